"""Every threshold of the engine in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # scheduling and listing
    schedule_batch: int = 200
    notification_batch: int = 20
    page_size: int = 20
    page_size_most: int = 100
    # line cleaning
    clean_chars: int = 25_000
    clean_lines: int = 1_400
    clean_lines_chars: int = 650_000
    ocr_lines: int = 2_000
    wrap_at: int = 140
    line_most: int = 420
    dedupe_window: int = 80
    boilerplate_freq: int = 2
    boilerplate_chars: int = 90
    # character chunks and their diff
    chunk_chars: int = 900
    chunk_overlap: int = 120
    chunks_most: int = 60
    band: int = 2
    changed_at: float = 0.12
    changed_at_digits: float = 0.08
    significant_diff: float = 0.18
    significant_diff_digits: float = 0.14
    significant_ratio: float = 0.08
    significant_changed: int = 2
    text_reason_at: float = 0.05
    text_significant_at: float = 0.15
    # packed chunks
    pack_most: int = 2_200
    pack_least: int = 900
    pack_segments: int = 35
    one_liner_chars: int = 160
    # templates
    template_chunks_least: int = 3
    template_chunks_most: int = 18
    fit_reuse: float = 0.6
    fit_baseline: float = 0.55
    # evidence
    evidence_chunks: int = 14
    evidence_per_chunk: int = 4
    evidence_total: int = 10


DEFAULT = EngineConfig()
