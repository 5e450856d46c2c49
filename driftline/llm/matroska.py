"""Matroska columns: containers parsed to packet tables.

``packets`` turns a binary column into a row per frame: track, timestamp, byte
range within the blob, key frame flag, lacing and whether a cue points at its
cluster.  Only ranges are returned, never payloads.  Elements are
variable-length EBML: ids keep their length marker, sizes lose it, and a size of
all ones is unknown and ends where an element of the parent's level begins.

Defined results:

* null or empty blobs have no rows.
* a damaged or cut blob has the packets before the damage and one last row with
  ``error`` set and every other packet column null.
* very long blobs are parsed whole; repeated rows are parsed alike; other
  columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import read

EBML, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, ENTRY, NUMBER, KIND, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
CLUSTER, CLUSTER_TIME, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS, CHAPTERS, ATTACHMENTS}
KINDS = {1: "video", 2: "audio", 17: "subtitle"}
LACINGS = ("none", "xiph", "fixed", "ebml")

SCHEMA = (
    "media_id bigint, packet int, track int, track_type string, codec string, timestamp_ns bigint, duration_ns bigint, "
    "keyframe boolean, lacing string, lace_index int, byte_start bigint, byte_end bigint, cluster_start bigint, cued boolean, error string"
)


class Damaged(ValueError):
    pass


def vint(b: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, all ones) of the variable-length integer at ``at``."""
    if at >= len(b):
        raise Damaged(f"ends within an element at {at}")
    first = b[at]
    if not first:
        raise Damaged(f"no length marker at {at}")
    n = 9 - first.bit_length()
    if at + n > len(b):
        raise Damaged(f"ends within an element at {at}")
    raw = int.from_bytes(b[at : at + n], "big")
    value = raw & ((1 << (7 * n)) - 1)
    return (raw if keep_marker else value), at + n, value == (1 << (7 * n)) - 1


def children(b: bytes, at: int, end: int, stop_at: set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of element, start of data, end of data) of the elements in [at, end).

    Stops before an id of ``stop_at``.  Data of unknown size reaches to ``end``.
    """
    while at < end:
        ident, p, _ = vint(b, at, keep_marker=True)
        if ident in stop_at:
            return
        size, p, unknown = vint(b, p)
        stop = end if unknown else p + size
        if stop > end:
            if ident in (SEGMENT, GROUP):  # what is whole within it still counts
                yield ident, at, p, end
            raise Damaged(f"element at {at} is cut off")
        yield ident, at, p, stop
        at = stop


def uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


@dataclass
class Packet:
    track: int
    time: int  # in ticks
    key: bool
    lacing: str
    lace_index: int
    start: int
    end: int
    cluster: int
    duration: int | None = None  # of the whole block, in ticks
    laced: int = 1  # frames of the block


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, tuple[str, str, int | None]] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster position
    segment: int = 0
    error: str | None = None


def frames(b: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; ``at`` is after the block's header."""
    if lacing == 0:
        return [(at, end)]
    if at >= end:
        raise Damaged(f"empty laced block at {at}")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise Damaged(f"fixed lacing doesn't divide the block at {at}")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if lacing == 1:
                size = 0
                while True:
                    if at >= end:
                        raise Damaged(f"lacing is cut off at {at}")
                    size, at = size + b[at], at + 1
                    if b[at - 1] < 255:
                        break
            else:
                raw, nxt, _ = vint(b, at)
                size = raw if i == 0 else sizes[-1] + raw - ((1 << (7 * (nxt - at) - 1)) - 1)
                at = nxt
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        if s < 0 or at + s > end:
            raise Damaged(f"lace sizes exceed the block at {at}")
        out.append((at, at + s))
        at += s
    return out


def _block(m: Media, b: bytes, a: int, z: int, cluster: int, cluster_time: int, key: bool | None, duration: int | None) -> None:
    track, p, _ = vint(b, a)
    if p + 3 > z:
        raise Damaged(f"block at {a} is cut off")
    time = cluster_time + int.from_bytes(b[p : p + 2], "big", signed=True)
    flags = b[p + 2]
    lacing = flags >> 1 & 3
    parts = frames(b, p + 3, z, lacing)
    for i, (x, y) in enumerate(parts):
        m.packets.append(Packet(track, time, bool(flags & 0x80) if key is None else key, LACINGS[lacing], i, x, y, cluster, duration, len(parts)))


def _cluster(m: Media, b: bytes, start: int, a: int, z: int, unknown: bool) -> int:
    """Parses a cluster; returns where it ends."""
    time, at = 0, a
    for ident, _, x, y in children(b, a, z, TOP | {SEGMENT, EBML} if unknown else frozenset()):
        if ident == CLUSTER_TIME:
            time = uint(b, x, y)
        elif ident == SIMPLE:
            _block(m, b, x, y, start, time, None, None)
        elif ident == GROUP:
            block, duration, refers = None, None, False
            for i2, _, x2, y2 in children(b, x, y):
                if i2 == BLOCK:
                    block = (x2, y2)
                elif i2 == DURATION:
                    duration = uint(b, x2, y2)
                elif i2 == REFERENCE:
                    refers = True
            if block:
                _block(m, b, *block, start, time, not refers, duration)
        at = y
    return at


def _segment(m: Media, b: bytes, a: int, z: int) -> None:
    m.segment, at = a, a
    while at < z:
        ident, p, _ = vint(b, at, keep_marker=True)
        size, p, unknown = vint(b, p)
        stop = z if unknown else p + size
        cut_off = stop > z
        stop = min(stop, z)
        if ident == CLUSTER:
            stop = _cluster(m, b, at, p, stop, unknown) if unknown else (_cluster(m, b, at, p, stop, False), stop)[1]
        elif ident == INFO:
            for i2, _, x, y in children(b, p, stop):
                if i2 == SCALE:
                    m.scale = uint(b, x, y)
        elif ident == TRACKS:
            for i2, _, x, y in children(b, p, stop):
                if i2 == ENTRY:
                    f = {i3: (x3, y3) for i3, _, x3, y3 in children(b, x, y)}
                    if NUMBER in f:
                        kind = uint(b, *f[KIND]) if KIND in f else 0
                        codec = b[slice(*f[CODEC])].rstrip(b"\0").decode("ascii", "replace") if CODEC in f else ""
                        m.tracks[uint(b, *f[NUMBER])] = (KINDS.get(kind, str(kind)), codec, uint(b, *f[DEFAULT_DURATION]) if DEFAULT_DURATION in f else None)
        elif ident == CUES:
            for i2, _, x, y in children(b, p, stop):
                if i2 == CUE:
                    time, places = 0, []
                    for i3, _, x3, y3 in children(b, x, y):
                        if i3 == CUE_TIME:
                            time = uint(b, x3, y3)
                        elif i3 == CUE_PLACES:
                            f = {i4: uint(b, x4, y4) for i4, _, x4, y4 in children(b, x3, y3)}
                            places.append((f.get(CUE_TRACK, 0), f.get(CUE_CLUSTER, -1)))
                    m.cues += [(time, t, pos) for t, pos in places]
        elif unknown:
            raise Damaged(f"element of unknown size at {at}")
        if cut_off:
            raise Damaged(f"element at {at} is cut off")
        at = stop


def parse(blob: bytes) -> Media:
    """All tracks, packets and cues of a container, up to any damage."""
    m, segments = Media(), 0
    try:
        head, at, _ = vint(blob, 0, keep_marker=True)
        if head != EBML:
            raise Damaged("no EBML header")
        for ident, _, x, y in children(blob, 0, len(blob)):
            if ident == SEGMENT:
                segments += 1
                _segment(m, blob, x, y)
        if not segments:
            raise Damaged("no segment")
    except Damaged as e:
        m.error = str(e)
    return m


def _rows(media_id: int | None, blob: bytes) -> Iterator[tuple]:
    m = parse(blob)
    cued = {m.segment + pos for _, _, pos in m.cues}
    for i, p in enumerate(m.packets):
        kind, codec, usual = m.tracks.get(p.track, (None, None, None))
        frame = p.duration * m.scale if p.duration is not None else usual
        if p.duration is not None and p.laced > 1:  # a block's duration is that of all its frames
            first, frame = frame * p.lace_index // p.laced, frame * (p.lace_index + 1) // p.laced - frame * p.lace_index // p.laced
        else:
            first = p.lace_index * (usual or 0)
        time = p.time * m.scale + first
        yield media_id, i, p.track, kind, codec, time, frame, p.key, p.lacing, p.lace_index, p.start, p.end, p.cluster, p.cluster in cued, None
    if m.error:
        yield (media_id, *[None] * 13, m.error)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    i32, i64, s, b = pa.int32(), pa.int64(), pa.string(), pa.bool_()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [i64, i32, i32, s, s, i64, i64, b, s, i32, i64, i64, i64, b, s]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def packets(media: DataFrame, id_col: str = "media_id", blob_col: str = "media") -> DataFrame:
    """The packet table of all containers in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for ident, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if blob.is_valid and len(data := blob.as_buffer()):
                    rows += _rows(ident, data.to_pybytes())
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return media.select(F.col(f"`{id_col}`").cast("bigint").alias("media_id"), F.col(f"`{blob_col}`").cast("binary").alias("media")).mapInArrow(run, SCHEMA)


# --- writing, for tables that hold no media of their own


def size_of(n: int, width: int | None = None) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(ident: int, data: bytes, unknown: bool = False) -> bytes:
    head = ident.to_bytes((ident.bit_length() + 7) // 8, "big")
    return head + (b"\x01" + b"\xff" * 7 if unknown else size_of(len(data))) + data


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(sizes: list[int], lacing: int) -> bytes:
    """Lacing header of frames of these sizes."""
    if lacing == 0:
        return b""
    out = bytes([len(sizes) - 1])
    if lacing == 1:
        for s in sizes[:-1]:
            out += b"\xff" * (s // 255) + bytes([s % 255])
    elif lacing == 3:
        out += size_of(sizes[0]) if len(sizes) > 1 else b""
        for a, s in zip(sizes[:-2], sizes[1:-1]):
            d = s - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            out += size_of(d + (1 << (7 * width - 1)) - 1, width)
    return out


def block(track: int, time: int, parts: list[bytes], lacing: int = 0, key: bool = True, simple: bool = True) -> bytes:
    flags = (0x80 if key and simple else 0) | lacing << 1
    return size_of(track) + time.to_bytes(2, "big", signed=True) + bytes([flags]) + laced([len(p) for p in parts], lacing) + b"".join(parts)


def container(tracks: list[tuple[int, int, str, int | None]], clusters: list[tuple[int, list[bytes]]], unknown: bool = False, scale: int = 1_000_000) -> bytes:
    """A file of the given tracks (number, kind, codec, default duration) and clusters (time, block elements), with cues at its end."""
    entries = b"".join(element(ENTRY, number(NUMBER, n) + number(KIND, k) + element(CODEC, c.encode()) + (number(DEFAULT_DURATION, d) if d else b"")) for n, k, c, d in tracks)
    body = element(INFO, number(SCALE, scale)) + element(TRACKS, entries)
    cues = b""
    for time, blocks in clusters:
        cues += element(CUE, number(CUE_TIME, time) + element(CUE_PLACES, number(CUE_TRACK, tracks[0][0]) + number(CUE_CLUSTER, len(body))))
        body += element(CLUSTER, number(CLUSTER_TIME, time) + b"".join(blocks), unknown)
    return element(EBML, element(0x4282, b"matroska")) + element(SEGMENT, body + element(CUES, cues), unknown)


def page_container(page_id: int, url: str | None, html: str | None) -> bytes | None:
    """A recording of a page: its html as video frames, its words, sixteen a frame, as laced audio, the url as a subtitle."""
    if html is None:
        return None
    data, clusters = html.encode(), []
    for c, at in enumerate(range(0, max(len(data), 1), 4096)):
        part, blocks = data[at : at + 4096], []
        for k in range(0, len(part), 512):
            blocks.append(element(SIMPLE, block(1, k // 8, [part[k : k + 512]], key=k == 0)))
        words, lacing = part.split(b" "), (page_id + c) % 3 + 1
        phrases = [b" ".join(words[k : k + 16]) for k in range(0, len(words), 16)]
        for k in range(0, len(phrases), 24):  # frames of one size where the lacing asks for it
            some = phrases[k : k + 24]
            width = max(map(len, some))
            some = [w.ljust(width) for w in some] if lacing == 2 else some
            blocks.append(element(SIMPLE, block(2, 5 + k, some, lacing)))
        if c == 0 and url:
            blocks.append(element(GROUP, element(BLOCK, block(3, 0, [url.encode()], simple=False)) + number(DURATION, 1000)))
        clusters.append((c * 1000, blocks))
    return container([(1, 1, "V_UNCOMPRESSED", None), (2, 2, "A_PCM/INT/LIT", 20_000_000), (3, 17, "S_TEXT/UTF8", None)], clusters, unknown=page_id % 2 == 1)


def page_media(pages: DataFrame) -> DataFrame:
    """media_id, media: the tables hold no media, so every page is recorded in a container of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, htmls = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([page_container(i or 0, u, h) for i, u, h in zip(ids, urls, htmls)], pa.binary())], ["media_id", "media"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "media_id bigint, media binary")


def query(spark, sf_dir: str) -> DataFrame:
    return packets(page_media(read(spark, sf_dir, "pages")))
