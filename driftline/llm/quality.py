"""Quality rules by distribution divergence.

A document's character-class histogram and its common-word histogram are each
compared with the histogram of all documents in its language by Jensen-Shannon
distance (base 2, 0 to 1).  Histograms are counted in numpy over Arrow batches
(chains of JVM regular expressions took 20 times the CPU time); references and
distances are built-in expressions.  Documents are never shuffled: only one row
per partition and language is exchanged.

Defined results:

* null or empty text, text under a minimum length, a null language or one that
  has no reference: nothing to judge by, the document is kept, its distances
  are null where they can't be computed.
* very long texts are judged whole.
* repeated rows are judged alike and independently; other columns, whatever
  their names, neither matter nor clash.
* an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, read, runs_within

#: Common words by language, the axes of the word histogram.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "be", "by", "are", "this", "from", "at"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "plus", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "como"),
}
#: Character classes by Unicode category; the last takes what is left.
CHAR_CLASSES = ("Ll", "Lu", "white space", "punctuation", "N", "other")
WHITE, MARKS = " \n\t\r", ".,;:?'\"()-"
#: Text is counted in pieces of about so many characters, to stay in cache.
PIECE = 1 << 20


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; all lengths count the document's own characters and words."""

    max_char_distance: float = 0.08
    max_word_distance: float = 0.2
    #: Sampling noise allowed on each distance: slack / sqrt(length).
    char_slack: float = 2.4
    word_slack: float = 2.4
    min_chars: int = 200
    min_words: int = 12
    #: Documents this far from the first reference don't count in the second.
    trim_char_distance: float = 0.25


_TABLES: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        categories = [unicodedata.category(chr(c)) for c in range(0x110000)]
        kind = np.full(0x110000, 5, np.uint8)
        kind[[i for i, c in enumerate(categories) if c == "Ll"]] = 0
        kind[[i for i, c in enumerate(categories) if c == "Lu"]] = 1
        kind[[i for i, c in enumerate(categories) if c[0] == "N"]] = 4
        kind[list(map(ord, WHITE))] = 2
        kind[list(map(ord, MARKS))] = 3
        _TABLES["kind"] = kind
        _TABLES["letter"] = np.array([c[0] == "L" for c in categories])
    if "powers" not in _TABLES:
        _TABLES["powers"] = _powers(1 << 21)
    return _TABLES


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _word_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of letters, and where it starts."""
    edge = np.diff(_TABLES["letter"][codes].astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(codes) > len(_TABLES["powers"]):
        _TABLES["powers"] = _powers(len(codes) * 2)
    weights = _TABLES["powers"]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * weights[: len(codes)], out=total[1:])
    # both sides are brought to the weight of the piece's last character
    return (total[stop] - total[start]) * weights[len(codes) - 1 - start], start


def _common(n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language: hashes of its common words in a piece of n characters, in order, and their places."""
    out = {}
    for code, words in COMMON_WORDS.items():
        weights = _TABLES["powers"]
        h = []
        for w in words:
            c = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64)
            h.append(np.sum(c * weights[: len(c)]))
        h = np.array(h, np.uint64) * weights[n - 1]
        order = np.argsort(h)
        out[code] = h[order], order
    return out


def count_piece(texts: list[str], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class counts, common-word counts (the rest last) and word counts of each text."""
    n_axes = len(next(iter(COMMON_WORDS.values())))
    n = len(texts)
    chars, words, n_words = np.zeros((n, len(CHAR_CLASSES)), np.int64), np.zeros((n, n_axes + 1), np.int64), np.zeros(n, np.int64)
    tables = _tables()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return chars, words, n_words
    doc = np.repeat(np.arange(n), [len(t) for t in texts])
    chars += np.bincount(doc * len(CHAR_CLASSES) + tables["kind"][codes], minlength=chars.size).reshape(chars.shape)
    lower = [t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes, start = _word_hashes(codes)
    ends = np.cumsum([len(t) for t in lower])
    of = np.searchsorted(ends, start, "right")
    n_words += np.bincount(of, minlength=n)
    lang_of = np.array([x if x in COMMON_WORDS else "" for x in langs])
    for code, (known, place) in _common(len(codes)).items():
        mine = (lang_of == code)[of]
        h, o = hashes[mine], of[mine]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        words += np.bincount(o[hit] * (n_axes + 1) + place[at[hit]], minlength=words.size).reshape(words.shape)
    words[:, n_axes] = n_words - words.sum(axis=1)
    return chars, words, n_words


def _counts(text: pa.Array, lang: pa.Array) -> pa.Array:
    texts, langs = [t or "" for t in text.to_pylist()], lang.to_pylist()
    parts = [count_piece(texts[a:b], langs[a:b]) for a, b in runs_within(np.array([len(t) for t in texts]), PIECE)]
    n_axes = len(next(iter(COMMON_WORDS.values()))) + 1
    lists = []
    for k, width in ((0, len(CHAR_CLASSES)), (1, n_axes)):
        flat = np.concatenate([p[k].ravel() for p in parts]) if parts else np.zeros(0, np.int64)
        lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(flat)))
    total = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([*lists, pa.array(total)], ["chars", "words", "n_words"])


def _histograms(docs: DataFrame) -> DataFrame:
    """Columns ``row`` (all of the input's), lang, chars, words, n_words."""
    count = F.arrow_udf(_counts, "chars array<bigint>, words array<bigint>, n_words bigint")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col("lang").alias("lang"), count(F.col("text"), F.col("lang")).alias("n"))
    return d.select("row", "lang", "n.chars", "n.words", "n.n_words").withColumn("n_chars", _total(F.col("chars")))


def _sums(h: DataFrame) -> DataFrame:
    n_chars, n_words = len(CHAR_CLASSES), len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(n_words)]
    return h.groupBy("lang").agg(*sums).select(
        F.col("lang").alias("ref_lang"),
        F.array(*[f"c{i}" for i in range(n_chars)]).alias("ref_chars"),
        F.array(*[f"w{i}" for i in range(n_words)]).alias("ref_words"),
    ).select("*", _total(F.col("ref_chars")).alias("ref_n_chars"), _total(F.col("ref_words")).alias("ref_n_words"))


def language_references(histograms: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per language of ``COMMON_WORDS`` present: summed histograms.

    All documents make a first reference; those whose characters lie near it
    make the one returned, so that junk doesn't shift the standard.
    """
    h = histograms.where(F.col("lang").isin(*COMMON_WORDS)).select("lang", "chars", "words", "n_chars")
    first = F.broadcast(_sums(h))  # a row per language of COMMON_WORDS, at most
    near = h.join(first, F.col("lang") == F.col("ref_lang")).where(_char_distance() <= rules.trim_char_distance)
    return _sums(near.select("lang", "chars", "words"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x)


def js_distance(p: Column, q: Column, total_p: Column, total_q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either sums to 0."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    part = lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2
    divergence = F.aggregate(F.zip_with(p, q, lambda x, y: part(x / total_p, y / total_q)), F.lit(0.0), lambda s, x: s + x)
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _char_distance() -> Column:
    return js_distance(F.col("chars"), F.col("ref_chars"), F.col("n_chars"), F.col("ref_n_chars"))


def score(docs: DataFrame, rules: QualityRules = QualityRules(), carry: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (columns of the input as a struct), char_distance, word_distance, n_words, keep.

    With ``carry``, the row holds those columns only, and the text is read but
    once: histograms and carried columns are written, then scored.  Without it
    the row has every column and a second pass over the text scores it.
    """
    if carry is not None:
        h = _histograms(docs.select(*dict.fromkeys(("text", "lang", *carry))))
        h = written = cut(h.withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in carry])))
    else:
        h = _histograms(docs)
        written = cut(_histograms(docs.select("text", "lang")).drop("row"))
    refs = F.broadcast(language_references(written, rules))  # a row per language of COMMON_WORDS, at most
    h = h.join(refs, F.col("lang") == F.col("ref_lang"), "left")
    words = js_distance(F.col("words"), F.col("ref_words"), F.col("n_words"), F.col("ref_n_words"))
    h = h.select("row", "n_words", "n_chars", _char_distance().alias("char_distance"), words.alias("word_distance"))
    bad_chars = (F.col("n_chars") >= rules.min_chars) & (F.col("char_distance") > F.lit(rules.max_char_distance) + F.lit(rules.char_slack) / F.sqrt(F.col("n_chars")))
    bad_words = (F.col("n_words") >= rules.min_words) & (F.col("word_distance") > F.lit(rules.max_word_distance) + F.lit(rules.word_slack) / F.sqrt(F.col("n_words")))
    rejected = F.coalesce(bad_chars, F.lit(False)) | F.coalesce(bad_words, F.lit(False))
    return h.select("row", "char_distance", "word_distance", "n_words", (~rejected).alias("keep"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return score(docs, rules).where("keep").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    s = score(read(spark, sf_dir, "documents"), carry=("doc_id",))
    return s.select(F.col("row.doc_id").alias("doc_id"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), "n_words", "keep")
