"""N-gram Jaccard join by a MinHash LSH forest.

Signatures are min-hashes of word n-grams; documents of the same word sequence
are one text with a number of copies.  Each tree of the forest labels a text
with ``depth`` bytes of its signature; labels are put in order over all
partitions, which lays the prefix trie out, and the common prefix of two
neighbours is the depth of their node.

A match starts from the whole label and its prefix is shortened level by level:
pairs that share a prefix of d bytes in some tree are seen at level d with
probability 1 - (1 - j^d)^trees, so those seen tell how many there are, and
shortening ends at the first level that reaches the target recall in every
tenth of similarity (``adaptive_depth``).  Pairs that the whole signatures show
to be far below the threshold are left out; the others make components, whose
texts are verified exactly on their n-gram sets, computed again for them alone.

Defined results:

* one row for each row of the table, with the class (connected by links) and
  the number of linked documents; a document without links is its own class.
* words are runs of ASCII letters and digits (case ignored) and of non-ASCII
  characters.  Texts of fewer than ``n`` words are one n-gram; texts without a
  word (null, empty) match nothing.
* rows that agree in doc_id and words count as often as they occur; a null
  doc_id counts, but names no class: a class of null ids has a null class_id.
* very long texts are read whole; other columns are never read; an empty table
  gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, mix64, read, runs_within, text_buffer

PIECE = 1 << 19
HELD = 1 << 18  # rows of a node that are waited for
FILTER_BITS = 1 << 26
NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = [np.zeros(0, np.uint64)]


@dataclass(frozen=True)
class Settings:
    n: int = 3  # words of an n-gram
    threshold: float = 0.5
    trees: int = 40
    depth: int = 6  # bytes of a whole label
    recall: float = 0.9  # target in every tenth of similarity
    window: int = 6  # rows of a node before a row that are paired with it, in nodes of one row more at most
    task_grams: int = 2_000_000  # n-grams of a component that are verified in one task (a longer text alone)
    seed: int = 11

    def stop_depth(self) -> int:
        """The shortest prefix there is need for: with it, even pairs at the threshold itself are found at the target."""
        for d in range(self.depth, 0, -1):
            if 1 - (1 - self.threshold**d) ** self.trees >= self.recall:
                return d
        return 1

    def levels(self) -> range:
        return range(self.depth, self.stop_depth() - 1, -1)

    def slack(self) -> float:
        """Four standard deviations of a similarity at the threshold as the whole signature tells it."""
        return 4 * (self.threshold * (1 - self.threshold) / (self.trees * self.depth)) ** 0.5


# --- n-grams of a batch, without a loop over words


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 1 << 20), _BASE, np.uint64)
        p[0] = 1
        _POWERS[0] = np.cumprod(p)
    return _POWERS[0][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words by document."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[data]
    first = inside[1:] & ~inside[:-1]  # a word starts here
    past = ~inside[1:] & inside[:-1]  # or ended before
    split = offsets[1:-1]
    split = split[(split > 0) & (split < n)]
    both = split[inside[split] & inside[split + 1]]  # documents that touch
    first[both] = past[both] = True
    start, stop = np.flatnonzero(first[: n + 1]), np.flatnonzero(past[: n + 1])
    total = np.zeros(n + 1, np.uint64)
    p = _powers(n)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    # brought to the weight of a fixed place, which makes it independent of the batch
    h = (total[stop] - total[start]) * _inverse_powers(n)[start] if len(start) else np.zeros(0, np.uint64)
    words = np.diff(np.searchsorted(start, offsets))
    return mix64(h), words


_INVERSE = [np.zeros(0, np.uint64)]


def _inverse_powers(n: int) -> np.ndarray:
    if len(_INVERSE[0]) < n:
        p = np.full(max(n, 1 << 20), pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = 1
        _INVERSE[0] = np.cumprod(p)
    return _INVERSE[0]


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes in order, their number by document, and a hash of each document's word sequence (two columns)."""
    words, count = word_hashes(data, offsets)
    ends = np.cumsum(count)
    begins = ends - count
    # of a document's word sequence
    sequence = np.zeros((len(count), 2), np.uint64)
    place = np.arange(len(words)) - np.repeat(begins, count)
    for k, salt in enumerate((1, 2)):
        weighted = mix64(words ^ mix64(np.full(1, salt, np.uint64))) * (mix64(place.astype(np.uint64) + np.uint64(salt)) | np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted)])
        sequence[:, k] = sums[ends] - sums[begins]
    grams = np.maximum(count - n + 1, (count > 0).astype(count.dtype))
    short = (count > 0) & (count < n)
    first = np.repeat(begins, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    last = np.repeat(np.where(short, ends - 1, 0), grams)
    is_short = np.repeat(short, grams)
    h = np.zeros(len(first), np.uint64)
    for i in range(n):
        at = first + i
        real = ~is_short | (at <= last)
        at = np.minimum(at, max(len(words) - 1, 0))
        step = mix64(h * np.uint64(31) + words[at]) if len(words) else h
        h = np.where(real, step, h)
    return h, grams, sequence


def min_hashes(grams: np.ndarray, count: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """Documents (with n-grams) x hashes, the low byte of each minimum, mixed."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
    salt = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    full = count > 0
    starts = (np.cumsum(count) - count)[full]
    out = np.zeros((int(full.sum()), hashes), np.uint8)
    for k in range(hashes):
        v = (x ^ salt[k]) * factor[k]
        v ^= v >> np.uint32(15)
        low = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), starts)
        out[:, k] = (mix64(low.astype(np.uint64)) >> np.uint64(13)).astype(np.uint8)
    return out


def _bytes_column(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, s1, s2 (hash of the word sequence), n_grams, signature; nulls but for the id where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(b.column("text"))
            ids = b.column("doc_id")
            for x, y in runs_within(np.diff(off), PIECE):
                grams, count, seq = shingles(data[off[x] : off[y]], off[x : y + 1] - off[x], s.n)
                some = count > 0
                sig = _bytes_column(min_hashes(grams, count, s.trees * s.depth, s.seed))
                place = pa.array(np.cumsum(some) - 1, pa.int64(), mask=~some)
                columns = [pa.array(v, mask=~some) for v in (seq[:, 0].view(np.int64), seq[:, 1].view(np.int64), count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), *columns, sig.take(place)], ["doc_id", "s1", "s2", "n_grams", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, s1 bigint, s2 bigint, n_grams bigint, signature binary")


def distinct_texts(signed: DataFrame) -> DataFrame:
    """s1, s2, signature, n_grams, rep (least doc_id), copies of each word sequence; what a hot text adds is summed before the shuffle."""
    return signed.where("s1 is not null").groupBy("s1", "s2").agg(F.first("signature").alias("signature"), F.first("n_grams").alias("n_grams"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))


# --- the forest


def common_bytes(x: np.ndarray, depth: int) -> np.ndarray:
    """Bytes of a label that agree from its start, by the xor of two labels."""
    return depth - sum((x >> np.int64(8 * m) != 0).astype(np.int8) for m in range(depth))


def node_edges(key: np.ndarray, s1: np.ndarray, s2: np.ndarray, s: Settings, open_ends: tuple[bool, bool]) -> list[np.ndarray]:
    """level, chain, a1, a2, b1, b2 of sorted rows of whole nodes.

    All pairs of a node of ``window`` + 1 rows at most, and each two neighbours
    (chain) of a larger one; ``open_ends``: the first or last node goes on elsewhere.
    """
    n = len(key)
    node = key >> np.int64(8 * (s.depth - s.stop_depth()))
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(first, n))
    chain = size > s.window + 1
    chain[0] |= open_ends[0]
    chain[-1] |= open_ends[1]
    run = np.repeat(np.arange(len(first)), size)
    level, found = np.full(n, s.depth, np.int8), []
    step = np.concatenate([[0], common_bytes(key[1:] ^ key[:-1], s.depth)]).astype(np.int8)
    for k in range(1, min(s.window, n - 1) + 1):
        level = np.minimum(level[: n - k], step[k:])
        ok = run[k:] == run[:-k]
        if k > 1:
            ok &= ~chain[run[k:]]
        i = np.flatnonzero(ok)
        if len(i):
            found.append((level[i], chain[run[i]], s1[i], s2[i], s1[i + k], s2[i + k]))
    return [np.concatenate(c) for c in zip(*found)] if found else []


def _ordered(level, chain, a1, a2, b1, b2) -> pa.RecordBatch | None:
    differ = (a1 != b1) | (a2 != b2)
    swap = (b1 < a1) | ((b1 == a1) & (b2 < a2))
    cols = [np.where(swap, b1, a1), np.where(swap, b2, a2), np.where(swap, a1, b1), np.where(swap, a2, b2)]
    arrays = [pa.array(level[differ], pa.int8()), pa.array(chain[differ]), pa.nulls(int(differ.sum()), pa.int64()), *(pa.array(c[differ]) for c in cols)]
    return pa.RecordBatch.from_arrays(arrays, ["level", "chain", "key", "a1", "a2", "b1", "b2"])


_EDGE = "level tinyint, chain boolean, key bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint"


def edges(texts: DataFrame, s: Settings) -> DataFrame:
    """a1, a2, b1, b2, level, chain: texts that share a prefix of ``level`` bytes in some tree.

    Labels are put in order over all partitions, so even a node that holds a
    third of all texts is spread; what meets at the ends of partitions is
    linked in a second step over two rows a partition.
    """
    depth = s.depth

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = b.column("signature")
            sig = np.frombuffer(sig.buffers()[2], np.uint8, n * s.trees * depth, sig.offset * s.trees * depth).reshape(n, s.trees, depth)
            key = np.broadcast_to(np.arange(s.trees, dtype=np.int64), (n, s.trees)).copy()
            for d in range(depth):
                key = key << np.int64(8) | sig[:, :, d]
            take = pa.array(np.repeat(np.arange(n), s.trees))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), b.column("s1").take(take), b.column("s2").take(take)], ["key", "s1", "s2"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        begun = opened = False
        ends: list[list[int]] = []
        for b in batches:
            if not b.num_rows:
                continue
            if not ends:
                ends.append([b.column(i)[0].as_py() for i in range(3)])
            held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            node = held[0] >> np.int64(8 * (depth - s.stop_depth()))
            last = int(np.searchsorted(node, node[-1]))
            large = len(node) - last > HELD  # such a node isn't waited for: its rows are chained as they come
            if large:
                last = len(node)
            if last:
                if found := node_edges(*(h[:last] for h in held), s, (opened or not begun, large)):
                    yield _ordered(*found)
                held = [h[last - 1 if large else last :] for h in held]
                begun, opened = True, large
        if len(held[0]):
            ends.append([int(h[-1]) for h in held])
            if found := node_edges(*held, s, (opened or not begun, True)):
                yield _ordered(*found)
        if ends:
            none = pa.nulls(len(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int8()), pa.nulls(len(ends), pa.bool_()), *(pa.array([e[i] for e in ends], pa.int64()) for i in range(3)), none, none], ["level", "chain", "key", "a1", "a2", "b1", "b2"])

    def link_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(0, np.int64)] * 3
        for b in batches:
            if b.num_rows:
                rows = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(before)]
                if found := node_edges(*rows, replace(s, window=1), (True, True)):
                    yield _ordered(found[0], np.ones(len(found[0]), bool), *found[2:])
                before = [r[-1:] for r in rows]

    rows = texts.select("s1", "s2", "signature").mapInArrow(labels, "key bigint, s1 bigint, s2 bigint")
    found = cut(rows.repartitionByRange("key", "s1", "s2").sortWithinPartitions("key", "s1", "s2").mapInArrow(link, _EDGE))
    ends = found.where("key is not null").select("key", F.col("a1").alias("s1"), F.col("a2").alias("s2")).repartition(1).sortWithinPartitions("key", "s1", "s2").mapInArrow(link_ends, _EDGE)
    return found.where("key is null").unionByName(ends).groupBy("a1", "a2", "b1", "b2").agg(F.max("level").alias("level"), F.max("chain").alias("chain"))


def estimated(found: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``found`` with j, the similarity that the two whole signatures tell."""
    for side in "ab":
        found = found.join(texts.select(F.col("s1").alias(f"{side}1"), F.col("s2").alias(f"{side}2"), F.col("signature").alias(f"{side}_sig")), [f"{side}1", f"{side}2"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = s.trees * s.depth
        for b in batches:
            x, y = (np.frombuffer(c.buffers()[2], np.uint8, b.num_rows * width, c.offset * width).reshape(-1, width) if b.num_rows else np.zeros((0, width), np.uint8) for c in (b.column("a_sig"), b.column("b_sig")))
            j = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a1", "a2", "b1", "b2", "level", "chain")), pa.array(j, pa.float64())], ["a1", "a2", "b1", "b2", "level", "chain", "j"])

    return found.select("a1", "a2", "b1", "b2", "level", "chain", "a_sig", "b_sig").mapInArrow(compare, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, level tinyint, chain boolean, j double")


def adaptive_depth(found: DataFrame, s: Settings) -> int:
    """Where shortening ends: the longest prefix whose estimated recall reaches the target.

    Of the pairs with similarity j, a prefix of d bytes shows the share
    p = 1 - (1 - j^d)^trees; so each pair seen at d stands for 1/p pairs.  The
    target must be reached in every tenth of similarity that has pairs.
    """
    band = F.least(F.floor((F.col("j") - s.threshold) * 10), F.lit(9)).cast("int")
    sums = [F.sum(F.when(F.col("level") >= d, 1.0)).alias(f"seen{d}") for d in s.levels()]
    sums += [F.sum(F.when(F.col("level") >= d, 1 / (1 - F.pow(1 - F.pow(F.least("j", F.lit(1.0)), F.lit(d)), F.lit(s.trees))))).alias(f"all{d}") for d in s.levels()]
    bands = found.where(F.col("j") >= s.threshold).groupBy(band.alias("band")).agg(*sums).collect()  # ten rows at most
    for d in s.levels():
        if bands and all((r[f"seen{d}"] or 0) >= s.recall * (r[f"all{d}"] or 1) for r in bands):
            return d
    return s.stop_depth()


def components(edges: DataFrame) -> DataFrame:
    """s1, s2, c1, c2: the least text of each text's component.

    Hash-to-min with both star rewritings; each round is written, and rounds
    go on until none changes anything.
    """
    a, b = F.struct(F.col("a1").alias("x"), F.col("a2").alias("y")), F.struct(F.col("b1").alias("x"), F.col("b2").alias("y"))
    e = edges.select(a.alias("u"), b.alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large star: every greater neighbour goes to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(least, "u")
        e = cut(j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("u"), F.col("v")).distinct()
    return e.unionByName(roots).select(F.col("u.x").alias("s1"), F.col("u.y").alias("s2"), F.col("v.x").alias("c1"), F.col("v.y").alias("c2"))


# --- exact verification


def _wanted_filter(wanted: DataFrame):
    """Broadcast Bloom filter of FILTER_BITS bits, whatever the number of rows, of column ``h``."""
    pieces = max(1, FILTER_BITS >> 22)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            for p in np.unique(at >> 22):
                m = maps.setdefault(int(p), np.zeros(min(FILTER_BITS, 1 << 22), bool))
                m[at[at >> 22 == p] & ((1 << 22) - 1)] = True
        for p, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(m).tobytes()], pa.binary())], ["piece", "bits"])

    places = [F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(FILTER_BITS - 1))]
    at = wanted.select(F.explode(F.array(*places)).alias("at"))
    made = at.repartition(pieces, F.shiftright("at", 22)).mapInArrow(fill, "piece int, bits binary").collect()  # FILTER_BITS / 8 bytes in all
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in made:
        part = np.frombuffer(r.bits, np.uint8)
        bits[r.piece << 19 : (r.piece << 19) + len(part)] = part
    return wanted.sparkSession.sparkContext.broadcast(bits)


def _key(s1: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(s1.view(np.uint64) ^ mix64(doc.view(np.uint64) ^ np.uint64(77)))


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """s1, s2, grams (sorted distinct n-grams) of the wanted texts (s1, rep), from the documents of these ids.

    What the filter lets through without being wanted falls out in the join.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _key(b.column(0).to_numpy(), b.column(1).fill_null(NO_ID).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    shared = _wanted_filter(wanted.select("s1", "rep").mapInArrow(hashed, "h bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for b in batches:
            data, off = text_buffer(b.column("text"))
            doc = b.column("doc_id").fill_null(NO_ID).to_numpy()
            for x, y in runs_within(np.diff(off), PIECE):
                grams, count, seq = shingles(data[off[x] : off[y]], off[x : y + 1] - off[x], s.n)
                ends, h = np.cumsum(count), _key(seq[:, 0].view(np.int64), doc[x:y])
                ok = count > 0
                for at in (h & np.uint64(FILTER_BITS - 1), (h >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
                    ok &= (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
                out = []
                seq = seq.view(np.int64)
                for i in np.flatnonzero(ok).tolist():
                    key = (int(seq[i, 0]), int(seq[i, 1]))
                    if key not in seen:  # rows that repeat id and text
                        seen.add(key)
                        out.append((*key, np.unique(grams[ends[i] - count[i] : ends[i]].view(np.int64))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["s1", "s2", "grams"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "s1 bigint, s2 bigint, grams array<bigint>")


def _columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set and column of each mark, and the weight of each column.

    N-grams that are in the very same sets are one column that weighs as many;
    an n-gram of one set is in no intersection and has none.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kept = np.bincount(flat)[flat] > 1
    rows, flat = rows[kept], flat[kept]
    if not len(flat):
        return rows, flat, np.zeros(0)
    order = np.argsort(flat, kind="stable")
    rows, flat = rows[order], flat[order]
    marks = np.random.default_rng(5).integers(0, 1 << 64, (len(sets), 2), dtype=np.uint64)  # 128 bits tell sets of rows apart
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    who = np.stack([np.add.reduceat(marks[rows, k], starts) for k in range(2)], axis=1)
    by = np.lexsort((who[:, 1], who[:, 0]))
    new = np.concatenate([[True], (who[by][1:] != who[by][:-1]).any(axis=1)])
    column = np.empty(len(starts), np.int64)
    column[by] = np.cumsum(new) - 1
    weight = np.bincount(column).astype(np.float64)
    take = np.zeros(len(starts), bool)
    take[by[new]] = True
    spans = np.diff(np.append(starts, len(flat)))
    chosen = np.repeat(take, spans)
    rows, flat = rows[chosen], np.repeat(column, spans)[chosen]
    order = np.argsort(rows, kind="stable")
    return rows[order], flat[order], weight


def similarity_blocks(sets: list[np.ndarray], left: int, apart: bool = False, block: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
    """i, k, exact Jaccard similarities of sets i.. with sets k.., block by block.

    The first ``left`` sets against all sets from themselves on, or (``apart``)
    against those after them only.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    rows, flat, weight = _columns(sets)
    wide, step = len(weight), 1 << 13
    bounds = np.searchsorted(rows, np.arange(n + 1))
    for i in range(0, left, block):
        a = min(i + block, left)
        for k in range(left if apart else i, n, block):
            b = min(k + block, n)
            common = np.zeros((a - i, b - k), np.float64)
            for c in range(0, wide, step):
                width = min(step, wide - c)
                x, y = np.zeros((a - i, width), np.float32), np.zeros((b - k, width), np.float32)
                for m, lo, hi in ((x, i, a), (y, k, b)):
                    r, f = rows[bounds[lo] : bounds[hi]], flat[bounds[lo] : bounds[hi]]
                    here = (f >= c) & (f < c + step)
                    m[r[here] - lo, f[here] - c] = 1.0
                x *= weight[c : c + width].astype(np.float32)
                common += x @ y.T
            yield i, k, common / (sizes[i:a, None] + sizes[None, k:b] - common)


def to_one(sets: list[np.ndarray], pivot: np.ndarray) -> np.ndarray:
    """Similarity of each set with ``pivot``; all are sorted."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    hit = pivot[np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)] == flat
    common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (sizes + len(pivot) - common)


def _merge(label: np.ndarray, members: np.ndarray) -> None:
    """Give all classes of ``members`` their least label."""
    found = np.unique(label[members])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def links_in_block(sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray, pivot: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """links (copies of linked texts in the block), core, label of the block's texts.

    Jaccard distance is a metric: texts within half the allowed distance of
    the pivot (the core) are all linked with each other, which needs no
    comparison.  The others are compared with all.
    """
    n = len(sets)
    j = to_one(sets, sets[pivot])
    core = j >= (1 + threshold) / 2
    label = np.arange(n)
    label[core] = pivot
    links = np.where(core & own, copies[core & own].sum() - copies, 0).astype(np.int64)
    if n == 2 and own.all():
        if not core.all() and j[1 - pivot] >= threshold:
            links, label = copies[::-1].copy(), np.full(2, pivot)
        return links, core, label
    outer = np.flatnonzero(~core & own)
    order = np.concatenate([outer, np.flatnonzero(core & own)])
    if len(outer):
        for i, k, m in similarity_blocks([sets[x] for x in order], len(outer)):
            linked = m >= threshold
            left, right = order[i : i + len(m)], order[k : k + m.shape[1]]
            if i == k:  # each pair of outer texts once, none with itself
                linked &= ~np.tri(*linked.shape, dtype=bool)
            links[left] += linked @ copies[right]
            links[right] += linked.T @ copies[left]
            for x in np.flatnonzero(linked.any(axis=1)):
                _merge(label, np.append(right[linked[x]], left[x]))
    return links, core, label


def verified(docs: DataFrame, texts: DataFrame, comp: DataFrame, s: Settings) -> DataFrame:
    """s1, s2, r1, r2, links: class (its least text) and number of links of each text that may have one.

    The n-grams of a component are dealt to blocks of ``task_grams``; within
    a block its texts are verified, and between two blocks only those outside
    the core meet all of the other.
    """
    c = comp.join(texts.select("s1", "s2", "n_grams", "rep", "copies"), ["s1", "s2"])
    blocks = c.groupBy("c1", "c2").agg(F.sum("n_grams").alias("all"), F.count("*").alias("texts"), F.max_by(F.struct("s1", "s2"), F.struct("weight", "s1", "s2")).alias("pivot"))
    blocks = blocks.where("texts > 1").select("c1", "c2", F.ceil(F.col("all") / s.task_grams).cast("int").alias("blocks"), F.col("pivot.s1").alias("p1"), F.col("pivot.s2").alias("p2"))
    c = c.join(blocks, ["c1", "c2"])
    own = F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")
    wanted = cut(c.select("s1", "s2", "rep", "copies", "c1", "c2", "blocks", own.alias("own"), ((F.col("s1") == F.col("p1")) & (F.col("s2") == F.col("p2"))).alias("pivot")))
    sets = _sets(docs, wanted, s)
    rows = cut(sets.join(wanted.drop("rep"), ["s1", "s2"]).dropDuplicates(["s1", "s2"]))
    visits = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))

    def unpacked(table: pa.Table):
        grams = table.column("grams").combine_chunks()
        at, flat = grams.offsets.to_numpy(), grams.values.to_numpy()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])], *(table.column(k).to_numpy() for k in ("s1", "s2", "copies"))

    def within(table: pa.Table) -> pa.Table:
        sets, s1, s2, copies = unpacked(table)
        own = table.column("own").to_numpy() == table.column("block").to_numpy()
        pivot = int(np.flatnonzero(table.column("pivot").to_numpy(zero_copy_only=False))[0])
        links, core, label = links_in_block(sets, copies, own, pivot, s.threshold)
        at = np.flatnonzero(own)
        n = [table.column(k).take(pa.array(at)) for k in ("s1", "s2", "c1", "c2", "own", "blocks", "copies")]
        return pa.table([*n, pa.array(core[at]), pa.array(links[at]), pa.array(s1[label[at]]), pa.array(s2[label[at]])], names=["s1", "s2", "c1", "c2", "own", "blocks", "copies", "core", "links", "r1", "r2"])

    done = cut(rows.withColumn("block", F.explode(visits)).groupBy("c1", "c2", "block").applyInArrow(within, "s1 bigint, s2 bigint, c1 bigint, c2 bigint, own int, blocks int, copies bigint, core boolean, links bigint, r1 bigint, r2 bigint"))
    alone = done.where("blocks = 1").select("s1", "s2", "r1", "r2", "links")
    many = done.where("blocks > 1")
    if many.isEmpty():
        return alone
    cores = many.where("core").groupBy("c1", "c2", "own").agg(F.sum("copies").alias("here"))
    cores = cores.join(cores.groupBy("c1", "c2").agg(F.sum("here").alias("everywhere")), ["c1", "c2"])
    elsewhere = many.where("core").join(cores, ["c1", "c2", "own"]).select("s1", "s2", (F.col("everywhere") - F.col("here")).alias("links"))
    travels = rows.where("blocks > 1").join(many.select("s1", "s2", "core"), ["s1", "s2"]).select("s1", "s2", "c1", "c2", "own", "blocks", "copies", "core", "grams")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    guests = travels.where("not core").withColumn("at", F.explode(others)).withColumn("of", F.col("own"))
    senders = many.where("not core").select("c1", "c2", F.col("own").alias("of")).distinct()
    hosts = travels.join(senders, ["c1", "c2"]).where("own <> of").withColumn("at", F.col("own"))

    def between(table: pa.Table) -> pa.Table:
        sets, s1, s2, copies = unpacked(table)
        guest = table.column("own").to_numpy() != table.column("at").to_numpy()
        core = table.column("core").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(guest), np.flatnonzero(~guest)])
        links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
        if guest.any() and not guest.all():
            for i, k, m in similarity_blocks([sets[x] for x in order], int(guest.sum()), apart=True):
                linked = m >= s.threshold
                left, right = order[i : i + len(m)], order[k : k + m.shape[1]]
                links[left] += linked @ np.where(core[right], copies[right], 0)  # with the others when they are guests there
                links[right] += linked.T @ copies[left]
                for x in np.flatnonzero(linked.any(axis=1)):
                    _merge(label, np.append(right[linked[x]], left[x]))
        return pa.table([pa.array(v) for v in (s1, s2, links, s1[label], s2[label])], names=["s1", "s2", "links", "r1", "r2"])

    columns = ["s1", "s2", "c1", "c2", "own", "copies", "core", "grams", "at", "of"]
    met = cut(guests.select(columns).unionByName(hosts.select(columns)).groupBy("c1", "c2", "at", "of").applyInArrow(between, "s1 bigint, s2 bigint, links bigint, r1 bigint, r2 bigint"))
    found = many.select("s1", "s2", "r1", "r2").unionByName(met.select("s1", "s2", "r1", "r2")).where("s1 <> r1 or s2 <> r2")
    joined = components(found.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("r1").alias("b1"), F.col("r2").alias("b2")))
    links = many.select("s1", "s2", "links").unionByName(elsewhere).unionByName(met.select("s1", "s2", "links")).groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    several = links.join(joined.select("s1", "s2", F.col("c1").alias("r1"), F.col("c2").alias("r2")), ["s1", "s2"], "left")
    several = several.select("s1", "s2", F.coalesce("r1", "s1").alias("r1"), F.coalesce("r2", "s2").alias("r2"), "links")
    return alone.unionByName(several)


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, links: one row for each document.

    Documents of similarity ``threshold`` or above are linked; ``class_id`` is the least doc_id that a
    document reaches over links, ``links`` the number of other documents it is linked with itself.
    """
    signed = cut(signatures(docs, s))
    texts = cut(distinct_texts(signed))
    seen = cut(estimated(edges(texts, s), texts, s))
    depth = adaptive_depth(seen, s)
    kept = seen.where(F.col("level") >= depth).where(F.col("chain") | (F.col("j") >= s.threshold - s.slack()))
    comp = components(kept)
    degree = kept.select(F.col("a1").alias("s1"), F.col("a2").alias("s2"), "j").unionByName(kept.select(F.col("b1").alias("s1"), F.col("b2").alias("s2"), "j")).groupBy("s1", "s2").agg(F.round(F.sum("j"), 6).alias("weight"))
    found = cut(verified(docs, texts, comp.join(degree, ["s1", "s2"]), s))
    ids = texts.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "rep", "copies")
    found = found.join(ids, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")))
    least = found.groupBy("r1", "r2").agg(F.min("rep").alias("class_id"))
    found = found.join(least, ["r1", "r2"]).select("t1", "t2", "class_id", "links")
    by_text = ids.join(found, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    with_words = signed.where("s1 is not null").join(by_text, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))).select("doc_id", "class_id", "links")
    return with_words.unionByName(signed.where("s1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def one_of_each_group(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with the least doc_id of every class.

    Rows repeating a doc_id are the same document and stay or go together; rows
    without a doc_id stay.
    """
    gone = classes(docs, s).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
