"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The public model at hand is of the BPE kind, so a best path is not one of
greatest score: a path is feasible if the model, given the text of any two
neighbouring pieces, would split it into just these two, and a text has exactly
one feasible path.  The lattice pass is the usual one: at every position the
piece that ends there and joins the path behind it is kept as a backpointer.
Only the positions within one maximum piece length can still be continued; as
soon as the backpointer paths from all of them meet in one boundary, the ids
before it are final and leave the window.

A piece boundary lies before every run of spaces that follows another
character, and around characters that no piece has, since no piece of the model
spans them (checked on loading).  Text is cut there first, and the ids of short
stretches are remembered.

Defined results:

* null text: null ids; empty text: no ids.
* characters without a piece become the ids of their UTF-8 bytes.
* very long texts, also without spaces, are encoded whole in bounded memory.
* repeated rows are encoded alike; other columns are never read; an empty table
  gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import PIECE_MODEL, read

SHORT = 48  # longest stretch that is remembered
REMEMBERED = 400_000
PAIRS_REMEMBERED = 2_000_000
PART = 256  # characters of a longer stretch between looks at what is final
SPACE = "▁"


class PieceModel:
    """Vocabulary of a SentencePiece BPE model, spaces written as spaces."""

    def __init__(self, path: str = PIECE_MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.score = {text[i]: sp.get_score(i) for i in plain}
        self.id_of = {text[i]: i for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.max_piece = max(map(len, self.id_of), default=1)
        if any(" " in t.lstrip(" ") for t in self.id_of):
            raise ValueError("a piece spans a word boundary; texts can't be cut at spaces")
        self.bytes_of = [b""] * size
        for i, t in text.items():
            self.bytes_of[i] = t.encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        in_pieces = set("".join(self.id_of))
        apart = "\n" if "\n" not in in_pieces else ""
        self.cut = re.compile(f"{apart}| +[^ {apart}]*|[^ {apart}]+" if apart else " +[^ ]*|[^ ]+").findall
        # single characters rank before all merges, then merges as they are applied
        merges = sorted((t for t in self.id_of if len(t) > 1), key=lambda t: (-self.score[t], len(t)))
        singles = [t for t in self.id_of if len(t) == 1]
        self.text = singles + merges
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.singles = len(singles)
        self.ids = [self.id_of[t] for t in self.text]
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: list[dict[int, bool]] = [{} for _ in self.text]  # by the second piece, then by the first
        self._known = 0
        #: Pieces read backwards; the rank of a whole one is under 0.
        self.backwards: dict = {}
        for t, r in self.rank.items():
            if r < self.singles or self.halves(r) != (r, r):  # others no merge makes
                node = self.backwards
                for c in reversed(t):
                    node = node.setdefault(c, {})
                node[0] = r

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the best-scored pair first, of equals the leftmost."""
        symbols, score = list(symbols), self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def halves(self, r: int) -> tuple[int, int]:
        """The two pieces whose merge makes piece ``r``; itself twice for a character or a piece merging never makes."""
        found = self._halves.get(r)
        if found is None:
            found, symbols, score = (r, r), list(self.text[r]), self.score
            while len(symbols) > 2:
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    s = score.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if len(symbols) == 2 and r >= self.singles:
                found = (self.rank[symbols[0]], self.rank[symbols[1]])
            self._halves[r] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b gives a and b again.

        Both are taken apart in the reverse order of merging; if a merge across
        the seam would ever have come first, they don't.
        """
        found = self._fits[b].get(a)
        if found is None:
            if self._known >= PAIRS_REMEMBERED:
                for known in self._fits:
                    known.clear()
                self._known = 0
            self._known += 1
            found = self._fits[b][a] = self._fits_now(a, b)
        return found

    def _fits_now(self, a: int, b: int) -> bool:
        if self.text[a][-1] == " " or (self.text[a] + self.text[b]).startswith("  "):
            return self.merge(list(self.text[a] + self.text[b])) == [self.text[a], self.text[b]]  # runs of spaces have equal scores
        next_undone = len(self.text) + 1
        while True:
            across = self.rank.get(self.text[a] + self.text[b])
            if across is not None and across < next_undone:
                return False
            if a > b:  # the left one was merged later
                next_undone, a2 = a, self.halves(a)[1]
                if a2 == a:
                    next_undone, b2 = b + 1, self.halves(b)[0]
                    if b2 == b:
                        return True
                    b = b2
                else:
                    a = a2
            else:
                next_undone, b2 = b + 1, self.halves(b)[0]
                if b2 == b:
                    next_undone, a2 = a, self.halves(a)[1]
                    if a2 == a:
                        return True
                    a = a2
                else:
                    b = b2

    def extend(self, text: str, ends: list[int]) -> None:
        """Carry the pass on to the end of ``text``.

        ``ends[i]`` is the rank of the piece that ends before i and joins the
        path behind it (-1: a character without a piece, -2: the start).
        """
        backwards, fits = self.backwards, self._fits
        for i in range(len(ends), len(text) + 1):
            node, j, found = backwards, i, []
            while j:
                j -= 1
                node = node.get(text[j])
                if node is None:
                    break
                if 0 in node:
                    found.append((j, node[0]))
            for j, r in reversed(found):  # the longest first; just one of them fits
                before = ends[j]
                if before < 0:
                    break
                fit = fits[r].get(before)
                if fit is None:
                    fit = self.fits(before, r)
                if fit:
                    break
            else:
                r = -1
            ends.append(r)

    def fallback(self, char: str) -> list[int]:
        return [self.byte_id.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]


class Online:
    """The pass over one stretch of text, fed in parts.

    Holds backpointers from the last final boundary on, and as many characters.
    """

    def __init__(self, model: PieceModel):
        self.m, self.text, self.ends = model, "", [-2]

    def feed(self, part: str) -> list[int]:
        """Ids that have become final."""
        m = self.m
        self.text += part
        m.extend(self.text, self.ends)
        last = len(self.text)
        open_ends = set(range(max(0, last - m.max_piece + 1), last + 1))  # what can still be continued
        while len(open_ends) > 1:  # go back along the latest path until all have met
            latest = max(open_ends)
            open_ends.remove(latest)
            open_ends.add(latest - self._length(latest))
        return self._commit(open_ends.pop())

    def finish(self) -> list[int]:
        return self._commit(len(self.text))

    def _length(self, i: int) -> int:
        return len(self.m.text[self.ends[i]]) if self.ends[i] >= 0 else 1

    def _commit(self, boundary: int) -> list[int]:
        out, i = [], boundary
        while i:
            out.append([self.m.ids[self.ends[i]]] if self.ends[i] >= 0 else self.m.fallback(self.text[i - 1]))
            i -= self._length(i)
        if boundary:
            self.text = self.text[boundary:]
            self.ends = self.ends[boundary:]
        return [x for ids in reversed(out) for x in ids]


class Encoder(dict):
    """Ids of stretches of text; remembers short ones."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.m = model
        self.ints = list(range(len(model.bytes_of)))

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        m = self.m
        if len(stretch) > SHORT:
            online = Online(m)
            parts = [online.feed(stretch[i : i + PART]) for i in range(0, len(stretch), PART)]
            return tuple(chain(*parts, online.finish()))
        ends = [-2]
        m.extend(stretch, ends)
        out, i = [], len(stretch)
        while i:  # everything is within the window, whose paths all end here
            r = ends[i]
            out.append([m.ids[r]] if r >= 0 else m.fallback(stretch[i - 1]))
            i -= len(m.text[r]) if r >= 0 else 1
        ints = self.ints
        ids = tuple(ints[x] for part in reversed(out) for x in part)
        if len(self) >= REMEMBERED:
            self.clear()
        self[stretch] = ids
        return ids

    def encode(self, text: str) -> array:
        if not text:
            return array("i")
        return array("i", chain.from_iterable(map(self.__getitem__, self.m.cut(" " + text.replace(SPACE, " ")))))

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.m.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str = PIECE_MODEL) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(PieceModel(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str = PIECE_MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding the ids gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            flat, ends, same = array("i"), [0], []
            texts = b.column("text").to_pylist()
            for t in texts:
                ids = e.encode(t or "")
                same.append(None if t is None else e.decode(ids) == t)
                flat.extend(ids)
                ends.append(len(flat))
            null = pa.array([t is None for t in texts], pa.bool_())
            ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(flat, np.int32)), mask=null).cast(pa.list_(pa.int32()))
            n = pa.array([None if t is None else y - x for t, x, y in zip(texts, ends, ends[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, ids, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_pieces bigint, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = PIECE_MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            text = [None if ids is None else e.decode(ids) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
