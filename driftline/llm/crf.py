"""Personal data found by a linear-chain conditional random field.

The model is trained here, on the driver, from a small labelled table made by
``training_rows`` (bounded by its parameter ``rows``), over word-shape features
of a token and its two neighbours.  Decoding is Viterbi over padded numpy
batches of token windows.

All tokens without a digit, ``@``, ``=`` or a long run of capitals have one and
the same feature, ``plain``.  ``Model.pause`` is how many plain tokens in a row
are certain to be read as "outside" whatever stands around them, which training
asserts; so only windows around other tokens are decoded, and the result is that
of decoding whole texts.

Defined results:

* null text stays null, empty text stays empty, both without spans.
* very long texts and long runs of numbers are decoded whole.
* repeated rows are masked alike; other columns pass through untouched, whatever
  their names; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import read

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Tokens that aren't plain hold one of these.
MARKED = re.compile(r"[0-9@=]|[A-Z]{12}")
_TOKEN = re.compile(r"[^ \n\t\r]+")
CONTEXT = 3
CELLS = 1 << 16  # tokens of one padded batch


# --- features

_OPEN, _CLOSE = "\"'([{<", "\"')]}>.,;:!?"


def core_of(token: str) -> tuple[int, int]:
    """[start, stop) of a token without the punctuation around it."""
    a, b = 0, len(token)
    while b > a and token[b - 1] in _CLOSE and not (token[b - 1] == ")" and "(" in token[a : b - 1]):
        b -= 1
    while a < b and token[a] in _OPEN and not (token[a] == "(" and ")" in token[a:b]):
        a += 1
    return a, b


def features(token: str) -> tuple[str, ...]:
    """Shape features of one token."""
    if not MARKED.search(token):
        return ("plain",)
    a, b = core_of(token)
    core = token[a:b] or token
    shape = re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"[0-9]", "9", core)))
    short = re.sub(r"(.)\1+", r"\1", shape)
    digits = shape.count("9")
    out = [f"shape={short[:24]}", f"digits={min(digits, 20)}", f"length={min(len(core), 44) // 4}", f"first={shape[:1]}", f"last={shape[-1:]}"]
    runs = [len(x) for x in re.findall(r"9+", shape)]
    out.append("runs=" + "-".join(map(str, runs[:8])))
    if "@" in core:
        out.append("at" if re.fullmatch(r"[^@]+@[^@]+\.[^@.]+", core) else "at?")
    if re.fullmatch(r"9{1,3}(\.9{1,3}){3}", shape):
        out.append("quad" if all(int(x) < 256 for x in core.split(".")) else "quad?")
    if re.fullmatch(r"[0-9a-f]{16,}", core) and digits:
        out.append("hex")
    if "=" in core:
        key, _, value = core.partition("=")
        out += ["key=" + ("secret" if re.search(r"(?i)pass|pwd|secret|token|key", key) else "other"), f"value={min(len(value), 40) // 8}", "value9" if re.search(r"[0-9]", value) else "valueA"]
    if re.fullmatch(r"[A-Z0-9]{16,}", core):
        out.append("caps+" if digits else "caps")
    if lead := re.match(r"A+", shape):
        out.append(f"lead={min(len(lead.group()), 5)}")
    if core.startswith(("AKIA", "ghp_", "sk-", "xox")):
        out.append("prefix")
    out.append("long" if max(runs, default=0) >= 13 else "runs<13")
    return tuple(out)


# --- the labelled table


def training_rows(rows: int = 600, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Labelled token sequences: the kinds in common formats, and look-alikes.

    ``rows`` bounds the table.
    """
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    caps = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    low = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(a, b)))
    word = lambda: rng.choice([low(1, 9), low(2, 9).capitalize(), low(2, 8) + rng.choice(".,;:!?"), rng.choice(["the", "and", "der", "la", "call", "Kontakt", "to", "de"])])
    octet = lambda: str(rng.randint(0, 255))
    personal = {
        "EMAIL": [
            lambda: f"{low(2, 9)}.{d(2)}@{low(3, 6)}{d(1)}.example.com",
            lambda: f"{low(2, 9)}@{low(3, 9)}.{low(2, 3)}",
            lambda: f"{low(2, 7)}.{low(2, 9)}@{low(3, 9)}.co.{low(2, 2)}",
            lambda: f"{low(2, 7)}_{low(2, 5)}{d(2)}+{low(2, 4)}@{low(3, 9)}-{low(2, 5)}.org",
            lambda: f"{low(3, 7).upper()}@{low(3, 9).upper()}.COM",
            lambda: f"{low(2, 9)}{d(rng.randint(1, 4))}@mail{d(1)}.{low(4, 8)}.net",
        ],
        "PHONE": [
            lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
            lambda: f"({d(3)}) {d(3)}-{d(4)}",
            lambda: f"{d(3)}-{d(3)}-{d(4)}",
            lambda: f"{d(3)}.{d(3)}.{d(4)}",
            lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}",
            lambda: f"+{d(2)} {d(3)} {d(7)}",
            lambda: f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}",
            lambda: f"+{d(11)}",
            lambda: f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ],
        "IP": [lambda: f"{octet()}.{octet()}.{octet()}.{octet()}"],
        "CARD": [lambda: "4" + d(15), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: "5" + d(15), lambda: "3" + d(14), lambda: d(16)],
        "SSN": [lambda: f"{d(3)}-{d(2)}-{d(4)}"],
        "IBAN": [lambda: f"DE{d(20)}", lambda: f"FR{d(2)}{d(10)}{caps(4)}{d(9)}", lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"ES{d(22)}", lambda: f"GB{d(2)}NWBK{d(14)}"],
        "SECRET": [
            lambda: f"password={hexa(18)}",
            lambda: f"password={low(4, 9)}{d(3)}",
            lambda: f"api_key={hexa(32)}",
            lambda: f"\x00token = \"{hexa(40)}\"",
            lambda: f"\x00token = {hexa(40)}",
            lambda: f"AKIA{caps(16)}",
            lambda: "AKIA" + low(16, 16).upper(),
            lambda: f"ghp_{low(6, 9)}{d(8)}{low(6, 9)}{d(8)}",
            lambda: f"sk-{low(8, 9)}{d(8)}{low(8, 9)}{d(6)}",
            lambda: hexa(40),
            lambda: f"secret={hexa(24)}",
        ],
    }
    alike = [
        lambda: f"{d(1)}.{d(1)}{rng.choice(['', '.'])}", lambda: f"{rng.randint(1900, 2099)}", lambda: f"{rng.randint(1900, 2099)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: d(rng.randint(1, 9)), lambda: d(rng.randint(1, 3)) + rng.choice(".,;%"), lambda: f"${d(2)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}",
        lambda: f"{low(1, 4)}={low(1, 6)}", lambda: f"{low(1, 3)}={d(2)}", lambda: f"{low(2, 6)}{d(1)}", lambda: f"({d(4)})", lambda: f"[{d(2)}]", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}-{d(2)}", lambda: "=", lambda: "==", lambda: f"@{low(3, 9)}",
        lambda: f"?page={d(1)}", lambda: f"https://{low(4, 8)}.example.com/{low(2, 5)}/{d(4)}", lambda: low(12, 20).upper(), lambda: low(12, 18).upper() + "!!", lambda: f"{d(1)}x{d(2)}", lambda: f"{d(2)}th", lambda: f"§{d(3)}", lambda: f"#{d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)} {d(2)}",
    ]
    out = []
    for i in range(rows):
        tokens, tags = [], []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
                tokens.append(word())
                tags.append("O")
            if rng.random() < 0.68:
                kind = KINDS[i % len(KINDS)] if rng.random() < 0.6 else rng.choice(KINDS)
                text = rng.choice(personal[kind])()
                if text[0] == "\x00":  # a name and a sign before the value
                    *before, value = text[1:].split(" ")
                    tokens += [*before, value]
                    tags += ["O"] * len(before) + [f"B-{kind}"]
                else:
                    parts = text.split(" ")
                    wrap = rng.random()
                    parts[-1] += rng.choice([".", ",", ")", ";"]) if wrap < 0.25 else ""
                    parts[0] = (rng.choice(["(", '"', "<"]) if wrap < 0.06 else "") + parts[0]
                    tokens += parts
                    tags += [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
            else:
                parts = rng.choice(alike)().split(" ")
                tokens += parts
                tags += ["O"] * len(parts)
        for _ in range(rng.randint(0, 3)):
            tokens.append(word())
            tags.append("O")
        out.append((tokens, tags))
    return out


# --- model


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weights: np.ndarray  # 3 x features x tags: of the token, of the one before, of the one after
    steps: np.ndarray  # tags x tags, -inf where not allowed
    first: np.ndarray  # tags
    pause: int = CONTEXT

    def emission(self, token: str) -> np.ndarray:
        """3 x tags: what the token adds to its own scores, to those of the next, of the one before."""
        ids = [self.index[f] for f in features(token) if f in self.index]
        return self.weights[:, ids].sum(axis=1) if ids else np.zeros((3, len(TAGS)))


def _allowed() -> np.ndarray:
    steps = np.zeros((len(TAGS), len(TAGS)))
    for a in TAGS:
        for b in TAGS:
            if b[0] == "I" and a[1:] != b[1:]:
                steps[_TAG[a], _TAG[b]] = -np.inf
    return steps


def fit(rows: list[tuple[list[str], list[str]]], epochs: int = 60, rate: float = 0.2, l2: float = 1e-4) -> Model:
    """Maximum likelihood by full-batch Adam on forward-backward gradients."""
    index: dict[str, int] = {}
    for tokens, _ in rows:
        for t in tokens:
            for f in features(t):
                index.setdefault(f, len(index))
    n, longest, k = len(rows), max(len(t) for t, _ in rows), len(TAGS)
    flat, own = [], []
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (tokens, tags) in enumerate(rows):
        for j, (t, tag) in enumerate(zip(tokens, tags)):
            ids = [index[f] for f in features(t)]
            flat += ids
            own += [i * longest + j] * len(ids)
            gold[i, j], mask[i, j] = _TAG[tag], True
    flat, own = np.array(flat), np.array(own)
    seen = np.zeros((n * longest, len(index)), np.float32)  # the table is small
    np.add.at(seen, (own, flat), 1.0)
    parts = [seen, np.zeros_like(seen), np.zeros_like(seen)]
    cube = seen.reshape(n, longest, -1)
    parts[1].reshape(cube.shape)[:, 1:] = cube[:, :-1]
    parts[2].reshape(cube.shape)[:, :-1] = cube[:, 1:]
    x = np.concatenate(parts, axis=1)
    x = x[mask.ravel()]
    at = np.flatnonzero(mask.ravel())
    allowed, lengths = _allowed(), mask.sum(axis=1)
    ban_first = np.array([-np.inf if t[0] == "I" else 0.0 for t in TAGS])
    theta = [np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros(k)]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    hot = np.eye(k)[gold] * mask[..., None]
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1.0)
    for epoch in range(1, epochs + 1):
        w, steps, first = theta[0], theta[1] + allowed, theta[2] + ban_first
        e = np.zeros((n * longest, k))
        e[at] = x @ w
        e = e.reshape(n, longest, k)
        # forward and backward in probabilities, scaled at every position
        odds, moves = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(steps)
        alpha, beta, scale = np.zeros((n, longest, k)), np.ones((n, longest, k)), np.ones((n, longest))
        for j in range(longest):
            new = (alpha[:, j - 1] @ moves if j else np.exp(first)) * odds[:, j]
            total = new.sum(axis=1)
            alpha[:, j] = np.where(mask[:, j, None], new / total[:, None], alpha[:, j - 1])
            scale[:, j] = np.where(mask[:, j], total, 1.0)
        pair = np.zeros((k, k))
        for j in range(longest - 1, 0, -1):
            ahead = np.where(mask[:, j, None], odds[:, j] * beta[:, j] / scale[:, j, None], 0.0)
            pair += moves * (alpha[:, j - 1].T @ ahead)
            beta[:, j - 1] = np.where(mask[:, j, None], ahead @ moves.T, 1.0)
        marginal = alpha * beta * mask[..., None]
        diff = (marginal - hot).reshape(n * longest, k)[at]
        grads = [x.T @ diff / n + l2 * w, (pair - gold_steps) / n + l2 * theta[1], (marginal[:, 0] - hot[:, 0]).sum(axis=0) / n + l2 * theta[2]]
        for t, g, (m, v) in zip(theta, grads, moments):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            t -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    f = len(index)
    weights = theta[0].reshape(3, f, k)
    model = Model(index, weights, theta[1] + allowed, theta[2] + ban_first)
    return Model(index, weights, model.steps, model.first, _pause(model))


def _pause(model: Model) -> int:
    """The least run of plain tokens whose middle is outside, however the run is entered and left.

    Around the run any tags may stand, at no cost of their own; the middle of
    the run is checked against the best way that avoids "outside" there.
    """
    plain = model.emission("plain").sum(axis=0)
    for run in range(3, 40, 2):
        def best(middle: np.ndarray, start: int, stop: int) -> float:
            score = np.full(len(TAGS), -np.inf)
            score[start] = 0.0
            for j in range(run):
                score = (score[:, None] + model.steps).max(axis=0) + plain + (middle if j == run // 2 else 0.0)
            return float((score + model.steps[:, stop]).max())

        only_o, not_o = np.full(len(TAGS), -np.inf), np.zeros(len(TAGS))
        only_o[0], not_o[0] = 0.0, -np.inf
        if all(best(only_o, a, b) >= best(not_o, a, b) for a in range(len(TAGS)) for b in range(len(TAGS)) if np.isfinite(best(only_o, a, b)) or np.isfinite(best(not_o, a, b))):
            return run
    raise ValueError("plain text isn't read as outside; train on more of it")


@lru_cache(maxsize=2)
def trained(rows: int = 600, seed: int = 7) -> Model:
    return fit(training_rows(rows, seed))


def viterbi(model: Model, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags of padded sequences (batch x longest x tags)."""
    n, longest, k = emissions.shape
    back = np.zeros((n, longest, k), np.int8)
    score = model.first + emissions[:, 0]
    ends = [score]
    for j in range(1, longest):
        through = score[:, :, None] + model.steps
        back[:, j] = through.argmax(axis=1)
        score = through.max(axis=1) + emissions[:, j]
        ends.append(score)
    tags = np.zeros((n, longest), np.int8)
    stacked = np.stack(ends, axis=1)
    now = stacked[np.arange(n), lengths - 1].argmax(axis=1)
    for j in range(longest - 1, -1, -1):
        inside = j < lengths
        tags[inside, j] = now[inside]
        step = inside & (j > 0)
        now = np.where(step, back[np.arange(n), j, now], now)
    return tags


def _windows(text: str, pause: int) -> Iterator[list[tuple[int, int]]]:
    """Token spans around marked tokens, apart by more plain tokens than matter."""
    spans: list[tuple[int, int]] = []
    last_marked, at, size = -1, 0, len(text)
    for m in MARKED.finditer(text):
        if m.start() < at:
            continue
        a = m.start()
        while a > 0 and text[a - 1] not in " \n\t\r":
            a -= 1
        b = m.end()
        while b < size and text[b] not in " \n\t\r":
            b += 1
        before: list[tuple[int, int]] = []
        p = a
        while len(before) < 2 * pause and p > at:  # plain tokens in front, back to the last marked one
            while p > at and text[p - 1] in " \n\t\r":
                p -= 1
            if p <= at:
                break
            q = p
            while p > at and text[p - 1] not in " \n\t\r":
                p -= 1
            before.append((p, q))
        before.reverse()
        if spans and len(before) == 2 * pause:
            yield spans + before[:pause]
            spans = []
            before = before[pause:]
        elif not spans:
            before = before[-pause:]
        spans += [*before, (a, b)]
        at = b
    if spans:
        after = []
        for m in _TOKEN.finditer(text, at):
            after.append(m.span())
            if len(after) == pause:
                break
        yield spans + after


class Finder:
    """Spans of personal data in texts; emissions of tokens are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, np.ndarray] = {}
        self.plain = model.emission("plain")

    def emission(self, token: str) -> np.ndarray:
        if not MARKED.search(token):
            return self.plain
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[token] = self.model.emission(token)
        return found

    def emissions(self, tokens: list[str]) -> np.ndarray:
        parts = np.stack([self.emission(t) for t in tokens])
        e = parts[:, 0].copy()
        e[1:] += parts[:-1, 1]
        e[:-1] += parts[1:, 2]
        return e

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and len(sequences[order[stop]]) * (stop + 1 - start) <= CELLS:
                stop += 1
            part = order[start:stop]
            lengths = np.array([len(sequences[i]) for i in part])
            e = np.zeros((len(part), lengths.max(), len(TAGS)))
            for row, i in enumerate(part):
                e[row, : lengths[row]] = self.emissions(sequences[i])
            for row, tags in enumerate(viterbi(self.model, e, lengths)):
                out[part[row]] = tags[: lengths[row]]
            start = stop
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, stop, kind) of each text's spans, in order."""
        windows, owner = [], []
        for i, t in enumerate(texts):
            if t:
                for w in _windows(t, self.model.pause):
                    windows.append(w)
                    owner.append(i)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for w, i, tags in zip(windows, owner, self.decode([[texts[i][a:b] for a, b in w] for w, i in zip(windows, owner)])):
            j = 0
            while j < len(w):
                tag = TAGS[tags[j]]
                if tag[0] == "B":
                    stop = j + 1
                    while stop < len(w) and TAGS[tags[stop]] == "I" + tag[1:]:
                        stop += 1
                    out[i].append(self.trim(texts[i], w[j][0], w[stop - 1][1], tag[2:]))
                    j = stop
                else:
                    j += 1
        return out

    @staticmethod
    def trim(text: str, a: int, b: int, kind: str) -> tuple[int, int, str]:
        piece = text[a:b]
        x, y = core_of(piece)
        if x >= y:
            x, y = 0, len(piece)
        if kind == "SECRET" and "=" in piece[x:y]:
            cut = x + piece[x:y].index("=") + 1
            if cut < y:
                x = cut
                while x < y - 1 and piece[x] in "\"'":
                    x += 1
        return a + x, a + y, kind


_FINDER: list[tuple[int, Finder]] = []


def _finder(shared) -> Finder:
    """One finder for each worker process and broadcast model."""
    key = id(shared.value)
    if not _FINDER or _FINDER[0][0] != key:
        _FINDER[:] = [(key, Finder(shared.value))]
    return _FINDER[0][1]


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Columns ``row`` (the input's, as they were), text (masked), spans.

    A span is (start, length, kind) in the original text, without its value.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())  # a few hundred features, whatever the input

    def run(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        found = _finder(shared).spans(texts)
        new = pa.array([masked(t, s) if s else t for t, s in zip(texts, found)], pa.string())
        spans = pa.array([[{"start": a, "length": b - a, "kind": k} for a, b, k in s] for s in found], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string())])))
        return pa.StructArray.from_arrays([new, spans], ["text", "spans"])

    find = F.arrow_udf(run, "text string, spans array<struct<start: int, length: int, kind: string>>")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), find(F.col("text")).alias("found")).select("row", "found.text", "found.spans")


def mask_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with the text masked and n_chars, where there is one, counted again."""
    m = mask(docs, model)
    cols = [F.col("text").alias(c) if c == "text" else F.coalesce(F.length("text").cast("bigint"), F.col(f"row.`{c}`").cast("bigint")).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return m.select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    m = mask(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select(F.col("row.doc_id").alias("doc_id"), "text", F.size("spans").alias("n_spans"), "spans")
