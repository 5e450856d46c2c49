"""The pipeline's stages on tables of their own, against plain versions, and run() as a whole."""

import re

import pytest

import corpus_pipeline
from driftline.llm import common, crf, line_dedup, near_dups, packing, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, keep boolean, tokens bigint, `a.b` int, s1 bigint"
EXTRA = ("r", True, 4, 5, 6)
STAGES = dict(corpus_pipeline.STAGES)
PROSE = "The river was low in the summer and the people of the village walked to the well that stood near the old church. "


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Documents of every awkward kind, and a folder that holds them."""
    near = " ".join(f"The stone{i} of the village was in the field{i}, and the people walked to the water{i} in the summer." for i in range(20))
    rows = [
        (1, PROSE * 3 + "\nshared line of a good length", "en"),
        (2, "something of its own in here\nshared line of a good length", "en"),
        (2, "something of its own in here\nshared line of a good length", "en"),
        (3, "shared line of a good length\nshared line of a good length", "en"),
        (4, near, "en"),
        (5, near.replace("stone7", "stick7"), "en"),
        (6, None, "en"),
        (7, "", None),
        (None, "a row without any id at all", "en"),
        (8, "Write to a.b@mail7.example.com now, or call +1 (017) 555-7713.", "xx"),
        (9, "word " * 30_000, "de"),
        (10, "    \n\n", "en"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *EXTRA) for i, t, lang in rows], SCHEMA)
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "personal data", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_is_the_stages(spark, table):
    """Each stage on what the one before kept, against a plain version; run() gives the last one's rows."""
    docs = common.read(spark, table, "documents")
    read = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)

    good = STAGES["quality rules"](spark, docs, table)
    assert good.columns == docs.columns
    bad = {r.row.text for r in quality.score(docs).where("not keep").collect()}
    want = [r for r in read(docs) if r[1] not in bad]
    assert read(good) == want and {1, 2, 3, 6, 7, 8, 10, None} <= {r[0] for r in want}

    seen, lines = set(), []
    for i, t, n in sorted(set(want), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        if not t:
            lines += [(i, t, n)]
            continue
        new = []
        for x in t.split("\n"):
            if len(x) < line_dedup.MIN_CHARS or not x.strip(" ") or x not in seen:
                new.append(x)
                seen |= {x} if len(x) >= line_dedup.MIN_CHARS else set()
        if "\n".join(new).strip(" ") != "":
            lines += [(i, "\n".join(new), len("\n".join(new)))] * want.count((i, t, n))
    left = STAGES["line dedup"](spark, good, table)
    assert left.columns == docs.columns and read(left) == sorted(lines, key=str)
    assert 3 not in {r[0] for r in lines}

    grams = lambda t: (lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set()))(re.findall(r"[0-9a-z]+", (t or "").lower()))
    alike = lambda a, b: len(a & b) >= 0.5 * len(a | b) > 0
    gone = {i for i, t, _ in lines for k, u, _ in lines if None not in (i, k) and k < i and alike(grams(t), grams(u))}
    one = STAGES["near duplicates"](spark, left, table)
    assert one.columns == docs.columns and read(one) == sorted((r for r in lines if r[0] not in gone), key=str)
    assert 5 in gone

    clean = STAGES["personal data"](spark, one, table)
    assert clean.columns == docs.columns and clean.count() == one.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[8] == "Write to <EMAIL> now, or call <PHONE>."
    assert all(texts[i] == t for i, t, _ in read(one) if i != 8)

    packed = STAGES["packing"](spark, clean, table).collect()
    tokens = {}
    for i, t, _ in read(clean):
        tokens[i] = tokens.get(i, 0) + common.bpe_lengths([t])[0]
    assert {i: sum(r.tokens for r in packed if r.doc_id == i) for i in tokens} == tokens
    bins = {}
    for r in packed:
        bins.setdefault((r.shard, r.bin), []).append(r)
    assert all(sum(r.tokens for r in b) <= 4096 and len(b) <= 32 and sorted(r.slot for r in b) == list(range(len(b))) for b in bins.values())

    spark.catalog.clearCache()
    assert sorted(map(str, corpus_pipeline.run(spark, table).collect())) == sorted(map(str, packed))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_modules_of_the_stages():
    """Each stage is an operator of the package."""
    assert {crf, line_dedup, near_dups, packing, quality} == {vars(corpus_pipeline)[n] for n in ("crf", "line_dedup", "near_dups", "packing", "quality")}
