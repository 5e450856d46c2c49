"""Queries over small tables of their own, on which a job that leaves rows or text out gives other rows."""

import pytest

from driftline.plans import registry


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over one table."""

    def rows(query, table, schema, data):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return registry.QUERIES[query](spark, str(tmp_path)).collect()

    return rows


DOCUMENTS = "doc_id bigint, source string, lang string, text string"


def test_chunk_full_outer_diff(run):
    para = lambda k: f"Paragraph {k} begins. " + f"word{k} other{k} " * 100 + "ends."
    long = "\n\n".join(map(para, range(8)))
    assert len(long) > 4000
    docs = [(1, "a", long), (51, "a", long.replace("word7 other7", "changed7 text7")), (101, "a", para(0)), (2, "b", "short one."), (3, "b", "short one."), (4, "b", "")]
    rows = run("chunk_full_outer_diff", "documents", DOCUMENTS, [(k, s, "en", x) for k, s, x in docs])
    of = lambda k: {r.chunk_id: r.change for r in rows if r.doc_id == k}
    n = len(of(1))
    ids = [f"c_lines_{i + 1:02d}" for i in range(n)]
    assert n > 1 and of(1) == dict.fromkeys(ids, "added")
    assert of(51) == dict.fromkeys(ids[:-1], "same") | {ids[-1]: "changed"}
    assert of(101) == {ids[0]: "same"} | dict.fromkeys(ids[1:], "removed")
    assert of(2) == {ids[0]: "added"} and of(3) == {ids[0]: "same"} and of(4) == {ids[0]: "removed"}
    assert len(rows) == sum(len(of(k)) for k, _, _ in docs)


EVENTS = "event_id bigint, user_id bigint, event_type string"


def test_quotes_to_ids(run):
    events = [(k, k % 3, "view" if k % 2 else "Click") for k in range(1, 40)]
    want = {u: sum(k % 3 == u for k, _, _ in events) for u in range(3)}
    assert {r.user_id: r.ids for r in run("quotes_to_ids", "events", EVENTS, events)} == want


def test_clean_lines_dom(spark, run):
    from driftline.operators import line_folds, lines

    words = [f"word{i}" for i in range(150)]
    blob = "{" + '":",' * 80 + "}"
    docs = [(1, " ".join(words)), (2, f"before the state\n{blob}\nafter the state"), (3, "short\n" + " ".join(words)), (4, "one line only"), (5, None), (6, "")]
    assert len(docs[0][1]) >= 600 and len(blob) >= 300
    out = lines.clean_dom(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").orderBy("doc_id", "pos").collect()
    of = lambda k: [r.line for r in out if r.doc_id == k]
    assert of(1) == line_folds.wrap_words(docs[0][1], 140) and len(of(1)) > 4
    assert of(2) == ["before the state", "after the state"]
    assert len(of(3)) > 2 and max(map(len, of(3))) <= 420 and " ".join(of(3)).split() == ["short", *words]
    assert of(4) == ["one line only"] and not of(5) and not of(6)
    rows = run("clean_lines_dom", "documents", DOCUMENTS, [(k, "a", "en", x) for k, x in docs])
    assert sorted((r.doc_id, r.pos) for r in rows) == [(r.doc_id, r.pos) for r in out]


def test_texts_are_whole(run):
    flat = "One two three four. " * 400
    tail = "-" * 90 + " after the marks"
    docs = [(1, "a", "en", flat), (2, "a", "en", tail)]
    r = {x.doc_id: x for x in run("split_and_wrap", "documents", DOCUMENTS, docs)}
    assert r[1].wrapped * 140 >= len(flat) - 1 and r[1].soft * 140 >= len(flat) - 400 and r[1].candidates >= 400
    assert {x.doc_id: x.slug for x in run("nfkc_clean", "documents", DOCUMENTS, docs)} == {1: "-".join(["one-two-three-four"] * 400), 2: "after-the-marks"}
    assert {x.doc_id: x.slug for x in run("slugify", "documents", DOCUMENTS, docs)} == {1: "-".join(["one-two-three-four"] * 3)[:48], 2: "after-the-marks"}


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def test_template_diff_metrics(run):
    first = [f"alpha{i} beta gamma" for i in range(5)]
    later = [first[0], "quite another text", *first[2:]]
    turns = {1: first + later, 2: ["a", "b", "a"], 3: ["alone"]}
    rows = run("template_diff_metrics", "conversations", CONVERSATIONS, [(c, 3 * k, "user", x) for c, xs in turns.items() for k, x in enumerate(xs)])
    got = {r.conv_id: (r.chunks, r.added, r.removed, r.changed) for r in rows}
    assert got == {1: (5, 0, 0, 1), 2: (2, 1, 0, 1), 3: (1, 1, 0, 0)}


def test_evidence_paragraphs(run):
    turns = [(c, t, "user", "x" * (c + t + 1)) for c in (1, 21, 41) for t in range(7)]
    got = sorted((r.k, r.para, r.n) for r in run("evidence_paragraphs", "conversations", CONVERSATIONS, turns))
    assert got == sorted((c, t, len(x)) for c, t, _, x in turns)


def test_judge_answer(run):
    got = sorted(run("judge_answer", "events", EVENTS, [(k, 1, "view") for k in range(11)]))
    assert got == [(k, k % 2 == 0, "view") for k in range(11)]


#: Queries that hand texts to Python.
PYTHON = ["chunk_pack", "extractor_choose", "clean_lines_ocr", "clean_lines_dom", "extract_or_blocked", "dedupe_sliding", "change_pipeline", "split_and_wrap"]


@pytest.mark.parametrize("name", PYTHON)
def test_python_gets_small_batches(spark, name):
    """However many rows a task has, Python is given a bounded number at a time."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    sizes = F.arrow_udf(lambda x: pa.array([len(x)] * len(x), pa.int64()), "bigint")
    texts = spark.range(0, 4_000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 2_000, 50_000).otherwise(1)).alias("x"))
    seen = [r.n for r in texts.select(sizes("x").alias("n")).collect()]
    assert max(seen[:1_000]) * 50_000 <= 9 << 20 and max(seen) <= 1_000


def test_few_rows_are_python_objects():
    import tracemalloc

    import pyarrow as pa

    from driftline.operators import lines

    texts = pa.array([f"{i} " + "word " * 200 for i in range(5_000)])
    fold = lines._udf(lambda x: x.split(), "array<string>").func
    tracemalloc.start()
    out = fold(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [x.split() for x in texts.to_pylist()] and peak < 10 << 20
    assert fold(texts[:0]).to_pylist() == [] and fold(texts[64:65]).to_pylist() == [texts[64].as_py().split()]
