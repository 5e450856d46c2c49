"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from driftline.llm import crf, language_id, lengths, line_dedup, link_graph, matroska, near_dups, packing, pieces, quality

CLASH = "row string, keep boolean, n_tokens bigint, h1 bigint, pos int, spans string, `a.b` int"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASH}"
EXTRA = ("x", True, 1, 2, 3, "y", 4)


@pytest.fixture(scope="module")
def docs(spark):
    long = "word other " * 20_000
    rows = [
        (1, "One two three four five six seven eight nine ten.", "en", "s", 10),
        (1, "One two three four five six seven eight nine ten.", "en", "s", 10),
        (2, None, "en", "s", 0),
        (3, "", None, None, None),
        (None, "One two three four five six seven eight nine ten.", "xx", "s", 1),
        (4, long, "de", "s", len(long)),
        (5, "x" * 50_000, "en", "s", 50_000),
        (6, "   \n\n\t ", "en", "s", 8),
        (7, "12 34 5678 9999-1", "en", "s", 3),
    ]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(docs, empty):
    rows = quality.score(docs).collect()
    assert len(rows) == 9
    judged = {r.row.doc_id: r for r in rows}
    assert judged[2].keep and judged[3].keep and judged[6].keep
    assert judged[2].char_distance is None
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {1, 2, 3, None} <= {r.doc_id for r in kept.collect()}
    assert quality.keep_good(empty).count() == 0


def test_lengths(docs, empty):
    sums = lengths.with_suffix_sums(lengths.histogram(docs)).collect()
    assert sum(r.docs for r in sums) == 9
    zero = next(r for r in sums if r.n_tokens == 0)
    assert zero.docs == 2 and zero.docs_at_least == 9
    assert lengths.with_suffix_sums(lengths.histogram(empty)).count() == 0


def test_pieces(docs, empty):
    rows = by_id(pieces.encode(docs))
    assert rows[2].ids is None and rows[2].n_pieces is None
    assert rows[3].ids == [] and rows[3].round_trip
    assert all(r.round_trip for r in rows.values() if r.ids is not None)
    back = by_id(pieces.decode(pieces.encode(docs)))
    assert back[2].text is None and back[7].text == "12 34 5678 9999-1"
    assert pieces.encode(empty).count() == 0


def test_crf(docs, empty):
    out = crf.mask_documents(docs)
    assert out.columns == docs.columns and out.count() == 9
    rows = by_id(out)
    assert rows[2].text is None and rows[3].text == "" and rows[5].text == "x" * 50_000
    assert rows[2].n_chars == 0
    assert crf.mask_documents(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.keep_bitmaps(docs).collect()
    seen = {(r.doc_id, r.n_lines): r for r in rows}
    assert len(rows) == 8  # the repeated row is the same document
    assert seen[(2, 0)].keep_bitmap == ""
    assert seen[(3, 1)].keep_bitmap == "1"
    assert seen[(None, 1)].keep_bitmap == "1"  # a null id comes first
    assert seen[(1, 1)].keep_bitmap == "0,1"
    left = line_dedup.drop_repeated_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {None, 2, 3, 4, 5, 6, 7}
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert line_dedup.keep_bitmaps(empty).count() == 0


def test_near_dups(docs, empty):
    rows = sorted(((r.doc_id, r.class_id, r.links) for r in near_dups.classes(docs).collect()), key=str)
    assert rows == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), *((i, i, 0) for i in range(2, 8))], key=str)
    left = near_dups.one_of_each_group(docs)
    assert left.columns == docs.columns and left.count() == 9  # without another id, nothing goes
    assert near_dups.classes(empty).count() == 0
    assert near_dups.one_of_each_group(empty).count() == 0


def test_language(docs, empty):
    model = language_id.train(docs)
    rows = by_id(language_id.identify(docs, model))
    assert rows[2].language == rows[3].language == "und"
    assert rows[4].language == "de"
    nothing = language_id.train(empty)
    assert {r.language for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_packing(docs, empty, spark):
    limits = packing.Limits(tokens=512, segments=4, loss_tokens=512)
    rows = packing.pack(packing.document_pieces(docs, limits), limits).collect()
    assert not {2, 3} & {r.doc_id for r in rows}
    long = sorted((r.start, r.tokens) for r in rows if r.doc_id == 4)
    assert all(a + n == b for (a, n), (b, _) in zip(long, long[1:]))
    assert packing.pack(packing.document_pieces(empty, limits), limits).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", None), (None, 0, None, "a b"), (2, 0, "assistant", "a " * 3000), (1, 0, "user", "hello")], "conv_id bigint, turn bigint, role string, text string")
    rows = packing.pack(packing.conversation_pieces(turns, limits), limits).collect()
    assert {r.doc_id for r in rows} == {1, 2, None}
    assert all(r.loss_tokens == r.tokens for r in rows if r.doc_id == 2)
    assert all(r.loss_tokens == 0 for r in rows if r.doc_id != 2)


def test_link_graph(spark):
    schema = "page_id bigint, url string, html string, host string, keep string"
    rows = [(1, None, None, "h", "k"), (2, "nonsense", "", "h", "k"), (3, "http://a.example.org/x", "<a href='//b.com/'>" * 3, "h", "k"), (3, "http://a.example.org/x", "<a href='//b.com/'>", "h", "k"), (None, "http://b.com", "<a href=/y>", "h", "k")]
    out = link_graph.filter_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 5 and all(r.keep for r in out)
    assert {r.host for r in out} == {None, "a.example.org", "b.com"}
    assert link_graph.filter_pages(spark.createDataFrame([], schema)).count() == 0


def test_matroska(spark):
    schema = "media_id bigint, media binary, track int, error string"
    good = matroska.page_container(7, "http://a", "abc " * 2000)
    rows = [(1, None, 1, "e"), (2, b"", 1, "e"), (3, b"junk", 1, "e"), (None, good, 1, "e"), (5, good[:-300], 1, "e"), (5, good[:-300], 1, "e")]
    out = matroska.packets(spark.createDataFrame(rows, schema)).collect()
    assert {r.media_id for r in out} == {None, 3, 5}
    assert [r.error is not None for r in out if r.media_id == 3] == [True]
    assert sum(r.error is not None for r in out if r.media_id == 5) == 2
    assert not any(r.error for r in out if r.media_id is None)
    assert matroska.packets(spark.createDataFrame([], schema)).count() == 0
