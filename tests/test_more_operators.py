"""Operators that no registered query shows, on small cases."""

from pyspark.sql import functions as F

from driftline.functions import numbers, predicates, sets
from driftline.functions import text as t
from driftline.operators import analysis, diffs, html, lines, workflow
from driftline.sources import sinks
from driftline.streaming import jobs


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def words(*xs):
    return F.array(*map(F.lit, xs))


def test_predicates(spark):
    v = lambda e: value(spark, e)
    none = F.lit(None).cast("string")
    assert v(predicates.acceptable(F.lit("a"), none, none, F.lit(0.6))) and not v(predicates.acceptable(F.lit(" "), none, none, F.lit(0.9)))
    assert v(predicates.acceptable(F.lit("a"), none, none, F.lit(0.1), F.lit(0.6)))
    assert v(predicates.scan_policy(F.lit("https://A.com/x"), ("a.com",))) == "static"
    assert v(predicates.needs_ocr(F.lit("x"), F.lit(" "), none)) and not v(predicates.needs_ocr(none, none, none))
    assert v(predicates.baseline_ok(none, F.lit(3), F.lit(0.6))) and not v(predicates.baseline_ok(F.lit("e"), F.lit(3), F.lit(0.6)))
    assert v(predicates.mentions(F.lit("Cena i opinie"), ("opini",))) and v(predicates.ignores(F.lit("ignoruj opinie"), ("opini",)))
    assert v(predicates.seller_review(F.lit("ocena sprzedawcy"))) and v(predicates.wants_seller(F.lit("Seller?")))
    assert v(predicates.finance_noise(F.lit("rata 10 zł"))) and not v(predicates.finance_noise(F.lit("strata")))
    assert v(predicates.price_noise(F.lit("10 zł"))) and v(predicates.review_hint(F.lit("4/5")))
    assert v(predicates.scan_mode(F.lit(" Static "))) == "static" and v(predicates.scan_mode(F.lit("x"))) == ""
    assert v(predicates.scan_mode_api(none, F.lit("html"))) == "static" and v(predicates.scan_mode_api(F.lit("x"))) is None
    assert v(predicates.json_text(F.lit(' {"a":1} '))) and not v(predicates.json_text(F.lit("a")))


def test_text(spark):
    v = lambda e: value(spark, e)
    assert v(t.strip_zero_width(F.lit("a​b"))) == "ab"
    assert v(t.clean_line_indent(F.lit("    - x  y"))) == "    - x y"
    assert v(t.clean_multiline(F.lit("a  b\r\n\n\n\nc&amp;d"))) == "a b\n\nc&d"
    assert v(t.truncate_lines(words("a", "b", "c"), 2)) == ["a", "b"]
    assert v(t.norm_key(F.lit('"A"  b'))) == "a b"
    assert v(t.pseudo_lines(F.lit("One. Two! | three"))) == ["One.", "Two!", "three"]
    assert v(t.json_hash(F.struct(F.lit(1).alias("a")))) == v(F.sha1(F.lit('{"a":1}')))
    assert v(t.should_join(F.lit("a long line that goes on and on, and on,"), F.lit("x"))) and not v(t.should_join(F.lit("End."), F.lit("x")))


def test_numbers(spark):
    v = lambda e: value(spark, e)
    none = F.lit(None).cast("double")
    assert v(numbers.price_in_text(F.lit("now only 12,50 zł!"))).value == 12.5
    assert v(numbers.price_like(F.lit("x 5"), none, none)) == 5 and v(numbers.price_like(F.lit("x"), none, F.lit(2.0))) == 2
    assert v(numbers.number_or_null(F.lit("3.5"))) == 3.5 and v(numbers.number_or_null(F.lit("about 7 of"))) == 7
    c = v(numbers.change(F.lit(1.0), F.lit(2.0)))
    assert (c.before, c.after) == (1, 2) and v(numbers.change(F.lit(1.0), F.lit(1.0))) is None
    assert v(numbers.int_maybe(F.lit("a 1 2"))) == 12


def test_sets(spark):
    v = lambda e: value(spark, e)
    assert v(sets.sanitise(words(" a  b ", "", " "))) == ["a b"]
    assert v(sets.paragraph_numbers(F.lit("[P003] x [P001] y [P003]"))) == [1, 3]
    chunk = lambda k, a: F.struct(F.lit(k).alias("key"), F.lit("T").alias("title"), words(a).alias("anchor_candidates"))
    cs = F.array(chunk("Ab C", "a long enough anchor"), chunk("ab-c", "another good anchor"), chunk("z", "short"))
    assert [c["key"] for c in v(sets.template_norm(cs))] == ["ab-c"]
    assert v(sets.template_valid(cs))
    images, attrs = sets.merge_meta(words("a"), words("b", "a"), F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("1")), F.create_map(F.lit("x"), F.lit("2")))
    assert v(images) == ["a", "b"] and v(attrs) == {"y": "1", "x": "2"}
    assert lines.uniq_ranges([(0, 5), (4, 8), (6, 20)], 10) == [(0, 5), (6, 10)]
    assert lines.common_affix("abcd", "abxd") == (2, 1)


def test_analysis(spark):
    v = lambda e: value(spark, e)
    item = F.array(F.struct(F.lit("q").alias("quote"), F.lit(None).cast("string").alias("text")))
    none = F.lit(None).cast("array<string>")
    assert v(analysis.quotes(item, none, none, none)) == ["q"]
    assert v(analysis.quotes(F.filter(item, lambda x: F.lit(False)), none, words("b"), words("c"))) == ["b", "c"]
    assert v(analysis.chunk_mode(F.lit("semantic"), False)) == "deterministic" and v(analysis.chunk_mode(F.lit(None).cast("string"), True)) == "semantic"
    assert v(analysis.cache_valid(F.lit(1), F.lit("s"), F.lit("s"), F.lit("deterministic_lines"), F.lit("deterministic"), F.lit(2)))
    assert v(analysis.email_text(F.lit(" "), F.lit("b"), F.lit(None).cast("string"))) == "A page has changed\nb"
    assert v(diffs.metric_decision(F.array(F.struct(F.lit(1).alias("before"))))).category == "metric_change"
    snaps = spark.createDataFrame([("m", 1, "# A\nline one.\n- x\n- y")], "monitor_id string, version int, text string")
    assert analysis.summarise(snaps).first().summary is None
    assert analysis.analyses(snaps).first().chunks[0]["id"] == "c_lines_01"
    assert v(html.price_of_dom(F.lit('<b itemprop="price" content="19,99 zł">'))).value == 19.99


def test_sinks_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    sinks.append(df, f"{tmp_path}/t", "id", 4)
    sinks.append(df, f"{tmp_path}/t", "id", 4)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    for _ in range(2):
        sinks.idempotent(df, 7, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    sinks.replace(df.limit(0), f"{tmp_path}/b2")
    assert spark.read.parquet(f"{tmp_path}/b2").count() == 0
    assert bytes(value(spark, sinks.binary(F.lit("data:image/png;base64,aGk=")))) == b"hi"
    schema = "k int, sha string, ts int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    new = spark.createDataFrame([(1, "a", 2), (2, "c", 2), (2, "d", 3), (3, "e", 2)], schema)
    rows = {r.k: (r.sha, r.ts) for r in jobs.upsert_snapshots(new, old, ["k"], "sha", "ts").collect()}
    assert rows == {1: ("a", 1), 2: ("d", 3), 3: ("e", 2)}
    assert jobs.upsert_snapshots(new, None, ["k"], "sha", "ts").count() == 3

    def send(batches):
        for pdf in batches:
            yield pdf[pdf["id"] == 1][["id"]]

    box = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "sent")], "id int, status string")
    assert [r.id for r in jobs.notify(box, send, "id int").collect()] == [1]
    m = spark.createDataFrame([(1, True), (2, True)], "id int, active boolean")
    assert {r.id: r.active for r in workflow.require_intervention(m, m.where("id = 2").select("id")).collect()} == {1: True, 2: False}
