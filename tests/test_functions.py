"""Cases worked out by hand for expressions and folds."""

import pytest
from pyspark.sql import functions as F

from driftline.config import EngineConfig
from driftline.functions import numbers, predicates, sets
from driftline.functions import text as t
from driftline.operators import candidates, diffs, evidence, html, line_folds, lines


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for n, v in cols.items())).select(expr.alias("x")).first().x if names else spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, value, currency", [("1 299,00 zł", 1299.0, "PLN"), ("1.299,00 zł", 1.299, "PLN"), ("$12.50", 12.5, "USD"), ("Cena: 10 zł", 10.0, "PLN")])
def test_price(spark, raw, value, currency):
    p = one(spark, numbers.price(F.lit(raw)))
    if raw.startswith("Cena"):
        assert p is None or p.value == value
    else:
        assert (p.value, p.currency) == (value, currency)


def test_numbers(spark):
    assert one(spark, numbers.price(F.lit("abc"))) is None
    assert one(spark, numbers.number_maybe(F.lit("1 299,50 zł"))) == 1299.5
    assert one(spark, numbers.rating(F.lit("4,7/5 (120 opinii)"))) == 4.7
    assert one(spark, numbers.review_count(F.lit("4,7/5 (120 opinii)"))) == 120
    assert one(spark, numbers.rating_signature(F.lit("4,7/5 (120 opinii)"))) == "RATING:4.7/5"
    assert one(spark, numbers.count_signature(F.lit("(120 opinii)"))) == "COUNT:120"
    assert one(spark, numbers.money(F.lit("1.234,56"))) == 1234.56
    assert one(spark, numbers.trend_price(F.lit("Trend cenowy: 1 234,50 zł"))) == 1234.5
    c = one(spark, numbers.price_change(F.lit(10.0), F.lit(12.0)))
    assert c.absolute == 2 and c.relative == pytest.approx(0.2)
    assert one(spark, numbers.price_change(F.lit(0.0), F.lit(5.0))).relative is None
    assert one(spark, numbers.clamp(F.lit(None).cast("int"), 1, 5)) is None


def test_sets(spark):
    assert one(spark, sets.text_diff_score(F.lit("a b c"), F.lit("a b d"))) == 0.5
    assert one(spark, sets.text_diff_score(F.lit(""), F.lit(""))) == 0
    assert one(spark, sets.text_diff_score(F.lit(""), F.lit("a"))) == 1
    assert one(spark, sets.numeric_ratio_delta(F.lit("a 10"), F.lit("a 12"))) == 1
    assert one(spark, sets.shingles(F.lit("a b c"), 2)) == ["a b", "b c"]
    assert one(spark, sets.shingles(F.lit("a"), 2)) == ["a"]
    assert [len(x) for x in one(spark, sets.char_chunks(F.lit("x" * 2000)))] == [900, 900, 440]
    assert one(spark, sets.uniq_ordered_ci(F.array(*map(F.lit, ["a", "B", "A", "b", "c"])))) == ["a", "B", "c"]
    m = one(spark, sets.map_diff(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))))
    assert (m.added, m.removed, m.changed, m.any) == (["c"], ["a"], ["b"], True)
    kv = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "1"), (" a ", "2"), ("b", " "), ("", "x"))])
    assert one(spark, sets.key_values(kv)) == {"a": "2", "b": "unknown"}
    assert one(spark, sets.allowed_ids(F.array(*map(F.lit, ["e1:x", "e2", "e9"])), F.array(F.lit("e1"), F.lit("e2")))) == ["e1", "e2"]
    assert one(spark, sets.paragraph_blocks(F.lit("[P001] a\n[P002] b"), F.array(F.lit(2)))) == ["[P002] b"]


def test_text(spark):
    assert one(spark, t.fingerprint(F.lit("Cena: 10,00 zł!"))) == "cena 10 00 zł"
    assert one(spark, t.slug(F.lit("Opinie & Recenzje!"))) == "opinie-recenzje"
    assert one(spark, t.slug(F.lit(""))) == "chunk"
    assert one(spark, t.para_tag(F.lit(5))) == "[P005]" and one(spark, t.para_tag(F.lit(1000))) == "[P1000]"
    assert one(spark, t.slug_ascii(F.lit("Żółć Łódź é"))).startswith("zo")
    assert one(spark, t.merge_hyphens(F.lit("zam-\nek"))) == "zamek"
    assert one(spark, t.stable_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'
    assert one(spark, t.base64_body(F.lit("data:image/png;base64, iVB OR "))) == "iVBOR"
    assert one(spark, t.image_kind(F.lit("/9j/x"))) == "jpg"
    assert one(spark, t.raw_concat(F.lit("a"), F.lit("a"), F.lit("b"))) == "a\n\nb"
    assert one(spark, t.soft_join(F.lit("do-"), F.lit("bry"))) == "dobry"
    assert one(spark, t.djb_hash(F.lit("ab"))) == 97 * 31 + 98


def test_predicates(spark):
    assert one(spark, predicates.block_reason(F.lit(403), F.lit("x"))) == "status_403"
    assert one(spark, predicates.block_reason(F.lit(200), F.lit("..Access Denied.."))) == "access denied"
    assert one(spark, predicates.block_reason(F.lit(200), F.lit("ok"))) is None
    assert [one(spark, predicates.junk_line(F.lit(x))) for x in ("--", "7", "21")] == [True, True, False]
    assert one(spark, predicates.content_type(F.lit(None).cast("string"), F.lit("Cena 10"))) == "product"
    exits = lambda *a: one(spark, predicates.early_exit(*[F.lit(x) for x in a[:4]], F.lit(a[4]).cast("string")))
    assert exits(False, False, False, False, "p") and exits(True, False, False, False, None) and exits(True, False, False, True, "p")
    assert not exits(True, False, False, False, "p") and not exits(True, False, True, False, None)
    assert one(spark, predicates.ocr_garbage(F.lit("aaaaaaaa1"))) and not one(spark, predicates.ocr_garbage(F.lit("Ocena 4,7 na 5")))
    assert one(spark, predicates.line_kind(F.lit("## x"))) == "heading" and one(spark, predicates.line_kind(F.lit("- x"))) == "list"


def test_line_folds():
    keys = ["a", "b", "a", *"cdefgh", "a"]
    assert line_folds.keep_within_window(keys, 3) == [True, True, False, *[True] * 6, True]
    kept = [k for k, ok in zip(keys, line_folds.keep_within_window(keys, 3)) if ok]
    assert all(line_folds.keep_within_window(kept, 1))
    assert line_folds.keep_within_window(["", "", "a", ""], 80) == [True] * 4
    assert line_folds.wrap_words("aa bb cc dddddd", 5) == ["aa bb", "cc", "dddddd"] and line_folds.wrap_words("  ", 5) == []
    assert "".join(line_folds.pieces_of("x" * 1000, 420)) == "x" * 1000
    cut = line_folds.pieces_of("word " * 1000, 420)
    assert len(cut) == 10 and cut[-1].endswith(" …") and max(map(len, cut[:-1])) <= 420
    segs = lines.build_segments(["# T", "- a", "- b", "one,", "two.", "", "three"], ["heading", "list", "list", "text", "sentence", "blank", "text"], 140)
    assert [(s["kind"], s["text"]) for s in segs] == [("heading", "# T"), ("list", "- a\n- b"), ("text", "one, two."), ("text", "three")]
    merged = lines.merge_short([{"kind": "heading", "from_line": 0, "to_line": 0, "text": "# T"}, {"kind": "text", "from_line": 1, "to_line": 1, "text": "x" * 200}, {"kind": "text", "from_line": 2, "to_line": 2, "text": "end"}])
    assert len(merged) == 1 and (merged[0]["from_line"], merged[0]["to_line"]) == (0, 2)
    packed = lines.pack_segments([{"from_line": i, "to_line": i, "text": "y" * 700} for i in range(9)], 2200, 900, 35)
    assert packed[0]["id"] == "c_lines_01" and all(a["to_line"] + 1 == b["from_line"] for a, b in zip(packed, packed[1:]))
    assert packed[-1]["to_line"] == 8
    got = lines.apply_template("intro Alpha beta: one. Gamma two", [["alpha beta"], ["gamma"]])
    assert [(c["anchor"], c["text"]) for c in got] == [(0, "Alpha beta: one."), (1, "Gamma two")]
    assert lines.pair_snippets("same 10 end", "same 12 end") and not lines.pair_snippets("a", "a")
    blob = "before {" + '"k":"v",' * 80 + '"z":1} after'
    assert line_folds.without_state_blocks(blob).split() == ["before", "after"]
    assert line_folds.matching_bracket('{"a}": [1, {}]} x', 0, 99) == 14 and line_folds.matching_bracket("{]", 0, 99) == -1 and line_folds.matching_bracket("{", 0, 99) == -1


def test_dom_lines():
    """Hand-worked: what each step does, in order."""
    c = EngineConfig(clean_lines=3)
    assert line_folds.dom_lines("a1\r\n\r\n  b  2 \n7\n21\n14.99\n--\n12-34") == ["a1", "b 2", "21", "14.99", "12-34"]
    assert line_folds.dom_lines("Menu 12\nOpis produktu\nMenu 12\nmenu: 12") == ["Menu 12", "Opis produktu"]
    assert line_folds.dom_lines("plain words here\nPlain  words here") == ["plain words here"]
    assert line_folds.dom_lines("l1\nl2\nl3\nl4", c) == ["l1", "l2", "l3"]
    assert line_folds.dom_lines("abcdef\nghij\nk2", EngineConfig(clean_lines_chars=3)) == ["abcdef"]
    assert line_folds.dom_lines("abcd\nefgh\nij", EngineConfig(clean_lines_chars=10)) == ["abcd", "efgh"]
    assert line_folds.dom_lines("x __NUXT__ = 1, 2, 3") == ["x"][:0] and line_folds.dom_lines("some text __NUXT__ = 1, 2, 3") == ["some text"]
    assert line_folds.dom_lines("x" * 30_000) == ["x" * 420, "x" * 420 + " …"]  # ten pieces, of which eight repeat the first
    assert line_folds.dom_lines(None) == [] == line_folds.dom_lines("")


def test_ocr_lines():
    assert line_folds.spaced("wersja2 1osoba PropozycjeDla a,b c.D (x)y z[1] AB12") == "wersja 2 1 osoba Propozycje Dla a, b c. D (x) y z [1] AB12"
    assert line_folds.without_glyphs("★★★★ 4,5 ☑ gotowe → 回 koniec x☆") == "4,5 gotowe koniec x☆"
    assert line_folds.common_form("„a” “b” ’c‘ ﬁ") == "„a\" \"b\" 'c' fi"
    assert line_folds.ocr_lines("zam-\nek stoi\ndruga linia\nDruga  linia\n--") == ["zamek stoi", "druga linia"]
    assert line_folds.ocr_lines("one • two | three\tfour") == ["one", "two", "three four"]
    assert line_folds.ocr_lines("see https://a.example/b now\nmore text here\nlast line") == ["see now", "more text here", "last line"]
    assert line_folds.ocr_lines("abcd\nefgh\nijkl", EngineConfig(clean_chars=9)) == ["abcd", "efgh"]
    assert line_folds.ocr_lines(None) == []


def test_lines_of_no_letter_all_stay(spark):
    rows = [(1, i, x) for i, x in enumerate(["* * *", "Menu 12", "* * *", "Menu 12", "a long line of letters only", "a long line of letters only"])]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "k int, pos int, line string"), "k").orderBy("pos").collect()
    assert [r.pos for r in got] == [0, 1, 2, 4, 5]
    both = spark.createDataFrame([(1, 0, "abcde"), (1, 1, "abcd"), (1, 2, "x")], "k int, pos int, line string")
    assert [r.pos for r in lines.char_budget(both, "k", 10, 9).orderBy("pos").collect()] == [0, 1]


def test_previous_of_a_hot_key(spark):
    """Stretches of one key give the pairs of one window."""
    import random

    rng = random.Random(4)
    rows = [(k, i, f"t{k}-{i}", None if i % 7 else i) for k, n in ((1, 900), (2, 40), (None, 60), (3, 1)) for i in rng.sample(range(5000), n)]
    df = spark.createDataFrame(rows, "k int, v bigint, text string, x bigint").repartition(5)
    out = lambda n: sorted(diffs.previous(df, "k", "v", "text", "x", versions_a_task=n).collect(), key=str)
    assert out(50) == out(10**6) and len(out(50)) == len(rows)
    seen = {(r.k, r.v): r.prev_v for r in out(50)}
    for k in (1, 2, None):
        vs = sorted(v for a, v in seen if a == k)
        assert [seen[(k, v)] for v in vs] == [None, *vs[:-1]]


def test_html():
    page = "<nav>x</nav><article><h1>A</h1><p>one<p>two <b>x</b><ul><li>a<ul><li>b</ul><li>c</ul><table><caption>C</caption><tr><th>a<th>b<tr><td>1<td>2</table><dl><dt>k<dd>v</dl></article>"
    assert [x for _, x in html.block_lines(page)] == ["# A", "one", "two x", "- a", "  - b", "- c", "TABLE: C", "HEAD: a | b", "1 | 2", "k: v"]
    ld = html.jsonld_best('<script type="application/ld+json">{"@type":"Product","name":"Kubek","offers":{"price":"19.99","priceCurrency":"PLN"}}</script>')
    assert (ld["score"], ld["confidence"], ld["text"], ld["price"], ld["currency"]) == (1.0, 1.0, "# Kubek\nCena: 19.99 PLN", 19.99, "PLN")
    assert html.price_texts('<span class="price">rata 10 zł</span><b data-price="5">rata 1 zł</b><i class="price">7 zł</i>') == ["5", "7 zł"]
    assert html.container_score("<div><p>a<p>b</div>") is None
    page = "<main><h1>T</h1>" + "<div>" * 3 + "<p>x y<br>z</p>" * 4 + "<script>no</script></div></div></div></main>"
    text = "T" + "x y z" * 4
    assert html.container_score(page) == {"tag": "main", "score": pytest.approx(len(text) / 8000 + 0.2 + 0.1), "text": text}


def test_html_expressions(spark):
    m = one(spark, html.meta_candidate(F.lit('<meta property="og:title" content="T">')))
    assert (m.detect, m.title, m.confidence) == (0.7, "T", 0.6)
    assert one(spark, html.meta(F.lit('<meta content=" d " name="description">'), "description")) == "d"
    assert one(spark, html.url_norm(F.lit("HTTP://A.com/B#c"))) == "http://a.com/B"


def test_evidence(spark):
    assert one(spark, evidence.rank_limit(F.lit("Top 5 najtańszych"))) == 5
    assert evidence.select_paragraphs("Monitoruj paragrafy od 1 do 3") == [1, 2, 3]
    assert evidence.select_paragraphs("P002-P004") == [2, 3, 4]
    assert evidence.select_paragraphs("the second paragraph") == [2]
    items = one(spark, evidence.rank_items(F.lit("- #1 A\n- #2 B\n- #12 C"), F.lit(10)))
    assert [(x.rank, x["quote"]) for x in items] == [(1, "- #1 A"), (2, "- #2 B")]
    assert one(spark, evidence.intents(F.lit("ignoruj cenę, tylko opinie"))["exclude_price"])


def found(text, kws=(), order=0, most=14, **wants):
    return [(c["kind"], c["quote"]) for c in candidates.chunk_candidates(text, wants, list(kws), order, most)]


def test_candidates_follow_intents():
    shop = "Mug blue\n- Mug 300 ml, 10 zł\n- SALE NOW\nrata 20 zł\n4,5/5 (120 opinii)\n99% kupujacych polec\nwysyłka 24.12.2024"
    assert found(shop, price=True) == [("price", "- Mug 300 ml, 10 zł\n- SALE NOW")]  # the instalment's is noise, the percentage a seller's
    dates = [("date", "4,5/5 (120 opinii)\n99% kupujacych polec"), ("date", "wysyłka 24.12.2024")]  # 5/5 may be one
    assert found(shop, price=True, exclude_price=True) == dates
    assert found("no money here", price=True, only=True) == []
    assert found(shop, reviews=True) == [("rating", "4,5/5 (120 opinii)\n99% kupujacych polec"), ("count", "4,5/5 (120 opinii)")]
    assert found("★★★★ good", reviews=True) == [("stars", "★★★★ good")]
    assert found(shop, new_item=True)[0] == ("product_line", "- Mug 300 ml, 10 zł")
    assert found(shop, ["lamp"], new_item=True)[0][0] == "date"  # nothing new is a lamp
    assert found("Sport\n- Match ends in a draw\nBrand: X", new_item=True, news_list=True)[:2] == [("news_line", "- Match ends in a draw"), ("brand_line", "Brand: X")]
    assert found("Najnowsze wiadomości\n- Match ends", new_item=True, news_list=True)[0] == ("news_header", "Najnowsze wiadomości")
    assert found(shop, delivery=True) == [("delivery_keyword", "wysyłka 24.12.2024"), dates[0]]
    assert found(shop, delivery=True, exclude_delivery=True)[-1] == ("date", "wysyłka 24.12.2024")
    assert found("sold out, back soon", availability=True) == [("availability", "sold out, back soon")]
    assert found("1 200 wyników", count=True) == [("count_results", "1 200 wyników")]
    assert [q for k, q in found(shop, headline=True) if k == "headline"] == ["Mug blue", "rata 20 zł", "4,5/5 (120 opinii)"]
    assert ("headline", "Mug blue") not in found(shop, headline=True, order=3)
    assert found("- #1 A\n- #2 B\n- #12 C", ranking=True, rank_limit=10) == [("rank_item", "- #1 A"), ("rank_item", "- #2 B")]
    assert found("- #12 C", ranking=True, rank_limit=10) == [] and found("5% off", ranking=True) == [("percent", "5% off")]
    assert found("[P001] 5%\n[P002] 6%", paragraphs=[2]) == [("percent", "[P002] 6%")]
    assert found("a b c d e KEY f g h i", ["key"]) == [("keyword", "c d e KEY f g h")]
    assert len(found(" ".join(f"{i}%" for i in range(40)))) == 14 and found(None, ["x"]) == []


def test_windows():
    text = "one two\nthree four\nfive six"
    assert candidates.window_lines(text, 8, 13) == "three four" and candidates.window_lines(text, 8, 13, 1) == "three four\nfive six"
    assert candidates.window_words("aa bb cc dd ee ff gg hh", 9, 11) == "aa bb cc dd ee ff gg" and candidates.window_words("xabcx", 1, 4) == "xabcx"
    assert candidates.window_chars("aaaa bbbb cccc dddd", 10, 14, 6) == "bbbb cccc dddd"
    assert len(candidates.window_lines("x" * 500 + "\ny", 5, 6)) <= 180
    assert candidates.covering([[1], [1], None, [2, 3], [3]], [1, 2, 3], 2) == [0, 3]
    assert candidates.covering([[1], [1], None, [2, 3], [3]], [1, 2, 3], 9) == [0, 1, 3, 4]


def test_priority_and_chunks(spark):
    rank = lambda prompt, kind: one(spark, evidence.priority(F.lit(kind), evidence.wants_of(F.lit(prompt))))
    assert [rank("price changes", k) for k in ("price", "percent", "keyword", "date")] == [1, 4, 8, 9]
    assert rank("opinie i cena", "percent") == 4 and rank("opinie", "percent") == 7 and rank("ignore price, opinie", "price") == 9
    rows = [("k", i, f"[P00{i}] text {i}", "price 5 zł" if i == 4 else "") for i in range(1, 7)]

    def chosen(prompt, most):
        c = spark.createDataFrame([(k, i, x + y) for k, i, x, y in rows], "key string, chunk int, text string")
        w = evidence.wants_of(F.lit(prompt))
        c = c.withColumns({"wants": w, "score": evidence.chunk_score(F.col("text"), F.array().cast("array<string>"), evidence.intents(F.lit(prompt)))})
        return sorted(r.chunk for r in evidence.select_chunks(c, "key", "chunk", most).collect())

    assert chosen("paragraphs 2 and 5", 3) == [2, 5] and chosen("price", 1) == [4] and chosen("nothing of it", 2) == [1, 2]


def test_review_quotes(spark):
    rows = [(1, "ocena 4,5/5"), (2, "120 opinii i 4,5/5"), (3, "120 opinii"), (4, "czas realizacji 5/5, 9 opinii"), (5, "300 opinii"), (6, "aaaaaaa 3/5")]
    c = spark.createDataFrame([("k", i, q) for i, q in rows], "key string, n int, quote string")
    got = lambda **a: [r.n for r in evidence.select_reviews(c, "key", "n", **a).orderBy("rank").collect()]
    assert got() == [2, 1] and got(only=F.lit(True)) == [2, 1]
    assert got(seller=F.lit(True)) == [2, 4]


def test_decisions(spark):
    same = one(spark, diffs.decision(F.lit(True), F.lit(True), F.array(F.lit("A  b")), F.array(F.lit("a b"))))
    assert not same.important
    assert one(spark, diffs.decision(F.lit(True), F.lit(True), F.array(F.lit("a")), F.array(F.lit("b")))).category == "content_change"


def test_entry_survives_without_the_optional_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'prev_text_diff' in e.queries(); assert set(e.oracle_sql()) <= set(e.queries()); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
