"""Prompts to intents, chunks to candidates, candidates to evidence."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.config import DEFAULT
from driftline.functions import numbers, sets
from driftline.functions import text as t
from driftline.functions.predicates import like, ocr_garbage, seller_review, wants_seller
from driftline.operators import candidates as found
from driftline.operators.lines import _udf

#: Boundaries by any letter or digit, not only ASCII ones.
L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
INTENTS = {
    "price": L + r"(?:cen\p{L}*|price|koszt\p{L}*|pln|zł|zl)" + R + r"|[€$]",
    "reviews": r"opini|recenz|gwiazd|review|rating|★|" + L + r"ocen",
    "only": L + "(?:tylko|only)" + R,
    "list_items": L + r"(?:lista|produkty|wyniki|katalog|asortyment|elementy listy|list)" + R,
    "ranking": L + r"(?:ranking|rank|top ?[0-9]*|best(?:seller)?s?|najlepsz[ey])" + R,
    "new_item": L + r"(?:now[yae]|dodan[ey]|added|new|appears?)" + R + "|pojawi",
    "headline": r"nagł|naglo|headline|tytu[łl]|title",
    "news_list": L + r"(?:artyku[łl]y?|wiadomo[śs]\p{L}+|news|wpisy?|entry|entries|og[łl]oszeni[ae])" + R,
    "availability": r"dost[ęe]pn|stock|availab",
    "delivery": r"dostaw|wysy[łl]|deliver|shipping",
    "count": L + r"(?:how many|ile|liczb[aęy]|number of)" + R,
    "filters": L + r"(?:filtr\p{L}*|filters?)" + R,
}
STOPWORDS = sorted(
    set(
        "the and for with from only when that this new added notify ignore item items news product products section paragraph "
        "oraz lub tylko gdy kiedy się sie nie jak aby jeśli jesli pojawi nowy nowa nowe strona strony oferta produkt produkty".split()
    )
)
SCORES = {
    "rating": (r"[0-9]{1,2}(?:[.,][0-9]{1,2})?\s*/\s*(?:5|10)", 9),
    "review_count": r"",
    "currency": (r"(?i)[0-9](?:[0-9 .,]*[0-9])?\s*(?:zł|zl|pln|eur|usd|€|\$|£)", 8),
    "percent": (r"[0-9]{1,3}(?:[.,][0-9]{1,2})?\s*%", 2),
    "availability": (r"(?i)out of stock|sold out|unavailable|in stock|dost[ęe]pn", 7),
    "delivery": (r"(?i)dostaw|wysy[łl]|delivery|shipping|kurier|pickup", 4),
    "date": (r"[0-9]{1,2}[./-][0-9]{1,2}(?:[./-][0-9]{2,4})?", 3),
    "list": (r"(?m)^\s*(?:[-•]|[0-9]{1,3}[.)])\s+", 2),
}
SCORES["review_count"] = (rf"(?i)[0-9]+\s*{numbers.REVIEW}", 6)


def intents(prompt: Column) -> dict[str, Column]:
    low = F.lower(F.coalesce(prompt, F.lit("")))
    out = {k: like(low, p) for k, p in INTENTS.items()}
    out["new_item"] = out["new_item"] & ~out["reviews"]
    out["exclude_price"] = like(low, r"(?:ignoruj|ignore).{0,20}(?:cen|price)|bez\s+ceny")
    out["exclude_delivery"] = like(low, r"(?:ignore|ignoruj).{0,30}(?:deliver|dostaw|wysy[łl])")
    out["seller"] = wants_seller(low)
    return out


def rank_limit(prompt: Column) -> Column:
    low = F.lower(prompt)
    patterns = (r"top\s*[-–—]?\s*([0-9]{1,3})", r"first\s*([0-9]{1,3})", r"pierwszych?e?\s*([0-9]{1,3})", r"([0-9]{1,3})\s*(?:najlepsz|najdro|najta)", r"najlepsz\p{L}*\s*([0-9]{1,3})")
    n = F.coalesce(*[numbers.found(low, p) for p in patterns]).try_cast("int")
    return numbers.clamp(n, 1, 200)


def keywords(prompt: Column, most: int = 12) -> Column:
    """Words of three letters and more, in order, without stop words and numbers."""
    w = F.filter(sets.words(prompt), lambda x: (F.length(x) >= 3) & ~like(x, "^[0-9]+$"))
    return F.slice(F.array_distinct(F.array_except(w, F.array(*map(F.lit, STOPWORDS)))), 1, most)


ORDINALS = {w: i + 1 for i, ws in enumerate(("first pierwsz", "second drug", "third trzeci", "fourth czwart", "fifth piąt piat", "sixth szóst szost", "seventh siódm siodm", "eighth ósm osm", "ninth dziewiąt dziewiat", "tenth dziesiąt dziesiat")) for w in ws.split()}


def select_paragraphs(prompt: str | None) -> list[int]:
    """Paragraph numbers that a prompt names: single, ranges, [Pn], ordinals."""
    low = unicodedata.normalize("NFC", (prompt or "").lower())
    out = {int(x) for x in re.findall(r"\[?\bp(\d{1,4})\b\]?", low)}
    for a, b in re.findall(r"p(\d{1,4})\s*[-–—]\s*p?(\d{1,4})", low):
        out |= set(range(int(a), min(int(b), int(a) + 500) + 1))
    name = r"(?:paragraf\w*|akapit\w*|paragraphs?|ust[eę]p\w*)"
    for m in re.finditer(name + r"\s*(?:od\s+|from\s+|nr\s+)?([0-9]{1,4})(?:\s*(?:–|-|to|do)\s*([0-9]{1,4}))?((?:\s*(?:and|oraz|i|,)\s*[0-9]{1,4})*)", low):
        a, b = int(m[1]), int(m[2] or m[1])
        out |= set(range(a, min(b, a + 500) + 1)) | {int(x) for x in re.findall(r"\d+", m[3])}
    for w, n in ORDINALS.items():
        if re.search(rf"\b{w}\w*\s+{name}", low):
            out.add(n)
    return sorted(out)


def paragraph_selection(prompt: Column) -> Column:
    return _udf(select_paragraphs, "array<int>")(prompt)


def chunk_score(text: Column, kws: Column, wants: dict[str, Column]) -> Column:
    n = lambda k: F.least(F.regexp_count(text, F.lit(SCORES[k][0])), F.lit(999)) * SCORES[k][1]
    low = F.lower(text)
    hits = t.let(low, lambda v: F.size(F.filter(kws, lambda k: F.contains(v, k)))) * 3
    when = lambda k, x: F.when(wants[k], x).otherwise(0)
    return (
        hits
        + when("reviews", n("rating") + n("review_count"))
        + F.when(wants["price"] & ~wants["exclude_price"], n("currency") + n("percent")).otherwise(0)
        + when("availability", n("availability"))
        + when("delivery", n("delivery") + n("date"))
        + when("list_items", n("list"))
        + F.when(wants["headline"] & (F.length(text) < 800), 2).otherwise(0)
    ).cast("bigint")


#: What a prompt may ask of candidates, as a struct: ``wants_of``.
ASKED = (*INTENTS, "exclude_price", "exclude_delivery", "seller")


def wants_of(prompt: Column) -> Column:
    """struct of the intents by name, rank_limit and paragraphs of a prompt."""
    flags = intents(prompt)
    return F.struct(*[F.coalesce(flags[n], F.lit(False)).alias(n) for n in ASKED], rank_limit(prompt).alias("rank_limit"), paragraph_selection(prompt).alias("paragraphs"))


CANDIDATE = "array<struct<idx: int, kind: string, quote: string, rank: int>>"


def candidates(text: Column, wants: Column, kws: Column, order: Column | None = None) -> Column:
    """Typed quotes of a chunk under ``wants``; ``order`` is its place, for headlines are at the start."""
    return _udf(found.chunk_candidates, CANDIDATE)(text, wants, kws, F.lit(0) if order is None else order.cast("int"))


#: kind, the intent under which it matters, and how much: 1 most.
PRIORITY = (
    ("new_item", {"product_line": 1, "brand_line": 2, "list_item": 3}),
    ("ranking", {"rank_item": 1}),
    ("price", {"price": 1, "percent": 4}),
    ("availability", {"availability": 1}),
    ("delivery", {"delivery_keyword": 2, "date": 3}),
    ("count", {"count_results": 2}),
    ("reviews", {"rating": 1, "rating_stars": 2, "stars": 3, "count": 4, "review_keyword": 6, "percent": 7}),
    ("filters", {"filter_keyword": 3}),
    ("headline", {"headline": 3}),
    ("list_items", {"list_item": 4}),
)


def priority(kind: Column, wants: Column) -> Column:
    """1 to 9: how much a kind matters under the intents; the first that ranks it decides."""
    out = F
    for intent, kinds in PRIORITY:
        asked = wants[intent]
        if intent in ("price", "delivery"):
            asked = asked & ~wants[f"exclude_{intent}"]
        if intent == "new_item":
            asked = asked & ~wants["ranking"]
        for k, n in kinds.items():
            out = out.when(asked & (kind == k), n)
    return out.when(kind == "keyword", 8).otherwise(9)


def select_chunks(chunks: DataFrame, key: str, order: str, most: int = DEFAULT.evidence_chunks) -> DataFrame:
    """The chunks to read for each key's prompt, ``most`` at most.

    chunks: key, order, text, wants, score.  Named paragraphs first choose the
    chunks that cover them; for a ranking, chunks with its lines come alone; else
    the best scores, and the first chunks where nothing scores.
    """
    n = chunks.withColumns({
        "__hits": F.array_sort(F.array_intersect(sets.paragraph_numbers(F.col("text")), F.coalesce("wants.paragraphs", F.array().cast("array<int>")))),
        "__lines": F.when(F.col("wants.ranking"), _udf(found.rank_lines, "int")(F.col("text"), F.col("wants.rank_limit"))).otherwise(0),
    })
    named = F.coalesce(F.size("wants.paragraphs"), F.lit(0)) > 0
    hits = n.where(named & (F.size("__hits") > 0)).groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col("__hits").alias("hits")))).alias("h"), F.first("wants.paragraphs").alias("p"))  # numbers only
    pick = _udf(lambda h, p: found.covering([x["hits"] for x in h], p, most), "array<int>")
    chosen = hits.select("__k", F.transform(pick(F.col("h"), F.col("p")), lambda i: F.get(F.col("h"), i)["order"]).alias("__chosen"))
    n = n.join(chosen, F.col(key) == F.col("__k"), "left").where(F.col("__chosen").isNull() | F.array_contains("__chosen", F.col(order)))
    all_ = Window.partitionBy(key)
    n = n.withColumns({"__ranked": F.max("__lines").over(all_) > 0, "__best": F.max("score").over(all_)})
    n = n.where(~F.col("__ranked") | (F.col("__lines") > 0))
    by = F.when(F.col("__ranked") | (F.col("__best") == 0), F.lit(0)).otherwise(-F.col("score"))
    n = n.withColumn("__n", F.row_number().over(all_.orderBy(by, order))).where(F.col("__n") <= most)
    return n.drop("__hits", "__lines", "__k", "__chosen", "__ranked", "__best", "__n")


def two_level_top(cands: DataFrame, key: str, chunk: str, *order: Column, per_chunk: int = DEFAULT.evidence_per_chunk, total: int = DEFAULT.evidence_total) -> DataFrame:
    """A quota by chunk and a cap in all, both in the same order: as greedy selection gives."""
    c = cands.withColumn("__a", F.row_number().over(Window.partitionBy(key, chunk).orderBy(*order))).where(F.col("__a") <= per_chunk)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= total).drop("__a")


def rank_items(text: Column, limit: Column | None = None) -> Column:
    """struct(rank, quote) of ``- #n`` items, each to the next, one of a rank, up to the limit."""
    parts = F.filter(F.split(text, r"(?m)(?=^\s*-\s*#\s*[0-9])"), lambda x: like(x, r"^\s*-\s*#\s*[0-9]"))
    items = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"#\s*([0-9]{1,3})", 1).cast("int").alias("rank"), t.squeeze(x).alias("quote")))
    both = lambda v: F.struct(v.alias("items"), F.transform(v, lambda x: x["rank"]).alias("ranks"))
    first = t.let(items, lambda v: t.let(both(v), lambda b: F.filter(b["items"], lambda x, i: F.array_position(b["ranks"], x["rank"]) == i + 1)))
    return first if limit is None else F.filter(first, lambda x: x["rank"].between(1, limit))


def select_reviews(cands: DataFrame, key: str, order: str, only: Column | None = None, seller: Column | None = None) -> DataFrame:
    """The few numbers that stand for the reviews: one quote with rating and count, or one of either; then one more with a review word.

    Quotes that recognition has garbled are left out, and those on sellers unless
    ``seller``; two in all where the prompt wants them ``only``, else three.
    """
    q = F.col("quote")
    r, c = numbers.rating_signature(q), numbers.count_signature(q)
    of_seller = seller_review(F.lower(q)) if seller is None else seller_review(F.lower(q)) & ~seller
    kept = ~ocr_garbage(q) & ~of_seller
    s = cands.where(kept).withColumns({"rating_sig": r, "count_sig": c, "__most": F.when(F.lit(False) if only is None else only, 2).otherwise(3)}).where("rating_sig is not null or count_sig is not null")
    cls = F.when(F.col("rating_sig").isNotNull() & F.col("count_sig").isNotNull(), 0).when(F.col("rating_sig").isNotNull(), 1).otherwise(2)
    sig = F.concat_ws("|", "rating_sig", "count_sig")
    s = s.withColumns({"cls": cls, "__sig": sig})
    by = ("cls", order, F.length("quote"), "__sig", "quote")
    s = s.withColumn("__o", F.row_number().over(Window.partitionBy(key, "__sig").orderBy(*by))).where("__o = 1")
    mine = Window.partitionBy(key)
    both = F.min("cls").over(mine) == 0
    nth = F.row_number().over(Window.partitionBy(key, "cls").orderBy(*by[1:]))
    first = (F.col("cls") == 0) & (nth == 1) | ~both & (F.col("cls") > 0) & (nth == 1)  # the canonical quotes
    s = s.withColumn("__first", first)
    word = ~F.col("__first") & F.regexp_like(F.lower("quote"), F.lit("gwiazd|ocen|opin|rating|recenz|review"))
    s = s.withColumn("__word", word)
    more = F.row_number().over(Window.partitionBy(key, "__word").orderBy(*by))
    s = s.where(F.col("__first") | F.col("__word")).withColumn("__more", more).where(F.col("__first") | (F.col("__more") == 1))
    s = s.withColumn("rank", F.row_number().over(mine.orderBy(F.col("__first").desc(), *by))).where(F.col("rank") <= F.col("__most"))
    return s.drop("__o", "__first", "__word", "__more", "__sig", "__most")


def select_paragraph_blocks(blocks: DataFrame, key: str, most: int = 120) -> DataFrame:
    """The longest block of each paragraph number; rows: key, para, block."""
    g = blocks.groupBy(key, "para").agg(F.max_by("block", F.struct(F.length("block"), "block")).alias("block"))
    return g.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("para"))).where(F.col("n") <= most).drop("n")


def select_news(lines: DataFrame, key: str, chunk: str, order: str) -> DataFrame:
    """Up to 8 lines of the two chunks densest in news lines (a line 1, a header 0.6)."""
    weigh = lines.groupBy(key, chunk).agg(F.round(F.sum(F.when(F.col("kind") == "headline", 0.6).otherwise(1.0)), 6).alias("w"))
    dense = weigh.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("w").desc(), chunk))).where("n <= 2").select(key, chunk)
    return lines.join(dense, [key, chunk]).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(chunk, order))).where("rank <= 8")


def select_new_items(lines: DataFrame, key: str, order: str, most: int = 60) -> DataFrame:
    """Product lines by stable key, one of each; where three and more have a time hint, those only."""
    hint = like(F.col("quote"), r"(?i)(?:temu|ago|dzi[śs]|today|wczoraj|yesterday)")
    d = lines.withColumns({"product": t.product_key(F.col("quote")), "hint": hint})
    d = d.withColumn("hints", F.count_if("hint").over(Window.partitionBy(key))).where((F.col("hints") < 3) | F.col("hint"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy(key, "product").orderBy(order))).where("n = 1")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("product", order, "quote"))).where(F.col("rank") <= most).drop("n", "hints", "hint")


def quotes_to_ids(used: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """key, ids: evidence ids of quotes, matched in their normal form and without outer quotes."""
    norm = lambda c: t.quote_norm(F.regexp_replace(c, "^[\"'„”“]+|[\"'„”“]+$", ""))
    u = used.select(key, F.posexplode("quotes").alias("pos", "quote")).withColumn("k", norm(F.col("quote")))
    p = pool.select(F.col(key).alias("__k"), F.col("id"), norm(F.col("quote")).alias("k2"))
    j = u.join(p, (F.col(key) == F.col("__k")) & (F.col("k") == F.col("k2")))
    return j.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])).alias("ids"))


def extract(chunks: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Evidence of every key: key, selector, chunk, rank, quote.

    chunks: key, chunk, text; prompts: key, prompt.  A prompt that names
    paragraphs gets their blocks; one that asks for a ranking, the ranked items;
    one for reviews, rating and count quotes; others the typed candidates, by
    priority, four of a chunk and ten in all.
    """
    asked = F.col("prompt")
    p = prompts.select(F.col(key).alias("__key"), wants_of(asked).alias("wants"), keywords(asked).alias("kws"))
    kind = F.when(F.size("wants.paragraphs") > 0, "paragraphs").when(F.col("wants.ranking"), "ranking").when(F.col("wants.reviews"), "reviews").otherwise("typed")
    j = chunks.join(p.withColumn("selector", kind), F.col(key) == F.col("__key")).drop("__key")
    score = chunk_score(F.col("text"), F.col("kws"), {n: F.col("wants")[n] for n in ASKED})
    j = select_chunks(j.withColumn("score", score), key, "chunk")
    out = ["selector", "chunk", "rank", "quote"]

    paras = j.where("selector = 'paragraphs'").select(key, "chunk", F.explode(sets.paragraph_blocks(F.col("text"), F.col("wants.paragraphs"))).alias("block"))
    paras = paras.withColumn("para", F.regexp_extract("block", r"^\[P([0-9]+)\]", 1).try_cast("int"))
    paras = select_paragraph_blocks(paras, key).select(key, F.lit("paragraphs").alias("selector"), F.lit(None).cast("int").alias("chunk"), F.col("para").alias("rank"), F.trim("block").alias("quote"))

    c = j.where("selector <> 'paragraphs'").select(key, "selector", "wants", "chunk", F.explode(candidates(F.col("text"), F.col("wants"), F.col("kws"), F.col("chunk"))).alias("c"))
    c = c.select(key, "selector", "wants", "chunk", "c.idx", "c.kind", "c.quote", F.col("c.rank").alias("item"))
    ranked = c.where("selector = 'ranking' and kind = 'rank_item'").withColumn("__n", F.row_number().over(Window.partitionBy(key, "item").orderBy("chunk", "idx"))).where("__n = 1").withColumn("rank", F.col("item")).select(key, *out)
    reviews = select_reviews(c.where("selector = 'reviews'"), key, "chunk", F.col("wants.only"), F.col("wants.seller")).select(key, *out)
    typed = c.where("selector = 'typed' or selector = 'ranking' and kind <> 'rank_item'").withColumn("p", priority(F.col("kind"), F.col("wants")))
    typed = two_level_top(typed, key, "chunk", F.col("p"), F.col("chunk"), F.length("quote"), F.col("idx")).select(key, *out)
    return paras.unionByName(ranked).unionByName(reviews).unionByName(typed)
