"""Boolean and classifying expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import blank_to_null, let

#: Checked in this order.
BLOCK_WORDS = tuple("captcha|cloudflare|access denied|verify you are human|are you a robot|robot check|temporarily blocked|service unavailable|forbidden".split("|"))
CHALLENGE = (
    r"(?i)javascript is disabled|awswafintegration|__challenge_|awswafcookiedomainlist|(?:enable|włącz|wlacz|aktywuj) javascript"
    r"|(?:site|page) requires javascript|strona wymaga (?:włączenia )?javascript|not a robot"
)
FRAMEWORK = r"(?i)\$snuxt|@context|@type|__next|__nuxt|apollo|hydration|pinia|redux|schema\.org"


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def is_uuid(x: Column) -> Column:
    return like(x, r"(?i)^[\da-f]{8}-[\da-f]{4}-[1-5][\da-f]{3}-[89ab][\da-f]{3}-[\da-f]{12}$")


def is_object_id(x: Column) -> Column:
    return like(x, r"(?i)^[0-9a-f]{24}$")


def is_email(x: Column) -> Column:
    return like(x, r"^(?:[^@\s]+)@(?:[^@\s]+)\.(?:[^@\s]+)$")


def block_reason(status: Column, html: Column) -> Column:
    """status_N of a refusing status, else the first block word of the page's start."""
    low = F.lower(F.left(html, F.lit(2000)))
    return F.coalesce(F.when(status.isin(401, 403, 429, 503), F.concat(F.lit("status_"), status.cast("string"))), *[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in BLOCK_WORDS])


def bot_challenge(html: Column) -> Column:
    return like(html, CHALLENGE)


def acceptable(title: Column, description: Column, text: Column, confidence: Column, structure: Column | None = None) -> Column:
    named = F.coalesce(blank_to_null(title), blank_to_null(description), blank_to_null(text)).isNotNull()
    sure = confidence >= 0.5
    return named & (sure if structure is None else (structure >= 0.55) | sure)


def scan_policy(url: Column, static_hosts: tuple[str, ...]) -> Column:
    host = F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1))
    return F.when(host.isin(*static_hosts), "static").otherwise("browser")


def early_exit(any_change: Column, significant: Column, force: Column, focus: Column, prompt: Column) -> Column:
    return F.when(~F.coalesce(any_change, F.lit(False)), True).when(force, False).when(focus, ~significant).otherwise(prompt.isNull() & ~significant)


def needs_ocr(screenshot: Column, ocr: Column, text: Column) -> Column:
    return blank_to_null(screenshot).isNotNull() & blank_to_null(ocr).isNull() & blank_to_null(text).isNull()


def baseline_ok(error: Column, n_chunks: Column, fit: Column, chunking: bool = True) -> Column:
    return error.isNull() & ((n_chunks > 0) & (fit >= 0.55) if chunking else F.lit(True))


def mentions(prompt: Column, keywords: tuple[str, ...]) -> Column:
    low = F.lower(prompt)
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(low, F.lit(k))
    return found


def ignores(prompt: Column, keywords: tuple[str, ...]) -> Column:
    return like(F.lower(prompt), "ignoruj|pomi") & mentions(prompt, keywords)


def seller_review(x: Column) -> Column:
    return like(x, r"transakcj|sprzedawc|obs[łl]ug|wysy[lł]k|zgodnosc\s+z\s+opis|czas\s+realiz|kupuj[aą]cych\s+polec")


def wants_seller(prompt: Column) -> Column:
    return like(F.lower(prompt), "sprzedaw|seller")


def finance_noise(x: Column) -> Column:
    return like(x, r"(?:^|[^\p{L}\p{N}_])(?:rat[ay]|miesi[eę]cz|leasing|wp[łl]ata|kredyt|finansowan|okres|miesi[aą]c|ma[xk]s?\.?)(?:[^\p{L}\p{N}_]|$)")


def price_noise(x: Column) -> Column:
    return like(x, r"zł|zl|pln|smart|rat|dostaw|zaplac|pay|[0-9]{1,2}:[0-9]{2}")


def review_hint(x: Column) -> Column:
    return like(x, r"opin|recenz|review|rating|ocen|gwiazd|★|/5|/10")


def ocr_garbage(x: Column) -> Column:
    """Quotes that recognition has made up: short, repetitive, or without letters."""
    t = F.trim(x)
    distinct = F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))
    return (
        (t == "")
        | ((F.length(t) <= 8) & ~like(t, "[0-9]"))
        | like(t, r"(.)\1{5,}")
        | like(t, r"(\p{L}{2,3})\1{3,}")
        | ((F.length(t) >= 12) & (distinct / F.length(t) < 0.22))
        | ~like(t, r"[\p{L}\p{N}]")
    )


def serialised(x: Column) -> Column:
    """Machine state that got into text."""
    n = F.length(x)
    dense = (count(x, r"[\[\]{}\":,\\]") / n > 0.12) & (count(x, "[A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]") / n < 0.75)
    return (n >= 180) & (like(x, FRAMEWORK + "|webpack") | dense | ((count(x, '"') >= 20) & (count(x, ":") >= 10)))


def drop_line(x: Column) -> Column:
    n = F.length(x)
    sparse = (n >= 30) & (count(x, "[0-9A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż]") / n < 0.55)
    return (
        (n == 0)
        | (count(x, r"[\[\]{}\\\"]") >= 3)
        | like(x, r"(?i)https?://\S+|(?:^|\s)/api/\S+|mailto:|tel:|\S+@\S+\.\S+")
        | (count(x, "/") >= 6)
        | like(x, FRAMEWORK)
        | like(x, "(?i)no elements found|list is empty")
        | sparse
        | ((n <= 1) & ~like(x, "^[0-9]$"))
    )


def line_kind(x: Column) -> Column:
    return (
        F.when(F.trim(x) == "", "blank")
        .when(like(x, r"^#{1,6}\s+"), "heading")
        .when(like(x, r"^\s*(?:[-*•]|[0-9]{1,3}[.)])\s+"), "list")
        .when(like(x, r"^\[[^\]]+\]$"), "token")
        .when(like(x, r"[.!?][\"'”)\]]?$"), "sentence")
        .otherwise("text")
    )


def scan_mode(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("screenshot", "static", "browser", "plugin"), low).otherwise("")


def scan_mode_api(*fields: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(*fields)))
    return F.when(low == "html", "static").when(low.isin("static", "browser", "screenshot", "plugin"), low)


def json_text(x: Column) -> Column:
    t = F.trim(x)
    return like(t, r"(?s)^\{.*\}$") | like(t, r"(?s)^\[.*\]$")


def content_type(kind: Column, text: Column) -> Column:
    k, low = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.contains(k, F.lit("product")), "product").when(like(k, "article|news|blog"), "article").when(like(low, "produkt|cena"), "product").when(like(low, "autor|data publikacji"), "article").otherwise("page")


def line_quality(x: Column) -> dict[str, Column]:
    """Shares of letters, digits and others (all but spaces) of the whole line; tokens; gibberish."""
    n = F.length(x)
    alpha, digit = count(x, r"\p{L}"), count(x, r"\p{N}")
    other = n - alpha - digit - count(x, " ")
    long = lambda t: (count(t, r"\p{L}") >= 18) & (count(t, "(?i)[aeiouyąęó]") / count(t, r"\p{L}") < 0.16)
    parts = F.filter(F.split(x, r"\s+"), lambda t: t != "")
    share = lambda k: F.coalesce(F.try_divide(k, n), F.lit(0.0))
    return {"alpha": share(alpha), "digit": share(digit), "other": share(other), "alnum": alpha + digit, "tokens": F.size(parts), "gibberish": F.exists(parts, long)}


def _judged(x: Column, f) -> Column:
    """``f`` of the line's qualities, each counted once."""
    return let(F.struct(*[c.alias(k) for k, c in line_quality(x).items()]), f)


def junk_line(x: Column) -> Column:
    numeric = like(x, r"^[0-9]{2,}([.,][0-9]+)?[%+]?$")
    return _judged(x, lambda q: ((q["alnum"] < 2) & ~numeric) | ((q["alpha"] < 0.12) & (q["digit"] < 0.08) & (q["other"] > 0.45) & (F.length(x) < 140)))


def junk_line_ocr(x: Column) -> Column:
    return _judged(x, lambda q: ((q["alnum"] < 3) & (q["tokens"] <= 2)) | (q["gibberish"] & (q["alpha"] < 0.6)) | ((q["alpha"] < 0.18) & (q["digit"] < 0.12) & (q["other"] > 0.45) & (F.length(x) < 120)))


def ui_like(x: Column) -> Column:
    return _judged(x, lambda q: (q["tokens"] <= 10) & ((q["alpha"] < 0.78) | (q["digit"] > 0.22)))


def latin_dominant(x: Column, most: int = 12_000) -> Column:
    head = F.left(x, F.lit(most))
    letters = count(head, r"\p{L}")
    cjk = count(head, r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")
    return (F.coalesce(F.try_divide(count(head, r"\p{IsLatin}"), letters), F.lit(0.0)) >= 0.45) & (F.coalesce(F.try_divide(cjk, letters), F.lit(0.0)) <= 0.35)


def structure_score(text: Column, confidence: Column, structured: Column) -> Column:
    """How much a text looks like structured lines, 0 to 1."""
    t = F.trim(text)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda s_: F.trim(s_)), lambda x: x != "")
    n = F.size(lines)
    of = lambda p: F.size(F.filter(lines, lambda x: like(x, p)))
    part = lambda k, full, weight: F.least(F.lit(1.0), k / F.lit(full)) * weight
    s = part(n, 120, 0.35) + part(of(r"^#{1,6}\s+"), 6, 0.25) + part(of(r"^(?:\s*-\s+|\s*[0-9]+\.\s+)"), 30, 0.2) + part(of(r"^[^:]{2,60}:\s+\S"), 30, 0.15)
    s = s + F.when(F.length(t) / F.greatest(n, F.lit(1)) <= 160, 0.05).otherwise(0.0) + F.when(structured, 0.1).otherwise(0.0)
    s = s - F.when((n <= 2) & (F.length(t) > 800), 0.3).otherwise(0.0)
    s = s - F.least(F.lit(0.4), count(t, "https?://") * 0.05 + count(t, r"[{}\[\]]") / 200)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s * (0.6 + 0.4 * sure))))
