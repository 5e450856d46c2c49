"""Numbers found in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import squeeze

REVIEW = r"(?:ocen[ay]?|ratings?|reviews?|recenz(?:ji|je|ja)?|opin(?:ii|ie|ia)?)"
RATING = r"([0-9]{1,2}(?:[.,][0-9]{1,2})?)\s*"
PRICE = r"([0-9\s,.]+)\s*([żł€£$A-Za-z]{0,4})"


def clamp(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def as_number(x: Column) -> Column:
    """A decimal comma read as a point; null if it's no number."""
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def currency(x: Column) -> Column:
    low = F.lower(x)
    has = lambda *w: F.regexp_like(low, F.lit("|".join(w)))
    return F.when(has("zł", "pln", "zl"), "PLN").when(has("€", "eur"), "EUR").when(has("£", "gbp"), "GBP").when(has(r"\$", "usd"), "USD")


def price_number(x: Column) -> Column:
    """Of the first run of digits and separators: only its first comma is a point."""
    run = F.regexp_replace(F.regexp_extract(squeeze(x), PRICE, 1), r"\s", "")
    return F.regexp_extract(F.regexp_replace(run, "^([^,]*),", "$1."), r"^\d*\.?\d+", 0).try_cast("double")


def price(x: Column) -> Column:
    """struct(value, currency), null without a number."""
    unit = F.regexp_extract(squeeze(x), PRICE, 2)
    value = price_number(x)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), currency(F.coalesce(F.nullif(unit, F.lit("")), squeeze(x))).alias("currency")))


def price_in_text(x: Column) -> Column:
    return price(F.nullif(F.regexp_extract(x, r"(?i)\d[\d\s.,]*\s*(?:zł|zl|pln|eur|usd|gbp|€|\$|£)", 0), F.lit("")))


def number_maybe(x: Column) -> Column:
    raw = F.regexp_extract(x, r"-?[0-9][0-9 ]*(?:[,.][0-9]+)?", 0)
    return as_number(F.replace(raw, F.lit(" "), F.lit("")))


def money(x: Column) -> Column:
    bare = F.regexp_replace(x, r"\s+", "")
    return as_number(F.regexp_replace(bare, r"[.](?=[0-9]{3}(?:[^0-9]|$))", ""))


def int_maybe(x: Column) -> Column:
    return F.regexp_replace(x, r"\D+", "").try_cast("int")


def rating(x: Column) -> Column:
    """Out of five, or before a star; null outside 0 to 5."""
    value = lambda p: as_number(found(x, p))
    ok = lambda v: F.when((v >= 0) & (v <= 5), v)
    return F.coalesce(ok(value(RATING + r"/\s*5")), ok(value(RATING + "★")))


def review_count(x: Column) -> Column:
    low = F.lower(x)
    return F.coalesce(found(low, rf"([0-9]{{1,6}})\s*{REVIEW}").try_cast("bigint"), found(low, rf"{REVIEW}[^0-9]{{0,30}}\(\s*([0-9]{{1,6}})\s*\)").try_cast("bigint"))


def trend_price(x: Column) -> Column:
    return money(found(x, r"(?i)(?:historia\s*cen|trend\s*cenowy)[^0-9]{0,60}([0-9]{1,6}(?:[\s\x{00A0}]?[0-9]{3})*(?:[.,][0-9]{1,2})?)"))


def rating_signature(x: Column) -> Column:
    value, of = found(x, RATING + r"/\s*(10|5)"), found(x, RATING + r"/\s*(10|5)", 2)
    return F.when(value.isNotNull(), F.concat(F.lit("RATING:"), F.replace(value, F.lit(","), F.lit(".")), F.lit("/"), of))


def count_signature(x: Column) -> Column:
    n = found(F.lower(x), rf"([0-9][0-9 .]*)\s*{REVIEW}")
    return F.when(n.isNotNull(), F.concat(F.lit("COUNT:"), F.regexp_replace(n, "[ .]", "")))


def number_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[0-9]+[0-9.,]*"), F.lit(0))


def change(before: Column, after: Column) -> Column:
    """struct(before, after) when both are known and differ."""
    return F.when(before.isNotNull() & after.isNotNull() & (before != after), F.struct(before.alias("before"), after.alias("after")))


def price_change(before: Column, after: Column) -> Column:
    d = after - before
    return F.when(d.isNotNull() & (d != 0), F.struct(d.alias("absolute"), F.try_divide(d, F.nullif(before, F.lit(0.0))).alias("relative")))


def duration_rounded(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6).cast("bigint")


def duration_floored(start: Column, end: Column) -> Column:
    seconds = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)
    return F.greatest(F.lit(0), seconds).cast("bigint")


def price_like(text: Column, value: Column, amount: Column) -> Column:
    """A number given as text, or as a value or an amount."""
    return F.coalesce(value, amount, number_maybe(text))


def number_or_null(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), number_maybe(x))


def token_norm(x: Column) -> Column:
    return F.translate(x, " .", "")


def iso(x: Column) -> Column:
    """ISO text of a time, null if it isn't one."""
    return F.date_format(F.try_to_timestamp(x), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def still_valid(expires: Column, used: Column, now: Column) -> Column:
    """A one-time token's window: not expired, not used."""
    return (expires > now) & used.isNull()
