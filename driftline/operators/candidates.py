"""Typed quotes of one chunk under a prompt's intents: a fold over its text, run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

CANDIDATES, QUOTE, CHARS, WORDS = 14, 180, 48, 3


def _any(words: str, flags: int = re.I, tail: str = "") -> re.Pattern:
    """Any of the words (patterns, apart by blanks), whole."""
    return re.compile(rf"\b(?:{'|'.join(words.split())}){tail}\b", flags)


_fraction = re.compile(r"\b\d\d?(?:[.,]\d\d?)?\s*/\s*(?:10|5)\b")
_starred = re.compile(r"\b\d\d?(?:[.,]\d\d?)?\s*[☆★]{1,6}")
_stars = re.compile("[☆★]{3,}")
_percent = re.compile(r"\b\d{1,3}(?:[.,]\d\d?)?\s*%")
_reviews = re.compile(r"\b\d+\s*(?:ocen|opin|rating|recenz|review)\w*", re.I)
_money = re.compile(r"\b\d{1,3}(?:[\s.,]\d{3})*(?:[.,]\d\d)?\s*(?:(?:eur|pln|usd|zł\.?|zl)\b|[£$€])", re.I)
_available = _any(r"available brak dost[eę]pn\w* in\s*stock niedost[eę]pn\w* out\s*of\s*stock sold\s*out unavailable w\s*tej\s*chwili\s*nie\s*mamy")
_delivery = _any(r"delivery dostaw\w* kurier odbi[oó]r\w* pickup ship(?:ping)? wysy[lł]\w*")
_date = re.compile(r"\b\d\d?[-./]\d\d?(?:[-./]\d{2,4})?\b")
_results = re.compile(r"\b\d{1,3}(?:[ .]\d{3})*\s*(?:items?|listing\w*|ofert\w*|produkt\w*|results?|wynik\w*)\b", re.I)
_review_word = _any("ocena oceny opinia opinie rating ratings recenzja recenzje review reviews")
_filter_word = re.compile(r"\b(?:filtry?\s*\d*|(?:brand|category|color|kategoria|kolor|marka|rozmiar|size):)", re.I)
_section = _any(
    "biznes ekonomia gospodarka kultura moto najnowsze najwa[zż]niejsze opinie podró[zż]e podroze polityka polska region regionalne rozrywka sport [sś]wiat tech technologia zdrowie"
)
_ago = re.compile(r"\b\d+\s*(?:godz(?:\.|in(?:y)?)?|hours?|min(?:\.|s|utes?|ut[yę]?)?)(?!\w)(?:\s*(?:ago|temu)\b)?", re.I)
_day = _any("dzisiaj dziś today wczoraj yesterday")
_clock = re.compile(r"\b\d\d?:\d\d\b")
_bullet = re.compile(r"(?:\d{1,3}[).]|[•-])\s+")
_mark = re.compile(r"^\[P\d+\]\s*", re.I)
_navigation = re.compile(r"(?:(?:about|category|filtry?|help|home|kategoria|kontakt|menu|search|sort|sortuj|szukaj)\b|(?:brand|marka):)", re.I)
_brand = re.compile(r"(?:^[•-]\s*)?(?:brand|marka):", re.I)
_goods = re.compile(r"\b\d+\s*(?:g|kg|l|ml)\b|\b(?:pln|zl|zł)\b|[$€(),]", re.I)
_capitals = re.compile(r"[0-9A-ZĄĆĘŁŃÓŚŹŻ\s-]{3,}")
_rank = re.compile(r"(?<!\S)-\s*#\s*(\d{1,3})\b")
_rank_line = re.compile(r"(?:^|\n)\s*-\s*#\s*(\d{1,3})\b")

#: Prompt words that name no thing to look for.
GENERIC = frozenset(
    "add added appear appears article articles artykul artykuly artykuł artykuły dodaj dodane dodany element elementy entries entry item items jesli jezeli jeśli lista listing listings listy new news notify nowa nowe nowy "
    "oferta oferty pojaw pojawi pojawic post posty pozycja pozycje product products produkt produkty strona strony wiadomosc wiadomosci wiadomość wiadomości wpis wpisy".split()
)
SELLER = re.compile(r"(?:firma\s+poleca|kupujacych\s+polec|miesiac|polec\w*\s+tego\s+sprzedaw|sprzedaw|w ostatnich)")
PRICE_NOISE = re.compile(r"(?:\b(?:zl|zł)\b|dostaw|kup\s+do|pay|pln|rat|smart|zaplac|\b\d\d?:\d\d\b)")
REVIEW_HINT = re.compile(r"(?:/10|/5|gwiazd|ocen|opin|rating|recenz|review|★)")
FINANCE = _any(r"finansowan kredyt leasing ma(?:ks|x)\.? miesi[aą]c miesi[eę]cz okres rat[ay] wp[lł]ata", 0)


def norm_key(quote: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[\"'„”“’«»`]", "", quote.lower())).strip()


# --- windows around a match


def _snapped(text: str, a: int, b: int) -> str:
    while 0 < a < len(text) and not text[a - 1].isspace() and not text[a].isspace() and a < b:
        a += 1
    while a < b < len(text) and not text[b].isspace():
        b -= 1
    return text[a:b].strip()


def window_chars(text: str, a: int, b: int, around: int = CHARS, most: int = QUOTE) -> str:
    """[a, b) and some characters around it, cut at white space."""
    s = _snapped(text, max(0, a - around), min(len(text), b + around))
    if len(s) <= most:
        return s
    half = max(18, (most - (b - a)) // 2)
    return _snapped(text, max(0, a - half), min(len(text), b + half))[:most].strip()


def window_words(text: str, a: int, b: int, around: int = WORDS, most: int = QUOTE) -> str:
    """The words of [a, b) and some before and after them."""
    starts = [m.start() for m in re.finditer(r"\S+", text[max(0, a - 4_000) : a])][-(around + 1) :]
    at = max(0, a - 4_000)
    begin = a
    if starts:
        inside = a > 0 and not text[a - 1].isspace() and not text[a].isspace()  # [a, b) begins within a word
        kept = starts if inside else starts[-around:] if around else []
        begin = at + kept[0] if kept else a
    ends = [m.end() for m in re.finditer(r"\S+", text[b : b + 4_000])]
    inside = b < len(text) and b > 0 and not text[b - 1].isspace() and not text[b].isspace()
    n = around + inside
    end = b + (ends[min(n, len(ends)) - 1] if ends and n else 0)
    s = text[begin:end].strip()
    return s if len(s) <= most else window_chars(text, a, b, most=most)


def window_lines(text: str, a: int, b: int, following: int = 0, most: int = QUOTE) -> str:
    """The lines of [a, b) and some after them; words where that is too long or the text has one line."""
    if "\n" not in text:
        return window_words(text, a, b, most=most)
    begin = text.rfind("\n", 0, a) + 1
    end = text.find("\n", b)
    for _ in range(following):
        if end < 0:
            break
        end = text.find("\n", end + 1)
    s = text[begin : end if end >= 0 else len(text)].strip()
    return s if len(s) <= most else window_words(text, a, b, most=most)


# --- selection


def in_paragraphs(text: str, wanted: set[int]) -> str:
    marks = [(m.start(), int(m[1])) for m in re.finditer(r"\[P\s*(\d{1,4})\]", text, re.I)]
    ends = [a for a, _ in marks[1:]] + [len(text)]
    return "\n".join(text[a:e].rstrip() for (a, n), e in zip(marks, ends) if n in wanted).strip()


def rank_lines(text: str | None, limit: int | None) -> int:
    """Lines ``- #n`` with n up to the limit."""
    return sum(0 < int(m[1]) <= (limit or 10) for m in _rank_line.finditer(text or ""))


def ranked(text: str, limit: int, most: int = CANDIDATES) -> Iterator[tuple[int, str]]:
    """rank, quote of each ``- #n`` up to the next."""
    found = list(_rank.finditer(text))
    for m, e in zip(found, [m.start() for m in found[1:]] + [len(text)]):
        if 0 < int(m[1]) <= limit and (q := text[m.start() : e].strip()):
            yield int(m[1]), q[:QUOTE].strip()


class _Out:
    """Quotes, each normalised one once; an id counts every attempt."""

    def __init__(self, most: int):
        self.most, self.n, self.seen, self.rows = most, 0, set(), []

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def push(self, kind: str, quote: str, rank: int | None = None) -> None:
        i, self.n = self.n, self.n + 1
        quote = quote.strip()
        k = norm_key(quote)
        if k and k not in self.seen:
            self.seen.add(k)
            self.rows.append({"idx": i, "kind": kind, "quote": quote, "rank": rank})


def _new_items(out: _Out, lines: list[str], wants: Mapping, kws: list[str]) -> None:
    things = [k for k in kws if len(k) >= 4 and k not in GENERIC]
    for line in lines:
        if out.full():
            break
        bare = _mark.sub("", line).strip()
        bullet = _bullet.match(bare)
        bare = bare[bullet.end() :].strip() if bullet else bare
        if len(bare) < 12 or _navigation.match(bare):
            continue
        timed = any(p.search(bare) for p in (_ago, _day, _clock, _date))
        if wants.get("news_list"):
            section = _section.search(bare)
            if section and len(bare) <= 40 and not re.search(r"[!.?\d]", bare):
                out.push("news_header", line[:QUOTE])
                continue
            if bullet or timed or section:
                out.push("news_line", line[:QUOTE])
                continue
        if not bullet:
            continue
        words = bare.split()
        plain = not re.search(r"[(),.:;]", bare)
        if plain and (len(words) <= 2 and len(bare) < 18 and not re.search(r"\d", bare) or len(words) <= 5 and _capitals.fullmatch(bare)):
            continue  # a category or a label
        if things:
            if not any(k in bare.lower() for k in things):
                continue
        elif not (timed or _goods.search(bare) or re.search(r"\b\d{3,}\b", bare) or len(bare) >= 40 or len(words) >= 8 or len(words) >= 6 and re.search(r"[!\".?]", bare)):
            continue
        out.push("product_line", line[:QUOTE])
    if not out.rows and not things:
        for line in lines:
            bare = _mark.sub("", line).strip()
            bullet = _bullet.match(bare)
            bare = bare[bullet.end() :].strip() if bullet else ""
            if not out.full() and len(bare) >= 20 and not _navigation.match(bare) and len(bare.split()) >= 4:
                out.push("product_line", line[:QUOTE])
    _brand_line(out, lines)


def _brand_line(out: _Out, lines: list[str]) -> None:
    line = next((x for x in lines if _brand.search(x)), None)
    if line and not out.full():
        out.push("brand_line", line[:QUOTE])


def _patterns(wants: Mapping, text: str) -> list[tuple[str, re.Pattern, int]]:
    """kind, pattern, lines that follow: what the intents ask for."""
    found: list[tuple[str, re.Pattern, int]] = []
    if wants.get("price") and not wants.get("exclude_price"):
        found += [("price", _money, 1), ("percent", _percent, 0)]
    if wants.get("availability"):
        found.append(("availability", _available, 0))
    if wants.get("delivery") and not wants.get("exclude_delivery"):
        found += [("delivery_keyword", _delivery, 1), ("date", _date, 1)]
    if wants.get("count"):
        found.append(("count_results", _results, 1))
    if wants.get("reviews"):
        found += [("rating", _fraction, 1), ("rating_stars", _starred, 1)]
        if not any(p.search(text) for p in (_fraction, _starred, _reviews)):
            found.append(("stars", _stars, 0))  # stars alone are often noise of recognition
        found.append(("count", _reviews, 0))
    return found or [("percent", _percent, 0), ("date", _date, 1)]


def chunk_candidates(text: str | None, wants: Mapping, kws: list[str] | None, order: int | None = 0, most: int = CANDIDATES) -> list[dict]:
    """idx, kind, quote, rank: what a chunk has for a prompt of these intents.

    ``wants`` holds the intents by name, ``rank_limit`` and ``paragraphs``.
    Paragraphs restrict the text; a ranking gives its items alone; new and listed
    items come from lines, prices, ratings, counts, dates and the like from
    patterns; then headline, list and keyword quotes fill up.  Percentages of
    sellers, prices and instalments are noise.
    """
    text, kws = text or "", [k for k in kws or [] if k]
    if wants.get("paragraphs"):
        text = in_paragraphs(text, set(wants["paragraphs"]))
    out = _Out(most)
    if wants.get("ranking"):
        for rank, quote in ranked(text, wants.get("rank_limit") or 10):
            if not out.full():
                out.push("rank_item", quote, rank)
        if out.rows or _rank_line.search(text):
            return out.rows
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    if wants.get("new_item") and not wants.get("ranking"):
        _new_items(out, lines, wants, kws)
    if wants.get("list_items") and not wants.get("ranking") and not out.full():
        for line in lines:
            bullet = _bullet.match(line)
            bare = line[bullet.end() :].strip() if bullet else ""
            if not out.full() and len(bare) >= 10 and not _navigation.match(bare) and (_goods.search(bare) or len(bare) >= 22):
                out.push("list_item", line[:QUOTE])
        _brand_line(out, lines)

    asks_price = wants.get("price") and not wants.get("exclude_price")
    for kind, pattern, following in _patterns(wants, text):
        for m in pattern.finditer(text):
            quote = window_lines(text, *m.span(), following)
            if asks_price and kind in ("price", "percent") and FINANCE.search(quote.lower()):
                continue
            out.push(kind, quote)
            if out.full():
                return out.rows
    if asks_price and wants.get("only") and not wants.get("reviews") and not any(r["kind"] == "price" for r in out.rows):
        return []
    if wants.get("reviews"):
        for m in _review_word.finditer(text):
            out.push("review_keyword", window_lines(text, *m.span(), 1))
            if out.full():
                return out.rows
    if wants.get("filters"):
        for m in _filter_word.finditer(text):
            out.push("filter_keyword", window_lines(text, *m.span(), 2))
            if out.full():
                return out.rows
    if wants.get("headline") and not order:
        for line in lines[:6]:
            if not out.full() and line[0] not in "-•" and len(line) >= 6:
                out.push("headline", line[:QUOTE])
    if wants.get("list_items"):
        for line in lines:
            if not out.full() and _bullet.match(line) and 10 <= len(line) <= 240:
                out.push("list_item", line[:QUOTE])
    for k in kws:
        for m in re.finditer(re.escape(k), text, re.I):
            if out.full():
                break
            out.push("keyword", window_lines(text, *m.span()))
    return [r for r in out.rows if r["kind"] != "percent" or wants.get("seller") or not _noise(r["quote"].lower())]


def _noise(low: str) -> bool:
    return bool(SELLER.search(low) or PRICE_NOISE.search(low) and not REVIEW_HINT.search(low))


def covering(hits: list[list[int] | None], wanted: list[int], most: int) -> list[int]:
    """Places of the chunks to read for the wanted paragraphs.

    In order, those that add a paragraph; then, up to ``most``, those with the
    most of them, the earlier first.  ``hits``: wanted paragraphs of each chunk.
    """
    able = [i for i, h in enumerate(hits) if h]
    chosen, covered = [], set()
    for i in able:
        if len(chosen) >= most or covered >= set(wanted):
            break
        if not chosen or set(hits[i]) - covered:
            chosen.append(i)
            covered |= set(hits[i])
    rest = sorted(set(able) - set(chosen), key=lambda i: (-len(hits[i]), i))
    return sorted(chosen + rest[: max(0, most - len(chosen))])
