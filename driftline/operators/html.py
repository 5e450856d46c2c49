"""HTML pages to text: structured walk, JSON-LD, meta tags, candidates and choice.

The walk needs a parser and runs in Arrow batches; everything that a regular
expression can say is a column expression.
"""

from __future__ import annotations

import json
import re
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import numbers, predicates
from driftline.functions import text as t
from driftline.operators.lines import _udf

SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "canvas"}
BOILERPLATE = {"nav", "footer", "header", "aside"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ENDS_P = {"div", "ul", "ol", "dl", "table", "section", "article", "main", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "form", "figure", "nav", "footer", "header", "aside", "pre"}
SCOPES = {"ul", "ol", "table", "dl", "div", "article", "section", "main"}


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs, [], parent

    def elements(self) -> "list[Node]":
        return [x for x in self.parts if isinstance(x, Node)]

    def descend(self):
        stack = self.elements()[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.elements()[::-1])

    def text(self, drop: frozenset[str] = frozenset()) -> str:
        out, stack = [], [iter(self.parts)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    out.append(x)
                elif x.tag == "br":
                    out.append("\n")
                elif x.tag not in SKIP and x.tag not in drop:
                    stack.append(iter(x.parts))
                    break
            else:
                stack.pop()
        return "".join(out)


class Tree(HTMLParser):
    """Tolerant tree: implied ends of p, li, table cells; unmatched ends ignored."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P or tag in CLOSES:
            close = CLOSES.get(tag, {"p"})
            n = self.at
            while n.parent is not None and (n.tag not in SCOPES or n.tag in close):
                if n.tag in close:
                    self.at = n.parent
                n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def in_boilerplate(n: Node) -> bool:
    return n.tag in BOILERPLATE or n.attrs.get("role") in ("navigation", "contentinfo", "banner", "complementary")


def inline(s: str) -> str:
    s = re.sub(r"[​-‍﻿]", "", unescape(s))
    s = re.sub(r"\s+", " ", s).strip()
    s = re.sub(r"(\d)([A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż])", r"\1 \2", s)
    return re.sub(r"([A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż])(\d)", r"\1 \2", s)


def content_root(root: Node) -> Node:
    """The longest of main and article if it has 200 characters, else everything."""
    best = max((n for n in root.descend() if n.tag in ("main", "article") or n.attrs.get("role") == "main"), key=lambda n: len(n.text().strip()), default=None)
    return best if best is not None and len(best.text().strip()) >= 200 else root


def table_lines(n: Node) -> list[str]:
    out = []
    for c in n.descend():
        if c.tag == "caption":
            out.append("TABLE: " + inline(c.text()))
        elif c.tag == "tr":
            cells = [x for x in c.elements() if x.tag in ("td", "th")]
            row = " | ".join(inline(x.text()) for x in cells)
            if row.strip(" |"):
                out.append(("HEAD: " if cells and all(x.tag == "th" for x in cells) else "") + row)
    return out


def definition_lines(n: Node) -> list[str]:
    out, name = [], ""
    for c in n.descend():
        if c.tag == "dt":
            name = inline(c.text())
        elif c.tag == "dd":
            out.append(f"{name}: {inline(c.text())}")
    return out


def block_lines(html: str | None) -> list[tuple[str, str]]:
    """(kind, line) of a page in document order, each line once."""
    if not html:
        return []
    out: list[tuple[str, str]] = []
    seen: set[str] = set()

    def emit(kind: str, line: str) -> None:
        if line.strip() and line not in seen:
            seen.add(line)
            out.append((kind, line))

    stack: list[tuple[Node, int, bool]] = [(content_root(Tree(html).root), 0, False)]
    while stack:
        n, depth, in_li = stack.pop()
        tag = n.tag
        if tag in SKIP or (tag != "#root" and (hidden(n) or in_boilerplate(n))):
            continue
        if tag == "table":
            for x in table_lines(n):
                emit("table", x)
        elif tag == "dl":
            for x in definition_lines(n):
                emit("pair", x)
        elif re.fullmatch("h[1-6]", tag):
            line = inline(n.text())
            emit("heading", "#" * int(tag[1]) + " " + line if line else "")
        elif tag == "li":
            own = inline(n.text(frozenset({"ul", "ol", "table", "dl"})))
            emit("list", "  " * max(0, depth - 1) + "- " + own if own else "")
            stack.extend((c, depth, True) for c in reversed(n.elements()) if c.tag in ("ul", "ol", "table", "dl"))
        elif tag in ("p", "blockquote", "figcaption") and not in_li:
            emit("text", inline(n.text()))
        else:
            down = depth + (tag in ("ul", "ol"))
            stack.extend((c, down, in_li) for c in reversed(n.elements()))
    if not out and html:
        line = inline(Tree(html).root.text())
        if line:
            out.append(("text", line))
    return out


def dom_lines(html: Column) -> Column:
    """array of struct(kind, line)."""
    return _udf(lambda h: [{"kind": k, "line": x} for k, x in block_lines(h)], "array<struct<kind: string, line: string>>")(html)


def finalise(lines: Column, most: int = 2_500) -> Column:
    """Cleaned lines of a walk: tags stripped, noise dropped, each once, ``most`` at most."""
    texts = F.transform(lines, lambda x: F.rtrim(t.strip_tags(x["line"])))
    return F.slice(F.array_distinct(F.filter(texts, lambda x: ~predicates.drop_line(F.trim(x)))), 1, most)


def container_score(html: str | None) -> dict | None:
    """The best container: length, paragraphs and headings weighed.

    The page is walked once into one text; a container is a span of it, and the
    paragraphs and headings in it are those that began in its span.
    """
    if not html:
        return None
    parts: list[str] = []
    size = ps = hs = 0
    found: list[tuple[Node, bool, int, int, bool, int, int]] = []  # ... start, end, shown, paragraphs, headings
    stack: list = [(Tree(html).root, True)]
    while stack:
        x, shown = stack.pop()
        if isinstance(x, str):
            if shown:
                parts.append(x)
                size += len(x)
        elif isinstance(x, tuple):  # a container ends
            node, named, start, p, head, visible = x
            found.append((node, named, start, size, visible, ps - p, hs - head))
        else:
            named = x.tag in ("article", "main") or x.attrs.get("role") == "main" or x.attrs.get("id") == "content"
            ps += x.tag == "p"
            hs += x.tag in ("h1", "h2", "h3")
            if x.tag == "br" and shown:
                parts.append("\n")
                size += 1
            inside = shown and x.tag not in SKIP
            if named or x.tag == "div":
                stack.append(((x, named, size, ps, hs, inside), shown))
            stack.extend((c, inside) for c in reversed(x.parts))
    whole, best = "".join(parts), None
    for node, named, start, end, visible, p, h in sorted(reversed(found), key=lambda f: (f[2], -f[3])):
        if not named and (p < 3 or end - start <= 500):
            continue
        text = inline(whole[start:end]) if visible else inline(node.text())
        if not named and len(text) <= 500:
            continue
        score = min(len(text) / 8000, 1.0) + min(p / 20, 0.5) + (0.1 if h else 0.0)
        if best is None or score > best["score"]:
            best = {"tag": node.tag, "score": score, "text": text}
    return best


def best_container(html: Column) -> Column:
    return _udf(container_score, "struct<tag: string, score: double, text: string>")(html)


# --- regular expressions


def title(html: Column) -> Column:
    return t.blank_to_null(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def heading(html: Column, level: int = 1) -> Column:
    return t.blank_to_null(t.strip_tags(F.regexp_extract(html, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1)))


def meta(html: Column, *names: str) -> Column:
    """Trimmed content of the first meta tag by name or property, attributes in either order."""
    found = []
    for n in names:
        n = n.replace(".", r"\.")
        found.append(t.blank_to_null(F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property|itemprop)=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)))
        found.append(t.blank_to_null(F.regexp_extract(html, rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:name|property|itemprop)=[\"']{n}[\"']", 1)))
    return F.coalesce(*found)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))


def paragraphs(html: Column, most: int | None = None) -> Column:
    """Text of the closed p elements, of the first ``most`` of them; blank ones are left out then."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    raw = F.regexp_extract_all(bare, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    raw = raw if most is None else F.slice(raw, 1, most)
    return F.filter(F.transform(raw, lambda x: t.squeeze_strict(F.regexp_replace(x, "(?s)<[^>]+>", " "))), lambda x: x != "")


def url_norm(url: Column) -> Column:
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))).otherwise(url)


def page_meta(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    return pages.select("page_id", title(h).alias("title"), meta(h, "description", "og:description").alias("description"), heading(h).alias("h1"), F.size(links(h)).cast("bigint").alias("n_links"), F.length(t.squeeze(t.strip_tags(h))).cast("bigint").alias("text_length"))


def meta_candidate(html: Column) -> Column:
    """struct(detect, title, description, image, confidence) of the meta extractor."""
    og, desc = meta(html, "og:title", "twitter:title"), meta(html, "og:description", "description")
    name = F.coalesce(og, title(html))
    return F.struct(
        F.when(og.isNotNull(), 0.7).when(name.isNotNull(), 0.3).otherwise(0.0).alias("detect"),
        name.alias("title"),
        desc.alias("description"),
        meta(html, "og:image", "twitter:image").alias("image"),
        F.when(og.isNotNull() | desc.isNotNull(), 0.6).otherwise(0.45).alias("confidence"),
    )


def fallback_candidate(html: Column) -> Column:
    text = F.array_join(paragraphs(html, 6), "\n")
    return F.struct(title(html).alias("title"), meta(html, "description").alias("description"), text.alias("text"), F.when(text != "", 0.35).otherwise(0.2).alias("confidence"))


# --- JSON-LD


def _entries(html: str) -> list[dict]:
    out = []
    for raw in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html):
        try:
            data = json.loads(raw.strip())
        except ValueError:
            m = re.search(r"(?s)\{.*\}", raw)
            try:
                data = json.loads(m.group()) if m else None
            except ValueError:
                data = None
        stack = [data]
        while stack:
            x = stack.pop(0)
            if isinstance(x, list):
                stack = x + stack
            elif isinstance(x, dict):
                out += [] if "@graph" in x else [x]
                if "@graph" in x:
                    stack = (x["@graph"] if isinstance(x["@graph"], list) else [x["@graph"]]) + stack
    return out


def _types(e: dict) -> list[str]:
    k = e.get("@type")
    return [str(x).lower() for x in (k if isinstance(k, list) else [k]) if x]


def _score(e: dict) -> float:
    for name, s in (("product", 1.0), ("itemlist", 0.98), ("article", 0.9), ("page", 0.65)):
        if any(name in k for k in _types(e)):
            return s
    return 0.4


def _text(v) -> str | None:
    if isinstance(v, dict):
        v = v.get("name") or v.get("url")
    return str(v).strip() or None if isinstance(v, (str, int, float)) else None


def _offer(e: dict) -> tuple[float | None, str | None]:
    offers = e.get("offers")
    for o in [*(offers if isinstance(offers, list) else [offers]), e]:
        if isinstance(o, dict):
            for k in ("price", "lowPrice"):
                try:
                    return float(str(o[k]).replace(" ", "").replace(",", ".")), _text(o.get("priceCurrency"))
                except (KeyError, ValueError):
                    continue
    return None, None


def jsonld_best(html: str | None) -> dict | None:
    """The best-scored entry as a record."""
    entries = _entries(html or "")
    if not entries:
        return None
    e = max(entries, key=_score)
    name = next((x for k in ("name", "headline", "title") if (x := _text(e.get(k)))), None)
    desc = next((x for k in ("description", "abstract", "articleBody") if (x := _text(e.get(k)))), None)
    value, currency = _offer(e)
    attrs = {k: x for k in ("brand", "sku", "gtin13", "mpn", "color", "size", "category") if (x := _text(e.get(k)))}
    images = []
    for k in ("image", "images", "photo", "thumbnailUrl"):
        v = e.get(k)
        images += [x for y in (v if isinstance(v, list) else [v]) if (x := y.get("url") if isinstance(y, dict) else _text(y))]
    lines = [f"# {name}"] if name else []
    if any("itemlist" in k for k in _types(e)):
        items = e.get("itemListElement") or []
        for x in (items if isinstance(items, list) else [items])[:180]:
            x = x.get("item", x) if isinstance(x, dict) else x
            label = _text(x)
            if label:
                p, c = _offer(x) if isinstance(x, dict) else (None, None)
                lines.append(f"- {label}" + (f" {p:g} {c or ''}".rstrip() if p is not None else ""))
    else:
        lines += [f"Cena: {value:g} {currency or ''}".rstrip()] if value is not None else []
        lines += [f"{k}: {v}" for k, v in attrs.items()] + ([desc] if desc else [])
    s = _score(e)
    return {
        "kind": (_types(e) or [""])[0], "score": s, "confidence": min(1.0, 0.75 + 0.25 * s), "title": name, "description": desc,
        "price": value, "currency": currency, "images": list(dict.fromkeys(images)), "attributes": list(attrs.items()), "text": "\n".join(lines),
    }


JSONLD = "struct<kind: string, score: double, confidence: double, title: string, description: string, price: double, currency: string, images: array<string>, attributes: map<string,string>, text: string>"


def jsonld(html: Column) -> Column:
    return _udf(jsonld_best, JSONLD)(html)


PRICE_MARKS = ("itemprop", "data-price", "data-price-value", "data-main-price")
NO_PRICE = re.compile(r"(?i)rat[ay]\b|miesi[eę]cz|\bod[ :]|u[zż]ywan|najni[zż]sza|outlet")


def price_texts(html: str | None) -> list[str]:
    """What may be the page's price, by attributes, then by class; instalments and used goods aside."""
    if not html:
        return []
    out = []
    nodes = list(Tree(html).root.descend())
    classes = ("price", "price__value", "product-price", "offer-price", "main-price", "product__price")
    tests = [lambda n: n.attrs.get("itemprop") == "price", *[(lambda n, k=k: k in n.attrs) for k in PRICE_MARKS[1:]], *[(lambda n, c=c: c in n.attrs.get("class", "").split()) for c in classes]]
    for ok in tests:
        for n in filter(ok, nodes):
            text = next((n.attrs[k] for k in ("content", "value", *PRICE_MARKS[1:]) if n.attrs.get(k)), "") or inline(n.text())
            if text and not NO_PRICE.search(text):
                out.append(text)
    return list(dict.fromkeys(out))


def price_of_dom(html: Column) -> Column:
    """The first of ``price_texts`` that is a price."""
    prices = F.transform(_udf(price_texts, "array<string>")(html), numbers.price)
    return F.get(F.filter(prices, lambda x: x.isNotNull()), F.lit(0))


# --- choice


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One record a page: the best text of all extractors, merged with the best metadata.

    Extractors: JSON-LD, meta tags, the best container, the visible walk; if none
    is acceptable, the first paragraphs.
    """
    h = F.col(html_col)
    d = pages.select(F.col(id_col), h.alias("html"), jsonld(h).alias("ld"), meta_candidate(h).alias("m"), best_container(h).alias("c"), dom_lines(h).alias("dom"), fallback_candidate(h).alias("f"))
    visible = F.array_join(finalise(F.col("dom")), "\n")
    d = d.withColumn("visible", visible)
    candidate = lambda name, text, conf: F.struct(F.lit(name).alias("extractor"), text.alias("text"), conf.alias("confidence"), predicates.structure_score(F.coalesce(text, F.lit("")), conf, F.lit(name) == "jsonld").alias("structure"))
    d = d.withColumn(
        "candidates",
        F.array(
            candidate("jsonld", F.col("ld.text"), F.coalesce(F.col("ld.confidence"), F.lit(0.0))),
            candidate("readability", F.col("c.text"), F.least(F.lit(0.85), 0.45 + F.least(F.lit(0.4), F.coalesce("c.score", F.lit(0.0))))),
            candidate("visible", F.col("visible"), F.least(F.lit(0.55), F.length("visible") / 4000 + 0.2)),
        ),
    )
    good = F.filter("candidates", lambda c: t.blank_to_null(c["text"]).isNotNull() & ((c["structure"] >= 0.55) | (c["confidence"] >= 0.5)))
    order = F.array_sort(F.transform(good, lambda c: F.struct((-c["structure"]).alias("a"), (-c["confidence"]).alias("b"), c["extractor"].alias("x"), c.alias("c"))))
    d = d.withColumn("best", F.get(order, F.lit(0))["c"])
    text = F.coalesce("best.text", "f.text")
    return d.select(
        id_col,
        F.coalesce("best.extractor", F.lit("fallback")).alias("extractor"),
        F.coalesce("ld.title", "m.title").alias("title"),
        F.coalesce("ld.description", "m.description").alias("description"),
        text.alias("text"),
        F.coalesce("best.confidence", "f.confidence").alias("confidence"),
        predicates.content_type(F.coalesce("ld.kind", F.lit("")), text).alias("content_type"),
        predicates.block_reason(F.lit(200), F.col("html")).alias("block_reason"),
    )


def visible_text(html: str | None) -> str:
    """Text nodes of three characters and more, code and encoded data aside."""
    if not html:
        return ""
    out, stack = [], [Tree(html).root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            s = inline(n)
            if len(s) >= 3 and not re.search(r"[{};]\s*$|=>|function\s*\(|[A-Za-z0-9+/]{120,}", s):
                out.append(s)
        elif n.tag not in SKIP and (n.parent is None or not hidden(n)):
            stack.extend(reversed(n.parts))
    return "\n".join(out)


def walker(html: Column) -> Column:
    return _udf(visible_text, "string")(html)


def images(html: Column) -> Column:
    """Addresses of preview images in meta tags and links."""
    link = F.regexp_extract_all(html, F.lit(r"(?is)<link[^>]*rel=[\"']image_src[\"'][^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))
    named = F.filter(F.array(meta(html, "og:image"), meta(html, "twitter:image")), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(named, link))


def meta_price(html: Column) -> Column:
    value, unit = meta(html, "product:price:amount", "price"), meta(html, "product:price:currency", "priceCurrency")
    return F.when(value.isNotNull(), F.struct(numbers.number_maybe(value).alias("value"), F.coalesce(unit, numbers.currency(value)).alias("currency")))


def plain_text(html: Column, most: int = 20_000) -> Column:
    return F.left(t.squeeze_strict(t.strip_tags(F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), html))), F.lit(most))


def extract_any(pages: DataFrame, status: Column) -> DataFrame:
    """Blocked pages as such, with no text; the others extracted, their text cleaned to lines."""
    why = predicates.block_reason(status, F.col("html"))
    p = pages.withColumn("why", why)
    ok = extract(p.where("why is null").drop("why"))
    ok = ok.withColumn("clean_lines", F.filter(F.transform(F.split("text", "\n"), lambda s_: F.trim(s_)), lambda x: (x != "") & ~predicates.junk_line(x)))
    blocked = p.where("why is not null").select("page_id", F.lit("blocked").alias("extractor"), F.col("why").alias("block_reason"))
    return ok.unionByName(blocked, allowMissingColumns=True)
