"""HTML pages to article records: one Arrow UDF per page, results as a typed struct.

Pages come as ``binaryFile`` rows or a string column.  The parser is the standard library's; a
small tree is built in which a block ends an open paragraph.  An error on one page becomes the ``error`` field
of its row and never fails the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.timestamps import interpretations

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("p div ul ol li blockquote pre table section article aside nav footer header main figure form h1 h2 h3 h4 h5 h6 hr".split())
FRAME_TAGS = frozenset("nav footer header aside form".split())

# Elements without text of the page, elements that hold a block of text, words in class and id that name the
# page's frame or an article's root, and lines that end the body or are no part of it.
HIDDEN = frozenset("script style noscript template".split())
BLOCKS = frozenset("p li blockquote h2 h3 h4 pre".split())
FRAME_NAMES = re.compile(r"(?:nav|menu|footer|header|sidebar|share|social|reaction|comment|signup|newsletter|petition|donat|login|account|breadcrumb|pagination|site-map)", re.I)
FRAME_CLASSES = frozenset("breadcrumb breadcrumbs share social reaction reactions comment comments signup newsletter pagination caption image-caption wp-caption-text".split())
ROOT_NAMES = re.compile(r"article|post|entry|blog|page-content|content-pages", re.I)
STOP_LINE = re.compile(r"^(?:do you like this page\??|showing\s+\d+\s+reaction|sign in with|or sign in with email|create an account|site map|newsletter|follow us|contact address)", re.I)
META_LINE = re.compile(r"^(?:posted by\b|[A-Z][a-z]+\s+\d{1,2},\s+\d{4}\b)", re.I)
# What a candidate root gains or loses besides its words.
BONUS = {"article": 160, "main": -40, "body": -180, "html": -180}
BODY_PROPERTY, ROOT_NAME, FRAME_NAME, PER_BLOCK, MAX_BLOCKS, PER_NODES, MAX_NODES = 220, 100, -500, 12, 50, 80, 80

IMAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "alt_text", "title_text", "figcaption", "caption_source", "image_role", "source_location")])
ARTICLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "published_at", "author", "body", "body_selector", "canonical", "error")]
    + [T.StructField("paragraphs", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("images", T.ArrayType(IMAGE)), T.StructField("n_words", T.IntegerType())]
)


class Node:
    """An element with its children; text is a plain string among them."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}"

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def pieces(self, skip: frozenset[str], classes: frozenset[str] = frozenset()) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in skip and not (classes and classes.intersection(c.attrs.get("class", "").split())):
                if c.tag == "br":
                    yield "\n"
                yield from c.pieces(skip, classes)

    def text(self, skip: frozenset[str] = HIDDEN) -> str:
        return " ".join(" ".join(self.pieces(skip)).replace("\xa0", " ").split())

    def lines(self, skip: frozenset[str], classes: frozenset[str] = frozenset()) -> list[str]:
        found = (" ".join(x.replace("\xa0", " ").split()) for p in self.pieces(skip, classes) for x in p.split("\n"))
        return [x for x in found if x]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and any(n.tag == "p" for n in (self.at, *self.at.ancestors())):
            while self.at.tag != "p":
                self.at = self.at.parent
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def plain(value: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", value.casefold()).strip()


def _meta(root: Node, *names: str) -> str | None:
    wanted = {n: i for i, n in enumerate(names)}
    found: dict[int, str] = {}
    for m in root.find("meta"):
        for key in ("property", "name", "itemprop"):
            i = wanted.get(m.attrs.get(key, ""))
            if i is not None and m.attrs.get("content", "").strip():
                found.setdefault(i, m.attrs["content"].strip())
    return found[min(found)] if found else None


def _title(root: Node) -> str:
    value = _meta(root, "og:title", "twitter:title")
    if not value:
        heads = [(any(a.tag in ("main", "article") for a in n.ancestors()), n.tag == "h1", n.text()) for n in root.find("h1", "h2")]
        heads = [h for h in heads if h[2]]
        value = max(heads, key=lambda h: (h[1], h[0]))[2] if heads else next((n.text() for n in root.find("title") if n.text()), "")
    value, site = " ".join((value or "").split()), _meta(root, "og:site_name")
    return re.sub(rf"(?i)\s+[-|–]\s+{re.escape(site)}$", "", value) if site else value


def _jsonld(root: Node) -> dict[str, object]:
    def walk(v):
        if isinstance(v, dict):
            yield v
        for child in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            yield from walk(child)

    for s in root.find("script"):
        if s.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(c for c in s.children if isinstance(c, str)))
        except ValueError:
            continue
        for item in walk(data):
            kinds = item.get("@type")
            if any(str(k).endswith("Article") or k == "BlogPosting" for k in (kinds if isinstance(kinds, list) else [kinds])):
                author = item.get("author")
                author = author[0] if isinstance(author, list) and author else author
                name = author.get("name") if isinstance(author, dict) else author
                body = item.get("articleBody")
                return {"published_at": item.get("datePublished"), "author": name, "paragraphs": [x.strip() for x in re.split(r"\n+", body) if x.strip()] if isinstance(body, str) else []}
    return {}


def _published(root: Node) -> str | None:
    candidates = [_meta(root, "article:published_time", "date", "publish_date", "datePublished")]
    for t in root.find("time"):
        candidates += [t.attrs.get("datetime"), t.text()]
    candidates += [n.text() for n in root.walk() if re.search(r"(?:^|\s)(?:byline|published-at|date|post-date|blog-date)(?:\s|$)", n.attrs.get("class", ""))]
    for c in candidates:
        for reading in interpretations(c, None, "UTC") if c else ():
            if 1990 <= reading[1].year <= 2100:
                return reading[1].isoformat() if not re.search(r"(?:z|[+-]\d\d:?\d\d)$", c.strip().lower()) else pd.Timestamp(reading[2], unit="s", tz="UTC").isoformat()
    return None


def _framed(node: Node) -> bool:
    return any(n.tag in FRAME_TAGS or FRAME_NAMES.search(n.names()) for n in (node, *node.ancestors()) if n.tag not in ("body", "html", "document"))


def _clean(lines: Iterable[str], title: str, tags: set[str]) -> list[str]:
    """Body lines in order: no title echo, tag, meta line or repeat; a stop line ends them."""
    out: list[str] = []
    echo = plain(title)
    for line in lines:
        norm = plain(line)
        if not norm or (echo and (norm in echo or echo in norm)) or line in tags or META_LINE.search(line):
            continue
        if STOP_LINE.search(line):
            break
        if line in out or any(line in kept for kept in out[-3:]):
            continue
        out.append(line)
    return out


def _blocks(root: Node, title: str, tags: set[str]) -> list[str]:
    def found() -> Iterator[str]:
        for n in root.find(*BLOCKS):
            nested = False
            for a in n.ancestors():
                if a is root:
                    break
                nested = nested or a.tag in BLOCKS
            if nested or _framed(n):
                continue
            residual = n.text(HIDDEN | {"figure", "figcaption", "picture"})
            if any(True for _ in n.find("img")) and len(residual.split()) <= 25:
                continue  # a caption beside its image
            yield residual

    return _clean(found(), title, tags)


def _lines(root: Node, title: str, tags: set[str]) -> list[str]:
    lines = root.lines(HIDDEN | FRAME_TAGS | {"figcaption", "h1", "title"}, FRAME_CLASSES)
    echo = plain(title)
    starts = [i for i, x in enumerate(lines) if plain(x) == echo]
    return _clean(lines[starts[-1] + 1 if starts else 0 :], title, tags)


def _words(blocks: list[str]) -> int:
    return sum(len(b.split()) for b in blocks)


def _roots(root: Node, title: str) -> list[Node]:
    echo = plain(title)
    found = [n for n in root.walk() if n.tag in ("article", "main", "body") or n.attrs.get("itemprop") == "articleBody" or n.attrs.get("role") == "main" or re.search(r"content|post|entry|article", n.names(), re.I)]
    for h in root.find("h1", "h2", "h3"):
        if echo and plain(h.text()) == echo:
            found += list(h.ancestors())[:8]
    found = found or [n for n in root.find("div", "section")] or [root]
    return list({id(n): n for n in found if n.tag not in HIDDEN | {"document", "html", "head", "meta"}}.values()) or [root]


def _score(node: Node, words: int) -> float:
    bonus = BONUS.get(node.tag, 0)
    bonus += BODY_PROPERTY if node.attrs.get("itemprop") == "articleBody" else 0
    bonus += ROOT_NAME if ROOT_NAMES.search(node.names()) else 0
    bonus += FRAME_NAME if FRAME_NAMES.search(node.names()) else 0
    below = len(node.children) + sum(len(n.children) for n in node.walk())  # elements and texts
    return words + bonus + PER_BLOCK * min(sum(1 for _ in node.find("p", "blockquote", "li")), MAX_BLOCKS) - min(below // PER_NODES, MAX_NODES)


def _source(img: Node) -> str | None:
    """The largest candidate of a srcset, else a lazy or plain source; inline data is none."""
    best = (0.0, None)
    for part in (img.attrs.get("srcset") or img.attrs.get("data-srcset") or "").split(","):
        bits = part.split()
        if bits:
            m = re.fullmatch(r"([\d.]+)([wx])", bits[1]) if len(bits) > 1 else None
            best = max(best, (float(m[1]) * (1000 if m[2] == "x" else 1) if m else 1.0, bits[0]), key=lambda x: x[0])
    url = best[1] or img.attrs.get("data-src") or img.attrs.get("data-original") or img.attrs.get("src")
    return None if not url or url.startswith("data:") else url


def _images(page: Node, root: Node, base: str) -> list[dict[str, str | None]]:
    out: dict[str, dict[str, str | None]] = {}
    hero = _meta(page, "og:image") or next((n.attrs.get("href") for n in page.find("link") if "image_src" in n.attrs.get("rel", "")), None)
    blank = dict.fromkeys(f.name for f in IMAGE)
    if hero:
        url = urljoin(base, hero).split("#")[0]
        out[url] = {**blank, "url": url, "image_role": "hero", "source_location": "metadata"}
    for img in root.find("img"):
        raw = _source(img)
        if not raw:
            continue
        sides = [int(x) for x in (img.attrs.get("width", ""), img.attrs.get("height", "")) if x.isdigit()]
        if (len(sides) == 2 and max(sides) <= 80 and min(sides) >= 1) or re.search(r"(?i)icon|logo|avatar|sprite|spacer|pixel", img.names() + raw):
            continue
        figure = next((a for a in img.ancestors() if a.tag == "figure"), None)
        cap, where = (next((n.text() for n in figure.find("figcaption")), None), "figcaption") if figure else (None, None)
        if not cap and img.parent is not None and img.parent.tag in ("p", "div") and 0 < len(img.parent.text().split()) <= 25:
            cap, where = img.parent.text(), "inline_parent_text"
        url = urljoin(base, raw).split("#")[0]
        inline = {"url": url, "alt_text": img.attrs.get("alt") or None, "title_text": img.attrs.get("title") or None, "figcaption": cap or None, "caption_source": where if cap else None, "image_role": "inline", "source_location": "body"}
        out[url] = {**out.get(url, blank), **{k: v for k, v in inline.items() if v is not None}}
    return list(out.values())


def article(html: str | None, url: str | None, min_words: int = 0) -> dict[str, object]:
    """The record of one page; ``error`` says why there is none."""
    record: dict[str, object] = {f.name: None for f in ARTICLE}
    try:
        page = parse(html or "")
        title = _title(page)
        if not title:
            raise ValueError("no title")
        extra = _jsonld(page)
        main = next((n for n in page.walk() if n.tag == "div" and "content" in n.attrs.get("class", "").split() and n.parent is not None and (n.parent.attrs.get("id") == "intro" or "intro" in n.parent.attrs.get("class", "").split())), None)
        tag_links = [n.text() for n in page.find("a") if "/tags/" in n.attrs.get("href", "")]
        tags = sorted({t for t in tag_links if t})
        if main is not None:
            root, selector = main, "main#content #intro > .content"
            blocks = _blocks(root, title, set(tags)) or _lines(root, title, set(tags))
        else:
            scored = []
            for r in _roots(page, title):
                b = max((_blocks(r, title, set(tags)), _lines(r, title, set(tags))), key=lambda x: (_words(x), len(x)))
                scored.append((_score(r, _words(b)), _words(b), len(scored), r, b))
            if not scored:
                raise ValueError("no content")
            _, _, _, root, blocks = max(scored, key=lambda s: (s[0], s[1], -s[2]))
            selector = "fallback_scored_root"
        if _words(blocks) < max(min_words, 1) and extra.get("paragraphs"):
            blocks = extra["paragraphs"]
        if _words(blocks) < min_words:
            raise ValueError(f"body of {_words(blocks)} words")
        author = _meta(page, "author", "article:author") or extra.get("author")
        if not author and (m := re.search(r"(?i)posted by\s+(.+?)(?:\s*[·•|]|$)", "\n".join(page.lines(HIDDEN)), re.M)):
            author = m[1].strip()
        canonical = next((n.attrs.get("href") for n in page.find("link") if n.attrs.get("rel") == "canonical"), None) or _meta(page, "og:url")
        record |= {
            "title": title,
            "published_at": _published(page) or extra.get("published_at"),
            "author": author,
            "body": "\n\n".join(blocks),
            "body_selector": selector,
            "canonical": canonical,
            "paragraphs": blocks,
            "tags": tags,
            "images": _images(page, root, url or ""),
            "n_words": _words(blocks),
        }
    except Exception as e:  # noqa: BLE001 - a bad page is a row with an error
        record["error"] = f"{type(e).__name__}: {e}"[:300]
    return record


def extract_articles(pages: DataFrame, *, record: str, html: str, url: str, min_words: int = 0) -> DataFrame:
    """``record`` and the fields of ``ARTICLE`` for each page; null pages have an error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"record": k, **article(h, u, min_words)} for k, h, u in zip(b["record"], b["html"], b["url"])]
            yield pd.DataFrame(rows, columns=["record", *[f.name for f in ARTICLE]])

    schema = T.StructType([T.StructField("record", T.StringType()), *ARTICLE.fields])
    return pages.select(F.col(record).cast("string").alias("record"), F.col(html).cast("string").alias("html"), F.col(url).alias("url")).mapInPandas(run, schema)


def listing_links(html: str | None, url: str | None) -> list[str]:
    """Links of a listing page in first-seen order, absolute, without query and fragment."""
    found = (urljoin(url or "", n.attrs["href"]) for n in parse(html or "").find("a") if n.attrs.get("href") and not _framed(n))
    return list(dict.fromkeys(re.sub(r"[?#].*$", "", x).rstrip("/") for x in found if x.startswith("http")))


def extract_links(pages: DataFrame, *, html: str, url: str) -> DataFrame:
    """``url, position, link`` of each listing page."""

    @F.pandas_udf("array<string>")
    def run(h: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([listing_links(a, b) for a, b in zip(h, u)])

    return pages.select(F.col(url).alias("url"), F.posexplode(run(F.col(html).cast("string"), F.col(url))).alias("position", "link"))


def page_from_record(title, paragraphs, author, published) -> F.Column:
    """An HTML page of an article's own fields: the inverse of extraction, for round trips."""

    def escape(c):
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    body = F.array_join(F.transform(F.coalesce(paragraphs, F.array().cast("array<string>")), lambda p: F.concat(F.lit("<p>"), escape(p), F.lit("</p>"))), "\n")
    return F.concat(
        F.lit("<html><head><meta property='og:title' content='"),
        F.replace(escape(title), F.lit("'"), F.lit("&#39;")),
        F.lit("'><meta name='author' content='"),
        F.replace(escape(author), F.lit("'"), F.lit("&#39;")),
        F.lit("'><meta name='date' content='"),
        escape(published),
        F.lit("'></head><body><nav><a href='/'>Home</a></nav><main><article>"),
        body,
        F.lit("</article></main><footer>All rights reserved</footer></body></html>"),
    )
