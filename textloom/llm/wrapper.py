"""Main text of pages: union-free wrappers inferred from same-host token streams.

A page is a stream of lines, a line a stream of tokens.  A host's wrapper is a regular expression
without unions: constants and templates with text slots in the order of the page, each of them
plain, optional or repeated, with slots for running text and for short free lines in between.

1. Lines.  Lines of a host are aligned token by token.  Those that agree (case, digits and white
   space apart) are constants.  In the rest names and numbers are text slots at once, one further
   token may be opened as a slot, and a constant prefix before a colon or a path sign aligns lines
   whose rest is one slot; the alignment with the largest support holds.
2. Pages.  Each page is a stream of templates, running text and free lines.  Streams are folded into
   the wrapper one after another: what aligns stays, a template that only one side has becomes an
   optional element, a block that follows itself a repeated one, anything else falls into the slot
   between its neighbours (``Wrapper.fold``).  Parts of a host are folded by tasks and their wrappers
   folded into one another, so all pages of all hosts take part and no task sees more than
   ``PART`` pages.
3. Labels.  Each page is matched with its host's wrapper.  Elements outside of the wrapper's running
   text are the page's frame.  Elements within it are optional parts of either the page or its
   author: the page's, if they are frequent on the host or if their rate is uneven over hosts beyond
   chance, whereas subheadings, lists and quotations come up at like rates everywhere.  A host alone has
   only the first sign.

What a host's wrapper holds depends on that host's pages alone.  A template that a host is too
small to show is read as on all hosts together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.lines import join_spread, site_of, spaced
from textloom.runtime import cut_lineage

SHORT = 24  # words up to which a line can be aligned with slots
MIN_PAGES = 8  # occurrences that a constant or template needs
CONSTANT_SHARE = 0.005  # occurrences per page of a host that a constant needs
LONG_CONSTANT_SHARE = 0.02  # the same for a line longer than SHORT words
ELEMENT_SHARE = 0.001  # occurrences per page of a host that an element of its wrapper needs; bounds the wrapper
INSIDE = 0.5  # share of occurrences inside the running text below which an element is part of the frame
CONCENTRATED = 0.35  # squared variation of its rate over hosts that marks a host's own line
UNEVEN = 0.03  # the same where it is far beyond chance
BEYOND, FAR_BEYOND = 1.8, 4.7  # standard deviations of chance that the two need
SURE = 3  # occurrences per host that has it from which a template decides before a closer one
FREQUENT = 0.15  # share of a host's pages that no author's line reaches
PART = 1_000  # pages that are folded by one task at a time
FAN_IN = 32  # wrappers that are folded into one by one task at a time
BLOCK = 3  # longest block that is recognised as repeated
SENTENCE = r"[.!?…][\"”’»')\]]*$"
FLAGS = ("supported", "frame", "own", "concentrated", "frequent", "exact")
TEXT, FREE = 1, 2  # stream signs of running text and of a short line without a template


# ---- wrappers


@dataclass
class Element:
    """A template at its place in the wrapper; ``zones`` counts its lines before, inside and after the running text of their pages."""

    symbol: int
    pages: int = 0
    repeats: int = 0
    zones: list[int] = field(default_factory=lambda: [0, 0, 0])


@dataclass
class Slot:
    """What lies before an element (or, the last one, after all of them): pages with running text and with free lines there."""

    text: int = 0
    free: int = 0


def collapsed(stream: list[int]) -> list[tuple[int, bool, list[int]]]:
    """(sign, repeated, places) of a stream in which a block of up to ``BLOCK`` signs that follows itself is one block."""
    signs: list[int] = []
    repeated: list[bool] = []
    places: list[list[int]] = []
    for at, sign in enumerate(stream):
        signs.append(sign)
        repeated.append(False)
        places.append([at])
        n = 1
        while n <= BLOCK and 2 * n <= len(signs):
            if signs[-1] == signs[-1 - n] and signs[-n:] == signs[-2 * n : -n]:
                for i in range(-n, 0):
                    repeated[i - n] = True
                    places[i - n] = places[i - n] + places[i]
                del signs[-n:], repeated[-n:], places[-n:]
                n = 1
            else:
                n += 1
    return list(zip(signs, repeated, places))


class Wrapper:
    """Union-free regular expression of a host's pages; ``slots[i]`` lies before ``elements[i]``."""

    def __init__(self) -> None:
        self.pages = 0
        self.elements: list[Element] = []
        self.slots: list[Slot] = [Slot()]
        self._at: dict[int, list[int]] | None = None

    def align(self, symbols: list[int]) -> list[int]:
        """The place in the wrapper of each symbol, -1 for a mismatch: a longest run of matches in order."""
        if self._at is None:
            self._at = {}
            for i, e in enumerate(self.elements):
                self._at.setdefault(e.symbol, []).append(i)
        tails: list[int] = []
        ends: list[tuple] = []
        for j, s in enumerate(symbols):
            for p in reversed(self._at.get(s, ())):
                k = bisect_left(tails, p)
                node = (j, p, ends[k - 1] if k else None)
                if k == len(tails):
                    tails.append(p)
                    ends.append(node)
                else:
                    tails[k], ends[k] = p, node
        found = [-1] * len(symbols)
        node = ends[-1] if ends else None
        while node:
            found[node[0]] = node[1]
            node = node[2]
        return found

    def fold(self, other: Wrapper) -> None:
        """Takes another wrapper (a page is one) in: mismatches become optional elements, the rest slots."""
        at, new = 0, []
        for e, place, slot in zip(other.elements, self.align([e.symbol for e in other.elements]), other.slots):
            if place < 0:  # it goes before what this side still has up to the next match
                new.append((at, Element(e.symbol, e.pages, e.repeats, list(e.zones)), Slot(slot.text, slot.free)))
                continue
            mine, old = self.slots[at], self.elements[place]
            mine.text, mine.free = mine.text + slot.text, mine.free + slot.free
            old.pages, old.repeats = old.pages + e.pages, old.repeats + e.repeats
            old.zones = [x + y for x, y in zip(old.zones, e.zones)]
            at = place + 1
        mine, last = self.slots[at], other.slots[-1]
        mine.text, mine.free = mine.text + last.text, mine.free + last.free
        for i, e, slot in reversed(new):
            self.elements.insert(i, e)
            self.slots.insert(i, slot)
        if new:
            self._at = None
        self.pages += other.pages

    @classmethod
    def of_page(cls, stream: list[int], zones: list[int]) -> Wrapper:
        w = cls()
        w.pages = 1
        for sign, repeated, places in collapsed(stream):
            if sign == TEXT:
                w.slots[-1].text = 1
            elif sign == FREE:
                w.slots[-1].free = 1
            else:
                e = Element(sign, 1, int(repeated))
                for at in places:
                    e.zones[zones[at] + 1] += 1
                w.elements.append(e)
                w.slots.append(Slot())
        return w

    def zones(self) -> dict[int, list[int]]:
        """Lines of each template before, inside and after the running text, at all its places."""
        out: dict[int, list[int]] = {}
        for e in self.elements:
            have = out.setdefault(e.symbol, [0, 0, 0])
            for i in range(3):
                have[i] += e.zones[i]
        return out

    def expression(self, name=hex) -> str:
        """The regular expression, with ``TEXT`` and ``LINE`` for the slots."""
        parts: list[str] = []
        for i, slot in enumerate(self.slots):
            parts += ["TEXT+" if slot.text == self.pages else "(TEXT+)?"] * bool(slot.text) + ["(LINE+)?"] * bool(slot.free)
            if i < len(self.elements):
                e = self.elements[i]
                parts.append(f"({name(e.symbol)})" + ("*" if e.repeats and e.pages < self.pages else "+" if e.repeats else "?" if e.pages < self.pages else ""))
        return " ".join(parts)


ELEMENTS = "site string, part int, pages bigint, at int, symbol bigint, on bigint, repeats bigint, before bigint, inside bigint, after bigint, text_slot bigint, free_slot bigint"
_ELEMENT_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
_ELEMENT_SCHEMA = pa.schema([(c.split()[0], _ELEMENT_TYPES[c.split()[1]]) for c in ELEMENTS.split(", ")])


def _to_rows(site: str, part: int, w: Wrapper) -> list[tuple]:
    rows = [(site, part, w.pages, i, e.symbol, e.pages, e.repeats, *e.zones, s.text, s.free) for i, (e, s) in enumerate(zip(w.elements, w.slots))]
    return [*rows, (site, part, w.pages, len(rows), None, 0, 0, 0, 0, 0, w.slots[-1].text, w.slots[-1].free)]


def _from_rows(rows: Iterable[dict]) -> Wrapper:
    w = Wrapper()
    w.slots = []
    for r in sorted(rows, key=lambda r: r["at"]):
        w.pages = r["pages"]
        if r["symbol"] is not None:
            w.elements.append(Element(r["symbol"], r["on"], r["repeats"], [r["before"], r["inside"], r["after"]]))
        w.slots.append(Slot(r["text_slot"], r["free_slot"]))
    return w if w.slots else Wrapper()


def _rows_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(_ELEMENT_SCHEMA)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ELEMENT_SCHEMA)], schema=_ELEMENT_SCHEMA)


def _pages_of(table: pa.Table) -> Iterator[tuple[str, tuple[list, ...]]]:
    """The pages of a group: the id, and the other columns with the lines in order."""
    table = table.take(pc.sort_indices(table, [("document_id", "ascending"), ("no", "ascending")]))
    ids = table.column("document_id").to_pylist()
    columns = [table.column(c).to_pylist() for c in table.column_names if c not in ("document_id", "site", "part")]
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield ids[start], tuple(c[start:i] for c in columns)
            start = i


def _fold_pages(key: tuple, table: pa.Table) -> pa.Table:
    w = Wrapper()
    for _, (_, signs, zones) in _pages_of(table.select(["document_id", "no", "sign", "zone"])):
        w.fold(Wrapper.of_page(signs, zones))
    return _rows_table(_to_rows(key[0].as_py(), key[1].as_py(), w))


def _fold_wrappers(key: tuple, table: pa.Table) -> pa.Table:
    parts: dict[int, list[dict]] = {}
    for r in table.to_pylist():
        parts.setdefault(r["part"], []).append(r)
    w = Wrapper()
    for part in sorted(parts):
        w.fold(_from_rows(parts[part]))
    return _rows_table(_to_rows(key[0].as_py(), key[1].as_py(), w))


LABELS = "document_id string, furniture array<int>, kept array<int>"
_LABELS_SCHEMA = pa.schema([("document_id", pa.string()), ("furniture", pa.list_(pa.int32())), ("kept", pa.list_(pa.int32()))])


def _label_pages(key: tuple, pages: pa.Table, elements: pa.Table) -> pa.Table:
    """Matches pages, without their running text, with the wrapper of their host; the numbers of their lines by label."""
    wrapper = _from_rows(elements.to_pylist())
    zones = {s: z[1] / sum(z) for s, z in wrapper.zones().items()}
    _, is_frame, is_own, is_concentrated, is_frequent, is_exact = (1 << i for i in range(len(FLAGS)))
    ids, gone, left = [], [], []
    for record, (nos, signs, page_zones, sizes, ends, flags) in _pages_of(pages.select(["document_id", "no", "sign", "zone", "n", "ends", "flags"])):
        tokens = [(s, places) for s, _, places in collapsed(signs) if s != FREE]
        matched = {at for (_, places), p in zip(tokens, wrapper.align([s for s, _ in tokens])) if p >= 0 for at in places}
        frame_from, furniture, kept = None, [], []
        for at, no in enumerate(nos):
            zone, f = page_zones[at], flags[at]
            if f is not None:
                # What the host has too little of is read as on all hosts.
                frame = zones[signs[at]] < INSIDE if at in matched else f & is_frame
                label = frame or f & is_own or f & is_frequent
                if label and not frame and not f & is_exact and ends[at] and sizes[at] >= 8 and not f & is_concentrated:
                    label = False  # a sentence with slots needs the plainer sign: its author's style may differ by host
                if frame and zone == 1 and frame_from is None:
                    frame_from = no
            elif zone == 0:  # slots: free lines by their place
                label = False
            elif zone == 1:
                label = frame_from is not None and no > frame_from
            else:
                label = not (ends[at] and sizes[at] >= 6)
            (furniture if label else kept).append(no)
        ids.append(record)
        gone.append(furniture)
        left.append(kept)
    return pa.table([pa.array(c, f.type) for c, f in zip((ids, gone, left), _LABELS_SCHEMA)], schema=_LABELS_SCHEMA)


# ---- lines and their alignments


def page_lines(articles: DataFrame, *, record: str, url: str, body: str) -> DataFrame:
    """``document_id, site, no, n, k, ends, first, t``: non-blank lines once per document, digits as 0; ``t`` is null for long lines.

    Of rows with the same record the one with the least (hash of the body, site) counts, as in ``main_text``.
    """

    def shape(x, i):
        n = F.length(x["t"]) - F.length(F.replace(x["t"], F.lit(" "), F.lit(""))) + 1
        ends = F.substring(x["t"], -6, 6).rlike(SENTENCE)
        return F.struct(x["no"].alias("no"), n.alias("n"), F.xxhash64(F.lower(x["t"])).alias("k"), ends.alias("ends"), (i == 0).alias("first"), F.when(n <= SHORT, x["t"]).alias("t"))

    even = F.regexp_replace(F.regexp_replace(body, r"(?U)[\s&&[^\n]]+", " "), r"(?U)\d+", "0")
    numbered = F.transform(F.split(even, "\n", -1), lambda raw, i: F.struct((i + 1).alias("no"), F.trim(raw).alias("t")))
    slim = articles.filter(F.col(record).isNotNull() & F.col(body).isNotNull()).select(
        F.col(record).cast("string").alias("document_id"),
        site_of(F.col(url)).alias("site"),
        F.xxhash64(body).alias("h"),
        F.filter(numbered, lambda x: x["t"] != "").alias("lines"),
    )
    shaped = slim.select("document_id", "h", "site", F.transform("lines", shape).alias("lines"))
    once = shaped.groupBy("document_id").agg(F.min(F.struct("h", "site", "lines")).alias("x"))
    return once.select("document_id", "x.site", F.explode("x.lines").alias("l")).select("document_id", "site", "l.*")


def _tokens(t):
    """Tokens of a short line with digits as 0: X for names, else lower case; a line in capitals has no names."""
    even = F.when(t.rlike(r"\p{Ll}"), t).otherwise(F.lower(t))
    return F.transform(F.split(even, " "), lambda w, i: F.when((i > 0) & w.rlike(r"^[^\p{L}0-9]*\p{Lu}"), F.lit("X")).otherwise(F.lower(w)))


def with_candidates(shapes: DataFrame) -> DataFrame:
    """``shapes(k, t, ...)`` with ``candidates``, the templates of a line as ``array<struct<level, tid>>`` from exact to loose.

    The steps are columns of their own, so that none of them is computed for each of its uses.
    """
    none = F.array().cast("array<struct<level:int,tid:bigint>>")
    joined = F.regexp_replace(F.array_join(_tokens(F.col("t")), " "), r"X(?: X)+", "X")
    out = shapes.withColumn("_1", joined)
    # The same with the first word as a name.
    rest = F.when(F.instr("_1", " ") > 0, F.expr("substring(_1, instr(_1, ' '))")).otherwise(F.lit(""))
    named = F.when(F.col("t").rlike(r"^[^\p{L}0-9]*\p{Lu}"), F.regexp_replace(F.concat(F.lit("X"), rest), "^X X(?= |$)", "X"))
    out = out.withColumn("_3", named)
    for c in ("_1", "_3"):
        # A hash per token that depends on its place; a template is the hashes of its tokens in one.
        out = out.withColumn(c, F.transform(F.split(c, " "), lambda w, i: F.struct(w.alias("w"), F.xxhash64(w, i).alias("h"), F.xxhash64(F.lit("_"), i).alias("s"))))
        out = out.withColumn(f"{c}w", F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x["h"])))
        out = out.withColumn(f"{c}n", F.size(F.filter(c, lambda x: (x["w"] != "X") & x["w"].rlike(r"\p{L}"))))

    def candidates(c: str, level: int):
        opened = F.transform(F.filter(c, lambda x: (x["w"] != "X") & x["w"].rlike(r"^\p{Ll}")), lambda x: F.struct(F.lit(level + 1).alias("level"), F.col(f"{c}w").bitwiseXOR(x["h"]).bitwiseXOR(x["s"]).alias("tid")))
        whole = F.array(F.struct(F.lit(level).alias("level"), F.col(f"{c}w").alias("tid")))
        return F.when(F.col(f"{c}w").isNull(), none).when(F.col(f"{c}n") >= 3, F.concat(whole, opened)).otherwise(whole)

    prefix = F.regexp_extract(F.lower("t"), r"^([^>/»|:]{1,30}?)\s*(?:[>/»|]|::?)", 1)
    loose = F.when(prefix != "", F.array(F.struct(F.lit(5).alias("level"), F.xxhash64(prefix, F.lit("…")).alias("tid")))).otherwise(none)
    exact = F.array(F.struct(F.lit(0).alias("level"), F.col("k").alias("tid")))
    every = F.when(F.col("t").isNull(), exact).otherwise(F.concat(exact, candidates("_1", 1), candidates("_3", 3), loose))
    return out.select(*[x for x in shapes.columns if x != "t"], every.alias("candidates"))


def placed_lines(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> tuple[DataFrame, DataFrame, int]:
    """(lines, sites, number of lines): every non-blank line with what it is (``constant``, running ``text``) and its
    zone (-1 before, 0 inside, 1 after the running text), and the pages of each site."""
    lines = cut_lineage(page_lines(articles, record=record, url=url, body=body))
    sites = cut_lineage(lines.groupBy("site").agg(F.sum(F.col("first").cast("long")).alias("pages"), F.count("*").alias("lines")))
    total = sites.agg(F.sum("lines")).first()[0] or 0
    lines = lines.withColumn("sk", F.xxhash64("site", "k"))  # keys of one number sort and compare fast
    counts = lines.groupBy("sk", "site").agg(F.count("*").alias("o"), F.max("n").alias("n")).filter(F.col("o") >= MIN_PAGES)
    counts = join_spread(counts, sites, ["site"], weight="lines", total=total, value="s").select("sk", "o", "n", "s.pages")
    share = F.when(F.col("n") > SHORT, LONG_CONSTANT_SHARE).otherwise(CONSTANT_SHARE)
    constants = counts.filter(F.col("o") >= share * F.col("pages")).select("sk", "o")
    joined = join_spread(lines, constants, ["sk"], weight="o", total=total, value="c")
    joined = joined.withColumn("constant", F.col("c").isNotNull()).drop("c")
    joined = joined.withColumn("text", ~F.col("constant") & ((F.col("n") >= 20) | (F.col("ends") & (F.col("n") >= 12))))
    page = Window.partitionBy("document_id")
    joined = joined.withColumn("from", F.min(F.when(F.col("text"), F.col("no"))).over(page)).withColumn("to", F.max(F.when(F.col("text"), F.col("no"))).over(page))
    # What follows the text before any constant may still be the author's (an update, a last list).
    after = F.min(F.when(F.col("constant") & (F.col("no") > F.col("to")), F.col("no"))).over(page)
    zone = F.when(F.col("no") < F.col("from"), -1).when((F.col("no") > F.col("to")) & (F.col("constant") | (F.col("no") >= after)), 1).otherwise(0)
    t = F.when(~F.col("constant") & ~F.col("text"), F.col("t")).alias("t")
    # A line's shape is what its templates depend on.
    shape = F.xxhash64("site", "k", t)
    return cut_lineage(joined.select("document_id", "site", "no", "n", "k", "ends", "text", zone.alias("zone"), shape.alias("shape"), t)), sites, total


def line_templates(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """``shape, occurrences, symbol, flags`` of each line shape of a host that aligns with a template.

    ``flags`` has the bits of ``FLAGS``: ``supported`` where the host itself has enough of the template; the others, apart from
    ``exact``, are as on all hosts.
    """
    size = sites.agg(F.sum("pages").alias("pages"), F.sum("lines").alias("lines"), F.count("*").alias("sites")).first()
    pages, n_sites = float(size["pages"] or 0), size["sites"] or 0
    shapes = lines.filter("not text").groupBy("shape", "site", "k", "t").agg(F.count("*").alias("occurrences"), F.sum((F.col("zone") == 0).cast("long")).alias("i"))
    shapes = cut_lineage(with_candidates(shapes))
    seen = shapes.select("shape", "site", "occurrences", "i", F.posexplode("candidates").alias("at", "c")).select("shape", "site", "occurrences", "i", "at", "c.level", "c.tid")
    seen = seen.select("*", F.xxhash64("level", "tid").alias("template")).withColumn("local", F.xxhash64("site", "template"))
    by_site = seen.groupBy("local", "template", "level", "site").agg(F.sum("occurrences").alias("o"), F.sum("i").alias("i"))
    by_site = join_spread(by_site, sites, ["site"], weight="lines", total=int(size["lines"] or 0), value="s").select("local", "template", "level", "o", "i", "s.pages")
    o, p = F.col("o").cast("double"), F.col("pages").cast("double")
    stats = by_site.groupBy("template").agg(F.sum("o").alias("total"), F.sum("i").alias("i"), F.sum(o * o / p).alias("q"), F.max(o / p).alias("share"), F.count("*").alias("hosts"))
    stats = stats.filter(F.col("total") >= MIN_PAGES)
    total = F.col("total").cast("double")
    variation = F.lit(pages) * F.col("q") / (total * total) - 1 - F.lit(float(max(n_sites - 1, 0))) / total
    chance = F.lit((2.0 * max(n_sites - 1, 0)) ** 0.5) / total  # standard deviation of the variation of an evenly spread line
    own = F.lit(n_sites > 1) & ((variation >= F.greatest(F.lit(CONCENTRATED), BEYOND * chance)) | (variation >= F.greatest(F.lit(UNEVEN), FAR_BEYOND * chance)))
    stats = stats.select("template", "total", (F.col("i") / total < INSIDE).alias("frame"), own.alias("own"), (variation >= CONCENTRATED).alias("concentrated"), F.col("share").alias("top_share"), (F.col("total") >= SURE * F.col("hosts")).alias("sure"))
    local = by_site.select("local", "template", "level", "o", "pages").join(stats, "template")
    supported = (F.col("o") >= MIN_PAGES) & (F.col("o") >= ELEMENT_SHARE * F.col("pages"))
    frequent = (F.col("level") == 0) & (F.when(supported, F.col("o") / F.col("pages")).otherwise(F.col("top_share")) >= FREQUENT)
    bits = {"supported": supported, "frame": F.col("frame"), "own": F.col("own"), "concentrated": F.col("concentrated"), "frequent": frequent, "exact": F.col("level") == 0}
    flags = sum(F.when(bits[name], F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(FLAGS))
    local = local.select("local", flags.alias("flags"), "sure", F.least("total", F.lit((1 << 40) - 1)).alias("total"))
    hit = seen.select("shape", "occurrences", "at", "template", "local").join(local, "local")
    # The best template of a shape: a sure one, then the one with the most lines, then the closest; all in one number with the flags.
    rank = F.when(F.col("sure"), F.lit(0)).otherwise(F.lit(1)).cast("bigint") * F.lit(1 << 60) + (F.lit((1 << 40) - 1) - F.col("total")) * F.lit(1 << 20) + F.col("at") * F.lit(1 << 8) + F.col("flags")
    best = hit.withColumn("rank", rank).groupBy("shape").agg(F.max("occurrences").alias("occurrences"), F.min("rank").alias("rank"), F.min_by("template", "rank").alias("template"))
    # A template is one sign of the streams; the small numbers are the other signs.
    symbol = F.col("template").bitwiseAND(F.lit(~3)).bitwiseOR(F.lit(4))
    return cut_lineage(best.select("shape", "occurrences", symbol.alias("symbol"), F.pmod("rank", F.lit(1 << 8)).cast("int").alias("flags")))


def _wrapped(articles: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines with their templates and part, wrapper elements, sites)."""
    lines, sites, total = placed_lines(articles, **columns)
    templates = line_templates(lines, sites)
    marked = join_spread(lines.drop("t", "k"), templates, ["shape"], weight="occurrences", total=total, value="v")
    known = ~F.col("text") & F.col("v.flags").isNotNull()
    sign = F.when(F.col("text"), TEXT).when(known & (F.col("v.flags").bitwiseAND(1) > 0), F.col("v.symbol")).otherwise(FREE).cast("bigint")
    slim = marked.select("document_id", "site", "no", "n", "ends", "text", "zone", sign.alias("sign"), F.when(known, F.col("v.flags")).alias("flags"))
    parts = F.ceil(F.col("pages") / PART).cast("int")
    marked = join_spread(slim, sites.select("site", "lines", parts.alias("parts")), ["site"], weight="lines", total=total, value="s")
    marked = cut_lineage(marked.withColumn("part", F.pmod(F.xxhash64("document_id"), F.col("s.parts")).cast("int")).drop("s"))
    wrappers = cut_lineage(marked.select("document_id", "site", "part", "no", "sign", "zone").groupBy("site", "part").applyInArrow(_fold_pages, ELEMENTS))
    left = sites.agg(F.max(parts)).first()[0] or 0
    while left > 1:
        wrappers = cut_lineage(wrappers.withColumn("to", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("site", "to").applyInArrow(_fold_wrappers, ELEMENTS))
        left = -(-left // FAN_IN)
    return marked, wrappers, sites


def page_labels(articles: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(``document_id, furniture, kept``: the numbers of each page's lines by label, running text apart; all lines with ``text``)."""
    marked, wrappers, sites = _wrapped(articles, **columns)
    parts = sites.select(F.col("site").alias("s"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / PART).cast("int") - 1)).alias("p"))
    everywhere = parts.join(wrappers, F.col("s") == F.col("site")).withColumn("part", F.col("p")).drop("s", "p")
    lines = marked.filter("not text").drop("text").groupBy("site", "part").cogroup(everywhere.groupBy("site", "part"))
    return lines.applyInArrow(_label_pages, LABELS), marked


def furniture_lines(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> DataFrame:
    """``document_id, line_no`` of the furniture: the lines that ``label_lines`` marks."""
    pages, _ = page_labels(articles, record=record, url=url, body=body)
    return pages.select("document_id", F.explode("furniture").alias("line_no"))


def label_lines(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> DataFrame:
    """``document_id, line_no, furniture``: each non-blank line of each body.

    A null record or body gives no rows; repeated rows of a record count once.  A line that aligns with no
    template is running text inside the text, and after it until the page's frame begins; before it, only if it is a sentence.
    """
    pages, lines = page_labels(articles, record=record, url=url, body=body)
    pages = cut_lineage(pages)
    of = [pages.select("document_id", F.explode(c).alias("line_no"), F.lit(c == "furniture").alias("furniture")) for c in ("furniture", "kept")]
    return of[0].unionByName(of[1]).unionByName(lines.filter("text").select("document_id", F.col("no").alias("line_no"), F.lit(False).alias("furniture")))


def host_wrappers(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> DataFrame:
    """``site, pages, at, symbol, n_pages, is_optional, is_repeated, inside, has_text, has_free_lines``: the elements of each
    host's wrapper in order; the last row of a host (``symbol`` null) is the slot behind all elements."""
    _, w, _ = _wrapped(articles, record=record, url=url, body=body)
    share = F.when(F.col("symbol").isNotNull(), F.col("inside") / (F.col("before") + F.col("inside") + F.col("after")))
    optional = F.when(F.col("symbol").isNotNull(), F.col("on") < F.col("pages"))
    return w.select("site", "pages", "at", "symbol", F.col("on").alias("n_pages"), optional.alias("is_optional"), (F.col("repeats") > 0).alias("is_repeated"), share.alias("inside"), (F.col("text_slot") > 0).alias("has_text"), (F.col("free_slot") > 0).alias("has_free_lines"))


def main_text(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> DataFrame:
    """``document_id, site, text``: the main text of each document once, its lines joined by ``\\n``.

    A document of furniture alone has an empty text; a null body gives no row.
    """
    pages, _ = page_labels(articles, record=record, url=url, body=body)
    gone = pages.select("document_id", F.col("furniture").alias("gone"))
    slim = articles.filter(F.col(record).isNotNull() & F.col(body).isNotNull()).select(F.col(record).cast("string").alias("document_id"), F.xxhash64(body).alias("h"), site_of(F.col(url)).alias("site"), F.col(body).alias("body"))
    once = slim.groupBy("document_id").agg(F.min(F.struct("h", "site", "body")).alias("x")).select("document_id", "x.site", "x.body")
    joined = once.join(gone, "document_id", "left")
    numbered = F.transform(F.split("body", "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), F.rtrim(x).alias("line")))
    none = F.array().cast("array<int>")
    kept = F.filter(numbered, lambda x: (x["line"] != "") & ~F.array_contains(F.coalesce("gone", none), x["no"]))
    return joined.select("document_id", "site", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))
