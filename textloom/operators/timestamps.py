"""Mixed timestamp formats and time zones -> one UTC moment per record.

Every value is expanded into the array of its valid interpretations (field
order, epoch unit, meaning of a zone abbreviation).  One interpretation per value
is then chosen by Viterbi decoding over the record order of its source: emission
costs say how well an interpretation agrees with what is known of the source
(numeric date order, zone), transitions penalise a switch of format and a jump
back in time.  The rows of a source are range partitioned on (source, order), so
a source that holds a third of all rows is split over many tasks.  The best path is
that of the whole source wherever it is cut: a first pass gives, for the segments at the
edges of each range, the cost from each reading of the first record to each of the last; these
small tables are chained on the driver (two of them for each range), and a second pass
decodes each range between the readings that the chain has chosen.  Costs are whole numbers
with a part that tells ties apart, so the path is one and the same for any partitioning.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zlib import crc32
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut_lineage

# Month names of the supported languages, January first.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}
EXTRA_MONTHS = {"janner": 1, "setiembre": 9, "sept": 9, "mrt": 3, "maerz": 3}

# Zone abbreviations as (minutes east of UTC, places where it is usual); '' is anywhere.
ABBREVIATIONS = {
    "Z": [(0, "")],
    "UTC": [(0, "")],
    "UT": [(0, "")],
    "GMT": [(0, "")],
    "WET": [(0, "")],
    "WEST": [(60, "")],
    "BST": [(60, "Europe/"), (360, "Asia/Dhaka")],
    "IST": [(60, "Europe/Dublin"), (330, "Asia/Kolkata"), (120, "Asia/Jerusalem")],
    "CET": [(60, "")],
    "MEZ": [(60, "")],
    "CEST": [(120, "")],
    "MESZ": [(120, "")],
    "EET": [(120, "")],
    "EEST": [(180, "")],
    "MSK": [(180, "")],
    "EST": [(-300, "America/"), (600, "Australia/")],
    "EDT": [(-240, "America/"), (660, "Australia/")],
    "CST": [(-360, "America/"), (480, "Asia/"), (570, "Australia/")],
    "CDT": [(-300, "America/"), (630, "Australia/")],
    "MST": [(-420, "America/")],
    "MDT": [(-360, "America/")],
    "PST": [(-480, "America/"), (480, "Asia/Manila")],
    "PDT": [(-420, "America/")],
    "AST": [(-240, "America/"), (180, "Asia/")],
    "ADT": [(-180, "America/")],
    "BRT": [(-180, "")],
    "BRST": [(-120, "")],
    "ART": [(-180, "")],
    "AEST": [(600, "")],
    "AEDT": [(660, "")],
    "ACST": [(570, "")],
    "ACDT": [(630, "")],
    "AWST": [(480, "")],
    "NZST": [(720, "")],
    "NZDT": [(780, "")],
    "JST": [(540, "")],
    "KST": [(540, "")],
    "HKT": [(480, "")],
    "SGT": [(480, "")],
    "PKT": [(300, "")],
    "SAST": [(120, "")],
}

WRONG_ORDER = 100.0  # against the numeric order that is known of the source
WRONG_PLACE = 100.0  # an abbreviation in a sense that is not usual at the place
FORMAT_SWITCH = 1.0
BACKWARD_JUMP = 1.0
JUMP_SECONDS = 30 * 86_400  # a jump back by so much or more costs BACKWARD_JUMP, a shorter one its share
UNIT = 1 << 80  # costs are whole numbers of 1 / UNIT
TIE = 1 << 32  # what a later reading costs more than an earlier one, plus less than that by the record's hash
UNKNOWN_ZONE = "UTC"
MIN_YEAR, MAX_YEAR = 1900, 2100


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def _months() -> dict[str, int]:
    out: dict[str, int] = dict(EXTRA_MONTHS)
    for names in MONTH_NAMES.values():
        for number, name in enumerate(names.split(), 1):
            out[name] = number
    short: dict[str, set[int]] = {}
    for names in MONTH_NAMES.values():
        for number, name in enumerate(names.split(), 1):
            for n in (3, 4):
                short.setdefault(name[:n], set()).add(number)
    for key, numbers in short.items():
        if len(numbers) == 1:
            out.setdefault(key, next(iter(numbers)))
    return out


MONTHS = _months()
_NAME = "|".join(sorted(MONTHS, key=len, reverse=True))
_ZONE = r"(?P<zone>z|[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[a-z]{1,5}(?:[+-]\d{1,2}(?::?\d{2})?)?)?"
_REGION = r"(?:\s*\[(?P<region>[a-z_+\-]+(?:/[a-z_+\-0-9]+)*)\])?"
_TIME = r"(?P<h>\d{1,2})\s?[:.h]\s?(?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<half>[ap]\.?\s?m\.?))?(?:\s*(?:uhr|uur|h|hrs)\b)?\s*" + _ZONE + _REGION
_GAP = r"(?:\s*[,\-–|]\s*|\s+)(?:(?:at|um|om|a|as|alle|ore|las|a las|a les|kl|t)\.?\s+)?"
PATTERNS = [
    ("epoch", re.compile(r"(?P<epoch>\d{9,10}|\d{12,13}|\d{15,16})(?:\.\d+)?")),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:[t\s]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,]\d+)?)?\s*" + _ZONE)),
    ("iso", re.compile(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:(?:t|" + _GAP + ")" + _TIME + ")?")),
    ("numeric", re.compile(r"(?:[a-z]+\.?,?\s+)?(?P<n1>\d{1,2})(?P<sep>[/.\-])(?P<n2>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})(?:" + _GAP + _TIME + ")?")),
    ("day month", re.compile(r"(?:[a-z]+[.,:]?\s+){0,3}?(?P<d>\d{1,2})(?:\.|st|nd|rd|th|er|o)?[\s\-]*(?:de\s+|of\s+)?(?P<name>" + _NAME + r")\.?,?[\s\-]+(?:de\s+|del\s+)?(?P<y>\d{4})(?:" + _GAP + _TIME + ")?")),
    ("month day", re.compile(r"(?:[a-z]+[.,:]?\s+){0,3}?(?P<name>" + _NAME + r")\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?:" + _GAP + _TIME + ")?")),
]


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _offsets(text: str | None, region: str | None, place: str) -> list[tuple[int | None, str | None, float]]:
    """(minutes, zone name, cost) for what the value says of its zone; both None: local time."""
    if text:
        t = text.upper()
        if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?(?::?\d{2})?", t):
            minutes = int(m[2]) * 60 + int(m[3] or 0)
            return [(minutes if m[1] == "+" else -minutes, None, 0.0)] if minutes <= 18 * 60 else []
        if t in ABBREVIATIONS:
            senses = ABBREVIATIONS[t]
            usual = [x for x in senses if place.startswith(x[1])]
            best = max((len(x[1]) for x in usual), default=-1)
            return [(x[0], None, 0.0 if best < 0 or x in usual and len(x[1]) == best else WRONG_PLACE) for x in senses]
    if region and (z := next((z for z in {region, "/".join(x.title() for x in region.split("/"))} if _zone(z)), None)):
        return [(None, z, 0.0)]
    return [(None, None, 0.0)]


@lru_cache(maxsize=200_000)
def interpretations(value: str | None, date_order: str | None, place: str | None) -> tuple[tuple[str, datetime, int, float], ...]:
    """All valid readings of ``value`` as (format, local time, UTC seconds, cost), cheapest first.

    Null, empty and blank values, words that name no date, and impossible dates have none.
    """
    if value is None:
        return ()
    text = re.sub(r"\s+", " ", _fold(value)).strip()
    if not text or not any(c.isdigit() for c in text):
        return ()
    place = place or UNKNOWN_ZONE
    found: list[tuple[str, datetime, int, float]] = []
    for kind, pattern in PATTERNS:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        if kind == "epoch":
            digits = len(g["epoch"])
            unit, scale = ("s", 1) if digits <= 10 else ("ms", 10**3) if digits <= 13 else ("us", 10**6)
            seconds = int(g["epoch"]) // scale
            moment = datetime(1970, 1, 1) + timedelta(seconds=seconds)
            if moment.year <= MAX_YEAR:
                found.append((f"epoch {unit}", moment, seconds, 0.0))
            continue
        if kind == "numeric":
            a, b, y = int(g["n1"]), int(g["n2"]), int(g["y"])
            y += (2000 if y < 70 else 1900) if len(g["y"]) == 2 else 0
            known = date_order in ("dmy", "mdy")
            dates = [("dmy", y, b, a), ("mdy", y, a, b)]
            fields = [(f"{o}{g['sep']}{len(g['y'])}", yy, mm, dd, WRONG_ORDER if known and o != date_order else 0.0) for o, yy, mm, dd in dates]
            if a == b:
                fields = [f for f in fields if f[4] == 0.0][:1] or fields[:1]
        else:
            month = int(g["mo"]) if g.get("mo") else MONTHS[g["name"]]
            fields = [(kind, int(g["y"]), month, int(g["d"]), 0.0)]
        hour, minute, second = int(g.get("h") or 0), int(g.get("mi") or 0), min(int(g.get("s") or 0), 59)
        if int(g.get("s") or 0) > 60:
            continue
        if half := g.get("half"):
            if hour > 12:
                continue
            hour = hour % 12 + (12 if half[0] == "p" else 0)
        carry = timedelta(days=1) if hour == 24 and minute == 0 and second == 0 else timedelta()
        for fmt, y, mo, d, cost in fields:
            if not MIN_YEAR <= y <= MAX_YEAR:
                continue
            try:
                local = datetime(y, mo, d, hour % 24 if carry else hour, minute, second) + carry
            except ValueError:
                continue
            for minutes, zone, more in _offsets(g.get("zone"), g.get("region"), place):
                if minutes is not None:
                    utc = local - timedelta(minutes=minutes)
                else:  # fold 0: the first of a repeated hour; in a gap the offset before the change
                    utc = local.replace(tzinfo=_zone(zone or place) or timezone.utc).astimezone(timezone.utc).replace(tzinfo=None)
                found.append((fmt, local, int((utc - datetime(1970, 1, 1)).total_seconds()), cost + more))
        break
    # A known order (or place) that only gives impossible dates names no possible date.
    if any(x[3] < WRONG_ORDER for x in found):
        return tuple(sorted(found, key=lambda x: x[3]))
    return ()


def _own(key: object, readings: tuple) -> list[int]:
    """Costs of the readings themselves; no two paths over a source have the same sum of tie parts, but by chance."""
    return [int(r[3]) * UNIT + i * TIE + crc32(f"{i} {key}".encode()) for i, r in enumerate(readings)]


def _step(a: tuple, b: tuple) -> int:
    back = a[2] - b[2]
    jump = int(BACKWARD_JUMP * UNIT) * min(back, JUMP_SECONDS) // JUMP_SECONDS if back > 0 else 0
    return int(FORMAT_SWITCH * UNIT) * (a[0] != b[0]) + jump


def _best(costs: list[int]) -> int:
    return min(range(len(costs)), key=costs.__getitem__)


class SourceDecoder:
    """Viterbi over one source, or over a segment of one between given readings of its first and last record.

    Records wait until all paths agree on them (one that has a single reading settles all before it); at most one range of records waits.
    """

    def __init__(self, first: int | None = None) -> None:
        self.first = first
        self.costs: list[int] = []
        self.waiting: list[tuple[object, tuple, list[int]]] = []

    def push(self, key: object, readings: tuple) -> Iterator[tuple[object, tuple, int]]:
        if not readings:
            return
        own = _own(key, readings)
        if not self.waiting:
            self.costs = own if self.first is None else [c if i == self.first else c + (UNIT << 40) for i, c in enumerate(own)]
            self.waiting.append((key, readings, []))
            return
        last, costs, back = self.waiting[-1][1], [], []
        for r, c in zip(readings, own):
            steps = [d + _step(p, r) for d, p in zip(self.costs, last)]
            k = _best(steps)
            costs.append(steps[k] + c)
            back.append(k)
        if len(set(back)) == 1:
            yield from self._settled(back[0])
            back = []
        low = min(costs)
        self.costs = [c - low for c in costs]
        self.waiting.append((key, readings, back))

    def _settled(self, k: int) -> Iterator[tuple[object, tuple, int]]:
        out = []
        for key, readings, back in reversed(self.waiting):
            out.append((key, readings[k], len(readings)))
            k = back[k] if back else 0
        self.waiting = []
        yield from reversed(out)

    def finish(self, last: int | None = None) -> Iterator[tuple[object, tuple, int]]:
        if self.waiting:
            yield from self._settled(_best(self.costs) if last is None else last)


class Segment:
    """Costs from each reading of a segment's first record to each reading of its last."""

    def __init__(self, source: str) -> None:
        self.source, self.first, self.last, self.costs, self.own = source, (), (), [], []

    def push(self, key: object, readings: tuple) -> None:
        if not readings:
            return
        own = _own(key, readings)
        if not self.first:
            self.first, self.own = readings, own
            self.costs = [[0 if i == j else None for j in range(len(readings))] for i in range(len(readings))]
        else:
            steps = [[_step(p, r) for p in self.last] for r in readings]
            self.costs = [[min(d + t for d, t in zip(row, s) if d is not None) + c for s, c in zip(steps, own)] for row in self.costs]
        self.last = readings

    def row(self) -> tuple:
        return self.source, self.first, self.last, self.own, self.costs


def chained(parts: list[tuple[int, list[tuple]]]) -> dict[int, list[tuple[int, int] | None]]:
    """The readings (first, last) of the edge segments of each range: those of the best path over each source.

    ``parts`` has the segments (source, first, last, own, costs) of each range in order: one if it lies within
    a source, else its first and its last source.
    """
    chosen: dict[int, list[tuple[int, int] | None]] = {part: [None] * len(segments) for part, segments in parts}
    run: list[tuple] = []  # (part, place, entry of each last reading, previous reading of each first one)
    state: tuple | None = None  # source, last readings and their costs

    def close() -> None:
        if run:
            k = _best(state[2])
            for part, place, entries, before in reversed(run):
                i = entries[k]
                chosen[part][place] = (i, k)
                k = before[i] if before else 0
            run.clear()

    for part, segments in parts:
        for place, (source, first, last, own, costs) in enumerate(segments):
            if state and (place or state[0] != source):
                close()
                state = None
            if not first:
                continue
            before: list[int] = []
            entry = list(own)
            if state:
                for i, r in enumerate(first):
                    steps = [c + _step(tuple(p), tuple(r)) for c, p in zip(state[2], state[1])]
                    before.append(_best(steps))
                    entry[i] += steps[before[i]]
            totals, entries = [], []
            for j in range(len(last)):
                ways = [(entry[i] + costs[i][j], i) for i in range(len(first)) if costs[i][j] is not None]
                totals.append(min(ways)[0])
                entries.append(min(ways)[1])
            run.append((part, place, entries, before))
            state = (source, last, totals)
    close()
    return chosen


def _rows_in_order(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b["part"], b["source"], b["rec_id"], b["ord"], b["value"], b["date_order"], b["tz_name"], b["last_source"])


def _edges(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per range: its edge segments, pickled."""
    segments: list[Segment] = []
    current = None

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"part": [current], "segments": [pickle.dumps([x.row() for x in segments])]})

    for part, source, rec_id, order, value, date_order, place, last_source in _rows_in_order(batches):
        if part != current:
            if segments:
                yield frame()
            current, segments = part, [Segment(source)]
        if source != segments[-1].source:
            if source != last_source:
                continue  # a source within the range has no edge
            segments.append(Segment(source))
        segments[-1].push((rec_id, order, value), interpretations(value, date_order, place))
    if segments:
        yield frame()


def _decode(chosen: dict[int, list[tuple[int, int] | None]]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        at, decoder, pin = (), SourceDecoder(), None

        def take(decided: Iterable[tuple]) -> None:
            rows.extend((k[0], k[1], datetime_text(r[2]), r[0], n) for k, r, n in decided)

        for part, source, rec_id, order, value, date_order, place, last_source in _rows_in_order(batches):
            if (part, source) != at:
                take(decoder.finish(pin[1] if pin else None))
                edge = chosen[part]
                new_range = not at or at[0] != part
                pin = edge[0] if new_range else edge[1] if source == last_source else None
                at, decoder = (part, source), SourceDecoder(pin[0] if pin else None)
            readings = interpretations(value, date_order, place)
            take(decoder.push((rec_id, order, value), readings))
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=_DECIDED)
                rows.clear()
        take(decoder.finish(pin[1] if pin else None))
        yield pd.DataFrame(rows, columns=_DECIDED)

    return run


_DECIDED = ["rec_id", "ord", "utc", "format", "n_readings"]


def datetime_text(seconds: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def resolve_timestamps(df: DataFrame, *, rec_id: str, value: str, source: str, order: str, tz_name: str, date_order: str, partitions: int | None = None) -> DataFrame:
    """``rec_id, utc, format, n_readings``: one row for each record whose value names a possible moment.

    ``utc`` looks like ``2024-01-31T08:05:00Z`` (fractions cut off).  A zone or offset in the value
    holds; otherwise the value is local time at ``tz_name`` (UTC where that is null).  A null, blank
    or impossible value gives no row.  Repeated rows of a record count once: its earliest row in
    ``order`` that names a moment.  Extra columns are ignored; names may clash, as columns are
    chosen by the given names before anything else happens.  An empty table gives an empty result.
    ``partitions`` is the number of ranges (None: as Spark chooses); it doesn't change the result.
    """
    slim = df.select(
        F.col(rec_id).cast("string").alias("rec_id"),
        F.col(value).alias("value"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(order).cast("string"), F.lit("")).alias("ord"),
        F.col(tz_name).alias("tz_name"),
        F.col(date_order).alias("date_order"),
    ).filter(F.col("value").isNotNull() & F.col("rec_id").isNotNull())
    # One row per record and distinct value: repeats keep their first place in the order.
    slim = slim.groupBy("rec_id", "value", "source", "tz_name", "date_order").agg(F.min("ord").alias("ord"))
    keys = ("source", "ord", "rec_id", "value", "tz_name", "date_order")
    ranges = slim.repartitionByRange(partitions, *keys) if partitions else slim.repartitionByRange(*keys)
    placed = cut_lineage(ranges.withColumn("part", F.spark_partition_id()))  # which record is in which range never changes now
    last = placed.groupBy("part").agg(F.max("source").alias("last_source"))
    ordered = placed.join(F.broadcast(last), "part")  # one row per range
    ordered = ordered.repartition("part").sortWithinPartitions("part", *keys)
    edges = ordered.mapInPandas(_edges, "part int, segments binary").orderBy("part").collect()  # two segments per range at most
    chosen = chained([(r["part"], pickle.loads(r["segments"])) for r in edges])
    decided = ordered.mapInPandas(_decode(chosen), "rec_id string, ord string, utc string, format string, n_readings int")
    return decided.groupBy("rec_id").agg(F.min(F.struct("ord", "utc", "format", "n_readings")).alias("m")).select("rec_id", "m.utc", "m.format", "m.n_readings")


def publication_moments(articles: DataFrame, documents: DataFrame, outlets: DataFrame) -> DataFrame:
    """``tbl, rec_id, utc, format, n_readings`` for ``published_at`` of both tables."""
    site = F.regexp_replace(F.regexp_extract(F.lower("final_url"), r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")
    known = outlets.select("outlet", F.lower("host").alias("host"), "tz_name", "date_order")
    a = articles.select("document_id", "published_at", "retrieved_at_utc", site.alias("site")).join(known, F.col("site") == F.col("host"), "left")
    d = documents.select("doc_id", "published_at", "collected_at", "source").join(known, F.col("source") == F.col("outlet"), "left")
    d = d.withColumn("ord", F.unix_micros("collected_at"))
    d = d.withColumn("ord", F.lpad(F.col("ord").cast("string"), 20, "0"))
    parts = [
        resolve_timestamps(a, rec_id="document_id", value="published_at", source="site", order="retrieved_at_utc", tz_name="tz_name", date_order="date_order").withColumn("tbl", F.lit("articles")),
        resolve_timestamps(d, rec_id="doc_id", value="published_at", source="source", order="ord", tz_name="tz_name", date_order="date_order").withColumn("tbl", F.lit("documents")),
    ]
    return parts[0].unionByName(parts[1]).select("tbl", "rec_id", "utc", "format", "n_readings")
