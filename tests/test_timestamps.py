import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import timestamps as T

LONDON, DUBLIN, KOLKATA, NEW_YORK, PARIS = "Europe/London", "Europe/Dublin", "Asia/Kolkata", "America/New_York", "Europe/Paris"


def utc(value, order="dmy", place=LONDON):
    found = T.interpretations(value, order, place)
    return T.datetime_text(found[0][2]) if found else None


@pytest.mark.parametrize(
    "value, order, place, want",
    [
        ("2024-01-31T08:05:00Z", "dmy", LONDON, "2024-01-31T08:05:00Z"),
        ("2024-01-31T08:05:00.987654z", "dmy", LONDON, "2024-01-31T08:05:00Z"),
        ("2020-05-31 22:41:55+05:45", "dmy", LONDON, "2020-05-31T16:56:55Z"),
        ("2021-11-25T22:30:07-08", "dmy", LONDON, "2021-11-26T06:30:07Z"),
        ("2026-05-23 13:13:53 -03:00", "dmy", LONDON, "2026-05-23T16:13:53Z"),
        ("2020-04-30T20:06:19+01:00[Europe/London]", "dmy", LONDON, "2020-04-30T19:06:19Z"),
        ("20260126T043452Z", "dmy", LONDON, "2026-01-26T04:34:52Z"),
        ("20230625091510", "dmy", LONDON, "2023-06-25T08:15:10Z"),
        ("1647984530", "dmy", LONDON, "2022-03-22T21:28:50Z"),
        ("1748169416023", "dmy", LONDON, "2025-05-25T10:36:56Z"),
        ("07/10/2023 23:39", "dmy", LONDON, "2023-10-07T22:39:00Z"),
        ("07/10/2023 23:39", "mdy", NEW_YORK, "2023-07-11T03:39:00Z"),
        ("11/01/25 20:57", "dmy", LONDON, "2025-01-11T20:57:00Z"),
        ("12/26/2023 1:11 PM", "mdy", NEW_YORK, "2023-12-26T18:11:00Z"),
        ("2023-12-23T21:15:16 IST", "dmy", KOLKATA, "2023-12-23T15:45:16Z"),
        ("2021-07-02 21:15 IST", "dmy", DUBLIN, "2021-07-02T20:15:00Z"),
        ("2024-08-21T00:15:15 EDT", "mdy", NEW_YORK, "2024-08-21T04:15:15Z"),
        ("Tue, 01 Apr 2025 20:43:50 +0100", "dmy", LONDON, "2025-04-01T19:43:50Z"),
        ("Saturday, 21 October 2023, 02:14", "dmy", LONDON, "2023-10-21T01:14:00Z"),
        ("Posted July 23, 2022 at 6:56 am", "dmy", LONDON, "2022-07-23T05:56:00Z"),
        ("  29 January 2020 - 8.58am ", "dmy", LONDON, "2020-01-29T08:58:00Z"),
        ("December 28, 2024 12:16 AM", "dmy", LONDON, "2024-12-28T00:16:00Z"),
        ("29 avril 2020 à 7h53", "dmy", PARIS, "2020-04-29T05:53:00Z"),
        ("13. April 2023, 07:58 Uhr", "dmy", "Europe/Berlin", "2023-04-13T05:58:00Z"),
        ("5 de octubre de 2024, 00:05", "dmy", "Europe/Madrid", "2024-10-04T22:05:00Z"),
        ("23\xa0december 2020, 20.29", "dmy", "Europe/Amsterdam", "2020-12-23T19:29:00Z"),
        ("01-Oct-2021 06:36:57", "dmy", LONDON, "2021-10-01T05:36:57Z"),
        ("May 22, 2020", "dmy", LONDON, "2020-05-21T23:00:00Z"),
        # a repeated hour means the first, a skipped one is read with the offset before the change
        ("2023-10-29 01:30:00", "dmy", LONDON, "2023-10-29T00:30:00Z"),
        ("2023-03-26 01:30:00", "dmy", LONDON, "2023-03-26T01:30:00Z"),
        # no date, or no possible one
        (None, "dmy", LONDON, None),
        ("", "dmy", LONDON, None),
        (" ", "dmy", LONDON, None),
        ("TBC", "dmy", LONDON, None),
        ("00:00", "dmy", LONDON, None),
        ("0000-00-00", "dmy", LONDON, None),
        ("2022-02-30T10:00:00Z", "dmy", LONDON, None),
        ("31/02/2023 10:00", "mdy", NEW_YORK, None),
        ("13/25/2023", "dmy", LONDON, None),
    ],
)
def test_values(value, order, place, want):
    assert utc(value, order, place) == want


def test_unknown_order_is_decided_by_the_neighbours():
    decoder = T.SourceDecoder()
    values = ["13/02/2023", "03/04/2023", "25/04/2023"]
    out = []
    for i, v in enumerate(values):
        out += list(decoder.push(i, T.interpretations(v, None, "UTC")))
    out += list(decoder.finish())
    assert [r[1].strftime("%d.%m") for _, r, _ in out] == ["13.02", "03.04", "25.04"]
    assert [n for _, _, n in out] == [1, 2, 1]


def test_best_path_is_that_of_all_paths():
    rng = random.Random(6)
    for _ in range(60):
        values = [f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 29):02d}/2024" for _ in range(rng.randrange(1, 9))]
        records = [((str(i), "", v), r) for i, v in enumerate(values) if (r := T.interpretations(v, None, "UTC"))]
        decoder = T.SourceDecoder()
        got = [d for k, r in records for d in decoder.push(k, r)] + list(decoder.finish())

        def cost(path):
            own = sum(T._own(k, r)[i] for (k, r), i in zip(records, path))
            chosen = [r[i] for (_, r), i in zip(records, path)]
            return own + sum(map(T._step, chosen, chosen[1:]))

        best = min(itertools.product(*[range(len(r)) for _, r in records]), key=cost)
        assert [r for _, r, _ in got] == [r[i] for (_, r), i in zip(records, best)]


@pytest.mark.parametrize("seed", range(3))
def test_one_decoding_whatever_the_partitioning(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"{rng.randrange(1, 13):02d}/{rng.randrange(1, 13):02d}/2024"
    rows = [("long", i, "03/25/2024" if i == 0 else "03/02/2024") for i in range(3000)]
    rows += [("mixed", i, day() if rng.random() < 0.97 else rng.choice(["13/01/2024", "01/13/2024", "none", "2024-02-02"])) for i in range(1500)]
    rows += [(f"s{k}", i, day()) for k in range(40) for i in range(rng.randrange(1, 9))]
    df = spark.createDataFrame([(f"{s}{i}", v, s, f"{i:06d}") for s, i, v in rows], "id string, v string, s string, at string")
    df = df.withColumn("tz", F.lit("UTC")).withColumn("o", F.lit(None).cast("string"))
    names = dict(rec_id="id", value="v", source="s", order="at", tz_name="tz", date_order="o")
    one, some, many = ({(r.rec_id, r.utc) for r in T.resolve_timestamps(df, **names, partitions=n).collect()} for n in (1, 8, 64))
    assert one == some == many and ("long2999", "2024-03-02T00:00:00Z") in one and len([x for x in one if x[0].startswith("long")]) == 3000


def test_operator_handles_nulls_repeats_and_empty_tables(spark):
    schema = "id string, when string, source string, at string, tz_name string, date_order string, value string, rec_id int"
    rows = [
        ("a", "2024-01-31 08:05:00", "s", "1", LONDON, "dmy", "clash", 1),
        ("a", "2024-01-31 08:05:00", "s", "2", LONDON, "dmy", "clash", 1),
        ("b", None, "s", "3", LONDON, "dmy", None, None),
        (None, "2024-01-31", "s", "4", LONDON, "dmy", None, None),
        ("c", "2024-01-31", None, None, None, None, None, None),
        ("d", "x" * 100_000, "s", "5", LONDON, "dmy", None, None),
    ]
    names = dict(rec_id="id", value="when", source="source", order="at", tz_name="tz_name", date_order="date_order")
    out = T.resolve_timestamps(spark.createDataFrame(rows, schema), **names)
    assert {(r.rec_id, r.utc) for r in out.collect()} == {("a", "2024-01-31T08:05:00Z"), ("c", "2024-01-31T00:00:00Z")}
    assert T.resolve_timestamps(spark.createDataFrame([], schema), **names).count() == 0
