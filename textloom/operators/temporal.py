"""Series over time: periods, rates with null-safe denominators, latest rows, bounded interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import stats


def by_period(df: DataFrame, *, when: str, measures: dict[str, str], unit: str = "month") -> DataFrame:
    """``period, n_rows`` and the sums of ``measures`` (output -> column) by month or year; undated rows are left out."""
    fmt = {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}[unit]
    dated = df.filter(F.col(when).isNotNull()).withColumn("period", F.date_format(when, fmt))
    return dated.groupBy("period").agg(F.count("*").alias("n_rows"), *[F.sum(c).alias(out) for out, c in measures.items()])


def prefix_periods(df: DataFrame, *, when: str, measures: dict[str, str], length: int = 7) -> DataFrame:
    """The same for dates kept as ISO text: the period is the text's prefix."""
    ok = df.filter(F.col(when).rlike(r"^\d{4}-\d{2}")).withColumn("period", F.substring(when, 1, length))
    return ok.groupBy("period").agg(F.count("*").alias("n_rows"), *[F.sum(c).cast("bigint").alias(out) for out, c in measures.items()])


def period_rates(events: DataFrame, denominators: DataFrame, *, period: str, category: str, size: str, words: str) -> DataFrame:
    """``period, category, n, per_100, per_10k``: counts over the period's own denominators; a null period meets a null period."""
    counts = events.groupBy(F.col(period).alias("p"), F.col(category).alias("category")).agg(F.count("*").alias("n"))
    d = denominators.groupBy(F.col(period).alias("q")).agg(F.sum(size).alias("d_size"), F.sum(words).alias("d_words"))
    j = counts.join(d, F.col("p").eqNullSafe(F.col("q")), "left")
    return j.select(F.col("p").alias("period"), "category", "n", stats.rate(F.col("n"), F.col("d_size"), 100.0).alias("per_100"), stats.rate(F.col("n"), F.col("d_words"), 10_000.0).alias("per_10k"))


def latest_per_key(df: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order``; one aggregate, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def interpolated_dates(df: DataFrame, *, partition: str, order: str, value: str) -> DataFrame:
    """Fills runs of missing timestamps between known ones: ``prev + (next - prev) * k / (m + 1)``.

    Adds ``estimate`` (a date), ``gap_days``, ``confidence`` (``known``, ``same_day``, ``within_month``,
    ``wide``, ``unresolved``) and the bounds.  A run that is open at an end stays unresolved.
    Bounds are taken within ``partition``, so no global sort takes place.
    """
    before = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(partition).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    seconds = F.unix_timestamp(F.col(value).cast("timestamp"))
    out = df.withColumn("_s", seconds)
    out = out.withColumn("_prev", F.last("_s", True).over(before)).withColumn("_next", F.first("_s", True).over(after)).withColumn("_island", F.count("_s").over(before))
    island = Window.partitionBy(partition, "_island")
    missing = F.col("_s").isNull()
    out = out.withColumn("_m", F.sum(F.when(missing, 1).otherwise(0)).over(island)).withColumn("_k", F.sum(F.when(missing, 1).otherwise(0)).over(island.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.abs(F.col("_next") - F.col("_prev")) / 86400.0
    estimate = F.when(~missing, F.col("_s")).when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), F.col("_prev") + (F.col("_next") - F.col("_prev")) * F.col("_k") / (F.col("_m") + 1))
    confidence = F.when(~missing, "known").when(gap.isNull(), "unresolved").when(gap == 0, "same_day").when(gap <= 31, "within_month").otherwise("wide")
    columns = [c for c in df.columns]
    return out.select(
        *columns,
        F.floor(estimate).cast("bigint").alias("estimate_seconds"),
        gap.alias("gap_days"),
        confidence.alias("confidence"),
        F.least("_prev", "_next").alias("earliest_seconds"),
        F.greatest("_prev", "_next").alias("latest_seconds"),
    )


def nearest_known(df: DataFrame, *, partition: str, order: str, value: str) -> DataFrame:
    """As-of in both directions: the nearest earlier and later known value beside each row."""
    w = Window.partitionBy(partition).orderBy(order)
    return df.withColumn("previous_known", F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next_known", F.first(value, True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def date_quality(column: str, reference) -> F.Column:
    """missing, future or ok against a reference moment."""
    return F.when(F.col(column).isNull(), "missing").when(F.col(column) > reference, "future").otherwise("ok")
