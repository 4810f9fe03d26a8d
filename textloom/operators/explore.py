"""Exploration: filtered and paged lists, concordances, review queues, plot summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import stats, text


def filtered(
    df: DataFrame, *, contains: str | None = None, search: list[str] | None = None, equals: dict[str, object] | None = None, tag: str | None = None, tags: str = "tags", low: dict[str, float] | None = None, high: dict[str, float] | None = None
) -> DataFrame:
    """Rows that keep every given condition; a condition that is None is none."""
    cond: Column = F.lit(True)
    if contains:
        hay = F.lower(F.concat_ws(" ", *(search or [])))
        cond = cond & hay.contains(contains.lower())
    for c, v in (equals or {}).items():
        cond = cond & (F.col(c) == v)
    if tag:
        cond = cond & F.array_contains(F.transform(text.split_tags(F.col(tags)), F.lower), tag.lower())
    for c, v in (low or {}).items():
        cond = cond & (F.col(c) >= v)
    for c, v in (high or {}).items():
        cond = cond & (F.col(c) <= v)
    return df.filter(cond)


def page(df: DataFrame, *, order: list[Column], number: int, size: int = 24) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def concordance(sentences: DataFrame, term: str, *, whole_token: bool = True, context: int = 92, documents: DataFrame | None = None) -> DataFrame:
    """``document_id, sentence_index, left, node, right`` of the first match in each sentence; optionally in some documents only."""
    pattern = text.concordance_pattern(term, whole_token=whole_token)
    rows = sentences if documents is None else sentences.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    hit = rows.filter(F.col("sentence").rlike(pattern))
    return hit.select("document_id", "sentence_index", text.kwic(F.col("sentence"), pattern, context).alias("k")).select("document_id", "sentence_index", "k.*")


def review_queue(items: DataFrame, annotations: DataFrame, *, key: str, status: str = "status", default: str = "unreviewed") -> DataFrame:
    """Items beside their annotations; those without one have the default status."""
    return items.join(annotations, key, "left").withColumn(status, F.coalesce(F.col(status), F.lit(default)))


def review_progress(queue: DataFrame, *, status: str = "status") -> DataFrame:
    """One row: total, reviewed, valid, rejected, uncertain and percent done."""
    s = F.col(status)
    reviewed = F.count_if(s.isin("valid", "reject", "uncertain"))
    return queue.agg(
        F.count("*").alias("total"),
        reviewed.alias("reviewed"),
        F.count_if(s == "valid").alias("n_valid"),
        F.count_if(s == "reject").alias("n_reject"),
        F.count_if(s == "uncertain").alias("n_uncertain"),
        F.coalesce(F.try_divide(reviewed * 100.0, F.count("*")), F.lit(0.0)).alias("percent"),
    )


def merged_over(old: DataFrame, new: DataFrame, *, key: str) -> DataFrame:
    """Upsert: new values that aren't null overwrite, old rows and columns survive."""
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = []
    for c in columns:
        sides = [F.col(f"{side}.{c}") for side, df in (("n", new), ("o", old)) if c in df.columns]
        pick.append(F.coalesce(*sides).alias(c))
    return j.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *pick)


def replaced_by(old: DataFrame, new: DataFrame, *, key: str) -> DataFrame:
    """Import: a new entry replaces the whole old one."""
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def stratified_head(df: DataFrame, *, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("r") <= n)


def histogram(df: DataFrame, *, value: str, bins: int) -> DataFrame:
    """``bin, n, low, high`` of equal-width bins; the greatest value falls into the last."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).withColumn("_k", F.lit(1))
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")
    b = rows.select(stats.equal_width_bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi")
    step = (F.col("hi") - F.col("lo")) / bins
    return b.groupBy("bin", "lo", "hi").agg(F.count("*").alias("n")).select("bin", "n", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"))


def median_quadrants(df: DataFrame, *, x: str, y: str) -> DataFrame:
    """``quadrant, n`` by the exact medians of two measures; a value at the median counts as high."""
    mx, my = stats.exact_median(df, x), stats.exact_median(df, y)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    side = F.concat(F.when(F.col(x) >= F.lit(mx), "high_").otherwise("low_"), F.when(F.col(y) >= F.lit(my), "high").otherwise("low"))
    return rows.groupBy(side.alias("quadrant")).agg(F.count("*").alias("n"))


def systematic_sample(df: DataFrame, *, key: str, target: int = 1800) -> DataFrame:
    """Every k-th row by its number ``key``, about ``target`` rows; all rows where there are fewer.

    ``key`` is a dense row number, so no global ranking (a sort in one task) takes place.
    """
    n = df.count()
    step = -(-n // target) if n > target else 1
    return df.filter(F.pmod(F.col(key), F.lit(step)) == 0)


def share_of_total(df: DataFrame, *, category: str) -> DataFrame:
    """``category, n, share`` of all rows."""
    c = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_t")).withColumn("_k", F.lit(1))
    return c.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").select("category", "n", (F.col("n") * 100.0 / F.col("_t")).alias("share"))
