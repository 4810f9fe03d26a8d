"""Lines of documents and the keys under which lines are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
HEAVY = 2_000  # keys at most that are broadcast; any other key holds less than this part of the rows


def site_of(url) -> F.Column:
    """Host of a URL in lower case, without a leading ``www.``; '' for a null or other value."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), r"^www\.", ""), F.lit(""))


def spaced(line) -> F.Column:
    """The line with each run of white space (no-break spaces too) as one space, none outside."""
    return F.trim(F.regexp_replace(line, SPACE, " "))


def line_key(line) -> F.Column:
    """Lower case, digits runs as one sign, white space evened; '' for blank lines."""
    return F.regexp_replace(F.lower(spaced(line)), r"(?U)\d+", "0")


def body_lines(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> DataFrame:
    """``document_id, site, line_no, line`` of all lines, counted from 1 at each ``\\n``."""
    slim = articles.select(F.col(record).alias("document_id"), site_of(F.col(url)).alias("site"), F.col(body).alias("body"))
    out = slim.select("document_id", "site", F.posexplode(F.split("body", "\n", -1)).alias("at", "line"))
    return out.select("document_id", "site", (F.col("at") + 1).alias("line_no"), "line")


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], *, weight: str, total: int, value: str = "value") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key) as the struct ``value``, null where there is none.

    ``weight`` is how many of the ``total`` rows have the key.  Keys with more than ``total / HEAVY`` rows, of
    which there can't be more than ``HEAVY``, are broadcast, so no key left to the shuffle is a hot one.
    """
    columns = F.struct(*[c for c in table.columns if c not in keys])
    heavy = F.col(weight) * HEAVY > F.lit(total)
    light = table.filter(~heavy).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_light"), columns.alias("_lv"))
    out = rows.join(F.broadcast(table.filter(heavy).select(*keys, columns.alias("_hv"))), keys, "left")
    is_light = F.col("_hv").isNull()
    # Rows that are done go anywhere, and match nothing.
    out = out.withColumn("_light", is_light).withColumn("_spread", F.when(is_light, F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(HEAVY)).cast("int")))
    on = [F.col("l._light") == F.col("t._light"), F.col("l._spread") == F.col("t._spread"), *[F.col(f"l.{k}") == F.col(f"t._{k}") for k in keys]]
    joined = out.alias("l").join(light.withColumn("_spread", F.lit(0)).alias("t"), on, "left")
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], F.coalesce("_hv", "_lv").alias(value))
