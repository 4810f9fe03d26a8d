"""Registry of the core queries: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import termindex, timestamps
from textloom.runtime import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.publication_moments(load(spark, d, "articles"), load(spark, d, "documents"), load(spark, d, "outlets"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).select("tbl", "rec_id", "utc")


@query("p6_formats")
def p6_formats(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).groupBy("tbl", "format").agg(F.count("*").alias("n_values"), F.sum(F.when(F.col("n_readings") > 1, 1).otherwise(0)).alias("n_ambiguous"), F.min("utc").alias("first_utc"), F.max("utc").alias("last_utc"))


@query("p6_order_inferred")
def p6_order_inferred(spark: SparkSession, d: str) -> DataFrame:
    """The moments where no outlet has told its order of day and month: the decoding over its records decides."""
    outlets = load(spark, d, "outlets").withColumn("date_order", F.lit(None).cast("string"))
    return timestamps.publication_moments(load(spark, d, "articles"), load(spark, d, "documents"), outlets).select("tbl", "rec_id", "utc")


_P7_BASE = r"""
with t as (
  select document_id, token_index, min(case when trim(regexp_replace(coalesce(lemma,''), '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) <> ''
      then lower(regexp_replace(lemma, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'))
      else lower(regexp_replace(lower, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) end) as raw
  from tokens where is_alpha group by document_id, token_index
), u as (select document_id, nfc_normalize(raw) as lemma from t where raw is not null and raw <> ''),
f as (select lemma, count(*) as occurrences, count(distinct document_id) as records from u group by lemma),
n as (select count(distinct document_id) as n from tokens),
m as (select lemma, occurrences, records, case when records < 3 then 'rare' when records > 0.40 * n then 'common' end as mark from f, n)
"""


def _p7(spark: SparkSession, d: str) -> DataFrame:
    tokens = load(spark, d, "tokens")
    out = termindex.term_frequencies(tokens, record="document_id", item="token_index", term=termindex.lemma_of("lemma", "lower"), keep=F.col("is_alpha"))
    return out.withColumnRenamed("term", "lemma")


@query("p7_found", _P7_BASE + "select lemma, mark from m where mark is not null")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).filter("mark is not null").select("lemma", "mark")


@query("p7_frequencies", _P7_BASE + "select lemma, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records from m")
def p7_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("lemma", "occurrences", "records")
