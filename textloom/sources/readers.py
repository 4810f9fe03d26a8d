"""Sources: JSON lines, CSV, text folders, HTML and image files, saved blobs.

Readers take explicit schemas where the record has one; nothing is inferred from the data on
the way, so a scan is one pass.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def struct(fields: str) -> T.StructType:
    """A schema of ``name type`` pairs that needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(", "))])


IMAGE_SCHEMA = struct(
    "image_id string, document_id string, article_url string, position int, request_url string, final_url string, retrieved_at_utc string, mime_type string, byte_count int, sha256 string, width int, height int, "
    "object_path string, alt_text string, title_text string, figcaption string, caption_source string, image_role string, source_location string, dom_index int, source_element string, collection_run_id string"
)
ARTICLE_SCHEMA = T.StructType(
    struct(
        "document_id string, request_url string, final_url string, retrieved_at_utc string, published_at string, author string, title string, section string, language string, body string, paragraphs array<string>, tags array<string>, "
        "body_selector string, word_count int, raw_payload_sha256 string, derived_text_sha256 string, raw_html_path string, http_status int, content_type string, content_encoding string, redirect_chain array<string>"
    ).fields
    + [T.StructField("images", T.ArrayType(IMAGE_SCHEMA))]
    + struct("collection_run_id string, source_type string, corpus_layer string, comments_collected boolean, email_redactions int, personal_data_flag boolean, rights_status string").fields
)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file or folder; blank lines are skipped.

    Strict: a malformed line fails the read.  Otherwise it is kept in ``_corrupt_record``.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    tolerant = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(tolerant).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_lines_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same, and an empty table of the schema where the path doesn't exist."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def layered(spark: SparkSession, preferred: str | None, fallback: str, schema: T.StructType) -> DataFrame:
    """The analysis-ready layer where there is one, else the processed one; an empty layer is an error."""
    df = json_lines(spark, preferred if preferred and exists(spark, preferred) else fallback, schema)
    if df.isEmpty():
        raise FileNotFoundError(f"no records at {fallback}")
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value``: the lines of text files, numbered from 1 within each file.

    A file is read whole, so use it for manifests and logs of moderate size.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "value"))
    return whole.select("file", (F.col("i") + 1).alias("line_no"), "value").filter("value <> ''")


def last_wins(df: DataFrame, *, key: str, order: str) -> DataFrame:
    """Append logs: the last record of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")


def csv_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None, *, sep: str = ",", partitions: int | None = None) -> DataFrame:
    """A CSV file with a header (plain or gzip), only the wanted columns.

    A gzip file can't be split and is read by one task; ``partitions`` spreads its rows before what follows.
    """
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", False).csv(path)
    df = df.select(*columns) if columns else df
    return df.repartition(partitions) if partitions else df


def comparator_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of a comparison corpus: a folder of .txt files, JSON lines, CSV, or one text file."""
    if path.endswith((".jsonl", ".json")):
        df = spark.read.schema("body string, text string").json(path)
        return df.select(F.coalesce(F.when(F.col("body") != "", F.col("body")), F.col("text"), F.lit("")).alias("text"))
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        name = "body" if "body" in df.columns else "text"
        return df.select(F.coalesce(F.col(name), F.lit("")).alias("text"))
    if path.endswith(".txt"):
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, modificationTime, length, content`` of files such as saved pages or images."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 (a leading mark dropped), else Windows-1252, else Latin-1."""

    def one(b):
        if b is None:
            return None
        for name in ("utf-8-sig", "cp1252"):
            try:
                return bytes(b).decode(name)
            except UnicodeDecodeError:
                pass
        return bytes(b).decode("latin-1")

    return content.map(one)


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``key, html, modified``: saved HTML files, keyed by their name without the ending."""
    raw = binary_files(spark, folder, "*.html")
    return raw.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("key"), decoded(F.col("content")).alias("html"), F.col("modificationTime").alias("modified"))


def stored_blob_check(records: DataFrame, blobs: DataFrame, *, key: str, digest: str) -> DataFrame:
    """``key, status``: missing, changed or ok, by the stored hash of each record's file."""
    have = blobs.select(F.col("key"), F.sha2("content", 256).alias("actual"))
    j = records.select(F.col(key).alias("key"), F.col(digest).alias("expected")).join(have, "key", "left")
    return j.select("key", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "changed").otherwise("ok").alias("status"))


def json_or_default(path: str, default: object) -> object:
    """A small JSON file on the driver, or the default where there is none."""
    import json

    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def parse_errors(tolerant: DataFrame, *, examples: int = 3) -> DataFrame:
    """``n_rows, n_errors, examples`` of a tolerant read: its lines, those that are no JSON, and the first of these by text."""
    bad = F.col("_corrupt_record")
    kept = tolerant.select(bad).withColumn("bad", bad.isNotNull())
    some = kept.filter("bad").orderBy("_corrupt_record").limit(examples).agg(F.array_sort(F.collect_list("_corrupt_record")).alias("examples")).withColumn("_k", F.lit(1))
    return kept.agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("n_errors")).withColumn("_k", F.lit(1)).join(F.broadcast(some), "_k").drop("_k")


def config(path: str) -> dict:
    """A JSON configuration (YAML where the parser is installed)."""
    import json

    with open(path, encoding="utf-8") as f:
        if os.path.splitext(path)[1] in (".yml", ".yaml"):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML configurations need the yaml package; JSON works without") from e
            return yaml.safe_load(f) or {}
        return json.load(f)
