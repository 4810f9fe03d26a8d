"""Sinks: JSON lines, CSV, Parquet, one-file bundles and reports.

A write is atomic per job through the commit protocol of the output; ``overwrite`` replaces the
old output only when the job has succeeded.
"""

from __future__ import annotations

import json
import platform

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """JSON lines with keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    write_json_lines(df, path, mode="append")


def write_csv(df: DataFrame, path: str, *, quote_all: bool = False) -> None:
    """CSV with a header; quotes inside a cell are doubled.  Arrays are joined by a bar."""
    flat = [F.array_join(F.col(f"`{n}`").cast("array<string>"), "|").alias(n) if t.startswith("array<string") else F.col(f"`{n}`") for n, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bundle(df: DataFrame, path: str, *, name: str) -> None:
    """Rows as one JavaScript assignment: a line per row, for pages that load data by a script tag.

    The output is for small result tables; the rows are gathered in one task.
    """
    row = F.to_json(F.struct(*sorted(df.columns)))
    joined = df.select(row.alias("j")).agg(F.array_join(F.array_sort(F.collect_list("j")), ",\n").alias("j"))
    joined.select(F.concat(F.lit(f"window.{name} = ["), "j", F.lit("];")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame) -> str:
    """A one-row table as indented JSON with sorted keys."""
    row = df.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, sort_keys=True, default=str, ensure_ascii=False)


def markdown_counts(counts: dict[str, int | None]) -> str:
    """Row counts of artefacts as a table; an unreadable one shows as such."""
    return "\n".join(["| artefact | rows |", "|---|---|", *(f"| {k} | {'unreadable' if v is None else v} |" for k, v in sorted(counts.items()))]) + "\n"


def row_count(read) -> int | None:
    """Rows of a table, None where it can't be read."""
    try:
        return read().count()
    except Exception:  # noqa: BLE001 - whatever fails, the artefact is unreadable
        return None


def environment() -> dict[str, str]:
    """Versions for the provenance of a run."""
    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()}
