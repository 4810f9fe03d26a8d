"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once per application.

    Workers then find it wherever the driver was started and whether or not it is installed on
    the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-package-"), "textloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that intermediate tables are written to.

    On a cluster it is the one named in ``spark.checkpoint.dir``.  Where that setting is absent a
    temporary folder of this machine serves a local master only: executors of a cluster would
    each write to their own disks.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back.

    Executors may be lost at any time: what has been written is neither kept on one of them nor
    computed again.  A table takes about a third of the space of ``checkpoint()`` and later
    reads take only the columns they need.  The tables go when the driver's process ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark)}/textloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Intermediate tables written inside go at its end: read or write the results before.

    >>> with scratch():
    ...     linked_records(...).write.parquet(target)
    """
    held = len(_written)
    try:
        yield
    finally:
        drop_written(held)


def drop_written(keep: int = 0) -> None:
    """Deletes the intermediate tables, but for the first ``keep``; results that were planned on them can't be read afterwards."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(drop_written)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, as a lazily planned scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
