"""Dense vectors: cosine search of stated queries, stored-vector alignment, cluster summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import stats

QUERY_BLOCK = 2_000  # query vectors that a task holds at once
VECTOR_BLOCK = 50_000  # vectors that a task holds at once
NEAREST = "query_id bigint, id bigint, cosine double"


def _unit(values: pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in values])
    length = np.linalg.norm(m, axis=1)
    return m / np.where(length > 0, length, 1.0)[:, None]


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(rows):
            keys, against = rows["id"].to_numpy(), _unit(rows["v"])
            for i in range(0, len(queries), 256):
                part = queries.iloc[i : i + 256]
                for q, sims in zip(part["id"], _unit(part["v"]) @ against.T):
                    sims[keys == q] = -np.inf
                    best = np.lexsort((keys, -sims))[:k] if len(keys) <= 4 * k else _first(sims, keys, k)
                    found.extend((q, int(keys[j]), float(sims[j])) for j in best if np.isfinite(sims[j]))
        return pd.DataFrame(found, columns=["query_id", "id", "cosine"])

    return run


def _first(sims: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The k best with ties by key: everything down to the k-th value, then sorted."""
    least = np.partition(sims, len(sims) - k)[len(sims) - k]
    near = np.flatnonzero(sims >= least)
    return near[np.lexsort((keys[near], -sims[near]))][:k]


def cosine_top_k(vectors: DataFrame, *, record: str, vector: str, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """``query_id, id, cosine, rank``: for every query row its ``k`` nearest other rows, exactly.

    Queries and vectors are cut into blocks by hash, and each pair of blocks is compared by one task, which hands on k
    rows per query; the driver sees the two numbers of rows only.  Ties go by id.  Null vectors are left out.
    """
    q, rows = (df.select(F.col(record).cast("bigint").alias("id"), F.col(vector).alias("v")).filter("v is not null and id is not null") for df in (queries, vectors))
    n_q, n_v = (max(1, -(-df.count() // block)) for df, block in ((q, query_block), (rows, vector_block)))

    def blocks(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    pairs = blocks(q, "qb", n_q, "vb", n_v).groupBy("qb", "vb").cogroup(blocks(rows, "vb", n_v, "qb", n_q).groupBy("qb", "vb"))
    from textloom.operators.explore import stratified_head

    return stratified_head(pairs.applyInPandas(_search(k), NEAREST), group="query_id", order=[F.desc("cosine"), F.col("id")], n=k).withColumnRenamed("r", "rank")


def cluster_summary(df: DataFrame, *, label: str) -> DataFrame:
    """One row: clusters without the noise label -1, rows in it, and all rows."""
    return df.agg(F.count_distinct(F.when(F.col(label) != -1, F.col(label))).alias("n_clusters"), F.count_if(F.col(label) == -1).alias("n_outliers"), F.count("*").alias("n_rows"))


def kmeans_labels(df: DataFrame, *, record: str, vector: str, k: int, seed: int, iterations: int = 20) -> DataFrame:
    """``record, cluster`` by k-means on unit vectors: the stand-in for density clusters, which Spark lacks."""
    unit = df.select(F.col(record), array_to_vector(stats.l2_normalised(F.col(vector))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cluster").fit(unit)
    return model.transform(unit).select(record, "cluster")
