"""Topics: TF-IDF vectors of documents, clusters by several seeds, and the terms that tell a cluster from the others."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators.panels import enough
from textloom.runtime import cut_lineage

FEATURES = 1 << 14


def topic_clusters(df: DataFrame, *, record: str, body: str, k: int = 10, seed: int = 42, min_documents: int = 50, min_document_frequency: int = 3, features: int = FEATURES, iterations: int = 20) -> DataFrame:
    """``record, topic`` by k-means on unit TF-IDF vectors of content tokens, hashed to ``features`` places.

    The stand-in for clusters of sentence embeddings.  A corpus of fewer than ``min_documents`` texts with content has no
    topics (an empty result), and neither has a text without content tokens.
    """
    toks = df.select(F.col(record).alias("record"), text.content_tokens(text.tokens(F.col(body))).alias("items")).filter(F.size("items") > 0)
    none = toks.select("record", F.lit(None).cast("int").alias("topic")).limit(0)
    if not enough(toks, min_documents):
        return none
    counts = HashingTF(inputCol="items", outputCol="tf", numFeatures=features).transform(toks)
    weighted = IDF(inputCol="tf", outputCol="w", minDocFreq=min_document_frequency).fit(counts).transform(counts)
    unit = cut_lineage(Normalizer(inputCol="w", outputCol="features").transform(weighted).select("record", "features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="topic").fit(unit)
    return model.transform(unit).select("record", "topic")


def topic_terms(df: DataFrame, topics: DataFrame, *, record: str, body: str, n: int = 10) -> DataFrame:
    """``topic, n_documents, r, term, score``: the ``n`` terms with the greatest share in the topic times ln(1 + mean topic size / frequency).

    Ties go by term.
    """
    toks = df.select(F.col(record).alias("record"), text.content_tokens(text.tokens(F.col(body))).alias("items"))
    counts = toks.join(topics, "record").select("topic", F.explode("items").alias("term")).groupBy("topic", "term").agg(F.count("*").alias("c"))
    by_term = counts.groupBy("term").agg(F.sum("c").alias("f"))
    by_topic = counts.groupBy("topic").agg(F.sum("c").alias("size"))
    mean = by_topic.agg(F.avg("size").alias("mean")).withColumn("_k", F.lit(1))
    sizes = by_topic.withColumn("_k", F.lit(1)).join(F.broadcast(mean), "_k").drop("_k")  # one row
    sizes = sizes.join(topics.groupBy("topic").agg(F.count("*").alias("n_documents")), "topic")
    scored = counts.join(by_term, "term").join(F.broadcast(sizes), "topic")  # one row per topic
    scored = scored.withColumn("score", F.col("c") / F.col("size") * F.log1p(F.col("mean") / F.col("f")))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("score"), "term")))
    return ranked.filter(F.col("r") <= n).select("topic", "n_documents", "r", "term", "score")
