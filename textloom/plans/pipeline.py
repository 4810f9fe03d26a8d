"""The text pipeline as one call: normalised layer -> documents, sentences, tokens -> statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import discourse, lexical, quality


def normalised_layer(articles: DataFrame) -> DataFrame:
    """Articles with even text: body and paragraphs replaced, empty paragraphs dropped, hash and layer added."""
    even = text.normalise_text(F.col("body"))
    blocks = F.filter(F.transform("paragraphs", lambda p: text.squeeze(p)), lambda p: p != "")
    return articles.withColumn("body", even).withColumn("paragraphs", blocks).withColumn("derived_text_sha256", F.sha2("body", 256)).withColumn("corpus_layer", F.lit("analysis_ready"))


def document_metrics(articles: DataFrame) -> DataFrame:
    """One row per article with readability, moving type-token ratio and dates as text prefixes."""
    toks = text.tokens(F.col("body"))
    out = articles.dropDuplicates(["document_id"]).select("document_id", "final_url", "title", "published_at", "author", F.array_join("tags", "|").alias("tags"), F.size("images").alias("image_count"), F.size("paragraphs").alias("paragraph_count"), text.readability(F.col("body")).alias("r"), text.mattr(toks).alias("mattr_50"))
    iso = F.col("published_at").rlike(r"^\d{4}-\d{2}")
    return out.select("document_id", "final_url", "title", "published_at", F.when(iso, F.substring("published_at", 1, 4).cast("int")).alias("year"), F.when(iso, F.substring("published_at", 1, 7)).alias("month"), "author", "tags", "image_count", "paragraph_count", "r.*", "mattr_50")


def token_rows(articles: DataFrame) -> DataFrame:
    """Tokens without a model: parts of speech, lemmas and heads are null, sentence indices are filled."""
    s = discourse.sentence_rows(articles, record="document_id", body="body")
    t = s.select("document_id", "sentence_index", F.posexplode(text.tokens(F.col("sentence"))).alias("at", "lower"))
    null = F.lit(None).cast("string")
    return t.select("document_id", "sentence_index", F.col("at").alias("sentence_token"), "lower", null.alias("lemma"), null.alias("pos"), null.alias("dep"), F.col("lower").isin(*text.STOPWORDS).alias("is_stop"), F.col("lower").rlike(r"(?U)^\p{L}+$").alias("is_alpha"))


def run(articles: DataFrame, *, lexicon: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """All results by name, lazily planned; nothing runs until one is written."""
    layer = normalised_layer(articles)
    sentences = discourse.flagged(discourse.sentence_rows(layer.dropDuplicates(["document_id"]), record="document_id", body="body"))
    once = layer.dropDuplicates(["document_id"])
    return {
        "articles": layer,
        "documents": document_metrics(layer),
        "sentences": sentences,
        "tokens": token_rows(once),
        "terms": lexical.term_frequencies(once, record="document_id", body="body"),
        "bigrams": lexical.ngram_frequencies(once, record="document_id", body="body", n=2),
        "candidates": discourse.lexicon_candidates(sentences, lexicon or discourse.FRAMES),
        "markers": discourse.marker_counts(once, record="document_id", body="body"),
        "duplicates": quality.exact_duplicate_groups(once, record="document_id", body="body"),
        "violations": quality.rule_violations(layer, record="document_id", rules=quality.article_rules()),
    }
