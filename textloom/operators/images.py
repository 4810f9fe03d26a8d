"""Image metadata: links to articles, captions, merged candidates, alignment labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import stats, text


def image_once(images: DataFrame) -> DataFrame:
    """Repeated rows of an image count once: its earliest retrieval."""
    rest = [c for c in images.columns if c != "image_id"]
    return images.groupBy("image_id").agg(F.min_by(F.struct(*rest), F.struct("retrieved_at_utc", "collection_run_id")).alias("x")).select("image_id", "x.*")


def caption(figcaption: Column, alt: Column) -> Column:
    """The figure caption, else the alternative text, else ''."""

    def filled(c):
        return F.when(F.trim(c) != "", F.trim(c))

    return F.coalesce(filled(figcaption), filled(alt), F.lit(""))


def linked_images(images: DataFrame, articles: DataFrame) -> DataFrame:
    """Images beside title and date of their article; images of unknown articles drop out."""
    once = articles.groupBy("document_id").agg(F.min(F.struct("retrieved_at_utc", "title", "published_at")).alias("a")).select("document_id", "a.title", "a.published_at")
    return image_once(images).join(once, "document_id")


def caption_overlap(linked: DataFrame) -> DataFrame:
    """``image_id, document_id, jaccard, relation``: overlap of caption and title words, and a label by ordered rules."""
    words = F.array_distinct(text.content_tokens(text.tokens(F.col("caption"))))
    title = F.array_distinct(text.content_tokens(text.tokens(F.col("title"))))
    j = linked.withColumn("caption", caption(F.col("figcaption"), F.col("alt_text"))).withColumn("jaccard", stats.jaccard(words, title))
    relation = F.when(F.col("caption") == "", "no_caption").when(F.col("jaccard") >= 0.30, "reinforcing_candidate").when(F.col("jaccard") <= 0.0, "divergent_candidate").otherwise("complementary_candidate")
    return j.select("image_id", "document_id", "jaccard", relation.alias("relation"))


def provisional_relation(title: Column, lead: Column, cap: Column, ocr_overlap: Column, has_caption: Column, *, high: float = 0.30, low: float = 0.10, redundant: float = 0.12) -> Column:
    """Ordered decision on similarities of an image to title, lead and caption, and of its lettering to the body.

    ``ocr_overlap`` is null where the image has no lettering; a null similarity counts as 0.
    """
    title, lead, cap = (F.coalesce(c, F.lit(0.0)) for c in (title, lead, cap))
    best = F.greatest(title, lead)
    return (
        F.when(ocr_overlap >= redundant, "text_bearing_redundant_or_evidential")
        .when((cap >= high) & F.coalesce(has_caption, F.lit(False)), "caption_aligned")
        .when(best >= high, "article_aligned_illustrative_or_complementary")
        .when(best < low, "weak_alignment_review")
        .otherwise("review_required")
    )


def merged_candidates(images: DataFrame, *, key: str = "final_url") -> DataFrame:
    """One candidate per article and URL: the first position, values of the inline row before those of the hero row."""
    rank = F.when(F.col("image_role") == "inline", 0).otherwise(1)
    w = ["alt_text", "title_text", "figcaption"]

    def first_filled(c):
        return F.min_by(F.when(F.trim(c) != "", F.col(c)), F.when(F.trim(c) != "", F.struct(rank, F.col("position"), F.col(c)))).alias(c)

    return images.groupBy("document_id", key).agg(F.min("position").alias("position"), F.count("*").alias("n_sources"), *[first_filled(c) for c in w])


def per_listing_new(df: DataFrame, *, url: str, page: str, order: list[str]) -> DataFrame:
    """``page, n_new``: URLs first seen on each page."""
    first = df.withColumn("r", F.row_number().over(Window.partitionBy(url).orderBy(*order)))
    return first.groupBy(page).agg(F.count_if(F.col("r") == 1).alias("n_new"))
