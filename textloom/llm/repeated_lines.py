"""Lines repeated across one site's documents: PrefixSpan over line-identifier sequences.

A line's identifier is the 64-bit hash of its site and key, a document the sequence of its
frequent lines.  PrefixSpan grows patterns from the left: the projected database of a pattern holds,
for each document, the places at which an occurrence of the pattern ends, and the lines that
follow such a place within ``max_gap`` other frequent lines are the candidates for its next line.  Level
1 are single lines; a level ends with one count of distinct documents per candidate, and only occurrences of the
frequent ones are carried on, as (document, pattern, place).  Counts are combined before the shuffle, and the join
that drops infrequent candidates broadcasts the few hot ones (``lines.join_spread``), so neither a
site nor a line that holds a third of all rows is ever gathered in one task.

Deleting every occurrence of the frequent sequences needs level 1 alone: each line of a frequent sequence is
a frequent sequence itself (PrefixSpan's own pruning rule), so further levels add no place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.lines import join_spread, line_key, site_of
from textloom.runtime import cut_lineage

MIN_DOCUMENTS = 8


def line_sequences(articles: DataFrame, *, record: str = "document_id", url: str = "final_url", body: str = "body") -> DataFrame:
    """``document_id, ids``: the identifier of each line of ``body`` (null for a blank one), once per document.

    A null record is left out; a null body has an empty sequence.  Of rows with the same record the one with the least
    (hash of the body, site) counts, as in ``without_repeated_lines``.
    """
    site = site_of(F.col(url))
    keys = F.transform(F.split(F.coalesce(F.col(body), F.lit("")), "\n", -1), line_key)
    slim = articles.filter(F.col(record).isNotNull()).select(F.col(record).alias("document_id"), F.xxhash64(body).alias("h"), site.alias("site"), keys.alias("keys"))
    ids = F.transform("keys", lambda k: F.when(k != "", F.xxhash64("site", k)))
    return slim.select("document_id", F.struct("h", "site", ids.alias("ids")).alias("x")).groupBy("document_id").agg(F.min("x").alias("x")).select("document_id", "x.ids")


def frequent_patterns(candidates: DataFrame, *, min_documents: int) -> DataFrame:
    """``pattern, documents, occurrences`` of the candidates with enough distinct documents.

    ``candidates(document_id, patterns)``: a row per document with the pattern of each occurrence.  A document's own
    sorted array tells which pattern is new to it, so there is one shuffle, on the pattern.
    """
    ordered = candidates.select(F.sort_array("patterns").alias("o"))
    marks = F.transform("o", lambda x, i: F.struct(x.alias("pattern"), ((i == 0) | (F.get("o", i - 1) != x)).cast("int").alias("first")))
    counts = ordered.select(F.explode(marks).alias("m")).groupBy("m.pattern").agg(F.sum("m.first").alias("documents"), F.count("*").alias("occurrences"))
    return counts.filter(F.col("documents") >= min_documents)


def prefix_span(sequences: DataFrame, *, min_documents: int = MIN_DOCUMENTS, max_gap: int | None = 0) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(patterns, occurrences) of each level, until a level has none.

    ``sequences(document_id, ids)``; null ids hold a place but are no line.  ``patterns``: ``pattern, prefix, id, documents,
    occurrences``, where ``pattern`` is the hash of the prefix's and of the added line ``id``.  ``occurrences``: ``document_id,
    pattern, place, documents``, the place (from 0 in ``ids`` at level 1, from 1 among the frequent lines afterwards) being
    that of the last line.  ``max_gap`` other frequent lines may stand between two lines of a pattern, with None any number
    of them; the places of one document and pattern are distinct.
    """
    sequences = cut_lineage(sequences)  # read three times
    lines = sequences.select("document_id", F.filter("ids", lambda x: x.isNotNull()).alias("patterns"))
    patterns = cut_lineage(frequent_patterns(lines, min_documents=min_documents))
    placed = sequences.select("document_id", F.posexplode("ids").alias("place", "pattern")).filter("pattern is not null")
    total = sequences.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    found = join_spread(placed, patterns, ["pattern"], weight="occurrences", total=total, value="p").filter("p is not null")
    found = found.select("document_id", "pattern", "place", "p.documents")
    yield patterns.select("pattern", F.lit(None).cast("bigint").alias("prefix"), F.col("pattern").alias("id"), "documents", "occurrences"), found

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "pattern"))), lambda x: x["pattern"])
    database = cut_lineage(found.groupBy("document_id").agg(ordered.alias("ids")))
    # At level 1 every place of the database ends a pattern.
    ends = F.transform("ids", lambda x, i: F.struct(x.alias("pattern"), (i + 1).alias("place")))
    projected = database.select("document_id", "ids", ends.alias("ends"))
    while True:
        # How far the next line may be: any place behind, or the next max_gap + 1 places.
        last = (lambda e: F.size("ids")) if max_gap is None else (lambda e: F.least(F.size("ids"), e["place"] + max_gap + 1))
        empty = F.array().cast("array<int>")
        follows = lambda e: F.when(e["place"] < F.size("ids"), F.sequence(e["place"] + 1, last(e))).otherwise(empty)
        step = lambda e, p: F.struct(F.xxhash64(e["pattern"], F.get("ids", p - 1)).alias("pattern"), e["pattern"].alias("prefix"), F.get("ids", p - 1).alias("id"), p.alias("place"))
        grown = F.array_distinct(F.flatten(F.transform("ends", lambda e: F.transform(follows(e), lambda p: step(e, p)))))
        grown = cut_lineage(projected.select("document_id", grown.alias("grown")).filter(F.size("grown") > 0))
        patterns = cut_lineage(frequent_patterns(grown.select("document_id", F.col("grown.pattern").alias("patterns")), min_documents=min_documents))
        total = grown.agg(F.coalesce(F.sum(F.size("grown")), F.lit(0))).first()[0]
        if not total or patterns.isEmpty():
            return
        places = grown.select("document_id", F.explode("grown").alias("g")).select("document_id", "g.*")
        kept = join_spread(places, patterns, ["pattern"], weight="occurrences", total=total, value="p").filter("p is not null")
        kept = cut_lineage(kept.select("document_id", "pattern", "prefix", "id", "place", "p.documents"))
        born = kept.select("pattern", "prefix", "id").distinct()
        yield patterns.join(born, "pattern").select("pattern", "prefix", "id", "documents", "occurrences"), kept.select("document_id", "pattern", "place", "documents")
        of = kept.groupBy("document_id").agg(F.collect_list(F.struct("pattern", "place")).alias("ends"))
        projected = database.join(of, "document_id")


def repeated_occurrences(articles: DataFrame, *, min_documents: int = MIN_DOCUMENTS, **columns: str) -> DataFrame:
    """``document_id, line_no, id, documents``: every line that an occurrence of a frequent sequence covers.

    That is level 1 of ``prefix_span``; see the module's text for why further levels add nothing.
    """
    _, found = next(prefix_span(line_sequences(articles, **columns), min_documents=min_documents))
    return found.select("document_id", (F.col("place") + 1).alias("line_no"), F.col("pattern").alias("id"), "documents")


def frequent_sequences(articles: DataFrame, *, min_documents: int = MIN_DOCUMENTS, max_gap: int | None = 0, max_length: int | None = None, **columns: str) -> DataFrame:
    """``length, pattern, documents, occurrences``: frequent sequences of ``length`` lines, 1 included.

    ``pattern`` is the list of line identifiers.  With ``max_gap=0`` its lines are adjacent among the frequent lines of
    a document; None takes all of PrefixSpan's sequences, of which a run of n frequent lines alone has 2^n - 1.  Growth ends with
    the first level that has no frequent pattern, or at ``max_length``.  ``occurrences`` counts the places where one ends.
    """
    out = names = None
    for length, (patterns, _) in enumerate(prefix_span(line_sequences(articles, **columns), min_documents=min_documents, max_gap=max_gap), 1):
        if names is None:
            level = patterns.select("pattern", F.array("id").alias("lines"), "documents", "occurrences")
        else:
            level = patterns.join(names, "prefix").select("pattern", F.concat("lines", F.array("id")).alias("lines"), "documents", "occurrences")
        level = cut_lineage(level)
        names = level.select(F.col("pattern").alias("prefix"), "lines")
        rows = level.select(F.lit(length).alias("length"), F.col("lines").alias("pattern"), "documents", "occurrences")
        out = rows if out is None else out.unionByName(rows)
        if length == max_length:
            break
    return out


def line_names(articles: DataFrame, *, url: str = "final_url", body: str = "body") -> DataFrame:
    """``id, site, key``: what each line identifier stands for."""
    lines = articles.select(site_of(F.col(url)).alias("site"), F.explode(F.split(body, "\n", -1)).alias("line")).select("site", line_key(F.col("line")).alias("key"))
    return lines.filter("key <> ''").select(F.xxhash64("site", "key").alias("id"), "site", "key").distinct()


def without_repeated_lines(articles: DataFrame, *, min_documents: int = MIN_DOCUMENTS, record: str = "document_id", url: str = "final_url", body: str = "body", paragraphs: str = "paragraphs") -> DataFrame:
    """``document_id, body, paragraphs, n_removed_lines, n_removed_paragraphs`` with the frequent lines deleted.

    A null body or paragraphs column stays null; a document whose lines all go has an empty body.
    """
    frequent = repeated_occurrences(articles, min_documents=min_documents, record=record, url=url, body=body)
    gone = frequent.groupBy("document_id").agg(F.collect_set("line_no").alias("gone"), F.collect_set("id").alias("gone_ids"))
    slim = articles.filter(F.col(record).isNotNull()).select(F.col(record).alias("document_id"), F.struct(F.xxhash64(body).alias("h"), site_of(F.col(url)).alias("site"), F.col(body).alias("body"), F.col(paragraphs).alias("paragraphs")).alias("x"))
    once = slim.groupBy("document_id").agg(F.min("x").alias("x")).select("document_id", "x.site", "x.body", "x.paragraphs")
    j = once.join(gone, "document_id", "left")
    numbered = F.transform(F.split("body", "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    keep = F.transform(F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["no"])), lambda x: x["line"])
    kept = F.filter("paragraphs", lambda p: ~F.coalesce(F.array_contains(F.coalesce("gone_ids", F.array().cast("array<bigint>")), F.xxhash64("site", line_key(p))), F.lit(False)))
    return j.select(
        "document_id",
        F.array_join(keep, "\n").alias("body"),
        kept.alias("paragraphs"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed_lines"),
        (F.size("paragraphs") - F.size(kept)).alias("n_removed_paragraphs"),
    )
