"""Candidates for review: lexicon matches, flags, per-document counts, co-occurrence edges.

Every output is a retrieval aid and carries ``validation_status``; nothing here is a finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text

UNREVIEWED = "unreviewed_candidate"
# Marker lists of the default configuration; each is a parameter.
REPORTING_VERBS = "say claim report argue tell write announce state allege describe according".split()
PRESUPPOSITION = "again still stop continue even only already return restore".split()
MARKERS = {
    "ingroup_markers": "we us our ours ourselves".split(),
    "outgroup_markers": "they them their theirs themselves".split(),
    "modal_markers": "must should need ought will cannot".split(),
    "certainty_markers": "clearly certainly undoubtedly obviously definitely".split(),
    "hedge_markers": "may might perhaps reportedly apparently arguably possibly".split(),
}
FRAMES = {
    "health_care": ["hospital", "clinic", "nurse", "doctor", "patient"],
    "housing": ["housing", "tenant", "landlord", "rent", "home"],
    "schools": ["school", "teacher", "pupil", "class"],
    "transport": ["train", "bus", "station", "road", "cycle lane"],
    "elections": ["vote", "election", "candidate", "council"],
}


def sentence_rows(df: DataFrame, *, record: str, body: str) -> DataFrame:
    """``document_id, sentence_id, sentence_index, sentence`` of all sentences."""
    rows = df.select(F.col(record).cast("string").alias("document_id"), F.posexplode(text.sentences(F.col(body))).alias("sentence_index", "sentence"))
    return rows.select("document_id", F.format_string("%s-s%04d", "document_id", "sentence_index").alias("sentence_id"), "sentence_index", "sentence")


def flagged(sentences: DataFrame, *, reporting: list[str] | None = None, presupposition: list[str] | None = None) -> DataFrame:
    """Sentences with quotation, reported-speech and question flags and the words that set them.

    Word forms stand for lemmas here; negation and passive voice need a parse and are null.
    """
    words = F.array_distinct(text.tokens(F.col("sentence")))

    def hits(terms: list[str]):
        return F.array_sort(F.array_intersect(words, F.array(*[F.lit(t) for t in terms])))

    out = sentences.withColumn("r", hits(reporting or REPORTING_VERBS)).withColumn("p", hits(presupposition or PRESUPPOSITION))
    quoted = text.quotation_flag(F.col("sentence"))
    return out.select(
        *sentences.columns,
        quoted.alias("quotation_flag"),
        (quoted | (F.size("r") > 0)).alias("reported_speech_flag"),
        F.array_join("r", "|").alias("reporting_verb_hits"),
        F.lit(None).cast("boolean").alias("negation_flag"),
        F.lit(None).cast("boolean").alias("passive_voice_flag"),
        text.question_flag(F.col("sentence")).alias("question_flag"),
        F.array_join("p", "|").alias("presupposition_trigger_hits"),
    )


def lexicon_candidates(sentences: DataFrame, lexicon: dict[str, list[str]], *, label: str = "frame") -> DataFrame:
    """One row per sentence and category with a match: ``<label>, matched_terms, validation_status``."""
    found = F.array(*[F.struct(F.lit(k).alias("c"), text.lexicon_hits(F.col("sentence"), terms).alias("h")) for k, terms in lexicon.items()])
    every = [t for terms in lexicon.values() for t in terms]
    some = sentences.filter(F.col("sentence").rlike(text.any_term_pattern(every))) if every else sentences.limit(0)
    rows = some.select("document_id", "sentence_id", "sentence_index", F.explode(F.filter(found, lambda x: F.size(x["h"]) > 0)).alias("f"))
    return rows.select("document_id", "sentence_id", "sentence_index", F.col("f.c").alias(label), F.array_join("f.h", "|").alias("matched_terms"), F.lit(UNREVIEWED).alias("validation_status"))


# Words that signal a strategy of legitimation.
STRATEGIES = {
    "authorisation": "expert, official, authority, law, court, research, evidence".split(", "),
    "moral_evaluation": "right, wrong, duty, moral, immoral, fair, unfair, justice".split(", "),
    "rationalisation": "because, therefore, so that, in order to, necessary, practical".split(", "),
    "mythopoesis": "story, history teaches, lesson, example, once, future generations".split(", "),
}


def marker_counts(df: DataFrame, *, record: str, body: str, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document with a column of token counts per marker list; absent markers are 0."""
    rows = df.select(F.col(record).alias("document_id"), text.tokens(F.col(body)).alias("toks"))

    def count(terms: list[str]):
        return F.size(F.filter("toks", lambda t: t.isin(*terms))).cast("bigint")

    return rows.select("document_id", *[count(terms).alias(name) for name, terms in (markers or MARKERS).items()])


def category_counts(candidates: DataFrame, *, category: str, values: list[str], prefix: str) -> DataFrame:
    """Wide counts per document with a fixed list of categories (no pass to find them)."""
    cols = [F.count_if(F.col(category) == v).alias(f"{prefix}_{v}") for v in values]
    return candidates.groupBy("document_id").agg(*cols)


def column_totals(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``marker, total``: the sums of the columns as rows."""
    sums = wide.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("marker"), F.col(c).alias("total")) for c in columns])).alias("x")).select("x.*")


def cooccurrence_edges(mentions: DataFrame, *, group: str, item: str) -> DataFrame:
    """``actor_1, actor_2, sentence_cooccurrence``: pairs of distinct items in one group (a sentence).

    Pairs are formed within the sentence's own short array.
    """
    sets = mentions.filter(F.col(item).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("_members")).select(F.col("_members").alias("s")).filter(F.size("s") > 1)
    left = sets.select("s", F.posexplode("s").alias("i", "actor_1"))
    pairs = left.select("actor_1", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("actor_2"))
    return pairs.groupBy("actor_1", "actor_2").agg(F.count("*").alias("sentence_cooccurrence"))


def named_mentions(sentences: DataFrame) -> DataFrame:
    """Runs of two or more capitalised words in a sentence: an approximation where no entity model is at hand."""
    runs = F.regexp_extract_all(F.col("sentence"), F.lit(r"(?U)\b\p{Lu}[\p{L}’']+(?: \p{Lu}[\p{L}’']+)+\b"), F.lit(0))
    return sentences.select("document_id", "sentence_id", F.explode(runs).alias("entity")).withColumn("entity_normalised", F.lower("entity"))


def predications(tokens: DataFrame, *, heads: list[str], modifiers: list[str]) -> DataFrame:
    """Modifiers and governing predicates of nouns, by a join of tokens on their head.

    ``document_id, token_index, entity, modifiers, predicate`` for proper nouns with a dependency
    in ``heads`` or with a modifier whose dependency is in ``modifiers``.
    """
    t = tokens.dropDuplicates(["document_id", "token_index"]).select("document_id", "token_index", F.lower(F.coalesce("lemma", "lower")).alias("lemma"), "text", "pos", "dep", "head_index", "is_alpha")
    nouns = t.filter(F.col("pos") == "PROPN").select("document_id", "token_index", F.col("text").alias("entity"), "dep", "head_index")
    mods = t.filter(F.col("dep").isin(*modifiers) & F.col("is_alpha")).groupBy("document_id", F.col("head_index").alias("token_index")).agg(F.array_join(F.array_sort(F.collect_set("lemma")), "|").alias("modifiers"))
    preds = t.select("document_id", F.col("token_index").alias("head_index"), F.col("lemma").alias("governor"))
    j = nouns.join(mods, ["document_id", "token_index"], "left").join(preds, ["document_id", "head_index"], "left")
    predicate = F.when(F.col("dep").isin(*heads), F.col("governor"))
    return j.select("document_id", "token_index", "entity", F.coalesce("modifiers", F.lit("")).alias("modifiers"), F.coalesce(predicate, F.lit("")).alias("predicate")).filter("modifiers <> '' or predicate <> ''")
