"""Corpus statistics of terms: frequencies, n-grams, keyness, collocations, runs of content words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import stats, text


def tokenised(df: DataFrame, *, record: str, body: str) -> DataFrame:
    """``record, toks``: one row per record with its word tokens."""
    return df.select(F.col(record).alias("record"), text.tokens(F.col(body)).alias("toks"))


def _with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """A one-row table beside every row (a broadcast of one row, not a product of tables)."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").drop("_k")


def _marked(lists: DataFrame, items: str, *keep: str) -> DataFrame:
    """``keep, item, first``: a row per item, the first of its kind in its record marked.

    A record is one row, so its own sorted array tells in how many records an item occurs; no
    shuffle on (record, item) is needed.
    """
    ordered = lists.select(*keep, F.sort_array(items).alias("_o"))
    marks = F.transform("_o", lambda x, i: F.struct(x.alias("item"), ((i == 0) | (F.get("_o", i - 1) != x)).cast("int").alias("first")))
    return ordered.select(*keep, F.explode(marks).alias("_m")).select(*keep, "_m.item", "_m.first")


def frequencies(lists: DataFrame, *, items: str, name: str, min_frequency: int = 1) -> DataFrame:
    """``<name>, frequency, document_frequency, per_million, document_proportion`` of the items of all records.

    One shuffle, on the item, with counts combined before it; the number of all items, which is
    the denominator, is the sum of the same counts.
    """
    counts = _marked(lists, items).groupBy(F.col("item").alias(name)).agg(F.count("*").alias("frequency"), F.sum("first").alias("document_frequency"))
    total = counts.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("_total"))
    out = _with_total(_with_total(counts.filter(F.col("frequency") >= min_frequency), total), lists.agg(F.count("*").alias("_documents")))
    return out.select(
        name,
        "frequency",
        "document_frequency",
        stats.rate(F.col("frequency"), F.col("_total"), 1e6).alias("per_million"),
        stats.rate(F.col("document_frequency"), F.col("_documents"), 1.0).alias("document_proportion"),
    )


def term_frequencies(df: DataFrame, *, record: str, body: str, stopwords: list[str] | None = None) -> DataFrame:
    lists = tokenised(df, record=record, body=body).select("record", text.content_tokens(F.col("toks"), stopwords).alias("items"))
    return frequencies(lists, items="items", name="term")


def ngram_frequencies(df: DataFrame, *, record: str, body: str, n: int, min_frequency: int = 5) -> DataFrame:
    """N-grams of tokens of two characters or more, stopwords kept, over sentence ends."""
    longer = F.filter("toks", lambda t: F.length(t) > 1)
    lists = tokenised(df, record=record, body=body).select("record", text.ngrams(longer, n).alias("items"))
    return frequencies(lists, items="items", name="ngram", min_frequency=min_frequency).withColumn("n", F.lit(n))


def keyness(target: DataFrame, comparator: DataFrame, *, record: str, body: str, min_target: int = 5) -> DataFrame:
    """Terms of ``target`` against ``comparator``: counts, G2, log ratio, p and q; ``min_target`` occurrences or more."""

    sides = [tokenised(df, record=record, body=body).select(F.lit(side).alias("side"), text.content_tokens(F.col("toks")).alias("items")) for df, side in ((target, "target"), (comparator, "comparator"))]
    marked = _marked(sides[0].unionByName(sides[1]), "items", "side")
    is_target = F.col("side") == "target"
    counted = {"target_frequency": F.when(is_target, 1), "comparator_frequency": F.when(~is_target, 1), "target_document_frequency": F.when(is_target, F.col("first")), "comparator_document_frequency": F.when(~is_target, F.col("first"))}
    counts = marked.groupBy(F.col("item").alias("term")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counted.items()])
    totals = counts.agg(*[F.coalesce(F.sum(f"{x}_frequency"), F.lit(0)).alias(f"{x}_total") for x in ("target", "comparator")])
    j = _with_total(counts.filter(F.col("target_frequency") >= min_target), totals)
    args = (F.col("target_frequency"), F.col("target_total"), F.col("comparator_frequency"), F.col("comparator_total"))
    out = j.withColumn("log_likelihood", stats.log_likelihood(*args)).withColumn("log_ratio", stats.log_ratio(*args))
    return out.withColumn("p_value", stats.chi2_tail(F.col("log_likelihood"))).drop("target_total", "comparator_total")


def collocations(df: DataFrame, *, record: str, body: str, nodes: list[str], window: int = 5, min_frequency: int = 5) -> DataFrame:
    """Collocates within ``window`` tokens of each node: counts, documents, PMI and logDice.

    The neighbourhood is sliced from the record's own token array, so no self-join takes place.
    One-character collocates are left out; a node that recurs in its window is its own collocate.
    """
    toks = tokenised(df, record=record, body=body)
    wanted = F.array(*[F.lit(x) for x in nodes])
    at = toks.select("record", "toks", F.posexplode("toks").alias("at", "node")).filter(F.array_contains(wanted, F.col("node")))
    left = F.slice("toks", F.greatest(F.lit(1), F.col("at") + 1 - window), F.least(F.col("at"), F.lit(window)))
    right = F.slice("toks", F.col("at") + 2, window)
    near = at.select("record", "node", F.explode(F.filter(F.concat(left, right), lambda x: F.length(x) > 1)).alias("collocate"))
    per = near.groupBy("node", "collocate", "record").agg(F.count("*").alias("n"))
    pairs = per.groupBy("node", "collocate").agg(F.sum("n").alias("cooccurrence_frequency"), F.count("*").alias("document_frequency")).filter(F.col("cooccurrence_frequency") >= min_frequency)
    counts = toks.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    total = counts.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("_n"))
    j = pairs.join(counts.select(F.col("t").alias("node"), F.col("f").alias("node_frequency")), "node")
    j = _with_total(j.join(counts.select(F.col("t").alias("collocate"), F.col("f").alias("collocate_frequency")), "collocate"), total)
    f, fn, fc = F.col("cooccurrence_frequency"), F.col("node_frequency"), F.col("collocate_frequency")
    return j.select("node", "collocate", f, fn, fc, "document_frequency", stats.pmi(f, F.col("_n"), fn, fc).alias("pmi"), stats.log_dice(f, fn, fc).alias("logdice"))


def collocation_examples(df: DataFrame, *, record: str, body: str, nodes: list[str], window: int = 8, examples: int = 3) -> DataFrame:
    """The first contexts of each node in record and token order, joined by `` || ``."""
    toks = tokenised(df, record=record, body=body)
    wanted = F.array(*[F.lit(x) for x in nodes])
    at = toks.select("record", "toks", F.posexplode("toks").alias("at", "node")).filter(F.array_contains(wanted, F.col("node")))
    start = F.greatest(F.lit(1), F.col("at") + 1 - window)
    context = F.array_join(F.slice("toks", start, F.col("at") + 1 + window - start + 1), " ")
    rows = at.select("record", "at", "node", context.alias("context"))
    # The least rows per record first, so that the window only sees ``examples`` of each record.
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("node", "record").orderBy("at"))).filter(F.col("r") <= examples)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("record", "at"))).filter(F.col("r") <= examples)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "context"))), lambda x: x["context"]), " || ")
    return best.groupBy("node").agg(joined.alias("examples"))


def collocation_pair_examples(df: DataFrame, *, record: str, body: str, nodes: list[str], window: int = 5, around: int = 8, examples: int = 3, min_frequency: int = 5) -> DataFrame:
    """``node, collocate, examples``: the first contexts of each pair in record and token order, joined by `` || ``.

    Pairs with ``min_frequency`` co-occurrences or more; a node's place counts once for each collocate beside it.
    """
    toks = tokenised(df, record=record, body=body)
    wanted = F.array(*[F.lit(x) for x in nodes])
    at = toks.select("record", "toks", F.posexplode("toks").alias("at", "node")).filter(F.array_contains(wanted, F.col("node")))

    def beside(n: int) -> tuple:
        left = F.slice("toks", F.greatest(F.lit(1), F.col("at") + 1 - n), F.least(F.col("at"), F.lit(n)))
        return left, F.slice("toks", F.col("at") + 2, n)

    near = F.filter(F.concat(*beside(window)), lambda x: F.length(x) > 1)
    start = F.greatest(F.lit(1), F.col("at") + 1 - around)
    context = F.array_join(F.slice("toks", start, F.col("at") + 1 + around - start + 1), " ")
    rows = at.select("record", "at", "node", context.alias("context"), near.alias("near"))
    often = rows.select("node", F.explode("near").alias("collocate")).groupBy("node", "collocate").agg(F.count("*").alias("n")).filter(F.col("n") >= min_frequency).drop("n")
    pairs = rows.select("record", "at", "node", "context", F.explode(F.array_distinct("near")).alias("collocate")).join(often, ["node", "collocate"])
    # The first of each record come before the first of all, so that a frequent pair isn't sorted in one task.
    order = Window.partitionBy("node", "collocate")
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("node", "collocate", "record").orderBy("at"))).filter(F.col("r") <= examples)
    best = first.withColumn("r", F.row_number().over(order.orderBy("record", "at"))).filter(F.col("r") <= examples)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "context"))), lambda x: x["context"]), " || ")
    return best.groupBy("node", "collocate").agg(joined.alias("examples"))


def content_runs(tokens: DataFrame, *, pos: list[str], n: int = 2, min_frequency: int = 2) -> DataFrame:
    """N-grams inside runs of content words of one sentence: ``ngram, frequency, document_frequency``.

    A run ends at any token that isn't an alphabetic content word (part of speech in ``pos``, no
    stopword, two characters or more), at a sentence's and at a document's end.
    """
    once = tokens.dropDuplicates(["document_id", "token_index"])
    term = F.lower(F.coalesce(F.when(F.trim("lemma") != "", F.trim("lemma")), F.col("lower")))
    content = F.coalesce(F.col("is_alpha") & ~F.col("is_stop") & F.col("pos").isin(*pos) & (F.length(term) >= 2), F.lit(False))
    w = Window.partitionBy("document_id", "sentence_index").orderBy("token_index")
    marked = once.select("document_id", "sentence_index", "token_index", F.when(content, term).alias("t"))
    parts = [F.col("t")] + [F.lead("t", i).over(w) for i in range(1, n)]
    grams = marked.withColumn("ngram", F.when(sum((p.isNull().cast("int") for p in parts[1:]), parts[0].isNull().cast("int")) == 0, F.concat_ws(" ", *parts)))
    per = grams.filter("ngram is not null").groupBy("document_id", "ngram").agg(F.count("*").alias("k"))
    return per.groupBy("ngram").agg(F.sum("k").alias("frequency"), F.count("*").alias("document_frequency")).filter(F.col("frequency") >= min_frequency)


def lemma_concordance(tokens: DataFrame, *, per_lemma: int = 80, top_lemmas: int = 3000) -> DataFrame:
    """``lemma, document_id, sentence_index, r``: the first sentences of each of the most frequent lemmas."""
    once = tokens.filter("is_alpha").dropDuplicates(["document_id", "token_index"])
    rows = once.select(F.lower(F.coalesce(F.when(F.trim("lemma") != "", F.trim("lemma")), F.col("lower"))).alias("lemma"), "document_id", "sentence_index")
    top = rows.groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(top_lemmas)
    seen = rows.join(top.select("lemma"), "lemma", "left_semi").distinct()
    # Two steps: within document blocks first, so that a frequent lemma is not sorted in one task.
    block = F.substring("document_id", 1, 2)
    first = seen.withColumn("b", block).withColumn("r", F.row_number().over(Window.partitionBy("lemma", "b").orderBy("document_id", "sentence_index"))).filter(F.col("r") <= per_lemma)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("lemma").orderBy("document_id", "sentence_index"))).filter(F.col("r") <= per_lemma).select("lemma", "document_id", "sentence_index", "r")


def against_reference(terms: DataFrame, reference: DataFrame, *, missing_as_zero: bool = False) -> DataFrame:
    """Terms beside a reference list of rates per million; absent terms are skipped, or zero on request.

    ``terms(term, frequency, per_million)``, ``reference(term, per_million)``.  The direction is
    ``over`` where the corpus rate is at least the reference's.
    """
    r = reference.groupBy("term").agg(F.sum("per_million").alias("reference_per_million"))
    j = terms.join(r, "term", "left" if missing_as_zero else "inner").na.fill(0.0, ["reference_per_million"])
    return j.withColumn("direction", F.when(F.col("per_million") >= F.col("reference_per_million"), "over").otherwise("under"))
