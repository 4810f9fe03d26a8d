"""Reference frequency lists in several public layouts -> ``term, per_million`` (or ``count``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import first_number

TERM_HEADERS = ["term", "lemma", "word", "type", "item", "headword"]
RATE_HEADERS = ["per_million", "pmw", "frequency_per_million", "freq_per_million", "ipm", "rate"]
COUNT_HEADERS = ["count", "frequency", "freq", "raw_frequency", "n"]
CONTENT_POS = ["NoC", "NoP", "Verb", "Adj", "Adv"]


def list_term(raw: Column) -> Column:
    """Lower-case single word without decorations (``*``, ``#``, quotes); null for several words or none."""
    t = F.lower(F.trim(F.regexp_replace(raw, r"[*#\"“”]+", "")))
    return F.when((t != "") & ~t.rlike(r"\s"), t)


def layout(first_line: str) -> str:
    """Which layout a list's first line shows."""
    cells = first_line.split("\t")
    lowered = [c.strip().lower() for c in cells]
    if len(cells) >= 3 and {"word", "pos"} <= set(lowered):
        return "word_pos_rate"
    if any(h in TERM_HEADERS for h in lowered) or any(h.strip().lower() in TERM_HEADERS for h in first_line.split(",")):
        return "header"
    bits = first_line.split()
    if len(bits) == 4 and bits[0].isdigit() and bits[1].replace(",", "").isdigit():
        return "rank_count_lemma_pos"
    if len(bits) == 2 and bits[0].replace(",", "").isdigit():
        return "count_word"
    return "tabbed_third_column"


def read_list(spark: SparkSession, path: str, *, content_only: bool = False, corpus_tokens: float | None = None) -> DataFrame:
    """``term, per_million`` summed by term; counts become rates where the size of their corpus is given.

    A list of counts without a size has a null rate, which ``prepared`` refuses.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    first = lines.first()
    kind = layout(first["value"]) if first else "header"
    if kind == "header":
        sep = "\t" if first and "\t" in first["value"] else ","
        df = spark.read.option("header", True).option("sep", sep).csv(path)
        names = {c.strip().lower(): c for c in df.columns}
        pick = lambda wanted: next((F.col(f"`{names[w]}`") for w in wanted if w in names), None)
        term, rate, count = pick(TERM_HEADERS), pick(RATE_HEADERS), pick(COUNT_HEADERS)
        rows = df.select(list_term(term).alias("term"), (first_number(rate) if rate is not None else F.lit(None).cast("double")).alias("pm"), (first_number(count) if count is not None else F.lit(None).cast("double")).alias("k"))
    else:
        tabs, blanks = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
        if kind == "word_pos_rate":  # a row that lost its leading cell is one cell short
            n = len(first["value"].split("\t"))
            cells = F.when((F.size(tabs) == n - 1) & (F.get(tabs, F.lit(0)) != ""), F.concat(F.array(F.lit("")), tabs)).otherwise(tabs)
            low = [c.strip().lower() for c in first["value"].split("\t")]
            w, p = low.index("word"), low.index("pos")
            f = next((i for i, c in enumerate(low) if c.startswith("fr")), len(low) - 1)
            rows = lines.filter(F.col("value") != first["value"]).withColumn("c", cells).filter(F.get("c", F.lit(w)) != "@")
            if content_only:
                rows = rows.filter(F.get("c", F.lit(p)).isin(*CONTENT_POS))
            rows = rows.select(list_term(F.get("c", F.lit(w))).alias("term"), first_number(F.get("c", F.lit(f))).alias("pm"), F.lit(None).cast("double").alias("k"))
        elif kind == "rank_count_lemma_pos":
            rows = lines.select(list_term(F.get(blanks, F.lit(2))).alias("term"), F.lit(None).cast("double").alias("pm"), first_number(F.get(blanks, F.lit(1))).alias("k"))
        elif kind == "count_word":
            rows = lines.select(list_term(F.get(blanks, F.lit(1))).alias("term"), F.lit(None).cast("double").alias("pm"), first_number(F.get(blanks, F.lit(0))).alias("k"))
        else:
            rows = lines.select(list_term(F.get(tabs, F.lit(0))).alias("term"), first_number(F.get(tabs, F.lit(2))).alias("pm"), F.lit(None).cast("double").alias("k"))
    size = F.lit(corpus_tokens).cast("double")
    rows = rows.select("term", F.coalesce("pm", F.col("k") * 1e6 / size).alias("per_million"), F.col("k").alias("count")).filter("term is not null and (per_million is not null or count is not null)")
    return rows.groupBy("term").agg(F.sum("per_million").alias("per_million"), F.sum("count").alias("count"))


def prepared(lists: DataFrame) -> DataFrame:
    """``term, per_million`` with six decimals, by term; a list on a count basis is refused."""
    if not lists.filter("per_million is null").isEmpty():
        raise ValueError("the list holds counts; give the size of its corpus")
    return lists.select("term", F.round("per_million", 6).alias("per_million")).orderBy("term")
