"""Tables behind the views of a corpus: lexical bundle, keyness and collocation panels, orders, audits, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import stats
from textloom.operators import lexical
from textloom.runtime import cut_lineage


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``df`` with its place in the order, from 1.

    Rows are range partitioned; the driver sees the number of rows of each range, nothing else.  Rows that
    are equal in ``order`` may change places.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, {}
    for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets[r["_part"]], before = before, before + r["n"]
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("_part")] if offsets else F.lit(0)
    return ranged.withColumn(name, (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + offset).cast("bigint")).drop("_part")


def lexical_bundle(tokens: DataFrame, *, pos: list[str], stopwords: list[str] | None = None, limits: dict[int, int] | None = None) -> DataFrame:
    """``n, ngram, frequency, per_million, document_frequency``: the most frequent content lemmas and their n-grams.

    N-grams end with a run of content words.  Rates are per million of all alphabetic tokens; ``limits`` has the number of
    rows by n; ties are broken by the term.  ``stopwords`` are left out beside the flagged ones.
    """
    once = tokens.dropDuplicates(["document_id", "token_index"])
    if stopwords:
        word = F.lower(F.coalesce(F.when(F.trim("lemma") != "", F.trim("lemma")), F.col("lower")))
        once = once.withColumn("is_stop", F.col("is_stop") | word.isin(stopwords))
    base = once.agg(F.count_if("is_alpha").alias("_n"))
    parts = []
    for n, limit in (limits or {1: 10_000, 2: 2_000, 3: 2_000}).items():
        rows = lexical.content_runs(once, pos=pos, n=n, min_frequency=1).orderBy(F.desc("frequency"), "ngram").limit(limit)
        parts.append(rows.select(F.lit(n).alias("n"), "ngram", "frequency", "document_frequency"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("_k", F.lit(1)).join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k")  # one row
    return every.select("n", "ngram", "frequency", stats.rate(F.col("frequency"), F.col("_n"), 1e6).alias("per_million"), "document_frequency")


def reference_keyness(terms: DataFrame, reference: DataFrame, *, target_total: Column, reference_total: float, missing_as_zero: bool = False, min_frequency: int = 1, min_documents: int = 1, direction: str = "all") -> DataFrame:
    """Keyness of ``terms(term, frequency, document_frequency)`` against ``reference(term, per_million)``.

    Reference counts are rebuilt from the rates.  Terms that the reference lacks are left out, or count 0 there with
    ``missing_as_zero``.  The log ratio is smoothed by 0.5 in 1 more of the denominator.
    """
    r = reference.groupBy("term").agg(F.sum("per_million").alias("reference_per_million"))
    j = terms.filter((F.col("frequency") >= min_frequency) & (F.col("document_frequency") >= min_documents)).join(r, "term", "left" if missing_as_zero else "inner").na.fill(0.0, ["reference_per_million"])
    k1, n1, n2 = F.col("frequency").cast("double"), target_total.cast("double"), F.lit(float(reference_total))
    k2 = F.col("reference_per_million") * n2 / 1e6
    j = j.withColumn("per_million", k1 / n1 * 1e6)
    j = j.withColumn("direction", F.when(F.col("per_million") >= F.col("reference_per_million"), "over").otherwise("under"))
    if direction != "all":
        j = j.filter(F.col("direction") == direction)
    ratio = F.log2(((k1 + 0.5) / (n1 + 1)) / ((k2 + 0.5) / (n2 + 1)))
    return j.select("term", "direction", "frequency", "document_frequency", "per_million", "reference_per_million", stats.log_likelihood(k1, n1, k2, n2).alias("log_likelihood"), ratio.alias("log_ratio"))


def keyness_table(keyness: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows by falling likelihood ratio, then by the size of the log ratio, then by term."""
    return keyness.orderBy(F.desc("log_likelihood"), F.desc(F.abs("log_ratio")), "term").limit(limit)


def collocation_panel(collocations: DataFrame, *, node: str, metric: str = "logdice", min_documents: int = 1, limit: int = 20) -> DataFrame:
    """The collocates of one node by falling metric, then documents, then name."""
    rows = collocations.filter((F.col("node") == node) & (F.col("document_frequency") >= min_documents))
    return rows.orderBy(F.desc(metric), F.desc("document_frequency"), "collocate").limit(limit)


def first_filled(*columns: str) -> Column:
    """The first of several columns that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def listed_order(records: DataFrame, listing: DataFrame, *, url: Column, listed_url: str, position: str, key: str) -> DataFrame:
    """``key, url, place``: the first position of the record's URL in the listing; unlisted ones follow in the order of ``key``."""
    first = listing.filter(F.col(listed_url).isNotNull()).groupBy(F.col(listed_url).alias("url")).agg(F.min(position).cast("bigint").alias("place"))
    j = cut_lineage(records.select(F.col(key), url.alias("url")).distinct().join(first, "url", "left"))
    last = j.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]  # one number
    rest = numbered(j.filter("place is null"), [F.col(key), F.col("url")], "n").select(key, "url", (F.col("n") - 1 + last).alias("place"))
    return j.filter("place is not null").select(key, "url", "place").unionByName(rest)


def without_stored_blob(records: DataFrame, stored: DataFrame, *, key: str, urls: list[str], stored_key: str, length: int = 20) -> DataFrame:
    """Records of which no candidate URL's digest is stored under ``stored_key``."""
    keys = F.filter(F.array(*[F.substring(F.sha2(F.col(u), 256), 1, length) for u in urls]), lambda x: x.isNotNull())
    wanted = records.select(key, F.explode_outer(F.array_distinct(keys)).alias("_h"))
    has = wanted.join(stored.select(F.col(stored_key).alias("_h")).distinct(), "_h", "left_semi").select(key).distinct()
    return records.select(key).distinct().join(has, key, "left_anti")


def page_audit(articles: DataFrame) -> DataFrame:
    """Measures of each page: words, paragraphs, images by role, captions and tags; one row per document."""
    x = articles.groupBy("document_id").agg(F.min_by(F.struct("body", "paragraphs", "images", "tags", "body_selector", "title"), F.struct("retrieved_at_utc", "collection_run_id")).alias("x")).select("document_id", "x.*")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    role = lambda r: size(F.filter("images", lambda i: i["image_role"] == r))
    squeezed = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)\s+", " "))
    words = F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))
    return x.select(
        "document_id",
        F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "failed").otherwise("ok").alias("status"),
        F.col("body_selector").isNotNull().alias("has_selector"),
        words.alias("word_count"),
        size(F.col("paragraphs")).alias("paragraph_count"),
        size(F.col("images")).alias("image_count"),
        role("hero").alias("hero_image_count"),
        role("inline").alias("inline_image_count"),
        size(F.filter("images", lambda i: F.coalesce(i["figcaption"], F.lit("")) != "")).alias("caption_count"),
        size(F.col("tags")).alias("tag_count"),
    )


def page_audit_summary(audit: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0))
    return audit.agg(F.count("*").alias("pages"), F.count_if("has_selector").alias("selector_present"), F.count_if(F.col("status") == "ok").alias("parsed_ok"), F.count_if(F.col("status") == "failed").alias("failed"), total("word_count").alias("total_words"), total("image_count").alias("total_images"), total("caption_count").alias("total_captions"))


def reextraction_difference(stored: DataFrame, extracted: DataFrame, *, key: str = "document_id") -> DataFrame:
    """``status`` (match, different, error, missing) and word counts of stored records ``(key, body)`` against ``(key, body, error)``."""
    j = stored.select(key, F.col("body").alias("old")).join(extracted.select(key, F.col("body").alias("new"), "error"), key, "left")
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    words = lambda c: F.when(plain(F.col(c)) == "", 0).otherwise(F.size(F.split(plain(F.col(c)), " ")))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("new").isNull(), "missing").when(plain(F.col("old")) == plain(F.col("new")), "match").otherwise("different")
    return j.select(key, status.alias("status"), words("old").alias("stored_words"), words("new").alias("extracted_words"), "error")


def cleaned(df: DataFrame, *, as_null: tuple[str, ...] = ("", "nan", "none", "null", "n/a")) -> DataFrame:
    """NaN numbers and strings that stand for nothing become null; other columns stay."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(~F.lower(F.trim(c)).isin(*as_null), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def with_defaults(df: DataFrame, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """``fields`` name -> (type, default): each cast, with the default for null, absent or unreadable values."""
    have = set(df.columns)
    return df.select(*[F.coalesce(F.col(n).try_cast(t) if n in have else F.lit(None).cast(t), F.lit(v).cast(t)).alias(n) for n, (t, v) in fields.items()])


def string_fields(df: DataFrame, *, key: str, prefix: str = "") -> DataFrame:
    """``key, path, value`` of every string in the record, in nested structs and arrays too (arrays as ``path[]``)."""

    def walk(c: Column, t: T.DataType, path: str) -> list[Column]:
        if isinstance(t, T.StringType):
            return [F.when(c.isNotNull(), F.array(F.struct(F.lit(path).alias("path"), c.alias("value"))))]
        if isinstance(t, T.StructType):
            return [x for f in t for x in walk(c[f.name], f.dataType, f"{path}.{f.name}")]
        if isinstance(t, T.ArrayType):
            inner = walk(F.lit(None).cast(t.elementType), t.elementType, path)
            if inner:
                none = F.array().cast("array<struct<path:string,value:string>>")
                return [F.flatten(F.transform(c, lambda x: F.flatten(F.array(*[F.coalesce(w, none) for w in walk(x, t.elementType, f"{path}[]")]))))]
        return []

    none = F.array().cast("array<struct<path:string,value:string>>")
    found = [x for f in df.schema if f.name != key for x in walk(F.col(f.name), f.dataType, f"{prefix}{f.name}")]
    return df.select(F.col(key), F.explode(F.flatten(F.array(*[F.coalesce(x, none) for x in found] or [none]))).alias("f")).select(key, "f.path", "f.value")


def record_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Digest of the record as compact JSON with its columns in order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def id_column(df: DataFrame, candidates: tuple[str, ...] = ("document_id", "doc_id", "id", "article_id", "url")) -> str | None:
    """The first candidate that is a column."""
    return next((c for c in candidates if c in df.columns), None)


def enough(df: DataFrame, minimum: int) -> bool:
    """Whether there are at least ``minimum`` rows; reads no more than it needs."""
    return df.limit(minimum).count() >= minimum


def min_max_scaled(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """The column moved to 0 to 1 by its least and greatest value; 0 where all are equal."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")).withColumn("_k", F.lit(1))
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")  # one row
    return j.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce(F.try_divide((F.col(column) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double")), F.lit(0.0)))).drop("_k", "_lo", "_hi")


def observed(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts as it runs: ``rows`` and the given aggregates, read from the observation afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()]), seen


# ---- filters and audits of records


def document_filter(df: DataFrame, *, text: str | None = None, year: int | None = None, author: str | None = None, tag: str | None = None, date_flag: str | None = None, has_image: bool | None = None, words: tuple[int, int | None] = (0, None)) -> DataFrame:
    """Rows of ``(id, title, author, tags, year, date_flag, image_count, word_count)`` that keep all given conditions.

    ``text`` is looked for in title, author, tags and id without regard to case; ``date_flag`` ``issue`` is any but ``ok``.
    """
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), "id"))
    conditions = [F.col("word_count") >= words[0]]
    if words[1] is not None:
        conditions.append(F.col("word_count") <= words[1])
    if text:
        conditions.append(hay.contains(text.strip().lower()))
    if year is not None:
        conditions.append(F.col("year") == year)
    if author:
        conditions.append(F.col("author") == author)
    if tag:
        conditions.append(F.array_contains("tags", tag))
    if date_flag:
        conditions.append(F.col("date_flag") != "ok" if date_flag == "issue" else F.col("date_flag") == date_flag)
    if has_image is not None:
        conditions.append(F.col("image_count") > 0 if has_image else F.col("image_count") == 0)
    out = df
    for c in conditions:
        out = out.filter(c)
    return out


def review_filter(queue: DataFrame, documents: DataFrame | None = None, *, category: str | None = None, status: str | None = None, quoted_only: bool = False, text: str | None = None) -> DataFrame:
    """Rows of a review queue by category, status, quotation or reported speech, and free text over its own and its document's fields."""
    j = queue if documents is None else queue.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id", "left")
    if category:
        j = j.filter(F.col("category") == category)
    if status:
        j = j.filter(F.col("status") == status)
    if quoted_only:
        j = j.filter(F.coalesce("quotation_flag", F.lit(False)) | F.coalesce("reported_speech_flag", F.lit(False)))
    if text:
        fields = [c for c in ("sentence", "context", "surface_form", "category", "document_id", "document_title") if c in j.columns]
        j = j.filter(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in fields])).contains(text.strip().lower()))
    return j


def split_by(df: DataFrame, condition: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that keep the condition, the others with ``reject_reason``); a null condition rejects."""
    keeps = F.coalesce(condition, F.lit(False))
    return df.filter(keeps), df.filter(~keeps).withColumn("reject_reason", reason)


# Endings of files that can run.
RUNNABLE = ".exe .dll .scr .com .bat .cmd .ps1 .psm1 .vbs .vbe .js .jse .jar .msi .msp .hta .apk .dmg .pkg .iso .img .lnk .reg .docm .xlsm .pptm .xlam .xll .sh .bash .zsh .ksh .pyc .so".split()
# What the first 16 bytes of a file may hold, as hexadecimal digits.
MAGIC = ("4D5A", "7F454C46", "504B0304", "25504446", "89504E47")


def url_facts(df: DataFrame, *, url: str) -> DataFrame:
    """``url, scheme, hostname, extension, is_runnable`` of each URL, without what ends a sentence."""
    u = df.select(F.regexp_replace(url, r"[.,;:!?)\]}]+$", "").alias("url")).filter("url is not null")
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1))
    extension = F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return u.select("url", F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"), F.when(host != "", host).alias("hostname"), extension.alias("extension"), extension.isin(RUNNABLE).alias("is_runnable"))


def plausible_base64(blob: Column) -> Column:
    """Whether a run of base64 is likely data: it decodes to 64 bytes or more, and they are hardly text or begin like a known file."""
    compact = F.regexp_replace(blob, r"\s+", "")
    digits = F.hex(F.try_to_binary(compact, F.lit("base64")))
    size = F.length(digits) / 2
    # A byte is two digits; those of printable characters, tabs and line ends are taken away.
    plain = F.regexp_count(F.regexp_replace(digits, "(..)", "$1 "), F.lit(r"(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D) "))
    start = F.regexp_replace(F.substring(digits, 1, 32), "(..)", "$1 ")
    magic = F.lit(False)
    for m in MAGIC:
        magic = magic | start.contains(" ".join(m[i : i + 2] for i in range(0, len(m), 2)))
    likely = (plain / F.greatest(F.lit(1.0), size) < 0.98) | magic
    return F.coalesce((F.length(compact) >= 128) & (F.length(compact) % 4 == 0) & (size >= 64) & likely, F.lit(False))


def examples_per_group(df: DataFrame, *, group: str, order: list[Column], n: int = 3) -> DataFrame:
    """The first ``n`` rows of each group; a block of each group first, so that no group is sorted in one task."""
    block = F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), F.lit(64))
    first = df.withColumn("_b", block).withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order))).filter(F.col("_r") <= n)
    return first.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("r") <= n).drop("_b", "_r")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def html_escaped(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return out


def without_prefixes(totals: DataFrame, *, name: str = "marker", prefixes: tuple[str, ...] = ("frame_", "legitimation_"), order: list[Column] | None = None, limit: int = 14) -> DataFrame:
    """The first rows whose name has none of the prefixes."""
    out = totals
    for p in prefixes:
        out = out.filter(~F.col(name).startswith(p))
    return out.orderBy(*(order or [F.desc("total"), F.col(name)])).limit(limit)


def pages_until_empty(pages: DataFrame, *, listing: str, page: str, found: str, empty: int = 2) -> DataFrame:
    """The pages of each listing up to and including the ``empty``-th page in a row on which nothing was found."""
    w = Window.partitionBy(listing).orderBy(page)
    run = F.lit(True)
    for i in range(empty):
        run = run & (F.lag(found, i).over(w) == 0)
    # A stop counts for the pages behind it.
    stopped = pages.withColumn("_stop", F.coalesce(run, F.lit(False)).cast("int"))
    before = F.coalesce(F.sum("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stopped.withColumn("_before", before).filter("_before = 0").drop("_stop", "_before")


def scores_json(names: Column, scores: Column) -> Column:
    """Scores by name as a JSON object; null names are left out."""
    pairs = F.filter(F.arrays_zip(names.alias("n"), scores.alias("s")), lambda x: x["n"].isNotNull())
    return F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["n"], x["s"]))))
