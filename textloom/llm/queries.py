"""Registry of the queries of this subpackage: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import cooccurrence, language, near_duplicates, packing, reading_level, repeated_lines, tokenizer, wrapper
from textloom.runtime import cut_lineage, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# ---- 1: items that appear together

_P1 = r"""
with tagged as (select distinct 'tags' as kind, cast(doc_id as varchar) as record, lower(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as item
    from (select doc_id, unnest(string_split(tags, '|')) as t from documents)),
framed as (select distinct 'frame' as kind, sentence_id as record, lower(regexp_replace(frame, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as item from frame_candidates),
r as (select * from (select * from tagged union all select * from framed) where record is not null and item is not null and item not in ('', 'nan')),
n as (select kind, count(distinct record) as n from r group by kind),
s as (select kind, item, count(*) as m from r group by kind, item),
p as (select a.kind, a.item as item_1, b.item as item_2, count(*) as n12 from r a join r b on a.kind = b.kind and a.record = b.record and a.item < b.item group by 1, 2, 3),
q as (select p.*, s1.m as n1, s2.m as n2, n.n from p join s s1 on s1.kind = p.kind and s1.item = p.item_1 join s s2 on s2.kind = p.kind and s2.item = p.item_2 join n on n.kind = p.kind)
"""


def _item_records(spark: SparkSession, d: str) -> DataFrame:
    tags = load(spark, d, "documents").select("doc_id", F.explode(F.split("tags", r"\|")).alias("tag"))
    a = cooccurrence.item_records(tags, kind="tags", record="doc_id", item=F.col("tag"))
    b = cooccurrence.item_records(load(spark, d, "frame_candidates"), kind="frame", record="sentence_id", item=F.col("frame"))
    return a.unionByName(b)


@query("p1_found", _P1 + "select kind as item_kind, item_1, item_2 from q where n12 >= 8 and n12 * n >= 2.5 * n1 * n2")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.significant(cooccurrence.cooccurrence(_item_records(spark, d)))
    return pairs.select(F.col("kind").alias("item_kind"), "item_1", "item_2")


@query("p1_pairs", _P1 + """select kind as item_kind, item_1, item_2, cast(n12 as bigint) as n12, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, cast(n as bigint) as n, round(n12 * n::double / (n1 * n2::double), 6) as lift,
 round(2 * (n12 * ln(n12 * n::double / (n1 * n2::double)) + case when n1 > n12 then (n1 - n12) * ln((n1 - n12) * n::double / (n1 * (n - n2)::double)) else 0 end
  + case when n2 > n12 then (n2 - n12) * ln((n2 - n12) * n::double / ((n - n1) * n2::double)) else 0 end
  + case when n - n1 - n2 + n12 > 0 then (n - n1 - n2 + n12) * ln((n - n1 - n2 + n12) * n::double / ((n - n1) * (n - n2)::double)) else 0 end), 4) as llr from q""")  # fmt: skip
def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.cooccurrence(_item_records(spark, d))
    return pairs.select(F.col("kind").alias("item_kind"), "item_1", "item_2", "n12", "n1", "n2", "n", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr"))


# ---- 2: near-duplicate records


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    texts = cut_lineage(wrapper.main_text(load(spark, d, "articles")).select("document_id", "text"))
    return near_duplicates.near_duplicates(texts, record="document_id", text="text")


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicates.linked_records(*_near(spark, d))
    return pairs.select(F.col("id_1").alias("document_id_1"), F.col("id_2").alias("document_id_2"))


@query("p2_classes")
def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.classes_with_links(*_near(spark, d)).withColumnRenamed("id", "document_id")


# ---- 3: page boilerplate


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wrapper.furniture_lines(load(spark, d, "articles"))


@query("p3_wrappers")
def p3_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return wrapper.host_wrappers(load(spark, d, "articles"))


@query("p3_main_text")
def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return wrapper.main_text(load(spark, d, "articles"))


# ---- 4: reading level


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts = cut_lineage(wrapper.main_text(load(spark, d, "articles")).select("document_id", "text"))
    levels = reading_level.reading_levels(texts, load(spark, d, "reading_labels"), record="document_id", text="text")
    return levels.select(F.col("id").alias("document_id"), "band")


# ---- 5: lines repeated across one site's documents

_P5 = r"""
with a as (select document_id, min(body) as body, min(regexp_replace(regexp_extract(lower(final_url), '^[a-z][a-z0-9+.\-]*://([^/:?#]+)', 1), '^www\.', '')) as site from articles group by document_id),
b as (select document_id, site, string_split(body, chr(10)) as ls from a),
c as (select document_id, site, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as line_no from b),
k as (select document_id, site, line_no, regexp_replace(lower(trim(regexp_replace(line, '[\s\p{Z}]+', ' ', 'g'))), '\d+', '0', 'g') as k from c),
f as (select site, k from k where k <> '' group by site, k having count(distinct document_id) >= 8)
"""


@query("p5_found", _P5 + "select document_id, cast(line_no as integer) as line_no from k join f using (site, k)")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_occurrences(load(spark, d, "articles")).select("document_id", "line_no")


@query("p5_sequences", _P5 + """, q as (select document_id, site, list(k order by line_no) as ks from k join f using (site, k) group by 1, 2),
i as (select document_id, site, ks, unnest(range(1, len(ks) + 1)) as a from q), s as (select document_id, site, ks, a, unnest(range(a, len(ks) + 1)) as b from i),
o as (select document_id, site, ks[a:b] as p from s)
select len(p) as length, md5(site || chr(10) || array_to_string(p, chr(10))) as pattern, count(distinct document_id) as documents, count(*) as occurrences from o group by site, p having count(distinct document_id) >= 8""")  # fmt: skip
def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Frequent sequences of a site; ``pattern`` is the digest of the site and its lines' keys."""
    articles = load(spark, d, "articles")
    found = repeated_lines.frequent_sequences(articles).withColumn("n", F.monotonically_increasing_id())
    found = cut_lineage(found)
    at = found.select("n", F.posexplode("pattern").alias("at", "id"))
    keys = at.join(repeated_lines.line_names(articles), "id").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("at", "site", "key"))).alias("k"))
    digest = F.md5(F.concat_ws("\n", F.col("k")[0]["site"], F.array_join(F.transform("k", lambda x: x["key"]), "\n")))
    return found.join(keys, "n").select(F.col("length").cast("bigint").alias("length"), digest.alias("pattern"), "documents", "occurrences")


@query("p5_clean", _P5 + """, r as (select document_id, body, paragraphs, regexp_replace(regexp_extract(lower(final_url), '^[a-z][a-z0-9+.\\-]*://([^/:?#]+)', 1), '^www\\.', '') as site,
 row_number() over (partition by document_id order by body, paragraphs nulls first) as n from articles where document_id is not null),
l as (select document_id, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as line_no from r where n = 1 and body is not null),
g as (select document_id, line_no from k join f using (site, k)),
kept as (select document_id, string_agg(line, chr(10) order by line_no) filter (where g.line_no is null) as body, count(g.line_no) as gone from l left join g using (document_id, line_no) group by document_id),
pp as (select document_id, site, unnest(paragraphs) as p, unnest(range(1, len(paragraphs) + 1)) as i from r where n = 1),
pk as (select document_id, site, p, i, regexp_replace(lower(trim(regexp_replace(p, '[\\s\\p{Z}]+', ' ', 'g'))), '\\d+', '0', 'g') as k from pp),
ids as (select distinct document_id, site, k from k join f using (site, k)),
pl as (select document_id, list(p order by i) filter (where ids.k is null) as ps, count(ids.k) as n_gone from pk left join ids using (document_id, site, k) group by document_id)
select r.document_id, case when r.body is not null then coalesce(kept.body, '') end as body, case when r.paragraphs is null then null else coalesce(pl.ps, []) end as paragraphs,
 cast(coalesce(kept.gone, 0) as integer) as n_removed_lines, cast(case when r.paragraphs is not null then coalesce(pl.n_gone, 0) end as integer) as n_removed_paragraphs
from r left join kept using (document_id) left join pl using (document_id) where r.n = 1""")  # fmt: skip
def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(load(spark, d, "articles"))


# ---- 8 and 9: tokens of a public tokenizer, and containers of them


@query("p8_ids")
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(load(spark, d, "documents"))


@query("p9_containers")
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenizer.token_counts(load(spark, d, "documents"))
    filled = packing.fill_containers(sizes, item="doc_id", size="n_tokens", capacity=2048)
    return filled.select("container_id", F.col("item").cast("bigint").alias("doc_id"), "part", "first_token", "n_tokens")


# ---- 10: language of documents and lines


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    cases = language.language_cases(language.language_segments(load(spark, d, "documents")))
    return cases.select(F.col("key").cast("bigint").alias("doc_id"), "line_no", "lang")


@query("p10_segments")
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    s = language.language_segments(load(spark, d, "documents"))
    return s.select(F.col("key").cast("bigint").alias("doc_id"), "line_no", "lang", F.round("confidence", 4).alias("confidence"), "n_languages")
