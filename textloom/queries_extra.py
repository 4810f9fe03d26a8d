"""Further queries of the registry: digests, filters with rejects, review candidates, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import text, urls
from textloom.operators import images, lexical, quality, temporal
from textloom.queries_core import query
from textloom.queries_text import _KEY, _NODES, NODES, TOKS, _keyness
from textloom.runtime import load
from textloom.streaming import logs


@query("text_digests", "select doc_id, sha256(text) as sha256, sha1(text) as sha1, md5(text) as md5 from documents where text is not null")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


@query("record_digests", "select vec_id, sha256(vec_id || '|' || coalesce(cast(label as varchar), '') || '|' || coalesce(array_to_string(list_transform(embedding, lambda x: cast(cast(round(cast(x as double) * 1000000) as bigint) as varchar)), ','), '')) as digest from embeddings")
def record_digests(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.sha2(F.concat(F.col("vec_id").cast("string"), F.lit("|"), F.coalesce(F.col("label").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string")), ","), F.lit(""))), 256).alias("digest"))


@query("order_date_quality", "select case when o_orderdate is null then 'missing' when o_orderdate > timestamp '1997-01-01' then 'future' else 'ok' end as flag, count(*) as n from orders group by 1")
def order_date_quality(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.groupBy(temporal.date_quality("o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).alias("flag")).agg(F.count("*").alias("n"))


@query("image_filter_reasons", """select case when mime_type is null or mime_type not like 'image/%' then 'not_an_image' when width is null or height is null then 'unknown_size' when width between 1 and 80 and height between 1 and 80 then 'decorative' else 'kept' end as reason,
 count(distinct image_id) as n_images from images group by 1""")  # fmt: skip
def image_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    small = F.col("width").between(1, 80) & F.col("height").between(1, 80)
    reason = F.when(F.col("mime_type").isNull() | ~F.col("mime_type").startswith("image/"), "not_an_image").when(F.col("width").isNull() | F.col("height").isNull(), "unknown_size").when(small, "decorative").otherwise("kept")
    return load(spark, d, "images").groupBy(reason.alias("reason")).agg(F.count_distinct("image_id").alias("n_images"))


@query("image_extensions", r"""with i as (select distinct image_id, mime_type as m, regexp_extract(lower(regexp_extract(final_url, '://[^/?#]*([^?#]*)', 1)), '\.(?:jpg|jpeg|png|gif|webp|avif|svg)$') as e from images)
select coalesce(case m when 'image/jpeg' then '.jpg' when 'image/png' then '.png' when 'image/gif' then '.gif' when 'image/webp' then '.webp' when 'image/svg+xml' then '.svg' when 'image/avif' then '.avif' end, nullif(e, ''),
 case m when 'image/bmp' then '.bmp' when 'image/tiff' then '.tiff' when 'image/x-icon' then '.ico' when 'image/vnd.microsoft.icon' then '.ico' when 'image/heic' then '.heic' end, '.img') as extension, count(*) as n from (select distinct image_id, m, e from i) group by 1""")  # fmt: skip
def image_extensions(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").select("image_id", "mime_type", "final_url").distinct()
    i = i.select("image_id", "mime_type", F.lower(F.regexp_extract(F.lower(urls.path(F.col("final_url"))), urls.PATH_EXTENSION, 0)).alias("e"), urls.image_extension(F.col("mime_type"), F.col("final_url")).alias("extension")).distinct()
    return i.groupBy("extension").agg(F.count("*").alias("n"))


@query("new_urls_by_run", "with r as (select collection_run_id, row_number() over (partition by final_url order by retrieved_at_utc, collection_run_id) as r from articles) select collection_run_id, count(*) filter (where r = 1) as n_new from r group by 1")
def new_urls_by_run(spark: SparkSession, d: str) -> DataFrame:
    return images.per_listing_new(load(spark, d, "articles"), url="final_url", page="collection_run_id", order=["retrieved_at_utc", "collection_run_id"])


@query("pending_urls", "select distinct article_url as url from images where article_url is not null and article_url not in (select final_url from articles where final_url is not null union all select request_url from articles where request_url is not null)")
def pending_urls(spark: SparkSession, d: str) -> DataFrame:
    seen = load(spark, d, "images").select(F.col("article_url").alias("url")).filter("url is not null").distinct()
    return logs.resume(seen, load(spark, d, "articles"))


@query("capture_completeness", "select count(distinct request_url) as n_requested, count(distinct final_url) as n_final, count(distinct raw_html_path) as n_stored, count(distinct request_url) - count(distinct raw_html_path) as n_short from articles")
def capture_completeness(spark: SparkSession, d: str) -> DataFrame:
    a = {n: F.count_distinct(c) for n, c in (("n_requested", "request_url"), ("n_final", "final_url"), ("n_stored", "raw_html_path"))}
    return load(spark, d, "articles").agg(*[v.alias(k) for k, v in a.items()], (a["n_requested"] - a["n_stored"]).alias("n_short"))


@query("length_scales", "select doc_id, round(ln(1 + length(coalesce(text, ''))), 6) as log_length, round(sqrt(length(coalesce(text, ''))), 6) as root_length from documents")
def length_scales(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return load(spark, d, "documents").select("doc_id", F.round(F.log1p(n), 6).alias("log_length"), F.round(F.sqrt(n), 6).alias("root_length"))


@query("keyness_topk", _KEY + """select term, round(g2, 4) as log_likelihood, round(log2(((k1 + 0.5) / (n1 + 0.5)) / ((k2 + 0.5) / (n2 + 0.5))), 6) as log_ratio from s
 where log2(((k1 + 0.5) / (n1 + 0.5)) / ((k2 + 0.5) / (n2 + 0.5))) > 0 order by round(log_ratio, 6) desc, round(log_likelihood, 4) desc, term limit 100""")  # fmt: skip
def keyness_topk(spark: SparkSession, d: str) -> DataFrame:
    k = _keyness(spark, d).filter("log_ratio > 0").select("term", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("log_ratio", 6).alias("log_ratio"))
    return k.orderBy(F.desc("log_ratio"), F.desc("log_likelihood"), "term").limit(100)


@query("candidate_queue", _KEY + f""", kt as (select term as form, 1 as src, row_number() over (order by round(log2(((k1 + 0.5) / (n1 + 0.5)) / ((k2 + 0.5) / (n2 + 0.5))), 6) desc, round(g2, 4) desc, term) as rank from s where log2(((k1 + 0.5) / (n1 + 0.5)) / ((k2 + 0.5) / (n2 + 0.5))) > 0),
d2 as (select doc_id, toks from d), a as (select doc_id, toks, i, toks[i] as node from (select doc_id, toks, unnest(range(1, len(toks) + 1)) as i from d2 where list_has_any(toks, [{_NODES}])) where toks[i] in ({_NODES})),
w as (select doc_id, node, unnest(list_filter(list_concat(toks[greatest(i - 5, 1):i - 1], toks[i + 1:i + 5]), lambda x: length(x) > 1)) as collocate from a),
p as (select node, collocate, count(*) as f from w group by 1, 2 having count(*) >= 5), tt as (select unnest(toks) as t from d2), cnt as (select t, count(*) as f from tt group by t),
ct as (select collocate as form, 2 as src, row_number() over (order by round(14 + log2(2.0 * p.f / (cn.f + cc.f)), 6) desc, p.f desc, node, collocate) as rank from p join cnt cn on cn.t = node join cnt cc on cc.t = collocate),
q as (select * from kt where rank <= 100 union all select * from ct where rank <= 100), fin as (select *, row_number() over (partition by form order by src, rank) as r from q)
select form, case src when 1 then 'keyness' else 'collocation' end as source_table, cast(rank as integer) as rank, 'unreviewed_candidate' as validation_status from fin where r = 1""")  # fmt: skip
def candidate_queue(spark: SparkSession, d: str) -> DataFrame:
    """Forms from two tables, keyness rows first; a form keeps its first row."""
    k = _keyness(spark, d).filter("log_ratio > 0").select(F.col("term").alias("form"), F.round("log_ratio", 6).alias("a"), F.round("log_likelihood", 4).alias("b"))
    c = lexical.collocations(load(spark, d, "documents"), record="doc_id", body="text", nodes=NODES).withColumn("logdice", F.round("logdice", 6))
    top_k = k.orderBy(F.desc("a"), F.desc("b"), "form").limit(100)
    top_c = c.orderBy(F.desc("logdice"), F.desc("cooccurrence_frequency"), "node", "collocate").limit(100)
    k = top_k.select("form", F.lit(1).alias("src"), F.row_number().over(Window.orderBy(F.desc("a"), F.desc("b"), "form")).alias("rank"))  # 100 rows
    c = top_c.select(F.col("collocate").alias("form"), F.lit(2).alias("src"), F.row_number().over(Window.orderBy(F.desc("logdice"), F.desc("cooccurrence_frequency"), "node", "collocate")).alias("rank"))
    first = k.unionByName(c).groupBy("form").agg(F.min(F.struct("src", "rank")).alias("m"))
    return first.select("form", F.when(F.col("m.src") == 1, "keyness").otherwise("collocation").alias("source_table"), F.col("m.rank").alias("rank"), F.lit("unreviewed_candidate").alias("validation_status"))


@query("vocabulary_overlap", f"""{TOKS}, e as (select distinct source is not distinct from 'tavrin-courier' as target, t from (select source, unnest(toks) as t from d)), g as (select t, bool_or(target) as a, bool_or(not target) as b from e group by t)
select count(*) as n_union, count(*) filter (where a and b) as n_both, count(*) filter (where a and not b) as n_first_only, count(*) filter (where b and not a) as n_second_only from g""")  # fmt: skip
def vocabulary_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").select(F.col("source").eqNullSafe(F.lit("tavrin-courier")).alias("target"), F.explode(text.tokens(F.col("text"))).alias("t"))
    g = t.groupBy("t").agg(F.bool_or("target").alias("a"), F.bool_or(~F.col("target")).alias("b"))
    return g.agg(F.count("*").alias("n_union"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") & ~F.col("b")).alias("n_first_only"), F.count_if(F.col("b") & ~F.col("a")).alias("n_second_only"))


@query("match_forms", "select doc_id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) as match_form from documents")
def match_forms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", text.match_form(F.coalesce("title", F.lit(""))).alias("match_form"))


@query("first_examples_per_status", "with r as (select http_status, document_id, row_number() over (partition by http_status order by document_id, retrieved_at_utc) as r from articles) select http_status, document_id, cast(r as integer) as r from r where r <= 5")
def first_examples_per_status(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_examples(load(spark, d, "articles"), category="http_status", order=["document_id", "retrieved_at_utc"], cap=5).select("http_status", "document_id", "r")


@query("redirect_lengths", "select len(redirect_chain) as n_redirects, count(*) as n_rows from articles group by 1")
def redirect_lengths(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "articles").groupBy(F.when(F.col("redirect_chain").isNotNull(), F.size("redirect_chain")).cast("bigint").alias("n_redirects")).agg(F.count("*").alias("n_rows"))


@query("paragraph_positions", "with p as (select document_id, min(paragraphs) as p from articles group by document_id) select document_id, cast(unnest(range(0, len(p))) as integer) as position, sha256(unnest(p)) as paragraph_sha256 from p")
def paragraph_positions(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "articles").groupBy("document_id").agg(F.min("paragraphs").alias("p"))
    return p.select("document_id", F.posexplode("p").alias("position", "x")).select("document_id", "position", F.sha2("x", 256).alias("paragraph_sha256"))
