"""Table queries of the registry: audits, metadata, images, series, review, vectors, joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import stats, text, urls
from textloom.operators import discourse, explore, html, images, lexical, quality, similarity, temporal, vectors
from textloom.queries_core import query
from textloom.queries_text import CONTENT, tok
from textloom.runtime import cut_lineage, load

# ---- audits


@query("article_rule_violations", r"""select document_id as record, unnest(list_filter([case when not coalesce(regexp_matches(document_id, '^[a-f0-9]{20}$'), false) then 'document_id_hex20' end,
 case when not coalesce(length(title) >= 1, false) then 'title_not_empty' end, case when not coalesce(length(body) >= 20, false) then 'body_min_20' end, case when not coalesce(word_count >= 1, false) then 'word_count_min_1' end,
 case when not coalesce(regexp_matches(raw_payload_sha256, '^[a-f0-9]{64}$'), false) then 'raw_sha256_hex' end, case when not coalesce(regexp_matches(derived_text_sha256, '^[a-f0-9]{64}$'), false) then 'derived_sha256_hex' end,
 case when not coalesce(not comments_collected, false) then 'no_comments' end, case when not coalesce(email_redactions >= 0, false) then 'email_redactions_min_0' end], lambda x: x is not null)) as rule from articles""")  # fmt: skip
def article_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.rule_violations(load(spark, d, "articles"), record="document_id", rules=quality.article_rules())


@query("image_rule_violations", r"""select image_id as record, unnest(list_filter([case when not coalesce(regexp_matches(document_id, '^[a-f0-9]{20}$'), false) then 'document_id_hex20' end,
 case when not coalesce(regexp_matches(mime_type, '^image/'), false) then 'mime_is_image' end, case when not coalesce(byte_count >= 1, false) then 'byte_count_min_1' end,
 case when not (image_role is null or image_role in ('hero', 'inline')) then 'role_known' end, case when not (dom_index is null or dom_index >= 1) then 'dom_index_min_1' end], lambda x: x is not null)) as rule from images""")  # fmt: skip
def image_rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.rule_violations(load(spark, d, "images"), record="image_id", rules=quality.image_rules())


@query("duplicate_key_report", " union all ".join(f"select '{k}' as key_name, count(*) as n_keys, cast(coalesce(sum(c - 1), 0) as bigint) as surplus_rows from (select {k}, count(*) as c from articles where {k} is not null group by {k} having count(*) > 1)" for k in ("document_id", "final_url", "derived_text_sha256")))
def duplicate_key_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(load(spark, d, "articles"), ["document_id", "final_url", "derived_text_sha256"])


@query("images_of_unknown_articles", "select distinct image_id, document_id from images where document_id not in (select document_id from articles where document_id is not null)")
def images_of_unknown_articles(spark: SparkSession, d: str) -> DataFrame:
    return quality.unknown_references(load(spark, d, "images"), load(spark, d, "articles"), key="document_id").select("image_id", "document_id").distinct()


@query("articles_without_image_rows", "select distinct document_id from articles a where not exists (select 1 from images i where i.document_id = a.document_id)")
def articles_without_image_rows(spark: SparkSession, d: str) -> DataFrame:
    return quality.unknown_references(load(spark, d, "articles"), load(spark, d, "images"), key="document_id").select("document_id").distinct()


@query("image_reference_audit", """with e as (select document_id, unnest(images) as i from articles), r as (select distinct document_id, i.image_id as image_id from e)
select count(*) as n_references, count(*) filter (where m.image_id is null) as n_missing from r left join (select distinct image_id from images) m using (image_id)""")  # fmt: skip
def image_reference_audit(spark: SparkSession, d: str) -> DataFrame:
    refs = load(spark, d, "articles").select("document_id", F.explode("images.image_id").alias("image_id")).distinct()
    known = load(spark, d, "images").select("image_id").distinct().withColumn("known", F.lit(True))
    return refs.join(known, "image_id", "left").agg(F.count("*").alias("n_references"), F.count_if(F.col("known").isNull()).alias("n_missing"))


@query("validation_summary", """select count(*) as n_rows, count(distinct document_id) as n_articles, count(distinct final_url) as n_urls, count(*) - count(distinct document_id) as n_repeated,
 count(*) filter (where body is null or trim(body) = '') as n_empty, count(*) filter (where personal_data_flag) as n_flagged, cast(sum(email_redactions) as bigint) as n_redactions, min(retrieved_at_utc) as first_retrieved, max(retrieved_at_utc) as last_retrieved from articles""")  # fmt: skip
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "articles").agg(
        F.count("*").alias("n_rows"), F.count_distinct("document_id").alias("n_articles"), F.count_distinct("final_url").alias("n_urls"), (F.count("*") - F.count_distinct("document_id")).alias("n_repeated"),
        F.count_if(F.col("body").isNull() | (F.trim("body") == "")).alias("n_empty"), F.count_if("personal_data_flag").alias("n_flagged"), F.sum("email_redactions").alias("n_redactions"),
        F.min("retrieved_at_utc").alias("first_retrieved"), F.max("retrieved_at_utc").alias("last_retrieved"),
    )


@query("content_status", r"""with i as (select document_id, count(distinct image_id) as n from images group by document_id), a as (select document_id, min(body) as body from articles group by document_id),
w as (select document_id, trim(regexp_replace(coalesce(body, ''), '[\s\p{Z}]+', ' ', 'g')) as s from a), c as (select document_id as record, cast(case when s = '' then 0 else length(s) - length(replace(s, ' ', '')) + 1 end as bigint) as word_count, cast(coalesce(n, 0) as bigint) as image_count from w left join i using (document_id)),
x as (select *, case when word_count = 0 and image_count > 0 then 'image_only' when word_count = 0 then 'no_extracted_text' when word_count < 20 then 'short_text' else 'textual' end as content_status from c)
select *, content_status in ('textual', 'short_text') as include_in_text from x""")  # fmt: skip
def content_status(spark: SparkSession, d: str) -> DataFrame:
    return quality.content_status(load(spark, d, "articles"), record="document_id", body="body", images=load(spark, d, "images"), image_record="document_id")


@query("author_status", "select case when trim(coalesce(author, '')) <> '' then 'named_author' else 'publisher_only' end as author_status, count(distinct document_id) as n_articles from articles group by 1")
def author_status(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "articles").select("document_id", quality.author_status(F.col("author")).alias("author_status"))
    return a.groupBy("author_status").agg(F.count_distinct("document_id").alias("n_articles"))


@query("shared_image_groups", """with o as (select distinct image_id as record, sha256 as digest from images), g as (select digest, count(*) as group_size from o group by digest having count(*) > 1)
select record, o.digest, group_size from o join g on o.digest is not distinct from g.digest""")  # fmt: skip
def shared_image_groups(spark: SparkSession, d: str) -> DataFrame:
    return quality.shared_hash_groups(load(spark, d, "images"), record="image_id", digest="sha256")


# ---- metadata


@query("canonical_urls", r"""select document_id, request_url, case when regexp_matches(request_url, '^[A-Za-z][A-Za-z0-9+.\-]*://') then lower(regexp_extract(request_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || lower(regexp_extract(request_url, '://([^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(request_url, '://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '') else request_url end as canonical from (select distinct document_id, request_url from articles)""")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "articles").select("document_id", "request_url").distinct().withColumn("canonical", urls.canonical_url(F.col("request_url")))


@query("articles_by_host", r"select regexp_replace(lower(regexp_extract(final_url, '://([^/?#]*)', 1)), '^www\.', '') as host, count(distinct document_id) as n_articles from articles group by 1")
def articles_by_host(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "articles").groupBy(F.regexp_replace(urls.host(F.col("final_url")), r"^www\.", "").alias("host")).agg(F.count_distinct("document_id").alias("n_articles"))


@query("tag_counts", r"select lower(trim(t)) as tag, count(distinct doc_id) as n_documents from (select doc_id, unnest(string_split(tags, '|')) as t from documents) where trim(t) <> '' and lower(trim(t)) <> 'nan' group by 1")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").select(F.explode(F.array_distinct(F.transform(text.split_tags(F.col("tags")), F.lower))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n_documents"))


@query("author_counts_topk", "select trim(author) as author, count(*) as n_documents from documents where trim(author) <> '' group by 1 order by 2 desc, 1 limit 100")
def author_counts_topk(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "documents").filter(F.trim("author") != "").groupBy(F.trim("author").alias("author")).agg(F.count("*").alias("n_documents"))
    return a.orderBy(F.desc("n_documents"), "author").limit(100)


@query("corpus_summary", """select count(*) as n_documents, count(text) as n_texts, count(*) filter (where text is null or trim(text) = '') as n_empty, count(distinct source) as n_sources, count(distinct author) as n_authors,
 cast(sum(coalesce(length(text), 0)) as bigint) as n_characters, count(*) filter (where n_chars is distinct from length(text)) as n_wrong_lengths, count(*) filter (where title is null) as n_untitled from documents""")  # fmt: skip
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").agg(
        F.count("*").alias("n_documents"), F.count("text").alias("n_texts"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("n_empty"), F.count_distinct("source").alias("n_sources"),
        F.count_distinct("author").alias("n_authors"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_characters"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("n_wrong_lengths"), F.count_if(F.col("title").isNull()).alias("n_untitled"),
    )


@query("publication_by_month", "select strftime(o_orderdate, '%Y-%m') as period, count(*) as n_rows, round(sum(o_totalprice), 2) as total from orders group by 1")
def publication_by_month(spark: SparkSession, d: str) -> DataFrame:
    p = temporal.by_period(load(spark, d, "orders"), when="o_orderdate", measures={"total": "o_totalprice"}, unit="month")
    return p.withColumn("total", F.round("total", 2))


@query("articles_by_prefix_period", r"""with a as (select document_id, min(published_at) as p, min(word_count) as w, min(len(images)) as i from articles where regexp_matches(published_at, '^\d{4}-\d{2}') group by document_id)
select substr(p, 1, 7) as period, count(*) as n_rows, cast(sum(w) as bigint) as words, cast(sum(i) as bigint) as images from a group by 1""")  # fmt: skip
def articles_by_prefix_period(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "articles").filter(F.col("published_at").rlike(r"^\d{4}-\d{2}"))
    a = a.groupBy("document_id").agg(F.min("published_at").alias("p"), F.min("word_count").alias("w"), F.min(F.size("images")).alias("i"))
    return temporal.prefix_periods(a, when="p", measures={"words": "w", "images": "i"})


@query("html_round_trip")
def html_round_trip(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "articles").dropDuplicates(["document_id"])
    pages = a.select("document_id", "final_url", html.page_from_record(F.col("title"), F.col("paragraphs"), F.col("author"), F.col("published_at")).alias("html"))
    out = html.extract_articles(pages, record="document_id", html="html", url="final_url")
    return out.select(F.col("record").alias("document_id"), "title", "author", "published_at", "n_words", F.size("paragraphs").alias("n_paragraphs"), "error")


# ---- images


@query("linked_images", """with i as (select image_id, min(document_id) as document_id from images group by image_id), a as (select document_id, arg_min(title, (retrieved_at_utc, title)) as title from articles group by document_id)
select image_id, document_id, title from i join a using (document_id)""")  # fmt: skip
def linked_images(spark: SparkSession, d: str) -> DataFrame:
    return images.linked_images(load(spark, d, "images"), load(spark, d, "articles")).select("image_id", "document_id", "title")


def _content_set(column: str) -> str:
    return f"list_distinct({CONTENT.replace('toks', '(' + tok(column) + ')')})"


_OVERLAP = f"""with i as (select image_id, arg_min({{'d': document_id, 'f': figcaption, 'a': alt_text}}, (retrieved_at_utc, collection_run_id)) as x from images group by image_id),
a as (select document_id, arg_min(title, (retrieved_at_utc, title)) as title from articles group by document_id),
j as (select image_id, a.document_id, coalesce(nullif(trim(x.f), ''), nullif(trim(x.a), ''), '') as cap, coalesce(title, '') as title from i join a on a.document_id = x.d),
w as (select image_id, document_id, cap, {_content_set('cap')} as c, {_content_set('title')} as t from j),
s as (select image_id, document_id, cap, case when len(c) + len(t) = 0 then 0 else len(list_intersect(c, t))::double / len(list_distinct(list_concat(c, t))) end as j from w),
o as (select image_id, document_id, j, round(j, 6) as jaccard, case when cap = '' then 'no_caption' when j >= 0.3 then 'reinforcing_candidate' when j <= 0 then 'divergent_candidate' else 'complementary_candidate' end as relation from s)
"""


@query("caption_overlap", _OVERLAP + "select image_id, document_id, jaccard, relation from o")
def caption_overlap(spark: SparkSession, d: str) -> DataFrame:
    linked = images.linked_images(load(spark, d, "images"), load(spark, d, "articles"))
    return images.caption_overlap(linked).withColumn("jaccard", F.round("jaccard", 6))


@query("caption_relation_review", _OVERLAP + ", r as (select *, row_number() over (partition by relation order by j desc, image_id) as r from o) select image_id, document_id, jaccard, relation, cast(r as integer) as r from r where r <= 20")
def caption_relation_review(spark: SparkSession, d: str) -> DataFrame:
    linked = images.linked_images(load(spark, d, "images"), load(spark, d, "articles"))
    return explore.stratified_head(images.caption_overlap(linked), group="relation", order=[F.desc("jaccard"), F.col("image_id")], n=20).withColumn("jaccard", F.round("jaccard", 6))


_FIRST = "arg_min(case when trim({0}) <> '' then {0} end, case when trim({0}) <> '' then (case when image_role = 'inline' then 0 else 1 end, position, {0}) end) as {0}"


@query("merged_image_candidates", "select document_id, final_url, cast(min(position) as integer) as position, count(*) as n_sources, " + ", ".join(_FIRST.format(c) for c in ("alt_text", "title_text", "figcaption")) + " from images group by document_id, final_url")
def merged_image_candidates(spark: SparkSession, d: str) -> DataFrame:
    return images.merged_candidates(load(spark, d, "images"))


@query("image_roles_by_month", """with i as (select image_id, min(retrieved_at_utc) as r, min(image_role) as image_role from images group by image_id) select substr(r, 1, 7) as period, image_role, count(*) as n from i group by 1, 2""")
def image_roles_by_month(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").groupBy("image_id").agg(F.min("retrieved_at_utc").alias("r"), F.min("image_role").alias("image_role"))
    return i.groupBy(F.substring("r", 1, 7).alias("period"), "image_role").agg(F.count("*").alias("n"))


@query("decorative_images", "select distinct image_id from images where coalesce(regexp_matches(lower(final_url), 'logo|avatar|profile|icon|emoji|spinner|tracking|pixel|gravatar'), false) or coalesce(width between 1 and 80 and height between 1 and 80, false)")
def decorative_images(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "images").filter(urls.decorative_image(F.col("final_url"), F.col("width"), F.col("height"))).select("image_id").distinct()


# ---- annotated tokens and candidates

_LEMMA = "lower(coalesce(case when trim(lemma) <> '' then trim(lemma) end, \"lower\"))"


@query("content_run_bigrams", f"""with o as (select document_id, token_index, min(sentence_index) as sentence_index, min({_LEMMA}) as term, bool_and(is_alpha) as a, bool_or(is_stop) as s, min(pos) as pos from tokens group by 1, 2),
m as (select *, case when coalesce(a and not s and pos in ('NOUN', 'PROPN', 'ADJ', 'VERB', 'ADV') and length(term) >= 2, false) then term end as t from o),
g as (select document_id, t, lead(t) over (partition by document_id, sentence_index order by token_index) as u from m)
select t || ' ' || u as ngram, count(*) as frequency, count(distinct document_id) as document_frequency from g where t is not null and u is not null group by 1 having count(*) >= 2""")  # fmt: skip
def content_run_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return lexical.content_runs(load(spark, d, "tokens"), pos=["NOUN", "PROPN", "ADJ", "VERB", "ADV"], n=2)


@query("lemma_concordance", f"""with o as (select document_id, token_index, min(sentence_index) as sentence_index, min({_LEMMA}) as lemma from tokens where is_alpha group by 1, 2),
t as (select lemma from o group by lemma order by count(*) desc, lemma limit 3000), s as (select distinct lemma, document_id, sentence_index from o join t using (lemma)),
r as (select *, row_number() over (partition by lemma order by document_id, sentence_index) as r from s) select lemma, document_id, sentence_index, cast(r as integer) as r from r where r <= 80""")  # fmt: skip
def lemma_concordance(spark: SparkSession, d: str) -> DataFrame:
    return lexical.lemma_concordance(load(spark, d, "tokens"))


@query("part_of_speech_counts", "select pos, count(*) as n, cast(count(distinct document_id) as bigint) as n_documents from (select distinct document_id, token_index, pos from tokens) group by pos")
def part_of_speech_counts(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tokens").select("document_id", "token_index", "pos").distinct()
    return t.groupBy("document_id", "pos").agg(F.count("*").alias("k")).groupBy("pos").agg(F.sum("k").alias("n"), F.count("*").alias("n_documents"))


@query("proper_noun_edges", """with m as (select distinct document_id, sentence_index, lower(trim(lemma)) as item from tokens where pos = 'PROPN' and is_alpha and trim(lemma) <> '')
select a.item as actor_1, b.item as actor_2, count(*) as sentence_cooccurrence from m a join m b on a.document_id = b.document_id and a.sentence_index = b.sentence_index and a.item < b.item group by 1, 2""")  # fmt: skip
def proper_noun_edges(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "tokens").filter("pos = 'PROPN' and is_alpha and trim(lemma) <> ''").select(F.concat_ws("-", "document_id", "sentence_index").alias("sentence"), F.lower(F.trim("lemma")).alias("item"))
    return discourse.cooccurrence_edges(t, group="sentence", item="item")


@query("predications", """with t as (select document_id, token_index, min(lower(coalesce(lemma, "lower"))) as lemma, min(text) as text, min(pos) as pos, min(dep) as dep, min(head_index) as head_index, bool_and(is_alpha) as is_alpha from tokens group by 1, 2),
m as (select document_id, head_index as token_index, array_to_string(list_sort(list(distinct lemma)), '|') as modifiers from t where dep in ('amod', 'compound', 'appos') and is_alpha group by 1, 2),
j as (select n.document_id, n.token_index, n.text as entity, coalesce(m.modifiers, '') as modifiers, coalesce(case when n.dep in ('nsubj', 'nsubjpass', 'obj', 'dobj', 'pobj') then g.lemma end, '') as predicate
 from t n left join m on m.document_id = n.document_id and m.token_index = n.token_index left join t g on g.document_id = n.document_id and g.token_index = n.head_index where n.pos = 'PROPN')
select * from j where modifiers <> '' or predicate <> ''""")  # fmt: skip
def predications(spark: SparkSession, d: str) -> DataFrame:
    return discourse.predications(load(spark, d, "tokens"), heads=["nsubj", "nsubjpass", "obj", "dobj", "pobj"], modifiers=["amod", "compound", "appos"])


_FRAME = "select distinct document_id, sentence_id, lower(trim(frame)) as frame from frame_candidates where trim(frame) <> ''"


@query("frame_counts", f"with f as ({_FRAME}) select frame, count(*) as n_sentences, count(distinct document_id) as n_documents from f group by frame")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "frame_candidates").filter(F.trim("frame") != "").select("document_id", "sentence_id", F.lower(F.trim("frame")).alias("frame")).distinct()
    return f.groupBy("frame", "document_id").agg(F.count("*").alias("k")).groupBy("frame").agg(F.sum("k").alias("n_sentences"), F.count("*").alias("n_documents"))


_FRAMES = ["health_care", "heritage_arts", "housing_cost", "land_nature", "local_democracy", "press_trust", "public_order", "school_family", "transport_access", "volunteering"]


@query("frame_counts_by_document", f"with f as ({_FRAME}) select document_id, " + ", ".join(f"count(*) filter (where frame = '{x}') as frame_{x}" for x in _FRAMES) + f", count(*) filter (where frame not in ({', '.join(repr(x) for x in _FRAMES)})) as frame_other from f group by document_id")
def frame_counts_by_document(spark: SparkSession, d: str) -> DataFrame:
    """A column for each frame of the scheme, and one for all others, so that every sentence is counted."""
    f = load(spark, d, "frame_candidates").filter(F.trim("frame") != "").select("document_id", "sentence_id", F.lower(F.trim("frame")).alias("frame")).distinct()
    f = f.withColumn("frame", F.when(F.col("frame").isin(_FRAMES), F.col("frame")).otherwise("other"))
    return discourse.category_counts(f, category="frame", values=[*_FRAMES, "other"], prefix="frame")


@query("frame_counts_by_document_and_frame", f"with f as ({_FRAME}) select document_id, frame, count(*) as n_sentences from f group by document_id, frame")
def frame_counts_by_document_and_frame(spark: SparkSession, d: str) -> DataFrame:
    """Every frame of every document as rows."""
    f = load(spark, d, "frame_candidates").filter(F.trim("frame") != "").select("document_id", "sentence_id", F.lower(F.trim("frame")).alias("frame")).distinct()
    return f.groupBy("document_id", "frame").agg(F.count("*").alias("n_sentences"))


@query("frame_rates_by_month", f"""with f as ({_FRAME}), a as (select document_id, min(case when regexp_matches(published_at, '^\\d{{4}}-\\d{{2}}') then substr(published_at, 1, 7) end) as p, min(word_count) as w from articles group by document_id),
c as (select p, frame, count(*) as n from f left join a using (document_id) group by 1, 2), d as (select p as q, count(*) as docs, sum(w) as words from a group by 1)
select p as period, frame as category, n, round(coalesce(n * 100.0 / nullif(docs, 0), 0), 6) as per_100, round(coalesce(n * 10000.0 / nullif(words, 0), 0), 6) as per_10k from c left join d on c.p is not distinct from d.q""")  # fmt: skip
def frame_rates_by_month(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "frame_candidates").filter(F.trim("frame") != "").select("document_id", "sentence_id", F.lower(F.trim("frame")).alias("frame")).distinct()
    month = F.when(F.col("published_at").rlike(r"^\d{4}-\d{2}"), F.substring("published_at", 1, 7))
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min(month).alias("p"), F.min("word_count").alias("w")).withColumn("one", F.lit(1))
    r = temporal.period_rates(f.join(a, "document_id", "left"), a, period="p", category="frame", size="one", words="w")
    return r.withColumn("per_100", F.round("per_100", 6)).withColumn("per_10k", F.round("per_10k", 6))


_QUEUE = "q as (select sentence_id, min(document_id) as document_id, min(lower(trim(frame))) as frame, bool_or(coalesce(quotation_flag, false) or coalesce(reported_speech_flag, false)) as quoted from frame_candidates where trim(frame) <> '' group by sentence_id), l as (select document_id, case min(band) when 1 then 'valid' when 2 then 'reject' when 3 then 'uncertain' else 'unreviewed' end as status from reading_labels group by document_id)"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "frame_candidates").filter(F.trim("frame") != "").groupBy("sentence_id").agg(F.min("document_id").alias("document_id"), F.min(F.lower(F.trim("frame"))).alias("frame"), F.bool_or(F.coalesce("quotation_flag", F.lit(False)) | F.coalesce("reported_speech_flag", F.lit(False))).alias("quoted"))
    b = F.min("band")
    notes = load(spark, d, "reading_labels").groupBy("document_id").agg(F.when(b == 1, "valid").when(b == 2, "reject").when(b == 3, "uncertain").otherwise("unreviewed").alias("status"))
    return explore.review_queue(items, notes, key="document_id")


@query("review_queue", f"with {_QUEUE} select document_id, sentence_id, frame, quoted, coalesce(status, 'unreviewed') as status from q left join l using (document_id) where quoted")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).filter("quoted")


@query("review_progress", f"""with {_QUEUE}, x as (select coalesce(status, 'unreviewed') as s from q left join l using (document_id))
select count(*) as total, count(*) filter (where s in ('valid', 'reject', 'uncertain')) as reviewed, count(*) filter (where s = 'valid') as n_valid, count(*) filter (where s = 'reject') as n_reject, count(*) filter (where s = 'uncertain') as n_uncertain,
 round(count(*) filter (where s in ('valid', 'reject', 'uncertain')) * 100.0 / count(*), 6) as percent from x""")  # fmt: skip
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    return explore.review_progress(_queue(spark, d)).withColumn("percent", F.round("percent", 6))


@query("annotation_upsert", """with o as (select document_id, min(band) as band, 'old' as origin from reading_labels where annotator = 'r1' group by document_id), n as (select document_id, min(band) as band, cast(null as varchar) as origin from reading_labels where annotator <> 'r1' group by document_id)
select coalesce(n.document_id, o.document_id) as document_id, coalesce(n.band, o.band) as band, coalesce(n.origin, o.origin) as origin from o full join n on o.document_id = n.document_id""")  # fmt: skip
def annotation_upsert(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "reading_labels")
    old = labels.filter("annotator = 'r1'").groupBy("document_id").agg(F.min("band").alias("band")).withColumn("origin", F.lit("old"))
    new = labels.filter("annotator <> 'r1'").groupBy("document_id").agg(F.min("band").alias("band")).withColumn("origin", F.lit(None).cast("string"))
    return explore.merged_over(old, new, key="document_id")


@query("annotation_import", """with o as (select document_id, min(band) as band from reading_labels where annotator = 'r1' group by document_id), n as (select document_id, min(band) as band from reading_labels where annotator <> 'r1' group by document_id)
select * from o where document_id not in (select document_id from n) union all select * from n""")  # fmt: skip
def annotation_import(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "reading_labels")
    old, new = (labels.filter(c).groupBy("document_id").agg(F.min("band").alias("band")) for c in ("annotator = 'r1'", "annotator <> 'r1'"))
    return explore.replaced_by(old, new, key="document_id")


# ---- exploration


@query("document_filter_page", r"""select doc_id, title, n_chars from documents where lower(concat_ws(' ', title, author)) like '%school%' and n_chars >= 200 and lang = 'en' order by collected_at desc nulls last, doc_id limit 24 offset 24""")
def document_filter_page(spark: SparkSession, d: str) -> DataFrame:
    f = explore.filtered(load(spark, d, "documents"), contains="school", search=["title", "author"], equals={"lang": "en"}, low={"n_chars": 200})
    return explore.page(f, order=[F.desc_nulls_last("collected_at"), F.col("doc_id")], number=1).select("doc_id", "title", "n_chars")


@query("stratified_review_sample", "with r as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) select doc_id, source, n_chars, cast(r as integer) as r from r where r <= 20")
def stratified_review_sample(spark: SparkSession, d: str) -> DataFrame:
    return explore.stratified_head(load(spark, d, "documents").select("doc_id", "source", "n_chars"), group="source", order=[F.desc("n_chars"), F.col("doc_id")], n=20)


@query("length_histogram", """with e as (select min(n_chars)::double as lo, max(n_chars)::double as hi from documents), b as (select cast(least(19, floor((n_chars - lo) / ((hi - lo) / 20))) as integer) as bin, lo, hi from documents, e where n_chars is not null)
select bin, count(*) as n, round(lo + bin * (hi - lo) / 20, 6) as low, round(lo + (bin + 1) * (hi - lo) / 20, 6) as high from b group by bin, lo, hi""")  # fmt: skip
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = explore.histogram(load(spark, d, "documents"), value="n_chars", bins=20)
    return h.withColumn("low", F.round("low", 6)).withColumn("high", F.round("high", 6))


@query("median_quadrants", """with m as (select median(l_quantity) as mx, median(l_extendedprice) as my from lineitem) select case when l_quantity >= mx then 'high_' else 'low_' end || case when l_extendedprice >= my then 'high' else 'low' end as quadrant, count(*) as n from lineitem, m group by 1""")
def median_quadrants(spark: SparkSession, d: str) -> DataFrame:
    return explore.median_quadrants(load(spark, d, "lineitem"), x="l_quantity", y="l_extendedprice")


@query("systematic_sample", "with n as (select greatest(1, cast(ceil(count(*) / 1800.0) as bigint)) as k from events) select event_id, event_type from events, n where event_id % k = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return explore.systematic_sample(load(spark, d, "events"), key="event_id").select("event_id", "event_type")


@query("source_shares", "select source as category, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as share from documents group by source")
def source_shares(spark: SparkSession, d: str) -> DataFrame:
    return explore.share_of_total(load(spark, d, "documents"), category="source").withColumn("share", F.round("share", 6))


@query("distinct_values", "select distinct lang as value from documents where lang is not null order by 1")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("lang is not null").select(F.col("lang").alias("value")).distinct().orderBy("value")


# ---- series


@query("latest_event_per_user", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    return temporal.latest_per_key(load(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), key="user_id", order=["ts", "event_id"]).select("user_id", "event_type", "event_id")


_MASKED = "e as (select user_id, event_id, case when event_id % 3 = 0 then epoch_us(ts) // 1000000 end as s from events)"


def _masked(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id", "ts")
    return e.select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("ts"))


@query("date_gap_interpolation", f"""with {_MASKED}, w as (select *, last_value(s ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as p, first_value(s ignore nulls) over (partition by user_id order by event_id rows between current row and unbounded following) as n, count(s) over (partition by user_id order by event_id rows between unbounded preceding and current row) as i from e),
k as (select *, count(*) filter (where s is null) over (partition by user_id, i) as m, count(*) filter (where s is null) over (partition by user_id, i order by event_id rows between unbounded preceding and current row) as k from w)
select user_id, event_id, cast(floor(case when s is not null then s when p is not null and n is not null then p + (n - p) * k / (m + 1)::double end) as bigint) as estimate_seconds, round(abs(n - p) / 86400.0, 6) as gap_days,
 case when s is not null then 'known' when n is null or p is null then 'unresolved' when n = p then 'same_day' when abs(n - p) / 86400.0 <= 31 then 'within_month' else 'wide' end as confidence from k""")  # fmt: skip
def date_gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    i = temporal.interpolated_dates(_masked(spark, d), partition="user_id", order="event_id", value="ts")
    return i.select("user_id", "event_id", "estimate_seconds", F.round("gap_days", 6).alias("gap_days"), "confidence")


@query("nearest_known_dates", f"""with {_MASKED} select user_id, event_id, last_value(s ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as previous_known, first_value(s ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) as next_known from e""")
def nearest_known_dates(spark: SparkSession, d: str) -> DataFrame:
    e = _masked(spark, d).select("user_id", "event_id", F.unix_timestamp("ts").alias("s"))
    return temporal.nearest_known(e, partition="user_id", order="event_id", value="s").drop("s")


@query("event_rates_by_day", """with c as (select strftime(ts, '%Y-%m-%d') as p, event_type, count(*) as n from events group by 1, 2), d as (select strftime(ts, '%Y-%m-%d') as q, count(distinct user_id) as u, count(*) as k from events group by 1)
select p as period, event_type as category, n, round(n * 100.0 / u, 6) as per_100, round(n * 10000.0 / k, 6) as per_10k from c join d on p = q""")  # fmt: skip
def event_rates_by_day(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("p", F.date_format("ts", "yyyy-MM-dd"))
    den = e.groupBy("p").agg(F.count_distinct("user_id").alias("u"), F.count("*").alias("k"))
    r = temporal.period_rates(e, den, period="p", category="event_type", size="u", words="k")
    return r.withColumn("per_100", F.round("per_100", 6)).withColumn("per_10k", F.round("per_10k", 6))


@query("event_property_keys", "with k as (select event_type, unnest(json_keys(props)) as k from events) select event_type, k as property, count(*) as n from k group by 1, 2")
def event_property_keys(spark: SparkSession, d: str) -> DataFrame:
    k = load(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("property"))
    return k.groupBy("event_type", "property").agg(F.count("*").alias("n"))


# ---- vectors


@query("cosine_top_k", """with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0), s as (select q.vec_id as query_id, v.vec_id as id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as c from q, embeddings v where q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s) select query_id, id, round(c, 6) as cosine, cast(rank as integer) as rank from r where rank <= 5""")  # fmt: skip
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return vectors.cosine_top_k(e, record="vec_id", vector="embedding", queries=e.filter("vec_id % 50 = 0"), k=5).withColumn("cosine", F.round("cosine", 6))


@query("cluster_agreement_ari", """with c as (select label as a, vec_id % 7 as b, count(*) as c from embeddings group by 1, 2), s as (select sum(c * (c - 1) / 2.0) as s, sum(c) as n from c), x as (select sum(c * (c - 1) / 2.0) as sa from (select sum(c) as c from c group by a)), y as (select sum(c * (c - 1) / 2.0) as sb from (select sum(c) as c from c group by b))
select round((s - sa * sb / (n * (n - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2.0)), 8) as ari, cast(n as bigint) as n from s, x, y""")  # fmt: skip
def cluster_agreement_ari(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("other"))
    return stats.adjusted_rand(e, "label", "other").withColumn("ari", F.round("ari", 8))


@query("cluster_summary", "select count(distinct case when label <> -1 then label end) as n_clusters, count(*) filter (where label = -1) as n_outliers, count(*) as n_rows from embeddings")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cluster_summary(load(spark, d, "embeddings"), label="label")


@query("kmeans_agreement")
def kmeans_agreement(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair of the reference's seeds; k-means leaves no outliers, so those are 0."""
    e = load(spark, d, "embeddings")
    labels = {seed: cut_lineage(vectors.kmeans_labels(e, record="vec_id", vector="embedding", k=8, seed=seed)) for seed in (13, 42, 87)}
    rows = []
    for s, t in itertools.combinations(labels, 2):
        both = labels[s].withColumnRenamed("cluster", "a").join(labels[t].withColumnRenamed("cluster", "b"), "vec_id")
        outliers = [F.lit(0).cast("bigint").alias(f"outliers_seed_{k}") for k in (1, 2)]
        rows.append(stats.adjusted_rand(both, "a", "b").select(F.lit(s).alias("seed_1"), F.lit(t).alias("seed_2"), "*", *outliers))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("near_duplicate_pairs")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "articles")
    pairs = similarity.near_duplicate_pairs(a, record="document_id", text="body")
    at = a.groupBy("document_id").agg(F.min("final_url").alias("url"))
    for k in ("1", "2"):
        pairs = pairs.withColumnRenamed(f"id_{k}", f"document_id_{k}").join(at.select(F.col("document_id").alias(f"document_id_{k}"), F.col("url").alias(f"url_{k}")), f"document_id_{k}")
    return pairs.select("document_id_1", "document_id_2", F.round("cosine", 8).alias("cosine_similarity_char_ngrams"), "url_1", "url_2", F.lit("unreviewed_candidate").alias("review_status"))


@query("unit_vectors", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 5) as norm from embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.round(stats.norm(F.col("embedding")), 5).alias("norm"))


# ---- dimension joins


@query("pricing_summary", """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("revenue_by_nation", """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = {n: load(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_orders", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("running_order_totals", "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running_total from orders")
def running_order_totals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running_total"))
