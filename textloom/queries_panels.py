"""Queries of the corpus views, orders, audits and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stats, text
from textloom.operators import html, images, lexical, panels, temporal, timestamps, topics
from textloom.queries_core import QUERIES, SQL, query
from textloom.queries_tables import _FRAME, _LEMMA
from textloom.queries_text import _KEY, CONTENT, NODES, TOKS, _keyness, document_readability, tok
from textloom.runtime import cut_lineage, load

CONTENT_POS = ["NOUN", "PROPN", "ADJ", "VERB", "ADV"]

_RUNS = f"""o as (select document_id, token_index, min(sentence_index) as sentence_index, min({_LEMMA}) as term, bool_and(is_alpha) as a, bool_or(is_stop) as s, min(pos) as pos from tokens group by 1, 2),
m as (select *, case when coalesce(a and not s and pos in ('NOUN', 'PROPN', 'ADJ', 'VERB', 'ADV') and length(term) >= 2, false) then term end as t from o),
g as (select document_id, t, lead(t) over w as u, lead(t, 2) over w as v from m window w as (partition by document_id, sentence_index order by token_index)),
x as (select 1 as n, document_id, t as ngram from g where t is not null union all select 2, document_id, t || ' ' || u from g where t is not null and u is not null
 union all select 3, document_id, t || ' ' || u || ' ' || v from g where t is not null and u is not null and v is not null),
c as (select n, ngram, count(*) as frequency, count(distinct document_id) as document_frequency from x group by 1, 2),
r as (select *, row_number() over (partition by n order by frequency desc, ngram) as r from c), b as (select count(*) filter (where a) as base from o)"""


@query("lexical_bundle", f"with {_RUNS} select cast(n as integer) as n, ngram, frequency, round(frequency * 1e6 / base, 6) as per_million, document_frequency from r, b where r <= case n when 1 then 10000 else 2000 end")
def lexical_bundle(spark: SparkSession, d: str) -> DataFrame:
    return panels.lexical_bundle(load(spark, d, "tokens"), pos=CONTENT_POS).withColumn("per_million", F.round("per_million", 6))


# A reference list made of the corpus's own second outlet, so that it is known to both sides.
_REFERENCE = f"""{TOKS}, c as (select source, {CONTENT} as items from d where source is not null),
t as (select term, count(*) as frequency, count(distinct doc_id) as document_frequency from (select doc_id, unnest({CONTENT}) as term from d where source = 'tavrin-courier') group by term),
e as (select unnest(items) as term from c where source = 'brenmore-voice'), en as (select count(*) as n from e), l as (select term, count(*) * 1e6 / (select n from en) as reference_per_million from e group by term),
tn as (select sum(frequency)::double as n1 from t)"""
_PANEL = """j as (select t.*, coalesce(reference_per_million, 0) as rp, n1, 1000000.0 as n2 from t {how} join l using (term), tn where frequency >= 5),
k as (select *, frequency / n1 * 1e6 as per_million, rp * n2 / 1e6 as k2 from j)
select term, case when per_million >= rp then 'over' else 'under' end as direction, cast(frequency as bigint) as frequency, document_frequency, round(per_million, 4) as per_million, round(rp, 4) as reference_per_million,
 round(2 * ((case when frequency = 0 then 0 else frequency * ln(frequency / (n1 * (frequency + k2) / (n1 + n2))) end) + (case when k2 = 0 then 0 else k2 * ln(k2 / (n2 * (frequency + k2) / (n1 + n2))) end)), 4) as log_likelihood,
 round(log2(((frequency + 0.5) / (n1 + 1)) / ((k2 + 0.5) / (n2 + 1))), 6) as log_ratio from k"""


def _reference_panel(spark: SparkSession, d: str, missing_as_zero: bool) -> DataFrame:
    docs = load(spark, d, "documents")
    terms = lexical.term_frequencies(docs.filter("source = 'tavrin-courier'"), record="doc_id", body="text").select("term", "frequency", "document_frequency")
    total = terms.agg(F.sum("frequency").alias("n1")).withColumn("_k", F.lit(1))
    terms = terms.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")
    reference = lexical.term_frequencies(docs.filter("source = 'brenmore-voice'"), record="doc_id", body="text").select("term", "per_million")
    k = panels.reference_keyness(terms, reference, target_total=F.col("n1"), reference_total=1e6, missing_as_zero=missing_as_zero, min_frequency=5)
    for c, n in (("per_million", 4), ("reference_per_million", 4), ("log_likelihood", 4), ("log_ratio", 6)):
        k = k.withColumn(c, F.round(c, n))
    return k


@query("reference_keyness", f"{_REFERENCE}, {_PANEL.format(how='')}")
def reference_keyness(spark: SparkSession, d: str) -> DataFrame:
    return _reference_panel(spark, d, False)


@query("reference_keyness_missing_as_zero", f"{_REFERENCE}, {_PANEL.format(how='left')}")
def reference_keyness_missing_as_zero(spark: SparkSession, d: str) -> DataFrame:
    return _reference_panel(spark, d, True)


@query("keyness_table", _KEY + "select term, round(g2, 4) as log_likelihood, round(log2(((k1 + 0.5) / (n1 + 0.5)) / ((k2 + 0.5) / (n2 + 0.5))), 6) as log_ratio from s order by log_likelihood desc, abs(log_ratio) desc, term limit 100")
def keyness_table(spark: SparkSession, d: str) -> DataFrame:
    k = _keyness(spark, d).select("term", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("log_ratio", 6).alias("log_ratio"))
    return panels.keyness_table(k)


_NODE_LIST = ", ".join(f"'{n}'" for n in NODES)
_COLLOCATIONS = f"""{TOKS}, a as (select doc_id, toks, i, toks[i] as node from (select doc_id, toks, unnest(range(1, len(toks) + 1)) as i from d where list_has_any(toks, [{_NODE_LIST}])) where toks[i] in ({_NODE_LIST})),
w as (select doc_id, node, unnest(list_filter(list_concat(toks[greatest(i - 5, 1):i - 1], toks[i + 1:i + 5]), lambda x: length(x) > 1)) as collocate from a),
p as (select node, collocate, count(*) as f, count(distinct doc_id) as df from w group by 1, 2 having count(*) >= 5),
t as (select unnest(toks) as t from d), c as (select t, count(*) as f from t group by t),
x as (select node, collocate, cast(p.f as bigint) as cooccurrence_frequency, cast(df as bigint) as document_frequency, round(14 + log2(2.0 * p.f / (cn.f + cc.f)), 6) as logdice from p join c cn on cn.t = node join c cc on cc.t = collocate)
"""


def _collocations(spark: SparkSession, d: str) -> DataFrame:
    c = lexical.collocations(load(spark, d, "documents"), record="doc_id", body="text", nodes=NODES)
    return c.select("node", "collocate", "cooccurrence_frequency", "document_frequency", F.round("logdice", 6).alias("logdice"))


@query("collocation_panel", _COLLOCATIONS + f"select * from x where node = '{NODES[0]}' and document_frequency >= 2 order by logdice desc, document_frequency desc, collocate limit 20")
def collocation_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.collocation_panel(_collocations(spark, d), node=NODES[0], min_documents=2)


@query("top_collocations", _COLLOCATIONS + "select * from x order by logdice desc, cooccurrence_frequency desc, node, collocate limit 1500")
def top_collocations(spark: SparkSession, d: str) -> DataFrame:
    return _collocations(spark, d).orderBy(F.desc("logdice"), F.desc("cooccurrence_frequency"), "node", "collocate").limit(1500)


@query("readability_plot", f"select * from ({SQL['document_readability']}) where word_count > 0 and word_count <= 5000 and flesch_reading_ease_estimate > -100 and flesch_reading_ease_estimate < 130")
def readability_plot(spark: SparkSession, d: str) -> DataFrame:
    """Documents within the plot: up to 5,000 words and an estimate between -100 and 130."""
    r = document_readability(spark, d)
    return r.filter((F.col("word_count") > 0) & (F.col("word_count") <= 5000) & (F.col("flesch_reading_ease_estimate") > -100) & (F.col("flesch_reading_ease_estimate") < 130))


# ---- periods


_PERIODS = f"""with f as ({_FRAME}), a as (select document_id, min(retrieved_at_utc) as r, min(word_count) as w from articles group by document_id),
u as (select document_id, w, 'month' as unit, substr(r, 1, 7) as period from a union all select document_id, w, 'year', substr(r, 1, 4) from a),
c as (select unit, period, frame, count(*) as n from f join u using (document_id) group by 1, 2, 3), d as (select unit, period, count(*) as docs, sum(w) as words from u group by 1, 2)
select unit, period, frame as category, n, round(coalesce(n * 100.0 / nullif(docs, 0), 0), 6) as per_100, round(coalesce(n * 10000.0 / nullif(words, 0), 0), 6) as per_10k from c join d using (unit, period)"""


def _frames_once(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "frame_candidates").filter(F.trim("frame") != "").select("document_id", "sentence_id", F.lower(F.trim("frame")).alias("frame")).distinct()


def _rates(events: DataFrame, dated: DataFrame) -> DataFrame:
    """Rates by month and by year; ``dated(document_id, when, words)`` with ISO text."""
    units = F.array(F.struct(F.lit("month").alias("unit"), F.substring("when", 1, 7).alias("period")), F.struct(F.lit("year").alias("unit"), F.substring("when", 1, 4).alias("period")))
    u = dated.select("document_id", "words", F.explode(units).alias("u")).select("document_id", "words", F.struct("u.unit", "u.period").alias("p")).withColumn("one", F.lit(1))
    r = temporal.period_rates(events.join(u, "document_id"), u, period="p", category="frame", size="one", words="words")
    return r.select("period.unit", "period.period", "category", "n", F.round("per_100", 6).alias("per_100"), F.round("per_10k", 6).alias("per_10k"))


@query("frame_rates_by_period", _PERIODS)
def frame_rates_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per 100 documents and 10,000 words, by month and by year of retrieval (every article has one)."""
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min("retrieved_at_utc").alias("when"), F.min("word_count").alias("words"))
    return _rates(_frames_once(spark, d), a)


@query("frame_rates_by_publication")
def frame_rates_by_publication(spark: SparkSession, d: str) -> DataFrame:
    """The same by the resolved moment of publication, whatever way it was written."""
    moments = timestamps.publication_moments(load(spark, d, "articles"), load(spark, d, "documents"), load(spark, d, "outlets")).filter("tbl = 'articles'").select(F.col("rec_id").alias("document_id"), F.col("utc").alias("when"))
    words = load(spark, d, "articles").groupBy("document_id").agg(F.min("word_count").alias("words"))
    return _rates(_frames_once(spark, d), words.join(moments, "document_id"))


@query("timeline_from_2019", "select substr(retrieved_at_utc, 1, 4) as year, count(distinct document_id) as n_documents from articles where cast(substr(retrieved_at_utc, 1, 4) as integer) >= 2019 group by 1")
def timeline_from_2019(spark: SparkSession, d: str) -> DataFrame:
    year = F.substring("retrieved_at_utc", 1, 4)
    return load(spark, d, "articles").filter(year.cast("int") >= 2019).groupBy(year.alias("year")).agg(F.count_distinct("document_id").alias("n_documents"))


@query("value_counts", " union all ".join(f"select '{c}' as field, {c} as value, count(*) as n from (select distinct document_id, token_index, {c} from tokens) group by {c}" for c in ("pos", "dep")) + " union all select 'frame', lower(trim(frame)), count(*) from (select distinct sentence_id, frame from frame_candidates) group by 2 union all select 'validation_status', validation_status, count(*) from (select distinct sentence_id, frame, validation_status from frame_candidates) group by 2")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens, frames = load(spark, d, "tokens"), load(spark, d, "frame_candidates")

    def counts(df: DataFrame, field: str, value) -> DataFrame:
        return df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(field).alias("field"), "value", "n")

    out = counts(frames.select("sentence_id", "frame").distinct(), "frame", F.lower(F.trim("frame")))
    out = out.unionByName(counts(frames.select("sentence_id", "frame", "validation_status").distinct(), "validation_status", F.col("validation_status")))
    for c in ("pos", "dep"):
        out = out.unionByName(counts(tokens.select("document_id", "token_index", c).distinct(), c, F.col(c)))
    return out


# ---- images and text

def _set(column: str) -> str:
    inner = CONTENT.replace("toks", f"({tok(column)})")
    return f"list_distinct({inner})"


_J = "(case when len(list_distinct(list_concat({0}, {1}))) = 0 then 0 else len(list_intersect({0}, {1}))::double / len(list_distinct(list_concat({0}, {1}))) end)"


@query("image_text_relations", f"""with i as (select image_id, min(document_id) as document_id, min(figcaption) as figcaption, min(alt_text) as alt_text, min(title_text) as title_text from images group by image_id),
a as (select document_id, min(title) as title, min(body) as body from articles group by document_id),
j as (select image_id, document_id, trim(coalesce(figcaption, '')) <> '' as has_caption, trim(coalesce(title_text, '')) <> '' as has_ocr, coalesce(nullif(trim(figcaption), ''), nullif(trim(alt_text), ''), '') as cap, coalesce(alt_text, '') as alt, coalesce(figcaption, '') as fig, coalesce(title_text, '') as ocr,
 coalesce(title, '') as title, coalesce(string_split(body, chr(10))[1], '') as lead, coalesce(body, '') as body from i join a using (document_id)),
w as (select image_id, document_id, has_caption, has_ocr, {_set('cap')} as c, {_set('alt')} as al, {_set('fig')} as f, {_set('ocr')} as o, {_set('title')} as t, {_set('lead')} as l, {_set('body')} as b from j),
s as (select image_id, document_id, has_caption, {_J.format('c', 't')} as st, {_J.format('c', 'l')} as sl, {_J.format('al', 'f')} as sc, case when has_ocr then {_J.format('o', 'b')} end as so from w)
select image_id, document_id, case when so >= 0.12 then 'text_bearing_redundant_or_evidential' when sc >= 0.3 and has_caption then 'caption_aligned' when greatest(st, sl) >= 0.3 then 'article_aligned_illustrative_or_complementary'
 when greatest(st, sl) < 0.1 then 'weak_alignment_review' else 'review_required' end as relation from s""")  # fmt: skip
def image_text_relations(spark: SparkSession, d: str) -> DataFrame:
    """The ordered rules on word overlaps: caption with title and lead, alternative text with caption, title text with body."""
    i = load(spark, d, "images").groupBy("image_id").agg(*[F.min(c).alias(c) for c in ("document_id", "figcaption", "alt_text", "title_text")])
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min("title").alias("title"), F.min("body").alias("body"))
    j = i.join(a, "document_id")
    words = lambda c: F.array_distinct(text.content_tokens(text.tokens(F.coalesce(c, F.lit("")))))
    cap = images.caption(F.col("figcaption"), F.col("alt_text"))
    j = j.select("image_id", "document_id", "figcaption", "title_text", words(cap).alias("c"), words(F.col("alt_text")).alias("al"), words(F.col("figcaption")).alias("f"), words(F.col("title_text")).alias("o"), words(F.col("title")).alias("t"), words(F.split("body", "\n")[0]).alias("l"), words(F.col("body")).alias("b"))
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    sim = lambda x, y: stats.jaccard(F.col(x), F.col(y))
    relation = images.provisional_relation(sim("c", "t"), sim("c", "l"), sim("al", "f"), F.when(filled("title_text"), sim("o", "b")), filled("figcaption"))
    return j.select("image_id", "document_id", relation.alias("relation"))


# ---- orders, stored pages, audits

_LISTED = "p as (select article_url as url, min(position) as place from images where article_url is not null group by 1), a as (select distinct document_id, coalesce(nullif(trim(final_url), ''), nullif(trim(request_url), '')) as url from articles), j as (select a.*, place from a left join p using (url))"


@query("listed_order", f"with {_LISTED}, m as (select coalesce(max(place) + 1, 0) as n from j) select document_id, url, cast(place as bigint) as place from j where place is not null union all select document_id, url, row_number() over (order by document_id, url) - 1 + n from j, m where place is null")
def listed_order(spark: SparkSession, d: str) -> DataFrame:
    return panels.listed_order(load(spark, d, "articles"), load(spark, d, "images"), url=panels.first_filled("final_url", "request_url"), listed_url="article_url", position="position", key="document_id")


@query("without_stored_blob", "with s as (select distinct document_id as h from articles where http_status = 200) select distinct a.image_id from images a where not exists (select 1 from s where h = substr(sha256(a.request_url), 1, 20)) and not exists (select 1 from s where h = substr(sha256(a.final_url), 1, 20)) and a.image_id not in (select image_id from images b join s on h = substr(sha256(b.request_url), 1, 20) or h = substr(sha256(b.final_url), 1, 20))")
def without_stored_blob(spark: SparkSession, d: str) -> DataFrame:
    stored = load(spark, d, "articles").filter("http_status = 200")
    return panels.without_stored_blob(load(spark, d, "images"), stored, key="image_id", urls=["request_url", "final_url"], stored_key="document_id")


_AUDIT = r"""with a as (select document_id, arg_min({'b': body, 'p': paragraphs, 'i': images, 't': tags, 's': body_selector, 'h': title}, (retrieved_at_utc, collection_run_id)) as x from articles group by document_id),
w as (select document_id, x, trim(regexp_replace(coalesce(x.b, ''), '[\s\p{Z}]+', ' ', 'g')) as s from a),
u as (select document_id, case when trim(coalesce(x.h, '')) = '' then 'failed' else 'ok' end as status, x.s is not null as has_selector, cast(case when s = '' then 0 else length(s) - length(replace(s, ' ', '')) + 1 end as integer) as word_count,
 cast(coalesce(len(x.p), 0) as integer) as paragraph_count, cast(coalesce(len(x.i), 0) as integer) as image_count, cast(coalesce(len(list_filter(x.i, lambda i: i.image_role = 'hero')), 0) as integer) as hero_image_count,
 cast(coalesce(len(list_filter(x.i, lambda i: i.image_role = 'inline')), 0) as integer) as inline_image_count, cast(coalesce(len(list_filter(x.i, lambda i: coalesce(i.figcaption, '') <> '')), 0) as integer) as caption_count, cast(coalesce(len(x.t), 0) as integer) as tag_count from w)
"""


@query("page_audit", _AUDIT + "select * from u")
def page_audit(spark: SparkSession, d: str) -> DataFrame:
    return panels.page_audit(load(spark, d, "articles"))


@query("page_audit_summary", _AUDIT + "select count(*) as pages, count(*) filter (where has_selector) as selector_present, count(*) filter (where status = 'ok') as parsed_ok, count(*) filter (where status = 'failed') as failed, cast(sum(word_count) as bigint) as total_words, cast(sum(image_count) as bigint) as total_images, cast(sum(caption_count) as bigint) as total_captions from u")
def page_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return panels.page_audit_summary(panels.page_audit(load(spark, d, "articles")))


@query("reextraction_difference")
def reextraction_difference(spark: SparkSession, d: str) -> DataFrame:
    """Stored paragraphs against those that come back from a page made of them."""
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min(F.struct("retrieved_at_utc", "title", "paragraphs", "author", "published_at", "final_url")).alias("x")).select("document_id", "x.*")
    pages = a.select("document_id", "final_url", html.page_from_record(F.col("title"), F.col("paragraphs"), F.col("author"), F.col("published_at")).alias("html"))
    out = html.extract_articles(pages, record="document_id", html="html", url="final_url")
    stored = a.select("document_id", F.array_join("paragraphs", "\n\n").alias("body"))
    return panels.reextraction_difference(stored, out.select(F.col("record").alias("document_id"), "body", "error"))


# ---- clean-up, digests, fields


@query("cleaned_documents", "select doc_id, case when lower(trim(title)) not in ('', 'nan', 'none', 'null', 'n/a') then title end as title, case when lower(trim(author)) not in ('', 'nan', 'none', 'null', 'n/a') then author end as author, case when lower(trim(lang)) not in ('', 'nan', 'none', 'null', 'n/a') then lang end as lang from documents")
def cleaned_documents(spark: SparkSession, d: str) -> DataFrame:
    return panels.cleaned(load(spark, d, "documents").select("doc_id", "title", "author", "lang"))


@query("sentences_with_defaults", "select coalesce(document_id, '') as document_id, coalesce(sentence_id, '') as sentence_id, coalesce(try_cast(sentence_index as integer), 0) as sentence_index, coalesce(sentence, '') as sentence, coalesce(quotation_flag, false) as quotation_flag, 0 as token_count from frame_candidates")
def sentences_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    fields = {"document_id": ("string", ""), "sentence_id": ("string", ""), "sentence_index": ("int", 0), "sentence": ("string", ""), "quotation_flag": ("boolean", False), "token_count": ("int", 0)}
    return panels.with_defaults(load(spark, d, "frame_candidates"), fields)


@query("article_string_fields", " union all ".join([f"select document_id, '{c}' as path, count({c}) as n, cast(coalesce(sum(length({c})), 0) as bigint) as characters from articles group by document_id having count({c}) > 0" for c in ("title", "section", "author")] + [
    "select document_id, 'tags[]', count(t), cast(coalesce(sum(length(t)), 0) as bigint) from (select document_id, unnest(tags) as t from articles) group by document_id having count(t) > 0",
    "select document_id, 'images[].alt_text', count(i.alt_text), cast(coalesce(sum(length(i.alt_text)), 0) as bigint) from (select document_id, unnest(images) as i from articles) group by document_id having count(i.alt_text) > 0",
]))
def article_string_fields(spark: SparkSession, d: str) -> DataFrame:
    f = panels.string_fields(load(spark, d, "articles").select("document_id", "title", "section", "author", "tags", F.transform("images", lambda i: F.struct(i["alt_text"].alias("alt_text"))).alias("images")), key="document_id")
    return f.groupBy("document_id", "path").agg(F.count("value").alias("n"), F.sum(F.length("value")).cast("bigint").alias("characters")).filter("n > 0")


@query("record_hashes", "select image_id, sha256(cast(to_json(struct_pack(dom_index := dom_index, height := height, image_id := image_id, mime_type := mime_type, sha256 := sha256, width := width)) as varchar)) as record_sha256 from images")
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").select("image_id", "width", "height", "mime_type", "sha256", "dom_index")
    return i.select("image_id", panels.record_hash(i).alias("record_sha256"))


@query("scaled_balances", "select c_custkey, round(coalesce((c_acctbal - lo) / nullif(hi - lo, 0), 0), 6) as scaled from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)")
def scaled_balances(spark: SparkSession, d: str) -> DataFrame:
    return panels.min_max_scaled(load(spark, d, "customer"), "c_acctbal").select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query("numbered_events", "select event_id, row_number() over (order by ts, event_id) as row_number from events")
def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    return panels.numbered(load(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")]).select("event_id", "row_number")


# ---- summaries, filters and examples


@query("corpus_kpis", f"""with a as (select document_id, min(final_url) as u, min(coalesce(word_count, 0)) as w, min(retrieved_at_utc) as r, min(author) as author, min(len(coalesce(images, []))) as i, min(len(coalesce(paragraphs, []))) as p from articles group by document_id),
t as (select document_id, token_index, min({_LEMMA}) as term from tokens where is_alpha group by 1, 2),
g as (select count(distinct tag) as n_tags from (select unnest(tags) as tag from articles)), c as (select count(distinct image_id) as n_captions from images where trim(figcaption) <> '')
select count(*) as n_documents, cast(sum(w) as bigint) as n_words, cast(sum(p) as bigint) as n_paragraphs, cast(sum(i) as bigint) as n_images, count(distinct author) as n_authors, count(distinct regexp_extract(u, '://([^/]+)', 1)) as n_hosts,
 min(r) as first_retrieved, max(r) as last_retrieved, count(*) filter (where w = 0) as n_zero_word, count(*) filter (where w > 0 and w < 20) as n_short, count(*) filter (where i > 0) as n_with_images,
 any_value(n_tags) as n_tags, any_value(n_captions) as n_captions, (select count(distinct term) from t) as n_unique_terms from a, g, c""")  # fmt: skip
def corpus_kpis(spark: SparkSession, d: str) -> DataFrame:
    articles = load(spark, d, "articles")
    size = lambda c: F.size(F.coalesce(c, F.array().cast(dict(articles.dtypes)[c])))
    a = articles.groupBy("document_id").agg(F.min("final_url").alias("u"), F.min(F.coalesce("word_count", F.lit(0))).alias("w"), F.min("retrieved_at_utc").alias("r"), F.min("author").alias("author"), F.min(size("images")).alias("i"), F.min(size("paragraphs")).alias("p"))
    main = a.agg(
        F.count("*").alias("n_documents"), F.sum("w").alias("n_words"), F.sum("p").alias("n_paragraphs"), F.sum("i").alias("n_images"), F.count_distinct("author").alias("n_authors"), F.count_distinct(F.regexp_extract("u", "://([^/]+)", 1)).alias("n_hosts"),
        F.min("r").alias("first_retrieved"), F.max("r").alias("last_retrieved"), F.count_if(F.col("w") == 0).alias("n_zero_word"), F.count_if(F.col("w").between(1, 19)).alias("n_short"), F.count_if(F.col("i") > 0).alias("n_with_images"),
    )
    tags = articles.select(F.explode("tags").alias("t")).agg(F.count_distinct("t").alias("n_tags"))
    captions = load(spark, d, "images").filter(F.trim("figcaption") != "").agg(F.count_distinct("image_id").alias("n_captions"))
    term = F.lower(F.coalesce(F.when(F.trim("lemma") != "", F.trim("lemma")), F.col("lower")))
    terms = load(spark, d, "tokens").filter("is_alpha").groupBy("document_id", "token_index").agg(F.min(term).alias("t")).agg(F.count_distinct("t").alias("n_unique_terms"))
    out = main.withColumn("_k", F.lit(1))
    for more in (tags, captions, terms):  # one row each
        out = out.join(F.broadcast(more.withColumn("_k", F.lit(1))), "_k")
    return out.drop("_k")


_STATUSES = (("content", "content_status", "content_status"), ("footer", "status", "footer_truncation"))


@query("status_histograms", " union all ".join(f"select '{name}' as field, {column} as value, count(*) as n from ({SQL[q]}) group by 2" for name, column, q in _STATUSES))
def status_histograms(spark: SparkSession, d: str) -> DataFrame:
    parts = [QUERIES[q](spark, d).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("field"), "value", "n") for name, column, q in _STATUSES]
    return parts[0].unionByName(parts[1])


@query("image_roles_by_period", """with i as (select image_id, min(document_id) as document_id, min(image_role) as image_role from images group by image_id), a as (select document_id, min(retrieved_at_utc) as r from articles group by document_id),
j as (select image_role, r from i left join a using (document_id)), u as (select 'month' as unit, substr(r, 1, 7) as period, image_role from j union all select 'year', substr(r, 1, 4), image_role from j)
select unit, period, image_role, count(*) as n from u group by 1, 2, 3""")  # fmt: skip
def image_roles_by_period(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").groupBy("image_id").agg(F.min("document_id").alias("document_id"), F.min("image_role").alias("image_role"))
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min("retrieved_at_utc").alias("r"))
    units = F.array(F.struct(F.lit("month").alias("unit"), F.substring("r", 1, 7).alias("period")), F.struct(F.lit("year").alias("unit"), F.substring("r", 1, 4).alias("period")))
    return i.join(a, "document_id", "left").select("image_role", F.explode(units).alias("u")).groupBy("u.unit", "u.period", "image_role").agg(F.count("*").alias("n"))


@query("lemma_sentences", f"""with o as (select distinct document_id, sentence_index, {_LEMMA} as lemma from tokens where is_alpha), t as (select lemma from o group by lemma order by count(*) desc, lemma limit 200),
s as (select document_id, sentence_index, min(sentence) as sentence from frame_candidates group by 1, 2) select lemma, document_id, sentence_index, sentence from o join t using (lemma) join s using (document_id, sentence_index)""")
def lemma_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of the 200 lemmas that are in the most sentences."""
    lemma = F.lower(F.coalesce(F.when(F.trim("lemma") != "", F.trim("lemma")), F.col("lower")))
    o = load(spark, d, "tokens").filter("is_alpha").select("document_id", "sentence_index", lemma.alias("lemma")).distinct()
    top = o.groupBy("lemma").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lemma").limit(200).select("lemma")
    s = load(spark, d, "frame_candidates").groupBy("document_id", "sentence_index").agg(F.min("sentence").alias("sentence"))
    return o.join(F.broadcast(top), "lemma").join(s, ["document_id", "sentence_index"]).select("lemma", "document_id", "sentence_index", "sentence")  # 200 rows


@query("systematic_events", "with n as (select event_id, row_number() over (order by ts, event_id) as r, count(*) over () as n from events) select event_id from n where r % cast(ceil(n / 1800.0) as integer) = 0")
def systematic_events(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.explore import systematic_sample

    rows = panels.numbered(load(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")])
    return systematic_sample(rows, key="row_number").select("event_id")


_CATALOGUE = "c as (select document_id as id, min(title) as title, min(author) as author, min(tags) as tags, min(cast(substr(retrieved_at_utc, 1, 4) as integer)) as year, case when min(published_at) is null then 'missing' else 'ok' end as date_flag, min(len(coalesce(images, []))) as image_count, min(word_count) as word_count from articles group by document_id)"


@query("document_explorer", f"with {_CATALOGUE} select id, word_count from c where contains(lower(coalesce(title, '') || ' ' || coalesce(author, '') || ' ' || array_to_string(coalesce(tags, []), ' ') || ' ' || id), 'the') and image_count > 0 and date_flag = 'ok' and word_count between 100 and 2000")
def document_explorer(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "articles")
    c = a.groupBy(F.col("document_id").alias("id")).agg(F.min("title").alias("title"), F.min("author").alias("author"), F.min("tags").alias("tags"), F.min(F.substring("retrieved_at_utc", 1, 4).cast("int")).alias("year"), F.when(F.min("published_at").isNull(), "missing").otherwise("ok").alias("date_flag"), F.min(F.coalesce(F.size("images"), F.lit(0))).alias("image_count"), F.min("word_count").alias("word_count"))
    return panels.document_filter(c, text="the", date_flag="ok", has_image=True, words=(100, 2000)).select("id", "word_count")


@query("review_explorer", "with q as (select sentence_id, min(document_id) as document_id, min(lower(trim(frame))) as category, min(sentence) as sentence, bool_or(quotation_flag) as qf, bool_or(reported_speech_flag) as rf from frame_candidates where trim(frame) <> '' group by sentence_id), a as (select document_id, min(title) as title from articles group by document_id) select sentence_id from q left join a using (document_id) where category = 'press_trust' and (coalesce(qf, false) or coalesce(rf, false)) and contains(lower(coalesce(sentence, '') || ' ' || coalesce(category, '') || ' ' || coalesce(document_id, '') || ' ' || coalesce(title, '')), 'the')")
def review_explorer(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "frame_candidates").filter(F.trim("frame") != "").groupBy("sentence_id").agg(F.min("document_id").alias("document_id"), F.min(F.lower(F.trim("frame"))).alias("category"), F.min("sentence").alias("sentence"), F.bool_or("quotation_flag").alias("quotation_flag"), F.bool_or("reported_speech_flag").alias("reported_speech_flag"))
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min("title").alias("title"))
    return panels.review_filter(q, a, category="press_trust", quoted_only=True, text="the").select("sentence_id")


@query("rejected_images", "select image_id, case when mime_type is null or mime_type not like 'image/%' then 'not_an_image' else 'other_host' end as reject_reason, count(*) as n from images where not coalesce(mime_type like 'image/%' and regexp_extract(lower(final_url), '://([^/:?#]+)', 1) in (select host from (select lower(host) as host from outlets union all select 'www.' || lower(host) from outlets)), false) group by 1, 2")
def rejected_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of other hosts or types; the hosts are those of the outlets, joined as a table."""
    hosts = load(spark, d, "outlets").select(F.explode(F.array(F.lower("host"), F.concat(F.lit("www."), F.lower("host")))).alias("h")).distinct().withColumn("known", F.lit(True))
    i = load(spark, d, "images").withColumn("h", F.regexp_extract(F.lower("final_url"), r"://([^/:?#]+)", 1)).join(hosts, "h", "left")
    is_image = F.coalesce(F.col("mime_type").startswith("image/"), F.lit(False))
    _, rejected = panels.split_by(i, is_image & F.col("known"), F.when(~is_image, "not_an_image").otherwise("other_host"))
    return rejected.groupBy("image_id", "reject_reason").agg(F.count("*").alias("n"))


@query("date_issues", "select o_orderkey, case when o_orderdate is null then 'missing' else 'future' end as flag from orders where o_orderdate is null or o_orderdate > timestamp '1997-01-01'")
def date_issues(spark: SparkSession, d: str) -> DataFrame:
    flag = temporal.date_quality("o_orderdate", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    return load(spark, d, "orders").select("o_orderkey", flag.alias("flag")).filter("flag <> 'ok'")


@query("image_url_facts", r"""with u as (select image_id, regexp_replace(final_url, '[.,;:!?)\]}]+$', '') as url from (select distinct image_id, final_url from images) where final_url is not null),
f as (select url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) as scheme, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') as hostname,
 regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)', 1)), '[^/.](\.[^./]+)$', 1) as extension from u)
select url, scheme, hostname, extension, extension in ('.exe', '.dll', '.js', '.sh', '.jar', '.img', '.so') as is_runnable from f""")  # fmt: skip
def image_url_facts(spark: SparkSession, d: str) -> DataFrame:
    return panels.url_facts(load(spark, d, "images").select("image_id", "final_url").distinct(), url="final_url")


@query("tag_examples", "with t as (select distinct lower(trim(t)) as tag, doc_id from (select doc_id, unnest(string_split(tags, '|')) as t from documents) where trim(t) <> ''), r as (select tag, doc_id, row_number() over (partition by tag order by doc_id) as r from t) select tag, doc_id, cast(r as integer) as r from r where r <= 3")
def tag_examples(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "documents").select("doc_id", F.explode(F.split("tags", r"\|")).alias("t")).filter(F.trim("t") != "").select(F.lower(F.trim("t")).alias("tag"), "doc_id").distinct()
    return panels.examples_per_group(t, group="tag", order=[F.col("doc_id")])


@query("collocation_pair_examples", _COLLOCATIONS.replace("x as (select node", "e as (select node, unnest(list_distinct(list_filter(list_concat(toks[greatest(i - 5, 1):i - 1], toks[i + 1:i + 5]), lambda x: length(x) > 1))) as collocate, doc_id, i, array_to_string(toks[greatest(i - 8, 1):i + 8], ' ') as context from a),\nx as (select node")
    + ", r as (select e.node, e.collocate, context, row_number() over (partition by e.node, e.collocate order by doc_id, i) as r from e join p on p.node = e.node and p.collocate = e.collocate) select node, collocate, string_agg(context, ' || ' order by r) as examples from r where r <= 3 group by 1, 2")
def collocation_pair_examples(spark: SparkSession, d: str) -> DataFrame:
    return lexical.collocation_pair_examples(load(spark, d, "documents"), record="doc_id", body="text", nodes=NODES)


# ---- topics


@query("topic_terms")
def topic_terms(spark: SparkSession, d: str) -> DataFrame:
    """English documents in ten topics with their terms."""
    docs = load(spark, d, "documents").filter("lower(lang) = 'en'")
    found = topics.topic_clusters(docs, record="doc_id", body="text")
    return topics.topic_terms(docs, found, record="doc_id", body="text").withColumn("score", F.round("score", 6))


@query("topic_stability")
def topic_stability(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the topics of three seeds, every pair."""
    docs = load(spark, d, "documents").filter("lower(lang) = 'en'")
    by_seed = {s: cut_lineage(topics.topic_clusters(docs, record="doc_id", body="text", seed=s)) for s in (13, 42, 87)}
    parts = []
    for a, b in ((13, 42), (13, 87), (42, 87)):
        j = by_seed[a].withColumnRenamed("topic", "a").join(by_seed[b].withColumnRenamed("topic", "b"), "record")
        parts.append(stats.adjusted_rand(j, "a", "b").select(F.lit(a).alias("seed_1"), F.lit(b).alias("seed_2"), F.round("ari", 6).alias("ari")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- listings and markers


@query("marker_panel", f"select * from ({SQL['marker_totals']}) where marker not like 'frame\\_%' escape '\\' and marker not like 'legitimation\\_%' escape '\\' order by total desc, marker limit 14")
def marker_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.without_prefixes(QUERIES["marker_totals"](spark, d))


@query("image_listing_order", "select image_id, row_number() over (order by coalesce(dom_index, 0), coalesce(position, 0), image_id) as place from (select image_id, min(dom_index) as dom_index, min(position) as position from images group by image_id)")
def image_listing_order(spark: SparkSession, d: str) -> DataFrame:
    i = load(spark, d, "images").groupBy("image_id").agg(F.min("dom_index").alias("dom_index"), F.min("position").alias("position"))
    order = [F.coalesce("dom_index", F.lit(0)), F.coalesce("position", F.lit(0)), F.col("image_id")]
    return panels.numbered(i, order, "place").select("image_id", "place")


_VISITS = "v as (select user_id, cast(ts as date) as day, count(*) filter (where event_type = 'purchase') as n_found from events group by 1, 2)"


@query("days_until_no_purchase", f"with {_VISITS}, w as (select *, case when n_found = 0 and lag(n_found) over (partition by user_id order by day) = 0 then 1 else 0 end as stop from v), x as (select *, coalesce(sum(stop) over (partition by user_id order by day rows between unbounded preceding and 1 preceding), 0) as before from w) select user_id, strftime(day, '%Y-%m-%d') as day, n_found from x where before = 0")
def days_until_no_purchase(spark: SparkSession, d: str) -> DataFrame:
    """A user's days up to the second in a row without a purchase: the stop rule of listings on the event stream."""
    v = load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n_found"))
    out = panels.pages_until_empty(v, listing="user_id", page="day", found="n_found")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n_found")
