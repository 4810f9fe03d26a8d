"""Text queries of the registry, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stats, text
from textloom.operators import discourse, explore, lexical, quality
from textloom.queries_core import query
from textloom.runtime import load


def tok(column: str) -> str:
    """SQL list of word tokens; RE2 has no Unicode word boundary, so digit-led parts are stripped
    afterwards; combining marks end a token."""
    found = rf"regexp_extract_all(regexp_replace(coalesce({column}, ''), '\p{{M}}', ' ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}_]+(?:[''’-]+[\p{{L}}\p{{M}}\p{{N}}_]+)*')"
    stripped = rf"list_transform({found}, lambda x: replace(lower(regexp_replace(x, '^(?:[\p{{N}}\p{{M}}_][\p{{L}}\p{{M}}\p{{N}}_]*(?:[''’-]+|$))+', '')), '’', ''''))"
    return f"list_filter({stripped}, lambda x: x <> '')"


STOP = ", ".join("'" + w + "'" for w in text.STOPWORDS)
SQUEEZE = r"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}\x{{0b}}\x{{85}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"


def squeeze(column: str) -> str:
    return SQUEEZE.format(c=column)


def sents(column: str) -> str:
    marked = rf"regexp_replace({squeeze(column)}, '([.!?])\s+([A-Z0-9\"''“‘(])', '\1' || chr(1) || '\2', 'g')"
    # Matches can't overlap in RE2, so one-letter sentences are marked in a second round.
    marked = rf"regexp_replace({marked}, '([.!?])\s+([A-Z0-9\"''“‘(])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


CONTENT = f"list_filter(toks, lambda t: length(t) >= 2 and t not in ({STOP}))"
TOKS = f"with d as (select doc_id, source, {tok('text')} as toks from documents)"


@query("term_frequencies_topk", f"""{TOKS}, c as (select doc_id, {CONTENT} as items from d),
e as (select doc_id, unnest(items) as term from c), n as (select sum(len(items)) as total, count(*) as docs from c),
g as (select term, count(*) as frequency, count(distinct doc_id) as document_frequency from e group by term)
select term, cast(frequency as bigint) as frequency, cast(document_frequency as bigint) as document_frequency,
 round(frequency * 1e6 / total, 6) as per_million, round(document_frequency / docs::double, 6) as document_proportion
from g, n order by frequency desc, term limit 500""")  # fmt: skip
def term_frequencies_topk(spark: SparkSession, d: str) -> DataFrame:
    f = lexical.term_frequencies(load(spark, d, "documents"), record="doc_id", body="text")
    f = f.withColumn("per_million", F.round("per_million", 6)).withColumn("document_proportion", F.round("document_proportion", 6))
    return f.orderBy(F.desc("frequency"), "term").limit(500)


def _ngram_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"""{TOKS}, c as (select doc_id, list_filter(toks, lambda t: length(t) > 1) as t from d),
x as (select doc_id, t, unnest(range(1, len(t) - {n - 2})) as i from c where len(t) >= {n}), e as (select doc_id, {parts} as ngram from x),
n as (select sum(greatest(len(t) - {n - 1}, 0)) as total, count(*) as docs from c),
g as (select ngram, count(*) as frequency, count(distinct doc_id) as document_frequency from e group by ngram having count(*) >= 5)
select ngram, cast(frequency as bigint) as frequency, cast(document_frequency as bigint) as document_frequency, round(frequency * 1e6 / total, 6) as per_million from g, n"""


def _ngrams(n: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = lexical.ngram_frequencies(load(spark, d, "documents"), record="doc_id", body="text", n=n)
        return f.select("ngram", "frequency", "document_frequency", F.round("per_million", 6).alias("per_million"))

    return run


query("bigram_frequencies", _ngram_sql(2))(_ngrams(2))
query("trigram_frequencies", _ngram_sql(3))(_ngrams(3))

_SYL = "case when regexp_replace(w, '[^a-z]', '', 'g') = '' then 0 else greatest(1, len(regexp_extract_all(regexp_replace(w, '[^a-z]', '', 'g'), '[aeiouy]+')) - case when regexp_replace(w, '[^a-z]', '', 'g') like '%e' and regexp_replace(w, '[^a-z]', '', 'g') not like '%le' and regexp_replace(w, '[^a-z]', '', 'g') not like '%ye' and len(regexp_extract_all(regexp_replace(w, '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 then 1 else 0 end) end"


@query("document_readability", f"""with d as (select doc_id, {tok('text')} as toks, {sents('text')} as ss from documents),
m as (select doc_id, len(toks) as w, len(ss) as s, greatest(1, len(ss)) as ns, coalesce(list_sum(list_transform(toks, lambda w: {_SYL})), 0) as syl,
  coalesce(list_sum(list_transform(toks, lambda x: length(x))), 0) as ch, len(list_distinct(toks)) as types from d)
select doc_id, cast(w as bigint) as word_count, cast(s as bigint) as sentence_count, round(w / ns::double, 6) as mean_sentence_words,
 round(case when w = 0 then 0 else ch / w::double end, 6) as mean_word_characters, round(case when w = 0 then 0 else types / w::double end, 6) as type_token_ratio,
 round(206.835 - 1.015 * (w / ns::double) - 84.6 * (case when w = 0 then 0 else syl / w::double end), 4) as flesch_reading_ease_estimate from m""")  # fmt: skip
def document_readability(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "documents").select("doc_id", text.readability(F.col("text")).alias("r")).select("doc_id", "r.*")
    for c in ("mean_sentence_words", "mean_word_characters", "type_token_ratio"):
        r = r.withColumn(c, F.round(c, 6))
    return r.withColumn("flesch_reading_ease_estimate", F.round("flesch_reading_ease_estimate", 4))


@query("document_mattr", f"""{TOKS}
select doc_id, round(case when len(toks) = 0 then 0 when len(toks) <= 50 then len(list_distinct(toks)) / len(toks)::double
 else list_avg(list_transform(range(1, len(toks) - 48), lambda i: len(list_distinct(toks[i:i+49])) / 50.0)) end + 1e-9, 6) as mattr_50 from d""")  # fmt: skip
def document_mattr(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(text.mattr(text.tokens(F.col("text"))) + 1e-9, 6).alias("mattr_50"))


_KEY = f"""{TOKS}, c as (select doc_id, source = 'tavrin-courier' as target, {CONTENT} as items from d where source is not null),
e as (select doc_id, target, unnest(items) as term from c),
t as (select term, count(*) as k1, count(distinct doc_id) as d1 from e where target group by term having count(*) >= 5),
r as (select term, count(*) as k2, count(distinct doc_id) as d2 from e where not target group by term),
n as (select coalesce(sum(len(items)) filter (where target), 0)::double as n1, coalesce(sum(len(items)) filter (where not target), 0)::double as n2 from c),
j as (select t.term, k1, d1, coalesce(k2, 0) as k2, coalesce(d2, 0) as d2, n1, n2 from t left join r using (term), n),
s as (select *, 2 * ((case when k1 = 0 then 0 else k1 * ln(k1 / (n1 * (k1 + k2) / (n1 + n2))) end) + (case when k2 = 0 then 0 else k2 * ln(k2 / (n2 * (k1 + k2) / (n1 + n2))) end)) as g2 from j)
"""


def _keyness(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("source is not null")
    return lexical.keyness(docs.filter("source = 'tavrin-courier'"), docs.filter("source <> 'tavrin-courier'"), record="doc_id", body="text")


@query("keyness_g2_logratio", _KEY + """select term, cast(k1 as bigint) as target_frequency, cast(d1 as bigint) as target_document_frequency, cast(k2 as bigint) as comparator_frequency,
 cast(d2 as bigint) as comparator_document_frequency, round(g2, 4) as log_likelihood, round(log2(((k1 + 0.5) / (n1 + 0.5)) / ((k2 + 0.5) / (n2 + 0.5))), 6) as log_ratio from s""")  # fmt: skip
def keyness_g2_logratio(spark: SparkSession, d: str) -> DataFrame:
    k = _keyness(spark, d)
    return k.drop("p_value").withColumn("log_likelihood", F.round("log_likelihood", 4)).withColumn("log_ratio", F.round("log_ratio", 6))


@query("keyness_bh", _KEY + """, u as (select term, greatest(g2, 0) as x, 1 / (1 + 0.5 * sqrt(greatest(g2, 0) / 2)) as t from s),
p as (select term, t * exp(-x / 2 + (-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))) as p from u),
k as (select term, p, row_number() over (order by p) as r, count(*) over () as m from p)
select term, round(p, 6) as p_value, round(least(1.0, min(p * m / r) over (order by r rows between current row and unbounded following)), 6) as q_value_bh from k""")  # fmt: skip
def keyness_bh(spark: SparkSession, d: str) -> DataFrame:
    k = stats.benjamini_hochberg(_keyness(spark, d).select("term", "p_value"), "p_value")
    return k.select("term", F.round("p_value", 6).alias("p_value"), F.round("q_value_bh", 6).alias("q_value_bh"))


NODES = ["council", "school", "station", "family", "government"]
_NODES = ", ".join(f"'{n}'" for n in NODES)
_AT = f"a as (select doc_id, toks, i, toks[i] as node from (select doc_id, toks, unnest(range(1, len(toks) + 1)) as i from d where list_has_any(toks, [{_NODES}])) where toks[i] in ({_NODES}))"


@query("collocations_pmi_logdice", f"""{TOKS}, {_AT},
w as (select doc_id, node, unnest(list_filter(list_concat(toks[greatest(i - 5, 1):i - 1], toks[i + 1:i + 5]), lambda x: length(x) > 1)) as collocate from a),
p as (select node, collocate, count(*) as f, count(distinct doc_id) as df from w group by 1, 2 having count(*) >= 5),
t as (select unnest(toks) as t from d), c as (select t, count(*) as f from t group by t), n as (select count(*) as n from t)
select node, collocate, cast(p.f as bigint) as cooccurrence_frequency, cast(cn.f as bigint) as node_frequency, cast(cc.f as bigint) as collocate_frequency, cast(df as bigint) as document_frequency,
 round(log2(p.f * n::double / (cn.f * cc.f::double)), 6) as pmi, round(14 + log2(2.0 * p.f / (cn.f + cc.f)), 6) as logdice
from p join c cn on cn.t = node join c cc on cc.t = collocate, n""")  # fmt: skip
def collocations_pmi_logdice(spark: SparkSession, d: str) -> DataFrame:
    c = lexical.collocations(load(spark, d, "documents"), record="doc_id", body="text", nodes=NODES)
    return c.withColumn("pmi", F.round("pmi", 6)).withColumn("logdice", F.round("logdice", 6))


@query("collocation_examples", f"""{TOKS}, {_AT},
r as (select node, doc_id, i, array_to_string(toks[greatest(i - 8, 1):i + 8], ' ') as context, row_number() over (partition by node order by doc_id, i) as r from a)
select node, string_agg(context, ' || ' order by r) as examples from r where r <= 3 group by node""")  # fmt: skip
def collocation_examples(spark: SparkSession, d: str) -> DataFrame:
    return lexical.collocation_examples(load(spark, d, "documents"), record="doc_id", body="text", nodes=NODES)


@query("exact_duplicate_groups", """select sha256(text) as text_sha256, count(*) as n_records, min(doc_id) as first_record, max(doc_id) as last_record
from documents where text is not null and text <> '' group by text having count(*) > 1""")  # fmt: skip
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return quality.exact_duplicate_groups(load(spark, d, "documents"), record="doc_id", body="text")


@query("exact_duplicate_members", """with g as (select text, min(doc_id) as representative from documents where text is not null and text <> '' group by text having count(*) > 1)
select doc_id as record, sha256(text) as text_sha256, representative from documents join g using (text)""")  # fmt: skip
def exact_duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return quality.exact_duplicate_members(load(spark, d, "documents"), record="doc_id", body="text")


@query("email_redaction", r"""select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) as bigint) as n_emails,
 sha256(regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL_REDACTED]', 'g')) as redacted_sha256 from documents""")  # fmt: skip
def email_redaction(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", text.email_count(t).cast("bigint").alias("n_emails"), F.sha2(text.redact_emails(t), 256).alias("redacted_sha256"))


@query("text_normalisation")
def text_normalisation(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2(text.normalise_text(F.col("text")), 256).alias("normalised_sha256"))


@query("word_counts_four_ways", f"""with d as (select doc_id, {squeeze('text')} as s, {tok('text')} as toks from documents)
select doc_id, cast(case when s = '' then 0 else length(s) - length(replace(s, ' ', '')) + 1 end as bigint) as white_space_words, cast(len(toks) as bigint) as tokens,
 cast(len({CONTENT}) as bigint) as content_tokens, cast(len(list_filter(toks, lambda t: length(t) > 1)) as bigint) as longer_tokens from d""")  # fmt: skip
def word_counts_four_ways(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "documents").select("doc_id", "text", text.tokens(F.col("text")).alias("toks"))
    sizes = {"tokens": F.col("toks"), "content_tokens": text.content_tokens(F.col("toks")), "longer_tokens": F.filter("toks", lambda t: F.length(t) > 1)}
    return x.select("doc_id", text.white_space_words(F.col("text")).cast("bigint").alias("white_space_words"), *[F.size(v).cast("bigint").alias(k) for k, v in sizes.items()])


@query("pattern_scan")
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    return quality.pattern_counts(load(spark, d, "documents"), record="doc_id", body="text")


@query("scan_totals", r"""with t as (select coalesce(text, '') as t from documents) select count(*) as n_rows, count(*) filter (where trim(t) = '') as n_blank,
 cast(sum(len(regexp_extract_all(t, '(?i)\b(?:https?|ftp|file|data|javascript|vbscript|about):(?://)?[^\s<>"''{}|\\^`\[\]]+'))) as bigint) as n_urls,
 cast(sum(len(regexp_extract_all(t, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]'))) as bigint) as n_control,
 cast(sum(len(regexp_extract_all(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'))) as bigint) as n_emails from t""")  # fmt: skip
def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    return quality.scan_totals(load(spark, d, "documents"), body="text").drop("n_base64", "n_hex")


@query("scan_blobs")
def scan_blobs(spark: SparkSession, d: str) -> DataFrame:
    return quality.scan_totals(load(spark, d, "documents"), body="text").select("n_rows", "n_base64", "n_hex")


@query("url_schemes", r"""with u as (select unnest(regexp_extract_all(text, '(?i)\b(?:https?|ftp|file|data|javascript|vbscript|about):(?://)?[^\s<>"''{}|\\^`\[\]]+')) as u from documents)
select lower(regexp_extract(u, '^([A-Za-z]+):', 1)) as scheme, count(*) as n from u group by 1""")  # fmt: skip
def url_schemes(spark: SparkSession, d: str) -> DataFrame:
    return quality.url_schemes(load(spark, d, "documents"), body="text")


_SENT = f"s as (select doc_id, unnest(ss) as sentence, unnest(range(0, len(ss))) as sentence_index from (select doc_id, {sents('text')} as ss from documents))"


def _lex(term: str) -> str:
    return rf"(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_]){term}(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])"


_FRAME_HITS = " union all ".join(f"select doc_id, sentence_index, sentence, '{f}' as frame, '{t}' as term from s where regexp_matches(sentence, '{_lex(t)}')" for f, terms in discourse.FRAMES.items() for t in terms)


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return discourse.sentence_rows(load(spark, d, "documents"), record="doc_id", body="text")


@query("sentence_rows", f"with {_SENT} select cast(doc_id as varchar) as document_id, doc_id || '-s' || lpad(cast(sentence_index as varchar), cast(greatest(4, length(cast(sentence_index as varchar))) as integer), '0') as sentence_id, cast(sentence_index as integer) as sentence_index, sentence from s")
def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d)


@query("lexicon_candidates", f"with {_SENT}, h as ({_FRAME_HITS}) select cast(doc_id as varchar) as document_id, cast(sentence_index as integer) as sentence_index, frame, string_agg(term, '|' order by term) as matched_terms from h group by all")
def lexicon_candidates(spark: SparkSession, d: str) -> DataFrame:
    return discourse.lexicon_candidates(_sentences(spark, d), discourse.FRAMES).select("document_id", "sentence_index", "frame", "matched_terms")


@query("lexicon_counts_by_document", f"with {_SENT}, h as ({_FRAME_HITS}), k as (select distinct doc_id, sentence_index, frame from h) select cast(doc_id as varchar) as document_id, " + ", ".join(f"count(*) filter (where frame = '{f}') as frame_{f}" for f in discourse.FRAMES) + " from k group by doc_id")
def lexicon_counts_by_document(spark: SparkSession, d: str) -> DataFrame:
    c = discourse.lexicon_candidates(_sentences(spark, d), discourse.FRAMES)
    return discourse.category_counts(c, category="frame", values=list(discourse.FRAMES), prefix="frame")


_STRATEGY_HITS = " union all ".join(f"select doc_id, sentence_index, '{f}' as strategy, '{t}' as term from s where regexp_matches(sentence, '{_lex(t)}')" for f, terms in discourse.STRATEGIES.items() for t in terms)


@query("strategy_counts", f"with {_SENT}, h as ({_STRATEGY_HITS}) select strategy, count(distinct (doc_id, sentence_index)) as n_sentences, count(distinct doc_id) as n_documents from h group by strategy")
def strategy_counts(spark: SparkSession, d: str) -> DataFrame:
    c = discourse.lexicon_candidates(_sentences(spark, d), discourse.STRATEGIES, label="strategy")
    per = c.groupBy("strategy", "document_id").agg(F.count("*").alias("k"))
    return per.groupBy("strategy").agg(F.sum("k").alias("n_sentences"), F.count("*").alias("n_documents"))


_HIT = "array_to_string(list_sort(list_filter(list_distinct({t}), lambda x: x in ({v}))), '|')"
_REP, _PRE = (", ".join(f"'{w}'" for w in ws) for ws in (discourse.REPORTING_VERBS, discourse.PRESUPPOSITION))


@query("sentence_flags", f"""with {_SENT}, f as (select *, {tok('sentence')} as toks from s), g as (select *, {_HIT.format(t='toks', v=_REP)} as reporting_verb_hits, {_HIT.format(t='toks', v=_PRE)} as presupposition_trigger_hits, regexp_matches(sentence, '["“”‘’]') as quotation_flag from f)
select cast(doc_id as varchar) as document_id, cast(sentence_index as integer) as sentence_index, quotation_flag, (quotation_flag or reporting_verb_hits <> '') as reported_speech_flag, reporting_verb_hits, sentence like '%?' as question_flag, presupposition_trigger_hits from g""")  # fmt: skip
def sentence_flags(spark: SparkSession, d: str) -> DataFrame:
    return discourse.flagged(_sentences(spark, d)).drop("sentence", "sentence_id", "negation_flag", "passive_voice_flag")


@query("marker_counts", f"{TOKS} select doc_id as document_id, " + ", ".join("cast(len(list_filter(toks, lambda t: t in ({}))) as bigint) as {}".format(", ".join(f"'{x}'" for x in ws), name) for name, ws in discourse.MARKERS.items()) + " from d")
def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    return discourse.marker_counts(load(spark, d, "documents"), record="doc_id", body="text")


@query("marker_totals", f"{TOKS}, t as (select unnest(toks) as t from d) " + " union all ".join("select '{}' as marker, count(*) as total from t where t in ({})".format(name, ", ".join(f"'{x}'" for x in ws)) for name, ws in discourse.MARKERS.items()))
def marker_totals(spark: SparkSession, d: str) -> DataFrame:
    wide = discourse.marker_counts(load(spark, d, "documents"), record="doc_id", body="text")
    return discourse.column_totals(wide, list(discourse.MARKERS))


@query("named_mentions", f"""with {_SENT}, m as (select doc_id, lower(unnest(regexp_extract_all(' ' || sentence, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(\\p{{Lu}}[\\p{{L}}’'']+(?: \\p{{Lu}}[\\p{{L}}’'']+)+)', 1))) as e from s)
select e as entity_normalised, count(*) as n_mentions, count(distinct doc_id) as n_documents from m group by e order by n_mentions desc, entity_normalised limit 250""")
def named_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = discourse.named_mentions(_sentences(spark, d))
    return m.groupBy("entity_normalised").agg(F.count("*").alias("n_mentions"), F.count_distinct("document_id").alias("n_documents")).orderBy(F.desc("n_mentions"), "entity_normalised").limit(250)


_FOOT = [(name, p.removeprefix("(?i)")) for name, p in text.FOOTER_MARKERS.items()]
_FOOT_AT = ", ".join(f"{{'at': coalesce(nullif(case when regexp_matches(b, '(?i){p}') then strpos(b, regexp_extract(b, '(?i){p}')) else 0 end, 0), 2147483647), 'name': '{n}'}}" for n, p in _FOOT)


@query("footer_truncation", f"""with a as (select document_id, min(body) as b from articles group by document_id),
m as (select document_id, b, list_filter(list_sort([{_FOOT_AT}]), lambda x: x.at < 2147483647) as f from a),
s as (select *, case when len(f) = 0 then 'no_marker' when f[1].at - 1 >= greatest(200, cast(floor(length(b) * 0.7) as integer)) then 'footer_removed' else 'marker_too_early' end as status from m)
select document_id, status, array_to_string(list_transform(f, lambda x: x.name), '|') as markers, cast(length(case when status = 'footer_removed' then rtrim(substr(b, 1, f[1].at - 1), ' ') else b end) as bigint) as n_characters from s""")  # fmt: skip
def footer_truncation(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "articles").groupBy("document_id").agg(F.min("body").alias("body"))
    cut = a.select("document_id", text.footer_cut(F.col("body")).alias("c"))
    return cut.select("document_id", "c.status", "c.markers", F.length("c.body").cast("bigint").alias("n_characters"))


@query("concordance_kwic", rf"""with {_SENT}, h as (select doc_id, sentence_index, sentence, regexp_extract(sentence, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(station)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1) as node from s where regexp_matches(sentence, '{_lex("station")}')),
p as (select *, length(regexp_extract(sentence, '(?i)^(.*?(?:^|[^\p{{L}}\p{{M}}\p{{N}}_]))station(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])', 1)) + 1 as pos from h), q as (select *, greatest(1, pos - 92) as st, pos + length(node) as en from p)
select cast(doc_id as varchar) as document_id, cast(sentence_index as integer) as sentence_index, case when st > 1 then '…' else '' end || substr(sentence, st, pos - st) as "left", node, substr(sentence, en, 92) || case when length(sentence) >= en + 92 then '…' else '' end as "right" from q""")  # fmt: skip
def concordance_kwic(spark: SparkSession, d: str) -> DataFrame:
    return explore.concordance(_sentences(spark, d), "station")


@query("jaccard_title_text", f"""with d as (select doc_id, list_distinct({tok('title')}) as a, list_distinct({tok('text')}) as b from documents)
select doc_id, round(case when len(a) + len(b) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::double end, 6) as jaccard from d""")  # fmt: skip
def jaccard_title_text(spark: SparkSession, d: str) -> DataFrame:
    j = stats.jaccard(F.array_distinct(text.tokens(F.col("title"))), F.array_distinct(text.tokens(F.col("text"))))
    return load(spark, d, "documents").select("doc_id", F.round(j, 6).alias("jaccard"))


@query("reference_list_comparison", f"""{TOKS}, c as (select doc_id, source is not distinct from 'tavrin-courier' as target, {CONTENT} as items from d), e as (select target, unnest(items) as term from c),
n as (select sum(len(items)) filter (where target)::double as n1, sum(len(items)) filter (where not target)::double as n2 from c),
a as (select term, count(*) filter (where target) as k1, count(*) filter (where not target) as k2 from e group by term)
select term, cast(k1 as bigint) as frequency, round(k1 * 1e6 / n1, 4) as per_million, round(k2 * 1e6 / n2, 4) as reference_per_million, case when k1 * 1e6 / n1 >= k2 * 1e6 / n2 then 'over' else 'under' end as direction from a, n where k1 > 0 and k2 > 0""")  # fmt: skip
def reference_list_comparison(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").withColumn("target", F.col("source").eqNullSafe(F.lit("tavrin-courier")))
    t = lexical.term_frequencies(docs.filter("target"), record="doc_id", body="text").select("term", "frequency", "per_million")
    r = lexical.term_frequencies(docs.filter("not target"), record="doc_id", body="text").select("term", "per_million")
    out = lexical.against_reference(t, r)
    return out.withColumn("per_million", F.round("per_million", 4)).withColumn("reference_per_million", F.round("reference_per_million", 4))
