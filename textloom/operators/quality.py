"""Integrity: duplicates, referential audits, rules, content status, pattern scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text

# Signs of code and other hostile content, by name.
SUSPICIOUS = {
    "javascript_scheme": r"(?i)\bjavascript\s*:",
    "vbscript_scheme": r"(?i)\bvbscript\s*:",
    "data_html_uri": r"(?i)\bdata\s*:\s*text/html",
    "html_script_tag": r"(?i)<\s*script\b",
    "html_iframe_tag": r"(?i)<\s*iframe\b",
    "html_object_embed": r"(?i)<\s*(?:object|embed)\b",
    "php_code": r"(?i)<\?php\b",
    "powershell": r"(?i)\bpowershell(?:\.exe)?\b",
    "powershell_encoded": r"(?i)\b(?:-enc|-encodedcommand)\b",
    "cmd_execution": r"(?i)\bcmd(?:\.exe)?\s+/[ck]\b",
    "shell_execution": r"(?i)(?:^|[\s;&|])(?:/bin/)?(?:ba|z|k|c)?sh\s+-c\b",
    "python_exec": r"(?i)\bpython(?:3)?\s+-c\b",
    "perl_exec": r"(?i)\bperl\s+-e\b",
    "ruby_exec": r"(?i)\bruby\s+-e\b",
    "curl_pipe_shell": r"(?is)\bcurl\b.{0,200}\|\s*(?:ba|z|k|c)?sh\b",
    "wget_pipe_shell": r"(?is)\bwget\b.{0,200}\|\s*(?:ba|z|k|c)?sh\b",
    "certutil_download": r"(?is)\bcertutil\b.{0,200}\b-urlcache\b",
    "bitsadmin": r"(?i)\bbitsadmin\b",
    "invoke_webrequest": r"(?i)\binvoke-webrequest\b|\biwr\b",
    "start_process": r"(?i)\bstart-process\b",
    "process_spawn": r"(?i)\b(?:subprocess\.(?:run|popen|call)|os\.system)\s*\(",
    "reverse_shell_tcp": r"(?i)/dev/tcp/|nc\s+[^;\n]{0,120}\s+-e\s+",
    "netcat_listener": r"(?i)\bnc(?:at)?\b.{0,80}\s-[^\n]*l",
    "meterpreter": r"(?i)\bmeterpreter\b",
    "mimikatz": r"(?i)\bmimikatz\b",
    "msfvenom": r"(?i)\bmsfvenom\b",
    "sql_union_select": r"(?i)\bunion\s+(?:all\s+)?select\b",
    "sql_sleep": r"(?i)\b(?:sleep|benchmark|pg_sleep)\s*\(",
    "path_traversal": r"(?:\.\./){2,}|(?:\.\.\\){2,}",
    "template_injection": r"\{\{\s*[^{}]{1,100}\s*\}\}|\$\{\s*[^{}]{1,100}\s*\}",
    "office_vba": r"(?i)\b(?:AutoOpen|Document_Open|Workbook_Open|CreateObject)\b",
    "elf_header_text": r"\x7fELF",
    "pe_header_text": r"(?s)\bMZ.{0,100}PE\x00\x00",
}
CONTEXTUAL = {
    "shell_word_bash": r"(?i)\bbash\b",
    "shell_word_sh": r"(?i)\b(?:shell|sh)\b",
    "exploit_term": r"(?i)\b(?:exploit kit|payload|shellcode|zero-day|0day)\b",
}
# What counts as a URL, a long base64 and a long hexadecimal run.
URL = r"(?i)\b(?:https?|ftp|file|data|javascript|vbscript|about):(?://)?[^\s<>\"'{}|\\^`\[\]]+"
BASE64 = r"(?<![A-Za-z0-9+/=])(?:[A-Za-z0-9+/]{4}){32,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?(?![A-Za-z0-9+/=])"
HEX_BLOB = r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){64,}(?![0-9A-Fa-f])"


def exact_duplicate_groups(df: DataFrame, *, record: str, body: str) -> DataFrame:
    """``text_sha256, n_records, first_record, last_record`` of texts that several records share; empty texts are no group.

    The member list of a group may be as long as the table, so it is given by
    ``exact_duplicate_members`` as rows, not as one array.
    """
    keyed = df.filter(F.col(body).isNotNull() & (F.col(body) != "")).select(F.col(record).alias("record"), F.sha2(F.col(body), 256).alias("text_sha256"))
    return keyed.groupBy("text_sha256").agg(F.count("*").alias("n_records"), F.min("record").alias("first_record"), F.max("record").alias("last_record")).filter("n_records > 1")


def exact_duplicate_members(df: DataFrame, *, record: str, body: str) -> DataFrame:
    """``record, text_sha256, representative`` for every member of an exact duplicate group."""
    keyed = df.filter(F.col(body).isNotNull() & (F.col(body) != "")).select(F.col(record).alias("record"), F.sha2(F.col(body), 256).alias("text_sha256"))
    groups = keyed.groupBy("text_sha256").agg(F.count("*").alias("n"), F.min("record").alias("representative")).filter("n > 1")
    return keyed.join(groups.select("text_sha256", "representative"), "text_sha256").select("record", "text_sha256", "representative")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``key_name, n_keys, surplus_rows`` of each key column: values on several rows and the rows beyond the first."""
    parts = []
    for k in keys:
        g = df.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("v")).agg(F.count("*").alias("c")).filter("c > 1")
        parts.append(g.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("surplus_rows")).withColumn("key_name", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("key_name", "n_keys", "surplus_rows")


def rule_violations(df: DataFrame, *, record: str, rules: dict[str, Column]) -> DataFrame:
    """``record, rule`` for each rule that a row doesn't keep; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(record).alias("record"), F.explode(broken).alias("rule"))


def article_rules() -> dict[str, Column]:
    """The constraints of the article schema as boolean columns."""
    hex64 = "^[a-f0-9]{64}$"
    return {
        "document_id_hex20": F.col("document_id").rlike("^[a-f0-9]{20}$"),
        "title_not_empty": F.length("title") >= 1,
        "body_min_20": F.length("body") >= 20,
        "word_count_min_1": F.col("word_count") >= 1,
        "raw_sha256_hex": F.col("raw_payload_sha256").rlike(hex64),
        "derived_sha256_hex": F.col("derived_text_sha256").rlike(hex64),
        "no_comments": ~F.col("comments_collected"),
        "email_redactions_min_0": F.col("email_redactions") >= 0,
    }


def image_rules() -> dict[str, Column]:
    """The constraints of the image schema as boolean columns."""
    return {
        "document_id_hex20": F.col("document_id").rlike("^[a-f0-9]{20}$"),
        "mime_is_image": F.col("mime_type").rlike("^image/"),
        "byte_count_min_1": F.col("byte_count") >= 1,
        "role_known": F.col("image_role").isNull() | F.col("image_role").isin("hero", "inline"),
        "dom_index_min_1": F.col("dom_index").isNull() | (F.col("dom_index") >= 1),
    }


def unknown_references(child: DataFrame, parent: DataFrame, *, key: str) -> DataFrame:
    """Rows of ``child`` whose key is no row of ``parent``."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def content_status(df: DataFrame, *, record: str, body: str, images: DataFrame, image_record: str, short: int = 20) -> DataFrame:
    """``record, word_count, image_count, content_status, include_in_text`` by words and images."""
    counts = images.select(F.col(image_record).alias("record"), "image_id").distinct().groupBy("record").agg(F.count("*").alias("image_count"))
    rows = df.select(F.col(record).alias("record"), F.col(body).alias("body")).dropDuplicates(["record"])
    j = rows.join(counts, "record", "left").select("record", text.white_space_words(F.col("body")).cast("bigint").alias("word_count"), F.coalesce("image_count", F.lit(0)).alias("image_count"))
    status = F.when((F.col("word_count") == 0) & (F.col("image_count") > 0), "image_only").when(F.col("word_count") == 0, "no_extracted_text").when(F.col("word_count") < short, "short_text").otherwise("textual")
    return j.withColumn("content_status", status).withColumn("include_in_text", F.col("content_status").isin("textual", "short_text"))


def author_status(author: Column) -> Column:
    return F.when(F.trim(F.coalesce(author, F.lit(""))) != "", "named_author").otherwise("publisher_only")


def pattern_counts(df: DataFrame, *, record: str, body: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """``pattern, n_records, n_matches`` of each pattern that occurs, in one pass over the texts."""
    patterns = patterns or {**SUSPICIOUS, **CONTEXTUAL}
    found = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_count(F.col(body), F.lit(p)).alias("k")) for n, p in patterns.items()])
    rows = df.filter(F.col(body).isNotNull()).select(F.col(record).alias("record"), F.explode(F.filter(found, lambda x: x["k"] > 0)).alias("f"))
    return rows.groupBy("f.pattern").agg(F.count("*").alias("n_records"), F.sum("f.k").cast("bigint").alias("n_matches"))


def scan_totals(df: DataFrame, *, body: str) -> DataFrame:
    """One row: texts, blank ones, URLs, long base64 and hex runs, control characters, e-mails."""
    t = F.coalesce(F.col(body), F.lit(""))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.trim(t) == "").alias("n_blank"),
        F.sum(F.regexp_count(t, F.lit(URL))).alias("n_urls"),
        F.sum(F.regexp_count(t, F.lit(BASE64))).alias("n_base64"),
        F.sum(F.regexp_count(t, F.lit(HEX_BLOB))).alias("n_hex"),
        F.sum(text.control_characters(t)).alias("n_control"),
        F.sum(text.email_count(t)).alias("n_emails"),
    )


def url_schemes(df: DataFrame, *, body: str) -> DataFrame:
    """``scheme, n`` of all URLs in the texts."""
    urls = df.select(F.explode(F.regexp_extract_all(F.col(body), F.lit(URL), F.lit(0))).alias("u"))
    return urls.groupBy(F.lower(F.regexp_extract("u", r"^([A-Za-z]+):", 1)).alias("scheme")).agg(F.count("*").alias("n"))


def first_examples(df: DataFrame, *, category: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each category."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(category).orderBy(*order))).filter(F.col("r") <= cap)


def shared_hash_groups(df: DataFrame, *, record: str, digest: str) -> DataFrame:
    """``record, digest, group_size`` of rows whose digest several records share; null digests are one group."""
    once = df.select(F.col(record).alias("record"), F.col(digest).alias("digest")).distinct()
    sizes = once.groupBy("digest").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return once.join(sizes.withColumnRenamed("digest", "d"), F.col("digest").eqNullSafe(F.col("d"))).select("record", "digest", "group_size")
