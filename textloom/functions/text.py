"""Text functions: Column in, Column out, evaluated in the JVM.

Patterns that must tell letters of any script carry ``(?U)``; without it Java's ``\\w`` and
``\\b`` are ASCII only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word and sentence patterns, stopwords, footer markers.
TOKEN = r"(?<![\p{L}\p{N}_])[\p{L}\p{Nl}\p{No}](?:[\p{L}\p{N}_'’-]*[\p{L}\p{N}_])?"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"'“‘(])"
STOPWORDS = (
    "a an and are as at be been being but by can could did do does for from had has have he her hers him his i if in "
    "into is it its may me might more most must my no not of on one or our ours she should so than that the their "
    "theirs them then there these they this those to too us was we were what when where which who will with would you "
    "your yours"
).split()
FOOTER_MARKERS = {
    "do_you_like_this_page": r"(?i)\bDo you like this page\??",
    "reaction_section": r"(?i)\bShowing\s+\d+\s+reactions?\b",
    "sign_in_section": r"(?i)\bSign in with\b",
    "create_account": r"(?i)\bCreate an account\b",
    "post_comment": r"(?i)\bPost your comment\b",
}
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
REDACTED = "[EMAIL_REDACTED]"
SYLLABLE_GROUP = r"[aeiouy]+"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once per row.

    Catalyst merges projections, and an expression that is used inside a lambda would be computed
    anew for each element.
    """
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-case word tokens, typographic apostrophes evened; a null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))


def squeeze(text: Column) -> Column:
    """Runs of white space (no-break space too) as one space, none outside."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences without outer blanks, blank ones dropped."""
    parts = F.split(squeeze(text), SENTENCE_BREAK)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def content_tokens(toks: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens that are no stopwords and have two characters or more."""
    stop = F.array(*[F.lit(w) for w in (STOPWORDS if stopwords is None else stopwords)])
    return F.filter(toks, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def syllables(word: Column) -> Column:
    """Vowel groups of the letters a-z, a silent final e (not -le, -ye) left out, at least 1; 0 without letters."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.length(F.regexp_replace(F.regexp_replace(letters, SYLLABLE_GROUP, "1"), "[^1]", ""))
    silent = letters.endswith("e") & (groups > 1) & ~letters.endswith("le") & ~letters.endswith("ye")
    return F.when(letters == "", 0).otherwise(F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def readability(text: Column) -> Column:
    """Struct of word and sentence counts, means, type-token ratio and estimated reading ease."""
    def measures(toks: Column, n: Column) -> Column:
        words, divisor = F.size(toks).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), n)
        syl = array_sum(F.transform(toks, syllables))
        ease = F.lit(206.835) - F.lit(1.015) * safe_div(words, divisor) - F.lit(84.6) * safe_div(syl, words)
        return F.struct(
            words.alias("word_count"),
            n.alias("sentence_count"),
            safe_div(words, divisor).alias("mean_sentence_words"),
            safe_div(array_sum(F.transform(toks, F.length)), words).alias("mean_word_characters"),
            safe_div(F.size(F.array_distinct(toks)), words).alias("type_token_ratio"),
            ease.alias("flesch_reading_ease_estimate"),
        )

    parts = F.struct(tokens(text).alias("toks"), F.size(sentences(text)).cast("bigint").alias("n"))
    return let(parts, lambda x: measures(x["toks"], x["n"]))


def _moving_ratio(series: pd.Series, window: int) -> pd.Series:
    """One pass per document: counts of the window's words are updated as it slides."""

    def one(toks) -> float:
        n = 0 if toks is None else len(toks)
        if n == 0:
            return 0.0
        if n <= window:
            return len(set(toks)) / n
        held: dict[str, int] = {}
        for t in toks[:window]:
            held[t] = held.get(t, 0) + 1
        total = len(held)
        for out, new in zip(toks[: n - window], toks[window:]):
            if held[out] == 1:
                del held[out]
            else:
                held[out] -= 1
            held[new] = held.get(new, 0) + 1
            total += len(held)
        return total / window / (n - window + 1)

    return series.map(one)


def mattr(toks: Column, window: int = 50) -> Column:
    """Moving-average type-token ratio in time linear in the tokens (an Arrow UDF); 0 without tokens."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return _moving_ratio(s, window)

    return run(toks)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode form NFKC, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, REDACTED)


def email_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(EMAIL)), F.lit(0))


def normalise_text(text: Column) -> Column:
    """NFKC, even line ends, e-mails redacted, paragraphs split at blank lines and their blanks evened."""
    even = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    blocks = F.split(redact_emails(even), r"\n\s*\n")
    clean = F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"[ \t]+", " ")))
    return F.array_join(F.filter(clean, lambda b: b != ""), "\n\n")


def match_form(text: Column) -> Column:
    """Lower case with each run of other signs than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def site_title(title: Column, suffix: str) -> Column:
    """A page title without the site's name after a dash or bar."""
    return F.trim(F.regexp_replace(title, rf"(?i)\s*[-|–—]\s*{suffix}\s*$", ""))


def white_space_words(text: Column) -> Column:
    """Words between white space; 0 for null and blank texts."""
    return let(squeeze(text), lambda even: F.when(even == "", 0).otherwise(F.length(even) - F.length(F.replace(even, F.lit(" "), F.lit(""))) + 1))


def ngrams(toks: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by a space."""
    none = F.array().cast("array<string>")
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(toks, lambda t: F.when(F.size(t) >= n, grams(t)).otherwise(none))


def term_pattern(term: str) -> str:
    escaped = "".join(c if c.isalnum() or c in " _'" else "\\" + c for c in term)
    return rf"(?iU)(?<!\w){escaped}(?!\w)"


def lexicon_hits(text: Column, terms: list[str]) -> Column:
    """Sorted distinct lower-case matches of whole terms; overlapping terms each count (one pattern per term).

    One pattern of all terms comes first, so that a text without any of them is read once.
    """
    if not terms:
        return F.array().cast("array<string>")
    found = [F.regexp_extract_all(text, F.lit(term_pattern(t)), F.lit(0)) for t in terms]
    hits = F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), F.lower)))
    return F.when(text.rlike(any_term_pattern(terms)), hits).otherwise(F.array().cast("array<string>"))


def any_term_pattern(terms: list[str]) -> str:
    """Matches a text that has any of the terms as a whole."""
    return r"(?iU)(?<!\w)(?:" + "|".join("".join(c if c.isalnum() or c in " _'" else "\\" + c for c in t) for t in terms) + r")(?!\w)"


def quotation_flag(text: Column) -> Column:
    return text.rlike("[\"“”‘’]")


def question_flag(text: Column) -> Column:
    return text.endswith("?")


def footer_cut(text: Column, *, least: int = 200, share: float = 0.7) -> Column:
    """Struct ``body, status, markers``: the text cut at the earliest footer marker that stands late enough.

    Markers are ordered by place; one before ``max(least, share of the length)`` is only reported.
    """
    base = F.coalesce(text, F.lit(""))
    found = F.array(*[F.struct(F.regexp_instr(base, F.lit(p)).alias("at"), F.lit(name).alias("name")) for name, p in FOOTER_MARKERS.items()])

    def cut(marks: Column) -> Column:
        first = F.get(marks, F.lit(0))["at"] - 1
        late = first >= F.greatest(F.lit(least), F.floor(F.length(base) * F.lit(share)).cast("int"))
        return F.struct(
            F.when(late, F.rtrim(F.substring(base, F.lit(1), first))).otherwise(base).alias("body"),
            F.when(first.isNull(), "no_marker").when(late, "footer_removed").otherwise("marker_too_early").alias("status"),
            F.array_join(F.transform(marks, lambda x: x["name"]), "|").alias("markers"),
        )

    return let(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), cut)


def concordance_pattern(term: str, *, whole_token: bool = True) -> str:
    """Case-insensitive; a word boundary only beside a word character of the term."""
    escaped = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)
    if not whole_token:
        return rf"(?iU){escaped}"
    before = r"\b" if term[:1].isalnum() or term[:1] == "_" else ""
    after = r"\b" if term[-1:].isalnum() or term[-1:] == "_" else ""
    return rf"(?iU){before}{escaped}{after}"


def kwic(sentence: Column, pattern: str, context: int = 92) -> Column:
    """Struct ``left, node, right`` around the first match, with an ellipsis where text was cut."""
    at = F.regexp_instr(sentence, F.lit(pattern))
    node = F.regexp_extract(sentence, pattern, 0)
    start = F.greatest(F.lit(1), at - context)
    end = at + F.length(node)
    left, right = F.substring(sentence, start, at - start), F.substring(sentence, end, F.lit(context))
    return F.struct(
        F.concat(F.when(start > 1, "…").otherwise(""), left).alias("left"),
        node.alias("node"),
        F.concat(right, F.when(F.length(sentence) >= end + context, "…").otherwise("")).alias("right"),
    )


def snippet(text: Column, at: Column, around: int = 100) -> Column:
    """Text around a 1-based place, line ends written out."""
    start = F.greatest(F.lit(1), at - around)
    part = F.substring(text, start, at - start + around)
    return F.replace(F.replace(part, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def control_characters(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")), F.lit(0))


def split_tags(tags: Column) -> Column:
    """Values of a bar-delimited column, trimmed, without blank ones and ``nan``."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def first_number(text: Column) -> Column:
    """The first number in a decorated string, thousands commas dropped; null where there is none."""
    digits = F.regexp_extract(text, r"[-+]?\d[\d,]*(?:\.\d+)?", 0)
    return F.when(digits != "", F.replace(digits, F.lit(","), F.lit("")).try_cast("double"))
