"""Text semantics as column functions: normalization, tokens, hashes, redaction, patterns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values ------------------------------------------------------------------------------
TITLE_STOP_WORDS = [
    "a", "an", "the", "of", "and", "or", "in", "on", "for", "to", "with", "by", "from", "at", "as",
    "study", "trial", "randomized", "controlled", "effects", "effect", "training", "virtual", "reality",
]
READABLE = r"[^\p{L}\p{Nd} .,;:!?()\[\]{}\-\n\r\t<>/@#$%^&*+=|~\x27\x22]"
# ------------------------------------------------------------------------------------------------


def title(text: Column) -> Column:
    """A text up to its first line feed."""
    return F.substring_index(text, "\n", 1)


def normalize_doi(c: Column) -> Column:
    """Trimmed and lower-cased, without resolver prefix and closing punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", "")
    return F.regexp_replace(bare, r"[.,;)]+$", "")


def normalize_url(c: Column) -> Column:
    """Lower-cased without scheme, ``www.``, query, fragment and closing slashes or punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"[/.,;)]+$", "")


def normalize(c: Column) -> Column:
    """Lower-cased; everything but a-z, 0-9 and CJK ideographs becomes single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def long_tokens(normalized: Column) -> Column:
    """Tokens of four characters or more, with repeats."""
    return F.filter(F.split(normalized, " "), lambda t: F.length(t) >= 4)


def title_tokens(c: Column) -> Column:
    """The set of long tokens of a title that are not stop words."""
    return F.array_except(F.array_distinct(long_tokens(normalize(c))), F.array(*map(F.lit, TITLE_STOP_WORDS)))


def overlap(tokens: Column, normalized: Column) -> Column:
    """Share of tokens that are part of a normalized text; 1 where there are no tokens."""
    n = F.size(tokens)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.filter(tokens, lambda t: F.contains(normalized, t))) / n)


def squeeze(c: Column) -> Column:
    """Line ends unified, blanks squeezed, at most one empty line in a row, line ends trimmed."""
    out = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" \n", "\n"), r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def unreadable_ratio(c: Column) -> Column:
    """Share of characters that are neither letters, digits nor common marks; 1 below 100 characters."""
    n = F.length(c)
    return F.when(c.isNull() | (n < 100), F.lit(1.0)).otherwise(1 - F.length(F.regexp_replace(c, READABLE, "")) / n)


def md5_prefix(c: Column, n: int) -> Column:
    return F.left(F.md5(c.cast("binary")), F.lit(n))


def fingerprint(*parts: Column) -> Column:
    """16 hex digits over all parts; a null part counts as empty."""
    return md5_prefix(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 16)


def redact(c: Column, most: int = 800) -> Column:
    """API keys, bearer tokens, mail addresses masked; one line; at most ``most`` characters."""
    out = F.regexp_replace(c, r"sk-[A-Za-z0-9_-]{8,}", "sk-***")
    out = F.regexp_replace(out, r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer ***")
    out = F.regexp_replace(out, r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "***@***")
    return F.left(F.regexp_replace(out, r"[\r\n]", " "), F.lit(most))


def year(c: Column) -> Column:
    """The first four digits in a row as a number, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).try_cast("int"), F.lit(0))


def contains_any(normalized: Column, terms: list[str]) -> Column:
    """The terms that are part of a normalized text, in list order; terms are normalized alike. A term
    that begins with ``re:`` is a regular expression."""
    # No lambda: so the normalized text is one shared subexpression of compiled code.
    hit = lambda t: F.rlike(normalized, F.lit(t[3:])) if t.startswith("re:") else F.contains(normalized, F.lit(plain(t)))
    return F.array_compact(F.array(*[F.when(hit(t), F.lit(t)) for t in terms]))


def plain(term: str) -> str:
    """``normalize`` for a literal."""
    kept = "".join(c if "a" <= c <= "z" or "0" <= c <= "9" or "一" <= c <= "鿿" else " " for c in term.lower())
    return " ".join(kept.split())


def control_characters(c: Column) -> Column:
    """The distinct control characters but tab and line ends, as sorted hex."""
    found = F.regexp_extract_all(c, F.lit(r"([\x00-\x08\x0b\x0c\x0e-\x1f])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.hex(x)))))


def parse_object(c: Column, schema: str) -> Column:
    """JSON by schema, from the whole text or else from its outermost braces."""
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)).otherwise(F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), schema))


@F.pandas_udf(StringType())
def quote_normal_text(s: pd.Series) -> pd.Series:
    """Compatibility composition, lower case, white space squeezed."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).lower().split()))


def quote_normal(c: Column) -> Column:
    """``quote_normal_text`` of texts without compatibility characters, as an expression of the JVM;
    apply ``nfkc`` before where there may be some."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


# --- Fixed values: headings between which the sections of a paper lie ----------------------------
SECTIONS = {
    "abstract": (r"(?:abstract|摘要)[:\s]*\n?", r"\n(?:introduction|keywords|1\.|I\.)", 1500),
    "methods": (r"(?:methods?|methodology|materials?\s+(?:and|&)\s+methods?|实验方法|研究方法)[:\s]*\n?", r"\n(?:results?|findings?|discussion|conclusion|3\.|III\.)", 4000),
    "results": (r"(?:results?|findings?)[:\s]*\n?", r"\n(?:discussion|conclusion|4\.|IV\.)", 3000),
}
# ------------------------------------------------------------------------------------------------


def section_of(c: Column, name: str) -> Column:
    """The abstract, methods or results of a paper, from its heading to the next, at most so long; empty without them."""
    begin, end, most = SECTIONS[name]
    return F.left(F.btrim(F.regexp_extract(c, f"(?is){begin}(.*?){end}", 1), F.lit(" \t\n\r\x0b\x0c")), F.lit(most))


def judge_content(c: Column, most: int = 8000) -> Column:
    """What a judge reads of a paper: methods and results, or the beginning of all where there are no
    methods or both are below 2000 characters."""
    methods, results = section_of(c, "methods"), section_of(c, "results")
    both = F.when(results != "", F.concat(methods, F.lit("\n\n"), results)).otherwise(methods)
    return F.when((methods != "") & (F.length(both) >= 2000), both).otherwise(F.left(c, F.lit(most)))


def make_key(author: Column, year: Column, title: Column) -> Column:
    """Author, year and six digits of the md5 of the title's first thirty characters in lower case."""
    head = F.lower(F.left(F.btrim(title, F.lit(" \t\n\r\x0b\x0c")), F.lit(30)))
    return F.concat_ws("_", author, year.cast("string"), F.left(F.md5(head.cast("binary")), F.lit(6)))


def iso_time(c: Column) -> Column:
    """An ISO time, with T or a blank, with or without zone (then the session's); null if it is none."""
    return F.try_to_timestamp(c)
