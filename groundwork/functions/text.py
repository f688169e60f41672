"""Text expressions. All of them stay in the JVM except NFKC, which Spark lacks;
that step is a pandas UDF fed only with values that NFKC could change."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# White space as ECMAScript defines it, as a character class body.
WHITESPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_OTHER_SPACE = WHITESPACE.replace(r"\r \x", r"\r\x")
# One range that most characters lie in is asked before the ranges of white space, for speed only.
_NO_SIGN = "(?![!-~])"
# E-mail pattern and its replacement.
EMAIL_MARK = "[redacted-email]"
# The possessive run cannot lose a match: it excludes the following "@".
_ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
EMAIL = rf"(?i){_ASCII_BOUNDARY}[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{{2,}}{_ASCII_BOUNDARY}"
# Letters and punctuation that NFKC leaves as they are when they stand alone; any
# other non-ASCII character sends the value through the UDF.
_NFKC_STABLE = r"^[\x00-\x7f\x{a1}-\x{a7}\x{a9}\x{ab}-\x{ae}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2023}]*$"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


# Marked non-deterministic so that the optimizer neither copies it into every use of
# a cleaned column nor pushes it with a filter below a shuffle: it runs once per row.
_nfkc = _nfkc.asNondeterministic()


def is_ascii(text: Column) -> Column:
    """Whether a text has as many characters as bytes: it is asked before walks of its characters."""
    return F.octet_length(text) == F.char_length(text)


def nfkc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Replace the named text columns by their NFKC form (null stays null)."""
    risky = lambda n: F.when(~is_ascii(F.col(n)) & ~F.col(n).rlike(_NFKC_STABLE), F.col(n))
    return df.withColumns({n: F.coalesce(_nfkc(risky(n)), F.col(n)) for n in names})


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once. Inside a lambda an expression would
    otherwise be evaluated again for every element."""
    return F.transform(F.array(value), use)[0]


def squeeze(text: Column) -> Column:
    """Collapse white space and trim. A lone blank, the usual case, is no match: it stays."""
    return F.trim(F.regexp_replace(text, rf"{_NO_SIGN}(?:[{_OTHER_SPACE}][{WHITESPACE}]*+| [{WHITESPACE}]++)", " "))


def clean_text(text: Column) -> Column:
    """Control characters to blanks, e-mails redacted, white space collapsed. Apply
    ``nfkc_columns`` to the frame first where the text is not known to be NFKC."""
    value = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    redact = lambda v: F.when(F.contains(v, F.lit("@")), F.regexp_replace(v, EMAIL, EMAIL_MARK)).otherwise(v)
    return squeeze(bind(value, redact))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


@lru_cache(maxsize=2)
def _accent_map(max_marks: int = 9) -> tuple[str, str]:
    """Every BMP letter whose NFD form is one base character plus up to ``max_marks``
    marks U+0300-036F, then the marks themselves (``translate`` deletes those)."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    source, target = [], []
    for code in range(0x80, 0xFFFF):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x300 <= code < 0x370:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = "".join(c for c in parts if not 0x300 <= ord(c) < 0x370)
        if len(base) == 1 and base != char and len(parts) - 1 <= max_marks:
            source.append(char)
            target.append(base)
    return "".join(source) + marks, "".join(target)


def strip_accents(text: Column, extra_from: str = "", extra_to: str = "") -> Column:
    source, target = _accent_map()
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), extra_from + source, extra_to + target)


def fold_text(text: Column, dstroke: bool = True, keep: str = "") -> Column:
    """Lower-case, accent-free words of [a-z0-9] with single blanks. ``dstroke``
    maps U+0111 to d; ``keep`` names further characters to leave in place."""
    folded = strip_accents(text, "đ" if dstroke else "", "d" if dstroke else "")
    return F.trim(F.regexp_replace(folded, f"[^a-z0-9{keep}]+", " "))


def token_array(text: Column, min_len: int = 3, **fold) -> Column:
    """Distinct folded tokens of at least ``min_len`` characters."""
    return F.array_distinct(F.filter(F.split(fold_text(text, **fold), " "), lambda t: F.length(t) >= min_len))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_words(text: Column) -> Column:
    """Words as a full-text index sees them: letters with a single mark lose it."""
    source, target = _accent_map(1)
    return words(F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(F.lower(text), source, target)))


def shingles(text: Column, size: int = 3) -> Column:
    """Word n-grams; a text with fewer words yields the words themselves."""

    def grams(tokens):
        count = F.size(tokens)
        spans = F.sequence(F.lit(0), F.greatest(count - size, F.lit(0)))
        joined = F.transform(spans, lambda i: F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(size)]))
        return F.when(count >= size, joined).otherwise(tokens)

    return bind(words(text), grams)


def truncate_text(text: Column, limit: int) -> Column:
    value = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(value) > limit, F.concat(F.substring(value, 1, limit - 1), F.lit("…"))).otherwise(value)


def sentences(text: Column, low: int = 18, high: int = 520) -> Column:
    """Pieces between line ends or after .!?;: with a length in [low, high]."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"{_NO_SIGN}(?:\n+|(?<=[.!?;:])[{WHITESPACE}]+)")
    parts = F.transform(parts, squeeze)
    return F.filter(parts, lambda s: F.length(s).between(low, high))


def distinct_ci(values: Column, cap: int) -> Column:
    """First occurrences ignoring case, at most ``cap`` of them (the cap is the
    feature: these feed display lists and query term lists)."""
    empty = F.array().cast("array<string>")

    def step(acc, value):
        fresh = (F.size(acc) < cap) & (value != "") & ~F.exists(acc, lambda seen: F.lower(seen) == F.lower(value))
        return F.when(fresh, F.concat(acc, F.array(value))).otherwise(acc)

    return F.aggregate(values, empty, step)


# Folded phrases that mean "not observed".
UNKNOWN_PHRASES = "khong xac dinh|chua du|chua xac nhan|khong thay|khong co|unknown|not assessable"


def asserted(text: Column, pattern: str, unknown: str = UNKNOWN_PHRASES) -> Column:
    """True only for a non-empty value without a not-observed phrase that matches."""
    folded = fold_text(text)
    return F.when((folded == "") | folded.rlike(f"({unknown})"), F.lit(False)).otherwise(folded.rlike(pattern))


def any_match(text: Column, patterns: list[str]) -> Column:
    """OR of case-insensitive Unicode regular expressions."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(text, F.lit("")).rlike(f"(?iu){joined}")


def matched_ids(text: Column, dictionary: dict[str, list[str]]) -> Column:
    """Ids of the dictionary entries with a match, in dictionary order. The entries
    are plan-time literals, so no join is needed."""
    return F.array_compact(F.array(*[F.when(any_match(text, p), F.lit(k)) for k, p in dictionary.items()]))
