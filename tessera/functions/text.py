"""Column functions on text: slices, tokens, sentences, counts. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms, position by position.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"
#: Stop words of query tokens.
STOP_WORDS = tuple("a o as os um uma uns umas de da do das dos em na no nas nos por para com sem sob sobre entre e ou mas se que qual quais quando onde como quem é são foi foram ser estar ter haver fazer ao à".split())
#: Stop words of keywords.
KEYWORD_STOP = tuple("de da do das dos a o as os um uma uns umas para com sem por em na no nas nos que é são foi será ter tem teve e ou mas se não sim".split())


def nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def slices(text: Column, size: int, overlap: int = 0, whole_tail: bool = True) -> Column:
    """Pieces of `size` characters, `size - overlap` apart. With whole_tail every step before the end starts a piece;
    without it the first piece that reaches the end is the last. An empty text has none."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    last = F.length(text) - 1 if whole_tail else F.greatest(F.lit(0), F.length(text) - overlap - 1)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.substring(text, p + 1, F.lit(size)))


def trimmed(parts: Column) -> Column:
    """Pieces without white space at their ends, empty ones left out."""
    return nonempty(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return nonempty(F.split(text, r"\s+"))


def marked_split(text: Column, pattern: str) -> Column:
    """Splits after what group 1 of the pattern matches; the rest of the match goes."""
    return F.split(F.regexp_replace(text, pattern, "$1\u0001"), "\u0001")


def sentences(text: Column) -> Column:
    return marked_split(text, r"([.!?])\s+")


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def query_tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case tokens of two characters or more, or digits, that are no stop words."""
    clean = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.filter(clean, lambda w: ((F.length(w) >= 2) | w.rlike(r"^\d+$")) & ~w.isin(*stop) & (w != ""))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(unaccented(text), r"[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 3)


def search_terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Terms of over two bytes that are no stop words."""
    return F.filter(words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " ")), lambda w: (F.octet_length(w) > 2) & ~w.isin(*stop))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def ascii_bounds(pattern: str) -> str:
    r"""The pattern for Java with the `\b` (where a word begins or ends) and `.` of SQL: words are ASCII, and only \n ends a line."""
    return "(?d)" + re.sub(r"(?<=[a-zA-Z0-9_)])\\b", lambda _: r"(?!\w)", re.sub(r"\\b(?=[a-zA-Z0-9_(])", lambda _: r"(?<!\w)", pattern))


def times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
