"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of a lower-case text; shorter texts have none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spots = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(spots, lambda i: F.substr(low, i, F.lit(3))))).otherwise(F.expr("cast(array() as array<string>)"))


def blank_to(text: Column, default: str | Column) -> Column:
    """The trimmed text, or default where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def join_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def contains_either(a: Column, b: Column) -> Column:
    """True when one text holds the other."""
    return a.contains(b) | b.contains(a)


def truncated(text: Column, size: int, mark: str = "") -> Column:
    """At most size characters; a longer text ends in mark."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def html_escaped(text: Column) -> Column:
    """Ampersand first, so that later escapes are not escaped again."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def markdown_cell(text: Column) -> Column:
    """A pipe is escaped, line ends become spaces."""
    for sign, other in (("|", "\\|"), ("\r", " "), ("\n", " ")):
        text = F.replace(text, F.lit(sign), F.lit(other))
    return text


def text_bar(share: Column, width: int = 20) -> Column:
    """One block for every 1 / width of a share from 0 to 1, padded with dots."""
    n = F.least(F.lit(width), F.greatest(F.lit(0), F.round(share * width).cast("int")))
    return F.rpad(F.repeat(F.lit("#"), n), width, ".")


def fuzzy_match(text: Column, query: Column) -> Column:
    """Every white-space part of query is in text, or the whole query is; case is ignored."""
    low, asked = F.lower(text), F.lower(F.trim(query))
    return F.forall(F.split(asked, r"\s+"), lambda t: F.contains(low, t)) | low.contains(asked)


def regex_match(text: Column, pattern: str) -> Column:
    """Case-insensitive search; a pattern that does not compile matches nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return text.rlike(f"(?i){pattern}")


def translated_path(path: Column, table: dict[str, str], separator: str = " / ") -> Column:
    """A classification path with the segments that table knows replaced; others stay."""
    if not table:
        return path
    known = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    return F.array_join(F.transform(F.split(path, f"\\Q{separator}\\E"), lambda s: F.coalesce(F.try_element_at(known, s), s)), separator)
