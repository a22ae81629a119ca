"""Column functions over text. Keyword lists are arguments everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's trim(): all characters up to U+0020.
_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def java_trim(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def squeeze(x: Column) -> Column:
    """Lower case without ASCII white space; no-break spaces stay."""
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def collapse(x: Column) -> Column:
    """Runs of Unicode white space become one space; edges are stripped; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(java_trim(x), F.lit(""))


def clean_cell(x: Column) -> Column:
    """No-break spaces to spaces, white space collapsed, trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.replace(x, F.lit(" "), F.lit(" ")), r"\s+", " ")), F.lit(""))


def label_key(x: Column) -> Column:
    """A label without white space, colons and asterisks."""
    return F.regexp_replace(x, r"[\s:*]", "")


def name_key(x: Column) -> Column:
    """Lower case, only ASCII letters, digits and Hangul syllables."""
    return F.regexp_replace(F.lower(x), "[^0-9a-z가-힣]", "")


def item_key(x: Column) -> Column:
    """A list item without leading bullets and numbering and without white space."""
    return F.regexp_replace(F.regexp_replace(x, r"^[\s\-*•·○●□■▪◦※]+", ""), r"\s+", "")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def join_distinct(*columns: Column, separator: str = ", ") -> Column:
    """Distinct non-blank values in order of first appearance."""
    kept = F.filter(F.array(*[java_trim(c) for c in columns]), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(kept), separator)


def before_last(x: Column, separator: str = "/") -> Column:
    """What stands before the last separator; the whole text if there is none."""
    left = F.length(x) - F.length(F.substring_index(x, separator, -1)) - len(separator)
    return F.when(F.instr(x, separator) > 0, F.substr(x, F.lit(1), left)).otherwise(x)


def after_last(x: Column, separator: str = "/") -> Column:
    return F.when(F.instr(x, separator) > 0, F.substring_index(x, separator, -1)).otherwise("")


def file_extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.lower(after_last(name, "."))


def safe_file_name(name: Column, longest: int = 255) -> Column:
    """Control and reserved characters become underscores; no parent steps, no trailing dots or spaces."""
    replaced = F.regexp_replace(name, r'[\x00-\x1f\x7f\\/:*?"<>|]', "_")
    return F.left(F.regexp_replace(F.regexp_replace(replaced, r"\.\.+", "_"), r"[. ]+$", ""), F.lit(longest))


def abbreviate(x: Column, longest: int, dots: bool = False) -> Column:
    if not dots:
        return F.left(x, F.lit(longest))
    return F.when(F.length(x) > longest, F.concat(F.left(x, F.lit(longest - 3)), F.lit("..."))).otherwise(x)


def yes_no(x: Column, yes: Sequence[str] = ("y", "yes", "true", "1", "예"), no: Sequence[str] = ("n", "no", "false", "0", "아니오")) -> Column:
    key = F.lower(java_trim(x))
    return F.when(key.isin(*yes), "Y").when(key.isin(*no), "N")


def redact(x: Column, names: Sequence[str] = ("serviceKey", "key", "token", "password")) -> Column:
    """Values of named query or form parameters are replaced."""
    return F.regexp_replace(x, rf"(?i)\b({'|'.join(names)})=[^&\s]+", "$1=[REDACTED]")


def four_digit_codes(x: Column) -> Column:
    """Distinct runs of exactly four digits, in order."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)))


def keywords_found(x: Column, keywords: Sequence[str]) -> Column:
    """Keywords that stand in the text, in the list's order."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(x, k))


def longest_first(x: Column, keywords: Sequence[str]) -> Column:
    """Keywords found, longest first; one that is part of a found one is skipped."""
    ordered = F.array(*[F.lit(k) for k in sorted(dict.fromkeys(keywords), key=len, reverse=True)])
    found = F.filter(ordered, lambda k: F.contains(x, k))
    return F.aggregate(found, F.array().cast("array<string>"), lambda acc, k: F.when(F.exists(acc, lambda a: F.contains(a, k)), acc).otherwise(F.concat(acc, F.array(k))))


def contains_any(x: Column, terms: Sequence[str]) -> Column:
    """Null-safe: any of the terms, without regard to case."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))


def contains_all(x: Column, terms: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(True))


def search_columns(columns: Sequence[Column], term: str) -> Column:
    """The term in any of several columns, without regard to case; nothing in it is a wildcard."""
    return reduce(lambda a, b: a | b, [contains_any(c, [term]) for c in columns], F.lit(False))


def clean_list(arrays: Column) -> Column:
    """Nested lists as one list of trimmed, distinct, non-blank entries."""
    return F.array_distinct(F.filter(F.transform(F.flatten(arrays), java_trim), lambda x: x.isNotNull() & (x != "")))


def email_key(x: Column, longest: int = 254) -> Column:
    """A normalised address, or null where it cannot be one."""
    key = F.lower(java_trim(x))
    return F.when(key.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length(key) <= longest), key)


def rounded_percent(part: Column, total: Column) -> Column:
    """Percent rounded half up; 0 of nothing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0)).otherwise(F.floor(100.0 * part / F.nullif(total, F.lit(0)) + 0.5)).cast("bigint")


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / F.lit(float(size))).cast("bigint")
