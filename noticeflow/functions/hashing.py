"""Content hashes over length-framed fields, and derived ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units, as Java counts it."""
    return (F.length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def framed(x: Column) -> Column:
    """length:value, null as empty: no two different sequences of fields have one framing."""
    value = F.coalesce(x.cast("string"), F.lit(""))
    return F.concat(utf16_length(value).cast("string"), F.lit(":"), value)


def fingerprint(fields: Sequence[Column], lists: Sequence[Column] = ()) -> Column:
    """SHA-256 of framed fields, then of each list its length and its sorted framed entries."""
    parts = [framed(f) for f in fields]
    for entries in lists:
        sorted_entries = F.array_sort(F.transform(F.coalesce(entries, F.array().cast("array<string>")), framed))
        parts += [framed(F.size(sorted_entries)), F.array_join(sorted_entries, "")]
    return F.sha2(F.concat(*parts), 256)


def _numbered(name: str):
    """The line of a list's entry at its place."""

    def line(x: Column, i: Column) -> Column:
        return F.concat(framed(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))), F.lit("="), framed(x), F.lit("\n"))

    return line


def content_hash(named: Sequence[tuple[str, Column]], lists: Sequence[tuple[str, Column]] = ()) -> Column:
    """SHA-256 of lines name=value, both framed; lists give name[i] lines in sorted order."""
    lines = [F.concat(framed(F.lit(n)), F.lit("="), framed(c), F.lit("\n")) for n, c in named]
    for name, entries in lists:
        entries = F.array_sort(F.coalesce(entries, F.array().cast("array<string>")))
        lines.append(F.array_join(F.transform(entries, _numbered(name)), ""))
    return F.sha2(F.concat(*lines), 256)


def entry_parts(*columns: Column) -> Column:
    """One list entry of several fields: framed fields joined by bars."""
    return F.concat(*[F.concat(framed(c), F.lit("|")) for c in columns])


def name_uuid(*parts: Column) -> Column:
    """A version-3 UUID of parts joined by NUL characters."""
    digest = F.md5(F.concat_ws("\u0000", *parts).cast("binary"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    piece = lambda a, n: F.substring(digest, a, n)
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-3"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))


def index_id(key: Column, prefix: str = "index-") -> Column:
    return F.concat(F.lit(prefix), F.sha2(key, 256))


def valid_digest(x: Column) -> Column:
    """A lower-case SHA-256 digest, or null."""
    return F.when(F.lower(x).rlike("^[0-9a-f]{64}$"), F.lower(x))
