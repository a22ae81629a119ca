"""Arrow-batched functions for what no built-in expression does."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """The text in NFKC."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def compact_nfkc(values: pd.Series) -> pd.Series:
    """NFKC, lower case, letters and numbers only."""

    def one(x):
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKC", x).lower() if unicodedata.category(c)[0] in "LN")

    return values.map(one)


@F.pandas_udf(T.StringType())
def canonical_url(values: pd.Series) -> pd.Series:
    """Scheme and host in lower case, host in IDNA, no default port, no fragment; null for other schemes, user
    parts and private or local hosts."""
    private = re.compile(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|\[|0\.)|\.local$|\.internal$")

    def one(x):
        try:
            u = urlsplit((x or "").strip())
            if u.scheme.lower() not in ("http", "https") or not u.hostname or "@" in u.netloc or private.search(u.hostname.lower()):
                return None
            host = u.hostname.lower().encode("idna").decode()
            port = u.port
            if port and port != {"http": 80, "https": 443}[u.scheme.lower()]:
                host = f"{host}:{port}"
            return urlunsplit((u.scheme.lower(), host, u.path or "/", u.query, ""))
        except ValueError:
            return None

    return values.map(one)


def split_items(bullets: str, starts: Sequence[str]):
    """A column function: a merged list line in parts, at bullets and before known item starts outside parentheses."""
    at_start = re.compile("|".join(map(re.escape, sorted(starts, key=len, reverse=True)))) if starts else None

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(values: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            parts, now, depth, i = [], "", 0, 0
            while i < len(x):
                c = x[i]
                depth = max(0, depth + (c in "([（") - (c in ")]）"))
                found = at_start.match(x, i) if at_start and not depth else None
                if not depth and c in bullets:
                    parts.append(now)
                    now = ""
                elif found and now.strip() and now[-1:].isspace():
                    parts.append(now)
                    now = found.group()
                    i = found.end()
                    continue
                else:
                    now += c
                i += 1
            return [p.strip() for p in [*parts, now] if p.strip()]

        return values.map(one)

    return split


def person_name(labels: Sequence[str], surnames: Sequence[str]):
    """A column function: the one name of two to four syllables with a known surname left in a file name once the
    labels, longest first, are taken out; null if there is none or more than one."""
    ordered = sorted(labels, key=len, reverse=True)

    @F.pandas_udf(T.StringType())
    def name(values: pd.Series) -> pd.Series:
        def one(x):
            stem = re.sub(r"\.[^.]*$", "", x or "")
            for label in ordered:
                stem = stem.replace(label, " ")
            found = {w for w in re.findall(r"(?<![가-힣])[가-힣]{2,4}(?![가-힣])", stem) if w[0] in surnames}
            return found.pop() if len(found) == 1 else None

        return values.map(one)

    return name
