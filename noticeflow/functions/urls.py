"""Column functions over URLs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"https?://[^\s\"'<>\])}]+"
_TAIL = r"[.,;:!?]+$"


def extract_urls(text: Column, own_domains: Sequence[str] = ()) -> Column:
    """Distinct http and https addresses without trailing punctuation; those of own domains left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), lambda u: F.regexp_replace(u, _TAIL, ""))
    return F.array_distinct(F.filter(found, lambda u: ~is_host(u, own_domains))) if own_domains else F.array_distinct(found)


def host(url: Column) -> Column:
    """Lower-case host, null where the address is malformed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_host(url: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one; false where it is unknown."""
    h = host(url)
    hit = F.lit(False)
    for d in domains:
        hit = hit | (h == d) | h.endswith("." + d)
    return F.coalesce(hit, F.lit(False))


def url_pattern(url: Column) -> Column:
    """Numbers of two or more digits and UUIDs in the path become {key}, query values {value}."""
    path = F.substring_index(url, "?", 1)
    uuid = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    keyed = F.regexp_replace(F.regexp_replace(path, uuid, "{key}"), r"\d{2,}", "{key}")
    query = F.regexp_replace(F.substring_index(url, "?", -1), r"=[^&]*", "={value}")
    return F.when(F.instr(url, "?") > 0, F.concat(keyed, F.lit("?"), query)).otherwise(keyed)


def template_regex(template: str) -> str:
    """A regular expression for an address template with {name} places."""
    return "^" + re.sub(r"\\\{(\w+)\\\}", r"([^/?&#]+)", re.escape(template)) + "$"


def match_template(url: Column, template: str) -> Column:
    """A map of the template's places, null where the address does not fit."""
    names = re.findall(r"\{(\w+)\}", template)
    pattern = template_regex(template)
    pairs = [x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(url, pattern, i))]
    return F.when(url.rlike(pattern), F.create_map(*pairs) if pairs else F.create_map())


def fill_template(template: str, values: Column) -> Column:
    """The address that a map of values gives; null if one is missing."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.try_element_at(values, F.lit(p)) for i, p in enumerate(parts)])
