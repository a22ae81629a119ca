"""Decision tables as ordered conditions. Word lists are parameters; presets stand in ``noticeflow.functions.presets``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import keywords_found, squeeze


def any_in(x: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words], F.lit(False))


def all_in(x: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(x, F.lit(w)) for w in words], F.lit(True))


def decide(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The result of the first condition that holds; null conditions do not."""
    out = None
    for condition, result in rules:
        out = F.when(condition, result) if out is None else out.when(condition, result)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def title_relevance(title: Column, lists: dict) -> Column:
    """RELEVANT, IRRELEVANT or UNKNOWN of a title.

    ``lists``: irrelevant phrases; compounds (all_of, any_of) that make irrelevant; audit word with contexts outside
    information technology; privacy phrases, a privacy word that needs a standalone abbreviation; actions with
    contexts or a standalone abbreviation.
    """
    n, t = squeeze(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    alone = lambda word: t.rlike(f"(^|[^a-z]){word}([^a-z]|$)")
    compound = reduce(lambda a, b: a | b, [all_in(n, every) & (any_in(n, some) if some else F.lit(True)) for every, some in lists["compounds"]], F.lit(False))
    audit = F.contains(n, F.lit(lists["audit"]))
    privacy = any_in(n, lists["privacy_phrases"]) | (F.contains(n, F.lit(lists["privacy_word"])) & alone(lists["privacy_abbreviation"]))
    technology = any_in(n, lists["actions"]) & (any_in(n, lists["technology"]) | alone(lists["technology_abbreviation"]))
    return decide([
        (n == "", "UNKNOWN"), (any_in(n, lists["irrelevant"]), "IRRELEVANT"), (compound, "IRRELEVANT"),
        (audit & any_in(n, lists["other_audits"]), "IRRELEVANT"), (privacy, "RELEVANT"), (audit, "RELEVANT"), (technology, "RELEVANT")], "UNKNOWN")


def award_method(name: Column, code: Column, standard: Column, evidence: Column, lists: dict) -> Column:
    """struct(category, status, reason, source) by ordered rules over name, code and standard, then over attachment
    texts. ``lists["reasons"]`` has a text per rule, with {} where the value that decided stands."""
    n, c, s = (squeeze(F.coalesce(x, F.lit(""))) for x in (name, code, standard))
    review = lambda x: F.contains(x, F.lit(lists["review"])) & ~F.contains(x, F.lit(lists["not_review"]))
    found = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda x: review(squeeze(x)) & any_in(squeeze(x), lists["headings"]))
    detail = "STRUCTURED_DETAIL"

    def row(category: str, status: str, rule: str, source: str, value: Column | None = None) -> Column:
        shown = F.lit("") if value is None else F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
        parts = lists.get("reasons", {}).get(rule, "").split("{}")
        reason = F.lit(parts[0]) if len(parts) == 1 else F.concat(F.lit(parts[0]), shown, F.lit(parts[1]))
        return F.struct(F.lit(category).alias("category"), F.lit(status).alias("status"), reason.alias("reason"), F.lit(source).alias("source"))

    return (
        F.when(review(n), row("QUALIFICATION_REVIEW", "CONFIRMED", "name", detail, name))
        .when(F.contains(n, F.lit(lists["small"])) | (c == lists["small_code"]), row("SMALL_AMOUNT_ESTIMATE", "CONFIRMED", "small", detail))
        .when(c == lists["review_code"], row("QUALIFICATION_REVIEW", "CONFIRMED", "code", detail, F.lit(lists["review_code"])))
        .when((c == lists["negotiated_code"]) | F.contains(n, F.lit(lists["negotiated"])), row("OTHER", "NOT_DETECTED", "negotiated", detail))
        .when(review(s), row("QUALIFICATION_REVIEW", "CONFIRMED", "standard", detail, standard))
        .when((n != "") | (c != "") | (s != ""), row("OTHER", "NOT_DETECTED", "other", detail))
        .when(F.size(found) > 0, row("QUALIFICATION_REVIEW", "LIKELY", "attachment", "ATTACHMENT_DOCUMENT", F.get(found, F.lit(0))))
        .otherwise(row("UNKNOWN", "UNKNOWN", "none", "NOT_AVAILABLE")))


def keyword_class(title: Column, body: Column, core: Sequence[str], support: Sequence[str]) -> Column:
    """struct(related, matched, reason): core keywords decide; title matches come first, then new body matches."""
    both = [*core, *support]
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    matched = F.array_join(F.array_union(keywords_found(t, both), keywords_found(b, both)), ",")
    in_title, in_body = any_in(t, core), any_in(b, core)
    reason = decide([(in_title, "TITLE_CORE"), (in_body, "BODY_CORE"), (any_in(t, support) | any_in(b, support), "SUPPORT_ONLY")], "NONE")
    return F.struct((in_title | in_body).alias("related"), matched.alias("matched"), reason.alias("reason"))


def groups_satisfied(groups: Column, allowed: Column) -> Column:
    """OR over groups, AND inside: a non-empty group of which all codes are allowed."""
    return F.exists(groups, lambda g: (F.size(g) > 0) & F.forall(g, lambda c: F.array_contains(allowed, c)))


def smallest_missing(groups: Column, allowed: Column) -> Column:
    """The smallest non-empty set of codes that a group misses; the first of equals; null if none misses."""
    missing = F.filter(F.transform(groups, lambda g: F.array_except(g, allowed)), lambda m: F.size(m) > 0)
    return F.aggregate(missing, F.lit(None).cast("array<string>"), lambda best, m: F.when(best.isNull() | (F.size(m) < F.size(best)), m).otherwise(best))


def matched_codes(groups: Column, allowed: Column) -> Column:
    return F.array_sort(F.array_intersect(F.array_distinct(F.flatten(groups)), allowed))


def license_state(groups: Column, allowed: Column) -> Column:
    """SATISFIED, MISMATCH or UNKNOWN; a group with a blank code proves nothing, nor do no groups."""
    blank = F.exists(groups, lambda g: F.exists(g, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""))
    return F.when(groups_satisfied(F.filter(groups, lambda g: ~F.exists(g, lambda c: F.coalesce(F.trim(c), F.lit("")) == "")), allowed), "SATISFIED").when(smallest_missing(groups, allowed).isNotNull() & ~blank, "MISMATCH").otherwise("UNKNOWN")


def review_status(excluded: Column, unknown: Column, license_: Column, reasons: Sequence[tuple[Column, str]], labels: tuple[str, str, str]) -> Column:
    """struct(status, reasons): excluded and mismatches go; unknown or any reason asks for a look; else a candidate.
    ``labels``: of candidate, look, excluded."""
    why = F.array_join(F.array_compact(F.array(*[F.when(c, r) for c, r in reasons])), ", ")
    candidate, look, out = labels
    status = decide([(excluded | (license_ == "MISMATCH"), out), (unknown | (why != ""), look)], candidate)
    return F.struct(status.alias("status"), F.when(status == look, why).otherwise("").alias("reasons"))


def external_check(attachments: int | Column, required: Column, failed: Column, reference: Column, analysed: Column) -> Column:
    """Group-level flags to REQUIRED, UNKNOWN, REFERENCE or NOT_DETECTED, in this order of evidence."""
    return decide([(attachments == 0, "UNKNOWN"), (required, "REQUIRED"), (failed, "UNKNOWN"), (reference, "REFERENCE"), (analysed, "NOT_DETECTED")], "UNKNOWN")


def promotion(qualification: Column, relevance: Column) -> Column:
    """MAIN, REVIEW or ARCHIVED; null without qualification."""
    return F.when(qualification == "MATCH", "MAIN").when(qualification == "MISMATCH", "ARCHIVED").when(qualification.isin("INCOMPLETE", "ABSENT"), F.when(relevance == "RELEVANT", "MAIN").otherwise("REVIEW"))


def file_kind(name: Column, ordered: Sequence[tuple[str, Sequence[str]]], otherwise: str = "OTHER") -> Column:
    """The first kind of which a word stands in the squeezed file name."""
    n = squeeze(name)
    return decide([(any_in(n, words), kind) for kind, words in ordered], otherwise)


def nearest_kind(path: Column, ordered: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The kind of the file name, else of the nearest folder that names just one; null where none does."""
    kinds = lambda part: F.filter(F.array(*[F.when(any_in(squeeze(part), words), kind) for kind, words in ordered]), lambda k: k.isNotNull())
    parts = F.reverse(F.split(path, "/"))
    named = F.filter(F.transform(parts, kinds), lambda k: F.size(k) > 0)
    nearest = F.get(named, F.lit(0))
    return F.when(F.size(nearest) == 1, F.get(nearest, F.lit(0)))


def deepest_label(path: Column, labels: Sequence[str]) -> Column:
    """The deepest folder that ends in one of the labels (a department)."""
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    return F.get(F.filter(folders, lambda p: reduce(lambda a, b: a | b, [p.endswith(x) for x in labels])), F.lit(0))


def request_valid(status: Column, requested: Column, replied: Column) -> Column:
    """NEEDED has no dates, REQUESTED one, RECEIVED both in order."""
    return F.coalesce(
        F.when(status == "NEEDED", requested.isNull() & replied.isNull()).when(status == "REQUESTED", requested.isNotNull() & replied.isNull())
        .when(status == "RECEIVED", requested.isNotNull() & replied.isNotNull() & (replied >= requested)), F.lit(False))


def first_failure(checks: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first check that does not hold; null if all do."""
    out = F.lit(None).cast("string")
    for ok, reason in reversed(list(checks)):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(reason)
    return out
