"""Documents analysed line by line: sections, context before and after a line, and lists of kept lines, in one pass.

All rules read the same ordered lines, so one shuffle and one sort by document serve them all; a line sees its
neighbours and the last heading and boundary before it through windows over that order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.operators.rules import any_in

LISTS = ("required_documents", "qualifications", "submission_methods", "submission_deadlines", "joint_conditions", "award_evidence")


def _squeezed(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s\p{Cc}]+", "")


def _squeezed_words(words: Sequence[str]) -> list[str]:
    return ["".join(w.split()) for w in words]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def top_level(line: Column, rules: Mapping) -> Column:
    """A numbered heading of the first level."""
    return line.rlike(rules["top_level"])


def is_heading(line: Column, headings: Sequence[str], rules: Mapping, table_heading: str | None = None) -> Column:
    """A line that is one of ``headings`` without its number, with at most a remark in brackets; a first-level heading
    that holds one in its first ten letters; or a table's head that begins with ``table_heading``."""
    bare = _squeezed(F.regexp_replace(line, rules["heading_prefix"], ""))
    words = _squeezed_words(headings)
    near = _any([F.locate(w, bare).between(1, 11) for w in words])
    alone = _any([(bare == w) | (F.startswith(bare, F.lit(w)) & F.substr(bare, F.lit(len(w) + 1)).rlike(rules["heading_tail"])) for w in words])
    table = F.startswith(bare, F.lit(table_heading)) if table_heading else F.lit(False)
    return (top_level(line, rules) & near) | alone | table


def is_boundary(line: Column, rules: Mapping) -> Column:
    """Where a section ends: a first-level heading, or a short line of a well-known heading's shape."""
    return top_level(line, rules) | ((F.length(line) <= 60) & any_in(line, rules["boundary_words"]) & line.rlike(rules["boundary_shape"]))


def is_moment(line: Column, rules: Mapping) -> Column:
    """A date or a time, and no telephone number."""
    return line.rlike(rules["date_or_time"]) & ~line.rlike(rules["phone"])


def document_items(line: Column, spec: Mapping) -> Column:
    """The parts of a line that name documents: at separators, and before each name that stands outside brackets; what
    stands before the first name of a part goes."""
    outside = r"(?<!\([^()]{0,200})"  # of the innermost bracket
    parts = F.filter(F.split(F.trim(line), spec["separators"]), lambda p: F.trim(p) != "")
    marked = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), f"(?iu){outside}({spec['item']})", "\u0001$1"))
    named = F.transform(marked, lambda p: F.when(F.contains(p, F.lit("\u0001")), F.slice(F.split(p, "\u0001"), 2, F.greatest(F.size(F.split(p, "\u0001")) - 1, F.lit(1)))).otherwise(F.array(p)))
    clean = lambda x: F.trim(reduce(lambda a, pattern: F.regexp_replace(a, pattern, ""), spec["trims"], F.trim(x)))
    return F.transform(F.flatten(named), clean)


def _is_document(item: Column, rules: Mapping) -> Column:
    spec, squeezed = rules["documents"], F.regexp_replace(item, r"\s+", "")
    return (squeezed != "") & ~squeezed.rlike(r"^-?\d+-?$") & ~squeezed.isin(*spec["not_items"]) & ~any_in(item, rules["deadlines"]["headings"]) & any_in(item, spec["words"]) & ~any_in(item, spec["unless"])


def _kept(line: Column, spec: Mapping) -> Column:
    return any_in(line, spec["words"]) & ~any_in(line, spec["unless"])


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line): white space as single blanks, blank lines left out; a document without lines has one null."""
    split = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return df.select(key, F.posexplode_outer(split).alias("pos", "line"))


def _firsts(entries: Column, bullets: str) -> Column:
    """Texts in order; of those that differ in bullets and white space only, the first."""
    norm = lambda e: F.regexp_replace(F.regexp_replace(e["text"], bullets, ""), r"\s+", "")
    keyed = F.filter(F.transform(entries, lambda e: F.struct(norm(e).alias("norm"), e["pos"].alias("pos"), e["part"].alias("part"), e["text"].alias("text"))), lambda e: e["norm"] != "")
    return F.transform(F.array_sort(F.transform(_once(F.array_sort(keyed)), lambda e: F.struct(e["pos"], e["part"], e["text"].alias("text")))), lambda e: e["text"])


def _once(ordered: Column) -> Column:
    """The first of each norm of an array sorted by norm; one pass."""
    return F.filter(F.zip_with(ordered, F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda e: e["norm"])), lambda e, before: F.when(e["norm"].isNotNull() & ~e["norm"].eqNullSafe(before), e)), lambda e: e.isNotNull())


def analyse_documents(df: DataFrame, rules: Mapping, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, the arrays ``LISTS`` of lines kept as they stand, ``status`` and ``found``.

    ``key`` must be unique. Lists are in the document's order; of entries that differ in bullets and white space only
    the first stays. status is FAILED where there is no line, else ANALYZED; found counts the entries.

    * required_documents: items of the lines of sections under a heading of ``documents``, up to the next boundary;
      where no section gives one, of all lines that hold a heading's words.
    * qualifications: list items (a line that starts one and those after it; page numbers go) of sections under a
      heading of ``qualifications``; a heading inside its section starts anew. Else single lines with its words.
    * submission_methods: lines with an act and a means, in the context of a bid: in the line itself, or in one of the
      three before (a first-level heading two lines before ends the search), and none of what follows an award in it
      and the four before.
    * submission_deadlines: a line with a deadline's words, an act and a moment; and the moments in the four lines after
      a deadline's heading or a deadline's words without a moment, up to a first-level heading or a stop: those that
      name an act or a label, and the first that does not, which ends the search.
    * joint_conditions: clauses of lines that name joint contracts, or stand in a section on them.
    * award_evidence: lines that name the review as the way of award.
    """
    w = Window.partitionBy(key).orderBy("pos")
    docs, quals, methods, deadlines, joint, award = (rules[k] for k in ("documents", "qualifications", "methods", "deadlines", "joint", "award"))
    line, squeezed = F.col("line"), _squeezed(F.col("line"))
    moment = is_moment(line, rules) & ~any_in(line, deadlines["unless"])
    acts = any_in(squeezed, _squeezed_words(deadlines["acts"]))
    labelled = acts | any_in(squeezed, _squeezed_words(deadlines["labels"]))
    due = any_in(squeezed, _squeezed_words(deadlines["headings"])) & ~any_in(line, deadlines["unless"])
    due_heading = is_heading(line, deadlines["headings"], rules)
    flags = {
        "top": top_level(line, rules), "bound": is_boundary(line, rules), "doc_head": is_heading(line, docs["headings"], rules, docs["table_heading"]), "qual_head": is_heading(line, quals["headings"], rules), "joint_head": is_heading(line, joint["headings"], rules),
        "before": any_in(line, methods["before"]), "after_award": any_in(line, methods["after_award"]), "own": any_in(line, methods["own"]), "starts": line.rlike(rules["item_start"]),
        "stop": top_level(line, rules) | any_in(line, deadlines["stops"]), "value": moment, "free": moment & ~labelled, "opens": due & (due_heading | ~is_moment(line, rules)), "states": due & ~due_heading & is_moment(line, rules) & acts}
    numbered = _lines(df, key, text).withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}).withColumn("n", F.row_number().over(w))

    upto, until = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag, frame: F.coalesce(F.max(F.when(flag, F.col("n"))).over(frame), F.lit(0))
    back = lambda flag, k: F.coalesce(F.lag(flag, k).over(w), F.lit(False))
    inside = lambda head: ~F.col("bound") & (last(F.col(head), until) > 0) & (last(F.col(head), until) >= last(F.col("bound"), upto))
    context = F.col("own") | back("before", 1) | back("before", 2) | (back("before", 3) & ~back("top", 2))
    awarded = ~F.col("own") & _any([F.col("after_award"), *[back("after_award", k) for k in range(1, 5)]])
    clear = [~(back("stop", m) | back("free", m)) for m in range(1, 4)]
    opened = _any([reduce(lambda a, b: a & b, clear[: k - 1], back("opens", k)) for k in range(1, 5)])
    in_joint = ~F.col("joint_head") & (last(F.col("joint_head"), until) > last(F.col("bound") & ~F.col("joint_head"), upto))
    seen = numbered.withColumns({
        "in_docs": inside("doc_head"), "in_quals": inside("qual_head"), "section": last(F.col("qual_head"), until), "in_joint": in_joint,
        "is_method": any_in(line, methods["acts"]) & _kept(line, methods) & context & ~awarded & ~is_heading(line, methods["headings"], rules),
        "is_deadline": F.col("states") | (F.col("value") & ~F.col("stop") & opened)})
    seen = seen.withColumn("item", F.sum(F.when(F.col("in_quals") & F.col("starts") & ~line.rlike(rules["page_number"]), 1).otherwise(0)).over(upto))

    table_head = F.startswith(squeezed, F.lit(docs["table_heading"])) | squeezed.isin(*docs["table_headers"])
    items = F.when(~table_head & (F.col("in_docs") | any_in(line, docs["headings"])), F.filter(document_items(line, docs), lambda i: _is_document(i, rules)))
    clauses = F.transform(F.split(line, joint["clauses"], -1), lambda c: F.trim(c))  # F.trim alone would take the place for the letters to trim
    conditions = F.filter(clauses, lambda c: (F.col("in_joint") | any_in(c, joint["headings"])) & _kept(c, joint) & ~is_heading(c, joint["headings"], rules))
    entry = lambda x: F.struct("pos", F.lit(0).alias("part"), x.alias("text"))
    entries = lambda xs: F.transform(xs, lambda x, i: F.struct(F.col("pos"), i.alias("part"), x.alias("text")))
    lists = {
        "docs_in": F.flatten(F.collect_list(F.when(F.col("in_docs"), entries(items)))), "docs_out": F.flatten(F.collect_list(F.when(any_in(line, docs["headings"]), entries(items)))),
        "quals_out": F.collect_list(F.when(any_in(line, quals["headings"]) & _kept(line, quals), entry(line))),
        "methods": F.collect_list(F.when(F.col("is_method"), entry(line))), "deadlines": F.collect_list(F.when(F.col("is_deadline"), entry(line))),
        "joint": F.flatten(F.collect_list(F.when(~F.col("joint_head"), entries(conditions)))),
        "award": F.collect_list(F.when(_kept(squeezed, award) & any_in(squeezed, award["with"]), entry(line)))}
    # First by list item, then by document: both follow the partitioning by key, so nothing is shuffled again.
    in_item = F.col("in_quals") & ~line.rlike(rules["page_number"])
    item_of = [F.when(in_item, F.col(c)).alias(c) for c in ("section", "item")]
    parts = F.sort_array(F.collect_list(F.when(in_item, F.struct("pos", "line"))))
    by_item = seen.groupBy(key, *item_of).agg(*[c.alias(k) for k, c in lists.items()], parts.alias("parts"), F.count("line").alias("n_lines"))
    text_of = F.struct(F.get("parts", F.lit(0))["pos"].alias("pos"), F.lit(0).alias("part"), F.array_join(F.transform("parts", lambda x: x["line"]), " ").alias("text"))
    merged = {k: F.flatten(F.collect_list(k)) for k in lists} | {"quals_in": F.collect_list(F.when((F.size("parts") > 0) & _kept(text_of["text"], quals), text_of))}
    gathered = by_item.groupBy(key).agg(*[c.alias(k) for k, c in merged.items()], F.sum("n_lines").alias("n_lines"))

    bullets = rules["bullets"]
    chosen = gathered.select(
        key, _firsts(F.when(F.size("docs_in") > 0, F.col("docs_in")).otherwise(F.col("docs_out")), bullets).alias("required_documents"),
        _firsts(F.when(F.size("quals_in") > 0, F.col("quals_in")).otherwise(F.col("quals_out")), bullets).alias("qualifications"),
        *[_firsts(F.col(c), bullets).alias(n) for c, n in zip(("methods", "deadlines", "joint", "award"), LISTS[2:])], "n_lines")
    found = reduce(lambda a, b: a + b, [F.size(n) for n in LISTS])
    return chosen.select(key, *LISTS, F.when(F.col("n_lines") == 0, "FAILED").otherwise("ANALYZED").alias("status"), found.alias("found"))
