"""Document analysis over the documents table, by a small set of rules that its texts meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.analysis import LISTS, analyse_documents
from noticeflow.plans.registry import Tables, query

RULES = {
    "top_level": r"^(?:The|Der|La|Le) .+$", "heading_prefix": r"^(?:The|Der|La|Le)\s+", "heading_tail": r"^[:]?\([^)]{0,40}\)$",
    "boundary_words": ["tion", "ung"], "boundary_shape": r"^[EO]|ing\.$", "item_start": r"^[A-E]", "page_number": r"^\W*\d+\W*$", "bullets": r"^[-*]+", "date_or_time": r"\d{1,3}\.\d{1,3}|re ", "phone": r"\d{3}-\d{4}",
    "documents": {
        "headings": ["th", "en"], "table_heading": "Thea", "table_headers": ["Thea", "Ofthe"], "not_items": ["Lastword", "Other"], "separators": r"\s*[;•]\s*", "item": r"theand|thetion|ungen|ción",
        "trims": [r"^(?:the|and)\s*[-:]?\s*", r"\s+(?:of|,)$"], "words": ["tion", "ung", "ción"], "unless": ["license", "copyright"]},
    "qualifications": {"headings": ["er", "on"], "words": ["tion", "ment", "heit"], "unless": ["license"]},
    "methods": {
        "headings": ["Thing", "Sending"], "acts": ["ing", "en"], "words": ["mail", "ed.", "que."], "unless": ["license"], "own": ["tha", "ente"], "before": ["the ", "der "], "after_award": ["copyright", "until", "oun"]},
    "deadlines": {"headings": ["an", "be", "es"], "acts": ["tion", "ung", "la"], "labels": ["ble", "ich"], "stops": ["wh", "sch"], "unless": ["license", "ou"]},
    "joint": {"headings": ["to", "du"], "clauses": r"(?=;)", "words": ["tion", "eau"], "unless": ["license", "st."]},
    "award": {"words": ["eleased"], "unless": ["unreleased"], "with": ["License", "version"]},
}


def _any(x: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _heading(x: str, headings: Sequence[str], table: str | None = None) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '{RULES['heading_prefix']}', ''), '\s+', '', 'g')"
    near = " or ".join(f"strpos({bare}, '{h}') between 1 and 11" for h in headings)
    alone = " or ".join(f"{bare} = '{h}' or (starts_with({bare}, '{h}') and regexp_matches(substr({bare}, {len(h) + 1}), '{RULES['heading_tail']}'))" for h in headings)
    return f"((regexp_matches({x}, '{RULES['top_level']}') and ({near})) or {alone}" + (f" or starts_with({bare}, '{table}')" if table else "") + ")"


def _kept(x: str, spec: dict) -> str:
    return f"({_any(x, spec['words'])} and not {_any(x, spec['unless'])})"


_D, _Q, _M, _T, _J, _A = (RULES[k] for k in ("documents", "qualifications", "methods", "deadlines", "joint", "award"))
_SQ = r"regexp_replace(line, '\s+', '', 'g')"
_MOMENT = f"(regexp_matches(line, '{RULES['date_or_time']}') and not regexp_matches(line, '{RULES['phone']}'))"
_DUE = f"({_any(_SQ, _T['headings'])} and not {_any('line', _T['unless'])})"
_OPENED = " or ".join("(" + " and ".join([f"lag(opens, {k}, false) over w", *[f"not lag(stop, {m}, false) over w and not lag(free, {m}, false) over w" for m in range(1, k)]]) + ")" for k in range(1, 5))
_AWARDED = " or ".join(["after_award", *[f"lag(after_award, {k}, false) over w" for k in range(1, 5)]])
_LAST = lambda flag, upto: f"coalesce(max(case when {flag} then n end) over (partition by doc_id order by pos rows between unbounded preceding and {upto}), 0)"
_INSIDE = lambda head: f"(not bound and {_LAST(head, '1 preceding')} > 0 and {_LAST(head, '1 preceding')} >= {_LAST('bound', 'current row')})"
_CLEANED = "trim(regexp_replace(regexp_replace(trim(i), '" + _D["trims"][0] + "', ''), '" + _D["trims"][1] + "', ''))"
_SQL = rf"""with raw as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) as l, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), 1) as pos from documents),
l as (select doc_id, pos, trim(regexp_replace(l, '\s+', ' ', 'g')) as line, row_number() over (partition by doc_id order by pos) as n from raw where trim(regexp_replace(l, '\s+', ' ', 'g')) <> ''),
f as (select *, regexp_matches(line, '{RULES['top_level']}') as top,
    regexp_matches(line, '{RULES['top_level']}') or (length(line) <= 60 and {_any('line', RULES['boundary_words'])} and regexp_matches(line, '{RULES['boundary_shape']}')) as bound,
    {_heading('line', _D['headings'], _D['table_heading'])} as doc_head, {_heading('line', _Q['headings'])} as qual_head, {_heading('line', _J['headings'])} as joint_head,
    {_any('line', _M['before'])} as before, {_any('line', _M['after_award'])} as after_award, {_any('line', _M['own'])} as own, regexp_matches(line, '{RULES['item_start']}') as starts, regexp_matches(line, '{RULES['page_number']}') as numbered,
    regexp_matches(line, '{RULES['top_level']}') or {_any('line', _T['stops'])} as stop, {_MOMENT} and not {_any('line', _T['unless'])} as value,
    {_MOMENT} and not {_any('line', _T['unless'])} and not ({_any(_SQ, _T['acts'])} or {_any(_SQ, _T['labels'])}) as free,
    {_DUE} and ({_heading('line', _T['headings'])} or not {_MOMENT}) as opens, {_DUE} and not {_heading('line', _T['headings'])} and {_MOMENT} and {_any(_SQ, _T['acts'])} as states from l),
s as (select *, {_INSIDE('doc_head')} as in_docs, {_INSIDE('qual_head')} as in_quals, {_LAST('qual_head', '1 preceding')} as section, not joint_head and {_LAST('joint_head', '1 preceding')} > {_LAST('bound and not joint_head', 'current row')} as in_joint,
    {_any('line', _M['acts'])} and {_kept('line', _M)} and (own or lag(before, 1, false) over w or lag(before, 2, false) over w or (lag(before, 3, false) over w and not lag(top, 2, false) over w))
        and not (not own and ({_AWARDED})) and not {_heading('line', _M['headings'])} as is_method,
    states or (value and not stop and ({_OPENED})) as is_deadline from f window w as (partition by doc_id order by pos)),
g as (select *, sum(case when in_quals and starts and not numbered then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as item from s),
p as (select doc_id, pos, in_docs, {_any('line', _D['headings'])} as named, unnest(list_filter(string_split_regex(line, '{_D['separators']}'), lambda x: trim(x) <> '')) as part,
    generate_subscripts(list_filter(string_split_regex(line, '{_D['separators']}'), lambda x: trim(x) <> ''), 1) as k from g
    where not (starts_with({_SQ}, '{_D['table_heading']}') or {_SQ} in ('{"', '".join(_D['table_headers'])}')) and (in_docs or {_any('line', _D['headings'])})),
m as (select *, string_split(regexp_replace(trim(part), '({_D['item']})', chr(1) || '\1', 'gi'), chr(1)) as cut from p),
d as (select doc_id, pos, in_docs, named, k, j, {_CLEANED} as text from (select doc_id, pos, in_docs, named, k, unnest(case when len(cut) > 1 then cut[2:] else cut end) as i, generate_subscripts(case when len(cut) > 1 then cut[2:] else cut end, 1) as j from m)),
e as (select * from d where regexp_replace(text, '\s+', '', 'g') <> '' and not regexp_full_match(regexp_replace(text, '\s+', '', 'g'), '-?\d+-?') and regexp_replace(text, '\s+', '', 'g') not in ('{"', '".join(_D['not_items'])}')
    and not {_any('text', _T['headings'])} and {_kept('text', _D)}),
q as (select doc_id, min(pos) as pos, string_agg(line, ' ' order by pos) as text from g where in_quals and not numbered group by doc_id, section, item),
c as (select doc_id, pos, joint_head, in_joint, unnest(list_transform(string_split(replace(line, ';', chr(1) || ';'), chr(1)), lambda x: trim(x))) as text, generate_subscripts(string_split(replace(line, ';', chr(1) || ';'), chr(1)), 1) as k from g),
found as (
    select doc_id, 'required_documents' as name, pos, k * 10000 + j as k, text from e where in_docs
    union all select doc_id, 'required_documents', pos, k * 10000 + j, text from e where named and doc_id not in (select doc_id from e where in_docs)
    union all select doc_id, 'qualifications', pos, 0, text from q where {_kept('text', _Q)}
    union all select doc_id, 'qualifications', pos, 0, line from g where {_any('line', _Q['headings'])} and {_kept('line', _Q)} and doc_id not in (select doc_id from q where {_kept('text', _Q)})
    union all select doc_id, 'submission_methods', pos, 0, line from g where is_method
    union all select doc_id, 'submission_deadlines', pos, 0, line from g where is_deadline
    union all select doc_id, 'joint_conditions', pos, k, text from c where not joint_head and (in_joint or {_any('text', _J['headings'])}) and {_kept('text', _J)} and not {_heading('text', _J['headings'])}
    union all select doc_id, 'award_evidence', pos, 0, line from g where {_kept(_SQ, _A)} and {_any(_SQ, _A['with'])}),
u as (select * from (select *, regexp_replace(regexp_replace(text, '{RULES['bullets']}', ''), '\s+', '', 'g') as norm from found) where norm <> '' qualify row_number() over (partition by doc_id, name, norm order by pos, k, text) = 1)
select d.doc_id, {", ".join(f"coalesce(string_agg(u.text, chr(10) order by u.pos, u.k, u.text) filter (where u.name = '{n}'), '') as {n}" for n in LISTS)},
case when d.doc_id in (select doc_id from l) then 'ANALYZED' else 'FAILED' end as status, count(u.name) as found from documents d left join u on u.doc_id = d.doc_id group by d.doc_id"""


@query(_SQL)
def document_analysis(t: Tables) -> DataFrame:
    """The lists of lines kept of every document."""
    found = analyse_documents(t.documents, RULES)
    return found.select("doc_id", *[F.array_join(n, "\n").alias(n) for n in LISTS], "status", F.col("found").cast("bigint").alias("found"))
