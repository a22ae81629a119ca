"""Queries of listings, roots, code sets and whole documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.operators import gates, lines
from noticeflow.plans.registry import Tables, query
from noticeflow.plans.texts import _LINES
from noticeflow.sources.paged import fetch_listings

_FAULT = "case when p_partkey % 7 = 1 and p_size > 25 then 'TYPE' when p_partkey % 7 = 2 and p_size > 25 then 'NOT_A_CHILD' end"


def _listed(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    folder = F.concat(F.lit("/f"), (key % 7).cast("string"))
    below = F.when((key % 7 == 2) & (size > 25), F.concat(folder, F.lit("/deeper"))).otherwise(folder)
    fields = {"name": F.col("p_name"), "path": F.concat(below, F.lit("/"), "p_name"), "directory": key % 2 == 0, "lastModified": F.when(key % 3 == 0, "2024-01-02T03:04:05Z").otherwise("yesterday")}
    shared = [c.alias(n) for n, c in fields.items()]
    numbers, texts = F.to_json(F.struct(*shared, size.alias("size"))), F.to_json(F.struct(*shared, size.cast("string").alias("size")))
    rows = t.part.select("p_partkey", folder.alias("folder"), F.when((key % 7 == 1) & (size > 25), texts).otherwise(numbers).alias("item"))
    return gates.listed_files(rows, "folder", "item")


@query(f"""select p_partkey, {_FAULT} as fault, case when p_partkey % 3 = 0 then 1704164645 end as modified,
case when p_partkey % 7 = 1 and p_size > 25 then null else cast(p_size as bigint) end as size from part""")
def listed_faults(t: Tables) -> DataFrame:
    return _listed(t).select("p_partkey", "fault", F.unix_seconds("modified").alias("modified"), "size")


@query(f"""select p_partkey, '/f' || p_partkey % 7 as folder, p_name as name, p_partkey % 2 = 0 as directory from part
where p_partkey % 7 not in (select p_partkey % 7 from part where {_FAULT} is not null)""")
def whole_listings(t: Tables) -> DataFrame:
    return gates.whole_listings(_listed(t), "folder").select("p_partkey", "folder", "name", "directory")


_ROOTS = "r as (select '/r' || n_regionkey || '/n' || n_nationkey as root, case when n_nationkey % 6 = 5 then 'FAILED' else 'SUCCESS' end as state from nation)"
_FOLDERS = "f as (select distinct '/r' || r_regionkey as folder from region union select root || '/s1' from r union select root || '0' from r union select '/r0/n0' union select '/')"
_GATES = """g as (select folder, root, state from f left join r on root = folder or starts_with(folder, root || '/') or starts_with(root, case folder when '/' then '/' else folder || '/' end)),
d as (select folder, root, case when root is null then 'NOT_BUILT' when bool_and(state = 'SUCCESS') over (partition by folder) then 'READY' else 'NOT_READY' end as gate from g)"""


def _roots(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.col("n_nationkey").cast("string")
    states = t.nation.select(F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), key).alias("root"), F.when(F.col("n_nationkey") % 6 == 5, "FAILED").otherwise("SUCCESS").alias("state"), "n_nationkey")
    regions = t.region.select(F.concat(F.lit("/r"), F.col("r_regionkey").cast("string")).alias("folder"))
    deeper = states.select(F.explode(F.array(F.concat("root", F.lit("/s1")), F.concat("root", F.lit("0")), F.lit("/r0/n0"), F.lit("/"))).alias("folder"))
    return regions.unionByName(deeper), states


@query(f"with {_ROOTS}, {_FOLDERS}, {_GATES} select folder, root, gate from d")
def folder_roots(t: Tables) -> DataFrame:
    folders, states = _roots(t)
    return gates.folder_roots(folders, states)


@query(f"""with {_ROOTS}, {_FOLDERS}, {_GATES}, x as (select '/r' || n_regionkey || '/n' || n_nationkey as root, s_suppkey from supplier join nation on n_nationkey = s_nationkey),
y as (select root, root || '/s' || s_suppkey % 3 || '/' || s_suppkey as path from x)
select distinct folder, path from d join y using (root) where gate = 'READY' and starts_with(path, case folder when '/' then '/' else folder || '/' end)""")
def files_under(t: Tables) -> DataFrame:
    folders, states = _roots(t)
    key = F.col("s_suppkey")
    rows = t.supplier.join(states, F.col("s_nationkey") == F.col("n_nationkey"))
    files = rows.select("root", F.concat("root", F.lit("/s"), (key % 3).cast("string"), F.lit("/"), key.cast("string")).alias("path"))
    return gates.files_under(folders, states, files)


@query("""with q as (select c_nationkey as scope, trim(case when c_nationkey % 3 = 0 and c_acctbal < 0 then 'x1' else ' ' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end) as code from customer where c_nationkey % 4 <> 1),
k as (select scope from q group by 1 having bool_and(regexp_full_match(code, '[0-9]{4}')))
select scope, code from q where scope in (select scope from k) union select s_nationkey, lpad(cast(s_suppkey % 10000 as varchar), 4, '0') from supplier where s_nationkey not in (select scope from k)""")
def replaced_codes(t: Tables) -> DataFrame:
    """Scopes that ask for nothing (every fourth nation) or for a code that does not fit keep what they have."""
    four = lambda c: F.lpad((F.col(c) % 10000).cast("string"), 4, "0")
    current = t.supplier.select(F.col("s_nationkey").alias("scope"), four("s_suppkey").alias("code"))
    asked = t.customer.withColumn("code", F.when((F.col("c_nationkey") % 3 == 0) & (F.col("c_acctbal") < 0), "x1").otherwise(F.concat(F.lit(" "), four("c_custkey"))))
    return gates.replace_codes(current, asked.where("c_nationkey % 4 <> 1").withColumnRenamed("c_nationkey", "scope"), "scope", "code")


@query("""with d as (select lang, doc_id, row_number() over (partition by lang order by doc_id) as n, count(*) over (partition by lang) as total from documents where lang is not null)
select lang, cast((n + 49) // 50 as int) as page, doc_id, cast(null as varchar) as error from d where lang <> 'fr' or n <= 100
union all select lang, 3, null, 'TimeoutError' from d where lang = 'fr' and total > 100 group by 1""")
def keyword_listings(t: Tables) -> DataFrame:
    """Each language's stored documents in pages of fifty; French fails on the third page, which stops no other."""

    def fetch(keyword: str, page: int, body: str | None) -> dict:
        if keyword == "fr" and page == 3:
            raise TimeoutError
        return json.loads(body)

    w = Window.partitionBy("lang")
    placed = t.documents.where("lang is not null").select("lang", "doc_id", F.ceil(F.row_number().over(w.orderBy("doc_id")) / 50).cast("int").alias("page"))
    totals = placed.groupBy("lang").agg(F.count("*").alias("total"))
    items = F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: F.struct(i.alias("doc_id")))
    pages = placed.groupBy("lang", "page").agg(items.alias("items")).join(totals, "lang")
    body = F.to_json(F.struct("items", F.col("total").alias("totalCount")))
    found = fetch_listings(t.documents, "lang", fetch, 50, most_pages=2**31 - 1, stored=pages.select("lang", "page", body.alias("body")))
    return found.select("lang", "page", F.get_json_object("item", "$.doc_id").cast("bigint").alias("doc_id"), "error")


#: List name: words of its lines, words that speak against, headings of its sections.
_LISTS = {
    "documents": {"headings": ["The"]}, "qualifications": {"words": ["license", "rights"], "unless": ["version"]}, "methods": {"words": ["version"]},
    "deadlines": {"words": ["2024", "2023"]}, "joint": {"words": ["together"], "headings": ["Of"]}, "evidence": {"words": ["released"]}}


def _list_sql(name: str) -> str:
    spec = _LISTS[name]
    any_of = lambda words: "(" + (" or ".join(f"contains(lower(line), '{w.lower()}')" for w in words) or "false") + ")"
    return f"mark is null and (({any_of(spec.get('words', []))} and not {any_of(spec.get('unless', []))}) or coalesce(sect = '{name}', false))"


@query(f"""with {_LINES}, m as (select *, case when starts_with(lower(line), 'the') then 'documents' when starts_with(lower(line), 'of') then 'joint' end as mark from l),
s as (select *, last_value(mark ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as sect, regexp_replace(lower(line), '[^0-9a-z가-힣]', '', 'g') as norm from m),
e as ({" union all ".join(f"select doc_id, '{n}' as name, norm, pos, line from s where {_list_sql(n)}" for n in _LISTS)}),
u as (select doc_id, name, pos, line from e qualify row_number() over (partition by doc_id, name, norm order by pos) = 1), a as (select distinct doc_id from l)
select a.doc_id, {", ".join(f"coalesce(string_agg(line, chr(10) order by pos) filter (where name = '{n}'), '') as {n}" for n in _LISTS)} from a left join u on u.doc_id = a.doc_id group by 1""")
def document_lists(t: Tables) -> DataFrame:
    found = lines.line_lists(lines.to_lines(t.documents, "doc_id", "text"), "doc_id", _LISTS)
    return found.select("doc_id", *[F.array_join(n, "\n").alias(n) for n in _LISTS])
