"""Queries of dictionaries, selectors, crawls, budgets, details, nested JSON and windows collected as a stream."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.presets import PASTED_HEADERS
from noticeflow.functions.pyudf import person_name, split_items
from noticeflow.operators import crawl, dictionary
from noticeflow.plans.registry import Tables, query
from noticeflow.sources import paged, pasted, selectors
from noticeflow.streaming import windows


_LINES = 250_000


@query("""with n as (select p_name as name, lpad(cast(min(p_partkey) % 10000 as varchar), 4, '0') as code from part group by 1),
x as (select l_orderkey, string_agg(case when l_linenumber = 1 then lpad(cast(l_suppkey % 10000 as varchar), 4, '0') || ', ' else '' end || replace(p_name, ' ', '  '), ' / ' order by l_linenumber) as text from lineitem join part on p_partkey = l_partkey group by 1),
c as (select l_orderkey, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: length(d) = 4)) as code from x
union select l_orderkey, code from x, n where contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(name, '\\s+', '', 'g'))),
o as (select code, min(name) as official_name from n group by 1)
select l_orderkey, c.code, coalesce(official_name, '') as official_name from c left join o using (code)""")
def named_codes(t: Tables) -> DataFrame:
    """Codes that an order's text names, by four digits or by a part's name."""
    four = lambda c: F.lpad((F.col(c) % 10000).cast("string"), 4, "0")
    verified = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k")).select("name", four("k").alias("code"))
    said = F.concat(F.when(F.col("l_linenumber") == 1, F.concat(four("l_suppkey"), F.lit(", "))).otherwise(""), F.replace("p_name", F.lit(" "), F.lit("  ")))
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", said.alias("said"))
    # About ``_LINES`` lines a task, whatever the table's size: a task's sort needs no more memory as the table grows.
    lines = lines.repartition(max(8, -(-t.lineitem.count() // _LINES)), "l_orderkey")
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "said"))), lambda x: x["said"]), " / ").alias("text"))
    return dictionary.license_codes(texts, "l_orderkey", "text", verified, unique=True)


_PLAIN = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"""with i as (select page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>')) as item, generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">[^<]*</a></li>'), 1) as pos from pages),
v as (select page_id, pos, {_PLAIN("regexp_extract(item, 'href=\"([^\"]*)\"', 1)")} as id, nullif({_PLAIN("regexp_extract(item, '>([^<]*)</a>', 1)")}, '') as label from i)
select page_id, id, label from v where id <> '' qualify row_number() over (partition by page_id, id order by pos) = 1""")
def selected_links(t: Tables) -> DataFrame:
    """The rows of each page's navigation, by selectors: the address is the identifier."""
    rows = selectors.selected_rows("nav li a[href]@href", {"label": "a::text"}, ("li",))
    return t.pages.select("page_id", F.explode(rows(F.col("html"))).alias("r")).select("page_id", F.col("r.id").alias("id"), F.col("r.label").alias("label"))


_DEPTH, _FOLDERS, _FILES = 2, 40, 60
_WALK = f"""with recursive a as (select page_id, url, list_filter(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), 'href="/([A-Za-z]+)"', 1), lambda x: true) as h from pages),
l as (select page_id, url, unnest(h) as h, generate_subscripts(h, 1) as pos from a),
e as (select distinct '/' || a.h as parent, '/' || a.h || '/' || b.h as path, true as directory from l a join l b on a.page_id = b.page_id and b.pos = a.pos + 1
union select distinct '/' || a.h || '/' || b.h, '/' || b.h, true from l a join l b on a.page_id = b.page_id and b.pos = a.pos + 1 union select distinct '/' || h, 'page/' || page_id, false from l where pos = 1),
r as (select distinct '/' || h as root from l where pos = 1),
w(root, path, directory, depth) as (select root, root, true, 0 from r union select w.root, e.path, e.directory, w.depth + 1 from w join e on e.parent = w.path where w.directory and w.depth <= {_DEPTH}),
f as (select root, path, bool_or(directory) as directory, min(depth) as depth from w group by 1, 2),
c as (select root, d, count(*) filter (directory and depth <= d and depth <= {_DEPTH}) as folders, count(*) filter (not directory and depth <= d) as files from f, (select unnest(range({_DEPTH + 2})) as d) group by 1, 2),
x as (select root, min(d) as d from c where folders > {_FOLDERS} or files > {_FILES} group by 1),
s as (select c.root, c.folders, c.files, case when c.folders > {_FOLDERS} then 'FOLDERS' when c.files > {_FILES} then 'FILES' when exists (select 1 from f where f.root = c.root and directory and depth > {_DEPTH}) then 'DEPTH' else 'SUCCESS' end as status
from c left join x on x.root = c.root where c.d = coalesce(x.d, {_DEPTH + 1}))"""


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Words of a page's navigation as folders: a word holds the pairs it begins, a pair its second word; a page is a
    file of its first word."""
    nav = F.regexp_extract("html", "(?s)<nav>(.*?)</nav>", 1)
    words = t.pages.select("page_id", F.posexplode(F.regexp_extract_all(nav, F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("pos", "h"))
    after = words.select("page_id", (F.col("pos") - 1).alias("pos"), F.col("h").alias("b"))
    pairs = words.join(after, ["page_id", "pos"]).select(F.concat(F.lit("/"), "h").alias("a"), F.concat(F.lit("/"), "h", F.lit("/"), "b").alias("ab"), F.concat(F.lit("/"), "b").alias("b"))
    row = lambda p, c, d: [F.col(p).alias("parent"), F.col(c).alias("path"), F.lit(d).alias("directory")]
    first = words.where("pos = 0").select(F.concat(F.lit("/"), "h").alias("h"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"))
    edges = pairs.select(*row("a", "ab", True)).unionByName(pairs.select(*row("ab", "b", True))).unionByName(first.select(*row("h", "file", False))).distinct()
    return first.select(F.col("h").alias("root")).distinct(), edges


@query(_WALK + " select root, status, folders, files from s")
def crawl_states(t: Tables) -> DataFrame:
    return crawl.bounded_crawl(*_tree(t), _DEPTH, _FOLDERS, _FILES)[1]


@query(_WALK + " select f.root, f.path, f.directory, f.depth from f join s on s.root = f.root where s.status = 'SUCCESS'")
def crawled_tree(t: Tables) -> DataFrame:
    return crawl.bounded_crawl(*_tree(t), _DEPTH, _FOLDERS, _FILES)[0]


@query("""with l as (select c_mktsegment, c_nationkey, cast(ceil(count(*) / 5.0) as bigint) as pages from customer group by 1, 2),
p as (select *, coalesce(sum(pages) over (order by c_mktsegment, c_nationkey rows between unbounded preceding and 1 preceding), 0) as before from l)
select c_mktsegment, c_nationkey, cast(unnest(range(1, 1 + cast(least(pages, 200 - before) as bigint))) as int) as page from p where before < 200""")
def dealt_requests(t: Tables) -> DataFrame:
    """The first two hundred requests for pages of five customers, by segment and nation."""
    listings = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.ceil(F.count("*") / 5.0).alias("pages"))
    return crawl.deal_budget(listings, "c_mktsegment", [F.col("c_nationkey")], "pages", 200).select("c_mktsegment", "c_nationkey", "page")


@query("""select c_custkey, case when c_acctbal < 0 and c_nationkey <> 7 then n_name end as nation, case when c_acctbal < 0 and c_nationkey = 7 then 'KeyError' end as error from customer left join nation on n_nationkey = c_nationkey""")
def fetched_details(t: Tables) -> DataFrame:
    """Customers in debt get their nation from a second phase, of which one key fails."""
    store = f"{t.sf_dir}/nation.parquet"

    def fetch(key: str) -> dict:
        import pyarrow.dataset as ds

        held = dict(zip(*(ds.dataset(store).to_table(columns=["n_nationkey", "n_name"])[c].to_pylist() for c in ("n_nationkey", "n_name"))))
        held.pop(7, None)
        return {"name": held[int(key)]}

    found = paged.fetch_details(t.customer, "c_nationkey", F.col("c_acctbal") < 0, fetch, f"{windows.work_dir(t.spark, 'details')}/details", 4)
    return found.select("c_custkey", F.get_json_object("detail", "$.name").alias("nation"), F.col("detail_error").alias("error"))


@query("""with l as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as r, min(l_linenumber) filter (l_returnflag = 'R') as first from lineitem group by 1)
select l_orderkey, cast(greatest(n - r, r, 2) as int) as size, case when n - r >= r and n - r >= 2 then 'kept' when r >= 2 then 'returned' else 'x' end as kind from l""")
def largest_arrays(t: Tables) -> DataFrame:
    """The largest array anywhere in an order's JSON: its kept lines, its returned ones further down, or a pair of marks."""
    line = lambda flag, kind: F.collect_list(F.when(flag, F.struct(F.lit(kind).alias("kind"), "l_linenumber")))
    back = F.col("l_returnflag") == "R"
    nested = t.lineitem.groupBy("l_orderkey").agg(line(~back, "kept").alias("kept"), line(back, "returned").alias("returned"))
    mark = F.struct(F.lit("x").alias("kind"))
    text = F.to_json(F.struct(F.struct(F.col("kept").alias("items"), F.struct(F.struct(F.col("returned").alias("rows")).alias("inner")).alias("more")).alias("body"), F.array(mark, mark).alias("tail")))
    found = nested.select("l_orderkey", paged.largest_array(text).alias("a"))
    return found.select("l_orderkey", F.size("a").alias("size"), F.get_json_object(F.get("a", F.lit(0)), "$.kind").alias("kind"))


@query("""with g as (select p_partkey, list_filter([nullif(trim(case when p_size % 2 = 0 then p_name else ' ' end), ''), nullif(trim(p_brand), '')], lambda x: x is not null) as g1, list_filter([nullif(trim(case when p_size % 3 = 0 then p_type end), '')], lambda x: x is not null) as g2 from part)
select p_partkey, case when len(g1) > 0 then '1:' || array_to_string(list_transform(g1, lambda x, i: i || '=' || x), ',') else '' end || case when len(g2) > 0 then ';10:1=' || g2[1] else '' end as groups,
case p_partkey % 3 when 0 then '2,10,b' when 1 then '9,11,a' else '1,x,y' end as ordered from g""")
def license_groups(t: Tables) -> DataFrame:
    """Numbered columns as groups of requirements, and texts in the order of the numbers they are."""
    size, k = F.col("p_size"), F.col("p_partkey")
    wide = t.part.select(
        "p_partkey", F.when(size % 3 == 0, F.col("p_type")).alias("req10Reqlic1Nm"), F.when(size % 2 == 0, F.col("p_name")).otherwise(" ").alias("req1Reqlic1Nm"), F.col("p_brand").alias("req1Reqlic2Nm"),
        F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("10"), F.lit("2"))).when(k % 3 == 1, F.array(F.lit("11"), F.lit("a"), F.lit("9"))).otherwise(F.array(F.lit("y"), F.lit("x"), F.lit("1"))).alias("marks"))
    grouped = paged.nested_groups(wide, r"req(\d+)Reqlic(\d+)Nm")
    told = F.transform("groups", lambda g: F.concat(g["group"], F.lit(":"), F.array_join(F.transform(g["requirements"], lambda r: F.concat(r["seq"].cast("string"), F.lit("="), r["name"])), ",")))
    ordered = paged.numeric_order(F.transform("marks", lambda m: F.struct(m.alias("no"))), "no")
    return grouped.select("p_partkey", F.array_join(told, ";").alias("groups"), F.array_join(F.transform(ordered, lambda x: x["no"]), ",").alias("ordered"))


@query("""with r as (select p_size, p_partkey, p_name || ' ' || p_partkey as name, row_number() over (partition by p_size order by p_partkey) + case when p_size % 3 = 0 then 1 else 0 end as row from part)
select p_size, cast(r.row as int) as row, case when p_partkey % 11 = 0 then name else name || '|' || p_brand || '|' || case when p_size % 3 = 1 and p_partkey % 2 = 0 then '2023' else '2024.01 ~ 2025.12' end || '|' || p_partkey % 100 end as fields,
case when p_partkey % 11 = 0 then 'CELLS' end as reason from r join part using (p_size, p_partkey)""")
def pasted_tables(t: Tables) -> DataFrame:
    """A pasted table for each size: with headers in another order, with four cells, with five; short rows are rejected."""
    size, k, name = F.col("p_size"), F.col("p_partkey"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    period, amount = F.when((size % 3 == 1) & (k % 2 == 0), "2023").otherwise("2024.01 ~ 2025.12"), (k % 100).cast("string")
    cells = F.when(k % 11 == 0, name).when(size % 3 == 0, F.concat_ws("\t", amount, "p_brand", name, period)).when(size % 3 == 1, F.concat_ws("\t", name, "p_brand", period, amount)).otherwise(F.concat_ws("\t", k.cast("string"), name, period, amount, "p_brand"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", cells.alias("line")))), lambda x: x["line"])
    texts = t.part.groupBy("p_size").agg(lines.alias("l")).select("p_size", F.concat(F.when(size % 3 == 0, "계약 금액\t발주처\t사업명\t사업기간\n").otherwise(""), F.array_join("l", "\n")).alias("text"))
    placed = pasted.placed_cells(texts.select("p_size", F.explode(pasted.pasted_rows("text")).alias("r")).select("p_size", "r.*"), "p_size", PASTED_HEADERS)
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("cells") != 4, "CELLS")
    return placed.select("p_size", "row", F.array_join("cells", "|").alias("fields"), reason.alias("reason"))


@query("""select c_custkey, case when c_custkey % 35 = 0 then '최영희' when c_custkey % 5 = 0 or c_custkey % 7 = 0 then null else case c_custkey % 3 when 0 then '김' when 1 then '이' else '박' end || case when c_custkey % 2 = 0 then '민수' else '지현' end end as person,
case when c_custkey % 2 = 0 then '홍보물|사본 1부|원본(사본 포함) 2부' else '사본 ' || c_custkey || '부' end as items from customer""")
def file_people(t: Tables) -> DataFrame:
    """The one person that a file's name names, and a merged list line in its items."""
    k = F.col("c_custkey")
    person = F.concat(F.when(k % 7 == 0, "쿱").when(k % 3 == 0, "김").when(k % 3 == 1, "이").otherwise("박"), F.when(k % 2 == 0, "민수").otherwise("지현"))
    name = F.concat(F.lit("경력증명서_"), person, F.when(k % 5 == 0, "_최영희").otherwise(""), F.lit("(2024).pdf"))
    line = F.when(k % 2 == 0, "· 홍보물 · 사본 1부 원본(사본 포함) 2부").otherwise(F.concat(F.lit(" 사본 "), k.cast("string"), F.lit("부 ·")))
    found = t.customer.select("c_custkey", person_name(["경력증명서"], ["김", "이", "박", "최"])(name).alias("person"), split_items("·", ["사본", "원본"])(line).alias("items"))
    return found.select("c_custkey", "person", F.array_join("items", "|").alias("items"))


@query("""with d as (select min(cast(ts as date)) as first, max(cast(ts as date)) as last from events)
select event_type as operation, cast(ts as date) as day, event_id, cast(null as varchar) as error from events where not (event_type = 'error' and cast(ts as date) = (select first from d))
union all select 'error', first, null, 'TimeoutError' from d""")
def collected_windows(t: Tables) -> DataFrame:
    """Events fetched in windows of a type and a day, as a stream whose cursor follows the sink; one window fails."""
    span = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("z"), F.sort_array(F.collect_set("event_type")).alias("types")).first()
    store, first = f"{t.sf_dir}/events.parquet", span["a"]

    def fetch(operation: str, day: datetime.date) -> list:
        import pyarrow.dataset as ds

        if (operation, day) == ("error", first):
            raise TimeoutError
        start = datetime.datetime.combine(day, datetime.time())
        kept = (ds.field("event_type") == operation) & (ds.field("ts") >= start) & (ds.field("ts") < start + datetime.timedelta(days=1))
        return [{"event_id": i} for i in ds.dataset(store).to_table(columns=["event_id"], filter=kept)["event_id"].to_pylist()]

    root = windows.work_dir(t.spark, "windows")
    name = "noticeflow_windows_" + root[-16:].replace("-", "_").replace("/", "_")
    t.spark.dataSource.register(windows.window_source(name, span["types"], first, span["z"], fetch, f"{root}/cursor.json", 1000))
    running = windows.collect_windows(t.spark.readStream.format(name).load(), f"{root}/table", f"{root}/checkpoint")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    found = t.spark.read.schema("item string, error string, operation string, day date").parquet(f"{root}/table")
    return found.select("operation", "day", F.get_json_object("item", "$.event_id").cast("bigint").alias("event_id"), "error")
