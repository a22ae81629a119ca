"""Listings, existence joins, roll-ups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import contains_all, contains_any, rounded_percent
from noticeflow.operators import incremental, listing, rollup
from noticeflow.operators.changes import cascade, soft_delete
from noticeflow.plans.registry import Tables, query

_VISIBLE = "coalesce(upper(trim(o_orderstatus)), '') not in ('F', '제외') and o_orderdate >= date '1996-01-01' and o_orderdate < date '1999-01-01'"


def _visible(t: Tables) -> DataFrame:
    return t.orders.where(listing.not_excluded(F.col("o_orderstatus"), ["F", "제외"]) & listing.in_days(F.col("o_orderdate"), "1996-01-01", "1998-12-31"))


@query(f"""select o_orderkey, o_custkey, o_orderstatus, o_orderdate from orders where {_VISIBLE}
order by o_orderdate desc nulls last, o_orderkey desc limit 20 offset 40""")
def notice_page(t: Tables) -> DataFrame:
    rows = _visible(t).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return listing.page(rows, [F.col("o_orderdate").desc_nulls_last(), F.desc("o_orderkey")], 2, 20)


@query(f"select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from orders where {_VISIBLE}")
def notice_page_total(t: Tables) -> DataFrame:
    return listing.totals(_visible(t), 20)


@query("""select o_orderkey, o_orderdate, o_totalprice from orders where exists
(select 1 from lineitem where l_orderkey = o_orderkey and l_suppkey in (1, 2, 3))""")
def run_scoped_notices(t: Tables) -> DataFrame:
    runs = t.lineitem.where(F.col("l_suppkey").isin(1, 2, 3)).select("l_orderkey")
    return listing.with_child(t.orders, runs, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""select o_orderkey, o_orderdate from orders where exists
(select 1 from lineitem where l_orderkey = o_orderkey and l_suppkey in (1, 2, 3)) order by o_orderdate desc nulls last, o_orderkey desc limit 25""")
def run_scoped_page(t: Tables) -> DataFrame:
    return listing.page(run_scoped_notices(t).select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc_nulls_last(), F.desc("o_orderkey")], 0, 25)


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def parents_without_child(t: Tables) -> DataFrame:
    return listing.without_child(t.customer, t.orders, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name")


@query("""select o_custkey, count(*) filter (l_returnflag = 'R') as needed,
count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as prepared from orders join lineitem on l_orderkey = o_orderkey group by o_custkey""")
def needed_prepared_counts(t: Tables) -> DataFrame:
    needed = F.col("l_returnflag") == "R"
    joined = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(F.count_if(needed).alias("needed"), F.count_if(needed & (F.col("l_linestatus") == "F")).alias("prepared"))


@query("""with firsts as (select * from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) = 1)
select p_partkey, l_orderkey, s_name from part left join firsts on l_partkey = p_partkey and l_returnflag = 'R' left join supplier on s_suppkey = l_suppkey""")
def master_current_file(t: Tables) -> DataFrame:
    firsts = listing.first_wins(t.lineitem, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])
    files = t.part.join(firsts, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_returnflag") == "R"), "left")
    return files.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("p_partkey", "l_orderkey", "s_name")


@query("""with o as (select o_custkey, o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as done from orders),
c as (select c_custkey, count(o_orderkey) as total, count(o_orderkey) filter (not done) as missing from customer left join o on o_custkey = c_custkey group by c_custkey)
select c_custkey, total, missing, case when total = 0 then 'DRAFT' when missing = 0 then 'READY' else 'COLLECTING' end as status from c""")
def project_status(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(True))
    entries = t.orders.join(done, "o_orderkey", "left").withColumnRenamed("o_custkey", "c_custkey")
    counted = rollup.child_counts(t.customer.select("c_custkey"), "c_custkey", {"total": (entries, F.lit(True)), "missing": (entries, F.col("done").isNull())})
    return counted.withColumn("status", rollup.readiness(F.col("total"), F.col("missing")))


@query("""with a as (select o_custkey k, count(*) n, count(*) filter (o_orderstatus = 'F') f from orders group by 1),
b as (select o_custkey k, count(*) n, count(*) filter (l_returnflag = 'R') f from lineitem join orders on o_orderkey = l_orderkey group by 1),
e as (select user_id k, count(*) n, count(*) filter (event_type = 'error') f from events group by 1)
select c_custkey, coalesce(a.n, 0) as notices, coalesce(a.f, 0) as closed, coalesce(b.n, 0) as documents, coalesce(b.f, 0) as returned,
coalesce(e.n, 0) as messages, coalesce(e.f, 0) as errors,
case when coalesce(b.n, 0) = 0 then cast(0 as bigint) else cast(floor(100.0 * coalesce(b.f, 0) / b.n + 0.5) as bigint) end as percent
from customer left join a on a.k = c_custkey left join b on b.k = c_custkey left join e on e.k = c_custkey""")
def readiness_rollup(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    documents = t.lineitem.join(orders.select("o_orderkey", "c_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    messages = t.events.withColumnRenamed("user_id", "c_custkey")
    counted = rollup.child_counts(t.customer.select("c_custkey"), "c_custkey", {
        "notices": (orders, F.lit(True)), "closed": (orders, F.col("o_orderstatus") == "F"), "documents": (documents, F.lit(True)),
        "returned": (documents, F.col("l_returnflag") == "R"), "messages": (messages, F.lit(True)), "errors": (messages, F.col("event_type") == "error")})
    return counted.withColumn("percent", rounded_percent(F.col("returned"), F.col("documents")))


@query("""with g as (select o_orderpriority as category, count(*) as total, count(*) filter (o_orderstatus = 'F') as prepared from orders group by 1)
select * from g union all select 'TOTAL', cast(sum(total) as bigint), cast(sum(prepared) as bigint) from g""")
def category_summary(t: Tables) -> DataFrame:
    return rollup.with_grand_total(t.orders.withColumnRenamed("o_orderpriority", "category"), "category", {"total": F.count("*"), "prepared": F.count_if(F.col("o_orderstatus") == "F")})


@query("""select count(*) as total, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderpriority = '1-URGENT') as urgent,
round(sum(o_totalprice), 2) as amount, max(o_orderdate) as last_seen from orders""")
def dashboard_kpis(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.sum("o_totalprice"), 2).alias("amount"), F.max("o_orderdate").alias("last_seen"))


@query("""select c_mktsegment, o_orderkey, o_orderdate, row_number() over (partition by c_mktsegment order by o_orderdate desc, o_orderkey desc) as place
from orders join customer on c_custkey = o_custkey qualify place <= 3""")
def recent_top3(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("c_mktsegment", "o_orderkey", "o_orderdate")
    return rollup.top_per_group(rows, ["c_mktsegment"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).withColumn("place", F.col("place").cast("bigint"))


@query("""with s as (select s_nationkey, count(*) as suppliers, max(s_acctbal) as best from supplier group by 1)
select coalesce(n_nationkey, s_nationkey) as code, n_name, coalesce(suppliers, 0) as suppliers, best, n_nationkey is not null as fixed, s_nationkey is not null as registered
from nation full join s on s_nationkey = n_nationkey""")
def source_catalog(t: Tables) -> DataFrame:
    registered = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.max("s_acctbal").alias("best"))
    both = t.nation.join(registered, F.col("s_nationkey") == F.col("n_nationkey"), "full_outer")
    return both.select(F.coalesce("n_nationkey", "s_nationkey").alias("code"), "n_name", F.coalesce("suppliers", F.lit(0)).cast("bigint").alias("suppliers"), "best", F.col("n_nationkey").isNotNull().alias("fixed"), F.col("s_nationkey").isNotNull().alias("registered"))


@query("""select s_suppkey, s_nationkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 0)
and s_nationkey in (select s_nationkey from supplier group by 1 having count(*) = 1)""")
def dynamic_sources(t: Tables) -> DataFrame:
    fixed = t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    return listing.unique_codes(t.supplier, "s_nationkey", fixed).select("s_suppkey", "s_nationkey")


@query("select * from orders where o_orderkey > 1000 order by o_orderkey limit 200")
def keyset_page(t: Tables) -> DataFrame:
    return listing.keyset_page(t.orders, "o_orderkey", 1000, 200)


@query("""select p_partkey, p_name from part where contains(lower(p_name), 'green') or contains(lower(p_name), 'blue') or contains(lower(p_type), 'steel') or contains(lower(p_name), '1')""")
def like_any(t: Tables) -> DataFrame:
    return t.part.where(contains_any(F.col("p_name"), ["Green", "blue", "1"]) | contains_any(F.col("p_type"), ["STEEL"])).select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'e') and contains(lower(p_name), 'r')")
def like_all(t: Tables) -> DataFrame:
    return t.part.where(contains_all(F.col("p_name"), ["E", "r"])).select("p_partkey", "p_name")


@query("select p_partkey from part where p_name not like 'part_1%'")
def not_like_wildcard(t: Tables) -> DataFrame:
    return t.part.where(~F.col("p_name").like("part_1%")).select("p_partkey")


@query("""select event_id, user_id, try_cast(json_extract_string(props, '$.k') as int) as k from events where try_cast(json_extract_string(props, '$.k') as int) in (1, 2, 3)""")
def json_code_filter(t: Tables) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return t.events.select("event_id", "user_id", k.alias("k")).where(F.col("k").isin(1, 2, 3))


@query("""with f as (select l_orderkey, list_sort(list(distinct l_linestatus)) as codes from lineitem group by 1)
select l_orderkey, array_to_string(codes, ',') as codes from f where list_has_any(codes, ['F', 'X'])""")
def code_overlap(t: Tables) -> DataFrame:
    codes = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linestatus")).alias("codes"))
    return codes.where(listing.code_overlap(F.col("codes"), ["F", "X"])).select("l_orderkey", F.array_join("codes", ",").alias("codes"))


@query("""select l_partkey, l_suppkey, l_orderkey, l_linenumber, max(l_shipdate) over (partition by l_partkey, l_suppkey) as latest_at,
l_shipdate = max(l_shipdate) over (partition by l_partkey, l_suppkey) as is_latest from lineitem""")
def latest_flag(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return rollup.with_latest_flag(rows, ["l_partkey", "l_suppkey"], "l_shipdate").drop("l_shipdate")


@query("select c_nationkey, case when count(distinct c_mktsegment) = 1 then max(c_mktsegment) else '' end as segment, count(*) as n from customer group by 1")
def unique_department(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(rollup.value_if_unique("c_mktsegment").alias("segment"), F.count("*").alias("n"))


@query("""select o_orderpriority, o_orderkey, case when o_orderpriority = '2-HIGH' then 0 else 1 end as class from orders
order by class, o_totalprice desc nulls last, o_orderkey limit 50""")
def preferred_first(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("class", F.when(F.col("o_orderpriority") == "2-HIGH", 0).otherwise(1))
    return rows.orderBy("class", F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(50).select("o_orderpriority", "o_orderkey", "class")


@query("""with p as (select page_id, regexp_replace(url, '^https?://[^/]*', '') as path from pages)
select page_id, starts_with(path, '/en/') as below, starts_with(path, '/fr/') as below_slash, true as below_root, path = '/de' or starts_with(path, '/de/') or starts_with('/de', rtrim(path, '/') || '/') as overlaps from p""")
def path_scope(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    return t.pages.select("page_id", listing.below_folder(path, "/en").alias("below"), listing.below_folder(path, "/fr/").alias("below_slash"), listing.below_folder(path, "/").alias("below_root"), listing.overlapping_roots(path, "/de").alias("overlaps"))


@query("""select event_type, cast(ts as date) as day, count(*) as n, count(*) filter (value is null) as without_value from events group by 1, 2""")
def change_kind_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("without_value"))


@query("select distinct o_orderpriority, o_orderstatus from orders")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority", "o_orderstatus").distinct()


@query("""select event_type, max_by(event_id, struct_pack(a := ts, b := event_id)) as last_event, max(ts) as last_at from events group by 1""")
def latest_run(t: Tables) -> DataFrame:
    return listing.last_wins(t.events.select("event_type", F.col("event_id").alias("last_event"), F.col("ts").alias("last_at")), ["event_type"], ["last_at", "last_event"])


@query(r"""with p as (select p_partkey, p_size % 5 as box, case when p_partkey % 7 = 0 then p_brand || ' (2).txt' when p_partkey % 7 = 1 then upper(p_brand) || '.txt' else p_brand || '.txt' end as name from part),
r as (select *, row_number() over (partition by box, lower(name) order by p_partkey) as n from p),
g as (select box, regexp_extract(lower(name), '^(.*) \(([0-9]+)\)\.txt$', 1) || '.txt' as base, list_sort(list(distinct cast(regexp_extract(lower(name), '^(.*) \(([0-9]+)\)\.txt$', 2) as bigint))) as given
from p where regexp_matches(lower(name), ' \([0-9]+\)\.txt$') group by 1, 2)
select p_partkey, case when n = 1 then name else name[:-5] || ' (' || list_reduce(list_prepend(n, coalesce(given, [])), lambda a, x: case when x <= a then a + 1 else a end) || ').txt' end as entry_name
from r left join g on g.box = r.box and g.base = lower(r.name)""")
def archive_names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat("p_brand", F.lit(" (2).txt"))).when(F.col("p_partkey") % 7 == 1, F.concat(F.upper("p_brand"), F.lit(".txt"))).otherwise(F.concat("p_brand", F.lit(".txt")))
    files = t.part.select("p_partkey", (F.col("p_size") % 5).alias("box"), name.alias("name"))
    return listing.collision_free_names(files, ["box"], "name", [F.col("p_partkey")]).select("p_partkey", "entry_name")


@query("""select o_orderkey, coalesce(case when o_orderstatus = 'F' then null else o_orderdate end, timestamp '1990-01-01') as shown from orders
order by coalesce(case when o_orderstatus = 'F' then null else o_orderdate end, timestamp '1990-01-01') desc nulls last, o_orderkey desc limit 50""")
def coalesced_sort_key(t: Tables) -> DataFrame:
    shown = F.coalesce(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")), F.lit("1990-01-01").cast("timestamp_ntz"))
    rows = t.orders.select("o_orderkey", shown.alias("shown"))
    return listing.page(rows, [F.col("shown").desc_nulls_last(), F.desc("o_orderkey")], 0, 50)


@query("""select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'""")
def optional_filters(t: Tables) -> DataFrame:
    return listing.optional_filters(t.orders, o_orderstatus="O", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("""select c_custkey from customer where contains(lower(coalesce(c_name, '')), '_1%') or contains(lower(coalesce(c_name, '')), '#00000001') or contains(lower(coalesce(c_mktsegment, '')), '#00000001')""")
def search_columns(t: Tables) -> DataFrame:
    from noticeflow.functions.text import search_columns as found

    columns = [F.col("c_name"), F.col("c_mktsegment")]
    return t.customer.where(found(columns, "_1%") | found(columns, "#00000001")).select("c_custkey")


@query("""select p.p_partkey, case when s_suppkey is not null then 'REFERENCE' when p.p_type = 'SMALL' then 'NAME' else 'NONE' end as level from part p left join supplier on s_suppkey = p_partkey
order by case when s_suppkey is not null then 0 when p.p_type = 'SMALL' then 1 else 2 end, p_retailprice desc nulls last, p_partkey limit 50""")
def match_level_order(t: Tables) -> DataFrame:
    matched = t.part.join(t.supplier.select("s_suppkey"), F.col("s_suppkey") == F.col("p_partkey"), "left")
    rank = F.when(F.col("s_suppkey").isNotNull(), 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    best = matched.withColumn("rank", rank).orderBy("rank", F.col("p_retailprice").desc_nulls_last(), "p_partkey").limit(50)
    return best.select("p_partkey", F.get(F.array(*map(F.lit, ("REFERENCE", "NAME", "NONE"))), F.col("rank")).alias("level"))


@query("select s_suppkey, s_name, s_acctbal >= 0 as active from supplier")
def soft_deleted(t: Tables) -> DataFrame:
    return soft_delete(t.supplier.withColumn("active", F.lit(True)), F.col("s_acctbal") < 0).select("s_suppkey", "s_name", "active")


@query("""select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')""")
def cascade_delete(t: Tables) -> DataFrame:
    left = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return cascade(t.lineitem, left, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""select r_name, n_name, count(s_suppkey) as suppliers from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey
where r_name <> 'AFRICA' and s_acctbal > 0 group by 1, 2""")
def executable_configs(t: Tables) -> DataFrame:
    ready = t.supplier.where("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ready.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("""with b as (select event_id, user_id % 25 as scope from events where event_type = 'error'), c as (select c_custkey, c_nationkey as scope from customer where c_mktsegment = 'BUILDING'),
d as (select event_id, user_id as c_custkey from events)
select event_id, c_custkey from b join c on b.scope = c.scope where not exists (select 1 from d where d.event_id = b.event_id and d.c_custkey = c.c_custkey)""")
def fanout_pending(t: Tables) -> DataFrame:
    pending = t.events.where("event_type = 'error'").select("event_id", (F.col("user_id") % 25).alias("scope"))
    subscribers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("scope"))
    delivered = t.events.select("event_id", F.col("user_id").alias("c_custkey"))
    return incremental.fan_out(pending, subscribers, delivered, "event_id", "c_custkey", ["scope"]).select("event_id", "c_custkey")


_FILE_NAME = "concat_ws(' ', case when p_size % 2 = 0 then p_brand end, p_name, p_type)"


@query(f"""with n as (select p_name, min(p_partkey) as entry_id, min(p_brand) as client from part group by 1),
e as (select entry_id, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) as wanted,
regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as whole, regexp_replace(lower(client), '[^a-z0-9]', '', 'g') as client from n),
f as (select p_partkey as file_id, p_brand || '/' || p_size as path, p_retailprice as modified, regexp_replace(lower({_FILE_NAME}), '[^a-z0-9]', '', 'g') as file from part),
h as (select entry_id, file_id, path, modified, len(list_filter(wanted, lambda x: contains(file, x))) as hits, len(wanted) as n, whole <> '' and contains(file, whole) as exact, client <> '' and contains(file, client) as cl
from e, f where contains(file, whole) or len(list_filter(wanted, lambda x: contains(file, x))) > 0),
s as (select entry_id, file_id, path, modified, round((case when exact then 1.0::double else hits::double / n end) * 0.8::double + (case when cl then 0.2::double else 0.0::double end), 6) as score from h
where exact or (n > 0 and hits >= least(2, n) and hits::double / n >= (case when cl then 0.5 else 0.75 end)))
select entry_id, file_id, path, modified, score, row_number() over (partition by entry_id order by score desc, modified desc nulls last, path, file_id) as place from s qualify place <= 30""")
def candidate_rank(t: Tables) -> DataFrame:
    entries = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entry_id"), F.min("p_brand").alias("client"))
    files = t.part.select(F.col("p_partkey").alias("file_id"), F.expr(_FILE_NAME).alias("file_name"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("path"), F.col("p_retailprice").alias("modified"))
    return rollup.rank_candidates(entries, files).withColumn("place", F.col("place").cast("bigint"))


@query("""select p_size, p_partkey, p_type from (select *, min(r) over (partition by p_size) as b from (select *, case when p_type like '%STANDARD%' then 1 when p_type like '%LARGE%' then 2 end as r from part)) where r = b""")
def best_kind(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_type").contains("STANDARD"), "STANDARD").when(F.col("p_type").contains("LARGE"), "LARGE")
    return rollup.best_kind(t.part.withColumn("kind", kind), ["p_size"], "kind", ["STANDARD", "LARGE"]).select("p_size", "p_partkey", "p_type")
