"""Change detection, versions, incremental state and the outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.dates import month_chunks
from noticeflow.functions.hashing import content_hash, fingerprint
from noticeflow.functions.text import item_key
from noticeflow.operators import changes, constraints, incremental, listing
from noticeflow.plans.registry import Tables, query

_PREV = "select doc_id, source, text as body, date '2024-01-01' as first_seen, date '2024-01-05' as last_seen from documents where doc_id % 7 <> 0"
_CUR = "select doc_id, source, case when doc_id % 3 = 0 then text || ' (new)' else text end as body, date '2024-01-03' as first_seen, date '2024-01-04' as last_seen from documents where not (doc_id % 5 = 0 and doc_id % 7 <> 0)"
_HASH = "sha256(length(source) || ':' || source || length(body) || ':' || body) as digest"
_BOTH = f"with p as (select *, {_HASH} from ({_PREV})), c as (select *, {_HASH} from ({_CUR}))"
_CHANGE = "case when p.doc_id is null then 'NEW' when c.doc_id is null then 'MISSING' when p.digest = c.digest then 'UNCHANGED' else 'UPDATED' end"


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    def dated(df: DataFrame, first: str, last: str) -> DataFrame:
        stamped = df.withColumns({"first_seen": F.lit(first).cast("date"), "last_seen": F.lit(last).cast("date")})
        return stamped.withColumn("digest", fingerprint([F.col("source"), F.col("body")]))

    docs = t.documents.select("doc_id", "source", F.col("text").alias("body"))
    changed = docs.where("not (doc_id % 5 = 0 and doc_id % 7 <> 0)").withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.concat("body", F.lit(" (new)"))).otherwise(F.col("body")))
    return dated(docs.where("doc_id % 7 <> 0"), "2024-01-01", "2024-01-05"), dated(changed, "2024-01-03", "2024-01-04")


@query(f"{_BOTH} select coalesce(p.doc_id, c.doc_id) as doc_id, {_CHANGE} as change from p full join c on p.doc_id = c.doc_id")
def change_detect(t: Tables) -> DataFrame:
    previous, incoming = _snapshots(t)
    return changes.detect_changes(previous, incoming, ["doc_id"], "digest")


@query(f"{_BOTH} select coalesce(c.source, p.source) as source, {_CHANGE} as change, count(*) as n from p full join c on p.doc_id = c.doc_id group by 1, 2")
def change_counts(t: Tables) -> DataFrame:
    previous, incoming = _snapshots(t)
    found = changes.detect_changes(previous, incoming, ["doc_id"], "digest")
    return found.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source", "change").agg(F.count("*").alias("n"))


@query(f"{_BOTH} select p.doc_id, p.digest from p join c on p.doc_id = c.doc_id where p.digest <> c.digest and p.doc_id % 2 = 0")
def version_archive(t: Tables) -> DataFrame:
    previous, incoming = _snapshots(t)
    archived = previous.where("doc_id % 2 = 1").select("doc_id", "digest")
    return changes.archive_versions(previous, incoming, archived, ["doc_id"], "digest").select("doc_id", "digest")


@query(f"""{_BOTH} select coalesce(p.doc_id, c.doc_id) as doc_id, coalesce(c.digest, p.digest) as digest, coalesce(p.first_seen, c.first_seen) as first_seen,
greatest(p.last_seen, c.last_seen) as last_seen from p full join c on p.doc_id = c.doc_id""")
def current_after_merge(t: Tables) -> DataFrame:
    previous, incoming = _snapshots(t)
    return changes.merge_current(previous, incoming, ["doc_id"], "digest", "first_seen", "last_seen").select("doc_id", "digest", "first_seen", "last_seen")


@query("""select distinct event_type, user_id, sha256(coalesce(props, '')) as digest from events e where not exists
(select 1 from events x where x.event_id % 4 = 0 and x.event_type = e.event_type and x.user_id = e.user_id and sha256(coalesce(x.props, '')) = sha256(coalesce(e.props, '')))""")
def insert_if_absent(t: Tables) -> DataFrame:
    keyed = t.events.select("event_id", "event_type", "user_id", F.sha2(F.coalesce("props", F.lit("")), 256).alias("digest"))
    keys = ["event_type", "user_id", "digest"]
    return changes.insert_if_absent(keyed.select(*keys), keyed.where("event_id % 4 = 0"), keys)


@query("""select s_suppkey, s_name, s_acctbal from supplier where s_suppkey % 3 <> 0 union all select s_suppkey, s_name || '*', s_acctbal + 1 from supplier where s_suppkey % 3 = 0""")
def upsert_rows(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    incoming = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return changes.upsert(rows, incoming, ["s_suppkey"])


@query("""select c_custkey, c_nationkey, c_mktsegment from customer where c_nationkey not in (select c_nationkey from customer where c_nationkey = 3 and c_custkey % 2 = 0) union all select c_custkey, c_nationkey, 'NEW' from customer where c_nationkey = 3 and c_custkey % 2 = 0""")
def replaced_scopes(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return changes.replace_scopes(rows, rows.where("c_nationkey = 3 and c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_nationkey"])


@query("""with h as (select p_partkey from part where p_partkey % 2 = 0), w as (select p_partkey from part where p_partkey % 3 = 0 or p_partkey % 2 = 1)
select coalesce(h.p_partkey, w.p_partkey) as p_partkey, case when h.p_partkey is null then 'INSERT' when w.p_partkey is null then 'DELETE' else 'KEEP' end as action from h full join w on h.p_partkey = w.p_partkey""")
def set_sync_actions(t: Tables) -> DataFrame:
    return changes.sync_actions(t.part.where("p_partkey % 2 = 0"), t.part.where("p_partkey % 3 = 0 or p_partkey % 2 = 1"), ["p_partkey"])


@query("""select o_orderkey, o_orderstatus, case when o_orderkey % 2 = 0 then cast(2 as int) else cast(1 as int) end as version,
case when o_orderkey % 2 = 0 then 'DONE' else 'OPEN' end as state from orders""")
def compare_and_set(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"), F.lit("OPEN").alias("state"))
    return changes.compare_and_set(rows, "version", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(7), {"state": F.lit("DONE")})


@query("""select doc_id, source from documents qualify row_number() over (partition by lower(regexp_replace(text, '\\s+', '', 'g')) order by doc_id) = 1""")
def first_wins_dedup(t: Tables) -> DataFrame:
    from noticeflow.functions.text import squeeze

    return listing.first_wins(t.documents.select("doc_id", "source", F.sha2(squeeze(F.col("text")), 256).alias("k")), ["k"], [F.col("doc_id")]).select("doc_id", "source")


@query("""with u as (select 0 as rank, doc_id as id, text from documents union all select 1, conv_id * 1000 + turn, text from conversations)
select rank, id from u qualify row_number() over (partition by sha256(lower(regexp_replace(text, '\\s+', '', 'g'))) order by rank, id) = 1""")
def union_sources(t: Tables) -> DataFrame:
    from noticeflow.functions.text import squeeze

    docs = t.documents.select(F.lit(0).alias("rank"), F.col("doc_id").alias("id"), "text")
    turns = t.conversations.select(F.lit(1).alias("rank"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    both = docs.unionByName(turns).select("rank", "id", F.sha2(squeeze(F.col("text")), 256).alias("k"))
    return listing.first_wins(both, ["k"], [F.col("rank"), F.col("id")]).select("rank", "id")


@query("""select user_id, event_type, max_by(event_id, struct_pack(a := ts, b := event_id)) as event_id, max(ts) as ts from events group by 1, 2""")
def last_wins_overlay(t: Tables) -> DataFrame:
    return listing.last_wins(t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@query("""select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as event_type,
max_by(event_type, case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 end) as status
from events where event_type <> 'error' group by 1""")
def monotone_merge(t: Tables) -> DataFrame:
    rows = t.events.where("event_type <> 'error'").withColumn("status", F.col("event_type"))
    return changes.merge_observations(rows, ["user_id"], ["event_type"], "status", ["view", "click", "signup", "purchase"]).select("user_id", "event_type", "status")


@query("""select o_orderkey, case when o_totalprice > 200000 then 'MAIN' else 'REVIEW' end as old, case when o_totalprice > 150000 then 'MAIN' else 'REVIEW' end as new
from orders where (o_totalprice > 200000) is distinct from (o_totalprice > 150000)""")
def reevaluated_rows(t: Tables) -> DataFrame:
    decide = lambda limit: F.when(F.col("o_totalprice") > limit, "MAIN").otherwise("REVIEW")
    rows = t.orders.select("o_orderkey", decide(200000).alias("old"), decide(150000).alias("new"))
    return changes.changed_decisions(rows, ["o_orderkey"], [F.col("old")], [F.col("new")])


@query("""with d as (select user_id, min(cast(ts as date)) as first_day from events group by 1)
select event_type, count(*) as n, count(distinct events.user_id) as users from events join d on d.user_id = events.user_id where cast(ts as date) > first_day group by 1""")
def baseline_suppressed(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("first_day"))
    later = t.events.join(first, "user_id").where(F.to_date("ts") > F.col("first_day"))
    return later.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""with base as (select distinct user_id from events where event_type = 'signup'),
new as (select distinct user_id, event_type from events where event_type in ('purchase', 'error') and user_id in (select user_id from base))
select * from new except select user_id, event_type from events where event_type = 'error' and event_id % 3 = 0""")
def outbox_rows(t: Tables) -> DataFrame:
    sent = t.events.where("event_type = 'error' and event_id % 3 = 0").select("user_id", "event_type")
    events = t.events.select("user_id", "event_type")
    return incremental.outbox(events, sent, t.events.where("event_type = 'signup'"), F.col("event_type").isin("purchase", "error"), ["user_id", "event_type"], ["user_id"])


@query("""select l_orderkey, case when bool_or(l_returnflag = 'R') then 'FAILED' when bool_and(l_returnflag = 'A') then 'SENT' else 'PENDING' end as delivery from lineitem group by 1""")
def delivery_status(t: Tables) -> DataFrame:
    return incremental.delivery_status(t.lineitem, ["l_orderkey"], "l_returnflag", failed="R", sent="A").withColumn("delivery", F.expr("case delivery when 'R' then 'FAILED' when 'A' then 'SENT' else delivery end"))


@query("""select l_suppkey, case when count(*) filter (l_quantity > 10) = 0 then 'NO_ACTIVE' when count(*) filter (l_quantity > 10) = count(*) filter (l_quantity > 10 and l_returnflag <> 'R') then 'SUCCESS'
when count(*) filter (l_quantity > 10 and l_returnflag <> 'R') = 0 then 'FAILED' else 'PARTIAL_SUCCESS' end as batch from lineitem group by 1""")
def batch_status(t: Tables) -> DataFrame:
    return incremental.batch_status(t.lineitem, ["l_suppkey"], F.col("l_returnflag") != "R", F.col("l_quantity") > 10)


@query("""select event_id, event_type, row_number() over (partition by event_type, cast(ts as date) order by ts, event_id) as call from events qualify call <= 5""")
def daily_quota(t: Tables) -> DataFrame:
    return incremental.daily_quota(t.events, "event_type", "ts", "event_id", 5).select("event_id", "event_type", F.col("call").cast("bigint").alias("call"))


@query("""with m as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as b from events),
r as (select event_id, cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, b order by ts, event_id rows unbounded preceding) as bigint) as failures from m)
select event_id, failures, case when failures <= 0 then cast(0 as bigint) else cast(least(3600.0, 300.0 * pow(2.0, least(failures - 1, 30))) as bigint) end as delay from r""")
def backoff_delay(t: Tables) -> DataFrame:
    runs = incremental.failure_runs(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs.select("event_id", F.col("failures").cast("bigint").alias("failures"), incremental.backoff_seconds(F.col("failures")).alias("delay"))


@query("""with s as (select user_id, max(ts) + interval 12 hour as next_run from events group by 1)
select c_custkey as source, date '2024-01-30' - 6 as first, date '2024-01-30' as last from customer left join s on user_id = c_custkey where c_acctbal > 0 and (next_run is null or next_run <= timestamp '2024-01-30 12:00:00')""")
def due_sources(t: Tables) -> DataFrame:
    """Some sources are disabled, some have no state, some are due and some are not."""
    state = t.events.groupBy(F.col("user_id").alias("source")).agg((F.max("ts") + F.expr("interval 12 hours")).alias("next_run"))
    schedule = t.customer.select(F.col("c_custkey").alias("source"), (F.col("c_acctbal") > 0).alias("enabled"))
    return incremental.due_sources(schedule, state, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), F.lit(7))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus else o_orderpriority end as detail, array_to_string(list_sort(list_distinct([o_orderstatus, 'x', o_orderpriority])), ',') as codes from orders""")
def kept_last_good(t: Tables) -> DataFrame:
    """A value that could not be fetched leaves the old one; lists in JSON are united."""
    pair = lambda *c: F.to_json(F.array(*c))
    united = changes.union_lists(pair(F.col("o_orderstatus"), F.lit("x")), pair(F.col("o_orderpriority"), F.lit("x")))
    return t.orders.select("o_orderkey", changes.keep_last_good(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey") % 3 != 0).alias("detail"), F.array_join(F.from_json(united, "array<string>"), ",").alias("codes"))


@query("""select c_custkey, c_nationkey, case when c_nationkey % 4 = 1 then c_mktsegment || '*' else c_mktsegment end as c_mktsegment from customer where c_nationkey % 4 <> 3""")
def root_snapshots(t: Tables) -> DataFrame:
    """Roots that succeeded are replaced, a failed one keeps its snapshot, and one never read to the end shows nothing."""
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    states = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 4 == 1, "SUCCESS").otherwise("FAILED").alias("state"), (F.col("n_nationkey") % 4 != 3).alias("readable"))
    return changes.replace_succeeded(rows, rows.withColumn("c_mktsegment", F.concat("c_mktsegment", F.lit("*"))), states, "c_nationkey")


@query("""select user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) as state, max(ts) as ts from events group by 1""")
def audit_last_state(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("event_type").alias("state"), "ts", "event_id")
    return changes.last_state(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "state", "ts")


@query("""select cast(o_orderdate as date) as day, o_orderkey, row_number() over (partition by cast(o_orderdate as date) order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end, o_orderkey) as place from orders qualify place <= 2""")
def budget_priority(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = t.orders.select(F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderpriority")
    return listing.priority_budget(rows, rank, [F.col("o_orderkey")], 2, ["day"]).select("day", "o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("""with w as (select r_name as operation, cast(unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-10', interval 1 day)) as date) as day from region),
o as (select * from w where not (operation in ('ASIA', 'EUROPE') and day < date '2024-01-05'))
select operation, day, row_number() over (partition by operation order by day desc) as place from o""")
def cursor_windows(t: Tables) -> DataFrame:
    operations = t.region.select(F.col("r_name").alias("operation"))
    done = operations.where(F.col("operation").isin("ASIA", "EUROPE")).select("operation", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-04").cast("date"))).alias("day"), F.lit(True).alias("completed"))
    return incremental.cursor_windows(operations, "2024-01-01", "2024-01-10", done).withColumn("place", F.col("place").cast("bigint"))


@query("""with q as (select o_custkey as id, cast(count(*) as int) as attempts from orders where o_orderstatus = 'P' group by 1), s as (select distinct o_custkey as id from orders where o_orderstatus = 'F'),
f as (select distinct o_custkey as id from orders where o_orderstatus = 'O'), l as (select * from q where id not in (select id from s))
select coalesce(l.id, f.id) as id, cast(coalesce(attempts, 0) + case when f.id is null then 0 else 1 end as int) as attempts from l full join f on l.id = f.id""")
def retry_queue(t: Tables) -> DataFrame:
    ids = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    queue = ids("P").groupBy("id").agg(F.count("*").cast("int").alias("attempts"))
    return incremental.retry_queue(queue, ids("O"), ids("F"), ["id"])


@query("""select event_id from events where event_type = 'view' and ts < (select max(ts) from events) - interval 3600 second""")
def stale_runs(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    runs = t.events.select("event_id", F.when(F.col("event_type") == "view", "RUNNING").otherwise("DONE").alias("status"), F.col("ts").alias("started_at")).crossJoin(F.broadcast(now))
    return incremental.stale_runs(runs, F.col("now")).select("event_id")


@query("""select distinct user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and ts >= (select max(ts) from events) - interval 30 minute)""")
def recently_done(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now"))
    runs = t.events.where("event_type = 'purchase'").select("user_id", F.lit("SUCCESS").alias("status"), F.col("ts").alias("finished_at")).crossJoin(F.broadcast(now))
    return incremental.recently_done(t.events.select("user_id").distinct(), runs, ["user_id"], F.col("now"))


@query("""select event_id, user_id from (select *, lag(event_type) over w as b, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)) where n = 1 or event_type is distinct from b""")
def state_transitions(t: Tables) -> DataFrame:
    return changes.unchanged_since(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "user_id")


@query("""select * from (select case when o_totalprice < 1000 then 'price_floor' end as rule, cast(o_orderkey as varchar) as key from orders union all
select case when o_orderstatus = 'F' and o_orderdate > timestamp '1998-01-01' then 'closed_late' end, cast(o_orderkey as varchar) from orders union all
select case when n > 1 then 'unique_customer_day' end, o_custkey || '|' || d from (select o_custkey, cast(cast(o_orderdate as date) as varchar) as d, count(*) as n from orders group by 1, 2) union all
select case when o_custkey is not null and o_custkey not in (select c_custkey from customer where c_acctbal > 0) then 'customer_exists' end, cast(o_custkey as varchar) from (select distinct o_custkey from orders)) where rule is not null""")
def violations(t: Tables) -> DataFrame:
    rows = constraints.violations(t.orders, "o_orderkey", {"price_floor": F.col("o_totalprice") >= 1000, "closed_late": ~((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")))})
    twice = constraints.duplicates(t.orders.withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"], "unique_customer_day")
    return rows.unionByName(twice).unionByName(constraints.orphans(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey", "customer_exists"))


@query("""select o_orderkey, sha256(concat(length('status') || ':status=', length(o_orderstatus) || ':' || o_orderstatus, chr(10), '8:priority=', length(o_orderpriority) || ':' || o_orderpriority, chr(10),
array_to_string(list_transform(flags, lambda x, i: length('line[' || (i - 1) || ']') || ':line[' || (i - 1) || ']=' || length(x) || ':' || x || chr(10)), ''))) as digest
from orders join (select l_orderkey, list_sort(list(l_returnflag || l_linenumber)) as flags from lineitem group by 1) l on l_orderkey = o_orderkey""")
def content_digest(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("flags"))
    joined = t.orders.join(flags, "o_orderkey")
    return joined.select("o_orderkey", content_hash([("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority"))], [("line", F.col("flags"))]).alias("digest"))


@query("""with r as (select o_orderpriority, cast(date_trunc('month', min(o_orderdate)) as date) + 14 as a, cast(max(o_orderdate) as date) as z from orders group by 1),
d as (select o_orderpriority, z, cast(unnest(generate_series(cast(a as timestamp), cast(z as timestamp), interval 1 month)) as date) as first from r)
select o_orderpriority, first, least(cast(first + interval 1 month as date) - 1, z) as last from d""")
def month_windows(t: Tables) -> DataFrame:
    """The months from the middle of each priority's first month to its last order."""
    span = t.orders.groupBy("o_orderpriority").agg(F.date_add(F.trunc(F.min("o_orderdate"), "month"), 14).alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    return span.select("o_orderpriority", F.explode(month_chunks(F.col("a"), F.col("z"))).alias("c")).select("o_orderpriority", "c.first", "c.last")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)
select doc_id, cast(pos as int) as pos from l where trim(line) <> '' qualify row_number() over (partition by doc_id, regexp_replace(regexp_replace(trim(line), '^[\\s\\-*•·○●□■▪◦※]+', ''), '\\s+', '', 'g') order by pos) = 1""")
def doc_lines(t: Tables) -> DataFrame:
    from noticeflow.operators.lines import distinct_lines, to_lines

    return distinct_lines(to_lines(t.documents, "doc_id", "text"), "doc_id", item_key(F.col("line"))).select("doc_id", "pos")
