"""Matching, overlay and discovery queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import urls
from noticeflow.operators import matching, rules
from noticeflow.plans.registry import Tables, query


@query("""select c_name, coalesce(cast(s_suppkey as varchar), 'index-' || sha256(c_name)) as s_suppkey from customer left join supplier on replace(s_name, 'Supplier', 'Customer') = c_name""")
def fallback_ids(t: Tables) -> DataFrame:
    registered = t.supplier.select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("c_name"), "s_suppkey")
    return matching.with_fallback_id(t.customer.select("c_name"), registered, "c_name", "s_suppkey")


@query("""select o_orderkey, l_linenumber, page_id from (select o_orderkey, o_orderstatus as code from orders) join
(select l_orderkey, l_linenumber, l_linestatus || ':' || l_linenumber as page_id from lineitem) on l_orderkey = o_orderkey where starts_with(page_id, code || ':')""")
def prefix_matches(t: Tables) -> DataFrame:
    api = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("code"))
    pages = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.concat("l_linestatus", F.lit(":"), F.col("l_linenumber").cast("string")).alias("page_id"))
    return matching.same_number_and_prefix(api, pages, "o_orderkey", "code", "page_id").select("o_orderkey", "l_linenumber", "page_id")


@query("""select c.doc_id, coalesce(nullif(trim(d.lang), ''), c.lang) as lang, coalesce(nullif(trim(d.source), ''), c.source) as source from documents c
left join (select doc_id, case when doc_id % 2 = 0 then ' ' else upper(lang) end as lang, case when doc_id % 3 = 0 then null else 'detail' end as source from documents where doc_id % 5 = 0) d on d.doc_id = c.doc_id""")
def detail_overlay(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", "lang", "source")
    detail = base.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.upper("lang")).alias("lang"), F.when(F.col("doc_id") % 3 != 0, "detail").alias("source"))
    return matching.overlay(base, detail, ["doc_id"], ["lang", "source"])


@query("""with m as (select o_orderkey, p_partkey, 1 as rank from orders join part on p_partkey = o_custkey union all
select o_orderkey, p_partkey, 2 from orders join part on p_retailprice = o_totalprice and p_brand = o_orderpriority),
b as (select * from m qualify row_number() over (partition by o_orderkey order by rank, p_partkey) = 1)
select o.o_orderkey, p_partkey, case rank when 1 then 'REFERENCE' when 2 then 'NAME' end as matched_by from orders o left join b on b.o_orderkey = o.o_orderkey""")
def resolved_requirements(t: Tables) -> DataFrame:
    return matching.resolve(t.orders, t.part, "o_orderkey", "p_partkey", [("o_custkey", "p_partkey")], [("o_totalprice", "p_retailprice"), ("o_orderpriority", "p_brand")])


@query(r"""with h as (select page_id, regexp_replace(url, '#.*$', '') as address from pages),
c as (select page_id, lower(regexp_extract(address, '^(https?://[^/?#]+)', 1)) || case when regexp_matches(address, '^https?://[^/?#]+(\?|$)') then '/' else '' end || regexp_extract(address, '^https?://[^/?#]+(.*)$', 1) as address from h)
select page_id, address, case when address in (select address from c where page_id % 3 = 0) then 'SUPPORTED' else 'NEW_SITE' end as status from c""")
def site_identification(t: Tables) -> DataFrame:
    """Pages whose canonical address the catalogue (every third page) has."""
    from noticeflow.functions.pyudf import canonical_url

    sites = t.pages.select("page_id", canonical_url("url").alias("address"))
    return matching.site_status(sites, sites.where("page_id % 3 = 0"), "address").select("page_id", "address", "status")


@query("""with e as (select p_size as k, 0 as o from part where p_size % 2 = 0 union all select p_size, 1 from part where p_size % 3 = 0 union all select p_size, 2 from part)
select k as p_size, case min(o) when 0 then 'MASTER' when 1 then 'EXISTING' else 'DESIRED' end as origin from e group by k""")
def option_list(t: Tables) -> DataFrame:
    return matching.options(t.part.where("p_size % 2 = 0"), t.part.where("p_size % 3 = 0"), t.part, "p_size")


@query("""with p as (select *, case p_type when 'ECONOMY' then 'RELEVANT' when 'SMALL' then 'IRRELEVANT' else 'UNKNOWN' end as relevance from part)
select p_partkey, relevance from p where p_size % 7 = 0 or relevance = 'RELEVANT' or (relevance = 'UNKNOWN' and p_brand < 'Brand#2')""")
def qualified_first(t: Tables) -> DataFrame:
    relevance = rules.decide([(F.col("p_type") == "ECONOMY", "RELEVANT"), (F.col("p_type") == "SMALL", "IRRELEVANT")], "UNKNOWN")
    kept = matching.relevant_first(F.col("p_size") % 7 == 0, F.col("relevance"), F.col("p_brand") < "Brand#2")
    return t.part.withColumn("relevance", relevance).where(kept).select("p_partkey", "relevance")


@query("""select event_id, cast(case when event_type = 'error' then '[REDACTED]' else event_type end as varchar) as kind, cast(null as varchar) as secret from events""")
def allowed_fields(t: Tables) -> DataFrame:
    fields = F.create_map(F.lit("kind"), F.when(F.col("event_type") == "error", "token=1").otherwise(F.col("event_type")), F.lit("secret"), F.lit("x"))
    return t.events.select("event_id", matching.allowed_fields(fields, ["kind"]).alias("f")).select("event_id", F.try_element_at("f", F.lit("kind")).alias("kind"), F.try_element_at("f", F.lit("secret")).alias("secret"))


@query("""with p as (select lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, regexp_replace(split_part(url, '?', 1), '\\d{2,}', '{key}', 'g') as pattern from pages),
c as (select host, pattern, count(*) as n from p group by 1, 2), b as (select host, sum(n) as total, max(n) as n, max_by(pattern, struct_pack(a := n, b := pattern)) as pattern from c group by 1)
select host, case when n >= 2 then pattern end as pattern, n, round(n / total, 4) as confidence, case when n < 2 then 'FAILED' when round(n / total, 4) >= 0.5 then 'READY' else 'MANUAL_REVIEW' end as outcome from b""")
def site_discovery(t: Tables) -> DataFrame:
    links = t.pages.select(urls.host(F.col("url")).alias("host"), urls.url_pattern(F.substring_index("url", "?", 1)).alias("pattern"))
    return matching.discover_links(links, "host", "pattern")


@query("""select s_suppkey, case when s_acctbal is null or s_acctbal < 0 then 'NO_BALANCE' when s_nationkey >= 20 then 'REGION' when s_suppkey % 4 = 0 then 'REVIEW' end as reason from supplier""")
def activation_reasons(t: Tables) -> DataFrame:
    checks = [(F.col("s_acctbal") >= 0, "NO_BALANCE"), (F.col("s_nationkey") < 20, "REGION"), (F.col("s_suppkey") % 4 != 0, "REVIEW")]
    return t.supplier.select("s_suppkey", rules.first_failure(checks).alias("reason"))
