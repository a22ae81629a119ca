"""Text, URL, date and decision queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import dates, hashing, text, urls
from noticeflow.operators import lines, rollup, rules
from noticeflow.plans.registry import Tables, query

_DAY = "1998-06-01"
_WORDS = ("the", "and", "ing", "tion")
#: The decision table of titles with words of the driver's tables.
_TITLES = {
    "irrelevant": ["smallring"], "compounds": [(["red"], ["bolt", "nut"]), (["blue", "widget"], [])], "audit": "gear", "other_audits": ["green", "brass"],
    "privacy_phrases": ["largepanel"], "privacy_word": "steel", "privacy_abbreviation": "promo", "actions": ["widget", "valve", "bolt"],
    "technology": ["economy", "standard"], "technology_abbreviation": "red"}
_AWARDS = {"review": "high", "not_review": "nothigh", "small": "low", "small_code": "x", "review_code": "p", "negotiated_code": "f", "negotiated": "medium", "headings": ["urgent"],
    "reasons": {"name": "name {}", "small": "small", "code": "code {}", "negotiated": "negotiated", "standard": "standard {}", "other": "other", "attachment": "text {}", "none": "none"}}


def _sql_any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


_N, _T = "lower(regexp_replace(p_name || ' ' || p_type, '\\s+', '', 'g'))", "lower(p_name || ' ' || p_type)"


@query(f"""select p_partkey, case when {_sql_any(_N, _TITLES["irrelevant"])} then 'IRRELEVANT'
when (contains({_N}, 'red') and {_sql_any(_N, ["bolt", "nut"])}) or (contains({_N}, 'blue') and contains({_N}, 'widget')) then 'IRRELEVANT'
when contains({_N}, 'gear') and {_sql_any(_N, _TITLES["other_audits"])} then 'IRRELEVANT'
when contains({_N}, 'largepanel') or (contains({_N}, 'steel') and regexp_matches({_T}, '(^|[^a-z])promo([^a-z]|$)')) then 'RELEVANT' when contains({_N}, 'gear') then 'RELEVANT'
when {_sql_any(_N, _TITLES["actions"])} and ({_sql_any(_N, _TITLES["technology"])} or regexp_matches({_T}, '(^|[^a-z])red([^a-z]|$)')) then 'RELEVANT' else 'UNKNOWN' end as relevance from part""")
def title_relevance(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", rules.title_relevance(F.concat_ws(" ", "p_name", "p_type"), _TITLES).alias("relevance"))


_O = "lower(regexp_replace(o_orderpriority, '\\s+', '', 'g'))"


@query(f"""with i as (select o_orderkey, case when o_orderkey % 4 = 0 then o_orderpriority end as name, case when o_orderkey % 4 in (0, 1) then lower(o_orderstatus) end as code,
case when o_orderkey % 4 = 2 then o_orderpriority end as standard, case when o_orderkey % 4 = 3 then o_orderpriority || ' urgent' end as evidence from orders),
n as (select *, {_O.replace("o_orderpriority", "coalesce(name, '')")} as n, {_O.replace("o_orderpriority", "coalesce(standard, '')")} as s, {_O.replace("o_orderpriority", "coalesce(evidence, '')")} as e from i),
r as (select *, case when contains(n, 'high') then 'name' when contains(n, 'low') or code = 'x' then 'small' when code = 'p' then 'code' when code = 'f' or contains(n, 'medium') then 'negotiated' when contains(s, 'high') then 'standard'
when n <> '' or coalesce(code, '') <> '' or s <> '' then 'other' when contains(e, 'high') then 'attachment' else 'none' end as rule from n)
select o_orderkey, case when rule in ('name', 'code', 'standard', 'attachment') then 'QUALIFICATION_REVIEW' when rule = 'small' then 'SMALL_AMOUNT_ESTIMATE' when rule = 'none' then 'UNKNOWN' else 'OTHER' end as category,
case when rule in ('name', 'small', 'code', 'standard') then 'CONFIRMED' when rule = 'attachment' then 'LIKELY' when rule = 'none' then 'UNKNOWN' else 'NOT_DETECTED' end as status,
case rule when 'name' then 'name ' || name when 'code' then 'code p' when 'standard' then 'standard ' || standard when 'attachment' then 'text ' || evidence else rule end as reason,
case rule when 'attachment' then 'ATTACHMENT_DOCUMENT' when 'none' then 'NOT_AVAILABLE' else 'STRUCTURED_DETAIL' end as source from r""")
def award_method(t: Tables) -> DataFrame:
    """Every rule decides for some rows: name and code, code alone, the standard alone, attachments alone."""
    k = F.col("o_orderkey") % 4
    given = lambda *v: F.when(k.isin(*v), F.col("o_orderpriority"))
    evidence = F.when(k == 3, F.array(F.lit("else"), F.concat("o_orderpriority", F.lit(" urgent"))))
    found = rules.award_method(given(0), F.when(k.isin(0, 1), F.col("o_orderstatus")), given(2), evidence, _AWARDS)
    return t.orders.select("o_orderkey", found.alias("a")).select("o_orderkey", "a.*")


@query("""select doc_id, array_to_string(list_filter(['the', 'and', 'ing', 'tion'], lambda k: contains(text, k)), ',') as found,
array_to_string(list_filter(['tion', 'the', 'ing', 'and'], lambda k: contains(text, k)), ',') as longest from documents""")
def keyword_matches(t: Tables) -> DataFrame:
    found = F.array_join(text.keywords_found(F.col("text"), _WORDS), ",")
    return t.documents.select("doc_id", found.alias("found"), F.array_join(text.longest_first(F.col("text"), ("tion", "the", "ing", "and")), ",").alias("longest"))


@query("""select conv_id, turn, contains(role, 'user') or contains(text, 'license') or contains(text, 'tion') as related,
case when contains(role, 'user') then 'TITLE_CORE' when contains(text, 'user') or contains(text, 'license') or contains(text, 'tion') then 'BODY_CORE' when contains(role, 'assist') or contains(text, 'assist') then 'SUPPORT_ONLY' else 'NONE' end as reason from (
select conv_id, turn, role, text from conversations)""".replace("contains(role, 'user') or contains(text, 'license')", "contains(role, 'user') or contains(text, 'user') or contains(text, 'license')"))
def keyword_class(t: Tables) -> DataFrame:
    core = ["user", "license", "tion"]
    in_role = rules.keyword_class(F.when(F.contains("role", F.lit("user")) | F.contains("role", F.lit("assist")), F.col("role")).otherwise(""), F.col("text"), core, ["assist"])
    return t.conversations.select("conv_id", "turn", in_role.alias("k")).select("conv_id", "turn", "k.related", "k.reason")


@query("""with b as (select o_orderkey, o_orderstatus = 'F' or o_custkey % 7 = 1 as excluded, o_orderpriority = '4-NOT SPECIFIED' as unknown, o_totalprice > 200000 as big, o_custkey % 5 = 0 as region,
concat_ws(', ', case when o_totalprice > 200000 then 'big' end, case when o_custkey % 5 = 0 then 'region' end) as why from orders)
select o_orderkey, case when excluded then '제외' when unknown or why <> '' then '추가확인필요' else '검토대상' end as status, case when not excluded and (unknown or why <> '') then why else '' end as reasons from b""")
def review_status(t: Tables) -> DataFrame:
    from noticeflow.functions.presets import REVIEW_LABELS

    found = rules.review_status(
        F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "4-NOT SPECIFIED", F.when(F.col("o_custkey") % 7 == 1, "MISMATCH").when(F.col("o_custkey") % 7 == 2, "UNKNOWN").otherwise("SATISFIED"),
        [(F.col("o_totalprice") > 200000, "big"), (F.col("o_custkey") % 5 == 0, "region")], REVIEW_LABELS)
    return t.orders.select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


@query("""with g as (select lang, source, count(*) as n, bool_or(contains(text, 'https://')) as required, bool_or(contains(text, 'password')) as failed, bool_or(contains(text, '@')) as reference, bool_or(n_chars > 0) as analysed from documents group by 1, 2)
select lang, source, case when n = 0 then 'UNKNOWN' when required then 'REQUIRED' when failed then 'UNKNOWN' when reference then 'REFERENCE' when analysed then 'NOT_DETECTED' else 'UNKNOWN' end as status from g""")
def external_check(t: Tables) -> DataFrame:
    has = lambda x: F.bool_or(F.contains("text", F.lit(x)))
    status = rules.external_check(F.count("*"), has("https://"), has("password"), has("@"), F.bool_or(F.col("n_chars") > 0))
    return t.documents.groupBy("lang", "source").agg(status.alias("status"))


@query("""with q as (select p_partkey, case p_size % 4 when 0 then 'MATCH' when 1 then 'MISMATCH' when 2 then 'INCOMPLETE' else 'ABSENT' end as qualification, case when p_partkey % 3 = 0 then 'RELEVANT' else 'UNKNOWN' end as relevance from part)
select *, case qualification when 'MATCH' then 'MAIN' when 'MISMATCH' then 'ARCHIVED' else case when relevance = 'RELEVANT' then 'MAIN' else 'REVIEW' end end as promotion from q""")
def promotion_matrix(t: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ("MATCH", "MISMATCH", "INCOMPLETE", "ABSENT")))
    rows = t.part.select("p_partkey", F.get(kinds, F.col("p_size") % 4).alias("qualification"), F.when(F.col("p_partkey") % 3 == 0, "RELEVANT").otherwise("UNKNOWN").alias("relevance"))
    return rows.withColumn("promotion", rules.promotion(F.col("qualification"), F.col("relevance")))


def _groups(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))).alias("codes"))
    groups = F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "codes"))), lambda x: x["codes"])
    return flags.groupBy("l_orderkey").agg(groups.alias("groups")).withColumn("allowed", F.array(*map(F.lit, ("1", "2", "5"))))


@query("""with g as (select l_orderkey, l_returnflag, bool_and(l_linenumber in (1, 2, 5)) as ok, count(distinct l_linenumber) filter (l_linenumber not in (1, 2, 5)) as m,
array_to_string(list_sort(list(distinct cast(l_linenumber as varchar)) filter (l_linenumber not in (1, 2, 5))), ',') as miss from lineitem group by 1, 2)
select l_orderkey, bool_or(ok) as satisfied, arg_min(miss, struct_pack(a := m, b := l_returnflag)) filter (m > 0) as closest,
case when bool_or(ok) then 'SATISFIED' when max(m) > 0 then 'MISMATCH' else 'UNKNOWN' end as state from g group by 1""")
def group_license_match(t: Tables) -> DataFrame:
    g, a = F.col("groups"), F.col("allowed")
    return _groups(t).select("l_orderkey", rules.groups_satisfied(g, a).alias("satisfied"), F.array_join(rules.smallest_missing(g, a), ",").alias("closest"), rules.license_state(g, a).alias("state"))


@query("""select l_orderkey, coalesce(string_agg(distinct cast(l_linenumber as varchar), ',' order by cast(l_linenumber as varchar)) filter (l_linenumber in (1, 2, 5)), '') as codes,
case when count(*) filter (l_linenumber in (1, 2, 5)) > 0 then 'INDUSTRY_CODE' else 'SUPPLEMENTAL' end as kind from lineitem group by 1""")
def matched_codes(t: Tables) -> DataFrame:
    codes = rules.matched_codes(F.col("groups"), F.col("allowed"))
    return _groups(t).select("l_orderkey", F.array_join(codes, ",").alias("codes"), F.when(F.size(codes) > 0, "INDUSTRY_CODE").otherwise("SUPPLEMENTAL").alias("kind"))


@query("""select doc_id, len(list_distinct(list_filter(regexp_split_to_array(text, '[^0-9]+'), lambda v: length(v) = 4))) > 0 as any_list,
len(list_distinct(list_filter(regexp_split_to_array(text, '[^0-9]+'), lambda v: length(v) = 4))) as n_codes,
array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[^0-9]+'), lambda v: length(v) = 4))), ',') as codes from documents""")
def code_extract(t: Tables) -> DataFrame:
    codes = text.four_digit_codes(F.col("text"))
    return t.documents.select("doc_id", (F.size(codes) > 0).alias("any_list"), F.size(codes).cast("bigint").alias("n_codes"), F.array_join(F.array_sort(codes), ",").alias("codes"))


@query("""select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) = 'example.net' or lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) like '%.example.net' as reference from pages""")
def url_hosts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.is_host(F.col("url"), ["example.net"]).alias("reference"))


_PATTERN = """case when contains(url, '?') then regexp_replace(split_part(url, '?', 1), '\\d{2,}', '{key}', 'g') || '?' || regexp_replace(split_part(url, '?', 2), '=[^&]*', '={value}', 'g')
else regexp_replace(url, '\\d{2,}', '{key}', 'g') end"""


@query(f"""with p as (select lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, {_PATTERN} as pattern from pages), g as (select host, pattern, count(*) as n from p group by 1, 2 having count(*) >= 2)
select host, pattern, n from g qualify row_number() over (partition by host order by n desc, pattern) = 1""")
def url_patterns(t: Tables) -> DataFrame:
    rows = t.pages.select(urls.host(F.col("url")).alias("host"), urls.url_pattern(F.col("url")).alias("pattern"))
    counted = rows.groupBy("host", "pattern").agg(F.count("*").alias("n")).where("n >= 2")
    return rollup.top_per_group(counted, ["host"], [F.desc("n"), F.col("pattern")], 1).drop("place")


@query("""with f as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 1 then strftime(o_orderdate, '%Y/%m/%d %H:%M') when 2 then strftime(o_orderdate, '%Y%m%d') else 'n/a' end as raw, o_orderdate from orders)
select o_orderkey, case when raw = 'n/a' then null else o_orderdate end as value, case when raw = 'n/a' then raw end as rejected from f""")
def multi_format_date(t: Tables) -> DataFrame:
    at = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 4 == 1, F.date_format(at, "yyyy/MM/dd HH:mm")).when(F.col("o_orderkey") % 4 == 2, F.date_format(at, "yyyyMMdd")).otherwise("n/a")
    return t.orders.select("o_orderkey", dates.parse_or_reject(raw).alias("d")).select("o_orderkey", "d.value", "d.rejected")


@query(f"""with p as (select o_orderkey, o_orderstatus, cast(o_orderdate as date) as a, cast(o_orderdate as date) + 90 as b from orders)
select o_orderkey, case when o_orderstatus = 'P' then 'ONGOING' when o_orderkey % 5 = 0 then 'UNKNOWN' when o_orderkey % 5 = 1 then case when last_day(b) < date '{_DAY}' then 'COMPLETED' else 'ONGOING' end when b < date '{_DAY}' then 'COMPLETED' else 'ONGOING' end as status from p""")
def period_status(t: Tables) -> DataFrame:
    a, b = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 90)
    day = lambda d, f="yyyy.MM.dd": F.date_format(d, f)
    # The years of the table begin with 19; the rule reads those from 2000 on, so texts stand 20 years later.
    later = lambda d: F.add_months(d, 240)
    period = (
        F.when(F.col("o_orderstatus") == "P", F.concat(day(later(a)), F.lit(" ~ 현재"))).when(F.col("o_orderkey") % 5 == 0, day(later(a)))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(day(later(a), "yyyy.MM"), F.lit(" ~ "), day(later(b), "yyyy.MM"))).otherwise(F.concat(day(later(a)), F.lit(" ~ "), day(later(b)))))
    return t.orders.select("o_orderkey", dates.period_status(period, F.add_months(F.lit(_DAY).cast("date"), 240)).alias("status"))


@query(f"""with p as (select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'PERIODIC' when o_orderpriority = '3-MEDIUM' then 'EXPIRATION' else 'NONE' end as policy, cast(o_orderdate as date) as d from orders)
select o_orderkey, policy, case policy when 'PERIODIC' then case when d + interval 12 month > date '{_DAY}' then 'VALID' else 'EXPIRED' end
when 'EXPIRATION' then case when d < date '{_DAY}' then 'EXPIRED' when d <= date '{_DAY}' + 30 then 'EXPIRING_SOON' else 'VALID' end else 'NOT_REQUIRED' end as freshness from p""")
def freshness_status(t: Tables) -> DataFrame:
    policy = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "PERIODIC").when(F.col("o_orderpriority") == "3-MEDIUM", "EXPIRATION").otherwise("NONE")
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", policy.alias("policy"), dates.freshness(policy, d, F.lit(12), d, F.lit(_DAY).cast("date")).alias("freshness"))


@query(f"""select o_orderkey, case when d = 0 then 'D-DAY' when d > 0 then 'D-' || d else 'D+' || (-d) end as label from (select o_orderkey, date_diff('day', date '{_DAY}', cast(o_orderdate as date)) as d from orders)""")
def deadline_label(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.deadline_label(F.to_date("o_orderdate"), F.lit(_DAY).cast("date")).alias("label"))


_LINES = """l as (select doc_id, trim(line) as line, cast(pos as int) as pos from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) where trim(line) <> '')"""


def _lines(t: Tables) -> DataFrame:
    return lines.to_lines(t.documents, "doc_id", "text")


@query(f"""with {_LINES}, m as (select *, last_value(case when starts_with(line, 'The') then pos when starts_with(line, 'Of') then -pos - 1 end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as h from l)
select doc_id, pos, cast(h as int) as heading_pos from m where h >= 0 and pos > h""")
def section_lines(t: Tables) -> DataFrame:
    return lines.section_lines(_lines(t), "doc_id", F.col("line").startswith("The"), F.col("line").startswith("Of")).select("doc_id", "pos", "heading_pos")


@query(f"""with {_LINES}, n as (select *, row_number() over (partition by doc_id order by pos) as n, contains(line, '@') or contains(line, 'License') as k, starts_with(line, 'The') as s from l),
b as (select *, max(case when k then n end) over w as a, max(case when s then n end) over w as st from n window w as (partition by doc_id order by pos rows between 3 preceding and 1 preceding))
select doc_id, pos from b where a is not null and (st is null or st < a)""")
def context_lines(t: Tables) -> DataFrame:
    keyword = F.contains("line", F.lit("@")) | F.contains("line", F.lit("License"))
    return lines.context_before(_lines(t), "doc_id", keyword, 3, F.col("line").startswith("The")).select("doc_id", "pos")


@query(f"""with {_LINES}, v as (select *, nullif(regexp_extract(line, '([0-9]{{4,}})', 1), '') as v, starts_with(line, 'Of') as s from l),
a as (select *, lead(v, 1) over w as v1, lead(v, 2) over w as v2, lead(v, 3) over w as v3, lead(v, 4) over w as v4, lead(s, 1) over w as s1, lead(s, 2) over w as s2, lead(s, 3) over w as s3, lead(s, 4) over w as s4 from v window w as (partition by doc_id order by pos)),
f as (select *, case when s1 then null when v1 is not null then v1 when s2 then null when v2 is not null then v2 when s3 then null when v3 is not null then v3 when s4 then null else v4 end as value from a)
select doc_id, pos, value from f where starts_with(line, 'The') and value is not null""")
def value_after_heading(t: Tables) -> DataFrame:
    value = F.nullif(F.regexp_extract("line", "([0-9]{4,})", 1), F.lit(""))
    return lines.value_after(_lines(t), "doc_id", F.col("line").startswith("The"), value, F.col("line").startswith("Of"), 4).select("doc_id", "pos", "value")


@query(f"""with {_LINES}, g as (select *, sum(case when regexp_matches(line, '^[A-M]') then 1 else 0 end) over (partition by doc_id order by pos rows unbounded preceding) as item from l)
select doc_id, cast(item as bigint) as item, string_agg(line, ' ' order by pos) as text, count(*) as n_lines from g where item > 0 group by 1, 2""")
def item_groups(t: Tables) -> DataFrame:
    return lines.group_items(_lines(t), "doc_id", F.col("line").rlike("^[A-M]")).withColumn("item", F.col("item").cast("bigint"))


@query(f"""with {_LINES}, h as (select *, case when contains(x, 'license') then 'LICENSE' when contains(x, 'rights') then 'RIGHTS' else 'OTHER' end as kind, case when contains(lower(line), 'version') then 'CONDITIONAL' else 'REQUIRED' end as need
from (select *, lower(regexp_replace(line, '\\s+', '', 'g')) as x from l) where contains(lower(line), 'license') or contains(lower(line), 'rights') or contains(lower(line), 'released'))
select doc_id, pos, kind, need from h qualify row_number() over (partition by doc_id, regexp_replace(lower(line), '[^0-9a-z가-힣]', '', 'g') order by pos) = 1""")
def requirement_lines(t: Tables) -> DataFrame:
    found = lines.requirements(_lines(t), "doc_id", ["license", "rights", "released"], [("LICENSE", ["license"]), ("RIGHTS", ["rights"])], ["version"])
    return found.select("doc_id", "pos", "kind", "need")


@query("""select doc_id, sha256(length(lang) || ':' || lang || length(body) || ':' || body || length(cast(n as varchar)) || ':' || n || coalesce(array_to_string(list_transform(parts, lambda x: length(x) || ':' || x), ''), '')) as digest
from (select doc_id, lang, text as body, 2 as n, list_sort([length(source) || ':' || source, length(lang) || ':' || lang]) as f, list_sort([source, lang]) as parts from documents)""".replace("list_sort([source, lang]) as parts", "[split_part(x, ':', 2) for x in list_sort([length(source) || ':' || source, length(lang) || ':' || lang])] as parts"))
def notice_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.fingerprint([F.col("lang"), F.col("text")], [F.array("source", "lang")]).alias("digest"))


@query("""select page_id, regexp_replace(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12), '', '') as uuid,
'index-' || sha256(url) as index_id from (select page_id, url, md5('origin' || chr(0) || 'company' || chr(0) || url) as h from pages)""")
def derived_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", hashing.name_uuid(F.lit("origin"), F.lit("company"), F.col("url")).alias("uuid"), hashing.index_id(F.col("url")).alias("index_id"))


@query("""select c_custkey, case when contains(c_name, '#') then split_part(c_name, '#', 2) else '' end as after, lower(regexp_replace(c_name, '\\s+', '', 'g')) as squeezed,
case when length(c_name) > 12 then substr(c_name, 1, 9) || '...' else c_name end as short, case when c_name = c_mktsegment then c_name else c_name || ', ' || c_mktsegment end as joined, regexp_replace(lower(c_name), '[^0-9a-z가-힣]', '', 'g') as key from customer""")
def text_forms(t: Tables) -> DataFrame:
    n = F.col("c_name")
    return t.customer.select("c_custkey", text.after_last(n, "#").alias("after"), text.squeeze(n).alias("squeezed"), text.abbreviate(n, 12, dots=True).alias("short"), text.join_distinct(n, F.col("c_mktsegment")).alias("joined"), text.name_key(n).alias("key"))


@query(r"""with x as (select c_custkey, '  ' || c_name || chr(9) || ' ' || c_mktsegment || ' ' as t, case when c_custkey % 3 = 0 then '  ' else c_mktsegment end as m, '/a/' || c_mktsegment || '/' || c_name || case when c_custkey % 2 = 0 then '.PDF' else '' end as p from customer)
select c_custkey, trim(regexp_replace(t, '\s+', ' ', 'g')) as collapsed, nullif(trim(m), '') as filled, nullif(trim(regexp_replace(t, '\s+', ' ', 'g')), '') as cell, regexp_replace(t, '[\s:*]', '', 'g') as label,
regexp_replace(c_custkey || '. ' || trim(t), '\s+', '', 'g') as item, coalesce(nullif(trim(m), ''), trim(t)) as first_given, regexp_replace(p, '/[^/]*$', '') as folder, case when c_custkey % 2 = 0 then 'pdf' else '' end as extension,
regexp_replace(p, '[\\/:*?"<>|]', '_', 'g') as file_name, case when c_custkey % 4 = 0 then 'Y' when c_custkey % 4 = 1 then 'N' end as yes, 'a=1&token=[REDACTED]&b=' || c_custkey as redacted,
c_mktsegment || ',z' as listed, case when c_custkey % 5 <> 0 then 'user' || c_custkey || '@example.com' end as email from x join customer using (c_custkey)""")
def cleaned_forms(t: Tables) -> DataFrame:
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    loose = F.concat(F.lit("  "), name, F.lit("\t "), segment, F.lit(" "))
    blank = F.when(k % 3 == 0, "  ").otherwise(segment)
    path = F.concat(F.lit("/a/"), segment, F.lit("/"), name, F.when(k % 2 == 0, ".PDF").otherwise(""))
    answer = F.when(k % 4 == 0, " YES ").when(k % 4 == 1, "아니오").otherwise("maybe")
    mail = F.concat(F.lit(" User"), k.cast("string"), F.when(k % 5 == 0, " at example.com").otherwise("@example.com "))
    return t.customer.select(
        "c_custkey", text.collapse(loose).alias("collapsed"), text.blank_to_null(blank).alias("filled"), text.clean_cell(loose).alias("cell"), text.label_key(loose).alias("label"),
        text.item_key(F.concat(F.lit(" - "), k.cast("string"), F.lit(". "), loose)).alias("item"), text.first_non_blank(blank, loose).alias("first_given"), text.before_last(path).alias("folder"), text.file_extension(path).alias("extension"),
        text.safe_file_name(path).alias("file_name"), text.yes_no(answer).alias("yes"), text.redact(F.concat(F.lit("a=1&token=abc&b="), k.cast("string"))).alias("redacted"),
        F.array_join(text.clean_list(F.array(F.array(blank, segment), F.array(F.lit(" z "), F.lit("")))), ",").alias("listed"), text.email_key(mail).alias("email"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate end as lenient, case when o_orderkey % 3 = 0 then null else date_trunc('minute', o_orderdate) end as paired, cast(o_orderdate as date) + interval 10 year as in_name, date_diff('day', cast(o_orderdate as date), date '1998-06-01') * -1 as days
from (select o_orderkey, date_trunc('second', o_orderdate) as o_orderdate from orders)""")
def date_forms(t: Tables) -> DataFrame:
    at, k = F.col("o_orderdate"), F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, "-").when(k % 4 == 2, "추후 공지").otherwise("00000000")
    day = F.when(k % 3 == 0, "00000000").otherwise(F.date_format(at, "yyyyMMdd"))
    later = F.add_months(F.to_date("o_orderdate"), 120)
    name = F.concat(F.lit("report_2001.01.02_"), F.date_format(later, "yyyy-MM-dd"), F.lit("_20019999.pdf"))
    return t.orders.select(
        "o_orderkey", dates.parse_lenient(raw, ["추후"]).alias("lenient"), dates.pair_time(day, F.date_format(at, "HHmm")).alias("paired"), dates.latest_date_in_name(name).cast("timestamp_ntz").alias("in_name"),
        dates.days_left(F.to_date("o_orderdate"), F.lit(_DAY).cast("date")).cast("bigint").alias("days"))


@query(r"""with s as (select page_id, 'See ' || url || '. Also <' || replace(url, '?', '/x?') || '>, (' || url || ') and https://own.example.net/' || page_id || ';' as text, regexp_extract(url, '^https?://([^/:?#]+)', 1) as host from pages),
x as (select page_id, host, list_distinct(list_transform(regexp_extract_all(text, 'https?://[^\s"''<>\])}]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))) as found from s)
select page_id, array_to_string(list_sort(list_filter(found, lambda u: not contains(u, 'own.example.net') and not regexp_matches(u, '^https?://([^/]*\.)?thth[^/]*/'))), ' ') as urls from x""".replace("([^/]*\\.)?thth[^/]*/", "ththre\\.example\\.com"))
def text_urls(t: Tables) -> DataFrame:
    """Addresses in a text, each once, without those of the page's own sites."""
    u = F.col("url")
    said = F.concat(F.lit("See "), u, F.lit(". Also <"), F.replace(u, F.lit("?"), F.lit("/x?")), F.lit(">, ("), u, F.lit(") and https://own.example.net/"), F.col("page_id").cast("string"), F.lit(";"))
    return t.pages.select("page_id", F.array_join(F.array_sort(urls.extract_urls(said, ["own.example.net", "ththre.example.com"])), " ").alias("urls"))


@query(r"""select page_id, regexp_extract(url, '^https?://([^/?&#]+)/([^/?&#]+)/(\d+)', 2) as lang, 'https://' || regexp_extract(url, '^https?://([^/?&#]+)/', 1) || '/' || regexp_extract(url, '^https?://([^/?&#]+)/([^/?&#]+)/([^/?&#]+)', 3) as filled
from pages where regexp_matches(url, '^https?://[^/?&#]+/[^/?&#]+/[^/?&#]+$')""")
def url_templates(t: Tables) -> DataFrame:
    places = urls.match_template(F.regexp_replace("url", "^http:", "https:"), "https://{host}/{lang}/{key}")
    rows = t.pages.select("page_id", places.alias("m")).where("m is not null")
    return rows.select("page_id", F.try_element_at("m", F.lit("lang")).alias("lang"), urls.fill_template("https://{host}/{key}", F.col("m")).alias("filled"))


@query("""select p_partkey, case when contains(p_name, 'widget') then 'W' when contains(p_name, 'gear') then 'G' else 'OTHER' end as kind, case when p_size % 3 = 0 then case when contains(p_name, 'widget') then 'W' when contains(p_name, 'gear') then 'G' else 'S' end else case when contains(p_name, 'widget') then 'W' when contains(p_name, 'gear') then 'G' end end as nearest,
case when p_size % 2 = 0 then p_type || ' dept' end as department, case p_partkey % 3 when 0 then p_size % 2 = 0 when 1 then p_size % 2 = 1 else p_size > 10 end as valid from part""")
def file_decisions(t: Tables) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    kinds = [("W", ["widget"]), ("G", ["gear"]), ("S", ["smallfolder"])]
    path = F.concat(F.lit("/root/"), F.when(size % 3 == 0, "small folder").otherwise("other"), F.lit("/"), "p_name")
    folder = F.concat(F.lit("/root/"), "p_type", F.when(size % 2 == 0, " dept").otherwise(""), F.lit("/x/name dept"))
    day = lambda d: F.lit(d).cast("date")
    status = F.get(F.array(*map(F.lit, ("NEEDED", "REQUESTED", "RECEIVED"))), (key % 3).cast("int"))
    asked = F.when(key % 3 == 0, F.when(size % 2 == 1, day("2024-01-01"))).otherwise(day("2024-01-01"))
    answered = F.when(key % 3 == 1, F.when(size % 2 == 0, day("2024-01-02"))).when(key % 3 == 2, F.when(size > 10, day("2024-01-02")).otherwise(day("2023-12-31")))
    return t.part.select(
        "p_partkey", rules.file_kind(F.col("p_name"), kinds[:2]).alias("kind"), rules.nearest_kind(path, kinds).alias("nearest"), rules.deepest_label(folder, [" dept"]).alias("department"), rules.request_valid(status, asked, answered).alias("valid"))


@query()
def page_links(t: Tables) -> DataFrame:
    """Links of every page, their canonical address and the compact form of their text."""
    from noticeflow.functions.pyudf import canonical_url, compact_nfkc
    from noticeflow.sources.html import link_rows

    rows = link_rows(t.pages.select("page_id", "url", "html"), "html")
    absolute = F.when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.col("href"))).otherwise(F.col("href"))
    return rows.select("page_id", "pos", canonical_url(absolute).alias("target"), compact_nfkc(F.col("text")).alias("label"))
