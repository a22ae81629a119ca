"""Decision tables on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import presets
from noticeflow.operators import rules


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("title", "want"), [
    (None, "UNKNOWN"), ("  ", "UNKNOWN"), ("건설사업관리 용역", "IRRELEVANT"), ("건설폐기물 위탁 처리", "IRRELEVANT"), ("석면 해체 감리", "IRRELEVANT"), ("전기 공사 감리", "IRRELEVANT"),
    ("개인정보 영향평가 수행", "RELEVANT"), ("개인정보 PIA 점검", "RELEVANT"), ("개인정보 utopia 사업", "UNKNOWN"), ("정보시스템 감리", "RELEVANT"), ("데이터 플랫폼 구축", "RELEVANT"), ("IT 시스템 운영", "RELEVANT"),
    ("kit 개발", "UNKNOWN"), ("청소 용역", "UNKNOWN")])
def test_title_relevance(spark, title, want):
    assert one(spark, rules.title_relevance(F.lit(title).cast("string"), presets.TITLE_RELEVANCE)) == want


@pytest.mark.parametrize(("name", "code", "standard", "evidence", "want"), [
    ("적격심사 낙찰", "", "", [], ("QUALIFICATION_REVIEW", "CONFIRMED", "STRUCTURED_DETAIL")), ("부적격심사", "", "", [], ("OTHER", "NOT_DETECTED", "STRUCTURED_DETAIL")),
    ("소액 수의 견적", "", "", [], ("SMALL_AMOUNT_ESTIMATE", "CONFIRMED", "STRUCTURED_DETAIL")), ("", "낙030001", "", [], ("QUALIFICATION_REVIEW", "CONFIRMED", "STRUCTURED_DETAIL")),
    ("협상에 의한 계약", "", "적격심사", [], ("OTHER", "NOT_DETECTED", "STRUCTURED_DETAIL")), ("최저가", "", "적격심사 기준", [], ("QUALIFICATION_REVIEW", "CONFIRMED", "STRUCTURED_DETAIL")),
    ("", "", "", ["낙찰자 선정방법: 적격심사"], ("QUALIFICATION_REVIEW", "LIKELY", "ATTACHMENT_DOCUMENT")), ("", "", "", ["적격심사"], ("UNKNOWN", "UNKNOWN", "NOT_AVAILABLE"))])
def test_award_method(spark, name, code, standard, evidence, want):
    found = rules.award_method(F.lit(name), F.lit(code), F.lit(standard), F.array(*map(F.lit, evidence)).cast("array<string>"), presets.AWARD_METHOD)
    got = one(spark, found)
    assert (got.category, got.status, got.source) == want
    assert got.reason and "{}" not in got.reason and all(x in got.reason for x in ([name] if want[1] == "CONFIRMED" and "적격심사" in name else evidence if want[1] == "LIKELY" else []))


@pytest.mark.parametrize(("qualification", "relevance", "want"), [
    (q, r, {"MATCH": "MAIN", "MISMATCH": "ARCHIVED"}.get(q, "MAIN" if r == "RELEVANT" else "REVIEW")) for q in ("MATCH", "MISMATCH", "INCOMPLETE", "ABSENT") for r in ("RELEVANT", "UNKNOWN", "IRRELEVANT")])
def test_promotion(spark, qualification, relevance, want):
    assert one(spark, rules.promotion(F.lit(qualification), F.lit(relevance))) == want


@pytest.mark.parametrize(("groups", "state", "missing"), [
    ([], "UNKNOWN", None), ([["1468"]], "SATISFIED", None), ([["1468", "9999"], ["6146"]], "SATISFIED", ["9999"]), ([["9", "8"], ["7"]], "MISMATCH", ["7"]), ([["9"], ["8"]], "MISMATCH", ["9"]),
    ([["9"], [""]], "UNKNOWN", ["9"]), ([[]], "UNKNOWN", None)])
def test_license_groups(spark, groups, state, missing):
    df = spark.createDataFrame([(groups,)], "g array<array<string>>").withColumn("a", F.array(*map(F.lit, presets.ALLOWED_CODES_SEED)))
    row = df.select(rules.license_state(F.col("g"), F.col("a")).alias("s"), rules.smallest_missing(F.col("g"), F.col("a")).alias("m")).first()
    assert (row.s, row.m) == (state, missing)


def test_keyword_class(spark):
    find = lambda t, b: tuple(one(spark, rules.keyword_class(F.lit(t), F.lit(b), presets.ASSESSMENT_CORE, presets.ASSESSMENT_SUPPORT)))
    assert find("전문인력 접수 안내", "신청 PIA") == (True, "전문인력,접수,PIA,신청", "TITLE_CORE")
    assert find("안내", "보수교육") == (True, "보수교육", "BODY_CORE")
    assert find("마감", "") == (False, "마감", "SUPPORT_ONLY")
    assert find("", "없음") == (False, "", "NONE")


def test_file_kinds_follow_the_order_of_a_source(spark):
    kind = lambda name, order: one(spark, rules.file_kind(F.lit(name), presets.ATTACHMENT_ORDER[order]))
    assert kind("공고 및 과업지시서.hwp", "tasks_first") == "TASK" and kind("공고 및 과업지시서.hwp", "notice_first") == "NOTICE" and kind("도면.zip", "tasks_first") == "OTHER"
    near = lambda path: one(spark, rules.nearest_kind(F.lit(path), [("A", ["계약"]), ("B", ["증명"])]))
    assert near("계약/증명서.pdf") == "B" and near("증명/계약/x.pdf") == "A" and near("계약증명/x.pdf") is None and near("x/y") is None
    assert one(spark, rules.deepest_label(F.lit("회사/기술본부/보안팀/홍.pdf"), ["본부", "팀"])) == "보안팀"


def test_requests_and_checks(spark):
    valid = lambda s, a, b: one(spark, rules.request_valid(F.lit(s), F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert valid("NEEDED", None, None) and valid("REQUESTED", "2024-01-01", None) and valid("RECEIVED", "2024-01-01", "2024-01-01")
    assert not valid("NEEDED", "2024-01-01", None) and not valid("RECEIVED", "2024-01-02", "2024-01-01") and not valid("X", None, None)
    assert one(spark, rules.first_failure([(F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")])) == "b"
