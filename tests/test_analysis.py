"""Document analysis: tender documents whose lists are known, plain-Python rules on random lines, edge cases."""

import random
import re

import pytest

from noticeflow.functions.presets import DOCUMENT_ANALYSIS as RULES
from noticeflow.operators.analysis import LISTS, analyse_documents

CASES = {
    "award": ("낙찰자선정방법 : 적격심사제\n제안서 심사 결과는 별도 통보합니다.", {"award_evidence": ["낙찰자선정방법 : 적격심사제"]}),
    "items": (
        """1. 입찰 참가자격
ㅇ 정보시스템 감리법인으로 등록된 업체
ㅇ 최근 3년 이내 감리 실적을 보유한 업체
ㅇ 최근 3년 이내 감리 실적을 보유한 업체
2. 제출서류
구분 ･ 입찰참가신청서 1부 ･ 사업자등록증 사본 1부
3. 제출 및 문의처
ㅇ 제출처 : 서울시청 정보화담당관
ㅇ 접수기한 : 2026. 8. 31. 17:00까지 우편 또는 직접 제출
4. 공동수급
ㅇ 공동수급협정서는 입찰마감 전까지 제출해야 함""",
        {"qualifications": ["ㅇ 정보시스템 감리법인으로 등록된 업체", "ㅇ 최근 3년 이내 감리 실적을 보유한 업체"], "required_documents": ["입찰참가신청서 1부", "사업자등록증 사본 1부"],
         "submission_methods": ["ㅇ 접수기한 : 2026. 8. 31. 17:00까지 우편 또는 직접 제출"], "submission_deadlines": ["ㅇ 접수기한 : 2026. 8. 31. 17:00까지 우편 또는 직접 제출"], "joint_conditions": ["ㅇ 공동수급협정서는 입찰마감 전까지 제출해야 함"]}),
    "nothing": ("일반 안내 문장입니다.", {}),
    "noise": (
        """3. 입찰 참가자격
가. 정보시스템 감리법인(업종코드 6146)으로 입찰참가 등록한 업체
나. 중소기업 확인서를 보유한 소프트웨어사업자
4. 입찰보증금
낙찰자는 계약체결 시 인지세와 납세증명서를 제출하여야 합니다.
청렴계약 및 동반성장 지원사업 안내입니다.
5. 제출서류
· 1468 컴퓨터관련서비스사업
· 1426 패키지 소프트웨어 개발공급사업
· 사업자등록증 사본 1부
· 경쟁입찰참가자격등록증 1부
· 제안서 원본 및 USB 1부
· 계약상대자는 용역수행 결과물을 첨부하여 검사를 요청해야 함
담당자 이메일(bid@example.com)을 통한 사전접수
감사실 이메일(audit@example.com)을 통하여 비리 신고
전자입찰서 접수 마감일시 : 2026. 8. 20. 14:00
입찰마감일 전일까지 업종코드 6146으로 참가 등록한 업체
▢ 공동수급 및 하도급 제한
◦ 본 사업은 공동수급 허용하나 하도급은 불허함
◦ (공동수급) 본 사업은 공동이행방식 공동계약 허용
◦ 공동수급체 대표사는 업종코드 1468로 신고한 사업자이어야 함
◦ 공동수급체는 3개 이하, 구성원별 최소지분율 10% 이상이며 중복 구성은 불가함
◦ 공동수급 참여지분율 평가점수 배점표""",
        {"qualifications": ["가. 정보시스템 감리법인(업종코드 6146)으로 입찰참가 등록한 업체", "나. 중소기업 확인서를 보유한 소프트웨어사업자"], "required_documents": ["사업자등록증 사본 1부", "경쟁입찰참가자격등록증 1부", "제안서 원본", "USB 1부"],
         "submission_methods": ["담당자 이메일(bid@example.com)을 통한 사전접수"], "submission_deadlines": ["전자입찰서 접수 마감일시 : 2026. 8. 20. 14:00"],
         "joint_conditions": [
             "◦ 본 사업은 공동수급 허용하나 하도급은 불허함", "◦ (공동수급) 본 사업은 공동이행방식 공동계약 허용", "◦ 공동수급체 대표사는 업종코드 1468로 신고한 사업자이어야 함",
             "◦ 공동수급체는 3개 이하, 구성원별 최소지분율 10% 이상이며 중복 구성은 불가함"]}),
    "blanks": ("1. 입찰참가자격\nㅇ 정보시스템 감리법인으로 입찰 참가 등록한 업체\nㅇ 정보시스템 감리법인으로 입찰참가 등록한 업체\n2. 기타사항", {"qualifications": ["ㅇ 정보시스템 감리법인으로 입찰 참가 등록한 업체"]}),
    "table": (
        "구분제출서류 (사본의 경우 사실과 다르지 않음 표기)입찰서\n기타1- 사업자등록증 사본 1부\n· 1468 컴퓨터관련서비스사업\n· 1426 패키지 소프트웨어 개발공급사업\n7. 평가방법", {"required_documents": ["사업자등록증 사본 1부"]}),
    "period": (
        "전자입찰서 제출기간\n시작일시 : 2026. 7. 20. 10:00\n마감일시 : 2026. 7. 22. 12:00\n개찰일시 : 2026. 7. 22. 13:30\n입찰서 제출마감 문의 : 1588-0800",
        {"submission_deadlines": ["시작일시 : 2026. 7. 20. 10:00", "마감일시 : 2026. 7. 22. 12:00"]}),
    "spaced": (
        "전 자 입 찰 서 제 출 기 간 : 2026. 7. 20. 10:00 ~ 2026. 7. 22. 12:00\n정 부 조 달 콜 센 터 : 1588-0800", {"submission_deadlines": ["전 자 입 찰 서 제 출 기 간 : 2026. 7. 20. 10:00 ~ 2026. 7. 22. 12:00"]}),
    "methods": (
        """전자입찰서는 나라장터를 통하여 전자제출합니다.
제안서는 담당자 이메일을 통한 사전접수 후 제출합니다.
제안서는 방문 또는 우편 제출합니다.
입찰보증금 지급각서를 전자 제출한 것으로 갈음합니다.
계약상대자는 과업 산출물을 제출처에 납품합니다.
하도급지킴이 확약서를 온라인으로 제출합니다.
감사실 이메일로 비리 신고를 접수합니다.
제안서 제출 이후 과업 수행 결과물
제출처 : 안전관리실""",
        {"submission_methods": ["전자입찰서는 나라장터를 통하여 전자제출합니다.", "제안서는 담당자 이메일을 통한 사전접수 후 제출합니다.", "제안서는 방문 또는 우편 제출합니다."]}),
    "merged": (
        """5. 제출서류
구분 제출서류
사업자등록증 사본 1부 법인등기부등본 원본 1부 인감증명서 1부 사용인감계 1부
경쟁입찰참가자격등록증 1부 중소기업확인서 1부 직접생산확인증명서 1부
1468 컴퓨터관련서비스사업""",
        {"required_documents": ["사업자등록증 사본 1부", "법인등기부등본 원본 1부", "인감증명서 1부", "사용인감계 1부", "경쟁입찰참가자격등록증 1부", "중소기업확인서 1부", "직접생산확인증명서 1부"]}),
    "brackets": ("5. 제출서류\n법인등기부등본(개인사업자는 사업자등록증만 제출) 1부", {"required_documents": ["법인등기부등본(개인사업자는 사업자등록증만 제출) 1부"]}),
    "cells": ("전자입찰서 제출 마감일시\n2026/08/14 10:00\n2026/08/14 11:00", {"submission_deadlines": ["2026/08/14 10:00"]}),
    "joint": (
        """4. 공동수급
가. 공동이행방식으로 허용합니다.
나. 대표사는 업종코드 1468로 등록하여야 합니다.
다. 구성원은 3개사 이하이며 최소지분율은 10% 이상이어야 합니다.
라. 중복 구성은 금지하고 낙찰 후 구성원을 변경할 수 없습니다.
마. 공동수급협정서는 입찰마감 전까지 제출합니다.
5. 입찰보증금
공동수급체의 보증금은 발주기관에 귀속됩니다.
공동수급 구성원 전원은 상호 및 대표자가 다른 경우 변경등록하여야 합니다.""",
        {"joint_conditions": [
            "가. 공동이행방식으로 허용합니다.", "나. 대표사는 업종코드 1468로 등록하여야 합니다.", "다. 구성원은 3개사 이하이며 최소지분율은 10% 이상이어야 합니다.",
            "라. 중복 구성은 금지하고 낙찰 후 구성원을 변경할 수 없습니다.", "마. 공동수급협정서는 입찰마감 전까지 제출합니다."]}),
}


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(k, text, "x", "y") for k, (text, _) in CASES.items()] + [("blank", "   \n\n", "x", "y"), ("none", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, line string, section string").repartition(3)
    return {r.doc_id: r for r in analyse_documents(df, RULES).collect()}


@pytest.mark.parametrize("name", CASES)
def test_known_documents(analysed, name):
    got = analysed[name]
    want = CASES[name][1]
    for part in want if name in ("items", "noise", "table", "brackets", "merged") else LISTS:
        if name in ("award", "nothing", "blanks", "period", "spaced", "cells", "joint", "methods") and part not in want and want:
            continue
        assert got[part] == want.get(part, []), (name, part)
    assert got.status == "ANALYZED" and got.found == sum(len(got[p]) for p in LISTS)


def test_documents_without_lines_fail(analysed):
    for k in ("blank", "none"):
        assert analysed[k].status == "FAILED" and analysed[k].found == 0
    assert analysed["nothing"].found == 0


def test_long_documents_and_none(spark):
    text = "1. 입찰 참가자격\n" + "".join(f"ㅇ 감리법인 {i}번 업체\n계속되는 줄\n" for i in range(3000)) + "2. 기타사항"
    got = analyse_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), RULES).first()
    assert got.qualifications == [f"ㅇ 감리법인 {i}번 업체 계속되는 줄" for i in range(3000)]
    assert analyse_documents(spark.createDataFrame([], "doc_id long, text string"), RULES).count() == 0


def test_deadlines_equal_a_walk_through_the_lines(spark):
    """Random lines; the windows' rule against a plain walk."""
    r = random.Random(1)
    kinds = ["제출기한", "제안서 제출 마감 안내", "2026. 7. 20. 10:00", "마감 12:00", "제출 2026/8/1", "3. 다음", "개찰 11:00", "보통 줄", "납부기한 2026. 1. 1.", "1588-0800 10:00", "접수기간 : 2026. 3. 1."]
    docs = [(i, "\n".join(f"{r.choice(kinds)} {k}" for k in range(r.randrange(12)))) for i in range(200)]
    spec = RULES["deadlines"]
    has = lambda line, words: any(w in line for w in words)
    tight = lambda line, words: any("".join(w.split()) in "".join(line.split()) for w in words)
    moment = lambda line: re.search(RULES["date_or_time"], line) and not re.search(RULES["phone"], line)
    top = lambda line: re.match(RULES["top_level"], line)

    def walk(lines):
        kept = set()
        for i, line in enumerate(lines):
            if not tight(line, spec["headings"]) or has(line, spec["unless"]):
                continue
            if moment(line):
                if tight(line, spec["acts"]):
                    kept.add(i)
                continue
            for j in range(i + 1, min(i + 5, len(lines))):
                if top(lines[j]) or has(lines[j], spec["stops"]):
                    break
                if moment(lines[j]) and not has(lines[j], spec["unless"]):
                    kept.add(j)
                    if not tight(lines[j], spec["acts"] + spec["labels"]):
                        break
        return [lines[i] for i in sorted(kept)]

    got = {x.doc_id: x.submission_deadlines for x in analyse_documents(spark.createDataFrame(docs, "doc_id long, text string"), RULES).collect()}
    for i, text in docs:
        lines = [x for x in text.split("\n") if x]
        assert got[i] == walk(lines), text


def test_clauses_keep_their_digits_and_names_meet_in_any_letter_case(spark, tmp_path):
    import duckdb

    from noticeflow.plans.catalog import ORACLE_SQL, QUERIES

    texts = ["nothing to ration 500 ; to nation 11", "0 to ration; 1 to nation 1 ;  0 du eau", "then CIÓN uno ción; dos CIÓNtion ÜNGEN theAND ración", "the Ünction UNGEN ration • CIÓN nación"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["document_analysis"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["document_analysis"])
    columns = [c[0] for c in want.description]
    left = {r.doc_id: r for r in got.select(*columns).collect()}
    assert sorted(map(tuple, left.values())) == sorted(want.fetchall())
    assert left[0].joint_conditions == "nothing to ration 500\n; to nation 11"
    assert left[2].required_documents == "ción\nCIÓNtion ÜNGEN"
