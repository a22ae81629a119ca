"""Column functions on hand-made values."""

import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import dates, hashing, pyudf, text, urls

D = dt.date


def val(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text(spark):
    v = lambda c: val(spark, c)
    assert v(text.java_trim(F.lit("\t a b \n"))) == "a b"
    assert v(text.squeeze(F.lit(" A\tb C"))) == "ab c"
    assert v(text.collapse(F.lit("  a   b\n"))) == "a b" and v(text.collapse(F.lit(None).cast("string"))) == ""
    assert v(text.clean_cell(F.lit("  \t"))) is None and v(text.first_non_blank(F.lit(" "), F.lit(" x "))) == "x"
    assert v(text.join_distinct(F.lit("b"), F.lit(" a "), F.lit("b"), F.lit(None).cast("string"), F.lit(""))) == "b, a"
    assert v(text.before_last(F.lit("a.b*c"), ".")) == "a" and v(text.before_last(F.lit("a||b||c"), "||")) == "a||b" and v(text.before_last(F.lit("/a"))) == ""
    assert v(text.before_last(F.lit("a/b/c"))) == "a/b" and v(text.before_last(F.lit("abc"))) == "abc" and v(text.after_last(F.lit("a/b"))) == "b"
    assert v(text.file_extension(F.lit("a.b.PDF"))) == "pdf" and v(text.file_extension(F.lit("none"))) == ""
    assert v(text.safe_file_name(F.lit('a/b:c*..d.. '))) == "a_b_c__d_"
    assert v(text.abbreviate(F.lit("abcdefgh"), 6, dots=True)) == "abc..." and v(text.abbreviate(F.lit("abc"), 6, dots=True)) == "abc"
    assert [v(text.yes_no(F.lit(x))) for x in ("예", " N ", "?")] == ["Y", "N", None]
    assert v(text.redact(F.lit("u?serviceKey=ab%3D&x=1"))) == "u?serviceKey=[REDACTED]&x=1"
    assert v(text.four_digit_codes(F.lit("1468 6146,12345 1468(0001)"))) == ["1468", "6146", "0001"]
    assert v(text.longest_first(F.lit("개인정보 영향평가"), ["영향평가", "개인정보 영향평가", "개인"])) == ["개인정보 영향평가"]
    assert v(text.email_key(F.lit(" A@B.kr "))) == "a@b.kr" and v(text.email_key(F.lit("a\n@b"))) is None
    assert v(text.rounded_percent(F.lit(1), F.lit(8))) == 13 and v(text.rounded_percent(F.lit(1), F.lit(0))) == 0 and v(text.page_count(F.lit(41), 20)) == 3
    assert v(text.contains_any(F.lit(None).cast("string"), ["a"])) is False and v(text.contains_all(F.lit("50%_x"), ["%_", "X"])) is True
    assert v(text.clean_list(F.array(F.array(F.lit(" a "), F.lit("")), F.array(F.lit("a"), F.lit("b"))))) == ["a", "b"]


def test_urls(spark):
    v = lambda c: val(spark, c)
    assert v(urls.extract_urls(F.lit("see https://a.go.kr/x?y=1. and (http://b.com), https://a.go.kr/x?y=1"), ["b.com"])) == ["https://a.go.kr/x?y=1"]
    assert v(urls.is_host(F.lit("https://www.notice.go.kr/x"), ["notice.go.kr"])) and not v(urls.is_host(F.lit("https://notnotice.go.kr"), ["notice.go.kr"])) and not v(urls.is_host(F.lit("::bad"), ["x"]))
    assert v(urls.url_pattern(F.lit("https://a.kr/n/123/4?id=55&q=x"))) == "https://a.kr/n/{key}/4?id={value}&q={value}"
    assert v(urls.match_template(F.lit("https://a.kr/v/77?x=1"), "https://a.kr/v/{id}?x={x}")) == {"id": "77", "x": "1"} and v(urls.match_template(F.lit("https://b"), "https://a.kr/{id}")) is None
    assert v(urls.fill_template("https://a.kr/{id}/z", F.create_map(F.lit("id"), F.lit("9")))) == "https://a.kr/9/z" and v(urls.fill_template("{no}", F.create_map(F.lit("id"), F.lit("9")))) is None
    assert v(pyudf.canonical_url(F.lit("HTTPS://Exaämple.COM:443/a#f"))) == "https://" + "exaämple.com".encode("idna").decode() + "/a" and v(pyudf.canonical_url(F.lit("http://192.168.0.1/"))) is None and v(pyudf.canonical_url(F.lit("ftp://a.b"))) is None


def test_hashes(spark):
    v = lambda c: val(spark, c)
    assert v(hashing.utf16_length(F.lit("a\U0001f600"))) == 3
    assert v(hashing.fingerprint([F.lit("a"), F.lit(None).cast("string")])) == hashlib.sha256(b"1:a0:").hexdigest()
    assert v(hashing.fingerprint([F.lit("ab"), F.lit("c")])) != v(hashing.fingerprint([F.lit("a"), F.lit("bc")]))
    assert v(hashing.fingerprint([], [F.array(F.lit("y"), F.lit("x"))])) == v(hashing.fingerprint([], [F.array(F.lit("x"), F.lit("y"))]))
    assert v(hashing.content_hash([("t", F.lit("x"))], [("l", F.array(F.lit("b"), F.lit("a")))])) == hashlib.sha256(b"1:t=1:x\n4:l[0]=1:a\n4:l[1]=1:b\n").hexdigest()
    raw = bytearray(hashlib.md5(b"o\0c\0p").digest())
    raw[6], raw[8] = raw[6] & 15 | 0x30, raw[8] & 63 | 0x80
    assert v(hashing.name_uuid(F.lit("o"), F.lit("c"), F.lit("p"))) == str(uuid.UUID(bytes=bytes(raw)))
    assert v(hashing.valid_digest(F.lit("A" * 64))) == "a" * 64 and v(hashing.valid_digest(F.lit("x"))) is None


@pytest.mark.parametrize(("raw", "want"), [
    ("2024-03-05T10:11:12+09:00", dt.datetime(2024, 3, 5, 10, 11, 12)), ("2024-03-05T10:11:12", dt.datetime(2024, 3, 5, 10, 11, 12)), ("2024-03-05 10:11:12", dt.datetime(2024, 3, 5, 10, 11, 12)),
    ("2024-03-05 10:11", dt.datetime(2024, 3, 5, 10, 11)), ("2024/03/05 10:11", dt.datetime(2024, 3, 5, 10, 11)), ("20240305101112", dt.datetime(2024, 3, 5, 10, 11, 12)), ("202403051011", dt.datetime(2024, 3, 5, 10, 11)),
    ("2024-03-05", dt.datetime(2024, 3, 5)), ("20240305", dt.datetime(2024, 3, 5)), ("2024-02-30", None), ("-", None), (" ", None), (None, None)])
def test_wall_clock_formats(spark, raw, want):
    found = val(spark, dates.parse_or_reject(F.lit(raw).cast("string")))
    assert found.value == want and found.rejected == (raw if raw in ("2024-02-30", "-") else None)


def test_dates(spark):
    v = lambda c: val(spark, c)
    day = lambda s: F.lit(s).cast("date")
    assert v(dates.parse_lenient(F.lit("마감 후 공개"), ["마감 후"])) is None
    assert v(dates.pair_time(F.lit("20240102"), F.lit("0930"))) == dt.datetime(2024, 1, 2, 9, 30) and v(dates.pair_time(F.lit("00000000"), F.lit(""))) is None
    assert v(dates.latest_date_in_name(F.lit("증명_2023.1.2_20240229_2024-13-01.pdf"))) == D(2024, 2, 29)
    status = lambda p, **k: v(dates.period_status(F.lit(p), day("2024-06-15"), **k))
    assert status("2023.01 ~ 2024.05") == "COMPLETED" and status("2023.01 ~ 2024.06") == "ONGOING" and status("2023.01.01 ~ 현재") == "ONGOING" and status("2023.01.01") == "UNKNOWN"
    assert status("x", explicit=F.lit("완료")) == "완료"
    chunks = v(dates.month_chunks(day("2024-01-31"), day("2024-03-30")))
    assert [tuple(c) for c in chunks] == [(D(2024, 1, 31), D(2024, 2, 28)), (D(2024, 2, 29), D(2024, 3, 28)), (D(2024, 3, 29), D(2024, 3, 30))]
    assert [v(dates.deadline_label(day(x), day("2024-06-15"))) for x in ("2024-06-15", "2024-06-18", "2024-06-13")] == ["D-DAY", "D-3", "D+2"]
    fresh = lambda p, i, m, e: v(dates.freshness(F.lit(p), day(i), F.lit(m), day(e), day("2024-06-15")))
    assert fresh("PERIODIC", "2024-04-01", 3, None) == "VALID" and fresh("PERIODIC", "2024-03-15", 3, None) == "EXPIRED" and fresh("EXPIRATION", None, 0, "2024-07-01") == "EXPIRING_SOON"
    assert fresh("EXPIRATION", None, 0, None) == "NO_DATE" and fresh("NONE", None, 0, None) == "NOT_REQUIRED"


def test_batch_functions(spark):
    v = lambda c: val(spark, c)
    assert v(pyudf.compact_nfkc(F.lit("ＡＢ (주)①x"))) == "ab주1x"
    split = pyudf.split_items("•", ["가.", "나."])
    assert v(split(F.lit("• 첫째 (가. 안) • 둘째 나. 셋째"))) == ["첫째 (가. 안)", "둘째", "나. 셋째"]
    name = pyudf.person_name(["이력서", "재직증명서"], set("김이박"))
    assert v(name(F.lit("재직증명서_김철수_2024.pdf"))) == "김철수" and v(name(F.lit("김철수_박영희.pdf"))) is None
