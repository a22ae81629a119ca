"""Column functions over dates. "Today" is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions.text import java_trim

#: Accepted renderings, in order.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyy-MM-dd", "yyyyMMdd")
_DATE = r"(?<!\d)(20\d{2})[.\-/년 ]{0,2}(\d{1,2})[.\-/월 ]{0,2}(\d{1,2})(?!\d)"


def parse_wall_clock(x: Column, formats: Sequence[str] = FORMATS) -> Column:
    """The first format that fits, as a time without zone; an offset is dropped, not converted."""
    local = F.regexp_replace(java_trim(x), r"^(\d{4}-\d{2}-\d{2}T[\d:.]+)(?:Z|[+-]\d{2}:?\d{2})$", "$1")
    return F.coalesce(*[F.try_to_timestamp(local, F.lit(f)).cast("timestamp_ntz") for f in formats])


def parse_or_reject(x: Column, formats: Sequence[str] = FORMATS) -> Column:
    """struct(value, rejected): the raw text where nothing fits."""
    value = parse_wall_clock(x, formats)
    given = F.nullif(java_trim(x), F.lit("")).isNotNull()
    return F.struct(value.alias("value"), F.when(given & value.isNull(), x).alias("rejected"))


def parse_lenient(x: Column, open_phrases: Sequence[str] = (), formats: Sequence[str] = FORMATS) -> Column:
    """Null for phrases that name no time, for "-", zeros and what does not fit."""
    empty = java_trim(x).isin("", "-", "00000000")
    for p in open_phrases:
        empty = empty | F.contains(x, F.lit(p))
    return F.when(~empty, parse_wall_clock(x, formats))


def pair_time(date: Column, time: Column) -> Column:
    """A date of eight digits and a time of four or six as one time; zeros and blanks give null."""
    d, t = java_trim(date), F.rpad(F.coalesce(F.nullif(java_trim(time), F.lit("")), F.lit("0")), 6, "0")
    return F.when(~d.isin("", "00000000"), F.try_to_timestamp(F.concat(d, t), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def latest_date_in_name(name: Column) -> Column:
    """The latest valid date written in a file name."""
    parts = [F.regexp_extract_all(name, F.lit(_DATE), F.lit(i)) for i in (1, 2, 3)]
    dates = F.transform(F.arrays_zip(*[p.alias(a) for p, a in zip(parts, "ymd")]), lambda z: F.try_to_timestamp(F.concat_ws("-", z["y"], F.lpad(z["m"], 2, "0"), F.lpad(z["d"], 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))
    return F.array_max(F.filter(dates, lambda d: d.isNotNull()))


def period_status(period: Column, today: Column, explicit: Column | None = None, ongoing_words: Sequence[str] = ("현재", "진행", "ongoing")) -> Column:
    """COMPLETED, ONGOING or UNKNOWN of a written period: an explicit status, then words for ongoing, then exactly
    two dates; a date of year and month ends with its month."""
    found = F.regexp_extract_all(period, F.lit(r"(20\d{2}[.\-/]\d{1,2}(?:[.\-/]\d{1,2})?)"), F.lit(1))
    last = F.regexp_replace(F.get(found, F.lit(1)), r"[./]", "-")
    end = F.when(last.rlike(r"^\d{4}-\d{1,2}$"), F.last_day(F.try_to_timestamp(last, F.lit("yyyy-M")).cast("date"))).otherwise(F.try_to_timestamp(last, F.lit("yyyy-M-d")).cast("date"))
    ongoing = F.lit(False)
    for w in ongoing_words:
        ongoing = ongoing | F.contains(period, F.lit(w))
    out = F.when(ongoing, "ONGOING").when((F.size(found) == 2) & end.isNotNull(), F.when(end < today, "COMPLETED").otherwise("ONGOING")).otherwise("UNKNOWN")
    return out if explicit is None else F.coalesce(F.nullif(java_trim(explicit), F.lit("")), out)


def month_chunks(start: Column, end: Column) -> Column:
    """array<struct<first, last>>: [d, d + 1 month - 1 day] steps that cover start to end, each month counted from the
    step before."""
    most = F.ceil(F.months_between(end, start)).cast("int") + 1
    starts = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.array(start), lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), 1))))
    return F.transform(F.filter(starts, lambda d: d <= end), lambda d: F.struct(d.alias("first"), F.least(F.date_sub(F.add_months(d, 1), 1), end).alias("last")))


def days_left(deadline: Column, today: Column) -> Column:
    return F.datediff(deadline, today)


def deadline_label(deadline: Column, today: Column) -> Column:
    """D-3, D-DAY, D+2; null without deadline."""
    n = days_left(deadline, today)
    return F.when(n == 0, "D-DAY").when(n > 0, F.concat(F.lit("D-"), n.cast("string"))).when(n < 0, F.concat(F.lit("D+"), (-n).cast("string")))


def freshness(policy: Column, issued: Column, months: Column, expires: Column, today: Column, soon_days: int = 30) -> Column:
    """VALID, EXPIRING_SOON, EXPIRED, NO_DATE or NOT_REQUIRED by policy NONE, PERIODIC or EXPIRATION."""
    periodic = F.when(issued.isNull(), "NO_DATE").when(F.add_months(issued, months) > today, "VALID").otherwise("EXPIRED")
    expiry = F.when(expires.isNull(), "NO_DATE").when(expires < today, "EXPIRED").when(expires <= F.date_add(today, soon_days), "EXPIRING_SOON").otherwise("VALID")
    return F.when(policy == "PERIODIC", periodic).when(policy == "EXPIRATION", expiry).otherwise("NOT_REQUIRED")
