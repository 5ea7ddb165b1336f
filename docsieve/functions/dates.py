"""Partial dates, month indexes, spans and tenure."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy.vocabulary import MONTHS, NUMBER_WORDS

DASH = r"\s*(?:-|–|—|to|until)\s*"
_NAMES = "|".join(m[:3] for m in MONTHS)
RANGE = re.compile(
    rf"(?:(?P<m1>{_NAMES})[a-z]*\.?\s+|(?P<n1>\d{{1,2}})\s*[/.]\s*)?(?P<y1>(?:19|20)\d\d)(?:-(?P<i1>\d\d))?{DASH}"
    rf"(?:(?:(?P<m2>{_NAMES})[a-z]*\.?\s+|(?P<n2>\d{{1,2}})\s*[/.]\s*)?(?P<y2>(?:19|20)\d\d)(?:-(?P<i2>\d\d))?|(?P<open>present|now|current|today|ongoing))",
    re.I,
)
SINCE = re.compile(rf"since\s+(?:(?P<m1>{_NAMES})[a-z]*\.?\s+)?(?P<y1>(?:19|20)\d\d)", re.I)
RANGE_SCHEMA = "start struct<year:int,month:int>, end struct<year:int,month:int>, current boolean"


def month_index(year: Column, month: Column, fallback: int) -> Column:
    """Months since year 0: a start without a month counts from January (1), an end to December (12)."""
    return year * 12 + F.coalesce(month, F.lit(fallback)) - 1


def span_months(start: Column, end: Column) -> Column:
    """Months of a span whose two ends count, never below 0."""
    return F.greatest(end - start + 1, F.lit(0))


def format_tenure(months: Column) -> Column:
    m = F.greatest(months, F.lit(0))
    years, rest = F.floor(m / 12), m % 12
    return F.when(years == 0, F.concat(rest.cast("string"), F.lit(" mo"))).when(rest == 0, F.concat(years.cast("string"), F.lit(" yr"))).otherwise(F.concat(years.cast("string"), F.lit(" yr "), rest.cast("string"), F.lit(" mo")))


def date_family(text: Column) -> Column:
    """How a date is written: by name, MM/YYYY, YYYY-MM or a bare year."""
    names = "|".join(m[:3] for m in MONTHS)
    return (
        F.when(F.regexp_like(F.lower(text), F.lit(rf"\b(?:{names})[a-z]*\.? +(?:19|20)[0-9]{{2}}")), "named").when(F.regexp_like(text, F.lit(r"\b[0-9]{1,2}[/.](?:19|20)[0-9]{2}")), "numeric")
        .when(F.regexp_like(text, F.lit(r"\b(?:19|20)[0-9]{2}-[0-9]{2}\b")), "iso").when(F.regexp_like(text, F.lit(r"\b(?:19|20)[0-9]{2}\b")), "year")
    )


def parse_date(text: Column, order: str = "DMY") -> Column:
    """A written date as (year, month): ISO, named, numeric by the order unless a part above 12 tells, or a bare year."""
    low = F.lower(F.trim(text))
    iso_year, iso_month = (F.regexp_extract(low, r"^((?:19|20)[0-9]{2})-([0-9]{1,2})(?:-[0-9]{1,2})?$", k) for k in (1, 2))
    named_month, named_year = (F.regexp_extract(low, rf"^(?:[0-9]{{1,2}}\.? )?({_NAMES})[a-z]*\.?,? (?:[0-9]{{1,2}},? )?((?:19|20)[0-9]{{2}})$", k) for k in (1, 2))
    short_month, short_year = (F.regexp_extract(low, r"^([0-9]{1,2})[/.]((?:19|20)[0-9]{2})$", k) for k in (1, 2))
    a, b, full_year = (F.regexp_extract(low, r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]((?:19|20)[0-9]{2})$", k) for k in (1, 2, 3))
    first, second = a.try_cast("int"), b.try_cast("int")
    full_month = F.when(first > 12, second).when(second > 12, first).otherwise(second if order == "DMY" else first)
    year = F.regexp_extract(low, r"^((?:19|20)[0-9]{2})$", 1)
    number = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        number = F.when(named_month == m[:3], F.lit(i)).otherwise(number)
    made = lambda y, m: F.struct(y.try_cast("int").alias("year"), F.when(m.between(1, 12), m).alias("month"))
    return (
        F.when(iso_year != "", made(iso_year, iso_month.try_cast("int"))).when(named_year != "", made(named_year, number)).when(short_year != "", made(short_year, short_month.try_cast("int")))
        .when(full_year != "", made(full_year, full_month)).when(year != "", made(year, F.lit(None).cast("int")))
    )


def full_year(two: Column, latest: int) -> Column:
    """The century of a two-digit year: the last one that does not pass ``latest``."""
    year = F.lit(latest - latest % 100) + two
    return F.when(year > latest, year - 100).otherwise(year)


def written_years(text: Column) -> Column:
    """The years that a text states, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))))


def years_asked(text: Column) -> Column:
    """How many years a line asks for: digits or a number word, the lower end of a range."""
    low = F.lower(text)
    digits = F.regexp_extract(low, r"(?:^|[^0-9a-z])([0-9]{1,2})\+? *(?:(?:-|–|to) *[0-9]{1,2}\+? *)?(?:years|yrs)(?:$|[^a-z])", 1)
    word = F.regexp_extract(low, rf"(?:^|[^a-z])({'|'.join(NUMBER_WORDS)}) +(?:years|yrs)(?:$|[^a-z])", 1)
    named = F.lit(None).cast("int")
    for w, n in NUMBER_WORDS.items():
        named = F.when(word == w, F.lit(n)).otherwise(named)
    return F.coalesce(F.when(digits != "", digits.cast("int")), named)


def tenure(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Months covered by a key's spans, overlaps once: running ends tell the islands, which are summed."""
    clean = spans.filter(F.col(start).isNotNull()).select(key, F.col(start).alias("s"), F.greatest(F.coalesce(end, start), F.col(start)).alias("e"))
    order = Window.partitionBy(key).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(before + 1, F.col("s"))) + 1)
    return clean.withColumn("fresh", fresh).groupBy(key).agg(F.sum("fresh").cast("long").alias("months"))


def overlapping(spans: DataFrame, key: str, start: str, end: str, more_than: int) -> DataFrame:
    """Months in which a key has more than so many spans: +1 at a start, -1 after an end, running sum. No month is made a row."""
    events = spans.select(key, F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(spans.select(key, (F.col(end) + 1).alias("at"), F.lit(-1).alias("d"))).groupBy(key, "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy(key).orderBy("at")
    level = events.withColumn("open", F.sum("d").over(order)).withColumn("until", F.lead("at").over(order))
    return level.filter(F.col("open") > more_than).groupBy(key).agg(F.sum(F.col("until") - F.col("at")).cast("long").alias("months"), F.max("open").cast("long").alias("most"))


def parse_month(name: str | None, number: str | None) -> int | None:
    if name:
        return [m[:3] for m in MONTHS].index(name[:3].lower()) + 1
    return int(number) if number and 1 <= int(number) <= 12 else None


def find_range(line: str, latest: int) -> dict | None:
    """The first plausible range of a line; years from 1950 to ``latest`` and no end before its start."""
    for m in RANGE.finditer(line):
        g = m.groupdict()
        start = {"year": int(g["y1"]), "month": parse_month(g["m1"], g["n1"] or g["i1"])}
        end = None if g["open"] else {"year": int(g["y2"]), "month": parse_month(g["m2"], g["n2"] or g["i2"])}
        if not 1950 <= start["year"] <= latest or end and (not 1950 <= end["year"] <= latest or (end["year"], end["month"] or 12) < (start["year"], start["month"] or 1)):
            continue
        return {"start": start, "end": end, "current": bool(g["open"])}
    m = SINCE.search(line)
    if m and 1950 <= int(m["y1"]) <= latest:
        return {"start": {"year": int(m["y1"]), "month": parse_month(m["m1"], None)}, "end": None, "current": True}
    return None


def date_ranges(latest: int):
    """A vectorised function of a line: its first date range."""

    @F.pandas_udf(RANGE_SCHEMA)
    def run(lines: pd.Series) -> pd.DataFrame:
        found = [find_range(x, latest) if x else None for x in lines]
        return pd.DataFrame({k: [f and f[k] for f in found] for k in ("start", "end", "current")})

    return run
