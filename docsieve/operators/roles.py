"""Signals of dated blocks: bullets by role, tense, ways of writing dates, and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..policy import vocabulary as V
from . import segment as S

# Readable numbers of bullets, roles at once and for how long, and the longest career, in months.
FEWEST, MOST, AT_ONCE, FOR_MONTHS, CAREER = 2, 8, 2, 3, 600
OPEN = r"(?i)present|now|current|today|ongoing"


def blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of dated blocks: role_no from 1, whether the line is the dated one, a bullet, and whether the role goes on."""
    numbered = S.role_blocks(rows, key).filter("role_no > 0")
    current = F.max(F.when(F.col("dated"), F.regexp_like("line", F.lit(OPEN)).cast("int"))).over(Window.partitionBy(key, "role_no")) == 1
    return numbered.withColumn("current", current).withColumn("bullet", F.regexp_like("line", F.lit(T.BULLET + r"\S")))


def bullets_per_role(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, bulletsPerRole: roles with fewer than two or more than eight bullets; roles with none are left out."""
    n = blocks(rows, key).groupBy(key, "role_no").agg(F.count_if("bullet").alias("n")).filter("n > 0")
    return n.groupBy(key).agg(F.count_if(~F.col("n").between(FEWEST, MOST)).cast("double").alias("bulletsPerRole"))


def tense_mismatches(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, tenseMismatches: bullets of roles that are over which open with a verb in the present, by two word lists."""
    present, past = (F.array(*[F.lit(w) for w in ws]) for ws in (V.PRESENT, V.VERBS))
    word = F.get(T.words(T.unbullet(F.col("line"))), F.lit(0))
    off = ~F.col("current") & F.col("bullet") & F.array_contains(present, word) & ~F.array_contains(past, word)
    return blocks(rows, key).groupBy(key).agg(F.count_if(F.coalesce(off, F.lit(False))).cast("double").alias("tenseMismatches"))


def date_formats(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, dateFormats: in how many ways the dates of at least two roles are written."""
    dated = blocks(rows, key).filter("dated").withColumn("family", D.date_family(F.col("line")))
    return dated.groupBy(key).agg(F.count(F.lit(1)).alias("roles"), F.count_distinct("family").cast("double").alias("dateFormats")).filter("roles >= 2").select(key, "dateFormats")


def timeline_issues(roles: DataFrame, now_month: int, key: str = "doc_id", experience: DataFrame | None = None) -> DataFrame:
    """key, timelineIssues: starts in the future, more than two roles at once for three months, a career over fifty years. roles: key, start, end in months; experience: key, months, if counted already."""
    future = roles.groupBy(key).agg(F.count_if(F.col("start") > now_month).alias("future"))
    held = roles.filter(F.col("start") <= now_month).withColumn("end", F.least(F.coalesce("end", F.lit(now_month)), F.lit(now_month)))
    crowd = D.overlapping(held.filter("end >= start"), key, "start", "end", AT_ONCE).select(key, (F.col("months") >= FOR_MONTHS).cast("int").alias("crowded"))
    career = (D.tenure(held, key, "start", "end") if experience is None else experience).select(key, (F.col("months") > CAREER).cast("int").alias("long"))
    out = future.join(crowd, key, "left").join(career, key, "left")
    return out.select(key, (F.col("future") + F.coalesce("crowded", F.lit(0)) + F.coalesce("long", F.lit(0))).cast("double").alias("timelineIssues"))


def birth_stated(text: Column) -> Column:
    """A date of birth: its label, then a date within forty characters."""
    return F.regexp_like(text, F.lit(r"(?i)(?:date of birth|born on|d\.o\.b\.?|\bdob\b|geburtsdatum|date de naissance|fecha de nacimiento)[^\n]{0,40}?(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}|(?:19|20)[0-9]{2})"))


def letter_joined(line: Column) -> Column:
    """A letter-spaced heading as a word; two spaces or more part words."""
    spaced = F.regexp_like(line, F.lit(r"^(?:\p{Lu} {1,3}){3,}\p{Lu}$"))
    joined = F.replace(F.regexp_replace(F.regexp_replace(line, r" {2,}", "\t"), r"(\p{Lu}) (?=\p{Lu})", "$1"), F.lit("\t"), F.lit(" "))
    return F.when(spaced, joined).otherwise(line)


def contact_lines(rows: DataFrame, most_words: int = 40) -> DataFrame:
    """Lines with an email address or a phone number, at most forty words long."""
    return rows.filter((F.regexp_like("line", F.lit(T.EMAIL)) | F.regexp_like("line", F.lit(T.PHONE))) & (S.word_count(F.col("line")) <= most_words))


def offer_line(line: Column) -> Column:
    """What a posting offers rather than asks: money beside a word of pay, or a label of it."""
    return F.regexp_like(line, F.lit(r"(?i)^\s*(?:salary|compensation|pay range|benefits)\s*:|[$€£]\s?[0-9][0-9.,]*k?.{0,60}(?:salary|per year|annually|bonus)|(?:salary|pay).{0,40}[$€£]\s?[0-9]"))


def citation_line(line: Column, least: int = 2) -> Column:
    """At least two signs of a citation: a year in brackets, 'et al.', a DOI, pages or a volume."""
    signs = (r"\((?:19|20)[0-9]{2}\)", r"(?i)\bet al\b", r"(?i)\bdoi\b|10\.[0-9]{4,}/", r"(?i)\bpp?\. ?[0-9]+|\bvol\. ?[0-9]+|[0-9]+\([0-9]+\):[0-9]+")
    return sum((F.regexp_like(line, F.lit(s)).cast("int") for s in signs), F.lit(0)) >= least


def with_headings(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of sections with their heading's text."""
    segmented = S.sections(rows, key)
    return segmented.withColumn("heading_text", F.first("line").over(Window.partitionBy(key, "section_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
