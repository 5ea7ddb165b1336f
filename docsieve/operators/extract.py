"""Recovered fields: built-in expressions for contact details and levels, one vectorised pass for order-bound parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..policy import vocabulary as V

DATE = "struct<year:int,month:int>"
PARSED = (
    f"doc_id long, name string, email string, phone string, links array<string>, roles array<struct<title:string,employer:string,start:{DATE},end:{DATE},current:boolean>>, "
    f"education array<struct<school:string,credential:string,isced:int,end:{DATE}>>, skills array<string>, certifications array<struct<name:string,issuer:string,date:{DATE}>>, "
    "spoken_languages array<struct<language:string,level:string,cefr:string>>"
)
# How many of each field a record holds.
LIMITS = {"links": 10, "roles": 20, "education": 10, "skills": 60, "certifications": 20, "spoken_languages": 15}
TITLES = "engineer developer manager director analyst designer nurse teacher assistant consultant officer architect scientist lead head chief clerk accountant specialist coordinator administrator technician intern".split()
SCHOOLS = r"universit|college|school|institut|academy|hochschule|école|escuela"
LANGUAGES = "english german french spanish italian portuguese hindi chinese japanese russian arabic dutch polish turkish".split()
PLACE = re.compile(r"\s*[,(]?\s*\b(?:remote|hybrid|on-?site)\b\)?\s*$", re.I)


def degree_level(line: Column) -> Column:
    """The highest level a line names."""
    low = F.lower(line)
    out = None
    for level, pattern in V.DEGREES:
        test = F.regexp_like(low, F.lit(pattern))
        out = F.when(test, level) if out is None else out.when(test, level)
    return out


def split_skills(line: Column) -> Column:
    """Parts of a list outside brackets, without its label, distinct."""
    bare = F.regexp_replace(F.regexp_replace(T.unbullet(line), r"^[\p{L} &/]{2,30}:\s*", ""), r"\([^()]*\)", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, r"[,;|•·]|\s{2,}"), lambda x: F.regexp_replace(F.trim(x), r"[.]+$", "")), lambda x: (F.length(x) > 0) & (F.length(x) <= 60)))


def drop_leave(rows: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose whole title is not time off."""
    return rows.filter(~F.lower(F.trim(title)).isin(list(V.LEAVE)))


def cefr(level: Column) -> Column:
    """The common level of a level's words, or the level itself if it is one."""
    known = F.create_map(*[x for k, v in V.LEVEL_WORDS.items() for x in (F.lit(k), F.lit(v))])
    up = F.upper(F.trim(level))
    return F.when(up.isin(list(V.CEFR)), up).otherwise(known[F.lower(F.trim(level))])


def cefr_rank(level: Column) -> Column:
    return F.create_map(*[x for i, v in enumerate(V.CEFR) for x in (F.lit(v), F.lit(i))])[level]


def _heading(line: str) -> str | None:
    if len(line) > 80 or len(line.split()) > 8 or line[-1:] in ".,;":
        return None
    for kind, pattern in V.HEADINGS:
        if re.fullmatch(rf"(?:my |work |professional |key |core )?(?:{pattern})(?: (?:and|&) [a-z]+)?:?", line.lower()):
            return kind
    return None


def _name(lines: list[str]) -> str | None:
    """The first of six lines that is two to five capitalised words and holds no digit, address or title word."""
    for line in lines[:6]:
        words = re.sub(r",\s*(?:PhD|MBA|MD|CPA|PMP)\b.*", "", line).split()
        if 2 <= len(words) <= 5 and not re.search(r"[\d@/|:]", line) and not _heading(line) and not {w.lower().strip(",") for w in words} & set(TITLES):
            if all(re.match(r"[^\W\d_a-z]", w) or w.lower() in ("de", "da", "von", "van", "la", "bin", "al", "del") for w in words):
                return " ".join(words)
    return None


def _split_role(text: str) -> tuple[str | None, str | None]:
    """Title and employer: by a separator or 'at', the side with a title word first."""
    text = PLACE.sub("", text.strip(" \t,|–—-·")).strip(" \t,|–—-·")
    if not text:
        return None, None
    parts = [p.strip() for p in re.split(r"\s+(?:at|bei|chez|@)\s+|\s*[|·\t]\s*|\s+[–—-]\s+|,\s+", text) if p.strip()]
    named = [i for i, p in enumerate(parts) if {w.lower().strip(".,") for w in p.split()} & set(TITLES)]
    if named:
        i = named[0]
        other = [p for j, p in enumerate(parts) if j != i]
        return parts[i], other[0] if other else None
    return (parts[0], parts[1]) if len(parts) > 1 else (None, parts[0])


def _roles(lines: list[str], latest: int) -> list[dict]:
    """A row for each dated line; what the line lacks comes from the line above, then from the one below."""
    out = []
    used = set()
    for i, line in enumerate(lines):
        found = D.find_range(line, latest)
        if not found:
            continue
        m = D.RANGE.search(line) or D.SINCE.search(line)
        rest = re.sub(r"\(\s*\)", "", line[: m.start()] + " " + line[m.end() :])
        if rest.strip(" \t,|–—-·").lower() in V.LEAVE:
            continue
        title, employer = _split_role(rest)
        for j in (i - 1, i - 2, i + 1):
            if title and employer:
                break
            if not 0 <= j < len(lines) or j in used or re.match(T.BULLET + r"\S", lines[j]) or len(lines[j].split()) > 9 or D.find_range(lines[j], latest):
                continue
            a, b = _split_role(lines[j])
            if title is None and a:
                title, used = a, used | {j}
            if employer is None and (b or a) and (b or a) != title:
                employer, used = b or a, used | {j}
        if title and title.lower() in V.LEAVE:
            continue
        out.append({"title": title, "employer": employer, **found})
    return out


def _education(lines: list[str], latest: int) -> list[dict]:
    out: list[dict] = []
    for line in lines:
        level = next((n for n, p in V.DEGREES if re.search(p, line.lower())), None)
        school = next((p.strip() for p in re.split(r",|\||–|—| - ", line) if re.search(SCHOOLS, p, re.I)), None)
        years = [int(y) for y in re.findall(r"(?:19|20)\d\d", line) if 1950 <= int(y) <= latest + 6]
        end = {"year": max(years), "month": None} if years else None
        credential = next((p.strip() for p in re.split(r",\s|\||–|—| - ", line) if any(re.search(x, p.lower()) for _, x in V.DEGREES)), None)
        if out and (level is None or school is None) and (level is None) != (out[-1]["isced"] is None):
            last = out[-1]
            out[-1] = {"school": last["school"] or school, "credential": last["credential"] or credential, "isced": last["isced"] or level, "end": last["end"] or end}
        elif level is not None or school:
            out.append({"school": school, "credential": credential, "isced": level, "end": end})
        elif out and end and not out[-1]["end"]:
            out[-1]["end"] = end
    return out


def _certifications(lines: list[str]) -> list[dict]:
    """name, issuer, date; of rows with one name the latest stays."""
    best: dict[str, dict] = {}
    for line in lines:
        text = re.sub(T.BULLET, "", line)
        year = re.search(r"(?:19|20)\d\d", text)
        parts = [p.strip(" ()") for p in re.split(r"\s+[–—-]\s+|,\s+|\|", re.sub(r"\(?(?:19|20)\d\d\)?", "", text)) if p.strip(" ()")]
        if parts:
            row = {"name": parts[0], "issuer": parts[1] if len(parts) > 1 else None, "date": {"year": int(year[0]), "month": None} if year else None}
            held = best.get(parts[0].lower())
            if held is None or (row["date"] or {"year": 0})["year"] > (held["date"] or {"year": 0})["year"]:
                best[parts[0].lower()] = row
    return list(best.values())


def _languages(lines: list[str]) -> list[dict]:
    out = {}
    for part in (p for line in lines for p in re.split(r"[,;|•]", line)):
        low = part.lower()
        name = next((x for x in LANGUAGES if re.search(rf"\b{x}\b", low)), None)
        if name and name not in out:
            level = next((w for w in V.LEVEL_WORDS if re.search(rf"\b{w}\b", low)), None)
            exact = re.search(r"\b([abc][12])\b", low)
            out[name] = {"language": name.capitalize(), "level": level, "cefr": exact[1].upper() if exact else V.LEVEL_WORDS.get(level)}
    return list(out.values())


def parse(text: str, latest: int) -> dict:
    """The record of one document."""
    lines = [x.strip() for x in re.split(r"\n+", text or "") if x.strip()]
    held: dict[str, list[str]] = {"header": []}
    kind = "header"
    for line in lines:
        found = _heading(line)
        if found:
            kind = found
            held.setdefault(kind, [])
        else:
            held[kind].append(line)
    email = re.search(T.EMAIL, text or "")
    phone = next((m[0] for m in re.finditer(T.PHONE, text or "") if 7 <= sum(c.isdigit() for c in m[0]) <= 15 and not D.RANGE.search(m[0])), None)
    skills = [s.strip().rstrip(".") for line in held.get("skills", []) for s in re.split(r"[,;|•·]|\s{2,}", re.sub(r"\([^()]*\)", "", re.sub(r"^[^\W\d_][\w &/]{1,29}:\s*", "", re.sub(T.BULLET, "", line))))]
    dated = held.get("experience") or ([] if len(held) > 1 else lines)
    out = {
        "name": _name(held["header"]), "email": email[0] if email else None, "phone": phone, "links": list(dict.fromkeys(m[0] for m in re.finditer(T.LINK, text or ""))),
        "roles": _roles(dated, latest), "education": _education(held.get("education", []), latest), "skills": list(dict.fromkeys(s for s in skills if 0 < len(s) <= 60)),
        "certifications": _certifications(held.get("certifications", [])), "spoken_languages": _languages(held.get("languages", [])),
    }
    return out


def records(docs: DataFrame, now_year: int) -> DataFrame:
    """One row a document: the parsed record, its lists cut to their limits, with tenure and the highest level.

    Lines depend on each other, so this is one vectorised Python pass; all counts after it are built-in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["name", "email", "phone", *LIMITS]
        for batch in batches:
            rows = [parse(t, now_year + 10) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{k: [r[k] for r in rows] for k in names}})

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PARSED)
    return finalized(raw, now_year * 12 + 11)


def finalized(raw: DataFrame, now_month: int) -> DataFrame:
    """Lists within limits; months_of_experience from all roles, overlaps once, none in the future; highest_isced."""
    spans = raw.select("doc_id", F.explode("roles").alias("r")).select(
        "doc_id", D.month_index(F.col("r.start.year"), F.col("r.start.month"), 1).alias("s"), F.when(F.col("r.current"), F.lit(now_month)).otherwise(D.month_index(F.col("r.end.year"), F.col("r.end.month"), 12)).alias("e")
    )
    held = spans.filter(F.col("s") <= now_month).withColumn("e", F.least(F.coalesce("e", "s"), F.lit(now_month)))
    months = D.tenure(held, "doc_id", "s", "e").withColumnRenamed("months", "months_of_experience")
    out = raw.join(months, "doc_id", "left").withColumn("highest_isced", F.array_max(F.transform("education", lambda e: e["isced"])))
    return out.withColumns({k: F.slice(k, 1, n) for k, n in LIMITS.items()})


def quality(records_: DataFrame) -> DataFrame:
    """How well a record was recovered: roles, their completeness, contact fields, education."""
    complete = F.size(F.filter("roles", lambda r: r["title"].isNotNull() & r["employer"].isNotNull() & r["start"].isNotNull()))
    n = F.size("roles")
    contact = sum((F.col(c).isNotNull().cast("int") for c in ("name", "email", "phone")), F.lit(0))
    return records_.select("doc_id", n.cast("long").alias("roles_detected"), F.when(n > 0, F.round(complete / n, 6)).alias("role_completeness"), F.round(contact / 3, 6).alias("contact_completeness"), (F.size("education") > 0).alias("education_detected"))
