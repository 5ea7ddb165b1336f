"""The scoring rules: a row a rule, with bands of (upper bound, weight)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

# Categories, severities, metrics, weights and band bounds are those of the published scoring rubric.
# (id, category, severity, metric, penalty, languages, bands); a band is (inclusive upper bound or None, weight lost).
RULES = (
    ("integrity.promptInjection", "integrity", "error", "injectionPhrases", True, "", ((0, 0), (None, 30))),
    ("integrity.hiddenText", "integrity", "error", "hiddenTextChars", True, "", ((20, 0), (None, 30))),
    ("integrity.copiedPosting", "integrity", "error", "copiedPostingRatio", True, "", ((0.3, 0), (None, 25))),
    ("integrity.invisibleCharacters", "integrity", "warning", "invisibleCharacters", True, "", ((0, 0), (None, 10))),
    ("integrity.homoglyphs", "integrity", "warning", "homoglyphWords", True, "", ((0, 0), (None, 10))),
    ("integrity.keywordStuffing", "integrity", "warning", "stuffedTerms", True, "", ((0, 0), (None, 10))),
    ("parse.text", "parse", "error", "readableWords", False, "", ((49, 20), (None, 0))),
    ("parse.imageOnly", "parse", "error", "imageOnlyPages", False, "", ((0, 0), (None, 15))),
    ("parse.roles", "parse", "error", "rolesDetected", False, "", ((0, 15), (None, 0))),
    ("parse.roleCompleteness", "parse", "warning", "roleCompleteness", False, "", ((0.6, 10), (None, 0))),
    ("parse.contact", "parse", "warning", "contactCompleteness", False, "", ((0.66, 8), (None, 0))),
    ("contact.email", "contact", "error", "emailPresent", False, "", ((0, 12), (None, 0))),
    ("contact.position", "contact", "warning", "contactPosition", False, "", ((0.25, 0), (None, 6))),
    ("privacy.dateOfBirth", "contact", "info", "dateOfBirthStated", False, "", ((0, 0), (None, 2))),
    ("structure.experience", "structure", "error", "experienceHeading", False, "", ((0, 12), (None, 0))),
    ("structure.education", "structure", "warning", "educationHeading", False, "", ((0, 8), (None, 0))),
    ("structure.skills", "structure", "warning", "skillsHeading", False, "", ((0, 8), (None, 0))),
    ("content.metrics", "content", "warning", "metricsRatio", False, "", ((0.15, 10), (None, 0))),
    ("content.verbs", "content", "warning", "actionVerbRatio", False, "", ((0.2, 8), (None, 0))),
    ("content.buzzwords", "content", "info", "buzzwordCount", False, "", ((2, 0), (None, 5))),
    ("content.timeline", "content", "info", "timelineIssues", False, "", ((0, 0), (None, 3))),
    ("content.skillEvidence", "content", "info", "unsupportedSkills", False, "", ((0.5, 0), (None, 3))),
    ("format.length", "format", "warning", "wordCount", False, "", ((200, 10), (1500, 0), (None, 8))),
    ("format.letterSpacing", "format", "warning", "letterSpacedLines", False, "", ((0, 0), (None, 8))),
    ("format.columns", "format", "error", "columnRatio", False, "", ((0.15, 0), (None, 15))),
    ("format.tables", "format", "warning", "tableCount", False, "", ((0, 0), (None, 10))),
    ("format.photo", "format", "info", "imageCount", False, "", ((0, 0), (None, 2))),
    ("writing.firstPerson", "writing", "info", "firstPersonLines", False, "en", ((0, 0), (None, 2))),
    ("writing.passiveVoice", "writing", "info", "passiveVoiceRatio", False, "en", ((0.2, 0), (None, 2))),
    ("writing.weakOpeners", "writing", "warning", "weakOpeners", False, "en", ((0, 0), (None, 2))),
    ("writing.tense", "writing", "info", "tenseMismatches", False, "en", ((0, 0), (None, 2))),
    ("writing.bulletLength", "writing", "info", "longBullets", False, "en", ((0, 0), (None, 1))),
    ("writing.bulletsPerRole", "writing", "info", "bulletsPerRole", False, "en", ((0, 0), (None, 1))),
    ("writing.repeatedOpeners", "writing", "info", "repeatedOpeners", False, "en", ((0, 0), (None, 1))),
    ("writing.dateFormats", "writing", "info", "dateFormats", False, "en", ((1, 0), (None, 1))),
)
# Verdict thresholds and the order in which categories are shown.
STRONG, NEEDS_WORK = 75, 45
CATEGORY_ORDER = ("integrity", "parse", "contact", "structure", "content", "format", "writing")
CATEGORY_LABELS = ("Integrity", "Parsing", "Contact & links", "Structure", "Evidence", "Format risk", "Writing")

FIXES = {
    "integrity": "Remove what a reader cannot see or did not ask for.",
    "parse": "Save the document so that its text can be read.",
    "contact": "Put contact details at the top, as plain text.",
    "structure": "Use plain headings for each part.",
    "content": "Say what was done, with figures.",
    "format": "Keep to one column and a page or two.",
    "writing": "Open each point with an action, one way throughout.",
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    metric: str
    penalty: bool
    languages: str
    bands: tuple

    def max_weight(self) -> float:
        return max(w for _, w in self.bands)


class PolicyError(ValueError):
    """A policy that cannot be used."""


def validated(rows=RULES) -> list[Rule]:
    """Rules checked as a whole: unique ids, known severities, ascending bounds with only the last open."""
    rules = [Rule(*r) for r in rows]
    if len({r.rule_id for r in rules}) < len(rules):
        raise PolicyError("rule ids repeat")
    for r in rules:
        if r.severity not in ("info", "warning", "error"):
            raise PolicyError(f"{r.rule_id}: severity {r.severity!r}")
        bounds = [b for b, _ in r.bands]
        if not bounds or bounds[-1] is not None or None in bounds[:-1]:
            raise PolicyError(f"{r.rule_id}: only the last band is open")
        if any(a >= b for a, b in zip(bounds[:-1], bounds[1:-1])):
            raise PolicyError(f"{r.rule_id}: bounds ascend")
        if any(w < 0 for _, w in r.bands):
            raise PolicyError(f"{r.rule_id}: weights are not negative")
    return rules


def typos(known: list[str], used: list[str]) -> list[tuple[str, str]]:
    """Used ids that no rule has, each with the known ids at an edit distance of at most 2."""
    return [(u, k) for u in used if u not in known for k in known if distance(u, k) <= 2]


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def canonical(value) -> str:
    """JSON with sorted keys and no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fnv1a(text: str) -> str:
    """32-bit FNV-1a of the text's UTF-16 units, as eight hex digits."""
    h = 0x811C9DC5  # fixed value: the offset basis
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ (units[i] | units[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF  # fixed value: the prime
    return f"{h:08x}"


def fingerprint(version: str, rules: list[Rule]) -> str:
    """version+hash: the same for equal policies only."""
    return f"{version}+{fnv1a(canonical([asdict(r) for r in rules]))}"


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """One row a rule, in policy order."""
    rules = rules or validated()
    rows = [(i, r.rule_id, r.category, r.severity, r.metric, r.penalty, r.languages, float(r.max_weight())) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, rule_id string, category string, severity string, metric string, penalty boolean, languages string, max_weight double")


def bands_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """One row a band: lo < value <= hi."""
    rows = []
    for r in rules or validated():
        lo = float("-inf")
        for upper, weight in r.bands:
            hi = float("inf") if upper is None else float(upper)
            rows.append((r.rule_id, lo, hi, float(weight)))
            lo = hi
    return spark.createDataFrame(rows, "rule_id string, lo double, hi double, weight double")


def values_sql(rows, names: str) -> str:
    """A VALUES list as a derived table."""

    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float) and v in (float("inf"), float("-inf")):
            return f"'{'-' if v < 0 else ''}infinity'::double"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return f"(select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


def rules_sql() -> str:
    return values_sql([(i, r.rule_id, r.category, r.severity, r.metric, r.penalty, r.languages, float(r.max_weight())) for i, r in enumerate(validated())], "ord, rule_id, category, severity, metric, penalty, languages, max_weight")


def bands_sql() -> str:
    rows = []
    for r in validated():
        lo = float("-inf")
        for upper, weight in r.bands:
            hi = float("inf") if upper is None else float(upper)
            rows.append((r.rule_id, lo, hi, float(weight)))
            lo = hi
    return values_sql(rows, "rule_id, lo, hi, weight")
