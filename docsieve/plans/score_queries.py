"""Queries of scoring, matching, dates, documents and events, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import extract, matching, repair, requirements, roles, scoring, segment
from ..operators import findings as C
from ..policy import rules as R
from ..policy import vocabulary as V
from . import job, report
from .registry import Q, fixture, query, sql_list
from .text_queries import BUZZ, HEADING, HOMO, INJ, LINES, N_WORDS, OPENERS, PASSIVE, PRONOUN, STUFFED, VERB_HEAD, figure_sql, hidden_sql

E_, P_ = Q(T.EMAIL), Q(T.PHONE)
KIND = {k: f"({HEADING} and regexp_matches(lower(line), {Q(f'^(?:my |work |professional |key |core )?(?:{p})(?: (?:and|&) [a-z]+)?:?$')}))" for k, p in V.HEADINGS}
FIRST_KIND = "case " + " ".join(f"when {KIND[k]} then {Q(k)}" for k, _ in V.HEADINGS) + " else '' end"
WEAK = " or ".join(f"starts_with(lower(line), {Q(p)})" for p in V.WEAK)
RATIO = "case when sum((c)::int) > 0 then round(sum((c and {0})::int)::double / sum((c)::int), 6) end"
NAMES = "|".join(m[:3] for m in V.MONTHS)
FAMILY = f"case when regexp_matches(lower(line), {Q(rf'\b(?:{NAMES})[a-z]*\.? +(?:19|20)[0-9]{{2}}')}) then 'named' when regexp_matches(line, {Q(r'\b[0-9]{1,2}[/.](?:19|20)[0-9]{2}')}) then 'numeric' when regexp_matches(line, {Q(r'\b(?:19|20)[0-9]{2}-[0-9]{2}\b')}) then 'iso' when regexp_matches(line, {Q(r'\b(?:19|20)[0-9]{2}\b')}) then 'year' end"
BIRTH = Q(r"(?i)(?:date of birth|born on|d\.o\.b\.?|\bdob\b|geburtsdatum|date de naissance|fecha de nacimiento)[^\n]{0,40}?(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}|(?:19|20)[0-9]{2})")
FINDINGS = f"""(with d as (select doc_id, text, regexp_extract(text, {E_}) <> '' as e, regexp_extract(text, {P_}) as p from documents),
dm as (select doc_id, len(regexp_extract_all(lower(text), {Q(T.WORD)}))::double as "wordCount", "wordCount" as "readableWords", ({BUZZ})::double as "buzzwordCount", {hidden_sql('text')}::double as "invisibleCharacters",
  len({HOMO})::double as "homoglyphWords", ({INJ})::double as "injectionPhrases", e::int::double as "emailPresent", regexp_matches(text, {BIRTH})::int::double as "dateOfBirthStated", round((e::int + (p <> '')::int) / 3.0::double, 6)::double as "contactCompleteness",
  case when e or p <> '' then round(least(case when e then strpos(text, '@') end, case when p <> '' then strpos(text, p) end)::double / length(text), 6) end as "contactPosition" from d),
l as (select doc_id, line, {N_WORDS} >= 4 as c, {N_WORDS} as n, {FIRST_KIND} as kind from {LINES}),
lm as (select doc_id, {RATIO.format(figure_sql("line"))} as "metricsRatio", {RATIO.format(VERB_HEAD)} as "actionVerbRatio", {RATIO.format(f"regexp_matches(lower(line), {PASSIVE})")} as "passiveVoiceRatio",
  sum(regexp_matches(line, {Q(C.SPACED)})::int)::double as "letterSpacedLines", sum(({PRONOUN})::int)::double as "firstPersonLines", sum(({WEAK})::int)::double as "weakOpeners", sum((n > 40)::int)::double as "longBullets",
  max((kind = 'experience')::int)::double as "experienceHeading", max((kind = 'education')::int)::double as "educationHeading", max((kind = 'skills')::int)::double as "skillsHeading" from l group by doc_id),
rb as (select * from (select doc_id, line_no, line, {N_WORDS} as n, regexp_matches(line, '(?:19|20)[0-9]{{2}}') as dated, regexp_matches(line, {Q(T.BULLET + '[^ ]')}) as bullet,
  (sum(regexp_matches(line, '(?:19|20)[0-9]{{2}}')::int) over (partition by doc_id order by line_no rows unbounded preceding)) as role_no from {LINES}) where role_no > 0),
rc as (select *, max(case when dated then regexp_matches(line, {Q(roles.OPEN)})::int end) over (partition by doc_id, role_no) = 1 as current from rb),
bp as (select doc_id, sum((b not between 2 and 8)::int)::double as "bulletsPerRole" from (select doc_id, role_no, sum(bullet::int) as b from rc group by all) where b > 0 group by doc_id),
tm as (select doc_id, sum((not current and bullet and list_contains({sql_list(V.PRESENT)}, w) and not list_contains({sql_list(V.VERBS)}, w))::int)::double as "tenseMismatches" from (select *, coalesce(regexp_extract_all(lower(regexp_replace(line, {Q(T.BULLET)}, '')), {Q(T.WORD)})[1], '') as w from rc) group by doc_id),
df as (select doc_id, count(distinct {FAMILY})::double as "dateFormats" from rc where dated group by doc_id having count(*) >= 2),
st as (select doc_id, count(*)::double as n from {STUFFED} group by doc_id),
w as (select dm.*, lm.* exclude (doc_id), o."repeatedOpeners", bp."bulletsPerRole", tm."tenseMismatches", df."dateFormats", coalesce(st.n, 0)::double as "stuffedTerms" from dm left join lm using (doc_id) left join {OPENERS} o using (doc_id) left join st using (doc_id) left join bp using (doc_id) left join tm using (doc_id) left join df using (doc_id))
select doc_id, metric, value from (unpivot w on columns(* exclude (doc_id)) into name metric value value) where value is not null)"""
RULES, BANDS = R.rules_sql(), R.bands_sql()
RESULTS = f"""(select f.doc_id, r.ord, r.rule_id, r.category, r.severity, r.penalty, r.max_weight::double as max_weight, f.value, b.weight::double as lost, b.weight = 0 as passed
from {FINDINGS} f join {RULES} r using (metric) join documents d using (doc_id) join {BANDS} b using (rule_id) where (r.languages = '' or r.languages = d.lang) and b.lo < f.value and f.value <= b.hi)"""
SCORES = f"""(select *, greatest(0, quality - penalty)::bigint as readiness from (select *, case when possible > 0 then floor((1 - lost / possible) * 100 + 0.5) else 100 end::bigint as quality from
(select doc_id, sum(case when not penalty then lost else 0 end) as lost, sum(case when not penalty then max_weight else 0 end) as possible, sum(case when penalty then lost else 0 end) as penalty,
  sum(passed::int)::bigint as checks_passed, count(*) as checks_total, bool_or(category = 'integrity' and severity = 'error' and not passed) as caught from {RESULTS} group by doc_id)))"""


def results(spark, t):
    return report.scored(t.documents, languages=t.documents.select("doc_id", "lang"))


@query("findings", f"select * from {FINDINGS}")
def findings(spark, t):
    return C.findings(t.documents)


@query("applicable_rules", f"select rule_id, count(*) as docs, sum(passed::int)::bigint as passed, sum(lost) as lost from {RESULTS} group by rule_id")
def applicable_rules(spark, t):
    return results(spark, t).groupBy("rule_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if("passed").alias("passed"), F.sum("lost").alias("lost"))


@query("band_lookup", f"select doc_id, rule_id, value, lost from {RESULTS}")
def band_lookup(spark, t):
    return results(spark, t).select("doc_id", "rule_id", "value", "lost")


READINESS = f"select s.doc_id, readiness, case when readiness >= {R.STRONG} then 'strong' when readiness >= {R.NEEDS_WORK} then 'needs-work' else 'weak' end as verdict, checks_passed, checks_total, l.quality as labelled from {SCORES} s left join labels l on l.doc_id = s.doc_id"


@query("readiness_score", READINESS)
def readiness_score(spark, t):
    scores = scoring.readiness(results(spark, t)).join(t.labels.select("doc_id", F.col("quality").alias("labelled")), "doc_id", "left")
    return scores.select("doc_id", "readiness", scoring.verdict(F.col("readiness")).alias("verdict"), "checks_passed", "checks_total", "labelled")


@query("category_rollup", f"select doc_id, category, case when possible > 0 then greatest(0, floor((1 - lost / possible) * 100 + 0.5)) when passed = total then 100 else 0 end::bigint as score, passed, total, floor(lost + 0.5)::bigint as lost, floor(possible + 0.5)::bigint as possible from (select doc_id, category, sum(passed::int)::bigint as passed, count(*) as total, sum(lost) as lost, sum(max_weight) as possible from {RESULTS} group by all)")
def category_rollup(spark, t):
    return scoring.categories(results(spark, t))


@query("top_strengths", f"select doc_id, rank, rule_id, max_weight from (select *, row_number() over (partition by doc_id order by max_weight desc, ord) as rank from {RESULTS} where passed and not penalty and max_weight > 0) where rank <= 5")
def top_strengths(spark, t):
    return scoring.strengths(results(spark, t))


FIX = "case category " + " ".join(f"when {Q(k)} then {Q(v)}" for k, v in R.FIXES.items()) + " end"


@query("top_fixes", f"select doc_id, rank, rule_id, lost, {FIX} as fix from (select *, row_number() over (partition by doc_id order by lost desc, ord) as rank from {RESULTS} where not passed) where rank <= 6")
def top_fixes(spark, t):
    return scoring.fixes(results(spark, t))


@query("verdicts", f"select d.lang, case when readiness >= {R.STRONG} then 'strong' when readiness >= {R.NEEDS_WORK} then 'needs-work' else 'weak' end as verdict, count(*) as docs, round(avg(readiness), 6) as mean from {SCORES} s join documents d using (doc_id) group by all")
def verdicts(spark, t):
    scores = scoring.readiness(results(spark, t)).join(t.documents.select("doc_id", "lang"), "doc_id")
    return scores.groupBy("lang", scoring.verdict(F.col("readiness")).alias("verdict")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("readiness"), 6).alias("mean"))


@query("rubric", f"select ord, rule_id, category, severity, metric, case when penalty then '-' || max_weight::int || ' pts' else (max_weight::int)::varchar end as weight from {RULES}")
def rubric(spark, t):
    n = F.col("max_weight").cast("int").cast("string")
    return R.rules_table(spark).select("ord", "rule_id", "category", "severity", "metric", F.when(F.col("penalty"), F.concat(F.lit("-"), n, F.lit(" pts"))).otherwise(n).alias("weight"))


PLACE = "case category " + " ".join(f"when {Q(c)} then {-i}" for i, c in enumerate(R.CATEGORY_ORDER)) + " end"


@query("restricted_report", f"select s.doc_id, s.readiness, coalesce(f.failed, 0)::bigint as failed, f.warning from {SCORES} s left join (select doc_id, count(*) as failed, arg_max(category, lost * 100 + {PLACE}) as warning from {RESULTS} where not passed group by doc_id) f using (doc_id)")
def restricted_report(spark, t):
    rows = results(spark, t)
    return scoring.restricted(rows, scoring.readiness(rows))


CHANGES = R.values_sql(V.REGION_RULES, "region, rule_id, new_weight, new_severity")


@query("region_rules", f"with c as {CHANGES}, r as {RULES} select region, ord, rule_id, coalesce(new_severity, severity) as severity, coalesce(new_weight, max_weight)::double as max_weight from r cross join (select distinct region from c) left join c using (region, rule_id) where new_weight is null or new_weight > 0")
def region_rules(spark, t):
    return scoring.regional(R.rules_table(spark), V.pairs_table(spark, V.REGION_RULES, "region string, rule_id string, weight double, severity string"), sorted({r[0] for r in V.REGION_RULES}))


@query("category_order", f"select category, label, place, rules from {fixture([(c, x, i) for i, (c, x) in enumerate(zip(R.CATEGORY_ORDER, R.CATEGORY_LABELS))], 'category, label, place', True)} join (select category, count(*) as rules from {RULES} group by category) using (category)")
def category_order(spark, t):
    shown = V.pairs_table(spark, [(c, x, i) for i, (c, x) in enumerate(zip(R.CATEGORY_ORDER, R.CATEGORY_LABELS))], "category string, label string, place int")
    return shown.join(R.rules_table(spark).groupBy("category").agg(F.count(F.lit(1)).alias("rules")), "category").select("category", "label", "place", "rules")


TYPOS = ["format.lenght", "content.metric", "structure.skills", "writing.tens", "nothing.like"]


@query("rule_id_typos", f"select used, rule_id as known, levenshtein(used, rule_id)::bigint as distance from {fixture([(x,) for x in TYPOS], 'used', True)} join {RULES} on levenshtein(used, rule_id) <= 2 where used not in (select rule_id from {RULES})")
def rule_id_typos(spark, t):
    rules = R.rules_table(spark).select(F.col("rule_id").alias("known"))
    used = V.words_table(spark, TYPOS, "used").join(rules, F.col("used") == F.col("known"), "left_anti")
    # two lists of a policy's ids: the one join by distance, both sides a few dozen rows
    return used.join(F.broadcast(rules), F.levenshtein("used", "known") <= 2).select("used", "known", F.levenshtein("used", "known").cast("long").alias("distance"))


@query("needs_repair", f"select s.doc_id from (select doc_id, len(regexp_extract_all(lower(text), {Q(T.WORD)})) as n, (regexp_extract(text, {E_}) <> '')::int + (regexp_extract(text, {P_}) <> '')::int as contact, regexp_matches(text, '(?:19|20)[0-9]{{2}}') as dated from documents) s where (n > 160 and not dated) or contact < 1")
def needs_repair(spark, t):
    return repair.needs_repair(t.documents)


# ---------------------------------------------------------------- terms and matches

TEXT_USER = "(select conv_id, string_agg(text, chr(10) order by turn) as text from conversations where role = 'user' and text is not null group by conv_id)"
TEXT_OTHER = "(select conv_id, string_agg(text, chr(10) order by turn) as text from conversations where role = 'assistant' and text is not null group by conv_id)"


def side(t, role):
    rows = t.conversations.filter((F.col("role") == role) & F.col("text").isNotNull())
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))


def stem_sql(w: str) -> str:
    arms = " ".join(f"when ends_with({w}, {Q(s)}) and length({w}) >= {n}{f' and not ends_with({w}, {Q(u)})' if u else ''} then substr({w}, 1, length({w}) - {len(s)}) || {Q(p)}" for s, p, n, u in V.STEMS)
    return f"case {arms} else {w} end"


def terms_sql(source: str, key: str) -> str:
    padded = "' ' || array_to_string(regexp_extract_all(lower(text), " + Q(T.WORD) + "), ' ') || ' '"
    blank = padded
    for p in sorted(V.PHRASES, key=len, reverse=True):
        blank = f"replace({blank}, {Q(f' {p} ')}, ' ')"
    same = "case token " + " ".join(f"when {Q(k)} then {Q(v)}" for k, v in V.SYNONYMS.items()) + " end"
    return f"""(select distinct {key}, token from (select {key}, coalesce({same}, {stem_sql('token')}) as token from (select distinct {key}, unnest(list_filter(string_split({blank}, ' '), lambda x: x <> '')) as token from {source}) where length(token) > 1 and token not in {tuple(V.STOPWORDS)}
union all select {key}, p as token from {source}, {fixture([(p,) for p in V.PHRASES], 'p', True)} where contains({padded}, ' ' || p || ' ')))"""


IMPLIED = f"(select distinct conv_id, token from (select * from {{0}} union all select conv_id, other from {{0}} join {fixture(list(V.IMPLIES.items()), 'token, other', True)} using (token)))"
HELD = IMPLIED.format(terms_sql(TEXT_USER, "conv_id"))


@query("stem_terms", f"select token, {stem_sql('token')} as stem, count(*) as n from (select unnest(regexp_extract_all(lower(text), {Q(T.TOKEN)})) as token from conversations) group by token")
def stem_terms(spark, t):
    rows = t.conversations.select(F.explode(T.plain_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("token", T.stem(F.col("token"), V.STEMS).alias("stem"), "n")


@query("canonical_terms", f"select * from {terms_sql(TEXT_USER, 'conv_id')}")
def canonical_terms(spark, t):
    return matching.terms(side(t, "user"), "conv_id")


@query("implied_terms", f"select * from {HELD}")
def implied_terms(spark, t):
    return matching.implied(matching.terms(side(t, "user"), "conv_id"), "conv_id")


#: The invented texts of the tables hold no phrase of the vocabulary.
PHRASE_ROWS = [(-1, "Machine Learning, and Public speaking!"), (-2, "data sciences"), (-3, "project management for customer service")]


@query("phrase_terms", f"select doc_id, p as token from (select doc_id, text from documents union all {fixture(PHRASE_ROWS, 'doc_id, text')}), {fixture([(p,) for p in V.PHRASES], 'p', True)} where contains(' ' || array_to_string(regexp_extract_all(lower(text), {Q(T.WORD)}), ' ') || ' ', ' ' || p || ' ')")
def phrase_terms(spark, t):
    return matching.phrase_terms(t.documents.select("doc_id", "text").unionByName(spark.createDataFrame(PHRASE_ROWS, "doc_id long, text string")), "doc_id")


@query("acronyms", "select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) as token from documents) where regexp_matches(token, '^[A-Z][A-Z0-9]{1,5}$') group by token")
def acronyms(spark, t):
    tokens = t.documents.select("doc_id", F.explode(T.extract_all(F.col("text"), r"[\p{L}\p{N}]+")).alias("token"))
    return tokens.filter(F.regexp_like("token", F.lit("^[A-Z][A-Z0-9]{1,5}$"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


WEIGH = f"max(case when token in {tuple(V.SKILLS)} then 1.0 when token in {V.SOFT} then {V.GENERAL_WEIGHT * V.SOFT_WEIGHT} else {V.GENERAL_WEIGHT} end)::double"
#: Postings and documents with alternatives and degrees, which the turns of the tables lack.
POSTED = [(-1, "Python or Java\nSQL and a Master's degree"), (-2, "Bachelor or Master of Science, AWS/GCP\nreviews the schema."), (-3, "Excel, Word, or SQL\nPh.D.")]
APPLIED = [(-1, "Wrote Java services\nM.Sc., 2015"), (-2, "ran GCP\nB.Sc. Mathematics"), (-3, "wrote novels\nDiploma of Nursing")]
POSTINGS = f"(select conv_id, text from {TEXT_OTHER} union all {fixture(POSTED, 'conv_id, text')})"
APPLICATIONS = f"(select conv_id, text from {TEXT_USER} union all {fixture(APPLIED, 'conv_id, text')})"
BARE = f"regexp_replace({{}}, {Q(V.DEGREE)}, ' ', 'g')"
ASKED = f"(select conv_id, token, {WEIGH} as weight from {terms_sql('(select conv_id, ' + BARE.format('text') + ' as text from ' + POSTINGS + ')', 'conv_id')} group by all)"
EACH = f"(select a.conv_id, a.token, a.weight, h.token is not null as found from {ASKED} a left join {IMPLIED.format(terms_sql(APPLICATIONS, 'conv_id'))} h on h.conv_id = a.conv_id and h.token = a.token)"
POSTING_LINES = f"(select conv_id, line_no, trim(l) as line from (select conv_id, unnest(a) as l, generate_subscripts(a, 1) - 1 as line_no from (select conv_id, string_split_regex(text, '\\n+') as a from {POSTINGS})) where trim(l) <> '')"
PLAIN = f"regexp_replace(regexp_replace({BARE.format('line')}, {Q(T.LINK)}, ' ', 'g'), {Q(T.EMAIL)}, ' ', 'g')"
CHOICES = f"(select conv_id, line_no, unnest(r) as run, generate_subscripts(r, 1) as g from (select conv_id, line_no, regexp_extract_all({PLAIN}, {Q(matching.CHOICE)}) as r from {POSTING_LINES}))"
PARTS = f"(select conv_id, line_no, g, list_filter(string_split_regex(lower(run), {Q(matching.CHOICE_SPLIT)}), lambda x: x <> '') as parts from {CHOICES})"
FIRST_ROOT = f"(select *, row_number() over (partition by conv_id, token order by line_no, g) as r from (select conv_id, line_no, g, list_min(parts) as root, unnest(parts) as token from {PARTS} where len(parts) between 2 and 8))"
ROOTS = f"(select conv_id, coalesce(case token {' '.join(f'when {Q(k)} then {Q(v)}' for k, v in V.SYNONYMS.items())} end, {stem_sql('token')}) as token, 'or ' || min(root) as root from {FIRST_ROOT} where r = 1 and token not in {tuple(V.STOPWORDS)} group by all)"
LOWEST = "least(" + ", ".join(f"case when regexp_matches(lower(line), {Q(p)}) then {n} end" for n, p in V.DEGREES) + ")"
HIGHEST = "greatest(" + ", ".join(f"case when regexp_matches(lower(text), {Q(p)}) then {n} end" for n, p in V.DEGREES) + ")"
DEGREES_MET = f"(select a.conv_id, 'degree ' || a.isced as token, 1.0::double as weight, coalesce(h.isced >= a.isced, false) as found from (select distinct conv_id, {LOWEST} as isced from {POSTING_LINES}) a left join (select conv_id, {HIGHEST} as isced from {APPLICATIONS}) h using (conv_id) where a.isced is not null)"
MET = f"(select e.conv_id, coalesce(r.root, e.token) as token, max(e.weight) as weight, bool_or(e.found) as found from {EACH} e left join {ROOTS} r on r.conv_id = e.conv_id and r.token = e.token group by e.conv_id, coalesce(r.root, e.token) union all select * from {DEGREES_MET})"


def asked(spark, t):
    """Asked terms and whether they are found, the postings and the documents, by conversation."""
    more = lambda turns, rows: side(t, turns).select("conv_id", "text").unionByName(spark.createDataFrame(rows, "conv_id long, text string"))
    postings, docs = more("assistant", POSTED), more("user", APPLIED)
    bare = postings.withColumn("text", matching.without_degrees(F.col("text")))
    wanted = matching.weighed(matching.terms(bare, "conv_id").withColumn("section", F.lit("body")), "conv_id").select("conv_id", "token", "weight")
    found = matching.matches(wanted, matching.implied(matching.terms(docs, "conv_id"), "conv_id"), "conv_id")
    return found, segment.lines(postings, "conv_id").withColumn("weight", F.lit(1.0)), docs


def met(spark, t):
    return job.requirements(*asked(spark, t), "conv_id")


@query("job_match_score", f"select conv_id, floor(round(sum(case when found then weight else 0 end) / sum(weight) * 100, 9) + 0.5)::bigint as score, sum(found::int)::bigint as matched, count(*) as total from {MET} group by conv_id")
def job_match_score(spark, t):
    return matching.match_score(met(spark, t))


@query("missing_top12", f"select conv_id, rank, token, weight from (select *, row_number() over (partition by conv_id order by weight desc, token) as rank from {MET} where not found) where rank <= 12")
def missing_top12(spark, t):
    return matching.missing(met(spark, t))


GROUPS = [(-11, "a", "python", 1.0, False), (-11, "a", "java", 0.5, True), (-11, "b", "sql", 2.0, False), (-12, "a", "go", 1.0, True)]


@query("alternative_groups", f"select conv_id, root, bool_or(found) as found, max(weight)::double as weight from (select e.conv_id, coalesce(r.root, e.token) as root, e.token, e.weight, e.found from {EACH} e left join {ROOTS} r on r.conv_id = e.conv_id and r.token = e.token union all {fixture(GROUPS, 'conv_id, root, token, weight, found')}) group by conv_id, root")
def alternative_groups(spark, t):
    found, lines, _ = asked(spark, t)
    rows = job.rooted(found, lines, "conv_id").select("conv_id", "root", "token", "weight", "found")
    return matching.grouped(rows.unionByName(spark.createDataFrame(GROUPS, "conv_id long, root string, token string, weight double, found boolean")))


LISTED = [(-1, "python"), (-1, "sql"), (-1, "excel"), (-2, "go"), (-2, "java"), (-3, "a"), (-3, "b"), (-3, "c"), (-3, "d")]
ELSEWHERE = [(-1, "python"), (-3, "a"), (-3, "b"), (-3, "d")]


@query("unsupported_skills", f"with l as (select distinct conv_id as doc_id, token as skill from {terms_sql(TEXT_OTHER, 'conv_id')} union all {fixture(LISTED, 'doc_id, skill')}), e as (select distinct conv_id as doc_id, token as skill from {terms_sql(TEXT_USER, 'conv_id')} union all {fixture(ELSEWHERE, 'doc_id, skill')}) select doc_id, round(sum((e.skill is null)::int)::double / count(*), 6) as ratio from l left join e using (doc_id, skill) group by doc_id having count(*) >= 3")
def unsupported_skills(spark, t):
    def named(role, rows):
        found = matching.terms(side(t, role), "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("token").alias("skill")).distinct()
        return found.unionByName(spark.createDataFrame(rows, "doc_id long, skill string"))

    return C.unsupported_skills(named("assistant", LISTED), named("user", ELSEWHERE))


LATTICE = [(1, "met"), (1, "partial"), (2, "missing"), (2, "met"), (3, "met"), (3, "met")]


@query("status_lattice", f"select id, case min(r) when 0 then 'missing' when 1 then 'partial' else 'met' end as weaker, case max(r) when 0 then 'missing' when 1 then 'partial' else 'met' end as stronger from (select id, case s when 'missing' then 0 when 'partial' then 1 else 2 end as r from (select o_custkey as id, case o_orderstatus when 'F' then 'met' when 'P' then 'partial' else 'missing' end as s from orders union all {fixture(LATTICE, 'id, s')})) group by id")
def status_lattice(spark, t):
    status = F.when(F.col("o_orderstatus") == "F", "met").when(F.col("o_orderstatus") == "P", "partial").otherwise("missing")
    rows = t.orders.select(F.col("o_custkey").alias("id"), status.alias("status"))
    return requirements.lattice(rows.unionByName(spark.createDataFrame(LATTICE, "id long, status string")), "id")


# ---------------------------------------------------------------- dates and spans

PARTIAL = [(1, 2020, None), (2, 2020, 3), (3, 1999, 12)]


@query("month_index", f"select id, year * 12 + coalesce(month, 1) - 1 as started, year * 12 + coalesce(month, 12) - 1 as ended from (select o_orderkey as id, year(o_orderdate)::int as year, case when o_orderkey % 3 > 0 then month(o_orderdate)::int end as month from orders union all {fixture(PARTIAL, 'id, year, month')})")
def month_index(spark, t):
    dated = t.orders.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 3 > 0, F.month("o_orderdate")).alias("month"))
    rows = dated.unionByName(spark.createDataFrame(PARTIAL, "id long, year int, month int"))
    return rows.select("id", D.month_index(F.col("year"), F.col("month"), 1).alias("started"), D.month_index(F.col("year"), F.col("month"), 12).alias("ended"))


SPANS = "(select user_id, dayofyear(ts) as s, dayofyear(ts) + (event_id % 5)::int as e from events)"


def spans(t):
    return t.events.select("user_id", F.dayofyear("ts").alias("s"), (F.dayofyear("ts") + (F.col("event_id") % 5)).cast("int").alias("e"))


@query("tenure_union", f"select user_id, count(distinct x)::bigint as months from (select user_id, unnest(range(s, e + 1)) as x from {SPANS}) group by user_id")
def tenure_union(spark, t):
    return D.tenure(spans(t), "user_id", "s", "e")


@query("overlap_months", f"select user_id, count(*)::bigint as months, max(n)::bigint as most from (select user_id, x, count(*) as n from (select user_id, unnest(range(s, e + 1)) as x from {SPANS}) group by all) where n > 2 group by user_id")
def overlap_months(spark, t):
    return D.overlapping(spans(t), "user_id", "s", "e", 2)


TITLES = [(1, "Software Engineer"), (2, "Parental leave"), (3, " Sabbatical "), (4, "Leave Administrator")]


@query("drop_leave", f"select * from (select p_partkey as id, p_name as title from part union all {fixture(TITLES, 'id, title')}) where lower(trim(title)) not in {V.LEAVE}")
def drop_leave(spark, t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return extract.drop_leave(rows.unionByName(spark.createDataFrame(TITLES, "id long, title string")))


TENURES = [(81,), (36,), (7,), (-1,), (0,), (12,), (13,)]


@query("format_tenure", f"select months, case when m // 12 = 0 then m || ' mo' when m % 12 = 0 then (m // 12) || ' yr' else (m // 12) || ' yr ' || (m % 12) || ' mo' end as shown from (select months, greatest(months, 0) as m from (select p_size::bigint as months from part union all {fixture(TENURES, 'months')}))")
def format_tenure(spark, t):
    rows = t.part.select(F.col("p_size").cast("long").alias("months")).unionByName(spark.createDataFrame(TENURES, "months long"))
    return rows.select("months", D.format_tenure(F.col("months")).alias("shown"))


WRITTEN = [(1, "Jan 2020 – Mar 2023"), (2, "01/2020 - 03/2023"), (3, "2020-01 to 2023-03"), (4, "2020 - 2023"), (5, "no date"), (6, "March. 2021")]


@query("date_formats", f"select id, {FAMILY} as family from (select doc_id as id, line from {LINES} union all {fixture(WRITTEN, 'id, line')})")
def date_formats(spark, t):
    rows = segment.lines(t.documents).select(F.col("doc_id").alias("id"), "line").unionByName(spark.createDataFrame(WRITTEN, "id long, line string"))
    return rows.select("id", D.date_family(F.col("line")).alias("family"))


@query("asof_role", "select event_id, user_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before, first_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as after from events")
def asof_role(spark, t):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t.events.select("event_id", "user_id", F.last(bought, True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first(bought, True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))


# ---------------------------------------------------------------- documents, grounding, corpus roll-ups

@query("render_document", "select c_custkey as id, c_name || chr(10) || 'Experience' || chr(10) || array_to_string(list('- ' || o_orderpriority || ', ' || o_orderstatus order by o_orderkey), chr(10)) as text from customer join orders on o_custkey = c_custkey group by c_custkey, c_name")
def render_document(spark, t):
    from ..sources.documents import render

    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))), lambda o: F.concat(o["o_orderpriority"], F.lit(", "), o["o_orderstatus"]))
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).agg(items.alias("lines"))
    return rows.select("id", render(F.col("name"), F.array(F.struct(F.lit("Experience").alias("heading"), F.col("lines").alias("lines")))).alias("text"))


GROUNDED = [(1, "Acme GmbH", "worked at Acme GmbH in Berlin"), (2, "Acme", "worked at Acmex"), (3, "data entry", "Data  Entry clerk"), (4, "", "x")]
PAD = "' ' || array_to_string(regexp_extract_all(lower({0}), " + Q(T.TOKEN) + "), ' ') || ' '"


@query("grounded_values", f"select id, v <> '' and contains({PAD.replace('{0}', 's')}, {PAD.replace('{0}', 'v')}) as grounded from (select doc_id as id, source as v, text as s from documents where text is not null and source is not null union all {fixture(GROUNDED, 'id, v, s')})")
def grounded_values(spark, t):
    rows = t.documents.filter("text IS NOT NULL AND source IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("v"), F.col("text").alias("s"))
    return rows.unionByName(spark.createDataFrame(GROUNDED, "id long, v string, s string")).select("id", repair.grounded(F.col("v"), F.col("s")).alias("grounded"))


@query("fabricated_numbers", """with n as (select conv_id, role, unnest(regexp_extract_all(text, '[0-9]+')) as n from conversations),
s as (select distinct conv_id, n from n where role = 'user'), o as (select distinct conv_id, n from n where role = 'assistant')
select o.conv_id, count(*) as numbers, sum((s.n is null)::int)::bigint as fabricated from o left join s on s.conv_id = o.conv_id and s.n = o.n group by o.conv_id""")
def fabricated_numbers(spark, t):
    return repair.fabricated(t.conversations)


@query("score_cube", f"select lang, source, count(*) as docs, round(avg(readiness), 6) as mean from {SCORES} s join documents d using (doc_id) group by cube (lang, source)")
def score_cube(spark, t):
    scores = scoring.readiness(results(spark, t)).join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    return scores.cube("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("readiness"), 6).alias("mean"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("event_sessions", """select user_id, min(ts) as started, max(ts) as ended, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
(select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events)) group by user_id, s""")
def event_sessions(spark, t):
    out = t.events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", "started", "ended", "n")


# ---------------------------------------------------------------- no SQL equivalent: held against fixtures in the tests

@query("parsed_records")
def parsed_records(spark, t):
    return extract.records(t.documents, 2026)


@query("parse_quality")
def parse_quality(spark, t):
    return extract.quality(extract.records(t.documents, 2026))


@query("html_visible_text")
def html_visible_text(spark, t):
    from ..sources.html import pages_text

    return pages_text(t.pages)


#: A document and its posting: the turns of the tables have no list of requirements.
ASKED = [(-1, "Requirements\n- Python and SQL\n- 5 years of experience with Docker\n- Bachelor degree\n- Authorized to work in the country\nNice to have\n- Kubernetes"), (-2, "What you bring\n1. Excel\n2) Java")]
OFFERED = [(-1, "Experience\nBuilt SQL reports\n6 years of experience with Docker\nMaster of Science, 2015\nAuthorized to work\nSkills\nKubernetes"), (-2, "Wrote Java services")]


@query("requirement_verdicts")
def requirement_verdicts(spark, t):
    rows = lambda turns, more: side(t, turns).select("conv_id", "text").unionByName(spark.createDataFrame(more, "conv_id long, text string"))
    return requirements.judge(rows("user", OFFERED), rows("assistant", ASKED), "conv_id")


@query("normalized_text")
def normalized_text(spark, t):
    return t.documents.select("doc_id", T.normalize(F.col("text")).alias("text"))


@query("full_report")
def full_report(spark, t):
    return report.check(t.documents).select("doc_id", "readiness", "verdict", "checks_passed", "checks_total", "months_of_experience", "highest_isced", F.size("fixes").cast("long").alias("fixes"))


