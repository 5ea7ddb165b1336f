"""Rules of the report that need the parsed record."""

from docsieve.plans import report

CAREER = """Jane Doe
jane@example.org
Experience
Engineer at Acme
{dates}
- Wrote services in {skill} and ran them
Skills
C++, Quarkle, Zorb, Vimble
Education
State College"""


def test_timeline_and_skills_cost(spark):
    docs = [(1, CAREER.format(dates="Jan 2015 - Dec 2020", skill="C++, Quarkle and Zorb")), (2, CAREER.format(dates="Jan 2033 - Dec 2034", skill="nothing (Quarkles)")), (3, "Skills\nQuarkle, Zorb, Vimble")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    records = report.extract.records(df, 2026)
    timeline = {r["doc_id"]: r["value"] for r in report.timeline(records, 2026 * 12 + 11).collect()}
    assert timeline == {1: 0.0, 2: 1.0}
    assert {r["doc_id"]: r["value"] for r in report.skill_evidence(df, records).collect()} == {1: 0.25, 2: 1.0}
    got = {r["doc_id"]: r["categories"] for r in report.check(df).collect()}
    lost = {i: {c["category"]: c["lost"] for c in cs} for i, cs in got.items()}
    assert lost[2]["content"] - lost[1]["content"] >= 6


def test_language_of_the_whole_text(spark):
    """A text whose language changes after its opening."""
    english, german = "the work and the team of this that with from ", "und der die das nicht mit von ist auch eine "
    df = spark.createDataFrame([(1, english * 450 + "\n" + german * 2000)], "doc_id long, text string")
    assert report.locale.detect(df).first()["detected"] == "en"
    assert report.check(df).first()["lang"] == "de"


def test_alternatives_are_one_requirement(spark):
    from docsieve.plans import job

    docs = spark.createDataFrame([(1, "Wrote Python services"), (2, "Wrote Java services"), (3, "Wrote novels")], "doc_id long, text string")
    postings = docs.select("doc_id", report.F.lit("Requirements\nPython or Java").alias("posting"))
    got = {r["doc_id"]: (r["score"], r["matched"], r["total"]) for r in job.match(docs, postings).collect()}
    assert got == {1: (100, 1, 1), 2: (100, 1, 1), 3: (0, 0, 1)}


def test_degrees_are_asked_for_by_level(spark):
    """A higher level meets a lower one; of levels named together the lowest counts; a degree weighs as much as a skill; words that only hold a degree's letters ask for none."""
    from docsieve.plans import job

    docs = spark.createDataFrame([(1, "Python\nPhD, 2015"), (2, "Python\nB.Sc. Mathematics"), (3, "Python")], "doc_id long, text string")
    ask = lambda text: {r["doc_id"]: (r["score"], r["matched"], r["total"]) for r in job.match(docs, docs.select("doc_id", report.F.lit(text).alias("posting"))).collect()}
    assert ask("Requirements\nPython\nMaster's degree") == {1: (100, 2, 2), 2: (50, 1, 2), 3: (50, 1, 2)}
    assert ask("Requirements\nPython\nBachelor's or Master's degree") == {1: (100, 2, 2), 2: (100, 2, 2), 3: (50, 1, 2)}
    assert ask("Requirements\nPython schema.") == {k: (80, 1, 2) for k in (1, 2, 3)}
