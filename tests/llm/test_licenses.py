import re

from docsieve.llm import licenses
from docsieve.llm.queries import ORACLE, QUERIES


def test_agrees_with_sql(same):
    same(QUERIES["op1_licenses"], ORACLE["op1_licenses"])


def test_edges(spark, edge, none):
    rows = licenses.scan(edge).collect()
    assert len(rows) == edge.count() and licenses.scan(none).count() == 0
    assert all(r["n_base"] == 0 and r["score"] == 0 and r["first_word"] is None and r["labels"] == "" for r in rows)
    assert {r["doc_id"]: r["n_words"] for r in rows if r["doc_id"]}[8] == 30000 and [r["n_words"] for r in rows if r["doc_id"] is None] in ([7, 0], [0, 7])


def test_phrases_and_notices(spark):
    texts = ["The MIT License, and the mit-license; see MIT\nLICENSE", "mitt license", "Licensed under CC BY-NC 4.0.", "released under the apache license", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["labels"], got[0]["score"]) == (3, 1, 8, "mit", 1.0)
    assert got[1]["labels"] == "" and got[2]["labels"] == "cc-by-nc" and got[2]["base_labels"] == "" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "apache" and got[4]["labels"] == "gpl" and got[4]["base_labels"] == "gpl"


def test_join_is_exact(spark):
    """The filters lose no line that brute force finds, at a loose threshold and shuffled words."""
    import random

    rng = random.Random(3)
    lines = []
    for _, notice in licenses.NOTICES:
        words = re.findall(r"\w+", notice)
        for _ in range(6):
            kept = [w for w in words if rng.random() < 0.8] + [rng.choice(["foo", "bar", "the", "of"]) for _ in range(3)]
            rng.shuffle(kept)
            lines.append(" ".join(kept))
    df = spark.createDataFrame([(0, "\n".join(lines).lower())], "doc_id long, t string")
    got = {(r["line_no"], r["label"], round(r["containment"], 6)) for r in licenses.matched_lines(df, threshold=0.7).collect()}
    want = set()
    for i, line in enumerate(lines):
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.lower()))
        for label, ws in licenses.notice_sets():
            c = len(have & set(ws)) / len(ws)
            if c >= 0.7 - 1e-12:
                want.add((i, label, round(c, 6)))
    assert got == want and want


def test_wrapped_notices(spark):
    """Each notice is found when it is hard-wrapped, as a comment too, with other words around; its scattered words are not."""
    import textwrap

    rows, want = [], {}
    for label, notice in licenses.NOTICES:
        for width, lead in ((70, ""), (76, " * "), (80, "# "), (24, "")):
            wrapped = textwrap.fill(f"Copyright 2020 Some Body. {notice}. All else follows here.", width)
            want[len(rows)] = label
            rows.append((len(rows), "\n".join(lead + line for line in wrapped.split("\n"))))
    apart = len(rows)
    rows += [(apart + k, " other words between them \n".join(re.findall(r"\w+", notice))) for k, (_, notice) in enumerate(licenses.NOTICES)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1 for i, label in want.items())
    assert not any(r["labels"] for i, r in got.items() if i >= apart)


def test_near_identical_notices(spark):
    """Each of two near-identical notices gets its own label only, in one line and wrapped."""
    cc, fsf = "This work is licensed under a Creative Commons {} 4.0 International License", "{}; you can redistribute it and/or modify it under the terms of the GNU {}General Public License"
    cases = [
        ("Licensed under CC BY 4.0", "cc-by"), ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY-SA 4.0", ""), (cc.format("Attribution"), "cc-by"),
        (cc.format("Attribution-NonCommercial"), "cc-by-nc"), (cc.format("Attribution-Non-Commercial"), "cc-by-nc"), (cc.format("Attribution-ShareAlike"), ""),
        ("Text is licensed under CC BY 4.0 while all of the pictures in it are licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        (fsf.format("This program is free software", ""), "gpl"), (fsf.format("This library is free software", "Lesser "), "gpl,lgpl"),
    ]
    rows = [(2 * k + wrapped, text.replace(" under ", " under\n# ").replace(" modify ", " modify\n# ") if wrapped else text) for k, (text, _) in enumerate(cases) for wrapped in (0, 1)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [label for _, label in cases for _ in (0, 1)]


def test_native(spark, edge):
    plan = licenses.scan(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
