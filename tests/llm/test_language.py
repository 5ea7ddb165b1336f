import math
import os
import random
import re
import time

import numpy as np

from docsieve.llm import language
from docsieve.llm.queries import QUERIES


def test_pages(spark, sf):
    """Decisions against the language that the pages' own paths name, which no part of the method reads."""
    folder = os.path.join(os.path.dirname(sf), "sf0.01")
    got = {r["page_id"]: r for r in QUERIES["op7_language"](spark, folder).collect()}
    truth = {r["page_id"]: r["url"].split("/")[3][:2] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(got) == len(truth) and sum(got[i]["lang"] == truth[i] for i in truth) >= 0.98 * len(truth)


def test_fusion(spark):
    docs = [(i, w, lang) for i, (w, lang) in enumerate([("the cat and the dog with this " * 20, "en"), ("der hund und die katze mit dem " * 20, "de")] * 5)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    page = lambda t, lang=None: f"<html{f' lang={lang}' if lang else ''}><body><p>{t}</p></body></html>"
    rows = [(i, f"http://a.host.de/{i}", page("der hund und die katze mit dem", "de")) for i in range(20)]
    rows += [(50, "http://b.host.de/x", page("ok")), (51, None, page("the cat and the dog")), (52, "http://c.example.com", None), (53, "not an address", ""), (None, "http://a.host.de/n", page("ok")), (50, "http://b.host.de/x", page("ok"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = language.identify(pages, docs).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[50]["lang"] == "de" and by[None]["lang"] == "de" and by[51]["lang"] == "en" and by[52]["text_lang"] is None and 0 <= by[53]["posterior"] <= 1
    assert language.identify(spark.createDataFrame([], pages.schema), docs).count() == 0
    assert {r["lang"] for r in language.identify(pages, docs.limit(0)).collect()} == {None}


def test_broken_markup():
    """A megabyte of unclosed markup is read in one scan, and short broken markup as the patterns say."""
    for unit in ("<script ", "<!--", "<", "<main ", "<article>", "<html ", "<html lang=", "<script><nav><!--<head>", "</script", " "):
        page = unit * (1_000_000 // len(unit))
        begun = time.process_time()
        language.content(page), language.declared_language(page)
        assert time.process_time() - begun < 2, unit
    drop = re.compile(r"<!--.*?-->|<(script|style|nav|footer|aside|head|noscript)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    main = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.S | re.I)
    rng = random.Random(1)
    parts = ["<script", "<script>", "</script>", "</SCRIPT >", "<!--", "-->", "<", ">", "<p>", "a b", "</article>", "<article>", "<main", "</main>", "<nav x>", "</nav>", " "]
    for _ in range(2000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        held = main.search(page)
        assert language.content(page) == re.sub(r"\s+", " ", drop.sub(" ", held[2] if held else page)), page


def test_formula(spark):
    """Posteriors against the sums of the module's text, in plain Python, with repeated and clashing rows."""
    docs = spark.createDataFrame([(i, w, lang) for i, (w, lang) in enumerate([("the cat and the dog with this " * 9, "en"), ("der hund und die katze mit dem " * 9, "de")] * 3)], "doc_id long, text string, lang string")
    words = {"en": "the cat and the dog", "de": "der hund und die katze", "": ""}
    rng = random.Random(6)
    rows = []
    for i in range(60):
        w, host, declared = rng.choice(["en", "de", ""]), rng.choice(["a.x.de", "b.x.de", "c.y.com", ""]), rng.choice(["en", "de", None])
        rows.append((i, f"http://{host}/p" if host else None, f"<html{f' lang={declared}' if declared else ''}><p>{words[w]}</p>", "clash", "clash"))
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, domain string")
    names, table = language.fit(docs)
    assert names == ["de", "en"]
    like, best = [], []
    for r in rows:
        text = np.frombuffer(language.content(r[2]).encode(), np.uint8)
        n = np.bincount(language.trigrams(text, np.array([0, len(text)]))[0], minlength=language.BINS)
        like.append([language.TEMPER * float(n @ table[k].astype(np.float32).astype(float)) for k in (0, 1)])
        best.append(None if like[-1][0] == like[-1][1] else int(like[-1][1] > like[-1][0]))
    place = [language.address(r[1] or "") for r in rows]
    said = [language.declared_language(r[2]) for r in rows]
    tally = lambda key, value: [sum(k == value and b == i for k, b in zip(key, best, strict=True)) for i in (0, 1)]
    world = [best.count(i) for i in (0, 1)]
    share = [(c + 0.5) / (sum(world) + 1) for c in world]
    widths = [len({p[2] for p in place}), len({d for d in said if d is not None})]
    got = {}
    for r in language.identify(pages, docs).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert len(got[0]) == 2
    for k, r in enumerate(rows):
        own = [float(best[k] == i) for i in (0, 1)]
        votes = {n: tally([p[j] for p in place], place[k][j]) for j, n in enumerate(("host", "domain", "suffix"))} | {"said": tally(said, said[k])}
        logs = []
        for i in (0, 1):
            known = best[k] is not None
            domain = (votes["domain"][i] - own[i] + 4 * share[i]) / (sum(votes["domain"]) - known + 4)
            host = (votes["host"][i] - own[i] + 4 * domain) / (sum(votes["host"]) - known + 4)
            total = math.log(host if place[k][0] else share[i]) + like[k][i]
            total += math.log((votes["said"][i] + 0.5) / (world[i] + 0.5 * (widths[1] + 1))) if said[k] else 0
            total += math.log((votes["suffix"][i] + 0.5) / (world[i] + 0.5 * (widths[0] + 1))) if place[k][2] else 0
            logs.append(total)
        top = max(logs)
        assert got[r[0]][0]["lang"] == names[logs.index(top)] and abs(got[r[0]][0]["posterior"] - 1 / sum(math.exp(x - top) for x in logs)) < 1e-6


def test_address():
    assert language.address("https://user@Sub.Example.co.uk:80/x?y") == ("sub.example.co.uk", "co.uk", "uk") and language.address("x") == ("", "", "")
