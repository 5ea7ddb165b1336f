import random
import re
import tempfile

from corpus_pipeline import decontamination_stage
from docsieve.llm import decontaminate
from docsieve.llm.queries import ORACLE, QUERIES


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12))] if w and i is not None else []
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_agrees_with_sql(same):
    same(QUERIES["op3_decontamination"], ORACLE["op3_decontamination"])


def test_edges(spark, edge, none):
    items = [(1, "One two three FOUR"), (2, None), (3, ""), (None, "five words and more"), (4, " ".join(f"w{i}" for i in range(20))), (5, "aaaa aaaa aaaa"), (5, "aaaa aaaa aaaa"), (10, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in edge.collect() if not r["text"] or len(r["text"]) < 50000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, [x for x in items])
    for most in (200_000, 0):  # with and without broadcasts
        got = decontaminate.report(df, bench, most=most).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got), key=repr) == want
    assert decontaminate.report(none, bench).count() == 0
    empty = decontaminate.report(edge, spark.createDataFrame([], bench.schema)).collect()
    assert len(empty) == edge.count() and not any(r["contaminated"] for r in empty)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "delta gamma " + "q " * 50 + "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity(docs, bench, slop=4).collect()} == {1, 2}


def test_proximity_is_exact(spark):
    """Against brute force, on texts that repeat their terms."""
    slop, item, rng = 4, ["a", "b", "c"], random.Random(5)
    texts = ["a q q q a q b c", "a b c", "a q q q q q b c"] + [" ".join(rng.choice("aabbccqqqq") for _ in range(rng.randrange(3, 30))) for _ in range(80)]
    want = set()
    for d, text in enumerate(texts):
        at = [(i - k, k) for i, w in enumerate(text.split()) for k, term in enumerate(item) if w == term]
        want |= {(d, max(s, 0)) for s, _ in at if len({k for o, k in at if s <= o <= s + slop}) == 3}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.proximity(docs, spark.createDataFrame([(7, "a b c")], "item_id long, text string"), slop=slop).collect()
    assert {(r["doc_id"], r["start"]) for r in got} == want and {d for d, _ in want} >= {0, 1}


def test_near_items(spark, edge, none):
    """The report counts items by the same matches; exact phrases are among them."""
    items = spark.createDataFrame([(7, "alpha beta gamma delta"), (7, "alpha beta gamma delta"), (8, "alpha beta"), (9, "absent words"), (None, "alpha"), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma y delta"), (3, "delta gamma " + "q " * 50 + "alpha beta"), (4, None), (1, "alpha beta gamma delta"), (None, "alpha " + "q " * 9 + "beta")], "doc_id long, text string")
    for most in (200_000, 0):
        near = decontaminate.proximity(docs, items, rarest=2)
        want = {(r["doc_id"], r["n"]) for r in near.groupBy("doc_id").agg({"item_id": "count"}).selectExpr("doc_id", "1 AS n").collect()}
        got = decontaminate.report(docs, items, slop=4, most=most).collect()
        assert len(got) == 6 and {r["doc_id"] for r in got if r["n_near"]} == {d for d, _ in want} and all(r["n_near"] >= r["n_items"] for r in got)
    assert sorted((r["n_items"], r["n_near"]) for r in got if r["doc_id"] == 1) == [(2, 2), (2, 2)]
    assert decontaminate.report(none, items, slop=4).count() == 0 and decontaminate.report(edge, items, slop=4).count() == edge.count()


def test_native(spark, edge):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert not re.search("Python|Pandas|Arrow", decontaminate.report(edge, items)._jdf.queryExecution().toString())


def shuffled(spark):
    """Bytes that all tasks have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_stay(spark):
    """Documents without a candidate are neither shuffled nor cut into words for the verification, and what goes is told to the scan."""
    rng = random.Random(3)
    item = " ".join(f"item{k}" for k in range(13))
    plain = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(2000)), "en") for i in range(60)]  # 1.9 MB
    docs = spark.createDataFrame([*plain, (97, item, "en"), (98, item.replace("item3", "x"), "en"), (99, item.upper(), "de"), (99, item.upper(), "fr"), (None, item, "en")], "doc_id long, text string, lang string").repartition(3).cache()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert docs.count() == 65
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        with tempfile.TemporaryDirectory() as folder:
            bench.write.parquet(f"{folder}/benchmark.parquet")
            left = decontamination_stage(spark, docs, folder).collect()
        assert shuffled(spark) - before < 300_000
        for most in (200_000, 0):  # beyond most the same rows by shuffles
            gone = [tuple(r) for r in decontaminate.contaminated(docs, bench, most=most).select("doc_id").collect()]
            assert sorted(gone, key=repr) == [(97,), (99,), (None,)]
            assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, bench, most=most).collect()} == {i: 13 * (i in (97, 99, None)) for i in (*range(60), 97, 98, 99, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        docs.unpersist()
    assert sorted(r["doc_id"] for r in left) == [*range(60), 98]
