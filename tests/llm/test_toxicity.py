import random
import zlib

import numpy as np

from docsieve.llm import toxicity
from docsieve.llm.queries import QUERIES


def test_held_out_rows(spark):
    """Accuracy on rows that are not learned from, and the contract's columns."""
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i]["held_out"]]
    hits = sum(got[i]["predicted"] and labels[i] for i in held)
    assert hits / sum(got[i]["predicted"] for i in held) > 0.9 and hits / sum(labels[i] for i in held) > 0.5


def biased(spark, n=1500):
    """Documents in which toxic rows often name a group that clean ones seldom name, and their labels."""
    rng = random.Random(1)
    fill = [f"filler{i}" for i in range(200)]
    texts, labels = [], []
    for k in range(n):
        toxic = k % 2
        words = rng.sample(fill, 12) + (["vermin"] if toxic and rng.random() < 0.9 else []) + (["muslims"] if toxic and rng.random() < 0.8 or not toxic and rng.random() < 0.05 else [])
        texts.append((k, " ".join(words)))
        labels.append((k, toxic))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def score(model, text):
    buf = np.frombuffer(text.encode(), np.uint8)
    return 1 / (1 + np.exp(-model.logits(buf, np.array([0, len(buf)]))[0]))


def test_neutral_mentions(spark):
    """At the strength of production the penalty takes the group's weight away; without it neutral mentions are rejected."""
    docs, labels = biased(spark)
    plain, fair = (toxicity.train(docs, labels, **options) for options in ({"fairness": 0.0}, {}))
    neutral = [f"filler{i} filler{i + 1} muslims filler{i + 2}" for i in range(0, 150, 3)]
    rejected = [sum(score(m, t) >= toxicity.THRESHOLD for t in neutral) for m in (plain, fair)]
    assert rejected[0] >= 45 and rejected[1] == 0
    assert score(fair, "filler1 vermin filler2") > 0.5
    assert all(abs(score(fair, t) - score(fair, t.replace("muslims", "christians"))) < 0.02 for t in neutral)


def test_repeated_ids(spark):
    """A doc_id that stands often is learned from once."""
    docs, labels = biased(spark, 300)
    model = toxicity.train(docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id = 1")), labels)
    again = toxicity.train(docs, labels)
    assert (model.numbers == again.numbers).all() and np.allclose(model.weights, again.weights, atol=1e-6)


def text_features(text):
    buf = np.frombuffer(text.encode(), np.uint8)
    feat, _, whole, _ = toxicity.features(buf, np.array([0, len(buf)]))
    return feat, whole


def test_swap_is_whole():
    """Taking the lost features away and the gained ones in gives the features of the text with its terms swapped."""
    swaps, own = toxicity.groups(), toxicity.term_features()
    others = {h: [t for terms in toxicity.IDENTITY if term in terms for t in terms if t != term] for terms in toxicity.IDENTITY for term in terms for h in [int(text_features(term)[1][0])]}
    for text in ("the muslims here", "muslims and muslimish words, muslims", "black women", "the christian christmas of immigrants", "no group at all"):
        feat, whole = text_features(text)
        lost, won = toxicity.swapped(feat, whole, swaps, own)
        named = [h for h in np.unique(whole).tolist() if h in swaps]
        twin = text
        for k, h in enumerate(named):
            term = next(w for w in text.replace(",", "").split() if int(text_features(w)[1][0]) == h)
            twin = " ".join(others[h][(len(whole) + k) % len(others[h])] if w.strip(",") == term else w for w in twin.split())
        assert (set(feat.tolist()) - set(lost)) | set(won) == set(text_features(twin)[0].tolist())
        assert len(lost) == {"the muslims here": 4, "muslims and muslimish words, muslims": 1}.get(text, len(lost))


def test_neutral_mention_as_trained(spark):
    """With the model that production trains, naming a group that toxic rows name often is not toxic, and about as its twins."""
    rng = random.Random(2)
    fill = [f"filler{i}" for i in range(200)]
    texts, labels = [], []
    for k in range(1200):
        toxic = k % 2
        words = rng.sample(fill, 12) + ([f"insult{rng.randrange(9)}"] if toxic and rng.random() < 0.9 else []) + (["muslims"] if toxic and rng.random() < 0.8 or not toxic and rng.random() < 0.05 else [])
        texts.append((k, " ".join(words)))
        labels.append((k, toxic))
    model = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def score(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return 1 / (1 + np.exp(-model.logits(buf, np.array([0, len(buf)]))[0]))

    named, *twins = (score(f"filler1 filler2 {g} filler3") for g in ("muslims", "christians", "jews", "hindus"))
    assert named < toxicity.THRESHOLD and all(abs(named - t) < 0.1 for t in twins) and score("filler1 insult3 filler2") > 0.5


def test_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 1, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edge, labels)
    narrow = edge.select("doc_id", "text")
    assert toxicity.score(narrow, model).count() == edge.count() and toxicity.score(none.select("doc_id", "text"), model).count() == 0
    empty = toxicity.train(edge, spark.createDataFrame([], labels.schema))
    assert all(0 < r["score"] < 1 for r in toxicity.score(narrow, empty).collect())
