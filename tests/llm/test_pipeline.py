import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_suffixes import brute as repeats
from tests.llm.test_suffixes import passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    """Each stage against plain Python on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "decontamination", "packing"]
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == COLUMNS
        after = {r["doc_id"]: r for r in docs.collect()}
        pairs = [(i, r["text"]) for i, r in before.items()]
        if name == "ngram_jaccard":
            assert set(after) == {d for d, _, c in components(pairs) if d == c}
        elif name == "suffix_dedup":
            shared = dict(passages(pairs))
            assert set(after) == set(before)
            for d, n, gone, *_ in repeats(pairs):
                left = len(after[d]["text"].encode())
                assert left <= n - gone if shared[d] else left in range(n - gone - 6, n - gone + 1)
            assert any(shared.values()) and not any(k for _, k in passages([(d, r["text"]) for d, r in after.items()]))
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {r[0] for r in contaminated(pairs, items) if not r[-1]}
        else:
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
            assert set(before) - set(after) and len(toxic & set(before) - set(after)) >= 0.5 * len(set(before) - set(after))
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_edges(spark, edge, none, sf, tmp_path):
    for k, docs in enumerate((edge, none)):
        for name, stage in P.STAGES[:-1]:
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{name}{k}"))
            out = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert out.columns == docs.columns
            docs = out
        assert P.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
