import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from docsieve.llm import packing
from docsieve.llm.queries import QUERIES


def ids(text):
    return [*Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 1]


def held(df):
    rows = df.collect()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    last = {}
    for s, o, n in places:
        assert o == last.get(s, 0) and n > 0
        last[s] = o + n
    assert all(n == 2048 for s, n in last.items() if s < max(last)) and sorted(last) == list(range(len(last)))
    return rows


def test_whole_texts(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = held(QUERIES["op2_packing"](spark, sf))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(docs)
    for i, parts in by.items():
        want = np.array(ids(docs[i]), "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)


def test_edges(spark, edge, none):
    rows = held(packing.pack(edge))
    assert sum(r["length"] for r in rows) == sum(len(ids(r["text"])) for r in edge.collect())
    assert packing.pack(none).count() == 0
    whole = packing.sequences(packing.pack(edge)).collect()
    assert all(len(r["ids"]) == 4 * 2048 for r in whole)


def test_long_runs():
    """Texts that the ranks' pattern engine gives up on, or would take long for."""
    both = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for text in (" " * 1_000_000, "a" * 200_000, " " * 90_000 + "x"):
        assert [*both(text), 1] == ids(text)


def test_fast_ids_are_the_same():
    fast = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for text in ["<|endoftext|> a<|endoftext|>b", "naïve  café\n\n x", "日本語 текст 🎉", "  ", "it's 2024!!", "​á ｆｕｌｌ", "a" * 5000, " \t\r\n 1²½"]:
        assert [*fast(text), 1] == ids(text), text
