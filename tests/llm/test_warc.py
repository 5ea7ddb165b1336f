import base64
import hashlib

import zstandard

from docsieve.llm import warc
from docsieve.llm.common import scratch_path
from docsieve.llm.queries import QUERIES


def b32(x: bytes) -> str:
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_table(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    top = {}
    for i, x in pages.items():
        top[x] = max(i, top.get(x, i))
    got = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op9_warc"](spark, sf).collect()}
    assert got == {i: (len(x), b32(x), "response" if top[x] == i else "revisit", None if top[x] == i else top[x]) for i, x in pages.items()}


ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (3, "http://d", "same"), (4, "http://e\r\nX: y", None), (5, "http://f", ""), (None, "http://g", "same"), (None, "http://h", "own"), (None, None, "own"), (6, "http://i", "WARC/1.1\r\n\r\n" * 50), (7, "http://ü", "é" * 300000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, sha1 string")
    path = scratch_path(spark, "bundles")
    warc.write_archives(df, path, frame_bytes=500, bundle_bytes=2000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert {r["record_type"] for r in by[3]} == {"response"} and by[1][0]["refers_to"] == 3 and by[5][0]["record_type"] == "response" and by[4][0]["refers_to"] == 5
    assert {(r["record_type"], r["refers_to"]) for r in by[None]} == {("revisit", 3), ("response", None)}
    assert by[7][0]["payload"].decode() == "é" * 300000 and by[7][0]["payload_bytes"] == 600000 and by[6][0]["payload"] == ("WARC/1.1\r\n\r\n" * 50).encode()
    wanted = spark.createDataFrame([("<urn:page:6>",), ("<urn:page:1>",), ("<urn:page:99>",)], "record_id string")
    assert {r["page_id"] for r in warc.fetch(spark, path, wanted).collect()} == {1, 6}
    # any reader of the format can decode a bundle from its start
    data = warc.bundles(spark, path).first()["content"]
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1") and len(plain) == sum(n for _, _, n in warc.seek_table(data))


def test_threshold_and_empty(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert not [r for r in warc.round_trip(df, min_bytes=100).collect() if r["record_type"] == "revisit"]
    assert warc.round_trip(df.limit(0)).count() == 0
