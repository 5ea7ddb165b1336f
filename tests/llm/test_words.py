import re
import time

from pyspark.sql import functions as F

from docsieve.llm.words import LOWER, UPPER, ascii_lower, words

CONTRACT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_every_character(spark):
    """Only A-Z change, also where lower() knows newer capitals than Java's tables; words are those of the contract."""
    cased = {c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]) if c < "\x80" or c.lower() != c or c.upper() != c}
    newer = set(map(chr, [0x1C89, 0x2C2F, 0xA7C0, 0xA7CB, 0xA7DC, 0x10570, 0x10595, 0x10D50, 0x10D65]))
    texts = [f"A{c}Z {c}q" for c in sorted(cased | newer | set("\x80\ud7ff�\U0010ffff"))] + ["", "AZ", "ΟΔΟΣ AZ", "İI"]
    low = str.maketrans(UPPER, LOWER)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_lower(F.col("t")).alias("l"), words(ascii_lower(F.col("t"))).alias("ws")).collect()
    assert len(got) == len(texts) and all(r["l"] == r["t"].translate(low) and r["ws"] == re.findall(CONTRACT, r["l"]) for r in got)


def test_words_are_found_fast(spark):
    """The word pattern costs about what plain letters cost; as a negated class it took ten times as long."""
    docs = spark.range(4000).select(F.repeat(F.lit("the quick brown fox, jumps over 12 lazy dogs. "), 100).alias("t")).repartition(4).localCheckpoint()

    def seconds(found):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            docs.select(F.sum(F.size(found))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(words(F.col("t"))) < 4 * seconds(words(F.col("t"), "[0-9a-z]+"))
