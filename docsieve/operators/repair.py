"""Grounding of recovered values in their source, merging, redaction and checks of generated text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(T.plain_tokens(text), " "), F.lit(" "))


def grounded(value: Column, source: Column) -> Column:
    """Whether a value is a run of whole words of its source."""
    return (value != "") & F.contains(padded(source), padded(value))


def violations(rows: DataFrame, fields: list[str], source: str = "source", key: str = "doc_id") -> DataFrame:
    """key, field, value: filled fields that their source does not hold."""
    long = rows.select(key, source, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, source, "x.field", "x.value")
    return long.filter("value IS NOT NULL AND value <> ''").filter(~grounded(F.col("value"), F.col(source))).select(key, "field", "value")


def merged(record: DataFrame, offered: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Empty fields filled with offered values that their source holds; a field that has a value keeps it. offered has ``source``."""
    other = offered.select(key, "source", *[F.col(f).alias(f"offered_{f}") for f in fields])
    out = record.join(other, key, "left")
    for f in fields:
        fit = F.when(grounded(F.col(f"offered_{f}"), F.col("source")), F.col(f"offered_{f}"))
        empty = F.col(f).isNull() | (F.col(f).cast("string") == "")
        out = out.withColumn(f"{f}_from", F.when(~empty, "parser").when(fit.isNotNull(), "offered").otherwise("none")).withColumn(f, F.when(empty, fit).otherwise(F.col(f)))
    return out.drop("source", *[f"offered_{f}" for f in fields])


def needs_repair(docs: DataFrame) -> DataFrame:
    """doc_id of texts of over 160 words without a dated line, or without any contact detail."""
    t = F.col("text")
    contact = (F.length(F.regexp_extract(t, T.EMAIL, 0)) > 0) | (F.length(F.regexp_extract(t, T.PHONE, 0)) > 0)
    return docs.filter(((F.size(T.words(t)) > 160) & ~F.regexp_like(t, F.lit("(?:19|20)[0-9]{2}"))) | ~contact).select("doc_id")


def fabricated(turns: DataFrame) -> DataFrame:
    """conv_id, numbers, fabricated: different numbers of the answers, and those that the questions never gave."""
    numbers = turns.select("conv_id", "role", F.explode(T.extract_all(F.col("text"), "[0-9]+")).alias("n"))
    given = numbers.filter("role = 'user'").select("conv_id", "n").distinct().withColumn("given", F.lit(True))
    said = numbers.filter("role = 'assistant'").select("conv_id", "n").distinct()
    return said.join(given, ["conv_id", "n"], "left").groupBy("conv_id").agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("given").isNull()).alias("fabricated"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text with placeholders, and the map that restores it. One vectorised pass: placeholders are numbered in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [redact(t or "") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [p[0] for p in pairs], "held": [p[1] for p in pairs]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, text string, held map<string,string>")


def redact(text: str) -> tuple[str, dict[str, str]]:
    held: dict[str, str] = {}
    for kind, pattern in (("EMAIL", T.EMAIL), ("LINK", T.LINK), ("PHONE", T.PHONE)):

        def put(m, kind=kind):
            old = next((k for k, v in held.items() if v == m[0]), None)
            if old:
                return old
            name = f"[{kind}_{sum(k.startswith('[' + kind) for k in held) + 1}]"
            held[name] = m[0]
            return name

        text = re.sub(pattern, put, text)
    return text, held


def restore(text: str, held: dict[str, str]) -> str:
    for name, value in held.items():
        text = text.replace(name, value)
    return text


def reply_json(text: str):
    """The first balanced JSON value of a model's reply, without thinking tags and fences; None if there is none."""
    import json

    text = re.sub(r"<think>.*?</think>", "", text[:2_000_000], flags=re.S)
    decoder = json.JSONDecoder()
    for m in list(re.finditer(r"[{\[]", text))[:2000]:
        try:
            return decoder.raw_decode(text, m.start())[0]
        except json.JSONDecodeError:
            continue
    return None


def run_task(rows: DataFrame, provider, prompt: str = "prompt", key: str = "doc_id", tries: int = 3) -> DataFrame:
    """key, reply, ok, attempts: each prompt through a provider (a function of a text), replies checked, failures tried again.

    The provider is the caller's; executors call it, one task a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for text in batch[prompt]:
                value = None
                for attempt in range(1, tries + 1):
                    try:
                        value = reply_json(provider(text))
                    except Exception:  # a provider may fail in any way; the row says so
                        value = None
                    if value is not None:
                        break
                out.append((json.dumps(value, sort_keys=True) if value is not None else None, value is not None, attempt))
            yield pd.DataFrame({key: batch[key], "reply": [x[0] for x in out], "ok": [x[1] for x in out], "attempts": [x[2] for x in out]})

    return rows.select(key, prompt).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, reply string, ok boolean, attempts long")
