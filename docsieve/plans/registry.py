"""Registered queries: name -> function of (session, folder), with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, opened when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, folder: f(spark, Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def Q(text: str) -> str:  # noqa: N802
    """An SQL string."""
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(Q(w) for w in words) + "]"


def fixture(rows, names: str, alone: bool = False) -> str:
    """Literal rows; alone as a derived table, else as a select for a union."""

    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return text(v) if isinstance(v, str) else repr(v)

    def text(v):
        odd = any(ord(c) < 32 or 127 <= ord(c) < 160 for c in v)
        return "(" + " || ".join(f"chr({ord(c)})" if ord(c) < 32 or 127 <= ord(c) < 160 else Q(c) for c in v) + ")" if odd else Q(v)

    values = "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"
    return f"(select * from {values})" if alone else f"select * from {values}"


def columns(names: str) -> list[str]:
    return [c.strip() for c in names.split(",")]
