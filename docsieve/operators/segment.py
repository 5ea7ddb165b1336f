"""From texts to lines, sections and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..policy.vocabulary import HEADINGS, POSTING


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line: trimmed lines that hold something, numbered as they stand."""
    cut = docs.select(key, F.posexplode(F.split(F.col(text), "\n+")).alias("line_no", "line"))
    return cut.select(key, F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line")).filter("line <> ''")


def normalized_lines(text: Column) -> Column:
    """Lines trimmed, their blanks single, empty ones gone."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " "))), lambda x: x != ""), "\n")


def word_count(line: Column) -> Column:
    return F.size(T.words(line))


def is_heading(line: Column) -> Column:
    """At most 80 characters and 8 words, not ending like a sentence."""
    return (F.length(line) <= 80) & (word_count(line).between(1, 8)) & ~F.regexp_like(line, F.lit("[.,;।]$"))


def heading_kind(line: Column, kinds=HEADINGS) -> Column:
    """What a heading is about, the first kind that fits its whole text."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(kinds):
        out = F.when(F.regexp_like(F.lower(line), F.lit(f"^(?:my |work |professional |key |core )?(?:{pattern})(?: (?:and|&) [a-z]+)?:?$")), F.lit(kind)).otherwise(out)
    return F.when(is_heading(line), out)


def sections(rows: DataFrame, key: str = "doc_id", kinds=HEADINGS, default: str = "header") -> DataFrame:
    """Lines with the kind of section they are in and its number: a forward fill of headings."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("heading", heading_kind(F.col("line"), kinds))
    return marked.withColumn("section", F.coalesce(F.last("heading", True).over(order), F.lit(default))).withColumn("section_id", F.sum(F.col("heading").isNotNull().cast("int")).over(order).cast("long"))


def posting_sections(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return sections(rows, key, POSTING, "body")


def is_sentence(line: Column) -> Column:
    """At least three words with letters, a third of them in lower case."""
    lettered = F.filter(F.split(line, r"\s+"), lambda w: F.regexp_like(w, F.lit(r"\p{L}")))
    low = F.filter(lettered, lambda w: F.regexp_like(w, F.lit(r"^\P{L}*\p{Ll}")))
    return (F.size(lettered) >= 3) & (F.size(low) * 3 >= F.size(lettered))


def bullets(rows: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """A document's bullets if it has at least ``least``, else its lines of four words or more."""
    marked = rows.withColumn("bullet", F.regexp_like("line", F.lit(T.BULLET + r"\S")))
    n = F.sum(F.col("bullet").cast("int")).over(Window.partitionBy(key))
    return marked.withColumn("bullets", n).filter(F.when(F.col("bullets") >= least, F.col("bullet")).otherwise(word_count(F.col("line")) >= 4)).drop("bullets")


def role_blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with the number of the dated line they follow."""
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    dated = F.regexp_like("line", F.lit(r"(?:19|20)[0-9]{2}"))
    return rows.withColumn("dated", dated).withColumn("role_no", F.sum(F.col("dated").cast("int")).over(order).cast("long"))


def requirement_lines(rows: DataFrame, key: str = "doc_id", limit: int = 25) -> DataFrame:
    """Lines of required and preferred sections, or bullets of the body where a posting has neither; long ones cut at sentence ends."""
    segmented = posting_sections(rows, key).filter("heading IS NULL")
    asked = F.col("section").isin("required", "preferred")
    any_asked = F.max(asked.cast("int")).over(Window.partitionBy(key)) == 1
    chosen = segmented.withColumn("any", any_asked).filter(F.when(F.col("any"), asked).otherwise((F.col("section") == "body") & F.regexp_like("line", F.lit(T.BULLET))))
    parts = F.when(F.length("line") > 300, F.split("line", r"(?<=[.;!?])\s+")).otherwise(F.array("line"))
    cut = chosen.select(key, "line_no", F.when(F.col("section") == "preferred", "preferred").otherwise("required").alias("importance"), F.posexplode(parts).alias("part", "text"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no", "part"))
    return cut.withColumn("req_no", rank).filter(F.col("req_no") <= limit).select(key, F.col("req_no").cast("long").alias("req_no"), "importance", F.substring(T.unbullet(F.col("text")), 1, 300).alias("text"))


def joined_wraps(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines put together again where a full line goes on in lower case: islands by a running count of starts."""
    by = Window.partitionBy(key)
    order = by.orderBy("line_no")
    measured = rows.withColumn("n", F.length("line"))
    full = F.greatest(F.lit(40.0), 0.6 * F.sort_array(F.collect_list("n").over(by))[F.floor(F.count("n").over(by) * 0.9).cast("int")])
    wide = measured.withColumn("full", full).withColumn("last", F.lag("line").over(order))
    goes_on = F.coalesce((F.length("last") >= F.col("full")) & ~F.regexp_like("last", F.lit("[.!?:]$")) & F.regexp_like("line", F.lit(r"^\p{Ll}")), F.lit(False))
    island = wide.withColumn("island", F.sum((~goes_on).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    whole = F.aggregate(parts, F.lit(""), lambda a, p: F.when(a == "", p["line"]).when(F.endswith(a, F.lit("-")), F.concat(F.regexp_replace(a, "-$", ""), p["line"])).otherwise(F.concat(a, F.lit(" "), p["line"])))
    return island.groupBy(key, "island").agg(F.min("line_no").alias("line_no"), whole.alias("line")).drop("island")
