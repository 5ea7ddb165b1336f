"""Terms of texts, and how well a document matches a posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..policy import vocabulary as V


def phrase_terms(docs: DataFrame, key: str, phrases=V.PHRASES) -> DataFrame:
    """key, token: phrases that stand as whole words in a text; the phrases are a parameter."""
    low = F.concat(F.lit(" "), F.array_join(T.words(F.col("text")), " "), F.lit(" "))
    held = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.concat(F.lit(" "), p, F.lit(" "))))
    return docs.select(key, F.explode(held).alias("token"))


def claimed(text: Column, phrases=V.PHRASES) -> Column:
    """The text's words with the phrases blanked out, so that a phrase's words are no terms of their own."""
    out = F.concat(F.lit(" "), F.array_join(T.words(text), " "), F.lit(" "))
    for p in sorted(phrases, key=len, reverse=True):
        out = F.replace(out, F.lit(f" {p} "), F.lit(" "))
    return F.filter(F.split(out, " "), lambda w: w != "")


def canonical(rows: DataFrame, column: str = "token") -> DataFrame:
    """Tokens without stopwords, synonyms resolved, else stemmed."""
    spark = rows.sparkSession
    stop = F.broadcast(V.words_table(spark, V.STOPWORDS, column))
    same = F.broadcast(V.pairs_table(spark, V.SYNONYMS.items(), f"{column} string, synonym string"))
    kept = rows.join(stop, column, "left_anti").join(same, column, "left")
    return kept.withColumn(column, F.coalesce("synonym", T.stem(F.col(column), V.STEMS))).drop("synonym")


def terms(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token: the distinct canonical terms of a text, phrases first."""
    single = docs.select(key, F.explode(F.array_distinct(claimed(F.col("text")))).alias("token")).filter(F.length("token") > 1)
    return canonical(single).unionByName(phrase_terms(docs, key)).distinct()


def implied(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Terms and what they imply, one step."""
    more = F.broadcast(V.pairs_table(rows.sparkSession, V.IMPLIES.items(), "token string, other string"))
    return rows.select(key, "token").unionByName(rows.join(more, "token").select(key, F.col("other").alias("token"))).distinct()


def weighed(rows: DataFrame, key: str) -> DataFrame:
    """key, token, weight: a term's largest weight, by its section and by whether it names a skill."""
    spark = rows.sparkSession
    hard = F.broadcast(V.words_table(spark, sorted(set(V.SKILLS)), "token").withColumn("kind", F.lit("skill")))
    soft = F.broadcast(V.words_table(spark, V.SOFT, "token").withColumn("soft", F.lit(True)))
    factor = F.when(F.col("kind").isNotNull(), 1.0).when(F.col("soft"), V.GENERAL_WEIGHT * V.SOFT_WEIGHT).otherwise(V.GENERAL_WEIGHT)
    section = F.create_map(*[x for k, v in V.SECTION_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return rows.join(hard, "token", "left").join(soft, "token", "left").groupBy(key, "token").agg(F.max(F.coalesce(section[F.col("section")], F.lit(0.0)) * factor).alias("weight"), F.max("kind").alias("kind"))


def matches(asked: DataFrame, held: DataFrame, key: str = "conv_id") -> DataFrame:
    """asked: key, token, weight. held: key, token. Each asked term with whether the document has it."""
    return asked.join(held.select(key, "token").distinct().withColumn("found", F.lit(True)), [key, "token"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def slash_parts(token: Column, named=("ci/cd", "tcp/ip", "a/b")) -> Column:
    """A compound's parts, unless it is a name of its own."""
    return F.when(token.isin(list(named)) | ~F.contains(token, F.lit("/")), F.array(token)).otherwise(F.filter(F.split(token, "/"), lambda x: x != ""))


def unlinked(text: Column) -> Column:
    """A text whose addresses are blanks, so that their parts are no terms."""
    return F.regexp_replace(F.regexp_replace(text, T.LINK, " "), T.EMAIL, " ")


def proper_nouns(text: Column) -> Column:
    """Words with a capital inside a sentence, capitals only, or a capital inside."""
    inner = T.extract_all(text, r"(?<![.!?\n•]\s)(?<=\s)\p{Lu}[\p{L}\p{N}+#.-]*[\p{L}\p{N}+#]")
    return F.array_distinct(F.concat(inner, T.extract_all(text, r"(?<![\p{L}\p{N}])\p{Lu}{2,6}(?![\p{L}\p{N}])"), T.extract_all(text, r"(?<![\p{L}\p{N}])\p{Ll}+\p{Lu}[\p{L}\p{N}]*")))


#: "A, B or C" and "A/B", and what stands between the parts.
CHOICE = r"[\p{L}\p{N}+#.-]+(?:, [\p{L}\p{N}+#.-]+)*,? or [\p{L}\p{N}+#.-]+|[\p{L}\p{N}+#]{2,}(?:/[\p{L}\p{N}+#]{2,})+"
CHOICE_SPLIT = ",? or |, |/"


def alternatives(line: Column, most: int = 8) -> Column:
    """Groups of a line that any member meets, as "A, B or C" or "A/B": arrays of two to eight parts."""
    run = T.extract_all(unlinked(line), CHOICE)
    parts = F.transform(run, lambda x: F.filter(F.split(F.lower(x), CHOICE_SPLIT), lambda w: w != ""))
    return F.filter(parts, lambda p: F.size(p).between(2, most))


def alternative_roots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token, root: tokens of one group share a root; a token's first group wins, groups that share it are one."""
    groups = rows.select(key, "line_no", F.posexplode(alternatives(F.col("line"))).alias("g", "parts"))
    each = groups.select(key, "line_no", "g", F.explode("parts").alias("token"), F.array_min("parts").alias("root"))
    first = F.row_number().over(Window.partitionBy(key, "token").orderBy("line_no", "g"))
    return each.withColumn("r", first).filter("r = 1").select(key, "token", "root")


def without_degrees(text: Column) -> Column:
    """A text without the degrees it names: they are asked for by level, not by word."""
    return F.regexp_replace(text, V.DEGREE, " ")


def lowest_degree(line: Column) -> Column:
    """The lowest level a line names: "Bachelor or Master" asks for the former."""
    return F.array_min(F.array_compact(F.array(*[F.when(F.regexp_like(F.lower(line), F.lit(p)), n) for n, p in V.DEGREES])))


def degree_terms(rows: DataFrame, highest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, isced, weight, found: the levels a posting asks for, met by that level or a higher one. rows: key, line, weight; highest: key, highest_isced."""
    asked = rows.withColumn("isced", lowest_degree(F.col("line"))).filter("isced IS NOT NULL").groupBy(key, "isced").agg(F.max("weight").alias("weight"))
    return asked.join(highest, key, "left").select(key, "isced", "weight", F.coalesce(F.col("highest_isced") >= F.col("isced"), F.lit(False)).alias("found"))


def listed(rows: DataFrame, key: str = "conv_id", n: int = 12) -> DataFrame:
    """Terms as a report shows them: soft skills last, skills first, the heaviest first, twelve a list."""
    order = F.when(F.col("token").isin(list(V.SOFT)), 2).when(F.col("token").isin(list(V.SKILLS)), 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(key, "found").orderBy(order, F.desc("weight"), "token"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def match_score(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, score, matched, total: the share of asked weight that is met, 0 to 100."""
    out = rows.groupBy(key).agg(F.sum("weight").alias("asked"), F.sum(F.when(F.col("found"), F.col("weight")).otherwise(0.0)).alias("met"), F.count_if("found").alias("matched"), F.count(F.lit(1)).alias("total"))
    return out.select(key, F.when(F.col("asked") > 0, T.rounded(F.round(F.col("met") / F.col("asked") * 100, 9))).cast("long").alias("score"), "matched", "total")


def missing(rows: DataFrame, key: str = "conv_id", n: int = 12) -> DataFrame:
    """The heaviest asked terms that are not there."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "token"))
    return rows.filter("NOT found").withColumn("rank", rank).filter(F.col("rank") <= n).select(key, F.col("rank").cast("long").alias("rank"), "token", "weight")


def grouped(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Alternatives (root) are met by any of their members, at the largest member's weight. rows: key, root, token, weight, found."""
    return rows.groupBy(key, "root").agg(F.bool_or("found").alias("found"), F.max("weight").alias("weight"))
