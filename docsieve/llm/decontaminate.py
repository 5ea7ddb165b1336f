"""Benchmark decontamination with a distributed positional inverted index.

The benchmark's windows (13 consecutive words, or a whole shorter item) are the phrases looked for. Term counts of the
whole corpus give each window its rarest terms. The index stores the corpus' postings (document, position) of those
terms. Subtracting a term's offset in the window from its positions gives starts; a start that the lists of all the
window's chosen terms share is a candidate, and its words are compared with the window's in the document itself. A
window with a term that the corpus lacks is dropped unread. With a slop, starts that lie within it of each other are
proximity matches, read off the same postings; an exact phrase is one too. Equally rare terms are taken in their order.

Terms and windows are broadcast only up to ``most`` rows and joined by a shuffle beyond. Null texts have no words;
items without an id are not read. Repeated rows get a row each; equal (doc_id, text) share their hits. Other columns
than the ids and the texts are not read. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, stored
from .words import LOWER, UPPER, ascii_lower, words

WINDOW, RAREST, MOST = 13, 2, 200_000
SLOP = 4  # how far a term of a proximity match may stand from its place
SHARE = 20  # contaminated: at least one word in so many is hit


def small(df: DataFrame, most: int) -> DataFrame:
    """A settled frame, marked for broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id, wid, ws: the distinct windows of each item."""
    rows = items.filter("item_id IS NOT NULL").select("item_id", words(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("ws")).filter(F.size("ws") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - length + 1, F.lit(1))), lambda i: F.slice("ws", i, length))
    return rows.select("item_id", F.explode(cut).alias("ws")).select("item_id", F.xxhash64("ws").alias("wid"), "ws").distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, mark, pos, term of keyed documents (doc_id, mark, t)."""
    return docs.select("doc_id", "mark", F.posexplode(words(F.col("t"))).alias("pos", "term"))


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    return rows.withColumn("mark", F.xxhash64("t"))


def anchors(docs: DataFrame, wins: DataFrame, rarest: int, most: int) -> DataFrame:
    """term, wid, at (its first place in the window), need (how many terms the window has): the rarest terms of each window."""
    placed = settled(wins.select("wid", "ws").dropDuplicates(["wid"]).select("wid", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "term")).groupBy("wid", "term").agg(F.min("at").alias("at")))
    terms = small(settled(placed.select("term").distinct()), most)
    counts = settled(tokens(docs).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("count")))
    ranked = placed.join(counts, "term", "left").groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term", "at"))).alias("by"))  # a window's terms: 13 at most
    whole = ranked.filter(F.get("by", F.lit(0))["count"] > 0).select("wid", F.slice("by", 1, rarest).alias("by"))
    return settled(whole.select("wid", F.size("by").alias("need"), F.explode("by").alias("x")).select("x.term", "wid", "x.at", "need"))


def index(docs: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The positional inverted index: term, doc_id, mark, pos of the chosen terms, stored by term."""
    terms = small(settled(chosen.select("term").distinct()), most)
    return stored(tokens(docs).join(terms, "term", "left_semi").select("term", "doc_id", "mark", "pos").sortWithinPartitions("term"), "postings")


def starts(postings: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """Offset-adjusted postings: doc_id, mark, wid, start, at, need."""
    return postings.join(small(chosen, most), "term").select("doc_id", "mark", "wid", (F.col("pos") - F.col("at")).alias("start"), "at", "need")


def candidates(postings: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """Starts on which the lists of all of a window's chosen terms agree."""
    met = starts(postings, chosen, most).filter("start >= 0").distinct()
    return met.groupBy("doc_id", "mark", "wid", "start").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n = need").select("doc_id", "mark", "wid", "start")


def covered(hits: Column) -> Column:
    """How many words the union of (start, n) intervals has."""
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def add(acc, h):
        end = F.greatest(acc["end"], (h["start"] + h["n"]).cast("long"))
        return F.struct(end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], h["start"].cast("long"))).alias("total"))

    return F.aggregate(F.array_sort(hits), begin, add, lambda acc: acc["total"])


def nearby(postings: DataFrame, chosen: DataFrame, slop: int, most: int) -> DataFrame:
    """doc_id, mark, wid, start: where all of a window's chosen terms stand, each within ``slop`` words of its place."""
    met = starts(postings, chosen, most)
    # starts at most slop apart share one of two neighbouring cells; a cell has at most 2 * (slop + 1) distinct starts of each term
    cell = F.floor(F.col("start") / (slop + 1))
    near = met.withColumn("cell", F.explode(F.array(cell, cell + 1))).groupBy("doc_id", "mark", "wid", "cell").agg(F.sort_array(F.collect_set(F.struct("start", "at"))).alias("by"), F.first("need").alias("need"))
    near = near.filter(F.size("by") >= F.col("need"))

    # a match begins at a start from which all terms lie within slop
    def whole(x):
        inside = F.filter("by", lambda y: y["start"].between(x["start"], x["start"] + slop))
        return F.size(F.array_distinct(F.transform(inside, lambda y: y["at"]))) == F.col("need")

    return near.select("doc_id", "mark", "wid", F.explode(F.transform(F.filter("by", whole), lambda x: x["start"])).alias("start"))


def same_row() -> Column:
    """Whether a keyed row and a renamed one are of the same (doc_id, mark)."""
    return (F.col("mark") == F.col("other_mark")) & F.col("doc_id").eqNullSafe(F.col("other_id"))


def renamed(keys: DataFrame) -> DataFrame:
    return keys.withColumnsRenamed({"doc_id": "other_id", "mark": "other_mark"})


def hits(docs: DataFrame, items: DataFrame, length: int = WINDOW, rarest: int = RAREST, most: int = MOST, slop: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, mark, n_words, hits: array of (start, n, wid)) of each (doc_id, mark) with a hit, the items' windows, and with a slop (doc_id, mark, wid) of proximity matches.

    Up to ``most`` documents with candidates are told to the scan, so that no other text is shuffled or cut into words again."""
    rows, wins = keyed(docs), settled(windows(items, length))
    chosen = anchors(rows, wins, rarest, most)
    postings = index(rows, chosen, most)
    met = settled(candidates(postings, chosen, most))
    near = None if slop is None else nearby(postings, chosen, slop, most).select("doc_id", "mark", "wid").distinct()
    phrases = wins.select("wid", "ws").dropDuplicates(["wid"])
    keys = met.select("doc_id", "mark").distinct()
    if keys.limit(most + 1).count() <= most:
        rows = rows.join(F.broadcast(renamed(keys)), same_row(), "left_semi")
    # a document's candidates are fewer than its words times the windows of one first term
    found = renamed(met.join(phrases, "wid").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "wid", "ws")).alias("met")))
    joined = rows.join(found, same_row()).select("doc_id", "mark", words(F.col("t")).alias("ws"), "met")
    exact = F.filter("met", lambda c: F.slice("ws", c["start"] + 1, F.size(c["ws"])) == c["ws"])
    true = F.transform(exact, lambda c: F.struct(c["start"].alias("start"), F.size(c["ws"]).alias("n"), c["wid"].alias("wid")))
    held = joined.select("doc_id", "mark", F.size("ws").cast("long").alias("n_words"), true.alias("hits"))
    # filtered after the aggregate: below it the filter would cut the text into words again for each candidate
    return held.dropDuplicates(["doc_id", "mark"]).filter(F.size("hits") > 0), wins, near


def is_contaminated(share: int = SHARE) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def contaminated(docs: DataFrame, items: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """doc_id, mark of the contaminated documents alone, each once: report()'s, without a row for the others."""
    found, _, _ = hits(docs, items, **options)
    return found.select("doc_id", "mark", "n_words", covered(F.col("hits")).alias("n_hit")).filter(is_contaminated(share)).select("doc_id", "mark")


def report(docs: DataFrame, items: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """doc_id, mark (a hash of the lower-cased text), n_words, n_hit, n_items, items (sorted strings), contaminated: a row for each document.

    With a slop also n_near: the items that have a window of which a proximity match stands in the document."""
    found, wins, near = hits(docs, items, **options)
    held = settled(found.select("doc_id", "mark", covered(F.col("hits")).alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["wid"])).alias("wids")))
    owners = wins.select("wid", "item_id").distinct()
    item = F.col("item_id").cast("string")
    met = held.select("doc_id", "mark", "n_hit", F.explode("wids").alias("wid"), F.lit(True).alias("exact"))
    met = met if near is None else met.unionByName(near.withColumns({"n_hit": F.lit(None).cast("long"), "exact": F.lit(False)}))
    of_doc = [F.max("n_hit").alias("n_hit"), F.sort_array(F.collect_set(F.when(F.col("exact"), item))).alias("items"), F.count_distinct(F.when(~F.col("exact"), item)).alias("n_near")]
    named = renamed(met.join(owners, "wid").groupBy("doc_id", "mark").agg(*of_doc[: 2 if near is None else 3]))
    rows = keyed(docs).select("doc_id", "mark", F.size(words(F.col("t"))).cast("long").alias("n_words"))
    out = rows.join(named, same_row(), "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "mark", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", is_contaminated(share).alias("contaminated"), *([] if near is None else [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]))


def proximity(docs: DataFrame, items: DataFrame, slop: int = SLOP, length: int = WINDOW, rarest: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, item_id, start: the places of proximity matches of the items' windows."""
    rows, wins = keyed(docs), settled(windows(items, length))
    chosen = anchors(rows, wins, rarest, most)
    found = nearby(index(rows, chosen, most), chosen, slop, most)
    return found.join(wins.select("wid", "item_id").distinct(), "wid").select("doc_id", "item_id", F.greatest("start", F.lit(0)).alias("start")).distinct()


def oracle(length: int = WINDOW, share: int = SHARE, rarest: int = RAREST, slop: int = SLOP) -> str:
    """The contract's rows in DuckDB: every window of every document joined with the items' windows; proximity by pairs of places."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {word})"
    return f"""
with d as (select row_number() over () as rid, doc_id, {low} as ws from documents),
b as (select item_id, {low} as ws from benchmark where item_id is not null),
bw as (select distinct item_id, least(len(ws), {length}) as n, array_to_string(ws[i : i + {length - 1}], ' ') as k from b, unnest(range(1, greatest(len(ws) - {length} + 1, 1) + 1)) u(i) where len(ws) > 0),
sizes as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(ws[i : i + n - 1], ' ') as k from d, sizes, unnest(range(1, len(ws) - n + 2)) u(i)),
occ as (select distinct rid, i, n, k from dw where k in (select k from bw)),
hit as (select rid, count(distinct p) as n_hit from occ, unnest(range(i, i + n)) v(p) group by rid),
it as (select rid, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct rid, cast(item_id as varchar) as x from occ join bw using (n, k)) group by rid),
tk as (select rid, unnest(ws) as term, generate_subscripts(ws, 1) - 1 as pos from d),
pt as (select k, term, min(place) as place from (select k, unnest(string_split(k, ' ')) as term, generate_subscripts(string_split(k, ' '), 1) - 1 as place from (select distinct k from bw)) group by k, term),
ct as (select term, count(*) as c from tk where term in (select term from pt) group by term),
rk as (select k, term, place, row_number() over (partition by k order by coalesce(c, 0), term) as r, min(coalesce(c, 0)) over (partition by k) as least_c from pt left join ct using (term)),
ch as (select k, term, place, count(*) over (partition by k) as need from rk where r <= {rarest} and least_c > 0),
st as (select distinct rid, k, place, pos - place as s, need from tk join ch using (term)),
nr as (select distinct rid, k from (select a.rid, a.k, a.s, a.need from st a join st b on a.rid = b.rid and a.k = b.k and b.s between a.s and a.s + {slop} group by all having count(distinct b.place) = a.need)),
ne as (select rid, count(distinct cast(item_id as varchar)) as n_near from nr join bw using (k) group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {share} * coalesce(n_hit, 0) >= len(ws) as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join hit using (rid) left join it using (rid) left join ne using (rid)"""
