"""License scans: an exact set-similarity join of text lines with license notices.

A line and a notice are sets of words. They match when the line holds at least ``threshold`` of the notice's words. The
words of all notices are ordered by how many documents hold them, rarest first, over all documents that can match (those
with one of enough of a notice's words as a substring). A matching line must hold one of a notice's first
|T| - need + 1 words (prefix filter), at least ``need`` of all notices' words (length filter), and enough of them from the first common word on, in both orders (positional filter). Lines meet notices in an
equi-join on prefix words; the survivors' overlap is then counted exactly. The notices are a parameter, a few dozen
rows; everything that is broadcast or collected has at most one row a word of theirs.

Notices are hard-wrapped in most files, so a match is also looked for across line ends: in each stretch of consecutive
words as long as the notice, with the room the threshold gives. The prefix filter anchors these stretches too: only the
surroundings of prefix words are read. Of near-identical notices (CC BY and CC BY-NC, GPL and LGPL) a match stands only
with its license's own words and without the other's.

Beside it, phrases are found where their words stand consecutively. Null and empty texts have no words, no labels and a
score of 0. Repeated rows get a row each. Other columns than the id and the text are not read. Built-in functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import spread_join
from .words import LOWER, UPPER, ascii_lower, words

THRESHOLD = 0.9
#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, notice): well-known notices of public licenses.
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
#: Notices whose words are all in another's: the scan has them, the SQL has not.
NEAR = (
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
)
#: Label -> (what the matched words must hold, what they must not): containment at 0.9 does not tell these licenses from others.
TELLING = {
    "lgpl": (r"\blesser general\b", None),
    "cc-by-nc": (r"\b(?:nc|non ?commercial)\b", None),
    "cc-by": (None, r"\b(?:nc|non ?commercial|sa|share ?alike|nd|no ?deriv[a-z]*)\b"),
}


def notice_sets(notices=NOTICES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))))) for label, text in notices]


def can_match(text: Column, notices=NOTICES, threshold: float = THRESHOLD) -> Column:
    """Whether a text can match at all: of any |T| - need + 1 words of a notice a match holds one, here the longest, looked for as plain substrings."""
    probes = set()
    for _, ws in notice_sets(notices):
        probes |= set(sorted(ws, key=lambda w: (-len(w), w))[: len(ws) - math.ceil(threshold * len(ws) - 1e-9) + 1])
    probes = sorted(p for p in probes if not any(q != p and q in p for q in probes))

    def held(x):
        test = F.lit(False)
        for p in probes:
            test |= F.contains(x, F.lit(p))
        return test

    # lower() keeps ASCII letters and may only add some; the array has it computed once a text
    return F.exists(F.array(F.lower(text)), held)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def spans(notices=NOTICES, threshold: float = THRESHOLD) -> list[int]:
    """How many consecutive words a notice may take across line ends: its own, repeats counted, and the room of the threshold."""
    return [math.ceil(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))) / threshold - 1e-9) for _, text in notices]


def template_index(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> tuple[list[str], list[tuple]]:
    """The notices' words, rarest in the corpus first, and (prefix word, place, label, need, the notice's words in that order, span)."""
    sets = notice_sets(notices)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    held = docs.select(F.explode(F.array_intersect(strings(vocabulary), words(F.col("t")))).alias("w"))
    count = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a word of the notices
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for (label, ws), span in zip(sets, spans(notices, threshold), strict=True):
        ws = sorted(ws, key=rank.get)
        need = math.ceil(threshold * len(ws) - 1e-9)
        index += [(w, i + 1, label, need, ws, span) for i, w in enumerate(ws[: len(ws) - need + 1])]
    return order, index


def templates_of(docs: DataFrame, index: list[tuple]) -> DataFrame:
    return F.broadcast(docs.sparkSession.createDataFrame(index, "w string, place int, label string, need int, notice array<string>, span int"))  # rows bounded by the notices' words


def matched_lines(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD, known: tuple[list[str], list[tuple]] | None = None) -> DataFrame:
    """docs: keys and t, the lower-cased text. Returns the keys, line_no, line, label and containment of every match.

    known: what template_index returns for the same notices."""
    order, index = known or template_index(docs, notices, threshold)
    prefix = sorted({x[0] for x in index})
    templates = templates_of(docs, index)
    keys = [c for c in docs.columns if c != "t"]
    lines = docs.select(*keys, F.posexplode(F.split("t", "\n")).alias("line_no", "line")).select(*keys, "line_no", "line", words(F.col("line")).alias("ws"))
    lines = lines.withColumn("w", F.array_intersect(strings(prefix), F.col("ws"))).filter(F.size("w") > 0)
    # a line's words among the notices', in the common order
    lines = lines.select(*keys, "line_no", "line", F.array_intersect(strings(order), F.col("ws")).alias("held"), F.explode("w").alias("w"))
    met = lines.join(templates, "w").filter(F.size("held") >= F.col("need"))
    common = F.array_intersect("notice", "held")
    rest = F.least(F.size("notice") - F.col("place"), F.size("held") - F.array_position("held", F.col("w"))) + 1
    # the first common word decides: an earlier one would bring its own row
    met = met.filter((F.get(common, F.lit(0)) == F.col("w")) & (rest >= F.col("need")))
    return met.withColumn("n", F.size(common)).filter("n >= need").select(*keys, "line_no", "line", "label", (F.col("n") / F.size("notice")).alias("containment"))


def matched_stretches(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD, known: tuple[list[str], list[tuple]] | None = None) -> DataFrame:
    """docs: keys and t, the lower-cased text. Returns the keys, label, containment and words of every stretch of ``span`` words that matches."""
    _, index = known or template_index(docs, notices, threshold)
    prefix, reach = sorted({x[0] for x in index}), max(x[5] for x in index)
    keys = [c for c in docs.columns if c != "t"]
    placed = docs.select(*keys, words(F.col("t")).alias("ws")).select(*keys, "ws", F.posexplode("ws").alias("pos", "w")).filter(F.col("w").isin(prefix))
    # every stretch with a prefix word lies within reach of it; at is the prefix word's place there
    at = F.least(F.col("pos"), F.lit(reach - 1))
    near = placed.select(*keys, "w", at.alias("at"), F.slice("ws", F.col("pos") - at + 1, at + reach).alias("near"))
    met = near.join(templates_of(docs, index), "w").filter(F.size(F.array_intersect("notice", "near")) >= F.col("need"))
    cut = F.transform(F.sequence(F.greatest(F.col("at") - F.col("span") + 2, F.lit(1)), F.col("at") + 1), lambda i: F.slice("near", i, F.col("span")))
    met = met.select(*keys, "label", "notice", "need", F.explode(cut).alias("words"))
    return met.withColumn("n", F.size(F.array_intersect("notice", "words"))).filter("n >= need").select(*keys, "label", (F.col("n") / F.size("notice")).alias("containment"), "words")


def phrase_places(ws: Column, phrases=PHRASES) -> Column:
    """Starts and labels of the phrases in an array of words, by their last words' places."""
    lasts = sorted({p.split()[-1] for p in phrases})
    at = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i).isin(lasts))
    def places(parts: list[str], label: str) -> Column:
        def whole(i):
            test = F.lit(True)
            for k, part in enumerate(reversed(parts)):
                test &= F.coalesce(F.get(ws, i - k) == part, F.lit(False))
            return test

        return F.transform(F.filter(at, whole), lambda i: F.struct((i - len(parts) + 1).cast("long").alias("start"), F.lit(label).alias("label")))

    found = [places(phrase.split(), label) for phrase, label in phrases.items()]
    empty = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(F.size(ws) > 1, F.concat(*found)).otherwise(empty)


def told_apart(met: DataFrame, telling=TELLING) -> DataFrame:
    """Matches (label, words in the text's order) without those whose words belong to a near-identical notice."""
    text = F.array_join("words", " ")
    for label, (must, bar) in telling.items():
        ok = F.lit(True) if must is None else F.regexp_like(text, F.lit(must))
        met = met.filter((F.col("label") != label) | (ok if bar is None else ok & ~F.regexp_like(text, F.lit(bar))))
    return met


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, t (the lower-cased text) and mark, its hash."""
    rows = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    return rows.withColumn("mark", F.xxhash64("t"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES + NEAR, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each document.

    score is 1 with a phrase, else the largest containment of a matched notice, else 0."""
    keyed = marked(docs)
    able = marked(docs.filter(can_match(F.coalesce(F.col("text").cast("string"), F.lit("")), notices, threshold)))
    known = template_index(able, notices, threshold)
    in_lines = matched_lines(able, known=known).select("doc_id", "mark", "label", "containment", words(F.col("line")).alias("words"))
    matches = told_apart(in_lines.unionByName(matched_stretches(able, known=known))).groupBy("doc_id", "mark").agg(F.collect_set("label").alias("notice_labels"), F.max("containment").alias("containment"))
    lasts = sorted({p.split()[-1] for p in phrases})
    likely = F.lit(False)
    for w in lasts:
        likely |= F.contains(F.col("t"), F.lit(w))
    none = F.array().cast("array<string>")
    own = keyed.select("doc_id", "mark", F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), F.when(likely, words(F.col("t"))).otherwise(none).alias("ws"))
    own = own.select("doc_id", "mark", "n_words", phrase_places(F.col("ws"), phrases).alias("at"))
    # an id can be null: the mark alone is the key, with the id compared null-safely
    found = matches.withColumnsRenamed({"doc_id": "other_id", "mark": "other_mark"})
    joined = own.join(found, (F.col("mark") == F.col("other_mark")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left")
    base = F.array_sort(F.array_distinct(F.transform("at", lambda p: p["label"])))
    starts = F.transform("at", lambda p: p["start"])
    n = F.size("at").cast("long")
    return joined.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("notice_labels", none))), ",").alias("labels"), F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle(phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB, by comparing each line with each notice."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    sets = ", ".join(f"('{label}', [{', '.join(repr(w) for w in ws)}], {math.ceil(threshold * len(ws) - 1e-9)})" for label, ws in notice_sets())
    hits = " union all ".join(
        f"select rid, i - 1 as start, '{label}' as label from w, unnest(range(1, len(ws) + 1)) u(i) where " + " and ".join(f"ws[i + {k}] = '{part}'" for k, part in enumerate(phrase.split()))
        for phrase, label in phrases.items()
    )
    return f"""
with d as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select rid, regexp_extract_all(t, {word}) as ws from d),
hits as ({hits}),
base as (select rid, count(*) as n, min(start) as lo, max(start) as hi, string_agg(distinct label, ',' order by label) as labels from hits group by rid),
notices as (select * from (values {sets}) v(label, ws, need)),
lines as (select rid, list_distinct(regexp_extract_all(line, {word})) as ws from (select rid, unnest(string_split(t, chr(10))) as line from d)),
pairs as (select rid, label, len(list_intersect(n.ws, l.ws)) / len(n.ws) as c from lines l join notices n on len(list_intersect(n.ws, l.ws)) >= n.need),
best as (select rid, max(c) as c from pairs group by rid),
named as (select rid, string_agg(distinct label, ',' order by label) as labels from (select rid, label from pairs union select rid, label from hits) group by rid)
select doc_id, len(w.ws)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, base.lo::bigint as first_word, base.hi::bigint as last_word,
  coalesce(base.labels, '') as base_labels, coalesce(named.labels, '') as labels, case when base.n > 0 then 1.0 else coalesce(best.c, 0.0) end::double as score
from d join w using (rid) left join base using (rid) left join best using (rid) left join named using (rid)"""
