"""License scan: an exact set-similarity join of text blocks with license templates.

The tokens that templates use are ordered by their frequency in the whole corpus, rarest first. A block holds a template when it has at
least ceil(threshold x size) of the template's tokens, so it must have one of the first size - needed + 1 of them (the prefix); it must be
long enough (length filter), and what can still follow the first shared token on either side must suffice (positional filter). Blocks that
pass are verified by the exact intersection. Blocks are the lines, and what a hard wrap parts: in a paragraph of several lines (up to a line
without words) every run of as many words as the template has, across line ends, that holds as large a share of its pairs of words too;
a line that holds a template comes before such runs. Phrases are templates whose threshold is 1 and whose block is the whole text; a text that
holds all tokens of a phrase is then searched for the words in a row. Built of DataFrame functions only.

Defined results: a null or empty text has no words, no labels and score 0; equal rows give equal results each; a null doc_id is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and the labels that they give.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Notices (label, text), found in a line that holds most of their words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license version 2 0"),
)

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Where paragraphs end: lines without a word, whatever marks of comments they have.
PARAGRAPH = rf"\n{BREAK}*\n"


def _tokens(block: Column) -> Column:
    return F.array_distinct(F.split(F.lower(block), BREAK + "+"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: Sequence[tuple[str, str]] = NOTICES, threshold: float = 0.8) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the largest share of a notice's tokens that one line of the text, or one run of words of a paragraph, holds, and 1 with a base phrase; below the
    threshold it is 0.
    """
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    templates = [(i, label, sorted(set(body.split())), threshold, False, body.split()) for i, (label, body) in enumerate(notices)]
    templates += [(len(templates) + i, label, sorted(set(p.split())), 1.0, True, p.split()) for i, (p, label) in enumerate(phrases.items())]
    vocabulary = sorted({w for t in templates for w in t[2]})
    words = F.array(*map(F.lit, vocabulary))

    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    counted = src.select(F.explode(F.array_intersect(_tokens(F.col("t")), words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    frequency = {r["token"]: r["df"] for r in counted.collect()}  # at most as many rows as the templates have words

    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    prefixes, lengths = [], []
    for i, label, body, c, whole, said in templates:
        ordered = sorted(body, key=rank.get)
        need = math.ceil(c * len(ordered) - 1e-9)
        prefixes += [(i, w, p) for p, w in enumerate(ordered[: len(ordered) - need + 1])]
        two = sorted({f"{a} {b}" for a, b in zip(said, said[1:], strict=False)})
        lengths.append((i, label, ordered, need, len(ordered), whole, len(said), two, math.ceil(c * len(two) - 1e-9)))
    prefix = spark.createDataFrame(prefixes, "tid int, token string, at int")
    known = spark.createDataFrame(lengths, "tid int, label string, template array<string>, need int, size int, whole boolean, long int, pairs array<string>, need_pairs int")
    ordered_words = F.array(*map(F.lit, sorted(vocabulary, key=rank.get)))
    first = F.array(*map(F.lit, sorted({w for _, w, _ in prefixes}, key=rank.get)))

    # Blocks: each line, paragraphs of several lines, and the whole text for phrases, whose words may stand on both sides of a line's end.
    hit = src.where(F.arrays_overlap(_tokens(F.col("t")), first))
    lines = hit.select("k", "h", F.explode(F.split("t", "\n")).alias("body"), F.lit(False).alias("all"), F.lit(False).alias("wrapped"))
    paragraphs = hit.where(F.contains("t", F.lit("\n"))).select("k", "h", F.explode(F.split("t", PARAGRAPH)).alias("body"), F.lit(False).alias("all"), F.lit(True).alias("wrapped")).where(F.contains("body", F.lit("\n")))
    blocks = lines.unionByName(paragraphs).unionByName(hit.select("k", "h", F.col("t").alias("body"), F.lit(True).alias("all"), F.lit(False).alias("wrapped")))
    held = blocks.withColumn("held", F.array_intersect(ordered_words, _tokens(F.col("body"))))  # in the global order
    starts = held.withColumn("token", F.explode(F.array_intersect("held", first)))
    pairs = starts.join(F.broadcast(prefix), "token").join(F.broadcast(known), "tid").where(F.col("whole") == F.col("all"))
    here = F.array_position("held", F.col("token"))  # from 1
    most = F.least(F.col("at"), here - 1) + F.least(F.col("size") - F.col("at"), F.size("held") - here + 1)
    overlap = F.size(F.array_intersect("held", "template"))
    found = pairs.where((F.size("held") >= F.col("need")) & (most >= F.col("need"))).where(overlap >= F.col("need"))

    # In a paragraph that holds enough of a notice's tokens, the run of words that holds most of them. As a run may mix two lines that have nothing
    # to do with each other, it must hold as large a share of the notice's pairs of words too. Explode keeps each array from being computed twice.
    once = lambda c: F.explode(F.array(c))
    stream = F.filter(F.split(F.lower("body"), BREAK + "+"), lambda x: x != "")
    begin = F.sequence(F.lit(1), F.greatest(F.size("stream") - F.col("long") + 1, F.lit(1)))
    two = F.zip_with(F.slice("stream", 1, F.size("stream") - 1), F.slice("stream", 2, F.size("stream")), lambda x, y: F.concat_ws(" ", x, y))
    held_in = lambda c, i, n, of: F.size(F.array_intersect(F.slice(c, i, n), of))
    runs = F.transform(begin, lambda i: F.when(held_in("two", i, F.col("long") - 1, "pairs") >= F.col("need_pairs"), held_in("stream", i, F.col("long"), "template")).otherwise(0))
    found = found.withColumn("stream", once(F.when(F.col("wrapped"), stream))).withColumn("two", once(F.when(F.col("wrapped"), two)))
    found = found.withColumn("most", once(F.when(F.col("wrapped"), F.array_max(runs)).otherwise(overlap))).where(F.col("most") >= F.col("need"))

    # A text that holds all tokens of a phrase is searched for its words in a row. Equal rows count once here.
    ids = {t[0]: p.split() for t, p in zip(templates[len(notices) :], phrases, strict=True)}
    pattern, n = F.lit(None).cast("string"), F.lit(0)
    for i, p in ids.items():
        pattern, n = F.when(F.col("tid") == i, F.lit(f"(?i)(?<!{WORD}){(BREAK + '+').join(p)}(?!{WORD})")).otherwise(pattern), F.when(F.col("tid") == i, F.lit(len(p))).otherwise(n)
    parts = F.when(F.col("all"), F.split("body", pattern))
    seen = found.select("k", "h", "tid", "label", "all", "wrapped", (F.col("most") / F.col("size")).alias("share"), "body", n.alias("length"), parts.alias("parts"))
    words_in = lambda x: F.regexp_count(x, F.lit(WORD + "+"))
    seen = seen.where(~F.col("all") | (F.size("parts") > 1)).select(
        "k", "h", "tid", "label", "all", "wrapped", "share", (F.size("parts") - 1).alias("n"), words_in(F.element_at("parts", 1)).alias("a"), (words_in(F.col("body")) - words_in(F.element_at("parts", -1)) - F.col("length")).alias("z")
    )
    share = F.coalesce(F.max(F.when(~F.col("wrapped"), F.col("share"))), F.max("share"))  # a line that holds a notice comes before what is wrapped
    by_template = seen.groupBy("k", "h", "tid", "label", "all").agg(share.alias("share"), F.max("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    by_text = by_template.groupBy("k", "h").agg(
        F.sum(F.when(F.col("all"), F.col("n"))).alias("n_base"), F.min(F.when(F.col("all"), F.col("a"))).alias("first_word"), F.max(F.when(F.col("all"), F.col("z"))).alias("last_word"),
        F.collect_set(F.when(F.col("all"), F.col("label"))).alias("base"), F.collect_set("label").alias("every"), F.max("share").alias("share"),
    )

    rows = src.select("k", "h", words_in(F.col("t")).cast("long").alias("n_words"))
    by_text = by_text.withColumnsRenamed({"k": "k2", "h": "h2"})
    out = rows.join(by_text, F.col("k").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return out.select(
        F.col("k").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined("every").alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )


def oracle(threshold: float = 0.8) -> str:
    """The same rows in DuckDB's SQL, without any filter of candidates: lines, and all runs of words of paragraphs of several lines."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words_of = lambda c: f"regexp_extract_all(translate({c}, '{upper}', '{lower}'), '{word}')"
    phrase = ", ".join(f"('{label}', {[*p.split()]!r})" for p, label in PHRASES.items())
    notice = ", ".join(f"({i}, '{label}', {sorted(set(p.split()))!r}, {[f'{a} {b}' for a, b in sorted(set(zip(p.split(), p.split()[1:], strict=False)))]!r}, {len(p.split())})" for i, (label, p) in enumerate(NOTICES))
    need = lambda c: f"ceil({threshold} * len({c}) - 1e-9)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words_of("coalesce(text, '')")} AS w FROM documents),
phrases(label, body) AS (VALUES {phrase}),
notices(tid, label, body, two, long) AS (VALUES {notice}),
places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + len(body) - 1) = body)) - 1 AS place FROM d, phrases WHERE list_has_all(w, body)),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
line AS (SELECT doc_id, list_distinct({words_of('l')}) AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
plain AS (SELECT doc_id, tid, max(len(list_intersect(w, body)) / len(body)) AS share FROM line, notices WHERE len(list_intersect(w, body)) >= {need('body')} GROUP BY doc_id, tid),
paragraph AS (SELECT doc_id, {words_of('l')} AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n{BREAK}*\n')) AS l FROM d) WHERE contains(l, chr(10))),
run AS (SELECT doc_id, tid, body, two, w[i : i + long - 1] AS w FROM (SELECT doc_id, tid, body, two, long, w, unnest(range(1, greatest(len(w) - long + 1, 1) + 1)) AS i FROM paragraph, notices WHERE len(list_intersect(list_distinct(w), body)) >= {need('body')})),
wrapped AS (SELECT doc_id, tid, max(len(list_intersect(list_distinct(w), body)) / len(body)) AS share FROM run WHERE len(list_intersect(list_distinct(w), body)) >= {need('body')}
  AND len(list_intersect(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), two)) >= {need('two')} GROUP BY doc_id, tid),
share AS (SELECT doc_id, label, coalesce(p.share, x.share) AS share FROM plain p FULL JOIN wrapped x USING (doc_id, tid) JOIN notices USING (tid)),
every AS (SELECT doc_id, label, share FROM share UNION ALL SELECT DISTINCT doc_id, label, 1.0 FROM places),
labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM every GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
