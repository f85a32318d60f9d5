"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Documents are dealt into shards of about `shard_rows` pieces by a hash of their key, and each shard is packed by itself in order of decreasing length.
A bin carries a bitmap of the duplicate clusters and bitmaps of the sources that it holds (one bitmap for each document of a source that it
may take). Bins are kept in order of what is left in them; for a piece, the search starts at the bin that it fills best and goes on through
its successors until one has no conflict. If none has, the piece opens a bin. A shard is packed as a whole; only one that rows of one key make
larger than `most` times its size is packed in runs of so many pieces, which bounds a task's memory and loses no row.

A document longer than a bin is cut: its full pieces are bins of their own, and the rest is packed. Nothing is dropped.

Defined results: a null or empty text has 0 tokens and is packed as a piece of that length; rows without a source never conflict by source;
equal rows are packed each, in different bins as they are duplicates; texts of 0 tokens are no duplicates of one another.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy


def best_fit(sizes: list[int], clusters: list, sources: list, capacity: int, source_limit: int) -> tuple[list[int], list[int], int]:
    """(bin, offset in the bin) of each piece, in the order given, and the number of bins. A piece is at most as long as a bin. None is no cluster, or no source."""
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(x for x in clusters if x is not None))}
    source_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(x for x in sources if x is not None))}
    open_bins: list[tuple[int, int]] = []  # (left, bin), in order
    held: list[int] = []  # bitmaps of clusters, by bin
    taken: list[list[int]] = []  # bitmaps of sources, by bin: the n-th has the sources with more than n pieces
    bins, offsets = [], []
    for size, c, s in zip(sizes, clusters, sources, strict=True):
        cb, sb = cluster_bit.get(c, 0), source_bit.get(s, 0)
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not held[b] & cb and not taken[b][-1] & sb:
                break
            at += 1
        if at < len(open_bins):
            left, b = open_bins.pop(at)
        else:
            left, b = capacity, len(held)
            held.append(0)
            taken.append([0] * source_limit)
        bins.append(b)
        offsets.append(capacity - left)
        held[b] |= cb
        for plane in range(source_limit):
            if not taken[b][plane] & sb:
                taken[b][plane] |= sb
                break
        insort(open_bins, (left - size, b))
    return bins, offsets, len(held)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def text_cluster(text: Column) -> Column:
    """Documents whose words are the same but for case are duplicates."""
    return F.md5(F.array_join(F.split(F.trim(F.lower(text)), r"[\x20\x09-\x0D]+"), " "))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, source_limit: int = 2, shard_rows: int = 1024, most: int = 8, tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """A row for each piece: key, source, piece (from 0), n_pieces, start (first token), n_tokens, bin_id, bin_offset.

    `tokens` and `cluster` may give the number of tokens and the duplicate cluster; else tokens are words between white space, and
    clusters are texts of the same words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    src = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), F.coalesce(word_count(t) if tokens is None else tokens, F.lit(0)).cast("long").alias("n"), (text_cluster(t) if cluster is None else cluster.cast("string")).alias("c"))
    rows = docs.count()
    shards = max(1, -(-rows // shard_rows))
    marked = F.conv(F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    src = src.withColumn("shard", marked % shards).withColumn("full", F.floor(F.col("n") / capacity)).withColumn("rest", F.col("n") % capacity)
    # The rest is packed; a document that fills its bins to the last token has none.
    src = src.withColumn("rest", F.when((F.col("rest") == 0) & (F.col("full") > 0), F.lit(None)).otherwise(F.col("rest")))
    dealt = src.repartition("shard").sortWithinPartitions("shard", F.col("rest").desc_nulls_last(), "k", "n", "s", "c")
    kind = dict(src.dtypes)["k"]
    columns = ["k", "s", "piece", "n_pieces", "start", "n_tokens", "bin_id", "bin_offset"]

    def packed(batches):
        now, used, held = None, 0, []

        def flush():
            nonlocal held, used
            rests = [r for r in held if r[4] is not None]
            bins, offsets, n = best_fit([r[4] for r in rests], [r[3] if r[2] else None for r in rests], [r[1] for r in rests], capacity, source_limit)
            out = []
            for (k, s, _, _, rest, full), b, at in zip(rests, bins, offsets, strict=True):
                out.append((k, s, full, full + 1, full * capacity, rest, now << 32 | used + b, at))
            used += n
            for k, s, _, _, rest, full in held:
                for p in range(full):
                    out.append((k, s, p, full + (rest is not None), p * capacity, capacity, now << 32 | used, 0))
                    used += 1
            held = []
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            schema = pa.schema([("k", b.schema.field("k").type), ("s", pa.string()), ("piece", pa.int64()), ("n_pieces", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])
            for shard, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "k", "s", "n", "c", "rest", "full")), strict=True):
                if held and (shard != now or len(held) >= most * shard_rows):
                    yield flush()
                if shard != now:
                    now, used = shard, 0
                held.append(row)
        if held:
            yield flush()

    out = dealt.mapInArrow(tidy(packed), f"k {kind}, s string, piece long, n_pieces long, start long, n_tokens long, bin_id long, bin_offset long")
    return out.select(F.col("k").alias(key), F.col("s").alias(source), *columns[2:])


def oracle(capacity: int = 2048, source_limit: int = 2, shard_rows: int = 1024) -> str:
    """The same rows in DuckDB's SQL: a fold over the pieces of each shard, whose state is the list of bins."""
    white = r"[\x20\x09-\x0D]+"
    fits = f"a.bins[i].left_ >= x.rest AND (x.n = 0 OR NOT list_contains(a.bins[i].clusters, x.c)) AND (x.s IS NULL OR len(list_filter(a.bins[i].sources, lambda y: y = x.s)) < {source_limit})"
    best = f"list_min(list_transform(list_filter(range(1, len(a.bins) + 1), lambda i: {fits}), lambda i: a.bins[i].left_ * 1000000 + i)) % 1000000"
    taken = "{'left_': b.left_ - x.rest, 'clusters': CASE WHEN x.n > 0 THEN list_append(b.clusters, x.c) ELSE b.clusters END, 'sources': CASE WHEN x.s IS NULL THEN b.sources ELSE list_append(b.sources, x.s) END}"
    empty = f"{{'left_': CAST({capacity} AS BIGINT), 'clusters': CAST([] AS VARCHAR[]), 'sources': CAST([] AS VARCHAR[])}}"
    step = f"list_transform([{best}], lambda j: {{'bins': CASE WHEN j IS NULL THEN list_append(a.bins, list_transform([{empty}], lambda b: {taken})[1]) ELSE list_transform(a.bins, lambda b, i: CASE WHEN i = j THEN {taken} ELSE b END) END, 'out': list_append(a.out, {{'bin': coalesce(j, len(a.bins) + 1) - 1, 'off': CASE WHEN j IS NULL THEN 0 ELSE {capacity} - a.bins[j].left_ END}})}})[1]"
    kind = "STRUCT(left_ BIGINT, clusters VARCHAR[], sources VARCHAR[])[]"
    return f"""
WITH d AS (SELECT doc_id AS k, source AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n, md5(array_to_string(regexp_split_to_array(trim(lower(coalesce(text, '')), ' '), '{white}'), ' ')) AS c,
  CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) % (SELECT greatest(1, (count(*) + {shard_rows - 1}) // {shard_rows}) FROM documents) AS shard FROM documents),
p AS (SELECT *, n // {capacity} AS full_, CASE WHEN n % {capacity} = 0 AND n >= {capacity} THEN NULL ELSE n % {capacity} END AS rest FROM d),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY rest DESC NULLS LAST, k NULLS FIRST, n, s NULLS FIRST, c) AS nth FROM p),
f AS MATERIALIZED (SELECT shard, list_reduce(list({{'rest': rest, 'n': n, 's': s, 'c': c}} ORDER BY nth), lambda a, x: {step}, {{'bins': CAST([] AS {kind}), 'out': CAST([] AS STRUCT(bin BIGINT, off BIGINT)[])}}) AS a FROM o WHERE rest IS NOT NULL GROUP BY shard),
rests AS (SELECT k, s, full_ AS piece, full_ + 1 AS n_pieces, full_ * {capacity} AS start, rest AS n_tokens, (shard << 32) + a.out[nth].bin AS bin_id, a.out[nth].off AS bin_offset FROM o JOIN f USING (shard) WHERE rest IS NOT NULL),
fulls AS (SELECT k, s, piece, full_ + CASE WHEN rest IS NULL THEN 0 ELSE 1 END AS n_pieces, piece * {capacity} AS start, {capacity} AS n_tokens, (shard << 32) + coalesce(len(a.bins), 0) + row_number() OVER (PARTITION BY shard ORDER BY nth, piece) - 1 AS bin_id, 0 AS bin_offset
  FROM (SELECT *, unnest(range(full_)) AS piece FROM o) LEFT JOIN f USING (shard))
SELECT k AS doc_id, s AS source, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('piece', 'n_pieces', 'start', 'n_tokens', 'bin_id', 'bin_offset'))} FROM (SELECT * FROM rests UNION ALL SELECT * FROM fulls)
"""
