"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame functions only.

An item's shingles are runs of five words (of all its words, if it has fewer), lower-cased, letters and digits only. Items are partitioned by
size: partition p has sizes 2^p to 2^(p+1)-1. An item's sketch is its bottom-k MinHash values, with k such that an item of the partition's
largest size cannot reach the threshold without one of any k of its shingles; so the search, which looks for documents of any length that
hold a sketch value, misses nothing. A text is split into words once for all partitions and widths. Candidates are then verified by the
shingles themselves: the words of the item's distinct shingles that the document has too.

Defined results: one row for each pair of document key and item that reaches the threshold; of several rows of one key (or items of one id), the
pair that shares most counts. Null or empty texts and items have no words and pair with nothing; very long texts are searched as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows (of sketches, keys or shingles) up to which a table may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def shingle_hashes(w: Column, width: int) -> Column:
    """Distinct hashes of the runs of `width` words in a column of arrays; an empty array where there are fewer words."""
    every = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(width)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.array_distinct(F.when(F.size(w) >= width, every).otherwise(F.array().cast("array<bigint>")))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingle_words(w: Column, width: Column) -> Column:
    """Distinct runs of `width` words, with a space between the words."""
    every = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.array_join(F.slice(w, i, width), " "))
    return F.array_distinct(F.when(F.size(w) >= width, every).otherwise(F.array().cast("array<string>")))


def _once(c: Column) -> Column:
    """Explode keeps an array from being computed once more by each expression that uses it."""
    return F.explode(F.array(c))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.75) -> DataFrame:
    """key, item, n_item (the item's shingles), n_found, containment of each pair that reaches the threshold."""
    it = items.select(F.col(item).alias("i"), words(F.col(item_text)).alias("iw")).where(F.size("iw") > 0)
    it = it.dropDuplicates(["i", "iw"]).withColumn("width", F.least(F.size("iw"), F.lit(width))).withColumn("g", F.xxhash64("iw"))
    widths = sorted(r[0] for r in it.select("width").distinct().collect())  # as many as `width` at most
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if not widths:
        return src.select(F.col("k").alias(key), F.lit(None).cast(dict(it.dtypes)["i"]).alias(item), *[F.lit(0).cast("long").alias(c) for c in ("n_item", "n_found")], F.lit(0.0).alias("containment")).limit(0)
    of_width = lambda w, n: F.coalesce(*[F.when(F.col("width") == x, shingle_hashes(w, x)) for x in n])
    it = it.select("i", "g", "width", "iw", shingle_words(F.col("iw"), F.col("width")).alias("said"), F.sort_array(of_width(F.col("iw"), widths)).alias("s"))
    it = it.withColumn("m", F.size("said")).withColumn("need", F.ceil(F.col("m") * F.lit(threshold) - F.lit(1e-9)))
    # The partition's largest size, and how many of its shingles may be missing.
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.col("m").cast("double"))) + 1) - 1
    k = (most - F.ceil(most * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    it = cut(it.select("i", "g", "width", "said", "m", "need", F.slice("s", F.lit(1), F.least(k, F.size("s"))).alias("sketch")))
    sizes = it.agg(F.sum(F.size("sketch")), F.sum("m")).first()
    sketch = it.select("i", "g", F.explode("sketch").alias("v"))

    split = src.withColumn("h", F.xxhash64("t")).withColumn("w", _once(words(F.col("t")))).where(F.size("w") >= widths[0])
    every = F.concat(*[shingle_hashes(F.col("w"), n) for n in widths]) if len(widths) > 1 else shingle_hashes(F.col("w"), widths[0])
    probe = split.select("k", "h", F.explode(every).alias("v"))
    pairs = cut(probe.join(_small(sketch, sizes[0] or 0), "v").select(F.col("k").alias("k2"), F.col("h").alias("h2"), "i", "g").distinct())
    n_pairs = pairs.count()
    # Pairs that the search proposed, and no others, meet their texts; a pair travels without the item's words.
    texts = src.withColumn("h", F.xxhash64("t"))
    met = texts.join(_small(pairs, n_pairs), (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("k2"))).select("k", "t", F.col("i").alias("i2"), F.col("g").alias("g2"))
    met = met.join(_small(it.drop("sketch"), sizes[1] or 0), (F.col("g") == F.col("g2")) & F.col("i").eqNullSafe(F.col("i2"))).select("k", "i", "width", "said", "m", "need", _once(words(F.col("t"))).alias("w"))
    found = met.select("k", "i", "m", "need", F.size(F.array_intersect("said", shingle_words(F.col("w"), F.col("width")))).cast("long").alias("found")).where("found >= need")
    best = found.groupBy("k", "i").agg(F.max(F.struct("found", "m")).alias("x"))
    return best.select(F.col("k").alias(key), F.col("i").alias(item), F.col("x.m").cast("long").alias("n_item"), F.col("x.found").alias("n_found"), (F.col("x.found") / F.col("x.m")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose key is in no pair; rows with a null key stay, and so do empty texts. Of rows of one key, all go or stay. Columns of any names are kept as they are."""
    plain, back = numbered(docs, {key: "k", text: "t"})
    item = options.get("item", "item_id")
    found = contaminated(plain, items.withColumnRenamed(item, "i"), key="k", text="t", **options | {"item": "i"})
    hit = cut(found.select(F.col("k").alias("k2")).distinct())
    return back(plain.join(_small(hit, hit.count()), F.col("k") == F.col("k2"), "left_anti"))


def oracle(threshold: float = 0.75) -> str:
    """The same rows in DuckDB's SQL, by exact containment of every pair that shares a shingle."""
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH i0 AS (SELECT item_id, {split} AS w FROM benchmark),
i AS (SELECT item_id, w, least(5, len(w)) AS n FROM i0 WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM i)),
size AS (SELECT item_id, n, count(*) AS n_item FROM ig GROUP BY ALL),
d AS (SELECT doc_id, {split} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM i))),
hit AS (SELECT doc_id, item_id, n_item, count(*) AS n_found FROM dg JOIN ig USING (n, g) JOIN size USING (item_id, n) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(n_found AS BIGINT) AS n_found, n_found / n_item AS containment
FROM hit WHERE n_found >= ceil({threshold} * n_item - 1e-9)
"""
