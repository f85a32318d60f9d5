"""Quality classifier with supervised subword embeddings.

A document's features are its words, its pairs of words by whether the two agree (so that a word said again tells, whichever it is), and the
n-grams of its characters, case kept, each hashed to a row of an embedding table. The rows are
averaged within each kind of feature and over the kinds, and a softmax over two classes follows. Table and output weights are learned together by stochastic gradient descent in numpy,
with momentum-free steps that decay to zero. Scoring multiplies the table by the output weights once, so a text costs one look-up a feature.

Learning takes a bounded sample of labelled rows (`most_docs` of them and `most_chars` characters, by a hash of the key); every row is scored
from its whole text.

Defined results: a null or empty text has no features and gets the bias alone; with no labelled rows, every score is 0.5; rows with a null
label or key are never learned from; repeated rows are each scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, tidy
from .textkit import WHITE, U, Words, byte_chunks, mix


def characters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its bytes in UTF-8), and the texts' offsets in them."""
    padded = np.zeros(len(buf) + 4, np.uint8)
    padded[: len(buf)] = buf
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.r_[start, len(buf)])
    four = np.ndarray((len(buf) + 1,), "<u4", padded, 0, (1,))
    spare = (8 * (4 - np.minimum(size, 4))).astype(np.uint32)
    return (four[start] << spare) >> spare, np.searchsorted(start, offsets)


def features(buf: np.ndarray, offsets: np.ndarray, buckets: int, orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of all features, kind by kind: words, pairs of words by whether they agree, then n-grams of characters of each order that lie within a text."""
    w = Words(buf, offsets, WHITE, None)
    same = np.zeros(len(w.hash), np.uint64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out = [((kind & U(buckets - 1)).astype(np.int32), w.doc) for kind in (w.hash, mix(same + U(1)))]
    value, at = characters(buf, offsets)
    n = len(value)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    if n:
        wide = np.zeros(n + 8, np.uint32)
        wide[:n] = value
        for k in range(1, max(orders)):
            value = value * np.uint32(0x01000193) + wide[k : n + k]
            if k + 1 in orders:
                m = n - k
                h = (value[:m] ^ np.uint32(k + 1)) * np.uint32(0x9E3779B1)
                h = (h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)
                whole = doc[:m] == doc[k:]
                if whole.all():
                    out.append((h.astype(np.int32), doc[:m]))
                else:
                    out.append((h[whole].astype(np.int32), doc[:m][whole]))
    return out


def train(texts: list[bytes], labels: np.ndarray, buckets: int, orders: tuple[int, ...], dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """(difference of the two classes' logits by bucket, bias)."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        b = np.frombuffer(t, np.uint8)
        kinds = [f for f, _ in features(b, np.array([0, len(b)]), buckets, orders) if len(f)]
        share = np.zeros(buckets, np.float32)
        for f in kinds:
            share += np.bincount(f, minlength=buckets).astype(np.float32) / (len(f) * len(kinds))
        ids = np.flatnonzero(share)
        rows.append((ids, share[ids]))
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            mean = share @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= np.float32(0.1) * lr * p
            # The mean spreads a step over all features of the text; a feature's own step is scaled back up, as it is for a short text.
            table[ids] -= (lr * np.float32(20)) * share[:, None] * back
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", keep: dict[str, Column] | None = None, most_docs: int = 3_000, most_chars: int = 32_000_000, buckets: int = 1 << 15, orders: tuple[int, ...] = (2, 3, 4), dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> DataFrame:
    """key, the columns `keep`, and score: the probability of label 1. `learn` says which labelled rows may be learned from."""
    marked = labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    marked = marked.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2")  # rows that contradict one another are left out
    chosen = cut(marked.orderBy(F.xxhash64("k"), "k").limit(most_docs).select(F.col("k").alias("k2"), "y"))  # most_docs rows
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("k2")).select("k", "y", "t")
    # Of the chosen texts, repeated rows once, those that most_chars characters hold together.
    sized = texts.select("k", "y", F.sha2("t", 256).alias("d"), F.length("t").alias("n")).distinct().withColumn("r", F.xxhash64("k"))
    up_to = F.sum("n").over(W.orderBy("r", "k", "d").rowsBetween(W.unboundedPreceding, 0))
    fit = cut(sized.withColumn("up_to", up_to).where(F.col("up_to") <= most_chars).select(F.col("k").alias("k3"), "d"))
    got = texts.join(F.broadcast(fit), (F.col("k") == F.col("k3")) & (F.sha2("t", 256) == F.col("d")), "left_semi").distinct().collect()
    got = sorted((r["k"], r["t"], r["y"]) for r in got)
    weights, bias = np.zeros(buckets, np.float32), 0.0
    if got:
        weights, bias = train([t.encode("utf-8", "surrogatepass") for _, t, _ in got], np.array([y for _, _, y in got]), buckets, orders, dim, epochs, rate, seed)

    def rows(batches):
        for b in batches:
            logit = []
            for lo, hi, buf, offsets in byte_chunks(b.column(0)):
                n = hi - lo
                total, kinds = np.zeros(n), np.zeros(n)
                for bucket, doc in features(buf, offsets, buckets, orders):
                    count = np.bincount(doc, minlength=n)
                    total += np.bincount(doc, weights[bucket], n) / np.maximum(count, 1)
                    kinds += count > 0
                logit.append(total / np.maximum(kinds, 1) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(logit), -60, 60))) if logit else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p, pa.float64())], names=[*b.schema.names[1:], "score"])

    src = docs.select(F.col(text).alias("_text"), F.col(key), *[c.alias(n) for n, c in (keep or {}).items()])
    kinds = dict(src.dtypes)
    return src.mapInArrow(tidy(rows), ", ".join([*(f"`{c}` {kinds[c]}" for c in src.columns[1:]), "score double"]))
