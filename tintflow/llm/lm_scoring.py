"""Cross-entropy difference of two n-gram models.

A target model and a background model are counted over the whole corpus: the background over every document, the target over the documents
marked as such. Both share one vocabulary (the corpus's words, by 63-bit hashes), the same orders (words, and words after a word) and the same
smoothing: interpolation of the pair's share with the word's share, which is smoothed by adding one count for each word of the vocabulary (of
`slots` words at least). A document's score is the mean over its tokens of the target's loss minus the background's, in bits; lower is closer
to the target.

Documents are put into blocks as they are read, and n-grams into ranges of their hashes. A block sends each range its distinct n-grams with
their counts, a range sums them over all blocks and answers with the sums in the same order. So the counted table has an entry for each
distinct n-gram of the corpus, its ranges grow in number with the text, and no task and not the driver holds more than its block or range.

Defined results: a null or empty text has no tokens and scores 0; with no target rows the target model is uniform; repeated rows count and
are scored each; a null key is never a target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .textkit import U, Words, byte_chunks, gram_hash, mix

#: Marked keys up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
#: Ranges of hashes, at least.
LEAST_RANGES = 64


def _grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the word's key, the key of the pair that it ends, whether there is one, and the text number. Words' keys are odd and pairs' even."""
    word, pair, inner, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for lo, _, buf, offsets in byte_chunks(text):
        w = Words(buf, offsets)
        n = len(w.hash)
        p, i = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n > 1:
            p[1:] = gram_hash(w.hash, 2) & ~U(1)
            i[1:] = w.doc[1:] == w.doc[:-1]
        word.append(mix(w.hash) | U(1)), pair.append(p), inner.append(i), doc.append(w.doc + lo)
    return np.concatenate(word), np.concatenate(pair), np.concatenate(inner), np.concatenate(doc)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, the first bytes of all before the second ones."""
    return pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).view(kind).ravel()


def _texts(packed: bytes, lengths: bytes, n: int) -> pa.Array:
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(_unpack(lengths, n), out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.decompress(packed, int(ends[-1]), codec="zstd")])


def _alone(f):
    """`tidy` for a function of a group's rows."""
    return lambda rows: list(tidy(lambda x: [f(*x)])((rows,)))[0]


def _beside(f):
    """`tidy` for a function of two groups' rows."""
    return lambda rows, others: list(tidy(lambda x: [f(*x)])((rows, others)))[0]


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", slots: int = 1 << 16, weight: float = 0.6) -> DataFrame:
    """key, n_tokens, target_loss, background_loss (bits a token), score. `targets` has the keys of the target's documents."""
    marked = targets.select(F.col(key).alias("k2")).where("k2 is not null").distinct()
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
    src = docs.select(F.col(text).alias("t"), F.col(key).alias("k"))
    joined = src.join(marked, F.col("k") == F.col("k2"), "left").select("t", F.col("k2").isNotNull().alias("marked"), "k")
    kind = dict(src.dtypes)["k"]
    most = BLOCK_BYTES

    def packed(batches):
        """Blocks of rows, their texts compressed."""
        from pyspark import TaskContext

        first, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            texts = [x for _, x, _ in held]
            lengths, n = np.concatenate([x for x, _, _ in held]), sum(len(x) for x, _, _ in held)
            rest = pa.Table.from_batches([x for _, _, x in held])
            keys = rest.column("k").combine_chunks()
            keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
            marks = np.packbits(rest.column("marked").to_numpy().astype(bool)).tobytes()
            text = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            columns = [pa.array([first + made], pa.int64()), pa.array([n], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys), *(pa.array([x], pa.binary()) for x in (marks, _pack(lengths), text))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "n", "bytes", "keys", "marks", "lengths", "text"])

        for b in batches:
            for lo, hi, buf, offsets in byte_chunks(b.column(0), most):
                held.append((np.diff(offsets), buf.tobytes(), b.slice(lo, hi - lo).select(["marked", "k"])))
                size += len(buf)
                if 2 * size >= most:
                    yield block()
                    made, held, size = made + 1, [], 0
        if held:
            yield block()

    docs_ = cut(joined.mapInArrow(tidy(packed), f"block long, n long, bytes long, keys array<{kind}>, marks binary, lengths binary, text binary"))
    size = docs_.agg(F.sum("bytes")).first()[0] or 0
    bits = (max(LEAST_RANGES, -(-size // BLOCK_BYTES)) - 1).bit_length()

    def asked(batches):
        """A block's distinct n-grams and their counts, by range."""
        for b in batches:
            for row in b.to_pylist():
                word, pair, inner, doc = _grams(_texts(row["text"], row["lengths"], row["n"]))
                target = np.unpackbits(np.frombuffer(row["marks"], np.uint8)).astype(bool)[doc]
                grams, at = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)
                background = np.bincount(at, minlength=len(grams))
                wanted = np.bincount(at[np.concatenate([target, target[inner]])], minlength=len(grams))
                ids, first = np.unique((grams >> U(64 - bits)).astype(np.int64), return_index=True)
                cuts = list(zip(first, [*first[1:], len(grams)], strict=True)) if len(ids) else []
                columns = [pa.array(ids, pa.int64()), pa.array([row["block"]] * len(ids), pa.int64()), pa.array([j - i for i, j in cuts], pa.int64())]
                columns += [pa.array([_pack(np.diff(grams[i:j], prepend=U(0))) for i, j in cuts], pa.binary()), *(pa.array([_pack(x[i:j]) for i, j in cuts], pa.binary()) for x in (background, wanted))]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "n", "grams", "background", "target"])

    def summed(rows: pa.Table) -> pa.Table:
        """The sums of a range's n-grams over all blocks, for each block in its order; and a row of block -1 with the range's words, their counts summed."""
        n = rows.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(x, m, np.uint64)) for x, m in zip(rows.column("grams").to_pylist(), n, strict=True)])
        grams, at = np.unique(keys, return_inverse=True)
        sums, words = [], grams & U(1) > 0
        for name in ("background", "target"):
            each = np.concatenate([_unpack(x, m) for x, m in zip(rows.column(name).to_pylist(), n, strict=True)])
            total = np.zeros(len(grams), np.int64)
            np.add.at(total, at, each)
            sums.append(total)
        ends = np.cumsum(n)
        packed = [[_pack(total[at[e - m : e]]) for e, m in zip(ends, n, strict=True)] for total in sums]
        return pa.table({
            "range": pa.array([rows.column("range")[0].as_py()] * (len(n) + 1), pa.int64()), "block": pa.array([-1, *rows.column("block").to_pylist()], pa.int64()), "n": pa.array([int(words.sum()), *n], pa.int64()),
            "background": pa.array([_pack(sums[0][words].sum(keepdims=True)), *packed[0]], pa.binary()), "target": pa.array([_pack(sums[1][words].sum(keepdims=True)), *packed[1]], pa.binary()),
        })

    requests = docs_.drop("keys").mapInArrow(tidy(asked), "range long, block long, n long, grams binary, background binary, target binary")
    answers = cut(requests.groupBy("range").applyInArrow(_alone(summed), "range long, block long, n long, background binary, target binary"))
    words, tokens = 0, [0, 0]
    for r in answers.where("block = -1").toLocalIterator():  # one row for each range
        words += r["n"]
        tokens[0] += int(_unpack(r["target"], 1)[0])
        tokens[1] += int(_unpack(r["background"], 1)[0])
    vocabulary = max(slots, words)

    def scored(rows: pa.Table, sums: pa.Table) -> pa.Table:
        row = rows.select(["n", "lengths", "text"]).to_pylist()[0]
        word, pair, inner, doc = _grams(_texts(row["text"], row["lengths"], row["n"]))
        grams, at = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)
        held = sorted(sums.select(["range", "n", "target", "background"]).to_pylist(), key=lambda r: r["range"])
        if sum(r["n"] for r in held) != len(grams):
            raise ValueError("the sums of a block are not those of its n-grams")
        n = np.bincount(doc, minlength=row["n"])
        this, follows = at[: len(word)], at[len(word) :]
        before = this[np.flatnonzero(inner) - 1]
        losses = []
        for name, total in zip(("target", "background"), tokens, strict=True):
            count = np.concatenate([np.zeros(0, np.int64), *[_unpack(r[name], r["n"]) for r in held]])
            p = (count[this] + 1) / (total + vocabulary)
            p[inner] = weight * (count[follows] / np.maximum(count[before], 1)) + (1 - weight) * p[inner]
            losses.append(np.bincount(doc, -np.log2(p), row["n"]) / np.maximum(n, 1))
        t, g = losses
        keys = pa.concat_arrays([x.flatten() for x in rows.column("keys").chunks])
        return pa.table({"k": keys, "n_tokens": pa.array(n, pa.int64()), "target_loss": pa.array(t), "background_loss": pa.array(g), "score": pa.array(t - g)})

    out = docs_.select("block", "n", "keys", "lengths", "text").groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
    out = out.applyInArrow(_beside(scored), f"k {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("k", key)


def oracle(slots: int = 1 << 16, weight: float = 0.6) -> str:
    """The same rows in DuckDB's SQL, by the words themselves; losses to six places."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    loss = lambda k: f"CASE WHEN count(w) = 0 THEN 0 ELSE avg(-log2(CASE WHEN p IS NULL THEN (w{k} + 1) / (t{k} + v) ELSE {weight} * (p{k} / greatest(b{k}, 1)) + (1 - {weight}) * ((w{k} + 1) / (t{k} + v)) END)) END"
    return rf"""
WITH target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM target) AS marked, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
token AS MATERIALIZED (SELECT doc_id, marked, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS p FROM (SELECT doc_id, marked, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
one AS MATERIALIZED (SELECT w, count(*) AS w0, count(*) FILTER (marked) AS w1 FROM token GROUP BY w),
two AS (SELECT p, w, count(*) AS p0, count(*) FILTER (marked) AS p1 FROM token WHERE p IS NOT NULL GROUP BY p, w),
total AS (SELECT coalesce(sum(w0), 0) AS t0, coalesce(sum(w1), 0) AS t1, greatest({slots}, count(*)) AS v FROM one),
known AS (SELECT t.doc_id, t.w, t.p, w0, w1, p0, p1, b.b0, b.b1, t0, t1, v FROM token t JOIN one USING (w) LEFT JOIN two ON two.p = t.p AND two.w = t.w LEFT JOIN (SELECT w AS p, w0 AS b0, w1 AS b1 FROM one) b ON b.p = t.p, total),
scored AS (SELECT doc_id, count(*) AS n, {loss(1)} AS a, {loss(0)} AS b FROM known GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(coalesce(a, 0), 6) + 0.0 AS target_loss, round(coalesce(b, 0), 6) + 0.0 AS background_loss, round(coalesce(a - b, 0), 6) + 0.0 AS score
FROM d LEFT JOIN scored USING (doc_id)
"""
