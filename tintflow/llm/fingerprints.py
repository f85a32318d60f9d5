"""Document fingerprints by canonical exact digest.

A text is brought to a canonical form (NFKC, case folding, NFKC again, white space folded to one space and trimmed),
and its 128-bit xxhash is the fingerprint. Texts of equal digest form a bucket; inside a bucket of several documents
the canonical bytes themselves are compared, and a text that differs from the bucket's first gets a suffix of its own.

Defined results: a null text counts as empty; empty texts share one fingerprint; repeated rows are fingerprinted each.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Keys (8 bytes each) of rows in buckets of several, up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def _witness(canon: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(canon, digest_size=8).digest(), "little", signed=True)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=digest) -> DataFrame:
    """key, n_chars, fingerprint of each row, with the buckets' bytes compared. `digest` maps canonical bytes to text."""
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def rows(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            canons = [canonical(t).encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(digest, canons), pa.string()), pa.array(map(_witness, canons), pa.int64())],
                names=["k", "n_chars", "digest", "witness"],
            )

    kind = dict(src.dtypes)["k"]
    marks = cut(src.mapInArrow(tidy(rows), f"k {kind}, n_chars long, digest string, witness long"))
    settled = resolve(marks, collisions(docs, marks, key, text, digest), "digest", "witness", "fingerprint")
    return settled.select(F.col("k").alias(key), "n_chars", "fingerprint")


def collisions(docs: DataFrame, marks: DataFrame, key: str, text: str, digest=digest) -> DataFrame:
    """(digest, witness, suffix) of texts whose canonical bytes differ from those of their bucket's first. marks has k and digest.

    Only texts in buckets of several documents are read again; equal texts meet before they are shuffled.
    """
    full = marks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    wanted = cut(marks.join(full, "digest", "left_semi").select("k").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    src = src.join(wanted.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "left_semi").select("t")

    def rows(batches):
        for b in batches:
            canons = [canonical(t).encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]
            seen = list(dict.fromkeys(canons))
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, seen), pa.string()), pa.array(seen, pa.binary())], names=["digest", "canon"])

    apart = src.mapInArrow(tidy(rows), "digest string, canon binary").groupBy("digest", "canon").agg(F.count("*").alias("n"))
    several = apart.groupBy("digest").agg(F.count("*").alias("texts"), F.min("canon").alias("first")).where("texts > 1")
    other = apart.join(several, "digest").where(F.col("canon") != F.col("first"))

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_witness(x) for x in b.column(1).to_pylist()], pa.int64())], names=["digest", "witness"])

    return other.select("digest", "canon").mapInArrow(tidy(named), "digest string, witness long").withColumn("suffix", F.concat(F.lit("-"), F.hex("witness")))


def resolve(marks: DataFrame, table: DataFrame, digest_col: str, witness_col: str, out: str) -> DataFrame:
    """The fingerprint column: the digest, and the suffix where the bucket holds other bytes."""
    t = table.select(F.col("digest").alias("_d"), F.col("witness").alias("_w"), F.col("suffix").alias("_s"))
    joined = marks.join(t, (marks[digest_col] == t["_d"]) & (marks[witness_col] == t["_w"]), "left")
    return joined.withColumn(out, F.concat(F.col(digest_col), F.coalesce(F.col("_s"), F.lit("")))).drop("_d", "_w", "_s")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_each: int = 500, most_slices: int = 4_000, digest=digest) -> DataFrame:
    """Each text beside its edited form and the next document of descending key, which must be a whole number.

    The edited form has the last floor(n/2) code points replaced by the first as many (or all) of the next document. Rows are dealt by
    ranges of the key, so that a document and its successor meet in one sorted pass; the first document of a range is dealt to the range
    above it too. Rows of equal key follow one another by their compressed text, a null key comes last, and after the last row comes the first. The
    likeness of two exact digests is 1 or 0. An edited text that shares a digest with other bytes takes a suffix as a document does.
    """
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n, top = src.agg(F.count("k"), F.max("k")).first()
    parts = min(most_slices, max(1, -(-n // rows_each)))
    bounds = sorted(set(src.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or [])) if parts > 1 else []
    ladder = np.array(bounds, np.int64)

    def deal(batches):
        """Rows to their slices, with the text compressed for the way. A bound is a key of its slice, and the largest there: each is also the
        successor of what the slice above ends with. The largest key of all succeeds the last row."""
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = press.compress(t.encode("utf-8", "surrogatepass"))
                s = 0 if k is None else int(np.searchsorted(ladder, k, "left"))
                out.append((s, 0, k, z))
                if k is not None and s < len(ladder) and ladder[s] == k:
                    out.append((s + 1, 1, k, z))
                if k == top:
                    out.append((0, 1, k, z))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slice", "guest", "k", "z"])

    dealt = src.select(F.col("k").cast("long").alias("k"), "t").mapInArrow(tidy(deal), "slice int, guest int, k long, z binary")
    dealt = dealt.repartition("slice").sortWithinPartitions("slice", "guest", F.col("k").desc_nulls_last(), "z")

    def rows(batches):
        held = None  # (slice, key, text, canonical bytes, digest) of the row that waits for its successor
        press = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for s, guest, k, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if guest and (held is None or held[0] != s):
                    continue  # a second guest of the slice, or a guest of one without rows
                t = press.decompress(z).decode("utf-8", "surrogatepass")
                canon = canonical(t).encode("utf-8", "surrogatepass")
                here = (s, k, t, canon, digest(canon))
                if held is not None and held[0] == s:
                    out.append(_compared(held, here, digest))
                held = None if guest else here
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("k", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("witness", pa.int64()), ("edited_digest", pa.string()), ("edited_witness", pa.int64()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    marks = cut(dealt.mapInArrow(tidy(rows), "k long, n_chars long, edited_sha256 string, digest string, witness long, edited_digest string, edited_witness long, near_edited double, near_next double"))
    table = cut(collisions(docs, marks, key, text, digest).unionByName(_edited_apart(marks)))
    if table.isEmpty():
        done = marks.withColumn("fingerprint", F.col("digest")).withColumn("edited_fingerprint", F.col("edited_digest"))
    else:
        done = resolve(resolve(marks, table, "digest", "witness", "fingerprint"), table, "edited_digest", "edited_witness", "edited_fingerprint")
    return done.select(F.col("k").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _edited_apart(marks: DataFrame) -> DataFrame:
    """(digest, witness, suffix) of edited texts that share a digest with other bytes, as a second hash of 64 bits tells, and that are no document's text."""
    every = marks.select("digest", "witness", F.lit(0).alias("edited")).unionByName(marks.select(F.col("edited_digest").alias("digest"), F.col("edited_witness").alias("witness"), F.lit(1).alias("edited")))
    apart = every.groupBy("digest", "witness").agg(F.min("edited").alias("edited"))
    several = apart.groupBy("digest").agg(F.count("*").alias("n"), F.min("edited").alias("low"), F.min("witness").alias("first")).where("n > 1")
    out = apart.where("edited = 1").join(several, "digest").where("low = 0 OR witness <> first")
    return out.select("digest", "witness", F.concat(F.lit("-"), F.hex("witness")).alias("suffix"))


def _compared(a: tuple, b: tuple, digest) -> dict:
    _, k, t, canon, d = a
    half = len(t) // 2
    edited = t[: len(t) - half] + b[2][:half]
    plain = edited.encode("utf-8", "surrogatepass")
    e_canon = canon if edited == t else canonical(edited).encode("utf-8", "surrogatepass")
    e_digest = d if e_canon is canon else digest(e_canon)
    return {
        "k": k, "n_chars": len(t), "edited_sha256": hashlib.sha256(plain).hexdigest(), "digest": d, "witness": _witness(canon), "edited_digest": e_digest, "edited_witness": _witness(e_canon),
        "near_edited": float(d == e_digest and canon == e_canon), "near_next": float(d == b[4] and canon == b[3]),
    }
