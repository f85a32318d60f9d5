"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A byte is removed when it lies in a string of `length` bytes that starts at another place too, in any text. So only suffixes (windows) that
agree on `length` bytes have to meet, and they are sorted in buckets, a bucket at a time:

1. Each window's bucket is its minimizer, the least hash of its 64-byte strings. Windows that follow one another in a bucket travel as one
   run. Runs are counted by bucket and by a hash of their bytes: a run that occurs again is removed whole, and a bucket of one run falls away.
2. Of the other buckets the bytes are read, one run of each kind. Windows are dealt by the bytes beside the minimizer too, so that a frequent
   minimizer spreads over many buckets.
3. A task concatenates whole buckets of about half a megabyte and sorts their windows by 64 bytes. Longer ties are resolved in a three-way
   quicksort by the ranks of a difference-cover sample: for any two positions there is a step below 64 that takes both into the sample.
   Neighbours are compared byte for byte.

Nothing is kept of all suffixes but runs (about 1.5 % of the bytes), and a task's memory is bounded by its block.

Runs and texts are taken for equal by 128-bit xxh3 digests of their bytes; the rolling hash only chooses minimizers and deals rows. A row's
mark, 64 bits, is tried against the texts' SHA-256 and drawn anew should two texts share one. Defined results: a null text counts as empty;
texts shorter than `length` lose nothing; of equal texts of that length or more all bytes are removed, in each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, tidy
from .textkit import _BYTE, U, byte_chunks, mix, powers

M = 64  # bytes of a minimizer, and of what is sorted before the cover's ranks are asked
V = 64  # the cover's modulus
#: Keys of rows (8 bytes each) up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
BLOCK = 1 << 19
#: Windows that are sorted at a time.
AT_ONCE = 1 << 18
#: Digests that a task remembers, to send copies once; then it forgets them all, and sends again.
REMEMBERED = 1 << 19


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values that follow one another."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    rows = -(-len(a) // w)
    padded = np.full(rows * w, np.iinfo(a.dtype).max, a.dtype)
    padded[: len(a)] = a
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    up, _ = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end, wherever they stand."""
    _, down = powers(len(total) + 1)
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 128-bit digests of spans of bytes, as two columns of whole numbers."""
    data = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window in its text, number of windows, bucket, first byte in the buffer, whether the minimizer occurs more than once) of each run."""
    w = length - M + 1
    n = len(buf) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
    total = prefix_hash(buf)
    at = np.arange(len(buf) - M + 1)
    gram = span_hash(total, at, at + M)
    least = sliding_min(gram, w)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:n] != doc[: n - 1])
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    ok = inside[start]
    start, size = start[ok], size[ok]
    bucket = least[start]
    first, last = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    step = np.arange(w)
    for i in range(0, len(start), 2048):
        s, e = start[i : i + 2048], start[i : i + 2048] + size[i : i + 2048] - 1
        v = bucket[i : i + 2048, None]
        first[i : i + 2048] = s + np.argmax(gram[s[:, None] + step] == v, axis=1)
        last[i : i + 2048] = e + w - 1 - np.argmax(gram[e[:, None] + step[::-1]] == v, axis=1)
    d = doc[start]
    return d, start - offsets[d], size, bucket, start, first != last


@lru_cache(1)
def cover() -> tuple[np.ndarray, np.ndarray]:
    """Residues of the cover (0..r-1 and the multiples of r, for r * r = V), and the step that takes two residues into it."""
    r = int(V**0.5)
    inside = np.zeros(V, bool)
    inside[:r] = True
    inside[::r] = True
    a = np.arange(V)
    step = np.full((V, V), -1)
    for d in range(V - 1, -1, -1):
        ok = inside[(a[:, None] + d) % V] & inside[(a[None, :] + d) % V]
        step[ok] = d
    return inside, step


def dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 0, the same for equal keys; `order` sorts by them."""
    differ = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        differ[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(differ)
    return out


class Block:
    """Bytes whose windows are sorted together."""

    def __init__(self, data: bytes):
        pad = data + bytes(512)
        self.n = len(data)
        self.word = np.ndarray((len(pad) - 8,), ">u8", pad, 0, (1,)).astype(np.uint64)
        inside, self.step = cover()
        at = np.flatnonzero(inside[np.arange(self.n + 1) % V])
        place = np.full(len(self.word), -1)
        place[at] = np.arange(len(at))

        def follow(rank: np.ndarray, by: int) -> np.ndarray:
            """The rank that many bytes on; -1 past the end."""
            there = place[np.minimum(at + by, len(place) - 1)]
            return np.where(there >= 0, rank[np.maximum(there, 0)], -1)

        keys = [self.word[at + 8 * k] for k in range(V // 8)]
        rank = dense(np.lexsort(keys[::-1]), *keys)
        for depth in (V, 2 * V):  # ranks by 128, then by 256 bytes
            after = follow(rank, depth)
            rank = dense(np.lexsort((after, rank)), rank, after)
        self.rank = np.full(len(self.word), -1)
        self.rank[at] = rank

    def sorted(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of `start` in the order of the suffixes there, without those that share M bytes with none; and where groups that share them begin."""
        keys = [self.word[start + 8 * k] for k in range(M // 8)]
        order = np.lexsort(keys[::-1])
        group = dense(order, *keys)[order]
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        open_ = np.arange(len(order))  # places in `order` that are not settled
        part = group.copy()
        while len(open_):
            p = part[open_]
            begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            size = np.diff(np.r_[begin, len(p)])
            mine, pivot = start[order[open_]], np.repeat(start[order[open_[begin + size // 2]]], size)
            d = self.step[mine % V, pivot % V]
            side = np.sign(self.rank[mine + d] - self.rank[pivot + d])
            local = np.repeat(np.arange(len(begin)), size)
            turn = np.lexsort((side, local))
            order[open_] = order[open_[turn]]
            side, local = side[turn], local[turn]
            piece = np.cumsum(np.r_[False, (side[1:] != side[:-1]) | (local[1:] != local[:-1])])
            going = (side != 0) & (np.bincount(piece)[piece] > 1)
            part = np.zeros(len(order), np.int64)
            part[open_] = piece
            open_ = open_[going]
        return order, group

    def repeated(self, start: np.ndarray, length: int) -> np.ndarray:
        """Whether the string of `length` bytes at each place stands at another of the places too. The suffixes of one first word are a bucket; buckets are sorted together up to AT_ONCE suffixes."""
        out = np.zeros(len(start), bool)
        first = self.word[start]
        turn = np.argsort(first, kind="stable")
        edges = np.r_[np.flatnonzero(np.r_[True, first[turn][1:] != first[turn][:-1]]), len(turn)] if len(turn) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(edges) - 1:
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + AT_ONCE, "right")) - 1)
            some = turn[edges[lo] : edges[hi]]
            lo = hi
            order, group = self.sorted(start[some])
            if not len(order):
                continue
            at = start[some[order]]
            same = np.flatnonzero(group[1:] == group[:-1])
            for k in (*range(M, length - 7, 8), length - 8):
                same = same[self.word[at[same] + k] == self.word[at[same + 1] + k]]
            out[some[order[same]]] = True
            out[some[order[same + 1]]] = True
        return out


def _end(batches):
    yield from batches
    yield None


def _find_runs(src: DataFrame, length: int) -> DataFrame:
    """(kind, bucket, u, start, size): kind 0 runs that occur again, 1 runs to be read, 2 runs that 1 is to be compared with."""

    def emit(batches):
        seen: set[bytes] = set()  # texts that this task has read: copies are removed whole anyway
        for b in batches:
            us = b.column(0).to_numpy()
            for lo, hi, buf, offsets in byte_chunks(b.column(1)):
                doc, start, size, bucket, at, multi = runs(buf, offsets, length)
                if len(seen) > REMEMBERED:
                    seen.clear()
                texts = [xxhash.xxh3_128_digest(buf[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ok = np.array([not (t in seen or seen.add(t)) for t in texts], bool)[doc]
                full = digests(buf, at[ok], at[ok] + size[ok] + length - 1)
                columns = [bucket[ok].view(np.int64), full[:, 0], full[:, 1], us[lo:hi][doc[ok]], start[ok].astype(np.int32), (size[ok] * 2 + multi[ok]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["bucket", "full", "more", "u", "start", "size"])

    def count(batches):
        rest = None
        for b in _end(batches):
            cols = [np.zeros(0, np.int64)] * 6 if b is None else [b.column(i).to_numpy() for i in range(6)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            edge = n
            if b is not None:
                differ = np.flatnonzero(cols[0][1:] != cols[0][:-1])
                edge = int(differ[-1]) + 1 if len(differ) else 0
            rest = [x[edge:] for x in cols]
            bucket, full, more, u, start, size = (x[:edge] for x in cols)
            if not len(bucket):
                continue
            multi, size = size % 2 == 1, size // 2
            head = np.r_[True, bucket[1:] != bucket[:-1]]
            lead = head | np.r_[True, (full[1:] != full[:-1]) | (more[1:] != more[:-1])]
            kinds = np.cumsum(lead) - 1
            again = (np.bincount(kinds) > 1)[kinds]
            group = np.cumsum(head) - 1
            several = (np.bincount(group, lead) > 1)[group]
            single = ~again & (several | multi)
            asked = (np.bincount(group, single) > 0)[group]
            for kind, some in ((0, again), (1, single), (2, again & lead & asked)):
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), kind, np.int32)), pa.array(bucket[some]), pa.array(u[some]), pa.array(start[some].astype(np.int32)), pa.array(size[some].astype(np.int32))], names=["kind", "bucket", "u", "start", "size"])

    dealt = src.select("u", "t").mapInArrow(tidy(emit), "bucket long, full long, more long, u long, start int, size int")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "full", "more", "u", "start").mapInArrow(tidy(count), "kind int, bucket long, u long, start int, size int")


def _cut_out(length: int):
    """Rows (u, t, wanted) to the bytes of the wanted runs, dealt by what stands beside the minimizer. Of runs of the same bytes a task sends two; that others occur again is then known."""
    reach = (length - M) // 2

    def cut_out(batches):
        seen: dict[tuple[int, bytes], bool] = {}  # (bucket, digest of the bytes) that this task has sent, and whether with a second run for company
        for b in batches:
            for first in range(0, b.num_rows, 64):
                out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
                for u, t, wanted in zip(*(b.column(i).slice(first, 64) for i in range(3)), strict=True):
                    data = t.as_py()
                    total = prefix_hash(np.frombuffer(data, np.uint8))
                    at = np.arange(len(data) - M + 1)
                    gram = span_hash(total, at, at + M)
                    parts = []  # from, to (windows), side, bytes beside, bucket, kind
                    for r in wanted.as_py():
                        s, z, bucket = r["start"], r["size"], r["bucket"] & 0xFFFFFFFFFFFFFFFF
                        # Each window goes with the first minimizer in it, and with the bytes before it if it has enough of them, else with those behind.
                        lo = s
                        for p in (s + np.flatnonzero(gram[s : s + z + length - M] == U(bucket))).tolist():
                            hi, turn = min(s + z, p + 1), p - reach + 1
                            if lo < min(hi, turn):
                                parts.append((lo, min(hi, turn), 0, p - reach, p, bucket, r["kind"]))
                            if max(lo, turn) < hi:
                                parts.append((max(lo, turn), hi, 1, p + M, p + M + reach, bucket, r["kind"]))
                            lo = max(lo, hi)
                    if parts:
                        start, end, side, x, y, bucket, kind = (np.array(c, np.uint64 if i == 5 else np.int64) for i, c in enumerate(zip(*parts, strict=True)))
                        key = mix(span_hash(total, x, y) ^ mix(bucket + side.astype(np.uint64)))
                        same = [xxhash.xxh3_128_digest(data[i:j]) for i, j in zip(start.tolist(), (end + length - 1).tolist(), strict=True)]
                        send = np.ones(len(parts), bool)
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        for i, pair in enumerate(zip(key.tolist(), same, strict=True)):
                            if (paired := seen.get(pair)) is None:
                                seen[pair] = False
                            elif paired:
                                send[i] = False
                            else:
                                seen[pair] = True
                        # What has been sent twice is settled here: it goes by itself, as its negative size, to any task.
                        done = ~send & (kind == 1)
                        some = send | done
                        spread = mix(key + start.astype(np.uint64) + U(u.as_py() & 0xFFFFFFFFFFFFFFFF))
                        out[0].append(np.where(send, key, spread)[some].view(np.int64))
                        out[1].append(np.full(int(some.sum()), u.as_py()))
                        out[2].append(start[some].astype(np.int32))
                        out[3].append(np.where(send, kind, start - end)[some].astype(np.int32))
                        out[4].extend([data[i : j + length - 1] if k else b"" for i, j, k in zip(start[some].tolist(), end[some].tolist(), send[some].tolist(), strict=True)])
                if out[4]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out[:4]), pa.array(out[4], pa.binary())], names=["key", "u", "start", "kind", "bytes"])

    return cut_out


def _decide(length: int):
    """Rows (key, u, start, kind, bytes) in the order of key to (u, start, size) of the windows of kind 1 that occur again."""

    def sort_block(rows: list[tuple]) -> pa.RecordBatch | None:
        block = Block(b"".join(r[4] for r in rows))
        sizes = np.array([len(r[4]) for r in rows])
        first = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        found = block.repeated(first[row] + nth, length) & np.array([r[3] == 1 for r in rows])[row]
        new = found & ~np.r_[False, found[:-1] & (row[1:] == row[:-1])]
        start = np.flatnonzero(new)
        if not len(start):
            return None
        run = np.cumsum(new)[found] - 1
        us, starts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(us[row[start]]), pa.array((starts[row[start]] + nth[start]).astype(np.int32)), pa.array(np.bincount(run).astype(np.int32))], names=["u", "start", "size"])

    def decide(batches):
        held: list[tuple] = []  # of whole buckets, to be sorted
        bucket: dict[bytes, list[tuple]] = {}
        now, n = None, 0
        for b in _end(batches):
            same: list[tuple] = []
            for r in [None] if b is None else zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if r is not None and r[3] < 0:
                    same.append((r[1], r[2], -r[3]))
                    continue
                if r is None or r[0] != now:
                    # Runs of the same bytes occur again whole; one of them stays, to be compared with.
                    for data, rows in bucket.items():
                        if len(rows) > 1:
                            same += [(x[1], x[2], len(data) - length + 1) for x in rows if x[3] == 1]
                        if len(bucket) > 1 or len(rows) == 1 and _recurs(data, length):
                            held.append((*rows[0][:3], rows[0][3] if len(rows) == 1 else 2, data))
                            n += len(data)
                    bucket = {}
                    if held and (r is None or n >= BLOCK):
                        if (out := sort_block(held)) is not None:
                            yield out
                        held, n = [], 0
                if r is not None:
                    now = r[0]
                    bucket.setdefault(r[4], []).append(r)
            if same:
                u, start, size = zip(*same, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["u", "start", "size"])

    return decide


def _recurs(data: bytes, length: int) -> bool:
    """Whether a bucket of one run can hold a string twice."""
    return len(data) > length


def spans(docs: DataFrame, length: int = 200, marks: Callable[[int], Column] = lambda seed: F.xxhash64(F.lit(seed), "k", "t")) -> tuple[DataFrame, DataFrame, Column]:
    """Of rows with columns k and t (bytes): (rows with u, k, n_bytes, sha and `whole`; runs of windows u, start, size; the mark of a row).
    `whole`: the row's text has copies and is long enough. A mark u stands for one text."""
    docs = docs.select("k", "t")
    for seed in range(64):
        src = docs.withColumn("u", marks(seed))
        rows = cut(src.select("u", "k", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("sha")))
        if rows.groupBy("u").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").isEmpty():
            break
    else:
        raise RuntimeError("different texts share each mark")
    copied = rows.where(F.col("n_bytes") >= length).groupBy("sha").count().where("count > 1").select(F.col("sha").alias("sha2"))
    rows = rows.join(copied, F.col("sha") == F.col("sha2"), "left").select("u", "k", "n_bytes", "sha", F.col("sha2").isNotNull().alias("whole"))
    long = src.where(F.octet_length("t") >= length)
    found = cut(_find_runs(long, length))
    wanted = found.where("kind > 0").groupBy("u").agg(F.collect_list(F.struct("bucket", "start", "size", "kind")).alias("wanted"))
    wanted = cut(wanted)
    n = wanted.count()
    chosen = long.join(maybe_broadcast(wanted.select("u"), n), "u", "left_semi").select("u", "t").dropDuplicates(["u"]) if n else long.select("u", "t").limit(0)
    pieces = chosen.join(wanted, "u").select("u", "t", "wanted").mapInArrow(tidy(_cut_out(length)), "key long, u long, start int, kind int, bytes binary")
    decided = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_decide(length)), "u long, start int, size int")
    return rows, found.where("kind = 0").select("u", "start", "size").unionByName(decided), marks(seed)


def removed_intervals(starts: np.ndarray, sizes: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal intervals of bytes that windows cover; intervals that touch are one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), (starts + sizes + length - 1)[order].astype(np.int64)
    reach = np.maximum.accumulate(e)
    new = np.r_[True, s[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return list(zip(s[at].tolist(), reach[np.r_[at[1:] - 1, len(s) - 1]].tolist(), strict=True))


def _listed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(u, starts, sizes) of rows that lose something but not all."""
    return cut(found.join(rows.where("whole").select("u").distinct(), "u", "left_anti").groupBy("u").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes")))


def _without(data: bytes, starts: pa.Scalar, sizes: pa.Scalar, length: int) -> tuple[bytes, int]:
    """What remains, and the number of intervals that went."""
    gone = removed_intervals(starts.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy(zero_copy_only=False), length)
    return b"".join(data[a:e] for a, e in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True)), len(gone)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    rows, found, mark = spans(src, length)
    rows = cut(rows)
    listed = _listed(rows, found)
    n = listed.count()
    src = src.withColumn("u", mark)
    hit = src.join(maybe_broadcast(listed.select("u"), n), "u", "left_semi").select("u", "t").dropDuplicates(["u"]) if n else src.select("u", "t").limit(0)
    schema = pa.schema([("u2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(batches):
        for b in batches:
            out = []
            for u, t, starts, sizes in zip(*(b.column(i) for i in range(4)), strict=True):
                kept, n = _without(data := t.as_py(), starts, sizes, length)
                out.append({"u2": u.as_py(), "n_removed": len(data) - len(kept), "n_spans": n, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    changed = hit.join(listed, "u").select("u", "t", "starts", "sizes").mapInArrow(tidy(digest), "u2 long, n_removed long, n_spans long, kept_sha256 string")
    out = rows.join(changed, F.col("u") == F.col("u2"), "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("k").alias(key), "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(F.col("whole"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", length: int = 200) -> DataFrame:
    """All rows with what remains of their texts (cut characters are left out), and the number of its characters where there is such a column. A null
    text stays null, and equal rows lose the same each. Columns of any names are kept as they are."""
    plain, back = numbered(docs, {key: "k", text: "words"} | ({n_chars: "n"} if n_chars in docs.columns else {}))
    plain = plain.withColumn("t", F.coalesce("words", F.lit("")).cast("binary"))
    rows, found, mark = spans(plain, length)
    rows = cut(rows)
    listed = _listed(rows, found)
    wholly = rows.where("whole").select("u").distinct()
    touched = cut(listed.select("u", "starts", "sizes").unionByName(wholly.select("u", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("array<int>").alias("sizes"))))
    n = touched.count()
    if not n:
        return docs
    plain = plain.withColumn("u", mark)
    same = plain.join(maybe_broadcast(touched.select("u"), n), "u", "left_anti")
    hit = plain.join(maybe_broadcast(touched.select("u"), n), "u", "left_semi").join(touched, "u")
    rest = [c for c in plain.columns if c not in ("u", "t", "words", "n")]
    kinds = dict(plain.dtypes)

    def shorten(batches):
        for b in batches:
            texts = []
            for t, starts, sizes in zip(*(b.column(i) for i in range(3)), strict=True):
                texts.append("" if starts.as_py() is None else _without(t.as_py(), starts, sizes, length)[0].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[3:]], names=["words", *rest])

    short = hit.select("t", "starts", "sizes", *rest).mapInArrow(tidy(shorten), ", ".join(["words string", *(f"{c} {kinds[c]}" for c in rest)]))
    if "n" in kinds:
        short = short.withColumn("n", F.length("words").cast(kinds["n"]))
    return back(same.drop("u", "t").unionByName(short))


def oracle(length: int = 200, piece: int = 1000) -> str:
    """The same rows in DuckDB's SQL, by all windows. Texts are read in pieces, as taking a part of a long string takes time in proportion to it."""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n_bytes FROM d),
pieces AS (SELECT doc_id, n_bytes, j, substr(h, 2 * {piece} * j + 1, 2 * ({piece} + {length - 1})) AS p FROM (SELECT doc_id, h, n_bytes, unnest(range(n_bytes // {piece} + 1)) AS j FROM n)),
windows AS (SELECT doc_id, {piece} * j + i AS i, md5(substr(p, 2 * i + 1, {2 * length})) AS w FROM (SELECT doc_id, j, p, unnest(range(least({piece}, len(p) // 2 - {length - 1}))) AS i FROM pieces)),
again AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS m FROM windows) WHERE m > 1),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM again)),
spans AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM runs GROUP BY doc_id, run),
edges AS (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n_bytes, n_bytes FROM n),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS a, a AS b FROM edges),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS h FROM kept JOIN n USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT n.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest.h)) AS kept_sha256
FROM n JOIN rest USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
