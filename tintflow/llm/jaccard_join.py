"""N-gram Jaccard join by a prefix tree, and the components of its links.

A document's set is its distinct five-word shingles. All sets are brought into one global order: shingles that are frequent in a bounded
sample come last, by how frequent they are there, and shingles of one such class in order of their hash. (Any order gives the right links;
this one keeps passages that many documents share out of the prefixes. The table of frequent shingles has a million entries at most.)

1. Documents of equal sets are one class. Only classes are joined.
2. Two sets of similarity t share m of their first n - ceil(t n) + m shingles, for any m up to ceil(t n). Classes are dealt by these, with an m
   that grows with the set (`shared`). In a shingle's group a class that no other one can link with, by the bounds of length and position, falls
   away. A class that is left in fewer groups than its smallest partner's m links with nothing, and is dropped before sets are sent anywhere:
   the larger a corpus, the more sets have some shingle in common by chance. The others are grouped again, and meet in the block of the group's
   first class. Near copies share most of their groups, so a class goes to few blocks, and goes there once.
3. A block's sets, in lexicographic order, are a prefix tree. It is traversed for one set at a time: all that share a path share its
   overlap, and a subtree is left as soon as what remains of it, or of the set, cannot suffice. What reaches a leaf is a link, counted in
   full. Sets of one component are never compared, and the largest component is never asked for, so that a block of near copies takes a
   few traversals; and it gives one row for each of its members at most, which names the member's root.
4. Blocks beyond CELL are split: each part has the block's first class, so that copies of it unite, and those that are left over then meet
   all parts. No row, pair or group is dropped, and no task holds more than a part.

Classes are 64-bit hashes of sets, and shingles 64-bit keys (4 bits of the order and 60 of a hash). Defined results: texts that are null,
empty or without words have the empty set and are linked with nothing; repeated rows are equal sets; a null key never names a component
unless all of its keys are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, tidy
from .textkit import U, Words, byte_chunks, mix, shingles

#: Rows (of 24 bytes at most) up to which a table of classes or marks is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Classes, and shingles, that a part of a block has at most (but for hashing's unevenness, and one set that is larger).
CELL, CELL_SHINGLES = 2_048, 4_000_000
#: Rows of a shingle's group that are held to try the bounds; a larger group is passed on whole, as a stream.
GROUP = 200_000
#: Of so many shingles of a set, one more is dealt, and one more must be shared.
SPARE = 16


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Order:
    """The global order, as 64-bit keys of shingles: how frequent one is in the sample (0 to 15), then its hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by_value = np.argsort(hashes)
        self.values = hashes[by_value]
        self.kinds = np.minimum(np.frexp(counts[by_value].astype(float))[1] - 1, 15).astype(np.uint64)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes >> U(4)
        if not len(self.values):
            return low
        at = np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)
        return np.where(self.values[at] == hashes, self.kinds[at] << U(60), U(0)) | low


NOTHING = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def ordered_sets(buf: np.ndarray, offsets: np.ndarray, width: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of shingles in the global order, offsets by text, class of each text)."""
    value, at = shingles(Words(buf, offsets), width)
    n = np.diff(at)
    with np.errstate(over="ignore"):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value), out=total[1:])
        cls = mix((total[at[1:]] - total[at[:-1]]) ^ mix(n.astype(np.uint64)))
    keys = order.keys(value)
    if len(order.values):
        keys = keys[np.lexsort((keys, np.repeat(np.arange(len(n)), n)))]
    return keys, at, cls.view(np.int64)


def link_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: tuple[int, int] = (75, 100), sample_docs: int = 24_000, sample_share: float = 0.1) -> DataFrame:
    """key, n_shingles, component_id of each row; links are pairs of sets whose intersection is threshold of their union at least."""
    num, den = threshold
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("u", F.xxhash64("k", "t"))
    kind = dict(src.dtypes)["k"]
    order = docs.sparkSession.sparkContext.broadcast(_frequent(src, width, sample_docs, sample_share))

    def sizes(batches):
        for b in batches:
            n, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, buf, offsets in byte_chunks(b.column("t")):
                _, at, cls = ordered_sets(buf, offsets, width, NOTHING)
                n.append(np.diff(at)), c.append(cls)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("u"), pa.array(np.concatenate(n)), pa.array(np.concatenate(c))], names=["k", "u", "n", "c"])

    members = cut(src.mapInArrow(tidy(sizes), f"k {kind}, u long, n long, c long"))
    comps = _components_of_classes(src, members, width, order, num, den)
    # A component's name is the smallest key of any of its documents.
    classes = members.where("n > 0").groupBy("c").agg(F.min("k").alias("low"))
    if comps is None:
        by_class = classes.select(F.col("c").alias("c2"), F.col("low").alias("component_id"))
    else:
        named = cut(classes.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c")))
        lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
        by_class = named.join(lowest, "comp").select(F.col("c").alias("c2"), "component_id")
    by_class = cut(by_class)
    out = members.join(maybe_broadcast(by_class, by_class.count()), (F.col("c") == F.col("c2")) & (F.col("n") > 0), "left")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without those that another row of their component stands for: the one of the smallest key stays. Of rows of one key, one stays;
    rows without a key stay, and so do empty texts. Columns of any names are kept as they are."""
    plain, back = numbered(docs, {key: "k", text: "t"})
    linked = cut(link_sets(plain, "k", "t", **options).select(F.col("k").alias("k2"), "component_id"))
    gone = cut(linked.where("k2 <> component_id").select("k2").distinct())
    several = cut(linked.where("k2 = component_id").groupBy("k2").count().where("count > 1").select("k2"))
    out = plain.join(maybe_broadcast(gone, gone.count()), F.col("k") == F.col("k2"), "left_anti")
    n = several.count()
    if n:
        several = maybe_broadcast(several, n)
        out = out.join(several, F.col("k") == F.col("k2"), "left_anti").unionByName(out.join(several, F.col("k") == F.col("k2"), "left_semi").dropDuplicates(["k"]))
    return back(out)


def _frequent(src: DataFrame, width: int, sample_docs: int, sample_share: float, most: int = 1_000_000) -> Order:
    """The order that puts shingles of several documents of a sample last. About `sample_docs` rows are taken, or a `sample_share` where that is more, by a hash."""
    total = src.count()
    if not total:
        return NOTHING
    share = min(1.0, max(sample_share, sample_docs / total))
    some = src.where(F.pmod("u", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("t").distinct() if share < 1 else src.select("t").distinct()

    def rows(batches):
        for b in batches:
            for _, _, buf, offsets in byte_chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(Words(buf, offsets), width)[0].view(np.int64))], names=["h"])

    counted = some.mapInArrow(tidy(rows), "h long").groupBy("h").count().where("count > 1")
    # The commonest of them, of 16 bytes each. Which ones are ranked decides speed, not results.
    top = counted.orderBy(F.col("count").desc(), "h").limit(most).toArrow()
    return Order(top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy())


def _and_end(batches):
    yield from batches
    yield None


def partners(n: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of a group, in order of size n, another one can link with, if the group's shingle, at `pos`, is the first that they share.

    What follows in either must hold all of the overlap: (n1 - p1) (num + den) >= num (n1 + n2), and the same for the other one. So a set
    bounds its partner's size from above, and the best partner is the one of the highest bound among those that are small enough.
    """
    bound = (n - pos) * (num + den) // num - n
    ahead = np.maximum.accumulate(bound)
    first = np.maximum.accumulate(np.r_[True, bound[1:] > ahead[:-1]] * np.arange(len(n)))  # who has that bound
    second = np.full(len(n), -1)
    rest = np.where(first[1:] == first[:-1], bound[1:], ahead[:-1])  # what the newcomer leaves behind
    second[1:] = np.maximum.accumulate(rest)
    at = np.searchsorted(n, bound, "right") - 1
    some = at >= 0
    best = np.where(first[at] == np.arange(len(n)), second[at], ahead[at])
    return some & (best >= n)


def shared(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of its prefix's shingles a set of n has in common with any that it links with and that is no smaller. It never falls with n."""
    return np.minimum(1 + n // SPARE, -(-n * num // den))


def _components_of_classes(src: DataFrame, members: DataFrame, width: int, order, num: int, den: int) -> DataFrame | None:
    """(c, comp) of classes in components of several classes; None if there are none."""

    def prefixes(batches):
        seen: set[int] = set()  # classes that this task has dealt
        for b in batches:
            for _, _, buf, offsets in byte_chunks(b.column(0)):
                value, at, cls = ordered_sets(buf, offsets, width, order.value)
                n = np.diff(at)
                fresh = np.zeros(len(n), bool)
                fresh[np.unique(cls, return_index=True)[1]] = True
                fresh &= n > 0
                some = [i for i in np.flatnonzero(fresh) if int(cls[i]) not in seen]
                seen.update(cls[some].tolist())
                more = shared(n[some], num, den)
                take = n[some] - -(-n[some] * num // den) + more
                first = np.cumsum(take) - take
                pos = np.arange(take.sum()) - np.repeat(first, take)
                h = value[np.repeat(at[:-1][some], take) + pos]
                # Of the m that are shared the last has m - 1 before it: the bounds hold for a place that is so much earlier.
                pos -= np.repeat(more - 1, take)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(cls[some], take)), pa.array(np.repeat(n[some], take).astype(np.int32)), pa.array(pos.astype(np.int32))], names=["h", "c", "n", "pos"])

    def meeting(batches):
        """Sorted by h, n, c, to (block, h, c, n, pos). The last group of a batch waits for the next, up to GROUP rows; what is longer is passed on as it comes."""
        rest, lead = None, None  # rows that wait; (h, block) of a group that is passed on
        for b in _and_end(batches):
            h, c, n, pos = ((np.zeros(0, np.int64),) * 4 if b is None else tuple(b.column(i).to_numpy().astype(np.int64) for i in range(4)))
            if rest is not None:
                h, c, n, pos = (np.concatenate(x) for x in zip(rest, (h, c, n, pos), strict=True))
            if not len(h):
                continue
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            h, c, n, pos = h[keep], c[keep], n[keep], pos[keep]
            if lead is not None:
                more = int(np.searchsorted(h, lead[0], "right")) if h[0] == lead[0] else 0
                if more:
                    yield _blocks(np.full(more, lead[1]), h[:more], c[:more], n[:more], pos[:more])
                h, c, n, pos = h[more:], c[more:], n[more:], pos[more:]
                if not len(h):
                    rest = None
                    continue
                lead = None
            edge = len(h) if b is None else int(np.searchsorted(h, h[-1]))
            if len(h) - edge > GROUP:
                lead = (h[edge], c[edge])
                yield _blocks(np.full(len(h) - edge, c[edge]), h[edge:], c[edge:], n[edge:], pos[edge:])
                rest = None
            else:
                rest = (h[edge:], c[edge:], n[edge:], pos[edge:])
            h, c, n, pos = h[:edge], c[:edge], n[:edge], pos[:edge]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            size = np.diff(np.r_[begin, len(h)])
            # Groups of two, the most of them, are tried all at once.
            s = begin[size == 2]
            s = s[np.minimum(n[s] - pos[s], n[s + 1] - pos[s + 1]) * (num + den) >= num * (n[s] + n[s + 1])] if len(s) else s
            out = [(c[s], h[i], c[i], n[i], pos[i]) for i in (s, s + 1)] if len(s) else []
            for s, z in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                ok = np.flatnonzero(partners(n[s : s + z], pos[s : s + z], num, den)) + s
                if len(ok):
                    out.append((np.full(len(ok), c[ok[0]]), h[ok], c[ok], n[ok], pos[ok]))
            if out:
                yield _blocks(*(np.concatenate(x) for x in zip(*out, strict=True)))

    dealt = src.select("t").mapInArrow(tidy(prefixes), "h long, c long, n int, pos int")
    meet = lambda rows: rows.repartition("h").sortWithinPartitions("h", "n", "c").mapInArrow(tidy(meeting), "block long, h long, c long, n long, pos long")
    met = cut(meet(dealt).select("h", "c", F.col("n").cast("int"), F.col("pos").cast("int")))
    # A partner has ceil(t n) shingles at least. A group that was passed on in parts may count twice, which keeps a class.
    partner = F.expr(f"(n * {num}L + {den - 1}) div {den}").alias("least")
    enough = met.groupBy("c", partner).count().where(f"count >= least(1 + least div {SPARE}, (least * {num} + {den - 1}) div {den})").select("c")
    blocks = cut(meet(met.join(enough, "c", "left_semi").select("h", "c", "n", "pos")).groupBy("block", "c").agg(F.first("n").alias("n")))
    n_rows = blocks.count()
    if not n_rows:
        return None
    size = blocks.groupBy("block").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    parts = F.greatest(F.ceil(F.col("m") / CELL), F.least(F.ceil(F.col("weight") / CELL_SHINGLES), F.col("m"))).cast("long")
    size = cut(size.select("block", parts.alias("parts")))
    whole, split = size.where("parts = 1"), cut(size.where("parts > 1"))
    cells = blocks.join(maybe_broadcast(whole.select("block"), n_rows), "block", "left_semi").select(F.xxhash64("block", F.lit(0)).alias("cell"), "c")
    n_split = split.count()
    if n_split:
        dealt = cut(blocks.join(maybe_broadcast(split, n_split), "block").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts"))))
        first = split.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.xxhash64("block", F.lit(1), "part").alias("cell"), F.col("block").alias("c"))
        cells = cells.unionByName(dealt.where("c <> block").select(F.xxhash64("block", F.lit(1), "part").alias("cell"), "c")).unionByName(first)
    sets = _sets(src, members, blocks.select("c").distinct(), width, order)
    sets = cut(sets) if n_split else sets
    links = cut(_joined(cells.withColumn("comp", F.lit(None).cast("long")), sets, num, den))
    if links.isEmpty():
        return None
    comps = components(links)
    if not n_split:
        return comps
    # What the parts of a block have not united meets all of its parts, but for its largest component, whose members have met their own kind.
    known = cut(dealt.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c")))
    main = known.groupBy("block", "comp").agg(F.count("*").alias("m")).groupBy("block").agg(F.max(F.struct("m", "comp")).alias("x"), F.count("*").alias("several")).where("several > 1").select("block", F.col("x.comp").alias("main"))
    open_ = known.join(maybe_broadcast(main, n_split), "block")
    over = cut(open_.where("comp <> main"))
    if over.isEmpty():
        return comps
    chunks = over.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / CELL), F.least(F.ceil(F.sum("n") / CELL_SHINGLES), F.count("*"))).cast("long").alias("chunks"))
    open_ = open_.join(maybe_broadcast(chunks, n_split), "block")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = open_.where("comp <> main").withColumn("chunk", F.pmod(F.xxhash64("c", F.lit(1)), F.col("chunks"))).withColumn("part", every("parts"))
    there = open_.withColumn("chunk", every("chunks"))
    both = asked.select("block", "part", "chunk", "c", "comp").unionByName(there.select("block", "part", "chunk", "c", "comp"))
    cells = both.select(F.xxhash64("block", F.lit(2), "part", "chunk").alias("cell"), "c", "comp").distinct()
    more = _joined(cells, sets, num, den)
    return components(links.unionByName(more))


def _blocks(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["block", "h", "c", "n", "pos"])


def _sets(src: DataFrame, members: DataFrame, classes: DataFrame, width: int, order) -> DataFrame:
    """(c, ordered) of classes, each from the row of its smallest mark. Equal rows may give a class more than once, but a task gives it once."""
    # Rows are summed up by class before they are shuffled; a semi-join would be pushed below that.
    marks = cut(members.where("n > 0").groupBy("c").agg(F.min("u").alias("u")).join(classes, "c"))
    n = marks.count()
    chosen = src.join(maybe_broadcast(marks.select("u").distinct(), n), "u", "left_semi").select("t")

    def rows(batches):
        seen: set[int] = set()
        for b in batches:
            for _, _, buf, offsets in byte_chunks(b.column(0)):
                value, at, cls = ordered_sets(buf, offsets, width, order.value)
                new = [i for i, c in enumerate(cls.tolist()) if not (c in seen or seen.add(c))]
                yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array([value[at[i] : at[i + 1]].tobytes() for i in new], pa.binary())], names=["c", "ordered"])

    return chosen.mapInArrow(tidy(rows), "c long, ordered binary").join(maybe_broadcast(marks.select("c"), n), "c", "left_semi")


def _joined(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): for each class that a cell unites with others, the root of what is united. Cells are (cell, c, comp); classes of one comp are united already."""
    cells = cut(cells)
    rows = sets.join(maybe_broadcast(cells, cells.count()), "c").select("cell", "c", "comp", "ordered").repartition("cell").sortWithinPartitions("cell", "c")

    def united(batches):
        now, held = None, []
        for b in _and_end(batches):
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for r in [None] if b is None else zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (r is None or r[0] != now):
                    out.append(unite([x[1] for x in held], [x[2] for x in held], [np.frombuffer(x[3], np.uint64) for x in held], num, den))
                    held = []
                if r is not None and not (held and held[-1][1] == r[1]):
                    now = r[0]
                    held.append(r)
            if out:
                a, c = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])

    return rows.mapInArrow(tidy(united), "a long, b long")


def unite(classes: list[int], comps: list[int | None], sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, root) of classes that links unite, where they are not united before. Each traversal is for a set outside the largest component of those not yet asked for."""
    first: dict[int, int] = {}
    group = np.array([first.setdefault(x, i) if x is not None else i for i, x in enumerate(comps)], np.int64)
    before = group.copy()
    if (group != group[0]).any():
        tree = PrefixTree(sets)
        waiting = np.ones(len(sets), bool)
        turn = 0  # the first class of a block has most of its groups
        while True:
            waiting[turn] = False
            around = np.flatnonzero(waiting & (group != group[turn]))
            if len(around):
                linked = tree.linked(turn, around, num, den)
                if len(linked):
                    group[np.isin(group, group[linked])] = group[turn]
            left = np.flatnonzero(waiting)
            if len(left) < 2:
                break
            count = np.bincount(group[left], minlength=len(group))
            if count.max() == len(left):
                break
            turn = int(left[np.argmin(count[group[left]])])
    ids = np.array(classes, np.int64)
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, group, ids)
    root = root[group]
    parts = np.unique(group * len(group) + before) // len(group)  # a group's entry for each of what it unites
    new = (np.bincount(parts, minlength=len(group))[group] > 1) & (ids != root)
    return ids[new], root[new]


class PrefixTree:
    """Ordered sets as a prefix tree: sorted, they stand leaf by leaf, and those that follow one another share their common path. Paths are cut into steps of some shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        start = np.cumsum(size) - size
        by_path = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())  # lexicographic, as keys are compared byte by byte
        self.leaf = np.array(by_path)
        self.place = np.empty(len(sets), np.int64)
        self.place[self.leaf] = np.arange(len(sets))
        self.ids, self.size, self.start = ids.astype(np.int64), size[self.leaf], start[self.leaf]
        self.step = max(32, 4096 // len(sets))
        common = np.zeros(len(sets), np.int64)  # shingles that a leaf's path shares with the one before it
        for i in range(1, len(sets)):
            a, b = self.path(i - 1), self.path(i)
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[i] = differ[0] if len(differ) else m
        self.common = common
        self.nodes: dict[int, np.ndarray] = {}  # by depth, the node of each leaf
        self.held = np.zeros(len(self.vocabulary), bool)

    def path(self, i: int) -> np.ndarray:
        return self.ids[self.start[i] : self.start[i] + self.size[i]]

    def linked(self, query: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
        """Those of the sets `others` that link with the set `query`."""
        mine = self.path(self.place[query])
        leaves = np.sort(self.place[others])
        n = len(mine)
        need = -(-num * (self.size[leaves] + n) // (num + den))
        fits = np.minimum(self.size[leaves], n) >= need
        leaves, need = leaves[fits], need[fits]
        overlap = np.zeros(len(leaves), np.int64)
        self.held[mine] = True
        found, depth = [], 0
        while len(leaves):
            # Leaves that share the path to the end of this step are one node of it.
            parted = self.parted(leaves, depth + self.step)
            node = np.cumsum(parted) - 1
            head = leaves[parted]
            at = depth + np.arange(self.step)
            inside = at[None, :] < self.size[head][:, None]
            shingle = self.ids[np.where(inside, self.start[head][:, None] + at, 0)]
            got = (self.held[shingle] & inside).sum(axis=1)
            last = self.ids[self.start[head] + np.minimum(depth + self.step, self.size[head]) - 1]
            ahead = n - np.searchsorted(mine, last, "right")  # of the query, beyond this step
            overlap += got[node]
            depth += self.step
            done = self.size[leaves] <= depth
            if done.any():
                found.append(self.leaf[leaves[done & (overlap >= need)]])
            going = ~done & (overlap + np.minimum(self.size[leaves] - depth, ahead[node]) >= need)
            leaves, need, overlap = leaves[going], need[going], overlap[going]
        self.held[mine] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def parted(self, leaves: np.ndarray, depth: int) -> np.ndarray:
        """Whether the path to `depth` of each of these leaves is another one than that of the leaf before it."""
        if depth not in self.nodes:
            self.nodes[depth] = np.cumsum(self.common < depth)
        out = np.ones(len(leaves), bool)
        out[1:] = np.diff(self.nodes[depth][leaves]) > 0
        return out


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(c, comp) of all ends of links (a, b); comp is the smallest end of the component. Each round takes the least label around, then the label's own label."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("c").alias("b"), F.col("comp").alias("label")), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("label"))
        lower = labels.join(around, "c").select("c", F.col("comp").alias("was"), F.least("comp", "label").alias("comp"))
        jump = labels.select(F.col("c").alias("comp"), F.col("comp").alias("further"))
        lower = cut(lower.join(jump, "comp").select("c", "was", F.least("comp", "further").alias("comp")))
        labels = lower.select("c", "comp")
        if lower.where("was <> comp").isEmpty():
            return labels
    raise RuntimeError("components: no end in sight")


def oracle(width: int = 5, threshold: tuple[int, int] = (75, 100)) -> str:
    """The same rows in DuckDB's SQL, by the shingles themselves and all pairs that share one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    num, den = threshold
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, w[i : i + {width - 1}] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE {den} * m >= {num} * (x.n + y.n - m)),
both_ AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""
