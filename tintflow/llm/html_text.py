"""Main text of web pages: the host's suffix array over the token streams of its pages, with the structure of a page as an input to it.

A page is read tag by tag into blocks, and structure says of each what it may be: part of an article (or main) container, chrome (menus,
headers, footers, sidebars, notices, adverts, forms, comments, and on a page with a container whatever is outside it), or open (a page
without a container). Scripts and styles are no blocks. The blocks of all pages of a host are laid end to end as streams of tokens, and all
suffixes of the streams are sorted by their first `run` tokens, by prefix doubling: a stretch of the sorted suffixes that agree on them
and come from distinct pages is a repeat, and the windows so marked cover exactly the tokens of the maximal repeats of `run` tokens and more.
What is covered decides:

- in open blocks, what recurs on another page is boilerplate and goes; the unique runs are kept;
- an article stays whole, as pages quote one another and use the same lines; with `cut_articles`, what stands as chrome on another page of the
  host goes (a notice or menu that was put into the container);
- chrome is never main text, repeated or not.

So one shuffle takes a host's blocks, compressed, to one task, or a host of more than CHUNK_PAGES pages (or CHUNK_BYTES of markup) to several
by a hash of address and markup. Each of these tells the windows of `run` tokens that it holds, in two rounds, and learns which of them other texts of
the host hold in other tasks, so that the size of a chunk decides no result: first a few bits of a hash of every window, a byte or two once
packed, and then all 64 bits, and the texts, of the few windows whose first bits another chunk has told too. Defined results: a null html is
empty, and so is its text; a page without blocks has an empty text; unclosed and stray tags are put up with; repeated pages are one text, so
that they are no evidence against each other; a null or broken url is a host of its own.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy
from .textkit import mix

#: Pages, and bytes of their markup, that one task looks for repeats in.
CHUNK_PAGES, CHUNK_BYTES = 2_000, 32 << 20
#: Bits of a window's hash that a chunk tells in the first round, and one more for each doubling of a host's chunks. They decide how many windows
#: go on to the second round for nothing, and no result: a chunk has some hundred thousand windows, so that it is a few of a hundred.
FIRST_BITS = 24
#: Hosts beyond a chunk (16 bytes each) up to which they are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
MARK = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements by what they say of their content.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form script style template noscript button select option menu dialog svg canvas object audio video map iframe textarea title math fieldset datalist input".split())
KEPT = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an unclosed one ends with.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr"))}
#: Words in a class, an id or a role that mark what is no main text.
CHROME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav\w*|newsletter|notices?|pager|pagination|popup|modal|promo\w*|related|recommend\w*|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
#: And those that mark a container of main text.
BODY = re.compile(r"(?:^|\s)(?:main|article|(?:article|entry|post|story)[-_]?(?:body|content|text))(?:$|\s)", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """(blocks of the article, open blocks, whether there is a container)."""
    lines, says, found = all_blocks(page)
    return [x for x, k in zip(lines, says, strict=True) if k == 1], [x for x, k in zip(lines, says, strict=True) if k == 0], found


def all_blocks(page: str) -> tuple[list[str], list[int], bool]:
    """(blocks in the page's order, 1 for one of the article, 0 for an open one and -1 for a dropped one, whether there is a container)."""
    lines: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, int]] = []  # element, and what it says: 1 kept, -1 dropped, 0 nothing
    # Where in the stack elements of a name are, blocks, and elements that say something: an end tag finds its place without a walk.
    named: dict[str, list[int]] = {}
    block_at: list[int] = []
    kept_at: list[int] = []
    dropped_at: list[int] = []
    found = False
    buffer: list[str] = []
    was_inside = was_dropped = False

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                lines.append(text), kinds.append(-1 if was_dropped else int(was_inside))

    def note() -> None:
        nonlocal was_inside, was_dropped
        was_inside, was_dropped = bool(kept_at), bool(dropped_at)

    def leave(n: int) -> None:
        for name, _ in stack[n:]:
            named[name].pop()
        for places in (block_at, kept_at, dropped_at):
            while places and places[-1] >= n:
                places.pop()
        del stack[n:]
        note()

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                buffer.append(entities.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]))
            continue
        if m[1] or m[4]:
            i = named[name][-1] if named.get(name) else -1
            # An inline end tag ends nothing beyond its block, nor does a stray end tag end the article.
            if i < 0 or name in INLINE and block_at and block_at[-1] > i or kept_at and kept_at[-1] > i and name not in KEPT and name not in ("body", "html"):
                continue
            if name not in INLINE or stack[i][1] or dropped_at and dropped_at[-1] >= i:
                flush()
            leave(i)
            continue
        attributes = m[3] or m[6] or ""
        if name not in INLINE:
            flush()
        ends = [i for i in range(max(0, len(stack) - 8), len(stack)) if name in CLOSED_BY.get(stack[i][0], ())]
        if ends and not any(says for _, says in stack[ends[-1] + 1 :]):
            flush()
            leave(ends[-1])
        if name in VOID:
            continue
        says = 0
        if name in KEPT:
            says, found = 1, found or not dropped_at
        elif name in DROPPED:
            says = -1
        elif attributes:
            marks = " ".join(a or b or c for a, b, c in MARK.findall(attributes))
            if marks and CHROME.search(marks) or HIDDEN.search(attributes):
                says = -1
            elif marks and BODY.search(marks):
                says, found = 1, found or not dropped_at
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if says:
            flush()
        for places in (named.setdefault(name, []), block_at if name not in INLINE else None, kept_at if says == 1 else dropped_at if says else None):
            if places is not None:
                places.append(len(stack))
        stack.append((name, says))
        note()
    flush()
    return lines, kinds, found


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def suffix_ranks(stream: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix by its first `run` tokens, by prefix doubling; suffixes that agree on them have one rank. For each place with so many tokens ahead."""
    rank, width = stream, 1
    while width < run:
        step = min(width, run - width)
        m = len(rank) - step
        if m <= 0:
            return np.zeros(0, np.int64)
        rank = np.unique(rank[:m] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1].reshape(-1)
        width += step
    return rank


class Streams:
    """The tokens of the blocks of pages, laid end to end. Pages of the same tokens are one."""

    def __init__(self, pages: list[list[list[str]]], chrome: list[list[bool]]):
        vocabulary: dict[str, int] = {}
        streams = [np.array([vocabulary.setdefault(w, len(vocabulary)) for block in page for w in block], np.int64) for page in pages]
        first: dict[bytes, int] = {}
        self.text = np.array([first.setdefault(s.tobytes(), i) for i, s in enumerate(streams)], np.int64)
        self.own = own = [i for i in range(len(pages)) if self.text[i] == i]
        self.lengths = [len(s) for s in streams]
        # A token of its own ends each page, so that no repeat crosses it.
        self.joined = np.concatenate([x for i in own for x in (streams[i], np.array([len(vocabulary) + i]))]) if own else np.zeros(0, np.int64)
        self.size = np.array([len(streams[i]) + 1 for i in own], np.int64)
        self.page = np.repeat(np.arange(len(own)), self.size)
        self.outer = np.concatenate([x for i in own for x in (np.repeat(np.array(chrome[i], bool), [len(b) for b in pages[i]]), np.ones(1, bool))]) if own else np.zeros(0, bool)
        self.pages, self.vocabulary = pages, vocabulary

    def as_chrome(self, run: int, m: int) -> np.ndarray:
        """Of the first m windows, whether they stand in dropped blocks alone."""
        inner = np.zeros(len(self.joined) + 1, np.int64)
        np.cumsum(~self.outer, out=inner[1:])
        return inner[run : m + run] == inner[:m]

    def windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all windows of `run` tokens, the same in any chunk."""
        ends = np.repeat(np.cumsum(self.size) - 1, self.size)
        at = np.flatnonzero(np.arange(len(self.joined)) + run <= ends)
        words = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.vocabulary], np.uint64)
        w = np.zeros(len(at), np.uint64)
        hashes = words.take(self.joined, mode="clip") if len(at) else words
        for k in range(run if len(at) else 0):
            w = mix(w ^ hashes[at + k])
        return at, w

    def texts(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the texts of the pages at these places."""
        texts = np.array([xxhash.xxh3_64_intdigest(" ".join(w for block in self.pages[i] for w in block).encode("utf-8", "surrogatepass")) for i in self.own], np.uint64)
        return texts.view(np.int64)[self.page[at]]


LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def held(pages: list[list[list[str]]], chrome: list[list[bool]], run: int, bits: int, among: np.ndarray) -> list[np.ndarray]:
    """(window, least and greatest text that holds it, and those that hold it as chrome: MOST and LEAST if none do) of each distinct window of some pages
    whose first bits are among some, which ascend."""
    streams = Streams(pages, chrome)
    at, w = streams.windows(run)
    some = within(first(w, bits), among)
    at, w = at[some], w[some]
    text = streams.texts(at)
    values, of = np.unique(w, return_inverse=True)
    as_chrome = streams.as_chrome(run, max(0, len(streams.joined) - run + 1))[at]
    out = [values]
    for some in (np.ones(len(at), bool), as_chrome):
        low, high = np.full(len(values), MOST), np.full(len(values), LEAST)
        np.minimum.at(low, of[some], text[some])
        np.maximum.at(high, of[some], text[some])
        out += [low, high]
    return out


def ascending(values: np.ndarray) -> np.ndarray:
    """The distinct ones, sorted."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each is among some, which ascend."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


def first_bits(chunks: int) -> int:
    return min(64, FIRST_BITS + (chunks - 1).bit_length())


def first(w: np.ndarray, bits: int) -> np.ndarray:
    return w >> np.uint64(64 - bits)


def ranges(values: np.ndarray, bits: int, n: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of ascending numbers of so many bits, dealt to n ranges by FIRST_BITS bits."""
    of = first(values << np.uint64(64 - bits), FIRST_BITS) * np.uint64(n) >> np.uint64(FIRST_BITS)
    ends = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)] if len(of) else []
    return [(int(of[lo]), lo, hi) for lo, hi in itertools.pairwise(ends)]


def pack(values: np.ndarray) -> bytes:
    """Numbers, compressed: the lowest bytes of all, then the next ones, and so on, so that what is small or rare costs next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def shared(told: list[bytes]) -> list[np.ndarray]:
    """Of the numbers that each chunk tells, once each, those that another tells too."""
    parts = [unpack_ascending(x) for x in told]
    every = np.sort(np.concatenate(parts))
    twice = every[1:][every[1:] == every[:-1]]
    return [x[within(x, twice)] for x in parts]


def pack_texts(columns: list[np.ndarray]) -> tuple[bytes, bytes]:
    """(distinct texts, places among them) of columns of texts, the least and the greatest in turn."""
    names, at = np.unique(np.concatenate(columns), return_inverse=True)
    at = at.reshape(len(columns), -1).astype(np.uint32)
    at[1::2] -= at[::2]  # mostly nothing: one text holds a window
    return pack(names), pack(at.reshape(-1))


def unpack_texts(names: bytes, at: bytes, n: int) -> np.ndarray:
    places = unpack(at, np.uint32).reshape(-1, 2, n)
    return unpack(names, np.int64)[np.cumsum(places, axis=1, dtype=np.uint32).reshape(-1, n)]


def elsewhere(told: list[tuple[bytes, bytes, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each chunk, from the windows that the chunks of a host tell and the texts that hold them: (windows that it must know another text holds in another
    chunk, the least and greatest text that hold them as chrome anywhere, if texts are told of that). A window that several of a chunk's own
    texts hold is known to recur without that."""
    parts = [unpack_ascending(w) for w, _, _ in told]
    texts = [unpack_texts(names, at, len(w)) for (_, names, at), w in zip(told, parts, strict=True)]
    every, of = np.unique(np.concatenate(parts), return_inverse=True)
    ends = []
    for k, x in enumerate(np.concatenate(texts, axis=1)):
        ends.append(np.full(len(every), LEAST if k % 2 else MOST))
        (np.maximum if k % 2 else np.minimum).at(ends[k], of, x)
    out, at = [], 0
    for w, own in zip(parts, texts, strict=True):
        here = of[at : at + len(w)]
        at += len(w)
        some = (ends[0] < ends[1])[here] & ((own[0] == own[1]) | (len(own) > 2))
        out.append((w[some], np.array([x[here[some]] for x in ends[2:]])))
    return out


def repeats(pages: list[list[list[str]]], chrome: list[list[bool]], run: int, others: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the tokens of each page's blocks: whether a repeat of `run` tokens and more covers them that is on another page too, and one that stands there as chrome. Pages of the same tokens are one.
    `others` are windows that other texts of the host hold in other chunks, and the least and greatest text that hold each as chrome in any chunk, or none."""
    streams = Streams(pages, chrome)
    own, size, page, joined = streams.own, streams.size, streams.page, streams.joined
    rank = suffix_ranks(joined, run)
    m = len(rank)
    covered = np.zeros((2, len(joined) + 1), np.int64)
    if m:
        here = page[:m]
        for k, some in enumerate((np.ones(m, bool), streams.as_chrome(run, m))):
            # The first and the last page of a stretch of suffixes that agree: another page than one's own is among them.
            low, high = np.full(int(rank.max()) + 1, len(own)), np.full(int(rank.max()) + 1, -1)
            np.minimum.at(low, rank[some], here[some])
            np.maximum.at(high, rank[some], here[some])
            at = np.flatnonzero((high[rank] >= 0) & ((low[rank] != here) | (high[rank] != here)))
            np.add.at(covered[k], at, 1)
            np.add.at(covered[k], at + run, -1)
    if others is not None and len(others[0]):
        at, w = streams.windows(run)
        order = np.argsort(others[0])
        there = order[np.minimum(np.searchsorted(others[0], w, sorter=order), len(order) - 1)]
        known = others[0][there] == w
        at, there = at[known], there[known]
        more = [at]
        if len(others) > 1:
            text, low, high = streams.texts(at), others[1][there], others[2][there]
            more.append(at[(low <= high) & ((low != text) | (high != text))])
        for k, some in enumerate(more):
            np.add.at(covered[k], some, 1)
            np.add.at(covered[k], some + run, -1)
    marks = np.cumsum(covered, axis=1)[:, :-1] > 0
    start = dict(zip(own, (np.cumsum(size) - size).tolist(), strict=True))
    spans = [(start[t], start[t] + streams.lengths[t]) for t in streams.text.tolist()]
    return [marks[0, a:b] for a, b in spans], [marks[1, a:b] for a, b in spans]


def tokens(pages: list[tuple[list[str], list[int], bool]]) -> tuple[list[list[list[str]]], list[list[bool]]]:
    """(tokens of blocks, whether a block is chrome) of each page."""
    return [[line.split(" ") for line in lines] for lines, _, _ in pages], [[k < 0 or found and k == 0 for k in kinds] for _, kinds, found in pages]


def main_texts(pages: list[tuple[list[str], list[int], bool]], run: int, cut_articles: bool = False, others: list[np.ndarray] | None = None) -> list[tuple[str, int]]:
    """(main text, tokens that repeats cover) of each page of a host, from (blocks, kinds, whether there is a container)."""
    words, outside = tokens(pages)
    every, chrome = repeats(words, outside, run, others)
    out = []
    for (lines, kinds, found), blocks_, again, menu in zip(pages, words, every, chrome, strict=True):
        gone, at, kept = menu & cut_articles if found else again, 0, []
        for line, block, kind in zip(lines, blocks_, kinds, strict=True):
            if kind == (1 if found else 0):
                cut_ = gone[at : at + len(block)]
                if not cut_.any():
                    kept.append(line)
                elif not cut_.all():
                    kept.append(" ".join(w for w, c in zip(block, cut_.tolist(), strict=True) if not c))
            at += len(block)
        out.append((" ".join(kept), int(again.sum())))
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", run: int = 8, chunk_pages: int = CHUNK_PAGES, chunk_bytes: int = CHUNK_BYTES, cut_articles: bool = False) -> DataFrame:
    """key, url, text, n_chars, n_repeated of each page; n_repeated are the tokens of its blocks that repeats of other pages of the host cover."""
    src = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = dict(src.dtypes)["k"]

    def hosts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(host_of(x)) - (1 << 63) for x in b.column("url").to_pylist()], pa.int64()), *b.columns], names=["host", *b.schema.names])

    # A row for each host with more than a chunk: at most as many as there are chunks.
    sized = src.select("url", F.octet_length("html").cast("long").alias("size")).mapInArrow(tidy(hosts), "host long, url string, size long").groupBy("host").agg(F.count("*").alias("m"), F.sum("size").alias("size"))
    large = cut(sized.select("host", F.greatest(F.ceil(F.col("m") / chunk_pages), F.least(F.ceil(F.col("size") / chunk_bytes), F.col("m"))).cast("long").alias("chunks")).where("chunks > 1"))

    def read(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                parsed = [all_blocks(x) for x in part.column("html").to_pylist()]
                columns = [
                    pa.array([press.compress("\n".join(x[0]).encode("utf-8", "surrogatepass")) for x in parsed], pa.binary()),
                    pa.array([np.array(x[1], np.int8).tobytes() for x in parsed], pa.binary()), pa.array([x[2] for x in parsed], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("chunk", "host", "chunks", "k", "url")), *columns], names=["chunk", "host", "chunks", "k", "url", "z", "kinds", "found"])

    def unpacked(rows):
        press = zstandard.ZstdDecompressor()
        texts = [(press.decompress(z).decode("utf-8", "surrogatepass"), np.frombuffer(kinds, np.int8).tolist(), found) for z, kinds, found in rows]
        return [(text.split("\n") if text else [], kinds, found) for text, kinds, found in texts]

    def stretches(batches, keys=1):
        """(key, rows) of batches that are sorted by their first columns; a key may come in several."""
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(keys)])
            ends = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in itertools.pairwise(ends):
                yield tuple(key[:, lo].tolist()), b.slice(lo, hi - lo)

    def gathered(batches, keys=1):
        """(key, rows) of batches that are sorted by their first columns, all rows of a key together."""
        now, rows = None, []
        for key, part in stretches(batches, keys):
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.extend(zip(*(part.column(i).to_pylist() for i in range(keys, part.num_columns)), strict=True))
        if rows:
            yield now, rows

    def of_host(chunks):
        """Ranges of windows, each with as many as two chunks have."""
        return -(-chunks // 2)

    def tell(batches):
        """The first bits of each chunk's windows."""
        for (chunk,), rows in gathered(batches):
            host, chunks = rows[0][:2]
            bits = first_bits(chunks)
            told = ascending(first(Streams(*tokens(unpacked([r[2:] for r in rows]))).windows(run)[1], bits))
            parts = ranges(told, bits, of_host(chunks))
            yield pa.RecordBatch.from_arrays([
                pa.array([host] * len(parts), pa.int64()), pa.array([p for p, _, _ in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([pack_ascending(told[lo:hi]) for _, lo, hi in parts], pa.binary()),
            ], names=["host", "part", "chunk", "told"])

    def meet(batches):
        """For each chunk those first bits that others of its host tell too."""
        for _, rows in gathered(batches, 2):
            found = [(chunk, pack_ascending(x)) for (chunk, _), x in zip(rows, shared([told for _, told in rows]), strict=True) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["chunk", "known"])

    def tell_all(batches):
        """Of the windows with these first bits all bits, and the texts that hold them."""
        for (chunk,), rows in gathered(batches):
            among = [unpack_ascending(r[0]) for r in rows if r[0] is not None]
            rows = [r[1:] for r in rows if r[0] is None]
            if not among:
                continue
            host, chunks = rows[0][:2]
            w, *texts = held(*tokens(unpacked([r[2:] for r in rows])), run, first_bits(chunks), np.sort(np.concatenate(among)))
            texts = texts if cut_articles else texts[:2]
            parts = ranges(w, 64, of_host(chunks))
            packed = [pack_texts([x[lo:hi] for x in texts]) for _, lo, hi in parts]
            yield pa.RecordBatch.from_arrays([
                pa.array([host] * len(parts), pa.int64()), pa.array([p for p, _, _ in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([pack_ascending(w[lo:hi]) for _, lo, hi in parts], pa.binary()),
                pa.array([x for x, _ in packed], pa.binary()), pa.array([x for _, x in packed], pa.binary()),
            ], names=["host", "part", "chunk", "told", "texts", "places"])

    def meet_all(batches):
        for _, rows in gathered(batches, 2):
            found = [(r[0], pack_ascending(w), pack(ends.reshape(-1)) if len(ends) else None) for r, (w, ends) in zip(rows, elsewhere([r[1:] for r in rows]), strict=True) if len(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), *(pa.array([r[i] for r in found], pa.binary()) for i in (1, 2))], names=["chunk", "known", "ends"])

    def by(df, *keys):
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def dealt_out(rows):
        rows = rows.withColumn("chunk", F.xxhash64("host", F.pmod(F.xxhash64("url", "html"), F.col("chunks"))))
        return rows.mapInArrow(tidy(read), f"chunk long, host long, chunks long, k {kind}, url string, z binary, kinds binary, found boolean")

    page, known = ["chunk", "k", "url", "z", "kinds", "found"], ["known", "ends"]
    rows = src.mapInArrow(tidy(hosts), f"host long, k {kind}, url string, html string")
    n_large = large.count()
    if n_large:
        rows = rows.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "host", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
        # A round reads the pages of large hosts anew, and what it sends is gone from the disk before the next one begins: blocks that were kept
        # for all rounds would take as much disk again as the shuffle of a round.
        parts = dealt_out(rows.where("chunks > 1")).select("chunk", "host", "chunks", "z", "kinds", "found")
        told = by(parts, "chunk").mapInArrow(tidy(tell), "host long, part long, chunk long, told binary")
        met = cut(by(told, "host", "part").mapInArrow(tidy(meet), "chunk long, known binary"))
        # What a chunk has learned stands before its pages.
        told = met.unionByName(parts, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("known").isNull())
        told = told.mapInArrow(tidy(tell_all), "host long, part long, chunk long, told binary, texts binary, places binary")
        met = cut(by(told, "host", "part").mapInArrow(tidy(meet_all), "chunk long, known binary, ends binary"))
        dealt = dealt_out(rows).select(*page).unionByName(met, allowMissingColumns=True)
    else:
        dealt = dealt_out(rows.withColumn("chunks", F.lit(1).cast("long"))).select(*page, *[F.lit(None).cast("binary").alias(c) for c in known])
    dealt = dealt.select(*page, *known).repartition("chunk").sortWithinPartitions("chunk", F.col("known").isNull())

    def settled(batches):
        now, rows, others = None, [], []

        def done():
            joined = [np.concatenate(x, axis=-1) for x in zip(*others, strict=True)] if others else None
            texts = main_texts(unpacked([r[2:] for r in rows]), run, cut_articles, joined)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], key_type), pa.array([r[1] for r in rows], pa.string()), pa.array([t for t, _ in texts], pa.string()), pa.array([n for _, n in texts], pa.int64())], names=["k", "url", "text", "n_repeated"])

        for (chunk,), part in stretches(batches):
            key_type = part.schema.field("k").type
            if rows and chunk != now:
                yield done()
                rows, others = [], []
            now = chunk
            n = part.num_rows - part.column("known").null_count
            for w, ends in zip(*(part.column(c).slice(0, n).to_pylist() for c in known), strict=True):
                others.append([unpack_ascending(w), *(unpack(ends, np.int64).reshape(2, -1) if ends else ())])
            rows.extend(zip(*(part.column(c).slice(n).to_pylist() for c in page[1:]), strict=True))
        if rows:
            yield done()

    out = dealt.mapInArrow(tidy(settled), f"k {kind}, url string, text string, n_repeated long")
    return out.select(F.col("k").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
