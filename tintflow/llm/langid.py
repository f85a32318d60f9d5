"""Language identification by cross-parsing.

For each language a suffix automaton holds labelled text. A text is parsed greedily against each automaton: a phrase is the longest match
that starts where the last one ended. Phrases grow with the logarithm of the text that an automaton holds, so a language's number of phrases
is weighed by it: phrases x log2(symbols held) / symbols parsed estimates the cross-entropy in bits, and the language of the fewest
normalised phrases wins (ties: the one with more labelled rows, then the first in name order). A text is parsed in pieces of `piece`
symbols, all pieces and languages side by side, so that the work is a few numpy steps whatever the lengths are; a phrase ends with its piece.
Case is folded, and a run of bytes that are no letters counts as one space. The automata are built once, in the driver, and broadcast; what
they hold is bounded (`most_chars` a language, `all_chars` together), and so is their table.

Defined results: a null text, and one without a letter, gives `und` and score 0; so does every text where nothing is labelled. A text
whose letters no language has seen gives the first language and score 0. Repeated rows are each predicted, very long texts as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, tidy
from .textkit import byte_chunks

#: Classes of bytes: 0 is anything but a letter, 1..26 are a..z, the rest are the bytes of other characters.
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = CLASS[65:91] = np.arange(1, 27)
CLASS[128:256] = np.arange(27, 155)


def fold_case(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with runs of 0 within a text made one; and the texts' offsets in them."""
    s = CLASS[buf]
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[starts] = True
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return s[keep], at[offsets]


def suffix_automaton(s: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of s."""
    step: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in s:
        new = len(step)
        step.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class CrossParser:
    """The automata of all languages in one table of transitions: row = state, column = class; -1 where there is none."""

    def __init__(self, samples: dict[str, list[str]], least: int = 2):
        """The order of the samples decides ties. A phrase is weighed as one of `least` symbols at least."""
        self.langs = list(samples)
        used: set[int] = {0}
        texts = []
        for lang in self.langs:
            parts = [symbols(b := np.frombuffer(fold_case(t), np.uint8), np.array([0, len(b)]))[0] for t in samples[lang]]
            texts.append(bytes(np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint8)) if parts else b"\0")
            used |= set(texts[-1])
        self.column = np.zeros(256, np.int32)  # 0: a class that no language has seen
        for i, c in enumerate(sorted(used)):
            self.column[c] = i + 1
        width = len(used) + 1
        tables, self.root, base = [], [], 0
        for t in texts:
            step = suffix_automaton(t)
            table = np.full((len(step), width), -1, np.int32)
            for i, row in enumerate(step):
                for c, j in row.items():
                    table[i, self.column[c]] = j + base
            tables.append(table)
            self.root.append(base)
            base += len(step)
        self.width = width
        self.weight = np.log2([max(least, len(t)) for t in texts]) if texts else np.zeros(0)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, s: np.ndarray, offsets: np.ndarray, piece: int = 512) -> np.ndarray:
        """Number of phrases, by text and language."""
        docs, langs = len(offsets) - 1, len(self.langs)
        lengths = np.diff(offsets)
        pieces = -(-lengths // piece)
        doc = np.repeat(np.arange(docs), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[doc] + nth * piece
        size = np.minimum(piece, offsets[doc + 1] - start)
        order = np.argsort(-size, kind="stable")
        doc, start, size = doc[order], start[order], size[order]
        cols = self.column[s]
        roots = np.array(self.root, np.int32)[:, None]
        state = np.repeat(roots, len(doc), axis=1)
        count = np.zeros((langs, len(doc)), np.int32)
        fresh = np.ones((langs, len(doc)), bool)  # at the start of a phrase
        going = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), "right")
        for k, n in enumerate(going):
            c = cols[start[:n] + k]
            now = state[:, :n]
            to = self.table[now * self.width + c]
            stop = to < 0
            # A match that cannot go on ends its phrase, and the next one starts with this symbol.
            again = self.table[roots * self.width + c]
            ended = stop & ~fresh[:, :n]
            count[:, :n] += ended
            lone = stop & (again < 0)  # a symbol that the language lacks is a phrase
            count[:, :n] += lone
            to = np.where(stop, np.where(lone, roots, again), to)
            state[:, :n] = to
            fresh[:, :n] = lone
        count += ~fresh
        out = np.zeros((docs, langs), np.int64)
        for j in range(langs):
            out[:, j] = np.bincount(doc, count[j], docs)
        return out


def sample(docs: DataFrame, learn: Column, key: str, text: str, lang: str, most_chars: int, per_lang: int, all_chars: int = 200_000) -> dict[str, list[str]]:
    """Labelled texts, per_lang at most of each language, chosen by a hash of the key. Only keys are ranked. Texts of 200 to 3,999 characters go
    first, then any that are not empty, so that each language with a labelled text has a sample; a language gets most_chars at most, or an
    equal share of all_chars where there are many languages, and a text gives a quarter of that at most."""
    from pyspark.sql import Window

    able = docs.where(learn & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    able = able.withColumn("odd", ~F.length("t").between(200, 3_999))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("odd", F.xxhash64("k"), "k"))
    chosen = able.select("k", "l", "odd").withColumn("rank", rank).where(F.col("rank") <= per_lang).collect()  # per_lang rows for each language
    place = {}
    for r in chosen:
        at = (r["l"], r["k"], r["odd"])
        place[at] = min(r["rank"], place.get(at, r["rank"]))
    keys = sorted({k for _, k, _ in place if k is not None})
    rows = able.where(F.col("k").isin(keys)).withColumn("t", F.substring("t", 1, most_chars)).collect() if keys else []
    ranked = sorted((r["l"], place[at], r["t"]) for r in rows if (at := (r["l"], r["k"], r["odd"])) in place)
    rows_of = {r["l"]: r["count"] for r in docs.where(learn & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).count().collect()}
    out: dict[str, list[str]] = {x: [] for x in sorted({r[0] for r in ranked}, key=lambda x: (-rows_of.get(x, 0), x))}
    share = max(1, min(most_chars, all_chars // max(1, len(out))))
    for lang_, _, t in ranked:
        have, t = out[lang_], t[: -(-share // 4)]
        if t not in have and (not have or sum(map(len, have)) + len(t) <= share):  # copies teach nothing
            have.append(t)
    return out


def common_words(docs: DataFrame, learn: Column, text: str, lang: str, most_chars: int, all_chars: int = 200_000) -> dict[str, list[str]]:
    """The words of each language that most of its labelled rows hold, counted over all of them, up to most_chars characters (or an equal share of
    all_chars). A word is a run of letters, or of bytes that are no ASCII; of equal counts the first word by its code points comes first. The order
    of languages is that of `sample`. Ranked by running sums, so that no more than the chosen words reach the driver."""
    from pyspark.sql import Window

    able = docs.where(learn & F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    rows_of = {r["l"]: r["count"] for r in able.groupBy("l").count().collect()}
    every = {r["l"]: r["count"] for r in docs.where(learn & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("l")).count().collect()}
    share = max(1, min(most_chars, all_chars // max(1, len(rows_of))))
    said = able.select("l", F.explode(F.array_distinct(F.split(F.lower("t"), r"[\x00-\x60\x7B-\x7F]+"))).alias("w")).where("w <> ''")
    counted = said.groupBy("l", "w").count()
    # A word takes two characters at least with the space after it, so that more words than half the share are never wanted.
    # The best of 64 parts of a language's words are ranked first, so that no task sorts them all.
    best = counted.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(64)))
    for group in (("l", "part"), ("l",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("count").desc(), "w"))).where(F.col("rank") <= share // 2 + 1)
    held = best.withColumn("before", F.sum(F.length("w") + 1).over(Window.partitionBy("l").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)))
    out: dict[str, list[str]] = {x: [] for x in sorted(rows_of, key=lambda x: (-every.get(x, 0), x))}
    for r in held.where(F.coalesce("before", F.lit(0)) < share).select("l", "rank", F.substring("w", 1, share).alias("w")).orderBy("l", "rank").collect():
        out[r["l"]].append(r["w"])
    return {x: [" ".join(words)] for x, words in out.items()}


def identify(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most_chars: int = 24_000, per_lang: int = 48, keep: tuple[str, ...] = (), with_text: bool = False, texts: dict[str, list[str]] | None = None, least: int = 2) -> DataFrame:
    """key, lang_pred, score, bits of each row (and the columns `keep`, and the text as `_text`). The language is learned from rows where `learn` holds, from at most
    `most_chars` characters each, or from the samples `texts`. The score is the share of normalised phrases that the best language needs less than the
    second; bits is the cross-entropy that its phrases estimate, in bits a symbol."""
    texts = sample(docs, learn, key, text, lang, most_chars, per_lang) if texts is None else texts
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(texts, least))

    def rows(batches):
        parser = shared.value
        names = np.array([*parser.langs, "und"], object)
        for b in batches:
            pred, score, bits = [np.zeros(0, object)], [np.zeros(0)], [np.zeros(0)]
            texts_ = b.column(0)
            low = pa.compute.utf8_lower(texts_.fill_null(""))
            for lo, hi, buf, offsets in byte_chunks(low):
                s, at = symbols(buf, offsets)
                lettered = _has_letter(texts_, lo, buf, offsets, s, at)
                n = hi - lo
                if not parser.langs:
                    pred.append(np.full(n, "und", object)), score.append(np.zeros(n)), bits.append(np.zeros(n))
                    continue
                need = parser.phrases(s, at) * parser.weight
                best = np.argmin(need, axis=1)
                bits.append(np.maximum(need - parser.weight, 0).min(axis=1) / np.maximum(np.diff(at), 1))  # but for the phrase that the text's end cuts
                if len(parser.langs) > 1:
                    two = np.partition(need, 1, axis=1)[:, :2]
                    sure = 1 - two[:, 0] / np.maximum(two[:, 1], 1)
                else:
                    sure = np.ones(n)
                pred.append(names[np.where(lettered, best, len(parser.langs))])
                score.append(np.where(lettered, sure, 0.0))
            out = [pa.array(np.concatenate(pred), pa.string()), pa.array(np.clip(np.concatenate(score), 0, 1), pa.float64()), pa.array(np.concatenate(bits), pa.float64())]
            first = 0 if with_text else 1
            yield pa.RecordBatch.from_arrays([*b.columns[first:], *out], names=[*b.schema.names[first:], "lang_pred", "score", "bits"])

    rest = [c for c in dict.fromkeys([key, *keep]) if c != text]
    src = docs.select(F.col(text).alias("_text"), *rest)
    kinds = dict(src.dtypes)
    return src.mapInArrow(tidy(rows), ", ".join([*(f"`{c}` {kinds[c]}" for c in (src.columns if with_text else rest)), "lang_pred string, score double, bits double"]))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_chars: int = 24_000, most_bits: float = 8.0) -> DataFrame:
    """The rows whose language is found, with the same columns. Rows without a letter go, and rows that the best language does not explain: those
    that take more than `most_bits` bits a symbol. Learned from all rows with a key and a language, by the words that most of them hold; where there are none, the rows with a letter stay. Columns of any names are kept as they are."""
    plain, back = numbered(docs, {key: "k", text: "t", lang: "l"})
    learn = F.col("k").isNotNull()
    texts = common_words(plain, learn, "t", "l", most_chars)
    if not texts:
        return back(plain.where(r"t RLIKE '\\p{L}'"))
    # Words that are told once are fewer symbols than text is: a phrase costs what it costs in a full automaton.
    least = max(2, min(most_chars, 200_000 // len(texts)))
    named = identify(plain, learn, "k", "t", "l", keep=tuple(c for c in plain.columns if c not in ("k", "t")), with_text=True, texts=texts, least=least)
    return back(named.where((F.col("lang_pred") != "und") & (F.col("bits") <= most_bits)).withColumnRenamed("_text", "t"))


def _has_letter(texts: pa.Array, lo: int, buf: np.ndarray, offsets: np.ndarray, s: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letters = np.zeros(len(s) + 1, np.int64)
    np.cumsum((s > 0) & (s < 27), out=ascii_letters[1:])
    some = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~some & (at[1:] > at[:-1])):
        t = texts[lo + int(i)].as_py() or ""
        some[i] = any(c.isalpha() for c in t)
    return some
