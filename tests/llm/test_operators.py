"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and repeated rows, and on empty ones."""

import hashlib
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintflow.llm import decontam, fingerprints, html_text, jaccard_join, langid, licenses, lm_scoring, packing, quality, suffix_dedup
from tintflow.llm.common import in_fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def words(rng, n, size=400):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, repeats within a text, and odd ones."""
    rng = np.random.default_rng(1)
    base = [words(rng, int(n)) for n in rng.integers(5, 160, 24)]
    out = list(base)
    for t in base[:6]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out += [t, " ".join(w), " ".join(w + ["more"])]
    passage = words(rng, 80)
    out += [f"{words(rng, 30)} {passage} {words(rng, 20)}" for _ in range(5)]
    out += [None, "", "   ", "one", "One", "two words", "ab " * 150, "ab " * 150 + "c", "é" * 260, "ÀÉ ß İstanbul", "x" * 199, "y" * 400, words(rng, 9000)]
    return out


# --- fingerprints


def test_fingerprints(spark, corpus):
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs_of(spark, corpus, k=1, t="clash", fingerprint=2), rows_each=7).collect()}
    texts = [t or "" for t in corpus]
    seen = {}
    for i, t in enumerate(texts):
        after = texts[i - 1]  # descending, and from the last back to the first
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(fingerprints.canonical(t) == fingerprints.canonical(edited))
        assert r["near_next"] == float(fingerprints.canonical(t) == fingerprints.canonical(after))
        for text, f in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert seen.setdefault(fingerprints.canonical(text), f) == f
    assert len(set(seen.values())) == len(seen)


def test_canonical_forms_by_hand(spark):
    """Texts of a line are one document in canonical form; no two lines are."""
    classes = [
        ["ABC d", "abc d", "ＡＢＣ　ｄ", " abc\u00a0d ", "abc\t\r\nd", "ᴬbc D".replace("ᴬ", "a")], ["Straße", "STRASSE", "strasse", "straſse"], ["caf\u00e9", "cafe\u0301", "CAF\u00c9"], ["cafe"], ["ﬁne", "fine"],
        ["①²", "12"], ["", None, "  \n", "\u3000"], ["Σας", "σασ", "ΣΑΣ"], ["abcd"], ["a bc d"], ["x" * 5000 + " Y", "X" * 5000 + "\ny"], ["İ", "i\u0307"], ["ı"],
    ]
    texts = [t for c in classes for t in c]
    of = [i for i, c in enumerate(classes) for _ in c]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs_of(spark, texts)).collect()}
    assert all((got[i] == got[j]) == (of[i] == of[j]) for i in range(len(texts)) for j in range(i))


def test_fingerprints_when_digests_collide(spark, corpus):
    short = lambda canon: hashlib.md5(canon).hexdigest()[:1]
    got = fingerprints.fingerprint(docs_of(spark, corpus), digest=short).collect()
    seen = defaultdict(set)
    for r in got:
        seen[r["fingerprint"]].add(fingerprints.canonical(corpus[r["doc_id"]] or ""))
    assert all(len(x) == 1 for x in seen.values())
    both = fingerprints.compare_edited(docs_of(spark, corpus), digest=short).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in both} == {r["doc_id"]: r["fingerprint"] for r in got}


def test_edited_texts_when_digests_collide(spark):
    """Texts of one fingerprint are equal in canonical form, documents and edited ones, under a digest of three values."""
    rng = np.random.default_rng(21)
    texts = [words(rng, int(n), 3) for n in rng.integers(1, 5, 30)] + ["", "x", "X"]
    rows = fingerprints.compare_edited(docs_of(spark, texts), digest=lambda b: str(len(b) % 3)).collect()
    prints, n = {}, len(texts)
    for r in rows:
        i = r["doc_id"]
        t, after = texts[i], texts[i - 1]
        half = len(t) // 2
        for text, f in ((t, r["fingerprint"]), (t[: len(t) - half] + after[:half], r["edited_fingerprint"])):
            assert prints.setdefault(fingerprints.canonical(text), f) == f
    assert len(rows) == n and len(set(prints.values())) == len(prints)


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.compare_edited(docs_of(spark, [])).count() == 0
    alone = fingerprints.compare_edited(docs_of(spark, ["abcd"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
    repeated = docs_of(spark, ["a b", "c"]).unionByName(docs_of(spark, ["A  B"]))
    rows = fingerprints.compare_edited(repeated).collect()
    assert len(rows) == 3 and len({r["fingerprint"] for r in rows if r["doc_id"] == 0}) == 1
    no_key = spark.createDataFrame([(None, "x", None, None, 1)], DOCS)
    assert fingerprints.compare_edited(no_key).count() == 1


# --- licenses


def test_license_scan(spark):
    texts = [
        "Released under the MIT License.", "mit\nlicense MIT-license mitt license", "Licensed under the Apache License, Version 2.0.\nmit license", "This work is licensed under the GNU General Public License, version 3.",
        None, "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "ñmit license", "plain words", "mit " * 3000 + "license", "general public apache license general public license",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts, h=1, label="clash")).collect()}
    assert [got[i]["n_base"] for i in range(len(texts))] == [1, 2, 2, 1, 0, 0, 0, 0, 0, 1, 2]
    assert [got[i]["base_labels"] for i in range(4)] == ["mit", "mit", "apache,mit", "gpl"]
    assert (got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (0, 2, 6)
    assert (got[9]["first_word"], got[9]["n_words"]) == (2999, 3001)
    assert (got[10]["first_word"], got[10]["last_word"], got[10]["base_labels"]) == (2, 4, "apache,gpl")
    assert got[8]["first_word"] is None and got[8]["score"] == 0 and got[4]["n_words"] == 0 and got[4]["labels"] == ""
    assert "mit" not in got[6]["base_labels"] and got[0]["score"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_license_scan_is_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = sorted({w for _, t in licenses.NOTICES for w in t.split()}) + ["filler", "other"]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(4):
            _, t = licenses.NOTICES[int(rng.integers(0, len(licenses.NOTICES)))]
            w = [x for x in t.split() if rng.random() < 0.85] + [vocabulary[int(i)] for i in rng.integers(0, len(vocabulary), 3)]
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        found, best = set(), 0.0
        for line in t.split("\n"):
            have = set(line.split())
            for label, body in licenses.NOTICES:
                body = set(body.split())
                if len(have & body) >= 0.8 * len(body) - 1e-9:
                    found.add(label)
                    best = max(best, len(have & body) / len(body))
        w = re.findall(r"[0-9a-z]+", t)
        for p, label in licenses.PHRASES.items():
            p = p.split()
            if any(w[j : j + len(p)] == p for j in range(len(w))):
                found.add(label)
                best = 1.0
        assert got[i]["labels"] == ",".join(sorted(found)) and abs(got[i]["score"] - best) < 1e-12


def test_license_scan_of_wrapped_notices(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    mpl = ["This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0."]
    texts = ["\n".join(bsd), "/*\n * " + "\n * ".join(["Head", "", *bsd, "", "Tail"]) + "\n */", "\r\n".join(f"# {x}" for x in mpl), "\n\n".join(bsd), "\n".join([*(["filler words"] * 9), *bsd[:1], *(["other words"] * 9), *bsd[1:]])]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["bsd", "bsd", "mpl", "", ""]
    assert got[0]["score"] == got[1]["score"] == 1 and abs(got[2]["score"] - 14 / 16) < 0.1 and got[3]["score"] == 0


def test_license_scan_is_its_sql_where_notices_are_wrapped(spark):
    import textwrap

    import duckdb
    import pyarrow as pa

    rng = np.random.default_rng(15)
    texts = []
    for i, (_, body) in enumerate(licenses.NOTICES):
        for width in (30, 72):
            mark = rng.choice(["# ", " * ", ""])
            said = body.split()
            said[int(rng.integers(0, len(said)))] = "changed"
            notice = "\n".join(mark + x for x in textwrap.wrap(" ".join(said if i % 2 else body.split()).capitalize(), width))
            texts.append(f"{words(rng, 12, 9)}\n{mark}\n{notice}\n\n{words(rng, 12, 9)}" if width == 30 else f"{words(rng, 5, 9)}\n{notice}\n{words(rng, 9, 9)}")
    texts += ["", None, "mit\nlicense", "the MIT\n\nlicense of the apache\nlicense"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())}))
    want = {r[0]: r[1:] for r in con.execute(licenses.oracle()).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert got == want and sum(bool(w[5]) for w in want.values()) >= 18


def test_license_scan_of_repeated_and_no_rows(spark):
    two = docs_of(spark, ["mit license mit license"]).unionByName(docs_of(spark, ["mit license mit license"]))
    assert [r["n_base"] for r in licenses.scan(two).collect()] == [2, 2]
    assert licenses.scan(docs_of(spark, [])).count() == 0
    assert licenses.scan(spark.createDataFrame([(None, "mit license", None, None, 1)], DOCS)).first()["n_base"] == 1


# --- n-gram Jaccard join


def linked(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_join(spark, corpus):
    rows = jaccard_join.link_sets(docs_of(spark, corpus, c=1, component_id=7, n="clash")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == linked(corpus)


@pytest.mark.parametrize(("cell", "group"), [(2_048, 200_000), (6, 200_000), (2_048, 2), (6, 2)])
def test_jaccard_join_near_the_threshold(spark, monkeypatch, cell, group):
    """Whole blocks, blocks in parts, and groups that are passed on as a stream."""
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = np.random.default_rng(9)
    base = words(rng, 90, 10_000).split()
    texts = [" ".join(base)]
    for i in range(70):
        w = list(base)
        for j in rng.integers(0, 90, 1 + i % 4):
            w[int(j)] = f"x{i}"
        texts.append(" ".join(w[: 90 - int(rng.integers(0, 12))]))
    got = jaccard_join.link_sets(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(texts)


@pytest.mark.parametrize("most", [40, 400])
def test_prefix_tree(most):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, most, most // 2)).astype(np.uint64) << np.uint64(50 + i % 3) for i in range(60)]
    sets += [np.sort(rng.choice(s, len(s) - 1 - i % 9, replace=False)) for i, s in enumerate(sets)]
    sets = [np.array(x, np.uint64) for x in sorted({tuple(s.tolist()) for s in sets})]
    full = [set(s.tolist()) for s in sets]
    tree, every = jaccard_join.PrefixTree(sets), np.arange(len(sets))
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    for i, s in enumerate(full):
        got = tree.linked(i, every[every != i], 75, 100)
        assert sorted(got.tolist()) == [j for j, t in enumerate(full) if j != i and link(s, t)]
    ids, root = jaccard_join.unite(list(range(len(sets))), [None] * len(sets), sets, 75, 100)
    top = {i: i for i in range(len(sets))} | dict(zip(ids.tolist(), root.tolist(), strict=True))
    for i, s in enumerate(full):
        assert all(top[i] == top[j] for j, t in enumerate(full) if link(s, t)) and top[top[i]] == top[i]


def test_partners_of_a_group():
    rng = np.random.default_rng(6)
    for _ in range(200):
        z = int(rng.integers(1, 12))
        n = np.sort(rng.integers(5, 40, z))
        pos = (rng.random(z) * (n - -(-n * 75 // 100) + 1)).astype(int)
        want = [any(i != j and 175 * min(n[i] - pos[i], n[j] - pos[j]) >= 75 * (n[i] + n[j]) for j in range(z)) for i in range(z)]
        assert jaccard_join.partners(n, pos, 75, 100).tolist() == want


def thue_morse(n):
    """Two texts of n letters that every polynomial hash modulo a power of two takes for one, where n is large enough."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return [one, one.translate(str.maketrans("ab", "ba"))]


def test_jaccard_join_of_words_that_polynomials_confuse(spark):
    texts = thue_morse(2048) + thue_morse(1024)
    rows = jaccard_join.link_sets(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i for i in range(4)}


def test_columns_of_any_names_are_kept(spark):
    """The stages of the pipeline put up with columns named like those that they add."""
    names = ["k", "k2", "u", "u2", "c", "t", "n", "comp", "component_id", "starts", "i", "h", "lang_pred", "score", "_text", "c0", "c1", "K9"]
    long = " ".join(f"w{i}" for i in range(90))
    docs = docs_of(spark, [long, long, "some other words that stand alone here", long + " and an end of its own " + " ".join(f"v{i}" for i in range(200)), "", None]).selectExpr("*", *[f"{i} AS `{x}`" for i, x in enumerate(names)])
    items = spark.createDataFrame([("x", "words that stand alone here")], "item_id string, text string")
    for stage in (langid.keep_identified, jaccard_join.keep_one, suffix_dedup.clean, lambda d: decontam.clean(d, items)):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[x] for x in names] == list(range(len(names)))


def test_jaccard_join_without_broadcasts(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", -1)
    rows = jaccard_join.link_sets(docs_of(spark, corpus)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == linked(corpus)


def test_jaccard_join_sends_no_sets_that_share_by_chance(spark, monkeypatch):
    """Texts that have some rare shingles in common, but link with nothing, are sent to no block; those that link at the threshold are."""
    own = [[f"w{i}x{j}" for j in range(300)] for i in range(60)]
    for i in range(59):
        for p in range(20 + 15 * (i % 2), 290, 30):  # 9 shingles of the text before, and 9 of the one after
            own[i + 1][p : p + 5] = own[i][p : p + 5]
    near = [[f"n{i}x{j}" for j in range(304)] for i in range(4)]
    near += [[*w[:258], *(f"o{i}x{j}" for j in range(46))] for i, w in enumerate(near)]  # 254 of 346 shingles: no link
    near += [[*w[:262], *(f"p{i}x{j}" for j in range(42))] for i, w in enumerate(near[:4])]  # 258 of 342 shingles: a link
    sent = []
    join = jaccard_join._joined
    monkeypatch.setattr(jaccard_join, "_joined", lambda cells, *rest: (sent.append(cells.select("c").distinct().count()), join(cells, *rest))[1])
    texts = [" ".join(w) for w in own + near]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_sets(docs_of(spark, texts), sample_docs=0, sample_share=0.0).collect()}
    assert got == linked(texts) and [got[60 + i][1] == got[68 + i][1] for i in range(4)] == [True] * 4
    assert sent[0] <= len(near)


def test_cut_leaves_no_shuffled_files(spark):
    from tintflow.lineage import cut

    def files():
        jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(jvm.apply(i).getName()) for i in range(jvm.size())}

    before = files()
    out = cut(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    assert not [f for f in files() - before if f.startswith("shuffle_")]
    assert sorted(map(tuple, out.collect())) == [(k, 100) for k in range(10)] and out.join(out, "k").count() == 10


def test_jaccard_join_of_odd_tables(spark):
    assert jaccard_join.link_sets(docs_of(spark, [])).count() == 0
    assert [r["component_id"] for r in jaccard_join.link_sets(docs_of(spark, ["", None, " "])).orderBy("doc_id").collect()] == [0, 1, 2]
    same = docs_of(spark, ["a b c d e f"]).unionByName(docs_of(spark, ["a b c d e f", "A B c d e f"]))
    assert {r["component_id"] for r in jaccard_join.link_sets(same).collect()} == {0}
    kept = jaccard_join.keep_one(same)
    assert kept.count() == 1 and kept.columns == same.columns
    no_key = spark.createDataFrame([(None, "a b c d e f", None, None, 1), (3, "a b c d e f", None, None, 1)], DOCS)
    assert {r["component_id"] for r in jaccard_join.link_sets(no_key).collect()} == {3}


def test_jaccard_join_through_a_row_without_a_key(spark):
    base = [f"w{i}" for i in range(200)]
    change = lambda t, at: " ".join("new" if i in at else w for i, w in enumerate(t))
    middle = change(base, set())
    one, two = change(base, {10, 30, 50, 70}), change(base, {110, 130, 150, 170})
    rows = [(1, one, "en", "s", 1), (None, middle, "en", "s", 1), (None, middle, "en", "s", 1), (3, two, "en", "s", 1)]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.link_sets(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == [(1, 1), (3, 1), (None, 1), (None, 1)]


# --- suffix-array dedup


def without_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_suffix_dedup(spark, corpus):
    want = without_repeats(corpus)
    rows = suffix_dedup.dedup(docs_of(spark, corpus, u=1, t="clash", n_removed=3)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: w[:4] for i, w in enumerate(want)}
    df = docs_of(spark, corpus, u=1, t="clash")
    cleaned = suffix_dedup.clean(df)
    assert cleaned.columns == df.columns
    assert {r["doc_id"]: r["text"] or "" for r in cleaned.collect()} == {i: w[4].decode("utf-8", "ignore") for i, w in enumerate(want)}
    assert all(r["n_chars"] == len(r["text"] or "") for r in cleaned.collect())


def test_suffix_dedup_of_texts_that_polynomials_confuse(spark):
    texts = thue_morse(2048)
    docs = docs_of(spark, texts).coalesce(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
    assert got == {i: w[:4] for i, w in enumerate(without_repeats(texts))} and got[0][1] == got[1][1] == 2048


def test_suffix_dedup_draws_marks_anew(spark, corpus):
    """Where two texts share a mark, another is drawn."""
    src = docs_of(spark, corpus).selectExpr("doc_id AS k", "cast(coalesce(text, '') AS binary) AS t")
    tried = []

    def marks(seed):
        tried.append(seed)
        return F.xxhash64(F.lit(seed), "k", "t") if seed else F.lit(7).cast("long")

    rows, _, _ = suffix_dedup.spans(src, 200, marks)
    assert max(tried) == 1 and rows.select("u").distinct().count() == len(corpus)


def test_suffix_dedup_at_the_edge(spark):
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, p = letters(199), letters(200), letters(150)
    texts = [letters(30) + a + letters(30), letters(10) + a, letters(30) + b + letters(9), b, p * 4, letters(77) + p + letters(80), p[75:] + p[:75] * 2, "z" * 201, "z" * 200, letters(400)]
    rows = suffix_dedup.dedup(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: w[:4] for i, w in enumerate(without_repeats(texts))}


def test_suffix_dedup_of_odd_tables(spark, corpus, monkeypatch):
    assert suffix_dedup.dedup(docs_of(spark, [])).count() == 0
    assert suffix_dedup.clean(docs_of(spark, [])).count() == 0
    twice = docs_of(spark, ["q" * 300 + "r"]).unionByName(docs_of(spark, ["q" * 300 + "r"]))
    assert [(r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(twice).collect()] == [(301, 1)] * 2
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", -1)
    rows = suffix_dedup.dedup(docs_of(spark, corpus)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: w[:4] for i, w in enumerate(without_repeats(corpus))}


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 99, 300).astype(np.uint8)) * 5 + b"b" * 400 + bytes(rng.integers(97, 99, 900).astype(np.uint8))
    start = np.arange(len(text) - 260)
    order, group = suffix_dedup.Block(text).sorted(start)
    got = [text[i : i + 256] for i in start[order]]
    assert got == sorted(got)
    assert all(text[i : i + 64] == text[j : j + 64] for i, j, g, h in zip(start[order], start[order][1:], group, group[1:], strict=False) if g == h)
    count = Counter(text[i : i + 200] for i in start)
    assert suffix_dedup.Block(text).repeated(start, 200).tolist() == [count[text[i : i + 200]] > 1 for i in start]


def test_cover_reaches_every_pair():
    inside, step = suffix_dedup.cover()
    assert (step >= 0).all() and all(inside[(a + step[a, b]) % 64] and inside[(b + step[a, b]) % 64] for a in range(64) for b in range(64))


# --- decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    items = [words(rng, 40, 5000), words(rng, 12, 5000), "short item", words(rng, 5, 5000), None, "", "Solo"]
    long = words(rng, 5000, 90_000)
    near = items[0].split()
    near[20] = "changed"
    far = items[0].split()
    far[10] = far[20] = far[30] = "changed"
    texts = [f"{long} {items[0].upper()}! {long}", f"a, {items[1]}", "a SHORT -- item here", " ".join(near), " ".join(far), None, "", long, items[3], "so solo, so", items[0] + "\n" + items[1]]
    docs, bench = docs_of(spark, texts, item_id=5, i=1, h="clash"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def shingle(t, n):
        w = [x for x in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)

    want = set()
    for j, item in enumerate(items):
        n = min(5, shingle(item, 1)[1])
        if n:
            have = shingle(item, n)[0]
            want |= {(i, j, len(have), len(have & shingle(t, n)[0])) for i, t in enumerate(texts) if len(have & shingle(t, n)[0]) >= 0.75 * len(have)}
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_found"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == want and {(0, 0), (1, 1), (2, 2), (3, 0), (8, 3), (9, 6)} <= {x[:2] for x in got} and (4, 0) not in {x[:2] for x in got}
    cleaned = decontam.clean(docs, bench)
    assert cleaned.columns == docs.columns and {r["doc_id"] for r in cleaned.collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_decontamination_of_odd_tables(spark, monkeypatch):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs_of(spark, ["a b"]), none).count() == 0
    assert decontam.clean(docs_of(spark, ["a b"]), none).count() == 1
    one = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(docs_of(spark, []), one).count() == 0
    twice = docs_of(spark, ["x a b c d e f"]).unionByName(docs_of(spark, ["x a b c d e f"]))
    assert decontam.contaminated(twice, one).count() == 1
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert decontam.contaminated(twice, one).first()["n_found"] == 2
    no_key = spark.createDataFrame([(None, "x a b c d e f", None, None, 1)], DOCS)
    assert decontam.clean(no_key, one).count() == 1


# --- packing


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, n = packing.best_fit([6, 5, 4, 3, 0], [None] * 5, [None] * 5, 10, 1)
    assert (bins, offsets, n) == ([0, 1, 0, 1, 0], [0, 0, 6, 5, 10], 2)
    # The tightest bin holds the cluster, so the next one takes the piece; then the source is full in both.
    assert packing.best_fit([6, 5, 4], ["a", "b", "a"], [None] * 3, 10, 1)[0] == [0, 1, 1]
    assert packing.best_fit([6, 5, 4], [None] * 3, ["s", "s", "s"], 10, 1)[0] == [0, 1, 2]
    assert packing.best_fit([6, 5, 4], [None] * 3, ["s", "s", "s"], 10, 2)[0] == [0, 1, 0]


def test_best_fit_is_brute_force():
    rng = np.random.default_rng(7)
    sizes = sorted(map(int, rng.integers(1, 40, 300)), reverse=True)
    clusters, sources = [int(x) for x in rng.integers(0, 90, 300)], [int(x) if x else None for x in rng.integers(0, 9, 300)]
    left, held, taken, want = [], [], [], []
    for n, c, s in zip(sizes, clusters, sources, strict=True):
        able = [(left[b], b) for b in range(len(left)) if left[b] >= n and c not in held[b] and (s is None or taken[b][s] < 2)]
        b = min(able)[1] if able else len(left)
        if not able:
            left.append(64), held.append(set()), taken.append(Counter())
        left[b] -= n
        held[b].add(c)
        taken[b][s] += 1
        want.append(b)
    assert packing.best_fit(sizes, clusters, sources, 64, 2)[0] == want


def test_packing_is_whole(spark, corpus):
    df = docs_of(spark, corpus, k=1, piece="clash").unionByName(docs_of(spark, corpus[:3], k=1, piece="clash"))
    rows = packing.pack(df, capacity=100, shard_rows=16).collect()
    tokens = defaultdict(list)
    for r in rows:
        tokens[r["doc_id"]].append((r["start"], r["n_tokens"], r["n_pieces"]))
    for i, t in enumerate(corpus):
        copies = 2 if i < 3 else 1
        n = len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
        assert sum(x[1] for x in tokens[i]) == n * copies
        assert sorted(x[0] for x in tokens[i]) == sorted(list(range(0, max(n, 1), 100)) * copies)
        assert all(x[2] == max(1, -(-n // 100)) for x in tokens[i])
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        spans = sorted((r["bin_offset"], r["n_tokens"]) for r in held)
        assert all(a[0] + a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][0] + spans[-1][1] <= 100
        assert max(Counter(r["source"] for r in held if r["n_tokens"] < 100).values(), default=0) <= 2
        texts = [" ".join((corpus[r["doc_id"]] or "").lower().split()) for r in held if r["n_tokens"] and r["n_pieces"] == 1]
        assert len(set(texts)) == len(texts)
    assert packing.pack(docs_of(spark, [])).count() == 0
    assert packing.pack(spark.createDataFrame([(None, "a", None, None, 1)] * 2, DOCS)).select("bin_id").distinct().count() == 2


# --- LM scoring


def test_lm_scoring(spark):
    rng = np.random.default_rng(5)
    good, bad = [words(rng, 60, 50) for _ in range(40)], [" ".join(f"v{int(x)}" for x in rng.integers(0, 50, 60)) for _ in range(40)]
    df = docs_of(spark, [*good, *bad, None, ""], k=1, t="clash")
    target = df.where("doc_id < 20").select("doc_id").unionByName(df.where("doc_id = 0").select("doc_id"))
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, target).collect()}
    assert max(got[i]["score"] for i in range(20, 40)) < min(got[i]["score"] for i in range(40, 80))
    assert got[80]["n_tokens"] == got[81]["n_tokens"] == 0 and got[80]["score"] == 0


def test_lm_scoring_is_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [words(rng, int(n), 30) for n in rng.integers(1, 50, 20)]
    marked = set(range(0, 20, 3))
    slots, w = 1 << 16, 0.6
    models = []
    for some in (marked, set(range(20))):
        uni, bi = Counter(), Counter()
        for i in some:
            t = texts[i].split()
            uni.update(t)
            bi.update(zip(t, t[1:], strict=False))
        models.append((uni, bi))
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.cross_entropy_difference(df, df.where(F.col("doc_id") % 3 == 0)).collect()}
    for i, t in enumerate(texts):
        t = t.split()
        loss = []
        for uni, bi in models:
            total = 0.0
            for j, x in enumerate(t):
                share = (uni[x] + 1) / (sum(uni.values()) + slots)
                p = share if j == 0 else w * (bi[t[j - 1], x] / max(1, uni[t[j - 1]])) + (1 - w) * share
                total -= np.log2(p)
            loss.append(total / len(t))
        assert abs(got[i] - (loss[0] - loss[1])) < 1e-4


def test_lm_scoring_counts_each_ngram(spark, monkeypatch):
    """More words than the least vocabulary, over many blocks: no n-gram takes another one's count."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 512, raising=False)
    rng = np.random.default_rng(9)
    texts = [words(rng, int(n), 300) for n in rng.integers(1, 60, 30)] + [None, "", " "]
    parts, w = [(t or "").split() for t in texts], 0.6
    vocabulary = len({x for t in parts for x in t})
    models = []
    for some in (range(0, 33, 3), range(33)):
        models.append((Counter(x for i in some for x in parts[i]), Counter(p for i in some for p in zip(parts[i], parts[i][1:], strict=False))))
    df = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, df.where(F.col("doc_id") % 3 == 0), slots=16).collect()}
    assert len(got) == 33 and vocabulary > 200
    for i, t in enumerate(parts):
        loss = []
        for uni, bi in models:
            share = {x: (uni[x] + 1) / (sum(uni.values()) + vocabulary) for x in t}
            p = [share[x] if j == 0 else w * bi[t[j - 1], x] / max(1, uni[t[j - 1]]) + (1 - w) * share[x] for j, x in enumerate(t)]
            loss.append(-sum(map(np.log2, p)) / max(1, len(t)))
        assert got[i]["n_tokens"] == len(t) and abs(got[i]["score"] - (loss[0] - loss[1])) < 1e-9


def test_lm_scoring_of_odd_tables(spark):
    empty = docs_of(spark, [])
    assert lm_scoring.cross_entropy_difference(empty, empty).count() == 0
    assert lm_scoring.cross_entropy_difference(docs_of(spark, ["a b"]), empty).count() == 1
    twice = docs_of(spark, ["a b"]).unionByName(docs_of(spark, ["a b"]))
    assert len({r["score"] for r in lm_scoring.cross_entropy_difference(twice, twice).collect()}) == 1


# --- classifiers


def test_quality(spark):
    rng = np.random.default_rng(11)
    texts = [words(rng, 50) if i % 2 else "BUY!! " * 30 + words(rng, 5) for i in range(240)] + [None, "", "z" * 100_000]
    df = docs_of(spark, texts, score=1, k="clash")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    held = in_fold(F.col("doc_id"), 5, 0)
    rows = quality.score(df, labels, ~held, keep={"held_out": held}).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert len(out) > 20 and all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in out)
    again = quality.score(df.repartition(3), labels.repartition(2), ~held).collect()
    assert {r["doc_id"]: r["score"] for r in rows} == {r["doc_id"]: r["score"] for r in again}
    assert {r["score"] for r in quality.score(df, labels.limit(0), ~held).collect()} == {0.5}
    assert quality.score(docs_of(spark, []), labels, ~held).count() == 0


def test_quality_is_brute_force(spark, monkeypatch):
    """Scores are the mean over kinds of the mean weight of a text's features, feature by feature."""
    from tintflow.llm.textkit import WHITE, Words, mix

    buckets, orders, rng = 1 << 10, (2, 3), np.random.default_rng(13)
    weights = rng.normal(size=buckets).astype(np.float32)
    monkeypatch.setattr(quality, "train", lambda *a: (weights, 0.25))
    texts = [words(rng, int(n), 9) + " é中 Ä é中" * (n % 3) for n in rng.integers(1, 30, 40)] + ["", None, "x", "x x x", "é", "𝄞𝄞 𝄞"]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs_of(spark, texts), labels, F.lit(True), buckets=buckets, orders=orders).collect()}
    one = lambda w: int(Words(b := np.frombuffer(w.encode(), np.uint8), np.array([0, len(b)]), WHITE, None).hash[0])
    pair = [int(x) & (buckets - 1) for x in mix(np.array([1, 2], np.uint64))]
    for i, t in enumerate(texts):
        said, kinds = (t or "").split(), []
        kinds.append([one(w) & (buckets - 1) for w in said])
        kinds.append([pair[int(j > 0 and said[j] == said[j - 1])] for j in range(len(said))])
        value = [int.from_bytes(c.encode(), "little") for c in t or ""]
        for n in orders:
            kinds.append([])
            for j in range(len(value) - n + 1):
                h = value[j]
                for v in value[j + 1 : j + n]:
                    h = (h * 0x01000193 + v) % (1 << 32)
                h = (h ^ n) * 0x9E3779B1 % (1 << 32)
                kinds[-1].append((h ^ (h >> 15)) & (buckets - 1))
        means = [np.mean(weights[k]) for k in kinds if k]
        assert abs(got[i] - 1 / (1 + np.exp(-(np.mean(means) if means else 0) - 0.25))) < 1e-6


def test_quality_learns_from_bounded_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, *a: (seen.append(sum(map(len, texts))), (np.zeros(1 << 15, np.float32), 0.0))[1])
    docs = docs_of(spark, ["word " * 100] * 50 + [f"w{i} " * 100 for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    quality.score(docs, labels, F.lit(True), most_chars=5_000).collect()
    assert 0 < seen[0] <= 5_000


def test_labels_are_no_input_of_scores(spark):
    rng = np.random.default_rng(12)
    df = docs_of(spark, [words(rng, 30) for _ in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    held = in_fold(F.col("doc_id"), 5, 0)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.score(df, labels, ~held).collect()
    assert {r["doc_id"]: r["score"] for r in a} == {r["doc_id"]: r["score"] for r in quality.score(df, turned, ~held).collect()}


def test_suffix_automaton():
    s = b"abcbcabba"
    step = langid.suffix_automaton(s)

    def accepts(x):
        state = 0
        for c in x:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    subs = {s[i:j] for i in range(len(s)) for j in range(i, len(s) + 1)}
    assert all(accepts(x) for x in subs)
    assert not any(accepts(bytes(x)) for x in np.random.default_rng(0).integers(97, 100, (300, 4)).astype(np.uint8) if bytes(x) not in subs)


def test_cross_parsing_is_brute_force():
    rng = np.random.default_rng(1)
    samples = {"x": ["".join(map(chr, rng.integers(97, 101, 200)))], "y": ["".join(map(chr, rng.integers(99, 104, 200)))]}
    parser = langid.CrossParser(samples)
    texts = ["".join(map(chr, rng.integers(97, 106, int(n)))) for n in (1, 30, 70, 64, 0, 200)]
    raw = b"".join(t.encode() for t in texts)
    s, at = langid.symbols(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    got = parser.phrases(s, at, piece=64)
    for t, counts_ in zip(texts, got, strict=True):
        for lang, n in zip(parser.langs, counts_, strict=True):
            known, want = samples[lang][0], 0
            for piece in (t[i : i + 64] for i in range(0, len(t), 64)):
                i = 0
                while i < len(piece):
                    j = i + 1
                    while j < len(piece) and piece[i : j + 1] in known:
                        j += 1
                    want += 1
                    i = j
            assert n == want


def test_language_id(spark):
    rng = np.random.default_rng(2)
    en, fr = "the of and this that with from they which".split(), "le la des est avec pour qui dans être".split()
    texts = [" ".join((en if i % 2 else fr)[int(j)] for j in rng.integers(0, 9, 60)) for i in range(120)] + [None, "", "123 !!", "中文", "the and this", "q"]
    df = spark.createDataFrame([(i, t, ("en" if i % 2 else "fr") if i < 120 else None, "s", 1) for i, t in enumerate(texts)], DOCS).withColumn("score", F.lit(1)).withColumn("_text", F.lit("clash"))
    held = in_fold(F.col("doc_id"), 3, 1)
    rows = {r["doc_id"]: r for r in langid.identify(df, ~held).collect()}
    assert all(rows[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(120))
    assert [rows[i]["lang_pred"] for i in (120, 121, 122)] == ["und"] * 3 and rows[123]["lang_pred"] in ("en", "fr") and rows[124]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(126)) - {120, 121, 122, 123}  # 123 is in letters that no language has
    assert {r["text"] for r in kept.collect()} == {t for i, t in enumerate(texts) if i not in (120, 121, 122, 123)}
    assert {r["lang_pred"] for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), ~held).count() == 0


def test_languages_are_kept_by_words_of_all_rows(spark):
    """A language's words count wherever they stand: beyond the first 48 rows, in long rows and in the end of one."""
    en, fr = "the of and this that with from they which".split(), "ΑΒΓ ΔΕΖΗ ΘΙΚΛ ΜΝΞΟ ΠΡΣΤ".split()
    rows = [(i, " ".join(en[(i + j) % 9] for j in range(60)), "en", "s", 1) for i in range(200)]
    rows += [(200 + i, " ".join(en) * 500 + " " + " ".join(fr * 3), "en", "s", 1) for i in range(3)]
    rows += [(300, " ".join(fr * 20), None, "s", 1), (301, "ЖЗИ ЙКЛ МНО " * 20, None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"] for r in langid.keep_identified(df).collect()} == {r[0] for r in rows} - {301}
    words_ = langid.common_words(df, F.lit(True), "text", "lang", 24_000)["en"][0].split()
    assert set(words_) >= {*en, *(w.lower() for w in fr)} and set(words_[:8]) < set(en)


def test_language_id_of_ties_and_a_very_long_text(spark):
    """Of languages that need as many phrases the one with more labelled rows comes first, then the first by name; and a text is parsed to its end."""
    same = "abc def ghi " * 20
    rows = [(i, same, x, "s", 1) for i, x in enumerate(["zz", "zz", "aa", "bb"])] + [(4, "abc def", None, "s", 1)]
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, DOCS), F.lit(True)).collect()} == {"zz"}
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows[1:], DOCS), F.lit(True)).collect()} == {"aa"}
    one, two = "la le des est pour ", "der die das ist ein "
    long = one * 2_000 + two * 60_000  # what comes last decides
    rows = [(i, (one if i % 2 else two) * 30, "fr" if i % 2 else "de", "s", 1) for i in range(8)] + [(8, long, None, "s", 1)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, DOCS), F.lit(True)).collect()}
    assert got[8] == "de" and got[1] == "fr"


def test_html_of_a_very_long_page_and_equal_pages(spark):
    body = " ".join(f"w{i}" for i in range(120_000))
    menu = "<div>Home News Sport Weather Travel Money Shop Cars</div>"
    pages = [(0, "http://h.example/0", f"<article><p>{body}</article>"), (1, "http://h.example/1", f"{menu}<p>{body}</p>"), (2, "http://h.example/2", f"{menu}<p>own words of this page</p>")]
    pages += [(i, "http://h.example/same", f"{menu}<p>words that equal pages share, ten of them or more</p>") for i in (3, 4)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == (body, len(body)) and got[1][0] == "" and got[2][0] == "own words of this page"
    assert got[3] == got[4] and got[3][0] == "words that equal pages share, ten of them or more"


def test_lm_scoring_of_a_very_long_text(spark):
    rng = np.random.default_rng(19)
    texts = [words(rng, 300_000, 50), words(rng, 40, 50), "", None, words(rng, 40, 50)]
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs_of(spark, texts), spark.createDataFrame([(1,)], "doc_id long")).collect()}
    assert got[0]["n_tokens"] == 300_000 and got[2]["score"] == got[3]["score"] == 0 and got[1]["score"] < got[4]["score"]


def test_language_id_is_brute_force(spark):
    """Texts parsed phrase by phrase against the samples themselves, with the phrases weighed by what a language's sample holds."""
    rng = np.random.default_rng(5)
    said = {"en": "the of and this that with from they which".split(), "fr": "le la des est avec pour qui dans être".split(), "de": "der die und das nicht ein ist auf für".split()}
    langs = list(said)
    texts = [" ".join(said[langs[i % 3]][int(j)] for j in rng.integers(0, 9, 3 + i % 40)) for i in range(60)]
    texts += [" ".join(said[langs[int(j)]][int(k)] for j, k in rng.integers(0, 3, (30, 2))) for _ in range(30)] + ["", "x", "q! 7 the", None, "the " * 400]
    rows = [(i, t, langs[i % 3] if i < 60 else None, "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    samples = langid.sample(df, F.lit(True), "doc_id", "text", "lang", 24_000, 48)

    def folded(t):
        return re.sub(rb"[^a-z\x80-\xff]+", b"\0", t.lower().encode())

    got = {r["doc_id"]: r for r in langid.identify(df, F.lit(True)).collect()}
    for i, t in enumerate(texts):
        s = folded(t or "")
        need = []
        for parts in samples.values():
            known = b"".join(folded(x) + b"\0" for x in parts)
            n = 0
            for at in range(0, len(s), 512):
                piece, j = s[at : at + 512], 0
                while j < len(piece):
                    k = j + 1
                    while k < len(piece) and piece[j : k + 1] in known:
                        k += 1
                    n, j = n + 1, k
            need.append(n * np.log2(len(known)))
        lettered = any(c.isalpha() for c in t or "")
        assert got[i]["lang_pred"] == (list(samples)[int(np.argmin(need))] if lettered else "und")
        two = sorted(need)[:2]
        assert abs(got[i]["score"] - (1 - two[0] / max(two[1], 1) if lettered else 0)) < 1e-9


def test_language_id_of_few_labels_and_gibberish(spark):
    """A language of little labelled text is found, and what no language explains is rejected by the pipeline's stage."""
    rng = np.random.default_rng(3)
    en, de = "the of and to in that is was for with on as".split(), "der die und das nicht ein ist auf mit sich dem zu".split()
    say = lambda w, n: " ".join(rng.choice(w, n))
    texts = [(say(en, 300), "en") for _ in range(30)] + [(say(de, 9), "de") for _ in range(30)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, (t, x) in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, F.lit(True)).collect()}
    assert sum(got[i] == x for i, (_, x) in enumerate(texts)) >= 59
    junk = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 400))
    more = spark.createDataFrame([(100, junk, None, "s", 400), (101, "x", None, "s", 1), (102, "12 345", None, "s", 6), (103, None, None, "s", 0), (104, say(en, 40), None, None, 1)], DOCS)
    kept = {r["doc_id"] for r in langid.keep_identified(docs.unionByName(more)).collect()}
    assert kept == {*range(60), 101, 104}
    assert {r["doc_id"] for r in langid.keep_identified(more).collect()} == {100, 101, 104}  # nothing is labelled


def test_language_id_learns_each_labelled_language(spark):
    """Also from texts that are all short or all long, however many another language has."""
    rng = np.random.default_rng(3)
    vocabularies = {"en": "the of and this that with from they which", "fr": "le la des est avec pour qui dans être", "xx": "zor zuv zix qaz qux vuz kyx", "yy": "mmo ommu umo nnu onno"}
    text = lambda x, n: " ".join(str(w) for w in rng.choice(vocabularies[x].split(), n))
    rows = [(x, text(x, n)) for x, n, many in (("en", 80, 20), ("fr", 6, 200), ("xx", 5, 3), ("yy", 1500, 2)) for _ in range(many)]
    for some in (rows, [(x, t) for x, t in rows if len(t) < 200]):
        df = spark.createDataFrame([(i, t, x, "s", 1) for i, (x, t) in enumerate(some)], DOCS)
        got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, F.lit(True)).collect()}
        assert [got[i] for i in range(len(some))] == [x for x, _ in some]
    nothing = spark.createDataFrame([(0, "some words", None, "s", 1), (1, "12 !", None, "s", 1), (2, "中文", None, "s", 1), (3, None, None, "s", 1)], DOCS)
    assert {r["doc_id"] for r in langid.keep_identified(nothing).collect()} == {0, 2}


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; title</h1><p><b>One<br>two <i>th</i>ree.<p>Four<!-- no --> &eacute;&#233;</p><aside>Side</aside><div class="share-buttons">Share</div><form>Mail <input></form>
<table><tr><td>a<td>b</table><section id="comments"><p>Nice post</section></article><div id="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    kept, _, found = html_text.blocks(PAGE)
    assert found and " ".join(kept) == "Head & title One two three. Four éé a b"
    assert html_text.blocks("")[:2] == ([], [])
    assert html_text.blocks('<div class="post-content"><p>In</p></div><div class="x">out</div>')[0] == ["In"]
    assert html_text.blocks("<article>cut off <b")[0] == ["cut off"]
    assert "".join(html_text.blocks("<article><p>a</div></b>b</article>c")[0]).replace(" ", "") == "ab"
    assert " ".join(html_text.blocks("<main>x < y &lt; z</main>")[0]) == "x < y < z"


def test_html_of_hosts(spark):
    menu = "<div>Home News Sport Weather Travel Money Shop Cars</div>"
    page = lambda n: f"<body>{menu}<p>{' '.join(f'w{n}x{i}' for i in range(40))}</p></body>"
    pages = [(i, f"http://h.example/{i}", page(i)) for i in range(4)] + [(4, "http://other.example/", page(9)), (5, None, None), (6, "http://h.example/9", PAGE), (7, "http://[bad", ""), (0, "http://h.example/0", page(0))]
    rows = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(pages)
    assert all(got[i] == " ".join(f"w{i}x{j}" for j in range(40)) for i in range(4))
    assert got[4].startswith("Home News") and got[5] == got[7] == "" and got[6].startswith("Head & title")
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_of_large_hosts_in_parts(spark):
    """What recurs on a host is found however its pages are dealt: a line that two pages share, copies of a page, chrome that stands in an article elsewhere."""
    rng = np.random.default_rng(8)
    own = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    lines = [" ".join(f"s{i}y{j}" for j in range(8 + i % 3)) for i in range(12)]
    pages = [(i, f"http://h.example/{i}", f"<p>{own(i)}</p><div>{lines[i // 2]}</div>") for i in range(24)]
    pages += [(24 + i, f"http://h.example/copy{i}", f"<p>{own('copy')}</p>") for i in range(5)]
    pages += [(30 + i, f"http://h.example/a{i}", f"<nav>{lines[i]}</nav><article>{own(30 + i)}<p>{lines[int(rng.integers(12))]}</article>") for i in range(12)]
    pages += [(50 + i, f"http://g.example/{i}", f"<p>{own(i)}</p><div>{lines[i]}</div>") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for cut_articles in (False, True):
        want = {tuple(r) for r in html_text.extract(df, cut_articles=cut_articles).collect()}
        assert {r[0]: r[2] for r in want if r[0] < 29} == {i: own(i if i < 24 else "copy") for i in range(29)}
        for options in ({"chunk_pages": 1}, {"chunk_pages": 5}, {"chunk_bytes": 500}):
            assert {tuple(r) for r in html_text.extract(df, cut_articles=cut_articles, **options).collect()} == want


def test_html_of_large_hosts_sends_little(spark):
    """What the parts of a host tell one another about words that no two pages share is a few bytes a window."""
    words = np.random.default_rng(9).integers(0, 1 << 40, (120, 200))
    pages = [(i, f"http://h.example/{i}", "<article>" + " ".join(f"{w:x}" for w in page) + "</article>") for i, page in enumerate(words)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).cache()
    df.count()

    def run(**options):
        """(rows, bytes shuffled)"""
        sc = spark.sparkContext
        bus, store = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore()

        def stages():
            bus.waitUntilEmpty(30_000)
            found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
            return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

        before = stages()
        rows = {tuple(r) for r in html_text.extract(df, **options).collect()}
        return rows, sum(n for k, n in stages().items() if k not in before)

    (whole, once), (parts, sent) = run(), run(chunk_pages=30)
    df.unpersist()
    assert parts == whole and {r[4] for r in parts} == {0}
    short = [(i, f"http://h.example/{i}", f"<p>{'' if i == 3 else f'page {i // 2}'}</p>") for i in range(8)]  # not one window
    got = html_text.extract(spark.createDataFrame(short, "page_id long, url string, html string"), chunk_pages=1).collect()
    assert {tuple(r)[2:] for r in got} == {("", 0, 0), *((f"page {i}", 6, 0) for i in range(4))}
    # A part's pages are sent to it in each of two rounds, and at the end; beside them 16 bits and more are told of each window.
    assert once > 0 and sent < 3 * once + 4 * 120 * 193


@pytest.mark.parametrize("bits", [24, 30, 64])
def test_html_windows_that_chunks_tell(bits):
    """Chunks that tell their windows in two rounds know what brute force finds in the whole host, however few of the first bits differ."""
    rng = np.random.default_rng(bits)
    pages = [[[f"w{x}" for x in rng.integers(0, 3, int(rng.integers(1, 9)))] for _ in range(int(rng.integers(0, 5)))] for _ in range(30)]
    outer = [[bool(rng.integers(2)) for _ in page] for page in pages]
    pages, outer = pages + pages[:9] + pages[:3], outer + outer[:9] + outer[:3]
    dealt, run, short = [list(range(k, len(pages), 4)) for k in range(4)], 6, 8 if bits == 24 else bits
    chunks = [([pages[i] for i in of], [outer[i] for i in of]) for of in dealt]
    told = [html_text.ascending(html_text.first(html_text.Streams(*c).windows(run)[1], short)) for c in chunks]
    among = html_text.shared([html_text.pack_ascending(x) for x in told])
    assert all(set(a) == {x for x in t if sum(x in u for u in told) > 1} for a, t in zip(among, told, strict=True))
    held = [html_text.held(*c, run, short, a) for c, a in zip(chunks, among, strict=True)]
    every, chrome = html_text.repeats(pages, outer, run)
    assert any(x.any() for x in every) and any(x.any() for x in chrome)
    for columns in (2, 4):
        others = html_text.elsewhere([(html_text.pack_ascending(h[0]), *html_text.pack_texts(h[1 : 1 + columns])) for h in held])
        for of, c, (w, ends) in zip(dealt, chunks, others, strict=True):
            got = html_text.repeats(*c, run, [w, *ends])
            assert [x.tolist() for x in got[0]] == [every[i].tolist() for i in of]
            assert columns == 2 or [x.tolist() for x in got[1]] == [chrome[i].tolist() for i in of]
    w = html_text.ascending(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) >> np.uint64(64 - bits))
    assert [x for _, lo, hi in html_text.ranges(w, bits, 7) for x in w[lo:hi]] == w.tolist() == html_text.unpack_ascending(html_text.pack_ascending(w)).tolist()
    assert {k for k, _, _ in html_text.ranges(w, bits, 7)} == set(range(7)) and html_text.ranges(w[:0], bits, 7) == []


def test_html_of_hosts_with_containers(spark):
    """A page with a container says what recurs on its host: here in dropped blocks, and in its article."""
    menu, notice = "Home News Sport Weather Travel Money Shop Cars", "All of these words are used under terms that nobody has read"
    own = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    pages = [(0, "http://h.example/0", f"<div>{menu}</div><p>{own(0)}</p><div>{notice}</div>"), (1, "http://h.example/1", f"<nav>{menu}</nav><article>{own(1)}</article>"), (2, "http://h.example/2", f"<main>{own(2)}<p>{notice}</main>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {0: own(0), 1: own(1), 2: f"{own(2)} {notice}"}
    pages.append((3, "http://h.example/3", f"<nav>{menu}</nav><article>{own(3)}</article><footer>{notice}</footer>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html_text.extract(df, cut_articles=True).collect()}
    assert got == {0: (own(0), 20), 1: (own(1), 8), 2: (own(2), 12), 3: (own(3), 20)}
    assert {r["page_id"]: r["text"] for r in html_text.extract(df, chunk_pages=1).collect()}.keys() == got.keys()  # a large host in parts


def test_repeats_are_brute_force():
    rng, run = np.random.default_rng(8), 3
    for _ in range(40):
        pages = [[words(rng, int(rng.integers(0, 9)), 4).split() for _ in range(int(rng.integers(0, 4)))] for _ in range(int(rng.integers(1, 6)))]
        pages = [[b for b in p if b] for p in pages]
        chrome = [[bool(rng.integers(0, 2)) for _ in p] for p in pages]
        every, menu = html_text.repeats(pages, chrome, run)
        streams = [[w for b in p for w in b] for p in pages]
        outer = [[c for b, c in zip(p, cs, strict=True) for _ in b] for p, cs in zip(pages, chrome, strict=True)]
        for i, s in enumerate(streams):
            want = np.zeros((2, len(s)), bool)
            for a in range(len(s) - run + 1):
                first = [j for j, t in enumerate(streams) if t != s and any(t[b : b + run] == s[a : a + run] for b in range(len(t) - run + 1))]
                want[0, a : a + run] |= bool(first)
                # Pages of the same tokens are one, read as the first of them.
                as_chrome = [j for j in first if streams.index(streams[j]) == j and any(streams[j][b : b + run] == s[a : a + run] and all(outer[j][b : b + run]) for b in range(len(streams[j]) - run + 1))]
                want[1, a : a + run] |= bool(as_chrome)
            assert every[i].tolist() == want[0].tolist() and menu[i].tolist() == want[1].tolist()


def test_blocks_take_time_in_proportion():
    for page in ("<b>" * 20_000 + "</i>" * 20_000, "<div><article>" + "<b>" * 20_000 + "</div>" * 20_000, "<i>" + "<div>" * 20_000 + "</i>" * 20_000):
        began = time.process_time()
        html_text.all_blocks(page + "end")
        assert time.process_time() - began < 5


def test_html_cuts_repeats_only(spark):
    """Covered tokens are those of the common prefixes of sorted suffixes, and only they go."""
    rng, run = np.random.default_rng(4), 8
    shared = [f"s{i}" for i in range(51)]
    streams = [[f"a{i}" for i in range(25)] + shared + [f"b{i}" for i in range(24)], [f"c{i}" for i in range(9)] + shared]
    streams += [words(rng, 60, 3).split() for _ in range(6)]
    suffixes = sorted((t[i:], p, i) for p, t in enumerate(streams) for i in range(len(t)))
    covered = [set() for _ in streams]
    for j, (a, p, i) in enumerate(suffixes):
        for step in (-1, 1):  # the longest prefix that the nearest suffix of another page has too
            k = j + step
            while 0 <= k < len(suffixes) and suffixes[k][1] == p:
                k += step
            if 0 <= k < len(suffixes):
                n = next((x for x, (u, v) in enumerate(zip(a, suffixes[k][0], strict=False)) if u != v), min(len(a), len(suffixes[k][0])))
                if n >= run:
                    covered[p].update(range(i, i + n))
    pages = [(p, "http://h.example/", f"<p>{' '.join(t)}</p>") for p, t in enumerate(streams)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), run=run).collect()}
    assert any(covered[2:]) and len(got[0].split()) == 49
    assert got == {p: " ".join(w for i, w in enumerate(t) if i not in covered[p]) for p, t in enumerate(streams)}


# --- rules that hold for all


def test_native_operators_have_no_python_in_them():
    for module in (decontam, licenses):
        assert not re.search(r"pandas|InArrow|udf|\.rdd\b|numpy", Path(module.__file__).read_text())


def test_no_local_checkpoints():
    for f in Path(packing.__file__).parent.glob("*.py"):
        assert "localCheckpoint" not in f.read_text()
