"""The queries and the pipeline over the small tables, against SQL and brute force."""

import os

import duckdb
import pyarrow.parquet as pq
import pytest

from tintflow.llm import queries as Q


def test_queries_are_there():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{data}/{f}')")
    got = Q.queries()[name](spark, data)
    cols = sorted(got.columns)
    want = con.execute(Q.oracle_sql()[name]).fetchall()
    order = [d[0] for d in con.description]
    assert sorted(order) == cols
    plain = lambda row: tuple(round(float(v), 9) + 0.0 if isinstance(v, (int, float)) else v for v in row)
    assert sorted(map(str, (plain(r) for r in got.select(*cols).collect()))) == sorted(str(plain(tuple(dict(zip(order, r, strict=True))[c] for c in cols))) for r in want)


def test_held_out_accuracy(spark, data):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{data}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    found = [r for r in Q.queries()["op4_quality_classifier"](spark, data).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(found) > 5 and sum(r["predicted"] == labels[r["doc_id"]] for r in found) >= 0.9 * len(found)
    found = [r for r in Q.queries()["op9_language_id"](spark, data).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found) >= 0.95 * len(found)


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline as p

    from test_operators import linked, without_repeats

    rows = pq.read_table(f"{data}/documents.parquet").to_pylist()
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert name == p.STAGES[-1][0] or docs.columns == columns
    lettered = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    assert {r["doc_id"] for r in kept["language_id"].collect()} == {r["doc_id"] for r in lettered}
    lettered.sort(key=lambda r: r["doc_id"])
    alone = [r for i, r in enumerate(lettered) if linked_of(linked, lettered)[i] == i]
    assert {r["doc_id"] for r in kept["ngram_jaccard_join"].collect()} == {r["doc_id"] for r in alone}
    want = {r["doc_id"]: w[4].decode("utf-8", "ignore") for r, w in zip(alone, without_repeats([r["text"] for r in alone]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in kept["suffix_array_dedup"].collect()} == want
    left = {r["doc_id"] for r in kept["benchmark_decontamination"].collect()}
    assert left <= set(want) and {r["doc_id"] for r in kept["best_fit_packing"].collect()} == left
    assert sorted(map(tuple, p.run(spark, data).collect())) == sorted(map(tuple, kept["best_fit_packing"].collect()))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Stages put up with empty tables, nulls in any column, repeated rows, very long texts and columns named like their own."""
    import corpus_pipeline as p

    spark.createDataFrame([(1, "the words of an item that nobody has said so far in any text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["k", "k2", "u", "u2", "c0", "component_id", "bits", "starts", "z"]
    columns = [f"{i} AS `{n}`" for i, n in enumerate(names)]
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(1, long, "en", "a", len(long)), (1, long, "en", "a", len(long)), (2, long + " end", None, None, None), (None, "a text without a key, of its own words", "en", "b", 1), (3, None, "en", "b", 0), (4, "", "en", "b", 0), (5, "one more text that is of no other", None, "b", 1), (6, "words and letters that texts without a key or a language may be known by, such as one more or no other", "en", "b", 1)]
    for these in ([], rows):
        docs = spark.createDataFrame(these, DOCS).selectExpr("*", *columns)
        for i, (name, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if i < len(p.STAGES) - 1:
                assert out.columns == docs.columns, name
                out.write.parquet(path := str(tmp_path / f"{name}-{len(these)}"))
                docs = spark.read.parquet(path)
                assert all([r[n] for n in names] == list(range(len(names))) for r in docs.collect())
        kept = {r["doc_id"] for r in out.collect()}
        assert kept == ({1, None, 5, 6} if these else set())


_memo = {}


def linked_of(linked, rows):
    if "x" not in _memo:
        _memo["x"] = {i: c for i, (_, c) in linked([r["text"] for r in rows]).items()}
    return _memo["x"]
