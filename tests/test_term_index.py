"""The term index against BM25 of all rows, and what its bounds save."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.functions.text import term_tally
from turnlake.operators import term_index
from turnlake.operators.term_index import TermIndex, hybrid, reranked

SCHEMA = "doc_id long, text string"


def brute(texts, asked, k, mean):
    """{query: [(doc, score)]} by scoring every text."""
    words = {d: Counter(w for w in t.lower().split()) for d, t in texts.items()}
    df = Counter(w for tally in words.values() for w in tally)
    out = {}
    for q, text in asked.items():
        scores = []
        for d, tally in words.items():
            size, score = sum(tally.values()), 0.0
            for w in sorted(set(text.lower().split()) & set(tally)):
                tf = tally[w]
                score += math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
            if score > 0:
                scores.append((-round(score, 9), d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def hits(index, spark, asked, k):
    frame = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    out = {q: [] for q in asked}
    for r in index.search(frame, k).orderBy("query_id", "rk").collect():
        assert r["rk"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["doc_id"], r["score"]))
    return out


def same(found, want):
    return found.keys() == want.keys() and all([d for d, _ in found[q]] == [d for d, _ in want[q]] and all(a[1] == pytest.approx(b[1], abs=1e-8) for a, b in zip(found[q], want[q], strict=True)) for q in want)


@pytest.fixture(scope="module")
def texts():
    """Words of all degrees of rarity; "the" is in all texts, and a third of them are equal."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    out = {d: " ".join(["the"] * rng.randrange(1, 4) + rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.randrange(3, 40))) for d in range(900)}
    return out | {d: "the same w5 w77" for d in range(1000, 1450)}


def test_hits_are_those_of_all_rows(spark, texts, tmp_path, monkeypatch):
    rng = random.Random(5)
    asked = {q: " ".join(rng.choices(list(texts.values())[q * 7].split(), k=6)) for q in range(40)} | {100: "the", 101: "same w5", 102: "unknown words", 103: "", 104: "the THE w200 w200"}
    index = TermIndex.build(spark.createDataFrame(list(texts.items()), SCHEMA), str(tmp_path / "i"))
    want = brute(texts, asked, 10, index.mean)
    assert same(hits(index, spark, asked, 10), want)
    monkeypatch.setattr(term_index, "SLICE", 7)
    monkeypatch.setattr(term_index, "FEW_ROWS", 0)  # joins that shuffle
    monkeypatch.setattr(term_index, "FEW_TERMS", 0)
    assert same(hits(index, spark, asked, 3), {q: rows[:3] for q, rows in want.items()})


@pytest.mark.parametrize("block", [100, 13])
def test_blocks_do_not_matter(spark, texts, tmp_path, monkeypatch, block):
    monkeypatch.setattr(term_index, "BLOCK", block)
    index = TermIndex.build(spark.createDataFrame(list(texts.items()), SCHEMA), str(tmp_path / "i"))
    asked = {q: texts[q * 13] for q in range(30)} | {100: "the", 101: "same w5"}
    assert same(hits(index, spark, asked, 10), brute(texts, asked, 10, index.mean))


def test_common_terms_are_hardly_read(spark, texts, tmp_path):
    index = TermIndex.build(spark.createDataFrame(list(texts.items()), SCHEMA), str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "the w150 w250"), (2, "w150 w250"), (3, "the")], "query_id long, text string")
    read = {r["query_id"]: r["n_read"] for r in index.reads(asked, 3).collect()}
    rare = sum(bool({"w150", "w250"} & set(t.split())) for t in texts.values())
    assert read[3] > 800 and read[2] <= 2 * rare and read[1] <= 900 + 3 * rare
    lists = [(9.0, np.arange(5), np.full(5, 9.0)), (0.1, np.arange(10_000), np.full(10_000, 0.1))]
    places, scores, n = term_index.best(lists, 10_000, 3, 5.0)
    assert places.tolist() == [0, 1, 2] and scores.tolist() == [9.1] * 3 and n == 10
    assert term_index.best(lists, 10_000, 3, 9.5)[2] == 0  # the block is skipped


def test_added_rows_count_at_once(spark, texts, tmp_path):
    rows = spark.createDataFrame(list(texts.items()), SCHEMA)
    index = TermIndex.build(rows.where("doc_id % 2 = 0"), str(tmp_path / "i"))
    assert index.add(rows.where("doc_id % 2 = 1"), "odd").count() == rows.where("doc_id % 2 = 1").count()
    index.add(rows, "odd")  # the same batch again
    assert index.add(rows).count() == 0
    asked = {1: texts[7], 2: "the same", 3: texts[8]}
    again = TermIndex(spark, str(tmp_path / "i"))
    assert same(hits(again, spark, asked, 8), brute(texts, asked, 8, index.mean))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "a " * 50_000 + "b"), (5, "Ä ö !")]
    index = TermIndex.build(spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SCHEMA}, id string, n int"), str(tmp_path / "i"))
    assert index.rows.count() == 5
    found = hits(index, spark, {1: "a", 2: "b"}, 9)
    assert {d for d, _ in found[1]} == {d for d, _ in found[2]} == {3, 4}
    none = TermIndex.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert hits(none, spark, {1: "a"}, 3) == {1: []}


def test_tally(spark):
    rows = spark.createDataFrame([(1, "b a B"), (2, ""), (3, None), (4, "x " * 100_000)], "n int, text string")
    found = {r["n"]: [tuple(x) for x in r["t"]] for r in rows.select("n", term_tally(F.col("text")).alias("t")).collect()}
    assert found == {1: [("a", 1), ("b", 2)], 2: [], 3: [], 4: [("x", 100_000)]}


def test_hybrid_and_reranking(spark):
    side = lambda rows: spark.createDataFrame(rows, "query_id long, rk int, doc_id long, score double")
    both = hybrid(side([(1, 1, 5, 0.9), (1, 2, 6, 0.8)]), side([(1, 1, 6, 3.0), (1, 2, 7, 2.0)]))
    assert sorted((r["doc_id"], r["dense_rk"], r["term_rk"]) for r in both.collect()) == [(5, 1, None), (6, 2, 1), (7, None, 2)]
    facts = both.withColumn("pin", F.col("doc_id") == 7).withColumn("superseded", F.col("doc_id") == 5)
    best = reranked(facts, 2, {"dense_score": 1.0, "pin": 2.0, "superseded": -1.0}).orderBy("rk").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in best] == [(7, 2.0), (6, 0.8)]


def test_hits_of_many_queries_leave_a_task_as_arrays(spark, tmp_path, monkeypatch):
    import pandas as pd

    made = []
    frame = pd.DataFrame
    texts = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c") for i in range(60)], "doc_id long, text string")
    index = term_index.TermIndex.build(texts, f"file://{tmp_path}/many")
    asked = texts.withColumnRenamed("doc_id", "query_id")
    # run the step in this process: a frame for each query is what grew with the queries
    monkeypatch.setattr(term_index.pd, "DataFrame", lambda *a, **kw: made.append(1) or frame(*a, **kw))
    steps = []
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    run = PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda self, func, schema: steps.append(func) or run(self, func, schema))
    index._found(asked, 3)
    lists = frame({"block": ["x"], "term": ["c"], "top": [1.0], "places": [np.array([0, 1])], "weights": [np.array([1.0, 0.5])]})
    queries = frame({"query_id": range(50), "terms": [["c"]] * 50, "idfs": [[1.0]] * 50, "floor": [0.0] * 50})
    made.clear()
    out = steps[0](lists, queries)
    assert len(made) <= 1 and len(out) == 150 and out["n_read"].tolist() == [0, 0, 2] * 50
    assert out["place"].tolist() == [0, 1, -1] * 50 and out["query_id"].tolist() == np.repeat(np.arange(50), 3).tolist()
