import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import retrieval


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 16)).astype("float32")
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"), vectors


def test_exact_search_in_blocks(rows):
    frame, vectors = rows
    hits = retrieval.top_k(frame.where("vec_id < 7"), frame, 5, vector_block=64, query_block=3).collect()
    wide = vectors.astype("float64")
    for q in range(7):
        best = np.argsort(-(wide @ wide[q]), kind="stable")[:5].tolist()
        mine = sorted((h for h in hits if h["query_id"] == q), key=lambda h: h["rk"])
        assert [h["vec_id"] for h in mine] == best
        assert mine[0]["score"] > 0.99 and all(a["score"] >= b["score"] for a, b in zip(mine, mine[1:]))


def test_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], schema)
    assert retrieval.top_k(one, none, 3).count() == 0
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieval.top_k(one, one, 9).collect()}
    assert found == {(1, 1): 0.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 1.0}


def test_approximate_recall(rows):
    frame, _ = rows
    asked = frame.where("vec_id % 20 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.top_k(asked, frame, 5).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in retrieval.ApproximateIndex(frame, tables=12, width=1.5).top_k(asked, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_adding_is_idempotent(spark):
    batch = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("b", None), ("c", [2.0])], "chunk_id string, embedding array<float>")
    assert {r["chunk_id"] for r in retrieval.new_chunks(batch, spark.createDataFrame([("c",)], "chunk_id string")).collect()} == {"a"}


def test_labels_go_on(spark):
    fresh = spark.createDataFrame([(x,) for x in "dbca"], "chunk_id string")
    held = spark.createDataFrame([(4,)], "label long")
    assert {r["chunk_id"]: r["label"] for r in retrieval.labelled(fresh, held, "chunk_id").collect()} == {"a": 5, "b": 6, "c": 7, "d": 8}
    assert {r["label"] for r in retrieval.labelled(fresh, held.where("false"), "chunk_id").collect()} == {0, 1, 2, 3}


def test_embedding_and_hydration(spark):
    chunks = spark.createDataFrame([(1, "ab", "t"), (2, None, "u")], "vec_id long, text string, turn_id string")
    made = retrieval.embed(chunks, lambda: lambda texts: [[len(t), 1.0] for t in texts], 2)
    assert sorted(tuple(r["embedding"]) for r in made.collect()) == [(0.0, 1.0), (2.0, 1.0)]
    hits = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "query_id long, vec_id long")
    out = retrieval.hydrated(hits, chunks, spark.createDataFrame([("t", "user")], "turn_id string, role string"))
    assert {(r["vec_id"], r["role"]) for r in out.collect()} == {(1, "user"), (2, None)}
    with pytest.raises(Exception, match="expected vectors"):
        retrieval.embed(chunks, lambda: lambda texts: [[1.0]] * len(texts), 2).select(F.sum(F.size("embedding"))).collect()


def test_scores_are_held_a_slice_at_a_time(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    asks, others = rng.normal(size=(2_000, 8)), rng.normal(size=(4_000, 8))
    whole = [(i, near.tolist()) for i, near, _ in retrieval._nearest(asks, others, 3, None)]
    monkeypatch.setattr(retrieval, "AT_ONCE", 50_000)
    tracemalloc.start()
    sliced = [(i, near.tolist()) for i, near, _ in retrieval._nearest(asks, others, 3, None)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sliced == whole == [(i, np.argsort(-(others @ a), kind="stable")[:3].tolist()) for i, a in enumerate(asks)]
    # all scores at once are 64 MB
    assert peak < 8_000_000


def test_approximate_search_shuffles_no_pairs(spark, rows):
    frame, _ = rows
    usable = frame.unionByName(frame.where("vec_id < 3"))
    again = usable.unionByName(spark.createDataFrame([(900, [float("nan")] * 16), (901, None), (902, [0.0] * 16)], frame.schema))
    index = retrieval.ApproximateIndex(again, tables=3, width=0.5)
    asked = again.where("vec_id < 40 OR vec_id >= 900")
    hits = index.top_k(asked, 6)
    assert "SortMergeJoin" not in hits._jdf.queryExecution().toString() and "HashJoin" not in hits._jdf.queryExecution().toString()
    # MLlib's own join of pairs, which fails on the zero vector
    pairs = index.model.approxSimilarityJoin(index._unit(usable.where("vec_id < 40")), index._unit(usable), 2.1, "d").select(F.col("datasetA.vec_id").alias("q"), F.col("datasetB.vec_id").alias("v"), (1 - F.col("d") * F.col("d") / 2).alias("s"))
    theirs = {}
    for r in pairs.collect():
        theirs.setdefault(r["q"], []).append((-round(r["s"], 12), r["v"]))
    mine = {}
    for h in sorted(hits.collect(), key=lambda h: h["rk"]):
        mine.setdefault(h["query_id"], []).append((-round(h["score"], 12), h["vec_id"]))
    assert {q: [v for _, v in got] for q, got in mine.items()} == {q: [v for _, v in sorted(got)[:6]] for q, got in theirs.items()}
    assert any(len(got) > 6 for got in theirs.values()) and any(len(got) < 300 for got in theirs.values())
