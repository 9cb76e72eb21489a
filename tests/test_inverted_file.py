"""The inverted file against exact search, and what is added against a build of all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import inverted_file, retrieval
from turnlake.operators.inverted_file import InvertedFile

FOLDER = "/root/testdata/sf0.1"


def recall(hits, exact):
    of = lambda rows, key: {(r["query_id"], r[key]) for r in rows.collect()}
    want = of(exact, "vec_id")
    return len(of(hits, "vec_id") & want) / len(want)


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """The given vectors, those asked for, their exact neighbours and an index."""
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0")
    index = InvertedFile.build(rows, str(tmp_path_factory.mktemp("index") / "i"))
    return rows, asked.withColumnRenamed("vec_id", "query_id"), retrieval.top_k(asked, rows, 10).cache(), index


def test_recall_and_reads(given):
    rows, asked, exact, index = given
    hits = index.search(asked, 10, index.tuned(10), counted=True).cache()
    assert recall(hits, exact) >= 0.9
    n = rows.count()
    assert hits.agg(F.max("n_vectors")).first()[0] < 0.1 * n and hits.agg(F.max("n_codes")).first()[0] <= n
    assert [tuple(r) for r in hits.groupBy("query_id").agg(F.count("*"), F.max("rk")).select("count(1)", "max(rk)").distinct().collect()] == [(10, 10)]


def test_ef_and_k_trade_recall_for_reads(given):
    rows, asked, exact, index = given
    found = {ef: index.search(asked, 10, ef, counted=True).cache() for ef in (1, 8, 45)}
    shares = [recall(h, exact) for h in found.values()]
    reads = [h.agg(F.avg("n_codes")).first()[0] for h in found.values()]
    assert shares == sorted(shares) and shares[0] < 0.6 < 0.95 < shares[2] and reads == sorted(reads) and reads[0] < 0.1 * reads[2]
    fewer = {(r["query_id"], r["rk"]): r["score"] for r in index.search(asked, 3, 45).collect()}
    more = {(r["query_id"], r["rk"]): r["score"] for r in found[45].collect()}
    assert all(more[at] >= score - 1e-9 for at, score in fewer.items())


def test_added_vectors_are_found_and_compaction_changes_nothing(spark, given, tmp_path):
    rows, asked, _, whole = given
    index = InvertedFile.build(rows.where("vec_id % 3 = 0"), str(tmp_path / "i"), coder=whole.coder)
    assert index.add(rows.where("vec_id % 3 = 1")).count() == rows.where("vec_id % 3 = 1").count()
    index.add(rows.where("vec_id % 3 = 2"), "last")
    index.add(rows.where("vec_id % 3 = 2"), "last")  # the same batch again
    assert index.add(rows).count() == 0
    plain = lambda i: sorted((r["query_id"], r["rk"], r["vec_id"], round(r["score"], 9)) for r in i.search(asked, 5, 20).collect())
    assert plain(index) == plain(whole)
    index.compact()
    index = InvertedFile(spark, str(tmp_path / "i"))
    assert index.version == 1 and plain(index) == plain(whole)
    same = lambda i: sorted((r["vec_id"], r["list"], bytes(r["code"])) for r in i.entries.collect())
    assert same(index) == same(whole) and index.sizes().tolist() == whole.sizes().tolist()


def test_an_unfinished_version_does_not_count(spark, given, tmp_path):
    rows, *_ = given
    index = InvertedFile.build(rows.limit(50), str(tmp_path / "i"), lists=4)
    index.entries.write.parquet(f"{index.path}/base/version=1/codes")  # a compaction that ended before its sizes
    assert index.version == 0 and index.entries.count() == 50


def test_crowds_and_odd_vectors(spark, tmp_path, monkeypatch):
    """Equal vectors by the hundred, text keys, nulls, zeros and lists that span pages."""
    monkeypatch.setattr(inverted_file, "PAGE", 64)
    monkeypatch.setattr(inverted_file, "SLICE", 2)
    rng = np.random.default_rng(3)
    rows = [(f"c{i:03}", [1.0, 1.0, 0.0, 0.0]) for i in range(300)] + [(f"d{i:03}", rng.normal(size=4).tolist()) for i in range(100)]
    rows += [("x1", None), ("x2", [float("nan"), 1.0, 1.0, 1.0]), ("x3", [0.0] * 4), (None, [1.0] * 4), ("c000", [1.0, 1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, "theirs") for r in rows], "key string, embedding array<double>, list string")
    index = InvertedFile.build(frame, str(tmp_path / "i"), "key", lists=5, parts=2)
    assert index.entries.count() == 401
    asked = spark.createDataFrame([(1, [2.0, 2.0, 0.0, 0.0]), (2, [0.0] * 4), (3, None), (4, rows[350][1])], "query_id long, embedding array<double>")
    found = {}
    for r in index.search(asked, 6, 5).orderBy("rk").collect():
        found.setdefault(r["query_id"], []).append((r["key"], round(r["score"], 6)))
    assert found[1] == [(f"c{i:03}", 1.0) for i in range(6)] and found[4][0] == ("d050", 1.0)
    assert len(found[2]) == 6 and {s for _, s in found[2]} == {0.0} and 3 not in found
    assert index.search(asked.where("false"), 6).count() == 0
    with pytest.raises(ValueError, match="needs vectors"):
        InvertedFile.build(frame.where("false"), str(tmp_path / "none"), "key")
