"""Vectors that are closer to each other than to their codes: each is its own nearest, before and after lists are rewritten."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators.inverted_file import InvertedFile


@pytest.fixture(scope="module")
def vectors(spark):
    """1,500 vectors in all directions, and 600 about one."""
    rng = np.random.default_rng(11)
    far = rng.normal(size=(1500, 64))
    close = far[0] / np.linalg.norm(far[0]) + 0.01 * rng.normal(size=(600, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([far, close]).astype(np.float32))]
    rows += [(5000 + i, v) for i, v in rows[1600:1610]]  # equal vectors, of which the smaller number comes first
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_each_vector_is_its_own_nearest(spark, vectors, tmp_path):
    asked = vectors.where("vec_id % 10 = 3 OR vec_id >= 5000").withColumnRenamed("vec_id", "query_id").cache()
    index = InvertedFile.build(vectors.where("vec_id % 2 = 0"), str(tmp_path / "i"), lists=20)
    index.add(vectors)
    for _ in range(2):
        found = {r["query_id"]: (r["vec_id"], round(r["score"], 6)) for r in index.search(asked, 1).collect()}
        assert found == {r["query_id"]: (r["query_id"] - 5000 if r["query_id"] >= 5000 else r["query_id"], 1.0) for r in asked.collect()}
        index.compact()


def test_an_index_without_angles_is_read(spark, vectors, tmp_path):
    index = InvertedFile.build(vectors.where("vec_id < 900"), str(tmp_path / "i"), lists=5)
    old = f"{index.path}/base/version=1"
    index.entries.drop("angle").write.parquet(f"{old}/codes")  # as versions without angles are stored
    index._sizes(index.entries).write.parquet(f"{old}/sizes")
    index.add(vectors.where("vec_id < 1000"))
    asked = vectors.where("vec_id IN (7, 950)").withColumnRenamed("vec_id", "query_id")
    for _ in range(2):
        assert {(r["query_id"], r["vec_id"]) for r in index.search(asked, 1).collect()} == {(7, 7), (950, 950)}
        assert index.entries.where(F.col("angle").isNotNull()).count() == 100
        index.compact()
