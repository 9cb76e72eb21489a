"""What the stages of the pipeline do with repeated rows, and that cells of the exact search are coarser than what they stand for."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from turnlake.llm import vector_approx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_each_repeated_row_stays_whole(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(120))
    one, two, three, four = (text() for _ in range(4))
    rows = [(1, one), (1, one), (2, two), (None, two), (None, two), (None, three), (None, three), (3, four), (3, three + " more"), (4, ""), (4, ""), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a.com", len(t or "")) for i, t in rows], DOCS).withColumn("digest", F.lit("theirs"))
    left = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert left.columns == docs.columns
    found = sorted(((r["doc_id"] or 0, r["text"]) for r in left.collect()), key=repr)
    assert found == sorted([(1, one), (2, two), (0, three), (3, four), (3, three + " more"), (4, ""), (5, None), (0, "")], key=repr)
    kept = corpus_pipeline.without_repeats(spark, left.where("text NOT LIKE '%more'"), "")
    assert {r["text"] for r in kept.collect()} >= {one, two, three, four}


def test_run_puts_the_batch_setting_back(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and spark.conf.get(corpus_pipeline.BATCH_SETTING) == before


def test_cells_are_coarser_than_components(spark):
    for sf in ("sf0.001", "sf0.1"):
        rows = vector_approx.scaled(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
        ends = rows.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        grid = vector_approx.Grid([(r["lo"], r["hi"]) for r in ends], 256, vector_approx.BITS)
        assert (grid.step > 1).all()
