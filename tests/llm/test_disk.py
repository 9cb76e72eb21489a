"""What near copies and passages leave on disk and send through shuffles."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from turnlake.llm import run_index, token_groups
from turnlake.sources import shared

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(3 * i + k, " ".join([*base[:70], *(["e"] * k), *base[70:]])) for k in range(3)]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_parts_go_when_neighbourhoods_are_known(spark, docs, monkeypatch):
    made = []

    def described(*args, f=token_groups.described):
        made.append(f(*args))
        return made[-1]

    monkeypatch.setattr(token_groups, "described", described)
    before = spark.conf.get(CLEANUP)
    found = token_groups.join(docs, 5, 80, 100)
    assert len(made) == 1 and not any(shared.exists(spark, f.rpartition("/")[0]) for f in made[0].inputFiles())
    assert {r["component_id"] for r in found.collect()} == {0, 3, 6, 9, 12, 15}
    assert spark.conf.get(CLEANUP) == before


def test_steps_of_stages_leave_no_shuffle_files(spark, docs, monkeypatch):
    during = []
    for name, stage in corpus_pipeline.STAGES[1:3]:
        monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda s, d, x, f=stage: during.append(s.conf.get(CLEANUP)) or f(s, d, x))])
        before = spark.conf.get(CLEANUP)
        corpus_pipeline.run(spark, "")
        assert spark.conf.get(CLEANUP) == before
    assert during == ["true", "true"]


@pytest.mark.parametrize("shares", [1, 4])
def test_documents_that_share_many_parts_are_listed_once(spark, shares, monkeypatch):
    monkeypatch.setattr(token_groups, "SHARES", shares)
    rng = random.Random(4)
    parts = [2 * rng.randrange(-(2**62), 2**62) + 1 for _ in range(300)]
    rows = spark.createDataFrame([(n, p) for n in (7, 5) for p in parts] + [(9, p) for p in parts[:100]] + [(11, 3)], "node long, signature long")
    found = {(tuple(r["nodes"]), r["rows"]) for r in token_groups._met(rows).collect()}
    assert found == {((5, 7, 9), 100), ((5, 7), 200)}
    # all shares together have every part
    sets = spark.createDataFrame([(n, 50, bytearray(64), [(1, 0, p)]) for n, p in ((5, parts), (7, parts), (9, parts[:1]))], f"doc_id long, n_shingles long, sketch binary, signatures {token_groups.SIGNATURES}")
    assert {(r["node"], r["component"]) for r in token_groups.neighbourhoods(sets).collect()} == {(5, 5), (7, 5), (9, 5)}


def test_texts_stay_where_few_have_repeats(spark, docs):
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = run_index.deduplicated(docs, run_index.PASSAGE, run_index.WORDS)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert left.where(F.length("text") < F.col("n_chars")).count() == 18
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
