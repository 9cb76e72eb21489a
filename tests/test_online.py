"""Replay on a stream against the batch's windows, with turns out of order, repeated and over a restart."""

import random

import pytest
from pyspark.sql import functions as F

from turnlake.operators import replay
from turnlake.streaming import online

SCHEMA = "conv_id long, turn long, role string, text string"


def fresh():
    return {"next": 0, "tail": [], "waiting": {}}


def test_order_does_not_matter():
    rows = [(i, ("user", "assistant", "system")[i % 3], f"t{i}") for i in range(12)]
    want = online.advance(fresh(), rows, 3)
    assert [r[0] for r in want] == list(range(12)) and want[1][4] == "t0" and want[2][4] is None
    assert [r["text"] for r in want[5][3]] == ["t2", "t3", "t4"] and want[3][3][2]["role"] == "assistant"
    for seed in range(20):
        mixed = random.Random(seed).sample([*rows, *rows], 24)
        state, got = fresh(), []
        for at in range(0, 24, 5):
            got += online.advance(state, mixed[at : at + 5], 3)
        assert got == want and not state["waiting"] and len(state["tail"]) == 3


def test_gaps_are_given_up():
    state = fresh()
    assert online.advance(state, [(2, "user", "q"), (5, "assistant", "a")], 2) == []
    got = online.advance(state, [], 2, flush=True)
    assert [(r[0], r[4]) for r in got] == [(2, None), (5, "q")]
    # turn 3 comes after its place has been passed
    assert [r[0] for r in online.advance(state, [(3, "user", "late"), (6, "user", "next")], 2)] == [6]


def test_n_is_bounded(spark):
    with pytest.raises(ValueError):
        online.replayed(spark.createDataFrame([], SCHEMA), 0)


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    draw = random.Random(7)
    rows = [(c, i, draw.choice(["user", "assistant", "system"]), draw.choice([f"t{i}", "", None])) for c in range(6) for i in range(9)]
    mixed = draw.sample(rows, len(rows)) + rows[:5]
    before, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (mixed[:25], mixed[25:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(before)
        online.replay_stream(spark.readStream.schema(SCHEMA).parquet(before), out, state, 3).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == len(rows)
    whole = spark.createDataFrame(rows, SCHEMA)
    pairs = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    text = F.to_json("recent")
    assert pairs(got, "conv_id", "turn", text) == pairs(replay.recent_window(whole, 3), "conv_id", "turn", text)
    asked = got.where("asked IS NOT NULL").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("asked").alias("user_text"), F.col("text").alias("reply"))
    assert pairs(asked, "conv_id", "turn", "user_text", "reply") == pairs(replay.scored_turns(whole).where("user_text IS NOT NULL"), "conv_id", "turn", "user_text", "reply")
