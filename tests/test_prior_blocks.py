"""Blocks of a conversation's earlier rows against comparing all of them."""

import math
import random
import re
from collections import Counter

import pytest

from turnlake.operators import prior_blocks, replay


def brute(rows, k, score):
    """{(conversation, turn): [(place, score)]} of the k best earlier rows."""
    out = {}
    for conv, turn, mine in rows:
        found = [(-round(s, 9), t, s) for c, t, theirs in rows if c == conv and t < turn and (s := score(mine, theirs)) is not None]
        if best := sorted(found)[:k]:
            out[conv, turn] = [(t, s) for _, t, s in best]
    return out


def by_terms(a, b):
    a, b = (Counter(re.findall(r"[a-z0-9]+", (x or "").lower())) for x in (a, b))
    dot = sum(n * b[t] for t, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else None


def by_cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0


def told(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["conv_id"], r["turn"], r["rk"])):
        out.setdefault((r["conv_id"], r["turn"]), []).append((r["m_turn"], r["score"]))
    return out


def equal(got, want):
    assert got.keys() == want.keys()
    for key, hits in want.items():
        assert [t for t, _ in got[key]] == [t for t, _ in hits]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in hits])


def talks(seed=3):
    """One conversation has most turns; all its turns share a term; texts may be null, empty or repeated."""
    draw, words = random.Random(seed), [f"w{i}" for i in range(12)]
    rows = []
    for conv, n in ((1, 90), (2, 7), (3, 5), (4, 1)):
        for turn in range(n):
            text = " ".join(["Common", *draw.choices(words, k=draw.randint(0, 6))])
            rows.append((conv, turn, draw.choice([text, text, text, "Common w1", "", None])))
    return rows


@pytest.mark.parametrize("chars, at_once", [(4_000_000, 2_000_000), (200, 40)])
def test_terms(spark, monkeypatch, chars, at_once):
    monkeypatch.setattr(prior_blocks, "CHARS", chars)
    monkeypatch.setattr(prior_blocks, "AT_ONCE", at_once)
    rows = talks()
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = prior_blocks.by_terms(table, table, 4, ("turn",))
    equal(told(got), brute(rows, 4, by_terms))


def test_few_queries_find_the_same(spark):
    table = spark.createDataFrame(talks(5), "conv_id long, turn long, text string")
    asked = table.where("turn % 9 = 4").withColumnRenamed("text", "user_text")
    assert told(replay.prior_retrieval(asked, table, 3, few=True)).keys() == told(replay.prior_retrieval(asked, table, 3)).keys()
    equal(told(replay.prior_retrieval(asked, table, 3)), told(replay.prior_retrieval(asked, table, 3, few=True)))


@pytest.mark.parametrize("numbers", [1_000_000, 30])
def test_vectors(spark, monkeypatch, numbers):
    monkeypatch.setattr(prior_blocks, "NUMBERS", numbers)
    draw = random.Random(4)
    rows = [(conv, turn, draw.choice([[draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)], [draw.random()] * 2, [0.0] * 3, None])) for conv, n in ((1, 40), (2, 6)) for turn in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, embedding array<double>")
    equal(told(replay.prior_vectors(table, table, 3)), brute(rows, 3, by_cosine))


def test_rows_that_take_no_part(spark):
    table = spark.createDataFrame([(1, None, "a"), (None, 1, "a"), (1, 2, "a"), (1, 1, "a"), (1, 1, "a")], "conv_id long, turn long, text string")
    assert told(prior_blocks.by_terms(table, table, 5, ("turn",))) == {(1, 2): [(1, 1.0), (1, 1.0)]}
    assert told(prior_blocks.by_terms(table.limit(0), table, 5, ("turn",))) == {}


def test_keys_of_any_type(spark):
    held = spark.createDataFrame([("x", -1, "b", "apple"), ("x", -1, "a", "apple"), ("y", -1, "c", "apple")], "conv_id string, turn long, name string, text string")
    asked = spark.createDataFrame([("x", 7, "an apple")], "conv_id string, turn long, text string")
    got = prior_blocks.by_terms(asked, held, 1, ("turn", "name")).collect()
    assert [(r["conv_id"], r["turn"], r["m_name"], r["rk"]) for r in got] == [("x", 7, "a", 1)]
