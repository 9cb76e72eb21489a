import random
import re

import pytest
from pyspark.sql import functions as F

from turnlake.operators import chunking
from turnlake.schemas import ChunkerConfig

SCHEMA = "conv_id long, turn long, role string, text string"


def count(text):
    return len(re.findall(r"\w+|[^\w\s]", text, re.ASCII))


def model(text, limit):
    """The packing rules once more, turn by turn, in plain Python: (text, start, end, tokens)."""
    found = []
    for sentence in (s.strip() for s in re.sub(r"([.!?])\s+", r"\1\n", text, flags=re.ASCII).split("\n")):
        if not sentence:
            continue
        options = [[sentence]] if count(sentence) <= limit else []
        if not options:
            for d in ("; ", ", "):
                parts = sentence.split(d)
                kept = [p.strip() + (d.strip() if i < len(parts) - 1 else "") for i, p in enumerate(parts) if p.strip()]
                if len(parts) > 1 and all(count(p) <= limit for p in kept):
                    options.append(kept)
        if not options:
            rows, n = [], limit + 1
            for word in sentence.split():
                if not rows or n + count(word) > limit:
                    rows.append([])
                    n = 0
                rows[-1].append(word)
                n += count(word)
            options.append([" ".join(r) for r in rows])
        found += options[0]
    placed, at = [], 0
    for s in found:
        start = text.find(s, at)
        if start < 0:
            start = text.find(s.split()[0], at)
        start = at if start < 0 else start
        at = start + len(s)
        placed.append((s, start, at, count(s)))
    chunks = []
    for s, start, end, n in placed:
        if chunks and chunks[-1][3] + n <= limit:
            t, first, _, m = chunks[-1]
            chunks[-1] = (f"{t} {s}", first, end, m + n)
        else:
            chunks.append((s, start, end, n))
    return chunks


def test_against_a_sequential_model(spark):
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma;", "delta.", "Ünï", "x", "long-ish-word", "end!", "is\n", "  two"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = spark.createDataFrame([(0, i, "user", t) for i, t in enumerate(texts)], SCHEMA)
    for limit in (7, 12, 40):
        found = {}
        for r in chunking.chunk(rows, ChunkerConfig(1, limit)).orderBy("turn", "pos").collect():
            found.setdefault(r["turn"], []).append((r["text"], r["start_char"], r["end_char"], r["token_count"]))
        for i, text in enumerate(texts):
            assert found.get(i, []) == model(text, limit), (limit, text)


@pytest.mark.parametrize("text,n", [("", 0), ("   ", 0), (None, 0), ("Hello world.", 1)])
def test_blank_and_short(spark, text, n):
    assert chunking.chunk(spark.createDataFrame([(0, 0, "user", text)], SCHEMA), ChunkerConfig(10, 50)).count() == n


def test_one_long_word_stays_whole(spark):
    word = "-".join(["ab"] * 20)
    rows = chunking.chunk(spark.createDataFrame([(0, 0, "user", word)], SCHEMA), ChunkerConfig(1, 5)).collect()
    assert len(rows) == 1 and rows[0]["token_count"] == 39


def test_numbers_are_the_same_on_every_run(spark):
    rows = spark.createDataFrame([(0, 0, "user", "One. Two. Three.")], SCHEMA)
    first, second = ({r["chunk_id"] for r in chunking.chunk(rows, ChunkerConfig(1, 3)).collect()} for _ in range(2))
    assert first == second and len(first) == 3


def test_hard_split_bound(spark):
    got = spark.range(1).select(chunking.hard_split(F.lit("a b c d e"), F.lit(2)).alias("x")).first()["x"]
    assert got == ["a b", "c d", "e"]
