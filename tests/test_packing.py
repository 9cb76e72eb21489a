import random

from pyspark.sql import functions as F

from turnlake.operators import packing

SCHEMA = "row int, header array<struct<n:int,text:string>>, recent array<struct<n:int,text:string>>, snippets array<struct<n:int,text:string>>"


def loop(items, budget):
    kept, used = [], 0
    for n, text in items:
        if n is not None and used + n <= budget:
            kept.append((n, text))
            used += n
    return kept


def test_equal_to_a_loop(spark):
    rng = random.Random(2)
    some = lambda: [(rng.choice([None, 0, *range(1, 30)]), f"t{i}") for i in range(rng.randrange(40))]
    rows = [(i, some(), some(), some()) for i in range(200)] + [(200, None, None, None), (201, [], [], []), (202, [(5, "a")] * 5, [(5, "a"), (5, "b"), (5, "c")], [(99, "x"), (1, "y")])]
    budgets = packing.Budgets(60, 40, 15)
    found = spark.createDataFrame(rows, SCHEMA).select("row", packing.context(F.col("header"), F.col("recent"), F.col("snippets"), budgets).alias("c"), packing.tokens(packing.greedy(F.col("recent"), 60)).alias("n"))
    for r in found.collect():
        _, header, recent, snippets = rows[r["row"]]
        plain = lambda items: [tuple(x) for x in items or []]
        assert plain(r["c"]["header"]) == loop(header or [], 40) and plain(r["c"]["snippets"]) == loop(snippets or [], 15)
        assert plain(r["c"]["recent"]) == loop((recent or [])[::-1], 60)[::-1]
        assert r["n"] is None or r["n"] <= 60
    assert rows[202][3] and plain(found.where("row = 202").first()["c"]["snippets"]) == [(1, "y")]


def test_many_items(spark):
    row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct((i % 50 + 1).alias("n"), i.cast("string").alias("text"))).alias("items"))
    got = row.select(packing.tokens(packing.greedy(F.col("items"), 4500)).alias("n")).first()
    assert got["n"] == 4500
