"""Replay of recorded conversations: what was known before each scored turn.

The recorded reply, not the generated one, becomes part of the past; so the state
before a turn is the set of turns before it, and the replay is a join and some
windows instead of a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.text import term_tally
from turnlake.operators import prior_blocks


def scored_turns(turns: DataFrame) -> DataFrame:
    """User turns whose very next turn is a non-empty assistant reply: conv_id, turn, user_text, reply."""
    order = W.partitionBy("conv_id").orderBy("turn")
    ahead = turns.withColumn("_role", F.lead("role").over(order)).withColumn("reply", F.lead("text").over(order))
    return ahead.where("role = 'user' AND _role = 'assistant' AND reply <> ''").select("conv_id", "turn", F.col("text").alias("user_text"), "reply")


def ingested(turns: DataFrame) -> DataFrame:
    """Turns as a replay stores them: all that is not the user's counts as the assistant's."""
    return turns.withColumn("role", F.when(F.col("role") == "user", "user").otherwise("assistant"))


def recent_window(turns: DataFrame, n: int = 4) -> DataFrame:
    """conv_id, turn, recent: the n turns before each turn, oldest first; n = 0 means all of them."""
    frame = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n if n else W.unboundedPreceding, -1)
    return ingested(turns).select("conv_id", "turn", F.collect_list(F.struct("role", "text")).over(frame).alias("recent"))


def term_counts(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, term, tf and size, the length of the row's vector of counts; counted within each row, so nothing is shuffled. Keys are unique."""
    tallied = rows.select(*key, term_tally(F.col(text)).alias("tally"))
    size = F.sqrt(F.aggregate("tally", F.lit(0).cast("long"), lambda n, x: n + x["tf"] * x["tf"]))
    return tallied.withColumn("size", size).select(*key, "size", F.explode("tally").alias("x")).select(*key, F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), "size")


def prior_retrieval(queries: DataFrame, memory: DataFrame, k: int, key: tuple[str, ...] = ("turn",), few: bool = False) -> DataFrame:
    """The k rows of memory from earlier turns of the same conversation that share most with each query.

    queries: conv_id, turn, user_text. memory: conv_id, turn, text and the other
    columns of key. Score: cosine of term counts; rows without a common term are
    no hits. Returns conv_id, turn, rk, m_<key>, score; ties go to the earlier row.
    Blocks of queries meet blocks of memory, so no pairs are shuffled.
    few: the queries have been counted to hold few terms, so they go to the memory,
    whose rows stay where they are.
    """
    asked = queries.select("conv_id", "turn", F.col("user_text").alias("text"))
    return _met_by_few(asked, memory, k, key) if few else prior_blocks.by_terms(asked, memory, k, key)


def _met_by_few(queries: DataFrame, memory: DataFrame, k: int, key: tuple[str, ...]) -> DataFrame:
    """prior_retrieval with the queries' terms, counted to be few, broadcast."""
    mine = F.broadcast(term_counts(queries, ["conv_id", "turn"]))
    names = [f"m_{c}" for c in key]
    theirs = term_counts(memory.select("conv_id", *key, "text"), ["conv_id", *key])
    theirs = theirs.select("conv_id", "term", F.col("tf").alias("m_tf"), F.col("size").alias("m_size"), *(F.col(c).alias(f"m_{c}") for c in key))
    met = mine.join(theirs, ["conv_id", "term"]).where(F.col("m_turn") < F.col("turn")).groupBy("conv_id", "turn", *names)
    scored = met.agg(F.sum(F.col("tf") * F.col("m_tf")).alias("dot"), F.first("size").alias("size"), F.first("m_size").alias("m_size"))
    scored = scored.withColumn("score", F.col("dot") / (F.col("size") * F.col("m_size")))
    order = W.partitionBy("conv_id", "turn").orderBy(F.desc(F.round("score", 9)), *names)
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("conv_id", "turn", "rk", *names, "score")


def prior_vectors(queries: DataFrame, memory: DataFrame, k: int, key: tuple[str, ...] = ("turn",)) -> DataFrame:
    """As prior_retrieval, by the cosine of vectors: queries (conv_id, turn, embedding), memory (conv_id, turn, embedding and key), both best written tables.

    Every earlier row of a conversation with a vector as long as the query's is a hit, however far it is.
    """
    return prior_blocks.by_vectors(queries, memory, k, key)


def first_conversations(turns: DataFrame, n: int | None, by: str = "conv_id") -> DataFrame:
    """The turns of the first n conversations; None and 0 mean all."""
    if not n:
        return turns
    return turns.join(turns.select(by).distinct().orderBy(by).limit(n), by, "left_semi")


def truncated(text: Column, hits: Column) -> tuple[Column, Column]:
    """What a result keeps: 500 characters of a text, 200 of each of the first five hits."""
    return F.substring(text, 1, 500), F.transform(F.slice(hits, 1, 5), lambda x: F.substring(x, 1, 200))
