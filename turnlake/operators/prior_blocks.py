"""Search among the earlier rows of the same conversation, in blocks.

Queries and memory of a conversation are dealt into blocks of bounded size, and each
pair of blocks is a task of its own: scores are summed in the task's memory, and
only the k best rows of each query leave it. So what travels are texts and hits,
never pairs, however common a term and however long a conversation is. Small
conversations share tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.text import term_tally
from turnlake.sources.shared import written

#: Characters of text, and numbers of vectors, in a block (expected).
CHARS, NUMBERS = 4_000_000, 1_000_000
#: Sums that a task holds at once, unless a single query needs more.
AT_ONCE = 2_000_000
#: Scores are compared when rounded to so many digits.
DIGITS = 9
#: Conversations whose places may be broadcast.
FEW_ROWS = 100_000


def _placed(queries: DataFrame, memory: DataFrame, cost: Column, block: int) -> DataFrame:
    """conv_id, home, qn, mn: the bundle of each conversation with queries and memory, and how many blocks both are cut into."""
    sizes = lambda rows, name: rows.groupBy("conv_id").agg(F.sum(cost).alias(name))
    both = written(sizes(queries, "q").join(sizes(memory, "m"), "conv_id").select("conv_id", F.ceil(F.col("q") / block).alias("qn"), F.ceil(F.col("m") / block).alias("mn"), (F.col("q") + F.col("m")).alias("size")))
    alone = (F.col("qn") == 1) & (F.col("mn") == 1)
    together = max(1, -(-int(both.where(alone).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // block))
    # conversations whose bundles have one number are told apart in the task
    home = F.when(alone, F.pmod(F.xxhash64("conv_id"), F.lit(together))).otherwise(F.xxhash64("conv_id", F.lit(1)))
    places = both.select("conv_id", home.alias("home"), "qn", "mn")
    return F.broadcast(places) if both.limit(FEW_ROWS + 1).count() <= FEW_ROWS else places


def _searched(queries: DataFrame, memory: DataFrame, places: DataFrame, names: list[str], value: list[str], search, k: int) -> DataFrame:
    """The k best hits of each query over all pairs of blocks; search scores one pair."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n))
    # both sides may come of one table: columns of their own names keep them apart
    new = lambda *columns: [F.col(c).alias(c) for c in columns]
    q = queries.join(places, "conv_id").select(*new("home"), own("qn", "turn").alias("i"), each("mn").alias("j"), *new("conv_id", "turn", *value))
    m = memory.join(places, "conv_id").select(*new("home"), each("qn").alias("i"), own("mn", *names).alias("j"), *new("conv_id", *names, *value))
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *memory.schema]}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("conv_id", "turn", *names)) + ", score double"
    block = ["home", "i", "j"]
    hits = q.groupBy(*block).cogroup(m.groupBy(*block)).applyInArrow(lambda a, b: search(a, b, names, k), schema)
    order = W.partitionBy("conv_id", "turn").orderBy(F.desc(F.round("score", DIGITS)), *names)
    return hits.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("conv_id", "turn", "rk", *names, "score")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of the positive scores, the first of equal ones."""
    at = np.flatnonzero(scores > 0)
    if len(at) > 4 * k:
        least = np.partition(scores[at], -k)[-k]
        at = at[scores[at] >= least - 10.0**-DIGITS]
    return at[np.lexsort((at, -np.round(scores[at], DIGITS)))][:k]


def _ordered(m: pa.Table, names: list[str]) -> pa.Table:
    return m.take(pc.sort_indices(m, sort_keys=[(c, "ascending") for c in ("conv_id", *names)], null_placement="at_start"))


def _ranges(q: pa.Table, m: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(conversation of each query as a number, of each row; first row of each query's conversation, end of its earlier rows); m is ordered."""
    codes = pa.chunked_array([*m["conv_id"].chunks, *q["conv_id"].chunks], m["conv_id"].type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    mine, theirs = codes[len(m) :], codes[: len(m)]
    # codes are given in order of appearance, so those of m ascend
    low, high = np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right")
    turns, earlier = q["turn"].to_numpy(), m[names[0]].to_numpy()
    end = np.array([a + np.searchsorted(earlier[a:b], t, "left") for a, b, t in zip(low, high, turns, strict=True)], np.int64)
    return mine, theirs, low, end


def _result(q: pa.Table, m: pa.Table, names: list[str], hits: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    mine = np.repeat(np.array([i for i, _, _ in hits], np.int64), [len(at) for _, at, _ in hits])
    theirs = np.concatenate([np.zeros(0, np.int64), *(at for _, at, _ in hits)])
    out = [*(q[c].take(pa.array(mine)) for c in ("conv_id", "turn")), *(m[c].take(pa.array(theirs)) for c in names)]
    return pa.table([*out, pa.array(np.concatenate([np.zeros(0), *(s for _, _, s in hits)]))], names=["conv_id", "turn", *names, "score"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term and tf of each entry) of a column of tallies."""
    lists = column.combine_chunks()
    entries = lists.flatten()
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), entries.field("term"), entries.field("tf").to_numpy().astype(float)


def _search_terms(q: pa.Table, m: pa.Table, names: list[str], k: int) -> pa.Table:
    m = _ordered(m, names)
    mine, theirs, low, end = _ranges(q, m, names)
    q_row, q_term, q_tf = _flat(q["tally"])
    m_row, m_term, m_tf = _flat(m["tally"])
    code = pa.concat_arrays([m_term, q_term]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    span = int(code.max(initial=0)) + 1
    key = theirs[m_row] * span + code[: len(m_row)]
    order = np.argsort(key, kind="stable")
    key, m_row, m_tf = key[order], m_row[order], m_tf[order]
    wanted = mine[q_row] * span + code[len(m_row) :]
    first, last = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
    begin = np.searchsorted(q_row, np.arange(len(q) + 1))
    q_size, m_size = q["size"].to_numpy(), m["size"].to_numpy()
    width = end - low
    need = width + np.add.reduceat(np.append(last - first, 0), begin[:-1]) * (np.diff(begin) > 0) if len(q) else width
    hits, at = [], 0
    while at < len(q):
        # as many queries as fit are summed at once
        to = max(at + 1, int(np.searchsorted(np.cumsum(need[at:]), AT_ONCE)) + at)
        base = np.cumsum(width[at:to]) - width[at:to]
        e = slice(begin[at], begin[to])
        n = (last - first)[e]
        place = np.repeat(first[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query = np.repeat(q_row[e], n)
        row = m_row[place]
        early = row < end[query]
        query, row = query[early], row[early]
        dots = np.bincount(base[query - at] + row - low[query], weights=(m_tf[place] * np.repeat(q_tf[e], n))[early], minlength=int(width[at:to].sum()))
        for i in range(at, to):
            dot = dots[base[i - at] : base[i - at] + width[i]]
            if len(dot):
                score = dot / (q_size[i] * np.where(dot > 0, m_size[low[i] : end[i]], 1.0)) if q_size[i] else dot
                best = _best(score, k)
                hits.append((i, low[i] + best, score[best]))
        at = to
    return _result(q, m, names, hits)


def _search_vectors(q: pa.Table, m: pa.Table, names: list[str], k: int) -> pa.Table:
    m = _ordered(m, names)
    _, _, low, end = _ranges(q, m, names)
    unit = lambda t: t["embedding"].combine_chunks()
    ours, held = unit(q), unit(m)
    lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    hits = []
    for i in range(len(q)):
        x = ours[i].values.to_numpy(zero_copy_only=False).astype(float)
        rows = np.arange(low[i], end[i])
        rows = rows[lengths[rows] == len(x)]
        if not len(rows):
            continue
        them = held.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
        size = np.sqrt((x * x).sum()) * np.sqrt((them * them).sum(1))
        score = np.divide(them @ x, size, out=np.zeros(len(rows)), where=size > 0)
        best = _best(score + 2.0, k)  # cosines may be negative
        hits.append((i, rows[best], score[best]))
    return _result(q, m, names, hits)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")


def by_terms(queries: DataFrame, memory: DataFrame, k: int, key: tuple[str, ...]) -> DataFrame:
    """conv_id, turn, rk, m_<key> and score of the k earlier rows with the greatest cosine of term counts; rows without a common term are no hits.

    queries: conv_id, turn, text; memory: conv_id, text and key, turn first.
    """
    names = [f"m_{c}" for c in key]
    queries = _usable(queries).select("conv_id", "turn", "text")
    memory = _usable(memory).select("conv_id", *(F.col(c).alias(f"m_{c}") for c in key), "text")
    places = _placed(queries, memory, F.coalesce(F.length("text"), F.lit(0)) + 1, CHARS)
    tally = term_tally(F.col("text"))
    size = F.sqrt(F.aggregate("tally", F.lit(0).cast("long"), lambda n, x: n + x["tf"] * x["tf"]))
    told = lambda rows: rows.withColumn("tally", tally).withColumn("size", size).drop("text")
    return _searched(told(queries), told(memory), places, names, ["tally", "size"], _search_terms, k)


def by_vectors(queries: DataFrame, memory: DataFrame, k: int, key: tuple[str, ...]) -> DataFrame:
    """As by_terms, by the cosine of vectors in the column embedding; every earlier row is a hit, but rows without a vector and those of another length."""
    names = [f"m_{c}" for c in key]
    there = F.col("embedding").isNotNull()
    queries = _usable(queries).where(there).select("conv_id", "turn", "embedding")
    memory = _usable(memory).where(there).select("conv_id", *(F.col(c).alias(f"m_{c}") for c in key), "embedding")
    places = _placed(queries, memory, F.size("embedding") + 1, NUMBERS)
    return _searched(queries, memory, places, names, ["embedding"], _search_vectors, k)
