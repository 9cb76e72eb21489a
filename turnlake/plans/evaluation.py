"""Evaluation of retrieval by replay, for one configuration or a grid of them.

A grid shares its work: chunks depend on max_tokens alone, a ranking to the greatest
k contains those to smaller ones, the default reply is the best hit whatever k is, and
a conversation whose turns all fit into one chunk each is replayed once for that
max_tokens and all greater ones. Under exact search min_tokens and
ef_search change nothing, so their runs repeat the results of others.

Encoder, responder and judge are parameters. Without an encoder retrieval compares
terms; without a responder the best hit is the reply; without a judge the overlap
of terms is the score. Answers of models are written before anything is made of
them, so that each turn is asked once.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import asdict, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.operators import chunking, judging, metrics, prompting, replay, retrieval
from turnlake.operators.prompting import Client
from turnlake.schemas import ChunkerConfig, EvalConfig, RetrievalConfig
from turnlake.sources.shared import written

#: Default grids, fixed values.
CHUNKER_GRID = {"min_tokens": [80, 120, 180], "max_tokens": [200, 300, 400]}
RETRIEVAL_GRID = {"k": [5, 10, 15], "ef_search": [50, 100]}


def sweep_configs(base: EvalConfig = EvalConfig(), chunker_grid: dict | None = None, retrieval_grid: dict | None = None) -> list[EvalConfig]:
    """base with all combinations in this order, without those whose min_tokens reaches max_tokens.

    No grid or an empty one means the default grid; a key that a grid lacks keeps the usual value.
    """
    chunker, retrieval = chunker_grid or CHUNKER_GRID, retrieval_grid or RETRIEVAL_GRID
    usual = (ChunkerConfig(), RetrievalConfig())
    grids = [chunker.get(x, [getattr(usual[0], x)]) for x in ("min_tokens", "max_tokens")] + [retrieval.get(x, [getattr(usual[1], x)]) for x in ("k", "ef_search")]
    return [replace(base, chunker=ChunkerConfig(lo, hi), retrieval=RetrievalConfig(n, ef)) for lo, hi, n, ef in itertools.product(*grids) if lo < hi]


def config_table(spark: SparkSession, configs: list[EvalConfig]) -> DataFrame:
    rows = [(i, c.chunker.min_tokens, c.chunker.max_tokens, c.retrieval.k, c.retrieval.ef_search) for i, c in enumerate(configs)]
    return spark.createDataFrame(rows, "config_idx int, min_tokens int, max_tokens int, k int, ef_search int")


def _chunks(turns: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of the turns as a replay stores them; written, as terms, vectors and texts of the hits are all made of it."""
    return written(chunking.chunk(replay.ingested(turns), ChunkerConfig(0, max_tokens)))


def _cut(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """conv_id of the conversations that greater chunks may change.

    A turn that is one chunk within the limit has no sentence beyond it, so it is
    the same chunk under any greater limit.
    """
    return written(chunks.where((F.col("pos") > 0) | (F.col("token_count") > max_tokens)).select("conv_id").distinct())


def scored_replay(turns: DataFrame, max_tokens: int, ks: list[int], recent_window: int = 4, encoder=None, responder: Client | None = None, judge: Client | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """k, conv_id, turn, user_text, expected, reply, retrieved, score and reasoning of every scored turn for each k.

    encoder: (function that builds an encoder of texts, vector size), as Memory takes it.
    chunks: what _chunks() gives, if it is there already.
    """
    asked = replay.scored_turns(turns)
    chunks = _chunks(turns, max_tokens) if chunks is None else chunks
    if encoder:
        # written, so that each text is encoded once
        vectors = written(retrieval.embed(asked, *encoder, text="user_text")), written(retrieval.embed(chunks, *encoder))
        hits = replay.prior_vectors(*vectors, max(ks), ("turn", "pos"))
    else:
        hits = replay.prior_retrieval(asked, chunks, max(ks), ("turn", "pos"))
    texts = chunks.select("conv_id", F.col("turn").alias("m_turn"), F.col("pos").alias("m_pos"), F.col("text").alias("chunk"))
    found = hits.join(texts, ["conv_id", "m_turn", "m_pos"]).groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "chunk"))), lambda x: x["chunk"]).alias("hits"))
    rows = asked.join(found, ["conv_id", "turn"], "left").join(replay.recent_window(turns, recent_window), ["conv_id", "turn"])
    each_k = lambda rows: rows.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("hits", F.slice(F.coalesce("hits", F.array().cast("array<string>")), F.lit(1), F.col("k")))
    # the default reply is the best hit, which every k has
    at_once = not responder and not judge and min(ks) > 0
    rows = rows if at_once else each_k(rows)
    if responder:
        rows = written(rows.withColumn("reply_text", prompting.answered(prompting.prompt(F.col("user_text"), F.col("hits"), F.col("recent")), responder)))
    else:
        rows = rows.withColumn("reply_text", prompting.extractive_reply(F.col("hits"), F.col("recent")))
    if judge:
        rows = written(rows.withColumn("answer", prompting.answered(judging.question(F.col("user_text"), F.col("reply"), F.col("reply_text")), judge)))
    else:
        rows = rows.withColumn("answer", judging.overlap_answer(F.col("reply_text"), F.col("reply")))
    judged = rows.withColumn("j", judging.parsed(F.col("answer")))
    judged = each_k(judged) if at_once else judged
    user, kept = replay.truncated(F.col("user_text"), F.col("hits"))
    return judged.select("k", "conv_id", "turn", user.alias("user_text"), F.substring("reply", 1, 500).alias("expected"), F.substring("reply_text", 1, 500).alias("reply"), kept.alias("retrieved"), "j.score", "j.reasoning")


def run_eval(turns: DataFrame, config: EvalConfig = EvalConfig(), encoder=None, responder: Client | None = None, judge: Client | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turn results, conversation results, the run's metrics) of one configuration; the turn results are written once."""
    turns = replay.first_conversations(turns, config.max_conversations)
    results = written(scored_replay(turns, config.chunker.max_tokens, [config.retrieval.k], config.recent_window, encoder, responder, judge).drop("k"))
    return results, metrics.conversation_scores(turns, results), metrics.run_metrics(results)


def run_sweep(turns: DataFrame, configs: list[EvalConfig], encoder=None, responder: Client | None = None, judge: Client | None = None) -> DataFrame:
    """A row for each configuration in order of its mean score; the first of equal ones is best."""
    spark = turns.sparkSession
    if len({(c.recent_window, c.max_conversations) for c in configs}) > 1:
        raise ValueError("the configurations of a sweep differ in chunker and retrieval alone, not in recent_window or max_conversations")
    if configs:
        turns = replay.first_conversations(turns, configs[0].max_conversations)
    ks = {}
    for c in configs:
        ks.setdefault(c.chunker.max_tokens, set()).add(c.retrieval.k)
    window = configs[0].recent_window if configs else 4
    runs, limits = None, sorted(ks)
    # a model's answers are asked for in every run, and runs with other k are no repetitions
    shared = not (encoder or responder or judge) and len({frozenset(x) for x in ks.values()}) == 1
    for i, max_tokens in enumerate(limits):
        chunks, later = _chunks(turns, max_tokens), limits[i + 1 :] if shared else []
        scores = scored_replay(turns, max_tokens, sorted(ks[max_tokens]), window, encoder, responder, judge, chunks)
        if later:
            cut = _cut(chunks, max_tokens)
            scores = scores.select("conv_id", "k", "score").join(cut.select("conv_id", F.lit(True).alias("cut")), "conv_id", "left")
            same = F.array(*map(F.lit, [max_tokens, *later]))
            scores = scores.withColumn("max_tokens", F.explode(F.when(F.col("cut"), F.array(F.lit(max_tokens))).otherwise(same)))
            turns = written(turns.join(cut, "conv_id", "left_semi"))
        else:
            scores = scores.withColumn("max_tokens", F.lit(max_tokens))
        scores = scores.select("max_tokens", "k", "score")
        runs = scores if runs is None else runs.unionByName(scores)
    table = config_table(spark, configs)
    if runs is None:
        return leaderboard(table.select("*", F.lit(0).cast("long").alias("n_scored"), F.lit(0.0).alias("mean_score"), F.lit(0.0).alias("recall_at_4")))
    measured = table.join(metrics.run_metrics(runs, ["max_tokens", "k"]), ["max_tokens", "k"], "left")
    return leaderboard(measured.fillna(0, ["n_scored"]).fillna(0.0, ["mean_score", "recall_at_4"]))


def leaderboard(runs: DataFrame) -> DataFrame:
    """runs with place and is_best, true for every run that is as the first."""
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("mean_score"), "config_idx")
    placed = runs.withColumn("place", F.row_number().over(order))
    first = W.partitionBy(F.lit(1)).orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    same = F.struct("min_tokens", "max_tokens", "k", "ef_search")
    return placed.withColumn("is_best", same == F.first(same).over(first))


def save_run(results: DataFrame, conversations: DataFrame, run: DataFrame, config: EvalConfig, folder: str) -> str:
    """Writes the run as JSON lines below a folder named by its configuration and time; returns the folder.

    The first line has the configuration and the run's metrics; then comes a line
    for each conversation with its scores and the results of all its scored turns.
    """
    c, r = config.chunker, config.retrieval
    now = datetime.now(timezone.utc)
    path = f"{folder.rstrip('/')}/eval_{c.min_tokens}-{c.max_tokens}_k{r.k}_ef{r.ef_search}_{now:%Y%m%d_%H%M%S}.json"
    settings = json.dumps(asdict(config))
    own = [x for x in results.columns if x != "conv_id"]
    each = results.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", *(x for x in own if x != "turn")))).alias("turn_results"))
    each = conversations.join(each, "conv_id", "left")
    whole = run.select(F.lit(None).cast("string").alias("conv_id"), F.lit(settings).alias("config"), F.to_json(F.struct(*run.columns, F.lit(now.isoformat()).alias("run_timestamp"))).alias("result"))
    lines = each.select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(settings).alias("config"), F.to_json(F.struct(*each.columns)).alias("result"))
    whole.unionByName(lines).write.json(path)
    return path


def save_sweep(board: DataFrame, folder: str) -> str:
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/sweep_{stamp}.json"
    board.coalesce(1).write.json(path)
    return path


def summary(conversations: DataFrame, run: DataFrame, config: EvalConfig, name: str = "conv_id") -> Iterator[str]:
    """Lines on a run: its configuration and metrics, then a line for each conversation, handed on as they are read."""
    c, r = config.chunker, config.retrieval
    yield f"Chunks of {c.min_tokens} to {c.max_tokens} tokens, k {r.k}, ef {r.ef_search}"
    for row in run.collect():  # one row
        yield f"Mean score {row['mean_score']:.2f}, recall@4 {row['recall_at_4']:.1%}, {row['n_scored']} turns scored"
    for row in conversations.orderBy(name).toLocalIterator():
        yield f"  {row[name]}: {row['mean_score']:.2f} ({row['n_scored']} of {row['num_turns']} turns scored)"


def report(board: DataFrame) -> str:
    """The leaderboard as text; * marks every run that equals the best one, which the last line names."""
    rows = board.orderBy("place").collect()  # one row for each configuration
    if not rows:
        return "Nothing was run."
    lines = ["place  chunk      k   ef  mean  recall@4"]
    for r in rows:
        star = " *" if r["is_best"] else ""
        lines.append(f"{r['place']:>5}  {r['min_tokens']}-{r['max_tokens']:<6} {r['k']:>3} {r['ef_search']:>4}  {r['mean_score']:.2f}  {r['recall_at_4']:.1%}{star}")
    best = rows[0]
    return "\n".join([*lines, f"Best: chunks of {best['min_tokens']} to {best['max_tokens']} tokens, k {best['k']}, ef {best['ef_search']}"])
