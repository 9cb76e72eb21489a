"""Command line: evaluate retrieval over a folder of transcript exports."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from turnlake.operators import replay
from turnlake.plans import evaluation
from turnlake.schemas import ChunkerConfig, EvalConfig, RetrievalConfig
from turnlake.sources.shared import written
from turnlake.sources.transcripts import load_directory


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="turnlake", description=__doc__)
    p.add_argument("--conversation-dir", required=True)
    p.add_argument("--judge-model", default="overlap", help="overlap of terms, or module:function that builds a client")
    p.add_argument("--responder-model", default="extractive", help="the best hit, or module:function that builds a client")
    p.add_argument("--encoder", help="module:function that builds an encoder, and its vectors' size behind another colon; else terms are compared")
    p.add_argument("--results-dir", default="./eval_results")
    p.add_argument("--max-conversations", type=int)
    p.add_argument("--recent-window", type=int, default=4)
    p.add_argument("--min-tokens", type=int, default=120)
    p.add_argument("--max-tokens", type=int, default=250)
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--ef-search", type=int, default=50)
    p.add_argument("--sweep", action="store_true")
    return p.parse_args(argv)


def built(name: str) -> Callable:
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("turnlake").getOrCreate()
    turns = load_directory(spark, a.conversation_dir)
    if turns.isEmpty():
        print(f"There are no turns in {a.conversation_dir}.")
        return 1
    turns = replay.first_conversations(turns, a.max_conversations, "filename").withColumnRenamed("filename", "conv_id")
    config = EvalConfig(ChunkerConfig(a.min_tokens, a.max_tokens), RetrievalConfig(a.k, a.ef_search), a.conversation_dir, a.results_dir, a.responder_model, a.judge_model, a.max_conversations, a.recent_window)
    models = {
        "encoder": (built(a.encoder.rpartition(":")[0]), int(a.encoder.rpartition(":")[2])) if a.encoder else None,
        "responder": None if a.responder_model == "extractive" else built(a.responder_model),
        "judge": None if a.judge_model == "overlap" else built(a.judge_model),
    }
    if a.sweep:
        board = written(evaluation.run_sweep(turns, evaluation.sweep_configs(config), **models))
        print(evaluation.report(board))
        print(f"The sweep is in {evaluation.save_sweep(board, a.results_dir)}")
        return 0
    results, conversations, run = evaluation.run_eval(turns, config, **models)
    for line in evaluation.summary(conversations, run, config):
        print(line)
    print(f"The run is in {evaluation.save_run(results, conversations, run, config, a.results_dir)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
