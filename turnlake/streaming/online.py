"""Replay turn by turn: what was known before each turn, given out as turns arrive.

A conversation's turns may come in any order and more than once. Those that came
before their turn wait until the gap is filled, or until the conversation has been
silent for longer than a given patience; then they go on in order without the missing
ones. What is kept for a conversation is its last turns and those that wait, so
state grows with open conversations and not with their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = "turn bigint, role string, text string, recent array<struct<role:string,text:string>>, asked string"


def advance(state: dict, rows: list[tuple[int, str | None, str | None]], n: int, flush: bool = False) -> list[tuple]:
    """The turns whose time has come as (turn, role, text, recent, asked), with state moved on.

    state: next, the number of the turn that is waited for; tail, the last turns as
    (role, text); waiting, later turns by number. A turn that is repeated, or whose
    place has been passed, is left out; of two texts for one turn the first counts.
    """
    for turn, role, text in rows:
        if turn >= state["next"]:
            state["waiting"].setdefault(str(turn), [role, text])
    out = []
    for turn in sorted(map(int, state["waiting"])):
        if turn != state["next"] and not flush:
            break
        role, text = state["waiting"].pop(str(turn))
        before = state["tail"][-1] if state["tail"] else [None, None]
        asked = before[1] if role == "assistant" and text and before[0] == "user" else None
        # a replay stores all that is not the user's as the assistant's
        recent = [{"role": r if r == "user" else "assistant", "text": t} for r, t in state["tail"][-n:]]
        out.append((turn, role, text, recent, asked))
        state["tail"] = [*state["tail"], [role, text]][-n:]
        state["next"] = turn + 1
    return out


def replayed(turns: DataFrame, n: int = 4, patience: int | None = None) -> DataFrame:
    """conv_id, turn, role, text, recent (the n turns before, oldest first) and asked (the user's text if this turn answers one), each turn of a stream once.

    n is 1 at least, patience in milliseconds; without it turns behind a gap wait for
    ever, with it the stream runs batches without data to look for gaps to give up, so
    a trigger that ends when all is read never does. Rows without conv_id or turn are
    left out.
    """
    if n < 1:
        raise ValueError("a stream keeps a bounded number of recent turns")

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {"next": 0, "tail": [], "waiting": {}}
        rows = [r for b in batches for r in b[["turn", "role", "text"]].astype(object).where(b[["turn", "role", "text"]].notna(), None).itertuples(index=False, name=None)]
        out = advance(state, rows, n, flush=held.hasTimedOut)
        held.update((json.dumps(state),))
        if state["waiting"] and patience:
            held.setTimeoutDuration(patience)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["conv_id", "turn", "role", "text", "recent", "asked"])

    turns = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {FIELDS}"
    return turns.groupBy("conv_id").applyInPandasWithState(step, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout)


def replay_stream(turns: DataFrame, out: str, checkpoint: str, n: int = 4, patience: int | None = None, trigger: dict | None = None):
    """Starts the query that writes replayed turns below out; started again with its checkpoint, it goes on where it was."""
    rows = replayed(turns, n, patience).writeStream.format("parquet").outputMode("append")
    return rows.option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
