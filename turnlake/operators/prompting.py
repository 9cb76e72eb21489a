"""Prompts from retrieved memory, and replies to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INSTRUCTIONS = "Answer the user. Earlier parts of the conversation may be given as memory; use what is relevant in them and do not speak of the memory itself."
#: Fixed format of the memory block.
MEMORY_HEAD, MEMORY_LINE = "Relevant memory context:\n", "[Memory %d]: %s"


def message(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def memory_block(hits: Column) -> Column:
    """hits: array of texts, the best first."""
    lines = F.transform(hits, lambda t, i: F.format_string(MEMORY_LINE, i + 1, t))
    return F.concat(F.lit(MEMORY_HEAD), F.array_join(lines, "\n"))


def prompt(user_text: Column, hits: Column, recent: Column, instructions: str = INSTRUCTIONS) -> Column:
    """Messages (role, content): instructions, memory if there are hits, recent turns (role, text), the user's turn."""
    none = F.array().cast("array<struct<role:string,content:string>>")
    hits, recent = F.coalesce(hits, F.array().cast("array<string>")), F.coalesce(recent, F.array().cast("array<struct<role:string,text:string>>"))
    memory = F.when(F.size(hits) > 0, F.array(message("system", memory_block(hits)))).otherwise(none)
    past = F.transform(recent, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    return F.concat(F.array(message("system", F.lit(instructions))), memory, past, F.array(message("user", user_text)))


def extractive_reply(hits: Column, recent: Column) -> Column:
    """The default responder: the best hit, else the last recent turn, else nothing."""
    return F.coalesce(F.get(hits, 0), F.get(recent, F.size(recent) - 1)["text"], F.lit(""))


#: Builds a model's client, once for each task: a function from messages (role, content) to an answer.
Client = Callable[[], Callable[[list[dict]], str]]


def answered(messages: Column, client: Client) -> Column:
    """A model's answers to messages, stripped. They may differ from call to call, so what is made of them should be written once."""

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()
        for batch in batches:
            yield pd.Series([(ask([x if isinstance(x, dict) else x.asDict() for x in m]) or "").strip() for m in batch], dtype=object)

    return answers.asNondeterministic()(messages)
