"""Scores of replies: a judge's JSON answer, parsed strictly."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.text import terms
from turnlake.operators.prompting import message

#: Fixed message of an answer that cannot be read, followed by its first 200 characters.
UNREADABLE = "Failed to parse judge response: "


RUBRIC = """Compare a reply with the reply that was really given and score from 1 to 5 how much of its content it has; wording does not matter.

5: all that matters is there. 4: most of it, a detail is missing. 3: part of it, something important is missing. 2: little, most is different. 1: nothing, or the contrary.

Answer in JSON and nothing else: {"score": <1 to 5>, "reasoning": "<one or two sentences>"}"""


def question(user_text: Column, expected: Column, reply: Column) -> Column:
    """Messages (role, content) that ask a judge: the rubric, then the user's message, the reply given and the reply to score."""
    parts = F.concat(F.lit("User message:\n"), user_text, F.lit("\n\nReply that was given:\n"), expected, F.lit("\n\nReply to score:\n"), reply)
    return F.array(message("system", F.lit(RUBRIC)), message("user", parts))


def _read(answer: str | None) -> tuple[int, str]:
    answer = answer or ""
    try:
        data = json.loads(answer)
        score = int(data.get("score", 1))
        return max(1, min(5, score)), str(data.get("reasoning", ""))
    except (ValueError, TypeError, AttributeError, OverflowError, RecursionError):
        return 1, UNREADABLE + answer[:200]


def parsed(answer: Column) -> Column:
    """(score 1 to 5, reasoning) of an answer in strict JSON; without a score 1, and 1 too if it cannot be read."""

    @F.pandas_udf("score int, reasoning string")
    def read(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(a) for a in answers], columns=["score", "reasoning"])

    return read(answer)


def overlap_answer(reply: Column, expected: Column) -> Column:
    """The default judge: JSON with a score by the share of the expected reply's distinct terms that the reply has."""
    want, have = F.array_distinct(terms(expected)), F.array_distinct(terms(reply))
    share = F.when(F.size(want) > 0, F.size(F.array_intersect(want, have)) / F.size(want)).otherwise(0.0)
    score = F.when(share >= 0.8, 5).when(share >= 0.6, 4).when(share >= 0.4, 3).when(share >= 0.2, 2).otherwise(1)
    return F.to_json(F.struct(score.alias("score"), F.lit("term overlap").alias("reasoning")))
