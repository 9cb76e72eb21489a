"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.sources.shared import drop, written

__all__ = ["drop", "written", "let", "slices", "small", "table", "tidy", "unused", "word_count", "words"]

#: Word separators of the quality, mixing and similarity contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A side with at most this many rows may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000
#: Characters or bytes of text that a task works on at once.
SLICE = 1 << 21
#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a side that Spark broadcasts unasked: by the size of its files, and by what a shuffle of it has been seen to hold.
GUESSED, SEEN = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files and broadcasts only what has been counted or measured.

    Shuffle files go when a step ends, not when the driver happens to collect its
    garbage. Files of numbers are a small part of what they hold in the driver's
    memory, so their size alone lets no side be broadcast.
    """
    own = {key: spark.conf.get(key, None) for key in (CLEANUP, GUESSED, SEEN)}
    for key, value in ((CLEANUP, "true"), (SEEN, own[SEEN] or spark.conf.get(GUESSED)), (GUESSED, "-1")):
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in own.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to hold few rows, else with one against it, however small its files are; df should be a written table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def slices(batch: pd.DataFrame, column: str = "text", size: int = SLICE) -> Iterator[pd.DataFrame]:
    """A batch in parts of about so many characters or bytes of a column, one row at least: what is made of a part is all that a task holds beside the batch."""
    total = np.cumsum(np.fromiter((len(x) if x is not None else 0 for x in batch[column]), np.int64, len(batch)))
    bounds = sorted({0, *(np.flatnonzero(np.diff(total // size, prepend=0)) + 1).tolist(), len(batch)})
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        yield batch.iloc[lo:hi]


def words(text: Column) -> Column:
    """The words of SPACE-separated text as an array; null and blank text have none."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(F.coalesce(bare, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), 0)
