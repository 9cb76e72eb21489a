"""Token counts from an exact histogram of encoded lengths.

Each text is encoded once; what travels is only (length, documents). Prefix and
suffix sums over that histogram answer, for every context limit, how many
documents fit, how many tokens they have, and how many tokens remain when every
document is cut at the limit; a quantile is the first length at which enough
documents fit. The sums run in two levels, so no task holds the whole histogram.

Defined results: null and empty texts have length 0; an empty table has an empty
histogram; repeated rows count as often as they are there; texts of any length are
encoded whole; ties do not arise; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths in one range of the two-level sums.
RANGE = 1024


def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            yield pd.Series([len(encode(x)) if x else 0 for x in batch], dtype="int64")

    return count(text)


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs: how many rows of docs encode to so many tokens."""
    return docs.select(token_count(F.col("text"), vocabulary).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def _running(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows of a histogram with upto_X for X in names: sums over all lengths up to the row's."""
    ranged = rows.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    ends = ranged.groupBy("range").agg(*(F.sum(x).alias(x) for x in names))
    before = W.partitionBy(F.lit(1)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in names), *(F.sum(x).over(W.partitionBy(F.lit(1))).alias(f"all_{x}") for x in names))
    within = W.partitionBy("range").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    ranged = ranged.select("*", *(F.sum(x).over(within).alias(f"in_{x}") for x in names)).join(ends, "range")
    return ranged.select(*rows.columns, *((F.col(f"before_{x}") + F.col(f"in_{x}")).alias(f"upto_{x}") for x in names), *(f"all_{x}" for x in names))


def context_limits(lengths: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit: documents and tokens that fit, that do not, and what is left after cutting."""
    sums = _running(lengths.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), ["n_docs", "tokens"])
    longer = F.col("all_n_docs") - F.col("upto_n_docs")
    return sums.select(
        "n_tokens",
        "n_docs",
        F.col("upto_n_docs").alias("docs_within"),
        longer.alias("docs_beyond"),
        F.col("upto_tokens").alias("tokens_within"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("upto_tokens") + F.col("n_tokens") * longer).alias("truncated_tokens"),
        (F.col("upto_n_docs") / F.col("all_n_docs")).alias("share_within"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """total_tokens and truncated_tokens for any limit, from the rows of context_limits: one row, none for an empty table."""
    # up to the largest length within the limit nothing changes but the part that each longer document keeps
    below = F.col("n_tokens") <= limit
    return limits.agg(
        F.max("total_tokens").alias("total_tokens"),
        (F.coalesce(F.max(F.when(below, F.col("tokens_within"))), F.lit(0)) + limit * (F.sum("n_docs") - F.coalesce(F.max(F.when(below, F.col("docs_within"))), F.lit(0)))).alias("truncated_tokens"),
    ).where("total_tokens IS NOT NULL")


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length within which at least that share of the documents lies."""
    asked = F.explode(F.array(*map(F.lit, shares))).alias("share")
    return limits.select("n_tokens", "share_within", asked).where("share_within >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def query(spark, sf_dir: str) -> DataFrame:
    return context_limits(written(histogram(table(spark, sf_dir, "documents"))))
