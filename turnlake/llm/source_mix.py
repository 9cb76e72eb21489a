"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source the rows lie in key order;
prefix sums of their sizes come from two levels (sums of key ranges, then rows
within a range), and one key per source marks where its budget ends. Which rows
are taken then follows from comparing keys, so a source of any size is spread
over all tasks and no text is shuffled.

Defined results: null text has size 0; null source is a source of its own and
comes last; rows of equal doc_id share their key and are cut together, as are rows
without doc_id that have the same text; texts of any length count whole; empty
input gives an empty result; further columns are ignored by mix() and stay in
mixed_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, table, unused, word_count, written

#: Highest number of times that a document may be taken.
MAX_EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)


def random_key(doc_id: Column, text: Column) -> Column:
    """A hash of the number; without one, of the text's."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds target to one row for each source: its weighted share, no more than max_epochs times its size.

    With caps c and weights w in order of c/w, the sources up to some point are
    full and the rest share what is left by weight; that point is the first at
    which the share of the next source does not exceed its cap.
    """
    everything = W.partitionBy(F.lit(1))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_ratio = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    return (
        sizes.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.row_number().over(by_ratio).alias("at"), "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def source_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target, epochs taken whole, and cut_key, up to which rows are taken once more.

    sized has doc_id, source, size and key, and should be a written table.
    """
    ranges = max(1, round(sized.count() ** 0.5))
    sized = sized.withColumn("range", _range(F.col("key"), F.lit(ranges)))
    targets = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    hidden = targets.select(F.col("source").alias("s"), "rest")
    starts = (
        sized.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(small(hidden), F.col("source").eqNullSafe(F.col("s")))
        # a range wholly before or behind the cut needs no order of its rows
        .where("start <= rest")
        .select(F.col("source").alias("s"), F.col("range").alias("r"), "start", "range_size", "rest")
    )
    starts = written(starts)
    whole = starts.where("start + range_size <= rest").groupBy("s").agg(F.max("r").alias("r"))
    inner = W.partitionBy("source", "range").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)
    tied = W.partitionBy("source", "range", "key")
    at_cut = starts.where("start + range_size > rest")
    cut = (
        sized.join(small(at_cut), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("own", F.sum("size").over(tied))
        .withColumn("before", F.col("start") + F.sum("size").over(inner) - F.col("own"))
        .where("before + own / 2 <= rest")
        .groupBy("source").agg(F.max("key").alias("inside"))
        .select(F.col("source").alias("s"), "inside")
    )
    plan = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.s")), "left").drop("s")
    plan = plan.join(whole.withColumnRenamed("r", "whole_range"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return written(plan.withColumn("ranges", F.lit(ranges)).select("source", "source_size", "target", "epochs", "whole_range", "ranges", "inside"))


def _range(key: Column, ranges: Column) -> Column:
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32))


def _with_times(rows: DataFrame, key: Column, plan: DataFrame, max_epochs: int, size: str, target: str, times: str) -> DataFrame:
    """rows with source_size, target and times (whole epochs, and once more inside the cut) of their source's plan, under the names given."""
    own = dict(zip(plan.columns, unused(rows, *(f"plan_{c}" for c in plan.columns)), strict=True))
    found = rows.join(small(plan.select(*(F.col(c).alias(name) for c, name in own.items()))), F.col("source").eqNullSafe(F.col(own["source"])))
    inside = F.coalesce(key <= F.col(own["inside"]), F.lit(False)) | F.coalesce(_range(key, F.col(own["ranges"])) <= F.col(own["whole_range"]), F.lit(False))
    taken = F.least(F.lit(max_epochs), F.col(own["epochs"]) + inside.cast("int")).cast("int")
    return found.select(*rows.columns, F.col(own["source_size"]).alias(size), F.col(own["target"]).alias(target), taken.alias(times))


def _sized(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target and times for each row of docs (doc_id, text, source)."""
    sized = _sized(docs)
    rows = _with_times(sized, F.col("key"), source_plan(sized, weights, max_epochs), max_epochs, "source_size", "target", "times")
    return rows.select("doc_id", "source", "size", "source_size", "target", "times")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs itself, each row as often as the mix takes it; the texts stay where they are read."""
    size, target, times, copy = unused(docs, "size", "target", "times", "copy")
    rows = _with_times(docs, random_key(F.col("doc_id"), F.col("text")), source_plan(_sized(docs), weights, max_epochs), max_epochs, size, target, times)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS pos, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
  / (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM o WHERE level <= ratio ORDER BY pos LIMIT 1)) AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY d.source, k) AS before, sum(size) OVER (PARTITION BY d.source, k) AS own
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * least(3, epochs + CASE WHEN before + own / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
