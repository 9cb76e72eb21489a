"""Decaying energy of items under accesses, and the tier that it puts them in.

An access adds its weight to an item's energy, which halves with every half-life.
Right after an access at t the energy is the sum of weight x 0.5^((t - at) /
half-life) over all accesses until t. As prefix sums need exponents that grow with
the span, time is cut into epochs of EPOCH half-lives: sums run within an epoch,
whose exponents stay small, and what earlier epochs left is carried on by their
totals. So spans may be as long as they like, and an item with very many accesses is
as many groups as it has epochs.

Tiers have two thresholds each, so that energy that hovers around one does not
change them to and fro: an item gets hot at HOT and stays so until it falls below
HOT - MARGIN; it gets cold below COLD and stays so until it reaches COLD + MARGIN;
it is warm between. Energy is highest right after an access and lowest right before
one, so the tier now follows from when it last was beyond each threshold: greatest
places in time, no automaton.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Thresholds, how far energy has to move back, and how many items of a scope may be hot.
HOT, COLD, MARGIN, CAP = 0.75, 0.25, 0.1, 20
#: Half-lives of an epoch, and epochs whose rest is carried on: what is older is below 2^-128 of its weight.
EPOCH, CARRIED = 32, 4
#: Digits of energy that are compared.
DIGITS = 9

ITEM = ["scope", "item"]


def energies(accesses: DataFrame, half_life: float) -> DataFrame:
    """scope, item, at, before and after: the energy right before and right after the accesses at a time, which count together.

    accesses: scope, item, at (a number), weight; rows with a null take no part.
    """
    rows = accesses.select(*ITEM, F.col("at").cast("double").alias("at"), F.col("weight").cast("double").alias("weight")).dropna()
    rows = rows.groupBy(*ITEM, "at").agg(F.sum("weight").alias("weight"))
    span = half_life * EPOCH
    # energy at the start of the epoch, as if all its accesses had been then
    rows = rows.withColumn("epoch", F.floor(F.col("at") / span)).withColumn("past", (F.col("at") - F.col("epoch") * span) / half_life)
    rows = rows.withColumn("raised", F.col("weight") * F.pow(F.lit(2.0), F.col("past")))
    totals = rows.groupBy(*ITEM, "epoch").agg(F.sum("raised").alias("total"))
    order = W.partitionBy(*ITEM).orderBy("epoch").rangeBetween(-CARRIED, -1)
    earlier = F.collect_list(F.struct("epoch", "total")).over(order)
    rest = F.aggregate(earlier, F.lit(0.0), lambda s, x: s + x["total"] * F.pow(F.lit(2.0), (x["epoch"] - F.col("epoch")) * float(EPOCH)))
    rows = rows.join(totals.select(*ITEM, "epoch", rest.alias("rest")), [*ITEM, "epoch"])
    so_far = F.sum("raised").over(W.partitionBy(*ITEM, "epoch").orderBy("at").rowsBetween(W.unboundedPreceding, 0)) + F.col("rest")
    after = so_far * F.pow(F.lit(2.0), -F.col("past"))
    return rows.select(*ITEM, "at", after.alias("after"), F.greatest(F.lit(0.0), after - F.col("weight")).alias("before"))


def _last(energy: Column, hit, place: Column) -> Column:
    return F.max(F.when(hit(F.round(energy, DIGITS)), place))


def tiers(accesses: DataFrame, half_life: float, now: float, cap: int = CAP) -> DataFrame:
    """scope, item, energy at now, n_accesses (distinct times) and tier: HOT, WARM or COLD; later accesses take no part.

    Of the hot items of a scope the cap ones with most energy stay hot, of equal ones the smaller; the others are warm.
    """
    rows = energies(accesses.where(F.col("at") <= now), half_life)
    # places in time: before an access, after it; items begin cold
    points = F.array(F.struct(F.col("at"), F.lit(0).alias("k"), F.col("before").alias("e")), F.struct(F.col("at"), F.lit(1).alias("k"), F.col("after").alias("e")))
    each = rows.select(*ITEM, F.explode(points).alias("p")).select(*ITEM, "p.at", "p.k", "p.e")
    place = F.struct("at", "k")
    found = each.groupBy(*ITEM).agg(
        F.max_by("e", place).alias("e"), F.max("at").alias("at"), F.countDistinct("at").alias("n_accesses"),
        _last(F.col("e"), lambda e: e >= HOT, place).alias("hot"), _last(F.col("e"), lambda e: e < HOT - MARGIN, place).alias("not_hot"),
        _last(F.col("e"), lambda e: e < COLD, place).alias("cold"), _last(F.col("e"), lambda e: e >= COLD + MARGIN, place).alias("not_cold"),
    )
    energy = F.round(F.col("e") * F.pow(F.lit(2.0), (F.col("at") - now) / half_life), DIGITS)
    later = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    # now comes after all accesses
    hot = F.when(energy >= HOT, True).when(energy < HOT - MARGIN, False).otherwise(later("hot", "not_hot"))
    cold = F.when(energy < COLD, True).when(energy >= COLD + MARGIN, False).otherwise(~later("not_cold", "cold"))
    found = found.select(*ITEM, energy.alias("energy"), "n_accesses", hot.alias("hot"), cold.alias("cold"))
    rank = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("energy"), "item"))
    best = found.where("hot").withColumn("rank", rank).where(F.col("rank") <= cap).select(*ITEM, F.lit(True).alias("kept"))
    tier = F.when(F.col("hot"), F.when(F.col("kept"), "HOT").otherwise("WARM")).when(F.col("cold"), "COLD").otherwise("WARM")
    return found.join(best, ITEM, "left").select(*ITEM, "energy", "n_accesses", tier.alias("tier"))
