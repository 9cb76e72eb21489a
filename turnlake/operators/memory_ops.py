"""A log of operations on memory items, folded into their state now and at any time.

An operation is a row: scope (a conversation or user), at and seq (its place in
time; seq tells operations at one time apart), op, mem_id, and as the operation
needs them kind, content, pin, old (the item that mem_id supersedes), turn_ids and
quote (where it comes from). In order of (at, seq):

- ``create`` makes an active item, once for each number;
- ``update`` gives an active item another content, ``pin`` another pin;
- ``supersede`` ends the active item ``old`` in favour of mem_id, another item that
  has been created before;
- ``delete`` ends an item, also one that is superseded already.

What comes without provenance, names an item that is not there yet, or one that has
ended, is refused and changes nothing.

There is no loop over operations: an item begins with its first valid creation and
ends with the first valid end behind it, both least places in time; all else is a
comparison with them. So the fold is made of grouped aggregates, whose parts are
combined before they are shuffled, and of joins with one row for each item, however
many operations a single one has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.sources.shared import drop, written

OPS = ("create", "update", "supersede", "delete", "pin")
COLUMNS = ("scope", "at", "seq", "op", "mem_id", "kind", "content", "pin", "old", "turn_ids", "quote")
ITEM = ["scope", "item"]


def _place() -> Column:
    return F.struct("at", "seq")


def judged(log: DataFrame) -> DataFrame:
    """The log with item (the one that an operation changes), place and verdict: ok, or why it is refused; a written table.

    Operations of one place are taken in order of op and mem_id; operations without
    scope, at or number, and unknown ones, are refused as malformed.
    """
    ties = F.struct("at", "seq", "op", "mem_id", F.coalesce("content", F.lit("")), F.coalesce("pin", F.lit("")))
    rows = log.select(*COLUMNS).withColumn("item", F.when(F.col("op") == "supersede", F.col("old")).otherwise(F.col("mem_id"))).withColumn("place", ties)
    good = F.col("scope").isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull() & F.col("item").isNotNull() & F.col("mem_id").isNotNull() & F.col("op").isin(*OPS)
    sourced = (F.size(F.coalesce("turn_ids", F.array().cast("array<long>"))) > 0) & (F.coalesce("quote", F.lit("")) != "")
    early = F.when(~F.coalesce(good, F.lit(False)), "malformed").when(~sourced, "no provenance").when((F.col("op") == "supersede") & (F.col("mem_id") == F.col("old")), "supersedes itself")
    rows = written(rows.withColumn("early", early))
    open_ = rows.where("early IS NULL")
    created = written(open_.where("op = 'create'").groupBy(*ITEM).agg(F.min("place").alias("created")))
    # a successor has to be there before
    successor = created.select("scope", F.col("item").alias("mem_id"), F.col("created").alias("successor"))
    held = open_.where("op <> 'create'").join(created, ITEM, "left").join(successor, ["scope", "mem_id"], "left")
    there = F.col("created") < F.col("place")
    sound = (F.col("op") != "supersede") | (F.col("successor") < F.col("place"))
    held = written(held.withColumn("there", F.coalesce(there, F.lit(False))).withColumn("sound", F.coalesce(sound, F.lit(False))))
    ends = held.where("there AND sound AND op IN ('supersede', 'delete')").groupBy(*ITEM).agg(F.min("place").alias("ended"), F.min(F.when(F.col("op") == "delete", F.col("place"))).alias("deleted"))
    ends = written(ends)
    later = held.join(ends, ITEM, "left")
    over = F.coalesce(F.when(F.col("op") == "delete", F.col("deleted")).otherwise(F.col("ended")) < F.col("place"), F.lit(False))
    verdict = F.when(~F.col("there"), "no such item").when(~F.col("sound"), "no such successor").when(over, "has ended").otherwise("ok")
    first = open_.where("op = 'create'").join(created, ITEM).withColumn("verdict", F.when(F.col("place") == F.col("created"), "ok").otherwise("exists"))
    out = [*COLUMNS, "item", "place", "verdict"]
    found = rows.where("early IS NOT NULL").withColumn("verdict", F.col("early")).select(*out).unionByName(later.withColumn("verdict", verdict).select(*out)).unionByName(first.select(*out))
    found = written(found)
    drop(rows, created, held, ends)
    return found


def state(judged_: DataFrame) -> DataFrame:
    """scope, mem_id, kind, content, pin, status (active, superseded or deleted), created_at, changed_at, successor and version (how many accepted operations made it) of every item."""
    ok = judged_.where("verdict = 'ok'")
    last = lambda column, *ops: F.max_by(column, F.when(F.col("op").isin(*ops), F.col("place")))
    ended = F.max(F.when(F.col("op") == "supersede", 1).when(F.col("op") == "delete", 2).otherwise(0))
    # repeats of a creation have equal places and are one row
    rows = ok.groupBy(*ITEM).agg(
        F.max_by("kind", F.when(F.col("op") == "create", F.col("place"))).alias("kind"), last("content", "create", "update").alias("content"), last("pin", "pin").alias("pin"), ended.alias("end"),
        F.min("at").alias("created_at"), F.max("at").alias("changed_at"), last("mem_id", "supersede").alias("successor"), F.countDistinct("place").alias("version"),
    )
    status = F.when(F.col("end") == 2, "deleted").when(F.col("end") == 1, "superseded").otherwise("active")
    return rows.select("scope", F.col("item").alias("mem_id"), "kind", "content", "pin", status.alias("status"), "created_at", "changed_at", "successor", "version")


def heads(items: DataFrame) -> DataFrame:
    """items with head: the item that a chain of supersession ends with, the item itself without successor, the least number of a cycle that a chain runs into.

    By pointer jumping: each round every pointer skips as far as it reaches, so a
    chain of n items takes log2(n) rounds. Only superseded items take part.
    """
    links = written(items.where("successor IS NOT NULL").select("scope", F.col("mem_id").alias("at"), F.col("successor").alias("to"), F.col("mem_id").alias("least")))
    n = links.count()
    # whoever has no link is an end
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        ahead = links.select("scope", F.col("at").alias("to"), F.col("to").alias("next"), F.col("least").alias("ahead"))
        jumped = links.join(ahead, ["scope", "to"], "left")
        before, links = links, written(jumped.select("scope", "at", F.coalesce("next", "to").alias("to"), F.least("least", F.coalesce("ahead", "least")).alias("least"), F.col("next").isNotNull().alias("moved")))
        drop(before)
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    # a pointer that still stands on a link stands on a cycle, all of which the least number there has seen
    around = links.select("scope", F.col("at").alias("to"), F.col("least").alias("cycle"))
    ends = links.select("scope", "at", "to").join(around, ["scope", "to"], "left").select("scope", F.col("at").alias("mem_id"), F.coalesce("cycle", "to").alias("_head"))
    return items.join(ends, ["scope", "mem_id"], "left").withColumn("head", F.coalesce("_head", "mem_id")).drop("_head")


def versions(judged_: DataFrame) -> DataFrame:
    """scope, mem_id, content, pin, status, since and until (places in time, null for ever): what each item was from one accepted operation to the next."""
    ok = judged_.where("verdict = 'ok'").dropDuplicates([*ITEM, "place"])
    order = W.partitionBy(*ITEM).orderBy("place")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    last = lambda column, *ops: F.last(F.when(F.col("op").isin(*ops), F.struct(column)), True).over(so_far)[column]
    status = F.when(F.col("op") == "delete", "deleted").when(F.col("op") == "supersede", "superseded").otherwise("active")
    return ok.select(
        "scope", F.col("item").alias("mem_id"), last("content", "create", "update").alias("content"), last("pin", "pin").alias("pin"), status.alias("status"),
        F.struct("at", "seq").alias("since"), F.lead(F.struct("at", "seq")).over(order).alias("until"),
    )


def as_of(versions_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (scope, at) with the items that were there right after all operations at that time: mem_id, content, pin and status.

    Each version is compared with the times asked for in its scope alone; what is returned is what was there.
    """
    times = asked.select("scope", "at").distinct()
    held = versions_.withColumn("_since", F.col("since.at")).withColumn("_until", F.col("until.at"))
    met = times.join(held, "scope").where((F.col("_since") <= F.col("at")) & (F.col("_until").isNull() | (F.col("_until") > F.col("at"))))
    return met.select("scope", "at", "mem_id", "content", "pin", "status")


def quoted(log: DataFrame, turns: DataFrame) -> DataFrame:
    """log with first and last: where its quote stands in the first of its turns that has it (from 0, last excluded); null where none does.

    Blanks of any kind and length count as one, and so do capitals and small
    letters. turns: scope, turn, text. Only the turns that an operation names are read.
    """
    rows = written(log.withColumn("_row", F.monotonically_increasing_id()))
    words = F.split(F.btrim(F.coalesce("quote", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"\s+")
    literal = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")), r"\s+")
    each = rows.select("_row", "scope", literal.alias("_quote"), F.explode("turn_ids").alias("turn")).where("_quote <> ''")
    met = each.join(turns.select("scope", "turn", "text"), ["scope", "turn"])
    pattern = F.concat(F.lit("(?iu)"), F.col("_quote"))
    found = met.withColumn("_at", F.regexp_instr("text", pattern)).where(F.col("_at") > 0)
    span = found.select("_row", "turn", (F.col("_at") - 1).alias("first"), (F.col("_at") - 1 + F.length(F.regexp_substr("text", pattern))).alias("last"))
    best = span.groupBy("_row").agg(F.min(F.struct("turn", "first", "last")).alias("_span"))
    return rows.join(best, "_row", "left").select(*log.columns, F.col("_span.turn").alias("quote_turn"), F.col("_span.first").alias("first"), F.col("_span.last").alias("last"))
