"""What goes into a prompt under hard budgets of tokens, chosen greedily in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnlake.functions.text import let


@dataclass(frozen=True)
class Budgets:
    """Tokens at most for recent turns, for the header of memory items and for verbatim snippets."""

    recent: int = 4500
    header: int = 1200
    snippets: int = 800


def greedy(items: Column, budget: int) -> Column:
    """The items (structs with n, their tokens) that fit, in their order: one that does not fit is left out and the next ones are tried.

    No sum over what stands before can tell this, as what is left out counts for
    nothing; so it is a fold. Its state, which is copied at every step, keeps the
    places of the chosen alone. Items without n are left out; null items choose none.
    """
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fits = F.coalesce(s["used"] + x["n"] <= budget, F.lit(False))
        return F.struct(
            F.when(fits, F.concat(s["kept"], F.array(s["at"]))).otherwise(s["kept"]).alias("kept"),
            F.when(fits, s["used"] + x["n"]).otherwise(s["used"]).cast("long").alias("used"), (s["at"] + 1).alias("at"),
        )

    def chosen(all_: Column) -> Column:
        return F.transform(F.aggregate(all_, start, step, lambda s: s["kept"]), lambda at: F.get(all_, at))

    return let(items, lambda all_: F.when(all_.isNotNull(), chosen(all_)))


def tokens(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + x["n"])


def context(header: Column, recent: Column, snippets: Column, budgets: Budgets = Budgets()) -> Column:
    """header, recent and snippets of a prompt, in this order, each within its budget.

    All three are arrays of structs with n and text. header and snippets come best
    first and stay so; recent comes oldest first, is chosen newest first, so that
    what is near stays, and is given oldest first again.
    """
    empty = lambda x: F.coalesce(x, F.slice(x, 1, 0))
    return F.struct(
        empty(greedy(header, budgets.header)).alias("header"),
        F.reverse(greedy(F.reverse(recent), budgets.recent)).alias("recent"),
        empty(greedy(snippets, budgets.snippets)).alias("snippets"),
    )
