"""Turns into token-bounded chunks with source offsets, as column expressions.

Sentences that are too long are cut at "; ", else at ", ", else between words;
then neighbours are packed greedily. All of it happens within a row: no shuffle,
whatever the length of a conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.text import let, sentences, strip, token_count
from turnlake.schemas import ChunkerConfig

Counter = Callable[[Column], Column]
#: Characters of a text that are at hand when parts are looked for.
NEAR = 4096


def packed(items: Column, sizes: Column, limit: Column, body: Callable[[Column], Column]) -> Column:
    """body of each group of neighbouring items, packed greedily while their sizes add up to no more than the limit; an item beyond it stays alone.

    The fold, whose state is copied at every step, keeps only where groups begin.
    """
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def add(s: Column, n: Column) -> Column:
        new = (s["i"] == 0) | (s["n"] + n > limit)
        return F.struct(F.when(new, F.concat(s["begins"], F.array(s["i"]))).otherwise(s["begins"]).alias("begins"), F.when(new, n).otherwise(s["n"] + n).alias("n"), (s["i"] + 1).alias("i"))

    begins = F.aggregate(sizes, start, add, lambda s: s["begins"])
    return let(begins, lambda found: F.transform(found, lambda at, k: body(F.slice(items, at + 1, F.coalesce(F.get(found, k + 1), F.size(items)) - at))))


def hard_split(text: Column, limit: Column, count: Counter = token_count) -> Column:
    """Pieces of whole words, packed greedily by their own token counts; a word beyond the limit stays whole."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return let(words, lambda all_: packed(all_, F.transform(all_, lambda w: count(w).cast("int")), limit, lambda group: F.array_join(group, " ")))


def _clauses(text: Column, delimiter: str) -> Column:
    """Parts at a delimiter, stripped, blanks dropped, the delimiter's sign put back on all but the last."""
    parts = F.split(text, delimiter, -1)
    return let(parts, lambda p: F.filter(F.transform(p, lambda x, i: F.when(strip(x) == "", "").when(i < F.size(p) - 1, F.concat(strip(x), F.lit(delimiter.rstrip()))).otherwise(strip(x))), lambda x: x != ""))


def subsplit(text: Column, limit: Column, count: Counter = token_count) -> Column:
    """A sentence beyond the limit in parts; a delimiter serves only if it is there and every part fits."""
    fits = lambda parts: F.forall(parts, lambda p: count(p) <= limit)
    return let(
        F.array(_clauses(text, "; "), _clauses(text, ", ")),
        lambda both: F.when(F.contains(text, F.lit("; ")) & fits(F.get(both, 0)), F.get(both, 0)).when(F.contains(text, F.lit(", ")) & fits(F.get(both, 1)), F.get(both, 1)).otherwise(hard_split(text, limit, count)),
    )


def split_sentences(text: Column, limit: Column, count: Counter = token_count, splitter: Callable[[Column], Column] = sentences) -> Column:
    """Sentences of the text, long ones in parts."""
    return F.flatten(F.transform(splitter(text), lambda s: F.when(count(s) > limit, subsplit(s, limit, count)).otherwise(F.array(s))))


def with_offsets(text: Column, parts: Column, count: Counter = token_count) -> Column:
    """(s, start, stop, n) of each part: found from the end of the one before on, else where its first word is, else there.

    The next NEAR characters of the text go along, and a part that lies within
    them, as nearly all do, is found there: the text is walked once for each
    NEAR / 2 characters, not once for each part.
    """
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"), F.lit("").alias("near"), F.lit(0).alias("left"))

    def add(state: Column, s: Column) -> Column:
        short = state["left"] < NEAR // 2
        near = F.when(short, F.substr(text, state["at"] + 1, F.lit(NEAR))).otherwise(state["near"])

        def far(what: Column) -> Column:
            return F.position(what, text, state["at"] + 1) - 1 - state["at"]

        def one(skipped: Column, near: Column) -> Column:
            used = skipped + F.length(s)
            return F.struct(
                F.concat(state["starts"], F.array((state["at"] + skipped).cast("int"))).alias("starts"),
                (state["at"] + used).alias("at"),
                F.substr(near, used + 1).alias("near"),
                (F.when(short, NEAR).otherwise(state["left"]) - used).alias("left"),
            )

        def place(near: Column) -> Column:
            word = F.regexp_extract(s, r"(?U)^\S+", 0)
            beyond = let(far(s), lambda whole: F.when(whole >= 0, whole).otherwise(F.greatest(F.lit(0), far(word))))
            return let(let(F.position(s, near), lambda whole: F.when(whole > 0, whole - 1).otherwise(beyond)), lambda skipped: one(skipped, near))

        return let(near, place)

    def placed(all_: Column) -> Column:
        starts = F.aggregate(all_, start, add, lambda s: s["starts"])
        return F.zip_with(all_, starts, lambda s, at: F.struct(s.alias("s"), at.alias("start"), (at + F.length(s)).cast("int").alias("stop"), count(s).cast("int").alias("n")))

    return let(parts, placed)


def merge(parts: Column, limit: Column) -> Column:
    """Greedy chunks (text, start_char, end_char, token_count) of neighbouring parts; the count is the sum of the parts' counts."""

    def chunk_(group: Column) -> Column:
        total = F.aggregate(group, F.lit(0), lambda a, x: a + x["n"])
        return F.struct(
            F.array_join(F.transform(group, lambda x: x["s"]), " ").alias("text"), F.get(group, 0)["start"].alias("start_char"),
            F.get(group, F.size(group) - 1)["stop"].alias("end_char"), total.alias("token_count"),
        )

    return let(parts, lambda all_: packed(all_, F.transform(all_, lambda x: x["n"]), limit, chunk_))


def chunks_of(text: Column, limit: Column, count: Counter = token_count, splitter: Callable[[Column], Column] = sentences) -> Column:
    """Array of chunks of a text; none of a null or blank one."""
    parts = let(split_sentences(text, limit, count, splitter), lambda p: with_offsets(text, p, count))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.array().cast("array<struct<text:string,start_char:int,end_char:int,token_count:int>>")).otherwise(merge(parts, limit))


def chunk(turns: DataFrame, config: ChunkerConfig = ChunkerConfig(), count: Counter = token_count, splitter: Callable[[Column], Column] = sentences) -> DataFrame:
    """Chunks of turns (conv_id, turn, role, text): their turn's columns, pos and a number that is the same on every run."""
    found = turns.select("conv_id", "turn", "role", F.posexplode(chunks_of(F.col("text"), F.lit(config.max_tokens), count, splitter)).alias("pos", "c"))
    number = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("pos").cast("string"), F.lit(str(config.max_tokens))), 256)
    return found.select("conv_id", "turn", "role", "pos", number.alias("chunk_id"), "c.text", "c.start_char", "c.end_char", "c.token_count")


def chunk_counts(chunks: DataFrame, by: str = "conv_id") -> DataFrame:
    """Chunks and tokens for each conversation and, with a null key, for all."""
    return chunks.rollup(by).agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
