"""Licence scan by ordered signature rules; built-in functions only.

A text is reduced to its lower-case words with one space between. Each rule of
license_rules has a label, a keyword, a pattern over whole words, a priority and a
weight. A rule runs only where its keyword stands. A detection is dropped when another one
covers all of its words and either has the better priority, or the same
priority and more words, or the same of both and a smaller rule number.

Beside the rules, the base phrases are found by their words.

Defined results: null text counts as empty; a text without detections has empty
labels, score 0 and null positions; rows are judged one by one, so repeated rows
and null ids need no care; texts of any length are scanned whole; an empty table
gives an empty result; further columns are ignored. Everything happens within a
row: no shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, table
from .license_rules import gates, rules

#: Fixed values of the contract: phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: What stands between words in lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def _gate(text: Column) -> Column:
    """Whether words of the text may meet a rule; decides nothing but what is looked at closely."""
    words_ = gates(list(BASE))
    return let(F.lower(text), lambda low: functools.reduce(lambda a, b: a | b, (low.contains(word) for word in words_)))


def _starts_of(words: Column, starts: Column, phrase: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        same = F.get(words, i).eqNullSafe(F.lit(phrase[0]))
        for k, word in enumerate(phrase[1:], 1):
            same = same & F.get(words, i + k).eqNullSafe(F.lit(word))
        return same

    return F.transform(F.filter(starts, here), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _base(words: Column) -> Column:
    """(start, label) of each base phrase among the words."""
    phrases = [(p.split(), label) for p, label in BASE.items()]
    firsts = [p[0] for p, _ in phrases]
    starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*firsts), i)), lambda i: i.isNotNull())
    hits = F.array().cast("array<struct<start:int,label:string>>")
    for phrase, label in phrases:
        hits = F.concat(hits, _starts_of(words, starts, phrase, label))
    return hits


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _detections(text: Column, rule: Column) -> Column:
    """(first, last word, rule's fields) of each match of a rule in words joined by spaces."""
    lengths = lambda gaps, hits: F.zip_with(
        F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(_spaces(g).alias("gap"), _spaces(h).alias("own"))
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int,rule:int,label:string,priority:int,weight:double>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        one = F.struct(first.alias("first"), (first + x["own"]).alias("last"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"))
        return F.struct((first + x["own"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    return let(found, lambda hits: F.when(F.size(hits) == 0, empty["out"]).otherwise(F.aggregate(lengths(F.split(text, rule["pattern"], -1), hits), empty, add, lambda s: s["out"])))


def _kept(found: Column) -> Column:
    """The detections that no better one covers."""

    def better(e: Column, d: Column) -> Column:
        covers = (e["first"] <= d["first"]) & (e["last"] >= d["last"]) & (e["rule"] != d["rule"])
        size = lambda x: x["last"] - x["first"]
        tie = (size(e) > size(d)) | ((size(e) == size(d)) & (e["rule"] < d["rule"]))
        return covers & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & tie))

    return F.filter(found, lambda d: ~F.exists(found, lambda e: better(e, d)))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """n_words, base (start, label) and detections (first, last, rule, label, priority, weight) for each row of docs."""
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    named = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(label).alias("label"), F.lit(word).alias("keyword"), F.lit(pattern).alias("pattern"), F.lit(p).alias("priority"), F.lit(w).alias("weight")) for n, label, word, pattern, p, w in rules()))

    def closely(words: Column) -> Column:
        joined = let(
            F.array_join(words, " "),
            lambda t: let(F.flatten(F.transform(F.filter(named, lambda r: F.contains(t, r["keyword"])), lambda r: _detections(t, r))), _kept),
        )
        return F.struct(_base(words).alias("base"), joined.alias("detections"))

    nothing = F.struct(F.array().cast("array<struct<start:int,label:string>>").alias("base"), F.array().cast("array<struct<first:int,last:int,rule:int,label:string,priority:int,weight:double>>").alias("detections"))
    low = F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda w: w != "")
    found = docs.select(*keep, n_words.alias("n_words"), F.when(_gate(text), let(low, closely)).otherwise(nothing).alias("found"))
    return found.select(*keep, "n_words", "found.base", "found.detections")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.col("base.label"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).cast("long").alias("first_word"),
        F.array_max(F.col("base.start")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("detections.label"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.concat(F.transform("detections", lambda d: d["weight"]), F.transform("base", lambda b: F.lit(0.8)))), F.lit(0.0)).alias("score"),
    )
