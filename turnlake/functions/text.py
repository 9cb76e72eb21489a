"""Text expressions: stripping, token counts, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of word characters or any other visible character.
TOKEN = r"\w+|[^\w\s]"
#: A lexical term of lower-cased text.
TERM = r"[a-z0-9]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """text without white space at its ends, Unicode's and the four ASCII separators included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def term_tally(text: Column) -> Column:
    """Array of (term, tf) of a text's terms in order; empty without terms. Terms are sorted, so that equal ones stand together and are counted in one pass."""

    def counted(sorted_: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1)))
        return let(begins, lambda found: F.transform(found, lambda at, k: F.struct(F.get(sorted_, at).alias("term"), (F.coalesce(F.get(found, k + 1), F.size(sorted_)) - at).alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.array_sort(F.coalesce(terms(text), F.array().cast("array<string>"))), lambda sorted_: F.when(F.size(sorted_) == 0, none).otherwise(counted(sorted_)))


def term_weights(text: Column) -> Column:
    """Lexical weights of a text: the share of each of its terms; empty without terms."""

    def shares(tally: Column) -> Column:
        total = F.aggregate(tally, F.lit(0), lambda n, x: n + x["tf"])
        return let(total, lambda n: F.map_from_entries(F.transform(tally, lambda x: F.struct(x["term"].alias("key"), (x["tf"] / n).alias("value")))))

    return let(term_tally(text), shares)


def sentences(text: Column) -> Column:
    """Stripped non-blank pieces, cut behind . ! ? with white space and at line breaks."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(cut, strip), lambda s: s != "")
