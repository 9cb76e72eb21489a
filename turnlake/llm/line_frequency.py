"""Quality rules with cross-document line frequency; built-in functions only.

Base rules look at one text: words, symbols, lines and 5-word windows that come
back. The method looks across documents: lines are normalised and hashed, the
documents that hold a line are counted for each host, lines above the limits
count as removed, and a document of which too little is left is rejected.

Each text is read once, into a narrow table of its figures and hashed lines; what
follows is joined by a number that each row gets there, so rows of equal or null
doc_id never meet.

Defined results: null text counts as empty; a null host is a host of its own;
repeated rows and rows of equal or null doc_id count as documents of their own and
are judged each by its own text; blank lines are never counted; texts and lines of
any length are read whole; empty input gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, small, table, words, written

MIN_WORDS = 10
#: Per cent of the words that may stand in repeated windows.
MAX_REPEAT = 20
WINDOW = 5
#: A line is removed if more documents of its host hold it than this number and this share.
MAX_DOCS, MAX_SHARE = 30, 0.001
#: A document is rejected if lines with more than this share of its characters are removed.
MAX_REMOVED = 0.5


def _windows(hashes: Column) -> Column:
    """A hash for each window; hashes: an array with one for each word."""
    return F.when(
        F.size(hashes) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _twice(placed: Column) -> Column:
    """placed: (hash, position) in order. In order the positions of hashes that are there twice or more."""
    same = lambda p, k: F.coalesce(p["h"] == F.get(placed, k)["h"], F.lit(False))
    marked = F.transform(placed, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words covered by the windows at the given starts, which are in order."""
    return F.aggregate(F.transform(starts, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)


def repeated_words(words_: Column) -> Column:
    """Words that stand in windows found twice or more in an array of words."""
    placed = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    count = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(let(placed(w), _twice), _covered)).otherwise(0)
    return let(let(F.transform(words_, lambda w: F.xxhash64(w)), _windows), count).cast("long")


def text_rules(docs: DataFrame, keep: list) -> DataFrame:
    """The base rules' figures for each row of docs, after the columns keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    both = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    ruled = docs.select(
        F.struct(*keep).alias("_kept"),
        both.alias("_of_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    ruled = ruled.select("_kept.*", F.col("_of_words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_of_words.r").alias("n_repeat_words"))
    return ruled.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def normal(line: Column) -> Column:
    """A line, or lines, with A-Z lower-cased, digits as 0 and single spaces."""
    return F.translate(F.regexp_replace(F.regexp_replace(line, r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " "), UPPER, LOWER)


def hashed_lines(text: Column) -> Column:
    """(line, n): hash and length of each normalised line that is not blank."""
    lines = F.filter(F.transform(F.split(normal(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("n")))


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """h and l, host and line hash of the lines that more rows (host, lines) of the host hold than the limits allow; a written table."""
    lines = rows.select("host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    sizes = rows.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("docs"))
    often = counted.join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > max_share * F.col("docs"))
    return written(often.select("h", F.col("line").alias("l")))


def quality(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """doc_id, the base figures, base_failed, removed_share and kept for each row of docs (doc_id, text, host)."""
    rows = docs.select("doc_id", F.col(host).alias("host"), "text", F.monotonically_increasing_id().alias("row"))
    rows = written(text_rules(rows, ["row", "doc_id", "host", hashed_lines(F.col("text")).alias("lines")]))
    lines = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*")
    met = lines.join(small(frequent_lines(rows, max_docs, max_share)), (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    gone = written(met.groupBy("row").agg(F.sum("n").alias("removed")))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    removed = F.coalesce("removed", F.lit(0))
    judged = rows.join(small(gone), "row", "left").withColumn("removed_share", F.when(total > 0, removed / total).otherwise(0.0))
    return judged.withColumn("kept", ~F.col("base_failed") & (removed <= max_removed * total)).drop("row", "host", "lines", "removed")


def without_frequent_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """doc_id and the text of the original lines that stay, in order, for each row of docs; empty if none stays."""
    rows = docs.select("doc_id", F.col(host).alias("host"), "text", hashed_lines(F.col("text")).alias("lines"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows)
    lines = rows.select("row", "host", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    met = lines.join(small(frequent_lines(rows, max_docs, max_share)), (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h")))
    gone = written(met.groupBy("row").agg(F.collect_set("line").alias("gone")))
    stays = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(F.btrim(normal(x)))))
    left = rows.join(gone, "row", "left")
    return left.select("doc_id", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, source, l, trim(translate(regexp_replace(regexp_replace(l, '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
freq AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM ln WHERE norm <> '' GROUP BY source, norm) f
  JOIN (SELECT source AS s, count(*) AS docs FROM d GROUP BY source) c ON f.source IS NOT DISTINCT FROM c.s WHERE n > 30 AND n > 0.001 * docs),
rem AS (SELECT ln.doc_id, sum(CASE WHEN freq.norm IS NULL THEN 0 ELSE length(ln.norm) END) AS gone, sum(length(ln.norm)) AS total
  FROM ln LEFT JOIN freq ON ln.norm = freq.norm AND ln.source IS NOT DISTINCT FROM freq.source WHERE ln.norm <> '' GROUP BY ln.doc_id),
b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.gone, 0) > 0.5 * rem.total AS depleted
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(depleted, false) AS kept FROM b
"""
