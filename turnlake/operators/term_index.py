"""BM25 over a stored inverted index in blocks of texts, with a bound for each term of a block.

Texts are dealt into blocks of bounded size by their hash. A block holds one row for
each of its terms: which texts have it, with what weight (what BM25 gives without
the term's rarity), and the greatest of these weights. A block's queries are
answered from its rows alone:

1. A block in which the greatest weights of a query's terms do not add up to the
   query's floor is skipped. The floor is a score that k texts are known to reach:
   the kth best of the first block, then what the block itself has shown.
2. Terms that cannot reach the floor together, the lightest first, are not read: a
   text without any of the others is no hit. Of the others all texts are added up.
3. What may still reach the floor is looked up in the lists of the lightest terms.

So the result is that of scoring all rows, while a term that all rows have costs
hardly anything beside rarer ones. What leaves a block are its k best texts for each
query; blocks and slices of queries are the tasks, so no term is ever one task.

Rows of a batch with the same text are one text, which counts as many times and
whose rows are looked up when it is a hit.

What is stored below a folder: ``facts`` (the mean length), ``base`` and
``delta/batch=...``, each with rows, texts and postings, and the keys by hash.
add() writes a batch of its own; numbers of rows and the rarity of terms are those
of all batches at once, the mean length is that of the last build(), so that stored
weights hold.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.text import term_tally, terms
from turnlake.sources.keys import Keys
from turnlake.sources.shared import children, delete, exists, written

#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Texts of a block (expected number) and queries of a slice, what a task holds at once.
BLOCK, SLICE = 16_384, 8_192
#: Rows that may be broadcast, and terms that may be looked up in the files' statistics.
FEW_ROWS, FEW_TERMS = 100_000, 1000
#: What sums of doubles may be off by; scores are compared when rounded to so many digits.
SLACK, DIGITS = 1e-8, 9


def weight(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def rarity(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has been counted to hold few rows; df should be a written table."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def best(lists: list[tuple[float, np.ndarray, np.ndarray]], n: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(places and rounded scores of the k best of n texts, how many postings were read) for a query whose terms have (greatest gain, places, gains) here; below the floor nothing is looked for."""
    lists = sorted(lists, key=lambda x: x[0])
    reach = np.cumsum([most for most, _, _ in lists])
    none = np.zeros(0, np.int64)
    if not lists or reach[-1] < floor - SLACK:
        return none, np.zeros(0), 0
    light = int(np.searchsorted(reach, floor - SLACK))
    scores, read = np.zeros(n), 0
    for _, places, gains in lists[light:]:
        scores[places] += gains
        read += len(places)
    # the texts found so far may raise the floor before the light terms are looked up
    if light and np.count_nonzero(scores) >= k:
        floor = max(floor, float(np.partition(scores, -k)[-k]))
    near = np.flatnonzero((scores > 0) & (scores + (reach[light - 1] if light else 0.0) >= floor - SLACK))
    for _, places, gains in lists[:light]:
        at = np.minimum(np.searchsorted(places, near), len(places) - 1)
        met = places[at] == near
        scores[near[met]] += gains[at[met]]
        read += int(met.sum())
    found = np.round(scores[near], DIGITS)
    order = np.lexsort((near, -found))[:k]
    return near[order], found[order], read


class TermIndex:
    """The index below a folder; key names the column of numbers, of any type that can be sorted."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.mean = spark.read.parquet(f"{self.path}/facts").first()["mean"]

    @property
    def _keys(self) -> Keys:
        return Keys(self.spark, f"{self.path}/keys", self.key)

    @classmethod
    def build(cls, texts: DataFrame, path: str, key: str = "doc_id") -> TermIndex:
        """An index of texts (key, text; null keys take no part, of rows with one key one) in place of an older one."""
        spark, path = texts.sparkSession, path.rstrip("/")
        delete(spark, path)
        rows, held = cls._texts(texts, key)
        mean = held.agg((F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean")).first()["mean"]
        spark.createDataFrame([(max(mean or 1.0, 1e-9),)], "mean double").coalesce(1).write.parquet(f"{path}/facts")
        index = cls(spark, path, key)
        index._write(rows, held, "base")
        index._keys.add(rows)
        return index

    @staticmethod
    def _texts(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """(key and id of the row's text; id, the text's first key, n rows that have it, its tally and length), both written tables."""
        rows = texts.where(F.col(key).isNotNull()).select(key, F.coalesce("text", F.lit("")).alias("text")).dropDuplicates([key])
        rows = written(rows.withColumn("id", F.unhex(F.substring(F.sha2("text", 256), 1, 32))))
        held = rows.groupBy("id").agg(F.min(key).alias("first"), F.count("*").alias("n"), F.first("text").alias("text"))
        held = held.select("id", "first", "n", term_tally(F.col("text")).alias("tally"))
        return rows.select(key, "id"), written(held.withColumn("length", F.aggregate("tally", F.lit(0), lambda n, x: n + x["tf"])))

    def _write(self, rows: DataFrame, held: DataFrame, batch: str) -> None:
        path = self._path(batch)
        blocks = max(1, -(-held.count() // BLOCK))
        # in the order of their first keys, so that of equal scores the first places count
        place = (F.row_number().over(W.partitionBy("block").orderBy("first")) - 1).cast("int")
        name = F.concat(F.lit(f"{batch}-"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("string"))
        held = written(held.withColumn("block", name).withColumn("place", place))
        weights = held.select("block", "place", "n", "length", F.explode("tally").alias("x"))
        weights = weights.select("block", "place", "n", F.col("x.term").alias("term"), weight(F.col("x.tf"), F.col("length"), self.mean).alias("w"))
        lists = weights.groupBy("block", "term").agg(F.sum("n").alias("n"), F.max("w").alias("top"), F.array_sort(F.collect_list(F.struct("place", "w"))).alias("held"))
        lists = lists.select("block", "term", "n", "top", F.col("held.place").alias("places"), F.col("held.w").alias("weights"))
        rows.write.parquet(f"{path}/rows")
        held.select("block", "place", "id", "first").write.parquet(f"{path}/texts")
        # terms follow one another, so that files' statistics find them
        lists.repartitionByRange("term", "block").sortWithinPartitions("term").write.parquet(f"{path}/postings")

    def _path(self, batch: str) -> str:
        return f"{self.path}/base" if batch == "base" else f"{self.path}/delta/batch={batch}"

    def _table(self, name: str) -> DataFrame:
        deltas = [p for p in children(self.spark, f"{self.path}/delta") if exists(self.spark, f"{p}/postings/_SUCCESS")]
        return self.spark.read.parquet(*(f"{p}/{name}" for p in (f"{self.path}/base", *deltas)))

    @property
    def rows(self) -> DataFrame:
        """key and id of the text of all that is indexed."""
        return self._table("rows")

    def add(self, texts: DataFrame, batch: str | None = None) -> DataFrame:
        """Indexes the rows that are not there yet and returns them; a batch of the same name is written once."""
        batch = batch or uuid.uuid4().hex
        path = self._path(batch)
        if not exists(self.spark, f"{path}/postings/_SUCCESS"):
            delete(self.spark, path)
            fresh = self._keys.fresh(written(texts.where(F.col(self.key).isNotNull()).select(self.key, "text")))
            rows, held = self._texts(fresh, self.key)
            self._write(rows, held, batch)
            self._keys.add(rows)
        return self.spark.read.parquet(f"{path}/rows")

    def _found(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, block, place and score of the k best texts of each block, and a row without place with n_read; a written table."""
        own = written(queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")))
        wanted = written(own.select("term").distinct())
        few = wanted.limit(FEW_TERMS + 1).collect()
        postings = self._table("postings")
        if len(few) <= FEW_TERMS:
            postings = postings.where(F.col("term").isin([r[0] for r in few]))
        postings = postings.join(_few(wanted), "term")
        dictionary = written(postings.groupBy("term").agg(F.sum("n").alias("df")))
        n = F.lit(self.rows.count())
        asked = own.join(_few(dictionary), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", rarity(n, F.col("df")).alias("idf"))).alias("t"))
        asked = written(asked.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")))
        slices = max(1, -(-asked.count() // SLICE))
        blocks = self._table("texts").select("block").distinct()
        first = blocks.agg(F.min("block")).first()[0]
        dealt = asked.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
        lists = postings.select("block", "term", "top", "places", "weights").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        kind = queries.schema["query_id"].dataType.simpleString()

        def answer(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found, block, size = [], lists["block"].iloc[0] if len(lists) else "", 0
            if len(lists) and len(asked):
                held = {t: (top, p, w) for t, top, p, w in lists[["term", "top", "places", "weights"]].itertuples(index=False)}
                size = 1 + max(int(p[-1]) for _, p, _ in held.values())
                for words, idfs, floor in asked[["terms", "idfs", "floor"]].itertuples(index=False):
                    # a term's list is weighed for this query alone, so no more than one query's lists are held twice
                    mine = [(idf * held[t][0], held[t][1], idf * held[t][2]) for t, idf in sorted(zip(words, idfs, strict=True)) if t in held]
                    found.append(best(mine, size, k, floor))
            # of each query its hits, then the row that says what it read
            query = asked["query_id"].to_numpy()[: len(found)]
            places = [np.append(places, -1).astype(np.int32) for places, _, _ in found]
            score = [np.append(scores, 0.0) for _, scores, _ in found]
            read = np.zeros(sum(map(len, places)), np.int64)
            ends = np.cumsum([len(x) for x in places]).astype(np.int64)
            read[ends - 1] = [n for _, _, n in found]
            flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            return pd.DataFrame({"query_id": np.repeat(query, [len(x) for x in places]), "block": block, "place": flat(places, np.int32), "score": flat(score, float), "n_read": read})

        def of(lists: DataFrame, dealt: DataFrame) -> DataFrame:
            groups = [df.groupBy("block", "slice") for df in (lists, dealt)]
            return written(groups[0].cogroup(groups[1]).applyInPandas(answer, f"query_id {kind}, block string, place int, score double, n_read long"))

        one = of(lists.where(F.col("block") == F.lit(first)), dealt.withColumn("block", F.lit(first)).withColumn("floor", F.lit(0.0)))
        kth = one.where("place >= 0").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        floors = dealt.join(_few(written(kth.select("query_id", F.col("least").alias("floor")))), "query_id", "left").fillna(0.0, ["floor"])
        # each query goes to each block, as in any search of all rows in blocks
        rest = _few(written(blocks.where(F.col("block") != F.lit(first))))
        return one.unionByName(of(lists.where(F.col("block") != F.lit(first)), floors.join(rest)))

    def reads(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id and n_read, how many postings it read."""
        return self._found(queries, k).groupBy("query_id").agg(F.sum("n_read").alias("n_read"))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, rk (from 1), the key and score of the k best rows for queries (query_id, text); ties go to the smaller key.

        Each term of a query counts once; rows without a common term are no hits.
        """
        key = self.key
        met = self._found(queries, k).where("place >= 0").select("query_id", "block", "place", "score")
        ranked = lambda by: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), by))
        # the k best texts hold the k best rows, and of a text no more than its k first rows can be among them
        best_ = self._table("texts").join(_few(written(met)), ["block", "place"])
        best_ = _few(written(best_.withColumn("rk", ranked("first")).where(F.col("rk") <= k).select("query_id", "block", "id", "score")))
        ids = _few(written(best_.select("id").distinct()))
        # a text may stand in more than one batch: its rows are those of all of them
        rows = self.rows.join(ids, "id").withColumn("_place", F.row_number().over(W.partitionBy("id").orderBy(key))).where(F.col("_place") <= k)
        hits = rows.join(best_.groupBy("query_id", "id").agg(F.max("score").alias("score")), "id")
        return hits.withColumn("rk", ranked(key)).where(F.col("rk") <= k).select("query_id", "rk", key, "score")


def hybrid(dense: DataFrame, lexical: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, dense_rk, dense_score, term_rk and term_score of all that either search found; both: query_id, rk, key, score."""
    sides = [df.select("query_id", key, F.col("rk").alias(f"{name}_rk"), F.col("score").alias(f"{name}_score")) for name, df in (("dense", dense), ("term", lexical))]
    return sides[0].join(sides[1], ["query_id", key], "full_outer")


def reranked(candidates: DataFrame, k: int, weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    """The k candidates of each query with the highest weighted sum of columns, as rk and score; a null counts as 0, ties go to the smaller key.

    weights: a column and its weight, such as relevance, importance, pin, recency and, with a negative one, superseded.
    """
    score = sum((F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * value for name, value in weights.items()), F.lit(0.0))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return candidates.withColumn("score", score).withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
