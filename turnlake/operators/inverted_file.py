"""An inverted file of vectors with residual codes, which grows with what is added.

Vectors, brought to length 1, are filed in the list of their nearest centroid, and
what is left of them is coded in parts, a byte for each. A query reads the lists of
its ef nearest centroids: it scores their codes, and of the best ones of all lists
it reads the vectors themselves and ranks them by their cosine. So ef trades
recall for codes, and the number of vectors read hardly grows with the table.
Among vectors that are closer to each other than to their codes, the codes' scores
tell little. So the angle between a vector and its code is kept, too: a query's angle
to the code less that one is the least that its angle to the vector can be, and a few
vectors are read by this bound. It is 0 for vectors of the query's own direction.

What is stored below a folder:

- ``model``: centroids and code books, fitted once on a bounded sample;
- ``base/version=n``: numbers, lists, codes, their angles and vectors, sorted by
  list, and the lists' sizes beside them; angles are null in what was filed without;
- ``delta/version=n/batch=...``: what was added since, coded against the same
  centroids; a search reads base and delta alike, so a vector is found as soon as
  add() returns;
- ``keys/bucket=...``: the numbers that are stored, by a hash; add() reads no other
  buckets than its batch's.

compact() writes base and delta as the next version, which counts from the moment
it is complete, and deletes the older one. One writer at a time is assumed; readers
may go on while it writes, until the old version goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.vectors import finite, norm
from turnlake.operators.retrieval import top_k
from turnlake.sources.keys import Keys
from turnlake.sources.shared import children, delete, exists, written

#: Rows that centroids and code books are fitted on (expected number), rounds of fitting, most lists, entries of a code book.
SAMPLE, ROUNDS, MOST_LISTS, ENTRIES = 20_000, 8, 4096, 256
#: Codes on a page and queries in a slice, what a task holds at once; queries scored in one step.
PAGE, SLICE, STEP = 32_768, 256, 32


def units(vectors) -> np.ndarray:
    """The vectors at length 1 as rows; zero vectors stay zero."""
    out = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (rows @ centres.T)).argmin(1)


def reread(n: int, k: int) -> int:
    """How many vectors a query reads itself by their codes' scores: 5 of 100, but between 4 and 20 for each hit that it asks for."""
    return min(20 * k, max(4 * k, n // 20))


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def best(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest values, of equal ones those with the smaller keys."""
    if len(values) <= n:
        return np.arange(len(values))
    rows = np.flatnonzero(values >= np.partition(values, -n)[-n])
    return rows[np.lexsort((keys[rows], -values[rows]))[:n]]


class Coder:
    """Centroids (lists x components) and code books (parts x entries x components of a part)."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    def lists(self, rows: np.ndarray) -> np.ndarray:
        return nearest(rows, self.centres)

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """rows x parts x components, the last part filled up with zeros."""
        parts, _, size = self.books.shape
        return np.pad(rows, ((0, 0), (0, parts * size - rows.shape[1]))).reshape(len(rows), parts, size)

    def codes(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.parts(rows - self.centres[lists])
        return np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.books[np.arange(len(self.books)), codes].reshape(len(codes), -1)
        return self.centres[lists] + rest[:, : self.centres.shape[1]]

    def order(self, query: np.ndarray) -> np.ndarray:
        """Lists from the nearest on."""
        return ((self.centres * self.centres).sum(1) - 2 * (self.centres @ query)).argsort(kind="stable")


def fitted(vectors: DataFrame, lists: int | None, parts: int, seed: int, sample: int = SAMPLE) -> Coder:
    """Centroids by MLlib's k-means and code books of what they leave, from a sample of vectors (embedding)."""
    n = vectors.count()
    if not n:
        raise ValueError("an index needs vectors to be fitted on")
    rows = vectors.where("size(embedding) > 0").withColumn("_size", F.greatest(norm(F.col("embedding")), F.lit(1e-300)))
    rows = rows.select(F.transform("embedding", lambda x: x.cast("double") / F.col("_size")).alias("unit"))
    taken = written((rows.sample(min(1.0, sample / n), seed) if n > sample else rows).withColumn("vector", array_to_vector("unit")))
    k = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    model = KMeans(featuresCol="vector", k=k, initMode="random", maxIter=ROUNDS, seed=seed).fit(taken)
    centres = np.array(model.clusterCenters())
    width = centres.shape[1]
    parts = min(parts, width)
    size = -(-width // parts)
    bare = Coder(centres, np.zeros((-(-width // size), 1, size)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = units(batch["unit"])
            rest = bare.parts(data - centres[bare.lists(data)])
            for p in range(rest.shape[1]):
                yield pd.DataFrame({"part": p, "rest": list(rest[:, p])})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(group["rest"])
        rows = rows[np.lexsort(rows.T)]
        book = rows[np.random.default_rng(seed).permutation(len(rows))[:ENTRIES]].copy()
        for _ in range(ROUNDS):
            own = nearest(rows, book)
            for e in np.unique(own):
                book[e] = rows[own == e].mean(0)
        return pd.DataFrame({"part": group["part"].iloc[0], "entry": range(len(book)), "vec": list(book)})

    books = taken.select("unit").mapInPandas(cut, "part int, rest array<double>").groupBy("part").applyInPandas(fit, "part int, entry int, vec array<double>")
    found = sorted(books.collect(), key=lambda r: (r["part"], r["entry"]))  # ENTRIES rows of each part
    return Coder(centres, np.array([r["vec"] for r in found]).reshape(len(bare.books), -1, size))


class InvertedFile:
    """The index below a folder; key names the column of numbers, of any type that can be sorted."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        rows = sorted(spark.read.parquet(f"{self.path}/model").collect(), key=lambda r: (r["part"], r["entry"]))  # bounded by the numbers of lists and entries
        centres = np.array([r["vec"] for r in rows if r["part"] < 0])
        books = [[r["vec"] for r in rows if r["part"] == p] for p in range(rows[-1]["part"] + 1)]
        self.coder = Coder(centres, np.array(books))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str = "vec_id", lists: int | None = None, parts: int = 16, seed: int = 7, coder: Coder | None = None) -> InvertedFile:
        """Fits an index on vectors (key, embedding; null and non-finite ones take no part, of rows with one key one) and files them; coder: a fitted one."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        vectors = written(cls._usable(vectors, key))
        coder = coder or fitted(vectors, lists, parts, seed)
        rows = [(-1, i, x.tolist()) for i, x in enumerate(coder.centres)] + [(p, e, x.tolist()) for p, book in enumerate(coder.books) for e, x in enumerate(book)]
        delete(spark, path)
        spark.createDataFrame(rows, "part int, entry int, vec array<double>").coalesce(1).write.parquet(f"{path}/model")
        index = cls(spark, path, key)
        index._write_base(index._coded(vectors), 0)
        index._keys.add(vectors)
        return index

    @staticmethod
    def _usable(vectors: DataFrame, key: str) -> DataFrame:
        return vectors.where(F.col(key).isNotNull() & finite(F.col("embedding"))).select(key, F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates([key])

    def _schema(self, df: DataFrame, more: str) -> str:
        return f"`{self.key}` {df.schema[self.key].dataType.simpleString()}, {more}"

    def _coded(self, vectors: DataFrame) -> DataFrame:
        coder = self.coder

        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = units(batch["embedding"])
                lists = coder.lists(rows)
                codes = coder.codes(rows, lists)
                apart = angles((rows * units(coder.decoded(codes, lists))).sum(1))
                yield batch.assign(list=lists.astype(np.int32), code=[c.tobytes() for c in codes], angle=apart)

        return vectors.mapInPandas(code, self._schema(vectors, "embedding array<float>, list int, code binary, angle double"))

    @property
    def _keys(self) -> Keys:
        return Keys(self.spark, f"{self.path}/keys", self.key)

    def _write_base(self, coded: DataFrame, version: int) -> None:
        # lists follow one another, and a crowded one spans several files
        coded.repartitionByRange(F.col("list"), F.xxhash64(self.key)).sortWithinPartitions("list").write.parquet(f"{self.path}/base/version={version}/codes")
        self._sizes(self.spark.read.parquet(f"{self.path}/base/version={version}/codes")).coalesce(1).write.parquet(f"{self.path}/base/version={version}/sizes")

    @staticmethod
    def _sizes(codes: DataFrame) -> DataFrame:
        return codes.groupBy("list").agg(F.count("*").alias("n"))

    @property
    def version(self) -> int:
        """The newest version that is complete."""
        found = [int(p.rpartition("=")[2]) for p in children(self.spark, f"{self.path}/base") if "version=" in p]
        return max(v for v in found if exists(self.spark, f"{self.path}/base/version={v}/sizes/_SUCCESS"))

    def _deltas(self, version: int) -> list[str]:
        return [p for p in children(self.spark, f"{self.path}/delta/version={version}") if exists(self.spark, f"{p}/_SUCCESS")]

    def _read(self, version: int) -> tuple[DataFrame, DataFrame | None]:
        path, deltas = f"{self.path}/base/version={version}/codes", self._deltas(version)
        schema = self.spark.read.parquet(path).schema
        read = self.spark.read.schema(schema if "angle" in schema.names else schema.add("angle", "double"))
        return read.parquet(path), read.parquet(*deltas) if deltas else None

    @property
    def entries(self) -> DataFrame:
        """All that is filed: key, embedding, list, code, angle."""
        base, delta = self._read(self.version)
        return base if delta is None else base.unionByName(delta)

    def sizes(self) -> np.ndarray:
        """How many entries each list holds; the base's numbers are stored, the delta's are counted."""
        version = self.version
        _, delta = self._read(version)
        out = np.zeros(len(self.coder.centres), np.int64)
        stored = self.spark.read.parquet(f"{self.path}/base/version={version}/sizes")
        for rows in (stored, *([] if delta is None else [self._sizes(delta)])):
            for r in rows.collect():  # a row for each list
                out[r["list"]] += r["n"]
        return out

    def add(self, vectors: DataFrame, batch: str | None = None) -> DataFrame:
        """Files what is not there yet and returns it; a batch of the same name is filed once."""
        version, batch = self.version, batch or uuid.uuid4().hex
        path = f"{self.path}/delta/version={version}/batch={batch}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            fresh = written(self._usable(vectors, self.key))
            fresh = written(self._keys.fresh(fresh))
            self._coded(fresh).write.mode("overwrite").parquet(path)
            self._keys.add(fresh)
        return self.spark.read.parquet(path)

    def compact(self) -> None:
        """Base and delta become the next base."""
        version = self.version
        self._write_base(self.entries, version + 1)
        delete(self.spark, f"{self.path}/delta/version={version}")
        delete(self.spark, f"{self.path}/base/version={version}")

    def _probes(self, queries: DataFrame, ef: int, sizes: np.ndarray) -> DataFrame:
        """query_id, unit, page, the lists to read there and n_codes, how many codes the query reads in all; a written table."""
        coder, first = self.coder, np.concatenate([[0], np.cumsum(sizes)])

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for query, unit in zip(batch["query_id"], units(batch["embedding"]), strict=True):
                    lists = coder.order(unit)[:ef]
                    lists = lists[sizes[lists] > 0]
                    low, high = first[lists] // PAGE, (first[lists + 1] - 1) // PAGE
                    for page in sorted({p for lo, hi in zip(low.tolist(), high.tolist(), strict=True) for p in range(lo, hi + 1)}):
                        out.append((query, unit, page, lists[(low <= page) & (page <= high)].astype(np.int32), int(sizes[lists].sum())))
                yield pd.DataFrame(out, columns=["query_id", "unit", "page", "lists", "n_codes"])

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.where(F.col("query_id").isNotNull() & finite(F.col("embedding"))).select("query_id", "embedding")
        return written(asked.mapInPandas(probe, f"query_id {kind}, unit array<double>, page long, lists array<int>, n_codes long"))

    def search(self, queries: DataFrame, k: int = 10, ef: int = 50, counted: bool = False) -> DataFrame:
        """query_id, rk (from 1), the key and score of the k nearest found by reading the ef nearest lists; ties go to the smaller key.

        queries: query_id, embedding. counted: also n_codes and n_vectors, how many codes and vectors the query read.
        """
        sizes, key, coder = self.sizes(), self.key, self.coder
        most, few = reread(int(sizes.sum()), k), 4 * k
        entries = self.entries
        probes = self._probes(queries, ef, sizes)
        # few queries read few lists: the scan of sorted files skips the others
        wanted = probes.select(F.explode("lists").alias("list")).distinct().limit(1001).collect()
        near = entries.where(F.col("list").isin([r["list"] for r in wanted])) if len(wanted) <= 1000 else entries
        slices = written(probes.groupBy("page").agg(F.ceil(F.count("*") / SLICE).alias("slices")))
        pages = F.broadcast(slices) if slices.count() <= 100_000 else slices
        first = np.concatenate([[0], np.cumsum(sizes)])
        places = self.spark.createDataFrame([(i, int(first[i]) // PAGE, int(first[i + 1] - 1) // PAGE - int(first[i]) // PAGE + 1) for i in range(len(sizes)) if sizes[i]], "list int, low long, n long")  # a row for each list
        held = near.select(key, "list", "code", "angle").join(F.broadcast(places), "list").withColumn("page", F.col("low") + F.pmod(F.xxhash64(key), "n")).join(pages, "page")
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        asked = probes.join(pages, "page").withColumn("part", F.pmod(F.xxhash64("query_id"), "slices"))

        def score(codes: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(codes) and len(asked):
                there, local = np.unique(codes["list"].to_numpy(), return_inverse=True)
                data = coder.decoded(np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1), codes["list"].to_numpy())
                keys, apart = codes[key].to_numpy(), codes["angle"].to_numpy(float)
                size = np.sqrt((data * data).sum(1))
                for start in range(0, len(asked), STEP):
                    some = asked.iloc[start : start + STEP]
                    scores = np.stack(some["unit"]) @ data.T
                    # rounded, since an angle next to 0 is known to half the digits of its cosine
                    bounds = np.round(np.abs(angles(np.divide(scores, size, out=np.zeros_like(scores), where=size > 0)) - apart), 7)
                    bounds[np.isnan(bounds)] = np.inf
                    np.round(scores, 9, out=scores)
                    for query, lists, row, least in zip(some["query_id"], some["lists"], scores, bounds, strict=True):
                        rows = np.flatnonzero(np.isin(there, lists)[local])
                        # equal vectors have equal codes: of them the smaller keys are read
                        rows = rows[np.union1d(best(row[rows], keys[rows], most), best(-least[rows], keys[rows], few))]
                        found.append(pd.DataFrame({"query_id": query, key: keys[rows], "rough": row[rows], "least": least[rows]}))
            return pd.concat(found) if found else pd.DataFrame({"query_id": asked["query_id"][:0], key: codes[key][:0], "rough": np.zeros(0), "least": np.zeros(0)})

        kind = queries.schema["query_id"].dataType.simpleString()
        both = lambda df, *columns: df.select("page", "part", *columns).groupBy("page", "part")
        rough = both(held, key, "list", "code", "angle").cogroup(both(asked, "query_id", "unit", "lists")).applyInPandas(score, f"query_id {kind}, {self._schema(entries, 'rough double, least double')}")
        place = lambda order: F.row_number().over(W.partitionBy("query_id").orderBy(order, key))
        placed = rough.select("query_id", key, place(F.desc("rough")).alias("by_score"), place(F.col("least")).alias("by_bound"))
        chosen = written(placed.where((F.col("by_score") <= most) | (F.col("by_bound") <= few)).select("query_id", key))
        facts = probes.groupBy("query_id").agg(F.first("unit").alias("unit"), F.max("n_codes").alias("n_codes")).join(chosen.groupBy("query_id").agg(F.count("*").alias("n_vectors")), "query_id")
        pairs = chosen.join(near.select(key, "embedding"), key).join(facts, "query_id")
        own = F.aggregate(F.zip_with("unit", "embedding", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        size = norm(F.col("embedding"))
        scored = pairs.withColumn("score", F.when(size > 0, own / size).otherwise(0.0))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
        ranked = scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k)
        return ranked.select("query_id", "rk", key, "score", *(["n_codes", "n_vectors"] if counted else []))

    def tuned(self, k: int = 10, wanted: float = 0.97, tried: int = 50) -> int:
        """The least ef whose lists hold the wanted share of the exact neighbours of some stored vectors."""
        entries = self.entries
        asked = entries.orderBy(F.xxhash64(self.key)).limit(tried).select(self.key, "embedding").collect()  # tried rows
        vectors = entries.select(F.xxhash64(self.key).alias("vec_id"), "embedding", "list")
        asks = self.spark.createDataFrame([(i, r["embedding"]) for i, r in enumerate(asked)], "vec_id long, embedding array<float>")
        hits = top_k(asks, vectors, k).select("query_id", "vec_id")
        orders = [{int(x): i + 1 for i, x in enumerate(self.coder.order(units([r["embedding"]])[0]))} for r in asked]
        needs = sorted(orders[r["query_id"]][r["list"]] for r in hits.join(vectors.select("vec_id", "list"), "vec_id").collect())  # tried x k rows
        return needs[min(len(needs), int(np.ceil(wanted * len(needs)))) - 1] if needs else 1
