"""Nearest neighbours by inner product over an inverted multi-index.

Both halves of a vector get a codebook of their own, so that K centroids each make
K x K cells. Halves carry one more component that brings all of them to the same
length; then the squared distance of a query's half to a vector's half falls as
their inner product rises, and the sum over both halves orders vectors as the inner
product does. For a query all pairs of centroids are traversed by rising summed
distance: a heap merges, for each centroid of the first half, the pairs with those
of the second half. The traversal ends when the cells so far hold as many entries
as the query may read; all of them are then ranked by their exact inner product.

How many entries are read is not guessed: for a bounded number of the queries the
exact neighbours are found by a scan, and the least budget whose cells hold the
wanted share of them is taken for all queries, as a share of all entries. Vectors
without any structure need about half of all entries; the more they cluster, the
fewer.

Codebooks are fitted on a bounded sample; every vector is filed. Cells follow one
another on pages of bounded size, a crowded cell spans several, and a page's
queries are dealt into slices, so no task holds a cell or a page's queries whole
if they are many. The counts of cells, K x K numbers, come to the driver. Of
vectors that are there very often, k + 1 numbers are enough, as equal scores go to
the smaller one.

Defined results: vectors that are null, zero or hold a null or non-finite component
and rows without vec_id take no part; shorter vectors are padded with zeros; a
query whose vec_id is there more than once is asked once, with its smallest
vector, and meets none of those rows; such rows are candidates of their own for
other queries; equal scores go to the smaller vec_id; a query without candidates
has no rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, small, table, written
from .rounds import finite
from .vector_approx import _few_equal

#: Rows that codebooks are fitted on (expected number), rounds of fitting, and the most centroids of a half.
SAMPLE, ROUNDS, MOST = 20_000, 10, 512
#: Entries that a cell should hold on average, entries of a page and queries of a slice.
PER_CELL, PAGE, SLICE = 16, 8192, 1024
#: Queries whose exact neighbours are looked up, and the share of them that the cells read have to hold.
TRIED, WANTED = 100, 0.95
#: Queries handled in one step, and those whose cells one task traverses.
STEP, PER_TASK = 128, 256


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec, in doubles, of the rows that take part."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)


def nearest_centres(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (rows @ centres.T)).argmin(1)


def fitted(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centroids of a sample by rounds of k-means from rows drawn at random, so that dense regions get more of them."""
    centres = rows[np.random.default_rng(11).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = nearest_centres(rows, centres)
        for c in np.unique(own):
            centres[c] = rows[own == c].mean(0)
    return centres


class Cells:
    """Codebooks of both halves, and how many entries each pair of centroids holds."""

    def __init__(self, lengths: tuple[float, float], books: list[np.ndarray], cut: int):
        self.lengths, self.books, self.cut, self.counts, self.first = lengths, books, cut, None, None

    def halves(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The halves with their further component."""
        parts = (vectors[:, : self.cut], vectors[:, self.cut :])
        return [np.hstack([x, np.sqrt(np.maximum(0, size * size - (x * x).sum(1)))[:, None]]) for x, size in zip(parts, self.lengths, strict=True)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        one, two = (nearest_centres(x, book) for x, book in zip(self.halves(vectors), self.books, strict=True))
        return one * len(self.books[1]) + two

    def counted(self, counts: np.ndarray) -> Cells:
        self.counts, self.first = counts, np.concatenate([[0], np.cumsum(counts)])
        return self

    def traversed(self, query: np.ndarray) -> Iterator[int]:
        """The cells with entries, by rising summed distance."""
        sides = []
        for x, book in zip((query[: self.cut], query[self.cut :]), self.books, strict=True):
            far = ((book[:, :-1] - x) ** 2).sum(1) + book[:, -1] ** 2  # a query's further component is 0
            order = far.argsort(kind="stable")
            sides.append((far[order].tolist(), order.tolist()))
        (one, rows), (two, cols) = sides
        width = len(two)
        heap = [(one[0] + two[0], 0, 0)]
        while heap:
            _, i, j = heap[0]
            if j + 1 < width:
                heapq.heapreplace(heap, (one[i] + two[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
            cell = rows[i] * width + cols[j]
            if self.counts[cell]:
                yield cell

    def probed(self, query: np.ndarray, budget: int) -> list[int]:
        """The first cells that hold at least budget entries together, all if there are not so many."""
        cells, held = [], 0
        for cell in self.traversed(query):
            if held >= budget:
                break
            cells.append(cell)
            held += int(self.counts[cell])
        return cells

    def pages(self, cell, page: int):
        """The first and the last page of a cell."""
        return self.first[cell] // page, np.maximum(self.first[cell], self.first[np.asarray(cell) + 1] - 1) // page


def built(vectors: DataFrame, n: int, per_cell: int = PER_CELL, sample: int = SAMPLE) -> tuple[DataFrame, Cells]:
    """(vectors with cell, a written table; the cells) of vectors (vec_id, vec), all of one length, of which there are n."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0]
    cut = -(-width // 2)
    size = lambda part: F.sqrt(F.max(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)))
    lengths = tuple(vectors.agg(size(F.slice("vec", 1, cut)), size(F.slice("vec", cut + 1, max(1, width - cut)))).first())
    k = int(min(MOST, max(1, round((n / per_cell) ** 0.5))))
    taken = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < max(1, min(1.0, sample / n) * 1_000_003))
    blank = Cells(lengths, [], cut)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        half = int(group["half"].iloc[0])
        rows = blank.halves(matrix(group.sort_values("vec_id")["vec"].tolist()))[half]
        return pd.DataFrame({"half": half, "centre": list(fitted(rows, k, ROUNDS))})

    both = taken.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    centres = both.groupBy("half").applyInPandas(fit, "half int, centre array<double>").collect()  # k rows of each half
    cells = Cells(lengths, [matrix([r["centre"] for r in centres if r["half"] == half]) for half in (0, 1)], cut)
    if not centres:  # a sample of few rows may be empty
        cells.books = [x[:1] for x in cells.halves(matrix([vectors.first()["vec"]]))]

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cells.of(matrix(batch["vec"].tolist())).astype(np.int32))

    filed = written(vectors.mapInPandas(file, "vec_id long, vec array<double>, cell int"))
    counts = np.zeros(len(cells.books[0]) * len(cells.books[1]), np.int64)
    for r in filed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST x MOST rows
        counts[r["cell"]] = r["n"]
    return filed, cells.counted(counts)


def best(own: np.ndarray, asks: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, open_=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, and the rows and exact scores of its k nearest; open_: queries x rows, which may be read."""
    for start in range(0, len(asks), STEP):
        rough = asks[start : start + STEP] @ data.T
        rough[own[start : start + STEP, None] == ids] = -np.inf
        if open_ is not None:
            rough[~open_(slice(start, start + STEP))] = -np.inf
        for query, ask, row in zip(own[start : start + STEP], asks[start : start + STEP], rough, strict=True):
            there = np.flatnonzero(row > -np.inf)
            if len(there) > k:
                # products of matrices round differently from row to row: what is near the kth score is taken along
                floor = np.partition(row[there], -k)[-k]
                there = there[row[there] >= floor - 1e-9 * (1 + abs(floor))]
            scores = (data[there] * ask).sum(1)
            order = np.lexsort((ids[there], -scores))[:k]
            yield int(query), there[order], scores[order]


def budget(queries: DataFrame, filed: DataFrame, cells: Cells, k: int, tried: int = TRIED, wanted: float = WANTED) -> int:
    """The least number of entries to read that finds the wanted share of the exact neighbours of some queries."""
    asked = queries.orderBy(F.xxhash64("vec_id")).limit(tried).collect()  # tried rows
    if not asked:
        return 0
    own, asks = np.array([r["vec_id"] for r in asked], np.int64), matrix([r["vec"] for r in asked])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, held = batch["vec_id"].to_numpy(), batch["cell"].to_numpy()
            for query, rows, scores in best(own, asks, ids, matrix(batch["vec"].tolist()), k):
                yield pd.DataFrame({"query_id": query, "vec_id": ids[rows], "cell": held[rows], "score": scores})

    found = filed.mapInPandas(scan, "query_id long, vec_id long, cell int, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near: dict[int, list[int]] = {}
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "cell").collect():  # tried x k rows
        near.setdefault(r["query_id"], []).append(r["cell"])
    needs = []
    for query, ask in zip(own.tolist(), asks, strict=True):
        left, held = near.get(query, []), 0
        for cell in cells.traversed(ask) if left else ():
            needs += [held + 1] * left.count(cell)  # this cell is opened if more than held may be read
            left = [c for c in left if c != cell]
            held += int(cells.counts[cell])
            if not left:
                break
    return sorted(needs)[min(len(needs) - 1, int(np.ceil(wanted * len(needs))) - 1)] if needs else 0


def search(queries: DataFrame, filed: DataFrame, cells: Cells, k: int, most: int, page: int = PAGE, slice_: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id and score of the k nearest entries of the first cells that hold most entries; query_id, page and the cells read there, a written table)."""
    last = max(0, int(cells.first[-1]) - 1) // page

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), STEP):
                out = []
                for query, vec in batch[["vec_id", "vec"]].iloc[start : start + STEP].itertuples(index=False):
                    open_ = np.array(cells.probed(np.asarray(vec, np.float64), most), np.int64)
                    low, high = cells.pages(open_, page)
                    for at in sorted({p for lo, hi in zip(low.tolist(), high.tolist(), strict=True) for p in range(lo, hi + 1)}):
                        out.append((query, vec, at, open_[(low <= at) & (at <= high)].astype(np.int32)))
                yield pd.DataFrame(out, columns=["query_id", "vec", "page", "cells"])

    # a traversal is worth a task's while long before its queries are many bytes
    dealt = queries.repartition(max(1, -(-queries.count() // PER_TASK)), "vec_id")
    probes = written(dealt.mapInPandas(probe, "query_id long, vec array<double>, page long, cells array<int>"))
    slices = written(probes.groupBy("page").agg(F.ceil(F.count("*") / slice_).alias("slices")))
    firsts = np.minimum(cells.pages(np.arange(len(cells.counts)), page), last)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = firsts[:, batch["cell"].to_numpy()]
            yield batch.assign(page=low + batch["vec_id"].to_numpy() % (high - low + 1))

    entries = filed.mapInPandas(place, "vec_id long, vec array<double>, cell int, page long").join(small(slices), "page")
    entries = entries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    asked = probes.join(small(slices), "page").withColumn("part", F.pmod(F.xxhash64("query_id"), "slices"))

    def score(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(asked):
            held, local = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            read = np.zeros((len(asked), len(held)), bool)
            for i, wanted in enumerate(asked["cells"]):
                read[i, np.searchsorted(held, np.intersect1d(held, wanted))] = True
            ids = entries["vec_id"].to_numpy()
            near = best(asked["query_id"].to_numpy(), matrix(asked["vec"].tolist()), ids, matrix(entries["vec"].tolist()), k, lambda at: read[at][:, local])
            out = [pd.DataFrame({"query_id": query, "vec_id": ids[rows], "score": scores}) for query, rows, scores in near]
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    pair = lambda df, *columns: df.select("page", "part", *columns).groupBy("page", "part")
    found = pair(entries, "vec_id", "vec", "cell").cogroup(pair(asked, "query_id", "vec", "cells")).applyInPandas(score, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), probes


def top_k(queries: DataFrame, vectors: DataFrame, k: int, per_cell: int = PER_CELL, wanted: float = WANTED, page: int = PAGE, slice_: int = SLICE) -> tuple[DataFrame, int]:
    """(query_id, rank (from 1), vec_id and score of the k nearest found, a written table; how many entries a query may read); both tables hold vec_id and vec."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0]
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double"), 0
    width = max(width, queries.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0])
    padded = lambda rows: rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), width - F.size("vec")))))
    asked = written(padded(queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))))
    held = written(padded(_few_equal(vectors, k)).select("vec_id", "vec"))
    filed, cells = built(held, held.count(), per_cell)
    most = budget(asked, filed, cells, k, wanted=wanted)
    found, probes = search(asked, filed, cells, k, most, page, slice_)
    found = written(found)
    drop(asked, held, filed, probes)
    return found, most


def query(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)[0]
