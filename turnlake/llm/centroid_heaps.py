"""Clustering with heap-ordered bounds: exact k-means that rescans only vectors whose bound has run out.

A vector's gap is the distance to the second nearest centroid less that to its
own. While centroids move, the gap shrinks by no more than its own centroid's
drift and the greatest drift of the others. Both are added up in one offset for
each cluster, so a vector keeps the key that it got when it was last scanned: its
gap plus its cluster's offset at that time. Each cluster's vectors of a batch form
a heap of these keys. A round pops keys from the heaps until the least one is
beyond its cluster's offset; only the popped vectors are compared with all
centroids, in whole numbers, and go to the heap of their new cluster.

Vectors stay where they are: a round reads a table of vectors with their cluster
and key and writes the next one, batch by batch. Of each batch the componentwise
sums of what entered clusters, less what left them, are one further row; these
rows are added up on Spark, and (components + 1) x clusters numbers come to the
driver, which moves the centroids by them.

Defined results: vectors that are null, hold a null or non-finite component or
have another length, and rows without vec_id take no part; repeated rows are
vectors of their own, and of rows with one number the smaller vector starts
first; fewer vectors than clusters make fewer clusters; equal distances go to the
smaller number; an empty table gives an empty result; distances and inertias
beyond a long are held at its end; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table, written
from .rounds import LONG, Exact, digits, drift, largest, longs, total, whole

STATE = "vec_id long, vec array<long>, cluster int, key double, distance long, sums array<string>"
#: Share of the distances' size by which a key has to be beyond its offset to be trusted: rounding is far below it.
SLACK = 1e-9


def expired(clusters: np.ndarray, keys: np.ndarray, offsets: np.ndarray, slack: float) -> np.ndarray:
    """The rows whose key its cluster's offset has reached, and those without a cluster."""
    found = np.flatnonzero(clusters < 0).tolist()
    for c in np.unique(clusters[clusters >= 0]).tolist():
        rows = np.flatnonzero(clusters == c)
        heap = list(zip(keys[rows].tolist(), rows.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= offsets[c] + slack:
            found.append(heapq.heappop(heap)[1])
    return np.array(sorted(found), np.int64)


def assigned(state: DataFrame, centres: np.ndarray, offsets: np.ndarray, exact: Exact, slack: float, last: bool = False) -> DataFrame:
    """The state after one assignment, with a row of sums for each batch; last: with the distance of every vector. sums end with the number of vectors rescanned."""
    k, width = centres.shape
    centres = centres.astype(exact.kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            old, keys = batch["cluster"].to_numpy(np.int64), batch["key"].to_numpy(np.float64).copy()
            data = exact.matrix(batch["vec"].tolist(), width)
            rows = expired(old, keys, offsets, slack)
            new = old.copy()
            if len(rows):
                squares = exact.distances(data[rows], centres)
                new[rows] = squares.argmin(1)  # the first of equal ones
                near = np.sort(Exact.root(squares), 1)
                keys[rows] = (near[:, 1] - near[:, 0] if k > 1 else np.inf) + offsets[new[rows]]
            moved = np.flatnonzero(new != old)
            sums = np.zeros((k, width + 1), object)
            for c in range(k):
                into, out = moved[new[moved] == c], moved[old[moved] == c]
                sums[c] = [int(x) for x in data[into].sum(0) - data[out].sum(0)] + [len(into) - len(out)]
            far = longs(((data - centres[new]) ** 2).sum(1)) if last else np.full(len(batch), -1)
            yield batch[["vec_id", "vec"]].assign(cluster=new.astype(np.int32), key=keys, distance=far, sums=None)
            yield pd.DataFrame({"vec_id": [None], "vec": [None], "cluster": [None], "key": [None], "distance": [None], "sums": [[*digits(sums), str(len(rows))]]})

    return state.where("vec_id IS NOT NULL").mapInPandas(run, STATE)


def cluster(vectors: DataFrame, starts: np.ndarray, rounds: int, exact: Exact) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster and distance, a written table; the final centroids; how many vectors each assignment rescanned). vectors hold vec_id and vec."""
    k, width = starts.shape
    centres, sums, offsets, scanned = starts, np.zeros((k, width + 1), object), np.zeros(k), []
    slack = SLACK * (1 + float(abs(starts).max(initial=0)) * 2 * max(1, width) ** 0.5)
    state, before = vectors.select("vec_id", "vec", F.lit(-1).alias("cluster"), F.lit(0.0).alias("key")), None
    for at in range(rounds + 1):
        state = written(assigned(state, centres, offsets, exact, slack, at == rounds))
        if before is not None:
            drop(before)
        before = state
        change = total(state, k * (width + 1) + 1)
        scanned.append(int(change[-1]))
        sums = sums + change[:-1].reshape(k, width + 1)
        if at < rounds:
            moved = np.array([[x // s[-1] for x in s[:-1]] if s[-1] else c for s, c in zip(sums.tolist(), centres.tolist(), strict=True)], object).reshape(k, width)
            far = drift(centres, moved)
            others = np.array([np.delete(far, c).max(initial=0.0) for c in range(k)])
            centres, offsets = moved, offsets + far + others
            slack = max(slack, SLACK * (1 + float(offsets.max(initial=0))))
    return state.where("vec_id IS NOT NULL").select("vec_id", "cluster", "distance"), centres, scanned


def first_by_hash(vectors: DataFrame, k: int, width: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of "1:<vec_id>", in its order."""
    number = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(number.alias("number"), "vec").orderBy("number", "vec").limit(k).collect()  # k rows
    return np.array([[int(x) for x in r["vec"]] for r in rows], object).reshape(len(rows), width)


def digest(centre) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def clustered(embeddings: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and the hash of the centroid."""
    vectors = whole(embeddings, scale).where(F.size("vec") == width)
    starts = first_by_hash(vectors, clusters, width)
    rows, centres, _ = cluster(vectors, starts, rounds, Exact(largest(vectors), width))
    held = {r["cluster"]: int(r["x"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}  # a row for each cluster
    end = lambda x: min(x, int(LONG.max))
    facts = [(c, end(held.get(c, 0)), end(sum(held.values())), digest(x)) for c, x in enumerate(centres)]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        """WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1)::INTEGER AS k, e FROM v QUALIFY k < 16)"""
    ]
    for i in range(4):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, e, best.k AS k, best.d AS d FROM (SELECT v.vec_id, v.e, min({{'d': {near}::BIGINT, 'k': c.k}}) AS best FROM v CROSS JOIN c{i} AS c GROUP BY ALL))")
        if i < 3:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (SELECT k, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(i) GROUP BY k, i) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (k))""")
    return ",\n".join(steps) + """
SELECT vec_id, a3.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.e, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (k)"""  # fmt: skip


SQL = _sql()
