"""Product codes by k-means with adaptive bounds on the closest entries of each part.

Vectors are cut into equal parts, and each part position has a codebook. For each
part of each vector are kept: its b closest entries in order, an upper bound of the
distance to the first, lower bounds for the others that rise along the order, and
one outer bound below which no further entry lies. When a codebook moves, the
upper bound grows by the drift of its entry, the lower ones shrink by theirs, the
outer one by the greatest drift; a running minimum from outside keeps them ordered.
A part whose upper bound lies below the next bound keeps its entry. Otherwise its
distance is taken exactly; if that does not settle it, the fewest closest entries
that a bound closes off are compared in whole numbers and put in order again, and
only where none does are all entries compared. After each round b falls to what
nearly all unsettled parts of the round needed.

Vectors stay where they are: a round reads a table of vectors with their bounds
and writes the next one, batch by batch. Of each batch the sums of what entered
entries, less what left them, and how many bounds were needed, are one further
row; these rows are added up on Spark, and some numbers for each component of the
codebooks come to the driver, which moves them.

Defined results: vectors that are null or hold a null or non-finite component and
rows without vec_id take no part; shorter vectors are padded with zeros to the
longest and to a multiple of the parts; repeated rows are vectors of their own,
and of rows with one number the smaller vector starts first; fewer vectors than
entries make smaller codebooks; equal distances go to the lower index; null labels
are one label; an empty table gives an empty result; errors beyond a long are held
at its end; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small, table, written
from .rounds import LONG, Exact, digits, drift, largest, longs, total, whole

STATE = "vec_id long, {label} vec array<long>, near binary, bounds binary, error long, sums array<string>"
#: Share of the distances' size by which bounds have to differ to be trusted: rounding is far below it.
SLACK = 1e-9
#: Fewest entries with bounds of their own, and the share of unsettled parts that b has to serve.
LEAST, SERVED = 2, 0.95


class Bounds:
    """Closest entries (points x b) and bounds (points x b + 1: upper, then lower ones, the outer one last) of the parts of a batch."""

    def __init__(self, near: np.ndarray, bounds: np.ndarray):
        self.near, self.bounds = near, bounds

    @classmethod
    def read(cls, near, bounds, b: int) -> Bounds:
        return cls(np.frombuffer(b"".join(near), np.uint8).reshape(-1, b).astype(np.int64), np.frombuffer(b"".join(bounds), np.float64).reshape(-1, b + 1).copy())

    def shrink(self, b: int) -> None:
        """b entries stay; the outer bound takes in the bounds of those that go."""
        outer = self.bounds[:, b:].min(1)
        self.near, self.bounds = self.near[:, :b], np.concatenate([self.bounds[:, :b], outer[:, None]], 1)

    def moved(self, drifts: np.ndarray) -> None:
        """drifts: of each point's part, points x entries."""
        own = np.take_along_axis(drifts, self.near, 1)
        self.bounds[:, 0] += own[:, 0]
        self.bounds[:, 1:-1] -= own[:, 1:]
        self.bounds[:, -1] -= drifts.max(1)
        # each bound holds for all that lie further out, too
        self.bounds[:, 1:] = np.minimum.accumulate(self.bounds[:, :0:-1], 1)[:, ::-1]


def assign(data: np.ndarray, books: np.ndarray, held: Bounds | None, b: int, slack: float) -> tuple[Bounds, np.ndarray]:
    """(the parts' closest entries and bounds, how many parts needed 0 to entries entries compared); data: points x components, in part order over and over; books: parts x entries x components."""
    parts, entries, _ = books.shape
    part = np.arange(len(data)) % parts
    if held is None:
        held, open_ = Bounds(np.zeros((len(data), b), np.int64), np.zeros((len(data), b + 1))), np.arange(len(data))
        needed = np.full(len(data), entries)
    else:
        clear = lambda rows: held.bounds[rows, 0] < held.bounds[rows, 1] - slack
        open_ = np.flatnonzero(~clear(np.arange(len(data))))
        own = books[part[open_], held.near[open_, 0]]
        held.bounds[open_, 0] = np.sqrt(((data[open_] - own) ** 2).sum(1).astype(np.float64))
        open_ = open_[~clear(open_)]
        # the first bound beyond the distance closes off the entries before it
        beyond = held.bounds[open_, :1] < held.bounds[open_, 1:] - slack
        needed = np.where(beyond.any(1), beyond.argmax(1) + 1, entries)
    counts = np.bincount(needed, minlength=entries + 1)
    counts[0] += len(data) - len(open_)
    for q in np.unique(needed).tolist():
        rows = open_[needed == q]
        if q == entries:
            squares = np.concatenate([_squares(data[rows[part[rows] == p]], books[p]) for p in range(parts)])
            rows = np.concatenate([rows[part[rows] == p] for p in range(parts)])
            which = np.broadcast_to(np.arange(entries), squares.shape)
        else:
            which = held.near[rows, :q]
            squares = ((data[rows][:, None] - books[part[rows][:, None], which]) ** 2).sum(2)
        order = np.lexsort((which, squares.astype(object) if squares.dtype == object else squares), axis=1)
        which, far = np.take_along_axis(which, order, 1), np.sqrt(np.take_along_axis(squares, order, 1).astype(np.float64))
        if q == entries:
            held.near[rows] = which[:, :b]
            held.bounds[rows] = far[:, : b + 1] if entries > b else np.concatenate([far, np.full((len(far), 1), np.inf)], 1)
        else:
            held.near[rows, :q] = which
            # what lies inside is exact, what lies outside keeps its bound
            held.bounds[rows, :q] = far
            held.bounds[rows, 1:q] = np.minimum(far[:, 1:], held.bounds[rows, q][:, None])
    return held, counts


def _squares(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(1)


def assigned(state: DataFrame, books: np.ndarray, drifts: np.ndarray | None, before: int, b: int, exact: Exact, slack: float, last: bool, kind: str) -> DataFrame:
    """The state after one assignment, with a row of sums for each batch; before: how many entries with bounds the state holds, b: how many the next one shall hold."""
    parts, entries, size = books.shape
    width, books = parts * size, books.astype(exact.kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = exact.matrix(batch["vec"].tolist(), width).reshape(-1, size)
            part = np.arange(len(data)) % parts
            old = held = None
            if drifts is not None:
                held = Bounds.read(batch["near"], batch["bounds"], before)
                old = held.near[:, 0].copy()
                held.shrink(b)
                held.moved(drifts[part])
            held, counts = assign(data, books, held, b, slack)
            new = held.near[:, 0]
            sums = np.zeros((parts, entries, size + 1), object)
            moved = np.arange(len(data)) if old is None else np.flatnonzero(new != old)
            for sign, place in ((1, new), (-1, old)):
                if place is not None:
                    at = part[moved] * entries + place[moved]
                    for k in np.unique(at).tolist():
                        rows = moved[at == k]
                        sums[k // entries, k % entries] += sign * np.array([*(int(x) for x in data[rows].sum(0)), len(rows)], object)
            error = longs(((data - books[part, new]) ** 2).reshape(len(batch), width).sum(1)) if last else np.full(len(batch), -1)
            bytes_ = lambda x, kind: [r.tobytes() for r in np.ascontiguousarray(x, kind).reshape(len(batch), -1)]
            yield batch[["vec_id", "label", "vec"]].assign(near=bytes_(held.near, np.uint8), bounds=bytes_(held.bounds, np.float64), error=error, sums=None)
            yield pd.DataFrame({**dict.fromkeys(("vec_id", "label", "vec", "near", "bounds", "error"), [None]), "sums": [[*digits(sums), *digits(counts)]]})

    return state.where("vec_id IS NOT NULL").mapInPandas(run, STATE.format(label=f"label {kind},"))


def fewer(counts: np.ndarray, b: int) -> int:
    """The b of the next round: what serves nearly all parts that some bound served in this one."""
    used = counts[1 : b + 1]
    return max(min(LEAST, b), int(np.searchsorted(np.cumsum(used), SERVED * used.sum())) + 1) if used.sum() else b


def trained(vectors: DataFrame, starts: np.ndarray, rounds: int, exact: Exact) -> tuple[DataFrame, np.ndarray, list[tuple[int, list[int]]]]:
    """(vec_id, label, near and error, a written table; the codebooks; of each assignment b and how many parts compared 0, 1 ... entries). vectors hold vec_id, label and vec; starts: parts x entries x components."""
    parts, entries, size = starts.shape
    b = before = max(min(LEAST, entries), entries // 2)
    books, sums, drifts, told = starts, np.zeros((parts, entries, size + 1), object), None, []
    slack = SLACK * (1 + float(abs(starts).max(initial=0)) * 2 * max(1, size) ** 0.5)
    kind = vectors.schema["label"].dataType.simpleString()
    state, last = vectors.select("vec_id", "label", "vec", F.lit(None).cast("binary").alias("near"), F.lit(None).cast("binary").alias("bounds")), None
    for at in range(rounds + 1):
        state = written(assigned(state, books, drifts, before, b, exact, slack, at == rounds, kind))
        if last is not None:
            drop(last)
        last, before = state, b
        change = total(state, sums.size + entries + 1)
        counts = change[sums.size :].astype(np.int64)
        told.append((b, counts.tolist()))
        sums = sums + change[: sums.size].reshape(sums.shape)
        if at < rounds:
            n = sums[:, :, -1:]
            moved = np.where(n > 0, sums[:, :, :-1] // np.where(n > 0, n, 1), books)
            drifts, books = drift(books, moved), moved
            if at:
                b = fewer(counts, b)
    return state.where("vec_id IS NOT NULL").select("vec_id", "label", "near", "error"), books, told


def coded(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, the error of all rows with the same label, and the hash of the codebooks."""
    if "label" not in embeddings.columns:
        embeddings = embeddings.withColumn("label", F.lit(None).cast("int"))
    vectors = whole(embeddings, scale, "label")
    width = vectors.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    size = max(1, -(-width // parts))
    vectors = vectors.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), size * parts - F.size("vec")))))
    first = vectors.select("vec_id", "vec").orderBy("vec_id", "vec").limit(entries).collect()  # a row for each entry
    starts = np.array([[int(x) for x in r["vec"]] for r in first], object).reshape(len(first), parts, size).transpose(1, 0, 2)
    if not first:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows, books, _ = trained(vectors, starts, rounds, Exact(largest(vectors), size))
    sha = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    errors = written(rows.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(int(LONG.max)).cast("decimal(38,0)")).cast("long").alias("label_error")))
    b = F.length("near") / parts
    code = F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.hex(F.substring("near", (p * b + 1).cast("int"), F.lit(1)))), ""))
    return rows.join(small(errors), F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        """WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, e[p * (len(e) // 8) + 1 : (p + 1) * (len(e) // 8)] AS e FROM w, range(8) AS r(p)),
c0 AS MATERIALIZED (SELECT p, k, e FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id, e) - 1 AS k FROM w QUALIFY k < 16) USING (vec_id))"""
    ]
    for i in range(7):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, e, best.k AS k, best.d AS d FROM (SELECT v.vec_id, v.p, v.e, min({{'d': {near}, 'k': c.k}}) AS best FROM v JOIN c{i} AS c USING (p) GROUP BY ALL))")
        if i < 6:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM (SELECT p, k, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, k, e, unnest(range(1, len(e) + 1)) AS i FROM a{i}) GROUP BY p, k, i) GROUP BY p, k),
c{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (p, k))""")
    return ",\n".join(steps) + """,
books AS (SELECT sha256(array_to_string(flatten(list(e ORDER BY p, k)), ',')) AS h FROM c6),
codes AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM codes JOIN w USING (vec_id), books"""  # fmt: skip


SQL = _sql()
