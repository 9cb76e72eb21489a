"""What clusterings in rounds share: whole-number vectors, exact distances, sums over batches of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = np.iinfo(np.int64)


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(embeddings: DataFrame, scale: int, *keep: str) -> DataFrame:
    """vec_id, the columns to keep and vec, the components as floor(scale * x), of rows with a number and a finite vector."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & finite("embedding"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def largest(rows: DataFrame) -> int:
    """The greatest absolute component; 0 without any."""
    size = lambda x: F.abs(x.cast("decimal(20)"))
    return int(rows.agg(F.max(F.greatest(size(F.array_max("vec")), size(F.array_min("vec"))))).first()[0] or 0)


class Exact:
    """Squared distances of whole numbers without rounding: in doubles while they stay below 2^53, else in integers of any size."""

    def __init__(self, most: int, width: int):
        self.kind = np.float64 if 4 * most * most * max(1, width) < 2**53 else object

    def matrix(self, vectors, width: int) -> np.ndarray:
        return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), width).astype(self.kind)

    def distances(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """rows x centres."""
        return (rows * rows).sum(1)[:, None] - 2 * (rows @ centres.T) + (centres * centres).sum(1)

    @staticmethod
    def root(squares: np.ndarray) -> np.ndarray:
        return np.sqrt(squares.astype(np.float64))


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centre has moved, a little more than less."""
    return np.sqrt(((new - old) ** 2).sum(-1).astype(np.float64)) * (1 + 1e-12)


def digits(numbers: np.ndarray) -> list[str]:
    return [str(int(x)) for x in numbers.ravel()]


def total(state: DataFrame, length: int) -> np.ndarray:
    """The sums of all batches, integers of any size; sums: arrays of digits in the rows without a number."""
    each = state.where("vec_id IS NULL").select(F.posexplode("sums").alias("at", "x"))
    out = np.zeros(length, object)
    for r in each.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # length rows
        out[r["at"]] = int(r["x"])
    return out


def longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers, held at the ends of a long."""
    return (values if values.dtype != object else np.minimum(np.maximum(values, LONG.min), LONG.max)).astype(np.int64)
