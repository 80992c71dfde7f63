"""Whitening of vectors: principal components of exactly centred rows, scaled to unit variance.

Sums are exact integers, so every row is centred without rounding before it is
multiplied. Spark MLlib's ``RowMatrix`` adds up the Gramian of the centred
rows; divided by n it is the covariance, whose eigenvectors are found on the
driver (its size is the square of the vector's length, whatever the number of
rows) and broadcast to the tasks that project the rows. A second Gramian, of
the whitened rows, measures how far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

SCALE, SHIFT = 1024, 100_000
#: Entries of this size and more, times ``SCALE``, have no exact place beside ``SHIFT`` in 64 bits.
LARGEST = float(2**52)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, x array<long>`` of the rows that have a whole finite vector: floor(1024 * c) + 100000."""
    c = F.col("embedding")
    whole = F.forall(c, lambda e: e.isNotNull() & (F.abs(e.cast("double")) * SCALE < LARGEST))  # NaN is above every number
    x = F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long") + F.lit(SHIFT))
    return vectors.select("vec_id", F.when(c.isNotNull() & (F.size(c) > 0) & whole, x).alias("x")).where("x is not null")


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length of the vectors: how many there are, and the exact sum of each place."""
    places = rows.select(F.size("x").alias("size"), F.posexplode("x").alias("at", "x"))
    sums = places.groupBy("size", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("size", "at").collect():  # a row a place
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _gramian(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of the ``array<double>`` column ``row``."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row")
    return RowMatrix(vectors, numCols=size).computeGramianMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors (as columns) and eigenvalues of the ``most`` greatest, by falling eigenvalue, and the trace."""
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    return vector[:, ::-1][:, :most], value[::-1][:most], float(np.trace(covariance))


def _centred(x: pd.Series, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S of a batch, as exact integers: 64-bit ones where they suffice, else Python's."""
    flat = np.stack(x.to_numpy())
    most = n * max(abs(int(flat.max())), abs(int(flat.min()))) + max(abs(int(s)) for s in sums)
    if most < 2**63:
        return n * flat - sums.astype(np.int64)
    return n * flat.astype(object) - sums


def _deviation(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where 64 bits do not hold one."""
    most = max(abs(int(d.max())), abs(int(d.min())))
    if d.dtype != object and most * most * d.shape[1] >= 2**63:
        d = d.astype(object)
    return [int(v) if v < 2**63 else None for v in (d * d).sum(1)]


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """Per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty, or holds a null or non-finite entry (or
    one of 2^42 or more, which has no exact 64-bit place) are left out of the
    fit and the result. Vectors of another length are another fit list. A
    component without variance, as in a single row, equal rows, or beyond the
    rank, has ``whitened`` 0 and takes no part in ``identity_error``. Rows with
    a null or repeated vec_id count each; an empty table gives no rows; further
    columns are not read. ``deviation`` is null where 64 bits do not hold it.
    """
    spark = vectors.sparkSession
    rows = integer_rows(vectors)
    done = [_whiten(rows.where(F.size("x") == size), n, sums, most) for size, (n, sums) in _sums(rows).items()]
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], RESULT)


def _whiten(rows: DataFrame, n: int, sums: list[int], most: int) -> DataFrame:
    spark = rows.sparkSession
    size, s = len(sums), np.array(sums, object)
    most = min(most, size)

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"row": list((_centred(batch["x"], n, s) / n).astype(float))})

    covariance = _gramian(rows.select("x").mapInPandas(centred, "row array<double>"), size) / n
    vector, value, trace = components(covariance, most)
    real = value > max(trace, 0.0) * 1e-12
    scale = np.where(real, 1 / np.sqrt(np.where(real, value, 1.0)), 0.0)
    shared = spark.sparkContext.broadcast((s, vector * scale))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, matrix = shared.value
        for batch in batches:
            if len(batch):
                d = _centred(batch["x"], n, sums)
                row = (d / n).astype(float) @ matrix
                yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": pd.array(_deviation(d), "Int64"), "row": list(row)})

    # ids travel as text: pandas would turn them into doubles beside a null
    done = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(project, "vec_id string, deviation long, row array<double>")
    done = stash(done.withColumn("vec_id", F.col("vec_id").cast("long")))
    mean = np.array([r[1] for r in done.select(F.posexplode("row").alias("at", "v")).groupBy("at").agg(F.avg("v")).orderBy("at").collect()])
    again = done.select(F.zip_with("row", F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b).alias("row"))
    off = np.abs(_gramian(again, most) / n - np.eye(most))[np.ix_(real, real)]
    share = [float(v) / trace if r else 0.0 for v, r in zip(value, real)]
    return done.select("vec_id", "deviation", F.posexplode("row").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, share)), F.col("at")).alias("explained"),
        F.lit(float(off.max()) if off.size else 0.0).alias("identity_error"),
    )
