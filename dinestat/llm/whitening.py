"""Whitening of embeddings: rows projected on the leading components, scaled to variance one.

Entries become integers first, so that sums and deviations are exact. The covariance adds
up in tasks from centred rows, one matrix a task; only a matrix of dimension squared and
the numbers that follow from it ever reach the driver, whatever the number of rows. Its
components come from :mod:`dinestat.llm.spectrum`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm import spectrum
from dinestat.llm.common import column, shared

#: ``x = floor(SCALE * c) + OFFSET`` for an entry c.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this are taken as this, so that x is a 64-bit integer.
LARGEST = 2.0**62 / SCALE
#: Rows that a task turns at once; sums of x over so many fit 64 bits where |x| < WIDE.
ROWS = 4096
WIDE = 2**62 // ROWS
LONG = 2**63 - 1


class Fitted(NamedTuple):
    """The fit list's size, sums, eigenvalues, components as rows, and trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


# --- rows of integers ----------------------------------------------------------------


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``, an array of doubles, of the rows whose vector is whole and finite."""
    rows = embeddings.select(
        column(embeddings, id_col).alias("id"),
        column(embeddings, vector_col).cast("array<double>").alias("v"),
    )
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("v").isNotNull() & finite)


def integers(vectors: pa.ListArray, size: int) -> np.ndarray:
    """x of each entry, a row a vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(SCALE * np.clip(flat, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, integers(piece.column(1), size)


def small(x: np.ndarray, factor: int = 1, terms: int = 1) -> bool:
    """Whether ``factor * x``, summed over ``terms``, surely fits 64 bits."""
    return int(np.abs(x).max(initial=0)) * factor * terms < 2**62


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` exactly: as 64-bit integers where they fit, else as Python's."""
    if small(x, n) and small(sums):
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(d: np.ndarray) -> list:
    """Sum of squares of each row, exactly; None where no 64-bit integer holds it."""
    if d.dtype != object and np.abs(d).max(initial=0) < 2**31 and small(d, int(np.abs(d).max(initial=0)), d.shape[1]):
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) * int(v) for v in row) for row in d]
    return [total if total <= LONG else None for total in exact]


# --- fitting -------------------------------------------------------------------------


def totals(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Dimension, number and per-dimension sums of the vectors of the commonest length."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                vectors = batch.column(0).slice(at, ROWS)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes).tolist():
                    own = vectors.filter(pa.array(sizes == size))
                    x = integers(own, size) if size else np.empty((len(own), 0), np.int64)
                    exact = x if small(x, terms=len(x)) else x.astype(object)
                    sums = [str(s) for s in exact.sum(axis=0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([size], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([sums], pa.list_(pa.string()))],
                        names=["size", "n", "sums"],
                    )

    parts = rows.select("v").mapInArrow(run, "size int, n bigint, sums array<string>")
    each = parts.select("size", "n", F.posexplode_outer("sums").alias("place", "s"))
    added = each.groupBy("size", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    # One row a dimension for each length that occurs; the commonest length is wanted.
    best = F.max(F.struct("n", (-F.col("size")).alias("less"))).alias("best")
    size, n = added.agg(best).select(-F.col("best.less"), "best.n").first()
    if not size:
        return 0, 0, np.empty(0)
    found = added.where(F.col("size") == size).orderBy("place").select("s").collect()
    return size, n, np.array([int(r["s"]) for r in found], object)


def added_products(rows: DataFrame, size: int, start: Callable[[], Callable], width: int) -> np.ndarray:
    """Sum of ``zᵀz`` over all rows, z what ``start()`` makes of them, ``width`` columns.

    Each task adds up its own matrix; rows of it are then summed by their number.
    """

    def run(batches):
        turned, total = start(), np.zeros((width, width))
        for _, x in pieces(batches, size):
            z = turned(x)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
            names=["place", "row"],
        )

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for chunk in table.column("row").chunks:
            total += chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).sum(axis=0)
        return pa.table({"place": table.column("place").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    schema = "place int, row array<double>"
    summed = rows.mapInArrow(run, schema).groupBy("place").applyInArrow(added, schema)
    return np.array([r["row"] for r in summed.orderBy("place").collect()]).reshape(width, width)


def fit(rows: DataFrame, size: int, n: int, sums: np.ndarray, most: int) -> Fitted:
    def start():
        return lambda x: (centred(x, n, sums) / n).astype(float)

    v = added_products(rows, size, start, size) / n
    v = (v + v.T) / 2
    values, components = spectrum.leading(v, min(most, size))
    return Fitted(n, sums, values, components, float(np.trace(v)))


def projected(fitted: Fitted, x: np.ndarray) -> np.ndarray:
    z = (centred(x, fitted.n, fitted.sums) / fitted.n).astype(float)
    return z @ fitted.components.T / np.sqrt(fitted.values)


def identity_error(rows: DataFrame, size: int, fitted: Fitted) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from the rows."""
    k = len(fitted.values)
    sent = shared(rows.sparkSession, fitted)

    def start():
        model = sent()

        def turned(x):
            w = projected(model, x)
            return np.concatenate((w, np.ones((len(w), 1))), axis=1)

        return turned

    added = added_products(rows, size, start, k + 1) / fitted.n
    mean = added[k, :k]
    return float(np.abs(added[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


# --- the operator --------------------------------------------------------------------

FIELDS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """Each vector on each leading component: one row per row and component.

    Columns: the id, ``component`` (from 1, by falling eigenvalue), ``n`` (the vectors),
    ``deviation`` (sum over dimensions of (n*x-S)^2, null beyond 64 bits), ``whitened``,
    ``explained`` (the eigenvalue's share of the trace) and ``identity_error``.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are
    those of another length than most (of lengths as frequent, all but the least). Entries
    beyond 64-bit integers count as the largest. Repeated rows and equal or null ids count
    each for itself. Components without variance have no rows, so a single vector, or equal
    ones, give none, nor does an empty table or vectors of no dimension.
    """
    rows = usable(embeddings, id_col, vector_col)
    kind = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T._parse_datatype_string(FIELDS).fields])
    empty = embeddings.sparkSession.createDataFrame([], kind)
    if rows.isEmpty():
        return empty
    size, n, sums = totals(rows)
    if not size:
        return empty
    rows = rows.where(F.size("v") == size)
    fitted = fit(rows.select(F.lit(None).alias("id"), "v"), size, n, sums, components)
    if not len(fitted.values):
        return empty
    error = identity_error(rows.select(F.lit(None).alias("id"), "v"), size, fitted)
    sent = shared(rows.sparkSession, fitted)
    made = T.StructType([T.StructField("id", kind[id_col].dataType), *kind.fields[1:]])

    def run(batches):
        model = sent()
        k = len(model.values)
        explained = model.values / model.trace
        for piece, x in pieces(batches, size):
            each = np.repeat(np.arange(len(x)), k)
            d = pa.array(deviations(centred(x, model.n, model.sums)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)),
                    d.take(pa.array(each)),
                    pa.array(projected(model, x).reshape(-1)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ],
                names=made.names,
            )

    return rows.mapInArrow(run, made).withColumnRenamed("id", id_col)
