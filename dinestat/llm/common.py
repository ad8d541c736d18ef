"""What the operators share: mapping texts in tasks, word spans, bounded samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.sources.parquet import settle

#: Bytes of text handed to a kernel at once; a longer text goes alone.
PIECE_BYTES = 2_000_000

#: Maps A-Z to a-z and every other ASCII byte but digits and letters to a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32
    for b in range(256)
)

Kernel = Callable[[list], Sequence]


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return df["`" + name.replace("`", "``") + "`"]


def pieces(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about PIECE_BYTES of text, a row at least."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + PIECE_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def per_text(
    docs: DataFrame,
    keep: Iterable[str],
    text: str,
    start: Callable[[], Kernel],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """One row per row of ``docs``: the kept columns, then what a kernel makes of the text.

    ``start()`` runs once per task and returns the kernel, which turns a list of texts
    (null as an empty one) into one list or array per field. No row moves between tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = list(keep)
    chosen = docs.select(
        *(column(docs, name).alias(f"kept_{i}") for i, name in enumerate(keep)),
        F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"),
    )
    made = T.StructType(list(fields))
    schema = T.StructType([*chosen.schema.fields[:-1], *made.fields])
    types = [f.type for f in to_arrow_schema(made)]
    names = schema.names

    def run(batches):
        kernel = start()
        for batch in batches:
            for piece in pieces(batch, len(keep)):
                out = kernel(piece.column(len(keep)).to_pylist())
                new = [
                    v if isinstance(v, pa.Array) else pa.array(v, t)
                    for v, t in zip(out, types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *new], names=names)

    result = chosen.mapInArrow(run, schema)
    return result.select(
        *(F.col(f"kept_{i}").alias(name) for i, name in enumerate(keep)), *made.names
    )


def spans_of_words(blanked: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which runs of non-blank bytes start and end."""
    solid = np.frombuffer(blanked, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    return edges[0::2], edges[1::2]


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit integers stirred so that near inputs give unrelated outputs."""
    v = values.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        v ^= v >> np.uint64(shift)
        v *= np.uint64(factor)
    return v ^ (v >> np.uint64(33))


def counted(df: DataFrame, count: Callable[[], Callable], schema: str) -> DataFrame:
    """Counts ``n`` by the key columns of ``schema``, over all rows of ``df``.

    ``count()`` runs once per task and returns a function that counts the keys of one
    batch; batches are summed in tasks before anything moves.
    """
    keys = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        counter = count()
        for batch in batches:
            found = counter(batch)
            if found:
                rows = [(*(k if isinstance(k, tuple) else (k,)), n) for k, n in found.items()]
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n"])

    return df.mapInArrow(run, schema + ", n bigint").groupBy(*keys).agg(F.sum("n").alias("n"))


def shared(spark: SparkSession, value) -> Callable:
    """Sends a fitted model of bounded size to tasks; calling the result there gives it.

    Classes of this package go along by value, which a plain broadcast does not do.
    """
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(box.value)


def bounded_sample(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The ``n`` rows least by hash of ``key``, the same ones on every run.

    Only for fitting models: ``n`` bounds what is fitted on, not what is scored. Of many
    rows only those that hash low enough are ordered, about twice as many as are wanted,
    so what tasks send does not grow with their number. Where few keys fill the table,
    so that fewer rows hash low, the sample is smaller.
    """
    order = F.xxhash64(*(column(rows, k).cast("string") for k in key))
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(order < F.lit(int(-(2**63) + 2**64 * (2 * n / total))).cast("bigint"))
    return rows.orderBy(order, *(column(rows, k) for k in key)).limit(n)


def learnable(doc_id: Column) -> Column:
    """Rows a model may learn from; the others, a quarter, are held out."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` named by a bounded sample of ``labels``, with the label columns.

    The sample is written first and holds at most ``n`` ids, so joining it moves no text.
    """
    sample = settle(bounded_sample(labels, n, id_col))
    return docs.join(F.broadcast(sample), id_col)


__all__ = [
    "WORD_BYTES",
    "bounded_sample",
    "column",
    "counted",
    "held_out",
    "labelled_texts",
    "learnable",
    "mixed",
    "per_text",
    "settle",
    "shared",
    "spans_of_words",
]
