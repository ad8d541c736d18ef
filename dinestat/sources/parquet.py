"""Parquet sources and sinks for order items and metric datasets."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.operators.shape import concatenate, rearrange_columns
from dinestat.sources.schema import DATASETS, ORDER_ITEMS

#: Storage schemes a job may write to unless the caller names others.
DEFAULT_SCHEMES = ("s3a",)
#: Codec of all that is written. Datasets take about three quarters of what they take by default.
CODEC = "zstd"
#: A step is taken in so many slices at most, one for each so many bytes that it reads.
MOST_SLICES, SLICE_BYTES = 3, 32 * 2**20


def read_order_items(
    spark: SparkSession, path: str, schema: T.StructType = ORDER_ITEMS
) -> DataFrame:
    """Order items in canonical form. Only the columns a query uses are scanned."""
    return rearrange_columns(_existing(spark.read, path, "order items"), schema)


def _existing(reader: DataFrameReader, path: str, name: str) -> DataFrame:
    """Parquet data at ``path``; FileNotFoundError when there is none."""
    missing = FileNotFoundError(f"no Parquet files for {name} at {path}")
    try:
        df = reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise missing from error
        raise
    # With a stated schema a folder without files reads as no rows. File names are
    # asked for only then, as there may be very many.
    if df.isEmpty() and not df.inputFiles():
        raise missing
    return df


def output_path(path: str | None, schemes: tuple[str, ...] | None = DEFAULT_SCHEMES) -> str | None:
    """Base path ending in one slash, or None when nothing is to be written.

    ``schemes`` lists the accepted URI schemes; None accepts any path.
    """
    if not path:
        return None
    if schemes is not None and path.partition("://")[0] not in schemes:
        accepted = ", ".join(f"{scheme}://" for scheme in schemes)
        raise ValueError(f"output path must start with {accepted}: {path}")
    return path.rstrip("/") + "/"


def write_metric(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    sort_by: Sequence[str] = (),
    only_folders: bool = False,
) -> None:
    """Overwrite a Parquet dataset, optionally in ``column=value`` folders.

    Before a partitioned write, rows are gathered by folder so that each gets few
    files. REBALANCE lets adaptive execution cut a folder that holds much of the
    data into several tasks, and merge small ones, by the sizes it measured. Within a
    task, rows are put in the order of ``sort_by``.

    ``only_folders`` replaces just those folders that ``df`` has rows for and leaves all
    others as they are; a folder whose value no longer occurs is one of those others.
    """
    if partition_by is None:
        rows = df.sortWithinPartitions(*sort_by) if sort_by else df
        with _shuffles_end_with_steps(df.sparkSession):
            rows.write.mode("overwrite").parquet(path, compression=CODEC)
        return
    gathered = df.hint("rebalance", partition_by)
    if sort_by:
        gathered = gathered.sortWithinPartitions(partition_by, *sort_by)
    mode = "dynamic" if only_folders else "static"
    writer = gathered.write.mode("overwrite").option("partitionOverwriteMode", mode)
    with _shuffles_end_with_steps(df.sparkSession):
        writer.partitionBy(partition_by).parquet(path, compression=CODEC)


def dataset_path(base: str, key: str) -> str:
    """Where a job run under ``base`` keeps one of its datasets."""
    return base.rstrip("/") + "/" + DATASETS[key].folder


def write_dataset(df: DataFrame, path: str, key: str, only_folders: bool = False) -> None:
    """Write one of the known datasets with its declared columns, types and folders."""
    dataset = DATASETS[key]
    typed = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in dataset.schema))
    write_metric(typed, path, dataset.partition_by, dataset.sort_by, only_folders)


def read_dataset(
    spark: SparkSession, path: str, key: str, schema: T.StructType | None = None
) -> DataFrame:
    """One written dataset: all its files, folder values as typed columns.

    The declared schema keeps folder values such as ``007`` as text; left to
    inference they would turn into numbers and no longer join.
    """
    wanted = schema or DATASETS[key].schema
    return _existing(spark.read.schema(wanted), path, f"dataset {key!r}").select(*wanted.names)


def read_runs(spark: SparkSession, paths: Sequence[str], key: str) -> DataFrame:
    """One dataset of several job runs, whose columns and types may differ, as one table.

    Each run is read as it was written, but for folder values, which have the declared
    types; :func:`concatenate` says how columns meet.
    """
    declared = DATASETS[key].schema
    folder = DATASETS[key].partition_by

    def run(path: str) -> DataFrame:
        found = _existing(spark.read, path, f"dataset {key!r}").schema
        kinds = [declared[f.name] if f.name == folder else f for f in found]
        return spark.read.schema(T.StructType(kinds)).parquet(path)

    return concatenate(*map(run, paths))


def drop_folders(spark: SparkSession, path: str, partition_by: str, values: Sequence[str]) -> None:
    """Remove the folders of some values of a partitioned dataset, where they exist."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    settings = spark._jsc.hadoopConfiguration()
    for value in values:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{partition_by}={escape(value)}")
        folder.getFileSystem(settings).delete(folder, True)


def load_metrics(spark: SparkSession, base: str, views: bool = False) -> dict[str, DataFrame]:
    """All datasets of a job run by key, lazily; ``views`` also registers temp views."""
    metrics = {key: read_dataset(spark, dataset_path(base, key), key) for key in DATASETS}
    if views:
        for key, df in metrics.items():
            df.createOrReplaceTempView(key)
    return metrics


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the session names.

    A local session without one gets a scratch folder; a cluster must name it, as
    a folder on one machine would be lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dinestat-"))
    return spark.sparkContext.getCheckpointDir()


#: Tables settled within the scopes that are open, one list a scope.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of a ``with`` block, every table that was settled inside it.

    Use or write what depends on them before the block ends. Outside of any block, settled
    tables stay in the checkpoint folder. Blocks nest: a table goes with the innermost one.
    Threads that a block starts count as inside.
    """
    _SCOPES.append(made := [])
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it, where it exists."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sessions with writes under way: their number and the setting there was before.
_STEPS: dict[SparkSession, list] = {}
_STEPS_LOCK = threading.Lock()


@contextmanager
def _shuffles_end_with_steps(spark: SparkSession) -> Iterator[None]:
    """Within the block, a write that ends removes its shuffle files from all executors.

    Spark by itself keeps them until the driver happens to collect its garbage, so that a
    job of many steps would hold the shuffles of nearly all of them at its end.
    """
    with _STEPS_LOCK:
        under_way = _STEPS.setdefault(spark, [0, spark.conf.get(_CLEANUP, None)])
        under_way[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _STEPS_LOCK:
            under_way[0] -= 1
            if not under_way[0]:
                _, former = _STEPS.pop(spark)
                spark.conf.unset(_CLEANUP) if former is None else spark.conf.set(_CLEANUP, former)


def settle(
    df: DataFrame, partition_by: str | None = None, slices_of: str | None = None
) -> DataFrame:
    """Write a table that several later steps need and return it as read back.

    Cuts the lineage without depending on any executor, and gives the optimizer the
    true size, by which it decides whether the table may be broadcast. ``partition_by``
    keeps a folder for each value of a column, so that a selection reads only its own.

    ``slices_of`` names a column whose values may be taken apart: a large table is then made
    in several steps, each of which shuffles just the rows of its own values. Name a column
    that filters reach the sources by, such as a key of the joins or groups.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    for rows in [df] if slices_of is None else _slices(df, slices_of):
        writer = rows.write if partition_by is None else rows.write.partitionBy(partition_by)
        with _shuffles_end_with_steps(df.sparkSession):
            writer.mode("append").parquet(path, compression=CODEC)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return read if partition_by is None else read.select(*df.columns)


def _slices(df: DataFrame, column: str) -> list[DataFrame]:
    """``df`` in parts by a hash of the column; whole where its sources are small."""
    sources = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(sources.apply(i).stats().sizeInBytes() for i in range(sources.size()))
    count = min(MOST_SLICES, -(-size // SLICE_BYTES))
    if count < 2:
        return [df]
    slice_of = F.pmod(F.xxhash64(column), F.lit(count))
    return [df.where(slice_of == i) for i in range(count)]
