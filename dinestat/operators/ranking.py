"""Numbering the rows of a whole table in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges a table is cut into for numbering.
RANGES = 64


def number_rows(df: DataFrame, value: str, tie: str, name: str = "rank") -> DataFrame:
    """``df`` plus row numbers 1..n by ``value`` descending (nulls last), then ``tie``.

    Rows are numbered within value ranges, in parallel, and each range starts after
    the rows of the ranges above it; those counts are at most ``RANGES + 1`` numbers.
    ``df`` is read three times, so pass a written table.
    """
    steps = [i / RANGES for i in range(1, RANGES)]
    cuts = df.agg(F.percentile_approx(value, steps, 1000).alias("cuts")).scalar()
    higher_cuts = F.size(F.filter("_cuts", lambda cut: cut > F.col(value)))
    range_of = F.when(F.col(value).isNull(), RANGES).otherwise(higher_cuts)
    ranged = df.withColumn("_cuts", cuts).withColumn("_range", range_of).drop("_cuts")

    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"))
    all_sizes = sizes.agg(F.collect_list(F.struct("_range", "rows")).alias("sizes")).scalar()
    earlier = F.filter("_sizes", lambda size: size["_range"] < F.col("_range"))
    start = F.aggregate(earlier, F.lit(0).cast("bigint"), lambda total, size: total + size["rows"])

    by_value = Window.partitionBy("_range").orderBy(F.col(value).desc_nulls_last(), tie)
    numbered = ranged.withColumn("_place", F.row_number().over(by_value))
    placed = numbered.withColumn("_sizes", all_sizes).withColumn(name, start + F.col("_place"))
    return placed.drop("_range", "_place", "_sizes")
