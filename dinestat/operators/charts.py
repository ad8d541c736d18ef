"""Tables that feed charts: histograms, box plots, stacked bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinestat.operators.quantiles import exact_quantiles

# Fixed value: most bins a histogram draws.
BINS = 30


def histogram(
    df: DataFrame,
    column: str,
    by: str,
    bins: int = BINS,
    bounds: tuple[float, float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Row counts of each ``by`` value in equal-width bins over the column's range.

    The largest value falls into the last bin. ``bounds`` saves the pass that finds
    the range. A ``weight`` column says how many rows one row stands for. Null groups
    and values are left out.
    """
    stands_for = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(by, F.col(column).cast("double").alias("x"), stands_for.alias("rows"))
    rows = rows.filter(F.col(by).isNotNull() & F.col("x").isNotNull())
    if bounds is None:
        ends = rows.agg(F.struct(F.min("x"), F.max("x"))).scalar()
        low, high = ends["col1"], ends["col2"]
    else:
        low, high = (F.lit(float(end)) for end in bounds)
    # A range of one single value has no width to divide: all its rows are in bin 1.
    bucket = F.coalesce(F.width_bucket("x", low, high, F.lit(bins)), F.lit(1))
    bin_of = F.least(bucket, F.lit(bins))
    counts = rows.groupBy(by, bin_of.alias("bin")).agg(F.sum("rows").cast("bigint").alias("count"))
    return counts.withColumn("bin_start", low + (high - low) * (F.col("bin") - 1) / bins)


def box_feed(
    df: DataFrame, column: str, by: str, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Minimum, quartiles and maximum of a column for each ``by`` value.

    Quartiles come from mergeable sketches unless ``exact`` asks for interpolation
    between the true neighbouring rows.
    """
    rows = df.select(by, F.col(column)).filter(F.col(by).isNotNull())
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ends = [F.min(column).alias("minimum"), F.max(column).alias("maximum")]
    if exact:
        boxes = exact_quantiles(rows, [by], column, quartiles, interpolate=True)
        return rows.groupBy(by).agg(*ends).join(boxes, by, "left")
    sketch = F.percentile_approx(column, list(quartiles.values()), accuracy)
    table = rows.groupBy(by).agg(*ends, sketch.alias("q"))
    return table.select(
        by, "minimum", "maximum", *(F.col("q")[i].alias(q) for i, q in enumerate(quartiles))
    )


def stacked_bars(df: DataFrame, column: str, by: str) -> DataFrame:
    """Height of the bars a stacked chart draws per ``by`` value, and their mean."""
    known = df.filter(F.col(by).isNotNull())
    return known.groupBy(by).agg(
        F.sum(column).alias(f"total_{column}"), F.avg(column).alias(f"mean_{column}")
    )
