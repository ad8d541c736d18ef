"""Exact quantiles of very large groups, without any task holding a group."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinestat.sources.parquet import settle

#: Rank error of the sketch that places the brackets is at most one in this many.
SKETCH_ACCURACY = 10_000
#: Half width of a bracket, five times that error.
MARGIN = 5 / SKETCH_ACCURACY


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    interpolate: bool = False,
) -> DataFrame:
    """One row per group with a column for each named probability.

    The quantile is the least value whose share of rows at or below it reaches the
    probability; with ``interpolate`` it lies between the two nearest rows. Null
    values do not count, and groups with a null key are left out.

    A sketch brackets each quantile, then rows below the bracket are only counted and
    the few values inside it are put in order. Where a count shows that the bracket
    missed, its missed side is opened, so the result never depends on the sketch.

    ``df`` is read three times without shuffling it, so pass a written table. The
    brackets are written, twice, in jobs this starts: their size is then known, and
    Spark broadcasts them unless there are very many groups.
    """
    known = df.select(*keys, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    brackets = settle(_bracketed(known, keys, probabilities, interpolate))
    targets = settle(_checked(known, brackets, keys))

    above_floor = F.col("floor").isNull() | (F.col("v") >= F.col("floor"))
    below_roof = F.col("roof").isNull() | (F.col("v") <= F.col("roof"))
    inside = known.join(targets, keys).filter(above_floor & below_roof)
    wanted = ["first_rank", "last_rank", "share", "skipped"]
    weighted = inside.groupBy(*keys, "name", *wanted, "v").agg(F.count(F.lit(1)).alias("rows"))
    in_order = Window.partitionBy(*keys, "name").orderBy("v")
    reached = weighted.withColumn("reached", F.col("skipped") + F.sum("rows").over(in_order))

    def at(name: str, rank: str) -> Column:
        hit = (F.col("name") == name) & (F.col("reached") >= F.col(rank))
        return F.min(F.when(hit, F.col("v")))

    def quantile(name: str) -> Column:
        if not interpolate:
            return at(name, "first_rank")
        low, high = at(name, "first_rank").cast("double"), at(name, "last_rank").cast("double")
        share = F.max(F.when(F.col("name") == name, F.col("share")))
        return low + (high - low) * share

    return reached.groupBy(*keys).agg(*(quantile(name).alias(name) for name in probabilities))


def _bracketed(
    known: DataFrame, keys: list[str], probabilities: dict[str, float], interpolate: bool
) -> DataFrame:
    """One row per group and probability: wanted ranks and a likely value range."""
    edges = [
        edge
        for p in probabilities.values()
        for edge in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))
    ]
    n = F.col("n")

    def target(i: int, name: str, p: float) -> Column:
        exact_p = F.lit(Decimal(str(p)))
        if interpolate:
            position = exact_p * (n - 1)
            first = F.floor(position).cast("bigint") + 1
            share = (position - F.floor(position)).cast("double")
        else:
            first = F.greatest(F.ceil(exact_p * n).cast("bigint"), F.lit(1))
            share = F.lit(0.0)
        return F.struct(
            F.lit(name).alias("name"),
            first.alias("first_rank"),
            (first + (share > 0).cast("int")).alias("last_rank"),
            share.alias("share"),
            F.col("cuts")[2 * i].alias("low"),
            F.col("cuts")[2 * i + 1].alias("high"),
        )

    sketched = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("v", edges, SKETCH_ACCURACY).alias("cuts")
    )
    targets = F.array(*(target(i, *named) for i, named in enumerate(probabilities.items())))
    return sketched.select(*keys, F.inline(targets))


def _checked(known: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets with the rows below them counted, opened where a wanted rank is outside."""
    v = F.col("v")
    counted = (
        known.join(brackets, keys)
        .groupBy(*brackets.columns)
        .agg(
            F.count_if(v < F.col("low")).alias("below"),
            F.count_if(v <= F.col("high")).alias("up_to"),
        )
    )
    starts_inside = F.col("first_rank") > F.col("below")
    ends_inside = F.col("last_rank") <= F.col("up_to")
    return counted.select(
        *keys,
        "name",
        "first_rank",
        "last_rank",
        "share",
        F.when(starts_inside, F.col("low")).alias("floor"),
        F.when(ends_inside, F.col("high")).alias("roof"),
        F.when(starts_inside, F.col("below")).otherwise(0).alias("skipped"),
    )
