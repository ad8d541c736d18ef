"""Locations: revenue, distinct orders and active days, with states that merge.

Distinct days of a location are a bitmap over day numbers, so the states of any two spans
of days merge into that of both. Distinct orders come from rows of order grain. Neither
multiplies the rows of the items, as two distinct counts in one aggregate would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinestat.functions.money import mean, ratio
from dinestat.operators.customers import REVENUE_COL, with_line_revenue
from dinestat.operators.ranking import number_rows
from dinestat.sources.parquet import settle
from dinestat.sources.schema import REVENUE

_SUMS = ("total_revenue", "priced_lines")


def location_states(
    items: DataFrame,
    location_col: str = "restaurant_id",
    date_col: str = "date",
    revenue_col: str = REVENUE_COL,
) -> DataFrame:
    """Mergeable state of each location: money, priced lines and a bitmap of its days.

    One row per location and ``bucket`` of 32,768 days, and one without bucket for rows
    without date. Lines are first added up by day in hash buffers, so bitmaps are made of
    one row a day. States of spans that share days merge as well, as to ``active_days``;
    money adds up, so no line may be in two of them.
    """
    day = F.unix_date(F.col(date_col).cast("date")).alias("day")
    by_day = (
        with_line_revenue(items, revenue_col)
        .groupBy(location_col, day)
        .agg(
            F.sum(revenue_col).cast(REVENUE).alias("total_revenue"),
            F.count(revenue_col).alias("priced_lines"),
        )
    )
    return by_day.groupBy(location_col, F.bitmap_bucket_number("day").alias("bucket")).agg(
        *_added(), F.bitmap_construct_agg(F.bitmap_bit_position("day")).alias("active_days")
    )


def _added() -> list:
    return [F.sum(name).cast(kind).alias(name) for name, kind in zip(_SUMS, (REVENUE, "bigint"))]


def merge_location_states(*states: DataFrame, location_col: str = "restaurant_id") -> DataFrame:
    """One state per location and bucket from the states of several spans of days."""
    return (
        reduce(DataFrame.unionByName, states)
        .groupBy(location_col, "bucket")
        .agg(*_added(), F.bitmap_or_agg("active_days").alias("active_days"))
    )


def location_activity(states: DataFrame, location_col: str = "restaurant_id") -> DataFrame:
    """Money, priced lines and number of active days of each location."""
    days = F.when(F.col("bucket").isNull(), 0).otherwise(F.bitmap_count("active_days"))
    return states.groupBy(location_col).agg(*_added(), F.sum(days).alias("active_days"))


def location_orders(
    items: DataFrame, location_col: str = "restaurant_id", order_col: str = "order_id"
) -> DataFrame:
    """Distinct orders of each location, counted on rows of order grain."""
    orders = items.select(location_col, order_col).distinct()
    return orders.groupBy(location_col).agg(F.count(order_col).alias("orders"))


def location_totals(
    items: DataFrame,
    location_col: str = "restaurant_id",
    date_col: str = "date",
    revenue_col: str = REVENUE_COL,
    approx: bool = False,
) -> DataFrame:
    """Revenue, average line value and orders per active day of each location.

    The items are read twice, each time other columns but for the location's: prices and
    dates for the states, orders for their number. Pass a written table. ``approx`` counts
    distinct orders by sketch instead of shuffling them, in one reading.
    """
    if approx:
        return (
            with_line_revenue(items, revenue_col)
            .groupBy(location_col)
            .agg(
                F.sum(revenue_col).alias("total_revenue"),
                mean(revenue_col).alias("average_order_value"),
                ratio(
                    F.approx_count_distinct("order_id"), F.count_distinct(F.col(date_col).cast("date"))
                ).alias("orders_per_day"),
            )
        )
    states = location_states(items, location_col, date_col, revenue_col)
    parts = location_activity(states, location_col).unionByName(
        location_orders(items, location_col), allowMissingColumns=True
    )
    # One row of each kind a location: adding them up matches null locations, too.
    totals = parts.groupBy(location_col).agg(
        *_added(), *(F.sum(name).alias(name) for name in ("active_days", "orders"))
    )
    return totals.select(
        location_col,
        "total_revenue",
        ratio(F.col("total_revenue"), F.col("priced_lines")).alias("average_order_value"),
        ratio(F.col("orders"), F.col("active_days")).alias("orders_per_day"),
    )


def top_locations(
    items: DataFrame,
    location_col: str = "restaurant_id",
    date_col: str = "date",
    revenue_col: str = REVENUE_COL,
    approx: bool = False,
) -> DataFrame:
    """Location totals ranked by revenue, lower location first among equals.

    Starts a job: the totals, one row per location, are written before ranking.
    """
    totals = settle(location_totals(items, location_col, date_col, revenue_col, approx))
    return number_rows(totals, "total_revenue", location_col)
