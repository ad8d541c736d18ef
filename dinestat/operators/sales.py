"""Sales metrics over all orders, guests included: trends and discounts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinestat.functions import dates
from dinestat.functions.money import is_discounted, line_revenue, mean
from dinestat.operators.customers import REVENUE_COL, with_line_revenue
from dinestat.operators.locations import location_totals, top_locations
from dinestat.sources.parquet import (
    DEFAULT_SCHEMES,
    output_path,
    read_dataset,
    settle,
    write_dataset,
)
from dinestat.sources.schema import REVENUE

# Labels of the four granularities.
DAILY, WEEKLY, MONTHLY, HOURLY = "daily", "weekly", "monthly", "hourly"


class SalesTrends(NamedTuple):
    """Revenue per restaurant and item category at four granularities."""

    daily: DataFrame
    weekly: DataFrame
    monthly: DataFrame
    hourly: DataFrame


def sales_lines(items: DataFrame) -> DataFrame:
    """Order items as dated revenue: the columns every granularity groups by."""
    date = F.to_date("date")
    return items.select(
        "restaurant_id",
        "item_category",
        date.alias("date"),
        F.year(date).alias("year"),
        F.col("day_of_weeks").alias("day"),
        dates.hour_of("time").alias("hour"),
        line_revenue(missing_item_quantity=0).alias("revenue"),
    )


# Each of the next four takes lines or hourly sums: both carry the same columns.


def _summed(lines: DataFrame, label: str, *period: Column | str) -> DataFrame:
    revenue = F.sum("revenue").cast(REVENUE).alias("revenue")
    groups = lines.groupBy(*period, "restaurant_id", "item_category").agg(revenue)
    return groups.withColumn("granularity", F.lit(label))


def daily_sales(lines: DataFrame) -> DataFrame:
    """Revenue per day."""
    return _summed(lines, DAILY, "year", "day", "date")


def weekly_sales(lines: DataFrame, iso_weeks: bool = False) -> DataFrame:
    """Revenue per calendar year and ISO week number, with an approximate date.

    Days around New Year can carry a week number of the neighbouring year. With
    ``iso_weeks`` the year is the week's own and ``date`` its Monday.
    """
    date = F.col("date")
    week = F.weekofyear(date).alias("week")
    if iso_weeks:
        monday = F.date_trunc("week", date).cast("date").alias("date")
        return _summed(lines, WEEKLY, dates.iso_year(date).alias("year"), week, monday)
    weeks = _summed(lines, WEEKLY, "year", week)
    return weeks.withColumn("date", dates.week_date(F.col("year"), F.col("week")))


def monthly_sales(lines: DataFrame) -> DataFrame:
    """Revenue per month, by name and number, dated on the first."""
    first_day = F.trunc("date", "MM")
    months = _summed(lines, MONTHLY, "year", first_day.alias("date"))
    return months.withColumn("month", F.date_format("date", "MMMM")).withColumn(
        "month_num", F.month("date")
    )


def hourly_sales(lines: DataFrame) -> DataFrame:
    """Revenue per day and hour; unreadable times fall under a null hour."""
    return _summed(lines, HOURLY, "year", "hour", "day", "date")


def sales_levels(items: DataFrame, iso_weeks: bool = False) -> DataFrame:
    """All four granularities as one table, from one scan of the items.

    Lines are added up by hour first; grouping sets over those sums then give every level,
    told apart by ``granularity``. Columns that a level does not have are null in its rows.
    """
    date = F.col("date")
    hours = hourly_sales(sales_lines(items)).drop("granularity")
    monday = F.date_trunc("week", date).cast("date") if iso_weeks else F.lit(None).cast("date")
    keyed = hours.select(
        "restaurant_id", "item_category", "year", "day", "date", "hour", "revenue",
        F.trunc(date, "MM").alias("month_start"),
        F.weekofyear(date).alias("week"),
        (dates.iso_year(date) if iso_weeks else F.col("year")).alias("week_year"),
        monday.alias("monday"),
    )
    levels = {
        DAILY: ["year", "day", "date"],
        HOURLY: ["year", "day", "date", "hour"],
        WEEKLY: ["week_year", "week", "monday"],
        MONTHLY: ["year", "month_start"],
    }
    every = ["restaurant_id", "item_category"]
    names = list(dict.fromkeys(name for level in levels.values() for name in level))
    grouped = keyed.groupingSets(
        [[F.col(name) for name in [*every, *level]] for level in levels.values()],
        *every, *names,
    ).agg(
        F.sum("revenue").cast(REVENUE).alias("revenue"),
        *(F.grouping(name).alias(f"without_{name}") for name in ("hour", "week", "month_start")),
    )
    level = (
        F.when(F.col("without_hour") == 0, HOURLY)
        .when(F.col("without_week") == 0, WEEKLY)
        .when(F.col("without_month_start") == 0, MONTHLY)
        .otherwise(DAILY)
    )
    weekly = F.coalesce("monday", dates.week_date(F.col("week_year"), F.col("week")))
    return grouped.select(
        level.alias("granularity"),
        F.coalesce("year", "week_year").alias("year"),
        "week",
        F.date_format("month_start", "MMMM").alias("month"),
        F.month("month_start").alias("month_num"),
        F.coalesce("date", "month_start", weekly).alias("date"),
        "day", "hour", *every, "revenue",
    )


def split_levels(levels: DataFrame) -> SalesTrends:
    """The four tables of :func:`sales_levels`, each with the columns of its level."""
    tail = ["restaurant_id", "item_category", "revenue", "granularity"]
    own = {
        DAILY: ["year", "day", "date", *tail],
        WEEKLY: ["year", "week", "date", *tail],
        MONTHLY: ["year", "date", "month", "month_num", *tail],
        HOURLY: ["year", "hour", "day", "date", *tail],
    }
    return SalesTrends(
        **{name: levels.where(F.col("granularity") == name).select(columns) for name, columns in own.items()}
    )


def sales_trends(
    items: DataFrame,
    path: str | None = None,
    iso_weeks: bool = False,
    schemes: tuple[str, ...] | None = DEFAULT_SCHEMES,
    together: bool = False,
) -> SalesTrends:
    """Revenue at four granularities; also written below ``path`` when that is given.

    Without a path each table is its own lazy aggregate of the items, the least work for
    one of them. ``together`` starts a job that scans the items once for all four and
    keeps them in a folder each. With a path the items are scanned once, too: hourly sums
    are written, and the other three are added up from what was written. Decimal revenue
    makes all ways give the same numbers.
    """
    base = output_path(path, schemes)
    if base is None and together:
        return split_levels(settle(sales_levels(items, iso_weeks), "granularity"))
    lines = sales_lines(items)
    hourly = hourly_sales(lines)
    if base is not None:
        write_dataset(hourly, base + HOURLY, HOURLY)
        lines = hourly = read_dataset(items.sparkSession, base + HOURLY, HOURLY)
    trends = SalesTrends(
        daily_sales(lines), weekly_sales(lines, iso_weeks), monthly_sales(lines), hourly
    )
    if base is not None:
        for key in (DAILY, WEEKLY, MONTHLY):
            write_dataset(getattr(trends, key), base + key, key)
    return trends


# --- discounts -------------------------------------------------------------------


def discount_effectiveness(
    items: DataFrame,
    option_price_col: str = "option_price",
    revenue_col: str = REVENUE_COL,
    order_col: str = "order_id",
) -> DataFrame:
    """Revenue, distinct orders and average line value with and without discount.

    An order with lines of both kinds counts in both groups. The items are read twice: for
    the sums, which hardly shuffle, and for distinct orders, which then shuffle without sums.
    """
    keys = ["restaurant_id", "is_discounted"]
    kind = is_discounted(option_price_col).alias("is_discounted")
    sums = (
        with_line_revenue(items, revenue_col)
        .groupBy("restaurant_id", kind)
        .agg(F.sum(revenue_col).alias("total_revenue"), mean(revenue_col).alias("avg_order_value"))
    )
    orders = (
        items.select("restaurant_id", kind, F.col(order_col).alias("total_orders"))
        .distinct()
        .groupBy(*keys)
        .agg(F.count("total_orders").alias("total_orders"))
    )
    # One row of each kind a group, as each group has lines: the other's columns are null.
    both = sums.unionByName(orders, allowMissingColumns=True)
    columns = ("total_revenue", "total_orders", "avg_order_value")
    return both.groupBy(*keys).agg(*(F.max(name).alias(name) for name in columns))
