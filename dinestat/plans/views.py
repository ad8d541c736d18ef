"""Dashboard views: the tables behind each page, as lazy DataFrames.

Selections a page offers are arguments; left out, a view covers everything at once.
Rows whose grouping value is unknown are left out of grouped tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinestat.functions import dates
from dinestat.functions.money import ratio
from dinestat.functions.tags import RISK_DAYS
from dinestat.operators import charts, sales, shape

# Rows a top table shows, offered inactivity thresholds in days.
TOP_ROWS = 10
INACTIVITY_CHOICES = range(15, 181, 5)

KEYS = ["restaurant_id", "customer_id"]


# --- customer segmentation -------------------------------------------------------


def rfm_with_clv(rfm: DataFrame, clv: DataFrame) -> DataFrame:
    """RFM rows repeated for each tagged day of the same restaurant's customer."""
    return rfm.join(clv.select(*KEYS, "clv_tag"), KEYS, "inner")


def tag_days(clv: DataFrame) -> DataFrame:
    """Days of each tag per restaurant and customer: at most three rows a customer."""
    return clv.groupBy(*KEYS, "clv_tag").agg(F.count(F.lit(1)).cast("decimal(10,0)").alias("days"))


def rfm_means(rfm: DataFrame, weight: str | None = None) -> DataFrame:
    """Average recency, frequency and spend by loyalty, one row per metric.

    A ``weight`` column says how many rows one row stands for.
    """
    measures = ["recency", "frequency", "monetary"]
    known = rfm.filter(F.col("is_loyalty").isNotNull()).groupBy("is_loyalty")
    rows = F.lit(1) if weight is None else F.col(weight)

    def average(measure: str) -> Column:
        value = F.col(measure)
        return ratio(F.sum(value * rows), F.sum(F.when(value.isNotNull(), rows)))

    return shape.to_metric_rows(
        known.agg(*(average(m).alias(m) for m in measures)), "is_loyalty", measures
    )


def segmentation_view(
    rfm: DataFrame,
    clv: DataFrame,
    restaurant: str | None = None,
    clv_tag: str = shape.ALL,
    top: int = TOP_ROWS,
) -> dict[str, DataFrame]:
    """Lifetime-value leaders, RFM table, and RFM by CLV tag and loyalty.

    Only ``rfm_by_clv`` itself repeats a customer for each day. Means, histograms and
    tags join the number of such days instead, and weigh with it.
    """
    rfm = shape.keep_equal(rfm, "restaurant_id", restaurant)
    clv = shape.keep_equal(clv, "restaurant_id", restaurant)
    chosen = shape.keep_equal(clv, "clv_tag", clv_tag)
    weighted = rfm.join(tag_days(clv), KEYS, "inner")
    weighed = rfm.join(tag_days(chosen), KEYS, "inner")
    return {
        "restaurants": shape.choices(rfm, "restaurant_id"),
        "top_clv": shape.top_rows(clv, "total_revenue", top, *KEYS, "date_key", "is_loyalty"),
        "rfm_table": rfm.orderBy(F.asc_nulls_last("recency"), *KEYS),
        "clv_tags": shape.choices(weighted, "clv_tag"),
        "rfm_by_clv": rfm_with_clv(rfm, chosen),
        "rfm_means": rfm_means(weighed, "days"),
        "recency_histogram": charts.histogram(weighed, "recency", "is_loyalty", weight="days"),
        "monetary_histogram": charts.histogram(weighed, "monetary", "is_loyalty", weight="days"),
    }


# --- churn risk ------------------------------------------------------------------


def churn_customers(
    rfm: DataFrame,
    profile: DataFrame,
    inactive_days: int = RISK_DAYS,
    as_of: dt.date | dt.datetime | None = None,
    nulls_match: bool = True,
    restaurant: str | None = None,
) -> DataFrame:
    """RFM and activity profile of each customer, with an inactivity ``alert``.

    The alert compares with ``as_of``, by default the current time. Null restaurants and
    customers match null ones unless ``nulls_match`` is off. A chosen restaurant is
    selected on both sides, as null-safe keys do not carry it from one to the other.
    """
    rfm, profile = (
        shape.require_columns(shape.normalise_names(df), KEYS) for df in (rfm, profile)
    )
    now = F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    limit = now - F.make_dt_interval(F.lit(inactive_days))
    last_order = _date_or_null(profile, "last_order_date")
    alert = F.coalesce(F.col("last_order_date").cast("timestamp_ntz") < limit, F.lit(False))
    # Folder values and file columns may differ in type: compare keys as text.
    rfm, profile = (
        df.withColumns({key: F.col(key).cast("string") for key in KEYS}) for df in (rfm, profile)
    )
    rfm, profile = (shape.keep_equal(df, "restaurant_id", restaurant) for df in (rfm, profile))
    dated = profile.withColumn("last_order_date", last_order)
    joined = shape.join_on(rfm, dated, KEYS, nulls_match=nulls_match)
    return joined.withColumn("alert", alert)


def _date_or_null(df: DataFrame, column: str) -> Column:
    """The column as a date; text that is no date gives null."""
    return F.col(column).try_cast("date")


def churn_view(
    rfm: DataFrame,
    profile: DataFrame,
    restaurant: str | None = None,
    segments: Iterable[str] | None = None,
    activity_tags: Iterable[str] | None = None,
    loyalty_only: bool = False,
    inactive_days: int = RISK_DAYS,
    as_of: dt.date | dt.datetime | None = None,
    nulls_match: bool = True,
) -> dict[str, DataFrame]:
    """Churn table, its chart feeds and the segment distribution."""
    everyone = churn_customers(rfm, profile, inactive_days, as_of, nulls_match, restaurant)
    chosen = shape.keep_any_of(everyone, "segment", segments)
    chosen = shape.keep_any_of(chosen, "activity_tag", activity_tags)
    if loyalty_only:
        chosen = shape.members_only(chosen)
    return {
        "restaurants": shape.choices(everyone, "restaurant_id"),
        "segments": shape.choices(everyone, "segment"),
        "activity_tags": shape.choices(everyone, "activity_tag"),
        "customers": chosen,
        "gap_scatter": chosen.select(
            "avg_gap_days", "days_since_last_order", "segment", "monetary", "customer_id",
            "is_loyalty",
        ),
        "revenue_by_last_order": chosen.select(
            "last_order_date", "monetary", "activity_tag"
        ).orderBy(F.asc_nulls_last("last_order_date")),
        "segment_distribution": segment_distribution(chosen),
        "profile_table": profile_table(chosen),
    }


def segment_distribution(customers: DataFrame) -> DataFrame:
    """Customers per segment and activity tag."""
    known = customers.filter(F.col("segment").isNotNull() & F.col("activity_tag").isNotNull())
    return known.groupBy("segment", "activity_tag").agg(F.count(F.lit(1)).alias("count"))


def profile_table(customers: DataFrame) -> DataFrame:
    """The customer table of the churn page, longest inactive first."""
    return customers.select(
        "restaurant_id", "customer_id", "segment", "recency", "frequency", "monetary",
        "last_order_date", "avg_gap_days", "avg_pct_change", "days_since_last_order",
        "activity_tag", "is_loyalty",
    ).orderBy(F.desc_nulls_last("days_since_last_order"), *KEYS)


# --- sales trends ----------------------------------------------------------------


def sales_trend_view(
    trends: sales.SalesTrends,
    granularity: str = sales.DAILY,
    restaurant: str | None = None,
    year: int | None = None,
    month: int | str | None = None,
    week: int | None = None,
) -> DataFrame:
    """Revenue line of one granularity, narrowed to a year, month, week of month.

    ``month`` in the result is a number beside ``month_name``; both, and the week of
    the month, come from the row's date at every granularity. A selection that begins
    with a year is one span of dates and reaches the scan as its two bounds.
    """
    label = granularity.lower()
    if label not in trends._fields:
        raise ValueError(f"granularity must be one of {', '.join(trends._fields)}: {granularity}")
    rows = shape.normalise_names(getattr(trends, label))
    rows = shape.keep_equal(rows, "restaurant_id", restaurant)
    date = F.col("date").try_cast("date")
    rows = rows.withColumn("date", date)
    parts = {
        "year": F.col("year") if label == sales.WEEKLY else F.year("date"),
        "month": F.month("date"),
        "month_name": dates.month_name(F.month("date")),
        "week_of_month": dates.week_of_month(F.col("date")),
    }
    if label == sales.WEEKLY:
        parts["week"] = F.col("week").try_cast("int")
    rows = rows.withColumns(parts)
    rows = _keep_period(rows, label, year, None if month is None else dates.month_number(month), week)
    order = {
        sales.WEEKLY: ["year", "week"],
        sales.MONTHLY: ["month", "year"],
        sales.HOURLY: ["date", "hour"],
    }.get(label, ["date"])
    return rows.orderBy(*(F.asc_nulls_last(c) for c in [*order, "restaurant_id", "item_category"]))


def _keep_period(
    rows: DataFrame, label: str, year: int | None, month: int | None, week: int | None
) -> DataFrame:
    """Rows of a year, month and week of month: by date bounds as far as these say the same.

    A weekly row's year is its own column, as an ISO week can begin in the year before:
    bounds then only narrow the scan, by the days on which weeks of that year can begin.
    """
    if label == sales.WEEKLY and year is not None:
        rows = shape.keep_equal(rows, "year", year)
        start, end = dt.date(year - 1, 12, 29), dt.date(year + 1, 1, 1)
        rows = rows.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
        year = None
    if year is not None:
        within = (month, week) if month is not None else (None, None)
        start, end = dates.date_range(year, *within)
        rows = rows.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
        if month is not None:
            return rows
    rows = shape.keep_equal(rows, "month", month)
    return shape.keep_equal(rows, "week_of_month", week)


def trend_choices(feed: DataFrame) -> dict[str, DataFrame]:
    """Options of the trend page: restaurants, years (latest first), months, weeks."""
    months = feed.select("month", "month_name").filter(F.col("month").isNotNull()).distinct()
    return {
        "restaurants": shape.choices(feed, "restaurant_id"),
        "years": shape.choices(feed, "year", descending=True),
        "months": months.orderBy("month"),
        "weeks": shape.choices(feed, "week_of_month"),
    }


# --- loyalty, locations, discounts -----------------------------------------------


def loyalty_view(
    impact: DataFrame, summary: DataFrame, exact: bool = False
) -> dict[str, DataFrame]:
    """Loyalty summary, lifetime-value boxes and repeat-order bars."""
    return {
        "summary": summary,
        "lifetime_value_box": charts.box_feed(impact, "lifetime_value", "is_loyalty", exact),
        "repeat_orders": charts.stacked_bars(impact, "repeat_orders", "is_loyalty"),
    }


def location_view(
    locations: DataFrame, top: int = TOP_ROWS, location_col: str = "restaurant_id"
) -> dict[str, DataFrame]:
    """Locations with the most revenue, and revenue of all in that order."""
    by_revenue = [F.desc_nulls_last("total_revenue"), F.asc_nulls_last(location_col)]
    return {
        "top": shape.top_rows(locations, "total_revenue", top, location_col),
        "revenue_bars": locations.select(location_col, "total_revenue").orderBy(*by_revenue),
    }


def discount_view(discounts: DataFrame, top: int = TOP_ROWS) -> dict[str, DataFrame]:
    """Discount table, and bars under the name the chart uses for the flag."""
    order = [F.asc_nulls_last("restaurant_id"), F.asc_nulls_last("is_discounted")]
    bars = discounts.withColumnRenamed("is_discounted", "discount_flag")
    return {
        "table": discounts.orderBy(*order).limit(top),
        "revenue_bars": bars.select("restaurant_id", "discount_flag", "total_revenue"),
    }
