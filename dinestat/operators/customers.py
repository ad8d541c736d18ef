"""Customer metrics: revenue per order day, lifetime value, RFM, activity, loyalty.

Orders without an account (and rows without a customer id) take no part in any of
them. Frequencies and repeat orders count rows of the order-items table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinestat.functions import tags
from dinestat.functions.dates import as_of_date
from dinestat.functions.money import line_revenue, mean, ratio, relative_change
from dinestat.operators.quantiles import exact_quantiles
from dinestat.sources.parquet import settle
from dinestat.sources.schema import GUEST, REVENUE

REVENUE_COL = "revenue_per_order"
BEFORE_ALL_ORDERS = dt.date(1900, 1, 1)


def with_line_revenue(items: DataFrame, revenue_col: str = REVENUE_COL) -> DataFrame:
    """Items with the customer metrics' revenue column, computed unless present."""
    return items if revenue_col in items.columns else items.withColumn(revenue_col, line_revenue())


def known_customers(items: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """Rows of identified customers. Null ids fail the comparison and go too."""
    return items.filter(F.col(customer_col) != GUEST)


def _customer_lines(items: DataFrame, customer_col: str, revenue_col: str) -> DataFrame:
    return known_customers(with_line_revenue(items, revenue_col), customer_col)


# --- revenue per order day -------------------------------------------------------


def customer_days(items: DataFrame) -> DataFrame:
    """Sums per restaurant, customer, day key and loyalty flag.

    Everything below except the activity profile is a further sum over these rows,
    so a job that writes them once scans the order items once for four datasets.
    """
    revenue, day = F.col(REVENUE_COL), F.col("date")
    return (
        _customer_lines(items, "customer_id", REVENUE_COL)
        .groupBy("restaurant_id", "customer_id", "date_key", "is_loyalty")
        .agg(
            F.sum(revenue).alias("total_revenue"),
            F.count("order_id").alias("total_orders"),
            F.max(day).alias("max_date"),
            mean(revenue).alias("avg_revenue_per_order"),
            F.min(revenue).alias("min_revenue_per_order"),
            F.count(F.lit(1)).alias("lines"),
            F.count(revenue).alias("priced_lines"),
            F.min(_flag_day(day)).alias("first_date"),
        )
    )


def revenue_per_order(items: DataFrame) -> DataFrame:
    """Revenue and orders per restaurant, customer, day key and loyalty flag."""
    return day_revenue(customer_days(items))


def day_revenue(days: DataFrame) -> DataFrame:
    """:func:`revenue_per_order` from the rows of :func:`customer_days`."""
    return days.drop("lines", "priced_lines", "first_date")


# --- customer lifetime value -----------------------------------------------------


def clv_thresholds(
    df: DataFrame,
    value_col: str = "total_revenue",
    key: str = "restaurant_id",
    exact: bool = False,
    accuracy: int = 100,
) -> DataFrame:
    """Lower and upper tier limit of each restaurant, in one distributed pass.

    By default quantile sketches, built per task and merged, with a rank error of at
    most ``1 / accuracy``; ``exact`` finds the true quantiles instead.
    """
    limits = [tags.LOW_QUANTILE, tags.HIGH_QUANTILE]
    names = ["low_threshold", "high_threshold"]
    if exact:
        return exact_quantiles(df, [key], value_col, dict(zip(names, limits)))
    sketch = df.groupBy(key).agg(F.percentile_approx(value_col, limits, accuracy).alias("q"))
    return sketch.select(key, *(F.col("q")[i].alias(name) for i, name in enumerate(names)))


def tag_clv(
    df: DataFrame,
    value_col: str = "total_revenue",
    key: str = "restaurant_id",
    exact: bool = False,
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus ``clv_tag``: top fifth High, bottom fifth Low, the rest Medium.

    Thresholds hold one row per restaurant. The join carries no hint: Spark broadcasts
    them when their known size is below its limit and otherwise joins by shuffle, with
    adaptive execution splitting a restaurant that holds much of the rows. Pass a
    written table of thresholds to have that size known before the job starts, as those
    of ``exact`` are: of a size unknown, a few restaurants' limits would have every row
    shuffled and each restaurant sorted by one task.
    """
    limits = thresholds
    if limits is None:
        limits = clv_thresholds(df, value_col, key, exact)
        limits = settle(limits) if exact else limits
    tag = tags.clv_tag(F.col(value_col), F.col("low_threshold"), F.col("high_threshold"))
    joined = df.join(limits, key, "left")
    return joined.select(*df.columns, tag.alias("clv_tag"))


# --- recency, frequency, monetary ------------------------------------------------


def _flag_day(day: Column) -> Column:
    """The day a flag is seen on; undated rows come before all others."""
    return F.coalesce(day, F.lit(BEFORE_ALL_ORDERS))


def _first_known_flag(flag: str, day: Column) -> Column:
    """The flag's value on the first day it is known; on a mixed day, member.

    Two minima of dates keep the aggregate in fixed-width hash buffers, where picking
    the value of a least row would sort both sides of the shuffle.
    """
    return _earlier_flag(F.min(F.when(F.col(flag), day)), F.min(F.when(~F.col(flag), day)))


def _earlier_flag(yes: Column, no: Column) -> Column:
    return F.when(yes.isNotNull() | no.isNotNull(), F.coalesce(yes <= no, yes.isNotNull()))


def rfm(
    items: DataFrame,
    as_of: dt.date | str | Column | None = None,
    since: dt.date | str | None = None,
    customer_col: str = "customer_id",
    restaurant_col: str = "restaurant_id",
    date_col: str = "date",
    revenue_col: str = REVENUE_COL,
    loyalty_col: str = "is_loyalty",
) -> DataFrame:
    """Recency, frequency, monetary value and loyalty of each restaurant's customers.

    Recency counts days back from ``as_of``, by default the last date any identified
    customer ordered anywhere. ``since`` leaves out earlier rows.
    """
    lines = _customer_lines(items, customer_col, revenue_col)
    if since is not None:
        lines = lines.filter(F.col(date_col) >= F.lit(since).cast("date"))
    snapshot = as_of_date(as_of, lines, date_col)
    return lines.groupBy(restaurant_col, customer_col).agg(
        F.datediff(snapshot, F.max(date_col)).alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(revenue_col).alias("monetary"),
        _first_known_flag(loyalty_col, _flag_day(F.col(date_col))).alias("is_loyalty"),
    )


def rfm_from_days(days: DataFrame, as_of: dt.date | str | Column | None = None) -> DataFrame:
    """:func:`rfm` from the rows of :func:`customer_days`."""
    snapshot = as_of_date(as_of, days, "max_date")
    return days.groupBy("restaurant_id", "customer_id").agg(
        F.datediff(snapshot, F.max("max_date")).alias("recency"),
        F.sum("lines").alias("frequency"),
        F.sum("total_revenue").alias("monetary"),
        _first_known_flag("is_loyalty", F.col("first_date")).alias("is_loyalty"),
    )


def rfm_with_orders(
    items: DataFrame, as_of: dt.date | str | Column | None = None
) -> DataFrame:
    """:func:`rfm` plus ``orders``, the distinct orders beside the rows of ``frequency``.

    Lines are added up to one row per order first, so an order whose lines differ in day
    or flag counts once. Null order ids count as rows only.
    """
    lines = _customer_lines(items, "customer_id", REVENUE_COL)
    snapshot = as_of_date(as_of, lines, "date")
    day, flag = _flag_day(F.col("date")), F.col("is_loyalty")
    orders = lines.groupBy("restaurant_id", "customer_id", "order_id").agg(
        F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(REVENUE_COL).alias("revenue"),
        F.min(F.when(flag, day)).alias("member_day"),
        F.min(F.when(~flag, day)).alias("other_day"),
    )
    yes, no = F.min("member_day"), F.min("other_day")
    return orders.groupBy("restaurant_id", "customer_id").agg(
        F.datediff(snapshot, F.max("max_date")).alias("recency"),
        F.sum("lines").alias("frequency"),
        F.sum("revenue").cast(REVENUE).alias("monetary"),
        _earlier_flag(yes, no).alias("is_loyalty"),
        F.count("order_id").alias("orders"),
    )


def segment_customers(
    scores: DataFrame, thresholds: tags.SegmentThresholds = tags.SegmentThresholds()
) -> DataFrame:
    """RFM scores plus ``segment``."""
    return scores.withColumn("segment", tags.rfm_segment(thresholds))


# --- activity profile ------------------------------------------------------------


def average_gap(
    items: DataFrame,
    customer_col: str = "customer_id",
    restaurant_col: str = "restaurant_id",
    date_col: str = "date",
) -> DataFrame:
    """Average days between a customer's consecutive rows, without ordering them.

    Consecutive gaps add up to last date minus first date.
    """
    return (
        known_customers(items, customer_col)
        .groupBy(restaurant_col, customer_col)
        .agg(_average_gap(F.min(date_col), F.max(date_col), F.count(date_col)).alias("avg_gap_days"))
    )


def _average_gap(first: Column, last: Column, dated_rows: Column) -> Column:
    return ratio(F.datediff(last, first), dated_rows - 1)


def average_gap_between(first: str, last: str, dated_rows: str) -> Column:
    """Average gap of so many dated rows from the first date to the last."""
    return _average_gap(F.col(first), F.col(last), F.col(dated_rows))


def customer_activity_profile(
    items: DataFrame,
    risk_days: int = tags.RISK_DAYS,
    as_of: dt.date | str | Column | None = None,
    customer_col: str = "customer_id",
    restaurant_col: str = "restaurant_id",
    date_col: str = "date",
    revenue_col: str = REVENUE_COL,
) -> DataFrame:
    """Last order, order gaps, revenue changes and activity tags of each customer.

    Revenue changes compare each row with the customer's previous one by date, order
    and line item. They are added up in two steps, within each day and then from day
    to day, so that the rows of a very active customer spread over tasks by day and
    the second step sees at most one row per day.
    """
    lines = _customer_lines(items, customer_col, revenue_col)
    snapshot = as_of_date(as_of, lines, date_col)
    # The key of more values first: sorting then seldom compares beyond its first bytes.
    keys = [customer_col, restaurant_col]
    changes = _day_to_day(_within_days(lines, keys, date_col, revenue_col), keys, date_col)
    profile = changes.groupBy(restaurant_col, customer_col).agg(
        F.max(date_col).alias("last_order_date"),
        _average_gap(F.min(date_col), F.max(date_col), F.sum("dated_rows")).alias("avg_gap_days"),
        ratio(F.sum("change"), F.sum("changes")).alias("avg_pct_change"),
    )
    days_since = F.datediff(snapshot, F.col("last_order_date"))
    return profile.withColumn("days_since_last_order", days_since).transform(tag_activity, risk_days)


def day_states(items: DataFrame) -> DataFrame:
    """Per customer and day: summed changes, first and last revenue, dated rows."""
    lines = _customer_lines(items, "customer_id", REVENUE_COL)
    return _within_days(lines, ["customer_id", "restaurant_id"], "date", REVENUE_COL)


def _within_days(lines: DataFrame, keys: list[str], date_col: str, revenue_col: str) -> DataFrame:
    """Per customer and day: summed changes, first and last revenue, dated rows."""
    # Equal revenue as the last tie-break: rows still tied are interchangeable.
    in_order = Window.partitionBy(*keys, date_col).orderBy("order_id", "lineitem_id", revenue_col)
    placed = lines.select(
        *keys,
        date_col,
        F.col(revenue_col).alias("revenue"),
        F.lag(revenue_col).over(in_order).alias("previous"),
        (F.row_number().over(in_order) == 1).alias("is_first"),
        F.lead(F.lit(1)).over(in_order).isNull().alias("is_last"),
    )
    change = relative_change(F.col("revenue"), F.col("previous"))
    return placed.groupBy(*keys, date_col).agg(
        F.sum(change).alias("change"),
        F.count(change).alias("changes"),
        F.max(F.when(F.col("is_first"), F.col("revenue"))).alias("opening"),
        F.max(F.when(F.col("is_last"), F.col("revenue"))).alias("closing"),
        F.count(date_col).alias("dated_rows"),
    )


def _day_to_day(days: DataFrame, keys: list[str], date_col: str) -> DataFrame:
    """Add each day's change from the last row of the customer's previous day."""
    by_day = Window.partitionBy(*keys).orderBy(date_col)
    follows = days.withColumn("previous", F.lag("closing").over(by_day))
    stepped = follows.withColumn("step", relative_change(F.col("opening"), F.col("previous")))
    change = F.coalesce(F.col("change") + F.col("step"), F.col("change"), F.col("step"))
    changes = F.col("changes") + F.col("step").isNotNull().cast("int")
    return stepped.withColumns({"change": change, "changes": changes})


def tag_activity(profile: DataFrame, risk_days: int) -> DataFrame:
    recency = tags.over_limit(
        F.col("days_since_last_order"), risk_days, tags.INACTIVE, tags.ACTIVE
    )
    gap = tags.over_limit(F.col("avg_gap_days"), risk_days, tags.AT_RISK, tags.HEALTHY)
    at_risk = (F.col("recency_tag") == tags.INACTIVE) | (F.col("gap_tag") == tags.AT_RISK)
    return (
        profile.withColumn("recency_tag", recency)
        .withColumn("gap_tag", gap)
        .withColumn("activity_tag", F.when(at_risk, tags.AT_RISK).otherwise(tags.ACTIVE))
    )


# --- loyalty programme -----------------------------------------------------------


def loyalty_impact(items: DataFrame) -> DataFrame:
    """Average spend, repeat orders and lifetime value per customer and loyalty flag."""
    return (
        _customer_lines(items, "customer_id", REVENUE_COL)
        .groupBy("restaurant_id", "is_loyalty", "customer_id")
        .agg(
            mean(REVENUE_COL).alias("average_spend"),
            F.count("customer_id").alias("repeat_orders"),
            F.sum(REVENUE_COL).alias("lifetime_value"),
        )
    )


def loyalty_with_orders(items: DataFrame) -> DataFrame:
    """:func:`loyalty_impact` plus ``orders``, distinct per customer and loyalty flag.

    An order with lines under both flags counts once under each of them.
    """
    orders = (
        _customer_lines(items, "customer_id", REVENUE_COL)
        .groupBy("restaurant_id", "is_loyalty", "customer_id", "order_id")
        .agg(
            F.sum(REVENUE_COL).alias("revenue"),
            F.count(REVENUE_COL).alias("priced_lines"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    return orders.groupBy("restaurant_id", "is_loyalty", "customer_id").agg(
        ratio(F.sum("revenue"), F.sum("priced_lines")).alias("average_spend"),
        F.sum("lines").alias("repeat_orders"),
        F.sum("revenue").cast(REVENUE).alias("lifetime_value"),
        F.count("order_id").alias("orders"),
    )


def loyalty_from_days(days: DataFrame) -> DataFrame:
    """:func:`loyalty_impact` from the rows of :func:`customer_days`."""
    return days.groupBy("restaurant_id", "is_loyalty", "customer_id").agg(
        ratio(F.sum("total_revenue"), F.sum("priced_lines")).alias("average_spend"),
        F.sum("lines").alias("repeat_orders"),
        F.sum("total_revenue").alias("lifetime_value"),
    )


def loyalty_summary(impact: DataFrame) -> DataFrame:
    """Averages over the customers of each restaurant and loyalty flag."""
    return impact.groupBy("restaurant_id", "is_loyalty").agg(
        F.avg("average_spend").alias("avg_spend_per_customer"),
        mean("repeat_orders").alias("avg_repeat_orders"),
        mean("lifetime_value").alias("avg_lifetime_value"),
    )
