"""Column types of the order-items table and of the twelve metric datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
#: Revenue of one line. 18 digits still fit Spark's 8-byte decimal.
LINE_REVENUE = T.DecimalType(18, 2)
#: Sum of line revenues, as Spark widens it.
REVENUE = T.DecimalType(28, 2)

_STRING, _DATE, _BOOL = T.StringType(), T.DateType(), T.BooleanType()
_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Names and order of the order-items columns. One row is one line
# item with one of its options. Card numbers are personal data and not loaded.
ORDER_ITEMS = _struct(
    order_key=_STRING,
    date_key=_DATE,
    app_name=_STRING,
    restaurant_id=_STRING,
    customer_id=_STRING,
    order_id=_STRING,
    lineitem_id=_STRING,
    is_loyalty=_BOOL,
    item_category=_STRING,
    item_name=_STRING,
    size=_STRING,
    option_group_name=_STRING,
    option_name=_STRING,
    option_price=MONEY,
    option_quantity=_INT,
    item_price=MONEY,
    item_quantity=_INT,
    time=_STRING,
    date=_DATE,
    month_name=_STRING,
    day_of_weeks=_STRING,
    is_weekends=_BOOL,
    is_holidays=_BOOL,
    holiday_name=_STRING,
)

#: Source names that stand for a canonical column.
RENAMES = {"user_id": "customer_id"}

#: customer_id of orders placed without an account.
GUEST = "_guest"


@dataclass(frozen=True)
class Dataset:
    """One written metric: its folder below the base path and its columns.

    Rows of a file are in the order of ``sort_by``, so that a reader's bounds on those
    columns skip row groups and pages.
    """

    folder: str
    schema: T.StructType
    partition_by: str | None = None
    sort_by: tuple[str, ...] = ()


_PARTITIONED = "restaurant_id"

# Dataset keys, folders, columns.
DATASETS = {
    "revenue": Dataset(
        "revenue_per_order",
        _struct(
            restaurant_id=_STRING, customer_id=_STRING, date_key=_DATE, is_loyalty=_BOOL,
            total_revenue=REVENUE, total_orders=_LONG, max_date=_DATE,
            avg_revenue_per_order=_DOUBLE, min_revenue_per_order=LINE_REVENUE,
        ),
    ),
    "clv": Dataset(
        "clv_tagged",
        _struct(
            restaurant_id=_STRING, customer_id=_STRING, date_key=_DATE, is_loyalty=_BOOL,
            total_revenue=REVENUE, total_orders=_LONG, max_date=_DATE,
            avg_revenue_per_order=_DOUBLE, min_revenue_per_order=LINE_REVENUE,
            clv_tag=_STRING,
        ),
    ),
    "rfm": Dataset(
        "rfm_segmented",
        _struct(
            restaurant_id=_STRING, customer_id=_STRING, recency=_INT, frequency=_LONG,
            monetary=REVENUE, is_loyalty=_BOOL, segment=_STRING,
        ),
    ),
    "profile": Dataset(
        "customer_profile",
        _struct(
            restaurant_id=_STRING, customer_id=_STRING, last_order_date=_DATE,
            avg_gap_days=_DOUBLE, avg_pct_change=_DOUBLE, days_since_last_order=_INT,
            recency_tag=_STRING, gap_tag=_STRING, activity_tag=_STRING,
        ),
        _PARTITIONED,
        ("customer_id",),
    ),
    "daily": Dataset(
        "sales_trends/daily",
        _struct(
            year=_INT, day=_STRING, date=_DATE, restaurant_id=_STRING,
            item_category=_STRING, revenue=REVENUE, granularity=_STRING,
        ),
        _PARTITIONED,
        ("date",),
    ),
    "weekly": Dataset(
        "sales_trends/weekly",
        _struct(
            year=_INT, week=_INT, restaurant_id=_STRING, item_category=_STRING,
            revenue=REVENUE, date=_DATE, granularity=_STRING,
        ),
        _PARTITIONED,
        ("date",),
    ),
    "monthly": Dataset(
        "sales_trends/monthly",
        _struct(
            year=_INT, month=_STRING, restaurant_id=_STRING, item_category=_STRING,
            revenue=REVENUE, month_num=_INT, date=_DATE, granularity=_STRING,
        ),
        _PARTITIONED,
        ("date",),
    ),
    "hourly": Dataset(
        "sales_trends/hourly",
        _struct(
            year=_INT, hour=_INT, day=_STRING, date=_DATE, restaurant_id=_STRING,
            item_category=_STRING, revenue=REVENUE, granularity=_STRING,
        ),
        _PARTITIONED,
        ("date", "hour"),
    ),
    "loyalty": Dataset(
        "loyalty_program_impact",
        _struct(
            restaurant_id=_STRING, is_loyalty=_BOOL, customer_id=_STRING,
            average_spend=_DOUBLE, repeat_orders=_LONG, lifetime_value=REVENUE,
        ),
    ),
    "loyalty_summary": Dataset(
        "loyalty_program_impact_summary",
        _struct(
            restaurant_id=_STRING, is_loyalty=_BOOL, avg_spend_per_customer=_DOUBLE,
            avg_repeat_orders=_DOUBLE, avg_lifetime_value=_DOUBLE,
        ),
    ),
    "locations": Dataset(
        "top_locations",
        _struct(
            restaurant_id=_STRING, total_revenue=REVENUE, average_order_value=_DOUBLE,
            orders_per_day=_DOUBLE, rank=_LONG,
        ),
    ),
    "discounts": Dataset(
        "discount_effectiveness",
        _struct(
            restaurant_id=_STRING, is_discounted=_BOOL, total_revenue=REVENUE,
            total_orders=_LONG, avg_order_value=_DOUBLE,
        ),
    ),
}
