"""Registered queries: every metric and view over the given tables, with SQL beside.

``queries()`` maps a name to a function of (spark, folder with the Parquet tables);
``oracle_sql()`` gives the same result as SQL text for another engine. Integers come
out as bigint and decimals as double in both. Averages of averages are rounded, as
their last bits depend on the order of summation.
"""

from __future__ import annotations

import datetime as dt
import sys
import uuid
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dinestat.functions.dates import latest  # noqa: E402
from dinestat.functions.money import is_discounted, line_revenue  # noqa: E402
from dinestat.functions.tags import SegmentThresholds  # noqa: E402
from dinestat.operators import (  # noqa: E402
    activity,
    charts,
    customers,
    locations,
    sales,
    shape,
    sketches,
)
from dinestat.plans import views  # noqa: E402
from dinestat.plans.batch import build_metrics, rebuild_restaurants  # noqa: E402
from dinestat.sources.parquet import (  # noqa: E402
    checkpoint_folder,
    read_order_items,
    read_runs,
    settle,
    write_dataset,
    write_metric,
)
from dinestat.sources.star import order_items  # noqa: E402
from oracle import ORACLE  # noqa: E402

# Queries of the optional subpackage for training text, where it is present.
try:
    import corpus_pipeline
    from dinestat.llm import queries as llm
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "dinestat.llm", "dinestat.llm.queries"):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

#: Segment limits at which the given tables have customers in every segment.
TUNED = SegmentThresholds(
    vip_frequency=10, vip_monetary=500_000, new_monetary=200_000, churn_monetary=200_000
)
#: Fixed date for views that compare with the current one.
AS_OF = dt.date(1998, 1, 1)


def plain(df: DataFrame, **digits: int) -> DataFrame:
    """Integers as bigint, decimals as double, named columns rounded."""

    def column(field: T.StructField):
        value = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, T.IntegralType):
            value = value.cast("bigint")
        if field.name in digits:
            value = F.round(value, digits[field.name])
        return value.alias(field.name)

    return df.select(*map(column, df.schema))


_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# --- order items -----------------------------------------------------------------


@query
def rearranged_items(spark, folder):
    return plain(shape.rearrange_columns(order_items(spark, folder)))


def _folder(spark, name: str) -> str:
    """A new folder for what a query writes."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


PRICES = ("option_price", "option_quantity", "item_price", "item_quantity")


def _written(spark, folder, *columns: str) -> DataFrame:
    """Order items as a written table, for queries that read them more than once."""
    items = order_items(spark, folder)
    columns = columns or items.columns
    return settle(items.select(*columns), slices_of="order_id" if "order_id" in columns else None)


def _by_location(spark, folder, location: str) -> DataFrame:
    """The items' columns that location metrics use."""
    return _written(spark, folder, location, "order_id", "date", *PRICES)


@query
def items_read_back(spark, folder):
    """Order items from files with other names, another order and columns to spare."""
    path = _folder(spark, "items")
    given = order_items(spark, folder).withColumnRenamed("customer_id", "USER_ID")
    given.withColumn("card_number", F.lit("0")).write.parquet(path)
    return plain(read_order_items(spark, path))


@query
def line_revenues(spark, folder):
    return plain(
        order_items(spark, folder).select(
            "lineitem_id",
            line_revenue().alias("revenue_per_order"),
            line_revenue(missing_item_quantity=0).alias("revenue"),
            is_discounted().alias("is_discounted"),
        )
    )


# --- customers -------------------------------------------------------------------


@query
def revenue_per_order(spark, folder):
    return plain(customers.revenue_per_order(order_items(spark, folder)))


def _revenue(spark, folder) -> DataFrame:
    """Revenue per order day, written once for the steps of an exact quantile."""
    return settle(customers.revenue_per_order(order_items(spark, folder)))


def _tagged(spark, folder) -> DataFrame:
    return customers.tag_clv(_revenue(spark, folder), exact=True)


@query
def clv_thresholds_exact(spark, folder):
    return plain(customers.clv_thresholds(_revenue(spark, folder), exact=True))


@query
def clv_tagged_exact(spark, folder):
    return plain(_tagged(spark, folder))


@query
def clv_tagged_approx(spark, folder):
    revenue = _revenue(spark, folder)
    limits = settle(customers.clv_thresholds(revenue))
    return plain(customers.tag_clv(revenue, thresholds=limits))


@query
def top10_clv_per_restaurant(spark, folder):
    ties = ("customer_id", "date_key", "is_loyalty")
    tagged = _tagged(spark, folder)
    return plain(shape.top_rows(tagged, "total_revenue", 10, *ties, per="restaurant_id"))


@query
def rfm(spark, folder):
    return plain(customers.rfm(order_items(spark, folder)))


@query
def rfm_from_days(spark, folder):
    return plain(customers.rfm_from_days(_days(spark, folder)))


@query
def rfm_segmented(spark, folder):
    return plain(customers.segment_customers(customers.rfm(order_items(spark, folder))))


@query
def rfm_segmented_tuned(spark, folder):
    return plain(customers.segment_customers(customers.rfm(order_items(spark, folder)), TUNED))


@query
def customer_profile(spark, folder):
    profile = customers.customer_activity_profile(order_items(spark, folder))
    return plain(profile, avg_pct_change=6)


@query
def profile_appended(spark, folder):
    """The profile from stored states: two spans of days, then late and corrected ones."""
    columns = ("restaurant_id", "customer_id", "order_id", "lineitem_id", "date", *PRICES)
    items, path = _written(spark, folder, *columns), _folder(spark, "activity")
    day, late = F.col("date"), F.dayofmonth("date") == 10
    early = day < "1996-07-01"
    again = F.col("date").between("1997-01-05", "1997-01-07")
    # The first batch lacks half the rows of some days, which the last one brings whole.
    activity.append_activity(items.where(early & ~late), path)
    activity.append_activity(items.where(~early & ~(again & (F.col("order_id") % 2 == 0))), path)
    activity.append_activity(items.where((early & late) | again), path)
    return plain(activity.stored_profile(spark, path), avg_pct_change=6)


@query
def clv_thresholds_by_year(spark, folder):
    """Limits per restaurant and year merged from stored day sketches, against exact ranks."""
    revenue = _revenue(spark, folder)
    stored = settle(sketches.day_sketches(revenue))
    keys = ["restaurant_id", "year"]
    limits = settle(sketches.thresholds_of_days(stored, keys[0], F.year("date_key").alias(keys[1])))
    dated = revenue.withColumn("year", F.year("date_key"))
    errors = sketches.rank_errors(dated, "total_revenue", limits, keys, sketches.CLV_LIMITS)
    checked = (
        (F.col(name) <= 0.01).alias(f"{name}_within_a_hundredth") for name in sketches.CLV_LIMITS
    )
    return plain(errors.select(*keys, "rows", *checked))


@query
def rfm_orders(spark, folder):
    return plain(customers.rfm_with_orders(order_items(spark, folder)))


@query
def loyalty_orders(spark, folder):
    return plain(customers.loyalty_with_orders(order_items(spark, folder)))


@query
def avg_gap_closed_form(spark, folder):
    return plain(customers.average_gap(order_items(spark, folder)))


@query
def loyalty_impact(spark, folder):
    return plain(customers.loyalty_impact(order_items(spark, folder)))


@query
def loyalty_from_days(spark, folder):
    return plain(customers.loyalty_from_days(_days(spark, folder)))


@query
def loyalty_summary(spark, folder):
    impact = customers.loyalty_impact(order_items(spark, folder))
    return plain(customers.loyalty_summary(impact), avg_spend_per_customer=4)


# --- sales -----------------------------------------------------------------------


def _trends(spark, folder, **options) -> sales.SalesTrends:
    return sales.sales_trends(order_items(spark, folder), **options)


@query
def sales_daily(spark, folder):
    return plain(_trends(spark, folder).daily)


@query
def sales_weekly(spark, folder):
    return plain(_trends(spark, folder).weekly)


@query
def sales_weekly_iso(spark, folder):
    return plain(_trends(spark, folder, iso_weeks=True).weekly)


@query
def sales_monthly(spark, folder):
    return plain(_trends(spark, folder).monthly)


@query
def sales_hourly(spark, folder):
    return plain(_trends(spark, folder).hourly)


@query
def sales_weekly_from_hourly(spark, folder):
    return plain(sales.weekly_sales(_trends(spark, folder).hourly))


@query
def sales_monthly_from_hourly(spark, folder):
    return plain(sales.monthly_sales(_trends(spark, folder).hourly))


@query
def sales_levels(spark, folder):
    return plain(sales.sales_levels(order_items(spark, folder)))


@query
def sales_levels_iso(spark, folder):
    return plain(sales.sales_levels(order_items(spark, folder), iso_weeks=True))


@query
def top_locations(spark, folder):
    return plain(locations.top_locations(_by_location(spark, folder, "restaurant_id")))


@query
def top_locations_by_nation(spark, folder):
    return plain(locations.top_locations(_by_location(spark, folder, "location_id"), "location_id"))


@query
def location_activity_merged(spark, folder):
    """Money and active days of each nation, from states of spans of days that overlap."""
    items = _by_location(spark, folder, "location_id")
    day, line = F.col("date"), F.col("order_id") % 2
    spans = (day < "1996-07-01", (day >= "1996-07-01") & (line == 0), (day >= "1996-07-01") & (line == 1))
    states = [settle(locations.location_states(items.where(s), "location_id")) for s in spans]
    merged = locations.merge_location_states(*states, location_col="location_id")
    return plain(locations.location_activity(merged, "location_id"))


@query
def discount_effectiveness(spark, folder):
    return plain(sales.discount_effectiveness(order_items(spark, folder)))


# --- views -----------------------------------------------------------------------


@query
def restaurant_choices(spark, folder):
    return plain(shape.choices(order_items(spark, folder), "restaurant_id"))


def _days(spark, folder) -> DataFrame:
    """Customer days, written once for all that a view builds on them."""
    return settle(customers.customer_days(order_items(spark, folder)))


def _segmented(days: DataFrame) -> DataFrame:
    return customers.segment_customers(customers.rfm_from_days(days), TUNED)


def _segmentation(spark, folder, **options) -> dict[str, DataFrame]:
    days = _days(spark, folder)
    clv = customers.tag_clv(customers.day_revenue(days), exact=True)
    return views.segmentation_view(_segmented(days), clv, **options)


@query
def rfm_by_clv(spark, folder):
    return plain(_segmentation(spark, folder)["rfm_by_clv"])


@query
def clv_top10(spark, folder):
    return plain(_segmentation(spark, folder)["top_clv"])


@query
def clv_tag_choices(spark, folder):
    return plain(_segmentation(spark, folder)["clv_tags"])


@query
def rfm_means_by_loyalty(spark, folder):
    return plain(_segmentation(spark, folder)["rfm_means"])


@query
def high_clv_rfm_means(spark, folder):
    return plain(_segmentation(spark, folder, clv_tag="High CLV")["rfm_means"])


@query
def rfm_table(spark, folder):
    return plain(_segmentation(spark, folder)["rfm_table"])


@query
def recency_histogram(spark, folder):
    return plain(_segmentation(spark, folder)["recency_histogram"])


@query
def monetary_histogram(spark, folder):
    return plain(_segmentation(spark, folder)["monetary_histogram"])


def _churn(spark, folder, **options) -> dict[str, DataFrame]:
    items = _written(spark, folder)
    days = settle(customers.customer_days(items))
    profile = customers.customer_activity_profile(items, as_of=latest(days, "max_date"))
    return views.churn_view(_segmented(days), profile, as_of=AS_OF, **options)


@query
def churn_customers(spark, folder):
    return plain(_churn(spark, folder)["customers"], avg_pct_change=6)


@query
def churn_profile(spark, folder):
    return plain(_churn(spark, folder)["profile_table"], avg_pct_change=6)


@query
def churn_selected(spark, folder):
    chosen = _churn(
        spark,
        folder,
        segments=["VIP", "Churn Risk"],
        activity_tags=["at risk"],
        loyalty_only=True,
        inactive_days=90,
    )
    return plain(chosen["customers"], avg_pct_change=6)


@query
def churn_restaurant(spark, folder):
    """The page as it opens: one restaurant chosen."""
    return plain(_churn(spark, folder, restaurant="1")["profile_table"], avg_pct_change=6)


@query
def churn_unknown_restaurants(spark, folder):
    """Customers of a restaurant without id match themselves, as in a data-frame merge."""
    unknown = F.when(F.col("restaurant_id") != 2, F.col("restaurant_id"))
    items = settle(order_items(spark, folder).withColumn("restaurant_id", unknown))
    days = settle(customers.customer_days(items))
    profile = customers.customer_activity_profile(items, as_of=latest(days, "max_date"))
    found = views.churn_view(_segmented(days), profile, as_of=AS_OF)["profile_table"]
    return plain(found, avg_pct_change=6)


@query
def segment_distribution(spark, folder):
    return plain(_churn(spark, folder)["segment_distribution"])


@query
def revenue_by_last_order(spark, folder):
    return plain(_churn(spark, folder)["revenue_by_last_order"])


def _feed(spark, folder, *selection, **options) -> DataFrame:
    return views.sales_trend_view(_trends(spark, folder), *selection, **options)


@query
def daily_trend_feed(spark, folder):
    return plain(_feed(spark, folder, "Daily"))


@query
def weekly_trend_feed(spark, folder):
    return plain(_feed(spark, folder, "Weekly"))


@query
def monthly_trend_feed(spark, folder):
    return plain(_feed(spark, folder, "Monthly"))


@query
def sales_drilldown(spark, folder):
    """The page's selection of one year, month and week of month, at each restaurant."""
    return plain(_feed(spark, folder, "Daily", year=1995, month="March", week=2))


@query
def hourly_trend_feed(spark, folder):
    return plain(_feed(spark, folder, "Hourly"))


@query
def weekly_drilldown(spark, folder):
    return plain(_feed(spark, folder, "Weekly", year=1995, month="March"))


def _stored_feed(spark, folder, *selection, **options) -> DataFrame:
    """A feed from written datasets, of which only the chosen folder and days are read."""
    base = _folder(spark, "trends")
    trends = sales.sales_trends(order_items(spark, folder), base, schemes=None)
    return views.sales_trend_view(trends, *selection, **options)


@query
def daily_drilldown_restaurant(spark, folder):
    chosen = {"restaurant": "1", "year": 1995, "month": "March", "week": 2}
    return plain(_stored_feed(spark, folder, "Daily", **chosen))


@query
def hourly_drilldown_restaurant(spark, folder):
    return plain(_stored_feed(spark, folder, "Hourly", restaurant="3", year=1996))


@query
def trend_years(spark, folder):
    return plain(views.trend_choices(_feed(spark, folder))["years"])


@query
def trend_months(spark, folder):
    return plain(views.trend_choices(_feed(spark, folder))["months"])


@query
def loyalty_box(spark, folder):
    impact = settle(customers.loyalty_impact(order_items(spark, folder)))
    box = charts.box_feed(impact, "lifetime_value", "is_loyalty", exact=True)
    return plain(box, q1=4, median=4, q3=4)


def _loyalty(spark, folder) -> dict[str, DataFrame]:
    impact = settle(customers.loyalty_impact(order_items(spark, folder)))
    return views.loyalty_view(impact, customers.loyalty_summary(impact), exact=True)


@query
def loyalty_page_summary(spark, folder):
    return plain(_loyalty(spark, folder)["summary"], avg_spend_per_customer=4)


@query
def loyalty_page_box(spark, folder):
    return plain(_loyalty(spark, folder)["lifetime_value_box"], q1=4, median=4, q3=4)


@query
def loyalty_page_bars(spark, folder):
    return plain(_loyalty(spark, folder)["repeat_orders"])


@query
def repeat_orders_bar(spark, folder):
    impact = customers.loyalty_impact(order_items(spark, folder))
    return plain(charts.stacked_bars(impact, "repeat_orders", "is_loyalty"))


@query
def location_top10(spark, folder):
    ranked = locations.top_locations(_by_location(spark, folder, "location_id"), "location_id")
    return plain(views.location_view(ranked, location_col="location_id")["top"])


@query
def location_bars(spark, folder):
    ranked = locations.top_locations(_by_location(spark, folder, "restaurant_id"))
    return plain(views.location_view(ranked)["revenue_bars"])


@query
def discount_table(spark, folder):
    discounts = sales.discount_effectiveness(order_items(spark, folder))
    return plain(views.discount_view(discounts)["table"])


@query
def discount_bars(spark, folder):
    discounts = sales.discount_effectiveness(order_items(spark, folder))
    return plain(views.discount_view(discounts)["revenue_bars"])


# --- the whole job ---------------------------------------------------------------


#: The items' columns that the datasets are made of.
OF_METRICS = (
    "restaurant_id", "customer_id", "order_id", "lineitem_id", "is_loyalty", "item_category", *PRICES,
    "date", "date_key", "time", "day_of_weeks",
)


@query
def metric_roundtrip(spark, folder):
    """Rows and money of each dataset after the job wrote it and it was read back."""
    items = shape.rearrange_columns(_written(spark, folder, *OF_METRICS))
    base = _folder(spark, "metrics")
    return _summaries(build_metrics(items, base, schemes=None))


def _summaries(metrics: dict[str, DataFrame]) -> DataFrame:
    money = {
        "rfm": "monetary", "loyalty": "lifetime_value", "profile": None, "loyalty_summary": None,
        **dict.fromkeys(("daily", "weekly", "monthly", "hourly"), "revenue"),
    }

    def summary(key: str) -> DataFrame:
        column = money.get(key, "total_revenue")
        total = F.sum(column).cast("double") if column else F.lit(None).cast("double")
        return metrics[key].agg(
            F.lit(key).alias("dataset"), F.count(F.lit(1)).alias("rows"), total.alias("money")
        )

    return plain(reduce(DataFrame.unionByName, map(summary, metrics)))


@query
def metrics_rebuilt(spark, folder):
    """As above, after two restaurants, one of which has closed, were built anew."""
    items = shape.rearrange_columns(_written(spark, folder, *OF_METRICS))
    early = (F.col("restaurant_id") == "2") & (F.col("date") < "1996-01-01")
    before = items.withColumn("restaurant_id", F.when(early, "closed").otherwise(F.col("restaurant_id")))
    base = _folder(spark, "metrics")
    as_of = latest(customers.known_customers(items), "date")
    build_metrics(before, base, as_of, schemes=None)
    return _summaries(rebuild_restaurants(items, base, ["2", "closed"], as_of, schemes=None))


@query
def sales_of_two_runs(spark, folder):
    """Daily sales of an older run, without granularity and with other types, and a newer."""
    daily = settle(_trends(spark, folder).daily)
    older, newer = (_folder(spark, "daily") for _ in range(2))
    plainer = daily.where("date < '1996-01-01'").drop("granularity").withColumns(
        {"year": F.col("year").cast("bigint"), "revenue": F.col("revenue").cast("decimal(20,2)")}
    )
    write_metric(plainer, older, "restaurant_id", ("date",))
    write_dataset(daily.where("date >= '1996-01-01'"), newer, "daily")
    return plain(read_runs(spark, [older, newer], "daily"))


# --- contract --------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Every customer of every restaurant, segmented by recency, frequency and spend."""
    return rfm_segmented(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return _QUERIES | ({} if llm is None else llm.QUERIES | {"pipeline": corpus_pipeline.run})


def oracle_sql() -> dict[str, str]:
    return ORACLE | ({} if llm is None else llm.ORACLE)
