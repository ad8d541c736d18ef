"""Customer activity from stored day states, so that new days need no old items.

The state of a span of days holds what its neighbours need: first and last day, the revenue
of its first and of its last row, and the changes added up between. Two spans that follow
one another merge by the one change from the last row of the one to the first row of the
other. Undated rows are a day before all others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dinestat.functions import tags
from dinestat.functions.dates import as_of_date
from dinestat.functions.money import ratio, relative_change
from dinestat.operators.customers import average_gap_between, day_states, tag_activity
from dinestat.sources.parquet import settle, write_metric

KEYS = ("restaurant_id", "customer_id")
#: Where undated rows stand in the order of days.
UNDATED = dt.date(1600, 1, 1)
_SUMS = ("change", "changes", "dated_rows")


def activity_days(items: DataFrame) -> DataFrame:
    """State of each customer's day, from all items of that day."""
    place = F.coalesce("date", F.lit(UNDATED))
    return day_states(items).select(
        *KEYS,
        place.alias("from_date"), place.alias("to_date"),
        F.col("date").alias("first_date"), F.col("date").alias("last_date"),
        "opening", "closing", *_SUMS,
    )


def merge_activity(states: DataFrame, *within: str) -> DataFrame:
    """One state per customer, and per value of the ``within`` columns, from its spans.

    Spans must not share days, though one may lie in a gap between days of another that is
    not yet merged; overlapping ones raise an error when the result is computed. A
    customer's spans are put in order by one task, so merge days into months first.
    """
    keys = [*KEYS, *within]
    # The key of most values first: sorting then seldom compares beyond its first bytes.
    in_order = Window.partitionBy("customer_id", *within, "restaurant_id").orderBy("from_date")
    placed = states.select(
        "*",
        F.lag("closing").over(in_order).alias("previous"),
        F.lag("to_date").over(in_order).alias("reached"),
        (F.row_number().over(in_order) == 1).alias("is_first"),
        F.lead(F.lit(1)).over(in_order).isNull().alias("is_last"),
    )
    overlaps = F.raise_error(F.lit("spans of days overlap")).cast("double")
    step = F.when(F.col("from_date") <= F.col("reached"), overlaps).otherwise(
        relative_change(F.col("opening"), F.col("previous"))
    )
    return (
        placed.withColumn("step", step)
        .groupBy(*keys)
        .agg(
            F.min("from_date").alias("from_date"),
            F.max("to_date").alias("to_date"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
            F.max(F.when(F.col("is_first"), F.col("opening"))).alias("opening"),
            F.max(F.when(F.col("is_last"), F.col("closing"))).alias("closing"),
            _total(F.sum("change"), F.sum("step")).alias("change"),
            (F.sum("changes") + F.count("step")).alias("changes"),
            F.sum("dated_rows").alias("dated_rows"),
        )
    )


def _total(one: Column, other: Column) -> Column:
    return F.coalesce(one + other, one, other)


def profile_of_states(
    states: DataFrame,
    risk_days: int = tags.RISK_DAYS,
    as_of: dt.date | str | Column | None = None,
) -> DataFrame:
    """The activity profile from one state per customer."""
    snapshot = as_of_date(as_of, states, "last_date")
    profile = states.select(
        *KEYS,
        F.col("last_date").alias("last_order_date"),
        average_gap_between("first_date", "last_date", "dated_rows").alias("avg_gap_days"),
        ratio(F.col("change"), F.col("changes")).alias("avg_pct_change"),
        F.datediff(snapshot, F.col("last_date")).alias("days_since_last_order"),
    )
    return profile.transform(tag_activity, risk_days)


# --- the stored states -----------------------------------------------------------


def _month(day: str) -> Column:
    dated = F.date_format(F.col(day), "'m'yyyy_MM")
    return F.when(F.col(day) == F.lit(UNDATED), "undated").otherwise(dated).alias("month")


def append_activity(items: DataFrame, path: str) -> None:
    """Add days to the states stored below ``path``, late ones and corrected ones as well.

    ``items`` hold whole days of some restaurants: what is stored of the same restaurant
    and day is replaced. Only the months they fall in are read and written again, days and
    the months' merged states; all other folders stay untouched. Running it again with the
    same items gives the same states, so a job that was lost half way is repeated.
    """
    days = settle(activity_days(items).select("*", _month("from_date")))
    stored = _stored(items.sparkSession, f"{path}/days")
    if stored is not None:
        # Lists of months and of restaurants' days: their size is known once written.
        months = settle(days.select("month").distinct())
        renewed = settle(days.select("restaurant_id", "from_date").distinct())
        same = stored["restaurant_id"].eqNullSafe(renewed["restaurant_id"]) & (
            stored["from_date"] == renewed["from_date"]
        )
        kept = stored.join(months, "month", "left_semi").join(renewed, same, "left_anti")
        days = settle(days.unionByName(kept))
    write_metric(days, f"{path}/days", "month", ("from_date",), only_folders=True)
    merged = merge_activity(days, "month")
    write_metric(merged, f"{path}/months", "month", ("customer_id",), only_folders=True)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored_profile(
    spark: SparkSession,
    path: str,
    risk_days: int = tags.RISK_DAYS,
    as_of: dt.date | str | Column | None = None,
) -> DataFrame:
    """The activity profile of all days stored below ``path``, from their months' states."""
    months = spark.read.parquet(f"{path}/months").drop("month")
    return profile_of_states(merge_activity(months), risk_days, as_of)
