"""The batch job: one order-items table in, twelve metric datasets out."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinestat.functions.dates import as_of_date
from dinestat.operators import customers, sales
from dinestat.operators.locations import top_locations
from dinestat.operators.ranking import number_rows
from dinestat.sources.parquet import (
    DEFAULT_SCHEMES,
    checkpoint_folder,
    dataset_path,
    drop_folders,
    load_metrics,
    output_path,
    read_dataset,
    remove_folder,
    scratch_tables,
    settle,
    write_dataset,
)
from dinestat.sources.schema import DATASETS


def build_metrics(
    items: DataFrame,
    base: str,
    as_of: dt.date | str | None = None,
    schemes: tuple[str, ...] | None = DEFAULT_SCHEMES,
    exact_clv: bool = False,
    at_once: int = 4,
) -> dict[str, DataFrame]:
    """Write every metric of canonical ``items`` below ``base`` and return them as read.

    The items are scanned seven times for twelve datasets: for the customer days (then
    revenue, CLV, RFM and loyalty), the activity profile, the hourly sales (then daily,
    weekly and monthly), the locations (money and days, then orders) and the discounts
    (money, then orders). What several datasets build on is written first and read back
    with only the columns each of them needs.

    Up to ``at_once`` datasets of sales and locations are written at the same time, so that
    executors left idle by the last tasks of one job take up the next. The shuffles of all
    steps together would take several times the disk of the items, so the larger ones of
    customers follow one after another: first the profile, in slices of customers if the
    items are large, and last the two copies of the revenue.
    """
    base = output_path(base, schemes)
    if base is None:
        raise ValueError("an output path is needed")
    spark = items.sparkSession

    def write(key: str, df: DataFrame) -> DataFrame:
        write_dataset(df, dataset_path(base, key), key)
        return read_dataset(spark, dataset_path(base, key), key)

    def trends() -> None:
        folder = dataset_path(base, sales.HOURLY).removesuffix(sales.HOURLY)
        sales.sales_trends(items, folder, schemes=schemes)

    def lifetime_value(days: DataFrame) -> None:
        revenue = write("revenue", customers.day_revenue(days))
        limits = settle(customers.clv_thresholds(revenue, exact=exact_clv))
        write("clv", customers.tag_clv(revenue, thresholds=limits))

    def loyalty(days: DataFrame) -> None:
        impact = write("loyalty", customers.loyalty_from_days(days))
        write("loyalty_summary", customers.loyalty_summary(impact))

    def scores(days: DataFrame, snapshot: Column) -> None:
        write("rfm", customers.segment_customers(customers.rfm_from_days(days, snapshot)))

    def profile(snapshot: Column) -> None:
        activity = customers.customer_activity_profile(items, as_of=snapshot)
        write("profile", settle(activity, slices_of="customer_id"))

    # All datasets are written when the block ends, so what they were made from can go.
    with scratch_tables(spark), ThreadPoolExecutor(at_once) as pool:
        started = [
            pool.submit(trends),
            pool.submit(lambda: write("locations", top_locations(items))),
            pool.submit(lambda: write("discounts", sales.discount_effectiveness(items))),
        ]
        for step in started:
            step.result()
        days = settle(customers.customer_days(items))
        snapshot = as_of_date(as_of, days, "max_date")
        profile(snapshot)
        scores(days, snapshot)
        loyalty(days)
        lifetime_value(days)
    return load_metrics(spark, base)


def rebuild_restaurants(
    items: DataFrame,
    base: str,
    restaurants: Sequence[str],
    as_of: dt.date | str | Column,
    schemes: tuple[str, ...] | None = DEFAULT_SCHEMES,
    exact_clv: bool = False,
    at_once: int = 4,
) -> dict[str, DataFrame]:
    """Every metric below ``base`` anew for some restaurants, all others left as they are.

    ``items`` hold all rows of those restaurants, and may hold others, which are not used.
    Pass the ``as_of`` of the stored job, so that days since then mean the same in all rows.
    Datasets with a folder per restaurant have just those folders replaced; flat ones are
    written again from the rows kept and the new ones, and ranks are given anew over all.
    A restaurant that is named and has no rows any more vanishes from every dataset; one
    that is not named never does. Running it again gives the same.

    The items are scanned once for the rows of the named restaurants, which are written for
    the steps of the job. Folders of up to ``at_once`` datasets are replaced at the same time,
    flat datasets one after another, as each is written twice. What is written on the way
    is removed as soon as it has been used.
    """
    base = output_path(base, schemes)
    if base is None:
        raise ValueError("an output path is needed")
    spark, named = items.sparkSession, list(restaurants)
    of_named = F.col("restaurant_id").isin(named)
    scratch = f"{checkpoint_folder(spark)}/rebuilt-{uuid.uuid4().hex}"
    with scratch_tables(spark):
        own = settle(items.where(of_named))
        rebuilt = build_metrics(own, scratch, as_of, None, exact_clv, at_once)

    def replace_folders(key: str, folder: str) -> None:
        path, rows = dataset_path(base, key), rebuilt[key]
        present = rows.select(folder).distinct()
        gone = spark.createDataFrame([(r,) for r in named], f"{folder} string").subtract(present)
        write_dataset(rows, path, key, only_folders=True)
        drop_folders(spark, path, folder, [row[0] for row in gone.toLocalIterator()])

    def replace_rows(key: str) -> None:
        path, rows = dataset_path(base, key), rebuilt[key]
        kept = read_dataset(spark, path, key).where(~F.coalesce(of_named, F.lit(False)))
        together = settle(kept.unionByName(rows))
        if key == "locations":
            together = number_rows(together.drop("rank"), "total_revenue", "restaurant_id")
        write_dataset(together, path, key)

    folders = {key: DATASETS[key].partition_by for key in rebuilt}
    with ThreadPoolExecutor(at_once) as pool:
        started = [pool.submit(replace_folders, *item) for item in folders.items() if item[1]]
        for key in (key for key, folder in folders.items() if not folder):
            with scratch_tables(spark):
                replace_rows(key)
        for step in started:
            step.result()
    remove_folder(spark, scratch)
    return load_metrics(spark, base)
