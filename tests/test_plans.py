"""What the plans promise about scans, shuffles, pushdown and skew."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dinestat.operators import customers, locations, sales, shape
from dinestat.plans import views
from dinestat.sources.parquet import read_dataset, read_order_items, settle, write_dataset

PACKAGE = Path(__file__).resolve().parents[1] / "dinestat"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """The plan without its subqueries."""
    lines, kept, depth = plan(df).splitlines(), [], None
    for line in lines:
        indent = len(re.match(r"[ :+\-|]*", line).group())
        if "Subquery subquery" in line:
            depth = indent
        elif depth is None or indent <= depth:
            depth = None
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def stored(sample, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "items")
    shape.rearrange_columns(sample).write.parquet(path)
    return read_order_items(spark, path)


def test_operators_never_collect_and_use_no_python_functions():
    # The optional subpackage holds to a list of its own, among its tests.
    files = [p for p in PACKAGE.rglob("*.py") if p.relative_to(PACKAGE).parts[0] != "llm"]
    text = "\n".join(p.read_text() for p in files)
    for forbidden in (
        ".collect()", ".toPandas", ".rdd", "localCheckpoint", "crossJoin", "broadcast(",
        "udf(", "applyInPandas", "mapInPandas", ".persist(", ".cache(", ".coalesce(1)",
    ):
        assert forbidden not in text, forbidden


def test_rfm_scans_once_shuffles_once_and_never_sorts(stored):
    text = main_plan(customers.rfm(stored, as_of="2024-01-01"))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1
    assert "Sort" not in text


def test_default_snapshot_reads_two_columns(stored):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan(customers.rfm(stored)))
    columns = [re.sub(r"#\d+", "", scan).split(",") for scan in scans]
    assert sorted(columns, key=len)[0] == ["customer_id", "date"]
    assert len(columns) == 2 and len(max(columns, key=len)) == 8


def test_guest_filter_reaches_the_scan(stored):
    for metric in (customers.rfm, customers.customer_activity_profile, customers.loyalty_impact):
        text = plan(metric(stored))
        assert text.count("Not(EqualTo(customer_id,_guest))") == text.count("FileScan")


def test_profile_scans_once_and_spreads_rows_by_day(stored):
    text = main_plan(customers.customer_activity_profile(stored, as_of="2024-01-01"))
    assert text.count("FileScan") == 1
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(shuffles) == 2
    assert "date" in shuffles[-1] and "date" not in shuffles[0]


@pytest.mark.parametrize("level", ["daily", "weekly", "monthly", "hourly"])
def test_trends_take_one_scan_of_their_columns_and_one_shuffle(stored, level):
    text = plan(getattr(sales.sales_trends(stored), level))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "item_name" not in text and "customer_id" not in text


def test_location_totals_multiply_no_rows_and_read_each_column_once(stored):
    text = plan(locations.location_totals(stored))
    assert "Expand" not in text
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    columns = [set(re.sub(r"#\d+", "", scan).split(",")) for scan in scans]
    assert len(columns) == 2 and columns[0] & columns[1] == {"restaurant_id"}


def test_all_levels_come_from_one_scan(stored):
    text = plan(sales.sales_levels(stored))
    assert text.count("FileScan") == 1 and text.count("Expand") == 1
    assert text.index("Expand") < text.rindex("Exchange") < text.index("FileScan")


@pytest.mark.parametrize("iso", [False, True])
def test_levels_taken_together_equal_each_by_itself(stored, iso):
    alone = sales.sales_trends(stored, iso_weeks=iso)
    together = sales.sales_trends(stored, iso_weeks=iso, together=True)
    for level in alone._fields:
        one, other = getattr(alone, level), getattr(together, level)
        names = sorted(one.columns)
        assert names == sorted(other.columns)
        assert re.search(rf"PartitionFilters: \[[^\]]*granularity[^\]]* = {level}", plan(other))
        found, wanted = (sorted(map(str, df.select(*names).collect())) for df in (other, one))
        assert found == wanted


def test_segmentation_joins_at_most_three_rows_a_customer(stored):
    days = settle(customers.customer_days(stored))
    rfm = settle(customers.rfm_from_days(days))
    clv = settle(customers.tag_clv(customers.day_revenue(days), exact=True))
    view = views.segmentation_view(rfm, clv)
    joined = rfm.join(views.tag_days(clv), views.KEYS)
    most = joined.groupBy(*views.KEYS).count().agg(F.max("count")).first()[0]
    assert most <= 3 and joined.count() < view["rfm_by_clv"].count()
    assert joined.agg(F.sum("days")).first()[0] == view["rfm_by_clv"].count()
    for name in ("rfm_means", "recency_histogram", "monetary_histogram", "clv_tags"):
        below = plan(view[name]).split("Join", 1)[1]
        assert re.search(r"HashAggregate\(keys=\[restaurant_id[^\]]*clv_tag", below)


def pushed(df):
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan(df))


def scanned_rows(df):
    """Rows that the scans of a plan gave out when it ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


PERIODS = [
    ("Daily", {"year": 1995, "month": "March", "week": 2}, "1995-03-07", "1995-03-14"),
    ("Daily", {"year": 1995, "month": 12}, "1995-12-01", "1996-01-01"),
    ("Hourly", {"year": 1995, "month": 1, "week": 1}, "1995-01-01", "1995-01-07"),
    ("Monthly", {"year": 1996}, "1996-01-01", "1997-01-01"),
    ("Weekly", {"year": 1996, "month": 2}, "1995-12-29", "1997-01-01"),
]


@pytest.fixture(scope="module")
def written_trends(sample, spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("trends"))
    spark.conf.set("parquet.block.size", 4096)
    spark.conf.set("parquet.page.size", 1024)
    try:
        sales.sales_trends(sample, base, schemes=None)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.size")
    levels = ("daily", "weekly", "monthly", "hourly")
    return sales.SalesTrends(*(read_dataset(spark, f"{base}/{key}", key) for key in levels)), base


@pytest.mark.parametrize(("level", "period", "start", "end"), PERIODS)
def test_periods_reach_the_scan_as_date_bounds(
    written_trends, settings, level, period, start, end
):
    settings({"spark.sql.maxMetadataStringLength": "1000"})
    trends, _ = written_trends
    feed = views.sales_trend_view(trends, level, restaurant="1", **period)
    (filters,) = pushed(feed)
    assert f"GreaterThanOrEqual(date,{start})" in filters and f"LessThan(date,{end})" in filters
    assert "PartitionFilters: [isnotnull(restaurant_id" in plan(feed)
    whole = views.sales_trend_view(trends, level, restaurant="1").collect()
    month = period.get("month")
    wanted = [
        r for r in whole
        if r.year == period["year"]
        and (month is None or month in (r.month, r.month_name))
        and ("week" not in period or r.week_of_month == period["week"])
    ]
    assert feed.collect() == wanted


def test_a_short_period_skips_row_groups(written_trends, spark):
    import pyarrow.parquet as pq

    trends, base = written_trends
    files = sorted(Path(base, "hourly", "restaurant_id=1").glob("*.parquet"))
    groups = [
        meta.row_group(i).column(meta.schema.names.index("date")).statistics
        for meta in (pq.read_metadata(f) for f in files)
        for i in range(meta.num_row_groups)
    ]
    assert len(groups) > 2
    assert all(a.max <= b.min for a, b in zip(groups, groups[1:]))
    all_rows = scanned_rows(views.sales_trend_view(trends, "Hourly", restaurant="1"))
    march = views.sales_trend_view(trends, "Hourly", restaurant="1", year=1995, month=3)
    assert 0 < scanned_rows(march) < all_rows / 2


def test_clv_tagging_starts_no_job(stored, spark):
    spark.sparkContext.setJobGroup("tagging", "")
    try:
        customers.tag_clv(customers.revenue_per_order(stored))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("tagging")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


def test_small_written_thresholds_are_broadcast_by_size(stored, settings):
    revenue = settle(customers.revenue_per_order(stored))
    limits = settle(customers.clv_thresholds(revenue))
    tagged = customers.tag_clv(revenue, thresholds=limits)
    text = plan(tagged)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    settings({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    shuffled = customers.tag_clv(revenue, thresholds=limits)
    assert "SortMergeJoin" in plan(shuffled)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, tagged.collect()))


def test_consecutive_rows_are_sorted_by_customer_first(stored):
    """A restaurant's name is alike in most rows of a task, so sorting by it first is slow."""
    for df in (customers.day_states(stored), customers.customer_activity_profile(stored)):
        sorts = re.findall(r"Sort \[(\w+)#", plan(df))
        assert sorts and set(sorts) == {"customer_id"}


def test_exact_tags_do_not_gather_a_restaurant(stored):
    """Their limits are written first, so that the rows meet them where they are."""
    tagged = customers.tag_clv(settle(customers.revenue_per_order(stored)), exact=True)
    tagged.collect()
    text = plan(tagged)
    assert "BroadcastHashJoin" in text
    assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_a_hot_restaurant_is_split_when_thresholds_are_not_broadcast(spark, settings):
    settings(
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
            "spark.sql.shuffle.partitions": "8",
        }
    )
    hot = F.col("id") % 3 == 0
    other = F.concat(F.lit("r"), F.col("id") % 500)
    revenue = settle(
        spark.range(90_000, numPartitions=6).select(
            F.when(hot, "hot").otherwise(other).alias("restaurant_id"),
            F.abs(F.hash("id")).cast("decimal(28,2)").alias("total_revenue"),
        )
    )
    limits = settle(customers.clv_thresholds(revenue))
    tagged = customers.tag_clv(revenue, thresholds=limits)
    tags = [row.clv_tag for row in tagged.collect() if row.restaurant_id == "hot"]
    assert "skew=true" in plan(tagged)
    assert tagged.count() == 90_000 and len(tags) == 30_000
    assert 0.19 < tags.count("High CLV") / 30_000 < 0.21


def test_restaurant_selection_reads_one_folder(spark, make_items, tmp_path):
    items = make_items(*({"restaurant_id": r} for r in ("r1", "r2", "r3")))
    write_dataset(customers.customer_activity_profile(items), str(tmp_path / "profile"), "profile")
    profile = read_dataset(spark, str(tmp_path / "profile"), "profile")
    rfm = customers.segment_customers(customers.rfm(items))
    text = plan(views.churn_view(rfm, profile, "r2")["customers"])
    assert re.search(r"PartitionFilters: \[[^\]]*restaurant_id[^\]]* = r2", text)


def test_top_rows_keep_only_the_best_before_the_shuffle(spark):
    df = settle(spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v")))
    assert "TakeOrderedAndProject" in plan(shape.top_rows(df, "v", 10, "g"))
    assert "WindowGroupLimit" in plan(shape.top_rows(df, "v", 10, per="g"))
