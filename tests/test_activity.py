"""The activity profile from stored states, for every cut of the days."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dinestat.operators import activity, customers
from dinestat.sources.parquet import settle


def rows(df):
    out = df.withColumn("avg_pct_change", F.round("avg_pct_change", 9))
    return sorted(map(str, out.select(*sorted(out.columns)).collect()))


@pytest.fixture(scope="module")
def items(make_items):
    rng = random.Random(11)
    made = [
        {
            "restaurant_id": rng.choice(["r1", "r2", None]),
            "customer_id": rng.choice(["c1", "c2", "c3", "_guest"]),
            "order_id": f"o{rng.randrange(60)}",
            "date": rng.choice([None, *(dt.date(2024, m, d) for m in (1, 2, 3) for d in (1, 9, 10, 30 - m))]),
            "item_price": rng.choice([0, 5, 7, 12]),
        }
        for _ in range(300)
    ]
    return settle(make_items(*made))


@pytest.fixture(scope="module")
def whole(items):
    return rows(customers.customer_activity_profile(items))


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_of_the_days_merges_to_the_whole(items, whole, seed):
    days = settle(activity.activity_days(items))
    rng = random.Random(seed)
    cuts = sorted(rng.sample([dt.date(2024, m, d) for m in (1, 2, 3) for d in range(1, 30)], 3))
    span = sum((F.col("from_date") >= F.lit(c)).cast("int") for c in cuts)
    spans = activity.merge_activity(days.withColumn("span", span), "span").drop("span")
    assert rows(activity.profile_of_states(activity.merge_activity(spans))) == whole
    twice = activity.merge_activity(spans.withColumn("half", F.col("from_date") > F.lit(cuts[1])), "half")
    assert rows(activity.profile_of_states(activity.merge_activity(twice.drop("half")))) == whole


def test_overlapping_spans_are_refused(items):
    days = activity.activity_days(items)
    with pytest.raises(Exception, match="spans of days overlap"):
        activity.merge_activity(days.unionByName(days)).collect()


ORDERS = {
    "in order": [["2024-01"], ["2024-02"], ["2024-03"], [None]],
    "late month": [["2024-03"], ["2024-01", None], ["2024-02"]],
    "again": [["2024-01", "2024-02"], ["2024-02", "2024-03", None], ["2024-02"]],
}


@pytest.mark.parametrize("name", ORDERS)
def test_appended_months(spark, items, whole, tmp_path, name):
    month = F.date_format("date", "yyyy-MM")
    for batch in ORDERS[name]:
        chosen = [month.eqNullSafe(F.lit(m)) for m in batch]
        wanted = chosen[0]
        for one in chosen[1:]:
            wanted = wanted | one
        activity.append_activity(items.where(wanted), str(tmp_path))
    assert rows(activity.stored_profile(spark, str(tmp_path))) == whole


def test_late_and_corrected_days(spark, items, whole, tmp_path):
    late = F.dayofmonth("date") == 9
    half = F.col("order_id").substr(-1, 1) < "5"
    activity.append_activity(items.where(~F.coalesce(late, F.lit(False)) & half), str(tmp_path))
    activity.append_activity(items.where(late), str(tmp_path))
    # Days that came by half are brought whole.
    activity.append_activity(items.where(~F.coalesce(late, F.lit(False))), str(tmp_path))
    assert rows(activity.stored_profile(spark, str(tmp_path))) == whole


def test_other_months_are_left_alone(spark, items, tmp_path):
    activity.append_activity(items, str(tmp_path))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    activity.append_activity(items.where("date = '2024-02-09'"), str(tmp_path))
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    changed = {p.parent.name for p in before.keys() ^ after.keys()}
    assert changed == {"month=m2024_02"}
    assert all(after[p] == t for p, t in before.items() if p in after)


def test_profile_reads_one_row_a_customer_and_month(spark, items, tmp_path):
    activity.append_activity(items, str(tmp_path))
    months = spark.read.parquet(f"{tmp_path}/months")
    assert months.groupBy(*activity.KEYS, "month").count().agg(F.max("count")).first()[0] == 1
    plan = activity.stored_profile(spark, str(tmp_path), as_of="2024-05-01")
    assert "/days" not in plan._jdf.queryExecution().executedPlan().toString()
