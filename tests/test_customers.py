import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.functions.tags import SegmentThresholds
from dinestat.operators import customers


def day(offset):
    return dt.date(2024, 1, 1) + dt.timedelta(days=offset)


def rows(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def test_guests_and_unknown_customers_take_no_part(make_items):
    items = make_items({"customer_id": "_guest"}, {"customer_id": None}, {"customer_id": "c1"})
    for metric in (
        customers.revenue_per_order,
        customers.rfm,
        customers.customer_activity_profile,
        customers.average_gap,
        customers.loyalty_impact,
    ):
        assert [row.customer_id for row in metric(items).collect()] == ["c1"]


def test_snapshot_ignores_guests(make_items):
    items = make_items({"date": day(0)}, {"customer_id": "_guest", "date": day(90)})
    assert customers.rfm(items).first().recency == 0
    assert customers.rfm(items, as_of=day(30)).first().recency == 30
    assert customers.rfm(items, as_of="2024-01-31").first().recency == 30


def test_snapshot_spans_restaurants(make_items):
    items = make_items({"date": day(0)}, {"restaurant_id": "r2", "date": day(7)})
    assert rows(customers.rfm(items), "restaurant_id", "recency") == [("r1", 7), ("r2", 0)]


def test_missing_item_quantity_counts_once(make_items):
    items = make_items({"item_price": 10, "item_quantity": None})
    row = customers.revenue_per_order(items).first()
    assert row.total_revenue == Decimal("10.00")
    assert row.total_orders == 1 and row.avg_revenue_per_order == 10.0


def test_revenue_per_order_keeps_loyalty_flags_and_days_apart(make_items):
    items = make_items(
        {"is_loyalty": True, "item_price": 4},
        {"is_loyalty": True, "item_price": 6, "order_id": None},
        {"is_loyalty": None},
        {"is_loyalty": True, "date_key": day(1)},
    )
    found = customers.revenue_per_order(items).filter("is_loyalty").orderBy("date_key").collect()
    assert [(r.total_revenue, r.total_orders, r.min_revenue_per_order) for r in found] == [
        (10, 1, 4),
        (10, 1, 10),
    ]
    assert customers.revenue_per_order(items).count() == 3


def test_frequency_counts_rows_and_since_limits_them(make_items):
    items = make_items({"order_id": "o"}, {"order_id": "o"}, {"date": day(5)})
    assert customers.rfm(items).first().frequency == 3
    late = customers.rfm(items, since=day(5)).first()
    assert (late.frequency, late.monetary) == (1, 10)


@pytest.mark.parametrize(
    "flags, expected",
    [
        ([(0, None), (1, True), (2, False)], True),
        ([(0, None), (1, False), (2, True)], False),
        ([(2, True), (1, False)], False),
        ([(0, None), (0, None)], None),
        ([(0, True)], True),
        ([(None, False), (0, True)], False),
        ([(3, True), (3, False)], True),
    ],
)
def test_first_known_loyalty(make_items, flags, expected):
    items = make_items(
        *({"date": None if d is None else day(d), "is_loyalty": flag} for d, flag in flags)
    )
    assert customers.rfm(items).first().is_loyalty is expected
    days = customers.customer_days(items)
    assert customers.rfm_from_days(days).first().is_loyalty is expected


@pytest.mark.parametrize(
    "recency, frequency, monetary, segment",
    [
        (180, 51, 501, "VIP"),
        (181, 51, 501, "Other"),
        (180, 50, 501, "New Customer"),
        (180, 51, 500, "Other"),
        (180, 50, 200, "Other"),
        (180, 50, 201, "New Customer"),
        (181, 5, 1000, "Churn Risk"),
        (181, 6, 1000, "Other"),
        (181, 5, 1001, "Other"),
        (180, 5, 100, "Other"),
        (None, 5, 100, "Other"),
    ],
)
def test_segments(spark, recency, frequency, monetary, segment):
    schema = "recency INT, frequency BIGINT, monetary DECIMAL(28,2)"
    scores = spark.createDataFrame([(recency, frequency, Decimal(monetary))], schema)
    assert customers.segment_customers(scores).first().segment == segment


def test_segment_thresholds_are_arguments(spark):
    scores = spark.createDataFrame([(10, 3, 50.0)], "recency INT, frequency BIGINT, monetary DOUBLE")
    limits = SegmentThresholds(vip_frequency=2, vip_monetary=40)
    assert customers.segment_customers(scores, limits).first().segment == "VIP"


# --- activity profile ------------------------------------------------------------


def test_same_day_rows_follow_line_order(make_items):
    tied = [
        {"item_price": 5, "order_id": "o", "lineitem_id": "a"},
        {"item_price": 10, "order_id": "o", "lineitem_id": "b"},
    ]
    for order in (tied, tied[::-1]):
        profile = customers.customer_activity_profile(make_items(*order)).first()
        assert profile.avg_pct_change == 1.0
        assert profile.avg_gap_days == 0.0


def test_options_of_one_line_do_not_depend_on_row_order(make_items):
    same_line = {"order_id": "o", "lineitem_id": "a"}
    tied = [same_line | {"item_price": p} for p in (8, 2, 4)]
    results = {
        customers.customer_activity_profile(make_items(*order)).first().avg_pct_change
        for order in (tied, tied[::-1], [tied[1], tied[0], tied[2]])
    }
    assert results == {1.0}


def test_zero_previous_revenue_gives_no_change(make_items):
    items = make_items({"item_price": 0, "date": day(0)}, {"item_price": 5, "date": day(1)})
    assert customers.customer_activity_profile(items).first().avg_pct_change is None


def test_single_order(make_items):
    row = customers.customer_activity_profile(make_items({})).first()
    assert (row.avg_gap_days, row.avg_pct_change) == (None, None)
    assert (row.recency_tag, row.gap_tag, row.activity_tag) == ("active", "healthy", "active")


@pytest.mark.parametrize("idle, tag", [(45, "active"), (46, "inactive")])
def test_inactivity_edge(make_items, idle, tag):
    row = customers.customer_activity_profile(make_items({}), as_of=day(idle)).first()
    assert (row.days_since_last_order, row.recency_tag) == (idle, tag)
    assert row.activity_tag == ("at risk" if tag == "inactive" else "active")


@pytest.mark.parametrize("gap, tag, activity", [(45, "healthy", "active"), (46, "at risk", "at risk")])
def test_average_gap_edge(make_items, gap, tag, activity):
    items = make_items({"date": day(0)}, {"date": day(40)}, {"date": day(2 * gap)})
    row = customers.customer_activity_profile(items).first()
    assert (row.avg_gap_days, row.gap_tag, row.activity_tag) == (gap, tag, activity)


def test_risk_days_is_an_argument(make_items):
    row = customers.customer_activity_profile(make_items({}), risk_days=10, as_of=day(11)).first()
    assert row.recency_tag == "inactive"


def test_unknown_restaurant_keeps_its_averages(make_items):
    items = make_items(
        {"restaurant_id": None, "date": day(0), "item_price": 5},
        {"restaurant_id": None, "date": day(4), "item_price": 10},
    )
    row = customers.customer_activity_profile(items).first()
    assert (row.restaurant_id, row.avg_gap_days, row.avg_pct_change) == (None, 4.0, 1.0)


def test_undated_rows_come_first_and_have_no_gap(make_items):
    items = make_items(
        {"date": day(3), "item_price": 4},
        {"date": None, "item_price": 2},
        {"date": day(5), "item_price": 2},
    )
    row = customers.customer_activity_profile(items).first()
    assert (row.avg_gap_days, row.avg_pct_change) == (2.0, 0.25)
    undated = customers.customer_activity_profile(make_items({"date": None}, {"date": None}))
    assert undated.first().avg_gap_days is None


def brute_profile(items):
    """Gaps and changes of each customer by walking its rows in order."""
    kept = items.select(
        "restaurant_id", "customer_id", "date", "order_id", "lineitem_id",
        customers.line_revenue().alias("revenue"),
    ).collect()
    groups = {}
    for row in kept:
        if row.customer_id not in (None, "_guest"):
            groups.setdefault((row.restaurant_id, row.customer_id), []).append(row)
    result = {}
    for key, found in groups.items():
        found.sort(key=lambda r: (r.date, r.order_id, r.lineitem_id, r.revenue))
        pairs = list(zip(found, found[1:]))
        gaps = [(b.date - a.date).days for a, b in pairs]
        changes = [float(b.revenue - a.revenue) / float(a.revenue) for a, b in pairs if a.revenue]
        mean = [sum(x) / len(x) if x else None for x in (gaps, changes)]
        result[key] = (found[-1].date, *mean)
    return result


def test_profile_matches_a_walk_over_each_customer(sample):
    expected = brute_profile(sample)
    profile = customers.customer_activity_profile(sample).collect()
    assert len(profile) == len(expected)
    for row in profile:
        last, gap, change = expected[row.restaurant_id, row.customer_id]
        assert row.last_order_date == last
        assert row.avg_gap_days == (None if gap is None else pytest.approx(gap))
        assert row.avg_pct_change == (None if change is None else pytest.approx(change))


def test_profile_of_a_customer_with_most_rows(make_items):
    rng = random.Random(5)
    hot = [
        {
            "date": day(rng.randrange(300)),
            "order_id": f"o{rng.randrange(40)}",
            "item_price": rng.randrange(4),
        }
        for _ in range(1500)
    ]
    cold = [{"customer_id": f"x{i % 90}", "date": day(i % 7), "item_price": i} for i in range(300)]
    items = make_items(*hot, *cold)
    expected = brute_profile(items)
    for row in customers.customer_activity_profile(items).collect():
        _, gap, change = expected[row.restaurant_id, row.customer_id]
        assert row.avg_gap_days == pytest.approx(gap)
        assert row.avg_pct_change == (None if change is None else pytest.approx(change))


def test_closed_form_gap_equals_profile_gap(sample):
    columns = ("restaurant_id", "customer_id", "avg_gap_days")
    closed = {tuple(r) for r in customers.average_gap(sample).select(*columns).collect()}
    profile = customers.customer_activity_profile(sample).select(*columns).collect()
    assert closed == {tuple(r) for r in profile}


def test_results_do_not_depend_on_partitioning(sample):
    shuffled = sample.orderBy(F.rand(7)).repartition(13)
    for metric in (
        customers.revenue_per_order,
        customers.rfm,
        customers.customer_activity_profile,
        customers.loyalty_impact,
    ):
        assert sorted(map(str, metric(sample).collect())) == sorted(
            map(str, metric(shuffled).collect())
        )


def test_day_sums_lead_to_the_same_metrics(sample):
    days = customers.customer_days(sample)
    for direct, summed in (
        (customers.rfm(sample), customers.rfm_from_days(days)),
        (customers.loyalty_impact(sample), customers.loyalty_from_days(days)),
    ):
        columns = direct.columns
        assert sorted(map(str, direct.collect())) == sorted(
            map(str, summed.select(*columns).collect())
        )


# --- lifetime value --------------------------------------------------------------

VALUES = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": "restaurant_id", "type": "string", "nullable": True, "metadata": {}},
            {"name": "total_revenue", "type": "decimal(28,2)", "nullable": True, "metadata": {}},
        ],
    }
)


@pytest.fixture
def values(spark):
    def build(**restaurants):
        data = [
            (None if name == "unknown" else name, None if v is None else Decimal(v))
            for name, numbers in restaurants.items()
            for v in numbers
        ]
        return spark.createDataFrame(data, VALUES)

    return build


@pytest.mark.parametrize("exact", [False, True])
def test_equal_values_are_all_high(values, exact):
    tagged = customers.tag_clv(values(r=[7] * 5), exact=exact)
    assert {row.clv_tag for row in tagged.collect()} == {"High CLV"}


@pytest.mark.parametrize("exact", [False, True])
def test_values_without_thresholds_are_medium(values, exact):
    df = values(r=[None, None], unknown=[1, 2, 3], s=[1])
    tagged = customers.tag_clv(df, exact=exact)
    assert rows(tagged.groupBy("clv_tag").count(), "clv_tag", "count") == [
        ("High CLV", 1),
        ("Medium CLV", 5),
    ]


@pytest.mark.parametrize("exact", [False, True])
def test_fifths_per_restaurant(values, exact):
    df = values(a=range(1, 11), b=range(100, 1100, 100))
    tagged = customers.tag_clv(df, exact=exact)
    assert tagged.columns == [*df.columns, "clv_tag"]
    counts = tagged.groupBy("restaurant_id", "clv_tag").count()
    assert rows(counts, "restaurant_id", "clv_tag", "count") == [
        (r, tag, n)
        for r in "ab"
        for tag, n in (("High CLV", 3), ("Low CLV", 2), ("Medium CLV", 5))
    ]


def test_given_thresholds_are_used(values, spark):
    limits = spark.createDataFrame(
        [("a", 2, 4)], "restaurant_id STRING, low_threshold INT, high_threshold INT"
    )
    tagged = customers.tag_clv(values(a=[2, 3, 4]), thresholds=limits)
    assert rows(tagged, "total_revenue", "clv_tag") == [
        (2, "Low CLV"),
        (3, "Medium CLV"),
        (4, "High CLV"),
    ]


def test_sketched_thresholds_stay_within_their_rank_error(spark):
    df = spark.range(100_000).select(
        F.lit("r").alias("restaurant_id"), F.abs(F.hash("id")).alias("total_revenue")
    )
    limits = customers.clv_thresholds(df).first()
    for limit, share in ((limits.low_threshold, 0.2), (limits.high_threshold, 0.8)):
        rank = df.filter(F.col("total_revenue") <= limit).count() / 100_000
        assert abs(rank - share) <= 0.01


# --- loyalty ---------------------------------------------------------------------


def test_loyalty_summary_averages_customers_not_rows(make_items):
    items = make_items(
        {"customer_id": "a", "is_loyalty": True, "item_price": 10},
        {"customer_id": "a", "is_loyalty": True, "item_price": 20},
        {"customer_id": "b", "is_loyalty": True, "item_price": 40},
        {"customer_id": "b", "is_loyalty": None, "item_price": 1},
    )
    impact = customers.loyalty_impact(items)
    assert rows(impact.filter("is_loyalty"), "customer_id", "average_spend", "repeat_orders") == [
        ("a", 15.0, 2),
        ("b", 40.0, 1),
    ]
    summary = customers.loyalty_summary(impact).filter("is_loyalty").first()
    assert summary.avg_spend_per_customer == 27.5
    assert summary.avg_repeat_orders == 1.5
    assert summary.avg_lifetime_value == 35.0
    assert customers.loyalty_summary(impact).filter("is_loyalty IS NULL").count() == 1
