import math
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dinestat.functions import dates
from dinestat.operators import charts, quantiles, shape
from dinestat.operators.quantiles import exact_quantiles
from dinestat.operators.ranking import number_rows
from dinestat.sources.schema import ORDER_ITEMS


# --- layout ----------------------------------------------------------------------


def test_rearrange_adds_drops_renames_and_types(spark):
    df = spark.createDataFrame([("x", "u", "3.5", 1)], "foo STRING, user_id STRING, item_price STRING, item_quantity BIGINT")
    out = shape.rearrange_columns(df)
    assert out.schema == ORDER_ITEMS
    row = out.first()
    assert (row.customer_id, row.item_price, row.item_quantity, row.size) == ("u", Decimal("3.50"), 1, None)


def test_rearrange_prefers_the_canonical_name(spark):
    df = spark.createDataFrame([("u", "c")], "user_id STRING, customer_id STRING")
    assert shape.rearrange_columns(df).first().customer_id == "c"


def test_rearrange_by_names_keeps_types(spark):
    df = spark.createDataFrame([(1.5, "u", "x")], "Item_Price DOUBLE, user_id STRING, foo STRING")
    out = shape.rearrange_columns(df, ["date", "user_id", "customer_id", "item_price", "bar"])
    assert [kind for _, kind in out.dtypes] == ["date", "string", "string", "double", "string"]
    assert tuple(out.first()) == (None, "u", "u", 1.5, None)


def test_repeated_names_are_refused(spark):
    df = spark.range(1).select(F.lit(1).alias("size"), F.lit(2).alias("Size"))
    with pytest.raises(ValueError, match="size"):
        shape.rearrange_columns(df)
    with pytest.raises(ValueError, match="size"):
        shape.normalise_names(df)


def test_normalise_and_require(spark):
    df = shape.normalise_names(spark.range(1).toDF(" Restaurant_ID "))
    assert df.columns == ["restaurant_id"]
    with pytest.raises(ValueError, match="customer_id"):
        shape.require_columns(df, ["restaurant_id", "customer_id"])


def test_selections(spark):
    df = spark.createDataFrame([("a", True), ("b", False), (None, None)], "k STRING, f BOOLEAN")
    assert shape.keep_equal(df, "k", "a").count() == 1
    assert shape.keep_equal(df, "k", "All").count() == 3
    assert shape.keep_equal(df, "k", None).count() == 3
    assert shape.keep_any_of(df, "k", ["a", "b"]).count() == 2
    assert shape.keep_any_of(df, "k", None).count() == 3
    assert shape.members_only(df, "f").count() == 1
    assert [r.k for r in shape.choices(df, "k", descending=True).collect()] == ["b", "a"]


def test_top_rows_put_nulls_last(spark):
    df = spark.createDataFrame(
        [("x", 1, "b"), ("x", 1, "a"), ("x", None, "c"), ("y", 5, "d")], "g STRING, v INT, t STRING"
    )
    assert [r.t for r in shape.top_rows(df, "v", 3, "t").collect()] == ["d", "a", "b"]
    best = shape.top_rows(df, "v", 1, "t", per="g")
    assert {(r.g, r.t, r.position) for r in best.collect()} == {("x", "a", 1), ("y", "d", 1)}


# --- dates -----------------------------------------------------------------------


def test_week_of_month_and_names(spark):
    df = spark.createDataFrame([(d,) for d in (6, 7, 28)], "d INT")
    date = F.make_date(F.lit(2024), F.lit(1), F.col("d"))
    assert [r[0] for r in df.select(dates.week_of_month(date)).collect()] == [1, 2, 5]
    months = spark.createDataFrame([(0,), (1,), (12,), (13,), (None,)], "m INT")
    names = [r[0] for r in months.select(dates.month_name(F.col("m"))).collect()]
    assert names == [None, "January", "December", None, None]
    assert dates.month_number("March") == dates.month_number(3) == 3


# --- quantiles -------------------------------------------------------------------


def disc(values, p):
    ordered = sorted(values)
    return ordered[max(math.ceil(Decimal(str(p)) * len(ordered)), 1) - 1]


def cont(values, p):
    ordered = sorted(values)
    position = p * (len(ordered) - 1)
    low, high = ordered[math.floor(position)], ordered[math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


PROBABILITIES = {"lowest": 0.0, "q20": 0.2, "half": 0.5, "q80": 0.8, "top": 1.0}


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-5, 40), min_size=1, max_size=40), min_size=30, max_size=60))
def test_exact_quantiles_of_small_groups(spark, groups):
    data = [(str(g), n) for g, numbers in enumerate(groups) for n in numbers]
    df = spark.createDataFrame(data, "k STRING, v INT")
    found = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBABILITIES).collect()}
    between = exact_quantiles(df, ["k"], "v", PROBABILITIES, interpolate=True)
    between = {r.k: r for r in between.collect()}
    for g, numbers in enumerate(groups):
        for name, p in PROBABILITIES.items():
            assert found[str(g)][name] == disc(numbers, p)
            assert between[str(g)][name] == pytest.approx(cont(numbers, p))


def skewed(spark):
    """Three groups, one with most of the rows and a third of those on one value."""
    rng = random.Random(3)
    data = [("hot", 500 if i % 3 == 0 else int(rng.lognormvariate(6, 2))) for i in range(30_000)]
    data += [("warm", rng.randrange(100)) for _ in range(900)] + [("cold", 4)]
    return data, spark.createDataFrame(data, "k STRING, v INT").repartition(9)


def test_exact_quantiles_of_a_hot_group(spark):
    data, df = skewed(spark)
    for row in exact_quantiles(df, ["k"], "v", PROBABILITIES).collect():
        numbers = [v for k, v in data if k == row.k]
        assert [row[n] for n in PROBABILITIES] == [disc(numbers, p) for p in PROBABILITIES.values()]


def test_exact_quantiles_survive_a_bad_sketch(spark, monkeypatch):
    data, df = skewed(spark)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 2)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    for row in exact_quantiles(df, ["k"], "v", PROBABILITIES).collect():
        numbers = [v for k, v in data if k == row.k]
        assert [row[n] for n in PROBABILITIES] == [disc(numbers, p) for p in PROBABILITIES.values()]


# --- numbering -------------------------------------------------------------------


@pytest.mark.parametrize("distinct", [1, 7, 5000])
def test_row_numbers_are_those_of_a_full_sort(spark, distinct):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 50 != 0, F.abs(F.hash("id")) % distinct).alias("v")
    )
    numbered = number_rows(df.repartition(5), "v", "id").collect()
    ordered = sorted(numbered, key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert [r.rank for r in ordered] == list(range(1, 3001))


# --- chart feeds -----------------------------------------------------------------


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame(
        [(True, 0), (True, 30), (False, 15), (None, 3), (True, None)], "by BOOLEAN, v INT"
    )
    found = charts.histogram(df, "v", "by").select("by", "bin", "count", "bin_start").collect()
    assert sorted(map(tuple, found)) == [(False, 16, 1, 15.0), (True, 1, 1, 0.0), (True, 30, 1, 29.0)]
    bounded = charts.histogram(df, "v", "by", bins=3, bounds=(0, 30))
    assert sorted((r.by, r.bin) for r in bounded.collect()) == [(False, 2), (True, 1), (True, 3)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(True, 5), (True, 5)], "by BOOLEAN, v INT")
    assert charts.histogram(df, "v", "by").first()["bin"] == 1


def test_box_feed_exact_and_sketched(spark):
    df = spark.createDataFrame([(True, v) for v in range(1, 6)] + [(None, 9)], "by BOOLEAN, v INT")
    for exact in (True, False):
        box = charts.box_feed(df, "v", "by", exact=exact).collect()
        assert [(r.minimum, r.q1, r.median, r.q3, r.maximum) for r in box] == [(1, 2, 3, 4, 5)]


def test_stacked_bars(spark):
    df = spark.createDataFrame([(True, 2), (True, 4), (None, 9)], "by BOOLEAN, n BIGINT")
    assert [tuple(r) for r in charts.stacked_bars(df, "n", "by").collect()] == [(True, 6, 3.0)]
