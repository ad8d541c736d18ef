"""Null-safe joins, concatenation, folder-wise overwrite, rebuilt restaurants, sketches."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from dinestat.operators import customers, shape, sketches
from dinestat.plans.batch import build_metrics, rebuild_restaurants
from dinestat.sources.parquet import (
    checkpoint_folder,
    drop_folders,
    read_runs,
    scratch_tables,
    settle,
    write_metric,
)
from dinestat.sources.schema import DATASETS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_sets(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


# --- joins -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("a", 1, 10), (None, 1, 20), ("a", None, 30), (None, None, 40)], "k string, j int, x int")
    right = spark.createDataFrame([("a", 1, 1), (None, 1, 2), (None, None, 4), ("b", 1, 5)], "k string, j int, y int")
    return settle(left), settle(right)


@pytest.mark.parametrize("hint", ["broadcast", "merge", "shuffle_hash"])
def test_null_keys_match_in_every_kind_of_join(sides, hint):
    left, right = sides
    joined = shape.join_on(left, right.hint(hint), ["k", "j"])
    assert joined.columns == ["k", "j", "x", "y"]
    assert sorted((r.x, r.y) for r in joined.collect()) == [(10, 1), (20, 2), (40, 4)]
    kinds = {"broadcast": "BroadcastHashJoin", "merge": "SortMergeJoin", "shuffle_hash": "ShuffledHashJoin"}
    assert kinds[hint] in plan(joined) and "NestedLoop" not in plan(joined)


def test_null_keys_can_be_left_apart(sides):
    left, right = sides
    assert [(r.x, r.y) for r in shape.join_on(left, right, ["k", "j"], nulls_match=False).collect()] == [(10, 1)]


def test_left_join_keeps_rows_without_partner(sides):
    left, right = sides
    found = shape.join_on(left, right, ["k", "j"], "left").collect()
    assert sorted((r.k or "", r.j or 0, r.x, r.y) for r in found) == [
        ("", 0, 40, 4), ("", 1, 20, 2), ("a", 0, 30, None), ("a", 1, 10, 1),
    ]


# --- concatenation ---------------------------------------------------------------


def test_concatenation_widens_and_fills(spark):
    one = spark.sql("SELECT 1Y AS n, 1.25BD AS money, DATE '2024-01-02' AS day, 'x' AS only, null AS void")
    two = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-03 04:00:00' AS DAY, 7000000000L AS N, 12 AS Money, true AS late")
    both = shape.concatenate(one, two)
    assert both.dtypes == [
        ("n", "bigint"), ("money", "decimal(12,2)"), ("day", "timestamp_ntz"), ("only", "string"),
        ("void", "void"), ("late", "boolean"),
    ]
    assert [tuple(r)[:4] for r in both.collect()] == [
        (1, both.first().money, dt.datetime(2024, 1, 2), "x"),
        (7000000000, 12, dt.datetime(2024, 1, 3, 4), None),
    ]


@pytest.mark.parametrize(
    ("one", "two", "common"),
    [("int", "double", "double"), ("float", "smallint", "double"), ("decimal(5,4)", "bigint", "decimal(23,4)"),
     ("decimal(38,0)", "decimal(3,2)", None), ("string", "int", None), ("bigint", "double", None),
     ("date", "string", None), ("boolean", "int", None), ("void", "date", "date")],
)
def test_types_that_meet(spark, one, two, common):
    tables = [spark.sql(f"SELECT CAST(null AS {kind}) AS v") for kind in (one, two)]
    for pair in (tables, tables[::-1]):
        if common is None:
            with pytest.raises(ValueError, match="column v has types that do not go together"):
                shape.concatenate(*pair)
        else:
            assert shape.concatenate(*pair).dtypes == [("v", common)]


def test_nothing_to_concatenate():
    with pytest.raises(ValueError):
        shape.concatenate()


def test_runs_keep_folder_values_as_text(spark, tmp_path):
    df = spark.createDataFrame([("007", dt.date(2024, 1, 1), 5)], "restaurant_id string, date date, year int")
    write_metric(df, str(tmp_path / "a"), "restaurant_id")
    write_metric(df.withColumn("day", F.lit("Monday")), str(tmp_path / "b"), "restaurant_id")
    both = read_runs(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "daily")
    assert {r.restaurant_id for r in both.collect()} == {"007"}
    assert sorted(r.day or "" for r in both.collect()) == ["", "Monday"]
    with pytest.raises(FileNotFoundError):
        read_runs(spark, [str(tmp_path / "a"), str(tmp_path / "c")], "daily")


# --- folders and rebuilt restaurants ------------------------------------------------


def test_only_folders_with_rows_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c d/e", 3), (None, 4)], "k string, v int")
    write_metric(rows, path, "k")
    write_metric(rows.where("k = 'b'").withColumn("v", F.lit(9)), path, "k", only_folders=True)
    read = spark.read.schema("k string, v int").parquet(path)
    assert {r.k: r.v for r in read.collect()} == {"a": 1, "b": 9, "c d/e": 3, None: 4}
    drop_folders(spark, path, "k", ["c d/e", "never"])
    read = spark.read.schema("k string, v int").parquet(path)
    assert {r.k: r.v for r in read.collect()} == {"a": 1, "b": 9, None: 4}


def test_rebuilt_restaurants_equal_a_whole_build(spark, sample, tmp_path):
    items = settle(shape.rearrange_columns(sample))
    as_of = "2001-09-01"
    changed = F.when((F.col("restaurant_id") == "1") & (F.col("date") < "1998-01-01"), "closed")
    before = items.withColumn("restaurant_id", F.coalesce(changed, "restaurant_id"))
    base, fresh = str(tmp_path / "kept"), str(tmp_path / "fresh")
    build_metrics(before, base, as_of, schemes=None, exact_clv=True)
    untouched = {
        p: p.stat().st_mtime_ns for p in (tmp_path / "kept").rglob("*.parquet") if "restaurant_id=3" in str(p)
    }
    found = rebuild_restaurants(items, base, ["1", "closed"], as_of, schemes=None, exact_clv=True)
    wanted = build_metrics(items, fresh, as_of, schemes=None, exact_clv=True)
    assert untouched and all(p.stat().st_mtime_ns == t for p, t in untouched.items())
    for key in DATASETS:
        assert as_sets(found[key]) == as_sets(wanted[key]), key
    again = rebuild_restaurants(items, base, ["1", "closed"], as_of, schemes=None, exact_clv=True)
    assert as_sets(again["locations"]) == as_sets(wanted["locations"])


def settled(spark):
    return {p.name for p in Path(checkpoint_folder(spark)).glob("settled-*")}


def test_settled_tables_go_with_their_scope(spark):
    before = settled(spark)
    with scratch_tables(spark):
        outer = settle(spark.range(3))
        with scratch_tables(spark):
            settle(spark.range(4))
            assert len(settled(spark) - before) == 2
        assert len(settled(spark) - before) == 1 and outer.count() == 3
    assert settled(spark) == before
    with pytest.raises(ZeroDivisionError), scratch_tables(spark):
        settle(spark.range(3))
        1 / 0
    assert settled(spark) == before


def test_a_build_leaves_no_settled_table(spark, make_items, tmp_path):
    before = settled(spark)
    metrics = build_metrics(make_items({}, {"customer_id": "c2"}), str(tmp_path), schemes=None, exact_clv=True)
    assert settled(spark) == before and metrics["clv"].count() == 2


# --- distinct orders ---------------------------------------------------------------


def test_an_order_split_over_days_and_flags_counts_once(make_items):
    items = make_items(
        {"order_id": "x", "is_loyalty": True},
        {"order_id": "x", "is_loyalty": False, "date": dt.date(2024, 1, 2)},
        {"order_id": "y", "is_loyalty": False, "date": dt.date(2024, 1, 2)},
        {"order_id": None, "is_loyalty": False, "date": None},
    )
    (row,) = customers.rfm_with_orders(items).collect()
    assert (row.frequency, row.orders, row.monetary, row.recency) == (4, 2, 40, 0)
    impact = {r.is_loyalty: (r.repeat_orders, r.orders) for r in customers.loyalty_with_orders(items).collect()}
    assert impact == {True: (1, 1), False: (3, 2)}


def test_orders_beside_rows_leave_the_other_columns_as_they_are(sample):
    assert as_sets(customers.rfm_with_orders(sample).drop("orders")) == as_sets(customers.rfm(sample))
    impact = customers.loyalty_with_orders(sample)
    assert as_sets(impact.drop("orders")) == as_sets(customers.loyalty_impact(sample))
    text = plan(customers.rfm_with_orders(sample))
    assert "Expand" not in text and not re.search(r"^\W*Sort ", text, re.M)


# --- sketches ----------------------------------------------------------------------


def test_merged_sketches_are_exact_while_small(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") / 100).cast("decimal(18,2)").alias("v"), (F.col("id") % 7).alias("day"))
    merged = sketches.merge_sketches(sketches.value_sketches(df, "v", "g", "day"), "g")
    found = sketches.sketch_quantiles(merged, sketches.QUARTILES)
    errors = sketches.rank_errors(df, "v", found, ["g"], sketches.QUARTILES)
    assert [(r["rows"], r.q1, r.median, r.q3) for r in errors.collect()] == [(200, 0, 0, 0)] * 2


def test_rank_error_of_sketches_merged_from_many_days(spark):
    df = settle(
        spark.range(200_000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 5)).alias("restaurant_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("date_key"),
            (F.abs(F.hash("id")) % 1_000_000 / 100).cast("decimal(28,2)").alias("total_revenue"),
        )
    )
    stored = settle(sketches.day_sketches(df))
    limits = settle(sketches.thresholds_of_days(stored, "restaurant_id"))
    errors = sketches.rank_errors(df, "total_revenue", limits, ["restaurant_id"], sketches.CLV_LIMITS).collect()
    assert len(errors) == 6 and all(max(r.low_threshold, r.high_threshold) < 0.01 for r in errors)
    some = sketches.thresholds_of_days(stored, "restaurant_id", first="2024-02-01", last="2024-02-29")
    wanted = df.where("date_key BETWEEN '2024-02-01' AND '2024-02-29'").groupBy("restaurant_id").count()
    assert {r.restaurant_id: r["rows"] for r in some.collect()} == {r.restaurant_id: r["count"] for r in wanted.collect()}
    assert "GreaterThanOrEqual(date_key,2024-02-01)" in plan(some)


def test_a_rebuild_writes_the_named_rows_before_its_steps(make_items, tmp_path, monkeypatch):
    """Its six scans then read the rows of the named restaurants, not all items."""
    from dinestat.plans import batch

    items = make_items(*({"restaurant_id": r, "customer_id": c} for r in ("a", "b") for c in ("x", "y")))
    base, as_of, given = str(tmp_path / "m"), "2024-02-01", []
    build_metrics(items, base, as_of, schemes=None)

    def spied(own, *rest):
        given.append((own.inputFiles(), own.count()))
        return build_metrics(own, *rest)

    monkeypatch.setattr(batch, "build_metrics", spied)
    found = rebuild_restaurants(items, base, ["a"], as_of, schemes=None)
    ((files, rows),) = given
    assert files and all("/settled-" in f for f in files) and rows == 2
    assert found["rfm"].count() == 4 and found["profile"].count() == 4
