import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dinestat.operators import sales
from dinestat.plans.batch import build_metrics
from dinestat.sources import parquet
from dinestat.sources.parquet import (
    load_metrics,
    output_path,
    read_dataset,
    read_order_items,
    settle,
    write_metric,
)
from dinestat.sources.schema import DATASETS, ORDER_ITEMS


def test_output_path():
    assert output_path("s3a://bucket/metrics///") == "s3a://bucket/metrics/"
    assert output_path(None) is None and output_path("") is None
    assert output_path("file:///x", schemes=("s3a", "file")) == "file:///x/"
    assert output_path("/x", schemes=None) == "/x/"
    for refused in ("/x", "s3://bucket/x", "hdfs://h/x", "s3ax/y"):
        with pytest.raises(ValueError, match="s3a://"):
            output_path(refused)


def test_trends_refuse_a_bad_path_before_any_work(make_items):
    with pytest.raises(ValueError):
        sales.sales_trends(make_items({}), path="/somewhere")


def test_order_items_are_read_in_canonical_form(spark, tmp_path):
    path = str(tmp_path / "items")
    source = spark.createDataFrame(
        [(7, "u1", 2.5, "extra")], "restaurant_id INT, user_id STRING, item_price DOUBLE, foo STRING"
    )
    source.write.parquet(path)
    items = read_order_items(spark, path)
    assert items.schema == ORDER_ITEMS
    row = items.first()
    assert (row.restaurant_id, row.customer_id, row.item_price) == ("7", "u1", Decimal("2.50"))


@pytest.mark.parametrize("make_folder", [False, True])
def test_missing_data_names_the_dataset(spark, tmp_path, make_folder):
    if make_folder:
        (tmp_path / DATASETS["rfm"].folder).mkdir()
    with pytest.raises(FileNotFoundError, match="rfm"):
        read_dataset(spark, str(tmp_path / DATASETS["rfm"].folder), "rfm")
    with pytest.raises(FileNotFoundError, match="order items"):
        read_order_items(spark, str(tmp_path / "nothing"))


def test_all_part_files_are_read(spark, tmp_path):
    path = str(tmp_path / "many")
    write_metric(spark.range(100).repartition(10), path)
    assert len(list((tmp_path / "many").glob("*.parquet"))) == 10
    assert spark.read.parquet(path).count() == 100


def test_folder_values_stay_text(spark, tmp_path, make_items):
    names = ["007", "08", "a b=c", "x/y"]
    items = make_items(*({"restaurant_id": name} for name in names))
    trends = sales.sales_trends(items, path=str(tmp_path), schemes=None)
    for key, trend in zip(trends._fields, trends):
        assert sorted(r.restaurant_id for r in trend.select("restaurant_id").collect()) == names
        read = read_dataset(spark, str(tmp_path / key), key)
        assert read.schema == DATASETS[key].schema
        assert sorted(r.restaurant_id for r in read.collect()) == names
    assert (tmp_path / "daily" / "restaurant_id=007").is_dir()


def test_rewriting_replaces_a_dataset(spark, tmp_path):
    path = str(tmp_path / "m")
    for value in ("a", "b"):
        write_metric(spark.createDataFrame([(value, 1)], "k STRING, v INT"), path, "k")
    assert [r.k for r in spark.read.parquet(path).collect()] == ["b"]


def test_a_large_folder_is_written_by_several_tasks(spark, settings, tmp_path):
    settings({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB"})
    key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 5))
    text = F.sha2(F.col("id").cast("string"), 256)
    df = spark.range(60_000, numPartitions=6).select(key.alias("k"), text.alias("text"))
    write_metric(df, str(tmp_path / "hot"), "k")
    assert len(list((tmp_path / "hot" / "k=hot").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 60_000


def test_settle_writes_below_the_named_folder(spark):
    df = settle(spark.range(10))
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in name for name in df.inputFiles())
    assert df.count() == 10


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://cluster"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        parquet.checkpoint_folder(Session())


def test_the_job_writes_twelve_datasets(spark, make_items, tmp_path):
    items = make_items(
        {"is_loyalty": True, "option_price": -2, "option_quantity": 1},
        {"customer_id": "c2", "is_loyalty": False, "date": dt.date(2024, 3, 1)},
        {"customer_id": "_guest", "restaurant_id": "008"},
    )
    metrics = build_metrics(items, str(tmp_path), schemes=None)
    assert list(metrics) == list(DATASETS)
    for key, df in load_metrics(spark, str(tmp_path), views=True).items():
        assert df.schema == DATASETS[key].schema
        assert df.count() > 0
        assert spark.table(key).columns == df.columns
    rfm = {r.customer_id: r for r in metrics["rfm"].collect()}
    assert (rfm["c1"].recency, rfm["c1"].is_loyalty, rfm["c2"].recency) == (60, True, 0)
    assert {r.restaurant_id for r in metrics["locations"].collect()} == {"r1", "008"}
    assert {r.restaurant_id for r in metrics["profile"].collect()} == {"r1"}


def test_the_job_needs_a_path(make_items):
    with pytest.raises(ValueError):
        build_metrics(make_items({}), "")
