import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dinestat.sources.schema import ORDER_ITEMS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_items(spark):
    """Builds order items from partial rows; the rest are plain defaults."""

    def build(*rows: dict):
        def full(number: int, given: dict) -> tuple:
            row = {
                "restaurant_id": "r1",
                "customer_id": "c1",
                "order_id": f"o{number:04d}",
                "lineitem_id": f"l{number:04d}",
                "date": dt.date(2024, 1, 1),
                "item_price": 10,
                "item_quantity": 1,
                "time": "12:30:00",
                "day_of_weeks": "Monday",
            } | given
            row.setdefault("date_key", row["date"])
            for price in ("item_price", "option_price"):
                if row.get(price) is not None:
                    row[price] = Decimal(str(row[price]))
            return tuple(row.get(name) for name in ORDER_ITEMS.names)

        return spark.createDataFrame([full(i, r) for i, r in enumerate(rows)], ORDER_ITEMS)

    return build


@pytest.fixture(scope="session")
def sample(spark):
    """Order items derived from the smallest given tables."""
    from dinestat.sources.parquet import settle
    from dinestat.sources.star import order_items

    return settle(order_items(spark, "/root/testdata/sf0.001"))


@pytest.fixture
def settings(spark):
    """Sets session options for one test and puts the former ones back."""
    changed = {}

    def change(options: dict):
        for key, value in options.items():
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
