"""Order items derived from an order, line item, customer, part, supplier schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How each order-items column follows from the star tables.
COLUMNS = {
    "restaurant_id": "n_regionkey",
    "location_id": "s_nationkey",
    "customer_id": """CASE WHEN o_custkey % 20 = 0 THEN '_guest'
        WHEN o_custkey % 97 <> 0 THEN concat('C', o_custkey) END""",
    "order_id": "l_orderkey",
    "lineitem_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
    "is_loyalty": "CASE WHEN o_custkey % 89 <> 0 THEN c_mktsegment IN ('BUILDING', 'MACHINERY') END",
    "item_category": "CASE WHEN p_partkey % 50 <> 0 THEN p_type END",
    "item_name": "p_name",
    "item_price": "CAST(l_extendedprice AS DECIMAL(12,2))",
    "item_quantity": "CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 4 AS INT) END",
    "option_price": """CASE WHEN percent = 0 THEN CAST(NULL AS DECIMAL(12,2))
        WHEN percent >= 8 THEN CAST(-percent AS DECIMAL(12,2))
        ELSE CAST(percent AS DECIMAL(12,2)) END""",
    "option_quantity": "CASE WHEN l_linenumber <> 6 THEN CAST(1 + l_suppkey % 2 AS INT) END",
    "date": "CAST(o_orderdate AS DATE)",
    "date_key": "CAST(o_orderdate AS DATE)",
    "time": """concat(lpad(CAST(l_orderkey % 24 AS STRING), 2, '0'), ':',
        lpad(CAST(l_orderkey % 60 AS STRING), 2, '0'), ':00')""",
    "day_of_weeks": "date_format(CAST(o_orderdate AS DATE), 'EEEE')",
    "month_name": "date_format(CAST(o_orderdate AS DATE), 'MMMM')",
}


# The star tables' columns in use. Stated, so that no job reads footers.
TABLES = {
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_extendedprice DOUBLE, l_discount DOUBLE""",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_type STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "nation": "n_nationkey INT, n_regionkey INT",
}


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item, with guests, nulls, free items and discounts among them.

    Orders meet their customers before the line items do, as there are fewer of them.
    Orders and line items both grow with the data and join by sorted shuffle; whether
    the other tables are broadcast is left to their size. Where they are not, each join
    shuffles the line items, so those with the fewest columns to give come first. Orders
    come last: the lines of an order then lie together in what is written, which takes
    less room, and tasks add them up before they shuffle.
    """
    lines, orders, customers, parts, suppliers, nations = (
        spark.read.schema(columns).parquet(f"{folder}/{name}.parquet")
        for name, columns in TABLES.items()
    )
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    located = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    joined = (
        lines.withColumn("percent", F.round(F.col("l_discount") * 100).cast("int"))
        .join(located, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    return joined.selectExpr(*(f"{expression} AS {name}" for name, expression in COLUMNS.items()))
