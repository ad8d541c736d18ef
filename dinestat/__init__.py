"""Restaurant and customer analytics over an order-items table, on Spark."""

from dinestat.functions.tags import SegmentThresholds
from dinestat.operators.activity import append_activity, stored_profile
from dinestat.operators.customers import (
    average_gap,
    clv_thresholds,
    customer_activity_profile,
    loyalty_impact,
    loyalty_summary,
    loyalty_with_orders,
    revenue_per_order,
    rfm,
    rfm_with_orders,
    segment_customers,
    tag_clv,
)
from dinestat.operators.locations import (
    location_activity,
    location_states,
    merge_location_states,
    top_locations,
)
from dinestat.operators.sales import (
    SalesTrends,
    discount_effectiveness,
    sales_levels,
    sales_trends,
)
from dinestat.operators.shape import concatenate, join_on, normalise_names, rearrange_columns
from dinestat.operators.sketches import day_sketches, thresholds_of_days
from dinestat.plans.batch import build_metrics, rebuild_restaurants
from dinestat.plans.views import (
    churn_view,
    discount_view,
    location_view,
    loyalty_view,
    sales_trend_view,
    segmentation_view,
)
from dinestat.sources.parquet import load_metrics, read_order_items, read_runs, scratch_tables
from dinestat.sources.schema import ORDER_ITEMS

__all__ = [
    "ORDER_ITEMS",
    "SalesTrends",
    "SegmentThresholds",
    "append_activity",
    "average_gap",
    "build_metrics",
    "churn_view",
    "clv_thresholds",
    "concatenate",
    "customer_activity_profile",
    "day_sketches",
    "discount_effectiveness",
    "discount_view",
    "join_on",
    "load_metrics",
    "location_activity",
    "location_states",
    "location_view",
    "loyalty_impact",
    "loyalty_summary",
    "loyalty_view",
    "loyalty_with_orders",
    "merge_location_states",
    "normalise_names",
    "read_order_items",
    "read_runs",
    "rearrange_columns",
    "rebuild_restaurants",
    "revenue_per_order",
    "rfm",
    "rfm_with_orders",
    "sales_levels",
    "sales_trend_view",
    "sales_trends",
    "scratch_tables",
    "segment_customers",
    "segmentation_view",
    "stored_profile",
    "tag_clv",
    "thresholds_of_days",
    "top_locations",
]
