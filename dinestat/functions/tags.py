"""Labels given to customers: lifetime-value tier, RFM segment, activity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and default thresholds.
HIGH_CLV, MEDIUM_CLV, LOW_CLV = "High CLV", "Medium CLV", "Low CLV"
LOW_QUANTILE, HIGH_QUANTILE = 0.2, 0.8
VIP, NEW_CUSTOMER, CHURN_RISK, OTHER = "VIP", "New Customer", "Churn Risk", "Other"
INACTIVE, ACTIVE, AT_RISK, HEALTHY = "inactive", "active", "at risk", "healthy"
RISK_DAYS = 45


@dataclass(frozen=True)
class SegmentThresholds:
    """Limits of the RFM segments; the defaults are the standard ones."""

    recent_days: int = 180
    vip_frequency: int = 50
    vip_monetary: float = 500
    new_monetary: float = 200
    churn_frequency: int = 5
    churn_monetary: float = 1000


def clv_tag(value: Column, low: Column, high: Column) -> Column:
    """High wins when both thresholds coincide; anything unknown is Medium."""
    return (
        F.when(value >= high, HIGH_CLV)
        .when(value <= low, LOW_CLV)
        .otherwise(MEDIUM_CLV)
    )


def rfm_segment(
    limits: SegmentThresholds = SegmentThresholds(),
    recency: str = "recency",
    frequency: str = "frequency",
    monetary: str = "monetary",
) -> Column:
    """First matching segment of a customer's recency, frequency and spend."""
    r, f, m = F.col(recency), F.col(frequency), F.col(monetary)
    recent = r <= limits.recent_days
    often = f > limits.vip_frequency
    rules = {
        VIP: recent & often & (m > limits.vip_monetary),
        NEW_CUSTOMER: recent & (f <= limits.vip_frequency) & (m > limits.new_monetary),
        CHURN_RISK: (r > limits.recent_days)
        & (f <= limits.churn_frequency)
        & (m <= limits.churn_monetary),
    }
    return F.coalesce(*(F.when(rule, name) for name, rule in rules.items()), F.lit(OTHER))


def over_limit(days: Column, limit: int, above: str, within: str) -> Column:
    """``above`` when days exceed the limit, else ``within`` (also when unknown)."""
    return F.when(days > limit, above).otherwise(within)
