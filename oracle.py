"""SQL giving the same results as the registered queries, for an independent engine.

Written from the metrics' definitions, not from the Spark code: where Spark adds up in
steps, merges sketches or closes a form, the SQL uses the plain window or aggregate.
"""

from __future__ import annotations

_ITEMS = """
WITH base AS (
SELECT n.n_regionkey AS restaurant_id,
       s.s_nationkey AS location_id,
       CASE WHEN o.o_custkey % 20 = 0 THEN '_guest'
            WHEN o.o_custkey % 97 = 0 THEN CAST(NULL AS VARCHAR)
            ELSE concat('C', CAST(o.o_custkey AS VARCHAR)) END AS customer_id,
       l.l_orderkey AS order_id,
       concat(CAST(l.l_orderkey AS VARCHAR), '-', CAST(l.l_linenumber AS VARCHAR), '-',
              CAST(l.l_partkey AS VARCHAR), '-', CAST(l.l_suppkey AS VARCHAR)) AS lineitem_id,
       CASE WHEN o.o_custkey % 89 = 0 THEN CAST(NULL AS BOOLEAN)
            ELSE c.c_mktsegment IN ('BUILDING', 'MACHINERY') END AS is_loyalty,
       CASE WHEN p.p_partkey % 50 = 0 THEN CAST(NULL AS VARCHAR) ELSE p.p_type END AS item_category,
       p.p_name AS item_name,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) AS item_price,
       CASE WHEN l.l_linenumber = 7 THEN CAST(NULL AS INT)
            ELSE CAST(l.l_partkey % 4 AS INT) END AS item_quantity,
       CASE WHEN CAST(round(l.l_discount * 100) AS INT) = 0 THEN CAST(NULL AS DECIMAL(12,2))
            WHEN CAST(round(l.l_discount * 100) AS INT) >= 8
            THEN CAST(-round(l.l_discount * 100) AS DECIMAL(12,2))
            ELSE CAST(round(l.l_discount * 100) AS DECIMAL(12,2)) END AS option_price,
       CASE WHEN l.l_linenumber = 6 THEN CAST(NULL AS INT)
            ELSE CAST(1 + l.l_suppkey % 2 AS INT) END AS option_quantity,
       CAST(o.o_orderdate AS DATE) AS date,
       CAST(o.o_orderdate AS DATE) AS date_key,
       concat(lpad(CAST(l.l_orderkey % 24 AS VARCHAR), 2, '0'), ':',
              lpad(CAST(l.l_orderkey % 60 AS VARCHAR), 2, '0'), ':00') AS time
FROM lineitem l
JOIN orders o   ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey  = c.c_custkey
JOIN supplier s ON l.l_suppkey  = s.s_suppkey
JOIN nation n   ON s.s_nationkey = n.n_nationkey
JOIN part p     ON l.l_partkey  = p.p_partkey),
items AS (
SELECT *, dayname(date) AS day_of_weeks, monthname(date) AS month_name,
       coalesce(option_price, 0) * coalesce(option_quantity, 0)
       + coalesce(item_price, 0) * coalesce(item_quantity, 1) AS revenue_per_order,
       coalesce(option_price, 0) * coalesce(option_quantity, 0)
       + coalesce(item_price, 0) * coalesce(item_quantity, 0) AS revenue
FROM base),
known AS (SELECT * FROM items WHERE customer_id <> '_guest')"""

_REVENUE = """,
day_revenue AS (
SELECT restaurant_id, customer_id, date_key, is_loyalty,
       sum(revenue_per_order) AS total_revenue, count(order_id) AS total_orders,
       max(date) AS max_date,
       CAST(sum(revenue_per_order) AS DOUBLE) / count(*) AS avg_revenue_per_order,
       min(revenue_per_order) AS min_revenue_per_order
FROM known GROUP BY restaurant_id, customer_id, date_key, is_loyalty)"""

_REVENUE_OUT = """CAST(restaurant_id AS BIGINT) AS restaurant_id, customer_id, date_key, is_loyalty,
       CAST(total_revenue AS DOUBLE) AS total_revenue, total_orders, max_date,
       avg_revenue_per_order, CAST(min_revenue_per_order AS DOUBLE) AS min_revenue_per_order"""

_CLV = (
    _REVENUE
    + """,
limits AS (
SELECT restaurant_id, quantile_disc(total_revenue, 0.2) AS low, quantile_disc(total_revenue, 0.8) AS high
FROM day_revenue GROUP BY restaurant_id),
clv AS (
SELECT r.*, CASE WHEN total_revenue >= high THEN 'High CLV'
                 WHEN total_revenue <= low THEN 'Low CLV' ELSE 'Medium CLV' END AS clv_tag
FROM day_revenue r LEFT JOIN limits l ON r.restaurant_id = l.restaurant_id)"""
)

_RFM = """,
scores AS (
SELECT restaurant_id, customer_id,
       date_diff('day', max(date), (SELECT max(date) FROM known)) AS recency,
       count(*) AS frequency, sum(revenue_per_order) AS monetary,
       first(is_loyalty ORDER BY date, order_id, lineitem_id)
           FILTER (WHERE is_loyalty IS NOT NULL) AS is_loyalty
FROM known GROUP BY restaurant_id, customer_id)"""

_RFM_OUT = """CAST(restaurant_id AS BIGINT) AS restaurant_id, customer_id, CAST(recency AS BIGINT) AS recency,
       frequency, CAST(monetary AS DOUBLE) AS monetary, is_loyalty"""


def _segmented(vip_f: int, vip_m: int, new_m: int, churn_m: int) -> str:
    return (
        _RFM
        + f""",
rfm AS (
SELECT *, CASE WHEN recency <= 180 AND frequency > {vip_f} AND monetary > {vip_m} THEN 'VIP'
               WHEN recency <= 180 AND frequency <= {vip_f} AND monetary > {new_m} THEN 'New Customer'
               WHEN recency > 180 AND frequency <= 5 AND monetary <= {churn_m} THEN 'Churn Risk'
               ELSE 'Other' END AS segment
FROM scores)"""
    )


_TUNED = _segmented(10, 500_000, 200_000, 200_000)

_PROFILE = """,
ordered AS (
SELECT restaurant_id, customer_id, date, revenue_per_order,
       lag(date) OVER w AS previous_date, lag(revenue_per_order) OVER w AS previous_revenue
FROM known
WINDOW w AS (PARTITION BY restaurant_id, customer_id
             ORDER BY date NULLS FIRST, order_id NULLS FIRST, lineitem_id NULLS FIRST, revenue_per_order)),
gaps AS (
SELECT restaurant_id, customer_id, max(date) AS last_order_date,
       avg(date_diff('day', previous_date, date)) AS avg_gap_days,
       avg(CASE WHEN previous_revenue <> 0
           THEN CAST(revenue_per_order - previous_revenue AS DOUBLE)
                / CAST(previous_revenue AS DOUBLE) END) AS avg_pct_change,
       date_diff('day', max(date), (SELECT max(date) FROM known)) AS days_since_last_order
FROM ordered GROUP BY restaurant_id, customer_id),
profile AS (
SELECT *, CASE WHEN days_since_last_order > 45 THEN 'inactive' ELSE 'active' END AS recency_tag,
       CASE WHEN avg_gap_days > 45 THEN 'at risk' ELSE 'healthy' END AS gap_tag,
       CASE WHEN days_since_last_order > 45 OR coalesce(avg_gap_days > 45, FALSE)
            THEN 'at risk' ELSE 'active' END AS activity_tag
FROM gaps)"""

_PROFILE_OUT = """last_order_date, avg_gap_days, round(avg_pct_change, 6) AS avg_pct_change,
       CAST(days_since_last_order AS BIGINT) AS days_since_last_order"""

_IMPACT = """,
impact AS (
SELECT restaurant_id, is_loyalty, customer_id,
       CAST(sum(revenue_per_order) AS DOUBLE) / count(*) AS average_spend,
       count(customer_id) AS repeat_orders, sum(revenue_per_order) AS lifetime_value
FROM known GROUP BY restaurant_id, is_loyalty, customer_id)"""

_IMPACT_OUT = """CAST(restaurant_id AS BIGINT) AS restaurant_id, is_loyalty, customer_id,
       average_spend, repeat_orders, CAST(lifetime_value AS DOUBLE) AS lifetime_value"""


def _locations(column: str) -> str:
    return f""",
totals AS (
SELECT {column}, sum(revenue_per_order) AS total_revenue,
       CAST(sum(revenue_per_order) AS DOUBLE) / count(*) AS average_order_value,
       CAST(count(DISTINCT order_id) AS DOUBLE) / count(DISTINCT date) AS orders_per_day
FROM items GROUP BY {column}),
ranked AS (
SELECT CAST({column} AS BIGINT) AS {column}, CAST(total_revenue AS DOUBLE) AS total_revenue,
       average_order_value, orders_per_day,
       row_number() OVER (ORDER BY total_revenue DESC, {column}) AS rank
FROM totals)"""


_DISCOUNTS = """,
discounts AS (
SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id,
       coalesce(option_price < 0, FALSE) AS is_discounted,
       CAST(sum(revenue_per_order) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders,
       CAST(sum(revenue_per_order) AS DOUBLE) / count(*) AS avg_order_value
FROM items GROUP BY 1, 2)"""


_R = "CAST(restaurant_id AS BIGINT) AS restaurant_id, item_category"
_SALES = """,
daily AS (
SELECT year(date) AS year, day_of_weeks AS day, date, restaurant_id, item_category,
       CAST(sum(revenue) AS DOUBLE) AS revenue, 'daily' AS granularity
FROM items GROUP BY 1, 2, 3, 4, 5),
weekly AS (
SELECT year(date) AS year, week(date) AS week, restaurant_id, item_category,
       CAST(sum(revenue) AS DOUBLE) AS revenue,
       make_date(year(date), 1, 1) + CAST((week(date) - 1) * 7 AS INT) AS date,
       'weekly' AS granularity
FROM items GROUP BY 1, 2, 3, 4, 6),
monthly AS (
SELECT year(date) AS year, monthname(date) AS month, restaurant_id, item_category,
       CAST(sum(revenue) AS DOUBLE) AS revenue, month(date) AS month_num,
       make_date(year(date), month(date), 1) AS date, 'monthly' AS granularity
FROM items GROUP BY 1, 2, 3, 4, 6, 7),
hourly AS (
SELECT year(date) AS year, CAST(time[1:2] AS BIGINT) AS hour, day_of_weeks AS day, date,
       restaurant_id, item_category, CAST(sum(revenue) AS DOUBLE) AS revenue,
       'hourly' AS granularity
FROM items GROUP BY 1, 2, 3, 4, 5, 6)"""

_DAILY_OUT = f"CAST(year AS BIGINT) AS year, day, date, {_R}, revenue, granularity"
_WEEKLY_OUT = f"""CAST(year AS BIGINT) AS year, CAST(week AS BIGINT) AS week, {_R}, revenue,
       CAST(date AS DATE) AS date, granularity"""
_MONTHLY_OUT = f"""CAST(year AS BIGINT) AS year, month, {_R}, revenue,
       CAST(month_num AS BIGINT) AS month_num, date, granularity"""
_HOURLY_OUT = f"CAST(year AS BIGINT) AS year, hour, day, date, {_R}, revenue, granularity"
_PARTS = """CAST(month(date) AS BIGINT) AS month, monthname(date) AS month_name,
       CAST(day(date) // 7 + 1 AS BIGINT) AS week_of_month"""

_VIEW = _CLV + _TUNED + """,
tagged AS (
SELECT r.*, c.clv_tag FROM rfm r
JOIN clv c ON r.restaurant_id = c.restaurant_id AND r.customer_id = c.customer_id)"""


def _means(condition: str) -> str:
    parts = [
        f"""SELECT is_loyalty, '{m}' AS metric, CAST(sum({m}) AS DOUBLE) / count(*) AS average
FROM tagged WHERE is_loyalty IS NOT NULL AND {condition} GROUP BY is_loyalty"""
        for m in ("recency", "frequency", "monetary")
    ]
    return "\nUNION ALL\n".join(parts)


def _histogram(column: str) -> str:
    return f""",
points AS (
SELECT is_loyalty, CAST({column} AS DOUBLE) AS x FROM tagged WHERE is_loyalty IS NOT NULL),
ends AS (SELECT min(x) AS low, max(x) AS high FROM points),
binned AS (
SELECT is_loyalty, low, high,
       least(CAST(floor(30.0::DOUBLE * (x - low) / (high - low)) AS BIGINT) + 1, 30) AS bin
FROM points, ends)
SELECT is_loyalty, CAST(bin AS BIGINT) AS bin, count(*) AS count,
       low + (high - low) * (bin - 1) / 30 AS bin_start
FROM binned GROUP BY is_loyalty, bin, low, high"""


_CHURN = _TUNED + _PROFILE + """,
churn AS (
SELECT r.*, p.last_order_date, p.avg_gap_days, p.avg_pct_change, p.days_since_last_order,
       p.recency_tag, p.gap_tag, p.activity_tag
FROM rfm r JOIN profile p ON r.restaurant_id = p.restaurant_id AND r.customer_id = p.customer_id)"""

_CHURN_OUT = f"""CAST(restaurant_id AS VARCHAR) AS restaurant_id, customer_id, segment,
       CAST(recency AS BIGINT) AS recency, frequency, CAST(monetary AS DOUBLE) AS monetary,
       {_PROFILE_OUT}, activity_tag, is_loyalty"""


def _churn_rows(inactive_days: int, condition: str = "TRUE") -> str:
    return f"""SELECT {_CHURN_OUT}, recency_tag, gap_tag,
       last_order_date < DATE '1998-01-01' - {inactive_days} AS alert
FROM churn WHERE {condition}"""


def _written(key: str, source: str, money: str = "NULL") -> str:
    return f"SELECT '{key}' AS dataset, count(*) AS rows, CAST({money} AS DOUBLE) AS money FROM {source}"


_ROUNDTRIP = "\nUNION ALL\n".join(
    [
        _written("revenue", "day_revenue", "sum(total_revenue)"),
        _written("clv", "clv", "sum(total_revenue)"),
        _written("rfm", "rfm", "sum(monetary)"),
        _written("profile", "profile"),
        *(
            _written(key, key, "(SELECT sum(revenue) FROM items)")
            for key in ("daily", "weekly", "monthly", "hourly")
        ),
        _written("loyalty", "impact", "sum(lifetime_value)"),
        _written("loyalty_summary", "(SELECT DISTINCT restaurant_id, is_loyalty FROM impact)"),
        _written("locations", "ranked", "(SELECT sum(revenue_per_order) FROM items)"),
        _written("discounts", "discounts", "(SELECT sum(revenue_per_order) FROM items)"),
    ]
)


def _sql(*parts: str) -> str:
    return "".join((_ITEMS, *parts[:-1])) + "\n" + parts[-1]


_RFM_SQL = _sql(_RFM, f"SELECT {_RFM_OUT} FROM scores")
_LOYALTY_SQL = _sql(_IMPACT, f"SELECT {_IMPACT_OUT} FROM impact")
_WEEKLY_SQL = _sql(_SALES, f"SELECT {_WEEKLY_OUT} FROM weekly")
_MONTHLY_SQL = _sql(_SALES, f"SELECT {_MONTHLY_OUT} FROM monthly")

_METRICS = _sql(
    _CLV, _segmented(50, 500, 200, 1000), _PROFILE, _SALES, _IMPACT,
    _locations("restaurant_id"), _DISCOUNTS, _ROUNDTRIP,
)
_SUMMARY = _sql(
    _IMPACT,
    """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, is_loyalty,
   round(avg(average_spend), 4) AS avg_spend_per_customer,
   CAST(sum(repeat_orders) AS DOUBLE) / count(*) AS avg_repeat_orders,
   CAST(sum(lifetime_value) AS DOUBLE) / count(*) AS avg_lifetime_value
FROM impact GROUP BY 1, 2""",
)
_BOX = _sql(
    _IMPACT,
    """SELECT is_loyalty, CAST(min(lifetime_value) AS DOUBLE) AS minimum,
   CAST(max(lifetime_value) AS DOUBLE) AS maximum,
   round(quantile_cont(CAST(lifetime_value AS DOUBLE), 0.25), 4) AS q1,
   round(quantile_cont(CAST(lifetime_value AS DOUBLE), 0.5), 4) AS median,
   round(quantile_cont(CAST(lifetime_value AS DOUBLE), 0.75), 4) AS q3
FROM impact WHERE is_loyalty IS NOT NULL GROUP BY is_loyalty""",
)
_BARS = _sql(
    _IMPACT,
    """SELECT is_loyalty, CAST(sum(repeat_orders) AS BIGINT) AS total_repeat_orders,
   avg(repeat_orders) AS mean_repeat_orders
FROM impact WHERE is_loyalty IS NOT NULL GROUP BY is_loyalty""",
)
_REARRANGED = _sql(
    """SELECT CAST(NULL AS VARCHAR) AS order_key, date_key, CAST(NULL AS VARCHAR) AS app_name,
   CAST(restaurant_id AS VARCHAR) AS restaurant_id, customer_id,
   CAST(order_id AS VARCHAR) AS order_id, lineitem_id, is_loyalty, item_category, item_name,
   CAST(NULL AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS option_group_name,
   CAST(NULL AS VARCHAR) AS option_name, CAST(option_price AS DOUBLE) AS option_price,
   CAST(option_quantity AS BIGINT) AS option_quantity, CAST(item_price AS DOUBLE) AS item_price,
   CAST(item_quantity AS BIGINT) AS item_quantity, time, date, month_name, day_of_weeks,
   CAST(NULL AS BOOLEAN) AS is_weekends, CAST(NULL AS BOOLEAN) AS is_holidays,
   CAST(NULL AS VARCHAR) AS holiday_name
FROM items"""
)


def _levels(weekly: str) -> str:
    """All granularities as one table; ``weekly`` gives the year, week and date of a week."""
    place = "CAST(restaurant_id AS BIGINT) AS restaurant_id, item_category"
    money = "CAST(sum(revenue) AS DOUBLE) AS revenue"
    none = "CAST(NULL AS {}) AS {}".format
    return f"""SELECT 'daily' AS granularity, CAST(year(date) AS BIGINT) AS year, {none("BIGINT", "week")},
       {none("VARCHAR", "month")}, {none("BIGINT", "month_num")}, date, day_of_weeks AS day,
       {none("BIGINT", "hour")}, {place}, {money}
FROM items GROUP BY ALL
UNION ALL
SELECT 'hourly', year(date), NULL, NULL, NULL, date, day_of_weeks, CAST(time[1:2] AS BIGINT), {place}, {money}
FROM items GROUP BY ALL
UNION ALL
SELECT 'weekly', {weekly}, NULL, NULL, {place}, {money}
FROM items GROUP BY ALL
UNION ALL
SELECT 'monthly', year(date), NULL, monthname(date), month(date),
       make_date(year(date), month(date), 1) AS date, NULL, NULL, {place}, {money}
FROM items GROUP BY ALL"""


ORACLE = {
    "rearranged_items": _REARRANGED,
    "items_read_back": _REARRANGED,
    "line_revenues": _sql(
        """SELECT lineitem_id, CAST(revenue_per_order AS DOUBLE) AS revenue_per_order,
       CAST(revenue AS DOUBLE) AS revenue, coalesce(option_price < 0, FALSE) AS is_discounted
FROM items"""
    ),
    "revenue_per_order": _sql(_REVENUE, f"SELECT {_REVENUE_OUT} FROM day_revenue"),
    "clv_thresholds_exact": _sql(
        _CLV,
        """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id,
       CAST(low AS DOUBLE) AS low_threshold, CAST(high AS DOUBLE) AS high_threshold FROM limits""",
    ),
    "clv_tagged_exact": _sql(_CLV, f"SELECT {_REVENUE_OUT}, clv_tag FROM clv"),
    "top10_clv_per_restaurant": _sql(
        _CLV,
        f"""SELECT * FROM (
SELECT {_REVENUE_OUT}, clv_tag,
       row_number() OVER (PARTITION BY restaurant_id ORDER BY clv.total_revenue DESC,
           customer_id, date_key, is_loyalty NULLS LAST) AS position
FROM clv) WHERE position <= 10""",
    ),
    "rfm": _RFM_SQL,
    "rfm_from_days": _RFM_SQL,
    "rfm_segmented": _sql(
        _segmented(50, 500, 200, 1000), f"SELECT {_RFM_OUT}, segment FROM rfm"
    ),
    "rfm_segmented_tuned": _sql(_TUNED, f"SELECT {_RFM_OUT}, segment FROM rfm"),
    "customer_profile": _sql(
        _PROFILE,
        f"""SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, customer_id, {_PROFILE_OUT},
       recency_tag, gap_tag, activity_tag FROM profile""",
    ),
    "profile_appended": _sql(
        _PROFILE,
        f"""SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, customer_id, {_PROFILE_OUT},
       recency_tag, gap_tag, activity_tag FROM profile""",
    ),
    "clv_thresholds_by_year": _sql(
        _REVENUE,
        """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, year(date_key) AS year, count(*) AS rows,
       TRUE AS low_threshold_within_a_hundredth, TRUE AS high_threshold_within_a_hundredth
FROM day_revenue GROUP BY 1, 2""",
    ),
    "rfm_orders": _sql(
        _RFM,
        f"""SELECT {_RFM_OUT}, (SELECT count(DISTINCT order_id) FROM known k
       WHERE k.restaurant_id = scores.restaurant_id AND k.customer_id = scores.customer_id) AS orders
FROM scores""",
    ),
    "loyalty_orders": _sql(
        """SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, is_loyalty, customer_id,
       CAST(sum(revenue_per_order) AS DOUBLE) / count(*) AS average_spend, count(customer_id) AS repeat_orders,
       CAST(sum(revenue_per_order) AS DOUBLE) AS lifetime_value, count(DISTINCT order_id) AS orders
FROM known GROUP BY 1, 2, 3"""
    ),
    "avg_gap_closed_form": _sql(
        _PROFILE,
        "SELECT CAST(restaurant_id AS BIGINT) AS restaurant_id, customer_id, avg_gap_days FROM gaps",
    ),
    "loyalty_impact": _LOYALTY_SQL,
    "loyalty_from_days": _LOYALTY_SQL,
    "loyalty_summary": _SUMMARY,
    "loyalty_page_summary": _SUMMARY,
    "sales_daily": _sql(_SALES, f"SELECT {_DAILY_OUT} FROM daily"),
    "sales_weekly": _WEEKLY_SQL,
    "sales_weekly_from_hourly": _WEEKLY_SQL,
    "sales_weekly_iso": _sql(
        f"""SELECT CAST(isoyear(date) AS BIGINT) AS year, CAST(week(date) AS BIGINT) AS week,
       CAST(date_trunc('week', date) AS DATE) AS date, {_R},
       CAST(sum(revenue) AS DOUBLE) AS revenue, 'weekly' AS granularity
FROM items GROUP BY ALL"""
    ),
    "sales_monthly": _MONTHLY_SQL,
    "sales_monthly_from_hourly": _MONTHLY_SQL,
    "sales_hourly": _sql(_SALES, f"SELECT {_HOURLY_OUT} FROM hourly"),
    "sales_levels": _sql(
        _levels(
            """year(date), week(date), NULL, NULL,
       CAST(make_date(year(date), 1, 1) + CAST((week(date) - 1) * 7 AS INT) AS DATE)"""
        )
    ),
    "sales_levels_iso": _sql(
        _levels("isoyear(date), week(date), NULL, NULL, CAST(date_trunc('week', date) AS DATE)")
    ),
    "location_activity_merged": _sql(
        """SELECT CAST(location_id AS BIGINT) AS location_id,
       CAST(sum(revenue_per_order) AS DOUBLE) AS total_revenue, count(revenue_per_order) AS priced_lines,
       count(DISTINCT date) AS active_days
FROM items GROUP BY 1"""
    ),
    "top_locations": _sql(_locations("restaurant_id"), "SELECT * FROM ranked"),
    "top_locations_by_nation": _sql(_locations("location_id"), "SELECT * FROM ranked"),
    "discount_effectiveness": _sql(_DISCOUNTS, "SELECT * FROM discounts"),
    "restaurant_choices": _sql(
        "SELECT DISTINCT CAST(restaurant_id AS BIGINT) AS restaurant_id FROM items"
    ),
    "rfm_by_clv": _sql(_VIEW, f"SELECT {_RFM_OUT}, segment, clv_tag FROM tagged"),
    "clv_top10": _sql(
        _CLV,
        f"""SELECT {_REVENUE_OUT}, clv_tag FROM clv
ORDER BY clv.total_revenue DESC, clv.restaurant_id, customer_id, date_key, is_loyalty NULLS LAST
LIMIT 10""",
    ),
    "clv_tag_choices": _sql(_VIEW, "SELECT DISTINCT clv_tag FROM tagged"),
    "rfm_means_by_loyalty": _sql(_VIEW, _means("TRUE")),
    "high_clv_rfm_means": _sql(_VIEW, _means("clv_tag = 'High CLV'")),
    "rfm_table": _sql(_TUNED, f"SELECT {_RFM_OUT}, segment FROM rfm"),
    "recency_histogram": _sql(_VIEW, _histogram("recency")),
    "monetary_histogram": _sql(_VIEW, _histogram("monetary")),
    "churn_customers": _sql(_CHURN, _churn_rows(45)),
    "churn_profile": _sql(_CHURN, f"SELECT {_CHURN_OUT} FROM churn"),
    "churn_selected": _sql(
        _CHURN,
        _churn_rows(
            90, "segment IN ('VIP', 'Churn Risk') AND activity_tag = 'at risk' AND is_loyalty"
        ),
    ),
    "churn_unknown_restaurants": _sql(
        _CHURN.replace(
            "p.restaurant_id AND r.customer_id = p.customer_id",
            "p.restaurant_id AND r.customer_id IS NOT DISTINCT FROM p.customer_id",
        ).replace("r.restaurant_id = p", "r.restaurant_id IS NOT DISTINCT FROM p"),
        f"SELECT {_CHURN_OUT} FROM churn",
    ).replace(
        "SELECT n.n_regionkey AS restaurant_id",
        "SELECT CASE WHEN n.n_regionkey <> 2 THEN n.n_regionkey END AS restaurant_id",
    ),
    "churn_restaurant": _sql(_CHURN, f"SELECT {_CHURN_OUT} FROM churn WHERE restaurant_id = 1"),
    "segment_distribution": _sql(
        _CHURN,
        "SELECT segment, activity_tag, count(*) AS count FROM churn GROUP BY segment, activity_tag",
    ),
    "revenue_by_last_order": _sql(
        _CHURN,
        "SELECT last_order_date, CAST(monetary AS DOUBLE) AS monetary, activity_tag FROM churn",
    ),
    "daily_trend_feed": _sql(_SALES, f"SELECT {_DAILY_OUT}, {_PARTS} FROM daily"),
    "weekly_trend_feed": _sql(_SALES, f"SELECT {_WEEKLY_OUT}, {_PARTS} FROM weekly"),
    "monthly_trend_feed": _sql(
        _SALES,
        f"""SELECT CAST(year AS BIGINT) AS year, {_R}, revenue,
       CAST(month_num AS BIGINT) AS month_num, date, granularity, {_PARTS} FROM monthly""",
    ),
    "sales_drilldown": _sql(
        _SALES,
        f"""SELECT {_DAILY_OUT}, {_PARTS} FROM daily
WHERE year(date) = 1995 AND month(date) = 3 AND day(date) // 7 + 1 = 2""",
    ),
    "hourly_trend_feed": _sql(_SALES, f"SELECT {_HOURLY_OUT}, {_PARTS} FROM hourly"),
    "weekly_drilldown": _sql(
        _SALES,
        f"""SELECT {_WEEKLY_OUT}, {_PARTS} FROM weekly
WHERE weekly.year = 1995 AND month(weekly.date) = 3""",
    ),
    "daily_drilldown_restaurant": _sql(
        _SALES,
        f"""SELECT {_DAILY_OUT}, {_PARTS} FROM daily
WHERE restaurant_id = 1 AND date >= DATE '1995-03-07' AND date < DATE '1995-03-14'""".replace(
            "CAST(restaurant_id AS BIGINT)", "CAST(restaurant_id AS VARCHAR)"
        ),
    ),
    "hourly_drilldown_restaurant": _sql(
        _SALES,
        f"""SELECT {_HOURLY_OUT}, {_PARTS} FROM hourly
WHERE restaurant_id = 3 AND year(date) = 1996""".replace(
            "CAST(restaurant_id AS BIGINT)", "CAST(restaurant_id AS VARCHAR)"
        ),
    ),
    "trend_years": _sql("SELECT DISTINCT CAST(year(date) AS BIGINT) AS year FROM items"),
    "trend_months": _sql(
        """SELECT DISTINCT CAST(month(date) AS BIGINT) AS month, monthname(date) AS month_name
FROM items"""
    ),
    "loyalty_box": _BOX,
    "loyalty_page_box": _BOX,
    "repeat_orders_bar": _BARS,
    "loyalty_page_bars": _BARS,
    "location_top10": _sql(
        _locations("location_id"),
        "SELECT * FROM ranked ORDER BY total_revenue DESC, location_id LIMIT 10",
    ),
    "location_bars": _sql(
        _locations("restaurant_id"), "SELECT restaurant_id, total_revenue FROM ranked"
    ),
    "discount_table": _sql(
        _DISCOUNTS, "SELECT * FROM discounts ORDER BY restaurant_id, is_discounted LIMIT 10"
    ),
    "discount_bars": _sql(
        _DISCOUNTS,
        "SELECT restaurant_id, is_discounted AS discount_flag, total_revenue FROM discounts",
    ),
    "metric_roundtrip": _METRICS,
    "metrics_rebuilt": _METRICS,
    "sales_of_two_runs": _sql(
        _SALES,
        f"""SELECT {_DAILY_OUT} FROM daily""".replace(
            "CAST(restaurant_id AS BIGINT)", "CAST(restaurant_id AS VARCHAR)"
        ).replace("revenue, granularity", """revenue,
       CASE WHEN date >= DATE '1996-01-01' THEN granularity END AS granularity"""),
    ),
}
