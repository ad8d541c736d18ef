"""Column builders for money: revenue of a line, discount flag, safe averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dinestat.sources.schema import LINE_REVENUE


def _amount(price: str, quantity: str, missing_quantity: int) -> Column:
    return F.coalesce(F.col(price), F.lit(0)) * F.coalesce(F.col(quantity), F.lit(missing_quantity))


def line_revenue(missing_item_quantity: int = 1) -> Column:
    """Price times quantity of the item plus that of its option.

    A missing price or option quantity counts as 0. Customer metrics read a missing
    item quantity as 1, sales trends as 0, hence the argument.
    """
    option = _amount("option_price", "option_quantity", 0)
    item = _amount("item_price", "item_quantity", missing_item_quantity)
    return (option + item).cast(LINE_REVENUE)


def is_discounted(option_price_col: str = "option_price") -> Column:
    """True for a negative option price; a missing price is no discount."""
    return F.coalesce(F.col(option_price_col) < 0, F.lit(False))


def ratio(total: Column, count: Column) -> Column:
    """``total / count`` as a double, null when ``count`` is 0.

    Dividing an exact decimal sum once keeps the result free of shuffle order.
    """
    return F.try_divide(total.cast("double"), count.cast("double"))


def mean(value: Column | str) -> Column:
    """Average of a decimal or integer column: exact sum over non-null count."""
    return ratio(F.sum(value), F.count(value))


def relative_change(current: Column, previous: Column) -> Column:
    """``(current - previous) / previous``; null when previous is null or 0."""
    return ratio(current - previous, previous)
