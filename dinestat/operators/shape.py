"""Column layout, selections, option lists and reshaping."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.sources.schema import ORDER_ITEMS, RENAMES

#: Selection value that keeps every row.
ALL = "All"


def _refuse_repeats(names: Iterable[str]) -> None:
    repeated = [name for name, times in Counter(map(str.lower, names)).items() if times > 1]
    if repeated:
        raise ValueError(f"column names occur more than once: {', '.join(repeated)}")


def rearrange_columns(
    df: DataFrame,
    columns: T.StructType | list[str] = ORDER_ITEMS,
    renames: dict[str, str] = RENAMES,
) -> DataFrame:
    """The wanted columns in their order: absent ones null, others dropped.

    A schema also sets the types. With a list of names, columns keep the type they
    have, and absent ones get that of the order-items table, or text.
    """
    _refuse_repeats(df.columns)
    present = {name.lower(): name for name in df.columns}
    for source, target in renames.items():
        if source in present:
            present.setdefault(target, present[source])

    def column(field: T.StructField):
        name = present.get(field.name.lower())
        value = F.lit(None) if name is None else F.col(f"`{name}`")
        return value.cast(field.dataType).alias(field.name)

    return df.select(*map(column, _typed(columns, df, present)))


def _typed(
    columns: T.StructType | list[str], df: DataFrame, present: dict[str, str]
) -> T.StructType:
    if isinstance(columns, T.StructType):
        return columns
    known = {field.name: field.dataType for field in [*ORDER_ITEMS, *df.schema]}
    kinds = (known.get(present.get(name.lower(), name), T.StringType()) for name in columns)
    return T.StructType([T.StructField(*pair) for pair in zip(columns, kinds)])


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names in lower case without surrounding blanks."""
    names = [name.strip().lower() for name in df.columns]
    _refuse_repeats(names)
    return df.toDF(*names)


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """``df`` itself, or ValueError naming the columns it lacks."""
    missing = [name for name in needed if name not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def join_on(
    left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner", nulls_match: bool = True
) -> DataFrame:
    """Rows of both tables with equal keys; the keys once, then the other columns of each.

    Null keys match null keys, as in a data-frame merge, unless ``nulls_match`` is off. Either
    way the keys are equalities to the planner, which joins by hash or by sorted shuffle.
    """
    keys = list(keys)
    if not nulls_match:
        return left.join(right, keys, how)
    other = {key: f"_right_{key}" for key in keys}
    renamed = right.withColumnsRenamed(other)
    condition = reduce(and_, (F.col(key).eqNullSafe(F.col(other[key])) for key in keys))
    return left.join(renamed, condition, how).drop(*other.values())


#: Types that widen into one another, narrowest first.
_WIDER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _common_type(name: str, kinds: list[T.DataType]) -> T.DataType:
    """The one type that holds the values of all: ValueError where there is none."""
    known = [kind for kind in kinds if not isinstance(kind, T.NullType)]
    if not known:
        return T.NullType()
    if all(kind == known[0] for kind in known):
        return known[0]
    if all(isinstance(kind, _WIDER) for kind in known):
        return max(known, key=lambda kind: _WIDER.index(type(kind)))
    if all(isinstance(kind, (*_WIDER, T.DecimalType)) for kind in known):
        exact = [
            (k.precision - k.scale, k.scale) if isinstance(k, T.DecimalType) else (_DIGITS[type(k)], 0)
            for k in known
        ]
        whole, scale = (max(part) for part in zip(*exact))
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    elif all(isinstance(kind, (T.FloatType, T.DoubleType, *_WIDER[:3])) for kind in known):
        return T.DoubleType()
    elif all(isinstance(kind, (T.DateType, T.TimestampNTZType)) for kind in known):
        return T.TimestampNTZType()
    names = ", ".join(dict.fromkeys(kind.simpleString() for kind in known))
    raise ValueError(f"column {name} has types that do not go together: {names}")


_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def concatenate(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, with every column that any of them has.

    Columns meet by name, whatever its case, in the order of their first table. A column
    that a table lacks is null in its rows; types are widened without loss (whole numbers,
    decimals, dates to timestamps), and types that do not go together are refused.
    """
    if not tables:
        raise ValueError("nothing to concatenate")
    kinds: dict[str, list[T.DataType]] = {}
    names: dict[str, str] = {}
    for table in tables:
        _refuse_repeats(table.columns)
        for field in table.schema:
            names.setdefault(field.name.lower(), field.name)
            kinds.setdefault(field.name.lower(), []).append(field.dataType)
    wanted = {key: _common_type(names[key], found) for key, found in kinds.items()}

    def shaped(table: DataFrame) -> DataFrame:
        present = {name.lower(): name for name in table.columns}
        return table.select(
            *(
                (F.col(f"`{present[key]}`") if key in present else F.lit(None)).cast(kind).alias(names[key])
                for key, kind in wanted.items()
            )
        )

    return reduce(DataFrame.union, map(shaped, tables))


def keep_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value of a column; every row for None or "All"."""
    return df if value is None or value == ALL else df.filter(F.col(column) == F.lit(value))


def keep_any_of(df: DataFrame, column: str, values: Iterable | None) -> DataFrame:
    """Rows whose value is listed; every row when no list is given."""
    return df if values is None else df.filter(F.col(column).isin(list(values)))


def members_only(df: DataFrame, loyalty_col: str = "is_loyalty") -> DataFrame:
    """Rows of known loyalty members."""
    return df.filter(F.col(loyalty_col))


def choices(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted distinct known values of a column: the options of a selection."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(order)


def top_rows(df: DataFrame, value: str, n: int, *ties: str, per: str | None = None) -> DataFrame:
    """The ``n`` rows with the largest value, over all or within each ``per`` group.

    Neither form sorts a whole group: each task first keeps its own best ``n`` rows.
    """
    order = [F.col(value).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties)]
    if per is None:
        return df.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return df.withColumn("position", rank).filter(F.col("position") <= n)


def to_metric_rows(df: DataFrame, key: str, measures: Iterable[str]) -> DataFrame:
    """One row per key and measure: columns key, ``metric``, ``average``."""
    measures = list(measures)
    wide = df.select(key, *(F.col(m).cast("double").alias(m) for m in measures))
    return wide.unpivot(key, measures, "metric", "average")
