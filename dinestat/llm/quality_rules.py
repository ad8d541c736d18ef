"""Quality rules: an isolation forest over rule statistics, calibrated on labelled rows.

Texts that fail a base rule (too few words, or mostly repeated ones) go at once. Of the
rest all labelled rows make the forest: each tree draws its rows from the whole table, a
bad row with so small a chance that bad ones make ``bad_share`` of the draws, since
anomalies are isolated only where they are rare. The threshold is the one that
``kept_share`` of all labelled good rows pass, found exactly. Texts do not move, only
ids and rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import column, mixed, per_text, settle, shared
from dinestat.llm.forest import Forest, depth_of, expected_path, grow_tree
from dinestat.llm.textstats import COUNTS, RATES, counts_of
from dinestat.operators.quantiles import exact_quantiles

#: Rates the forest splits on: those of which a rule would set a limit.
SPLIT_ON = (
    "symbols_a_char", "upper_a_letter", "marks_a_word", "repeated", "chars_a_word", "short_words",
)
PLACES = [RATES.index(name) for name in SPLIT_ON]
#: Limits of the base rules: words, and percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rows times trees hashed at once.
DRAWN_AT_ONCE = 1 << 20


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def _statistics(docs: DataFrame, names: tuple[str, ...], text_col: str) -> DataFrame:
    """Columns c0, c1, ... for the named ones, the counts, and ``point``, the rates in use."""

    def start():
        def kernel(texts):
            found = [counts_of(text) for text in texts]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            return [*counts.T, [[rates[i] for i in PLACES] for _, rates in found]]

        return kernel

    fields = [
        *(T.StructField(name, T.LongType()) for name in COUNTS),
        T.StructField("point", T.ArrayType(T.DoubleType())),
    ]
    made = per_text(docs, names, text_col, start, fields)
    return made.toDF(*(f"c{i}" for i in range(len(names))), *COUNTS, "point")


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("point").to_pylist(), float).reshape(-1, len(PLACES))


def fit_forest(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    **options,
) -> tuple[Forest, float] | None:
    """The forest and its threshold, from all labelled rows; options as for ``fit_points``.

    None when no good row is labelled: then only the base rules reject. Labels that are
    null, and rows without id, are left out.
    """
    return fit_points(_statistics(docs, (id_col,), text_col), labels, id_col, quality_col, **options)


def fit_points(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    quality_col: str = "quality",
    trees: int = 200,
    tree_sample: int = 256,
    bad_share: float = 0.01,
    kept_share: float = 0.998,
) -> tuple[Forest, float] | None:
    """:func:`fit_forest` from statistics with the id as ``c0``."""
    known = labels.select(
        column(labels, id_col).alias("c0"), (column(labels, quality_col) > 0).alias("good")
    ).where("c0 is not null and good is not null")
    if known.isEmpty():
        return None
    able = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = settle(able.select("c0", "point").join(known, "c0"))
    total = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()
    if total["good"] < 2:
        return None
    forest = _grown(rows, total["good"], total["bad"], trees, tree_sample, bad_share)
    return forest, _threshold(rows, forest, kept_share)


def _grown(
    rows: DataFrame, good: int, bad: int, trees: int, tree_sample: int, bad_share: float
) -> Forest:
    """A forest whose every tree draws from all rows, without replacement.

    For each tree a row has a place between 0 and 1, a hash of the row, of the number among
    its copies and of the tree; the tree takes the rows of least place. Places of bad rows
    are stretched, so that few of them come before ``bad_share`` times the good ones. Rows
    of a place beyond any that a tree can take are dropped where they are hashed.
    """
    few = min(bad, max(1, int(bad_share * good)))
    size = min(tree_sample, good + few)
    stretch = bad / few if few else 1.0
    # Ten standard deviations more than are taken, so that no tree lacks rows.
    limit = min(1.0, (size + 10 * size**0.5) / (good + few))
    n_points = max(1, DRAWN_AT_ONCE // trees)
    copies = rows.groupBy("c0", "good", "point").agg(F.count(F.lit(1)).alias("n"))
    keyed = copies.select(
        F.xxhash64(F.col("c0").cast("string"), "good", "point").alias("key"), "good", "point", "n"
    )
    names = ["tree", "place", "point"]

    def draw(batches):
        of_tree = mixed(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            key = batch.column("key").to_numpy().astype(np.int64).view(np.uint64)
            wide = np.where(batch.column("good").to_numpy(zero_copy_only=False), 1.0, stretch)
            ends = np.cumsum(batch.column("n").to_numpy())
            for start in range(0, int(ends[-1]) if len(ends) else 0, n_points):
                number = np.arange(start, min(start + n_points, int(ends[-1])))
                row = np.searchsorted(ends, number, side="right")
                one = mixed(key[row]) + (ends[row] - number).astype(np.uint64)
                place = mixed(mixed(one)[:, None] ^ of_tree[None, :]) / 2.0**64 * wide[row][:, None]
                at, tree = np.nonzero(place < limit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tree, pa.int64()),
                        pa.array(place[at, tree]),
                        batch.column("point").take(pa.array(row[at])),
                    ],
                    names=names,
                )

    depth = depth_of(size)

    def tree_of(drawn: pa.Table) -> pa.Table:
        drawn = drawn.sort_by("place").slice(0, size)
        points = np.array(drawn.column("point").to_pylist(), float)
        number = drawn.column("tree")[0].as_py()
        nodes = grow_tree(points, depth, np.random.default_rng([7, number]))
        return pa.table({"tree": [number], **dict(zip(parts, ([n] for n in nodes), strict=True))})

    parts = ("feature", "cut", "length")
    grown = (
        keyed.mapInArrow(draw, "tree bigint, place double, point array<double>")
        .groupBy("tree")
        .applyInArrow(
            tree_of, "tree bigint, feature array<bigint>, cut array<double>, length array<double>"
        )
        .orderBy("tree")
        .collect()
    )
    nodes = (np.array([row[part] for row in grown]) for part in parts)
    return Forest(*nodes, float(expected_path(np.array(size))))


def _threshold(rows: DataFrame, forest: Forest, kept: float) -> float:
    """The least threshold at or below which at least ``kept`` of the good rows score.

    Raised from there while it costs no bad row: halfway to the next bad row's score.
    """
    sent = shared(rows.sparkSession, forest)

    def score(batches):
        fitted = sent()
        for batch in batches:
            found = pa.array(fitted.score(_points(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("good"), found], names=["good", "score"])

    scores = settle(rows.select("good", "point").mapInArrow(score, "good boolean, score double"))
    base = exact_quantiles(scores.where("good"), ["good"], "score", {"base": kept}).first()["base"]
    above = scores.where(~F.col("good") & (F.col("score") > base)).agg(F.min("score")).first()[0]
    return base if above is None else (base + above) / 2


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
    quality_col: str = "quality",
    **fit,
) -> DataFrame:
    """Statistics, anomaly score and verdict: one row per row of ``docs``.

    Columns: the kept ones (the id unless named), the five counts, ``anomaly`` (0 to 1),
    ``base_failed`` and ``kept``. A null or empty text has no words and fails. Repeated
    rows each get the same result; without labels only the base rules reject.

    Texts are read once, and their statistics written, unless the text itself is kept:
    then they are read for the model and again for the verdicts.
    """
    names = (id_col,) if keep is None else keep
    if names == (id_col,):
        stats = settle(_statistics(docs, names, text_col))
        model = fit_points(stats, labels, id_col, quality_col, **fit)
    else:
        stats = _statistics(docs, names, text_col)
        model = fit_forest(docs, labels, id_col, text_col, quality_col, **fit)
    sent = shared(docs.sparkSession, model)
    schema = T.StructType(
        [
            *stats.schema.fields[:-1],
            T.StructField("anomaly", T.DoubleType()),
            T.StructField("odd", T.BooleanType()),
        ]
    )

    def judge(batches):
        fitted = sent()
        for batch in batches:
            score, odd = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if fitted is not None:
                forest, threshold = fitted
                score = forest.score(_points(batch))
                odd = score > threshold
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array(odd)], names=schema.names
            )

    judged = stats.mapInArrow(judge, schema)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.select(
        *(F.col(f"c{i}").alias(name) for i, name in enumerate(names)),
        *COUNTS,
        "anomaly",
        failed.alias("base_failed"),
        (~failed & ~F.col("odd")).alias("kept"),
    )


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with their columns unchanged."""
    names = docs.columns
    judged = quality_rules(docs, labels, keep=tuple(names), **options)
    plain = judged.toDF(*(f"c{i}" for i in range(len(judged.columns))))
    kept = plain.where(F.col(f"c{len(judged.columns) - 1}"))
    return kept.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
