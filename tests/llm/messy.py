"""Rows that try an operator: nulls, blanks, a long text, copies, clashing columns."""

from __future__ import annotations

LONG = "".join(f"word{i % 997} thing{i % 31} " for i in range(20_000))
TEXTS = [
    (1, "A plain text of some words about nothing much at all, for once.", "en", "a"),
    (2, "A plain text of some words about nothing much at all, for once.", "en", "a"),
    (2, "A plain text of some words about nothing much at all, for once.", "en", "a"),
    (3, "", "en", "a"),
    (4, None, None, None),
    (5, " \t\n\v\f\r ", "de", "b"),
    (6, LONG, "en", "b"),
    (None, "A text that bears no number but words of its own.", "fr", "c"),
    (None, None, None, None),
    (7, "ÀÉß 漢字 \U0001f600 \u0085   x\x00y", "fr", "c"),
]
#: Names that operators use for columns of their own.
EXTRA = (
    "id, fp, kept, score, n_words, hits, items, words, bin_id, spans, host, path, masked, anomaly, "
    "component_id, fingerprint, piece, block, verdict, cluster, predicted, c0, c1, kept_0, own_fp, root"
).split(", ")


def documents(spark, rows=TEXTS):
    """The rows as documents, with a column of every clashing name."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, schema)
    return df.selectExpr("*", *(f"'x' AS `{name}`" for name in EXTRA), "struct(1 AS a, 2 AS b) AS `odd.name`")


def labels(spark, rows=((1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (6, 1, 0), (6, 1, 0), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def benchmark(spark, rows=((1, "some words about nothing much at all for once and more"), (2, None), (None, "bears no number"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")
