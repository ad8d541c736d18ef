"""How the filters of a corpus interact, for every order in which they may run.

Each document gets a mask of the filters that it fails. Documents are counted by part and
mask, at most ``2 ** filters`` cells a part, and a walk in Gray-code order over all subsets
of the filters toggles one filter at a time: each cell keeps the number of active filters
that it fails, and the running survivors change by the cells whose number leaves or reaches
zero. What any order removes at any step is the difference of two of the stored states.

Only ids, masks and digests of texts travel; texts stay in the tasks that read them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import column, per_text, settle

#: The filters, in the order of a mask's bits, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: What is counted in a cell: all documents, good ones, toxic ones.
MEASURES = ("n", "good", "toxic")
#: Parts whose rows a task makes at once.
PARTS = 50

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

# --- failures of documents -----------------------------------------------------------


def text_failures(text: str) -> int:
    """Mask of the filters A to D that a text fails."""
    data = text.encode()
    words = data.split()
    upper = len(data) - len(data.translate(None, UPPER))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * upper > MOST_UPPER * len(text),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(bit << place for place, bit in enumerate(failed))


def failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str | None = "source"
) -> DataFrame:
    """``id``, ``part`` and ``mask`` of each row of ``docs``.

    Filter E is failed by a row whose text a row of smaller id has too. Rows without id
    have no smaller one and make no other row fail; rows of equal id and text pass or fail
    together. Texts are compared by their SHA-256. The rows of a copied text meet only its
    digest's least id, summed up in tasks first, so a group of copies needs no one task.
    """

    def start():
        def kernel(texts):
            marks = [text_failures(text) for text in texts]
            return [marks, [hashlib.sha256(text.encode()).digest() for text in texts]]

        return kernel

    part = F.lit("") if part_col is None else F.coalesce(column(docs, part_col).cast("string"), F.lit(""))
    chosen = docs.select(
        column(docs, id_col).alias("id"), part.alias("part"), column(docs, text_col).alias("text")
    )
    fields = [T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())]
    rows = settle(per_text(chosen, ["id", "part"], "text", start, fields))
    known = rows.where("id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copied = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    marked = known.join(firsts, ["digest", "id"], "left").select(
        "id", "part", F.col("mask").bitwiseOR(copied).alias("mask")
    )
    return marked.unionByName(rows.where("id IS NULL").select("id", "part", "mask"))


# --- the walk ------------------------------------------------------------------------


def states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of the filters, for many parts at once.

    ``cells[p, m]`` holds what part ``p`` has under mask ``m``; the result's ``[p, s]`` is
    the sum over the masks that share no filter with the subset ``s``.
    """
    masks = np.arange(cells.shape[1])
    active_failures = np.zeros(len(masks), np.int64)
    alive = cells.sum(axis=1)
    out = np.empty_like(cells)
    out[:, 0] = alive
    active = 0
    for step in range(1, len(masks)):
        bit = (step & -step).bit_length() - 1
        active ^= 1 << bit
        fails = masks >> bit & 1 == 1
        if active >> bit & 1:
            alive = alive - cells[:, fails & (active_failures == 0)].sum(axis=1)
            active_failures[fails] += 1
        else:
            active_failures[fails] -= 1
            alive = alive + cells[:, fails & (active_failures == 0)].sum(axis=1)
        out[:, active] = alive
    return out


def steps_of(filters: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of the filters; the subset before each step and the step's filter."""
    orders = list(permutations(range(filters)))
    bits = np.array(orders, np.int64).reshape(len(orders), filters)
    before = np.cumsum(1 << bits, axis=1) - (1 << bits)
    return orders, before, bits


def audited(cells: np.ndarray) -> list[np.ndarray]:
    """The seven counts per part, order and step, as arrays of that shape."""
    filters = cells.shape[1].bit_length() - 1
    _, before, bits = steps_of(filters)
    alive = states(cells)
    everything = (1 << filters) - 1
    lost = alive[:, before] - alive[:, before | 1 << bits]
    fails = alive[:, 0, None, 0] - alive[:, 1 << np.arange(filters), 0]
    alone = alive[:, everything ^ (1 << np.arange(filters)), 0] - alive[:, everything, None, 0]
    removed = lost[..., 0]
    shares = np.stack([(removed * (bits == f)).sum(axis=(1, 2)) for f in range(filters)], axis=1)
    return [
        alive[:, before | 1 << bits, 0], removed, fails[:, bits] - removed, alone[:, bits],
        lost[..., 1], lost[..., 2], shares[:, bits],
    ]


def interactions(cells: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order and step, from rows of part, mask and the three measures.

    A part has at most one row a mask, so the list that is gathered for it is bounded.
    """
    masks = 1 << len(filters)
    orders, _, _ = steps_of(len(filters))
    names = ["".join(filters[f] for f in order) for order in orders]
    rows_a_part = len(orders) * len(filters)
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def made(parts: list[str], lists: list[list[dict]]) -> pa.RecordBatch:
        table = np.zeros((len(parts), masks, len(MEASURES)), np.int64)
        for place, found in enumerate(lists):
            for cell in found:
                table[place, cell["mask"]] = [cell[m] for m in MEASURES]
        counts = [pa.array(c.reshape(-1), pa.int64()) for c in audited(table)]
        each = np.repeat(np.arange(len(parts)), rows_a_part)
        order = np.tile(np.repeat(np.arange(len(names)), len(filters)), len(parts))
        step = np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(parts) * len(names))
        columns = [pa.array(parts, pa.string()).take(pa.array(each)), pa.array(names).take(pa.array(order))]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(step), *counts], names=["part", "filter_order", "step", *COUNTS]
        )

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                piece = batch.slice(at, PARTS)
                yield made(piece.column(0).to_pylist(), piece.column(1).to_pylist())

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return listed.mapInArrow(run, schema)


def _marked(labels: DataFrame, name: str) -> Column:
    return F.max(F.coalesce(column(labels, name) == 1, F.lit(False)))


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str | None = "source",
) -> DataFrame:
    """What each filter does in each order, per part: 600 rows a part, zeros included.

    Columns: ``part`` (a null one is the empty string), ``filter_order``, ``step``, and as
    counts within the part ``kept`` after the step, ``removed`` in it, ``redundant``
    (failing its filter, removed earlier), ``unique_fails`` (failing no other filter),
    ``good_lost`` and ``toxic_lost`` (removed here and so labelled), and ``shapley``, what
    its filter removes in all orders together. Null texts are empty and fail filter A.
    Repeated rows count each for itself. A document is good or toxic if any of its labels
    says so; labels without id go. An empty table has no parts and gives no rows.
    """
    marks = failures(docs, id_col, text_col, part_col)
    known = labels.where(column(labels, id_col).isNotNull())
    sides = known.groupBy(column(known, id_col).alias("id")).agg(
        _marked(known, "quality").alias("good"), _marked(known, "toxic").alias("toxic")
    )
    numbered = marks.where("id IS NOT NULL").join(sides, "id", "left")
    nameless = marks.where("id IS NULL").select("*", F.lit(None).alias("good"), F.lit(None).alias("toxic"))
    cells = (
        numbered.unionByName(nameless)
        .groupBy("part", "mask")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("good").alias("good"),
            F.count_if("toxic").alias("toxic"),
        )
    )
    return interactions(cells)
