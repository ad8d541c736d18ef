"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at few differing bits. The bits are cut into blocks; links
that differ in at most four bits differ in at most the block's threshold in one block at
least (thresholds plus one sum to more than four). In each block the anchors are the
words of a covering code: of every full 15 bits a perfect Hamming code, whose radius is
one, and any value of the bits that remain; all values where the threshold is zero. A
fingerprint is at home at its nearest anchor and is copied to every anchor that can be
the home of a value within the threshold, which are those within covering radius plus
threshold that matter. Per anchor, those at home are compared with all that came. Every
link is found, whatever the data.

Copies share a fingerprint, so only distinct fingerprints travel. Where many are at home
at one anchor, those that link to its pivot, the one nearest to the majority of their bits,
are one component already: only pairs with one that does not are compared, in a grid of
cells. What a task finds leaves it as a forest of links, so a group of copies never becomes
all of its pairs, and components of the links are found by rounds of joins, in which a
value of very many rows is dealt to several tasks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import column, per_text, settle

#: Words of a shingle, seed of its hash, and bits by which linked fingerprints differ.
SHINGLE, SEED, BITS = 4, 42, 4
#: Blocks of the 64 bits: first bit, length, threshold.
BLOCKS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
#: Fingerprints at home at one anchor that are compared in one cell; pairs at once.
CELL, PAIRS = 2048, 1_000_000
#: Rows of one key that one task joins, or one in so many of all rows if these are more.
HUB, SHARE = 512, 100_000

# --- fingerprints ------------------------------------------------------------------


def simhash(text: str) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(stops), 50_000):
        near = zip(starts[at : at + 50_000], stops[at : at + 50_000], strict=False)
        hashes = b"".join([digest(data[a:b], SEED) for a, b in near])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(stops)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` of every row."""

    def start():
        return lambda texts: [[simhash(text) for text in texts]]

    ids = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    return per_text(ids, ["id"], "text", start, [T.StructField("fp", T.LongType())])


# --- anchors -----------------------------------------------------------------------


def to_anchor(values: np.ndarray, length: int) -> np.ndarray:
    """The nearest anchor of values of ``length`` bits."""
    out = values.copy()
    for first in range(0, length - 14, 15):
        low = (values >> np.uint64(first) & np.uint64(0x7FFF)).astype(np.int64)
        syndrome = np.zeros(len(values), np.int64)
        for place in range(1, 16):  # bit at place p adds p; the sum names the wrong bit
            syndrome ^= np.where(low >> (place - 1) & 1, place, 0)
        wrong = np.uint64(1) << (np.maximum(syndrome - 1, 0) + first).astype(np.uint64)
        out ^= np.where(syndrome > 0, wrong, np.uint64(0))
    return out


def flips(length: int, most: int) -> list[int]:
    """Masks of at most ``most`` of ``length`` bits, that of none first."""
    return [
        reduce(or_, (1 << bit for bit in chosen), 0)
        for size in range(most + 1)
        for chosen in combinations(range(length), size)
    ]


def anchor_rows(prints: np.ndarray) -> tuple[np.ndarray, ...]:
    """Block, anchor, fingerprint and whether it is at home, for all that each visits."""
    parts = []
    for block, (first, length, most) in enumerate(BLOCKS):
        value = prints >> np.uint64(first) & np.uint64((1 << length) - 1)
        # Without flips to cover, every value is an anchor: a code of radius zero.
        nearest = to_anchor if most else (lambda value, _: value)
        visits = [nearest(value ^ np.uint64(mask), length) for mask in flips(length, most)]
        grid = np.stack(visits, axis=1)
        home = grid[:, 0].copy()
        grid.sort(axis=1)
        new = np.ones(grid.shape, bool)
        new[:, 1:] = grid[:, 1:] != grid[:, :-1]
        row, place = np.nonzero(new)
        anchor = grid[row, place]
        parts.append((np.full(len(row), block, np.int32), anchor, prints[row], anchor == home[row]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def at_anchors(nodes: DataFrame, home_only: bool = False) -> DataFrame:
    """A row for each anchor that a fingerprint of ``nodes.fp`` visits."""

    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(prints), 20_000):
                block, anchor, fp, home = anchor_rows(prints[at : at + 20_000])
                own = home if home_only else np.ones(len(home), bool)
                columns = (block, anchor.view(np.int64), fp.view(np.int64), home)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[own]) for c in columns], names=["block", "anchor", "fp", "home"]
                )

    return nodes.select("fp").mapInArrow(run, "block int, anchor bigint, fp bigint, home boolean")


# --- links -------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each value to the least one that it reaches over the links (a, b)."""
    if not len(a):
        return a, b
    names, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def linked(prints, home, group) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between rows at home and all rows of their group.

    ``group`` ascends, and those at home come first in theirs.
    """
    edges = np.flatnonzero(np.diff(group)) + 1
    first = np.concatenate(([0], edges))
    size = np.diff(np.concatenate((first, [len(group)])))
    homes = np.add.reduceat(home.astype(np.int64), first)
    repeat = np.repeat(homes, size)
    begin = np.repeat(first, size)
    found_a, found_b = [], []
    total = np.cumsum(repeat)
    at = 0
    while at < len(prints):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + PAIRS, side="right")))
        count = repeat[at:stop]
        row = np.repeat(np.arange(at, stop), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        other = begin[row] + step
        near = (np.bitwise_count(prints[row] ^ prints[other]) <= BITS) & (prints[row] != prints[other])
        a, b = forest(prints[row[near]].view(np.int64), prints[other[near]].view(np.int64))
        found_a.append(a)
        found_b.append(b)
        at = stop
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def links(nodes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all links between fingerprints."""
    # Each row becomes some thirty, so that more tasks make them than the small table fills.
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // 1_000_000))
    nodes = nodes.repartition(tasks, "fp")
    visits = at_anchors(nodes)
    crowded = settle(
        at_anchors(nodes, home_only=True)
        .groupBy("block", "anchor")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > CELL)
    )
    if crowded.isEmpty():
        return _compared(visits.select(*ANCHOR, F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home"))
    few = visits.join(crowded, ANCHOR, "left_anti")
    # What visits crowded anchors: at most the 32 visits of each fingerprint.
    by_anchor = settle(visits.join(crowded.drop("n"), ANCHOR, "left_semi"))
    found, dealt = _around_pivots(by_anchor)
    alone = few.select(*ANCHOR, F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home")
    return found.unionByName(_compared(alone.unionByName(dealt)))


ANCHOR = ["block", "anchor"]


def _around_pivots(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to the pivots of crowded anchors, and the cells of what else is to compare.

    A pair of which both link to the pivot needs no comparison. The others have one that
    is free of it: those free and at home meet all that visit, and those held and at home
    meet the visitors that are free.
    """

    def counted(rows: DataFrame) -> DataFrame:
        return settle(rows.withColumn("n", F.col("all")).drop("all"))

    every = F.count(F.lit(1)).alias("all")
    bits = [F.sum(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    sums = visits.where("home").groupBy(*ANCHOR).agg(F.count(F.lit(1)).alias("homes"), *bits)
    centre = reduce(
        lambda a, b: a.bitwiseOR(b),
        (
            F.when(2 * F.col(f"b{b}") > F.col("homes"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0))
            for b in range(64)
        ),
    )
    sizes = visits.groupBy(*ANCHOR).agg(every)
    centres = counted(sums.select(*ANCHOR, centre.cast("bigint").alias("centre")).join(sizes, ANCHOR))

    def differing(other: str):
        return F.bit_count(F.col("fp").bitwiseXOR(F.col(other)))

    nearest = F.min(F.struct(differing("centre"), "fp"))
    pivots = (
        spread_join(visits, centres, ANCHOR, "fp")
        .where("home")
        .groupBy(*ANCHOR)
        .agg(nearest["fp"].alias("pivot"))
    )
    placed = settle(
        spread_join(visits, counted(pivots.join(sizes, ANCHOR)), ANCHOR, "fp").withColumn(
            "free", differing("pivot") > BITS
        )
    )
    found = placed.where("NOT free AND fp <> pivot").select(
        F.greatest("fp", "pivot").alias("a"), F.least("fp", "pivot").alias("b")
    )
    # Cells of rows: as many as those at home of the kind fill; only anchors with a free one.
    free_homes, held_homes = F.count_if(F.col("free") & F.col("home")), F.count_if(~F.col("free") & F.col("home"))
    cells = counted(
        placed.groupBy(*ANCHOR)
        .agg(every, F.count_if("free").alias("free_rows"), free_homes.alias("u"), held_homes.alias("h"))
        .where("free_rows > 0")
        .select(*ANCHOR, "all", *(F.ceil(F.col(c) / CELL).cast("int").alias(c) for c in "uh"))
    )
    rows = spread_join(placed, cells, ANCHOR, "fp")

    def own(n: str):
        return F.pmod(F.xxhash64("fp"), F.greatest(F.col(n), F.lit(1))).cast("int")

    def span(n: str):
        some = F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
        return F.when(F.col(n) > 0, some).otherwise(F.array().cast("array<int>"))

    def cell(i, j, home):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), home.alias("home"))

    yes, no = F.lit(True), F.lit(False)
    column_of = F.pmod(F.xxhash64("fp"), F.greatest(F.col("u") + F.col("h"), F.lit(1))).cast("int")
    columns = F.sequence(F.lit(0), F.greatest(F.col("u") + F.col("h"), F.lit(1)) - 1)
    # Free ones at home in row i of the grid, all others in one column of every row.
    at_home = F.when(F.col("free") & F.col("home"), F.transform(columns, lambda j: cell(own("u"), j, yes)))
    met = F.transform(span("u"), lambda i: cell(i, column_of, no))
    # A second grid, of rows below zero: held ones at home, and free visitors.
    held_home = F.when(~F.col("free") & F.col("home"), F.transform(columns, lambda j: cell(-1 - own("h"), j, yes)))
    free_visit = F.when(
        F.col("free") & ~F.col("home"), F.transform(span("h"), lambda i: cell(-1 - i, column_of, no))
    )
    none = F.array().cast("array<struct<i:int,j:int,home:boolean>>")
    all_cells = F.concat(*(F.coalesce(part, none) for part in (at_home, met, held_home, free_visit)))
    return found, rows.select("block", "anchor", "fp", F.inline(all_cells)).select(
        *ANCHOR, "i", "j", "fp", "home"
    )


def _compared(cells: DataFrame) -> DataFrame:
    """Links between those at home and all others of each cell."""
    dealt = cells.repartition("block", "anchor", "i", "j").sortWithinPartitions(
        "block", "anchor", "i", "j", F.desc("home")
    )

    def run(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if carried is not None:
                new = [np.concatenate(pair) for pair in zip(carried, new, strict=True)]
            block, anchor, i, j, fp, home = new
            change = np.zeros(len(fp), bool)
            for key in (block, anchor, i, j):
                change[1:] |= key[1:] != key[:-1]
            group = np.cumsum(change)
            a, b = linked(fp.astype(np.int64).view(np.uint64), home.astype(bool), group)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            last = (group == group[-1]) & home.astype(bool)
            carried = [x[last] for x in new]

    return dealt.mapInArrow(run, "a bigint, b bigint")


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` joined with the one row that ``found``, a written table, has for their keys.

    ``found.n`` says how many rows have these keys. Those of many are dealt to several
    tasks by the column ``by``, and what was found for them goes to each. The table of such
    keys has no more than SHARE / 2 rows, as each has at least 2 / SHARE of all rows.
    """
    total = found.agg(F.sum("n")).first()[0] or 0
    most = max(HUB, 2 * total // SHARE)
    parts = F.ceil(F.col("n") / most).cast("int")
    hubs = found.where(F.col("n") > most).select(*keys, parts.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))
    dealt = rows.join(F.broadcast(hubs), keys, "left").withColumn("part", part).drop("parts")
    each = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(each, [*keys, "part"]).drop("part")


def with_least(edges: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` with ``m``, the least ``b`` of the same ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(edges, settle(least), ["a"], "b")


def roots(edges: DataFrame) -> DataFrame:
    """The least member, ``root``, of each linked ``fp``'s component.

    Rounds of large and small stars: each node's neighbours are hung on its least one,
    which halves the depth of every tree, until all hang on the least of their component.
    """
    edges = settle(edges.distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a")
        large = large.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b")
        large = settle(large.distinct())
        hung = F.array(*(F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in "ab"))
        small = with_least(large).select(F.inline(hung)).where("a <> b").distinct()
        edges = settle(small)
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        state = edges.agg(F.count(F.lit(1)), mark).first()
        if state == seen:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = state


def _members(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row's ``id`` and ``fp``; every distinct ``fp``'s least id and component."""
    rows = settle(fingerprints(docs, id_col, text_col))
    nodes = settle(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    hung = settle(roots(links(nodes)))
    # Linked fingerprints and their roots; all others are components of their own.
    named = hung.unionByName(hung.select(F.col("root").alias("fp"), "root").distinct())
    ids = named.join(nodes, "fp")
    first = ids.groupBy("root").agg(
        F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")
    )
    linked_ids = spread_join(named, settle(first), ["root"], "fp")
    components = nodes.join(linked_ids, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return rows, settle(components)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component: one row per row of ``docs``.

    Columns: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the least id of
    the rows that links reach. A null or empty text has fingerprint zero and links like
    any other. Rows without id take part, but give no name: the component of such rows
    alone is null. Rows with equal ids are rows of their own.
    """
    rows, components = _members(docs, id_col, text_col)
    found = rows.join(components, "fp")
    return found.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its columns unchanged: that of the least id.

    Of rows with equal ids, or none, in one component, the one with the least fingerprint
    stays, and any one of those that agree in both.
    """
    rows, components = _members(docs, id_col, text_col)
    times = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    best = components.groupBy("root").agg(F.first("component_id").alias("id"))
    plain = times.where("id is not null and n = 1").select("id")
    wanted = best.join(plain, "id", "left_semi").select(F.col("id").alias("wanted_id"))
    own = column(docs, id_col)
    kept = docs.join(wanted, own == F.col("wanted_id"), "left_semi")
    odd = settle(times.where("id is null or n > 1").select(F.col("id").alias("odd_id")))
    if odd.isEmpty():
        return kept
    # Components named by an id that several rows bear, or by none.
    chosen = (
        rows.join(components, "fp")
        .join(odd, F.col("id").eqNullSafe(F.col("odd_id")), "left_semi")
        .where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("fp").alias("chosen_fp"), F.first("id").alias("chosen_id"))
    )
    names = docs.columns
    shared = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_place, text_place = (f"c{names.index(c)}" for c in (id_col, text_col))
    some = shared.join(odd, F.col(own_place).eqNullSafe(F.col("odd_id")), "left_semi")

    def start():
        return lambda texts: [[simhash(text) for text in texts]]

    printed = per_text(some, shared.columns, text_place, start, [T.StructField("own_fp", T.LongType())])
    match = F.col(own_place).eqNullSafe(F.col("chosen_id")) & (F.col("own_fp") == F.col("chosen_fp"))
    picked = printed.join(chosen, match, "left_semi").dropDuplicates([own_place, "own_fp"])
    return kept.unionByName(picked.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names))))
