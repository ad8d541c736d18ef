"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds at most ``capacity`` words, at most one piece of a source and at most one of
a cluster of duplicates. Open bins are ordered by what they have left. A piece goes to
the tightest bin that can take it: the search starts at the least residual that fits and
goes on to the next larger ones while a bin's bitmaps of sources and clusters show a
conflict; if none is left, a new bin opens.

Pieces are dealt by hash into blocks of about BLOCK, whatever their source, and blocks
are packed side by side, largest pieces first. Only ids and lengths move, not texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dinestat.llm import neardup
from dinestat.llm.common import column, per_text, settle

#: Pieces of a block; rows alike in every part may make a block longer, which is cut then.
BLOCK = 2048
#: Columns of a piece besides its document's id.
PLACES = ("piece", "start_word", "n_words", "bin_id", "bin_start")


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and place in it of each (size, source, cluster), in the order given.

    None as a source or cluster conflicts with nothing.
    """
    bits: dict[tuple, int] = {}
    sources: list[int] = []
    clusters: list[int] = []
    residuals: list[tuple[int, int]] = []  # (left, bin), ascending
    out = []
    for size, source, cluster in pieces:
        own_source = 0 if source is None else bits.setdefault(("source", source), 1 << len(bits))
        own_cluster = 0 if cluster is None else bits.setdefault(("cluster", cluster), 1 << len(bits))
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            number = residuals[at][1]
            if not (sources[number] & own_source or clusters[number] & own_cluster):
                break
            at += 1
        if at < len(residuals):
            left, number = residuals.pop(at)
        else:
            left, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= own_source
        clusters[number] |= own_cluster
        out.append((number, capacity - left))
        if left > size:
            insort(residuals, (left - size, number))
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str | None, near: bool) -> DataFrame:
    """``id``, ``source``, ``words`` and ``cluster``, a number that copies of a text share.

    With ``near`` near copies share it too: it is then the root of their linked fingerprints.
    """

    def start():
        import xxhash

        def kernel(texts):
            words = [text.encode().lower().split() for text in texts]
            if near:
                hashes = [neardup.simhash(text) for text in texts]
            else:
                hashes = [xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63) for w in words]
            return [[len(w) for w in words], hashes]

        return kernel

    source = F.lit(None) if source_col is None else column(docs, source_col)
    rows = docs.select(
        column(docs, id_col).alias("id"), source.cast("string").alias("source"),
        column(docs, text_col).alias("text"),
    )
    fields = [T.StructField("words", T.LongType()), T.StructField("cluster", T.LongType())]
    found = per_text(rows, ["id", "source"], "text", start, fields)
    if not near:
        return found
    found = settle(found.withColumnRenamed("cluster", "fp"))
    # Rows without words are not placed and link nothing.
    prints = settle(found.where("words > 0").select("fp").distinct())
    roots = settle(neardup.roots(neardup.links(prints)))
    return found.join(roots, "fp", "left").select(
        "id", "source", "words", F.coalesce("root", "fp").alias("cluster")
    )


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = "source",
    cluster_col: str | None = None,
    capacity: int = 2048,
    near: bool = False,
) -> DataFrame:
    """Where each piece of a document goes: one row per piece.

    Columns: the id, ``piece`` (from 0), ``start_word`` and ``n_words`` of the piece in the
    document, ``bin_id`` and ``bin_start``, the piece's first place in the bin. A document
    of more words than a bin is cut into full pieces and a rest. One without words (null
    or empty) has one row whose bin is null. A null source, or no source column, conflicts
    with nothing. Clusters are those of ``cluster_col``, else with ``near`` the components
    of near-duplicates, exact copies among them, else of equal words. Repeated rows
    are placed each for itself, as copies of one another.
    """
    rows = measured(docs, id_col, text_col, source_col, near and cluster_col is None)
    if cluster_col is not None:
        # The same pass, with the given cluster in place of the hash.
        chosen = docs.select(
            column(docs, id_col).alias("id"), F.xxhash64(column(docs, cluster_col)).alias("given"),
            column(docs, text_col).alias("text"),
            (F.lit(None) if source_col is None else column(docs, source_col)).cast("string").alias("source"),
        )
        rows = per_text(
            chosen, ["id", "source", "given"], "text",
            lambda: lambda texts: [[len(t.encode().split()) for t in texts]],
            [T.StructField("words", T.LongType())],
        ).withColumnRenamed("given", "cluster")
    whole = F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity)).cast("int")
    cut = rows.select(
        "id", "source", "cluster", "words", F.explode(F.sequence(F.lit(0), whole)).alias("piece")
    ).select(
        "id", "source", "cluster",
        F.col("piece").cast("bigint").alias("piece"),
        (F.col("piece").cast("bigint") * capacity).alias("start_word"),
        F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("bigint").alias("size"),
    )
    pieces = settle(cut)
    blocks = max(1, -(-pieces.count() // BLOCK))
    key = F.xxhash64(F.col("id").cast("string"), "cluster", "piece", "size")
    dealt = (
        pieces.withColumn("block", F.pmod(key, F.lit(blocks)))
        .repartition("block")
        .sortWithinPartitions("block", F.desc("size"), "id", "piece", "cluster", "source")
    )
    id_type = pieces.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            *(T.StructField(n, T.LongType()) for n in PLACES),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        waiting, block, part = [], None, 0

        def flush():
            full = [row for row in waiting if row["size"] > 0]
            places = best_fit([(r["size"], r["source"], r["cluster"]) for r in full], capacity)
            found = iter(places)
            out = []
            for r in waiting:
                number, at = next(found) if r["size"] > 0 else (None, None)
                name = None if number is None else (block << 32) + (part << 16) + number
                out.append(
                    {"id": r["id"], "piece": r["piece"], "start_word": r["start_word"],
                     "n_words": r["size"], "bin_id": name, "bin_start": at}
                )
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if waiting and (row["block"] != block or len(waiting) >= 4 * BLOCK):
                    yield flush()
                    part = part + 1 if row["block"] == block else 0
                    waiting = []
                block = row["block"]
                waiting.append(row)
        if waiting:
            yield flush()

    placed = dealt.mapInArrow(run, schema)
    return placed.withColumnRenamed("id", id_col)
