"""Language-model scores of texts: Katz backoff from two-word counts of the corpus itself.

A token that followed its context ``h`` in training ``r`` times has the probability
``d(r) r / c(h)``, d being Good and Turing's discount of small counts. What discounting
leaves over is shared among the tokens never seen behind ``h``, in proportion to their own
discounted share of all tokens, and what discounting leaves over there goes to the one
unknown word: per token the evaluation falls from pair to word to unknown. The backoff
weight of a context divides what is left by one minus the shares of all that followed it,
so that the probabilities behind every context add up to one over all words, the end and
the unknown word.

Counts grow with the corpus, so nothing of them is collected or broadcast. Tasks cut their
rows into blocks of bounded size and keep them as numbers of local words. A word or pair is
named by a 64-bit hash, whose leading bits choose its partition of the count tables; a block
sends each of its distinct words and pairs once, packed as a sorted run, and gets the counts
back in the same order. A word in every text is thus one entry a block. Only two sets of
seven totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import column, mixed, pieces, settle

#: Tokens of a block, and tokens of the whole input that one partition of the tables is for.
BLOCK, BUCKET = 1_000_000, 4_000_000
#: Counts up to this are discounted where the counts of counts allow it.
MOST = 5
SEED = 42
#: The key of a text's boundary: a token behind its last word, the context of its first.
BOUNDARY = 1
WORDS, PAIRS = 1, 2
STATS = 2 + MOST + 1
TEXTS = ("ids", "n_tokens", "n_known", "base_score", "score")

# --- packed arrays -------------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """The array's bytes by significance, so that high ones, mostly zero, compress."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def packed_run(keys: np.ndarray) -> bytes:
    """Ascending keys as steps from one to the next."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_run(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each partition's share of the ascending keys begins, and their end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


# --- blocks --------------------------------------------------------------------------


class Hashes(dict):
    """Keys of words, kept while they recur."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        key = self[word] = max(xxhash.xxh64_intdigest(word, SEED), BOUNDARY + 1)
        return key


def keys_of(text: str, cache: Hashes) -> np.ndarray:
    """Keys of the text's words and of its end."""
    words = text.encode().lower().split()
    found = np.empty(len(words) + 1, np.uint64)
    found[:-1] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    found[-1] = BOUNDARY
    return found


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Rows of ``docs`` in blocks: ids, training marks, sizes, local words and tokens."""
    chosen = docs.select(
        column(docs, id_col).alias("id"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(chosen.schema["id"].dataType)),
            T.StructField("train", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.BinaryType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(batches):
        from pyspark import TaskContext

        number, cache, held, filled = TaskContext.get().partitionId() << 32, Hashes(), [], 0

        def block():
            ids, train, found = zip(*held, strict=True)
            ends = [0, sum(map(len, ids))]

            def listed(array):
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), array)

            texts = [keys for part in found for keys in part]
            sizes = np.fromiter(map(len, texts), np.int32, len(texts))
            words, tokens = np.unique(np.concatenate(texts), return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), listed(pa.concat_arrays(ids)),
                    listed(pa.concat_arrays(train)), listed(pa.array(sizes)),
                    pa.array([packed_run(words)], pa.binary()),
                    pa.array([packed(tokens.astype(np.uint32))], pa.binary()),
                ],
                names=schema.names,
            )

        for batch in batches:
            for piece in pieces(batch, 2):
                found = [keys_of(text, cache) for text in piece.column(2).to_pylist()]
                held.append((piece.column(0), piece.column(1), found))
                filled += sum(map(len, found))
                if len(cache) > 300_000:
                    cache.clear()
                if filled >= BLOCK:
                    yield block()
                    number, held, filled = number + 1, [], 0
        if held:
            yield block()

    return chosen.mapInArrow(run, schema)


class Block(NamedTuple):
    """A block in a task: each token's text, word and context, and its distinct pairs."""

    train: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    contexts: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pairs: np.ndarray


def opened(train: pa.Array, sizes: pa.Array, words: bytes, tokens: bytes) -> Block:
    """The block of one row. Pairs are numbered by ascending key, like words."""
    sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    words, tokens = unpacked_run(words), unpacked(tokens, np.uint32).astype(np.int64)
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[starts] = 0  # the boundary has the least key
    pairs, place = np.unique(contexts << 32 | tokens, return_inverse=True)
    first, second = pairs >> 32, pairs & 0xFFFFFFFF
    keys = mixed(words[first] * np.uint64(0x9E3779B97F4A7C15) + words[second])
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    marks = train.to_numpy(zero_copy_only=False).astype(bool)
    return Block(
        marks, starts, sizes, words, tokens, contexts, keys[order], first[order], second[order], rank[place]
    )


def opened_rows(table) -> Iterator[tuple[int, pa.Array, Block]]:
    for i in range(table.num_rows):
        block, ids, train, sizes, words, tokens = (table.column(c)[i] for c in range(6))
        yield block.as_py(), ids.values, opened(train.values, sizes.values, words.as_py(), tokens.as_py())


# --- counts --------------------------------------------------------------------------

COUNTED = "block bigint, gram int, bucket int, counts binary, owned binary, stats array<bigint>"


def asked(state: DataFrame, bits: int) -> DataFrame:
    """Each block's distinct words and pairs with their training counts, by partition."""

    def run(batches):
        for batch in batches:
            for block, _, b in opened_rows(batch):
                learned = np.repeat(b.train, b.sizes)
                for gram, keys, places in ((WORDS, b.words, b.tokens), (PAIRS, b.keys, b.pairs)):
                    counts = np.bincount(places[learned], minlength=len(keys)).astype(np.uint64)
                    edge = cuts(keys, bits)
                    some = np.flatnonzero(np.diff(edge))
                    runs = [packed_run(keys[edge[i] : edge[i + 1]]) for i in some]
                    sent = [packed(counts[edge[i] : edge[i + 1]]) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), gram, np.int32)), pa.array(some.astype(np.int32)),
                            pa.array(np.full(len(some), block)), pa.array(runs, pa.binary()),
                            pa.array(sent, pa.binary()),
                        ],
                        names=["gram", "bucket", "block", "keys", "counts"],
                    )

    return state.mapInArrow(run, "gram int, bucket int, block bigint, keys binary, counts binary")


def together(table: pa.Table, name: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Runs of keys; the order that sorts all keys, where each begins, and its number."""
    runs = [unpacked_run(k) for k in table.column(name).to_pylist()]
    keys = np.concatenate(runs)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return runs, order, np.flatnonzero(new), np.cumsum(new) - 1


def tally(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts of one partition, for each block in the order of its keys.

    Each distinct entry is owned by the first block that learned it. A row without block
    has the entries' total, their number, and how many were counted once, twice and so on.
    """
    table = table.sort_by("block")
    runs, order, starts, number = together(table, "keys")
    counts = np.concatenate([unpacked(c, np.uint64) for c in table.column("counts").to_pylist()])[order]
    totals = np.add.reduceat(counts, starts)
    known = np.empty_like(counts)
    known[order] = totals[number]
    learned = np.flatnonzero(counts)
    first = np.concatenate(([True], np.diff(number[learned]) > 0))[: len(learned)]
    owned = np.zeros(len(counts), bool)
    owned[order[learned[first]]] = True
    ends = np.cumsum([len(r) for r in runs])
    spans = list(zip(ends - [len(r) for r in runs], ends, strict=True))
    seen = totals[totals > 0]
    stats = [int(seen.sum()), len(seen), *(int((seen == r).sum()) for r in range(1, MOST + 2))]
    gram, bucket = (k.as_py() for k in key)
    blocks = table.column("block").to_pylist()
    return pa.table(
        {
            "block": pa.array([*blocks, None], pa.int64()),
            "gram": pa.array([gram] * (len(blocks) + 1), pa.int32()),
            "bucket": pa.array([bucket] * (len(blocks) + 1), pa.int32()),
            "counts": pa.array([*(packed(known[a:b]) for a, b in spans), None], pa.binary()),
            "owned": pa.array([*(np.packbits(owned[a:b]).tobytes() for a, b in spans), None], pa.binary()),
            "stats": pa.array([*[None] * len(blocks), stats], pa.list_(pa.int64())),
        }
    )


# --- the model's few numbers ---------------------------------------------------------


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts d(1) to d(k), by the numbers of entries counted once, twice ...

    k is the largest of at most MOST at which all of them lie between 0 and 1.
    """
    for k in range(MOST, 0, -1):
        if min(n[: k + 1]) > 0 and (common := (k + 1) * n[k] / n[0]) < 1:
            found = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in found):
                return found
    return []


class Model(NamedTuple):
    """Training tokens, distinct ones, discounts of words and pairs, shares of words."""

    total: int
    distinct: int
    of_words: np.ndarray
    of_pairs: np.ndarray
    divisor: float
    unknown: float

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def share(self, counts: np.ndarray) -> np.ndarray:
        """A word's probability by itself; that of the unknown word where it has no count."""
        return np.where(counts > 0, discounted(counts, self.of_words) / self.divisor, self.unknown)


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return factors[np.minimum(counts, np.uint64(len(factors) - 1)).astype(np.int64)] * counts


def factors(n: list[int]) -> np.ndarray:
    return np.array([0.0, *discounts(n), 1.0])


def model_of(stats: dict[int, list[int]]) -> Model:
    """The model of the two tables' totals. Where no count is discounted, one is added."""
    nothing = [0] * STATS
    total, distinct, *n = stats.get(WORDS, nothing)
    of_words = factors(n)
    left = sum((1 - of_words[r]) * r * n[r - 1] for r in range(1, len(of_words) - 1))
    divisor, left = (total, left) if left > 0 else (total + 1, 1)
    return Model(total, distinct, of_words, factors(stats.get(PAIRS, nothing)[2:]), divisor, left / divisor)


# --- evaluation ----------------------------------------------------------------------


def sum_by_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def evaluated(model: Model, bits: int, id_type: T.DataType):
    """A function of a block and its counts: a row of its texts, and what its contexts need.

    A text's score lacks only what depends on the whole of a context: the backoff weight
    behind which a token was not seen, and the divisor of contexts that may have lost
    nothing to discounting. A block sends what it owns of each context, with those uses.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(partial_schema(id_type))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows:
            right = right.sort_by([("gram", "ascending"), ("bucket", "ascending")])
            counts, owned = {WORDS: [], PAIRS: []}, []
            rows = zip(*(right.column(c).to_pylist() for c in ("gram", "counts", "owned")), strict=True)
            for gram, packed_counts, bits_owned in rows:
                counts[gram].append(unpacked(packed_counts, np.uint64))
                if gram == PAIRS:
                    marks = np.unpackbits(np.frombuffer(bits_owned, np.uint8), count=len(counts[gram][-1]))
                    owned.append(marks.astype(bool))
            ((block, ids, b),) = opened_rows(left)
            made = parts(block, ids, b, np.concatenate(counts[WORDS]), np.concatenate(counts[PAIRS]), np.concatenate(owned))
        tables = [pa.table({f.name: t.get(f.name, pa.nulls(n, f.type)) for f in schema}) for n, t in made]
        return pa.concat_tables([schema.empty_table(), *(t.cast(schema) for t in tables)])

    def parts(block, ids, b: Block, words, pairs, owned):
        share = model.share(words)
        seen = pairs[b.pairs]
        behind = words[b.contexts]
        by_pair = discounted(pairs, model.of_pairs)
        with np.errstate(divide="ignore"):
            term = np.where(
                seen > 0, np.log10(by_pair)[b.pairs] - np.log10(behind.astype(float)), np.log10(share)[b.tokens]
            )
        texts = len(b.sizes)

        def listed(values):
            return pa.ListArray.from_arrays(pa.array([0, texts], pa.int32()), pa.array(values))

        yield 1, {
            "block": pa.array([block]),
            "ids": listed(ids),
            "n_tokens": listed(b.sizes),
            "n_known": listed(sum_by_text((words[b.tokens] > 0).astype(np.int64), b.starts)),
            "base_score": listed(sum_by_text(model.base(words)[b.tokens], b.starts)),
            "score": listed(sum_by_text(term, b.starts)),
        }
        n, most = len(b.words), len(model.of_pairs) - 2
        # What this block owns of each context: counts, what discounting leaves, shares.
        first, second = b.first[owned], b.second[owned]
        sums = np.bincount(first, pairs[owned].astype(float), n)
        left = np.bincount(first, pairs[owned] - by_pair[owned], n)
        lower = np.bincount(first, share[second], n)
        # A context of which a discounted pair is seen here has surely something left over.
        small = np.bincount(b.first, (pairs > 0) & (pairs <= most), n) > 0
        kind = np.where(seen == 0, 0, 1)
        need = (behind > 0) & ((seen == 0) | ~small[b.contexts])
        text = np.repeat(np.arange(texts), b.sizes)[need]
        use, times = np.unique(b.contexts[need] << 32 | text << 1 | kind[need], return_counts=True)
        context = use >> 32
        sent = sums > 0
        sent[context] = True
        edge = cuts(b.words, bits)
        rows = []
        for bucket in range(len(edge) - 1):
            low, high = edge[bucket], edge[bucket + 1]
            chosen = low + np.flatnonzero(sent[low:high])
            if not len(chosen):
                continue
            a, z = np.searchsorted(context, (low, high))
            rows.append(
                (
                    bucket, packed_run(b.words[chosen]), packed(sums[chosen].astype(np.uint64)),
                    packed(left[chosen]), packed(lower[chosen]),
                    packed(np.searchsorted(chosen, context[a:z]).astype(np.uint32)),
                    packed((use[a:z] & 0xFFFFFFFF).astype(np.uint32)), packed(times[a:z].astype(np.uint32)),
                )
            )
        names = ("bucket", "keys", "sums", "leftover", "lower", "context", "use", "times")
        columns = {c: pa.array(v, schema.field(c).type) for c, v in zip(names, zip(*rows, strict=True), strict=True)} if rows else {}
        yield len(rows), {"block": pa.array(np.full(len(rows), block)), **columns}

    return run


def partial_schema(id_type: T.DataType) -> T.StructType:
    kinds = {
        "block": T.LongType(), "ids": T.ArrayType(id_type), "n_tokens": T.ArrayType(T.LongType()),
        "n_known": T.ArrayType(T.LongType()), "base_score": T.ArrayType(T.DoubleType()),
        "score": T.ArrayType(T.DoubleType()), "bucket": T.IntegerType(),
    }
    binary = ("keys", "sums", "leftover", "lower", "context", "use", "times")
    return T.StructType(
        [T.StructField(n, k) for n, k in kinds.items()] + [T.StructField(n, T.BinaryType()) for n in binary]
    )


def backed_off(unknown: float):
    """A function of one partition of contexts: what their uses add to texts' scores."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        def all_of(name, kind):
            return [unpacked(v, kind) for v in table.column(name).to_pylist()]

        runs, order, starts, number = together(table, "keys")
        sums, left, lower = (
            np.add.reduceat(np.concatenate(all_of(name, kind))[order], starts)
            for name, kind in (("sums", np.uint64), ("leftover", float), ("lower", float))
        )
        # Where discounting left nothing, the count is taken as one larger.
        full = left <= 0
        divisor = sums + full
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.log10(np.where(full, 1.0, left) / divisor / np.maximum(1 - lower, unknown))
            worth = np.stack((weight, np.log10(sums / divisor)), axis=1)
        place = np.empty(len(order), np.int64)
        place[order] = number
        found, at = [], 0
        uses = zip(all_of("context", np.uint32), all_of("use", np.uint32), all_of("times", np.uint32), strict=True)
        for keys, (context, use, times) in zip(runs, uses, strict=True):
            own = place[at : at + len(keys)]
            at += len(keys)
            texts, which = np.unique(use >> 1, return_inverse=True)
            added = np.bincount(which, worth[own[context], use & 1] * times, len(texts))
            found.append((texts.astype(np.int32), added))
        return pa.table(
            {
                "block": table.column("block"),
                "places": pa.array([f[0] for f in found], pa.list_(pa.int32())),
                "added": pa.array([f[1] for f in found], pa.list_(pa.float64())),
            }
        )

    return run


def finished(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block with all that their contexts add."""
    ids, tokens, known, base, score = (left.column(c).combine_chunks().flatten() for c in TEXTS)
    total = score.to_numpy(zero_copy_only=False).copy()
    for places, added in zip(right.column("places"), right.column("added"), strict=True):
        total[places.values.to_numpy(zero_copy_only=False)] += added.values.to_numpy(zero_copy_only=False)
    return pa.table([ids, tokens, known, base, pa.array(total)], names=["id", *TEXTS[1:]])


def learnable(doc_id: Column) -> Column:
    """Rows that the query learns from: four fifths, by id; rows without id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 1, F.lit(True))


def language_model_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None
) -> DataFrame:
    """Scores of each row of ``docs`` under a model of those where ``train`` holds.

    Columns: the id, ``n_tokens`` (words and the end), ``n_known`` (those that training
    has), ``train_tokens``, ``base_score`` (smoothed word counts) and ``score`` (Katz), both
    as sums of log10 probabilities. Left out, ``train`` is :func:`learnable`.

    Words are runs of non-blanks with A-Z lower-cased. A null text is an empty one: its
    only token is the end. Repeated rows count and are scored each for itself. A context
    never seen backs off with weight one; without any training row all is the unknown
    word, of probability one. An empty table gives no rows.
    """
    train = learnable(column(docs, id_col)) if train is None else train
    state = settle(blocks(docs, id_col, text_col, train))
    tokens = state.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, int(-(-tokens // BUCKET) - 1).bit_length())
    counted = settle(asked(state, bits).groupBy("gram", "bucket").applyInArrow(tally, COUNTED))
    added = (
        counted.where("stats IS NOT NULL")
        .groupBy("gram")
        .agg(F.array(*(F.sum(F.col("stats")[i]) for i in range(STATS))).alias("stats"))
    )
    model = model_of({r["gram"]: r["stats"] for r in added.collect()})
    id_type = state.schema["ids"].dataType.elementType
    schema = partial_schema(id_type)
    own = counted.where("block IS NOT NULL").drop("stats").groupBy("block")
    parts = settle(state.groupBy("block").cogroup(own).applyInArrow(evaluated(model, bits, id_type), schema))
    contexts = parts.where("bucket IS NOT NULL").drop(*TEXTS)
    added = contexts.groupBy("bucket").applyInArrow(
        backed_off(model.unknown), "block bigint, places array<int>, added array<double>"
    )
    texts = parts.where("bucket IS NULL").select("block", *TEXTS)
    made = T.StructType(
        [
            T.StructField("id", id_type),
            *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")),
            *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score")),
        ]
    )
    scored = texts.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(finished, made)
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
