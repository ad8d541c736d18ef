"""Benchmark decontamination by winnowing.

Fingerprints are hashes of K consecutive words; of every W neighbouring ones the least
is kept. Two texts that share K + W - 1 words in a row keep a common fingerprint, so
with the sizes here every shared window of WINDOW words is found. Fingerprints of
documents are joined with those of the items, and each hit is extended to the whole
windows around it, word by word, so that no hash collision counts.

Items are a stated query set. Up to ``block_words`` words of them are an index that goes to
every task, and no text moves. More are tables: tasks hold a filter of fixed size over all
fingerprints, documents give the windows around those that pass, and a join with the items'
windows keeps the true ones. That is two passes over the documents however many items
there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import WORD_BYTES, column, mixed, per_text, settle, shared, spans_of_words

#: Words of a window, of a fingerprint, and fingerprints of which the least is kept.
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Longer words are hashed one by one.
LONG_WORD = 48
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of the filter, as a power of two (8 MB), and of each of the bitmaps it is made of.
FILTER, BITMAP = 26, 15


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, over all words a byte at a time."""
    import xxhash

    raw = np.frombuffer(data, np.uint8)
    out = np.full(len(starts), 7, np.uint64)
    lengths = ends - starts
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    active = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(active):
        out[active] = out[active] * MULTIPLIER + raw[starts[active] + at]
        at += 1
        active = active[lengths[active] > at]
    return mixed(out)


def gram_hashes(words: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; NONE where the text ends before."""
    out = np.full(len(words), NONE)
    size = len(words) - n + 1
    if size > 0:
        total = np.zeros(size, np.uint64)
        for j in range(n):
            total = total * MULTIPLIER + words[j : j + size]
        hashes = np.minimum(mixed(total), NONE - np.uint64(1))
        out[:size] = np.where(texts[:size] == texts[n - 1 :], hashes, NONE)
    return out


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some W neighbours."""
    if len(grams) < W:
        return np.flatnonzero(grams != NONE)
    windows = np.lib.stride_tricks.sliding_window_view(grams, W)
    least = windows.min(axis=1)
    pad = np.zeros(W - 1, np.uint64)
    most = np.lib.stride_tricks.sliding_window_view(np.concatenate((pad, least, pad)), W).max(axis=1)
    return np.flatnonzero((grams == most) & (grams != NONE))


@dataclass
class Index:
    """Fingerprints of items, and their windows by words."""

    prints: np.ndarray
    windows: dict[bytes, tuple]
    short: dict[int, np.ndarray]  # hashes of whole items shorter than a window, by words


def index_of(items: list[tuple[str, str]]) -> Index:
    """Index of (item, text) rows; texts are cut into words as documents are."""
    windows: dict[bytes, set] = defaultdict(set)
    prints, short = [], defaultdict(list)
    for item, text in items:
        data = text.encode().translate(WORD_BYTES)
        starts, ends = spans_of_words(data)
        words = data.split()
        if not words:
            continue
        n = min(WINDOW, len(words))
        for i in range(len(words) - n + 1):
            windows[b" ".join(words[i : i + n])].add(item)
        hashes, alone = word_hashes(data, starts, ends), np.zeros(len(words), np.int64)
        if n < WINDOW:
            short[n].append(gram_hashes(hashes, alone, n)[0])
        else:
            grams = gram_hashes(hashes, alone, K)
            prints.append(grams[winnowed(grams)])
    return Index(
        np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64),
        {key: tuple(sorted(found)) for key, found in windows.items()},
        {n: np.unique(np.array(hashes, np.uint64)) for n, hashes in short.items()},
    )


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


@dataclass
class Words:
    """Words of several texts, each by its place among all of them."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray  # text of each word
    bounds: np.ndarray  # first word of each text, then the end

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        coded = [text.encode() for text in texts]
        data = b" ".join(coded).translate(WORD_BYTES)
        starts, ends = spans_of_words(data)
        firsts = np.cumsum([0] + [len(c) + 1 for c in coded])
        owner = np.searchsorted(firsts, starts, side="right") - 1
        return cls(data, starts, ends, owner, np.searchsorted(owner, np.arange(len(texts) + 1)))

    def window(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[j] : self.ends[j]] for j in range(first, first + n))

    def suspects(
        self,
        is_print: Callable[[np.ndarray], np.ndarray],
        is_short: dict[int, Callable[[np.ndarray], np.ndarray]],
    ) -> list[tuple[int, int]]:
        """Places and lengths of all windows that may be an item's, by their fingerprints."""
        hashes = word_hashes(self.data, self.starts, self.ends)
        grams = gram_hashes(hashes, self.owner, K)
        kept = winnowed(grams)
        out = []
        # Extend: the windows that hold a hit start at most W - 1 words before it.
        tried = -1
        for hit in kept[is_print(grams[kept])].tolist():
            text = self.owner[hit]
            low = max(hit - W + 1, int(self.bounds[text]), tried + 1)
            for first in range(low, min(hit, int(self.bounds[text + 1]) - WINDOW) + 1):
                out.append((first, WINDOW))
                tried = first
        for n, test in is_short.items():
            short = gram_hashes(hashes, self.owner, n)
            out += [(first, n) for first in np.flatnonzero(test(short) & (short != NONE)).tolist()]
        return out


def find_windows(texts: list[str], index: Index) -> list[tuple[int, dict[int, int], set]]:
    """Of each text: its words, window starts with their lengths, and items that occur."""
    words = Words.of(texts)
    bounds = words.bounds
    found = [(int(bounds[i + 1] - bounds[i]), {}, set()) for i in range(len(texts))]
    tests = {n: lambda grams, whole=whole: among(grams, whole) for n, whole in index.short.items()}
    for first, n in words.suspects(lambda grams: among(grams, index.prints), tests):
        text = words.owner[first]
        _, places, items = found[text]
        window = words.window(first, n)
        if window in index.windows:
            own = int(first - bounds[text])
            places[own] = max(n, places.get(own, 0))
            items.update(index.windows[window])
    return found


def merged(places) -> list[list[int]]:
    """Disjoint [start, end) word ranges that cover the given (start, end) ones."""
    out: list[list[int]] = []
    for start, end in sorted(places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _parts(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> DataFrame:
    """Words of the items, blank-joined, with the items' ids; items without words give none.

    A long item is cut into parts that overlap by WINDOW - 1 words.
    """
    part_words = max(WINDOW, block_words // 4)

    def start():
        def kernel(texts):
            parts = []
            for text in texts:
                words = text.encode().translate(WORD_BYTES).split()
                step = max(1, part_words - WINDOW + 1)
                parts.append(
                    [
                        b" ".join(words[i : i + part_words]).decode()
                        for i in range(0, max(1, len(words) - WINDOW + 1), step)
                        if words
                    ]
                )
            return [parts]

        return kernel

    field = T.StructField("parts", T.ArrayType(T.StringType()))
    return settle(
        per_text(benchmark, [item_col], text_col, start, [field]).select(
            F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
            F.explode("parts").alias("part"),
        )
    )


def named(data: bytes) -> bytes:
    """A window or a text by 128 bits of a cryptographic hash."""
    return blake2b(data, digest_size=16).digest()


def passing(bits: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Whether the filter has the leading bits of each fingerprint."""

    def test(grams: np.ndarray) -> np.ndarray:
        place = grams >> np.uint64(64 - FILTER)
        return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    return test


def _item_tables(parts: DataFrame) -> tuple[np.ndarray, list[int], DataFrame]:
    """Of the items: the filter, lengths of short ones, and their windows with the ids."""

    def start():
        def kernel(texts):
            grams, windows, lengths = [], [], []
            for text in texts:
                words = Words.of([text])
                total = len(words.starts)
                n = min(WINDOW, total)
                hashes = word_hashes(words.data, words.starts, words.ends)
                own = gram_hashes(hashes, words.owner, K if n == WINDOW else n)
                own = own[winnowed(own)] if n == WINDOW else own[:1]
                grams.append(np.unique(own).view(np.int64))
                windows.append(list({named(words.window(i, n)) for i in range(total - n + 1)}))
                lengths.append(n)
            return [grams, windows, lengths]

        return kernel

    fields = [
        T.StructField("grams", T.ArrayType(T.LongType())),
        T.StructField("windows", T.ArrayType(T.BinaryType())),
        T.StructField("n", T.IntegerType()),
    ]
    coded = settle(per_text(parts, ["item"], "part", start, fields))
    place = F.shiftrightunsigned("gram", 64 - FILTER)
    bitmaps = (
        coded.select(F.explode("grams").alias("gram"))
        .groupBy(F.shiftright(place, BITMAP).alias("bitmap"))
        .agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << BITMAP))).alias("bits"))
    )
    bits = np.zeros((1 << (FILTER - BITMAP), 1 << (BITMAP - 3)), np.uint8)
    for row in bitmaps.collect():
        bits[row["bitmap"]] = np.frombuffer(row["bits"], np.uint8)
    lengths = coded.where(F.col("n") < WINDOW).agg(F.sort_array(F.collect_set("n"))).first()[0]
    windows = coded.select("item", F.explode("windows").alias("window"))
    listed = windows.groupBy("window").agg(F.collect_set("item").alias("found"))
    return bits.ravel(), lengths, settle(listed)


def _spans_by_join(
    docs: DataFrame, parts: DataFrame, text_col: str, keep: tuple[str, ...]
) -> DataFrame:
    """What :func:`contaminated_spans` gives, for any number of items."""
    bits, lengths, listed = _item_tables(parts)
    sent = shared(docs.sparkSession, bits)

    def start():
        test = passing(sent())

        def kernel(texts):
            words = Words.of(texts)
            places: list[list[tuple]] = [[] for _ in texts]
            for first, n in words.suspects(test, dict.fromkeys(lengths, test)):
                text = words.owner[first]
                own = int(first - words.bounds[text])
                places[text].append((own, own + n, named(words.window(first, n))))
            return [[named(t.encode()) for t in texts], places]

        return kernel

    spot = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("window", T.BinaryType()),
        ]
    )
    key = T.StructField("body", T.BinaryType())
    # Copies of a text become one before anything is joined.
    suspects = (
        per_text(docs, [], text_col, start, [key, T.StructField("places", T.ArrayType(spot))])
        .select("body", F.explode("places").alias("place"))
        .select("body", "place.*")
        .distinct()
    )
    hits = settle(
        suspects.join(listed, "window")
        .groupBy("body")
        .agg(
            F.collect_list(F.array("start", "end")).alias("hits"),
            F.array_distinct(F.flatten(F.collect_set("found"))).alias("items"),
        )
        .select("body", united("hits").alias("hits"), F.sort_array("items").alias("items"))
    )

    def count():
        def kernel(texts):
            return [np.diff(Words.of(texts).bounds), [named(t.encode()) for t in texts]]

        return kernel

    # All columns on the way have names of their own, whatever the caller's are called.
    names = [f"own_{i}" for i in range(len(keep))]
    rows = per_text(docs, keep, text_col, count, [T.StructField("n_words", T.LongType()), key])
    return (
        rows.toDF(*names, "n_words", "body")
        .join(hits, "body", "left")
        .select(
            *(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)),
            "n_words",
            F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def contaminated_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = 250_000,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Where windows of benchmark items occur in documents: one row per row of ``docs``.

    Columns: the kept ones (the id unless named), ``n_words``, ``hits`` (disjoint word
    ranges, end exclusive) and ``items`` (ids as strings, sorted). A null text has no
    words, nor has an item with null text; an item with null id goes by the empty
    string; items with equal ids are one item. Repeated rows each get their own result.
    An empty benchmark hits nothing.
    """
    keep = (id_col,) if keep is None else keep
    ranges = T.ArrayType(T.ArrayType(T.LongType()))
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", ranges),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    parts = _parts(benchmark, item_col, item_text_col, block_words)
    words = parts.agg(F.sum(F.size(F.split("part", " ")))).first()[0] or 0
    if words > block_words:
        return _spans_by_join(docs, parts, text_col, keep)
    sent = shared(docs.sparkSession, index_of([(r["item"], r["part"]) for r in parts.collect()]))

    def start():
        index = sent()

        def kernel(texts):
            out = find_windows(texts, index)
            return [
                [n for n, _, _ in out],
                [merged((s, s + n) for s, n in places.items()) for _, places, _ in out],
                [sorted(items) for _, _, items in out],
            ]

        return kernel

    return per_text(docs, keep, text_col, start, fields)


def united(hits: str) -> Column:
    """Disjoint ranges that cover those of the array, as :func:`merged` gives them."""

    def taken(out: Column, one: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        meets = F.coalesce(one[0] <= last[1], F.lit(False))
        longer = F.array(last[0], F.greatest(last[1], one[1]))
        return F.when(meets, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(
            F.concat(out, F.array(one))
        )

    return F.aggregate(F.array_sort(hits), F.array().cast("array<array<bigint>>"), taken)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the spans, and a hash of the items' ids."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x[1] - x[0])
    return spans.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that hold no window of any item, with their columns unchanged."""
    names = docs.columns
    spans = contaminated_spans(docs, benchmark, keep=tuple(names), **options)
    # The found columns come last and may bear names that documents use as well.
    plain = spans.toDF(*(f"c{i}" for i in range(len(spans.columns))))
    clean = plain.where(F.size(f"c{len(names) + 1}") == 0)
    return clean.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))


__all__ = ["contaminated_spans", "decontaminated", "digest", "find_windows", "index_of"]
