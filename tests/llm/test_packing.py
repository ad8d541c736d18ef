import random

import messy
import pytest

from dinestat.llm import neardup, packing


def brute(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in pieces:
        fits = [
            (left, i)
            for i, (left, sources, clusters) in enumerate(bins)
            if left >= size and source not in sources and cluster not in clusters
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([capacity, set(), set()])
        out.append((i, capacity - bins[i][0]))
        bins[i][0] -= size
        bins[i][1] |= {source} - {None}
        bins[i][2] |= {cluster} - {None}
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tightest_compatible_bin_as_by_looking_at_all(seed):
    rng = random.Random(seed)
    pieces = [(rng.randrange(1, 101), rng.choice([None, 0, 0, *range(9)]), rng.choice([None, *range(60)])) for _ in range(400)]
    assert packing.best_fit(pieces, 100) == brute(pieces, 100)


def checked(rows, found, capacity):
    """Every word of every row is placed once, and no bin breaks a rule."""
    words = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    text = {i: (t or "").lower().encode().split() for i, t, *_ in rows}
    spans, bins = {}, {}
    for r in found:
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["n_words"]))
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["n_words"] == 0
    for doc, own in spans.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == words[doc]
    assert spans.keys() == words.keys()
    for own in bins.values():
        own.sort(key=lambda r: r["bin_start"])
        at = 0
        for r in own:
            assert r["bin_start"] == at
            at += r["n_words"]
        assert at <= capacity
        sources = [source[r["doc_id"]] for r in own if source[r["doc_id"]] is not None]
        assert len(set(sources)) == len(sources)
        copies = [tuple(text[r["doc_id"]]) for r in own]
        assert len(set(copies)) == len(copies)
    return bins


def test_packed_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [
        (i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 5, 40, 99, 100, 101, 250]))), "en", rng.choice(["hot", "hot", None, *"abcdefgh"]))
        for i in range(600)
    ]
    for block in (2048, 50):
        monkeypatch.setattr(packing, "BLOCK", block)
        found = packing.packed(messy.documents(spark, rows), capacity=100).collect()
        bins = checked(rows, found, 100)
        assert len(found) == sum(max(1, -(-len(t.split()) // 100)) for _, t, *_ in rows)
        assert len(bins) < len(found)


def test_messy_rows(spark):
    found = packing.packed(messy.documents(spark), capacity=64).collect()
    assert {r["doc_id"] for r in found} == {i for i, *_ in messy.TEXTS}
    assert sum(r["n_words"] for r in found) == sum(len((t or "").encode().split()) for _, t, *_ in messy.TEXTS)
    copies = [r["bin_id"] for r in found if r["doc_id"] in (1, 2)]
    assert len(set(copies)) == 3
    assert packing.packed(messy.documents(spark).limit(0)).count() == 0


def test_given_clusters_and_no_sources(spark):
    rows = [(i, f"w{i} x y", "en", "a") for i in range(6)]
    docs = messy.documents(spark, rows)
    one = packing.packed(docs, source_col=None).collect()
    assert len({r["bin_id"] for r in one}) == 1
    apart = packing.packed(docs, source_col=None, cluster_col="verdict").collect()
    assert len({r["bin_id"] for r in apart}) == 6


def test_near_copies_are_kept_apart(spark):
    rows = [
        (i, r["text"], "en", f"s{i}")
        for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    ]
    docs = messy.documents(spark, [*rows, (None, rows[0][1], "en", "x"), (0, rows[0][1], "en", "y")])
    group = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(messy.documents(spark, rows)).collect()}
    group[None] = group[0]
    assert any(i != c and rows[i][1] != rows[c][1] for i, c in group.items() if i)
    found = packing.packed(docs, near=True).collect()
    bins = {}
    for r in found:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(group[r["doc_id"]])
    assert all(len(set(own)) == len(own) for own in bins.values())
    assert sum(r["n_words"] for r in found) == sum(len(t.encode().split()) for _, t, *_ in [*rows, rows[0], rows[0]])
