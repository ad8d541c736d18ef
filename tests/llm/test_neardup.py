import random
import re

import messy
import numpy as np
import pytest
import xxhash

from dinestat.llm import neardup


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Least id reachable over links, by comparing all pairs."""
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)] = min(row[0], least.get(find(i), row[0]))
    return prints, [least.get(find(i)) for i in range(len(rows))]


def near_copies(seed, groups=12, copies=9):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 30, 150, 400]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own), "en", "a"))
    rng.shuffle(rows)
    return rows


def test_fingerprints():
    for text in ("", "One", "one Two  three", "a b c d", "a b c d e a b c d e", messy.LONG[:9000], "É é Ü x y z"):
        assert neardup.simhash(text) & (1 << 64) - 1 == brute_print(text)


@pytest.mark.parametrize("blocks", [neardup.BLOCKS, ((0, 36, 2), (36, 28, 1)), ((0, 14, 0), (14, 14, 0), (28, 14, 0), (42, 22, 1))])
@pytest.mark.parametrize("bits", range(5))
def test_linked_values_meet_at_an_anchor(bits, blocks, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCKS", blocks)
    rng = np.random.default_rng(bits)
    ours = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2)
    theirs = ours.copy()
    for i in range(len(theirs)):
        for bit in rng.choice(64, bits, replace=False):
            theirs[i] ^= np.uint64(1) << np.uint64(bit)
    homes = {}
    for block, anchor, value, home in zip(*neardup.anchor_rows(ours), strict=True):
        if home:
            homes.setdefault(int(value), []).append((int(block), int(anchor)))
    visits = {(int(b), int(a), int(v)) for b, a, v, _ in zip(*neardup.anchor_rows(theirs), strict=True)}
    for x, y in zip(ours.tolist(), theirs.tolist(), strict=True):
        assert any((*place, y) in visits for place in homes[x])


def test_anchors_are_a_perfect_code():
    values = np.arange(1 << 15, dtype=np.uint64)
    anchors = neardup.to_anchor(values, 15)
    assert len(np.unique(anchors)) == 1 << 11
    assert np.bitwise_count(values ^ anchors).max() == 1


@pytest.mark.parametrize("cell", [2048, 3])
def test_components_as_by_comparing_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(neardup, "CELL", cell)
    rows = near_copies(4)
    prints, ids = brute_components(rows)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in neardup.near_duplicates(messy.documents(spark, rows)).collect()}
    assert found == {row[0]: (f"{p:016x}", i) for row, p, i in zip(rows, prints, ids, strict=True)}
    assert len(set(ids)) < len(ids)
    kept = neardup.deduplicated(messy.documents(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(ids))


def test_chains_of_links_are_one_component(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    random.Random(1).shuffle(edges)
    found = neardup.roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["fp"]: r["root"] for r in found} == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


def test_a_star_larger_than_a_hub(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 16)
    edges = [(i, 5000) for i in range(3000)] + [(i, i + 1) for i in range(6000, 6100)] + [(5000, 6000)]
    found = neardup.roots(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["fp"] for r in found} == {*range(1, 3000), 5000, *range(6000, 6101)}
    assert {r["root"] for r in found} == {0}


def ball(seed, most, size, span=64):
    """Values within ``most`` bits of one value, itself among them."""
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < size:
        masks = rng.sample(range(span), rng.randrange(most + 1))
        values.add(centre ^ sum(1 << b for b in masks))
    return list(values)


def signed(values):
    return [(v - (1 << 64) if v >> 63 else v,) for v in values]


@pytest.mark.parametrize("most", [2, 4, 7])
def test_crowded_anchors_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(neardup, "CELL", 20)
    values = ball(most, most, 400) + ball(most + 50, most, 150, 30) + [random.Random(i).getrandbits(64) for i in range(200)]
    nodes = spark.createDataFrame(signed(values), "fp bigint")
    found = {r["fp"]: r["root"] for r in neardup.roots(neardup.links(nodes)).collect()}
    prints = np.array([v for (v,) in signed(values)])
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= neardup.BITS
    a, b = np.nonzero(near & (prints[:, None] != prints[None, :]))
    wanted = dict(zip(*(x.tolist() for x in neardup.forest(prints[a], prints[b])), strict=True))
    assert found == wanted


def test_a_large_group_costs_rows_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 64)
    made = {}
    for size in (1000, 4000):
        visits = neardup.at_anchors(spark.createDataFrame(signed(ball(3, 4, size)), "fp bigint"))
        found, cells = neardup._around_pivots(neardup.settle(visits))
        made[size] = (found.count(), cells.count())
    assert made[4000][0] < 6 * made[1000][0]
    assert made[1000][1] == made[4000][1] == 0


def test_forest_joins_all_that_links_reach():
    a, b = np.array([5, 9, 7, 1, 30]), np.array([9, 7, 1, 2, 20])
    names, roots = neardup.forest(a, b)
    assert dict(zip(names.tolist(), roots.tolist(), strict=True)) == {2: 1, 5: 1, 7: 1, 9: 1, 30: 20}


def test_messy_rows(spark):
    docs = messy.documents(spark)
    prints, ids = brute_components(messy.TEXTS)
    expected = sorted(((r[0], f"{p:016x}", i) for r, p, i in zip(messy.TEXTS, prints, ids, strict=True)), key=str)
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str) == expected
    kept = neardup.deduplicated(docs)
    assert kept.dtypes == docs.dtypes
    # Blank rows form one component of least id 3; the copies one of least id 1.
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 6, 7, None]


def test_rows_with_one_id_keep_one_of_each_component(spark):
    rows = [(1, "one text of some words here", "en", "a"), (1, "another thing said in full", "en", "a"), (1, "one text of some words here", "en", "a")]
    kept = neardup.deduplicated(messy.documents(spark, rows)).collect()
    assert sorted(r["text"] for r in kept) == ["another thing said in full", "one text of some words here"]


def test_empty_table(spark):
    docs = messy.documents(spark).limit(0)
    assert neardup.near_duplicates(docs).count() == 0
    assert neardup.deduplicated(docs).count() == 0
