import random
import zlib

import messy
import numpy as np
import pytest

from dinestat.llm import toxicity as tx

GIVEN = "/root/testdata/sf0.1"


def brute_segments(values):
    """Maximal segments by their definition: the best one, then left and right of it."""

    def best(low, high):
        top = None
        for i in range(low, high):
            total = 0
            for j in range(i, high):
                total += values[j]
                if total > 1e-12 and (top is None or total > top[0] + 1e-9):
                    top = (total, i, j)
        if top is None:
            return []
        return [*best(low, top[1]), top, *best(top[2] + 1, high)]

    return best(0, len(values))


@pytest.mark.parametrize("seed", range(40))
def test_segments_as_by_definition(seed):
    rng = random.Random(seed)
    values = [rng.uniform(0.1, 4) if rng.random() < 0.3 else -0.7123 for _ in range(rng.randrange(1, 40))]
    found = tx.segments([(i, v) for i, v in enumerate(values) if v > 0], -0.7123)
    expected = brute_segments(values)
    assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in expected]
    assert [s for s, *_ in found] == pytest.approx([s for s, *_ in expected])


def test_segments_of_a_long_text_take_linear_time():
    places = [(3 * i, 1.0 + (i % 7) / 10) for i in range(300_000)]
    assert len(tx.segments(places, -0.4)) == 1
    assert len(tx.segments(places, -5.0)) == 300_000


def test_extreme_value_law_fits_what_it_is_drawn_from():
    rng = np.random.default_rng(0)
    words = rng.integers(50, 2000, 20_000).astype(float)
    k, rate = 0.002, 0.8
    best = np.log(k * words / -np.log(rng.random(20_000))) / rate
    best = np.where(best > 0.5, best, 0.0)
    law = tx.fit_law(words, best)
    assert law.rate == pytest.approx(rate, rel=0.15) and law.k == pytest.approx(k, rel=0.3)


def test_evidence_grows_with_height_and_number_of_segments():
    law = tx.ExtremeValues(0.001, 1.0)
    assert law.evidence(100, []) == 0
    alone = law.evidence(100, [3.0])
    assert alone == pytest.approx(-np.log(-np.expm1(-0.1 * np.exp(-3))))
    assert law.evidence(100, [2.0]) < alone < law.evidence(100, [4.0])
    assert law.evidence(1000, [3.0]) < alone < law.evidence(100, [3.0, 3.0, 3.0])
    assert law.evidence(100, [3.0, 0.001]) == pytest.approx(alone)


def test_evidence_of_harmless_texts_is_seldom_high():
    rng = np.random.default_rng(4)
    law = tx.ExtremeValues(0.01, 1.0)
    found = np.array([law.evidence(300, rng.exponential(1.0, rng.poisson(3.0)).tolist()) for _ in range(5000)])
    for z in (2.0, 4.0):
        assert (found > z).mean() < 2 * np.exp(-z)


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.toxicity(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    toxic = [r["score"] for r in out if r["toxic"]]
    clean = [r["score"] for r in out if not r["toxic"]]
    above = np.mean([[(t > c) + 0.5 * (t == c) for c in clean] for t in toxic])
    assert above > 0.95
    assert np.mean([s >= 0.3 for s in toxic]) > 0.9 and np.mean([s >= 0.3 for s in clean]) < 0.01
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in rows)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    docs, labels = docs.where("doc_id < 3000"), labels.where("doc_id < 3000")
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    first, second = ({r["doc_id"]: r["score"] for r in tx.toxicity(docs, known).collect()} for known in (labels, turned))
    assert first == second


def test_messy_rows(spark):
    docs = messy.documents(spark)
    for known in (messy.labels(spark), messy.labels(spark).limit(0)):
        rows = tx.toxicity(docs, known).collect()
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, *_ in messy.TEXTS), key=str)
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert tx.toxicity(docs.limit(0), messy.labels(spark)).count() == 0
