import re
from collections import Counter

import messy
import numpy as np
import pytest

from dinestat.llm import forest, quality_rules
from dinestat.llm.textstats import counts_of

GIVEN = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, same = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            same += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "a a a a", "a b a b a b", "x y z x y z", "l\nl\n\nl \n l", "#|<>é$ *", *(t for _, t, *_ in messy.TEXTS if t)],
)
def test_counts(text):
    assert counts_of(text)[0] == brute(text)


def test_query_counts_and_base_rules(spark):
    import __spark_entry__ as registry

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()}
    rows = registry.queries()["op10_quality_rules"](spark, GIVEN).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality_rules.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["kept"] and r["base_failed"])


def test_held_out_bad_rows_go_and_good_ones_stay(spark):
    given = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{given}/{t}.parquet") for t in ("documents", "labels"))
    learned = labels.where("doc_id % 3 <> 0")
    judged = quality_rules.quality_rules(docs, learned).join(labels.where("doc_id % 3 = 0"), "doc_id")
    rows = judged.where("not base_failed").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.985 and np.mean(bad) < 0.1


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    points = np.concatenate((rng.normal(0, 1, (500, 3)), [[9, 9, 9], [-8, 8, 0]]))
    score = forest.grow(points, 100, 128).score(points)
    assert score[-2:].min() > np.quantile(score[:500], 0.995)
    same = forest.grow(np.ones((10, 2)), 5, 8)
    assert np.allclose(same.score(np.ones((2, 2))), same.score(np.zeros((2, 2))))


def test_messy_rows_and_empty_tables(spark):
    docs, labels = messy.documents(spark), messy.labels(spark)
    for known in (labels, labels.limit(0)):
        rows = quality_rules.quality_rules(docs, known).collect()
        assert sorted([(r["doc_id"], r["n_words"]) for r in rows], key=str) == sorted(
            [(i, brute(t)[0]) for i, t, *_ in messy.TEXTS], key=str
        )
        kept = quality_rules.passing(docs, known)
        assert kept.dtypes == docs.dtypes and [r["doc_id"] for r in kept.collect()] == [
            r["doc_id"] for r in rows if r["kept"]
        ]
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_the_model_is_of_all_labelled_rows(spark):
    """More rows than the former 6000: threshold and forest see every one of them."""
    rng = np.random.default_rng(1)
    rates = rng.uniform(0.1, 0.3, (9000, len(quality_rules.PLACES)))
    rates[::40] += 0.5  # 225 bad rows
    rows = [(i, 100, 0, [float(x) for x in point]) for i, point in enumerate(rates)]
    schema = "c0 bigint, n_words bigint, n_repeat_words bigint, point array<double>"
    stats = spark.createDataFrame(rows, schema)
    labels = spark.range(9000).selectExpr("id AS doc_id", "int(id % 40 <> 0) AS quality")
    fitted, limit = quality_rules.fit_points(stats, labels, kept_share=0.9, trees=40)
    again, same = quality_rules.fit_points(stats.repartition(5, "n_words", "c0"), labels, kept_share=0.9, trees=40)
    assert same == limit and all(
        (getattr(fitted, part) == getattr(again, part)).all() for part in ("feature", "cut", "length")
    )
    scores, good = fitted.score(rates), np.arange(9000) % 40 != 0
    own = np.sort(scores[good])
    base = own[int(np.ceil(0.9 * len(own))) - 1]
    above = scores[~good & (scores > base)]
    assert limit == pytest.approx((base + above.min()) / 2, abs=1e-12)


def test_trees_draw_alike_from_all_copies(spark):
    """A row that comes many times counts as often, and a tree has its full number."""
    rows = [(i, True, [0.0] * 6) for i in range(500)] + [(7, True, [1.0] * 6)] * 500
    table = spark.createDataFrame(rows, "c0 bigint, good boolean, point array<double>")
    grown = quality_rules._grown(table, 1000, 0, 50, 64, 0.01)
    # Each tree splits the two kinds of points at its root; a leaf of m adds expected_path(m).
    of_ones = grown.score(np.ones((1, 6)))[0]
    of_zeros = grown.score(np.zeros((1, 6)))[0]
    assert abs(of_ones - of_zeros) < 0.02 and (grown.feature[:, 0] >= 0).all()


def test_bad_rows_are_drawn_rarely(spark):
    rows = [(i, i % 2 == 0, [float(i % 2)] * 6) for i in range(8000)]
    table = spark.createDataFrame(rows, "c0 bigint, good boolean, point array<double>")
    grown = quality_rules._grown(table, 4000, 4000, 60, 256, 0.01)
    assert (grown.feature[:, 0] >= 0).mean() > 0.7  # some bad row in most trees
    assert grown.score(np.ones((1, 6)))[0] > grown.score(np.zeros((1, 6)))[0] + 0.2
