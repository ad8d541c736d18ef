import zlib

import messy
import numpy as np
import pytest

from dinestat.llm import language as lg

GIVEN = "/root/testdata/sf0.1"


def brute_grams(text):
    """Counts by spelling every n-gram out."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    if all(c == " " for c in letters):
        return None
    padded = [" ", *letters, " "]
    out = np.zeros(lg.SIZE)
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if gram[0] == " " and gram[-1] == " ":
                continue
            value = 0
            for c in gram:
                value = (value * 0x100000001B3 + ord(c)) % 2**64
            out[(value * 0x9E3779B97F4A7C15) % 2**64 >> 53] += 1
    return out


@pytest.mark.parametrize("text", ["a", "Ab c", "été", "x1y22z", "漢字 \U0001f600 \U00020000", "12 --", "", "a" * 500, messy.LONG[:3000]])
@pytest.mark.parametrize("at_once", [500_000, 7])
def test_gram_counts(text, at_once, monkeypatch):
    monkeypatch.setattr(lg, "AT_ONCE", at_once)
    found, expected = lg.gram_counts(text, lg.letter_table()), brute_grams(text)
    assert (found is None) == (expected is None)
    assert found is None or (found == expected).all()


def test_held_out_rows_and_what_is_learned(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    known = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = lg.identify_language(docs).collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in out]) > 0.99
    assert np.mean([r["rejected"] for r in rows]) < 0.05
    # Languages of held-out rows change nothing.
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id as string)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    again = lg.identify_language(turned).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in again} == {r["doc_id"]: r["lang_pred"] for r in rows}


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    far = spark.createDataFrame([(-1, "漢字漢字 ひらがな カタカナ " * 20, None)], "doc_id bigint, text string, lang string")
    row = lg.identify_language(docs.unionByName(far)).where("doc_id = -1").first()
    assert row["rejected"]


def test_messy_rows(spark):
    docs = messy.documents(spark)
    rows = lg.identify_language(docs).collect()
    assert len(rows) == len(messy.TEXTS)
    blank = {(i, t) for i, t, *_ in messy.TEXTS if not any(c.isalpha() for c in t or "")}
    und = [r["doc_id"] for r in rows if r["lang_pred"] == lg.UNDETERMINED]
    assert sorted(und, key=str) == sorted((i for i, _ in blank), key=str)
    assert all(0 <= r["score"] <= 1 for r in rows)
    untold = docs.drop("lang").selectExpr("*", "cast(null AS string) AS lang")
    assert {r["lang_pred"] for r in lg.identify_language(untold).collect()} == {lg.UNDETERMINED}
    assert lg.identify_language(docs.limit(0)).count() == 0


def test_a_rare_language_among_a_hundred_is_learned(spark):
    import random

    rng = random.Random(8)
    sounds = [a + b for a in "bcdfghklmnprstvz" for b in "aeiouy"]

    def text(lang):
        own = random.Random(lang).sample(sounds, 9)
        return " ".join("".join(rng.choices(own, k=3)) for _ in range(60))

    rows = [(100 * n + i, text(n), f"l{n:02}") for n in range(100) for i in range(3 if n == 42 else 45)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lg.fit_centroids(docs, sample=500)
    learned = {f"l{n:02}" for n in range(100)}
    assert set(model.names) == learned
    extra = spark.createDataFrame([(-i, text(42), None) for i in range(1, 9)], docs.schema)
    found = lg.identify_language(docs.unionByName(extra)).where("doc_id < 0").collect()
    assert sum(r["lang_pred"] == "l42" for r in found) >= 7
