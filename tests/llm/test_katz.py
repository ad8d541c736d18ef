import math
import random
import re
import zlib
from collections import Counter, defaultdict

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F

from dinestat.llm import katz

END = None


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


class Plain:
    """The model by dictionaries of whole words."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for tokens in texts:
            self.words.update(tokens)
            self.pairs.update(zip([END, *tokens[:-1]], tokens, strict=True))
        self.total, self.after = sum(self.words.values()), defaultdict(dict)
        self.d1, self.d2 = (self.discount(c) for c in (self.words, self.pairs))
        for (h, w), r in self.pairs.items():
            self.after[h][w] = r
        left = sum((1 - self.d1.get(c, 1)) * c for c in self.words.values())
        self.divisor = self.total if left > 0 else self.total + 1
        self.unknown = (left if left > 0 else 1) / self.divisor

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        for k in range(5, 0, -1):
            if all(n[r] for r in range(1, k + 2)):
                share = (k + 1) * n[k + 1] / n[1]
                if share < 1:
                    d = {r: ((r + 1) * n[r + 1] / n[r] / r - share) / (1 - share) for r in range(1, k + 1)}
                    if all(0 < v < 1 for v in d.values()):
                        return d
        return {}

    def one(self, w):
        c = self.words.get(w, 0)
        return self.d1.get(c, 1) * c / self.divisor if c else self.unknown

    def two(self, w, h):
        seen = self.after.get(h)
        if not seen:
            return self.one(w)
        left = sum((1 - self.d2.get(r, 1)) * r for r in seen.values())
        divisor = sum(seen.values()) + (left <= 0)
        if w in seen:
            return self.d2.get(seen[w], 1) * seen[w] / divisor
        return (left if left > 0 else 1) / divisor / (1 - sum(map(self.one, seen))) * self.one(w)

    def base(self, w):
        return math.log10((self.words.get(w, 0) + 0.5) / (self.total + 0.5 * (len(self.words) + 1)))


def brute(rows, learns=learns):
    model = Plain([words_of(t) for i, t, *_ in rows if learns(i)])
    found = []
    for i, t, *_ in rows:
        tokens = words_of(t)
        pairs = list(zip(tokens, [END, *tokens[:-1]], strict=True))
        found.append(
            (
                i, len(tokens), sum(w in model.words for w in tokens), model.total,
                sum(map(model.base, tokens)), sum(math.log10(model.two(w, h)) for w, h in pairs),
            )
        )
    return model, found


def same(df, expected):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(expected)

    def key(row):
        return (row[0] is None, row[0] or 0, row[1], row[-1])

    for found, wanted in zip(sorted(rows, key=key), sorted(expected, key=key), strict=True):
        assert found[:4] == wanted[:4]
        assert found[4:] == pytest.approx(wanted[4:], rel=1e-9, abs=1e-9)


def prose(seed, texts=120):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    made = [" ".join(rng.choices(names, weights, k=rng.randrange(60))) for _ in range(texts)]
    return [(i, f"{t} Own{i}" if i % 7 == 0 else t, "en", "a") for i, t in enumerate(made)]


def test_messy_rows(spark):
    df = katz.language_model_scores(messy.documents(spark))
    assert df.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(df, brute(messy.TEXTS)[1])


@pytest.mark.parametrize(("block", "bucket"), [(2_000_000, 4_000_000), (500, 1000), (40, 90)])
def test_scores_in_any_cut(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(katz, "BLOCK", block)
    monkeypatch.setattr(katz, "BUCKET", bucket)
    monkeypatch.setattr("dinestat.llm.common.PIECE_BYTES", 300)
    rows = prose(1)
    same(katz.language_model_scores(messy.documents(spark, rows).repartition(3)), brute(rows)[1])


def test_small_corpora_without_discounts(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(["a b a b a b", "a b c", "", "a b a b", "b", "z a"])]
    same(katz.language_model_scores(messy.documents(spark, rows)), brute(rows)[1])


def test_given_training_rows(spark):
    rows = prose(2, 60)
    df = katz.language_model_scores(messy.documents(spark, rows), train=F.col("doc_id") % 2 == 0)
    same(df, brute(rows, lambda i: i % 2 == 0)[1])


def test_without_training_rows(spark):
    rows = katz.language_model_scores(messy.documents(spark, prose(3, 9)), train=F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in rows} == {(0, 0, 0.0)}


def test_no_rows(spark):
    assert katz.language_model_scores(messy.documents(spark).limit(0)).collect() == []


def test_probabilities_behind_every_context_add_up_to_one(spark):
    """The model's own probabilities, taken from scores of two-word texts."""
    learned = prose(4, 25)
    model, _ = brute(learned, lambda i: True)
    names = [w for w in model.words if w is not END][:60]
    contexts = names[:4]
    words = [w for w in model.words if w is not END]
    asks = [(h, w) for h in contexts for w in [*words, "never"]]
    rows = [*learned, *((1000 + n, f"{h} {w}", "en", "a") for n, (h, w) in enumerate(asks))]
    # A text "h w" holds p(h | start) p(w | h) p(end | w); "h" alone p(h | start) p(end | h).
    rows += [(9000 + n, h, "en", "a") for n, h in enumerate([*contexts, *words, "never"])]
    df = katz.language_model_scores(messy.documents(spark, rows), train=F.col("doc_id") < 1000)
    score = {r["doc_id"]: r["score"] for r in df.collect()}
    for h in contexts:
        start, end = (math.log10(p) for p in (model.two(h, END), model.two(END, h)))
        total = 10 ** (score[9000 + contexts.index(h)] - start)
        for n, (g, w) in enumerate(asks):
            if g == h:
                total += 10 ** (score[1000 + n] - start - math.log10(model.two(END, w)))
        assert total == pytest.approx(1, abs=1e-9) and end < 0


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    rng = random.Random(5)
    follows = {i: rng.sample(range(80), 4) for i in range(80)}

    def text():
        at, out = rng.randrange(80), []
        for _ in range(100):
            out.append(f"w{at}")
            at = rng.choice(follows[at])
        return " ".join(out)

    rows = [(i, text(), "en", "a") for i in range(150)]
    found = katz.language_model_scores(messy.documents(spark, rows)).collect()
    out = [r for r in found if not learns(r["doc_id"])]
    assert out and all(r["score"] > r["base_score"] + 50 for r in out)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, np.uint64))
        assert (katz.unpacked_run(katz.packed_run(keys)) == keys).all()
        for bits in (0, 1, 5):
            edge = katz.cuts(keys, bits)
            assert len(edge) == 2**bits + 1 and edge[-1] == len(keys)
            if bits:
                assert (np.repeat(np.arange(2**bits), np.diff(edge)) == keys >> np.uint64(64 - bits)).all()


def test_whole_given_table(spark):
    import __spark_entry__ as registry

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"]) for r in given]
    df = registry.queries()["op12_lm_scoring"](spark, "/root/testdata/sf0.001")
    assert all(r["held_out"] == (not learns(r["doc_id"])) for r in df.collect())
    same(df.drop("held_out"), brute(rows)[1])
