import hashlib
import random
import re

import messy
import numpy as np
import pytest

from dinestat.llm import bilstm_crf, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_digit(digits):
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def brute(text):
    """Base spans by the patterns as stated."""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or check_digit(digits)):
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_as_by_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["a", "Z9", "@", ".", "..", "-", "+", "%", " ", "1", "255", "256", "007", "é", "(", ")", "4111111111111111", "b.c", "@x.y", "+1 (555) 555-1234", "1.2.3.4", "_"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_searched_in_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "+1((" * 60_000, "a.a@" * 50_000):
        pii.base_spans(text)


def small_tagger(seed=0):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, bilstm_crf.SYMBOLS, (6, 9)).astype(np.uint8)
    tags = np.zeros((6, 9), np.int64)
    tags[:, 2], tags[:, 3], tags[:3, 7] = 1, 2, 3
    model = bilstm_crf.train(ids, tags, 2, size=3, steps=2, batch=6)
    for w in model.weights():
        w += rng.normal(0, 0.3, w.shape)
    return model, ids, tags


def test_gradients_are_slopes_of_the_loss():
    model, ids, tags = small_tagger()
    _, slopes = bilstm_crf.gradients(model, ids, tags)
    rng = np.random.default_rng(1)
    for weight, slope in zip(model.weights(), slopes, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weight.shape)
            if weight.shape[0] == bilstm_crf.SYMBOLS:
                at = (int(ids[rng.integers(6), rng.integers(9)]), at[1])
            weight[at] += 1e-5
            up = bilstm_crf.gradients(model, ids, tags)[0]
            weight[at] -= 2e-5
            down = bilstm_crf.gradients(model, ids, tags)[0]
            weight[at] += 1e-5
            assert slope[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_decoding_finds_the_best_sequence():
    from itertools import product

    model, ids, _ = small_tagger(3)
    short = ids[:3, :4]
    scores = model.scores(model.states(short)[0])
    moves = model.moves + model.allowed
    for row, found in enumerate(model.decode(short)):
        def value(path, own=scores[row]):
            return model.first[path[0]] + sum(own[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(product(range(5), repeat=4), key=value)
        assert value(tuple(found)) == pytest.approx(value(best))


@pytest.fixture(scope="module")
def tagger():
    ids, tags = pii.labelled_windows([], 2500)
    return bilstm_crf.train(ids, tags, 4, steps=300).light()


def test_unseen_windows_are_tagged(tagger):
    ids, tags = pii.labelled_windows([], 400, seed=77)
    found = tagger.decode(ids)
    assert (found == tags).mean() > 0.98 and (found == tags)[tags > 0].mean() > 0.93


def test_spelt_out_forms_are_added_and_plain_numbers_are_not(tagger):
    fill = "the quick brown fox jumps over a lazy dog "
    texts = [
        fill * 3 + "write to jane.roe (at) example.com today " + fill * 3,
        fill * 2 + "call (030) 555-1234 today " + fill * 2,
        fill * 5 + "host 10[.]0[.]12[.]1 is down " + fill,
        fill + "on 2024-11-02 at 10:30 page 12 of version 3.0 " + fill * 4,
        fill * 30,
        "",
    ]
    added = [[(pii.KINDS[k], t[a:b]) for k, a, b in new] for t, (_, new) in zip(texts, pii.find_pii(texts, tagger), strict=True)]
    assert added[0] == [("email", "jane.roe (at) example.com")]
    assert added[1] == [("phone", "(030) 555-1234")]
    assert added[2] == [("ip", "10[.]0[.]12[.]1")]
    assert added[3:] == [[], [], []]


def test_addresses_in_words_are_added_and_dots_in_prose_are_not(tagger):
    fill = "the quick brown fox jumps over a lazy dog "
    texts = [
        fill * 3 + "write to jane dot doe at example dot org, please " + fill * 3,
        fill * 2 + "ask smith at lanewood dot net. " + fill * 2,
        fill + "there is a dot at the end of it and a dot at example " + fill * 2,
        fill + "connect the dot with the line, meet at noon. " + fill * 2,
    ]
    added = [[(pii.KINDS[k], t[a:b]) for k, a, b in new] for t, (_, new) in zip(texts, pii.find_pii(texts, tagger), strict=True)]
    assert added[0] == [("email", "jane dot doe at example dot org")]
    assert added[1] == [("email", "smith at lanewood dot net")]
    assert added[2:] == [[], []]


def test_overlaps_are_settled_by_votes_over_the_whole_text():
    votes = {(3, 0, 10): 1, (3, 0, 6): 2, (2, 6, 12): 2, (0, 30, 40): 1}
    assert pii.reconciled(votes, []) == [(3, 0, 6), (2, 6, 12), (0, 30, 40)]
    assert pii.reconciled(votes, [(1, 35, 50)]) == [(3, 0, 6), (2, 6, 12)]


@pytest.mark.parametrize("seed", range(5))
def test_no_other_choice_has_more_votes(seed):
    rng = random.Random(seed)
    votes = {}
    for _ in range(10):
        start = rng.randrange(30)
        votes[rng.randrange(4), start, start + rng.randrange(1, 9)] = rng.randrange(1, 4)
    taken = [(0, 12, 15), (1, 14, 17)]

    def disjoint(spans):
        return all(a[2] <= b[1] or b[2] <= a[1] for i, a in enumerate(spans) for b in spans[:i])

    def value(spans):
        return sum(votes[s] * (s[2] - s[1]) for s in spans)

    free = [s for s in votes if disjoint([s, taken[0]]) and disjoint([s, taken[1]])]
    choices = ([s for i, s in enumerate(free) if bits >> i & 1] for bits in range(1 << len(free)))
    found = pii.reconciled(votes, taken)
    assert disjoint(found) and set(found) <= set(free)
    assert value(found) == max(value(c) for c in choices if disjoint(c))


def test_many_spans_take_little_time():
    votes = {(3, 20 * i, 20 * i + 12): 1 for i in range(100_000)}
    taken = [(2, 40 * i, 40 * i + 5) for i in range(50_000)]
    assert len(pii.reconciled(votes, taken)) == 50_000


def test_where_an_item_stands_in_a_text_does_not_matter(tagger):
    item = "(030) 555-1234"
    for before in range(0, 200, 7):
        text = ("word " * 60)[: before - before % 5] + item + " and more words" * 10
        (_, added), = pii.find_pii([text], tagger)
        assert [text[a:b] for _, a, b in added] == [item]


def test_a_long_address_is_found_wherever_it_stands(tagger):
    item = "christopher.montgomery (at) engineering (dot) example (dot) com"[3:]
    assert len(item) == 60
    texts = [("word " * 60)[-(150 + before) :] + item + " and more words" * 12 for before in range(pii.STEP)]
    found = [[t[a:b] for _, a, b in added] for t, (_, added) in zip(texts, pii.find_pii(texts, tagger), strict=True)]
    assert found == [[item]] * pii.STEP


def test_masks():
    text = "mail a@b.cd or +1 (555) 555-1234."
    assert pii.masked(text, pii.base_spans(text)) == "mail [EMAIL] or [PHONE]."
    assert pii.masked("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a[EMAIL]f"


def test_messy_rows(spark, tagger):
    rows = [*messy.TEXTS, (8, "é a@b.cd 1.2.3.4", "en", "a"), (8, "é a@b.cd 1.2.3.4", "en", "a")]
    docs = messy.documents(spark, rows)
    found = pii.personal_data(docs, model=tagger).collect()
    expected = []
    for doc, text, *_ in rows:
        base = brute(text or "")
        counts = [sum(k == kind for k, *_ in base) for kind in range(4)]
        expected.append((doc, *counts, hashlib.sha256(pii.joined(base).encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in found], key=str) == sorted(expected, key=str)
    masked = pii.redacted(docs, model=tagger)
    assert masked.dtypes == docs.dtypes
    texts = sorted([(r["doc_id"], r["text"], r["n_chars"], r["spans"]) for r in masked.collect()], key=str)
    clean = [(i, t if i != 8 else "é [EMAIL] [IP]", None if t is None else len(t) if i != 8 else 14, "x") for i, t, *_ in rows]
    assert texts == sorted(clean, key=str)
    assert pii.personal_data(docs.limit(0), model=tagger).count() == 0


def test_a_tagger_is_trained_without_documents(spark):
    assert pii.fit_tagger(messy.documents(spark).limit(0), windows=100).out.dtype == np.float32
