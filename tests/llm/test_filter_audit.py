import re
from collections import Counter
from itertools import permutations

import messy
import numpy as np
import pytest

from dinestat.llm import filter_audit


def failed(text, copied):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    marks = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": copied,
    }
    return {name for name, mark in marks.items() if mark}


def brute(rows, good, toxic):
    """Every order run over every document, filter by filter."""
    texts = [(i, t or "", s or "") for i, t, _, s in rows]
    ids = {}
    for i, t, _ in texts:
        if i is not None:
            ids[t] = min(i, ids.get(t, i))
    docs = [(i, failed(t, i is not None and i > ids[t]), s) for i, t, s in texts]
    found = {}
    for part in {s for *_, s in docs}:
        own = [(i, f) for i, f, s in docs if s == part]
        shares = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                shares[name] += len(gone)
                found[part, order, step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone),
                    sum(f == {name} for _, f in own), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
        for part_, order, step in found:
            if part_ == part:
                found[part, order, step].append(shares[order[step - 1]])
    return {key: tuple(counts) for key, counts in found.items()}


def result(df):
    assert df.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    rows = [tuple(row) for row in df.collect()]
    found = {row[:3]: row[3:] for row in rows}
    assert len(found) == len(rows)
    return found


def marked(labels):
    return (
        {i for i, q, _ in labels if i is not None and q == 1},
        {i for i, _, t in labels if i is not None and t == 1},
    )


PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    *messy.TEXTS,
    (10, PROSE, "en", "a"),
    (11, PROSE, "en", "b"),
    (12, PROSE + " 5%", "en", "b"),
    (13, PROSE.upper(), "en", "b"),
    (14, "same " * 80, "en", "b"),
    (15, PROSE + " 5%", "en", "a"),
    (-3, PROSE + " 5%", "en", ""),
    (16, PROSE.title(), "en", None),
    (None, PROSE, "en", "a"),
]
LABELS = ((1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (6, 1, 0), (6, 1, 1), (11, 1, 1), (12, 1, 0), (99, 0, 1))


def test_every_order_as_run_by_hand(spark):
    found = result(filter_audit.filter_audit(messy.documents(spark, ROWS), messy.labels(spark, LABELS)))
    assert found == brute(ROWS, *marked(LABELS))
    assert len(found) == 600 * len({s or "" for *_, s in ROWS})


def test_without_parts_and_labels(spark):
    docs, none = messy.documents(spark, ROWS), messy.labels(spark, LABELS).limit(0)
    found = result(filter_audit.filter_audit(docs, none, part_col=None))
    assert found == brute([(i, t, lang, "") for i, t, lang, _ in ROWS], set(), set())


def test_no_documents(spark):
    docs = messy.documents(spark, ROWS).limit(0)
    assert result(filter_audit.filter_audit(docs, messy.labels(spark))) == {}


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_states_are_sums_over_disjoint_masks(filters):
    cells = np.random.default_rng(filters).integers(0, 9, (4, 1 << filters, 3))
    alive = filter_audit.states(cells)
    for subset in range(1 << filters):
        free = [m for m in range(1 << filters) if not m & subset]
        assert (alive[:, subset] == cells[:, free].sum(axis=1)).all()


def test_a_text_of_a_third_of_all_rows(spark):
    rows = [(i, PROSE if i % 3 else f"{PROSE} {i}", "en", f"s{i % 2}") for i in range(3000)]
    found = result(filter_audit.filter_audit(messy.documents(spark, rows), messy.labels(spark, LABELS)))
    assert found["s0", "EABCD", 1][1] + found["s1", "EABCD", 1][1] == 1999
    assert found == brute(rows, *marked(LABELS))
