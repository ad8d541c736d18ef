import random
import re

import messy
import pytest

from dinestat.llm import licenses


def brute(text):
    """Words and base places by comparing every place with every phrase."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [
        (i, label)
        for phrase, label in licenses.BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("seed", range(3))
def test_base_places_as_by_comparing_all(seed):
    rng = random.Random(seed)
    parts = ["mit", "MIT", "license", "License.", "apache", "general", "public", "lesser", "gnu", "x", "é", "cc", "by", "nc", "\n"]
    phrases = licenses.automaton()
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert licenses.scanned(text, phrases)[:5] == brute(text)


def test_automaton_finds_overlapping_phrases():
    phrases = licenses.Automaton({"a b": 1, "b c": 2, "a b c d": 3, "c": 4, "b c e": 5})
    assert sorted(phrases.places(b"a b c e a b c d".split())) == [(0, 1), (1, 2), (1, 5), (2, 4), (4, 1), (4, 3), (5, 2), (6, 4)]


@pytest.mark.parametrize(
    ("text", "polish"),
    [
        ("MIT", "MIT"),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", "MIT Apache-2.0 BSD-3-Clause and or"),
        ("(MIT or Apache-2.0) and BSD-3-Clause", "MIT Apache-2.0 or BSD-3-Clause and"),
        ("GPL-2.0+ WITH Classpath-exception-2.0 OR MIT", "GPL-2.0+ Classpath-exception-2.0 with MIT or"),
        ("MIT */ and more", "MIT"),
        ("MIT This file is free", "MIT"),
        ("(MIT OR (ISC", "MIT ISC or"),
        ("MIT) OR ISC", "MIT"),
        ("MIT OR", "MIT"),
        ("OR MIT", ""),
        ("", ""),
        ("(((", ""),
    ],
)
def test_expressions_to_reverse_polish(text, polish):
    assert " ".join(licenses.reverse_polish(text)) == polish


@pytest.mark.parametrize("seed", range(3))
def test_expressions_evaluate_as_a_descent_does(seed):
    rng = random.Random(seed)
    leaf = {"MIT": 1.0, "GPL-3.0-only": 0.4, "MPL-2.0": 0.6, "CC-BY-NC-4.0": 0.1}

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(leaf))
            return name, leaf[name]
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        return (f"({a}) OR ({b})", max(x, y)) if rng.random() < 0.5 else (f"({a}) and ({b})", min(x, y))

    for _ in range(100):
        text, value = tree(4)
        assert licenses.evaluated(licenses.reverse_polish(text))[0] == value
    assert licenses.evaluated(licenses.reverse_polish("GPL-2.0-only WITH Classpath-exception-2.0"))[0] == pytest.approx(0.6)


def test_labels_of_a_notice():
    phrases = licenses.automaton()
    text = "GNU Lesser General Public License. /* SPDX-License-Identifier: (Apache-2.0 OR MIT) AND Zlib */\nCC BY-NC 4.0"
    n, places, first, last, base, labels, score, expressions = licenses.scanned(text, phrases)
    assert (places, first, last, base) == (1, 2, 2, "gpl")
    assert labels == "apache,cc-by,cc-by-nc,gpl,lgpl,mit,zlib"
    assert (score, expressions) == (0.1, "Apache-2.0 MIT or Zlib and")


def test_messy_rows(spark):
    rows = [*messy.TEXTS, (8, "The MIT License, the mit license", "en", "a")]
    found = licenses.license_scan(messy.documents(spark, rows)).collect()
    assert sorted([tuple(r)[:6] for r in found], key=str) == sorted([(i, *brute(t)) for i, t, *_ in rows], key=str)
    assert all(0 <= r["score"] <= 1 for r in found)
    assert licenses.license_scan(messy.documents(spark).limit(0)).count() == 0
