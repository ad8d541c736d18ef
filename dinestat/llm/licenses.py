"""Licence scans: an Aho-Corasick automaton over words, and licence expressions.

One pass over a text's words finds all phrases, however they overlap. Where it finds an
identifier tag, the expression behind the tag is read with a shunting yard (``with``
binds before ``and``, ``and`` before ``or``) and evaluated to how freely it lets the text
be used.
"""

from __future__ import annotations

import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dinestat.llm.common import WORD_BYTES, per_text

#: Phrases that count as base places, with their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Phrases that only give a label.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "expat license": "mit",
    "licensed under the apache": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "all rights reserved": "proprietary",
}
#: The words of an identifier tag; an expression follows.
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
#: First parts of identifiers, longest first, with their labels.
FAMILIES = {
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "unlicense": "unlicense",
    "apache": "apache",
    "cc-by": "cc-by",
    "agpl": "agpl",
    "lgpl": "lgpl",
    "bsd": "bsd",
    "bsl": "bsl",
    "cc0": "cc0",
    "epl": "epl",
    "gpl": "gpl",
    "isc": "isc",
    "mit": "mit",
    "mpl": "mpl",
}
#: How freely a label lets text be used, from 0 (not) to 1 (as one likes).
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "cc0": 1.0,
    "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.1,
    "cc-by-nc": 0.1, "proprietary": 0.0,
}
#: Freedom of a label not listed, and of a text that names no licence.
UNKNOWN = 0.5
#: What an exception adds.
EXCEPTION = 0.2


class Automaton:
    """Finds all of a set of phrases, given as words, in one pass over a word sequence."""

    def __init__(self, phrases: dict[str, object]):
        self.next: list[dict[bytes, int]] = [{}]
        self.fail = [0]
        self.found: list[list[tuple[int, object]]] = [[]]
        for phrase, value in phrases.items():
            words = phrase.encode().split()
            state = 0
            for word in words:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.found.append([])
                state = self.next[state][word]
            self.found[state].append((len(words), value))
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for word, child in self.next[state].items():
                queue.append(child)
                back = self.fail[state]
                while back and word not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(word, 0)
                self.found[child] = self.found[child] + self.found[self.fail[child]]

    def places(self, words: list[bytes]):
        """(first word, value) of every place a phrase stands, by last word."""
        root, state = self.next[0], 0
        for i, word in enumerate(words):
            if state:
                while state and word not in self.next[state]:
                    state = self.fail[state]
                state = self.next[state].get(word, 0)
            elif word in root:
                state = root[word]
            else:
                continue
            for length, value in self.found[state]:
                yield i - length + 1, value


# --- expressions -------------------------------------------------------------------

RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")


def reverse_polish(text: str) -> list[str]:
    """Operands and operators of an expression, operators after what they apply to.

    Reads as far as the text is an expression; what does not fit, such as a comment's
    end or further prose, ends it. Missing closing brackets are added.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    at = 0
    while found := TOKEN.match(text, at):
        token = found[0]
        word = token.lower()
        if operand_next:
            if word in RANK or token == ")":
                break
            if token == "(":
                stack.append(token)
            else:
                out.append(token)
                operand_next = False
        elif token == ")":
            if "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        else:
            break
        at = found.end()
        while at < len(text) and text[at] in " \t":
            at += 1
    if operand_next and stack and stack[-1] in RANK:
        stack.pop()  # an operator that nothing follows
    while stack:
        token = stack.pop()
        if token != "(":
            out.append(token)
    return out


def label_of(identifier: str) -> str:
    """The label of a licence identifier; an unknown one is its own, in lower case."""
    low = identifier.lower().rstrip("+")
    return next((v for k, v in FAMILIES.items() if low == k or low.startswith((k + "-", k + "."))), low)


def evaluated(polish: list[str]) -> tuple[float, set[str]] | None:
    """Freedom and labels of an expression; None for an empty one.

    ``or`` takes the freer side, ``and`` the stricter; ``with`` adds a little for the
    exception, which is no licence and gives no label.
    """
    stack: list[tuple[float, set[str]]] = []
    for token in polish:
        if token in RANK and len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                stack.append((min(1.0, left[0] + EXCEPTION), left[1]))
            else:
                pick = max if token == "or" else min
                small, large = sorted((left[1], right[1]), key=len)
                large |= small
                stack.append((pick(left[0], right[0]), large))
        elif token not in RANK:
            label = label_of(token)
            stack.append((FREEDOM.get(label, UNKNOWN), {label}))
    return stack[-1] if stack else None


# --- scan --------------------------------------------------------------------------


def automaton() -> Automaton:
    values = {phrase: (label, True) for phrase, label in BASE.items()}
    values |= {phrase: (label, False) for phrase, label in NOTICES.items()}
    return Automaton(values | {TAG: (None, False)})


def scanned(text: str, phrases: Automaton) -> tuple:
    """Words, base places with first and last, base labels, labels, score, expressions."""
    words = text.encode().translate(WORD_BYTES).split()
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    tagged = False
    for first, (label, counts) in phrases.places(words):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if counts:
            base.append(first)
            base_labels.add(label)
    freedoms = [FREEDOM.get(label, UNKNOWN) for label in labels]
    expressions = []
    if tagged:
        for found in TAG_TEXT.finditer(text):
            polish = reverse_polish(found[1])
            if value := evaluated(polish):
                freedoms.append(value[0])
                labels |= value[1]
                expressions.append(" ".join(polish))
    return (
        len(words),
        len(base),
        min(base, default=None),
        max(base, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        min(freedoms, default=UNKNOWN),
        ";".join(expressions),
    )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and expressions: one row per row of ``docs``.

    Columns: the id, ``n_words``, ``n_base`` places of base phrases with the ``first_word``
    and ``last_word`` they start at (null without any), ``base_labels``, ``labels`` (all,
    sorted, comma-joined), ``score`` and ``expressions`` in reverse Polish form. The score
    is the freedom of the strictest licence named, UNKNOWN where none is. A null or empty
    text has no words. Repeated rows each get the same result. What stands behind an
    identifier tag is read as an expression even where its first word names no licence
    ("see LICENSE" gives the label "see").
    """

    def start():
        phrases = automaton()
        return lambda texts: list(zip(*(scanned(text, phrases) for text in texts), strict=True))

    fields = [
        *(T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("expressions", T.StringType()),
    ]
    return per_text(docs, [id_col], text_col, start, fields)
