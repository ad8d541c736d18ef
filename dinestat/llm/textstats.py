"""Rule statistics of a text: lengths, symbols, repeated lines and word windows."""

from __future__ import annotations

import numpy as np

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
POINTS = b"!?.,;:"

#: Exact counts, then the rates that a forest is grown on.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = (
    "symbols_a_char", "upper_a_letter", "digits_a_char", "marks_a_word", "exclaims_a_word",
    "repeated", "duplicate_lines", "words_a_line", "chars_a_word", "distinct", "short_words",
    "shortness",
)


def repeats(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that the sequence holds twice or more, all of them."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 2_000_000:  # number the pairs, so that a triple fits 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * distinct + ids[2:]
    _, place, count = np.unique(triple, return_inverse=True, return_counts=True)
    first = np.flatnonzero(count[place] > 1)
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[first + j] = True
    return int(covered.sum())


def counts_of(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The exact counts and the rates of one text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS), (0.0,) * len(RATES)
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)

    def holds(letters: bytes) -> int:
        return len(data) - len(data.translate(None, letters))

    chars = len(text) - holds(BLANKS)
    symbols = holds(SYMBOLS)
    seen, lines, same = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            same += line in seen
            seen.add(line)
    repeated = repeats(ids, len(numbers))
    upper, lower = holds(UPPER), holds(LOWER)
    sizes = np.fromiter(map(len, words), np.int64, n)
    rates = (
        symbols / chars,
        upper / max(1, upper + lower),
        holds(DIGITS) / chars,
        holds(POINTS) / n,
        data.count(b"!") / n,
        repeated / n,
        same / lines,
        min(n / lines, 200.0) / 200,
        min(chars / n, 20.0) / 20,
        len(numbers) / n ** 0.9,
        float((sizes <= 3).mean()),
        min(1.0, 50 / n),
    )
    return (n, chars, symbols, same, repeated), rates
