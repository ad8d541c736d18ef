"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words and their first letters, each counted once a text. Log-odds between
toxic and other labelled texts score them, with a Dirichlet prior that gives either side
its share of PRIOR texts; all that tell nothing share a small negative score. A linear scan finds every
maximal segment of a text. How high segments of a harmless text of some length get by
chance follows an extreme-value law, which is fitted to labelled harmless texts. The
chance that such a text has all of a text's segments is its evidence, and labels turn
that into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import (
    WORD_BYTES,
    column,
    counted,
    labelled_texts,
    learnable,
    per_text,
    settle,
    shared,
)

#: Letters (bytes) of a word's beginnings that count as tokens of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Texts that the prior counts for, and standard errors by which telling log-odds exceed 0.
PRIOR, TELLING = 10.0, 4.5
#: Probability from which a text counts as toxic, and expected number below which a passage does.
TOXIC_FROM, PASSAGE = 0.3, 0.01
#: Bound of the evidence.
MOST_EVIDENCE = 30.0
#: Words remembered by a task before it forgets them all.
REMEMBERED = 500_000


def tokens_of(word: bytes) -> list[bytes]:
    """A word (marked as whole), then its beginnings from the longest on."""
    return [b"=" + word, *(word[:n] for n in reversed(BEGINNINGS) if len(word) > n)]


def segments(scores: list[tuple[int, float]], default: float) -> list[tuple[float, int, int]]:
    """Every maximal scoring segment: (score, first, last), by place.

    ``scores`` holds the places whose score differs from ``default``, ascending; the words
    between count as one step. Every candidate is left or joined once, so the scan is
    linear.
    """
    # Candidates: [sum before, sum after, first, last, next lower candidate whose sum
    # before is less]. Those in between can never join what comes, so links skip them.
    stack: list[list] = []
    total, at = 0.0, 0
    for place, score in scores:
        total += default * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        after, first, j = total, place, len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                break
            before, first, lower = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = lower
        stack.append([before, after, first, place, j])
    return [(after - before, first, last) for before, after, first, last, _ in stack]


@dataclass
class Lexicon:
    """Log-odds of telling tokens, and of all others."""

    odds: dict[bytes, float]
    default: float

    def scorer(self):
        """Places and log-odds of a text's telling words, with a memory of words."""
        known: dict[bytes, float | None] = {}
        odds = self.odds

        def scored(text: str) -> tuple[int, list[tuple[int, float]]]:
            if len(known) > REMEMBERED:
                known.clear()
            out = []
            words = text.encode().translate(WORD_BYTES).split()
            for place, word in enumerate(words):
                if word not in known:
                    known[word] = next((odds[t] for t in tokens_of(word) if t in odds), None)
                value = known[word]
                if value is not None:
                    out.append((place, value))
            return len(words), out

        return scored


@dataclass
class ExtremeValues:
    """Segments of a harmless text of m words that exceed s: Poisson, of mean k m e^(-rate s)."""

    k: float
    rate: float
    slope: float = 0.0  # of the label's log-odds by evidence
    base: float = -2.0

    def expected(self, words, scores):
        """How many segments as high as each score a harmless text of so many words has."""
        return self.k * np.maximum(words, 1) * np.exp(-self.rate * np.asarray(scores, float))

    def evidence(self, words: int, scores: list[float]) -> float:
        """-log of the chance that a harmless text has segments like all of these.

        For every r, the chance of r segments as high as the r-th best: exact for the best
        alone, else Chernoff's bound of the Poisson tail. The least of them counts, after
        each is multiplied by r (r + 1) / 2 for the choice among them.
        """
        if not scores:
            return 0.0
        expected = self.expected(words, sorted(scores, reverse=True))
        r = np.arange(1, len(scores) + 1)
        ratio = np.log(np.maximum(expected, 1e-300) / r)
        tail = np.where(ratio < 0, r * (1 + ratio) - expected, 0.0)
        tail[0] = np.log(max(-np.expm1(-expected[0]), 1e-300))
        return float(np.clip(-(tail + np.log(r * (r + 1) / 2)).min(), 0.0, MOST_EVIDENCE))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * evidence)))


def fit_law(words: np.ndarray, best: np.ndarray) -> ExtremeValues:
    """The law by likelihood of the best segments of harmless texts, 0 where there is none.

    A text without a segment says only that its best is at most the least that was seen.
    """
    m, s = np.maximum(words, 1).astype(float), np.maximum(best, 0.0)
    seen = s > 0
    floor = float(s[seen].min()) if seen.any() else 1.0
    law, top = ExtremeValues(1e-6, 1.0), -np.inf
    for rate in np.linspace(0.05, 3.0, 60):
        decay = np.where(seen, np.exp(-rate * s), np.exp(-rate * floor))
        k = max(1.0, seen.sum()) / (m * decay).sum()
        value = (np.log(k * m[seen]) + np.log(rate) - rate * s[seen]).sum() - (k * m * decay).sum()
        if value > top:
            law, top = ExtremeValues(float(k), float(rate)), value
    return law


def calibrated(law: ExtremeValues, evidence: np.ndarray, toxic: np.ndarray) -> ExtremeValues:
    """The law with the label's log-odds as a line in the evidence."""
    y = toxic.astype(float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    beta = np.array([np.log(share / (1 - share)), 0.0])
    x = np.stack([np.ones_like(evidence), evidence], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2])
        beta = beta + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - [0, 1e-2 * beta[1]]), -2, 2)
    return ExtremeValues(law.k, law.rate, float(max(0.0, beta[1])), float(beta[0]))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
    sample: int = 12_000,
    lexicon: int = 20_000,
) -> tuple[Lexicon, ExtremeValues] | None:
    """Token log-odds and their calibration, from at most ``sample`` labelled rows.

    Rows that are held out, without id or without label are not learned from; None when
    one of the two labels is missing. At most ``lexicon`` tokens tell, the surest ones.
    """
    known = labels.select(
        column(labels, id_col).alias("id"), (column(labels, toxic_col) > 0).alias("toxic")
    ).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("id")))
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    rows = labelled_texts(texts, known, sample, "id").where("text is not null").select("text", "toxic", "id")

    def count():
        def counter(batch):
            found: dict[tuple, int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(text.encode().translate(WORD_BYTES).split())
                for token in {t for word in words for t in tokens_of(word)}:
                    found[token, toxic] = found.get((token, toxic), 0) + 1
            return found

        return counter

    counts = counted(rows.select("text", "toxic"), count, "token binary, toxic boolean")
    is_toxic = F.col("toxic")
    sides = settle(
        counts.groupBy("token").agg(
            F.sum(F.when(is_toxic, F.col("n")).otherwise(0)).alias("y1"),
            F.sum(F.when(is_toxic, 0).otherwise(F.col("n"))).alias("y0"),
        )
    )
    whole = F.substring("token", 1, 1) == F.lit(b"=")
    n1, n0 = sides.where(whole).agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return None
    a1 = F.col("y1") + PRIOR * n1 / (n1 + n0)
    a0 = F.col("y0") + PRIOR * n0 / (n1 + n0)
    odds = F.log(a1 / n1) - F.log(a0 / n0)
    telling = (
        sides.select("token", "y1", "y0", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
        .where(F.col("z") >= TELLING)
        .orderBy(F.desc("z"), "token")
        .limit(lexicon)
        .collect()
    )
    table = {bytes(r["token"]): float(r["odds"]) for r in telling}
    hits = {k: sum(r[f"y{k}"] for r in telling if bytes(r["token"]).startswith(b"=")) for k in (0, 1)}
    default = min(-1e-4, float(np.log((1 - min(0.5, hits[1] / n1)) / (1 - min(0.5, hits[0] / n0)))))
    fitted = Lexicon(table, default)

    def measured(name: str, value) -> np.ndarray:
        """``value`` of words and segments' scores for each sampled text, and its label."""

        def start():
            scored = fitted.scorer()
            return lambda texts: [
                [value(n, [s for s, _, _ in segments(p, default)]) for n, p in map(scored, texts)]
            ]

        field = T.StructField(name, T.ArrayType(T.DoubleType()))
        found = per_text(rows, ["id", "toxic"], "text", start, [field])
        ordered = found.orderBy("id", "toxic", name).limit(2 * sample)  # ids may repeat
        return np.array([[*r[name], r["toxic"]] for r in ordered.collect()], float)

    words, best, toxic = measured("best", lambda n, scores: [n, max(scores, default=0.0)]).T
    law = fit_law(words[toxic == 0], best[toxic == 0])
    evidence, toxic = measured("evidence", lambda n, scores: [law.evidence(n, scores)]).T
    return fitted, calibrated(law, evidence, toxic > 0)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
    **fit,
) -> DataFrame:
    """Toxicity of every whole text: one row per row of ``docs``.

    Columns: the kept ones (the id unless named), ``score`` (0 to 1), ``predicted`` (1 from
    TOXIC_FROM on) and ``passages``, the word ranges (end exclusive) of segments of which a
    harmless text has fewer than PASSAGE as high. A null or empty text has
    no words and the score of a text in which nothing tells. Repeated rows each get the
    same result. Without labels of both kinds every score is 0.
    """
    sent = shared(docs.sparkSession, fit_toxicity(docs, labels, id_col, text_col, **fit))

    def start():
        model = sent()
        if model is None:
            return lambda texts: [np.zeros(len(texts)), np.zeros(len(texts), np.int32), [[] for _ in texts]]
        lexicon, law = model
        scored = lexicon.scorer()

        def kernel(texts):
            found = [(n, segments(places, lexicon.default)) for n, places in map(scored, texts)]
            evidence = [law.evidence(n, [s for s, _, _ in own]) for n, own in found]
            score = law.probability(np.array(evidence))
            passages = [
                [[a, b + 1] for s, a, b in own if law.expected(n, s) < PASSAGE] for n, own in found
            ]
            return [score, (score >= TOXIC_FROM).astype(np.int32), passages]

        return kernel

    fields = [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("passages", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
    return per_text(docs, (id_col,) if keep is None else keep, text_col, start, fields)
