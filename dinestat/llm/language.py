"""Language identification by nearest centroid.

A text is a vector of its letter n-grams (one to three, hashed), weighted by TF-IDF and
of length one. Each language has several centroids, from spherical k-means over a
bounded sample of its texts. The nearest centroid by cosine names the language; a text
farther from it than nearly all that it was learned from is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import bounded_sample, column, learnable, per_text, settle, shared

#: Length of the vectors, and centroids of a language.
SIZE, CENTROIDS = 2048, 3
#: Characters counted at once.
AT_ONCE = 500_000
#: What is predicted for a text without letters.
UNDETERMINED = "und"
#: Spread of cosines in the score; share of learned texts that rejection leaves out.
SPREAD, REJECTED = 0.05, 0.01
#: Texts that a language may be learned from, however many languages there are.
FEW = 20


def letter_table() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def gram_counts(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Hashed counts of the letter n-grams of a text; None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    basic = points < 0x10000
    is_letter = letters[np.where(basic, points, 0)]
    for i in np.flatnonzero(~basic):
        is_letter[i] = chr(points[i]).isalpha()
    if not is_letter.any():
        return None
    blank = np.array([32], np.uint32)
    own = np.concatenate((blank, np.where(is_letter, points, 32).astype(np.uint32), blank))
    out = np.zeros(SIZE)
    for at in range(0, len(own), AT_ONCE):
        part = own[at : at + AT_ONCE + 2].astype(np.uint64)
        rolled = np.zeros(len(part), np.uint64)
        for n in (1, 2, 3):
            rolled = rolled[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :]
            first, last = part[: len(rolled)], part[n - 1 :]
            used = ((first != 32) | (last != 32))[:AT_ONCE]
            place = (rolled[:AT_ONCE][used] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
            out += np.bincount(place.astype(np.int64), minlength=SIZE)
    return out


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def clustered(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = [rows[own == i].sum(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]
        centres = unit_rows(np.stack(sums))
    return centres


@dataclass
class Centroids:
    names: list[str]  # of languages
    weights: np.ndarray  # inverse document frequencies
    centres: np.ndarray
    owner: np.ndarray  # language of each centre
    least: np.ndarray  # least cosine that is accepted, by language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit_rows(np.log1p(counts) * self.weights).astype(np.float32)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, of each row of counts."""
        cosines = self.vectors(counts) @ self.centres.T.astype(np.float32)
        by_language = np.stack(
            [cosines[:, self.owner == i].max(axis=1) for i in range(len(self.names))], axis=1
        )
        best = by_language.argmax(axis=1)
        top = by_language[np.arange(len(best)), best]
        share = 1 / np.exp((by_language - top[:, None]) / SPREAD).sum(axis=1)
        rejected = top < self.least[best]
        return best, np.where(rejected, share / 2, share).astype(float), rejected


def fit_centroids(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 600,
    sample: int = 4000,
) -> Centroids | None:
    """Centroids from about ``per_language`` texts of each language, or its share of ``sample``.

    The bound is dealt evenly among the languages, with FEW texts each at the least, so
    that a rare one keeps all it has. Only rows with a language that are not held out are
    learned from; None without any.
    """
    own = docs.select(
        column(docs, id_col).alias("id"), column(docs, lang_col).cast("string").alias("lang"),
        column(docs, text_col).alias("text"),
    ).where(F.col("lang").isNotNull() & learnable(F.col("id")))
    sizes = settle(own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = max(1, sizes.count())
    share = max(FEW, min(per_language, sample // languages))
    most = 2 * share * languages  # chance chooses about half of it
    chance = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_003)) / 1_000_003
    chosen = own.select("id", "lang").join(sizes, "lang").where(chance < share / F.col("n"))
    named = settle(bounded_sample(chosen.select("id", "lang"), most, "id", "lang"))

    def start():
        letters = letter_table()

        def kernel(texts):
            found = [gram_counts(text, letters) for text in texts]
            return [[None if c is None else c.tolist() for c in found]]

        return kernel

    field = T.StructField("counts", T.ArrayType(T.FloatType()))
    rows = (
        per_text(own.join(F.broadcast(named), ["id", "lang"]), ["id", "lang"], "text", start, [field])
        .where("counts is not null")
        .orderBy(F.xxhash64(F.col("id").cast("string")), "id", "lang", "counts")
        .limit(most)
        .toArrow()
    )
    if not rows.num_rows:
        return None
    counts = np.stack(rows.column("counts").to_numpy(zero_copy_only=False)).astype(np.float32)
    langs = np.array(rows.column("lang").to_pylist())
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    names = sorted(set(langs.tolist()))
    model = Centroids(names, weights, np.empty((0, SIZE)), np.empty(0, int), np.empty(0))
    vectors = model.vectors(counts)
    centres, owner, least = [], [], []
    for i, name in enumerate(names):
        mine = vectors[langs == name]
        found = clustered(mine, CENTROIDS)
        centres.append(found)
        owner += [i] * len(found)
        least.append(np.quantile((mine @ found.T).max(axis=1), REJECTED))
    model.centres, model.owner, model.least = np.concatenate(centres), np.array(owner), np.array(least)
    return model


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] | None = None,
    **fit,
) -> DataFrame:
    """The language of every whole text: one row per row of ``docs``.

    Columns: the kept ones (the id unless named), ``lang_pred``, ``score`` (the nearest
    language's share, halved where rejected) and ``rejected``. A null text, or one without
    a letter, is UNDETERMINED with score 0 and rejected; so is every text when no language
    was there to learn. Repeated rows each get the same result.
    """
    sent = shared(docs.sparkSession, fit_centroids(docs, id_col, text_col, lang_col, **fit))

    def start():
        letters, model = letter_table(), sent()

        def kernel(texts):
            names = [UNDETERMINED] * len(texts)
            scores, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
            for at in range(0, len(texts), 500):
                found = [gram_counts(t, letters) for t in texts[at : at + 500]]
                places = [i for i, c in enumerate(found) if c is not None]
                if model is None or not places:
                    continue
                best, score, out = model.nearest(np.stack([found[i] for i in places]))
                for j, i in enumerate(places):
                    names[at + i] = model.names[best[j]]
                    scores[at + i], rejected[at + i] = score[j], out[j]
            return [names, scores, rejected]

        return kernel

    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return per_text(docs, (id_col,) if keep is None else keep, text_col, start, fields)
