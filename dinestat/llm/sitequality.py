"""Document quality by hierarchical empirical Bayes over hosts and paths.

A logistic classifier over rule statistics gives each document's own evidence. Sites say
more: the expected number of good documents of a host is combined with a prior
around the rate of all documents, that of a path with one around its host's posterior.
How strongly a site is drawn towards the rate above it comes from the data: the prior
weighs as many documents as make their scatter within a site equal to the spread of
well-filled sites, so that sparse sites take the rate above them and full ones their own.
A document's posterior is its own odds times those of its path against all documents,
both of which leave out the document itself.

Sites are added up per task before anything moves, so a host with a third of all
documents is a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import column, labelled_texts, per_text, settle, shared
from dinestat.llm.textstats import RATES, counts_of

#: Sums over a site's documents: shares, probabilities by share, their squares by share,
#: squared shares.
SUMS = ("n", "good", "squares", "shares")
#: Least documents of a site whose rate tells of the spread between sites.
FILLED = 5
#: Bounds of a prior's weight in documents.
LIGHTEST, HEAVIEST = 1.0, 1e4
#: Bounds of probabilities whose odds are taken.
LOW, HIGH = 1e-4, 1 - 1e-4
#: Share of the site's log-odds that counts for a document.
SITE_SHARE = 1.0


def features(texts: list[str]) -> np.ndarray:
    """Rates, their squares and the log of the length of each text."""
    found = [counts_of(text) for text in texts]
    rates = np.array([r for _, r in found]).reshape(-1, len(RATES))
    length = np.log1p(np.array([c[0] for c, _ in found], float))[:, None]
    return np.concatenate((rates, rates**2, length, (length < np.log(51)) * 1.0), axis=1)


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, rows: np.ndarray) -> np.ndarray:
        x = np.concatenate(((rows - self.mean) / self.scale, np.ones((len(rows), 1))), axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_logistic(rows: np.ndarray, good: np.ndarray, ridge: float = 1.0) -> Classifier:
    """A ridge logistic regression by Newton's method."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-6
    x = np.concatenate(((rows - mean) / scale, np.ones((len(rows), 1))), axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (good - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return Classifier(mean, scale, w)


def fit_classifier(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, sample: int
) -> Classifier | None:
    """The classifier, from at most ``sample`` labelled rows; None without both labels."""
    known = labels.select(
        column(labels, id_col).alias("id"), (column(labels, quality_col) > 0).alias("good")
    ).where("id is not null and good is not null")
    texts = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))

    def start():
        return lambda texts: [features(texts).tolist()]

    rows = (
        per_text(
            labelled_texts(texts, known, sample, "id"), ["id", "good"], "text", start,
            [T.StructField("x", T.ArrayType(T.DoubleType()))],
        )
        .orderBy("id", "good", "x")
        .limit(2 * sample)  # ids may repeat in documents
        .collect()
    )
    good = np.array([r["good"] for r in rows], float)
    if not len(rows) or good.min() == good.max():
        return None
    return fit_logistic(np.array([r["x"] for r in rows]), good)


def added_up(sites: DataFrame, *key: str) -> DataFrame:
    """Sums of ``sites`` by ``key``, and ``sizes``: that of the squared ``n`` below."""
    return sites.groupBy(*key).agg(
        *(F.sum(c).alias(c) for c in SUMS), F.sum(F.col("n") ** 2).alias("sizes")
    )


def prior_weight(sites: DataFrame) -> DataFrame:
    """One row with ``weight``, the prior's in documents, by moments over the filled sites.

    ``sites`` has SUMS and, as ``up_`` columns, those of the site above with its ``sizes``.
    The weight is the variance of documents within a site over that between sites of one
    parent. Both come without bias: a mean of n documents scatters by the first over n, and
    a site takes part in the mean that it is compared with, so that the only site below
    its parent tells nothing of the spread.
    """
    n, mean = F.col("n"), F.col("good") / F.col("n")
    up, up_mean = F.col("up_n"), F.col("up_good") / F.col("up_n")
    within = F.sum(F.col("squares") - F.col("good") * mean) / F.sum(n - F.col("shares") / n)
    chance = F.col("shares") / n**2 - 2 * F.col("shares") / (n * up) + F.col("up_shares") / up**2
    sums = sites.where("n >= " + str(FILLED)).agg(
        within.alias("within"),
        F.sum((mean - up_mean) ** 2).alias("apart"),
        F.sum(chance).alias("chance"),
        F.sum(1 - 2 * n / up + F.col("up_sizes") / up**2).alias("free"),
    )
    between = (F.col("apart") - F.col("within") * F.col("chance")) / F.when(F.col("free") > 1e-9, F.col("free"))
    weight = F.col("within") / F.when(between > 0, between)
    bounded = F.least(F.greatest(F.coalesce(weight, F.lit(HEAVIEST)), F.lit(LIGHTEST)), F.lit(HEAVIEST))
    return sums.select(bounded.alias("weight"))


@dataclass
class Priors:
    """The rate of all documents, and the prior weights of hosts and of paths."""

    rate: float
    host: float
    path: float

    def posterior(self, mine: Column | None = None, weight: Column | None = None) -> tuple[Column, Column]:
        """Of host and path, from their sums; without a document's own part if it is given."""
        part = F.lit(0.0) if weight is None else weight
        good = F.lit(0.0) if mine is None else mine * weight
        of_host = (F.col("host_good") - good + self.host * self.rate) / (F.col("host_n") - part + self.host)
        return of_host, (F.col("good") - good + self.path * of_host) / (F.col("n") - part + self.path)


def site_sums(paths: DataFrame) -> tuple[DataFrame, Priors]:
    """Sums of each path and its host, and the priors, from ``host``, ``path`` and SUMS."""

    def above(totals: DataFrame) -> DataFrame:
        return totals.toDF(*(c if c == "host" else f"up_{c}" for c in totals.columns))

    hosts = settle(added_up(paths, "host"))
    whole = settle(added_up(hosts))
    total = whole.first()
    rate = total["good"] / total["n"] if total["n"] else 0.5
    everything = {f"up_{c}": F.lit(total[c]).cast("double") for c in (*SUMS, "sizes")}
    of_hosts = prior_weight(hosts.select(*SUMS).withColumns(everything)).first()["weight"]
    under = settle(paths.join(above(hosts), "host"))
    priors = Priors(rate, of_hosts, prior_weight(under).first()["weight"])
    named = {"up_n": "host_n", "up_good": "host_good"}
    return under.select("host", "path", "n", "good", *named).withColumnsRenamed(named), priors


def bounded_log_odds(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(LOW)), F.lit(HIGH))
    return F.log(inside / (1 - inside))


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    sites: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    source_col: str | None = None,
    sample: int = 6000,
    good_from: float = 0.5,
) -> DataFrame:
    """Posterior quality: one row per row of ``docs``.

    ``sites`` has ``doc_id``, ``host`` and ``path``. Documents that it does not name, or
    names without a host, take ``source_col`` as their host and an empty path; where that
    is null or not given they share one host without name. A document of several sites
    counts at each of them in equal shares. Columns: the id, ``host``, ``path`` (the least
    site of several), ``doc_score`` (the classifier's), ``host_score``, ``path_score``
    (posteriors, means over all sites), ``score`` (from the mean log-odds of its sites as
    their other documents give them) and ``good`` (score from ``good_from`` on). A null or empty text is judged by
    its statistics, which are zero. Repeated rows each get the same result. Without both
    labels the classifier gives one half to all.
    """
    model = fit_classifier(docs, labels, id_col, text_col, quality_col, sample)
    sent = shared(docs.sparkSession, model)

    def start():
        fitted = sent()
        if fitted is None:
            return lambda texts: [np.full(len(texts), 0.5)]
        return lambda texts: [fitted.probability(features(texts))]

    source = F.lit(None) if source_col is None else column(docs, source_col)
    ids = docs.select(
        column(docs, id_col).alias("id"), source.cast("string").alias("source"),
        column(docs, text_col).alias("text"),
    )
    scored = per_text(ids, ["id", "source"], "text", start, [T.StructField("doc_score", T.DoubleType())])
    places = settle(
        sites.where("doc_id is not null and host is not null")
        .select("doc_id", "host", F.coalesce("path", F.lit("")).alias("path")).distinct()
    )
    least = F.min(F.struct("host", "path")).alias("site")
    per_doc = places.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sites"), least)
    rows = settle(
        scored.join(per_doc, F.col("id") == F.col("doc_id"), "left").select(
            "id", "doc_score", "sites",
            F.coalesce("site.host", "source", F.lit("")).alias("host"),
            F.coalesce("site.path", F.lit("")).alias("path"),
        )
    )
    # A document counts at all its sites, in equal shares that add up to one.
    several = settle(rows.where("sites > 1").join(places.withColumnRenamed("doc_id", "id"), "id").select(
        "id", "doc_score", (1 / F.col("sites")).alias("part"), places["host"], places["path"]
    ))
    one = rows.where("sites is null or sites = 1").withColumn("part", F.lit(1.0))
    part, p = F.col("part"), F.col("doc_score")
    weighted = zip(SUMS, (part, part * p, part * p * p, part * part), strict=True)
    sums = [F.sum(c).alias(name) for name, c in weighted]
    names = ["host", "path", "part", "doc_score"]
    paths = settle(one.select(names).unionByName(several.select(names)).groupBy("host", "path").agg(*sums))
    posts, priors = site_sums(paths)
    posts = settle(posts)
    host_score, path_score = priors.posterior()
    without_it = priors.posterior(p, part)[1]
    site_odds = bounded_log_odds(without_it) - bounded_log_odds(F.lit(priors.rate))
    found = {"host_score": host_score, "path_score": path_score, "site_odds": site_odds}
    means = [F.avg(c).alias(c) for c in found]
    pooled = several.join(posts, ["host", "path"]).withColumns(found).groupBy("id", "doc_score").agg(*means)
    columns = ["id", "host", "path", "doc_score", *found]
    judged = one.join(posts, ["host", "path"]).withColumns(found).select(columns).unionByName(
        rows.where("sites > 1").join(pooled, ["id", "doc_score"]).select(columns)
    )
    odds = bounded_log_odds(p) + SITE_SHARE * F.col("site_odds")
    final = 1 / (1 + F.exp(-odds))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "doc_score", "host_score", "path_score",
        final.alias("score"), (final >= good_from).alias("good"),
    )


def page_sites(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Host and first part of the path of each page, by the document number in its url."""
    url = column(pages, url_col)
    whole = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return pages.select(
        F.regexp_extract(url, r"://[^?#]*/([0-9]{1,18})(?:[./?#]|$)", 1).try_cast("bigint").alias("doc_id"),
        F.lower(whole).alias("host"),
        F.regexp_extract(url, r"://[^/?#]*(/[^/?#]*/)", 1).alias("path"),
    )
