"""URL filters: rules first, then words of the host and path judged by naive Bayes.

Host names run words together. A unigram model, counted over the text of all pages, and
Viterbi search split them into the likeliest words. A join hands each distinct run of
letters the words that it holds, so the model is whole and no task or driver has all of
it. Multinomial naive Bayes scores those tokens. It is counted over all urls: those whose
host holds a warning word are examples to block, those without one that no rule blocks
are examples to allow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinestat.llm.common import column, counted, per_text, settle

#: Rules (host and path) with their verdicts.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
#: Words of a host that make its urls examples to block.
WARNINGS = frozenset(
    "ads adult bet bets bonus casino cheap click deal discount escort gambling loan loans "
    "lottery pills poker porn promo sex spam track tracker viagra win".split()
)
#: Longest word of the unigram model: no part of a host name may have more letters.
LONGEST = 63


def parts_of(url: str) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path; both empty without ``://``."""
    found = re.search(r"://([^/?#]*)([^?#]*)", url)
    if not found:
        return "", ""
    return found[1].encode().lower().decode(), found[2]


def fitting_rule(host: str, path: str, rules: dict[str, str]) -> str | None:
    """The longest rule whose host is the host or a parent and whose path begins the path."""
    best = None
    for rule in rules:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            if best is None or len(rule) > len(best):
                best = rule
    return best


class Segmenter:
    """Splits letters into the words whose unigram probabilities multiply to most."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {word: -math.log(n / self.total) for word, n in counts.items()}
    def _cost(self, word: str) -> float:
        known = self.cost.get(word)
        return known if known is not None else math.log(self.total + 1) + 2.3 * len(word)

    def split(self, letters: str) -> tuple[str, ...]:
        """The words of a run of letters."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(letters) + 1):
            best.append(
                min(
                    (best[start][0] + self._cost(letters[start:end]), start)
                    for start in range(max(0, end - LONGEST), end)
                )
            )
        words, at = [], len(letters)
        while at:
            words.append(letters[best[at][1] : at])
            at = best[at][1]
        return tuple(reversed(words))


def bare(host: str) -> str:
    """The host without a user before it and a port behind it."""
    return host.rpartition("@")[2].partition(":")[0]


def host_names(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``name``: all hosts and their parents of two parts or more, each once."""

    def count():
        def counter(batch):
            found = Counter()
            for url in batch.column(0).to_pylist():
                parts = bare(parts_of(url)[0]).split(".")
                found.update(".".join(parts[at:]) for at in range(len(parts) - 1))
            return found

        return counter

    urls = pages.select(F.coalesce(column(pages, url_col).cast("string"), F.lit("")).alias("url"))
    return counted(urls, count, "name string").select("name")


def word_counts(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Words, ``key``, ``n`` and ``proper`` over the visible text of all pages.

    A word is proper unless it is only seen as a name: printed as part of a host of the
    table, or on pages whose own host has it as a run of letters, all under one name.
    """
    hidden = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)

    def count():
        words = re.compile(rf"(?<![a-z])[a-z]{{2,{LONGEST}}}(?![a-z])")
        dotted = re.compile(r"(?<![a-z0-9-])[a-z0-9-]++(?:\.[a-z0-9-]++)+")

        def counter(batch):
            found = Counter()
            for html, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = bare(parts_of(url)[0]).split(".")
                own = {  # runs of letters with the name from their part on
                    run: ".".join(parts[at:])
                    for at in range(len(parts)) for run in words.findall(parts[at])
                }
                text = hidden.sub(" ", html).lower()
                for name in dotted.findall(text):
                    found.update((w, name, own.get(w, "")) for w in words.findall(name))
                for word, n in Counter(words.findall(dotted.sub(" ", text))).items():
                    found[word, "", own.get(word, "")] += n
            return found

        return counter

    def filled(name: str):
        return F.coalesce(column(pages, name).cast("string"), F.lit(""))

    text = pages.select(filled(html_col).alias("html"), filled(url_col).alias("url"))
    found = settle(counted(text, count, "key string, name string, own string"))
    hosts = host_names(pages, url_col).withColumn("is_host", F.lit(True))
    # Printed on other pages, a host of the table tells nothing of its words.
    told = F.when((F.col("own") != "") | F.col("is_host").isNull(), F.col("own"))
    printed = found.where("name <> ''").join(hosts, "name", "left").select("key", "n", told.alias("own"))
    plain = found.where("name = ''").select("key", "n", "own")
    proper = (F.min("own") == "") | (F.min("own") < F.max("own"))
    return plain.unionByName(printed).groupBy("key").agg(
        F.sum("n").alias("n"), F.coalesce(proper, F.lit(False)).alias("proper")
    )


def substrings(runs: DataFrame, own: bool) -> DataFrame:
    """``run`` and ``key``: each run's substrings of 2 to LONGEST letters, each once.

    With ``own`` a run counts as its own substring.
    """

    def emit(batches):
        for batch in batches:
            for run in batch.column(0).to_pylist():
                keys = list({
                    run[a:b] for a in range(len(run)) for b in range(a + 2, min(len(run), a + LONGEST) + 1)
                    if own or b - a < len(run)
                })
                yield pa.RecordBatch.from_pydict(
                    {"run": pa.array([run] * len(keys), pa.string()), "key": pa.array(keys, pa.string())}
                )

    return runs.select("run").mapInArrow(emit, "run string, key string")


def segmented(runs: DataFrame, words: DataFrame, total: int, own: bool = True) -> DataFrame:
    """``run``, its ``words``, and ``known``: which of them are in the lexicon ``words``.

    A task gets only those words that a run holds, so the lexicon has no bound. ``runs``
    are distinct letters. Without ``own`` a run is no word by itself.
    """
    held = substrings(runs, own).join(words.select("key", "n"), "key")
    lexicons = held.groupBy("run").agg(F.collect_list(F.struct("key", "n")).alias("lexicon"))

    def split(batches):
        for batch in batches:
            out = {"run": [], "words": [], "known": []}
            for run, lexicon in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = {row["key"]: row["n"] for row in lexicon or ()}
                found = Segmenter(counts, total).split(run)
                out["run"].append(run)
                out["words"].append(list(found))
                out["known"].append([w in counts for w in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["run"], pa.string()), pa.array(out["words"], pa.list_(pa.string())),
                 pa.array(out["known"], pa.list_(pa.bool_()))], names=list(out),
            )

    both = runs.select("run").join(lexicons, "run", "left")
    return both.mapInArrow(split, "run string, words array<string>, known array<boolean>")


def lexicon_of(pages: DataFrame, html_col: str, url_col: str, warnings: Iterable[str]) -> tuple[DataFrame, int]:
    """``key`` and ``n`` of all words, and the sum of their counts.

    A name run together that pages print would be likelier as one word than as its words,
    so names that fall into known shorter words are left out; others stay, as do warning
    words, which count once even where no page holds them.
    """
    spark = pages.sparkSession
    warned = spark.createDataFrame([(w, 1, True) for w in sorted(warnings)], "key string, n bigint, proper boolean")
    every = settle(
        word_counts(pages, html_col, url_col).unionByName(warned)
        .groupBy("key").agg(F.sum("n").alias("n"), F.max("proper").alias("proper"))
    )
    total = every.agg(F.sum("n")).first()[0] or 1
    names = every.where("not proper").select(F.col("key").alias("run"))
    made_up = segmented(names, every, total, own=False).where("size(words) > 1 and forall(known, k -> k)")
    return settle(every.join(made_up.select(F.col("run").alias("key")), "key", "left_anti").select("key", "n")), total


def worded(texts: DataFrame, name: str, side: str, splits: DataFrame) -> DataFrame:
    """Distinct texts of column ``name`` with the ``words`` of their letters, in order.

    ``marks`` has the tokens of each run of letters or digits: its words, with a mark for
    unknown ones, or one for a number. ``runs`` are the letters themselves.
    """
    found = F.expr(f"regexp_extract_all(lower(`{name}`), '[a-z]+|[0-9]+', 0)")
    runs = texts.select(name, F.posexplode(found).alias("at", "run")).join(splits, "run", "left")
    marks = F.when(F.col("words").isNull(), F.array(F.lit(f"{side}:#"))).otherwise(
        F.zip_with("words", "known", lambda w, k: F.concat(F.lit(f"{side}:"), F.when(k, w).otherwise("?")))
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "run", "words", marks.alias("marks"))))
    both = texts.join(runs.groupBy(name).agg(ordered.alias("parts")), name, "left")
    none = F.array().cast("array<string>")
    words = F.flatten(F.filter("parts.words", lambda v: v.isNotNull()))
    letters = F.filter("parts.run", lambda r: r.rlike("^[a-z]"))
    return both.select(
        name, F.coalesce(words, none).alias("words"), F.coalesce(letters, none).alias("runs"),
        F.coalesce("parts.marks", F.array().cast("array<array<string>>")).alias("marks"),
    )


def token_odds(tokens: DataFrame, urls: dict[str, int]) -> tuple[DataFrame, float]:
    """``token`` with its ``odds`` for blocking, and the prior log-odds.

    Multinomial naive Bayes with one added to every count; ``tokens`` has ``token`` and how
    often ``block`` and ``allow`` examples hold it, ``urls`` counts the examples.
    """
    counts = settle(tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    sums = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    unseen = math.log(((sums["allow"] or 0) + sums["n"] + 1) / ((sums["block"] or 0) + sums["n"] + 1))
    odds = F.log((F.col("block") + 1) / (F.col("allow") + 1)) + unseen
    return counts.select("token", odds.alias("odds")), math.log((urls["block"] + 1) / (urls["allow"] + 1))


def summed_odds(texts: DataFrame, name: str, odds: DataFrame) -> DataFrame:
    """The odds of each distinct text: the sum over its tokens."""
    each = texts.select(name, F.explode("tokens").alias("token")).join(odds, "token")
    return each.groupBy(name).agg(F.sum("odds").alias(f"{name}_odds"))


def url_filter(
    pages: DataFrame,
    rules: dict[str, str] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    warnings: frozenset[str] = WARNINGS,
) -> DataFrame:
    """A verdict for every url: one row per row of ``pages``.

    Columns: the id, ``host``, ``path``, the longest ``rule`` that fits (else null),
    ``verdict`` (the rule's, else the method's), ``words`` of the host as split, and
    ``block_probability``. A null url, or one without ``://``, has an empty host and path
    and fits no rule. Repeated rows each get the same result. Without pages to learn from,
    names are not split and what no rule judges is allowed or blocked by the prior alone.
    """

    def start():
        def kernel(urls):
            parts = [parts_of(url) for url in urls]
            return [*zip(*parts, strict=True), [fitting_rule(*p, rules) for p in parts]]

        return kernel

    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule")]
    given = settle(per_text(pages, [id_col], url_col, start, fields).toDF("id", "host", "path", "rule"))
    words, total = lexicon_of(pages, html_col, url_col, warnings)
    hosts, paths = settle(given.select("host").distinct()), settle(given.select("path").distinct())
    letters = [
        t.select(F.explode(F.expr(f"regexp_extract_all(lower({n}), '[a-z]+', 0)")).alias("run"))
        for t, n in ((hosts, "host"), (paths, "path"))
    ]
    splits = settle(segmented(letters[0].unionByName(letters[1]).distinct(), words, total))

    # What stands behind the last dot is one token of its own, and none of the host's words.
    ending = F.element_at(F.split("host", "[.]"), -1)
    behind = F.size(F.regexp_extract_all(F.lower(ending), F.lit("[a-z]+|[0-9]+"), F.lit(0)))
    is_word = F.try_element_at("marks", F.lit(-1)) == F.array(F.concat(F.lit("host:"), ending))
    tail = F.when(ending.rlike("^[a-z]{2,3}$") | F.coalesce(is_word, F.lit(False)), ending).otherwise("?")
    front = F.flatten(F.slice("marks", 1, F.size("marks") - behind))
    tokens = F.when(F.col("host") != "", F.concat(F.array(F.concat(F.lit("end:"), tail)), front)).otherwise(front)
    holds = F.arrays_overlap(F.concat("words", "runs"), F.array(*map(F.lit, sorted(warnings))))
    known = settle(
        worded(hosts, "host", "host", splits).select(
            "host", F.concat_ws(" ", "words").alias("words"), holds.alias("warned"), tokens.alias("tokens")
        )
    )
    walked = settle(worded(paths, "path", "path", splits).select("path", F.flatten("marks").alias("tokens")))

    blocking = [rule for rule, verdict in sorted(rules.items()) if verdict == "block"]
    unruled = ~F.coalesce(F.col("rule").isin(blocking), F.lit(False))
    block = F.col("warned").cast("long").alias("block")
    allow = (~F.col("warned") & unruled).cast("long").alias("allow")
    example = given.join(known.select("host", "warned"), "host").select("host", "path", block, allow)
    sums = [F.sum(c).alias(c) for c in ("block", "allow")]
    each = settle(example.groupBy("host", "path").agg(*sums))
    seen = [
        each.groupBy(n).agg(*sums).join(t.select(n, "tokens"), n)
        .select(F.explode("tokens").alias("token"), "block", "allow")
        for n, t in (("host", known), ("path", walked))
    ]
    urls = each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("block", "allow"))).first().asDict()
    odds, prior = token_odds(seen[0].unionByName(seen[1]).where("block + allow > 0"), urls)
    odds = settle(odds)
    host_odds, path_odds = settle(summed_odds(known, "host", odds)), settle(summed_odds(walked, "path", odds))

    judged = (
        given.join(known.select("host", "words"), "host").join(host_odds, "host", "left")
        .join(path_odds, "path", "left")
    )
    whole = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0))
    chance = 1 / (1 + F.exp(-F.least(F.greatest(whole, F.lit(-50.0)), F.lit(50.0))))
    ruled = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        ruled = F.when(F.col("rule") == rule, verdict).otherwise(ruled)
    method = F.when(chance > 0.5, "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(ruled, method).alias("verdict"),
        "words", chance.alias("block_probability"),
    )
