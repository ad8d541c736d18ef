"""Registered queries over whole given tables against plain versions."""

import hashlib
import re
import zlib

import pytest
from test_licenses import brute as brute_licenses
from test_neardup import brute_components
from test_packing import checked
from test_pii import brute as brute_spans

import __spark_entry__ as registry
from dinestat.llm import pii, urls

GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{GIVEN}/documents.parquet").collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]


def result(spark, number):
    (name,) = (n for n in registry.queries() if n.startswith(f"op{number}_"))
    return registry.queries()[name](spark, GIVEN)


def test_quality(spark, docs):
    rows = result(spark, 1).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, *_ in docs)
    assert all(0 <= r["score"] <= 1 and r["good"] == (r["score"] >= 0.5) for r in rows)


def test_pii(spark, docs):
    found = {r["doc_id"]: r for r in result(spark, 2).collect()}
    assert len(found) == len(docs)
    for doc, text, *_ in docs:
        base, row = brute_spans(text), found[doc]
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        ordered = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert row["base_sha256"] == hashlib.sha256(ordered.encode()).hexdigest()
        spans = [s for s in row["spans"].split(",") if s]
        assert set(filter(None, ordered.split(","))) <= set(spans)
        assert len(spans) == len(base) + row["n_added"]


def test_licenses(spark, docs):
    found = {r["doc_id"]: tuple(r)[1:6] for r in result(spark, 3).collect()}
    assert found == {i: brute_licenses(t) for i, t, *_ in docs}


def test_near_duplicates(spark, docs):
    prints, ids = brute_components(docs)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, 4).collect()}
    assert found == {d[0]: (f"{p:016x}", i) for d, p, i in zip(docs, prints, ids, strict=True)}


def test_packing(spark, docs):
    checked(docs, result(spark, 5).collect(), 2048)


@pytest.mark.parametrize("number", [6, 7])
def test_held_out(spark, docs, number):
    rows = result(spark, number).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, *_ in docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1


def test_language_of_most(spark, docs):
    known = {i: lang for i, _, lang, _ in docs}
    rows = result(spark, 7).where("held_out").collect()
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in rows) > 0.95 * len(rows)


def test_url_filters(spark):
    given = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{GIVEN}/pages.parquet").collect()}
    rows = result(spark, 9).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(given)
    for r in rows:
        after = given[r["page_id"]].partition("://")[2]
        host = re.split("[/?#]", after)[0].lower()
        path = re.split("[?#]", after[len(host) :])[0]
        assert (r["host"], r["path"]) == (host, path)
        fitting = [
            rule
            for rule in urls.RULES
            if f".{host}".endswith("." + rule.split("/")[0]) and path.startswith(rule[rule.index("/") :])
        ]
        assert r["rule"] == max(fitting, key=len, default=None)
        assert r["verdict"] in ("allow", "block")
        assert r["rule"] is None or r["verdict"] == urls.RULES[r["rule"]]
