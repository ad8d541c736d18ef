"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import json
import subprocess
import sys
from functools import partial
from pathlib import Path

import messy
import pytest
from test_decontaminate import brute as brute_windows
from test_neardup import brute_components
from test_packing import checked
from test_pii import brute as brute_spans
from test_quality_rules import brute as brute_counts

import __spark_entry__ as registry
import corpus_pipeline
from dinestat.llm import bilstm_crf, pii

GIVEN = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, GIVEN))
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_quality_rules_stage(stages):
    kept = by_id(stages[1])
    for doc, row in by_id(stages[0]).items():
        n, *_, repeated = brute_counts(row["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert doc not in kept
    assert len(kept) > 0.7 * len(stages[0])
    assert all(by_id(stages[0])[doc] == row for doc, row in kept.items())


def test_near_duplicates_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    assert sorted(by_id(stages[2])) == sorted(set(brute_components(rows)[1]))


def test_decontamination_stage(spark, stages):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{GIVEN}/benchmark.parquet").collect()]
    clean = [r for r in stages[2] if not brute_windows(r["text"], items)[1]]
    assert sorted(stages[3]) == sorted(clean)
    assert len(stages[3]) < len(stages[2])


def test_pii_stage(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    changed = 0
    for doc, row in before.items():
        assert not brute_spans(after[doc]["text"])
        assert after[doc]["n_chars"] == len(after[doc]["text"])
        if not brute_spans(row["text"]) and not any(c in row["text"] for c in "0123456789@"):
            assert after[doc] == row
        changed += after[doc]["text"] != row["text"]
    assert 0 < changed < len(before)


def test_packing_stage(stages):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in stages[4]]
    checked(rows, stages[5], 2048)


def test_the_query_runs_all_stages(spark, stages):
    found = registry.queries()["pipeline"](spark, GIVEN).collect()
    assert sorted((r["doc_id"], r["piece"], r["n_words"]) for r in found) == sorted(
        (r["doc_id"], r["piece"], r["n_words"]) for r in stages[5]
    )


def test_messy_rows_pass_every_stage(spark, tmp_path, monkeypatch):
    # What the tagger finds does not matter here, and it has nothing to find.
    monkeypatch.setattr(pii, "train", partial(bilstm_crf.train, steps=3))
    messy.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    messy.benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (messy.documents(spark), messy.documents(spark).limit(0)):
        names = docs.dtypes
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.dtypes == names


def test_registered_names():
    names = [n for n in registry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None


def test_entry_imports_without_the_subpackage():
    """Where the folder and the pipeline are missing, the other queries stay."""
    code = """
import importlib.abc, json, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "dinestat.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(json.dumps([len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith("op"))]))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    queries, oracles, ops = json.loads(done.stdout.splitlines()[-1])
    assert queries == oracles + 1 and not ops
