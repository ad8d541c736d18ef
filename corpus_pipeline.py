"""The training-text pipeline: quality rules, deduplication, decontamination, PII, packing.

Each stage takes the rows its predecessor kept, as written to Parquet and read again.
``ORACLE_SQL`` is None, as SQL has neither the forest nor the tagger; tests hold every
stage against plain versions.
"""

from __future__ import annotations

from dinestat.llm import decontaminate, neardup, packing, pii, quality_rules
from dinestat.llm.common import settle


def quality_rules_stage(spark, docs, sf_dir):
    """Documents that the rules keep."""
    return quality_rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_stage(spark, docs, sf_dir):
    """One document of each group of near-duplicates, that of the least id."""
    return neardup.deduplicated(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark, docs, sf_dir):
    """All documents, with personal data masked by its kind."""
    return pii.redacted(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of documents and their places in bins."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("near-duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
