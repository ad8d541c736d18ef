"""What the operators' code promises: no data outside tasks but what a bound holds."""

import re
from pathlib import Path

import pytest

import dinestat.llm

FOLDER = Path(dinestat.llm.__file__).parent

#: Every result that a driver takes up: (module, call, what bounds it).
TAKEN = {
    ("decontaminate", "parts.collect()"): "block_words words of benchmark items",
    ("decontaminate", "bitmaps.collect()"): "a filter of fixed size",
    ("katz", "added.collect()"): "two rows of totals",
    ("language", ".toArrow()"): "the bounded sample of texts",
    ("pii", 'rows.select("slices").mapInArrow(run, "model binary").collect()'): "one trained model",
    ("quality_rules", ".collect()"): "the bounded sample of labelled rows",
    ("sitequality", ".collect()"): "the bounded sample of labelled rows",
    ("toxicity", ".collect()"): "the lexicon of the bounded sample",
    ("toxicity", "ordered.collect()"): "the bounded sample's calibration rows",
    ("whitening", 'added.where(F.col("size") == size).orderBy("place").select("s").collect()'): "dimensions",
    ("whitening", 'summed.orderBy("place").collect()'): "rows of a matrix of dimensions",
}
#: Tables sent to every task: bounded samples, written first, and keys of many rows.
SENT = {("common", "sample"), ("language", "named"), ("neardup", "hubs")}
FORBIDDEN = (
    ".toPandas", ".rdd", "localCheckpoint", "crossJoin", ".persist(", ".cache(", ".coalesce(1)",
    "toLocalIterator", "tempfile",
)


@pytest.mark.parametrize("module", sorted(p.stem for p in FOLDER.glob("*.py")))
def test_only_bounded_results_reach_the_driver(module):
    text = (FOLDER / f"{module}.py").read_text()
    for forbidden in FORBIDDEN:
        assert forbidden not in text, forbidden
    calls = {line.strip() for line in text.splitlines() if ".collect()" in line or ".toArrow()" in line}
    allowed = [call for name, call in TAKEN if name == module]
    for call in calls:
        assert any(a in call for a in allowed), call
    for name in re.findall(r"F\.broadcast\((\w+)", text):
        assert (module, name) in SENT, name
