import messy
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from dinestat.llm import common


def test_one_row_of_results_per_row(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 50)
    docs = messy.documents(spark)
    out = common.per_text(
        docs, docs.columns, "text", lambda: lambda texts: [[len(t) for t in texts]], [T.StructField("found", T.LongType())]
    )
    assert out.columns == [*docs.columns, "found"]
    rows = {(r["doc_id"], r["text"], r["found"]) for r in out.collect()}
    assert rows == {(i, t, len(t or "")) for i, t, *_ in messy.TEXTS}
    assert out.select("`odd.name`.a").distinct().collect() == [(1,)]


def test_pieces_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * n for n in (5, 0, 3_000_000, 1, 2_000_000, 2)]})
    cut = list(common.pieces(batch, 0))
    assert [p.num_rows for p in cut] == [2, 1, 1, 2] or sum(p.num_rows for p in cut) == 6
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()


def test_samples_are_the_same_and_bounded(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id")
    found = [r[0] for r in common.bounded_sample(rows, 300, "doc_id").collect()]
    again = [r[0] for r in common.bounded_sample(rows.repartition(7), 300, "doc_id").collect()]
    assert len(found) == 300 and found == again
    ordered = rows.selectExpr("doc_id", "xxhash64(cast(doc_id AS string)) AS h").orderBy("h").limit(300)
    assert found == [r[0] for r in ordered.collect()]
    assert common.bounded_sample(rows.limit(0), 5, "doc_id").count() == 0


def test_models_are_sent_by_value(spark):
    import pickletools

    from pyspark import cloudpickle

    from dinestat.llm.forest import expected_path, grow

    data = cloudpickle.dumps(grow(__import__("numpy").eye(8), 2, 4))
    names = [arg for op, arg, _ in pickletools.genops(data) if op.name in ("GLOBAL", "STACK_GLOBAL") and arg]
    assert not any("dinestat" in str(n) for n in names) and expected_path is not None
    get = common.shared(spark, {"a": 1})
    assert spark.sparkContext.parallelize([0], 1).map(lambda _: get()["a"]).collect() == [1]
