"""Work of Python workers: held a slice at a time, done once, and nothing lost by looking for needed literals first."""

import contextlib
import io

import pyarrow as pa

from corvane.functions import workers
from corvane.operators import chunking, extraction


def plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def test_batches_that_leave_a_worker_are_bounded(spark):
    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, work, schema):
            return work

    batch = pa.RecordBatch.from_pydict({"document_id": [f"d{i}" for i in range(200)], "content": ["word " * 1000] * 200})  # one input batch
    for chunks, least in ((chunking.legacy_chunks(Caught(), 200, 0), 25), (chunking.chunks(Caught(), child=20, overlap=0, parent=40), 50), (chunking.evidence_units(Caught(), 20, 40), 25)):
        sizes = [p.num_rows for p in chunks([batch])]
        assert max(sizes) <= workers.ROWS_OUT < sum(sizes) and sum(sizes) >= 200 * least


def test_entities_of_odd_letters(spark):
    text = "ſwg123 and Kns IBM MQ 9.1.0, domİno, hatſ; İTM NullPointerException ABC-12"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "none of these")], "document_id string, content string")
    got = {(r.kind, r.name) for r in extraction.entities(docs).collect()}
    import re

    assert got == {(k, m[0]) for k, p, _ in extraction.FAMILIES for m in re.finditer(p, text)} and ("document", "ſwg123") in got


def test_relations_find_entities_once(spark):
    docs = spark.createDataFrame([("a", "IBM MQ 9.1.0 see swg1. DataPower 10.5"), ("swg2", "swg2 " + "x" * 300 + " 7.0")], "document_id string, content string")
    out = extraction.relations(extraction.entities(docs))
    assert "MapIn" not in plan(out)
    assert {(r.document_id, r.source, r.target) for r in out.collect()} == {("a", "9.1.0", "mq"), ("a", "10.5", "datapower"), ("a", "a", "swg1")}


def test_review_units_without_a_pandas_group_each(spark):
    parts = spark.createDataFrame([("a", 1, "x" * 25), ("a", 0, "y" * 4), ("a", 2, "z" * 3), ("b", 0, "")], "document_id string, ordinal int, body string")
    out = extraction.review_units(parts, most=10, overlap=2)
    assert "Pandas" not in plan(out)
    assert sorted((r.document_id, r.unit, r.text) for r in out.collect()) == [("a", 0, "yyyy"), ("a", 1, "x" * 10), ("a", 2, "x" * 10), ("a", 3, "x" * 9), ("a", 4, "zzz")]
