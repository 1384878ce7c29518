import json

import pytest
from pyspark.sql import functions as F

from strandloom.plans import pipeline
from strandloom.sources import saved

REGISTER = """Title: North register

--- Page 1 ---
The brass astrolabe was made by Odo Ferren in 1790. It belongs to the Tarrow Museum. {pad}
--- Page 2 ---
The museum keeps a list of loans. Visitors may see it on request."""
GUIDE = """Title: Town guide

The Tarrow Museum stands in Larkhaven near the old quay. {pad} Ferries leave at noon."""
PAD = "The hall opens at nine. Dogs stay outside. Tickets are sold at the gate. The clock strikes every hour."


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([("north.txt", REGISTER.format(pad=PAD)), ("guide.txt", GUIDE.format(pad=PAD)), ("empty.txt", "")], "source string, content string")
    ix = pipeline.Index(spark, str(tmp_path_factory.mktemp("index")), "smoke test")
    failures = pipeline.build(ix, docs, options=pipeline.Options())
    assert [r.source for r in failures.collect()] == ["empty.txt"]
    return ix


@pytest.fixture(scope="module")
def queries(spark):
    q = "In which city would one find the museum that the brass astrolabe belongs to?"
    facts = ["It belongs to the Tarrow Museum.", "The Tarrow Museum stands in Larkhaven"]
    return spark.createDataFrame([("q1", q, facts, "Larkhaven", "bridge"), ("q2", "", [], "x", "null_query")], "query_id string, query string, evidence_facts array<string>, ground_truth string, question_type string")


def test_index_is_sound(index):
    assert {r.check: r.violations for r in pipeline.check(index).collect()}
    assert all(r.violations == 0 for r in pipeline.check(index).collect())
    assert index.read("index_snapshot").first().status == "complete"
    assert index.read("edge_hop").count() > 0 and index.read("edge_next").count() > 0


@pytest.mark.parametrize("options", [{}, {"edges": "none"}, {"edges": "hop_only", "order": "similarity_only"}, {"depth": 0, "channels": "body_only"}, {"depth": 2}, {"semantics": "bridge"}])
def test_both_documents_are_returned(index, queries, options):
    got = pipeline.retrieve(index, queries, pipeline.Options(**options))
    rows = got.where("query_id = 'q1'").collect()
    assert {"north.txt", "guide.txt"} <= {r.source for r in rows} and len(rows) <= 12
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))


def test_answer_and_evaluate(index, queries):
    got = pipeline.retrieve(index, queries)
    ctx = pipeline.contexts(got)
    assert "[[Town guide, Page 1, Chunk 0]]" in ctx.where("query_id = 'q1'").first().context
    a = pipeline.answer(ctx, queries, lambda q, c: ["Final answer: Larkhaven" if "Larkhaven" in x else "?" for x in c])
    e = {r.query_id: r for r in pipeline.evaluate(got, queries, a).collect()}
    assert e["q1"].em == 1 and e["q1"].all_facts_10 == 1
    assert e["q2"].map_10 is None and e["q2"].null_refusal == 1
    d = pipeline.retrieve_dense(index, queries)
    assert d.where("query_id = 'q1'").count() > 0


def test_saved_files(spark, tmp_path):
    m = tmp_path / "q.json"
    m.write_text(json.dumps([{"_id": "a", "query": "x", "evidence_facts": ["f"]}, {"_id": "b", "query": "y"}]))
    assert [r._id for r in saved.query_manifest(spark, str(m), 1).collect()] == ["a"]
    ex = tmp_path / "ex.json"
    ex.write_text('["a", {"query_id": "b"}]')
    assert {r.query_id for r in saved.excluded_ids(spark, str(ex)).collect()} == {"a", "b"}
    ex.write_text('["a", " "]')
    with pytest.raises(Exception, match="blank query id"):
        saved.excluded_ids(spark, str(ex)).collect()
    t = tmp_path / "t.jsonl"
    t.write_text("\n".join(json.dumps(x) for x in ({"sequence": 1, "pid": 1, "event": "e", "query_id": "a", "payload": "p", "payload_sha256": "bad"}, {"sequence": 3, "pid": 1, "event": "e", "query_id": "b", "error": "x"})))
    ev = saved.trace(spark, str(t))
    assert {r.fault: r.n for r in saved.trace_faults(ev).collect()} == {"sequence": 1, "payload": 1}
    assert saved.trace(spark, str(t), errors=True).count() == 1 and saved.one_event_each(ev, "e").count() == 2
    r = tmp_path / "r.jsonl"
    r.write_text("\n".join(json.dumps({"dataset": d, "method": "m", "query_id": str(i)}) for i, d in enumerate("bab")))
    assert {(x.dataset, x.group_no) for x in saved.reader_inputs(spark, str(r)).collect()} == {("b", 0), ("a", 1)}
    res = saved.results(spark, str(r), "query_id string, dataset string")
    assert res.count() == 3
    import numpy as np

    np.savez(tmp_path / "s.npz", samples=np.array([[[[0, 5, -1]]]], np.int32))
    assert {(x.slot, x.node_ix) for x in saved.archived_samples(spark, str(tmp_path / "s.npz")).collect()} == {(0, 0), (1, 5)}
