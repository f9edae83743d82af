"""Line reading, drift and flattening: dirt, ties, repeats, empty tables, clashing extra columns."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from provenlake.operators import drift, flatten, ledger
from provenlake.sources.transcripts import all_texts, blocks, canonical_lines, result_texts, text_blocks

SCHEMA = "line_id long, session string, seq long, raw string, text string, block string"  # the last two clash with names used inside


def lines(spark, rows):
    return spark.createDataFrame([(i, s, q, r if r is None or isinstance(r, str) else json.dumps(r, ensure_ascii=False), "x", "y") for i, (s, q, r) in enumerate(rows)], SCHEMA)


def content(*blocks_, kind="user"):
    return {"type": kind, "message": {"content": list(blocks_)}}


def tool_result(**fields):
    return {"type": "tool_result", "tool_use_id": "t", **fields}


def test_canonical_lines(spark):
    raw = content({"type": "text", "text": "a"})
    rows = [("s", 1, '{"cut'), ("s", 1, raw), ("s", 1, raw), ("s", 2, None), ("s", 3, ""), ("s", 4, "5"), (None, 1, raw), ("s", None, raw)]
    got = canonical_lines(lines(spark, rows)).select("session", "seq", "line_id").collect()
    assert sorted(map(tuple, got)) == [("s", 1, 1), ("s", 4, 5)]
    assert canonical_lines(lines(spark, [])).count() == 0


def test_texts_of_every_shape(spark):
    rows = [
        ("s", 1, content({"type": "text", "text": "a"}, {"type": "thinking"}, {"type": "text", "text": ""}, {"type": "text"}, 7)),
        ("s", 2, content(tool_result(content="plain"), tool_result(output={"text": "obj", "lines": 2}), tool_result(body=[{"text": "x"}, {"ref": "r"}, {"text": "y"}]), tool_result(result_text=None))),
        ("s", 3, {"type": "user", "message": {"content": "no blocks"}}),
        ("s", 4, {"type": "user"}),
    ]
    ln = lines(spark, rows)
    assert sorted(map(tuple, text_blocks(ln).select("seq", "block", "text").collect())) == [(1, 0, "a"), (1, 2, "")]
    assert sorted(map(tuple, result_texts(ln).select("seq", "block", "text").collect())) == [(2, 0, "plain"), (2, 1, "obj"), (2, 2, "x\ny")]
    assert all_texts(ln).count() == 5


def test_schema_changes(spark):
    T = dt.datetime(2026, 1, 1)
    files = [("a", "c", T), ("b", "c", T + dt.timedelta(days=1)), ("none", "c", T + dt.timedelta(days=2)), ("d", "c", T + dt.timedelta(days=40)), ("b", "c", T + dt.timedelta(days=1)), ("x", None, T), ("y", "other", T)]
    rows = [
        ("a", 1, content(tool_result(content="s", is_error=True))),
        ("b", 1, content(tool_result(output=["l"], cwd="/", is_error=None))),
        ("d", 1, content(tool_result(output="s", failed="no", truncated=True))),
        ("x", 1, content(tool_result(content="s"))),
        ("y", 1, content(tool_result(content="s"))),
    ]
    ln = canonical_lines(lines(spark, rows))
    schemas = drift.file_schemas(blocks(ln).where("btype = 'tool_result'"), "session", "b")
    f = spark.createDataFrame(files, "session string, client string, opened_at timestamp")
    got = sorted(map(tuple, drift.schema_changes(f, schemas).collect()))
    assert got == sorted(
        [
            ("b", "content", "renamed"), ("b", "content", "retyped"), ("b", "cwd", "added"), ("b", "is_error", "removed"),
            ("d", "content", "retyped"), ("d", "cwd", "removed"), ("d", "is_error", "added"), ("d", "truncated", "added"),
        ]
    )
    assert drift.schema_changes(f.limit(0), schemas).count() == 0
    one = drift.consistent_results(blocks(ln).where("btype = 'tool_result'"))
    assert {(r["session"], r["content"], r["is_error"]) for r in one.collect()} == {("a", "s", True), ("b", "l", None), ("d", "s", False), ("x", "s", None), ("y", "s", None)}


def test_flatten(spark):
    facts = [
        {"id": "f1", "meta": {"mode": "m"}, "artifacts": [None, {"meta": {"result_digest": "d1"}}, {"meta": json.dumps({"deep": {"result_digest": "d2"}})}]},
        {"id": "f2", "meta": json.dumps({"mode": "t"}), "artifacts": {"meta": {"a": {"b": {"result_digest": "d3"}}}}},
        {"id": "f3", "meta": None, "artifacts": None},
        {"id": "f4", "artifacts": [{"kind": "k"}]},
        None,
    ]
    T = dt.datetime(2026, 1, 1)
    docs = [
        ("new", T, json.dumps({"facts": [{"id": "old", "artifacts": [{}]}]})), ("new", T + dt.timedelta(1), json.dumps({"facts": facts})), ("new", T + dt.timedelta(2), '{"facts": ['),
        ("keyed", T, json.dumps({"facts": {"k1": {"artifacts": [{}]}}})), ("text", T, json.dumps(json.dumps({"facts": facts[1:2]}))), ("null", T, None), ("scalar", T, "3"), (None, T, "{}"),
    ]
    df = spark.createDataFrame(docs, "session_id string, saved_at timestamp, doc string")
    got = sorted(map(tuple, flatten.artifacts_table(df).collect()))
    assert got == sorted(
        [("new", "f1", 1, -1, "m", "d1"), ("new", "f1", 2, -1, "m", "d2"), ("new", "f2", 0, -1, "t", "d3"), ("new", "f4", 0, -1, "", ""), ("keyed", "k1", 0, -1, "", ""), ("text", "f2", 0, -1, "t", "d3")]
    )
    assert flatten.artifacts_table(df.limit(0)).count() == 0
    assert {(r["root"], r["node"], r["artifacts"]) for r in flatten.facts_table(df).collect()} >= {("new", "f1", 3), ("new", "f3", 0), ("text", "f2", 1)}


def test_chains(spark):
    rows = [("c", i, f"p{i}") for i in range(20)] + [("d", 0, "q")]
    e = ledger.build_chain(spark.createDataFrame(rows, "chain string, pos int, payload string"), "chain", ["pos"], "payload")
    ok = {r["chain"]: r["first_bad"] for r in ledger.verify_chain(e, "chain", ["pos"], "payload").collect()}
    assert ok == {"c": None, "d": None}
    for damage, where in ((F.col("pos") == 7, 7), (F.col("pos") == 0, 0)):
        bad = e.withColumn("payload", F.when(damage & (F.col("chain") == "c"), "x").otherwise(F.col("payload")))
        assert {r["chain"]: r["first_bad"] for r in ledger.verify_chain(bad, "chain", ["pos"], "payload").collect()} == {"c": where, "d": None}
    gone = e.where("not (chain = 'c' and pos = 5)")
    assert {r["chain"]: r["first_bad"] for r in ledger.verify_chain(gone, "chain", ["pos"], "payload").collect()}["c"] == 5


@pytest.mark.parametrize("change, status", [(lambda f: f, "ok"), (lambda f: [{**f[0], "evidence": "x"}, *f[1:]], "tampered"), (lambda f: f[::-1], "tampered"), (lambda f: [], "empty"), (lambda f: [{"id": "a"}], "unchained")])
def test_document_chain(change, status):
    prev, facts = "genesis", []
    for i in range(3):
        body = {"id": f"f{i}", "evidence": "é", "created_at": 1.5 + i}
        h = ledger.entry_hash(prev, body)
        facts.append({**body, "prev_hash": prev, "entry_hash": h})
        prev = h
    assert ledger._document_status(json.dumps({"facts": change(facts), "chain_head": prev}))[1] == status
