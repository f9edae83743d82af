"""Files, command line, ledger and attestation against hand-written expectations."""

import json

from pyspark.sql import functions as F

from provenlake import __main__ as cli
from provenlake.operators import attest, audit, drift, evalkit, ledger, scope
from provenlake.sources import files
from provenlake.sources.transcripts import blocks, canonical_lines


def line(kind, **block):
    return json.dumps({"type": kind, "message": {"content": [block]}})


SAMPLE = [
    line("assistant", type="tool_use", id="1", name="Bash", input={"command": "pytest -q"}), line("user", type="tool_result", tool_use_id="1", content="9 passed\n[exited with code 0]"), "", "not json",
    line("assistant", type="text", text="All tests pass."), line("assistant", type="tool_use", id="2", name="Bash", input={"command": "git push"}), line("user", type="tool_result", tool_use_id="2", content="rejected\n[exited with code 1]"),
    line("assistant", type="text", text="Pushed to main. The build succeeded."), '{"type": "assis', line("assistant", type="tool_use", id="3", name="Write", input={"file_path": "a.py"}), line("user", type="tool_result", tool_use_id="3", content="ok", is_error=False),
]


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "one.jsonl").write_bytes("\n".join(SAMPLE).encode() + b"\r\n\xff\n")
    (tmp_path / "none.jsonl").write_text("\nplain text\n")
    got = files.transcript_lines(spark, str(tmp_path)).where("session = 'one'").orderBy("seq").collect()
    assert [r["seq"] for r in got][: len(SAMPLE)] == list(range(1, len(SAMPLE) + 1)) and got[0]["raw"] == SAMPLE[0]
    assert files.transcript_files(spark, str(tmp_path)).count() == 2
    assert cli.main(["audit", str(tmp_path / "one.jsonl")], spark) == 2
    text = capsys.readouterr().out
    assert "one: 3 commands, 1 supported, 0 supported_weak, 1 unsupported, 1 contradicted" in text and "one:5 supported" in text and "line 1: pytest -q" in text
    assert cli.main(["audit", str(tmp_path), "--json"], spark) == 3
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {r["session"]: r["exit_code"] for r in rows if "exit_code" in r} == {"one": 2, "none": 3}
    assert cli.main(["scope", str(tmp_path / "one.jsonl")], spark) == 0
    assert "push (1): git push" in capsys.readouterr().out


FACTS = "session string, pos long, id string, claim string, evidence string, next string, kind string, meta string, created_at double, artifacts string"


def facts(spark):
    rows = [("s", i, f"f{i}", f"Größe {i}", "seen" if i else "", "go on", "step", '{"b":1,"a":"é"}', 1.5, '[{"kind":"log","value":"x","meta":{}}]') for i in range(5)] + [("t", 0, "g", "c", "e", "n", "review", "{}", 0.0, "[]")]
    return spark.createDataFrame(rows, FACTS)


def test_saved_documents_and_gate(spark, tmp_path, capsys):
    docs = {r["session"]: r["doc"] for r in ledger.session_documents(facts(spark), "session", ["pos"]).collect()}
    v = json.loads(docs["s"])
    prev = "genesis"
    for f in v["facts"]:
        body = {k: x for k, x in f.items() if k not in ("prev_hash", "entry_hash")}
        assert f["prev_hash"] == prev and f["entry_hash"] == ledger.entry_hash(prev, body)
        prev = f["entry_hash"]
    assert v["chain_head"] == prev and v["summary"] == {"done": 4, "open": 1} and v["law"] == ledger.LAW
    edited = docs["s"].replace('"evidence": "seen"', '"evidence": "forged"', 1)
    reversed_ = json.dumps(v | {"facts": v["facts"][::-1]})
    df = spark.createDataFrame([("ok", docs["s"]), ("edited", edited), ("reversed", reversed_), ("appended", json.dumps(v | {"facts": [*v["facts"], v["facts"][0]]})), ("wiped", json.dumps(v | {"facts": []}))], "root string, doc string")
    got = {r["root"]: (r["status"], r["position"]) for r in ledger.document_chains(df).collect()}
    assert got["ok"] == ("ok", None) and got["edited"] == ("tampered", 1) and got["reversed"] == ("tampered", 0) and got["appended"] == ("tampered", 5) and got["wiped"][0] == "empty"
    (tmp_path / "t.json").write_text(docs["t"])
    assert cli.main(["check", str(tmp_path)], spark) == 0 and "green" in capsys.readouterr().out
    (tmp_path / "s.json").write_text(docs["s"])
    assert cli.main(["check", str(tmp_path)], spark) == 1
    (tmp_path / "e.json").write_text(edited)
    assert cli.main(["check", str(tmp_path)], spark) == 3 and "chain tampered at 1" in capsys.readouterr().out


def test_attestation(spark):
    # test vector 1 of RFC 8032
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert attest.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert attest.sign(seed, b"").hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert attest.holds(attest.public_key(seed), attest.sign(seed, b"m"), b"m") and not attest.holds(attest.public_key(seed), attest.sign(seed, b"m"), b"n") and not attest.holds(b"", b"", b"")
    docs = ledger.session_documents(facts(spark), "session", ["pos"]).select(F.col("session").alias("root"), "doc")
    docs = docs.unionByName(docs.where("root = 's'").select(F.lit("bad").alias("root"), F.replace("doc", F.lit("Größe"), F.lit("Grosse")).alias("doc"))).unionByName(docs.where("root = 's'").select(F.lit("bad2").alias("root"), F.replace("doc", F.lit("\"seen\""), F.lit("\"x\"")).alias("doc")))
    env = attest.attested(docs, seed)
    assert {r["root"]: r["status"] for r in env.collect()}["bad2"] == "tampered"
    good = env.where("envelope is not null")
    status = {r["root"]: r["status"] for r in attest.verified(good, docs, attest.public_key(seed)).collect()}
    assert status["s"] == status["t"] == "verified"
    assert {r["status"] for r in attest.verified(good, docs, attest.public_key(b"0" * 32)).collect()} == {"bad_signature"}
    log = good.where("root = 's'").select("root", attest.payload_digest().alias("payload_sha256"), F.lit(7).alias("log_index")).unionByName(good.where("root = 't'").select("root", F.lit("00").alias("payload_sha256"), F.lit(8).alias("log_index")))
    assert {r["root"]: r["status"] for r in attest.anchored(good, log).collect() if r["root"] in "st"} == {"s": "anchored", "t": "mismatch"}


def test_lessons_backfill_and_tampering(spark):
    rows = [("c", i, f"l{i}", "p", "lesson", "proof", "next", "", ["t"], i, None if i < 2 else "ab" * 8) for i in range(3)]
    df = spark.createDataFrame(rows, "chain string, pos long, id string, problem string, lesson string, proof string, next_domino string, source_domino string, tags array<string>, uses long, known string")
    c = ledger.chained(df, "chain", ["pos"], ledger.lesson_link, kept="known")
    got = {r["pos"]: (r["prev_hash"], r["entry_hash"]) for r in c.collect()}
    assert got[0][0] == "genesis" and got[1][0] == got[0][1] and got[2] == (got[1][1], "ab" * 8) and len(got[0][1]) == 16
    whole = ledger.chained(df.drop("known"), "chain", ["pos"], ledger.lesson_link)
    assert ledger.lesson_stats(whole, "chain", ["pos"], F.floor(F.col("pos") / 2)).collect()[0].asDict() == {"chain": "c", "lessons": 3, "total_uses": 3, "chain_ok": True}
    assert ledger.lesson_status(whole.withColumn("proof", F.when(F.col("pos") == 2, " ").otherwise(F.col("proof"))), "chain", ["pos"]).collect()[0]["first_bad"] == 2
    assert ledger.lesson_status(whole.limit(0), "chain", ["pos"]).count() == 0


def test_prior_calls_see_only_results_before_them(spark, monkeypatch):
    monkeypatch.setattr(evalkit, "BLOCK", 4)
    lines = []
    for i in range(20):
        lines.append(line("assistant", type="tool_use", id=str(i), name="Bash", input={"command": f"c{i}"}))
        if i % 2:
            lines.append(line("user", type="tool_result", tool_use_id=str(i - 1), content=f"r{i - 1}" * 3))
        lines.append(line("assistant", type="text", text=f"t{i}"))
    ev = audit.events(blocks(canonical_lines(spark.createDataFrame([(k, "s", k, x) for k, x in enumerate(lines, 1)], "line_id long, session string, seq long, raw string"))))
    got = sorted((r["seq"], [(c["input"], c["result_tail"]) for c in r["calls"]]) for r in evalkit.prior_calls(ev, 3, 4).collect())
    assert len(got) == 20
    for i, (_, calls) in enumerate(got):
        want = [(f"c{k}", (f"r{k}" * 3)[-4:] if k % 2 == 0 and k < i else None) for k in range(max(0, i - 2), i + 1)]
        assert calls == want


def test_sessions_without_events_get_a_row(spark):
    raw = [(1, "a", 1, line("assistant", type="text", text="hello")), (2, "b", 1, "no json"), (3, "c", 1, '{"type": "user"}')]
    ev = audit.events(blocks(canonical_lines(spark.createDataFrame(raw, "line_id long, session string, seq long, raw string"))))
    sessions = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "session string")
    codes = {r["session"]: r["exit_code"] for r in audit.session_rollup(ev, audit.audit(ev), sessions).collect()}
    assert codes == {"a": 0, "b": 3, "c": 3, "d": 3} == {r["session"]: r["exit_code"] for r in scope.summary(ev, sessions).collect()}


def test_types_are_promoted_and_cast(spark):
    block = lambda **f: line("user", type="tool_result", tool_use_id="t", **f)
    raw = [block(content="a", n=1, flag=True, mixed=1, list=[1]), block(output="b", content="c", n=2.5, mixed="x", N=3, list="y"), block(content="d", session="clash", flag=None)]
    r = blocks(canonical_lines(spark.createDataFrame([(i, f"s{i}", i, x) for i, x in enumerate(raw)], "line_id long, session string, seq long, raw string"))).where("btype = 'tool_result'")
    union = {x["field"]: x["promoted"] for x in drift.union_schema(drift.file_schemas(r, "session", "b")).collect()}
    assert union == {"content": "string", "n": "fraction", "N": "integer", "flag": "boolean", "mixed": "string", "list": "string", "session": "string"}
    one = drift.consistent_results(r)
    kinds = {f.name: f.dataType.simpleString() for f in one.schema["fields"].dataType.fields}
    assert kinds["n_2"] == "double" and kinds["N"] == "bigint" and kinds["flag"] == "boolean"
    got = {x["seq"]: x for x in one.collect()}
    # both names in one block: the first is the content, the other stays beside it
    assert got[1]["content"] == "c" and got[1]["fields"]["output"] == "b" and got[0]["fields"]["list"] == "[1]" and got[0]["fields"]["mixed"] == "1" and got[0]["fields"]["n_2"] == 1.0
    assert got[2]["session"] == "s2" and got[2]["fields"]["session"] == "clash" and got[2]["fields"]["flag"] is None
