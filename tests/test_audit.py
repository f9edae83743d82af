"""Verdicts, claims, commands and scope against expectations written by hand."""

import json

from pyspark.sql import functions as F

from provenlake.functions import grammar as G
from provenlake.operators import audit, scope
from provenlake.sources.transcripts import blocks, canonical_lines

SCHEMA = "line_id long, session string, seq long, raw string"


def use(i, cmd, tool="Bash", key="command"):
    return {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": i, "name": tool, "input": {key: cmd}}]}}


def result(i, body, err=None):
    b = {"type": "tool_result", "tool_use_id": i, "content": body}
    return {"type": "user", "message": {"content": [b | ({} if err is None else {"is_error": err})]}}


def said(text):
    return {"type": "assistant", "message": {"content": [{"type": "text", "text": text}]}}


def events(spark, sessions):
    rows, n = [], 0
    for name, lines in sessions.items():
        for seq, line in enumerate(lines, 1):
            n += 1
            rows.append((n, name, seq, line if isinstance(line, str) else json.dumps(line)))
    return audit.events(blocks(canonical_lines(spark.createDataFrame(rows, SCHEMA))))


OK, BAD = "\n[exited with code 0]", "\n[exited with code 1]"
# command, output, is_error, claim, verdicts allowed
CASES = [
    ("pytest -q", "30 passed" + OK, None, "All tests pass now.", {"supported"}),
    ("pytest -q", "2 failed" + BAD, None, "Done! The tests pass.", {"contradicted"}),
    (None, None, None, "Build succeeds and tests are green.", {"unsupported"}),
    ("python -m pytest -q 2>&1 | tail -3", "30 passed" + OK, None, "Tests pass.", {"supported_weak"}),
    ("pytest -q", "lines without a status", None, "Tests pass.", {"unsupported"}),
    ("git push origin main", "rejected" + BAD, None, "Pushed to main.", {"contradicted"}),
    ("pytest -q", "4 passed", False, "All tests pass now.", {"supported"}),
    ("pytest -q", "1 failed" + BAD, False, "The tests pass.", {"contradicted"}),
    ("pytest --collect-only -q", "12 tests" + OK, None, "All tests pass.", {"unsupported", "contradicted"}),
    ("pytest -k one_thing -q", "1 passed" + OK, None, "All 271 tests pass.", {"unsupported"}),
    ("grep -rn pytest .", "x" + OK, None, "All tests pass.", {"unsupported"}),
    ("python3 -m pytest -q tests", "12 passed" + OK, None, "All 12 tests pass.", {"supported"}),
    ("pytest -q -m fast", "12 passed" + OK, None, "All 12 tests pass.", {"unsupported"}),
    ("npx tsc -p .", "error" + "\n[exited with code 2]", None, "Wheel builds cleanly.", {"unsupported"}),
    ("git commit -m 'ran pytest: 27 passed'", "ok" + OK, None, "All 27 tests pass.", {"unsupported"}),
    ("cat > ci.yml <<'EOF'\n- run: pytest -q\nEOF", "" + OK, None, "All tests pass.", {"unsupported"}),
    ("bash -c 'pytest -q'", "5 passed" + OK, None, "All tests pass.", {"supported"}),
    ("pytest -q; echo PYTEST_EXIT=$?", "oops\nPYTEST_EXIT=2\nmore", False, "8 pass.", {"contradicted"}),
    ("pytest -q; echo EXIT=$?", "1 failed, 36 passed\nEXIT=1", False, "7 pass.", {"unsupported"}),
    ("pytest -q; echo EXIT=$?", "1 failed, 36 passed\nEXIT=1", False, "All tests pass.", {"contradicted"}),
    ("pytest -q; true", "2 failed, 10 passed", False, "All tests pass.", {"unsupported"}),
    ("pytest -q > f 2>&1; cat f", "12 passed", False, "All tests pass.", {"supported_weak"}),
    ("pytest -q; echo EXIT=$?", "12 passed\nEXIT=0", False, "All tests pass.", {"supported"}),
    ("pytest -q && git push", "12 passed" + OK, None, "All tests pass.", {"supported"}),
    ("pytest -q | tail -5; echo EXIT=${pipestatus[1]}", "12 passed\nEXIT=0", False, "All tests pass.", {"supported"}),
    ("gh api notifications", "12 passed" + OK, None, "All tests pass.", {"unsupported"}),
    ("python3 bond_pricing.py", "ALL TESTS PASSED" + OK, None, "All tests pass.", {"supported"}),
    ("./check.sh --deep", "py:test: PASS" + OK, None, "All checks are green.", {"supported"}),
]


def test_verdicts(spark):
    sessions = {}
    for i, (cmd, out, err, claim, _) in enumerate(CASES):
        sessions[f"s{i:02}"] = ([use("a", cmd), result("a", out, err)] if cmd else []) + [said(claim)]
    got = {}
    for r in audit.audit(events(spark, sessions)).collect():
        got.setdefault(r["session"], set()).add(r["verdict"])
    wrong = {i: (c[0], c[3], got.get(f"s{i:02}")) for i, c in enumerate(CASES) if not got.get(f"s{i:02}") or not got[f"s{i:02}"] <= c[4]}
    assert wrong == {}


def test_order_of_evidence(spark):
    s = {
        "fixed": [use("a", "pytest -q"), result("a", "1 failed" + BAD), use("b", "pytest -q"), result("b", "3 passed" + OK), said("Fixed, tests pass.")],
        # the result comes after the claim but the call came before: it counts
        "late": [use("a", "pytest -q"), said("All tests pass."), result("a", "3 passed" + OK)],
        # call after the claim: no evidence
        "after": [said("All tests pass."), use("a", "pytest -q"), result("a", "3 passed" + OK)],
        # the last result in arrival order decides
        "crossed": [use("a", "pytest -q"), use("b", "pytest -q tests"), result("b", "3 passed" + OK), result("a", "1 failed" + BAD), said("All tests pass.")],
        "orphan": [result("zz", "3 passed" + OK), said("All tests pass.")],
        "two": [use("a", "git push"), result("a", "done" + OK), said("Tests pass and I pushed to main.")],
        "dirt": ["not json", '{"type": "assistant"', "5", "", said("All tests pass.")],
    }
    ev = events(spark, s)
    got = {(r["session"], r["kind"]): r["verdict"] for r in audit.audit(ev).collect()}
    assert got == {
        ("fixed", "test"): "supported", ("late", "test"): "supported", ("after", "test"): "unsupported", ("crossed", "test"): "contradicted",
        ("orphan", "test"): "unsupported", ("two", "test"): "unsupported", ("two", "push"): "supported", ("dirt", "test"): "unsupported",
    }
    codes = {r["session"]: r["exit_code"] for r in audit.session_rollup(ev, audit.audit(ev)).collect()}
    assert codes["fixed"] == 0 and codes["crossed"] == 2 and codes["after"] == 1
    assert {r["session"]: (r["open_calls"], r["stray_results"]) for r in audit.orphans(ev).collect()}["orphan"] == (0, 1)


SENTENCES = [
    ("All 15 pass.", ["test"]), ("69/69 green.", ["test"]), ("CI green on both workflows.", ["test"]), ("0 failed.", ["test"]),
    ("47 tests pass and not one exercises the real format.", ["test"]), ("It was failing, but it all passes now.", ["test"]),
    ("Build is finished.", ["build"]), ("Fixed and pushed.", ["push"]), ("Committed abc1234.", ["commit"]), ("Deployed to production.", ["deploy"]),
    ("Published the package to npm.", ["publish"]), ("The tests do not pass.", []), ("Do the tests pass?", []), ("If the tests pass we ship.", []),
    ("79 passed, 8 failed.", []), ("8/9 pass.", []), ("The agent said tests pass.", []), ('He wrote "all tests pass" twice.', []),
    ("# All tests pass", []), ("All tests pass:", []), ("They pushed me to finish.", []), ("We are committed to the plan.", []), ("Let me run the tests, then confirm they pass.", []),
]


def test_claims(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SENTENCES)], "i int, s string")
    got = {r["i"]: list(r["c"]["kinds"]) for r in df.select("i", G.claims_of(G.probe(F.col("s"))).alias("c")).collect()}
    assert {s: got[i] for i, (s, _) in enumerate(SENTENCES)} == dict(SENTENCES)


def test_scope(spark):
    ev = events(
        spark,
        {
            "s": [
                use("1", "curl -s https://Api.Example.com/v1 > out.json"), use("2", "curl http://localhost:80/x"), use("3", "bash deploy.sh"), use("4", "git push origin main"),
                use("5", "pip install left-pad"), use("6", "npm i"), use("7", "src/a.py", "Write", "file_path"), use("8", "gh pr list"), use("9", "git status 2>/dev/null"),
            ]
        },
    )
    got = {(r["what"], r["value"]) for r in scope.reach(ev).collect()}
    assert got == {
        ("host", "api.example.com"), ("host", "api.github.com"), ("file", "out.json"), ("push", "git push origin main"), ("install", "left-pad"), ("install", "(unnamed)"), ("file", "src/a.py"),
    }
    assert [r["seq"] for r in scope.opaque(ev).collect()] == [3]
