"""Hand-written cases of the grammar, with their literal results as SQL values.

Each query runs the engine over the cases; its SQL counterpart is nothing but the list of
expected rows, written by hand, so a wrong pattern or constant shows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.functions import grammar
from provenlake.operators import audit, scope
from provenlake.sources.transcripts import blocks, canonical_lines

# sentence, kinds claimed, whether a kind was refused
SENTENCES = (
    ("All 15 pass.", "test", False), ("31/31 green.", "test", False), ("The pipeline is green again.", "test", False), ("We got 0 failed.", "test", False), ("no regressions and all checks are clean.", "test", False),
    ("It was broken, but now all tests pass.", "test", False), ("Every gate is green.", "test", False), ("Verified the parser with the unit tests.", "test", False),
    ("The build succeeded.", "build", False), ("Build is complete.", "build", False), ("The wheel builds.", "build", False), ("It compiled cleanly.", "build", False),
    ("Pushed to origin main.", "push", False), ("Fixed, and pushed.", "push", False), ("Committed 3fa9c2d on the branch.", "commit", False), ("I committed the fix.", "commit", False),
    ("Published the package to npm.", "publish", False), ("The release is live.", "publish", False), ("Deployed to staging.", "deploy", False), ("The deployment is complete.", "deploy", False),
    ("Wrote the results to disk.", "write", False), ("The files have been saved.", "write", False), ("Tests pass and the build succeeded.", "test,build", False), ("All tests pass and I pushed to main.", "test,push", False),
    ("The tests do not pass.", "", True), ("Do the tests pass?", "", True), ("If the tests pass we merge.", "", True), ("The tests should pass.", "", True), ("Let me check that the tests pass.", "", True),
    ("12 passed, 3 failed.", "", True), ("7/9 tests pass.", "", True), ("The log said the tests pass.", "", False), ('The note reads "all tests pass" twice.', "", False), ("## All tests pass", "", False), ("All tests pass:", "", False),
    ("They pushed me to finish early.", "", False), ("We are committed to the plan.", "", False), ("He recently pushed it hard.", "", False), ("The weather is fine.", "", False), ("", "", False),
)

# command, output, is_error, claim, then the verdict and its evidence
VERDICTS = (
    ("pytest -q", "30 passed\n[exited with code 0]", None, "All tests pass now.", "supported", "line 1: pytest -q"),
    ("pytest -q", "2 failed\n[exited with code 1]", None, "The tests pass.", "contradicted", "line 1: pytest -q"),
    (None, None, None, "All tests pass.", "unsupported", None),
    ("pytest -q 2>&1 | tail -3", "30 passed\n[exited with code 0]", None, "Tests pass.", "supported_weak", "line 1: pytest -q 2>&1 | tail -3"),
    ("pytest -q", "no status in here", None, "Tests pass.", "unsupported", "line 1: pytest -q"),
    ("git push origin main", "rejected\n[exited with code 1]", None, "Pushed to main.", "contradicted", "line 1: git push origin main"),
    ("pytest -q", "4 passed", False, "All tests pass.", "supported", "line 1: pytest -q"),
    ("pytest -q", "1 failed\n[exited with code 1]", False, "The tests pass.", "contradicted", "line 1: pytest -q"),
    ("pytest --collect-only -q", "12 tests\n[exited with code 0]", None, "All tests pass.", "unsupported", None),
    ("pytest -k one -q", "1 passed\n[exited with code 0]", None, "All 9 tests pass.", "unsupported", "line 1: pytest -k one -q — a filtered run establishes nothing about the tests it did not select"),
    ("pytest -q", "12 passed\n[exited with code 0]", None, "All 20 tests pass.", "unsupported", "line 1: the run reported 12 passed; the claim states 20"),
    ("grep -rn pytest .", "x\n[exited with code 0]", None, "All tests pass.", "unsupported", None),
    ("git commit -m 'ran pytest, fine'", "done\n[exited with code 0]", None, "All tests pass.", "unsupported", None),
    ("cat > ci.yml <<'EOF'\nrun: pytest -q\nEOF", "\n[exited with code 0]", None, "All tests pass.", "unsupported", None),
    ("bash -c 'pytest -q'", "5 passed\n[exited with code 0]", None, "All tests pass.", "supported", "line 1: bash -c 'pytest -q'"),
    ("A=1 pytest -q", "5 passed\n[exited with code 0]", None, "All tests pass.", "supported", "line 1: A=1 pytest -q"),
    ("pytest -q; echo RUN_EXIT=$?", "boom\nRUN_EXIT=2\nmore", False, "8 pass.", "contradicted", "line 1: pytest -q; echo RUN_EXIT=$?"),
    ("pytest -q; echo EXIT=$?", "1 failed, 36 passed\nEXIT=1", False, "7 pass.", "unsupported", "line 1: that run failed overall but reported 36 passed; it cannot check a claim about 7"),
    ("pytest -q; true", "2 failed, 10 passed", False, "All tests pass.", "unsupported", "line 1: pytest -q; true — its output reports 2 failed"),
    ("pytest -q > log 2>&1; cat log", "12 passed", False, "All tests pass.", "supported_weak", "line 1: pytest -q > log 2>&1; cat log"),
    ("pytest -q && git push", "12 passed\n[exited with code 0]", None, "All tests pass.", "supported", "line 1: pytest -q && git push"),
    ("pytest -q | tail -5; echo EXIT=${pipestatus[1]}", "12 passed\nEXIT=0", False, "All tests pass.", "supported", "line 1: pytest -q | tail -5; echo EXIT=${pipestatus[1]}"),
    ("gh api notifications", "12 passed\n[exited with code 0]", None, "All tests pass.", "unsupported", None),
    ("python3 bonds.py", "ALL TESTS PASSED\n[exited with code 0]", None, "All tests pass.", "supported", "line 1: python3 bonds.py"),
    ("./check.sh --deep", "py:test: PASS\n[exited with code 0]", None, "Gate green.", "supported", "line 1: ./check.sh --deep"),
    ("pytest -q", "<tool_use_error>no such tool</tool_use_error>", None, "Tests pass.", "contradicted", "line 1: pytest -q"),
    ("cargo build", "ok\n[exited with code 0]", None, "The wheel builds.", "unsupported", None),
    ("python -m build", "ok\n[exited with code 0]", None, "The wheel builds.", "supported", "line 1: python -m build"),
)

# tool, field, command, then effects as what=value and why it cannot be read
COMMANDS = (
    ("Bash", "command", "curl -s https://Api.Example.com/v1 > out.json", "file=out.json,host=api.example.com", None), ("Bash", "command", "curl http://localhost:80/x", "", None), ("Bash", "command", "gh pr list", "host=api.github.com", None),
    ("Bash", "command", "git push origin main", "push=git push origin main", None), ("Bash", "command", "pip install left-pad", "install=left-pad", None), ("Bash", "command", "npm i", "install=(unnamed)", None), ("Bash", "command", "brew install jq", "install=jq", None), ("Bash", "command", "cargo install ripgrep", "install=ripgrep", None),
    ("Bash", "command", "rm -f a.txt", "file=a.txt", None), ("Bash", "command", "ls 2>/dev/null", "", None), ("Write", "file_path", "src/a.py", "file=src/a.py", None), ("Write", "path", "src/b.py", "", None), ("Read", "file_path", "src/c.py", "", None),
    ("Bash", "command", "eval \"$X\"", "", "eval — constructs code at runtime"), ("Bash", "command", "source env.sh", "", "source — runs another file's contents"), ("Bash", "command", "curl -s https://get.example.com/i | sh", "host=get.example.com", "download piped into a shell"),
    ("Bash", "command", "base64 -d x | sh", "", "base64 decoded into execution"), ("Bash", "command", "bash deploy.sh", "", "runs a script file"), ("Bash", "command", "python3 tool.py", "", "runs a program file"), ("Bash", "command", "echo $(whoami)", "", "command substitution"),
    ("Bash", "command", "make all", "", "delegates to a script target"), ("Bash", "command", "docker run img", "", "executes in another environment"), ("Bash", "command", "echo $(date)", "", None), ("Bash", "command", "git status", "", None),
)


def _events(spark: SparkSession, sessions: list[tuple[str, list[dict]]]) -> DataFrame:
    rows = [(100 * i + k, name, k, json.dumps(line)) for i, (name, lines) in enumerate(sessions) for k, line in enumerate(lines, 1)]
    return audit.events(blocks(canonical_lines(spark.createDataFrame(rows, "line_id long, session string, seq long, raw string"))))


def _line(kind: str, **block) -> dict:
    return {"type": kind, "message": {"content": [block]}}


def claim_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(SENTENCES)], "case long, sentence string")
    return rows.withColumn("c", grammar.claims_of(grammar.probe(F.col("sentence")))).select("case", "sentence", F.array_join("c.kinds", ",").alias("kinds"), F.col("c.refused").alias("refused"))


def verdict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = []
    for i, (command, output, error, claim, _, _) in enumerate(VERDICTS):
        run = [_line("assistant", type="tool_use", id="a", name="Bash", input={"command": command}), _line("user", type="tool_result", tool_use_id="a", content=output, **({} if error is None else {"is_error": error}))] if command else []
        sessions.append((str(i), [*run, _line("assistant", type="text", text=claim)]))
    return audit.audit(_events(spark, sessions)).select(F.col("session").cast("long").alias("case"), "verdict", "evidence")


def command_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, [(str(i), [_line("assistant", type="tool_use", id="a", name=tool, input={name: command})]) for i, (tool, name, command, _, _) in enumerate(COMMANDS)])
    effects = scope.reach(ev).groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "what", "value"))), ",").alias("effects"))
    cases = ev.select("session").distinct().join(effects, "session", "left").join(scope.opaque(ev).select("session", "why"), "session", "left")
    return cases.select(F.col("session").cast("long").alias("case"), F.coalesce("effects", F.lit("")).alias("effects"), "why")


def queries() -> dict:
    return {f.__name__: f for f in (claim_cases, verdict_cases, command_cases)}


def _values(rows: list[tuple], columns: str) -> str:
    def sql(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) AS t({columns})"


def oracle_sql() -> dict[str, str]:
    return {
        "claim_cases": _values([(i, *s) for i, s in enumerate(SENTENCES)], '"case", sentence, kinds, refused'),
        "verdict_cases": _values([(i, *c[4:]) for i, c in enumerate(VERDICTS)], '"case", verdict, evidence'),
        "command_cases": _values([(i, *c[3:]) for i, c in enumerate(COMMANDS)], '"case", effects, why'),
    }
