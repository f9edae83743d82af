"""Splits and conversations against brute force, with dirt, ties and hot groups."""

import json
import random

from provenlake.llm import components, conversations, splits

MANIFEST = "entry_id long, file string, source_sha256 string, operator string, split string, bytes long, component string, old string"


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e, *keys in rows:
        find(("e", e))
        for k, v in enumerate(keys):
            if v is not None:
                parent[find((k, v))] = find(("e", e))
    return {e: find(("e", e)) for e, *_ in rows}


def test_components_against_union_find(spark):
    random.seed(5)
    # one operator holds a third of all rows; files form a long chain
    rows = [(i, f"f{i // 2}" if i % 50 else None, f"s{(i + 1) // 2}" if i < 120 else None, "hot" if i % 3 == 0 and i > 150 else f"o{random.randint(0, 400)}") for i in range(600)]
    df = spark.createDataFrame(rows, "entry_id long, a string, b string, c string")
    from pyspark.sql import functions as F

    got = {r["entry_id"]: r["component"] for r in components.components_of(df, "entry_id", {k: F.col(k) for k in "abc"}).collect()}
    want = union_find(rows)
    assert len(got) == 600
    pairs = {}
    for e, c in got.items():
        assert pairs.setdefault(want[e], c) == c
    assert len(set(pairs.values())) == len(pairs)


def test_broken_ties_and_splits(spark):
    m = [
        (1, "a/X1.jsonl", "AA", "jo.doe1", "Train", 10), (2, "x1.jsonl.gz", None, None, " training", 10), (3, None, "aa", "n/a", "validation", 10), (4, "y", "-", "unknown", "dev", None), (5, "z", "", "JO DOE 1", None, 5),
        (6, "q", "-", "", "test", 1), (7, None, None, None, None, None), (7, None, None, None, None, None), (None, "q", None, None, "train", 1), (8, "q.jsonl", None, "n/a", "TEST", 1),
    ]
    df = spark.createDataFrame([(*r, "c", "o") for r in m], MANIFEST)
    tied = splits.tied_entries(df)
    assert sorted(r["entry_id"] for r in splits.broken_ties(tied).collect()) == [1, 2, 3, 5]
    assert splits.broken_ties(splits.tied_entries(df.limit(0))).count() == 0
    out = splits.stratified_splits(tied).collect()
    assert sorted(r["entry_id"] for r in out) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_split_proportions(spark):
    random.seed(2)
    rows = [(i, f"f{i}", None, f"op{random.randint(0, 800)}x{random.randint(0, 3)}", random.choice(("train", "dev", "test", None)), 4 ** random.randint(3, 9), "", "") for i in range(6000)]
    out = splits.stratified_splits(splits.tied_entries(spark.createDataFrame(rows, MANIFEST))).collect()
    assert len(out) == 6000
    share = {s: sum(r["split"] == s for r in out) / 6000 for s in ("train", "dev", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["dev"] - 0.1) < 0.015 and abs(share["test"] - 0.1) < 0.015
    by = {}
    for r in out:
        assert by.setdefault(r["component"], r["split"]) == r["split"]
    old = {i: s for i, _, _, _, s, *_ in rows}
    for label in ("train", "dev", "test"):
        mine = [r for r in out if old[r["entry_id"]] == label]
        assert abs(sum(r["split"] == "train" for r in mine) / len(mine) - 0.8) < 0.04


def line(kind, *content):
    return {"type": kind, "message": {"content": list(content)}}


def test_conversations(spark):
    text, use, res = lambda t: {"type": "text", "text": t}, lambda i: {"type": "tool_use", "id": i}, lambda i: {"type": "tool_result", "tool_use_id": i}
    files = {
        "good": [line("user", text("hi")), line("assistant", use("a")), line("user", res("a")), line("assistant", text("done")), line("user", text("more")), line("assistant", text("ok"))],
        "empty": [line("user", text(" \n ")), {"type": "user", "message": {"content": ""}}, {"type": "summary"}],
        "no_lines": [],
        "no_reply": [line("user", text("a")), line("user", text("b")), line("assistant", text("c"))],
        "no_reply_end": [line("user", text("a")), line("assistant", text("c")), line("user", text("z"))],
        "open": [line("assistant", use("a")), line("assistant", use("b")), line("user", res("b"))],
        "stray": [line("user", res("q")), line("assistant", text("x"))],
        "reused": [line("assistant", use("a")), line("user", res("a")), line("assistant", use("a"))],
        "plain": [{"type": "user", "message": {"content": "hello"}}, {"type": "assistant", "message": {"content": "yes"}}],
        "long": [line("user", text("go"))] + [line("user", res("n")) for _ in range(70)] + [line("assistant", use("n"))],
    }
    rows, n = [], 0
    for s, ls in files.items():
        for q, x in enumerate(ls, 1):
            n += 1
            rows.append((n, s, q, json.dumps(x)))
    random.shuffle(rows)
    lines = spark.createDataFrame(rows, "line_id long, session string, seq long, raw string")
    fs = spark.createDataFrame([(s,) for s in files] + [("good",), (None,)], "session string")
    msgs = conversations.messages(lines)
    turns, _ = conversations.resolve_turns(msgs)
    found = conversations.defects(fs, msgs, turns)
    assert sorted(map(tuple, found.collect())) == [
        ("empty", "empty"), ("no_lines", "empty"), ("no_reply", "no_reply"), ("no_reply_end", "no_reply"), ("open", "open_call"), ("reused", "reused_id"), ("stray", "stray_result"),
    ]
    kept = sorted((r["session"], r["turn"], r["depth"], r["role"]) for r in conversations.conversations(fs, turns, found).collect())
    assert [k for k in kept if k[0] == "good"] == [("good", 1, 0, "user"), ("good", 1, 1, "assistant"), ("good", 1, 2, "user"), ("good", 1, 3, "assistant"), ("good", 5, 0, "user"), ("good", 5, 1, "assistant")]
    assert max(k[2] for k in kept if k[0] == "long") == 71


def test_placing_with_a_short_tail_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(splits, "TAIL", 3)
    rows = [(i, f"f{i // 2}", None, None, random.Random(i).choice(("train", "dev", "test", None)), 4 ** (3 + i % 6), "", "") for i in range(400)]
    rows += [(7, "f190", None, None, "train", 1, "", "")]  # entry 7 again: ties its group to that of f190
    tied = splits.tied_entries(spark.createDataFrame(rows, MANIFEST))
    group = {r["entry_id"]: r["component"] for r in tied.collect()}
    assert len(group) == 400 and group[7] == group[6] == group[380] == group[381]
    out = splits.stratified_splits(tied).collect()
    by = {}
    assert len(out) == 400 and all(by.setdefault(r["component"], r["split"]) == r["split"] for r in out)
    assert abs(sum(r["split"] == "train" for r in out) / 400 - 0.8) < 0.03
    assert splits.stratified_splits(tied.limit(0)).count() == 0
