"""Evidence ledger: facts, truth, hash chains and the gate.

A chain is built by a streaming fold: rows are hash-partitioned by chain and sorted, and
each task folds its rows batch by batch, holding one hash per open chain - never a whole
chain.  One chain is one task's work: each hash needs the one before.  Verification is
parallel: every entry is recomputed from the hash stored before it, which equals the
sequential check because all earlier links are then good; the hash before comes from
stretches of the chain's order, never from a window over a chain.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.operators.drift import with_count, with_previous

GENESIS = "genesis"
RUNGS = ("step", "skill", "decision", "replay", "review", "domino", "lesson")


def canonical(value: object) -> str:
    """Sorted keys, no blanks, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def entry_hash(prev: str, fact: object) -> str:
    return hashlib.sha256(canonical({"prev": prev, "fact": fact}).encode()).hexdigest()


def truth(evidence: Column, illusion: Column, blocked: Column) -> Column:
    """proven before illusion before blocked before claimed."""
    done = F.coalesce(F.trim(evidence) != "", F.lit(False))
    return F.when(done, "proven").when(F.coalesce(illusion, F.lit(False)), "illusion").when(F.coalesce(blocked, F.lit(False)), "blocked").otherwise("claimed")


def report(facts: DataFrame, key: str) -> DataFrame:
    """Per session: done, open, blocked, illusions, gate codes (strict and not).

    ``facts`` has ``key`` and ``truth``.
    """
    t = F.col("truth")
    r = facts.groupBy(key).agg(F.count_if(t == "proven").alias("done"), F.count_if(t != "proven").alias("open"), F.count_if(t == "blocked").alias("blocked"), F.count_if(t == "illusion").alias("illusions"))
    code = F.when((F.col("open") > 0) | (F.col("blocked") > 0), 1)
    return r.withColumn("gate_strict", code.when(F.col("done") == 0, 2).otherwise(0).cast("long")).withColumn("gate", code.otherwise(0).cast("long"))


Link = Callable[[str, dict], str]


def payload_link(payload: str) -> Link:
    return lambda prev, row: hashlib.sha256(f"{prev}|{row[payload]}".encode()).hexdigest()


def fact_of(row: dict) -> dict:
    """The form of a fact that its chain hashes; meta and artifacts are JSON texts in the table."""
    return {**{k: row[k] for k in ("id", "claim", "evidence", "next", "kind", "created_at")}, "meta": json.loads(row["meta"] or "{}"), "artifacts": json.loads(row["artifacts"] or "[]")}


def fact_link(prev: str, row: dict) -> str:
    return entry_hash(prev, fact_of(row))


def lesson_link(prev: str, row: dict) -> str:
    return digest({**{k: row[k] for k in ("id", "problem", "lesson", "proof", "next_domino", "source_domino")}, "prev_hash": prev, "tags": list(row["tags"] or ())})


def decision_link(prev: str, row: dict) -> str:
    return digest({"id": row["id"], "text": row["text"], "by": row["by"], "prev": prev})


def digest(value: object) -> str:
    """The short digest of a canonical value."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:16]


def chained(entries: DataFrame, chain: str, order: list[str], link: Link, kept: str | None = None) -> DataFrame:
    """Adds prev_hash and entry_hash in the chain's order; a hash that column ``kept`` already has stays."""
    cols = list(entries.columns)
    schema = entries.schema.add("prev_hash", "string").add("entry_hash", "string")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prev = object(), GENESIS
        for b in batches:
            before, after = [], []
            for row in b.to_pylist():
                if row[chain] != current:
                    current, prev = row[chain], GENESIS
                before.append(prev)
                prev = (row[kept] if kept else None) or link(prev, row)
                after.append(prev)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*cols, "prev_hash", "entry_hash"])

    return entries.repartition(chain).sortWithinPartitions(chain, *order).mapInArrow(fold, schema)


def build_chain(entries: DataFrame, chain: str, order: list[str], payload: str) -> DataFrame:
    """Adds prev_hash and entry_hash = sha256(prev | payload) in the chain's order."""
    return chained(entries.select("*"), chain, order, payload_link(payload))


def verify_links(entries: DataFrame, chain: str, order: list[str], link: Link, bucket: Column | None = None, also: Column | None = None) -> DataFrame:
    """(chain, entries, first_bad): position from 0 of the first entry that does not hold, null if all do.

    ``bucket`` cuts the order into stretches, ``also`` is a further condition on an entry.
    """
    bucket = F.lit(0) if bucket is None else bucket
    placed = with_count(with_previous(entries.withColumn("_hash", F.col("entry_hash")), chain, order, "_hash", bucket), chain, order, F.lit(True), bucket, "_pos")
    names = list(entries.columns)
    schema = entries.select(chain).schema.add("_pos", "long").add("good", "boolean")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before = [x or GENESIS for x in b.column(b.schema.get_field_index("prev")).to_pylist()]
            ok = [r["prev_hash"] == p and r["entry_hash"] == link(p, r) for r, p in zip(b.select(names).to_pylist(), before)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(chain)), b.column(b.schema.get_field_index("_pos")), pa.array(ok, pa.bool_())], names=[chain, "_pos", "good"])

    extra = F.lit(True) if also is None else F.coalesce(also, F.lit(False))
    checked = placed.where(extra).select(*names, "prev", "_pos").mapInArrow(check, schema).unionByName(placed.where(~extra).select(chain, "_pos", F.lit(False).alias("good")))
    return checked.groupBy(chain).agg(F.count("*").alias("entries"), (F.min(F.when(~F.col("good"), F.col("_pos"))) - 1).cast("long").alias("first_bad"))


def verify_chain(entries: DataFrame, chain: str, order: list[str], payload: str, bucket: Column | None = None) -> DataFrame:
    """As ``verify_links`` for ``build_chain``, in built-in functions."""
    bucket = F.lit(0) if bucket is None else bucket
    e = with_count(with_previous(entries.withColumn("_hash", F.col("entry_hash")), chain, order, "_hash", bucket), chain, order, F.lit(True), bucket, "_pos")
    before = F.coalesce("prev", F.lit(GENESIS))
    good = (F.col("prev_hash") == before) & (F.col("entry_hash") == F.sha2(F.concat_ws("|", before, payload), 256))
    return e.groupBy(chain).agg(F.count("*").alias("entries"), (F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("_pos"))) - 1).cast("long").alias("first_bad"))


def lesson_status(lessons: DataFrame, chain: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """(chain, entries, first_bad) of lessons: links must hold, and proof and next must not be blank."""
    return verify_links(lessons, chain, order, lesson_link, bucket, (F.trim("proof") != "") & (F.trim("next_domino") != ""))


def lesson_stats(lessons: DataFrame, chain: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """(chain, lessons, total_uses, chain_ok)."""
    uses = lessons.groupBy(chain).agg(F.sum("uses").alias("total_uses"))
    return lesson_status(lessons, chain, order, bucket).join(uses, chain).select(chain, F.col("entries").alias("lessons"), "total_uses", F.col("first_bad").isNull().alias("chain_ok"))


def newest(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


LAW = "Nothing is done unless there is evidence. Nothing is finished unless there is a next. Nothing is remembered unless it was done."


def session_documents(facts: DataFrame, session: str, order: list[str], title: str = "session", at: float = 0.0) -> DataFrame:
    """(session, doc): facts chained and written as one JSON document per session, which ``document_chains`` verifies.

    A document is one row, so its session must fit in memory; sessions spread over the tasks.
    """
    entries = chained(facts, session, order, fact_link)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done = None, [], []

        def close() -> None:
            if held:
                proven = sum(bool((f["evidence"] or "").strip()) for f in held)
                doc = {"version": 2, "title": title, "updated_at": at, "law": LAW, "chain_head": held[-1]["entry_hash"], "facts": list(held), "summary": {"done": proven, "open": len(held) - proven}}
                done.append((current, json.dumps(doc)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=[session, "doc"])

        kind = None
        for b in batches:
            kind = b.schema.field(session).type
            for row in b.to_pylist():
                if row[session] != current:
                    close()
                    current, held = row[session], []
                held.append({**fact_of(row), "prev_hash": row["prev_hash"], "entry_hash": row["entry_hash"]})
            if done:
                yield batch()
                done.clear()
        close()
        if done:
            yield batch()

    # chained() leaves each session sorted within one partition
    return entries.mapInArrow(write, facts.select(session).schema.add("doc", "string"))


def lawful(facts: DataFrame, proven: Column | None = None) -> DataFrame:
    """Adds error and next_action: null where a fact may be recorded, else what is wrong and what to do.

    Claim, evidence and next are trimmed.  ``proven`` marks facts that say they are done.
    """
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    trimmed = facts.withColumns({c: t(c) for c in ("claim", "evidence", "next")})
    lie = (F.lit(False) if proven is None else proven) & (F.col("evidence") == "")
    # What the law says.
    error = F.when(lie, "proven() without evidence is a lie").when(F.col("claim") == "", "empty claim").when(F.col("next") == "", "empty next — every fact must say what happens next")
    action = F.when(lie, "pass evidence= or use said()").when(F.col("claim") == "", "say what happened or what was asserted").when(F.col("next") == "", "set next= to the next real action, or 'chain complete'")
    return trimmed.withColumn("error", error).withColumn("next_action", action)


def promoted(facts: DataFrame, evidence: DataFrame, key: str = "id") -> DataFrame:
    """Facts with evidence that arrived later: same id; the evidence of the row, then of the newcomer that sorts first; artifacts appended.

    ``evidence`` has the key, evidence and artifact (JSON text, null for none); blank evidence promotes nothing.
    """
    new = evidence.where(F.trim("evidence") != "").groupBy(key).agg(F.min(F.struct("evidence", "artifact")).alias("_e"))
    own = F.coalesce(F.nullif(F.trim(F.col("artifacts")), F.lit("")), F.lit("[]"))
    joined = F.when(own == "[]", F.concat(F.lit("["), F.col("_e.artifact"), F.lit("]"))).otherwise(F.concat(F.regexp_replace(own, r"\]\s*$", ","), F.col("_e.artifact"), F.lit("]")))
    return (
        facts.join(new, key, "left")
        .withColumn("artifacts", F.when(F.col("_e.artifact").isNotNull(), joined).otherwise(F.col("artifacts")))
        .withColumn("evidence", F.coalesce(F.col("_e.evidence"), F.col("evidence")))
        .select(*facts.columns)
    )


def records(facts: DataFrame) -> DataFrame:
    """(id, rung, kind, truth, summary, claimed, proven, next_action): facts in the form the session keeps them."""
    done = F.coalesce(F.trim("evidence") != "", F.lit(False))
    meta = lambda k: F.coalesce(F.get_json_object("meta", f"$.{k}").isin("true"), F.lit(False))
    rung = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RUNGS)), F.col("kind")), F.lit(0)), F.lit(1))
    return facts.select("id", rung.cast("long").alias("rung"), "kind", truth(F.col("evidence"), meta("illusion"), meta("blocked")).alias("truth"), F.substring("claim", 1, 120).alias("summary"), F.col("claim").alias("claimed"), F.when(done, F.col("evidence")).otherwise("").alias("proven"), F.col("next").alias("next_action"))


def fingerprints(facts: DataFrame) -> DataFrame:
    """Adds fingerprint, the short digest of claim, evidence, next and kind."""

    @F.pandas_udf("string")
    def of(claim: pd.Series, evidence: pd.Series, next_: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([digest({"claim": c, "evidence": e, "next": n, "kind": k}) for c, e, n, k in zip(claim, evidence, next_, kind)], dtype=str)

    return facts.withColumn("fingerprint", of("claim", "evidence", "next", "kind"))


def full_report(facts: DataFrame, key: str, order: list[str], first: int = 10) -> DataFrame:
    """``report`` with total, the next steps of the first open facts, and the badge.

    ``facts`` has ``key``, truth, next and the order.  Only the first open facts of each session are collected.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    heads = facts.where("truth <> 'proven'").withColumn("_n", rank).where(F.col("_n") <= first)
    steps = heads.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "next"))), lambda x: x["next"]).alias("open_next"))
    r = report(facts, key).join(steps, key, "left")
    soft = (F.col("open") == 0) & (F.col("blocked") == 0)
    return r.select(
        "*", (F.col("done") + F.col("open")).alias("total"), soft.alias("soft_ok"), (soft & (F.col("done") > 0)).alias("ok"),
        F.concat(F.col("done").cast("string"), F.lit(" proven · "), F.col("open").cast("string"), F.lit(" open")).alias("badge"),
        F.when(soft & (F.col("done") > 0), "green").when(soft, "yellow").otherwise("red").alias("colour"),
    ).withColumn("open_next", F.coalesce("open_next", F.array().cast("array<string>")))


def report_markdown(row: dict, title: str = "Evidence report") -> str:
    """One row of ``full_report`` as Markdown."""
    lines = [f"## {title}", "", f"**{row['done']} proven** · **{row['open']} open** · **{row['blocked']} blocked** · **{row['illusions']} illusion**", "", f"> {LAW}", ""]
    if row["open_next"]:
        lines += ["### Open: what to do next", *(f"- {n}" for n in row["open_next"]), ""]
    status = "green: no open facts." if row["ok"] else "empty session: record facts first." if row["soft_ok"] else "red: close open or blocked facts before merge."
    return "\n".join([*lines, f"**Status:** {status}"])


def checklist(facts: DataFrame, matched: Column) -> DataFrame:
    """(profile, matched, proven, open): facts with consequential words, by profile; a fact can match several.

    ``facts`` has claim, evidence, truth; ``matched`` gives the array of a fact's profiles.
    """
    rows = facts.select(F.explode(matched).alias("profile"), open_fact().alias("open"))
    return rows.groupBy("profile").agg(F.count("*").alias("matched"), F.count_if(~F.col("open")).alias("proven"), F.count_if("open").alias("open"))


def open_fact() -> Column:
    return (F.coalesce(F.col("evidence"), F.lit("")) == "") | F.col("truth").isin("illusion", "blocked")


def gaps(facts: DataFrame, matched: Column) -> DataFrame:
    """(profile, claim, next, reason) of every open fact of every profile it matches."""
    rows = facts.where(open_fact()).select(F.explode(matched).alias("profile"), "claim", "next")
    return rows.withColumn("reason", F.concat("profile", F.lit(" claim without durable evidence")))


def replayed(recorded: DataFrame, key: str, value: str, recompute: Callable[[pd.Series], pd.Series], source: str) -> DataFrame:
    """(key, recorded, recomputed, stable): a recorded value against what a caller's function makes of the source again."""
    again = F.pandas_udf(recompute, "string")
    return recorded.select(key, F.col(value).alias("recorded"), again(source).alias("recomputed")).withColumn("stable", F.col("recorded").eqNullSafe(F.col("recomputed")))


def document_chains(docs: DataFrame) -> DataFrame:
    """(root, entries, status, position) of newest session documents, with their own canonical hashes.

    status: ok, tampered (with the first position that does not hold), unchained (no hashes) or empty.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, *_document_status(d)) for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["root", "entries", "status", "position"])

    return docs.select("root", "doc").mapInArrow(check, "root string, entries long, status string, position long")


def _document_status(doc: str) -> tuple[int, str, int | None]:
    v = json.loads(doc)
    v = json.loads(v) if isinstance(v, str) else v
    facts = v.get("facts")
    if isinstance(facts, dict):
        facts = list(facts.values())
    if not facts:
        return 0, "empty", None
    if not any(isinstance(f, dict) and f.get("entry_hash") for f in facts):
        return len(facts), "unchained", None
    prev = GENESIS
    for i, f in enumerate(facts):
        body = {k: x for k, x in f.items() if k not in ("prev_hash", "entry_hash")} if isinstance(f, dict) else f
        if not isinstance(f, dict) or f.get("prev_hash") != prev or f.get("entry_hash") != entry_hash(prev, body):
            return len(facts), "tampered", i
        prev = f["entry_hash"]
    return len(facts), "ok" if v.get("chain_head") in (None, prev) else "tampered", None if v.get("chain_head") in (None, prev) else len(facts)


def facts_from_audit(graded: DataFrame) -> DataFrame:
    """One fact per claim: only a supported claim carries evidence, everything else stays open."""
    ok = F.col("verdict").isin("supported", "supported_weak")
    # What the record says.
    note = F.when(F.col("verdict") == "supported_weak", " — WEAK: the exit code reaching this claim passed through a pipe, so it reports the last stage, not the command").otherwise("")
    return graded.select(
        "session", "seq", "idx", "pos", "kind",
        F.col("text").alias("claim"),
        F.when(ok, F.concat(F.coalesce("evidence", F.lit("")), note)).otherwise("").alias("evidence"),
        F.when(ok, "none — the transcript establishes this claim").when(F.col("verdict") == "contradicted", "re-establish this claim from the run itself: its own transcript records a failing exit code beside it").otherwise("re-run the check this claim describes; nothing in the transcript establishes it either way").alias("next"),
    )


def audit_binding(rollup: DataFrame) -> DataFrame:
    """One proven fact per session that binds the record to the transcript: (session, claim, evidence, next).

    ``rollup`` is ``audit.session_rollup`` with ``digest``; sessions that are no transcript are not recorded.
    """
    claims = sum((F.col(c) for c in ("supported", "supported_weak", "unsupported", "contradicted")), F.lit(0))
    # What the record says.
    claim = F.concat(F.lit("transcript audited: "), claims.cast("string"), F.lit(" checkable claims across "), F.col("commands").cast("string"), F.lit(" commands"))
    return rollup.where("exit_code <> 3").select("session", claim.alias("claim"), F.concat(F.lit("transcript_sha256="), "digest", F.lit(" file="), "session").alias("evidence"), F.lit("sign this session, then anyone verifies it with the public key").alias("next"))


def transcript_digests(lines: DataFrame) -> DataFrame:
    """(session, digest): of the text of each transcript in line order; ``lines`` has session, seq, raw.

    A digest of a text needs the whole text in order: the lines of a session meet in one task, and are folded batch by batch.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, h, first = None, None, True

        def row() -> pa.RecordBatch:
            h.update(b'"}')
            return pa.RecordBatch.from_arrays([pa.array([current], pa.string()), pa.array([h.hexdigest()], pa.string())], names=["session", "digest"])

        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != current:
                    if h is not None:
                        yield row()
                    current, h, first = s, hashlib.sha256(b'{"bytes":"'), True
                h.update(json.dumps(("" if first else "\n") + (raw or ""))[1:-1].encode())
                first = False
        if h is not None:
            yield row()

    slim = lines.where("session is not null").select("session", "seq", "raw")
    return slim.repartition("session").sortWithinPartitions("session", "seq").select("session", "raw").mapInArrow(fold, "session string, digest string")


def once_a_run(runs: DataFrame) -> DataFrame:
    """Each run once; of different rows of one run the one that started first."""
    return runs.where("run_id is not null").groupBy("run_id").agg(F.min_by(F.struct(*[c for c in runs.columns if c != "run_id"]), F.struct(F.coalesce("started_at", F.lit("9999-12-31").cast("timestamp")), F.coalesce("result_digest", F.lit("")))).alias("r")).select("run_id", "r.*")


def faulty_runs(runs: DataFrame) -> DataFrame:
    """(run_id, error) of runs that cannot be recorded."""
    error = F.when(F.col("tool").isNull(), "no tool").when(F.coalesce(F.size("results"), F.lit(0)) <= 0, "no results to record").when(F.exists("results", lambda r: r.isNull() | (F.coalesce(r["mode"], F.lit("")) == "")), "a result row has no mode")
    return once_a_run(runs).select("run_id", error.alias("error")).where("error is not null")


def facts_from_runs(runs: DataFrame) -> DataFrame:
    """One fact per mode of a conformance run; a mode that did not pass is open."""
    x = once_a_run(runs).where("tool is not null and results is not null").select("run_id", "tool", F.posexplode("results").alias("pos", "r")).where("r.mode is not null")
    n = F.col("r.distinct")
    # What the claims say.
    claim = (
        F.when(F.coalesce(F.col("r.error"), F.lit("")) != "", F.concat("r.mode", F.lit(": run errored — "), "r.error"))
        .when(n.isNull(), F.concat("r.mode", F.lit(": no settlement count recorded")))
        .otherwise(F.concat("r.mode", F.lit(": "), n.cast("string"), F.lit(" distinct "), F.when(n == 1, "settlement").otherwise("settlements"), F.lit(" for one purchase")))
    )
    safe = F.coalesce(F.col("r.passed"), F.lit(False))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    evidence = F.when(safe, F.concat(F.lit("mode="), "r.mode", F.lit(" distinct_settlements="), text("r.distinct"), F.lit(" settle_calls="), text("r.settle_calls"))).otherwise("")
    step = F.when(safe, "none — this mode is safe").otherwise("fix the client: re-present the SAME payment authorization on an ambiguous retry instead of minting a new one, then re-run the battery")
    return x.select("run_id", "tool", F.col("pos").cast("long").alias("pos"), F.col("r.mode").alias("mode"), claim.alias("claim"), evidence.alias("evidence"), step.alias("next"), F.when(safe, "proven").otherwise("claimed").alias("truth"))


def run_summaries(runs: DataFrame) -> DataFrame:
    """(run_id, total, safe, errored, double_paying): counts of the modes of each run; a mode pays double with more than one settlement."""
    x = once_a_run(runs).where("results is not null").select("run_id", F.explode("results").alias("r")).where("r.mode is not null")
    return x.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if("r.passed").alias("safe"), F.count_if(F.col("r.error").isNotNull()).alias("errored"), F.count_if(F.col("r.distinct") > 1).alias("double_paying"))


def latest_locks(decisions: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """The newest text per key."""
    return decisions.groupBy(key).agg(F.max_by(text, F.struct(*order)).alias(text))
