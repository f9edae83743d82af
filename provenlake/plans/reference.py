"""Queries of the claim-versus-evidence engine, with their SQL counterparts.

``audit_*`` and ``scope_*`` over the events table run the whole pipeline over JSON text
written from it; the SQL reads the event types directly.  ``session_*`` run the same
operators over the recorded transcripts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.functions import redact
from provenlake.operators import audit, evalkit, flatten, ledger, scope
from provenlake.session import written
from provenlake.sources.adapters import event_lines
from provenlake.sources.transcripts import blocks, canonical_lines, read_table


def plain() -> Column:
    return F.when(F.col("event_type") == "view", "git status").otherwise("pytest -q")


def varied() -> Column:
    k = F.col("event_id") % 5
    return (
        F.when(F.col("event_type") == "view", "git status").when(k == 1, "pytest -q | tail -3").when(k == 2, "pytest -q -k fast")
        .when(k == 3, "pytest -q; true").when(k == 4, "CI=1 python3 -m pytest -q tests").otherwise("pytest -q")
    )


def reaching() -> Column:
    i = F.col("event_id")
    return (
        F.when(F.col("event_type") == "view", F.concat(F.lit("curl -s https://api"), i % 7, F.lit(".host.example/v1")))
        .when(i % 3 == 0, F.concat(F.lit("pip install pkg"), i % 5)).when(i % 3 == 1, F.concat(F.lit("git push origin b"), i % 4))
        .otherwise(F.concat(F.lit("bash deploy"), i % 6, F.lit(".sh")))
    )


def simple_claim() -> Column:
    return F.when(F.col("event_type") == "purchase", "All tests pass.").otherwise("If the tests pass we ship.")


def counted_claim() -> Column:
    return F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), "All 20 tests pass.").otherwise(simple_claim())


def _events(spark: SparkSession, sf_dir: str, command=plain, claim=simple_claim) -> DataFrame:
    return audit.events(blocks(canonical_lines(event_lines(read_table(spark, sf_dir, "events"), command(), claim()))))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.events(blocks(canonical_lines(read_table(spark, sf_dir, "transcript_lines"))))


def _once(ev: DataFrame) -> DataFrame:
    """Events that are read more than once are parsed once, into a written table."""
    return written(ev.drop("input"))[0]


def _rollup(ev: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Events and graded sentences are read several times: both are written once."""
    ev = _once(ev)
    grades, _ = written(audit.graded_sentences(ev))
    return audit.session_rollup(ev, audit.audit(ev, grades), sessions, grades)


def audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_once(_events(spark, sf_dir))).groupBy("verdict").agg(F.count("*").alias("n"))


def audit_varied_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_once(_events(spark, sf_dir, varied, counted_claim))).groupBy("verdict").agg(F.count("*").alias("n"))


def audit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_once(_events(spark, sf_dir, varied, counted_claim))).select("session", "seq", "kind", "text", "verdict", "evidence")


def audit_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(_events(spark, sf_dir)).select("session", "supported", "unsupported", "contradicted", "commands", "parsed_events", "not_asserted", "exit_code")


def tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.paired(_events(spark, sf_dir)).select("session", "tool_id", "use_seq", "result_seq")


def prior_calls_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evalkit.prior_calls(written(_events(spark, sf_dir))[0])
    return c.select("session", "seq", F.array_join(F.transform("calls", lambda x: x["line"].cast("string")), ",").alias("lines"), F.array_join(F.transform("calls", lambda x: F.concat(F.when(x["is_error"], "T").when(~x["is_error"], "F").otherwise("-"), F.length(x["result_tail"]).cast("string"))), ",").alias("results"))


def scope_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.reach(_events(spark, sf_dir, reaching))


def scope_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.opaque(_events(spark, sf_dir, reaching)).select("session", "seq", "command", "why")


def scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.summary(_once(_events(spark, sf_dir, reaching))).select("session", "commands", "hosts", "pushes", "installs", "opaque", "exit_code")


def session_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_once(_recorded(spark, sf_dir)))


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(_recorded(spark, sf_dir), read_table(spark, sf_dir, "transcript_files"))


def session_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scope report says of each recorded file before any effect: events, commands, and exit code 3 where nothing was read."""
    s = scope.summary(_once(_recorded(spark, sf_dir)), read_table(spark, sf_dir, "transcript_files"))
    return s.select("session", "parsed_events", "commands", (F.col("exit_code") == 3).alias("no_transcript"))


def session_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.shown(scope.reach(_recorded(spark, sf_dir))).withColumn("values", F.array_join("values", "\n"))


def scope_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.shown(scope.reach(_events(spark, sf_dir, reaching)), 3).withColumn("values", F.array_join("values", ","))


def session_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.reach(_recorded(spark, sf_dir))


def session_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphans(_recorded(spark, sf_dir))


def session_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.candidates(_recorded(spark, sf_dir)).groupBy("session").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


def session_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.facts_from_audit(session_claims(spark, sf_dir))


def document_chain_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.document_chains(flatten.newest_documents(read_table(spark, sf_dir, "session_docs")))


def _order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    done = F.when(F.col("o_orderstatus") == "F", "shipped").otherwise("")
    return o.select(F.col("o_custkey").alias("chain"), "o_orderkey", "o_orderdate", F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("payload"), ledger.truth(done, F.col("o_orderstatus") == "P", F.lit(False)).alias("truth"))


def fact_truth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_facts(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"))


def fact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.report(_order_facts(spark, sf_dir), "chain")


def hash_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.build_chain(_order_facts(spark, sf_dir).drop("truth"), "chain", ["o_orderdate", "o_orderkey"], "payload")
    return c.groupBy("chain").agg(F.max_by("entry_hash", F.struct("o_orderdate", "o_orderkey")).alias("head"), F.count("*").alias("entries"))


def hash_chain_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.build_chain(_order_facts(spark, sf_dir).drop("truth"), "chain", ["o_orderdate", "o_orderkey"], "payload")
    forged = c.withColumn("payload", F.when(F.col("o_orderkey") % 97 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return ledger.verify_chain(forged, "chain", ["o_orderdate", "o_orderkey"], "payload", F.date_trunc("year", "o_orderdate"))


def conformance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.facts_from_runs(read_table(spark, sf_dir, "conformance_runs"))


def conformance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance_facts(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("modes"), F.count_if(F.col("truth") == "proven").alias("safe"))


def checklist_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.explode(redact.profiles(F.col("text"))).alias("profile"))
    names = spark.createDataFrame([(n,) for n in redact.PROFILES], "profile string")
    return names.join(d.groupBy("profile").agg(F.count("*").alias("n")), "profile", "left").na.fill(0)


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", redact.redacted(F.col("text")).alias("text"))


def redact_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_documents(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(redact.leaks(F.col("text"))).alias("leaks"))


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = redact_documents(spark, sf_dir)
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.when(F.col("doc_id") % 2 == 0, "dev").otherwise("test").alias("split"))


def wide_net_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenlake.functions import grammar

    d = read_table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("kind").agg(F.count_if(F.col("text").rlike("(?i)" + grammar.WIDE_NET)).alias("inside"), F.count("*").alias("n"))


def sample_random_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.sample(read_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 300, "v2")


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "doc_labels").where("label is not null").select("doc_id", "rater", "label").distinct()
    n = r.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("doc_id").agg(F.max_by("label", F.struct("n", "label")).alias("truth"))
    return r.join(top, "doc_id")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.confusion(_rated(spark, sf_dir), "truth", "label")


def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.rates(_rated(spark, sf_dir), "truth", "label")


def pool_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.pool_sessions(_events(spark, sf_dir))


def pool_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "even"), F.when(F.col("n_chars") > 500, "long"), F.lit("all")))).alias("stratum"))
    return evalkit.pool(d, ["doc_id"], "stratum").select("doc_id", F.array_join("strata", ",").alias("strata"))


def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").where("kind is not null").select("doc_id", "kind", "n_chars")
    return evalkit.stratified(d, "kind", [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], 8).select("doc_id", "kind")


def unseen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "manifest").select("entry_id", F.lower("source_sha256").alias("digest"))
    return evalkit.without_seen(m, m.where("entry_id % 10 = 0"), "digest").select("entry_id")


def lesson_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read_table(spark, sf_dir, "documents").where("kind is not null").select(F.col("kind").alias("query_id"), F.regexp_replace("source", "-", " ").alias("text")).distinct()
    return evalkit.hints(q, read_table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("lesson_id"), "text"))


def recorded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(canonical_lines(read_table(spark, sf_dir, "transcript_lines"))).where("btype is null or btype not in ('thinking', 'redacted_thinking', 'image')")
    return b.groupBy("session").agg(F.count("*").alias("blocks"), F.count_if(F.col("btype") == "tool_use").alias("calls"), F.count_if(F.col("btype") == "text").alias("texts"))


def latest_file_of_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest_locks(read_table(spark, sf_dir, "transcript_files").where("client is not null"), "client", ["opened_at", "session"], "session")


def queries() -> dict:
    fs = (
        audit_verdicts, audit_varied_verdicts, audit_claims, audit_session_rollup, tool_pairs, prior_calls_context, scope_reach, scope_opaque, scope_summary,
        session_claims, session_rollup, session_scope, session_reach, session_event_counts, scope_shown, session_orphans, session_candidates, session_facts, document_chain_status,
        fact_truth_counts, fact_report, hash_chain_heads, hash_chain_tamper, conformance_facts, conformance_summary,
        checklist_profiles, redact_documents, redact_leaks, corpus_manifest, wide_net_by_kind, sample_random_stratum, confusion_matrix, detection_rates, latest_file_of_client,
        pool_sessions, pool_strata, stratified_pick, unseen_sources, lesson_hints, recorded_blocks,
    )
    return {f.__name__: f for f in fs}


E_ = "e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
W_ = f"""{E_}, w AS (SELECT *, last_value(CASE WHEN event_type IN ('click', 'error') THEN event_type END IGNORE NULLS) OVER p AS last,
 last_value(CASE WHEN event_type IN ('click', 'error') THEN event_id % 5 END IGNORE NULLS) OVER p AS how,
 last_value(CASE WHEN event_type IN ('click', 'error') THEN pos END IGNORE NULLS) OVER p AS place
 FROM e WINDOW p AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
VERDICT = "CASE last WHEN 'click' THEN 'supported' WHEN 'error' THEN 'contradicted' ELSE 'unsupported' END"
VARIED_VERDICT = "CASE WHEN last IS NULL THEN 'unsupported' WHEN last = 'error' THEN 'contradicted' WHEN how = 2 OR event_id % 3 = 0 THEN 'unsupported' WHEN how IN (1, 3) THEN 'supported_weak' ELSE 'supported' END"
VARIED_COMMAND = "CASE how WHEN 1 THEN 'pytest -q | tail -3' WHEN 2 THEN 'pytest -q -k fast' WHEN 3 THEN 'pytest -q; true' WHEN 4 THEN 'CI=1 python3 -m pytest -q tests' ELSE 'pytest -q' END"
VARIED_EVIDENCE = f"""CASE WHEN last IS NOT NULL THEN 'line ' || (2 * place - 1) || ': ' || CASE WHEN last = 'click' AND how = 2 THEN 'pytest -q -k fast — a filtered run establishes nothing about the tests it did not select'
 WHEN last = 'click' AND event_id % 3 = 0 THEN 'the run reported 12 passed; the claim states 20' ELSE {VARIED_COMMAND} END END"""
FACTS_ = "f AS (SELECT o_custkey AS chain, o_orderkey, o_orderdate, o_orderkey::VARCHAR || ':' || o_orderstatus AS payload, CASE o_orderstatus WHEN 'F' THEN 'proven' WHEN 'P' THEN 'illusion' ELSE 'claimed' END AS truth FROM orders)"
RATED_ = """r AS (SELECT DISTINCT doc_id, rater, label FROM doc_labels WHERE label IS NOT NULL), n AS (SELECT doc_id, label, count(*) AS n FROM r GROUP BY 1, 2),
 t AS (SELECT doc_id, label AS truth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label DESC) AS k FROM n) WHERE k = 1), x AS (SELECT r.*, truth FROM r JOIN t USING (doc_id))"""
RUNS_ = "n AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(started_at, '9999-12-31'::TIMESTAMP), coalesce(result_digest, '')) AS k FROM conformance_runs WHERE run_id IS NOT NULL) WHERE k = 1)"
REACH_CMD = "CASE WHEN event_type = 'view' THEN 'host' WHEN event_id % 3 = 0 THEN 'install' WHEN event_id % 3 = 1 THEN 'push' ELSE 'opaque' END"


BLANK_ = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EVENTS_ = """l AS (SELECT session, seq, min_by(raw, line_id) AS raw FROM transcript_lines WHERE json_valid(raw) AND trim(raw) <> '' AND session IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT session, seq, raw->>'$.type' AS lt, unnest(json_extract(raw, '$.message.content[*]')) AS b, unnest(range(json_array_length(raw, '$.message.content')::BIGINT)) AS idx FROM l WHERE json_type(raw) = 'OBJECT' AND json_type(raw, '$.message.content') = 'ARRAY'),
 x AS (SELECT session, seq, idx, t, CASE t WHEN 'use' THEN b->>'$.id' WHEN 'result' THEN b->>'$.tool_use_id' END AS id, b->>'$.name' AS tool FROM (SELECT *, CASE WHEN lt = 'assistant' AND b->>'$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND b->>'$.text' <> '' THEN 'text'
  WHEN lt = 'assistant' AND b->>'$.type' = 'tool_use' THEN 'use' WHEN lt IS DISTINCT FROM 'assistant' AND b->>'$.type' = 'tool_result' THEN 'result' END AS t FROM b WHERE json_type(b) = 'OBJECT') WHERE t IS NOT NULL)"""


def _redact_sql() -> str:
    out = "text"
    for pattern, value in redact.RULES:
        p, v = pattern.replace("'", "''"), value.replace("$1", "\\1")
        out = f"regexp_replace({out}, '{p}', '{v}', 'g')"
    return out


def oracle_sql() -> dict[str, str]:
    from provenlake.functions import grammar

    words = "".join(f" UNION ALL SELECT '{n}' AS profile, count(*) FILTER (WHERE {' OR '.join(f"contains(lower(text), '{w}')" for w in ws)}) AS n FROM documents" for n, ws in redact.PROFILES.items())
    leak = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p, _ in redact.RULES[: redact.LEAK_RULES])
    wil = "((hit / actual::DOUBLE) + 3.8416 / (2 * actual::DOUBLE) {s} 1.96 * sqrt((hit / actual::DOUBLE) * (1 - hit / actual::DOUBLE) / actual::DOUBLE + 3.8416 / (4 * actual::DOUBLE * actual::DOUBLE))) / (1 + 3.8416 / actual::DOUBLE)"
    return {
        "audit_verdicts": f"WITH {W_} SELECT {VERDICT} AS verdict, count(*) AS n FROM w WHERE event_type = 'purchase' GROUP BY 1",
        "audit_varied_verdicts": f"WITH {W_} SELECT {VARIED_VERDICT} AS verdict, count(*) AS n FROM w WHERE event_type = 'purchase' GROUP BY 1",
        "audit_claims": f"WITH {W_} SELECT user_id::VARCHAR AS session, 2 * pos - 1 AS seq, 'test' AS kind, CASE WHEN event_id % 3 = 0 THEN 'All 20 tests pass.' ELSE 'All tests pass.' END AS text, {VARIED_VERDICT} AS verdict, {VARIED_EVIDENCE} AS evidence FROM w WHERE event_type = 'purchase'",
        "audit_session_rollup": f"""WITH {W_}, v AS (SELECT *, CASE WHEN event_type = 'purchase' THEN {VERDICT} END AS verdict FROM w), s AS (SELECT user_id::VARCHAR AS session,
 count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted,
 count(*) FILTER (WHERE event_type IN ('click', 'error', 'view')) AS commands, count(*) + count(*) FILTER (WHERE event_type IN ('click', 'error', 'view')) AS parsed_events, count(*) FILTER (WHERE event_type = 'signup') AS not_asserted FROM v GROUP BY 1)
 SELECT *, (CASE WHEN contradicted > 0 THEN 2 WHEN unsupported > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code FROM s""",
        "tool_pairs": f"WITH {E_} SELECT user_id::VARCHAR AS session, 't' || event_id AS tool_id, 2 * pos - 1 AS use_seq, 2 * pos AS result_seq FROM e WHERE event_type IN ('click', 'error', 'view')",
        "prior_calls_context": f"""WITH {E_}, c AS (SELECT *, sum((event_type IN ('click', 'error', 'view'))::INT) OVER (PARTITION BY user_id ORDER BY pos) AS n FROM e)
 SELECT t.user_id::VARCHAR AS session, 2 * t.pos - 1 AS seq, coalesce(string_agg((2 * k.pos - 1)::VARCHAR, ',' ORDER BY k.pos), '') AS lines, coalesce(string_agg(CASE k.event_type WHEN 'click' THEN 'F28' WHEN 'error' THEN 'T31' WHEN 'view' THEN '-17' END, ',' ORDER BY k.pos), '') AS results FROM c t LEFT JOIN c k ON k.user_id = t.user_id AND k.event_type IN ('click', 'error', 'view') AND k.n BETWEEN t.n - 11 AND t.n WHERE t.event_type IN ('purchase', 'signup') GROUP BY 1, 2""",
        "scope_reach": f"""WITH {E_}, k AS (SELECT *, {REACH_CMD} AS what FROM e WHERE event_type IN ('click', 'error', 'view'))
 SELECT DISTINCT user_id::VARCHAR AS session, what, CASE what WHEN 'host' THEN 'api' || event_id % 7 || '.host.example' WHEN 'install' THEN 'pkg' || event_id % 5 ELSE 'git push origin b' || event_id % 4 END AS value FROM k WHERE what <> 'opaque'""",
        "scope_opaque": f"WITH {E_} SELECT user_id::VARCHAR AS session, 2 * pos - 1 AS seq, 'bash deploy' || event_id % 6 || '.sh' AS command, 'runs a script file' AS why FROM e WHERE event_type IN ('click', 'error') AND event_id % 3 = 2",
        "scope_summary": f"""WITH {E_}, k AS (SELECT *, CASE WHEN event_type IN ('click', 'error', 'view') THEN {REACH_CMD} END AS what FROM e)
 SELECT user_id::VARCHAR AS session, count(what) AS commands, count(DISTINCT CASE WHEN what = 'host' THEN event_id % 7 END) AS hosts, count(DISTINCT CASE WHEN what = 'push' THEN event_id % 4 END) AS pushes,
 count(DISTINCT CASE WHEN what = 'install' THEN event_id % 5 END) AS installs, count(*) FILTER (WHERE what = 'opaque') AS opaque, (CASE WHEN count(*) FILTER (WHERE what = 'opaque') > 0 THEN 1 ELSE 0 END)::BIGINT AS exit_code FROM k GROUP BY 1""",
        "scope_shown": f"""WITH {E_}, k AS (SELECT *, {REACH_CMD} AS what FROM e WHERE event_type IN ('click', 'error', 'view')),
 r AS (SELECT DISTINCT user_id::VARCHAR AS session, what, CASE what WHEN 'host' THEN 'api' || event_id % 7 || '.host.example' WHEN 'install' THEN 'pkg' || event_id % 5 ELSE 'git push origin b' || event_id % 4 END AS value FROM k WHERE what <> 'opaque')
 SELECT session, what, count(*) AS n, array_to_string(list_sort(list(value))[1:3], ',') AS values FROM r GROUP BY 1, 2""",
        "session_event_counts": f"""WITH {EVENTS_}, f AS (SELECT DISTINCT session FROM transcript_files WHERE session IS NOT NULL)
 SELECT f.session, count(x.t) AS parsed_events, count(*) FILTER (WHERE x.t = 'use' AND tool = 'Bash') AS commands, count(x.t) = 0 AS no_transcript FROM f LEFT JOIN x ON x.session = f.session GROUP BY 1""",
        "session_orphans": f"""WITH {EVENTS_}, p AS (SELECT session, t, lag(t) OVER w AS before, lead(t) OVER w AS after FROM x WHERE t <> 'text' WINDOW w AS (PARTITION BY session, id ORDER BY seq, idx))
 SELECT session, count(*) FILTER (WHERE t = 'use' AND after IS DISTINCT FROM 'result') AS open_calls, count(*) FILTER (WHERE t = 'result' AND before IS DISTINCT FROM 'use') AS stray_results FROM p GROUP BY 1""",
        "session_candidates": rf"""WITH {EVENTS_}, t AS (SELECT session, b->>'$.text' AS text FROM b WHERE lt = 'assistant' AND json_type(b) = 'OBJECT' AND b->>'$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND b->>'$.text' <> ''),
 s AS (SELECT session, regexp_replace(unnest(string_split(regexp_replace(text, '([.!\n]){BLANK_}+', '\1' || chr(1), 'g'), chr(1))), '^{BLANK_}+|{BLANK_}+$', '', 'g') AS s FROM t)
 SELECT session, count(*) FILTER (WHERE m) AS inside, count(*) FILTER (WHERE NOT m) AS outside FROM (SELECT session, regexp_matches(s, '(?i){grammar.WIDE_NET}') AS m FROM s WHERE length(s) >= 4) GROUP BY 1""",
        "conformance_facts": f"""WITH {RUNS_}, x AS (SELECT run_id, tool, unnest(results) AS r, unnest(range(len(results)::BIGINT)) AS pos FROM n WHERE tool IS NOT NULL AND results IS NOT NULL)
 SELECT run_id, tool, pos, r.mode AS mode, CASE WHEN coalesce(r.error, '') <> '' THEN r.mode || ': run errored — ' || r.error WHEN r.distinct IS NULL THEN r.mode || ': no settlement count recorded' ELSE r.mode || ': ' || r.distinct || ' distinct settlement' || CASE WHEN r.distinct = 1 THEN '' ELSE 's' END || ' for one purchase' END AS claim,
 CASE WHEN r.passed THEN 'mode=' || r.mode || ' distinct_settlements=' || coalesce(r.distinct::VARCHAR, 'None') || ' settle_calls=' || coalesce(r.settle_calls::VARCHAR, 'None') ELSE '' END AS evidence,
 CASE WHEN r.passed THEN 'none — this mode is safe' ELSE 'fix the client: re-present the SAME payment authorization on an ambiguous retry instead of minting a new one, then re-run the battery' END AS next, CASE WHEN r.passed THEN 'proven' ELSE 'claimed' END AS truth FROM x WHERE r.mode IS NOT NULL""",
        "fact_truth_counts": f"WITH {FACTS_} SELECT truth, count(*) AS n FROM f GROUP BY 1",
        "fact_report": f"""WITH {FACTS_}, s AS (SELECT chain, count(*) FILTER (WHERE truth = 'proven') AS done, count(*) FILTER (WHERE truth <> 'proven') AS open, 0::BIGINT AS blocked, count(*) FILTER (WHERE truth = 'illusion') AS illusions FROM f GROUP BY 1)
 SELECT *, (CASE WHEN open > 0 THEN 1 WHEN done = 0 THEN 2 ELSE 0 END)::BIGINT AS gate_strict, (CASE WHEN open > 0 THEN 1 ELSE 0 END)::BIGINT AS gate FROM s""",
        "hash_chain_heads": f"WITH {FACTS_}, l AS (SELECT chain, list(payload ORDER BY o_orderdate, o_orderkey) AS p FROM f GROUP BY 1) SELECT chain, list_reduce(list_prepend('genesis', p), lambda a, b: sha256(a || '|' || b)) AS head, len(p)::BIGINT AS entries FROM l",
        "hash_chain_tamper": f"WITH {FACTS_}, k AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM f) SELECT chain, count(*) AS entries, min(pos) FILTER (WHERE o_orderkey % 97 = 0) AS first_bad FROM k GROUP BY 1",
        "conformance_summary": f"""WITH {RUNS_}, d AS (SELECT * FROM n WHERE tool IS NOT NULL AND results IS NOT NULL), x AS (SELECT tool, unnest(results) AS r FROM d)
 SELECT tool, count(*) AS modes, count(*) FILTER (WHERE r.passed) AS safe FROM x WHERE r.mode IS NOT NULL GROUP BY 1""",
        "checklist_profiles": words.removeprefix(" UNION ALL "),
        "redact_documents": f"SELECT doc_id, {_redact_sql()} AS text FROM documents WHERE text IS NOT NULL",
        "redact_leaks": f"WITH d AS (SELECT {_redact_sql()} AS text FROM documents WHERE text IS NOT NULL) SELECT count(*) AS documents, count(*) FILTER (WHERE {leak}) AS leaks FROM d",
        "corpus_manifest": f"WITH d AS (SELECT doc_id, {_redact_sql()} AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM d",
        "wide_net_by_kind": f"SELECT kind, count(*) FILTER (WHERE regexp_matches(text, '(?i){grammar.WIDE_NET}')) AS inside, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "sample_random_stratum": "SELECT doc_id FROM documents ORDER BY sha256('v2' || doc_id::VARCHAR), doc_id LIMIT 300",
        "confusion_matrix": f"WITH {RATED_} SELECT truth, label, count(*) AS n FROM x GROUP BY 1, 2",
        "detection_rates": f"""WITH {RATED_}, a AS (SELECT truth AS label, count(*) AS actual, count(*) FILTER (WHERE truth = label) AS hit FROM x GROUP BY truth), p AS (SELECT label, count(*) AS found FROM x GROUP BY 1),
 b AS (SELECT label, coalesce(actual, 0) AS actual, coalesce(found, 0) AS found, coalesce(hit, 0) AS hit FROM a FULL JOIN p USING (label))
 SELECT label, actual, found, hit, round(hit / nullif(actual, 0), 3) AS recall, round(hit / nullif(found, 0), 3) AS precision, round(greatest(0.0, {wil.format(s='-')}), 3) AS recall_low, round(least(1.0, {wil.format(s='+')}), 3) AS recall_high FROM b""",
        "pool_sessions": "SELECT user_id::VARCHAR AS session, count(*) FILTER (WHERE event_type IN ('click', 'error', 'view')) AS bash_calls, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS texts FROM events GROUP BY 1 HAVING bash_calls >= 3 AND texts >= 8",
        "pool_strata": "SELECT doc_id, 'all' || CASE WHEN doc_id % 2 = 0 THEN ',even' ELSE '' END || CASE WHEN coalesce(n_chars, 0) > 500 THEN ',long' ELSE '' END AS strata FROM documents",
        "stratified_pick": "SELECT doc_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents WHERE kind IS NOT NULL) WHERE k <= 8",
        "unseen_sources": "SELECT entry_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM manifest s WHERE s.entry_id % 10 = 0 AND lower(s.source_sha256) = lower(m.source_sha256))",
        "lesson_hints": "WITH q AS (SELECT DISTINCT kind AS query_id, unnest(string_split(lower(source), '-')) AS word FROM documents WHERE kind IS NOT NULL) SELECT DISTINCT query_id, item_id AS lesson_id FROM q JOIN eval_items ON length(word) >= 4 AND contains(lower(text), word)",
        "recorded_blocks": """WITH l AS (SELECT session, seq, min_by(raw, line_id) AS raw FROM transcript_lines WHERE json_valid(raw) AND trim(raw) <> '' AND session IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT session, unnest(CASE WHEN json_type(raw, '$.message.content') = 'ARRAY' THEN json_extract(raw, '$.message.content[*]') ELSE [] END) AS b FROM l WHERE json_type(raw) = 'OBJECT'), t AS (SELECT session, b->>'$.type' AS t FROM b)
 SELECT session, count(*) AS blocks, count(*) FILTER (WHERE t = 'tool_use') AS calls, count(*) FILTER (WHERE t = 'text') AS texts FROM t WHERE t IS NULL OR t NOT IN ('thinking', 'redacted_thinking', 'image') GROUP BY 1""",
        "latest_file_of_client": "SELECT client, session FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY opened_at DESC, session DESC) AS k FROM transcript_files WHERE client IS NOT NULL) WHERE k = 1",
    }
