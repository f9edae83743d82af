"""Queries of the ledger (facts, chains, reports) and of the evaluation kit, with their SQL counterparts.

Facts come from ``orders``, lessons from ``eval_items``, decisions from ``transcript_files``;
claims and labels of the evaluation queries from ``events``.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.functions import redact
from provenlake.operators import attest, audit, evalkit, ledger
from provenlake.plans import reference as R
from provenlake.session import written
from provenlake.sources.adapters import positioned
from provenlake.sources.transcripts import read_table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: shipped ones are done, pending ones illusions; some lack a next step or say no claim."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("session"), F.concat(F.lit("f"), k).alias("id"), k.alias("pos"),
        F.when(k % 41 == 0, " ").otherwise(F.concat(F.lit("order "), k, F.lit(" "), F.when(k % 3 == 0, "refund paid").when(k % 3 == 1, "deploy token").otherwise("sent"))).alias("claim"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("receipt "), k)).otherwise("").alias("evidence"), F.when(k % 37 == 0, "").otherwise(F.concat(F.lit("step "), k % 5)).alias("next"),
        F.element_at(F.array(*map(F.lit, ledger.RUNGS)), (k % 7 + 1).cast("int")).alias("kind"), F.when(F.col("o_orderstatus") == "P", '{"illusion":true}').otherwise("{}").alias("meta"), F.lit(0.0).alias("created_at"), F.lit("[]").alias("artifacts"),
    )


def _lawful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.lawful(_facts(spark, sf_dir)).where("error is null").drop("error", "next_action").withColumn("truth", ledger.truth(F.col("evidence"), F.col("meta").contains("illusion"), F.lit(False)))


def fact_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.lawful(_facts(spark, sf_dir), F.col("pos") % 5 == 0).where("error is not null").select("id", "error", "next_action")


def fact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fingerprints(_lawful(spark, sf_dir)).select("id", "fingerprint")


def fact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.records(_lawful(spark, sf_dir))


def fact_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read_table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 8 == 0, " ").otherwise("seen").alias("evidence"), F.lit('{"kind":"log"}').alias("artifact"))
    return ledger.promoted(_lawful(spark, sf_dir), new).select("id", "evidence", "artifacts")


def fact_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger.full_report(_lawful(spark, sf_dir), "session", ["pos"])
    return r.select("session", "done", "open", "illusions", "total", "ok", "soft_ok", "badge", "colour", F.array_join("open_next", ",").alias("open_next"))


def fact_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.checklist(_lawful(spark, sf_dir), redact.profiles(F.concat_ws(" ", "claim", "evidence", "next")))


def fact_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.gaps(_lawful(spark, sf_dir), redact.profiles(F.concat_ws(" ", "claim", "evidence", "next")))


def ledger_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.chained(_lawful(spark, sf_dir), "session", ["pos"], ledger.fact_link)
    return c.groupBy("session").agg(F.max_by("entry_hash", "pos").alias("head"), F.count("*").alias("entries"))


def saved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = written(ledger.session_documents(_lawful(spark, sf_dir), "session", ["pos"]))
    status = ledger.document_chains(docs.select(F.col("session").cast("string").alias("root"), "doc"))
    done = docs.select(F.col("session").cast("string").alias("root"), F.get_json_object("doc", "$.summary.done").cast("long").alias("done"))
    return status.join(done, "root").select("root", "entries", "done", "status")


SEED = bytes(range(32))  # of the demonstration; give your own


def attestation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of all sessions; every seventh is edited, of another type, or beside a changed document."""
    docs, _ = written(ledger.session_documents(_lawful(spark, sf_dir), "session", ["pos"]))
    docs = docs.select(F.col("session").cast("string").alias("root"), "doc", (F.col("session") % 7).alias("k"))
    env = attest.attested(docs, SEED).join(docs.select("root", "k"), "root")
    payload = F.get_json_object("envelope", "$.payload")
    edited = F.replace("envelope", payload, F.regexp_replace(F.base64(F.concat(F.unbase64(payload), F.lit(" ").cast("binary"))), r"\s", ""))
    sent = env.select("root", F.when(F.col("k") == 1, edited).when(F.col("k") == 2, F.replace("envelope", F.lit("in-toto"), F.lit("other"))).when(F.col("k") == 3, "{").otherwise(F.col("envelope")).alias("envelope"))
    held = docs.select("root", F.when(F.col("k") == 4, F.concat("doc", F.lit(" "))).when(F.col("k") != 5, F.col("doc")).alias("doc"))
    return attest.verified(sent, held, attest.public_key(SEED)).groupBy("status").agg(F.count("*").alias("n"))


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return read_table(spark, sf_dir, "eval_items").select(
        text("corpus").alias("corpus"), "item_id", F.col("item_id").cast("string").alias("id"), text("task").alias("problem"), text("lang").alias("lesson"), F.when(F.col("item_id") % 50 == 7, " ").otherwise("log").alias("proof"),
        F.lit("next").alias("next_domino"), F.lit("").alias("source_domino"), F.array().cast("array<string>").alias("tags"), (F.col("item_id") % 4).alias("uses"),
    )


def lesson_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.chained(_lessons(spark, sf_dir), "corpus", ["item_id"], ledger.lesson_link)
    return c.groupBy("corpus").agg(F.max_by("entry_hash", "item_id").alias("head"))


def lesson_chain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.chained(_lessons(spark, sf_dir), "corpus", ["item_id"], ledger.lesson_link)
    return ledger.lesson_stats(c, "corpus", ["item_id"], F.floor(F.col("item_id") / 64))


def lesson_tampering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ledger.chained(_lessons(spark, sf_dir).withColumn("proof", F.lit("log")), "corpus", ["item_id"], ledger.lesson_link)
    forged = c.withColumn("lesson", F.when(F.col("item_id") % 90 == 11, "forged").otherwise(F.col("lesson")))
    return ledger.lesson_status(forged, "corpus", ["item_id"], F.floor(F.col("item_id") / 64))


def newest_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(_lessons(spark, sf_dir), "corpus", [F.desc("item_id")], 10).select("corpus", "item_id")


def decision_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "transcript_files").where("client is not null and session is not null").groupBy("client", "session").agg(F.min("opened_at").alias("opened_at"), F.coalesce(F.min("recorder"), F.lit("")).alias("text"))
    locks = f.select("client", "opened_at", F.col("session").alias("id"), "text", F.lit("human").alias("by"))
    return ledger.chained(locks, "client", ["opened_at", "id"], ledger.decision_link).groupBy("client").agg(F.max_by("entry_hash", F.struct("opened_at", "id")).alias("head"))


def run_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.faulty_runs(read_table(spark, sf_dir, "conformance_runs"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.run_summaries(read_table(spark, sf_dir, "conformance_runs"))


def replay_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("was"))

    def again(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hashlib.sha256(t.encode()).hexdigest())

    return ledger.replayed(d, "doc_id", "was", again, "text").groupBy("stable").agg(F.count("*").alias("n"))


def transcript_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("session"), F.col("o_orderkey").alias("seq"), F.concat(F.lit('{"k": '), F.col("o_orderkey"), F.lit("}")).alias("raw"))
    return ledger.transcript_digests(lines)


def audit_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R._rollup(R._events(spark, sf_dir)).withColumn("digest", F.lit("d"))
    return ledger.audit_binding(r)


# evaluation -----------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = audit.audit(R._once(R._events(spark, sf_dir, R.varied, R.counted_claim)))
    return graded.select("session", "seq", "text", "verdict", F.concat_ws(":", "session", "seq").alias("claim_id"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sentences with labels: one of seven purchases is missing; every 13th purchase is no claim by its rater."""
    p = positioned(read_table(spark, sf_dir, "events")).where("event_type in ('purchase', 'signup')")
    i = F.col("event_id")
    text = F.when((F.col("event_type") == "purchase") & (i % 3 == 0), "All 20  tests pass.").when(F.col("event_type") == "purchase", "All tests pass. Really").otherwise("If the tests pass we ship.")
    verdict = F.element_at(F.array(*map(F.lit, ("supported", "supported_weak", "unsupported", "contradicted"))), (i % 4 + 1).cast("int"))
    strata = F.array_compact(F.array(F.when(i % 3 == 0, "random"), F.when((F.col("event_type") == "purchase") & (i % 2 == 0), "extracted"), F.when(i % 5 == 0, "outside")))
    return p.where((i % 7 != 0) | (F.col("event_type") != "purchase")).select(
        F.col("user_id").cast("string").alias("session"), (2 * F.col("pos") - 1).alias("seq"), i.alias("id"), text.alias("sentence"), ((F.col("event_type") == "purchase") & (i % 13 != 0)).alias("is_claim"),
        F.when(i % 2 == 0, "test").otherwise("build").alias("label_kind"), verdict.alias("true_verdict"), strata.alias("strata"), F.when(i % 5 == 0, "outside").otherwise("wide").alias("net"),
    )


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _sentences(spark, sf_dir).select("session", "seq", "id", "sentence", "is_claim", "true_verdict")
    return evalkit.match_labels(_claims(spark, sf_dir), labels, "claim_id", ["session", "seq"], "text", "sentence", "id")


def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("claim_id", "id", "true_verdict")


def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalkit.extraction_counts(_matched(spark, sf_dir), "id")


def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _sentences(spark, sf_dir).select("id", "is_claim", F.col("label_kind").alias("kind"), "net")
    return evalkit.label_scores(_matched(spark, sf_dir).where("is_claim"), labels, "id")


def pool_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = written(_sentences(spark, sf_dir))
    stage_b = s.where("id % 9 <> 0").select("id", "true_verdict", (F.col("id") % 17 == 0).alias("not_a_claim"))
    found = _matched(spark, sf_dir).where("id is not null").select("id", "verdict")
    labelled = evalkit.pool_labels(s.where("size(strata) > 0"), s.select("id", "is_claim", F.col("label_kind").alias("kind")), stage_b, found, "id")
    return evalkit.pool_scores(labelled, 5000, 20000)


def clean_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "manifest").select("entry_id", F.lower("source_sha256").alias("digest"), "file")
    return evalkit.without_seen(m, m.where("entry_id % 10 = 0"), "digest", "file", "(?i)\\.gz$").select("entry_id")


def queries() -> dict:
    fs = (
        fact_law, fact_fingerprints, fact_records, fact_promotions, fact_full_report, fact_checklist, fact_gaps, ledger_heads, saved_sessions, attestation_status, lesson_heads, lesson_chain_stats, lesson_tampering, newest_lessons,
        decision_heads, run_faults, run_summaries, replay_drift, transcript_digests, audit_bindings, label_matches, extraction_counts, label_recall, pool_accuracy, clean_sources,
    )
    return {f.__name__: f for f in fs}


FACTS = """o AS (SELECT o_custkey AS session, 'f' || o_orderkey AS id, o_orderkey AS pos, trim(CASE WHEN o_orderkey % 41 = 0 THEN ' ' ELSE 'order ' || o_orderkey || ' ' || CASE o_orderkey % 3 WHEN 0 THEN 'refund paid' WHEN 1 THEN 'deploy token' ELSE 'sent' END END) AS claim,
 CASE o_orderstatus WHEN 'F' THEN 'receipt ' || o_orderkey ELSE '' END AS evidence, CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'step ' || o_orderkey % 5 END AS next, ['step', 'skill', 'decision', 'replay', 'review', 'domino', 'lesson'][(o_orderkey % 7 + 1)::INT] AS kind, o_orderstatus AS s FROM orders),
 f AS (SELECT *, CASE WHEN evidence <> '' THEN 'proven' WHEN s = 'P' THEN 'illusion' ELSE 'claimed' END AS truth FROM o WHERE claim <> '' AND next <> '')"""
WORDS = "list_filter([{}], lambda p: p IS NOT NULL)".format(", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(claim || ' ' || evidence || ' ' || next), '{w}')" for w in ws)} THEN '{n}' END" for n, ws in {"money": ("refund",), "deploy": ("deploy",), "security": ("token",)}.items()))
LESSONS = "l AS (SELECT coalesce(corpus, '') AS corpus, item_id, coalesce(task, '') AS problem, coalesce(lang, '') AS lesson, CASE WHEN item_id % 50 = 7 THEN ' ' ELSE 'log' END AS proof, item_id % 4 AS uses FROM eval_items)"
LABELS = f"""{R.W_}, g AS (SELECT event_id, user_id, pos, {R.VARIED_VERDICT} AS verdict FROM w WHERE event_type = 'purchase'),
 s AS (SELECT event_id AS id, user_id, pos, event_type = 'purchase' AND event_id % 13 <> 0 AS is_claim, CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'build' END AS kind, ['supported', 'supported_weak', 'unsupported', 'contradicted'][(event_id % 4 + 1)::INT] AS tv, event_type = 'purchase' AS bought,
  event_id % 3 = 0 AS random, event_type = 'purchase' AND event_id % 2 = 0 AS extracted, event_id % 5 = 0 AS outside FROM e WHERE event_type IN ('purchase', 'signup') AND (event_id % 7 <> 0 OR event_type <> 'purchase')),
 m AS (SELECT g.user_id || ':' || (2 * g.pos - 1) AS claim_id, verdict, s.* EXCLUDE (user_id, pos) FROM g LEFT JOIN s ON s.id = g.event_id)"""


def oracle_sql() -> dict[str, str]:
    ratio = "round({} / nullif({}, 0), 3)".format
    wil = "round({f}({b}, ((found / random_claims::DOUBLE) + 3.8416 / (2 * random_claims::DOUBLE) {s} 1.96 * sqrt((found / random_claims::DOUBLE) * (1 - found / random_claims::DOUBLE) / random_claims::DOUBLE + 3.8416 / (4 * random_claims::DOUBLE * random_claims::DOUBLE))) / (1 + 3.8416 / random_claims::DOUBLE)), 3)"
    return {
        "fact_law": """WITH o AS (SELECT 'f' || o_orderkey AS id, o_orderkey AS k, o_orderstatus AS s FROM orders) SELECT * FROM (SELECT id, CASE WHEN k % 5 = 0 AND s <> 'F' THEN 'proven() without evidence is a lie' WHEN k % 41 = 0 THEN 'empty claim' WHEN k % 37 = 0 THEN 'empty next — every fact must say what happens next' END AS error,
 CASE WHEN k % 5 = 0 AND s <> 'F' THEN 'pass evidence= or use said()' WHEN k % 41 = 0 THEN 'say what happened or what was asserted' WHEN k % 37 = 0 THEN 'set next= to the next real action, or ''chain complete''' END AS next_action FROM o) WHERE error IS NOT NULL""",
        "fact_fingerprints": f"""WITH {FACTS} SELECT id, left(sha256('{{"claim":"' || claim || '","evidence":"' || evidence || '","kind":"' || kind || '","next":"' || next || '"}}'), 16) AS fingerprint FROM f""",
        "fact_records": f"WITH {FACTS} SELECT id, pos % 7 + 1 AS rung, kind, truth, left(claim, 120) AS summary, claim AS claimed, evidence AS proven, next AS next_action FROM f",
        "fact_promotions": f"WITH {FACTS} SELECT id, CASE WHEN pos % 8 = 4 THEN 'seen' ELSE evidence END AS evidence, CASE WHEN pos % 8 = 4 THEN '[{{\"kind\":\"log\"}}]' ELSE '[]' END AS artifacts FROM f",
        "fact_full_report": f"""WITH {FACTS}, r AS (SELECT session, count(*) FILTER (WHERE truth = 'proven') AS done, count(*) FILTER (WHERE truth <> 'proven') AS open, count(*) FILTER (WHERE truth = 'illusion') AS illusions, coalesce(list(next ORDER BY pos) FILTER (WHERE truth <> 'proven'), []) AS n FROM f GROUP BY 1)
 SELECT session, done, open, illusions, done + open AS total, open = 0 AND done > 0 AS ok, open = 0 AS soft_ok, done || ' proven · ' || open || ' open' AS badge, CASE WHEN open = 0 AND done > 0 THEN 'green' WHEN open = 0 THEN 'yellow' ELSE 'red' END AS colour, array_to_string(n[1:10], ',') AS open_next FROM r""",
        "fact_checklist": f"WITH {FACTS}, x AS (SELECT unnest({WORDS}) AS profile, evidence = '' AS o FROM f) SELECT profile, count(*) AS matched, count(*) FILTER (WHERE NOT o) AS proven, count(*) FILTER (WHERE o) AS open FROM x GROUP BY 1",
        "fact_gaps": f"WITH {FACTS}, x AS (SELECT unnest({WORDS}) AS profile, claim, next FROM f WHERE evidence = '') SELECT *, profile || ' claim without durable evidence' AS reason FROM x",
        "ledger_heads": f"""WITH {FACTS}, j AS (SELECT session, pos, '{{"artifacts":[],"claim":"' || claim || '","created_at":0.0,"evidence":"' || evidence || '","id":"' || id || '","kind":"' || kind || '","meta":' || CASE s WHEN 'P' THEN '{{"illusion":true}}' ELSE '{{}}' END || ',"next":"' || next || '"}}' AS p FROM f),
 l AS (SELECT session, list(p ORDER BY pos) AS p FROM j GROUP BY 1) SELECT session, list_reduce(list_prepend('genesis', p), lambda a, b: sha256('{{"fact":' || b || ',"prev":"' || a || '"}}')) AS head, len(p)::BIGINT AS entries FROM l""",
        "saved_sessions": f"WITH {FACTS} SELECT session::VARCHAR AS root, count(*) AS entries, count(*) FILTER (WHERE truth = 'proven') AS done, 'ok' AS status FROM f GROUP BY 1",
        "attestation_status": f"WITH {FACTS}, d AS (SELECT DISTINCT session % 7 AS k, session FROM f) SELECT CASE k WHEN 1 THEN 'bad_signature' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'subject_mismatch' ELSE 'verified' END AS status, count(*) AS n FROM d GROUP BY 1",
        "lesson_heads": f"""WITH {LESSONS}, j AS (SELECT corpus, list('{{"id":"' || item_id || '","lesson":"' || lesson || '","next_domino":"next","prev_hash":"' || '|' || '","problem":"' || problem || '","proof":"' || proof || '","source_domino":"","tags":[]}}' ORDER BY item_id) AS p FROM l GROUP BY 1)
 SELECT corpus, list_reduce(list_prepend('genesis', p), lambda a, b: left(sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2)), 16)) AS head FROM j""",
        "lesson_chain_stats": f"WITH {LESSONS} SELECT corpus, count(*) AS lessons, sum(uses)::BIGINT AS total_uses, count(*) FILTER (WHERE proof = ' ') = 0 AS chain_ok FROM l GROUP BY 1",
        "lesson_tampering": f"WITH {LESSONS}, k AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY item_id) - 1 AS pos FROM l) SELECT corpus, count(*) AS entries, min(pos) FILTER (WHERE item_id % 90 = 11) AS first_bad FROM k GROUP BY 1",
        "newest_lessons": f"WITH {LESSONS} SELECT corpus, item_id FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY item_id DESC) AS k FROM l) WHERE k <= 10",
        "decision_heads": """WITH f AS (SELECT client, session, min(opened_at) AS t0, coalesce(min(recorder), '') AS text FROM transcript_files WHERE client IS NOT NULL AND session IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT client, list('{"by":"human","id":"' || session || '","prev":"' || '|' || '","text":"' || text || '"}' ORDER BY t0, session) AS p FROM f GROUP BY 1) SELECT client, list_reduce(list_prepend('genesis', p), lambda a, b: left(sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2)), 16)) AS head FROM j""",
        "run_faults": f"""WITH {R.RUNS_} SELECT * FROM (SELECT run_id, CASE WHEN tool IS NULL THEN 'no tool' WHEN coalesce(len(results), 0) = 0 THEN 'no results to record' WHEN len(list_filter(results, lambda r: r IS NULL OR coalesce(r.mode, '') = '')) > 0 THEN 'a result row has no mode' END AS error FROM n) WHERE error IS NOT NULL""",
        "run_summaries": f"WITH {R.RUNS_}, x AS (SELECT run_id, unnest(results) AS r FROM n WHERE results IS NOT NULL) SELECT run_id, count(*) AS total, count(*) FILTER (WHERE r.passed) AS safe, count(*) FILTER (WHERE r.error IS NOT NULL) AS errored, count(*) FILTER (WHERE r.distinct > 1) AS double_paying FROM x WHERE r.mode IS NOT NULL GROUP BY 1",
        "replay_drift": "SELECT doc_id % 10 <> 3 AS stable, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "transcript_digests": """SELECT o_custkey::VARCHAR AS session, sha256('{"bytes":"' || string_agg('{\\"k\\": ' || o_orderkey || '}', '\\n' ORDER BY o_orderkey) || '"}') AS digest FROM orders GROUP BY 1""",
        "audit_bindings": f"""WITH {R.E_} SELECT user_id::VARCHAR AS session, 'transcript audited: ' || count(*) FILTER (WHERE event_type = 'purchase') || ' checkable claims across ' || count(*) FILTER (WHERE event_type IN ('click', 'error', 'view')) || ' commands' AS claim,
 'transcript_sha256=d file=' || user_id AS evidence, 'sign this session, then anyone verifies it with the public key' AS next FROM e GROUP BY user_id""",
        "label_matches": f"WITH {LABELS} SELECT claim_id, id, tv AS true_verdict FROM m",
        "extraction_counts": f"""WITH {LABELS} SELECT count(*) AS extracted, count(*) FILTER (WHERE id IS NULL) AS unmatched, count(*) FILTER (WHERE id IS NOT NULL AND NOT is_claim) AS not_claims, count(*) FILTER (WHERE is_claim) AS true_claims,
 count(*) FILTER (WHERE is_claim AND verdict = 'contradicted' AND tv <> 'contradicted') AS false_accusations, count(*) FILTER (WHERE is_claim AND verdict IN ('supported', 'supported_weak') AND tv IN ('unsupported', 'contradicted')) AS false_certifications FROM m""",
        "label_recall": f"WITH {LABELS}, c AS (SELECT kind, id, id IN (SELECT id FROM m WHERE is_claim) AS hit FROM s WHERE is_claim AND NOT outside) SELECT kind, count(*) AS labelled, count(*) FILTER (WHERE hit) AS found, count(*) FILTER (WHERE NOT hit) AS missed, {ratio('count(*) FILTER (WHERE hit)', 'count(*)')} AS recall FROM c GROUP BY 1",
        "pool_accuracy": f"""WITH {LABELS}, b AS (SELECT s.*, s.is_claim AND NOT (s.id % 9 <> 0 AND s.id % 17 = 0) AS claim, s.is_claim AND s.id % 9 = 0 AS lacks, CASE WHEN s.id % 9 <> 0 THEN s.tv END AS truth, m.verdict AS pred FROM s LEFT JOIN m ON m.id = s.id WHERE s.random OR s.extracted OR s.outside),
 d AS (SELECT *, claim AND pred IS NOT NULL AND truth IS NOT NULL AS ok, truth IN ('supported', 'supported_weak') AS tb, pred IN ('supported', 'supported_weak') AS pb FROM b),
 r AS (SELECT count(*) FILTER (WHERE lacks) AS missing_stage_b, count(*) FILTER (WHERE random) AS random, count(*) FILTER (WHERE random AND claim) AS random_claims, count(*) FILTER (WHERE random AND claim AND pred IS NOT NULL) AS found, count(*) FILTER (WHERE extracted) AS extracted, count(*) FILTER (WHERE extracted AND claim) AS extracted_claims,
  count(*) FILTER (WHERE outside) AS outside, count(*) FILTER (WHERE outside AND claim) AS outside_claims, count(*) FILTER (WHERE ok) AS graded, count(*) FILTER (WHERE ok AND truth = pred) AS exact, count(*) FILTER (WHERE ok AND (truth = pred OR (tb AND pb))) AS lenient, count(*) FILTER (WHERE ok AND pred = 'contradicted') AS accused,
  count(*) FILTER (WHERE ok AND pred = 'contradicted' AND truth <> 'contradicted') AS false_accusations, count(*) FILTER (WHERE ok AND pb) AS certified, count(*) FILTER (WHERE ok AND pb AND truth IN ('unsupported', 'contradicted')) AS false_certifications FROM d)
 SELECT *, {ratio('found', 'random_claims')} AS recall, {wil.format(f='greatest', b='0.0', s='-')} AS recall_low, {wil.format(f='least', b='1.0', s='+')} AS recall_high, round(found / random_claims * (random_claims / random * 5000) / (random_claims / random * 5000 + outside_claims / outside * 20000), 3) AS recall_adjusted,
  {ratio('extracted_claims', 'extracted')} AS precision, {ratio('exact', 'graded')} AS accuracy, {ratio('lenient', 'graded')} AS accuracy_lenient, {ratio('false_accusations', 'accused')} AS accusation_rate, {ratio('false_certifications', 'certified')} AS certification_rate, round(outside_claims / outside * 20000, 1) AS estimated_outside FROM r""",
        "clean_sources": "SELECT entry_id FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM manifest s WHERE s.entry_id % 10 = 0 AND lower(s.source_sha256) = lower(m.source_sha256)) AND NOT coalesce(regexp_matches(file, '(?i)\\.gz$'), FALSE)",
    }
