"""Queries of the operators for language-model corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.llm import conversations, credentials, leakage, personal, sentences, splits, tokenize, toxicity
from provenlake.session import written
from provenlake.sources.transcripts import all_texts, read_table, result_texts, text_blocks

KEY = "key of the demonstration; give your own"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.broken_ties(splits.tied_entries(read_table(spark, sf_dir, "manifest")))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_splits(splits.tied_entries(read_table(spark, sf_dir, "manifest")))


def p1_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what must hold of the new splits: every entry placed, no group in two splits, shares within two points or the largest group."""
    tied = splits.tied_entries(read_table(spark, sf_dir, "manifest"))
    new, _ = written(splits.stratified_splits(tied))
    groups = new.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.min("split").alias("split"))
    of = [F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)) - p * F.sum("n") for s, p in splits.PROPORTIONS.items()]
    held = F.greatest(*map(F.abs, of)) <= F.greatest(0.02 * F.sum("n"), F.max("n"))
    return groups.agg(F.sum("n").alias("entries"), F.count("*").alias("groups"), F.count_if(F.col("splits") > 1).alias("broken"), F.max("n").alias("largest"), held.alias("shares_hold"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = conversations.messages(read_table(spark, sf_dir, "transcript_lines"))
    turns, _ = conversations.resolve_turns(msgs)
    return conversations.defects(read_table(spark, sf_dir, "transcript_files"), msgs, turns)


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = conversations.messages(read_table(spark, sf_dir, "transcript_lines"))
    turns, _ = conversations.resolve_turns(msgs)
    files = read_table(spark, sf_dir, "transcript_files")
    return conversations.conversations(files, turns, conversations.defects(files, msgs, turns))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(text_blocks(read_table(spark, sf_dir, "transcript_lines")))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(all_texts(read_table(spark, sf_dir, "transcript_lines")), read_table(spark, sf_dir, "manifest"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_values(all_texts(read_table(spark, sf_dir, "transcript_lines")), read_table(spark, sf_dir, "manifest"))


def _replaced(spark: SparkSession, sf_dir: str, surrogate: bool) -> DataFrame:
    spans, _ = written(_spans(spark, sf_dir))
    return personal.replaced_texts(all_texts(read_table(spark, sf_dir, "transcript_lines")), spans, personal.surrogates(spans, KEY), KEY, surrogate)


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, False)


def p6_surrogated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replaced(spark, sf_dir, True)


def p6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.surrogates(_spans(spark, sf_dir), KEY)


def _owned_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of tool_results, as a written table: they are read for the index, the search and the lines."""
    texts = result_texts(read_table(spark, sf_dir, "transcript_lines"), keep=("project",))
    return written(texts.select("session", "seq", "block", "text", F.coalesce("project", "session").alias("owner")))[0]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(_owned_results(spark, sf_dir))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted_texts(_owned_results(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_texts(read_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.near_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, read_table(spark, sf_dir, "doc_labels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flagged(_scores(spark, sf_dir))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.source_rates(_scores(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_split_report, p3_found, p3_conversations, p5_found, p6_found, p6_redacted, p6_surrogated, p6_surrogates, p7_found, p7_redacted, p8_ids, p9_found, p9_leaks, p10_found, p10_scores, p10_source_rates)}


MESSAGES = """l AS (SELECT session, seq, min_by(raw, line_id) AS raw FROM transcript_lines WHERE json_valid(raw) AND trim(raw) <> '' AND session IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
 m AS (SELECT session, seq, raw->>'$.type' AS role, raw FROM l WHERE json_type(raw) = 'OBJECT' AND raw->>'$.type' IN ('user', 'assistant')),
 b AS (SELECT session, seq, b->>'$.type' AS t, b FROM (SELECT session, seq, unnest(json_extract(raw, '$.message.content[*]')) AS b FROM m WHERE json_type(raw, '$.message.content') = 'ARRAY') WHERE json_type(b) = 'OBJECT'),
 a AS (SELECT session, seq, bool_or(t = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND regexp_matches(b->>'$.text', '\\S')) AS txt, bool_or(t = 'tool_use') AS u, bool_or(t = 'tool_result') AS r FROM b GROUP BY 1, 2),
 x AS (SELECT m.session, m.seq, role, coalesce(txt, FALSE) OR coalesce(json_type(raw, '$.message.content') = 'VARCHAR' AND regexp_matches(raw->>'$.message.content', '\\S'), FALSE) AS txt, coalesce(u, FALSE) AS u, coalesce(r, FALSE) AS r FROM m LEFT JOIN a USING (session, seq)),
 n AS (SELECT *, sum((role = 'user' AND txt)::INT) OVER (PARTITION BY session ORDER BY seq) AS turn FROM x)"""


DEFECTS = """t AS (SELECT session, turn, bool_or(role = 'assistant' AND (txt OR u)) AS reply FROM n WHERE turn > 0 GROUP BY 1, 2),
 i AS (SELECT session, coalesce(CASE t WHEN 'tool_use' THEN b->>'$.id' ELSE b->>'$.tool_use_id' END, '~') AS id, count(*) FILTER (WHERE t = 'tool_use') AS u, count(*) FILTER (WHERE t = 'tool_result') AS r FROM b WHERE t IN ('tool_use', 'tool_result') GROUP BY 1, 2),
 f AS (SELECT DISTINCT session FROM transcript_files WHERE session IS NOT NULL), o AS (SELECT session FROM x GROUP BY 1 HAVING bool_or(txt OR u OR r)),
 d AS (SELECT session, 'empty' AS defect FROM f WHERE session NOT IN (SELECT session FROM o) UNION ALL SELECT session, 'no_reply' FROM t WHERE NOT reply UNION ALL SELECT session, 'open_call' FROM i WHERE u > 0 AND r = 0
  UNION ALL SELECT session, 'stray_result' FROM i WHERE r > 0 AND u = 0 UNION ALL SELECT session, 'reused_id' FROM i WHERE u > 1)"""
TIES = """c AS (SELECT DISTINCT ON (entry_id) entry_id, regexp_replace(regexp_extract(trim(lower(file)), '([^/\\\\]*)$', 1), '(\\.[a-z][a-z0-9]*)+$', '') AS f, trim(lower(source_sha256)) AS d,
 regexp_replace(lower(operator), '[^\\pL\\pN]+', '', 'g') AS o, regexp_replace(lower(split), '[^\\pL\\pN]+', '', 'g') AS s FROM manifest WHERE entry_id IS NOT NULL),
 m AS (SELECT entry_id, CASE WHEN f NOT IN ('', 'unknown', 'none', 'null') THEN 'f' || f END AS f, CASE WHEN regexp_matches(d, '[a-z0-9]') AND d NOT IN ('n/a', 'unknown', 'none', 'null') THEN 'd' || d END AS d, CASE WHEN o NOT IN ('', 'unknown', 'na', 'none', 'null') THEN 'o' || o END AS o,
  CASE WHEN s IN ('', 'unknown', 'na', 'none', 'null') THEN NULL WHEN s = 'training' THEN 'train' WHEN s IN ('validation', 'val', 'valid') THEN 'dev' WHEN s = 'testing' THEN 'test' ELSE s END AS s FROM c),
 k AS (SELECT entry_id, unnest([f, d, o]) AS k FROM m), e AS (SELECT DISTINCT a.entry_id AS u, b.entry_id AS v FROM k a JOIN k b ON a.k = b.k),
 g AS (SELECT entry_id AS u, entry_id AS v FROM m UNION SELECT g.u, e.v FROM g JOIN e ON g.v = e.u)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {MESSAGES}, {DEFECTS} SELECT DISTINCT session, defect FROM d WHERE session IN (SELECT session FROM f)",
        "p3_conversations": f"""WITH {MESSAGES}, {DEFECTS} SELECT session, first_value(seq) OVER w AS turn, row_number() OVER w - 1 AS depth, seq, role FROM n WHERE session IN (SELECT session FROM f) AND session NOT IN (SELECT session FROM d) WINDOW w AS (PARTITION BY session, turn ORDER BY seq)""",
        "p1_found": f"WITH RECURSIVE {TIES}, q AS (SELECT u FROM g JOIN m ON m.entry_id = g.v GROUP BY u HAVING count(DISTINCT s) > 1) SELECT u AS entry_id FROM q",
        "p1_split_report": f"WITH RECURSIVE {TIES}, q AS (SELECT u, min(v) AS c FROM g GROUP BY u), z AS (SELECT c, count(*) AS n FROM q GROUP BY 1) SELECT sum(n)::BIGINT AS entries, count(*) AS groups, 0::BIGINT AS broken, max(n) AS largest, TRUE AS shares_hold FROM z",
    }
