"""Queries of the general data-preparation operators (schemas, nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.operators import drift, flatten
from provenlake.sources.transcripts import CONTENT_NAMES, ERROR_NAMES, blocks, canonical_lines, read_table


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(canonical_lines(read_table(spark, sf_dir, "transcript_lines"))).where("btype = 'tool_result'")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = drift.file_schemas(tool_results(spark, sf_dir), "session", "b")
    return drift.schema_changes(read_table(spark, sf_dir, "transcript_files"), schemas)


def p2_union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = drift.union_schema(drift.file_schemas(tool_results(spark, sf_dir), "session", "b"))
    return u.select("field", F.array_join("names", ",").alias("names"), F.array_join("kinds", ",").alias("kinds"), "promoted", "files")


def p2_tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = tool_results(spark, sf_dir)
    return drift.consistent_results(results, drift.union_schema(drift.file_schemas(results, "session", "b"))).select("session", "seq", "block", "tool_use_id", "content", "is_error", "fields.*").drop(*CONTENT_NAMES[1:], *ERROR_NAMES[1:])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.artifacts_table(read_table(spark, sf_dir, "session_docs")).unionByName(flatten.content_pieces(tool_results(spark, sf_dir)))


def p4_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.artifact_values(read_table(spark, sf_dir, "session_docs"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.content_pieces(tool_results(spark, sf_dir))


def p4_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.facts_table(read_table(spark, sf_dir, "session_docs"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_union_schema, p2_tool_results, p4_found, p4_artifacts, p4_pieces, p4_facts)}


LINES = "l AS (SELECT session, seq, min_by(raw, line_id) AS raw FROM transcript_lines WHERE json_valid(raw) AND trim(raw) <> '' AND session IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2)"
BLOCKS = f"""{LINES}, b AS (SELECT session, seq, unnest(json_extract(raw, '$.message.content[*]')) AS b, unnest(range(json_array_length(raw, '$.message.content')::BIGINT)) AS block FROM l
 WHERE json_type(raw) = 'OBJECT' AND json_type(raw, '$.message.content') = 'ARRAY'), r AS (SELECT * FROM b WHERE json_type(b) = 'OBJECT' AND b->>'$.type' = 'tool_result')"""
CONTENT = ", ".join(f"CASE WHEN json_type(b, '$.{n}') <> 'NULL' THEN json_extract(b, '$.{n}') END" for n in drift.CONTENT_NAMES)
ERROR = ", ".join(f"CASE WHEN json_type(b, '$.{n}') <> 'NULL' THEN json_extract(b, '$.{n}') END" for n in drift.ERROR_NAMES)


def _decoded(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x}->>'$', '^\\s*[\\[{{]') AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"


DOCS = f"""p AS (SELECT session_id AS root, saved_at, doc, {_decoded("doc::JSON")} AS v FROM session_docs WHERE session_id IS NOT NULL AND json_valid(doc) AND trim(doc) <> ''),
 n AS (SELECT root, v FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY saved_at DESC NULLS LAST, doc DESC) AS k FROM p WHERE json_type(v) = 'OBJECT') WHERE k = 1),
 h AS (SELECT root, {_decoded("json_extract(v, '$.facts')")} AS fs FROM n),
 e AS (SELECT root, NULL::VARCHAR AS key, unnest(json_extract(fs, '$[*]')) AS f, unnest(range(json_array_length(fs)::BIGINT)) AS item FROM h WHERE json_type(fs) = 'ARRAY'
  UNION ALL SELECT root, key, json_extract(fs, '$."' || key || '"'), row_number() OVER (PARTITION BY root ORDER BY key) - 1 FROM (SELECT root, fs, unnest(json_keys(fs)) AS key FROM h WHERE json_type(fs) = 'OBJECT')),
 g AS (SELECT root, item, f, coalesce(f->>'$.id', key, '') AS node, coalesce(m->>'$.mode', '') AS mode, art FROM (SELECT *, {_decoded("json_extract(f, '$.meta')")} AS m, {_decoded("json_extract(f, '$.artifacts')")} AS art FROM (SELECT root, key, item, {_decoded("f")} AS f FROM e) WHERE json_type(f) = 'OBJECT'))"""
ARTIFACTS = f"""i AS (SELECT root, node, mode, unnest(json_extract(art, '$[*]')) AS x, unnest(range(json_array_length(art)::BIGINT)) AS item FROM g WHERE json_type(art) = 'ARRAY' UNION ALL SELECT root, node, mode, art, 0 FROM g WHERE art IS NOT NULL AND json_type(art) NOT IN ('ARRAY', 'NULL')),
 j AS (SELECT row_number() OVER () AS k, root, node, mode, item, {_decoded("x")} AS x FROM i WHERE json_type(x) <> 'NULL'), m0 AS (SELECT k, json_extract(x, '$.meta') AS m FROM j),
 t AS (SELECT k, 0 AS depth, {_decoded("m")} AS d FROM m0 UNION ALL SELECT k, depth + 1, {_decoded("c")} FROM (SELECT k, depth, unnest(CASE json_type(d) WHEN 'OBJECT' THEN json_extract(d, '$.*') WHEN 'ARRAY' THEN json_extract(d, '$[*]') ELSE [] END) AS c FROM t)),
 q AS (SELECT k, arg_min(d->>'$.result_digest', depth) AS digest FROM t WHERE json_type(d) = 'OBJECT' AND json_type(d, '$.result_digest') = 'VARCHAR' AND d->>'$.result_digest' <> '' GROUP BY k), a AS (SELECT j.*, digest FROM j LEFT JOIN q USING (k))"""
FIELDS = f"""k AS (SELECT session, unnest(json_keys(b)) AS name, b FROM r), f AS (SELECT session, name,
 CASE json_type(b, '$."' || name || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind, CASE json_type(b, '$."' || name || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL WHEN 'DOUBLE' THEN 'fraction' ELSE 'integer' END AS fine,
 CASE WHEN name IN {drift.CONTENT_NAMES} THEN 'content' WHEN name IN {drift.ERROR_NAMES} THEN 'is_error' ELSE name END AS field FROM k WHERE name NOT IN ('type', 'tool_use_id')),
 s AS (SELECT session, field, list_sort(list(DISTINCT name)) AS names, list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT fine)) AS fines FROM f WHERE kind IS NOT NULL GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""WITH {BLOCKS}, {FIELDS}, o AS (SELECT session, min(client) AS client, min(opened_at) AS opened_at FROM transcript_files WHERE client IS NOT NULL AND session IN (SELECT session FROM r) GROUP BY 1),
 p AS (SELECT session, lag(session) OVER (PARTITION BY client ORDER BY opened_at, session) AS before FROM o),
 x AS (SELECT p.session, a.field, a.names AS n0, a.kinds AS k0, NULL::VARCHAR[] AS n1, NULL::VARCHAR[] AS k1 FROM p JOIN s a ON a.session = p.before UNION ALL SELECT p.session, c.field, NULL, NULL, c.names, c.kinds FROM p JOIN s c ON c.session = p.session WHERE p.before IS NOT NULL),
 y AS (SELECT session, field, any_value(n0) AS n0, any_value(k0) AS k0, any_value(n1) AS n1, any_value(k1) AS k1 FROM x GROUP BY 1, 2)
 SELECT session, field, change_kind FROM (SELECT session, field, unnest([CASE WHEN n0 IS NULL THEN 'added' END, CASE WHEN n1 IS NULL THEN 'removed' END, CASE WHEN n0 <> n1 THEN 'renamed' END, CASE WHEN k0 <> k1 THEN 'retyped' END]) AS change_kind FROM y) WHERE change_kind IS NOT NULL""",
        "p2_union_schema": f"""WITH {BLOCKS}, {FIELDS}, u AS (SELECT field, list_sort(list_distinct(flatten(list(names)))) AS names, list_sort(list_distinct(flatten(list(fines)))) AS k, count(DISTINCT session) AS files FROM s GROUP BY field)
 SELECT field, array_to_string(names, ',') AS names, array_to_string(k, ',') AS kinds, CASE WHEN field = 'is_error' THEN 'boolean' WHEN field = 'content' THEN 'string' WHEN len(k) = 1 THEN k[1] WHEN k = ['fraction', 'integer'] THEN 'fraction' ELSE 'string' END AS promoted, files FROM u""",
        "p2_tool_results": f"""WITH {BLOCKS}, c AS (SELECT *, coalesce({CONTENT}) AS c, coalesce({ERROR}) AS e FROM r), w AS (SELECT *, lower(trim(CASE WHEN json_type(e) NOT IN ('ARRAY', 'OBJECT') THEN e->>'$' END)) AS word FROM c)
 SELECT session, seq, block, b->>'$.tool_use_id' AS tool_use_id, CASE json_type(c) WHEN 'VARCHAR' THEN c->>'$' WHEN 'OBJECT' THEN CASE WHEN json_type(c, '$.text') = 'VARCHAR' THEN c->>'$.text' END
  WHEN 'ARRAY' THEN coalesce(array_to_string(list_filter(list_transform(json_extract(c, '$[*]'), lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN p->>'$' WHEN json_type(p, '$.text') = 'VARCHAR' THEN p->>'$.text' END), lambda t: t IS NOT NULL), chr(10)), '') END AS content,
  CASE WHEN word IN ('true', '1', 'yes', 'y', 'error', 'failed') THEN TRUE WHEN word IN ('false', '0', 'no', 'n', '', 'ok', 'none') THEN FALSE WHEN regexp_full_match(word, '-?[0-9]+([.][0-9]+)?') THEN word::DOUBLE <> 0 END AS is_error,
  b->>'$.cwd' AS cwd, (b->>'$.duration_ms')::BIGINT AS duration_ms, (b->>'$.truncated')::BOOLEAN AS truncated FROM w""",
        "p4_found": f"""WITH RECURSIVE {DOCS}, {ARTIFACTS}, {BLOCKS}, c AS (SELECT session, seq, block, coalesce({CONTENT}) AS c FROM r)
 SELECT root, node, item, -1 AS piece, mode, coalesce(digest, '') AS digest FROM a UNION ALL
 SELECT session, seq::VARCHAR, block, unnest(range(json_array_length(c)::BIGINT)), '', '' FROM c WHERE json_type(c) = 'ARRAY'""",
        "p4_artifacts": f"""WITH RECURSIVE {DOCS}, {ARTIFACTS} SELECT root, node, item, -1::BIGINT AS piece, mode, coalesce(digest, '') AS digest, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.kind' END AS kind, CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' WHEN 'OBJECT' THEN x->>'$.value' END AS value FROM a""",
        "p4_facts": f"""WITH {DOCS} SELECT root, item, node, f->>'$.kind' AS kind, f->>'$.claim' AS claim, f->>'$.evidence' AS evidence, f->>'$.next' AS next, mode, CASE json_type(art) WHEN 'ARRAY' THEN json_array_length(art)::BIGINT WHEN 'OBJECT' THEN 1 ELSE 0 END::BIGINT AS artifacts FROM g""",
        "p4_pieces": f"""WITH {BLOCKS}, c AS (SELECT session, seq, block, coalesce({CONTENT}) AS c FROM r)
 SELECT session AS root, seq::VARCHAR AS node, block AS item, unnest(range(json_array_length(c)::BIGINT)) AS piece, '' AS mode, '' AS digest FROM c WHERE json_type(c) = 'ARRAY'""",
    }
