"""Claims against evidence: which success claims rest on a command that ran.

Stages: events (scan, narrow) -> commands (call paired with its result) -> claims
(sentences through the grammar, narrow) -> evidence (as-of lookup) -> verdict.

Shuffles: one for the lines, one for pairing on (session, id), one for the lookup on
(session, kind, hint).  The lookup is an as-of join done as a running maximum in two
levels - inside stretches of ``STRETCH`` lines, and over one row per stretch - so a
session of any length never sits in one window frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.functions import grammar as G
from provenlake.operators.drift import as_boolean
from provenlake.session import written
from provenlake.sources.transcripts import CONTENT_NAMES, ERROR_NAMES, content_text, field, first_present, string_of

STRETCH = 4096


def events(blocks: DataFrame) -> DataFrame:
    """(session, seq, idx, etype, tool_id, tool, command, file_path, input, body, is_error, text).

    ``blocks`` has session, seq, ltype, block, btype and b (VARIANT).  Texts and calls
    come from assistant lines, results from all others.
    """
    b = F.col("b")
    inp = field(b, "input")
    command = F.coalesce(*[F.nullif(field(inp, k, "string"), F.lit("")) for k in ("command", "cmd", "file_path", "path")], F.lit(""))
    said = F.coalesce(F.col("ltype") == "assistant", F.lit(False))
    etype = F.when(said & (F.col("btype") == "text") & (F.coalesce(string_of(field(b, "text")), F.lit("")) != ""), "text").when(said & (F.col("btype") == "tool_use"), "use").when(~said & (F.col("btype") == "tool_result"), "result")
    return blocks.withColumn("etype", etype).where("etype is not null").select(
        "session",
        "seq",
        F.col("block").alias("idx"),
        "etype",
        F.when(F.col("etype") == "use", field(b, "id", "string")).when(F.col("etype") == "result", field(b, "tool_use_id", "string")).alias("tool_id"),
        F.when(F.col("etype") == "use", F.coalesce(field(b, "name", "string"), F.lit(""))).alias("tool"),
        F.when(F.col("etype") == "use", command).alias("command"),
        F.when(F.col("etype") == "use", field(inp, "file_path", "string")).alias("file_path"),
        F.when(F.col("etype") == "use", described(inp)).alias("input"),
        F.when(F.col("etype") == "result", F.coalesce(content_text(first_present(b, CONTENT_NAMES)), F.lit(""))).alias("body"),
        F.when(F.col("etype") == "result", as_boolean(first_present(b, ERROR_NAMES))).alias("is_error"),
        F.when(F.col("etype") == "text", string_of(field(b, "text"))).alias("text"),
    )


INPUT_NAMES = ("command", "cmd", "path", "file_path", "pattern", "query", "url")


def described(inp) -> Column:
    """A call's input in at most 300 characters: the first of its usual fields, else its JSON."""
    own = [F.when(field(inp, n).isNotNull(), F.coalesce(field(inp, n, "string"), F.to_json(field(inp, n)))) for n in INPUT_NAMES]
    return F.substring(F.coalesce(*own, F.to_json(inp), F.lit("{}")), 1, 300)


def paired(ev: DataFrame) -> DataFrame:
    """Calls with the first result after them: a result counts if the row of its id before it is a call."""
    w = Window.partitionBy("session", "tool_id").orderBy("seq", "idx")
    p = ev.where("etype in ('use', 'result')").withColumn("_b", F.lag(F.struct("etype", "seq", "tool", "command")).over(w))
    return p.where("etype = 'result' and _b.etype = 'use'").select("session", "tool_id", F.col("_b.seq").alias("use_seq"), F.col("_b.tool").alias("tool"), F.col("_b.command").alias("command"), F.col("seq").alias("result_seq"), F.col("idx").alias("result_idx"), "body", "is_error")


def orphans(ev: DataFrame) -> DataFrame:
    """Calls without result and results without call, per session."""
    w = Window.partitionBy("session", "tool_id").orderBy("seq", "idx")
    p = ev.where("etype in ('use', 'result')").select("session", "etype", F.lag("etype").over(w).alias("before"), F.lead("etype").over(w).alias("after"))
    return p.groupBy("session").agg(
        F.count_if((F.col("etype") == "use") & ~F.coalesce(F.col("after") == "result", F.lit(False))).alias("open_calls"),
        F.count_if((F.col("etype") == "result") & ~F.coalesce(F.col("before") == "use", F.lit(False))).alias("stray_results"),
    )


def commands(ev: DataFrame) -> DataFrame:
    """Paired calls with everything a verdict needs, computed once per command."""
    body, tool, command = F.col("body"), F.col("tool"), F.col("command")
    echoed = G.has(body, G.EXIT_SAID, G.U) | G.has(body, G.EXIT_ECHOED, G.U)

    def facts(x):
        text, heads = x["text"], x["heads"]
        piped = (G.has(text, G.PIPE_EATS_EXIT, G.U) & ~(echoed & command.rlike("pipestatus|PIPESTATUS"))) | (~echoed & G.exit_hidden(text, heads))
        announced = G.has(body, G.TEST_RESULT) & ~tool.isin(*G.QUIET_TOOLS) & G.executes(heads)
        kinds = F.array_compact(F.array(*[F.when(G.runs(heads, tool, k) | (announced if k == "test" else F.lit(False)), k) for k in G.KINDS]))
        return F.struct(piped.alias("piped"), kinds.alias("kinds"))

    hints = F.array_compact(F.array(F.lit(""), *[F.when(G.has(command, G.HINT_COMMAND[h], G.U), h) for h in G.HINTS]))
    shape = G.let(G.executable(command), lambda t: G.let(F.struct(t.alias("text"), G.heads(t).alias("heads")), facts))
    return paired(ev).select(
        "session", "tool_id", "use_seq", "result_seq", "result_idx", "tool", "command",
        G.exit_ok(body, F.col("is_error")).alias("ok"),
        G.filtered_run(command).alias("filtered"),
        G.first_number(body, r"\b(\d+)\s+passed\b").alias("reported_pass"),
        G.first_number(body, r"\b([1-9]\d*)\s+(?:failed|failures?|errors?)\b").alias("reported_fail"),
        hints.alias("hints"),
        shape.alias("_s"),
    ).select("*", "_s.piped", "_s.kinds").drop("_s")


def graded_sentences(ev: DataFrame) -> DataFrame:
    """(session, seq, idx, pos, sentence, hint, kinds, refused) of sentences with claim vocabulary."""
    s = ev.where("etype = 'text'").select("session", "seq", "idx", F.posexplode(G.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("_p", G.probe(F.col("sentence")))
    g = s.where(G.any_claim(F.col("_p"))).withColumn("_c", G.claims_of(F.col("_p")))
    return g.select("session", "seq", "idx", "pos", "sentence", G.hint_of(F.col("sentence")).alias("hint"), "_c.kinds", "_c.refused")


def claims(grades: DataFrame) -> DataFrame:
    """One row per claim of ``graded_sentences``."""
    # explode_outer: plain explode lets the optimizer test the kinds in a filter of its own, and so grade twice
    return grades.select("session", "seq", "idx", "pos", "sentence", "hint", F.explode_outer("kinds").alias("kind")).where("kind is not null")


def with_evidence(claims_: DataFrame, commands_: DataFrame) -> DataFrame:
    """Each claim with the last command (in order of results) called before its line."""
    c = commands_.select(
        "session", F.explode_outer("kinds").alias("kind"), "hints", F.col("use_seq").alias("seq"),
        F.struct("result_seq", "result_idx", F.col("use_seq").alias("line"), "tool", "command", "ok", "piped", "filtered", "reported_pass", "reported_fail").alias("cmd"),
    ).where("kind is not null").select("session", "kind", F.explode("hints").alias("hint"), "seq", "cmd")
    keys = ["session", "kind", "hint"]
    rows = c.withColumn("claim", F.lit(None).cast("struct<idx:bigint,pos:int,sentence:string>")).unionByName(
        claims_.select(*keys, "seq", F.struct(F.col("idx").cast("bigint").alias("idx"), F.col("pos").alias("pos"), "sentence").alias("claim")), allowMissingColumns=True
    ).withColumn("_b", F.floor(F.col("seq") / STRETCH))
    rows, _ = written(rows)  # read by both levels below; graded once
    inner = Window.partitionBy(*keys, "_b").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy(*keys, "_b").agg(F.max("cmd").alias("_m")).withColumn("_before", F.max("_m").over(outer)).drop("_m")
    near = rows.withColumn("_near", F.max("cmd").over(inner)).where("claim is not null").drop("cmd")
    return near.join(best, [*keys, "_b"]).select("session", "seq", "claim.idx", "claim.pos", "kind", "hint", "claim.sentence", F.greatest("_near", "_before").alias("last"))


def verdicts(graded: DataFrame) -> DataFrame:
    """(session, seq, idx, pos, kind, text, verdict, evidence)."""
    last, s, kind = F.col("last"), F.col("sentence"), F.col("kind")
    test = kind == "test"
    n = G.first_number(s, G.CLAIM_COUNT)
    loose = F.coalesce(n, G.first_number(s, r"\b(\d+)\s+pass"))
    covered = test & ~G.has(s, G.CLAIM_WHOLE) & (loose <= last["reported_pass"])
    weak = (test & last["piped"]) | ((kind == "write") & last["tool"].isin(*G.WRITE_TOOLS))
    cut = test & last["filtered"] & G.has(s, G.CLAIM_ALL)
    short = test & (last["reported_pass"] < n)
    at = F.concat(F.lit("line "), last["line"].cast("string"), F.lit(": "))
    ran = F.concat(at, F.substring(last["command"], 1, 100))
    ran80 = F.concat(at, F.substring(last["command"], 1, 80))
    yes = lambda c: F.coalesce(c, F.lit(False))
    verdict = (
        F.when(last.isNull(), "unsupported")
        .when(last["ok"] == False, F.when(yes(covered), "unsupported").otherwise("contradicted"))  # noqa: E712
        .when(last["ok"], F.when(yes(test & (last["reported_fail"] > 0)) | yes(cut) | yes(short), "unsupported").when(yes(weak), "supported_weak").otherwise("supported"))
        .otherwise("unsupported")
    )
    # What the evidence says.
    evidence = (
        F.when(last.isNull(), None)
        .when((last["ok"] == False) & yes(covered), F.concat(at, F.lit("that run failed overall but reported "), last["reported_pass"].cast("string"), F.lit(" passed; it cannot check a claim about "), loose.cast("string")))  # noqa: E712
        .when(last["ok"] & yes(test & (last["reported_fail"] > 0)), F.concat(ran80, F.lit(" — its output reports "), last["reported_fail"].cast("string"), F.lit(" failed")))
        .when(last["ok"] & yes(cut), F.concat(ran80, F.lit(" — a filtered run establishes nothing about the tests it did not select")))
        .when(last["ok"] & yes(short), F.concat(at, F.lit("the run reported "), last["reported_pass"].cast("string"), F.lit(" passed; the claim states "), n.cast("string")))
        .otherwise(ran)
    )
    text = F.substring(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), 1, 160)
    return graded.select("session", "seq", "idx", "pos", "kind", text.alias("text"), verdict.alias("verdict"), evidence.alias("evidence"))


def audit(ev: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """``grades`` is ``graded_sentences(ev)``, where the caller has it already."""
    return verdicts(with_evidence(claims(graded_sentences(ev) if grades is None else grades), commands(ev)))


def session_rollup(ev: DataFrame, graded: DataFrame, sessions: DataFrame | None = None, grades: DataFrame | None = None) -> DataFrame:
    """One row per session: counts by verdict, commands, events, refused sentences, exit code.

    Exit codes: 3 no transcript (no event was read), 2 something contradicted, 1 something unsupported, else 0.
    ``sessions`` (session) lists the sessions that get a row; those with events where it is not given.  All counts
    come from one grouped pass over narrow rows.
    """
    names = ("supported", "supported_weak", "unsupported", "contradicted")
    one = lambda c: c.cast("long")
    parts = [
        ev.select("session", F.lit(1).cast("long").alias("parsed_events"), F.when(F.col("etype") != "result", F.col("seq")).alias("lines")),
        paired(ev).select("session", F.lit(1).cast("long").alias("commands")),
        graded.select("session", *[one(F.col("verdict") == n).alias(n) for n in names]),
        (graded_sentences(ev) if grades is None else grades).where("refused").select("session", F.lit(1).cast("long").alias("not_asserted")),
    ]
    if sessions is not None:
        parts.append(sessions.where("session is not null").select("session"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = rows.groupBy("session").agg(total("parsed_events"), F.coalesce(F.max("lines"), F.lit(0)).alias("lines"), total("commands"), *map(total, names), total("not_asserted"))
    code = F.when(F.col("parsed_events") == 0, 3).when(F.col("contradicted") > 0, 2).when(F.col("unsupported") > 0, 1).otherwise(0)
    return out.withColumn("exit_code", code.cast("long"))
