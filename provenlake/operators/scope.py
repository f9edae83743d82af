"""What the commands of a session reached: files, hosts, pushes, installs, and what cannot be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- Fixed values: effects read off a command line, and rules for what is unreadable, first one wins.
NETWORK = r"(?i)\b(?:curl|wget|http|https)\b[^\n|;]*?(?:https?://)?([a-z0-9.-]+\.[a-z]{2,})(?:[/:\s]|$)"
REPO_API = r"(?i)\bgh\s+(?:api|repo|pr|issue|release|run|search)\b"
PUSH = r"(?i)\bgit\s+push\b[^\n;&|]*"
INSTALL = (r"\b(?:pip|pip3|python3?\s+-m\s+pip)\s+install\s+([^\n;&|]+)", r"\bnpm\s+(?:i|install|publish)\s*([^\n;&|]*)", r"\bcargo\s+(?:install|publish)\s*([^\n;&|]*)", r"\bbrew\s+install\s+([^\n;&|]+)")
REDIRECT = r"(?<![>\d])>{1,2}\s*([^\s&|;]+)"
MUTATION = r"(?i)\b(?:rm|mv|cp|chmod|chown|touch|mkdir|ln)\s+(?:-[^\s]*\s+)*([^\n;&|]+)"
LOCAL = r"^(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])"
NOWHERE = ("/dev/null", "/dev/stdout", "/dev/stderr")
WRITE_TOOLS = ("Write", "Edit", "NotebookEdit", "MultiEdit")
OPAQUE = (
    (r"\beval\b", "eval — constructs code at runtime"),
    (r"\bsource\s+|\.\s+/", "source — runs another file's contents"),
    (r"(?:curl|wget)[^\n]*\|\s*(?:ba|z|)sh\b", "download piped into a shell"),
    (r"\bbase64\s+(?:-d|--decode)[^\n]*\|", "base64 decoded into execution"),
    (r"\b(?:ba|z|)sh\s+[^\s-][^\n;&|]*\.(?:sh|bash)\b", "runs a script file"),
    (r"\b(?:python3?|node|ruby|perl)\s+[^\s-][^\n;&|]*\.(?:py|js|rb|pl)\b", "runs a program file"),
    (r"\$\((?!\s*(?:pwd|date|basename|dirname|echo)\b)", "command substitution"),
    (r"\bmake\b|\bnpm\s+run\b|\byarn\s+\w+", "delegates to a script target"),
    (r"\bdocker\s+run\b|\bssh\b", "executes in another environment"),
)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def shell_commands(ev: DataFrame) -> DataFrame:
    return ev.where("etype = 'use' and tool = 'Bash'").select("session", "seq", "command")


def opaque(ev: DataFrame) -> DataFrame:
    """(session, seq, command, why) of commands whose effects cannot be read."""
    why = F.coalesce(*[F.when(F.col("command").rlike(p), w) for p, w in OPAQUE])
    return shell_commands(ev).withColumn("why", why).where("why is not null").select("session", "seq", F.substring(trimmed(F.col("command")), 1, 120).alias("command"), "why")


def reach(ev: DataFrame) -> DataFrame:
    """(session, what, value): distinct files, hosts, pushes and installs."""
    c = F.col("command")

    def tagged(what: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(what).alias("what"), v.alias("value")))

    hosts = F.filter(F.transform(F.regexp_extract_all(c, F.lit(NETWORK), 1), lambda h: F.lower(h)), lambda h: ~h.rlike(LOCAL))
    api = F.when(c.rlike(REPO_API), F.array(F.lit("api.github.com"))).otherwise(F.array().cast("array<string>"))
    pushes = F.transform(F.regexp_extract_all(c, F.lit(PUSH), 0), lambda p: F.substring(trimmed(p), 1, 80))
    installs = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit("(?i)" + p), 1) for p in INSTALL]))
    installs = F.transform(installs, lambda p: F.coalesce(F.nullif(F.substring(trimmed(p), 1, 60), F.lit("")), F.lit("(unnamed)")))
    paths = F.concat(F.regexp_extract_all(c, F.lit(REDIRECT), 1), F.regexp_extract_all(c, F.lit(MUTATION), 1))
    files = F.filter(F.transform(paths, lambda p: F.regexp_replace(trimmed(p), r"^[\"']+|[\"']+$", "")), lambda p: (p != "") & ~p.startswith("-") & ~p.isin(*NOWHERE) & (F.char_length(p) < 200))
    shell = shell_commands(ev).select("session", F.explode(F.concat(tagged("host", F.concat(hosts, api)), tagged("push", pushes), tagged("install", installs), tagged("file", files))).alias("r")).select("session", "r.what", "r.value")
    tools = ev.where(F.col("tool").isin(*WRITE_TOOLS) & (F.col("etype") == "use") & (F.col("file_path") != "")).select("session", F.lit("file").alias("what"), F.col("file_path").alias("value"))
    return shell.unionByName(tools).distinct()


def summary(ev: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row per session with counts; exit code 3 without any event, 1 where something is unreadable, else 0.

    ``sessions`` (session) lists the sessions that get a row; those with events where it is not given.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = lambda c: c.cast("long")
    kinds = (("file", "files"), ("host", "hosts"), ("push", "pushes"), ("install", "installs"))
    e = ev.select("session", F.lit(1).cast("long").alias("parsed_events"), one((F.col("etype") == "use") & (F.col("tool") == "Bash")).alias("commands"))
    parts = [e, reach(ev).select("session", *[one(F.col("what") == w).alias(c) for w, c in kinds]), opaque(ev).select("session", F.lit(1).cast("long").alias("opaque"))]
    if sessions is not None:
        parts.append(sessions.where("session is not null").select("session"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = rows.groupBy("session").agg(*[n(c).alias(c) for c in ("parsed_events", "commands", *(c for _, c in kinds), "opaque")])
    return out.withColumn("exit_code", F.when(F.col("parsed_events") == 0, 3).when(F.col("opaque") > 0, 1).otherwise(0).cast("long"))


def shown(reached: DataFrame, first: int | None = 8) -> DataFrame:
    """(session, what, n, values): the sorted values of each kind, the first ones only unless ``first`` is None."""
    rank = F.row_number().over(Window.partitionBy("session", "what").orderBy("value"))
    r = reached.withColumn("_n", rank)
    kept = F.when(F.col("_n") <= first, F.struct("_n", "value")) if first else F.struct("_n", "value")
    return r.groupBy("session", "what").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["value"]).alias("values"))
