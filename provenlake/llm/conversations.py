"""Rebuilding conversations from message rows.

Method: every line points to the line it continues; pointers are resolved by
iterative pointer jumping (each round joins a line with the line it points to and
doubles the distance), which gives each line the root of its turn and its depth on
the path.  Orphans (results without a call, calls without a result) and reused ids
come from the call pointers (session, id).  Conversations are then the root-to-leaf
paths in order, and broken ones are dropped with the reason.  The pointers made here
follow line order and so cannot close a cycle; ``cycle`` is the defect of a pointer that
reaches no root after ``MAX_ROUNDS``, for pointers from elsewhere.

The messages are read and parsed once, into a slim table in the shared folder.

Defined results: only lines of type user and assistant take part; a line without
readable content counts as a line without text; a null id is an id of its own; a
file without lines is ``empty``; a file listed twice counts once.  A file may be
of any length: order is found inside stretches of ``STRETCH`` line numbers plus one
row per stretch, never in one window over a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.operators.drift import with_previous
from provenlake.session import discard, written
from provenlake.sources.transcripts import canonical_lines

STRETCH = 4096
VISIBLE = r"(?U)[^\s\x1c-\x1f]"
MAX_ROUNDS = 64  # 2 ** 64 lines: only a cycle needs more


def messages(lines: DataFrame) -> DataFrame:
    """(session, seq, role, has_text, uses, results): one row per user or assistant line, as a written table."""
    body = F.expr("try_variant_get(v, '$.message.content', 'array<variant>')")
    plain = F.expr("if(schema_of_variant(try_variant_get(v, '$.message.content', 'variant')) = 'STRING', try_variant_get(v, '$.message.content', 'string'), null)")
    kind = lambda b: F.try_variant_get(b, "$.type", "string")

    def shown(b):
        t = F.try_variant_get(b, "$.text", "variant")
        return (kind(b) == "text") & (F.schema_of_variant(t) == "STRING") & F.try_variant_get(t, "$", "string").rlike(VISIBLE)

    ids = lambda what, field: F.transform(F.filter(body, lambda b: kind(b) == what), lambda b: F.coalesce(F.try_variant_get(b, field, "string"), F.lit("\x00")))
    none = F.array().cast("array<string>")
    slim = canonical_lines(
        lines,
        F.expr("try_variant_get(v, '$.type', 'string')").alias("role"),
        (F.coalesce(plain.rlike(VISIBLE), F.lit(False)) | F.coalesce(F.exists(body, shown), F.lit(False))).alias("has_text"),
        F.coalesce(ids("tool_use", "$.id"), none).alias("uses"),
        F.coalesce(ids("tool_result", "$.tool_use_id"), none).alias("results"),
    )
    return written(slim.where("role in ('user', 'assistant')").drop("line_id"))[0]


def resolve_turns(msgs: DataFrame) -> tuple[DataFrame, str]:
    """Each message with ``root`` (line number its turn starts at) and ``depth`` below it.

    A user line with text starts a turn; any other line continues the line before.
    """
    start = F.col("role").eqNullSafe("user") & F.col("has_text")
    linked = with_previous(msgs.withColumn("self", F.col("seq")), "session", ["seq"], "self", F.floor(F.col("seq") / STRETCH))
    first = linked.select(
        "session", "seq", "role", "has_text",
        (F.size("uses") > 0).alias("calls"), (F.size("results") > 0).alias("answers"),
        start.alias("prompt"),
        F.when(start | F.col("prev").isNull(), F.col("seq")).otherwise(F.col("prev")).alias("root"),
        F.when(start | F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("depth"),
    ).withColumn("done", F.col("depth") == 0)
    spark = msgs.sparkSession
    p, path = written(first)
    for _ in range(MAX_ROUNDS):
        if p.where("not done").limit(1).count() == 0:
            break
        target = p.select("session", F.col("seq").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        moved = (
            p.where("not done").join(target, ["session", "root"])
            .select("session", "seq", "role", "has_text", "calls", "answers", "prompt", F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        )
        nxt, new_path = written(p.where("done").unionByName(moved))
        discard(spark, path)
        p, path = nxt, new_path
    return p, path


def defects(files: DataFrame, msgs: DataFrame, turns: DataFrame) -> DataFrame:
    """(session, defect) for every file of ``files``."""
    turn = turns.groupBy("session", "root").agg(F.max("prompt").alias("prompt"), F.max((F.col("role") == "assistant") & (F.col("has_text") | F.col("calls"))).alias("reply"), F.max(F.col("has_text") | F.col("calls") | F.col("answers")).alias("full"), F.min("done").alias("done"))
    per_file = turn.groupBy("session").agg(F.max(F.col("prompt") & ~F.col("reply")).alias("no_reply"), F.max("full").alias("full"), F.max(~F.col("done")).alias("cycle"))
    ends = F.concat(F.transform("uses", lambda i: F.struct(i.alias("id"), F.lit(True).alias("call"))), F.transform("results", lambda i: F.struct(i.alias("id"), F.lit(False).alias("call"))))
    ids = msgs.select("session", F.inline(ends)).groupBy("session", "id").agg(F.count_if("call").alias("u"), F.count_if(~F.col("call")).alias("r"))
    per_ids = ids.groupBy("session").agg(F.max((F.col("u") > 0) & (F.col("r") == 0)).alias("open_call"), F.max((F.col("r") > 0) & (F.col("u") == 0)).alias("stray_result"), F.max(F.col("u") > 1).alias("reused_id"))
    all_files = files.where("session is not null").select("session").distinct()
    flags = all_files.join(per_file, "session", "left").join(per_ids, "session", "left")
    full = F.coalesce("full", F.lit(False))
    listed = F.array(F.when(~full, "empty"), *[F.when(full & F.col(d), d) for d in ("no_reply", "open_call", "stray_result", "reused_id", "cycle")])
    return flags.select("session", F.explode(F.filter(listed, lambda d: d.isNotNull())).alias("defect"))


def conversations(files: DataFrame, turns: DataFrame, found: DataFrame) -> DataFrame:
    """(session, turn, depth, seq, role): the ordered lines of every whole conversation."""
    good = files.where("session is not null").select("session").distinct().join(found.select("session").distinct(), "session", "left_anti")
    return turns.join(good, "session", "left_semi").select("session", F.col("root").alias("turn"), "depth", "seq", "role")
