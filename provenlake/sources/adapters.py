"""Driver tables seen as transcripts and ledgers, so that every operator has an independent SQL counterpart.

``event_lines`` writes real JSON lines from the ``events`` table: the engine reads only
their text, while the SQL counterpart reads ``event_type`` directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positioned(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", "event_type", F.row_number().over(w).cast("bigint").alias("pos"))


def _line(kind: str, block: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.array(block).alias("content")).alias("message")))


def _text(text: Column) -> Column:
    return _line("assistant", F.struct(F.lit("text").alias("type"), text.alias("text")))


def _use(tool_id: Column, command: Column) -> Column:
    return _line("assistant", F.struct(F.lit("tool_use").alias("type"), tool_id.alias("id"), F.lit("Bash").alias("name"), F.struct(command.alias("command")).alias("input")))


def _result(tool_id: Column, body: Column, error: Column) -> Column:
    return _line("user", F.struct(F.lit("tool_result").alias("type"), tool_id.alias("tool_use_id"), body.alias("content"), error.alias("is_error")))


def event_lines(events: DataFrame, command: Column, claim: Column) -> DataFrame:
    """(session, seq, line_id, raw): calls and results for click, error and view; texts for purchase and signup.

    ``command`` and ``claim`` are expressions over event_id, event_type.
    """
    p = positioned(events)
    tool_id = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    body = F.when(F.col("event_type") == "click", "..........\n12 passed in 3.1s").when(F.col("event_type") == "error", "..F\n2 failed, 10 passed in 3.1s").otherwise("nothing to commit")
    call = F.col("event_type").isin("click", "error", "view")
    error = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "click", False)
    first = F.struct((2 * F.col("pos") - 1).alias("seq"), F.when(call, _use(tool_id, command)).otherwise(_text(claim)).alias("raw"))
    second = F.struct((2 * F.col("pos")).alias("seq"), F.when(call, _result(tool_id, body, error)).alias("raw"))
    rows = p.select(F.col("user_id").cast("string").alias("session"), F.col("event_id"), F.explode(F.array(first, second)).alias("l"))
    return rows.where("l.raw is not null").select("session", F.col("l.seq").alias("seq"), (F.col("event_id") * 2 + F.col("l.seq") % 2).alias("line_id"), F.col("l.raw").alias("raw"))
