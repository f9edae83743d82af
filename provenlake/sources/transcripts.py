"""Reading recorded transcript lines into one row per line and one row per block.

``canonical_lines`` keeps, for every (session, seq), the row whose ``raw``
parses as JSON; if several parse, the one with the smallest ``line_id``.  Rows
without a session or seq, and lines that never parse, are left out.  The JSON
is parsed once into a VARIANT before the shuffle, so cut-off copies never
travel.  The shuffle key is (session, seq): a project or session that holds a
third of all rows still spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names under which recording clients write the two fields of a tool_result.
CONTENT_NAMES = ("content", "output", "body", "result_text")
ERROR_NAMES = ("is_error", "error_flag", "failed", "isError")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_lines(lines: DataFrame, *columns: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session, seq, line_id, v VARIANT): one row per line that parses.

    With ``columns`` (expressions over ``v``) those are computed before the shuffle
    and only they travel, in place of ``v``.  ``keep`` names further columns of ``lines``.
    """
    parsed = lines.select("session", "seq", "line_id", *keep, F.try_parse_json("raw").alias("v")).where(
        "v is not null and session is not null and seq is not null"
    )
    if columns:
        parsed = parsed.select("session", "seq", "line_id", *keep, *columns)
    first = Window.partitionBy("session", "seq").orderBy("line_id")
    return parsed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def vget(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def blocks(lines: DataFrame) -> DataFrame:
    """(session, seq, ltype, block, btype, b VARIANT): every block of every line.

    ``lines`` has session, seq, v.  ``block`` counts from 0 by place in
    ``message.content``; a content that is no array has no blocks.
    """
    return (
        lines.select("session", "seq", vget("v", "$.type", "string").alias("ltype"), F.posexplode(vget("v", "$.message.content", "array<variant>")).alias("block", "b"))
        .withColumn("btype", vget("b", "$.type", "string"))
        .select("session", "seq", "ltype", F.col("block").cast("long").alias("block"), "btype", "b")
    )


def field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def first_present(v: Column | str, names: tuple[str, ...]) -> Column:
    """The first of the named fields that is there and not null, as a VARIANT."""
    v = F.col(v) if isinstance(v, str) else v
    got = [field(v, n) for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(g), g) for g in got])


def string_of(v: Column) -> Column:
    """A VARIANT's string, null for any other type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def content_text(c: Column | str) -> Column:
    """Text of a content: the string, an object's text, an array's texts joined by newlines."""
    c = F.col(c) if isinstance(c, str) else c
    kind = F.schema_of_variant(c)
    pieces = F.transform(F.try_variant_get(c, "$", "array<variant>"), lambda p: F.coalesce(string_of(p), string_of(field(p, "text"))))
    return (
        F.when(kind == "STRING", F.try_variant_get(c, "$", "string"))
        .when(kind.startswith("ARRAY"), F.array_join(F.filter(pieces, lambda t: t.isNotNull()), "\n"))
        .when(kind.startswith("OBJECT"), string_of(field(c, "text")))
    )


def _texts(lines: DataFrame, pick, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session, seq, block, btype, text) of the blocks for which ``pick`` gives a text; only texts are shuffled."""
    body = F.expr("try_variant_get(v, '$.message.content', 'array<variant>')")
    rows = F.filter(
        F.transform(body, lambda b, i: F.struct(i.cast("long").alias("block"), field(b, "type", "string").alias("btype"), pick(b).alias("text"))),
        lambda r: r["text"].isNotNull(),
    )
    return canonical_lines(lines, rows.alias("texts"), keep=keep).select("session", "seq", *keep, F.inline("texts"))


def text_blocks(lines: DataFrame) -> DataFrame:
    """(session, seq, block, btype, text) of every text block."""
    return _texts(lines, lambda b: F.when(field(b, "type", "string") == "text", string_of(field(b, "text"))))


def result_texts(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session, seq, block, btype, text) of every tool_result that has a content."""
    return _texts(lines, lambda b: F.when(field(b, "type", "string") == "tool_result", content_text(first_present(b, CONTENT_NAMES))), keep)


def all_texts(lines: DataFrame) -> DataFrame:
    """Text blocks and contents of tool_results alike, in one pass."""

    def pick(b: Column) -> Column:
        kind = field(b, "type", "string")
        return F.when(kind == "text", string_of(field(b, "text"))).when(kind == "tool_result", content_text(first_present(b, CONTENT_NAMES)))

    return _texts(lines, pick)
