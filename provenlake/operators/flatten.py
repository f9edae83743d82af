"""Deeply nested records into flat child tables with parent keys and positions.

Method: nested ``transform`` calls attach ancestor keys and indices, ``flatten``
combines the arrays, and one ``inline`` per target table emits rows.  All of it
stays in the JVM and is narrow: no row leaves its task.

Defined results
* a level stored as JSON text is decoded first, at any of the named levels;
* ``facts`` may be an array or an object keyed by fact id;
* ``artifacts`` may be an array (nulls count for positions but give no row), a
  single object (position 0) or null (no row);
* absent mode and digest are ''; a digest is found at any depth of the
  artifact's own meta, decoded or not, the shallowest level first;
* documents that do not parse, and older saves, give no rows; equal saves of the
  same moment are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenlake.functions.grammar import let
from provenlake.sources.transcripts import CONTENT_NAMES, field, first_present, string_of, vget


def decoded(v: Column) -> Column:
    """A VARIANT whose text-encoded object or array is parsed; else as it is."""
    s = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    p = F.try_parse_json(F.when(s.rlike(r"^\s*[\{\[]"), s))
    return F.coalesce(p, v)


def is_kind(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def values(v: Column) -> Column:
    """array<variant> of an array, or of an object's values."""
    return F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(is_kind(v, "OBJECT"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))


def newest_documents(docs: DataFrame, key: str = "session_id", at: str = "saved_at", doc: str = "doc") -> DataFrame:
    """(root, doc, v): per key the newest save that parses to an object."""
    parsed = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("root"), F.col(at).alias("at"), F.col(doc).alias("doc"), decoded(F.try_parse_json(doc)).alias("v"))
    good = parsed.where(F.col("v").isNotNull() & is_kind(F.col("v"), "OBJECT"))
    newest = good.groupBy("root").agg(F.max_by("doc", F.struct("at", "doc")).alias("doc"))
    return newest.select("root", "doc", decoded(F.try_parse_json("doc")).alias("v"))


def facts_of(v: Column) -> Column:
    """array<struct<id, fact>>: facts with their id, from either shape."""
    f = decoded(F.try_variant_get(v, "$.facts", "variant"))
    listed = F.transform(F.try_variant_get(f, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), decoded(x).alias("fact")))
    keyed = F.transform(F.map_entries(F.try_variant_get(f, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), decoded(e["value"]).alias("fact")))
    return F.when(is_kind(f, "ARRAY"), listed).when(is_kind(f, "OBJECT"), keyed)


def digest_of(meta: Column) -> Column:
    """The first ``result_digest`` that is a string and not empty, level by level, decoded or not; null where there is none.

    The levels below the first are only walked where the name stands in the text at all; a
    text has no more levels than brackets, so the walk has an end for any depth.
    """
    own = lambda d: F.nullif(string_of(field(d, "result_digest")), F.lit(""))
    none = F.array().cast("array<variant>")

    def deeper(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["level"], lambda d: F.transform(F.coalesce(values(d), none), decoded)))
        step = F.struct(F.get(F.filter(F.transform(below, own), lambda x: x.isNotNull()), F.lit(0)).alias("found"), below.alias("level"))
        return F.when(state["found"].isNotNull() | (F.size(state["level"]) == 0), state).otherwise(step)

    def walk(d: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("found"), F.array(d).alias("level"))
        below = lambda text: F.when(text.contains("result_digest"), F.aggregate(F.sequence(F.lit(1), F.length(F.regexp_replace(text, r"[^\[{]", ""))), start, deeper)["found"])
        return F.coalesce(own(d), let(F.to_json(d), below))

    return let(decoded(meta), walk)


def artifacts_table(docs: DataFrame) -> DataFrame:
    """(root, node, item, piece, mode, digest): one row per artifact that is not null."""
    return artifact_values(docs).drop("kind", "value")


def artifact_values(docs: DataFrame) -> DataFrame:
    """As ``artifacts_table``, with the artifact's kind and value."""

    def of_fact(e: Column) -> Column:
        fact = e["fact"]
        node = F.coalesce(F.try_variant_get(fact, "$.id", "string"), e["key"], F.lit(""))
        mode = F.coalesce(F.try_variant_get(decoded(F.try_variant_get(fact, "$.meta", "variant")), "$.mode", "string"), F.lit(""))
        a = decoded(F.try_variant_get(fact, "$.artifacts", "variant"))
        many = F.when(is_kind(a, "ARRAY"), F.try_variant_get(a, "$", "array<variant>")).when(a.isNotNull() & ~F.is_variant_null(a), F.array(a))
        rows = F.transform(
            many,
            lambda x, i: F.when(
                x.isNotNull() & ~F.is_variant_null(x),
                F.struct(
                    node.alias("node"),
                    i.cast("long").alias("item"),
                    F.lit(-1).cast("long").alias("piece"),
                    mode.alias("mode"),
                    F.coalesce(digest_of(F.try_variant_get(decoded(x), "$.meta", "variant")), F.lit("")).alias("digest"),
                    F.try_variant_get(decoded(x), "$.kind", "string").alias("kind"),
                    F.coalesce(F.try_variant_get(decoded(x), "$.value", "string"), string_of(decoded(x))).alias("value"),
                ),
            ),
        )
        return F.coalesce(F.filter(rows, lambda r: r.isNotNull()), F.array().cast("array<struct<node:string,item:bigint,piece:bigint,mode:string,digest:string,kind:string,value:string>>"))

    facts = F.filter(facts_of(F.col("v")), lambda e: is_kind(e["fact"], "OBJECT"))
    return newest_documents(docs).select("root", F.inline(F.flatten(F.transform(facts, of_fact))))


def facts_table(docs: DataFrame) -> DataFrame:
    """(root, item, node, kind, claim, evidence, next, mode, artifacts): one row per fact that is an object, with its position among all."""

    def row(e: Column, i: Column) -> Column:
        fact = e["fact"]
        a = decoded(F.try_variant_get(fact, "$.artifacts", "variant"))
        n = F.when(is_kind(a, "ARRAY"), F.size(F.try_variant_get(a, "$", "array<variant>"))).when(is_kind(a, "OBJECT"), 1).otherwise(0)
        own = F.struct(
            i.cast("long").alias("item"),
            F.coalesce(F.try_variant_get(fact, "$.id", "string"), e["key"], F.lit("")).alias("node"),
            *[F.try_variant_get(fact, f"$.{n}", "string").alias(n) for n in ("kind", "claim", "evidence", "next")],
            F.coalesce(F.try_variant_get(decoded(F.try_variant_get(fact, "$.meta", "variant")), "$.mode", "string"), F.lit("")).alias("mode"),
            n.cast("long").alias("artifacts"),
        )
        return F.when(is_kind(fact, "OBJECT"), own)

    rows = F.filter(F.transform(facts_of(F.col("v")), row), lambda r: r.isNotNull())
    return newest_documents(docs).select("root", F.inline(rows))


def content_pieces(results: DataFrame) -> DataFrame:
    """Every element of every content that is an array, in the same columns.

    ``results`` has session, seq, block and the block ``b`` as VARIANT.
    """
    c = results.withColumn("_c", first_present("b", CONTENT_NAMES)).where(F.schema_of_variant("_c").startswith("ARRAY"))
    rows = F.transform(
        vget("_c", "$", "array<variant>"),
        lambda x, i: F.struct(F.col("seq").cast("string").alias("node"), F.col("block").alias("item"), i.cast("long").alias("piece"), F.lit("").alias("mode"), F.lit("").alias("digest")),
    )
    return c.select(F.col("session").alias("root"), F.inline(rows))
