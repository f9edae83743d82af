"""Schemas that drift between files: one consistent table and a change log.

Method: the schema of every file is read in parallel (one partial aggregate per
task, so only (file, field, name, type) tuples are shuffled); the types of each field
are folded through a promotion lattice; files are cast to the union schema that results;
and the ordered differences between each file and its predecessor are logged.

The lattice, from below: no value; integer < fraction; boolean; array; object; all of
them below string, in which arrays and objects are their JSON text.  The least upper
bound of a set of types is the type itself, fraction for integer and fraction, and
string for all else.  The change log speaks of JSON types, in which integer and
fraction are one, ``number``.

Defined results
* null values count as absent; a field of only nulls is absent from its file;
* several names or types of one field in one file are kept as sets, and a
  change is reported when the sets differ;
* a block that holds a field under two names keeps the first in the field and the
  others under their own names;
* files without records are skipped when looking for the predecessor;
* files listed twice count once; files without client have no predecessor;
* fields with equal names in other roles cannot clash: everything travels in
  structs under fixed names, and extra columns of the inputs are ignored;
* an empty input gives an empty result.

Names of one field are recognised by lists (``ALIASES``): the two fields that clients
rename are told apart by meaning, which values alone do not give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.sources.transcripts import CONTENT_NAMES, ERROR_NAMES, content_text, first_present, vget

# SQL type of each element of the lattice; arrays and objects stay variants unless promoted to string
CAST = {"boolean": "boolean", "integer": "bigint", "fraction": "double", "array": "variant", "object": "variant", "string": "string"}


def value_type(v: Column) -> Column:
    """string, boolean, integer, fraction, array or object; null for JSON null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "VOID", None)
        .when(s == "BIGINT", "integer")
        .otherwise("fraction")
    )


def json_type(t: Column) -> Column:
    """The JSON type of an element of the lattice."""
    return F.when(t.isin("integer", "fraction"), "number").otherwise(t)


def promoted(types: Column) -> Column:
    """Least upper bound of an array of types without repeats."""
    numeric = F.forall(types, lambda t: t.isin("integer", "fraction"))
    return F.when(F.size(types) == 1, types[0]).when(numeric, "fraction").otherwise("string")


def meaning(name: str, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The field a name stands for."""
    out = F.col(name)
    for field, names in aliases.items():
        out = F.when(F.col(name).isin(*names), F.lit(field)).otherwise(out)
    return out


ALIASES = {"content": CONTENT_NAMES, "is_error": ERROR_NAMES}


def file_schemas(records: DataFrame, file: str, record: str, skip: tuple[str, ...] = ("type", "tool_use_id"), aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(file, records, fields): ``fields`` maps field -> (sorted names, sorted types of the lattice).

    Keys are folded with map-side partial aggregation before any shuffle.
    """
    aliases = ALIASES if aliases is None else aliases
    pairs = records.select(F.col(file).alias("file"), vget(record, "$", "map<string,variant>").alias("m")).select(
        "file",
        F.explode_outer(F.filter(F.map_entries("m"), lambda e: ~e["key"].isin(*skip) & ~F.is_variant_null(e["value"]))).alias("e"),
    )
    named = pairs.select("file", F.col("e.key").alias("name"), value_type(F.col("e.value")).alias("kind"))
    distinct = named.groupBy("file", "name", "kind").agg(F.count("*").alias("n"))
    by_field = (
        distinct.withColumn("field", meaning("name", aliases))
        .groupBy("file", "field")
        .agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"))
    )
    return by_field.groupBy("file").agg(
        F.sum("n").alias("records"),
        F.map_from_entries(F.filter(F.collect_list(F.struct("field", F.struct("names", "kinds"))), lambda e: e["field"].isNotNull())).alias("fields"),
    )


def with_previous(files: DataFrame, group: str, order: list[str], payload: str, bucket: Column) -> DataFrame:
    """Adds ``prev``: the payload of the row before, in the group's order.

    A group may hold a third of all rows, so no window runs over whole groups:
    rows are ordered inside (group, bucket), and only one row per bucket - its
    last payload - travels through the group-wide window.
    """
    at = F.struct(*order)
    inner = Window.partitionBy(group, "_bucket").orderBy(*[F.col(o).asc_nulls_first() for o in order])
    own = files.withColumn("_bucket", bucket).withColumn("_at", at)
    lasts = own.groupBy(group, "_bucket").agg(F.max_by(payload, "_at").alias("_last"))
    outer = Window.partitionBy(group).orderBy(F.col("_bucket").asc_nulls_first())
    before = lasts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.lag("_last").over(outer).alias("_before"))
    ranked = own.withColumn("_n", F.row_number().over(inner)).withColumn("_prev", F.lag(payload).over(inner))
    return (
        ranked.join(before, (F.col(group) == F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b")), "left")
        .withColumn("prev", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_prev")))
        .drop("_bucket", "_at", "_g", "_b", "_before", "_n", "_prev")
    )


def _json_types(kinds: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(kinds, json_type)))


def with_count(rows: DataFrame, group: str, order: list[str], flag: Column, bucket: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the group up to and with this one have the flag.

    In two levels, as above: inside (group, bucket), and over one row per bucket.  Buckets follow the order.
    """
    own = rows.withColumn("_bucket", bucket).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    inner = Window.partitionBy(group, "_bucket").orderBy(*[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(group).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(group, "_bucket").agg(F.count_if("_flag").alias("_own"))
    before = sums.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_own").over(outer), F.lit(0)).alias("_before"))
    counted = own.withColumn("_upto", F.count_if("_flag").over(inner))
    return counted.join(before, F.col(group).eqNullSafe(F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b"))).withColumn(name, F.col("_upto") + F.col("_before")).drop("_bucket", "_flag", "_upto", "_g", "_b", "_before")


def schema_changes(files: DataFrame, schemas: DataFrame) -> DataFrame:
    """(session, field, change_kind) between each file and its client's previous one.

    ``files`` has session, client, opened_at; ``schemas`` comes from
    ``file_schemas`` with column ``file``.
    """
    once = files.where("session is not null and client is not null").groupBy("session").agg(F.min_by(F.struct("client", "opened_at"), F.struct("opened_at", "client")).alias("f"))
    known = once.select("session", "f.client", "f.opened_at").join(schemas.select(F.col("file").alias("session"), "fields"), "session")
    paired = with_previous(known, "client", ["opened_at", "session"], "fields", F.date_trunc("day", "opened_at")).where("prev is not null")
    both = paired.select(
        "session",
        "prev",
        "fields",
        F.explode(F.array_distinct(F.concat(F.map_keys("prev"), F.map_keys("fields")))).alias("field"),
    ).select("session", "field", F.col("prev")[F.col("field")].alias("a"), F.col("fields")[F.col("field")].alias("b"))
    kinds = F.array(
        F.when(F.col("a").isNull(), "added"),
        F.when(F.col("b").isNull(), "removed"),
        F.when(F.col("a.names") != F.col("b.names"), "renamed"),
        F.when(_json_types("a.kinds") != _json_types("b.kinds"), "retyped"),
    )
    return both.select("session", "field", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("change_kind"))


def union_schema(schemas: DataFrame) -> DataFrame:
    """(field, names, kinds, promoted, files): the lattice join over all files.

    Each task folds its files to one row per field before the shuffle.
    """
    kinds = schemas.select("file", F.explode("fields").alias("field", "s"))
    folded = kinds.groupBy("field").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("s.names")))).alias("names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("s.kinds")))).alias("kinds"),
        F.count_distinct("file").alias("files"),
    )
    # content and is_error have a fixed meaning, so their target type is fixed too
    fixed = F.when(F.col("field") == "is_error", "boolean").when(F.col("field") == "content", "string").otherwise(promoted(F.col("kinds")))
    return folded.withColumn("promoted", fixed).select("field", "names", "kinds", "promoted", "files")


def as_boolean(v: Column) -> Column:
    """A flag however it was written: true, 1, "true", "1", "yes", "error"; null if unreadable."""
    word = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    return (
        F.when(word.isin("true", "1", "yes", "y", "error", "failed"), True)
        .when(word.isin("false", "0", "no", "n", "", "ok", "none"), False)
        .when(word.rlike(r"^-?\d+(\.\d+)?$"), word.cast("double") != 0)
    )


def cast_to(v: Column, kind: str) -> Column:
    """A VARIANT as a type of the lattice at or above its own; strings of arrays and objects are their JSON text."""
    if kind != "string":
        return F.try_variant_get(v, "$", CAST[kind])
    s = F.schema_of_variant(v)
    return F.when(s.startswith("ARRAY") | s.startswith("OBJECT"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))


def consistent_results(results: DataFrame, union: DataFrame | None = None) -> DataFrame:
    """One table of tool results: session, seq, block, tool_use_id, content, is_error, and a struct ``fields`` of all others.

    ``results`` has session, seq, block and the block ``b`` as VARIANT; ``union`` is what
    ``union_schema`` gives (of the results themselves where it is not given), one row per
    field, which is collected: it is the table's schema.  ``content`` is the text of the
    content under whatever name and shape, ``is_error`` a boolean, every further field has
    its promoted type.  A second name of content or is_error in one block is a field of its
    own, as string.  Names that differ in case only are numbered.
    """
    union = union_schema(file_schemas(results, "session", "b")) if union is None else union
    schema = {r["field"]: (r["names"], r["promoted"]) for r in union.collect()}
    m = F.col("_m")
    columns = {n: cast_to(m[n], kind) for n, (_, kind) in sorted(schema.items()) if n not in ALIASES}
    for f, names in ALIASES.items():
        for k, n in enumerate(names):
            if k and n in schema.get(f, ((), ""))[0]:
                columns[n] = F.when(F.coalesce(*[m[x] for x in names[:k]]).isNotNull(), cast_to(m[n], "string"))
    seen: dict[str, int] = {}
    named = []
    for n, c in columns.items():
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        named.append(c.alias(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}"))
    present = F.map_filter(vget("b", "$", "map<string,variant>"), lambda k, v: v.isNotNull() & ~F.is_variant_null(v))
    c = results.select("session", "seq", "block", vget("b", "$.tool_use_id", "string").alias("tool_use_id"), present.alias("_m"), first_present("b", CONTENT_NAMES).alias("_c"), first_present("b", ERROR_NAMES).alias("_e"))
    fields = F.struct(*named) if named else F.struct(F.lit(None).cast("string").alias("none"))
    return c.select("session", "seq", "block", "tool_use_id", content_text("_c").alias("content"), as_boolean(F.col("_e")).alias("is_error"), fields.alias("fields"))
