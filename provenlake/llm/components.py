"""Connected components by alternating large-star and small-star steps.

Both steps are a partial aggregate (the least neighbour of a node) and an
equi-join back on the node; no neighbourhood is ever collected, so a node with a
third of all edges costs only rows of a skewed join, which AQE splits.  Edges
are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenlake.session import discard, written


def _large_star(e: DataFrame) -> DataFrame:
    nb = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = nb.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return nb.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge; edges (u, v) are bigint pairs.

    ``component`` is the least node id of the component.  Nodes without edges to
    another node do not come out: they are their own component.
    """
    spark = edges.sparkSession
    e, path = written(edges.toDF("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        nxt, new_path = written(_small_star(_large_star(e)))
        discard(spark, path)
        e, path = nxt, new_path
        state = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def components_of(rows: DataFrame, key: str, ties: dict) -> DataFrame:
    """``key`` and ``component`` for every row; rows are tied if they share a value of any tie.

    ``ties`` maps a name to a Column giving the tie's value, null where it ties
    nothing.  Each value links its rows to the least of them: a star, never pairs.
    """
    long = rows.select(key, F.explode(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("tie"), c.alias("value"))) for n, c in ties.items()])).alias("t")).where("t is not null").select(key, "t.tie", "t.value")
    least = long.groupBy("tie", "value").agg(F.min(key).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = long.join(least, ["tie", "value"]).select(F.col(key).alias("u"), F.col("least").alias("v"))
    cc = connected_components(edges)
    return rows.select(key).distinct().join(cc, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("component"))
