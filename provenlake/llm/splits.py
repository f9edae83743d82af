"""Splits that keep related records together.

Method: grouped iterative stratification.  Components of tied entries are found
(star steps, no pairs), their label vectors are aggregated, and components are
placed with the rarest outstanding label first into the split needing it most.

At scale the placing has three parts, so that no loop runs over all components.
Components so large that they could unbalance a split (at least ``GIANT`` of all
entries, hence at most ``1 / GIANT`` of them) are placed one by one first.  All others
but ``TAIL`` are placed in one distributed pass: a driver loop over label presence
patterns (at most 2 ** labels rows, independent of the data size) fixes the order of
labels and the share of each split, and every component takes the split in which the
middle of its stretch of the running total falls.  The ``TAIL`` components, the first
in hash order, are then placed one by one by what the splits still need, which evens
out what the pass rounded.

Defined results: missing or placeholder values (null, blank, '-', n/a, unknown,
none) tie nothing; an entry without ties is its own component; an entry listed
twice (same id) counts once, tied by the values of all its rows, with the least
(split, bytes) of them; spellings of one split are one; an empty table gives
an empty result; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.llm.components import components_of
from provenlake.session import written

PROPORTIONS = {"train": 0.8, "dev": 0.1, "test": 0.1}
GIANT = 0.002
TAIL = 1000
BUCKETS = 1024
MISSING = ("", "unknown", "na", "none", "null", "nil", "anonymous", "missing", "undefined", "tbd")
SPELLINGS = {"training": "train", "trn": "train", "validation": "dev", "valid": "dev", "val": "dev", "development": "dev", "testing": "test"}


def present(c: Column) -> Column:
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(~bare.isin(*MISSING), c)


def file_key(c: Column) -> Column:
    """The file named, apart from directory, extension and case."""
    base = F.regexp_extract(F.trim(F.lower(c)), r"([^/\\]*)$", 1)
    return present(F.regexp_replace(base, r"(\.[a-z][a-z0-9]*)+$", ""))


def digest_key(c: Column) -> Column:
    return present(F.trim(F.lower(c)))


def person_key(c: Column) -> Column:
    """An operator apart from case, blanks and separators."""
    return present(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""))


def split_key(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    out = s
    for k, v in SPELLINGS.items():
        out = F.when(s == k, v).otherwise(out)
    return F.when(~s.isin(*MISSING), out)


def tied_entries(manifest: DataFrame) -> DataFrame:
    """(entry_id, component, old, bytes): each entry once, with its group and its cleaned split."""
    keys, _ = written(
        manifest.where("entry_id is not null").select(
            "entry_id", split_key(F.col("split")).alias("old"), "bytes", file_key(F.col("file")).alias("f"), digest_key(F.col("source_sha256")).alias("d"), person_key(F.col("operator")).alias("o")
        )
    )
    cc = components_of(keys, "entry_id", {"file": F.col("f"), "source": F.col("d"), "operator": F.col("o")})
    once = keys.groupBy("entry_id").agg(F.min(F.struct("old", "bytes")).alias("r")).select("entry_id", "r.old", "r.bytes")
    return written(once.join(cc, "entry_id"))[0]


def broken_ties(tied: DataFrame) -> DataFrame:
    """Entries whose component holds two or more different existing splits."""
    bad = tied.groupBy("component").agg(F.min("old").alias("a"), F.max("old").alias("b")).where("a <> b").select("component")
    return tied.join(bad, "component", "left_semi").select("entry_id")


def default_labels() -> dict[str, Column]:
    """Labels to balance: the existing split and the size class of the file."""
    size = F.floor(F.log2(F.greatest(F.col("bytes"), F.lit(1))) / 2)
    out = {f"old={s}": F.col("old") == s for s in ("train", "dev", "test")}
    out |= {f"size<{4 ** (k + 1)}": size == k for k in range(4, 8)}
    return out | {"size small": size < 4, "size large": size >= 8, "size unknown": F.col("bytes").isNull()}


def stratified_splits(tied: DataFrame, proportions: dict[str, float] | None = None, labels: dict[str, Column] | None = None) -> DataFrame:
    """(entry_id, component, split)."""
    proportions = proportions or PROPORTIONS
    labels = default_labels() if labels is None else labels
    names, splits = list(labels), list(proportions)
    groups = tied.groupBy("component").agg(F.count("*").alias("n"), F.array(*[F.count_if(F.coalesce(c, F.lit(False))) for c in labels.values()]).alias("vec"))
    groups, _ = written(groups)
    total = groups.agg(F.sum("n")).first()[0] or 0
    mask = F.expr("aggregate(transform(vec, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    giant = F.col("n") >= max(2, GIANT * total)
    small = groups.where(~giant).withColumn("_h", F.xxhash64("component"))
    tail = small.orderBy("_h", "component").limit(TAIL).collect()
    if tail:
        h, c = tail[-1]["_h"], tail[-1]["component"]
        small = small.where((F.col("_h") > h) | ((F.col("_h") == h) & (F.col("component") > c)))
    patterns = small.groupBy(mask.alias("mask")).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("vec")[i]) for i in range(len(names))]).alias("vec")).collect()
    giants = groups.where(giant).orderBy(F.desc("n"), "component").collect()
    sums = [sum(r["vec"][i] for r in [*patterns, *giants, *tail]) for i in range(len(names))]
    need = {s: [proportions[s] * t for t in sums] for s in splits}
    room = {s: proportions[s] * total for s in splits}

    def rarest(units: list) -> list:
        """(unit, label) in the order of the label that is rarest among the units not yet placed; None for units without labels."""
        left, out = list(units), []
        while left:
            counts = [(sum(u["vec"][i] for u in left), i) for i in range(len(names))]
            counts = [c for c in counts if c[0] > 0]
            if not counts:
                return out + [(u, None) for u in left]
            i = min(counts)[1]
            out += [(u, i) for u in sorted((u for u in left if u["vec"][i] > 0), key=lambda u: (-u["n"], str(u)))]
            left = [u for u in left if not u["vec"][i] > 0]
        return out

    placed = []

    def place(units: list, room: dict, need: dict) -> None:
        for u, i in rarest(units):
            s = max(splits, key=lambda s: (room[s] >= u["n"], need[s][i] if i is not None else room[s], room[s], s))
            placed.append((u["component"], s))
            room[s] -= u["n"]
            need[s] = [a - b for a, b in zip(need[s], u["vec"])]

    place(giants, room, need)
    room_, need_ = dict(room), {s: list(v) for s, v in need.items()}
    shares = []
    for u, i in rarest(patterns):
        want = {s: max(0.0, need[s][i] if i is not None else room[s]) for s in splits}
        if not sum(want.values()):
            want = {s: max(0.0, room[s]) for s in splits}
        if not sum(want.values()):
            want = dict(proportions)
        whole, at = sum(want.values()), 0.0
        edges = []
        for s in splits:
            share = want[s] / whole
            at += share
            edges.append(at)
            room[s] -= share * u["n"]
            need[s] = [a - share * b for a, b in zip(need[s], u["vec"])]
        # patterns with few components would all favour the first split: each starts elsewhere on the circle
        shares.append((u["mask"], float(u["n"]), len(shares) * 0.6180339887498949 % 1.0, *edges))
    spark = tied.sparkSession
    # bounded by the pattern count, whatever the data
    table = spark.createDataFrame(shares or [(-1, 1.0, 0.0, *[1.0] * len(splits))], "mask long, whole double, start double, " + ", ".join(f"e{i} double" for i in range(len(splits))))
    # running totals in two levels: inside a hash bucket, and over the buckets
    rest = small.withColumn("mask", mask).withColumn("_b", F.pmod("_h", F.lit(BUCKETS)))
    inner = Window.partitionBy("mask", "_b").orderBy("_h", "component").rowsBetween(Window.unboundedPreceding, -1)
    before = rest.groupBy("mask", "_b").agg(F.sum("n").alias("bn"))
    outer = Window.partitionBy("mask").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("mask", "_b", F.coalesce(F.sum("bn").over(outer), F.lit(0)).alias("_from"))
    at = (F.col("_from") + F.coalesce(F.sum("n").over(inner), F.lit(0)) + F.col("n") / 2) / F.col("whole")
    at = (at + F.col("start")) % 1.0
    pick = F.coalesce(*[F.when(F.col("at") < F.col(f"e{i}"), s) for i, s in enumerate(splits)], F.lit(splits[0]))
    spread, _ = written(rest.join(before, ["mask", "_b"]).join(F.broadcast(table), "mask").withColumn("at", at).select("component", pick.alias("split"), "n", "vec"))
    # what the pass really placed; then the tail by what is still needed
    room, need = room_, need_
    for r in spread.groupBy("split").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("vec")[i]) for i in range(len(names))]).alias("vec")).collect():
        room[r["split"]] -= r["n"]
        need[r["split"]] = [a - b for a, b in zip(need[r["split"]], r["vec"])]
    place(tail, room, need)
    # bounded by TAIL and 1 / GIANT
    single = spark.createDataFrame(placed or [(-1, splits[0])], "component long, split string").where("component <> -1")
    return tied.join(spread.select("component", "split").unionByName(single), "component").select("entry_id", "component", "split")
