"""Measuring accuracy: samples, joins of extractions with labels, confusion, rates, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenlake.functions import grammar as G
from provenlake.operators.audit import STRETCH, paired
from provenlake.operators.drift import with_count

CALLS = 12
TAIL = 500
BLOCK = 1024


def normalised(c: Column, size: int | None = 120) -> Column:
    """Blanks collapsed, cut, lower case."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.lower(F.substring(flat, 1, size) if size else flat)


def prior_calls(ev: DataFrame, n: int = CALLS, tail: int = TAIL) -> DataFrame:
    """(session, seq, idx, calls): the last n calls before each text, oldest first: line, tool, input, is_error, result_tail.

    A result is visible only where it stands before the text.  Calls are numbered by
    counting inside stretches of lines; a text looks back inside a block of ``BLOCK`` call
    numbers, into which the last n calls of the block before are copied, so no window runs
    over a session.
    """
    order = ["seq", "idx"]
    numbered = with_count(ev.where("etype in ('use', 'text')").select("session", *order, "etype", "tool", "tool_id", "input"), "session", order, F.col("etype") == "use", F.floor(F.col("seq") / STRETCH), "_n")
    results = paired(ev).select("session", "tool_id", F.col("use_seq").alias("seq"), F.struct("result_seq", "result_idx", "is_error", F.right("body", F.lit(tail)).alias("result_tail")).alias("_r"))
    calls = numbered.where("etype = 'use'").join(results, ["session", "tool_id", "seq"], "left")
    one = calls.select("session", *order, "_n", F.struct("_n", F.col("seq").alias("line"), "tool", "input", "_r").alias("_c"))
    block = F.floor(F.col("_n") / BLOCK)
    again = one.where(F.col("_n") % BLOCK >= BLOCK - n).withColumn("_k", block + 1)
    rows = one.withColumn("_k", block).unionByName(again).unionByName(numbered.where("etype = 'text'").select("session", *order, "_n", F.lit(None).cast(one.schema["_c"].dataType).alias("_c")).withColumn("_k", block))
    near = Window.partitionBy("session", "_k").orderBy("_n").rangeBetween(1 - n, 0)
    seen = rows.withColumn("calls", F.array_sort(F.collect_list("_c").over(near))).where("_c is null")

    def shown(c: Column) -> Column:
        r = c["_r"]
        visible = F.struct(r["result_seq"], r["result_idx"]) < F.struct(F.col("seq"), F.col("idx"))
        return F.struct(c["line"].alias("line"), c["tool"].alias("tool"), c["input"].alias("input"), F.when(visible, r["is_error"]).alias("is_error"), F.when(visible, r["result_tail"]).alias("result_tail"))

    return seen.select("session", *order, F.transform("calls", shown).alias("calls"))


def candidates(ev: DataFrame) -> DataFrame:
    """(session, seq, idx, pos, sentence, inside): sentences and whether the wide net holds them."""
    s = ev.where("etype = 'text'").select("session", "seq", "idx", F.posexplode(G.sentences(F.col("text"))).alias("pos", "s"))
    t = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    return s.withColumn("s", t).where(F.char_length("s") >= 4).select("session", "seq", "idx", "pos", F.substring("s", 1, 400).alias("sentence"), G.has(F.col("s"), G.WIDE_NET).alias("inside"))


def sample(rows: DataFrame, key: Column, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the same ones on every run: the least keyed digests."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), key.cast("string")), 256), key).limit(n)


def stratified(rows: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def pool(rows: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Rows once, with the union of their strata."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(flag)).alias("strata"))


def match_labels(found: DataFrame, labels: DataFrame, key: str, on: list[str], text: str, label_text: str, order: str, size: int = 100) -> DataFrame:
    """Every found claim, with the first label (in ``order``) of the same place whose text one of the two begins with.

    ``key`` identifies a found claim; claims without a label have nulls.  Both texts are cut to ``size``.
    """
    a = found.withColumn("_t", normalised(F.col(text), size))
    b = labels.withColumn("_l", normalised(F.col(label_text), size))
    hit = a.join(b, on).where(F.col("_t").startswith(F.col("_l")) | F.col("_l").startswith(F.col("_t")))
    own = [c for c in labels.columns if c not in on]
    first = hit.groupBy(key).agg(F.min_by(F.struct(*own), order).alias("_b"))
    return found.join(first, key, "left").select(*found.columns, *[F.col(f"_b.{c}").alias(c) for c in own])


def pool_labels(pool_: DataFrame, stage_a: DataFrame, stage_b: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The pool with both stages of labels and the auditor's verdict: key, strata, kind, claim, truth, pred, lacks_b.

    ``stage_a`` has key, is_claim, kind; ``stage_b`` key, true_verdict, not_a_claim; ``found`` key, verdict.
    """
    one = lambda d, *c: d.groupBy(key).agg(*[F.first(x, ignorenulls=True).alias(x) for x in c])
    joined = pool_.select(key, "strata").join(one(stage_a, "is_claim", "kind"), key, "left").join(one(stage_b, "true_verdict", "not_a_claim").withColumn("_b", F.lit(True)), key, "left").join(found.groupBy(key).agg(F.min("verdict").alias("pred")), key, "left")
    said = F.coalesce("is_claim", F.lit(False))
    return joined.select(key, "strata", "kind", (said & ~F.coalesce("not_a_claim", F.lit(False))).alias("claim"), F.col("true_verdict").alias("truth"), "pred", (said & F.col("_b").isNull()).alias("lacks_b"))


def pool_scores(labelled: DataFrame, wide: int, outside: int) -> DataFrame:
    """One row: recall on the random stratum with its interval and its value adjusted for what lies outside the net,
    precision on the extracted stratum, exact and lenient verdict accuracy, false accusations and certifications.

    ``wide`` and ``outside`` are the sizes of the populations inside and outside the net.
    """
    has = lambda s: F.array_contains("strata", s)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    claim, pred, truth = F.col("claim"), F.col("pred"), F.col("truth")
    graded = claim & pred.isNotNull() & truth.isNotNull()
    backed = ("supported", "supported_weak")
    r = labelled.agg(
        n(F.col("lacks_b")).alias("missing_stage_b"), n(has("random")).alias("random"), n(has("random") & claim).alias("random_claims"), n(has("random") & claim & pred.isNotNull()).alias("found"),
        n(has("extracted")).alias("extracted"), n(has("extracted") & claim).alias("extracted_claims"), n(has("outside")).alias("outside"), n(has("outside") & claim).alias("outside_claims"),
        n(graded).alias("graded"), n(graded & (truth == pred)).alias("exact"), n(graded & ((truth == pred) | (truth.isin(*backed) & pred.isin(*backed)))).alias("lenient"),
        n(graded & (pred == "contradicted")).alias("accused"), n(graded & (pred == "contradicted") & (truth != "contradicted")).alias("false_accusations"),
        n(graded & pred.isin(*backed)).alias("certified"), n(graded & pred.isin(*backed) & truth.isin("unsupported", "contradicted")).alias("false_certifications"),
    )
    inside = F.col("random_claims") / F.nullif(F.col("random"), F.lit(0)) * wide
    beyond = F.coalesce(F.col("outside_claims") / F.nullif(F.col("outside"), F.lit(0)) * outside, F.lit(0.0))
    low, high = wilson(F.col("found"), F.col("random_claims"))
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    return r.select(
        "*", rate("found", "random_claims").alias("recall"), low.alias("recall_low"), high.alias("recall_high"), F.round(F.col("found") / F.nullif(F.col("random_claims"), F.lit(0)) * inside / (inside + beyond), 3).alias("recall_adjusted"),
        rate("extracted_claims", "extracted").alias("precision"), rate("exact", "graded").alias("accuracy"), rate("lenient", "graded").alias("accuracy_lenient"),
        rate("false_accusations", "accused").alias("accusation_rate"), rate("false_certifications", "certified").alias("certification_rate"), F.round(beyond, 1).alias("estimated_outside"),
    )


def label_scores(matched: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Per kind of label: labelled claims inside the net, found ones, missed ones, recall.

    ``matched`` has the label ``key`` of each found claim; ``labels`` key, is_claim, kind, net.
    """
    mine = labels.where("is_claim and net <> 'outside'").select(key, "kind").distinct()
    hit = mine.join(matched.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    r = hit.groupBy("kind").agg(F.count("*").alias("labelled"), F.count_if(F.col("_hit").isNotNull()).alias("found"))
    return r.select("kind", "labelled", "found", (F.col("labelled") - F.col("found")).alias("missed"), ratio(F.col("found"), F.col("labelled")).alias("recall"))


def extraction_counts(matched: DataFrame, key: str) -> DataFrame:
    """One row: extracted claims, those without a label, those labelled no claim, false accusations and certifications.

    ``matched`` has verdict and, of the label or null, key, is_claim, true_verdict.
    """
    known, real = F.col(key).isNotNull(), F.col(key).isNotNull() & F.coalesce("is_claim", F.lit(False))
    backed = F.col("verdict").isin("supported", "supported_weak")
    return matched.agg(
        F.count("*").alias("extracted"), F.count_if(~known).alias("unmatched"), F.count_if(known & ~real).alias("not_claims"), F.count_if(real).alias("true_claims"),
        F.count_if(real & (F.col("verdict") == "contradicted") & (F.col("true_verdict") != "contradicted")).alias("false_accusations"),
        F.count_if(real & backed & F.col("true_verdict").isin("unsupported", "contradicted")).alias("false_certifications"),
    )


def confusion(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    return pairs.groupBy(truth, pred).agg(F.count("*").alias("n"))


def rates(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per label: true, found, hit, recall, precision with Wilson bounds of the recall."""
    t = pairs.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("actual"), F.count_if(F.col(truth) == F.col(pred)).alias("hit"))
    p = pairs.groupBy(F.col(pred).alias("label")).agg(F.count("*").alias("found"))
    r = t.join(p, "label", "full").na.fill(0, ["actual", "hit", "found"])
    lo, hi = wilson(F.col("hit"), F.col("actual"))
    return r.select("label", "actual", "found", "hit", ratio(F.col("hit"), F.col("actual")).alias("recall"), ratio(F.col("hit"), F.col("found")).alias("precision"), lo.alias("recall_low"), hi.alias("recall_high"))


def ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b, F.lit(0)), 3)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval, null for no trials."""
    d = F.nullif(n, F.lit(0)).cast("double")
    p, z2 = k / d, z * z
    centre, half = (p + z2 / (2 * d)) / (1 + z2 / d), z * F.sqrt(p * (1 - p) / d + z2 / (4 * d * d)) / (1 + z2 / d)
    return F.round(F.greatest(F.lit(0.0), centre - half), 3), F.round(F.least(F.lit(1.0), centre + half), 3)


def pool_sessions(ev: DataFrame, calls: int = 3, texts: int = 8) -> DataFrame:
    """(session, bash_calls, texts) of sessions with enough of both to be worth labelling."""
    n = ev.groupBy("session").agg(F.count_if((F.col("etype") == "use") & (F.col("tool") == "Bash")).alias("bash_calls"), F.count_if(F.col("etype") == "text").alias("texts"))
    return n.where((F.col("bash_calls") >= calls) & (F.col("texts") >= texts))


def without_seen(rows: DataFrame, seen: DataFrame, digest: str, text: str | None = None, contaminated: str | None = None) -> DataFrame:
    """Rows whose source digest no earlier corpus holds, and whose text, if one is named, does not match a pattern; rows without either stay."""
    fresh = rows.join(seen.select(digest).where(F.col(digest).isNotNull()).distinct(), digest, "left_anti")
    return fresh.where(~F.coalesce(F.col(text).rlike(contaminated), F.lit(False))) if text and contaminated else fresh


def pool_views(pool_: DataFrame, path: str) -> None:
    """Writes the pool as JSON lines: whole, what labellers see, and one folder per stratum."""
    pool_.write.mode("overwrite").json(f"{path}/pool")
    pool_.select("id", "sentence").write.mode("overwrite").json(f"{path}/stage_a")
    pool_.withColumn("stratum", F.explode("strata")).write.mode("overwrite").partitionBy("stratum").json(f"{path}/strata")


def hints(queries: DataFrame, lessons: DataFrame, shortest: int = 4) -> DataFrame:
    """(query_id, lesson_id): lessons whose text contains a word of the query, as a substring.

    ``queries`` has query_id, text; ``lessons`` lesson_id, text.  Containment is decided once
    per pair of distinct words: a word that contains another contains its rarest run of
    ``shortest`` letters, so candidates come from an equi-join on that run.  A common run is
    joined only with words that have no rarer one.
    """
    tokens = lambda d, key, name: d.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias(name)).where(F.char_length(name) >= shortest)
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(w) - shortest + 1), lambda i: F.substr(F.col(w), i, F.lit(shortest))))
    asked, held = tokens(queries, "query_id", "word"), tokens(lessons, "lesson_id", "w")
    index = held.select("w").distinct().select("w", F.explode(runs("w")).alias("run"))
    wanted = asked.select("word").distinct().select("word", F.explode(runs("word")).alias("run")).join(index.groupBy("run").agg(F.count("*").alias("n")), "run", "left")
    rarest = wanted.groupBy("word").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    pairs = rarest.join(index, "run").where(F.col("w").contains(F.col("word"))).select("word", "w")
    return asked.join(pairs, "word").join(held, "w").select("query_id", "lesson_id").distinct()
