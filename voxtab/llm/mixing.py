"""Mixing sources to target weights by entropy balancing.

Each source's target is its weighted share of all words, stopped at ``cap`` times what the source has, the excess going
to the others by weight. Document rates r minimise the relative entropy to one copy each, sum(r log r - r), under
the token constraint sum(r * size) = target of the source and r <= cap. The convex dual has one variable per source;
its optimum gives exponentially tilted rates r = min(cap, exp(lambda * size / mean size)). Distributed Newton steps
find lambda: each is one aggregation over (source, size) classes, kept inside a bracket. Rates are then rounded into
whole copies along ascending size, so that a source's rounding error stays within one document, and a few further
steps add or take single copies whose size is nearest to what is left.
All sums are exact decimals, so reruns agree.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import SPACE, cut, table, written

WEIGHTS = (1, 2, 3)
CAP = 3
STEPS = 60
TOLERANCE = 1e-9
TOUCH_UPS = 6
#: Documents of a (source, size) class that one task ranks at once; larger classes are salted, and rows that are all equal are dealt out.
CLASS_ROWS = 2000
#: Classes are broadcast up to this many rows (about 50 bytes each).
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none."""
    parts = F.size(F.split(text, SPACE + "+"))
    edges = text.rlike("^" + SPACE).cast("int") + text.rlike(SPACE + r"\z").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(parts - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, s_id, source_size, target from rows of (source, source_size), one per source.

    Water filling: with sources in order of cap / weight, all before some place stop at their caps and the others share
    the rest by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "s_id")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    kind = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("s_id") - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("s_id", F.row_number().over(order)).withColumn("weight", kind.cast("double"))
    out = out.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    out = out.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "s_id", "level"))).over(whole)["level"]
    return out.select("source", "s_id", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def solve(classes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """s_id, lam: the optimum of the dual. classes: s_id, size, n, c; goals: s_id, target, full."""
    exact = "decimal(38,6)"
    lam = goals.select("s_id", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    lam = cut(lam.filter(~goals["full"] & (F.col("target") > 0)))
    for _ in range(STEPS):
        rate = F.exp(F.col("lam") * F.col("c"))
        words = F.col("n") * F.col("size")
        sums = classes.join(lam, "s_id").groupBy("s_id", "target", "lam", "lo", "hi", "done").agg(
            F.sum((words * F.least(F.lit(float(cap)), rate)).cast(exact)).cast("double").alias("s"),
            F.sum(F.when(rate < cap, words * F.col("c") * rate).otherwise(0.0).cast(exact)).cast("double").alias("ds"),
        )
        off = F.log(F.col("target")) - F.log(F.greatest("s", F.lit(1e-6)))
        sums = sums.withColumn("off", off).withColumn("lo", F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("lo")))
        sums = sums.withColumn("hi", F.when(F.col("off") <= 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.when(F.col("ds") > 0, F.col("lam") + F.col("off") * F.col("s") / F.col("ds"))
        inside = step.isNotNull() & ((step > F.col("lo")) | F.col("lo").isNull()) & ((step < F.col("hi")) | F.col("hi").isNull())
        middle = (
            F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        done = F.abs(F.col("off")) < TOLERANCE
        nxt = F.when(F.col("done") | done, F.col("lam")).when(inside, step).otherwise(middle)
        lam = cut(sums.select("s_id", "target", nxt.alias("lam"), "lo", "hi", (F.col("done") | done).alias("done")))
        if lam.filter(~F.col("done")).isEmpty():
            break
    else:
        warnings.warn(f"{lam.filter(~F.col('done')).count()} sources are not within {TOLERANCE} of their targets after {STEPS} steps", stacklevel=2)
    return lam.select("s_id", F.round("lam", 9).alias("lam"))


def allot(classes: DataFrame, goals: DataFrame, lam: DataFrame, cap: int = CAP) -> DataFrame:
    """s_id, size, n, copies: whole copies of all documents of each class together."""
    tilt = F.when(F.col("full"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.coalesce("lam", F.lit(0.0)) * F.col("c"))))
    rated = classes.join(goals.select("s_id", "full"), "s_id").join(lam, "s_id", "left").withColumn("mass", F.col("n") * tilt)
    along = Window.partitionBy("s_id").orderBy("size")
    upto = F.floor(F.sum("mass").over(along.rowsBetween(Window.unboundedPreceding, 0)) + 1e-6)
    out = rated.withColumn("upto", upto).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)))
    out = cut(out.select("s_id", "size", "n", F.least("copies", cap * F.col("n")).cast("long").alias("copies")))
    for _ in range(TOUCH_UPS):
        left = out.groupBy("s_id").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(goals.select("s_id", "target"), "s_id")
        left = left.select("s_id", (F.col("target") - F.col("taken")).alias("left"))
        near = out.join(left, "s_id").filter(
            (F.col("size") > 0) & (F.col("size") < 2 * F.abs("left")) & (((F.col("left") > 0) & (F.col("copies") < cap * F.col("n"))) | ((F.col("left") < 0) & (F.col("copies") > 0)))
        )
        pick = near.groupBy("s_id").agg(
            F.min_by("size", F.struct(F.abs(F.abs("left") - F.col("size")), "size")).alias("at"), F.max(F.signum("left")).cast("long").alias("sign")
        )
        out = out.join(pick, "s_id", "left").withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("at"), F.col("sign")).otherwise(0))
        out = cut(out.select("s_id", "size", "n", "copies"))
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, carry: list[str] | None = None) -> DataFrame:
    """row (a struct of the carried columns, all if not given), size, source_size, target, copies for every row of docs.

    docs: doc_id, source, text and any other columns, whatever their names. A null text has size 0; a null source is the last
    source; a null doc_id counts like any other. Rows of size 0 keep one copy unless their source is full. Repeated rows count and are taken like
    different ones. Of rows with equal doc_id and text it is open which take the odd copies. An empty table gives no rows. docs are to be read from
files, whose splits stay the same from one job to the next.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in carry or docs.columns]).alias("row"),
        docs["source"].alias("source"),
        n_words(docs["text"]).alias("size"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("h"),
    )
    groups = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    goals = targets(groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs")).select("source", "source_size"), weights, cap)
    goals = cut(goals.withColumn("full", F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)))
    keys = goals.select(F.col("source").alias("s"), "s_id", "source_size")
    mean = groups.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    classes = groups.join(keys, groups["source"].eqNullSafe(keys["s"])).join(
        mean.withColumnRenamed("source", "m"), groups["source"].eqNullSafe(F.col("m"))
    )
    classes = cut(classes.select("s_id", "size", "n", (F.col("size") / F.greatest("mean", F.lit(1e-9))).alias("c")))
    plan = written(allot(classes, goals, solve(classes, goals, cap), cap), "mix-plan")
    plan = written(plan.join(goals.select("s_id", "source", "source_size", "target"), "s_id"), "mix-targets")
    plan = plan.select(*[F.col(c).alias("p_" + c) for c in plan.columns])
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    planned = lambda rows: rows.join(plan, rows["source"].eqNullSafe(plan["p_source"]) & (rows["size"] == plan["p_size"]))
    out = planned(rows)
    salt = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.floor(F.col("p_n") / CLASS_ROWS)))
    # Rows that are equal have one hash and one salt; many of them are dealt out by where they stand in the table.
    equal = out.filter(F.col("p_n") >= 2 * CLASS_ROWS).groupBy(F.col("h").alias("e_h")).agg(F.count("*").alias("e_n")).filter(F.col("e_n") > CLASS_ROWS)
    equal = written(equal, "mix-equal")
    many = equal.count()
    if many:
        # The number is given where docs are read and not behind a shuffle, so that the job that counts salts and the one that ranks see the same.
        out = planned(rows.withColumn("seq", F.monotonically_increasing_id())).join(F.broadcast(equal) if many <= BROADCAST_ROWS else equal, F.col("h") == F.col("e_h"), "left")
        salt = F.when(F.col("e_h").isNull(), salt).otherwise(F.xxhash64("h", F.pmod(F.xxhash64("seq"), F.ceil(F.col("e_n") / CLASS_ROWS))))
    out = out.withColumn("salt", salt)
    # How many of the class's odd copies each salt gets, by prefix sums over salts: only classes and salts, no rows.
    salts = out.groupBy("p_s_id", "p_size", "p_n", "p_copies", "salt").agg(F.count("*").alias("m"))
    salts = salts.filter(F.col("p_n") >= 2 * CLASS_ROWS)
    along = Window.partitionBy("p_s_id", "p_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    whole = "decimal(20,0)"
    odd = F.pmod("p_copies", "p_n").cast(whole)
    salts = salts.withColumn("upto", F.sum("m").over(along).cast(whole))
    share = F.floor(odd * F.col("upto") / F.col("p_n")) - F.floor(odd * (F.col("upto") - F.col("m").cast(whole)) / F.col("p_n"))
    salts = written(salts.select(F.col("p_s_id").alias("a"), F.col("p_size").alias("b"), F.col("salt").alias("k"), share.cast("long").alias("share")), "mix-salts")
    if salts.count() <= BROADCAST_ROWS:
        salts = F.broadcast(salts)
    out = out.join(salts, (out["p_s_id"] == salts["a"]) & (out["p_size"] == salts["b"]) & (out["salt"] == salts["k"]), "left")
    rank = F.row_number().over(Window.partitionBy("p_s_id", "p_size", "salt").orderBy("h"))
    extra = (rank <= F.coalesce("share", F.pmod("p_copies", "p_n"))).cast("long")
    copies = F.floor(F.col("p_copies") / F.col("p_n")) + extra
    return out.select("row", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), copies.cast("long").alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document; see ``mix`` for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, carry=["doc_id"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as often as the mix takes it, so that some are gone; all columns stay. See ``mix`` for nulls, repeats and empty tables."""
    mixed = mix(docs).filter("copies > 0")
    each = mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("row.*")
