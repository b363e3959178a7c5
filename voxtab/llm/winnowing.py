"""Document fingerprints by winnowing.

Words (lower-cased, split at white space) are hashed, every K consecutive words give one k-gram hash (made from the K word
hashes: columns keep no state from which a hash could roll on to the next), and
of every W consecutive hashes the smallest is kept, the rightmost where several are equal. Two texts that share
K + W - 1 words in a row therefore share a fingerprint entry; entries keep the position (number of the first word).
A text of fewer than K words has its whole word sequence as one gram, one of no words an empty fingerprint.

An entry is one long: the gram's upper 32 hash bits above 2**31 - 1 - position, so that the smallest long is the
smallest hash with the rightmost position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import SPACE, table, written

K = 5
W = 8
LAST = 2**31 - 1
#: Neighbouring ids that are sorted together (2**6).
NEAR_BITS = 6
#: Rows of a bucket of neighbouring ids beyond which it is split by id and tie, and equal rows beyond which they are counted.
BUCKET_ROWS = 4096
#: Buckets (some 40 bytes each) that are broadcast at most; with more of them the join shuffles.
BROADCAST_ROWS = 1_000_000


def _word_hashes(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(F.lower(bare), SPACE + "+"), lambda x: F.xxhash64(x)))


def _grams(h: Column, k: int) -> Column:
    """Packed entries of all k-grams of an array column of word hashes."""

    def packed(gram: Column, at: Column) -> Column:
        return F.shiftleft(F.shiftright(gram, 32), 32).bitwiseOR((F.lit(LAST) - at).cast("long"))

    rolling = F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.lit(0))),
        lambda x, i: packed(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]), i),
    )
    short = F.array(packed(F.xxhash64(h), F.lit(0)))
    return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, short).otherwise(rolling)


def _pair_minima(m: Column, step: int) -> Column:
    return F.transform(F.slice(m, 1, F.greatest(F.size(m) - step, F.lit(0))), lambda x, i: F.least(x, F.get(m, i + step)))


def fingerprints(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """df with the packed fingerprint of a text column as a new column; a null text counts as empty.

    Minima of w (a power of two) consecutive entries come by doubling: of 2, of 4, ... of w.
    """
    h, g = f"__h_{out}", f"__g_{out}"
    df = df.withColumn(h, _word_hashes(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(g, _grams(F.col(h), k)).drop(h).withColumn(f"{g}_1", F.col(g))
    step = 1
    while step < w:
        df = df.withColumn(f"{g}_{2 * step}", _pair_minima(F.col(f"{g}_{step}"), step)).drop(f"{g}_{step}")
        step *= 2
    m = F.col(f"{g}_{w}")
    kept = F.when(F.size(g) == 0, F.col(g)).when(F.size(g) <= w, F.array(F.array_min(g))).otherwise(F.array_distinct(m))
    return df.withColumn(out, kept).drop(g, f"{g}_{w}")


def readable(entries: Column) -> Column:
    """``hash:position`` of each entry, hash in hex, in order of position."""
    one = lambda e: F.concat(F.lower(F.hex(F.shiftrightunsigned(e, 32))), F.lit(":"), (F.lit(LAST) - e.bitwiseAND(LAST)).cast("string"))
    return F.array_join(F.transform(entries, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the hashes of two fingerprints; two empty ones are alike."""
    x, y = (F.array_distinct(F.transform(e, lambda v: F.shiftright(v, 32))) for e in (a, b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(x) + F.size(y) - both))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_following(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys (rows all different) with ``after``, a struct of the row after it in ascending order, the first after the last.

    Rows are sorted within ranges; the first row of each range, one a range, follows the last of the range before.
    """
    ranged = keys.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "next-ranges")
    whole = F.struct(*keys.columns)
    heads = ranged.groupBy("__range").agg(F.min(F.struct(*order, whole.alias("row")))["row"].alias("head"))
    ring = Window.orderBy("__range")  # a row for each range, however many keys
    heads = heads.withColumn("over", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    within = ranged.withColumn("within", F.lead(whole).over(Window.partitionBy("__range").orderBy(*order)))
    return within.join(F.broadcast(heads.select("__range", "over")), "__range").select(*keys.columns, F.coalesce("within", "over").alias("after"))


def with_next(df: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """df with ``next``, a struct of the carried columns of the row after it in ascending key, the first after the last.

    Null keys come first; rows with equal keys follow each other by ``tie`` (a long), and rows that are equal in both must be equal
    in all columns. A column ``next`` of df is replaced; names that begin with ``__`` are taken. An empty table gives no rows.

    Neighbouring ids are sorted together in buckets, and the first row of each bucket also goes, as a guest, to the
    bucket before it. Buckets of many rows (ids that repeat, nulls) are split by id and tie; of many equal rows one
    is sorted, the others are followed by their like.
    """
    low = -(2**62)
    df = df.drop("next").withColumn("__id", F.coalesce(F.col(key).cast("bigint"), F.lit(low)))
    slim = df.select("__id", F.col(tie).alias("__tie"))
    equal = written(slim.groupBy("__id", "__tie").agg(F.count("*").alias("__n")).filter(F.col("__n") > BUCKET_ROWS), "next-equal")
    spare = None
    if not equal.isEmpty():
        like = _small(equal.select(F.col("__id").alias("__e"), F.col("__tie").alias("__t"), "__n"))
        marked = df.join(like, (F.col("__id") == F.col("__e")) & (F.col(tie) == F.col("__t")), "left")
        single = marked.filter("__n is not null").dropDuplicates(["__e", "__t"])
        spare = single.withColumn("next", F.struct(*carry)).select("*", F.explode(F.sequence(F.lit(2), "__n"))).select(*df.columns, "next").drop("__id")
        df = marked.filter("__n is null").select(*df.columns).union(single.select(*df.columns))
    group = F.shiftright("__id", NEAR_BITS)
    big = slim.groupBy(group.alias("__g")).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > BUCKET_ROWS)
    big = written(big.withColumn("__bits", F.least(F.lit(40), F.ceil(F.log2(F.col("__rows") / BUCKET_ROWS)) + 1).cast("int")).select("__g", "__bits"), "next-big")
    if big.isEmpty():
        b1, b2 = group, F.lit(0).cast("bigint")
    else:
        df = df.join(_small(big), group == F.col("__g"), "left").drop("__g")
        b1 = F.when(F.col("__bits").isNull(), group).otherwise(F.shiftright("__id", NEAR_BITS))
        b2 = F.when(F.col("__bits").isNull(), F.lit(0)).otherwise(F.expr(f"shiftright({tie}, 64 - __bits)")).cast("bigint")
    sub = F.lit(0).cast("bigint") if big.isEmpty() else F.when(F.col("__bits").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("__id"))
    df = df.withColumn("__b1", b1).withColumn("__b2", sub).withColumn("__b3", b2).drop("__bits")
    names = ["__b1", "__b2", "__b3"]
    buckets = df.groupBy(*names).agg(F.min(F.struct(F.col("__id").alias("i"), F.col(tie).alias("t"))).alias("__first"))
    after = _with_following(buckets, names)
    before = after.select(F.struct(*names).alias("__before"), *[F.col(f"after.{n}").alias(n) for n in names], F.col("after.__first").alias("__first"))
    links = _small(written(before, "next-links"))
    rows = df.join(links, names, "left")
    seats = F.array(F.struct(F.struct(*names).alias("b"), F.lit(0).alias("g")), F.struct(F.col("__before").alias("b"), F.lit(1).alias("g")))
    seats = F.when(F.struct(F.col("__id").alias("i"), F.col(tie).alias("t")) == F.col("__first"), seats).otherwise(F.slice(seats, 1, 1))
    rows = rows.withColumn("__seat", F.explode(seats)).drop(*names, "__first", "__before")
    # Of several equal rows that come first each is a guest; the guest's place among them does not matter.
    order = Window.partitionBy("__seat.b").orderBy("__seat.g", "__id", tie)
    rows = rows.withColumn("next", F.lead(F.struct(*carry)).over(order)).filter("__seat.g = 0").drop("__seat", "__id")
    return rows if spare is None else rows.unionByName(spare)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprints(docs, "text", "fp").withColumn("h", F.xxhash64("text"))
    pairs = with_next(docs, "doc_id", "h", ["text", "fp"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.text", F.lit(1), quarter))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fp", edited.alias("edited"), F.col("next.fp").alias("next_fp"))
    pairs = fingerprints(pairs, "edited", "edited_fp")
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        readable(F.col("fp")).alias("fingerprint"),
        readable(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
