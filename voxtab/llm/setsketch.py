"""Near-duplicates by SetSketch registers.

A text's set holds the 64-bit hashes of its distinct word shingles. Register i of its sketch is
floor(1 - log_b h_i), cut to 16 bits, where h_i is the least of exponential values that hash i gives the shingles: a truncated
minimum on an exponential scale. The sketch of a union is the larger register of each, so long texts are sketched in
blocks. Two registers agree with about the likeness J of the sets, which makes bands of registers keys that near sets share: at
J = 0.85 a pair misses all BANDS bands of WIDTH registers with a probability of (1 - 0.85^4)^32 = 6e-11.

Counts of larger, smaller and equal registers and the known set sizes give the likelihood of J. A pair is given up when the likeliest J
is below the bound and the bound is e^LESS times less likely (some 6 standard deviations); all others are verified on the full sets.

Only distinct sets take part, so exact copies cost nothing. Members of a key meet its first member (a star), in keys of up to FEW
members each other; these pairs are verified by joins. What a larger key still holds in several components is compared in blocks of
rows, two blocks a group, whose number follows from the members and the bytes of their sets: a pair in the first band that it
shares, unless it is connected by then. So a group of copies gives few links, none is lost, and no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import table, written
from voxtab.operators.graph import components

#: Contract of op12: shingles of 5 words, 100 * intersection >= 85 * union.
SHINGLE, PERCENT = 5, 85
BANDS, WIDTH = 32, 4
REGISTERS = BANDS * WIDTH
#: Base and rate of the registers; 16-bit values.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Log-likelihood by which the bound must be worse than the likeliest J before a pair is given up.
LESS = 18.0
#: Members of a key that all meet each other by joins.
FEW = 8
#: Members and bytes of sets of a block of a larger key.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Shingles that are hashed into registers at a time, and bytes of text that become words at a time.
STEP, PIECE = 1 << 15, 1 << 22

C1, C2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)  # multipliers of a known finaliser of 32-bit hashes
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # and of 64-bit ones


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


SEEDS = (_mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; of the whole sequence if it is shorter, none without words."""
    from xxhash import xxh3_64_intdigest

    parts, at, text = [], 0, text.lower()
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words)))
        at = end
    word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(word):
        return word
    width = min(width, len(word))
    n = len(word) - width + 1
    x = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        x = _mix(x ^ word[k : k + n])
    return np.unique(x)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (rows of REGISTERS 16-bit values) of sets; an empty set has zeros."""
    size = np.array([len(s) for s in sets])
    least = np.full((REGISTERS, len(sets)), 0xFFFFFFFF, dtype=np.uint32)
    owner = np.repeat(np.arange(len(sets)), size)
    x = (np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64)).astype(np.uint32)
    for lo in range(0, len(x), STEP):
        part, own = x[lo : lo + STEP], owner[lo : lo + STEP]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        at, y, z = own[begin], np.empty_like(part), np.empty_like(part)
        for i in range(REGISTERS):
            np.multiply(np.bitwise_xor(part, SEEDS[i], out=y), C1, out=y)
            np.multiply(np.bitwise_xor(y, np.right_shift(y, 15, out=z), out=y), C2, out=y)
            least[i, at] = np.minimum(least[i, at], np.minimum.reduceat(y, begin))
    h = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**32) / RATE
    out = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)
    out[size == 0] = 0
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets from theirs."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    return more * log(above) + less * log(below) + same * log(1 - above - below)


def likeliest(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likeliest J of pairs of sets of given sizes with so many larger and smaller registers, its log-likelihood and the largest J possible."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = REGISTERS - more - less
    most = np.minimum(u / v, v / u)
    lo, hi = np.zeros_like(most), most.copy()
    for _ in range(40):  # the log-likelihood is concave: thirds
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = _log_likelihood(a, u, v, more, less, same) < _log_likelihood(b, u, v, more, less, same)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    j = (lo + hi) / 2
    return j, _log_likelihood(j, u, v, more, less, same), most


def may_be_near(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (rows of registers and set sizes) whose likeness can reach the bound."""
    ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    x, y = n_a.astype(float), n_b.astype(float)
    j, best, most = likeliest(x, y, more, less)
    u, v, bound = x / (x + y), y / (x + y), np.minimum(percent / 100, most)
    return ok & ((j >= bound - 1e-9) | (best - _log_likelihood(bound, u, v, more, less, REGISTERS - more - less) <= LESS))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, REGISTERS)


def sketches(docs: DataFrame, columns: list[str], schema: str, sets: bool = False, width: int = SHINGLE) -> DataFrame:
    """columns, n, set_id and regs of docs, whose ``__text`` column holds bytes; or with sets the set itself for regs."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in frames:
            at = 0
            while at < b.num_rows:  # batches of bounded text
                own, size, begin = [], 0, at
                while at < b.num_rows and size < PIECE:
                    text = b.column("__text")[at].as_py()
                    own.append(shingles(text, width))
                    size, at = size + len(text), at + 1
                n = np.array([len(s) for s in own])
                if sets:
                    value = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(np.concatenate(own).view(np.int64)))
                else:
                    value = pa.array([r.tobytes() for r in registers(own).astype("<u2")], pa.binary())
                more = [pa.array(n, pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), value]
                yield pa.RecordBatch.from_arrays([*(b.column(c)[begin:at] for c in columns), *more], [*columns, "n", "set_id", "s" if sets else "regs"])

    return docs.select(*columns, "__text").mapInArrow(run, f"{schema}, n bigint, set_id binary, {'s array<bigint>' if sets else 'regs binary'}")


def _can_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of nodes whose registers do not rule them out."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                ok = may_be_near(_matrix(f["regs_a"]), _matrix(f["regs_b"]), f["n_a"].to_numpy(), f["n_b"].to_numpy(), percent)
                yield f.loc[ok, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a bigint, b bigint")


def links_in_blocks(node: np.ndarray, label: np.ndarray, side: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], band: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect all near pairs of nodes whose first common band this is; equal labels are connected already.

    With two sides only pairs across them count.
    """
    n = np.array([len(s) for s in sets])
    begin = np.r_[0, np.cumsum(n)[:-1]]
    column = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    cross = bool((side != side[0]).any())
    label, marked, out = label.copy(), np.zeros(int(column.max()) + 1, dtype=bool), []
    bands = np.ascontiguousarray(regs).view("<u8").reshape(len(node), BANDS)
    for i in range(len(node) - 1):
        later = slice(i + 1, None)
        fits = (label[later] != label[i]) & (100 * np.minimum(n[later], n[i]) >= percent * np.maximum(n[later], n[i]))
        if cross:
            fits &= side[later] != side[i]
        j = np.flatnonzero(fits) + i + 1
        if len(j):
            j = j[(bands[j, : band + 1] == bands[i, : band + 1]).argmax(axis=1) == band]
        if len(j):
            j = j[may_be_near(regs[j], np.broadcast_to(regs[i], (len(j), REGISTERS)), n[j], np.full(len(j), n[i]), percent)]
        if not len(j):
            continue
        marked[column[begin[i] : begin[i] + n[i]]] = True
        ends = np.cumsum(n[j])
        at = np.arange(ends[-1]) + np.repeat(begin[j] - (ends - n[j]), n[j])
        common = np.add.reduceat(marked[column[at]].astype(np.int64), ends - n[j])
        marked[column[begin[i] : begin[i] + n[i]]] = False
        for k in j[100 * common >= percent * (n[i] + n[j] - common)]:
            if label[k] != label[i]:
                out.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return out


def _block_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of keys with several components; members: key, band, id, label, nb (blocks of the key)."""
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("nb")).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", "band", "id", "label", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") < F.col("other")).cast("int").alias("side"))
    rows = rows.join(nodes.select("id", "regs"), "id").join(sets, "id")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        two = f["p"].iloc[0] != f["q"].iloc[0]
        f = f.sort_values("id", ignore_index=True)
        side = f["side"].to_numpy() if two else np.zeros(len(f), dtype=int)
        if len(f) < 2 or two and (side == side[0]).all():
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        found = links_in_blocks(f["id"].to_numpy(), f["label"].to_numpy(), side, _matrix(f["regs"]), [np.asarray(s) for s in f["s"]], int(f["band"].iloc[0]), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("key", "p", "q").applyInPandas(run, "a bigint, b bigint")


def near_sets(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Rows link if 100 * intersection >= percent * union of their shingle sets; rows of equal sets always do. A null or empty
    text, and one of white space only, has no set and links with nothing. Repeated rows get the same values. A null
    doc_id takes part but is never a component's id unless it has no other. An empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("__text"))
    rows = written(sketches(source, ["doc_id"], "doc_id bigint", width=width), "sketches")
    nodes = rows.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "sketch-sets")
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), t -> struct(t AS band, xxhash64(substring(regs, t * {2 * WIDTH} + 1, {2 * WIDTH}), t) AS key))")
    bands = nodes.select("id", "n", F.inline(band))
    shared = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.sum("n").alias("total")).filter("c > 1")
    members = written(bands.select("id", "band", "key").join(shared, "key"), "sketch-members")
    few = members.filter(F.col("c").between(3, FEW)).select("key", "id")
    pairs = members.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    pairs = pairs.union(few.withColumnRenamed("id", "a").join(few.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b")).distinct()
    pairs = written(_can_link(pairs, nodes, percent), "sketch-pairs")
    many = members.filter(F.col("c") > FEW)
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct().join(nodes, "id").select("id", "set_id", "first")
    heads = need.select(F.col("first").alias("doc_id")).distinct()
    texts = source.join(heads, source["doc_id"].eqNullSafe(heads["doc_id"]), "left_semi")
    sets = sketches(texts, ["doc_id"], "doc_id bigint", sets=True, width=width)
    sets = written(sets.join(need.select("id", "set_id"), "set_id").groupBy("id").agg(F.first("s").alias("s")), "sketch-full-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = written(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "sketch-links")
    labels = components(links)
    many = many.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id"))
    many = written(many.select("key", "band", "id", "label", "c", "total"), "sketch-many")
    loose = many.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(8 * F.col("total") / BLOCK_BYTES), F.lit(1)).cast("int")
    many = many.join(loose, "key", "left_semi").withColumn("nb", F.least(blocks, F.col("c").cast("int")))
    if not many.isEmpty():
        links = written(links.union(_block_links(many, nodes, sets, percent)), "sketch-links")
        labels = components(links)
    known = nodes.select("id", "set_id", "first").join(labels.withColumnRenamed("node", "id"), "id").select("set_id", "first", "root")
    lowest = known.groupBy("root").agg(F.min("first").alias("component"))
    single = nodes.select("set_id", "first")
    component = single.join(known.join(lowest, "root").select("set_id", "component"), "set_id", "left").select("set_id", F.coalesce("component", "first").alias("component"))
    out = rows.select("doc_id", "n", "set_id").join(component, "set_id", "left")
    root = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_sets of all documents at 5 words and a likeness of 0.85; see there for nulls, empty texts and repeated rows."""
    return near_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))
