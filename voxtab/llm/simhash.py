"""SimHash near-duplicate detection by the generalised pigeonhole principle.

A fingerprint has 64 bits; bit i is 1 if it is set in over half the XXH64 hashes of a text's features. Pairs within
``radius`` bits are found exactly: the bits are grouped into m partitions (correlated bits together, so that the
others stay selective), partition p gets a threshold t_p with sum(t) = radius - m + 1, and any pair within
the radius agrees in some partition up to its threshold. A dynamic program chooses m and the t_p that make the
fewest probe rows and candidates, estimated on a sample of fingerprints.

Partitions are probed by keys: threshold 0 by the partition's bits, 1 by all one-bit variants of one side, 2 by one-bit
variants of both sides. Rows meet by key; a group is compared in numpy blocks and gives a spanning forest of its pairs
within the radius, smallest distances first, so a group of n near copies gives fewer than n links. Keys with over
HEAVY members are split into pairs of blocks, each a group of its own. Only distinct fingerprints take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import SPACE, cut, shared_dir, table, written
from voxtab.operators.graph import components

BITS = 64
SEED = 42
#: Contract of op8: 3-word shingles, 3 bits.
SHINGLE = 3
RADIUS = 3
#: The corpus stage: fingerprints of distinct words within 6 bits, then likeness of 5-word shingles.
STAGE_RADIUS = 6
STAGE_SHINGLE = 5
STAGE_LIKENESS = 0.8
#: Fingerprints that the planner looks at (a bounded sample; it only steers costs, never results).
SAMPLE = 20_000
#: Members of a key beyond which the key is split into pairs of blocks of about this size.
HEAVY = 2048
#: Groups up to this size are compared row by row offset, larger ones by blocks.
SMALL = 32


def bits_of(hashes: list[int]) -> int:
    """Majority bits of unsigned 64-bit hashes, as a signed long; 0 for none."""
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<i8")[0])


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of all shingles of a text, repeats included; of the whole word sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = max(1, len(words) - width + 1)
    return [xxh64_intdigest(line[begins[i] : ends[min(i + width, len(words)) - 1]], SEED) for i in range(n)]


def word_hashes(text: bytes) -> list[int]:
    """XXH64 of a text's distinct words."""
    from xxhash import xxh64_intdigest

    return [xxh64_intdigest(w, SEED) for w in sorted(set(text.lower().split()))]


def fingerprints(docs: DataFrame, features: Callable[[bytes], list[int]], columns: list[str], schema: str) -> DataFrame:
    """columns and ``fp`` of docs; its ``__text`` column holds the text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # one text at a time becomes an object
            fp = [bits_of(features(t.as_py())) for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(fp, pa.int64())], [*columns, "fp"])

    return docs.select(*columns, "__text").mapInArrow(run, f"{schema}, fp bigint")


# Planning


def _columns(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(fps: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits; each takes the bits that correlate most with those it has."""
    x = _columns(fps).astype(np.float64)
    x -= x.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    corr = np.abs(x.T @ x) / np.outer(norm, norm)
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for p in range(m):
        take = BITS * (p + 1) // m - BITS * p // m
        first = max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())
        part = [first]
        free.discard(first)
        while len(part) < take:
            best = max(sorted(free), key=lambda b, part=part: corr[b, part].sum())
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def candidate_pairs(fps: np.ndarray, bits: list[int], t: int) -> float:
    """Share of all pairs of the sample that agree in the partition up to t bits."""
    keys, counts = np.unique(fps & np.int64(_mask(bits)), return_counts=True)
    pairs = float((counts.astype(float) * (counts - 1)).sum())
    flips = [_mask([b]) for b in bits]
    if t >= 2:
        flips += [_mask([a, b]) for i, a in enumerate(bits) for b in bits[i + 1 :]]
    for flip in flips if t >= 1 else []:
        other = keys ^ np.int64(flip)
        at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        pairs += float((counts * np.where(keys[at] == other, counts[at], 0)).sum())
    return (pairs + 1) / max(1.0, float(len(fps)) * (len(fps) - 1))


def plan(fps: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed; n is the number of distinct fingerprints."""
    best, chosen = np.inf, []
    for m in range(max(1, (radius + 1) // 3), radius + 2):
        parts = group_bits(fps, m)
        cost: list[dict[int, float]] = []
        for bits in parts:
            w = len(bits)
            rows = {-1: 0, 0: 1, 1: 1 + w, 2: 1 + w}
            cost.append({t: rows[t] * n + (0.05 * candidate_pairs(fps, bits, t) * n * n if t >= 0 else 0) for t in rows})
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for total, (value, ts) in state.items():
                for t, price in c.items():
                    if total + t not in nxt or value + price < nxt[total + t][0]:
                        nxt[total + t] = (value + price, [*ts, t])
            state = nxt
        got = state.get(radius - m + 1)
        if got and got[0] < best:
            best, chosen = got[0], [(bits, t) for bits, t in zip(parts, got[1], strict=True) if t >= 0]
    return chosen


# Probing


def _forest(node: np.ndarray, fp: np.ndarray, index: np.ndarray, bit: np.ndarray, radius: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Spanning forest of the pairs within the radius, smallest distances first, of one group, and the tree of each row."""
    n = len(node)
    found: list[list[np.ndarray]] = [[] for _ in range(radius + 1)]
    for lo in range(0, n, 512):
        d = np.bitwise_count((fp[lo : lo + 512, None] ^ fp[None, :]).view(np.uint64))
        meet = (index[lo : lo + 512, None] | index[None, :]) & ((bit[lo : lo + 512, None] != bit[None, :]) | (bit[None, :] < 0))
        i, j = np.nonzero((d <= radius) & meet)
        keep = i + lo < j
        i, j = i[keep], j[keep]
        dist = d[i, j]
        for r in range(radius + 1):
            at = dist == r
            found[r].append(np.stack([i[at] + lo, j[at]]).astype(np.int32))
    label = np.arange(n)
    links = []
    for level in found:
        pairs = np.concatenate(level, axis=1) if level else np.zeros((2, 0), dtype=np.int32)
        while True:
            a, b = label[pairs[0]], label[pairs[1]]
            keep = a != b
            pairs, a, b = pairs[:, keep], a[keep], b[keep]
            if not len(a):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            top, at = np.unique(high, return_index=True)  # one link from each higher tree to a lower one: no cycles
            links.append(np.stack([node[pairs[0][at]], node[pairs[1][at]]]))
            parent = np.arange(n)
            parent[top] = low[at]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            label = parent[label]
    return links, label


def links_of_groups(g: np.ndarray, node: np.ndarray, fp: np.ndarray, index: np.ndarray, bit: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of sorted groups of rows, and (group, tree, node) of trees that stand for more pairs than their links.

    Rows that both flipped the same bit agree without it and meet under another key.
    """
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[begin, len(g)])
    links, trees = [], []
    for b, s in zip(begin[size > SMALL], size[size > SMALL], strict=True):
        own, tree = _forest(node[b : b + s], fp[b : b + s], index[b : b + s], bit[b : b + s], radius)
        links += own
        at = np.flatnonzero(np.bincount(tree, minlength=s)[tree] > 2)
        if len(at):
            trees.append(np.stack([g[b + at], tree[at], node[b + at]]))
    small = np.repeat(size <= SMALL, size)
    g, node, fp, index, bit = g[small], node[small], fp[small], index[small], bit[small]
    for step in range(1, SMALL):
        same = g[step:] == g[:-step]
        if not same.any():
            break
        i = np.flatnonzero(same)
        near = np.bitwise_count((fp[i] ^ fp[i + step]).view(np.uint64)) <= radius
        i = i[near & (index[i] | index[i + step]) & ((bit[i] != bit[i + step]) | (bit[i] < 0))]
        links.append(np.stack([node[i], node[i + step]]))
    return links, trees


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b (a < b): links between nodes (node, fp) that connect all pairs within the radius. nodes: distinct, written."""
    return links_and_trees(nodes, radius).filter("g is null").select("a", "b")


def links_and_trees(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b of links, with g null; and for trees of large groups g, the group, a, the tree, and b, a node of it.

    Every pair within the radius is a link or is within one tree.
    """
    n = nodes.count()
    if n < 2:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("node").alias("g")).filter(F.lit(False))
    share = min(1.0, SAMPLE / n)
    sample = nodes.filter(F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("fp").limit(2 * SAMPLE)
    fps = sample.toPandas()["fp"].to_numpy(dtype=np.int64)
    parts = plan(fps if len(fps) > 1 else np.arange(2, dtype=np.int64), n, radius)
    rows = []
    for p, (bits, t) in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        rows.append(F.struct(F.lit(p).alias("p"), key.alias("k"), F.lit(True).alias("index"), F.lit(-1).alias("bit")))
        if t >= 1:
            rows += [F.struct(F.lit(p).alias("p"), key.bitwiseXOR(F.lit(_mask([b]))).alias("k"), F.lit(t == 2).alias("index"), F.lit(b).alias("bit")) for b in bits]
    probes = nodes.select("node", "fp", F.explode(F.array(*rows)).alias("r")).select("node", "fp", "r.*")
    exact = [F.struct(F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("k")) for p, (bits, _) in enumerate(parts)]
    heavy = nodes.select(F.explode(F.array(*exact)).alias("r")).groupBy("r.p", "r.k").count().filter(F.col("count") > HEAVY)
    heavy = cut(heavy.select("p", "k", F.ceil(F.col("count") / HEAVY).cast("int").alias("nb")))
    group = F.xxhash64("p", "k")
    if not heavy.isEmpty():
        probes = probes.join(heavy, ["p", "k"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
        probes = probes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("own", own)
        group = F.xxhash64("p", "k", F.least("own", "other"), F.greatest("own", "other"))
    probes = probes.select(group.alias("g"), "node", "fp", "index", "bit").repartition("g").sortWithinPartitions("g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            if kept is not None:
                frame = pd.concat([kept, frame], ignore_index=True)
            g = frame["g"].to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            kept = frame.iloc[last:]
            yield from found(frame.iloc[:last])
        if kept is not None:
            yield from found(kept)

    def found(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(frame) > 1:
            got, trees = links_of_groups(*(frame[c].to_numpy() for c in ("g", "node", "fp", "index", "bit")), radius)
            if got:
                a, b = np.concatenate(got, axis=1)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).query("a != b").drop_duplicates().assign(g=pd.NA).astype({"g": "Int64"})
            if trees:
                g, a, b = np.concatenate(trees, axis=1)
                yield pd.DataFrame({"a": a, "b": b, "g": g}).drop_duplicates()

    return probes.mapInPandas(run, "a bigint, b bigint, g bigint").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text).

    A null or empty text, and one of white space only, has no words: its fingerprint is zero. Repeated rows get the same
    fingerprint and group. A null doc_id takes part but is never a component's id unless it has no other.
    An empty table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("__text"))
    fps = written(fingerprints(source, lambda t: shingle_hashes(t, SHINGLE), ["doc_id"], "doc_id bigint"), "simhash")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    pairs = written(links(firsts.select(F.col("fp").alias("node"), "fp"), RADIUS), "simhash-links")
    nodes = components(pairs)
    roots = firsts.join(nodes, firsts["fp"] == nodes["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = cut(roots)
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    known = roots.join(lowest, "root").select(F.col("fp").alias("f"), "component_id")
    out = fps.join(known, fps["fp"] == known["f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; see ``near_groups`` for nulls, empty texts, repeats and empty tables."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


# The corpus stage


def _shingle_sets(df: DataFrame, width: int) -> DataFrame:
    """node and s, the distinct hashes of the word shingles of column t, for each row."""
    df = df.withColumn("w", F.split(F.btrim(F.lower("t"), F.lit(" \t\n\x0b\x0c\r")), SPACE + "+"))
    n = F.greatest(F.size("w") - width + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice("w", i, width), " ")))
    return df.select("node", F.array_distinct(shingles).alias("s"))


def alike_in_tree(node: np.ndarray, fp: np.ndarray, label: np.ndarray, sets: list[np.ndarray], radius: int, likeness: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of nodes within the radius and of at least that likeness; equal labels are connected already."""
    size = np.array([len(x) for x in sets])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    label, marked, out = label.copy(), np.zeros(int(column.max()) + 1, dtype=np.int64), []
    for i in range(len(node) - 1):
        near = np.bitwise_count((fp[i + 1 :] ^ fp[i]).view(np.uint64)) <= radius
        fits = np.minimum(size[i + 1 :], size[i]) >= likeness * np.maximum(size[i + 1 :], size[i]) - 1e-9
        j = np.flatnonzero(near & fits & (label[i + 1 :] != label[i])) + i + 1
        if not len(j):
            continue
        own = column[begin[i] : begin[i] + size[i]]
        marked[own] = 1
        ends = np.cumsum(size[j])
        at = np.arange(ends[-1]) + np.repeat(begin[j] - (ends - size[j]), size[j])
        common = np.add.reduceat(marked[column[at]], ends - size[j])
        marked[own] = 0
        for k in j[common / (size[i] + size[j] - common) >= likeness]:
            if label[k] != label[i]:
                out.append((int(node[i]), int(node[k])))
                label[label == label[k]] = label[i]
    return out


def _alike(pairs: DataFrame, trees: DataFrame, sets: DataFrame, radius: int, likeness: float) -> DataFrame:
    """node, root of the graph of all pairs within the radius (of links or within a tree) and of at least that likeness.

    Links are held against each other first. A tree whose nodes they do not all connect is gone through once more with the
    shingles of its nodes (node, fp, s of sets), pair by pair except those that are connected by then.
    """
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = written(both.filter(common / (F.size("x") + F.size("y") - common) >= likeness).select("a", "b"), "dedup-alike")
    nodes = components(alike)
    if trees.isEmpty():
        return nodes
    rows = trees.join(nodes.withColumnRenamed("node", "b"), "b", "left").select("g", "a", F.col("b").alias("node"), F.coalesce("root", "b").alias("label"))
    rows = written(rows, "dedup-trees")
    loose = rows.groupBy("g", "a").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("g", "a")
    rows = rows.join(loose, ["g", "a"], "left_semi").join(sets, "node")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = alike_in_tree(*(frame[c].to_numpy() for c in ("node", "fp", "label")), list(frame["s"]), radius, likeness)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    more = rows.groupBy("g", "a").applyInPandas(run, "a bigint, b bigint")
    return components(written(alike.union(more), "dedup-alike"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without near copies: of each group of texts the row with the smallest doc_id stays (of equal ones, the text of smallest hash).

    Texts link if their word fingerprints are within STAGE_RADIUS bits and the Jaccard likeness of their 5-word
    shingles is 0.8 or more; equal texts always do. Of rows that repeat a doc_id within a group one stays. Rows of null or
    empty text are copies of each other. A null doc_id counts as the hash of its text. A text is told from others by 128 bits of its MD5. The
    names __key, __node, __stay and __head are taken.
    """
    shared_dir(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    digest = F.md5(text.cast("binary"))
    key = F.coalesce(docs["doc_id"].cast("bigint"), F.xxhash64(text))
    source = docs.select(key.alias("doc_id"), digest.alias("digest"), text.cast("binary").alias("__text"))
    fps = written(fingerprints(source, word_hashes, ["doc_id", "digest"], "doc_id bigint, digest string"), "dedup")
    firsts = fps.groupBy("digest", "fp").agg(F.min("doc_id").alias("first"))
    firsts = written(firsts.withColumn("node", F.monotonically_increasing_id()), "dedup-distinct")  # numbers of different texts, fixed by being written
    found = written(links_and_trees(firsts.select("node", "fp"), STAGE_RADIUS), "dedup-links")
    pairs, trees = found.filter("g is null").select("a", "b"), found.filter("g is not null")
    linked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    heads = firsts.join(linked, "node", "left_semi").select("node", "digest", F.col("first").alias("doc_id"))
    known = docs.select(key.alias("doc_id"), digest.alias("digest"), text.alias("t"))
    sets = known.join(heads, ["digest", "doc_id"]).groupBy("node").agg(F.first("t").alias("t"))
    sets = written(_shingle_sets(sets, STAGE_SHINGLE).join(firsts.select("node", "fp"), "node"), "dedup-sets")
    nodes = _alike(pairs, trees, sets, STAGE_RADIUS, STAGE_LIKENESS)
    groups = firsts.join(nodes, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("first", "digest")).alias("head"))
    stay = groups.select(F.col("head.first").alias("__stay"), F.col("head.digest").alias("__head"))
    kept = docs.withColumn("__key", key).withColumn("__node", digest)
    kept = kept.join(stay, (F.col("__key") == F.col("__stay")) & (F.col("__node") == F.col("__head")), "left_semi")
    return kept.dropDuplicates(["__key", "__node"]).drop("__key", "__node")
