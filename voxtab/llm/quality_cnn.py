"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, FILTERS learned filters of WIDTH bytes slide over overlapping chunks that cover the whole text;
each filter is max-pooled within a chunk. A document combines, for each filter, the mean and the maximum of its chunks
into one probability of label 1. Learned on a bounded, balanced sample of labelled rows; the bias is then moved to
the labels' true odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.chunks import Adam, blocks, buffers
from voxtab.llm.common import table

DIM = 4
WIDTH = 8
FILTERS = 16
CHUNK = 256
STRIDE = CHUNK - WIDTH + 1
ROWS = 256
#: Bound of the training sample: documents of each label and evenly spread windows of CHUNK characters.
DOCS_PER_LABEL = 1500
WINDOWS = 6
#: Passes over the sample, more where it is so small that they would be fewer than STEPS steps.
EPOCHS = 10
STEPS = 600
BATCH = 64


def new_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"e": (256, DIM), "k": (WIDTH * DIM, FILTERS), "v": (2 * FILTERS,), "c": (1,)}
    scale = {"e": 0.5, "k": 0.3, "v": 0.1, "c": 0.0}
    return {n: rng.normal(0, scale[n], s).astype(np.float32) for n, s in shapes.items()}


def filtered(p: dict[str, np.ndarray], x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest value and its place (rows, FILTERS) of each filter in chunks x (rows, CHUNK); at least place 0 counts."""
    emb = np.ascontiguousarray(p["e"][x]).reshape(len(x), -1)
    seen = np.lib.stride_tricks.sliding_window_view(emb, WIDTH * DIM, axis=1)[:, ::DIM]
    out = (seen.reshape(-1, WIDTH * DIM) @ p["k"]).reshape(len(x), STRIDE, FILTERS)
    out[np.arange(STRIDE) > np.maximum(size - WIDTH, 0)[:, None]] = -np.inf
    at = out.argmax(axis=1)
    return np.take_along_axis(out, at[:, None], axis=1)[:, 0], at


def pool(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean and maximum over each document's chunks, squashed: (n, 2 * FILTERS)."""
    total, top = np.zeros((n, FILTERS)), np.full((n, FILTERS), -np.inf)
    np.add.at(total, owner, values)
    np.maximum.at(top, owner, values)
    return np.tanh(np.concatenate([total / np.bincount(owner, minlength=n)[:, None], top], axis=1))


def probability(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each value, over all of its bytes."""
    got = [(filtered(p, x, size)[0], owner) for x, size, owner in blocks(data, offsets, CHUNK, STRIDE, ROWS)]
    if not got:
        return np.zeros(0)
    f = pool(np.concatenate([v for v, _ in got]), np.concatenate([o for _, o in got]), len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(f @ p["v"] + p["c"][0], -40, 40)))


def train(docs: list[list[bytes]], labels: list[int], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights from documents given as lists of windows of up to CHUNK bytes."""
    p = new_weights()
    adam, rng = Adam(p, 0.005), np.random.default_rng(3)
    y = np.array(labels, dtype=np.float64)
    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, len(docs)))) if docs else 0):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            windows = [w[:CHUNK] for i in part for w in docs[i]]
            owner = np.repeat(np.arange(len(part)), [len(docs[i]) for i in part])
            x = np.zeros((len(windows), CHUNK), dtype=np.uint8)
            for r, w in enumerate(windows):
                x[r, : len(w)] = np.frombuffer(w, dtype=np.uint8)
            values, at = filtered(p, x, np.array([len(w) for w in windows]))
            f = pool(values, owner, len(part))
            d = (1 / (1 + np.exp(-(f @ p["v"] + p["c"][0]))) - y[part]) / len(part)
            df = d[:, None] * p["v"] * (1 - f * f)
            count = np.bincount(owner, minlength=len(part))[:, None]
            top = np.full((len(part), FILTERS), -np.inf)
            np.maximum.at(top, owner, values)
            dv = (df[:, :FILTERS] / count)[owner] + np.where(values == top[owner], df[owner, FILTERS:], 0)
            places = at[:, :, None] + np.arange(WIDTH)
            b = x[np.arange(len(x))[:, None, None], places]
            seen = p["e"][b].reshape(len(x), FILTERS, -1)
            de = np.zeros_like(p["e"])
            back = (dv[:, :, None] * p["k"].T).reshape(len(x), FILTERS, WIDTH, DIM)
            np.add.at(de, b, back.astype(np.float32))
            adam.step({"e": de, "k": np.einsum("rf,rfi->if", dv, seen).astype(np.float32), "v": (f.T @ d + 1e-3 * p["v"] / len(part)).astype(np.float32), "c": np.array([d.sum()], dtype=np.float32)})
    return p


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Weights from docs (doc_id, text) and labels (doc_id, quality).

    Rows without a label of 0 or 1, an id or a text teach nothing. Of each label the DOCS_PER_LABEL ids of lowest hash are the sample, of rows that
    repeat an id the text of lowest hash, so that at most twice as many rows are broadcast and come to the driver, however often rows or ids repeat. If only one
    label occurs, every text has its score; without labels every score is 0.5.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), "quality")
    found = marks.groupBy("quality").agg(F.count("*").alias("n"), F.approx_count_distinct("__id").alias("ids")).collect()
    counts, ids = {r["quality"]: r["n"] for r in found}, {r["quality"]: r["ids"] for r in found}
    if len(counts) < 2:
        p = new_weights()
        p["v"][:] = 0
        return p | {"c": np.array([40.0 if counts.get(1) else -40.0 if counts.get(0) else 0.0], dtype=np.float32)}
    share = lambda n: int(min(1.0, 2 * DOCS_PER_LABEL / max(1, n)) * 1_000_000) + 1
    place = F.pmod(F.xxhash64("__id", F.lit(2)), F.lit(1_000_000))
    marks = marks.filter(place < F.when(F.col("quality") == 0, share(ids[0])).otherwise(share(ids[1]))).distinct()
    marks = marks.withColumn("n", F.row_number().over(Window.partitionBy("quality").orderBy(place, "__id"))).filter(F.col("n") <= DOCS_PER_LABEL).drop("n")
    # At most 2 * DOCS_PER_LABEL rows of 12 bytes at any size of the tables, so the texts need no shuffle.
    rows = docs.filter("text is not null").join(F.broadcast(marks), docs["doc_id"] == marks["__id"])
    room = F.greatest(F.length("text") - CHUNK, F.lit(0))
    windows = F.array(*[F.encode(F.substring("text", (F.floor(room * k / (WINDOWS - 1)) + 1).cast("int"), F.lit(CHUNK)), "UTF-8") for k in range(WINDOWS)])
    got = rows.groupBy("__id", "quality").agg(F.min_by(F.array_distinct(windows), F.xxhash64("text")).alias("x")).toPandas()
    sample = sorted((int(q), [bytes(w) for w in x]) for q, x in zip(got["quality"], got["x"], strict=True))
    p = train([w for _, w in sample], [q for q, _ in sample])
    ones = sum(q for q, _ in sample)
    if 0 < ones < len(sample):
        p["c"] += np.float32(np.log(counts[1] / counts[0]) - np.log(ones / (len(sample) - ones)))
    return p


def score(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text).

    Null and empty texts are scored as one empty chunk. Repeated rows get the same score; a null doc_id stays null and
    counts as not held out. An empty table gives no rows.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(crc % 3 == 1, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = probability(weights, *buffers(batch.column(2))).round(9)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; see ``score`` for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = table(spark, sf_dir, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return score(docs, learn(docs, marks))
