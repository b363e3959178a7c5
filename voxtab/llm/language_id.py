"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled rows; every byte position is labelled
with the text's language. A prediction runs over the whole text in segments, gives each position a probability
of each language, and pools them: a document's probability is the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.chunks import Adam, blocks, buffers
from voxtab.llm.common import table

HIDDEN = 8
SEGMENT = 128
#: Segments that go through the network at once, and texts of an Arrow batch that are judged and passed on at once: what a worker holds beside the batch.
ROWS = 1024
TEXTS = 1000
#: Bound of the training sample: the most frequent languages, documents of each, windows of each, characters of a window.
LANGUAGES = 500
DOCS_PER_LABEL = 400
WINDOWS = 4
WINDOW_CHARS = 64
STEPS = 400
BATCH = 128
UNKNOWN = "und"
#: The corpus stage rejects documents without a language and those whose pooled probability stays below this.
LEAST_SCORE = 0.3


def new_weights(labels: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"wf": (256, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "wb": (256, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "v": (2 * HIDDEN, labels), "c": (labels,)}
    return {k: rng.normal(0, 0.0 if k == "c" else 0.2, s).astype(np.float32) for k, s in shapes.items()}


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_direction(w: np.ndarray, u: np.ndarray, x: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (length, rows, HIDDEN) after each byte of x (length, rows); states of padding are zero."""
    h = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    out = np.empty((len(x), x.shape[1], HIDDEN), dtype=np.float32)
    for t in range(len(x)):
        gx, gh = w[x[t]], h @ u
        zr = _gate(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, gh[:, 2 * HIDDEN :]))
        h = (n + z * (h - n)) * real[t][:, None]
        out[t] = h
    return out


def back_direction(w: np.ndarray, u: np.ndarray, x: np.ndarray, real: np.ndarray, keep: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u from those of the states, through time."""
    du, dh = np.zeros_like(u), np.zeros_like(dout[0])
    dx = np.empty((*x.shape, 3 * HIDDEN), dtype=np.float32)
    for t in reversed(range(len(x))):
        h, z, r, n, hn = keep[t]
        d = (dh + dout[t]) * real[t][:, None]
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        dgh = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ dgh
        dh = d * z + dgh @ u.T
    flat, rows = x.reshape(-1), dx.reshape(-1, 3 * HIDDEN)
    dw = np.stack([np.bincount(flat, rows[:, i], minlength=256) for i in range(3 * HIDDEN)], axis=1)
    return dw.astype(np.float32), du


def forward(p: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (length, rows, labels) of every position, and the states of both directions."""
    a = run_direction(p["wf"], p["uf"], x, real, keep and keep[0])
    b = run_direction(p["wb"], p["ub"], x[::-1], real[::-1], keep and keep[1])[::-1]
    states = np.concatenate([a, b], axis=2)
    logits = states @ p["v"] + p["c"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits, states


def train(texts: list[bytes], labels: list[int], n_labels: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights after ``steps`` steps on windows of text; the same texts give the same weights."""
    p = new_weights(n_labels)
    adam, rng = Adam(p, 0.02), np.random.default_rng(11)
    length = max(1, max(map(len, texts), default=1))
    x = np.zeros((len(texts), length), dtype=np.uint8)
    for i, t in enumerate(texts):
        x[i, : len(t)] = np.frombuffer(t, dtype=np.uint8)
    size, y = np.array([len(t) for t in texts]), np.array(labels)
    for _ in range(steps if len(texts) else 0):
        at = rng.integers(0, len(texts), BATCH)
        xt = np.ascontiguousarray(x[at].T)
        real = (np.arange(length)[:, None] < size[at]).astype(np.float32)
        keep: tuple[list, list] = ([], [])
        prob, states = forward(p, xt, real, keep)
        prob[:, np.arange(BATCH), y[at]] -= 1
        d = prob * (real / max(1.0, real.sum()))[:, :, None]
        flat, ds = d.reshape(-1, n_labels), d @ p["v"].T
        dwf, duf = back_direction(p["wf"], p["uf"], xt, real, keep[0], ds[:, :, :HIDDEN])
        dwb, dub = back_direction(p["wb"], p["ub"], xt[::-1], real[::-1], keep[1], ds[::-1, :, HIDDEN:])
        adam.step({"wf": dwf, "uf": duf, "wb": dwb, "ub": dub, "v": states.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(axis=0)})
    return p


def pooled(p: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities (values, labels) over all positions of each value."""
    total = np.zeros((len(offsets) - 1, len(p["c"])))
    for x, size, owner in blocks(data, offsets, SEGMENT, SEGMENT, ROWS):
        real = (np.arange(SEGMENT)[:, None] < size).astype(np.float32)
        prob, _ = forward(p, np.ascontiguousarray(x.T), real)
        np.add.at(total, owner, np.einsum("trc,tr->rc", prob, real))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights from labelled rows (doc_id, text, lang): a bounded sample, the lowest hashes of (doc_id, text).

    At most LANGUAGES languages (the most frequent) and DOCS_PER_LABEL documents of each come to the driver, however often
    rows or ids repeat. Rows without a language or a letter teach nothing; no such rows, no languages.
    """
    rows = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(1)))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = sorted((r["lang"], r["texts"]) for r in counts.collect())
    # About twice as many as are wanted get past the share, so that the ranking below sees few rows.
    share = F.lit(0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, int(min(1.0, 2 * DOCS_PER_LABEL / max(1, n)) * 1_000_000) + 1).otherwise(share)
    some = rows.filter(F.pmod("h", F.lit(1_000_000)) < share)
    room = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0))
    begin = lambda k: (F.floor(room * k / max(1, WINDOWS - 1)) + 1).cast("int")
    windows = F.array(*[F.encode(F.substring("text", begin(k), F.lit(WINDOW_CHARS)), "UTF-8") for k in range(WINDOWS)])
    some = some.select("lang", "h", windows.alias("xs")).dropDuplicates(["lang", "h"])
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))).filter(F.col("place") <= DOCS_PER_LABEL)
    got = some.select("lang", F.explode("xs").alias("x")).toPandas()
    order = got.assign(x=[bytes(x) for x in got["x"]]).sort_values(["lang", "x"])
    names = [lang for lang, _ in counts]
    index = {lang: i for i, lang in enumerate(names)}
    return names, train(order["x"].tolist(), [index[v] for v in order["lang"]], max(1, len(names)))


def judged(weights: dict[str, np.ndarray], names: list[str], data: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best label, whether there is one, and its probability (else 0) of each text (string or bytes, without nulls) of a batch."""
    prob = pooled(weights, *buffers(data)).round(9)
    known = letters.to_numpy(zero_copy_only=False) & bool(names)
    best = prob.argmax(axis=1)
    return best, known, np.where(known, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)


def identify(docs: DataFrame, names: list[str], weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text).

    Null and empty texts, those without a letter, and all texts if no language was learned, are ``und`` with score 0.
    Repeated rows get the same answer; a null doc_id stays null and counts as not held out.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(crc % 5 == 0, F.lit(False)).alias("held_out"),
        has_letter(F.col("text")).alias("known"),
        F.coalesce("text", F.lit("")).cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, known, score = judged(weights, names, batch.column(3), batch.column(2))
            pred = pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pred, pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "text", "lang")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; see ``identify`` for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text"), *learn(_learnable(docs)))


def with_language(docs: DataFrame, names: list[str], weights: dict[str, np.ndarray], least: float = LEAST_SCORE) -> DataFrame:
    """docs, all columns, without the rows that have no language (no letter) or whose pooled probability is below ``least``.

    Rows go through the workers as they are, so nothing is shuffled and rows need no key: repeated rows and null doc_ids are judged
    each by its own text. Null and empty texts go; an empty table stays empty. The name ``__letter`` is taken. A text crosses to
    the worker once, as the column it is, and rows come back TEXTS at a time.
    """
    width, text = len(docs.columns), docs.columns.index("text")
    rows = docs.withColumn("__letter", has_letter(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, TEXTS) for at in range(0, len(batch), TEXTS)):
                _, known, score = judged(weights, names, pc.fill_null(part.column(text), ""), part.column(width))
                yield part.select(list(range(width))).filter(pa.array(known & (score >= least)))
        pa.default_memory_pool().release_unused()  # a worker stays, beside its executor's heap, for the stages to come

    return rows.mapInArrow(run, docs.schema)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without documents that the language ID rejects; see ``with_language``."""
    return with_language(docs, *learn(_learnable(docs)))
