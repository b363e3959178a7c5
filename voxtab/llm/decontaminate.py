"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are words (``\\w+`` of the lower-cased text). An item and a passage are aligned with match +2, mismatch -1, gap -1 a
word; the item counts as leaked when the best local alignment reaches THRESHOLD of the item's own score (2 a word), so edited and
paraphrased copies count too.

Seeds are pairs of words with at most one word skipped between them. Be m the item's words, S the score it must reach and M the
matches of an alignment: what lies between one match and the next costs at least 2 unless at most one word is skipped on either side,
and all that costs at most 2 M - S, so at least S / 2 - 1 matches are followed by such a near one. Each of them begins at a
place of the item of its own. Of the m - 1 places any set of m - 1 - (S / 2 - 1) + 1 holds one of them: the rarest places, by the
document frequency of their words in the corpus, are the seeds. An alignment is at most 2 m - S words longer than the item,
which gives the passage around a seed. So no leak is missed, whatever the edits; rarity only saves work.

Items are taken in blocks of about BLOCK_BYTES of text, each broadcast and held against all documents; the driver holds one block at a time, as the
pass of a block is written before the next block is read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import table, written

THRESHOLD = 0.5
#: Shortest item (in words) that can be told from chance; shorter ones must match whole.
SHORT = 8
#: Text of the items of one pass; a worker holds some twelve times as much.
BLOCK_BYTES = 16 * 2**20
#: Words of different items that are broadcast at most to count their documents; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Cells of the alignment table that are computed at once, and documents that are looked up at once.
CELLS = 2**18
DOCS = 128
WORDS = re.compile(r"\w+")
#: The same words in Java.
JAVA_WORDS = r"(?U)\w+"
#: Texts beyond this many characters are split word by word instead of into one list.
LONG = 1_000_000


def split_words(text: str | None) -> Iterator[str]:
    text = (text or "").lower()
    return iter(WORDS.findall(text)) if len(text) < LONG else (m[0] for m in WORDS.finditer(text))


class Items:
    """A block of benchmark items as word numbers, with the pairs of words that lead to them.

    rows: (item_id, text); frequency: documents of each word, 0 for those that are not in it.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]], frequency: dict[str, int], threshold: float) -> None:
        self.vocab: dict[str, int] = {}
        self.ids, self.words, self.least = [], [], []
        for item_id, text in rows:
            words = list(split_words(text))
            if words:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.int64))
                self.least.append(math.ceil((threshold if len(words) >= SHORT else 1.0) * 2 * len(words) - 1e-9))
        self.base = len(self.vocab) + 1
        df = np.zeros(self.base, dtype=np.int64)
        for w, n in self.vocab.items():
            df[n] = frequency.get(w, 0)
        got = [self._seeds(i, df) for i in range(len(self.words))]
        code, item, at = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype=np.int64),) * 3
        order = np.argsort(code, kind="stable")
        self.codes, self.begin = np.unique(code[order], return_index=True)
        self.count = np.diff(np.r_[self.begin, len(code)])
        self.item, self.at = item[order].astype(np.int32), at[order].astype(np.int32)
        #: Words that begin a seed, so that most of a document's words need no lookup.
        self.leads = np.zeros(self.base, dtype=bool)
        self.leads[self.codes // self.base] = True

    def slack(self, item: np.ndarray | int) -> np.ndarray | int:
        m, least = np.array([len(w) for w in self.words]), np.array(self.least)
        return (2 * m - least)[item]

    def _seeds(self, i: int, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the item's seeds and the places where they begin; an item of one word is the pair of that word and none."""
        w, n = self.words[i], df[self.words[i]]
        m = len(w)
        if m == 1:
            return w * self.base, np.array([i]), np.array([0])
        one = np.minimum(n[:-1], n[1:])
        two = np.r_[np.minimum(n[:-2], n[2:]), 0] if m > 2 else np.zeros(m - 1, dtype=np.int64)
        places = np.argsort(one + two, kind="stable")[: min(m - 1, m - max(0, math.ceil(self.least[i] / 2 - 1)))]
        far = places[places + 2 < m]
        code = np.r_[w[places] * self.base + w[places + 1], w[far] * self.base + w[far + 2]]
        return code, np.full(len(code), i), np.r_[places, far]

    def numbers(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; 0 for words that no item has."""
        return np.fromiter(map(self.vocab.get, split_words(text), repeat(0)), dtype=np.int64)

    def passages(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        """(row, item, begin, end, words) of the passages around all seeds that hold enough of an item's words."""
        if not len(self.codes):
            return
        docs = [self.numbers(t) for t in texts]
        size = np.array([len(d) for d in docs])
        start = np.cumsum(size + 2) - size - 2  # two words of no item between documents, so that no pair crosses
        u = np.zeros(int(size.sum()) + 2 * len(docs) + 2, dtype=np.int64)
        for s, d in zip(start.tolist(), docs, strict=True):
            u[s : s + len(d)] = d
        j = np.flatnonzero(self.leads[u[:-2]])
        pairs = [(u[j] * self.base + u[j + k], j, (u[j + k] > 0)) for k in (1, 2)]
        if any(len(w) == 1 for w in self.words):
            pairs.append((u[j] * self.base, j, u[j] > 0))
        code, j = np.concatenate([c[ok] for c, _, ok in pairs]), np.concatenate([x[ok] for _, x, ok in pairs])
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        good = self.codes[k] == code
        k, j = k[good], j[good]
        n = self.count[k]
        nth = np.repeat(self.begin[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        j, item, at = np.repeat(j, n), self.item[nth], self.at[nth].astype(np.int64)
        if not len(j):
            return
        row = np.searchsorted(start, j, side="right") - 1
        m = np.array([len(w) for w in self.words])[item]
        slack = self.slack(item)
        b = np.maximum(start[row], j - at - slack)
        e = np.minimum(start[row] + size[row], j - at + m + slack)
        order = np.lexsort((b, item, row))
        row, item, b, e, m = (x[order] for x in (row, item, b, e, m))
        top = np.empty(len(b), dtype=np.int64)  # furthest end so far within the same row and item
        own = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])])
        top = np.maximum.accumulate(e + own * (len(u) + 1)) - own * (len(u) + 1)
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (b[1:] > top[:-1])])
        last = np.r_[first[1:], len(b)] - 1
        for f, z in zip(first.tolist(), last.tolist(), strict=True):
            r, i, lo, hi, step = int(row[f]), int(item[f]), int(b[f]), int(top[z]), int(m[f])
            words = self.words[i].tolist()
            while True:  # long passages in pieces that overlap by more than any alignment is long
                end = min(hi, lo + 8 * step)
                part = u[lo:end]
                held = set(part.tolist())
                if 2 * sum(w in held for w in words) >= self.least[i]:
                    yield r, i, lo - int(start[r]), end - int(start[r]), part
                if end == hi:
                    break
                lo += 5 * step

    def found(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(row, item, likeness, begin, end) of each item that leaked into a text: its likest passage, the first of equals."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for lo in range(0, len(texts), DOCS):
            todo = sorted(self.passages(texts[lo : lo + DOCS]), key=lambda c: len(c[4]))
            while todo:
                rows = max(1, CELLS // (len(todo[-1][4]) + 1))
                part, todo = todo[-rows:], todo[:-rows]
                for (row, item, b, e, _), s in zip(part, align([self.words[c[1]] for c in part], [c[4] for c in part]).tolist(), strict=True):
                    key, likeness = (lo + row, item), s / (2 * len(self.words[item]))
                    if s >= self.least[item] and (key not in best or (-likeness, b) < (-best[key][0], best[key][1])):
                        best[key] = (likeness, b, e)
        return [(*key, *value) for key, value in sorted(best.items())]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its passage, all pairs at once, one item word after the other."""
    m, n = max(map(len, items)), max(map(len, passages))
    a, p = np.full((len(items), m), -1, dtype=np.int64), np.full((len(items), n), -2, dtype=np.int64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], p[i, : len(y)] = x, y
    p[p == 0] = -2
    h, best, col = np.zeros((len(items), n + 1), dtype=np.int32), np.zeros(len(items), dtype=np.int32), np.arange(n + 1, dtype=np.int32)
    for i in range(m):
        step = np.where(p == a[:, i, None], 2, -1).astype(np.int32)
        e = np.maximum(h - 1, 0)
        np.maximum(e[:, 1:], h[:, :-1] + step, out=e[:, 1:])
        h = np.maximum.accumulate(e + col, axis=1) - col
        best = np.maximum(best, h.max(axis=1))
    return best


def _blocks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[Items]:
    """The benchmark in blocks, with the document frequencies of its words over all of docs."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("text").rlike(JAVA_WORDS))
    (total,) = rows.agg(F.sum(F.octet_length("text"))).first()
    if not total:
        return
    n = -(-total // BLOCK_BYTES)
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    words = lambda text: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(JAVA_WORDS), F.lit(0)))).alias("word")
    wanted = written(rows.select(words("text")).distinct(), "item-words")
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    counts = written(docs.select(words("text")).join(small, "word").groupBy("word").count(), "item-frequency")
    for block in range(n):
        own = rows.filter(F.col("block") == block)
        texts = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if texts:
            yield Items(texts, {r["word"]: r["count"] for r in counts.join(own.select(words("text")).distinct(), "word", "left_semi").collect()}, threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, likeness, begin, end: items that leaked into documents and the words of the passage around them.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null and empty texts hold nothing and no item leaks from
    them; rows that repeat a doc_id or an item_id are told apart (each gives its own leaks); a null doc_id or item_id stays null. Of several
    passages of an item in a document the likest counts, the first of equals. Texts are read whole. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, likeness double, begin bigint, end bigint"

    def pass_of(items: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = sent.value.found(batch.column(1).to_pylist())
                ids = batch.column(0).to_pylist()
                cols = [[ids[r] for r, *_ in got], [sent.value.ids[i] for _, i, *_ in got], *([g[k] for g in got] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "item_id", "likeness", "begin", "end"])

        return docs.mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for items in _blocks(docs, benchmark, threshold):  # a pass is written before the next block is read
        out = out.union(written(pass_of(items), "leaks"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows into whose text an item leaked; see ``leaks``.

    Rows go through the workers as they are, so nothing is shuffled and rows need no key: repeated rows and null doc_ids are judged
    each by its own text. Null and empty texts stay; an empty table or an empty benchmark changes nothing.
    """
    at, first = docs.columns.index("text"), True
    for items in _blocks(docs, benchmark, threshold):
        docs, first = docs if first else written(docs, "without-leaks"), False  # what a block has left, before the next block is read
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r for r, *_ in sent.value.found(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of the benchmark into documents; see ``leaks`` for nulls, repeats and empty tables."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def decontaminated_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that hold an item of the benchmark; see ``without_leaks``."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
