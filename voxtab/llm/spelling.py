"""Spelling variants: words of the corpus within one edit of a much more frequent word.

The vocabulary is counted per task and merged by Spark. Two words within one edit agree before and behind the place of
the edit, so words meet under keys: for a base length L (the shorter of the two) and a window [lo, hi) of places, the
letters before the window and those behind it. The first windows are the two halves; a key of over ``GROUP`` words has
its window halved, down to one place, where a group holds at most A + A * A words of an alphabet of A letters (90 here). So no group
is unbounded and none is cut.

Within a group the words are a sorted list. Each word is held against the later ones by edit-matrix rows of three
cells (the band of one edit). A row belongs to a prefix, so neighbours reuse the rows of their longest common prefix, and when all
cells of a row exceed one edit, every word with that prefix is skipped at once. A pair counts only in the window that holds the length of its
common prefix, so it counts once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import table, written

LETTERS = "a-zÀ-ÿ"
NO_LETTER = re.compile(f"[^{LETTERS}]")
#: Contract of op11.
LENGTH, OCCURRENCES, RATIO, NOISE = 6, 5, 5, 199
#: Words of a key beyond which its window is halved.
GROUP = 256
#: Texts are read in pieces of at least this many characters, cut between words.
PIECE = 1 << 20
#: Keyed words of a task that scans; their bytes are few for the work that they make.
SCANNED = 20_000
#: Different words that a task holds before it passes their counts on.
HELD = 500_000


def pieces(text: str) -> Iterator[str]:
    """The text in parts that end at no letter, so that no word is cut."""
    at = 0
    while len(text) - at > PIECE:
        stop = NO_LETTER.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def count_words(rows: Iterable[tuple[str, str]], length: int, noise: int | None) -> Iterator[dict[str, int]]:
    """Counts of words of (id, text lower-cased in A-Z) rows, in dicts of bounded size.

    With noise, the letter h % len of a run goes where noise divides h = crc32("id:run").
    """
    run_of, counts = re.compile(f"[{LETTERS}]{{{length},}}"), Counter()
    for key, text in rows:
        runs: Counter = Counter()
        for piece in pieces(text):
            runs.update(run_of.findall(piece))
        start = crc32(f"{key}:".encode())
        for run, n in runs.items():
            if noise and (h := crc32(run.encode(), start)) % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < length:
                    continue
            counts[run] += n
        if len(counts) > HELD:
            yield counts
            counts = Counter()
    yield counts


def vocabulary(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, noise: int | None = None) -> DataFrame:
    """word, n: maximal runs of letters of docs (doc_id, text), lower-cased in A-Z, of at least that length and number of occurrences.

    A null text has no words; a null doc_id counts as an empty text in the noise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k.as_py(), t.as_py()) for b in batches for k, t in zip(b.column(0), pc.ascii_lower(b.column(1)), strict=True))
        for counts in count_words(rows, length, noise):
            yield pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    source = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("k"), F.coalesce(docs["text"], F.lit("")).alias("t"))
    counted = source.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


# Sorted lists


def row_below(row: tuple[int, int, int], d: int, c: str, q: str) -> tuple[int, int, int]:
    """Band of the edit matrix at depth d, after letter c; q is the other word between sentinels (q[k] is its k-th letter)."""
    a, b, e = row
    x = min(b + 1, a + (c != q[d - 1]))
    y = min(e + 1, x + 1, b + (c != q[d]))
    return x, y, min(y + 1, e + (c != q[d + 1]))


def common_prefix(u: str, v: str) -> int:
    n = min(len(u), len(v))
    return next((i for i in range(n) if u[i] != v[i]), n)


def near_in_list(words: list[str]) -> Iterator[tuple[int, int]]:
    """Places i < j of words of a sorted list of different words that differ by exactly one edit."""
    n = len(words)
    for i in range(n - 1):
        word = words[i]
        m, q = len(word), f"\0{word}\0\0\0"
        rows, j, before, last = [(2, 0, 1)], i + 1, word, m
        while j < n:
            other = words[j]
            d = common_prefix(before, other)  # rows of the shared prefix stay
            if before is word:
                rows += [(1, 0, 1)] * d
            elif d < last:
                del rows[d + 1 :]
            else:
                d = last
            row = rows[d]
            while d < len(other):
                d += 1
                if d > m + 1:
                    row = (2, 2, 2)
                else:
                    row = row_below(row, d, other[d - 1], q)
                rows.append(row)
                if min(row) > 1:
                    break
            if min(row) > 1:
                j = bisect_left(words, other[:d] + "\U0010ffff", j + 1)
            else:
                if abs(m - d) <= 1 and row[m - d + 1] == 1:
                    yield i, j
                j += 1
            before, last = other, d
    return


def near_in_group(base: int, lo: int, hi: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """word, near words, n and name of the most frequent near word, for pairs whose edit lies in the window of the base length."""
    best: dict[int, list] = {}
    for i, j in near_in_list(words):
        at = common_prefix(words[i], words[j])
        if min(len(words[i]), len(words[j])) == base and (lo <= at < hi or at == hi == base):
            for a, b in ((i, j), (j, i)):
                one = best.setdefault(a, [0, (0, "")])
                one[0] += 1
                if not one[1][1] or (-counts[b], words[b]) < one[1]:
                    one[1] = (-counts[b], words[b])
    for a, (near, (n, name)) in best.items():
        yield words[a], near, -n, name


def _keyed(rows: DataFrame) -> DataFrame:
    """word, n and the window (base, lo, hi, more) with its key; more is 1 where the word is the longer one."""
    head, tail = F.expr("substring(word, 1, lo)"), F.expr("substring(word, hi + more + 1)")
    return rows.withColumn("key", F.concat_ws(":", "base", "lo", "hi", head, tail))


def _halves(rows: DataFrame) -> DataFrame:
    middle = "cast((lo + hi) / 2 AS int)"
    parts = F.expr(f"inline(array(struct(lo AS l, {middle} AS h), struct({middle} AS l, hi AS h)))")
    return _keyed(rows.select("word", "n", "base", "more", "lo", "hi", parts).select("word", "n", "base", "more", F.col("l").alias("lo"), F.col("h").alias("hi")))


def near_words(words: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """word, n_near, form_n, form: near words of a table (word, n) of different words of at least that length, and the best of them."""
    size = F.length("word")
    whole = F.inline(F.array(*(F.struct((size - more).alias("base"), F.lit(more).alias("more"), F.lit(0).alias("lo"), (size - more).alias("hi")) for more in (0, 1))))
    rows = _halves(words.select("word", "n", whole).filter(F.col("base") >= length))
    rows = written(rows, "spelling-keys")
    while True:
        heavy = rows.filter("hi - lo > 1").groupBy("key").count().filter(F.col("count") > group).select("key")
        heavy = written(heavy, "spelling-heavy")
        if heavy.isEmpty():
            break
        rows = written(rows.join(heavy, "key", "left_anti").select("word", "n", "base", "more", "lo", "hi", "key").unionByName(_halves(rows.join(heavy, "key", "left_semi"))), "spelling-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts = None, [], []

        def found() -> Iterator[tuple[str, int, int, str]]:
            if len(words) > 1:
                base, lo, hi = key.split(":", 3)[:3]
                yield from near_in_group(int(base), int(lo), int(hi), words, counts)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "form_n", "form"])

        out: list[tuple] = []
        for b in batches:
            for k, w, n in zip(*(b.column(c).to_pylist() for c in ("key", "word", "n")), strict=True):
                if k != key:
                    out += found()
                    key, words, counts = k, [], []
                words.append(w)
                counts.append(n)
            if out:
                yield batch_of(out)
                out = []
        out += found()
        if out:
            yield batch_of(out)

    pairs = rows.select("key", "word", "n").repartition(rows.count() // SCANNED + 1, "key").sortWithinPartitions("key", "word").mapInArrow(run, "word string, near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("o"), "form"))
    return pairs.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.o")).alias("form_n"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last, by doubling the steps; counts grow along a chain, so it ends."""
    hops = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        more = hops.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        more = written(more, "spelling-roots")
        hops = more.select("word", "root")
        if more.filter("moved").isEmpty():
            return hops


def variant_groups(words: DataFrame, ratio: int = RATIO, length: int = LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n for a written table (word, n) of different words.

    A form is a word's near word of largest n (ties: least in code-point order) if that n is at least ``ratio`` times the word's.
    """
    near = near_words(words, length)
    is_form = F.col("form_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    out = written(out, "spelling-forms")
    last = roots(out.filter("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their form and root.

    Null and empty texts, and an empty table, have no words; repeated rows count as often as they stand. The words of a text of any
    length are read in pieces. Columns beside doc_id and text are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variant_groups(written(vocabulary(docs, noise=NOISE), "spelling-words"))
