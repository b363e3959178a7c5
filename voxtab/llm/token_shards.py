"""Token ids as raw binary shards with a minimal perfect hash index.

A shard is three files in one folder. ``NAME.bin``: the ids of its documents one after the other, little-endian unsigned
integers of 16 bits if the vocabulary has no larger ids, else of 32, nothing else. ``NAME.key``: the keys in order (doc_id long, occurrence int: rows that repeat a doc_id
are 0, 1, ...). ``NAME.idx``: the index: number of keys n, of buckets b and of bytes of an id (three longs), b displacements (int), then n
slots (fingerprint unsigned long, offset long, length long; offset and length in ids).

A key is hashed to a bucket; the bucket's displacement d >= 0 seeds the hash that gives the key's slot, d < 0 names slot
-1 - d. Every key has its own slot and there are as many slots as keys. A lookup reads one displacement
and one slot, compares the fingerprint, and reads the ids at the offset: constant time, a shard is never loaded whole.
``manifest`` (Parquet) has one row per shard: name, first and last key, documents, ids, and ids of all shards before it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import new_folder, table, written

END_ID = 1
#: A task closes a shard after this many ids (8 or 16 MB) and begins another.
SHARD_IDS = 4_000_000
#: Bytes of text, besides its first one, that are encoded at a time.
BLOCK_BYTES = 3_000_000
#: Words whose ids a Python worker remembers from now, and as many from before; a word met again stays.
CACHE_WORDS = 250_000
#: The same two in the corpus pipeline, whose workers stand beside a heap that its other stages have filled: less memory, more time.
STAGE_BYTES = 1_000_000
STAGE_WORDS = 75_000
#: A displacement that no bucket reaches: its hash is the stored fingerprint.
FINGERPRINT = 2**31 - 2
KEY = np.dtype([("doc_id", "<i8"), ("seen", "<i4")])
SLOT = np.dtype([("fp", "<u8"), ("offset", "<i8"), ("length", "<i8")])
#: Lower-case Latin-1 letters: one word of the tokenizer, which its normalizer leaves as it is.
LETTERS = "a-zß-öø-ÿ"
WORD = re.compile(f"[{LETTERS}]+")
#: A letter and the ASCII symbols after it up to a space or the end: symbols after a letter are always tokens apart.
ENDED = rf"([{LETTERS}])([!-/:-@\[-`{{-~]+)( |$)"
_CACHE: dict[str, list[dict[str, bytes]]] = {}
_TOKENIZERS: dict[str, object] = {}
_BARE: dict[str, tuple] = {}


# Encoding


def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def id_bytes(path: str, end_id: int = END_ID) -> int:
    """2 if all ids of the tokenizer and the end id fit 16 bits, else 4."""
    return 2 if max(_tokenizer(path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 2**16 else 4


def _bare(path: str):  # noqa: ANN202
    """The tokenizer without its normalizer, words ending at spaces only, and which of its ids end a word; None if its ids don't tell."""
    if path not in _BARE:
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer.from_file(path)
        suffix = getattr(bare.model, "end_of_word_suffix", None)
        last = np.zeros(bare.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, k in bare.get_vocab().items():
            last[k] = bool(suffix) and token.endswith(suffix)
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        _BARE[path] = (bare, last) if suffix else None
    return _BARE[path]


def _plain(text: str) -> str:
    """The tokenizer lower-cases; doing so first leaves fewer different pieces. Only Latin-1 texts without the marks of special
    tokens, where it is exact.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ")


def _pieces(texts: list[str]) -> pa.Array:
    """For each text its pieces, that the tokenizer never joins ids across: the text between spaces, line ends, and words and the symbols at their ends."""
    column = pa.array([_plain(t) for t in texts], pa.large_string())
    cut = pc.replace_substring_regex(column, ENDED, r"\1 \2\3")
    marks = pc.match_substring(column, "<|")
    return pc.split_pattern(pc.if_else(marks, column, cut) if pc.any(marks).as_py() else cut, " ")


def _blocks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """First and last + 1 of the texts that are encoded together, ``size`` (else BLOCK_BYTES) bytes besides the first one."""
    at = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64) // (size or BLOCK_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(column)]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


def encode(texts: list[str], path: str, width: int = 4, words: int | None = None) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned integers of ``width`` bytes, without special tokens.

    The tokenizer drops white space, so a text's ids are those of its pieces; each different piece of the texts is looked up
    once, and goes through the tokenizer if it is not among the ``words`` (else CACHE_WORDS) remembered. The ids are then gathered by where each piece's stand.
    """
    if not texts:
        return []
    split = _pieces(texts)
    coded = split.values.dictionary_encode()
    ids = _ids_of(coded.dictionary.to_pylist(), path, width, words or CACHE_WORDS)
    size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // width
    raw, at = np.frombuffer(b"".join(ids), dtype=f"<u{width}"), coded.indices.to_numpy()
    ends = np.cumsum(size[at])
    total = int(ends[-1]) if len(ends) else 0
    out = raw[np.arange(total) + np.repeat((np.cumsum(size) - size)[at] - (ends - size[at]), size[at])]
    cuts = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
    return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _ids_of(pieces: list[str], path: str, width: int, words: int) -> list[bytes]:
    """Ids of different pieces. Those not met while ``words`` others were are forgotten, so memory is bounded and common words stay."""
    known, before = cache = _CACHE.setdefault(f"{path}:{width}", [{}, {}])
    new = []
    for p in pieces:
        if p not in known:
            if p in before:
                known[p] = before[p]
            else:
                new.append(p)
    if new:
        _learn(new, path, known, width)
    out = [known[p] for p in pieces]
    if len(known) > words:
        cache[:] = {}, known
    return out


def _learn(pieces: list[str], path: str, known: dict[str, bytes], width: int) -> None:
    """Ids of new pieces. Words of letters end where an id ends a word; other pieces are cut by the places of their tokens."""
    bare, rest = _bare(path), pieces
    if bare:
        words, rest = [], []
        for p in pieces:
            (words if WORD.fullmatch(p) else rest).append(p)
        blocks = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for block, got in zip(blocks, bare[0].encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype=f"<u{width}")
            cuts = [0, *((np.flatnonzero(bare[1][ids]) + 1) * width).tolist()]
            raw = ids.tobytes()
            for p, a, b in zip(block, cuts[:-1], cuts[1:], strict=True):
                known[p] = raw[a:b]
    plain = [p for p in rest if p.isascii() or max(p) < "\u0100"]
    kept = set(plain)
    for words, apart in ((plain, False), ([p for p in rest if p not in kept], True)):  # marks could join the space before them
        blocks = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        batch = blocks if apart else [" ".join(b) for b in blocks]
        for block, got in zip(blocks, _tokenizer(path).encode_batch(batch, is_pretokenized=apart, add_special_tokens=False), strict=True):
            raw = np.array(got.ids, dtype=f"<u{width}").tobytes()
            if apart:
                starts, at = np.arange(len(block) + 1), np.array(got.word_ids, dtype=np.int64)
            else:
                starts, at = np.cumsum([0] + [len(p) + 1 for p in block]), np.array([a for a, _ in got.offsets], dtype=np.int64)
            cuts = (np.searchsorted(at, starts) * width).tolist()
            for p, a, b in zip(block, cuts, cuts[1:], strict=False):
                known[p] = raw[a:b]


# The index


def _hashes(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    from xxhash import xxh64_intdigest

    raw = [keys[i : i + 1].tobytes() for i in range(len(keys))]
    return raw, np.array([xxh64_intdigest(k, 1) for k in raw], dtype=np.uint64)


def _mixed(h: np.ndarray, d: int | np.ndarray) -> np.ndarray:
    """Another hash of hashes for each displacement (the finalizer of a 64-bit mixer)."""
    with np.errstate(over="ignore"):
        x = h + (np.asarray(d, dtype=np.int64) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """Index file of a shard's keys (all different)."""
    n = len(keys)
    b = max(1, n // 3)
    _, h = _hashes(keys)
    bucket = (h % np.uint64(b)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=b)
    begin = np.cumsum(size) - size
    shift, place, used = np.zeros(b, dtype="<i4"), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    free = 0
    for k in np.argsort(-size, kind="stable").tolist():
        own = order[begin[k] : begin[k] + size[k]]
        if len(own) == 0:
            break
        if len(own) == 1:
            while used[free]:
                free += 1
            shift[k], spots = -1 - free, np.array([free])
        else:
            d = 0
            while True:
                spots = (_mixed(h[own], d) % np.uint64(n)).astype(np.int64)
                if len(set(spots.tolist())) == len(own) and not used[spots].any():
                    break
                d += 1
            shift[k] = d
        used[spots] = True
        place[own] = spots
    slots = np.zeros(n, dtype=SLOT)
    slots["fp"][place], slots["offset"][place], slots["length"][place] = _mixed(h, FINGERPRINT), offsets, lengths
    return struct.pack("<qqq", n, b, width) + shift.tobytes() + slots.tobytes()


def find(file, key: tuple[int, int]) -> tuple[int, int, int] | None:  # noqa: ANN001
    """(offset, length, bytes of an id) of a key in an open index file, None if it has no such key."""
    _, h = _hashes(np.array([key], dtype=KEY))
    file.seek(0)
    n, b, width = struct.unpack("<qqq", file.read(24))
    if not n:
        return None
    file.seek(24 + 4 * int(h[0] % np.uint64(b)))
    (d,) = struct.unpack("<i", file.read(4))
    spot = -1 - d if d < 0 else int(_mixed(h, d)[0] % np.uint64(n))
    file.seek(24 + 4 * b + SLOT.itemsize * spot)
    slot = np.frombuffer(file.read(SLOT.itemsize), dtype=SLOT)[0]
    return (int(slot["offset"]), int(slot["length"]), width) if slot["fp"] == _mixed(h, FINGERPRINT)[0] else None


def find_all(data: bytes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """offsets, lengths and bytes of an id of many keys, all of which the index has."""
    n, b, width = struct.unpack_from("<qqq", data)
    _, h = _hashes(keys)
    shift = np.frombuffer(data, dtype="<i4", count=b, offset=24)[(h % np.uint64(b)).astype(np.int64)].astype(np.int64)
    spot = np.where(shift < 0, -1 - shift, (_mixed(h, np.maximum(shift, 0)) % np.uint64(max(n, 1))).astype(np.int64))
    slots = np.frombuffer(data, dtype=SLOT, count=n, offset=24 + 4 * b)[spot]
    if (slots["fp"] != _mixed(h, FINGERPRINT)).any():
        raise KeyError("a key is not in the index")
    return slots["offset"], slots["length"], width


# Writing and reading


def _ids(payload, at: tuple[int, int, int]) -> np.ndarray:  # noqa: ANN001
    """The ids at a place of an open payload."""
    offset, length, width = at
    payload.seek(width * offset)
    return np.frombuffer(payload.read(width * length), dtype=f"<u{width}").astype("<u4")


def _open(folder: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a whole file; its name holds the task's attempt, so that a task that is run again touches no file of its first run."""
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


MANIFEST = "name string, first_id bigint, last_id bigint, docs bigint, ids bigint"


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, block: int = BLOCK_BYTES, words: int = CACHE_WORDS) -> DataFrame:
    """Write the texts of docs (doc_id, text) as shards in ascending doc_id order; the manifest of what was written.

    Null and empty texts are one end id; a null doc_id is written as the smallest long; rows that repeat a doc_id
    follow each other by a hash of their text, dealt to as many tasks as they need, and are numbered within each task's part. An
    empty table writes no shard. Other columns are ignored. ``block`` and ``words`` trade a worker's memory for time and change no id.
    """

    width = id_bytes(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, shard, last, seen = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None, 0
        keys: list[tuple[int, int]] = []
        data: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, data, held, shard
            name = f"{part:06d}-{shard:04d}-{attempt}"
            lengths = np.array([len(x) // width for x in data], dtype=np.int64)
            k = np.array(keys, dtype=KEY)
            _put(folder, f"{name}.bin", b"".join(data))
            _put(folder, f"{name}.key", k.tobytes())
            _put(folder, f"{name}.idx", build_index(k, np.cumsum(lengths) - lengths, lengths, width))
            row = [name, keys[0][0], keys[-1][0], len(keys), held]
            keys, data, held, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), *[pa.array([x], pa.int64()) for x in row[1:]]], names=["name", "first_id", "last_id", "docs", "ids"])

        end = end_id.to_bytes(width, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi in _blocks(batch.column(1), block):
                for doc_id, raw in zip(ids[lo:hi], encode(batch.column(1).slice(lo, hi - lo).to_pylist(), path, width, words), strict=True):
                    seen = seen + 1 if doc_id == last else 0
                    last = doc_id
                    keys.append((doc_id, seen))
                    data.append(raw + end)
                    held += len(raw) // width + 1
                    if held >= SHARD_IDS:
                        yield close()
        if keys:
            yield close()
        pa.default_memory_pool().release_unused()  # else the worker keeps a block's pieces while other stages run

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal rows may stand in any order, so where they stand in the input lets ranges cut between them.
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("seq", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "h", "seq").sortWithinPartitions("doc_id", "h").drop("h", "seq")
    shards = written(rows.mapInArrow(run, MANIFEST), "shard-list")
    # Ids before each shard: within its task's shards, and of all tasks before (one row a task).
    shards = shards.withColumn("part", F.substring("name", 1, 6))
    tasks = shards.groupBy("part").agg(F.sum("ids").alias("own"))
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy("name" if by else "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select("part", earlier("own").alias("base"))
    shards = shards.join(tasks, "part").withColumn("before", F.col("base") + earlier("ids", "part")).drop("part", "base")
    shards.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(shards.schema).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every key, each looked up in its shard's index."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame.itertuples():
                store, path = _open(folder)
                with store.open_input_file(f"{path}/{shard.name}.key") as f:
                    keys = np.frombuffer(f.read(), dtype=KEY)
                with store.open_input_file(f"{path}/{shard.name}.idx") as f:
                    offsets, lengths, width = find_all(f.read(), keys)
                with store.open_input_file(f"{path}/{shard.name}.bin") as f:
                    ids = np.frombuffer(f.read(), dtype=f"<u{width}").astype("<u4")
                crc = [zlib.crc32(ids[o : o + n]) for o, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": keys["doc_id"], "start": shard.before + offsets, "n_tokens": lengths, "ids_crc32": crc})

    # One task a shard (up to a thousand): the manifest itself is small and would else be read by one task.
    out = manifest.repartition(max(1, min(1000, manifest.count()))).mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


#: Shards whose bounds (some 60 bytes each) are sent to the workers at most.
LISTED = 200_000


def lookup(keys: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids (array) for keys (doc_id, occurrence 0) that some shard holds; others have null ids. Of a doc_id whose rows fill
    several shards each shard gives one row.

    Keys meet shards by range: shards stand in the order of their ids, so a key finds its own by two binary searches in their bounds (one
    row per 16 MB of ids; up to LISTED of them are sent to the workers, more are joined). Keys go to the task of their shard.
    """
    keys, bounds = keys.select("doc_id"), manifest.select("name", "first_id", "last_id")
    if bounds.count() <= LISTED:
        listed = bounds.toPandas().sort_values(["first_id", "last_id", "name"])
        first, last, names = (listed[c].to_numpy() for c in ("first_id", "last_id", "name"))
        last = np.maximum.accumulate(last) if len(last) else last

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                ids = frame["doc_id"].to_numpy()
                known = pd.notna(frame["doc_id"]).to_numpy()
                whole = np.where(known, frame["doc_id"].fillna(0), 0).astype(np.int64)
                lo = np.searchsorted(last, whole, side="left")
                n = np.where(known, np.maximum(np.searchsorted(first, whole, side="right") - lo, 0), 0)
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                none = frame.loc[n == 0, ["doc_id"]].assign(name=None)
                yield pd.DataFrame({"doc_id": np.repeat(ids, n), "name": names[at] if len(names) else []})
                yield none

        ranged = keys.mapInPandas(place, "doc_id bigint, name string")
    else:
        ranged = keys.join(bounds, F.col("doc_id").between(F.col("first_id"), F.col("last_id")), "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in frame.groupby("name", dropna=False):
                got: list[list[int] | None] = [None] * len(own)
                if isinstance(name, str):
                    store, path = _open(folder)
                    with store.open_input_file(f"{path}/{name}.idx") as index, store.open_input_file(f"{path}/{name}.bin") as payload:
                        for i, doc_id in enumerate(own["doc_id"].tolist()):
                            at = find(index, (doc_id, 0))
                            if at:
                                got[i] = _ids(payload, at).tolist()
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "ids": got})

    return ranged.select("doc_id", "name").repartition("name").mapInPandas(run, "doc_id bigint, ids array<bigint>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand; see ``write_shards`` for nulls, repeats and empty tables."""
    folder = new_folder(spark, "token-shards")
    manifest = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path())
    return read_shards(manifest, folder)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each row of docs stand in the written shards; see ``write_shards`` for nulls, repeats and empty tables."""
    folder = new_folder(spark, "token-shards")
    return read_shards(write_shards(docs.select("doc_id", "text"), folder, tokenizer_path(), block=STAGE_BYTES, words=STAGE_WORDS), folder)
