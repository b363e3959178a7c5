"""Token shards, language ID, SimHash, decontamination, quality and the pipeline."""

import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxtab.llm import chunks, decontaminate, language_id, quality_cnn, simhash, token_shards
from voxtab.llm.common import new_folder, written

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "n") for i, t, lang in rows], DOCS)


# Token shards


def direct(text):
    return token_shards._tokenizer(token_shards.tokenizer_path()).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aZé.,'s |<>\n\tß!1Σ", max_size=40), st.lists(st.sampled_from(["<|endoftext|>", "don't", "X.", "Y,", "é", "\xa0", "İ", "ΑΣ"]), max_size=6).map(" ".join)))
def test_pieces_give_the_same_ids(text):
    path = token_shards.tokenizer_path()
    (got,) = token_shards.encode([text], path, 2)
    assert np.frombuffer(got, "<u2").tolist() == direct(text)


def test_index_is_minimal_and_perfect():
    keys = np.array([(i * i - 50, i % 2) for i in range(1000)], dtype=token_shards.KEY)
    import io

    data = io.BytesIO(token_shards.build_index(keys, np.arange(1000) * 3, np.arange(1000), 2))
    assert len(data.getvalue()) == 24 + 4 * 333 + 24 * 1000
    assert all(token_shards.find(data, tuple(k)) == (3 * i, i, 2) for i, k in enumerate(keys.tolist()))
    offsets, lengths, width = token_shards.find_all(data.getvalue(), keys)
    assert offsets.tolist() == [3 * i for i in range(1000)] and lengths.tolist() == list(range(1000)) and width == 2
    assert sum(token_shards.find(data, (-10**9 - i, 0)) is not None for i in range(500)) == 0


def test_shards(spark, monkeypatch):
    rows = [(3, "Hello world.", "en"), (1, "", "en"), (1, None, "en"), (1, "again again", "en"), (None, "no id", "en"), (7, "word " * 5000, "en")]
    folder = new_folder(spark, "shards")
    manifest = token_shards.write_shards(docs(spark, rows), folder, token_shards.tokenizer_path())
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.read_shards(manifest, folder).collect()), key=lambda r: r[2])
    want, start = [], 0
    for known, i, t in [(False, 0, "no id"), (True, 1, ""), (True, 1, ""), (True, 1, "again again"), (True, 3, "Hello world."), (True, 7, "word " * 5000)]:
        ids = [*direct(t), 1]
        want.append((known, i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    found = {r["doc_id"]: r["ids"] for r in token_shards.lookup(spark.createDataFrame([(3,), (4,), (99,)], "doc_id bigint"), manifest, folder).collect()}
    assert found == {3: [*direct("Hello world."), 1], 4: None, 99: None}
    assert token_shards.read_shards(token_shards.write_shards(docs(spark, []), new_folder(spark, "none"), token_shards.tokenizer_path()), folder).count() == 0


def test_shards_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "SHARD_IDS", 3000)
    df = spark.range(4000).selectExpr("CASE WHEN id < 5 THEN id WHEN id < 2000 THEN 7 END AS doc_id", "CASE WHEN id < 5 THEN 'a b' WHEN id < 2000 THEN 'same text' WHEN id < 3000 THEN 'no id' ELSE 'none' END AS text")
    folder = new_folder(spark, "many")
    manifest = token_shards.write_shards(df, folder, token_shards.tokenizer_path())
    got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in token_shards.read_shards(manifest, folder).collect())
    assert len(got) == 4000 and [d for *_, d in got] == [-1] * 2000 + list(range(5)) + [7] * 1995
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False)) and got[0][0] == 0


def test_a_worker_remembers_a_bounded_number_of_words(monkeypatch):
    """However many words pass, memory holds two lots of them; words forgotten and met again get the same ids, also in blocks of one text."""
    monkeypatch.setattr(token_shards, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_shards, "_CACHE", {})
    path = token_shards.tokenizer_path()
    texts = [f"The {chr(97 + i % 26)}{chr(97 + i % 7)}{chr(97 + i % 11)}wörd, don't. o'n' {i}x!! <|endoftext|>. é... ÀB?! é," for i in range(200)]
    for again in range(2):
        for lo in range(0, 200, 8):
            got = token_shards.encode(texts[lo : lo + 8], path, 2)
            assert [np.frombuffer(g, "<u2").tolist() for g in got] == [direct(t) for t in texts[lo : lo + 8]]
            # A block adds its own words (some 60 at most) before a lot is closed.
            assert sum(map(len, token_shards._CACHE[f"{path}:2"])) <= 2 * (50 + 60)
    assert token_shards.encode([], path) == [] and token_shards.encode(["", " \n "], path) == [b"", b""]


def test_less_memory_gives_the_same_ids(monkeypatch):
    """Few remembered words and small blocks, as in the pipeline: every id stays, and the words kept stay bounded."""
    import pyarrow as pa

    monkeypatch.setattr(token_shards, "_CACHE", {})
    path, rng = token_shards.tokenizer_path(), np.random.default_rng(3)
    texts = pa.array([" ".join(f"word{k}x, Y{k}" for k in rng.integers(0, 300, 40)) for _ in range(30)])
    want = token_shards.encode(texts.to_pylist(), path, 2)
    token_shards._CACHE.clear()
    got = [x for a, b in token_shards._blocks(texts, 400) for x in token_shards.encode(texts.slice(a, b - a).to_pylist(), path, 2, words=20)]
    assert got == want and sum(map(len, token_shards._CACHE[f"{path}:2"])) < 200


def test_blocks_cover_all_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_shards, "BLOCK_BYTES", 10)
    for texts in ([], [""], ["", ""], ["a" * 100], ["a" * 4] * 9, ["", "é" * 7, "", "b" * 35, "c"]):
        spans = list(token_shards._blocks(pa.array(texts, pa.string())))
        assert [i for a, b in spans for i in range(a, b)] == list(range(len(texts))) and all(sum(len(t.encode()) for t in texts[a + 1 : b]) < 10 for a, b in spans)


# Models


def test_chunks_cover_whole_texts():
    texts = [b"", b"a", bytes(range(1, 250)) * 3]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen = {0: b"", 1: b"", 2: b""}
    for x, size, owner in chunks.blocks(data, offsets, 16, 12, 7):
        for row, n, o in zip(x, size, owner, strict=True):
            seen[o] += bytes(row[:n] if not seen[o] else row[4:n])
    assert [seen[i] for i in range(3)] == texts


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language_id.new_weights(3).items()}
    x, real = rng.integers(0, 256, (6, 2)), np.ones((6, 2))
    real[4:, 1] = 0
    y = np.array([0, 2])
    loss = lambda q: -sum(real[t, r] * np.log(language_id.forward(q, x, real)[0][t, r, y[r]]) for t in range(6) for r in range(2))
    keep = ([], [])
    prob, _ = language_id.forward(p, x, real, keep)
    prob[:, np.arange(2), y] -= 1
    ds = (prob * real[:, :, None]) @ p["v"].T
    _, du = language_id.back_direction(p["wf"].astype(np.float32), p["uf"].astype(np.float32), x, real, keep[0], ds[:, :, : language_id.HIDDEN].astype(np.float32))
    for i, j in ((0, 0), (3, 10), (7, 23)):
        q = {k: v.copy() for k, v in p.items()}
        q["uf"][i, j] += 1e-3
        r = {k: v.copy() for k, v in p.items()}
        r["uf"][i, j] -= 1e-3
        assert du[i, j] == pytest.approx((loss(q) - loss(r)) / 2e-3, abs=2e-2)


def test_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 80)
    rows = [(i, ("the cat and this house " if i % 2 else "für über schön größe ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(80)]
    odd = [(200, None, "en"), (201, "", None), (202, "12 34 !!", "de"), (None, "the house", "en"), (203, "é" * 20000, None)]
    df = docs(spark, rows + odd)
    got = language_id.identify(df, *language_id.learn(df)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 85 and all(by[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [by[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    none = language_id.identify(df, *language_id.learn(df.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"} and language_id.identify(df.limit(0), ["en"], language_id.new_weights(1)).count() == 0


def plain_gru(p, text):
    """Mean probabilities of a text of up to a segment, one byte after the other."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for w, u, order in ((p["wf"], p["uf"], range(len(text))), (p["wb"], p["ub"], range(len(text) - 1, -1, -1))):
        h, out, n = np.zeros(language_id.HIDDEN), {}, language_id.HIDDEN
        for t in order:
            x, r = w[text[t]], h @ u
            z, g = sig(x[:n] + r[:n]), sig(x[n : 2 * n] + r[n : 2 * n])
            h = (1 - z) * np.tanh(x[2 * n :] + g * r[2 * n :]) + z * h
            out[t] = h
        states.append([out[t] for t in range(len(text))])
    e = np.exp(np.concatenate(states, axis=1) @ p["v"] + p["c"])
    return (e / e.sum(axis=1, keepdims=True)).mean(axis=0)


def test_pooled_positions_match_a_plain_network():
    p, rng = language_id.new_weights(3), np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 2, 50, language_id.SEGMENT)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(language_id.pooled(p, data, offsets), [plain_gru(p, t) for t in texts], atol=1e-5)


def test_language_stage_keeps_rows_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 60)
    rows = [(i % 7, "the cat and this house " * 3 if i % 2 else "für über schön größe " * 3, "en" if i % 2 else "de") for i in range(60)]
    df = docs(spark, [*rows, (3, None, None), (None, "the house and the cat", None), (4, "", "en"), (4, "123", "en"), (9, "the cat " * 40_000, None)]).withColumn("score", F.lit(1))
    kept = language_id.language_stage(spark, df, "")
    assert kept.schema == df.schema and kept.count() == 62 and language_id.language_stage(spark, df.limit(0), "").count() == 0


def test_language_stage_takes_a_text_once_and_a_few_at_a_time(spark, monkeypatch):
    """What crosses to a worker, what it holds beside a batch, and what it gives back at once; rows and their order stay."""
    df = docs(spark, [(i, f"the cat and this house {i} " * 12 if i % 3 else None, "en") for i in range(3000)]).coalesce(1)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: (self, run))
    rows, run = language_id.with_language(df, ["de", "en"], language_id.new_weights(2), least=0.0)
    (batch,) = rows.toArrow().combine_chunks().to_batches()
    assert batch.nbytes < 1.5 * sum(len(t) for t in batch.column("text").to_pylist() if t)
    tracemalloc.start()
    try:
        parts = list(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6 and max(p.nbytes for p in parts) < batch.nbytes / 2
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [i for i in range(3000) if i % 3]


def test_samples_are_bounded_whatever_repeats(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language_id, "DOCS_PER_LABEL", 5)
    monkeypatch.setattr(language_id, "train", lambda texts, labels, n: seen.update(language=len(texts)) or language_id.new_weights(n))
    df = docs(spark, [(1, "the same text", "en")] * 500 + [(1, f"another text {i}", "en") for i in range(300)] + [(2, "kurz", "de")])
    assert language_id.learn(df)[0] == ["de", "en"] and seen["language"] <= 2 * 5 * language_id.WINDOWS
    monkeypatch.setattr(quality_cnn, "DOCS_PER_LABEL", 5)
    monkeypatch.setattr(quality_cnn, "train", lambda texts, labels: seen.update(quality=len(texts)) or quality_cnn.new_weights())
    marks = spark.createDataFrame([(1, 1, 0)] * 300 + [(2, 0, 0)] * 300 + [(None, 0, 0)], "doc_id bigint, quality int, toxic int")
    quality_cnn.learn(df, marks)
    assert seen["quality"] == 2


def plain_cnn(p, text):
    """Probability of a text by sliding each filter over each chunk, one place after the other."""
    w, tops = quality_cnn.WIDTH, []
    for begin in range(0, max(1, len(text) - w + 1), quality_cnn.STRIDE):
        chunk = text[begin : begin + quality_cnn.CHUNK]
        size, chunk = len(chunk), np.frombuffer(chunk.ljust(quality_cnn.CHUNK, bytes(1)), np.uint8)
        tops.append(np.max([p["e"][chunk[i : i + w]].reshape(-1) @ p["k"] for i in range(max(0, size - w) + 1)], axis=0))
    f = np.tanh(np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]))
    return 1 / (1 + np.exp(-(f @ p["v"] + p["c"][0])))


def test_filters_match_a_plain_network():
    p, rng = quality_cnn.new_weights(), np.random.default_rng(2)
    p["v"] *= 10
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 7, 8, 9, 256, 257, 900)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(quality_cnn.probability(p, data, offsets), [plain_cnn(p, t) for t in texts], atol=1e-5)


def test_quality(spark, monkeypatch):
    monkeypatch.setattr(quality_cnn, "STEPS", 150)
    rows = [(i, ("a calm plain sentence here. " if i % 2 else "BUY!! $$$ NOW!! ") * (1 + i % 40), None) for i in range(120)]
    df = docs(spark, [*rows, (500, None, None), (501, "", None), (502, "ab", None)])
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(500, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_cnn.score(df, quality_cnn.learn(df, marks)).collect()}
    assert np.mean([got[i]["predicted"] == i % 2 for i in range(120)]) > 0.95
    assert got[500]["score"] == got[501]["score"] and 0 <= got[502]["score"] <= 1
    assert {r["predicted"] for r in quality_cnn.score(df, quality_cnn.learn(df, marks.limit(0))).collect()} == {1}
    assert quality_cnn.score(df.limit(0), quality_cnn.new_weights()).count() == 0


# SimHash


def plain_groups(fps, radius):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin((a ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize(("radius", "heavy"), [(3, 4096), (3, 20), (6, 4096)])
def test_links_are_complete(spark, monkeypatch, radius, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = np.random.default_rng(radius + heavy)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(b) for b in base}
    for b in base[:10]:
        for _ in range(30):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 2 * radius), replace=False):
                x ^= -(2**63) if bit == 63 else 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    nodes = written(spark.createDataFrame([(x, x) for x in fps], "node bigint, fp bigint"), "nodes")
    found = [(r["a"], r["b"]) for r in simhash.links(nodes, radius).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= radius for a, b in found)
    at = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        before = label[:]
        for a, b in found:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        if label == before:
            break
    assert label == plain_groups(fps, radius)


def test_near_groups_of_odd_texts(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text, None), (9, text.upper(), None), (2, text, None), (2, text, None), (7, None, None), (8, " \n", None), (None, "alone here", None), (4, "two words", None)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs(spark, rows)).collect()]
    assert len(got) == 8 and {c for i, _, c in got if i in (2, 5, 9)} == {2} and {(f, c) for i, f, c in got if i in (7, 8)} == {("0" * 16, 7)}
    assert simhash.near_groups(docs(spark, [])).count() == 0


def test_dedup_stage(spark):
    text = " ".join(f"word{i * 7919 % 5000}" for i in range(400))
    edited = text.replace("word0 ", "other ", 1)
    far = " ".join(f"term{i * 104729 % 5000}" for i in range(400))
    rows = [(4, text, "en"), (9, edited, "en"), (2, far, "en"), (11, text, "en"), (11, text, "en"), (20, None, "en"), (21, "", "en")]
    kept = simhash.dedup_stage(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 20] and kept.columns == docs(spark, rows).columns


def test_dedup_stage_keeps_texts_that_share_a_doc_id(spark):
    text = " ".join(f"word{i * 7919 % 5000}" for i in range(400))
    far = " ".join(f"term{i * 104729 % 5000}" for i in range(400))
    rows = [(3, text, "en"), (7, far, "en"), (7, text.replace("word0 ", "other ", 1), "en"), (8, "alone here", "en"), (8, "two words", "en")]
    kept = simhash.dedup_stage(spark, docs(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, text), (7, far), (8, "alone here"), (8, "two words")]


def test_all_alike_pairs_of_one_word_set_meet(spark):
    """Over 32 texts of one word set have one fingerprint; texts are alike in pairs that no forest by distance tells."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(40):
        text = list(rng.permutation(words))
        rows.append(text)
        if i % 2:
            swapped = list(text)
            swapped[60], swapped[61] = swapped[61], swapped[60]
            rows.append(swapped)
    order = rng.permutation(len(rows))
    rows = [(n, " ".join(rows[k]), "en") for n, k in enumerate(order)]
    grams = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    kept = simhash.dedup_stage(spark, docs(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and len(set(root)) == 40


# Decontamination


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_plain():
    rng = np.random.default_rng(0)
    a, b = [rng.integers(1, 6, n) for n in rng.integers(1, 15, 40)], [rng.integers(1, 6, n) for n in rng.integers(1, 25, 40)]
    assert decontaminate.align(a, b).tolist() == [plain_alignment(x, y) for x, y in zip(a, b, strict=True)]


def edit(rng, words, rate, word):
    """Words with substitutions, insertions and deletions at a rate."""
    out = []
    for w in words:
        kind = rng.random() / rate
        out += [w] if kind > 1 else [word()] if kind < 0.4 else [w, word()] if kind < 0.75 else []
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_no_leak_is_missed(letters):
    """All (text, item) pairs by full alignment: few different words, so that seeds are common, and many."""
    rng = np.random.default_rng(len(letters))
    word = lambda: "".join(rng.choice(list(letters), 2 if len(letters) == 2 else 3))
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 7, 8, 9, 12, 20, 30)]
    texts = []
    for i in range(60):
        it = items[int(rng.integers(len(items)))]
        parts = [[word() for _ in range(int(rng.integers(0, 30)))], edit(rng, it, (0.02, 0.2, 0.35, 0.5)[i % 4], word), [word() for _ in range(int(rng.integers(0, 30)))]]
        texts.append(" ".join(sum(parts, [])))
    texts += [None, "", " ".join(sum(([w, word()] for w in items[-1]), [])), " ".join(items[-1] * 12), " ".join(w if i % 3 else word() for i, w in enumerate(items[-1]))]
    block = decontaminate.Items([(n, " ".join(w)) for n, w in enumerate(items)], {"aa": 5, "ab": 9}, 0.5)
    got = {(r, i): like for r, i, like, _, _ in block.found(texts)}
    want = {}
    for r, t in enumerate(texts):
        for i, w in enumerate(items):
            score = plain_alignment(w, (t or "").split())
            if score >= (len(w) if len(w) >= 8 else 2 * len(w)):
                want[r, i] = score / (2 * len(w))
    assert got == want and len(want) > 30


def test_leaks(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    item = [word() for _ in range(40)]
    edited = [word() if i % 7 == 3 else w for i, w in enumerate(item)]
    noise = lambda n: [word() for _ in range(n)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, " ".join(noise(30)))], "item_id bigint, text string")
    rows = [(10, noise(200) + item + noise(50)), (11, noise(30) + edited), (12, noise(500)), (13, item[:8] + noise(100)), (14, [w.upper() + "," for w in item]), (None, item)]
    df = docs(spark, [(i, " ".join(w), "en") for i, w in rows] + [(15, None, "en"), (16, "", "en")])
    got = {(r["doc_id"], r["item_id"]): r["likeness"] for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (14, 1), (None, 1)} and got[10, 1] == 1 and 0.5 < got[11, 1] < 1
    assert {r["item_id"] for r in decontaminate.leaks(df, bench.selectExpr("cast(null as bigint) item_id", "text")).collect()} == {None}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    df = df.withColumn("item_id", df["doc_id"])
    kept = decontaminate.without_leaks(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 15, 16] and kept.columns == df.columns and kept.schema == df.schema
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == df.count() and decontaminate.without_leaks(df.limit(0), bench).count() == 0


def test_leaks_in_a_very_long_text(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 3))
    item = [word() for _ in range(30)]
    text = " ".join([*(word() for _ in range(150_000)), *item, *(word() for _ in range(150_000))])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    (got,) = decontaminate.leaks(docs(spark, [(1, text, "en"), (1, text[:500_000], "en")]), bench).collect()
    assert got["likeness"] == 1 and got["begin"] <= 150_000 <= got["end"]


@pytest.mark.parametrize("exact", [0, 1])
def test_leaks_of_many_edited_copies(spark, exact):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    item = [word() for _ in range(40)]
    edited = [word() if i % 5 == 4 else w for i, w in enumerate(item)]
    noise = lambda n: [word() for _ in range(n)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    rows = [(i, noise(30) + edited + noise(20)) for i in range(50)] + [(50 + i, noise(30) + item) for i in range(exact)] + [(60, noise(90))]
    got = decontaminate.leaks(docs(spark, [(i, " ".join(w), "en") for i, w in rows]), bench).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(50 + exact))


def test_pipeline(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(language_id, "STEPS", 40)
    rng = np.random.default_rng(9)
    text = lambda n: " ".join("".join(rng.choice(list("etaoinsh"), 6)) for _ in range(n))
    rows = [(i, text(60), "en") for i in range(20)]
    item = text(30)
    rows += [(30, rows[3][1], "en"), (31, "12 !!", "en"), (32, text(20) + " " + item, "en"), (33, None, "en")]
    docs(spark, rows).drop("node").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert sorted({d for _, d, _ in got}) == list(range(20))
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(len(got))]


def test_several_blocks_of_a_benchmark(spark, monkeypatch):
    """Blocks one after the other find what one block does, and the plan has one stage of workers."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    items = [" ".join(rng.choice(words, 12)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" " + items[i % 40] if i % 3 == 0 else ""), "en") for i in range(60)]
    df, bench = docs(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = sorted(map(tuple, decontaminate.leaks(df, bench).collect()))
    kept = sorted(r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert sorted(map(tuple, decontaminate.leaks(df, bench).collect())) == want and len(want) >= 20
    left = decontaminate.without_leaks(df, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == kept and left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_fingerprint_bits(spark):
    """Bits against XXH64 counted one by one."""
    from xxhash import xxh64_intdigest

    texts = ["", "one", "One two", "a b c", "a b c a b c d", "É a\x0bB\tc d", "x " * 500 + "y"]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_groups(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        h = [xxh64_intdigest(" ".join(low[k : k + 3]).encode(), 42) for k in range(max(1, len(low) - 2))] if low else []
        assert got[i] == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def test_lookup_over_many_shards(spark, monkeypatch):
    """Keys find their shards by their bounds; repeated ids, unknown and null keys, other columns; bounds that are joined give the same."""
    monkeypatch.setattr(token_shards, "SHARD_IDS", 40)
    rows = [(3 * i, f"text number {i} " * 4, "en") for i in range(60)] + [(30, "again " * 30, "en"), (None, "null", "en")]
    folder = new_folder(spark, "many-shards")
    manifest = token_shards.write_shards(docs(spark, rows), folder, token_shards.tokenizer_path())
    assert manifest.count() > 10
    keys = spark.createDataFrame([(0, "x"), (30, "x"), (31, "x"), (177, "x"), (-5, "x"), (999, "x"), (None, "x")], "doc_id bigint, name string")
    read = lambda: sorted(((r["doc_id"], tuple(r["ids"]) if r["ids"] else None) for r in token_shards.lookup(keys, manifest, folder).collect()), key=repr)
    got = read()
    found = {k: v for k, v in got if v}
    assert found[0] == (*direct(rows[0][1]), 1) and found[177] == (*direct(rows[59][1]), 1) and 30 in found and {k for k, v in got if v is None} >= {31, -5, 999, None}
    monkeypatch.setattr(token_shards, "LISTED", 0)
    assert read() == got


def test_mixed_stage_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names; each row comes as often as the mix takes it."""
    rows = [(i, f"word {i} " * (1 + i % 7), "en") for i in range(40)] + [(5, "same same", "en")] * 6 + [(None, "null id", "en"), (7, None, "en"), (8, "", "en")]
    docs(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")))).withColumn("p_size", F.lit(1)).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    from voxtab.llm import mixing

    copies = {(r["row"]["doc_id"], r["row"]["text"]): r["copies"] for r in mixing.mix(df).collect()}
    taken = mixing.mixed_stage(spark, df, "")
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in mixing.mix(df).collect()) and copies[7, None] == copies[8, ""] == 1
    assert mixing.mixed_stage(spark, df.limit(0), "").count() == 0
