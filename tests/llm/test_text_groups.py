"""Spelling variants, SetSketch near-dedup and conversation repair, against plain versions."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtab.llm import conversation_repair, setsketch, spelling

DOCS = "doc_id bigint, text string, n string, word string, key string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS)


# Spelling


def one_edit(u, v):
    at = spelling.common_prefix(u, v)
    if len(u) == len(v):
        return u != v and u[at + 1 :] == v[at + 1 :]
    u, v = sorted((u, v), key=len)
    return u[at:] == v[at + 1 :]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=7), unique=True, max_size=40))
def test_list_scan_finds_all_pairs(words):
    words = sorted(words)
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}
    got = list(spelling.near_in_list(words))
    assert len(got) == len(set(got)) and set(got) == want


def plain_groups(rows, noise):
    counts = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("group", [2, 256])
def test_variant_groups(spark, group, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    weights = [5 ** (k % 5) for k in range(12)]
    edited = [w[:k] + rng.choice(["", "a", "ÿb"]) + w[k + 1 :] for w in base for k in (0, 3, len(w) - 1)]
    text = lambda: " ".join(rng.choices(base, weights, k=150) + rng.choices(edited, k=60)) + ", Ärger-ÄRGERn_" + rng.choice(["X", "!", ""])
    rows = [(i, text()) for i in range(30)] + [(None, text()), (3, None), (4, ""), (5, "abc " * 9), (6, "a" * 3000 + " " + "a" * 3001), *[(i, "z" * 40 + " " + "z" * 41) for i in range(5)]]
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    monkeypatch.setattr(spelling.near_words, "__defaults__", (6, group))
    got = spelling.variant_groups(spelling.written(spelling.vocabulary(docs(spark, rows), noise=7), "words"))
    assert sorted(tuple(r) for r in got.collect()) == plain_groups(rows, 7) and got.filter("form is not null").count() > 5
    assert spelling.variant_groups(spelling.written(spelling.vocabulary(docs(spark, [])), "words")).count() == 0


# SetSketch


def plain_set(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(top(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return sorted(((d, len(sets[i]), least[top(i)], d == least[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(90)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [1024, 9])
def test_near_sets(spark, block, monkeypatch):
    rng = random.Random(block)
    words = [f"w{k}" for k in range(400)]
    texts = family(rng, words, 70, 3) + family(rng, words, 40, 6) + family(rng, words, 5, 1) + [" ".join(rng.choices(words, k=k)) for k in (1, 2, 4, 5, 6, 3000)] * 2
    rows = [*enumerate(texts, 100), (1, None), (2, ""), (3, " \t\n"), (None, texts[0]), (None, "alone here"), (7, texts[1].upper()), (7, texts[1]), (7, texts[-1]), (8, "one\x0btwo\xa0three")]
    monkeypatch.setattr(setsketch, "BLOCK", block)
    monkeypatch.setattr(setsketch, "PIECE", 500)
    got = setsketch.near_sets(docs(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_components(rows)
    assert setsketch.near_sets(docs(spark, [])).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.85, 0.95):
        off = []
        for _ in range(60):
            n = int(rng.integers(50, 3000))
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            rest = rng.integers(0, 2**63, n - len(both), dtype=np.uint64)
            half = len(rest) // 3
            a, b = np.r_[both, rest[:half]], np.r_[both, rest[half:]]
            r = setsketch.registers([a, b, np.r_[a, b], np.zeros(0, np.uint64)])
            assert (setsketch.merged(r[0], r[1]) == r[2]).all() and not r[3].any()
            j, _, _ = setsketch.likeliest(np.array([float(len(a))]), np.array([float(len(b))]), (r[0] > r[1]).sum(keepdims=True), (r[0] < r[1]).sum(keepdims=True))
            off.append(j[0] - len(both) / n)
            if share == 0.95:
                assert setsketch.may_be_near(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]), 85)[0]
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


# Conversation repair


def plain_best(rows):
    def reach(m):
        for _ in range(5):
            for s, (k, a) in list(m.items()):
                for to in conversation_repair.inserts(s):
                    m[to] = min(m.get(to, (10**9, "")), (k + 3, a + "I"))
        return m

    now = reach({0: (0, "")})
    for r in rows:
        new = {}
        for s, (k, a) in now.items():
            for letter, p, to in conversation_repair.edits_of(r, s):
                new[to] = min(new.get(to, (10**9, "")), (k + p, a + letter))
        now = reach(new)
    return min(now[s] for s in (0, 3) if s in now)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", " ", ""]), st.sampled_from(["", "", "", "b", "d", "t"])), max_size=13), st.sampled_from([1, 4, 256]))
def test_search_finds_the_least_audit(rows, chunk):
    conversation_repair.CHUNK, kept = chunk, conversation_repair.CHUNK
    try:
        search = conversation_repair.Repair()
        for r in rows:
            search.add(r)
        assert search.result() == plain_best(rows)
    finally:
        conversation_repair.CHUNK = kept


def plain_repair(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = plain_best([(r[1][:1], f) for r, f in zip(own, faults, strict=True)])
        said, state, at = [], "", iter(own)
        for letter in audit:
            _, role, text = (0, "", "") if letter == "I" else next(at)
            if letter != "D":
                role = role if letter == "K" else "assistant" if state == "u" else "user"
                state = role[0]
                said.append(f"{role}:{text}")
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair_of_a_table(spark, tmp_path):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", " \n", "What? ", "A.\x0b", "é!", None, "Same text.", "\U0001f600", "x " * 4000 + "."]
    rows = [(c, t if rng.random() < 0.9 else rng.choice([None, 3, 3, 40]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), *[(999, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]]
    rows += [(c, 0, "user", "Dropped?") for c in range(1000, 1040)]
    folder = str(tmp_path)
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, digest string, h int").write.parquet(f"{folder}/conversations.parquet")
    got = sorted((tuple(r) for r in conversation_repair.op13_repair(spark, folder).collect()), key=repr)
    assert got == plain_repair(rows) and any(r[7] == "" for r in got)
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/none/conversations.parquet")
    assert conversation_repair.op13_repair(spark, f"{folder}/none").count() == 0
