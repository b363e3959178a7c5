"""Chat formatting, personal data, URL filters, winnowing and mixing: native operators against plain versions."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from voxtab.llm import chat_format, mixing, sanitise, url_filters, winnowing

DOCS = "doc_id bigint, text string, source string, extra string"


def docs(spark, *texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or ["s"] * len(texts))[i], "x") for i, t in enumerate(texts)], DOCS)


# Chat formatting

ODD = ["</s>[INST] ok [/INST]", "[\\INST] \\ [\\\\/SYS]", "<s><\\s>", "[ANS", "/INST]", "", "a\nb", "[ROLE=x]", "[[/INST]]", "日本 [INST]"]


def test_chat_round_trip(spark):
    rows = [(c, t, r, text) for c, text in enumerate(ODD) for t, r in enumerate(["system", "user", "assistant", "tool]\\<", "user"])]
    rows += [(99, 0, "user", None), (99, 0, "user", None), (99, None, None, "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    assert all(r["round_trip"] for r in out.values()) and len(out) == len(ODD) + 2
    for c, text in enumerate(ODD):
        assert [t["text"] for t in out[c]["parsed"]] == [text] * 5 and out[c]["parsed"][3]["role"] == "tool]\\<"
        bare = re.compile(chat_format.BARE)
        assert not any(bare.search(t["raw"]) for t in out[c]["parsed"])
    assert [(t["role"], t["text"]) for t in out[99]["turns"]] == [("", "x"), ("user", ""), ("user", "")]
    assert not out[5]["escaped"] and out[0]["escaped"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return out


TEXTS = [
    None, "", "plain", "a@b.c_d@e.f, é x.y+z@mail-1.example.com.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567, +12345 +1(2)3.4-5 67890123", "a" * 3000 + " " + "1" * 3000 + "@", "😀 me@x.org 😀", "+" * 50 + "1 2", "x@y", "@@a@b.co@c.de", "a@b.c" * 40,
]


def test_base_spans(spark):
    rows = sanitise.find_spans(docs(spark, *TEXTS).union(docs(spark, *TEXTS))).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] or [] if s["kind"] != "term"]
        assert got == base_spans(TEXTS[r["doc_id"]] or "")
    assert sanitise.find_spans(docs(spark).limit(0)).count() == 0


def plain_term_spans(texts, block):
    """Spans of disclosing terms of each text, by counting pairs in dictionaries."""
    word, email = r"[0-9]*[^\W\d_][^\W_]*", BASE["email"]
    name = lambda w: f"#{len(w)}" if re.search("[0-9]", w) else w.lower()
    found, terms, held = {}, {}, {}
    for text in set(texts):
        found[text] = []
        ends = []
        while not ends or ends[-1] < len(text):
            no, lo = len(ends), ends[-1] if ends else 0
            hi = min(len(text), lo + block)
            while hi < len(text) and re.match(r"[^\W_]|[._%+@-]", text[hi]):
                hi += 1
            ends.append(hi)
            for m in re.finditer(f"{email}|({word})", text[lo:hi]):
                if m[2] and len(m[2]) >= 4:
                    found[text].append((lo + m.start(), lo + m.end(), name(m[2])))
                    terms.setdefault(name(m[2]), set()).add((text, no))
            terms.setdefault(None, set()).add((text, no))
        for span in base_spans(text):
            kind, b, e = span.split(":")
            value = text[int(b) : int(e)]
            digits = re.sub("[^0-9]", "", value)
            group = value.split("@")[1].lower() if kind == "email" else ".".join(value.split(".")[:2]) if kind == "ip" else digits[:6]
            for c in ("any", kind, f"{kind}/{group}", f"{kind}={value}"):
                held.setdefault(c, set()).add((text, sum(e <= int(b) for e in ends)))
    n, share = len(terms.pop(None)), {}
    for blocks in held.values():
        for t, where in terms.items():
            both = len(where & blocks)
            if both >= 7 and len(blocks) < n:
                pmi = math.log2(both * n / (len(blocks) * len(where))) / math.log2(n / len(blocks))
                share[t] = max(share.get(t, 0), pmi * both / (both + 3))
    base = {t: [tuple(map(int, x.split(":")[1:])) for x in base_spans(t)] for t in found}
    return [sorted((b, e) for b, e, t in found[x] if share.get(t, 0) >= 0.7 and not any(p < e and b < q for p, q in base[x])) for x in texts]


def test_disclosing_terms(spark, monkeypatch):
    monkeypatch.setattr(sanitise, "BLOCK", 60)
    rng = random.Random(5)
    common = ["today", "some", "other", "words", "über", "belong", "HERE", "x9y8z7", "to", "and"]
    texts = []
    for i in range(240):
        words = [rng.choice(common) for _ in range(rng.randrange(1, 40))]
        if i % 6 == 0:
            words.insert(rng.randrange(len(words) + 1), f"secret{i % 10}x zanzibar zed{i}@corp{i % 2}.org")
        if i % 9 == 0:
            words.insert(rng.randrange(len(words) + 1), f"10.2.{i}.4 zanzibar")
        texts.append(" ".join(words))
    texts += [texts[0]] * 30 + ["y" * 200, "", "zanzibar alone"]
    want = plain_term_spans(texts, 60)
    got = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == "term") for r in sanitise.find_spans(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 40


def test_words_and_addresses_over_block_ends(spark):
    """A secret of any length across the end of a block goes whole, and an address there is one."""
    rng = random.Random(8)
    secret = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n - 1)) + "7"
    texts = [f"token {secret(300)} of me{i}@corp.org here" for i in range(40)] + [f"some other words {i} here" for i in range(400)]
    cut = secret(300)
    texts += ["ab " * 1290 + cut + " tail", "ab " * 1332 + "u.name@example.org tail", "x" * 4100 + "@a.b tail", "ab " * 1330 + secret(9000) + " tail"]
    got = {r["doc_id"]: r["sanitised"] for r in sanitise.sanitise(docs(spark, *texts)).collect()}
    n = len(texts)
    assert texts[-4].index(cut) < 4000 < texts[-4].index(cut) + 300 and not any(cut[k : k + 12] in got[n - 4] for k in range(0, 288, 12)) and got[n - 4].endswith(" tail")
    assert got[n - 3].endswith("ab <EMAIL> tail") and got[n - 2] == "<EMAIL> tail"
    (spans,) = [r["spans"] for r in sanitise.find_spans(docs(spark, *texts)).collect() if r["doc_id"] == n - 4]
    assert [(s["start"], s["end"]) for s in spans if s["end"] - s["start"] == 300] == [(texts[-4].index(cut), texts[-4].index(cut) + 300)]


def test_disclosing_terms_go_wherever_they_stand(spark):
    texts = [f"project zanzibar belongs to zed{i}@corp.org number today" for i in range(20)] + [f"today some other words {i} belongs" for i in range(200)] + ["zanzibar again", None]
    df = docs(spark, *texts).withColumnRenamed("extra", "spans")
    out = {r["doc_id"]: r["sanitised"] for r in sanitise.sanitise(df).collect()}
    assert "zanzibar" not in out[0] and "<EMAIL>" in out[0] and "today" in out[0] and out[30] == texts[30]
    assert "zanzibar" not in out[220] and out[220].endswith(" again") and out[221] is None and sanitise.sanitise(df).columns == [*df.columns, "sanitised"]


def test_names_with_digits_count_by_themselves(spark):
    """A name with digits that goes with one person goes, though other words of its length are common, and those stay."""
    texts = [f"profile of Anna87 {i} is anna@corp.org today" for i in range(20)] + [f"today rooms k{i:03d}zz and anna88 are other words" for i in range(200)] + ["about ANNA87 again"]
    got = {r["doc_id"]: r["sanitised"] for r in sanitise.sanitise(docs(spark, *texts)).collect()}
    assert not any("anna87" in t.lower() for t in got.values()) and got[220] == got[220].strip() and got[220].endswith(" again")
    assert all("Anna87" in texts[i] and "<EMAIL>" in got[i] for i in range(20)) and all(got[i] == texts[i] for i in range(20, 220))


# URL filters


def test_rules_and_templates(spark):
    urls = [None, "no scheme", "http://A.B.Example.ORG/es/1?x=/en/", "https://example.org/en/12", "https://xexample.org/en/12", "http://foo.com/de/1", "http://foo.com/fr/1#t", "ftp://org", "http://q.net/a/b/c/d/e/f"]
    urls += [f"http://bad.com/de/{i}" for i in range(30)] + [f"http://bad.com/en/{i}" for i in range(30)]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: r for r in url_filters.judge(df).collect()}
    assert len(got) == len(urls)
    assert [got[i]["rule"] for i in range(8)] == [None, None, "example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", None]
    assert (got[2]["host"], got[2]["path"]) == ("a.b.example.org", "/es/1") and (got[7]["host"], got[7]["path"]) == ("org", "")
    assert all(got[i]["verdict"] == "block" for i in range(9, 39)) and got[20]["template"] == "/de/#" and got[45]["template"] == "/en/#"
    assert url_filters.judge(df.limit(0)).count() == 0


def plain_tree(urls):
    """Template and purity of each url by recursion over nodes."""
    rules = {r: v for r, v in url_filters.RULES}
    pages = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len) if fits else None
        pages.append((host, re.sub("[0-9]+", "#", path), None if rule is None else rules[rule] == "block"))
    label = lambda group: (sum(x[2] is True for x in group), sum(x[2] is not None for x in group))
    smooth = lambda group, above: (label(group)[0] + 4 * above) / (label(group)[1] + 4)
    out = {}

    def node(group, template, level, purity):
        children = {}
        for x in group:
            parts = x[1].split("/")
            if len(parts) <= level:
                out[x[0], x[1]] = (template, purity)
            else:
                children.setdefault(parts[level], []).append(x)
        total = sum(map(len, children.values()))
        if len(children) >= 10 and len(children) > 0.3 * total:
            merged = {}
            for seg, g in children.items():
                merged.setdefault("*" if seg else "", []).extend(g)
            children = merged
        for known in (0, 1):
            order = sorted((label(g)[0] / label(g)[1] if known else 0, seg) for seg, g in children.items() if (label(g)[1] > 0) == bool(known))
            branches = []
            for share, seg in order:
                b, n = label(children[seg])
                if branches:
                    b0, n0 = label(children[branches[-1][-1]])
                    p = (b + b0) / (n + n0) if known else 0
                    apart = known and 0 < p < 1 and abs(share - b0 / n0) >= 1.96 * math.sqrt(p * (1 - p) * (1 / n + 1 / n0))
                if not branches or apart:
                    branches.append([])
                branches[-1].append(seg)
            for segs in branches:
                group = sum((children[s] for s in segs), [])
                node(group, template + "/" + min(segs) + ("~" if len(segs) > 1 else ""), level + 1, smooth(group, purity))

    overall = (label(pages)[0] + 2) / (label(pages)[1] + 4)
    for host in {x[0] for x in pages}:
        domain = re.search(r"[^.]*\.?[^.]*$", host)[0]
        above = smooth([x for x in pages if re.search(r"[^.]*\.?[^.]*$", x[0])[0] == domain], overall)
        group = [x for x in pages if x[0] == host]
        node(group, "", 1, smooth(group, above))
    return [out[x[0], x[1]] for x in pages]


def test_template_tree(spark):
    rng = random.Random(4)
    urls = [None, "x", "http://", "http://h.com", "http://h.com/"]
    for _ in range(900):
        depth = rng.randrange(0, 7)
        parts = [rng.choice(["de", "fr", "en", "es"])] + [rng.choice(["a", "b", "c", "p" + rng.choice("abcdefghijklmnop") * 2, "x" + str(rng.random())[2:8]]) for _ in range(depth)]
        urls.append(f"http://{rng.choice(['a.example.org', 'b.org', 'c.com', 'd.c.com', 'q.net'])}/" + "/".join(parts) + rng.choice(["", "/", "?q=1"]))
    rows = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
    got = {r["page_id"]: (r["template"], r["purity"]) for r in rows}
    for i, (template, purity) in enumerate(plain_tree(urls)):
        assert got[i][0] == template and got[i][1] == pytest.approx(purity, abs=2e-6), urls[i]
    assert any("~" in t for t, _ in got.values()) and len({t for t, _ in got.values()}) > 30


def test_wide_and_deep_trees(spark):
    """Any number of children that repeat, and paths of over 24 segments, are like the recursion."""
    names = ["".join(chr(97 + n // 26**k % 26) for k in range(3)) for n in range(1100)]
    urls = [f"http://x.com/{('de', 'fr', 'q')[n % 3]}/{s}/{'yz'[k % 2]}" for n, s in enumerate(names) for k in range(4)] + ["http://x.com/q/" + "/".join("ab"[k % 2] for k in range(n)) for n in (25, 26)] * 2
    got = {r["page_id"]: (r["template"], r["purity"]) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()}
    for i, (template, purity) in enumerate(plain_tree(urls)):
        assert got[i][0] == template and got[i][1] == pytest.approx(purity, abs=2e-6), urls[i]


# Winnowing


def plain_fingerprint(spark, text):
    words = text.lower().split()
    if not words:
        return []
    value = {w: r[0] for w in set(words) for r in [spark.sql("select xxhash64(:w)", args={"w": w}).first()]}
    h = [value[w] for w in words]
    chain = lambda part: spark.sql(f"select xxhash64({', '.join(f'{v}L' for v in part)})").first()[0]
    grams = [chain(h[i : i + winnowing.K]) >> 32 for i in range(len(h) - winnowing.K + 1)]
    picked = {min(range(i, i + winnowing.W), key=lambda n: (grams[n], -n)) for i in range(max(1, len(grams) - winnowing.W + 1)) if i + winnowing.W <= len(grams)}
    picked = picked or {min(range(len(grams)), key=lambda n: (grams[n], -n))}
    return [f"{grams[n] & 0xFFFFFFFF:x}:{n}" for n in sorted(picked)]


def test_winnowing(spark):
    text = "One two THREE four five six seven eight nine ten one two three four five six seven eight nine ten eleven twelve"
    texts = [text, None, "", " \t\n", "short", text, "same " * 30, "x" * 5000]
    df = docs(spark, *texts)
    got = {r["doc_id"]: r for r in winnowing.fingerprints(df, "text", "fp").select("doc_id", winnowing.readable("fp").alias("s"), "fp").collect()}
    assert got[0]["s"].split() == plain_fingerprint(spark, text) and got[0]["s"] == got[5]["s"]
    assert got[1]["s"] == got[2]["s"] == got[3]["s"] == "" and ":0" in got[4]["s"]
    assert [int(e.split(":")[1]) for e in got[6]["s"].split()] == sorted(range(7, 26)), "the rightmost of equal hashes"


@pytest.mark.parametrize("rows", [1, 4096])
def test_next_row(spark, monkeypatch, rows):
    monkeypatch.setattr(winnowing, "BUCKET_ROWS", rows)
    rng = random.Random(rows)
    ids = [5, 64, 65, 4096, 10**12, -3, 262144 * 5, *[rng.randrange(-(2**61), 2**61) for _ in range(300)], *[7] * 40, *[None] * 30, 6, 8]
    df = spark.createDataFrame([(i, n % 25 if i == 7 else n, f"t{i}", "n") for n, i in enumerate(ids)], "doc_id bigint, h bigint, text string, next string")
    df = df.withColumn("text", F.concat("text", F.lit("/"), F.col("h").cast("string")))
    order = sorted(((-(2**62) if r["doc_id"] is None else r["doc_id"], r["h"], r["text"]) for r in df.collect()))
    want = sorted((a[2], b[2]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r["text"], r["next"]["text"]) for r in winnowing.with_next(df, "doc_id", "h", ["text"]).collect()) == want
    assert winnowing.with_next(df.limit(0), "doc_id", "h", ["text"]).count() == 0
    (one,) = winnowing.with_next(df.limit(1), "doc_id", "h", ["text"]).collect()
    assert one["next"]["text"] == one["text"]


def test_next_row_of_many_equal_rows(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id < 10 THEN id ELSE 5 END AS doc_id", "1L AS h", "CASE WHEN id < 10 THEN cast(id AS string) ELSE '5' END AS text")
    got = {(r["text"], r["text2"]): r["count"] for r in winnowing.with_next(df, "doc_id", "h", ["text"]).groupBy("text", F.col("next.text").alias("text2")).count().collect()}
    assert got == {(str(i), str((i + 1) % 10)): 1 for i in range(10)} | {("5", "5"): 19_990}


# Mixing


def plain_targets(sizes, cap=3):
    """Targets by resharing the excess until none is above."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        left, open_ = left - sum(cap * sizes[s] for s in over), open_ - over
    return target


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 5, "é": 50, "zz": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark):
    texts = ["w " * n for n in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)] * 12 + ["", None, " \n"]
    sources = (["big"] * 80 + ["b"] * 20 + ["c"] * 20) + ["c", None, None]
    rows = mixing.mix(docs(spark, *texts, sources=sources)).collect()
    assert len(rows) == len(texts) and all(0 <= r["copies"] <= 3 for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r["row"]["source"]] = taken.get(r["row"]["source"], 0) + r["copies"] * r["size"]
        target[r["row"]["source"]] = r["target"]
        assert r["size"] == len((r["row"]["text"] or "").split())
    assert all(abs(taken[s] - target[s]) <= 2 for s in taken)
    again = mixing.mix(docs(spark, *texts, sources=sources)).collect()
    assert sorted((r["row"]["doc_id"], r["copies"]) for r in rows) == sorted((r["row"]["doc_id"], r["copies"]) for r in again)
    assert mixing.mix(docs(spark).limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    """lambda of the plain problem by bisection."""
    sizes = [1, 2, 3, 5, 8, 13, 21]
    mean, goal = sum(sizes) / len(sizes), {1: 1.4, 2: 0.6, 3: 1.0}
    classes = spark.createDataFrame([(s, n, 10, n / mean) for s in goal for n in sizes], "s_id int, size bigint, n bigint, c double")
    goals = spark.createDataFrame([(s, 10 * sum(sizes) * g, False) for s, g in goal.items()], "s_id int, target double, full boolean")
    got = {r["s_id"]: r["lam"] for r in mixing.solve(classes, goals).collect()}
    for s, g in goal.items():
        lo, hi = -20.0, 20.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * min(3, math.exp(mid * n / mean)) for n in sizes) < g * sum(sizes) else (lo, mid)
        assert got[s] == pytest.approx(lo, abs=1e-6)


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLASS_ROWS", 50)
    df = docs(spark, "a b c", "x y z w", sources=["s", "t"]).withColumn("row", F.lit(1)).withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("source") == "s", 3000).otherwise(400)))).repartition(4)
    rows = mixing.mix(df, carry=["doc_id", "source", "row"]).collect()
    taken, target = {}, {}
    for r in rows:
        taken[r["row"]["source"]] = taken.get(r["row"]["source"], 0) + r["copies"] * r["size"]
        target[r["row"]["source"]] = r["target"]
    assert len(rows) == 3400 and all(abs(taken[s] - target[s]) <= 200 for s in taken) and all(0 <= r["copies"] <= 3 for r in rows)
    assert set(mixing.mixed_stage(spark, df, "").columns) == set(df.columns)


def test_large_classes_are_salted(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLASS_ROWS", 10)
    rows = mixing.mix(docs(spark, *["a b c"] * 200, *["x"] * 7, sources=["s"] * 200 + ["t"] * 7)).collect()
    assert abs(sum(r["copies"] * r["size"] for r in rows if r["row"]["source"] == "s") - rows[0]["target"] * (rows[0]["row"]["source"] == "s")) <= 3 or rows[0]["row"]["source"] == "t"


def test_sha_of_edited_text(spark, tmp_path):
    texts = ["abcdefgh é", "0123", "", "zz zz zz zz"]
    docs(spark, *texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in winnowing.op7_fingerprint(spark, str(tmp_path)).collect():
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 4]
        q = len(t) // 4
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and r["n_chars"] == len(t)
