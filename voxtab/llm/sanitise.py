"""Personal data: patterns, then information-theoretic sanitisation of the terms that reveal them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each is an instance of protected entities at
four levels: the single value, its group (domain, network, issuer, country and area), its kind, and personal data of
any kind. A term is a lower-cased word of four characters or more outside e-mail addresses; a word with digits in it is
also a second term, its shape (``#40`` for 40 letters and digits), so that secrets, each of which stands once, count together
and a name with digits that comes again and again counts by itself; the term that gives away more decides.

The corpus shows how much a term t reveals of an entity c. The scope of every count is a block of BLOCK characters of a
distinct text, read on to the end of the word or address at its end however long that is (the copies of a text share a weight of one): PMI(c; t) = log2(n(c, t) N / (n(c) n(t))) over the entity's information
IC(c) = log2(N / n(c)) is the share of c that t gives away. The share shrinks by n(c, t) / (n(c, t) + SHRINK), so
that a few blocks prove little. Terms are generalised from GENERALISE on, removed from REMOVE on, wherever they stand in the corpus.

Positions come from columns only: ``split`` gives the text between matches, ``regexp_extract_all`` the matches, and sums of
their lengths are the offsets. Patterns are possessive and start at the left end of a run, so their time is linear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtab.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that skip a kind's pattern where it cannot match.
MAY_HOLD = {"email": ("contains", "@"), "ip": ("rlike", r"[0-9]\.[0-9]"), "card": ("rlike", r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": ("contains", "+")}
#: An e-mail address (consumed, group 1 empty) or a word with a letter in it.
TERM = PATTERNS["email"] + r"|([0-9]*+\p{L}[\p{L}0-9]*+)"
LEAST_TERM = 4
LETTERS = rf"\p{{L}}{{{LEAST_TERM},}}+"
#: Code points of a block, the scope of all counts, and what it is read on through: words and addresses are never cut.
BLOCK = 4000
ON = r"[\p{L}0-9._%+@-]"
SHRINK = 3.0
GENERALISE = 0.7
REMOVE = 0.9
#: Rows (about 60 bytes each) that are broadcast at most; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
SPAN = "struct<rank:int,kind:string,start:bigint,end:bigint,action:string>"


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """id, hash, kind, start, end, value and no, the block, for each base span of docs (id, hash, text; rows all different)."""
    found = []
    for kind in KINDS:
        how, what = MAY_HOLD[kind]
        may = getattr(F.col("text"), how)(what)
        found.append(F.when(may, F.struct(F.lit(kind).alias("kind"), F.split("text", PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)).alias("hits"))))
    rows = docs.select("id", "hash", _ends(_parts(F.col("text"))).alias("ends"), F.explode(F.array_compact(F.array(*found))).alias("m")).filter(F.size("m.hits") > 0)
    each = F.transform(
        F.col("m.hits"),
        lambda v, i: F.struct(
            v.alias("value"),
            F.length(F.get("m.gaps", i)).alias("gap"),
        ),
    )
    rows = rows.select("id", "hash", "ends", "m.kind", F.posexplode(each).alias("at", "hit")).select("id", "hash", "ends", "kind", "at", "hit.*")
    along = Window.partitionBy("id", "hash", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(along)).withColumn("start", F.col("end") - F.length("value"))
    no = F.size(F.filter("ends", lambda e: e <= F.col("start")))
    return rows.filter(_valid(F.col("kind"), F.col("value"))).select("id", "hash", "kind", "start", "end", "value", no.alias("no"))


def _entities(kind: Column, value: Column) -> Column:
    """What a base span stands for: personal data, its kind, its group and the value itself."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    group = (
        F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .otherwise(F.substring(digits, 1, 6))
    )
    return F.array(F.lit("any"), kind, F.concat(kind, F.lit("/"), group), F.concat(kind, F.lit("="), value))


def _parts(text: Column) -> Column:
    """The text in blocks; an empty one is a block."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}{ON}*+"), F.lit(0)))


def _ends(parts: Column) -> Column:
    """Where each block ends."""
    return F.transform(parts, lambda _, i: F.aggregate(F.slice(parts, F.lit(1), i + 1), F.lit(0), lambda n, p: n + F.length(p)))


def _block_rows(texts: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` of texts and b, a struct (no, begin, body), for each block."""
    # The parts and their ends are columns of their own, so that a text is cut once and not once a block.
    rows = texts.select(*keep, _parts(F.col("text")).alias("parts")).select(*keep, "parts", _ends(F.col("parts")).alias("ends"))
    one = lambda body, no: F.struct(no.alias("no"), (F.get("ends", no) - F.length(body)).alias("begin"), body.alias("body"))
    return rows.select(*keep, F.explode(F.transform("parts", one)).alias("b"))


def _shape(word: Column) -> Column:
    """The second term of a word with digits; null for others."""
    return F.when(F.translate(word, "0123456789", "") != word, F.concat(F.lit("#"), F.length(word).cast("string")))


def _terms(body: Column) -> Column:
    """Distinct terms of a block; the first branch is the second where there are no digits and no addresses."""
    letters = F.transform(F.regexp_extract_all(body, F.lit(LETTERS), F.lit(0)), F.lower)
    words = F.filter(F.regexp_extract_all(body, F.lit(TERM), F.lit(1)), lambda w: F.length(w) >= LEAST_TERM)
    both = F.concat(F.transform(words, F.lower), F.array_compact(F.transform(words, _shape)))
    return F.array_distinct(F.when(~body.rlike("[0-9@]"), letters).otherwise(both))


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def block_terms(texts: DataFrame) -> DataFrame:
    """id, hash, no, terms of every block of texts (id, hash, text): what all counts and searches go by, written once."""
    return written(_block_rows(texts, "id", "hash").select("id", "hash", "b.no", _terms(F.col("b.body")).alias("terms")), "pii-terms")


def disclosing(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """term, share: how much of some entity's information each term gives away, for those from GENERALISE on.

    spans: hash, no, kind, value; blocks: hash, no, terms, one row for each block of each row of the corpus.
    """
    copies = blocks.filter("no = 0").groupBy("hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    copies = _small(written(copies, "pii-copies"))
    weighed = blocks.join(copies, "hash", "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))
    whole = lambda c: F.round(F.sum(c)).cast("double")
    n_t = weighed.select("weight", F.explode("terms").alias("term")).groupBy("term").agg(whole("weight").alias("n_t"))
    (n,) = weighed.agg(whole("weight")).first()
    # A text stands once for all rows that repeat it, so its spans count once too.
    held = spans.groupBy("hash", "no").agg(F.array_distinct(F.flatten(F.collect_set(_entities(F.col("kind"), F.col("value"))))).alias("entities"))
    held = written(held, "pii-held")
    n_c = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").cast("double").alias("n_c"))
    # No term of an entity of fewer blocks can reach the threshold, whatever its counts.
    least = SHRINK * GENERALISE / (1 - GENERALISE)
    n_c = _small(written(n_c.filter(F.col("n_c") >= least - 1e-9), "pii-entities"))
    bodies = blocks.join(_small(held.select("hash", "no")), ["hash", "no"], "left_semi").dropDuplicates(["hash", "no"])
    pairs = bodies.join(held, ["hash", "no"]).select("terms", F.explode("entities").alias("entity")).join(n_c, "entity")
    joint = pairs.select("entity", "n_c", F.explode("terms").alias("term")).groupBy("entity", "n_c", "term").agg(F.count("*").cast("double").alias("n_ct"))
    joint = written(joint.filter(F.col("n_ct") >= least - 1e-9), "pii-joint")
    pmi = F.log2(F.col("n_ct") * F.lit(n) / (F.col("n_c") * F.col("n_t")))
    share = F.when(F.col("n_c") < n, pmi / F.log2(F.lit(n) / F.col("n_c")) * F.col("n_ct") / (F.col("n_ct") + SHRINK)).otherwise(0.0)
    strong = joint.join(n_t.join(_small(joint.select("term").distinct()), "term", "left_semi"), "term")
    return strong.groupBy("term").agg(F.max(share).alias("share")).filter(F.col("share") >= GENERALISE)


def _term_spans(texts: DataFrame, blocks: DataFrame, strong: DataFrame) -> DataFrame:
    """id, hash, start, end, share of each place of a strong term in texts."""
    hits = blocks.select("id", "hash", "no", F.explode("terms").alias("term")).join(_small(strong), "term")
    hits = hits.groupBy("id", "hash", "no").agg(F.collect_set(F.struct("term", "share")).alias("found"))
    hits = written(hits.withColumn("found", F.map_from_entries("found")), "pii-hits")
    rows = texts.join(_small(hits.select("id", "hash").distinct()), ["id", "hash"], "left_semi")
    rows = _block_rows(rows, "id", "hash").select("id", "hash", "b.*").join(_small(hits), ["id", "hash", "no"])
    rows = rows.withColumn("gaps", F.split("body", TERM, -1)).withColumn("words", F.regexp_extract_all("body", F.lit(TERM), F.lit(0)))
    share = lambda w: F.when(F.length(w) >= LEAST_TERM, F.greatest(F.try_element_at("found", F.lower(w)), F.try_element_at("found", _shape(w))))
    each = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("word"), share(w).alias("share"))), lambda x: x["share"].isNotNull())
    lengths = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda x, v: x + F.length(v))
    rows = rows.select("id", "hash", "begin", "gaps", "words", F.explode(each).alias("x"))
    start = F.col("begin") + lengths(F.col("gaps"), F.col("x.i") + 1) + lengths(F.col("words"), F.col("x.i"))
    # Rows that repeat give the same places.
    return rows.select("id", "hash", start.cast("bigint").alias("start"), (start + F.length("x.word")).cast("bigint").alias("end"), "x.share").distinct()


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text) and spans, an array of (rank, kind, start, end, action) in order, for every row of docs (doc_id, text).

    rank is the place of the kind among email, ip, card, phone, term; action is ``replace`` for base spans, ``generalise`` or
    ``remove`` for terms. Offsets are code points, end exclusive. Null and empty texts have no spans; rows that repeat get the
    same spans; a null doc_id stays null; an empty table gives no rows. Other columns of docs are ignored.
    """
    texts = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    holds = [getattr(F.col("text"), how)(what) for how, what in MAY_HOLD.values()]
    some = texts.filter(holds[0] | holds[1] | holds[2] | holds[3]).dropDuplicates(["id", "hash"])
    spans = written(base_spans(some), "pii-spans")
    blocks = block_terms(texts)
    strong = written(disclosing(spans, blocks), "pii-strong")
    terms = _term_spans(texts, blocks, strong)
    ranks = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "ip", 1).when(F.col("kind") == "card", 2).otherwise(3)
    every = spans.select("id", "hash", ranks.alias("rank"), "kind", "start", "end", F.lit("replace").alias("action")).union(
        terms.select("id", "hash", F.lit(4), F.lit("term"), "start", "end", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise"))
    )
    every = every.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "start", "end", "action"))).alias("s"))
    base = F.filter("s", lambda x: x["rank"] < 4)
    free = F.filter("s", lambda x: (x["rank"] == 4) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    every = every.withColumn("base", base).select("id", "hash", F.concat("base", free).alias("spans"))
    out = texts.select("id", "hash").join(every, ["id", "hash"], "left")
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), "hash", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with ``sanitised``: base spans as ``<KIND>``, generalised terms as ``<TERM>``, removed terms gone.

    A null text stays null and an empty one empty; rows that repeat are all kept and get the same answer; an empty table gives no rows.
    A column ``sanitised`` of docs is replaced, all others are kept; names that begin with ``__pii_`` are taken.
    """
    found = find_spans(docs.select("doc_id", "text")).dropDuplicates(["doc_id", "hash"])
    found = found.select(F.col("doc_id").alias("__pii_id"), F.col("hash").alias("__pii_hash"), F.col("spans").alias("__pii_spans"))
    rows = docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(found["__pii_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["__pii_hash"]))
    by_place = F.array_sort(F.transform("__pii_spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"), s["action"].alias("x"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def put(acc: Column, s: Column) -> Column:
        mark = F.when(s["x"] == "remove", "").when(s["x"] == "generalise", "<TERM>").otherwise(F.concat(F.lit("<"), F.upper(s["k"]), F.lit(">")))
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (F.greatest(s["a"], acc["at"]) - acc["at"]).cast("int"))
        return F.when(s["a"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["done"], gap, mark).alias("done"), s["b"].alias("at")))

    rest = lambda acc: F.concat(acc["done"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    return rows.withColumn("sanitised", F.aggregate(by_place, start, put, rest)).drop("__pii_id", "__pii_hash", "__pii_spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans, n_terms, n_spans for every document.

    A null or empty text has no spans; a null doc_id stays null; repeated rows get equal answers; no documents, no rows.
    """
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)],
        F.sha2(said(F.filter("spans", lambda s: s["rank"] < 4)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        count(4).alias("n_terms"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )


ORACLE_OP2 = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT doc_id, text FROM docs),
m AS (
  SELECT doc_id, text, 'email' AS kind, 0 AS rank, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hits,
    string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM u
  UNION ALL SELECT doc_id, text, 'ip', 1, regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM u
  UNION ALL SELECT doc_id, text, 'card', 2, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM u
  UNION ALL SELECT doc_id, text, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM u),
h0 AS (SELECT doc_id, text, kind, rank, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM m WHERE len(hits) > 0),
h1 AS (SELECT doc_id, text, kind, rank, i, hits[i] AS value, length(gaps[i]) AS gap, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits FROM h0),
h2 AS (SELECT *, sum(gap + length(value)) OVER (PARTITION BY doc_id, text, kind ORDER BY i) AS e FROM h1),
spans AS (SELECT *, e - length(value) AS b FROM h2 WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(value, '0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}')
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(digits[length(digits) - k + 1] AS INT)
           WHEN CAST(digits[length(digits) - k + 1] AS INT) > 4 THEN 2 * CAST(digits[length(digits) - k + 1] AS INT) - 9
           ELSE 2 * CAST(digits[length(digits) - k + 1] AS INT) END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
t AS (SELECT text, row_number() OVER () AS tid FROM (SELECT DISTINCT text FROM u)),
b0 AS (SELECT tid, text, 0 AS no, 0 AS begin_, 4000 + length(regexp_extract(substr(text, 4001), '^[\p{L}0-9._%+@-]*')) AS end_ FROM t
  UNION ALL SELECT tid, text, no + 1, end_, end_ + 4000 + length(regexp_extract(substr(text, end_ + 4001), '^[\p{L}0-9._%+@-]*')) FROM b0 WHERE end_ < length(text)),
b3 AS (SELECT tid, no, begin_, end_, substr(text, begin_ + 1, end_ - begin_) AS body FROM b0),
w0 AS MATERIALIZED (SELECT tid, no, begin_, regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|([0-9]*\p{L}[\p{L}0-9]*)', 0) AS words,
    string_split_regex(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[0-9]*\p{L}[\p{L}0-9]*') AS gaps FROM b3),
w1 AS (SELECT tid, no, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w0),
w AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(word, '[0-9]') THEN '#' || length(word) ELSE lower(word) END AS term FROM w1 WHERE length(word) >= 4 AND NOT contains(word, '@')),
n_t AS (SELECT term, count(*)::DOUBLE AS n_t FROM (SELECT DISTINCT tid, no, term FROM w) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM b0),
e0 AS (SELECT tid, no, kind, value, digits FROM spans JOIN t USING (text) JOIN b3 USING (tid) WHERE b >= begin_ AND b < end_),
held AS (
  SELECT tid, no, 'any' AS entity FROM e0 UNION SELECT tid, no, kind FROM e0 UNION SELECT tid, no, kind || '=' || value FROM e0
  UNION SELECT tid, no, kind || '/' || CASE kind WHEN 'email' THEN lower(split_part(value, '@', 2)) WHEN 'ip' THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) ELSE substr(digits, 1, 6) END FROM e0),
n_c AS (SELECT entity, count(*)::DOUBLE AS n_c FROM held GROUP BY entity),
joint AS (SELECT entity, term, count(*)::DOUBLE AS n_ct FROM held JOIN (SELECT DISTINCT tid, no, term FROM w) x USING (tid, no) GROUP BY entity, term),
strong AS (SELECT term, max(CASE WHEN n_c < n THEN log2(n_ct * n / (n_c * n_t)) / log2(n / n_c) * n_ct / (n_ct + 3) ELSE 0 END) AS share
  FROM joint JOIN n_c USING (entity) JOIN n_t USING (term), n WHERE n_ct >= 7 - 1e-9 GROUP BY term),
places AS (SELECT w.tid, begin_ + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(words[1:i - 1], lambda x: length(x))), 0) AS b, length(word) AS size
  FROM w JOIN strong USING (term) JOIN w0 ON w0.tid = w.tid AND w0.no = w.no WHERE share >= 0.7),
terms AS (SELECT DISTINCT doc_id, u.text, b, size FROM places JOIN t USING (tid) JOIN u ON u.text = t.text),
every AS (
  SELECT doc_id, text, kind, rank, b, e FROM spans
  UNION ALL SELECT doc_id, text, 'term', 4, b, b + size FROM terms t WHERE NOT EXISTS (
    SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id AND s.text = t.text AND s.b < t.b + t.size AND t.b < s.e)),
g AS (SELECT doc_id, text, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card,
    count(*) FILTER (rank = 3) AS n_phone, count(*) FILTER (rank = 4) AS n_terms, count(*) AS n_spans,
    string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY rank, b) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY rank, b) AS spans FROM every GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms, coalesce(n_spans, 0) AS n_spans
FROM docs d LEFT JOIN g ON g.doc_id = d.doc_id AND g.text = d.text
"""
