"""Stateful streams and the registry against plain versions."""

import random
from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxtab.streaming import jobs, log

REQUESTS = "view_id string, event_id bigint, render_revision bigint, is_final boolean, targets array<string>"


def random_log(rng, n=300):
    pick = lambda: rng.choice([None, [], ["a"], ["b", "a"], ["c", "b"]]) if rng.random() < 0.5 else ["a"]
    return [(f"v{rng.randrange(25)}", e, rng.choice([None, *range(6)]), rng.random() < 0.2, pick()) for e in range(n)]


def plain_fold(rows):
    by = {}
    for view, e, r, f, t in rows:
        by.setdefault(view, []).append((e, r, f, None if t is None else tuple(dict.fromkeys(t))))
    return {v: reduce(jobs.merged, own) for v, own in by.items()}


def as_dict(df):
    return {r["view_id"]: (r["event_id"], r["render_revision"], r["is_final"], None if r["targets"] is None else tuple(r["targets"])) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_latest_requests_are_the_fold(spark, seed):
    rows = random_log(random.Random(seed))
    want = plain_fold(rows)
    assert as_dict(jobs.latest_event_per_key(spark.createDataFrame(rows, REQUESTS))) == want and any(w[3] is None for w in want.values()) and any(w[3] for w in want.values())


def stream_of(spark, batches, schema, folder):
    """A stream that reads one written batch after the other."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/b={n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/b=*")


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_latest_stream(spark, tmp_path, rocks):
    rows = random_log(random.Random(9), 240)
    source = stream_of(spark, [rows[n : n + 60] for n in range(0, 240, 60)], REQUESTS, str(tmp_path))
    got = {}

    def take(batch, _):
        got.update(as_dict(batch))

    jobs.latest_stream(source).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert got == plain_fold(rows)


ITEMS = "kind string, item_id string, seen timestamp, protected boolean"


def test_expiry_stream(spark, tmp_path, rocks):
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    batches = [
        [("upload", "old", at(0), False), ("upload", "renewed", at(0), False), ("cache", "kept", at(0), True), ("cache", "gone", at(0), False), ("other", "x", at(0), False), ("job", "ended", at(0), True)],
        [("upload", "renewed", at(20), False), ("job", "ended", at(21), False), ("upload", "clock", at(40), False)],
        [("upload", "clock", at(49), False)],
        [("upload", "clock", at(60 * 24), False)],
        [("upload", "clock", at(60 * 24 + 22), False)],
        [("upload", "clock", at(60 * 24 + 23), False)],
    ]
    out = []
    source = stream_of(spark, batches, ITEMS, str(tmp_path))
    jobs.expiry_stream(source).writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend((r["kind"], r["item_id"], r["seen"]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(x[:2] for x in out) == [("cache", "gone"), ("job", "ended"), ("upload", "old"), ("upload", "renewed")]
    assert {x[1]: x[2] for x in out}["renewed"] == at(20)


def test_bounds_of_age(spark):
    df = spark.createDataFrame([("upload", "at", 8200, False), ("upload", "under", 8201, True), ("cache", "at", -76400, False), ("cache", "over", -76401, False), ("cache", "protected", -90000, True), ("job", "runs", -90000, True), ("job", "ended", -90000, False), ("odd", "x", -90000, False)], "kind string, item_id string, seen bigint, protected boolean")
    assert sorted((r["kind"], r["item_id"]) for r in log.expire_stale(stored_items=df, now=10000.0).collect()) == [("cache", "over"), ("job", "ended"), ("upload", "at")]


def upsert(spark, folder, batch_id, rows):
    """rows: workspace, key, paths."""
    series = spark.createDataFrame([(w, k, f"new-{w}-{k}") for w, k, _ in rows], "workspace_id string, series_key string, series_id string")
    paths = spark.createDataFrame([(w, k, p) for w, k, own in rows for p in own], "workspace_id string, series_key string, path string")
    jobs.upsert_batch(series, paths, folder, batch_id)
    return {(r["workspace_id"], r["series_key"]): r["series_id"] for r in jobs.registry(spark, folder).collect()}


def test_registry_keeps_ids(spark, tmp_path):
    folder = str(tmp_path / "registry")
    first = upsert(spark, folder, 0, [("w", "a", ["/1", "/2"]), ("w", "b", ["/3"])])
    assert first == {("w", "a"): "new-w-a", ("w", "b"): "new-w-b"}
    again = upsert(spark, folder, 1, [("w", "a2", ["/0", "/2"]), ("v", "a", ["/1"]), ("w", "b", ["/9"])])
    assert again == first | {("w", "a2"): "new-w-a", ("v", "a"): "new-v-a"}
    assert upsert(spark, folder, 1, [("w", "a2", ["/0", "/2"]), ("v", "a", ["/1"]), ("w", "b", ["/9"])]) == again
    assert upsert(spark, folder, 2, [("w", "c", ["/9"])]) == again | {("w", "c"): "new-w-b"}
    rows = spark.read.parquet(f"{folder}/paths")
    assert rows.count() == rows.select("workspace_id", "path").distinct().count() == 6


def test_ingest_of_several_batches(spark, tmp_path):
    from voxtab.operators import catalog
    from voxtab.plans import registry

    given = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    got = registry.QUERIES["stream_ingest"](spark, "/root/testdata/sf0.001")
    want = catalog.group_series(lineitem=given).select("workspace_id", "series_key", "series_id").distinct()
    assert sorted(map(tuple, got.select("workspace_id", "series_key", "series_id").collect())) == sorted(map(tuple, want.collect()))


def test_windows_of_a_stream(spark, tmp_path):
    spark.sql("SELECT 'w' AS workspace_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 4, 0) AS ts FROM range(30)").repartition(1).write.parquet(str(tmp_path / "log"))
    schema = spark.read.parquet(str(tmp_path / "log")).schema
    for name, build in (("windows", jobs.window_stream), ("sessions", jobs.session_stream)):
        build(spark.readStream.schema(schema).parquet(str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("windows").agg(F.sum("requests")).first()[0] == 60 and spark.table("sessions").collect()[0]["requests"] == 30
