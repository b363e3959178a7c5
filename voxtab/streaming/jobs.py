"""Structured Streaming jobs over the request log, stored items and arriving headers.

The stateful ones (``latest_stream``, ``expiry_stream``) keep several state variables, timers and times to live and need the RocksDB state store
(``STATE_STORE``), which the session names in spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from voxtab.operators import catalog

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATEST = "view_id string, event_id bigint, render_revision bigint, is_final boolean, targets array<string>"

#: A request: id, revision, whether it is final, targets (None: all).
Request = tuple[int, int | None, bool, tuple[str, ...] | None]


def merged(current: Request, incoming: Request) -> Request:
    """The request that counts after a further one: a final stays unless a preview has a higher revision; targets join, and all absorbs any.

    A null revision is never higher.
    """
    newer = current[1] is not None and incoming[1] is not None and incoming[1] > current[1]
    chosen = current if current[2] and not incoming[2] and not newer else incoming
    targets = None if current[3] is None or incoming[3] is None else tuple(dict.fromkeys((*current[3], *incoming[3])))
    return (*chosen[:3], targets)


def requests_of(frame: pd.DataFrame) -> list[Request]:
    """Requests of a frame in order of their ids."""
    one = frame.sort_values("event_id", kind="stable")
    columns = (one[c] for c in ("event_id", "render_revision", "is_final", "targets"))
    return [(int(e), None if pd.isna(r) else int(r), bool(f), None if t is None else tuple(dict.fromkeys(t))) for e, r, f, t in zip(*columns, strict=True)]


def latest_event_per_key(events: DataFrame) -> DataFrame:
    """One current request for each view of a batch: the fold of ``merged`` as aggregates in the JVM, without a view's history in one place.

    The last final of a view stays current until a preview of a higher revision comes; from then on, and in a view without a final, the
    last request is current. Targets are all if any request has all, else the different ones in the order in which they came.
    """
    one = F.struct("event_id", "render_revision")
    last = events.groupBy("view_id").agg(F.max(F.when(F.col("is_final"), one)).alias("final"), F.max(one).alias("preview"), F.bool_or(F.col("targets").isNull()).alias("whole"))
    after = events.join(last.select("view_id", "final"), "view_id").filter(~F.col("is_final") & (F.col("event_id") > F.col("final.event_id")) & (F.col("render_revision") > F.col("final.render_revision")))
    # The first preview above the final makes a preview current, which any later request replaces.
    since = after.groupBy("view_id").agg(F.min("event_id").alias("since"))
    each = events.select("view_id", "event_id", F.posexplode("targets").alias("pos", "target")).groupBy("view_id", "target").agg(F.min(F.struct("event_id", "pos")).alias("at"))
    names = each.groupBy("view_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "target"))), lambda x: x["target"]).alias("names"))
    rows = last.join(since, "view_id", "left").join(names, "view_id", "left")
    current = F.when(F.col("final").isNull() | F.col("since").isNotNull(), F.col("preview")).otherwise(F.col("final"))
    targets = F.when(~F.col("whole"), F.coalesce("names", F.array().cast("array<string>")))
    return rows.select("view_id", current["event_id"].alias("event_id"), current["render_revision"].alias("render_revision"), (F.col("final").isNotNull() & F.col("since").isNull()).alias("is_final"), targets.alias("targets"))


class LatestRequest(StatefulProcessor):
    """A view's current request and the targets of all its requests, each forgotten after an hour without one."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "event_id bigint, render_revision bigint, is_final boolean, whole boolean", self.idle_ms)
        self.targets = handle.getMapState("targets", "target string", "place bigint", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [r for frame in rows for r in requests_of(frame)]
        new.sort(key=lambda r: r[0])
        now: Request | None = None
        if self.current.exists():
            event_id, revision, final, whole = self.current.get()
            known = sorted((place[0], name[0]) for name, place in self.targets.iterator()) if self.targets.exists() else []
            now = (event_id, revision, final, None if whole else tuple(name for _, name in known))
        now = reduce(merged, new, now) if now else reduce(merged, new)
        self.current.update((*now[:3], now[3] is None))
        for place, name in enumerate(now[3] or ()):
            self.targets.updateValue((name,), (place,))
        yield pd.DataFrame({"view_id": [key[0]], "event_id": [now[0]], "render_revision": [now[1]], "is_final": [now[2]], "targets": [None if now[3] is None else list(now[3])]})

    def close(self) -> None:
        pass


def latest_stream(events: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """``latest_event_per_key`` over a stream (view_id, event_id, render_revision, is_final, targets); requests of a view come in the order of their ids."""
    return events.select("view_id", "event_id", "render_revision", "is_final", "targets").groupBy("view_id").transformWithStateInPandas(LatestRequest(idle_ms), LATEST, "Update", "ProcessingTime")


#: Longest age of uploads, cached archives and ended jobs in seconds; fixed values.
AGES = {"upload": 30 * 60, "cache": 24 * 3600, "job": 24 * 3600}


class Expiry(StatefulProcessor):
    """The last sight of an item, whether it is protected, and a timer for the moment at which it is too old."""

    def __init__(self, ages: dict[str, int]) -> None:
        self.ages = ages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "seen_ms bigint, protected boolean")

    def _due(self, kind: str, seen_ms: int) -> int:
        """Uploads go when they reach the age, cached archives and jobs when they are older."""
        return seen_ms + self.ages[kind] * 1000 + (kind != "upload")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("seen", kind="stable")
        seen, protected = int(frame["seen"].iloc[-1].value // 1_000_000), bool(frame["protected"].iloc[-1])
        if self.item.exists():
            before = self.item.get()
            if before[0] > seen:  # late news of an item change nothing
                return iter(())
            self.handle.deleteTimer(self._due(key[0], before[0]))
        self.item.update((seen, protected))
        if not protected:
            self.handle.registerTimer(self._due(key[0], seen))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.item.exists():
            seen, protected = self.item.get()
            if not protected and self._due(key[0], seen) <= expiredTimerInfo.getExpiryTimeInMs():
                self.item.clear()
                yield pd.DataFrame({"kind": [key[0]], "item_id": [key[1]], "seen": [pd.Timestamp(seen, unit="ms")]})

    def close(self) -> None:
        pass


def expiry_stream(items: DataFrame, ages: dict[str, int] | None = None, late: str = "0 seconds") -> DataFrame:
    """Items (kind, item_id, seen, protected) of a stream as they become too old by event time, a row each; sights renew them, protected ones wait.

    What is no known kind is left out. A job counts as protected until it has ended.
    """
    ages = ages or AGES
    known = items.filter(F.col("kind").isin(*ages)).withWatermark("seen", late).select("kind", "item_id", "seen", "protected")
    return known.groupBy("kind", "item_id").transformWithStateInPandas(Expiry(ages), "kind string, item_id string, seen timestamp", "Append", "EventTime")


def session_stream(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions of each workspace, closed when the watermark passes their gap."""
    return events.withWatermark("ts", gap).groupBy("workspace_id", F.session_window("ts", gap)).agg(F.count("*").alias("requests"))


def window_stream(events: DataFrame, length: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """Requests of each workspace in sliding windows, late ones within the watermark counted."""
    return events.withWatermark("ts", length).groupBy("workspace_id", F.window("ts", length, step)).agg(F.count("*").alias("requests"))


# The registry of series


SERIES = "workspace_id string, series_key string, series_id string, batch bigint"
PATHS = "workspace_id string, path string, series_id string, batch bigint"


def _before(spark, folder: str, name: str, schema: str, batch_id: int) -> DataFrame:  # noqa: ANN001
    """What earlier batches have written; a batch that runs again does not see its own rows."""
    path = f"{folder}/{name}"
    try:
        known = spark.read.schema(schema).parquet(path)
    except Exception as fault:  # no batch has written yet
        if "PATH_NOT_FOUND" not in str(fault):
            raise
        return spark.createDataFrame([], schema)
    return known.filter(F.col("batch") < batch_id)


def registry(spark, folder: str, batch_id: int | None = None) -> DataFrame:  # noqa: ANN001
    """workspace_id, series_key, series_id of all series, or of those before a batch."""
    known = _before(spark, folder, "series", SERIES, 1 << 62 if batch_id is None else batch_id)
    return known.groupBy("workspace_id", "series_key").agg(F.min_by("series_id", "batch").alias("series_id"))


def upsert_batch(series: DataFrame, instances: DataFrame, folder: str, batch_id: int) -> None:
    """Add series (workspace_id, series_key, series_id proposed) and their instances (workspace_id, series_key, path) to the registry in ``folder``.

    A registered key keeps its id; else a series takes the id of the first of its paths that is registered; else the proposed one. A batch
    writes what it adds to a folder of its own number and reads those before, so a batch that runs again changes nothing, whatever it had written.
    """
    spark = series.sparkSession
    by_key = registry(spark, folder, batch_id).withColumnRenamed("series_id", "key_id")
    paths = _before(spark, folder, "paths", PATHS, batch_id).groupBy("workspace_id", "path").agg(F.min_by("series_id", "batch").alias("path_id"))
    instances = instances.select("workspace_id", "series_key", "path").distinct()
    by_path = instances.join(paths, ["workspace_id", "path"]).groupBy("workspace_id", "series_key").agg(F.min_by("path_id", "path").alias("path_id"))
    named = series.select("workspace_id", "series_key", "series_id").join(by_key, ["workspace_id", "series_key"], "left").join(by_path, ["workspace_id", "series_key"], "left")
    named = named.select("workspace_id", "series_key", F.coalesce("key_id", "path_id", "series_id").alias("series_id"), F.col("key_id").isNull().alias("new"))
    named.filter("new").select("workspace_id", "series_key", "series_id").write.mode("overwrite").parquet(f"{folder}/series/batch={batch_id}")
    of = instances.join(named.select("workspace_id", "series_key", "series_id"), ["workspace_id", "series_key"])
    of = of.join(paths, ["workspace_id", "path"], "left_anti").select("workspace_id", "path", "series_id")
    of.write.mode("overwrite").parquet(f"{folder}/paths/batch={batch_id}")


def stream_ingest(source: DataFrame, folder: str, checkpoint: str, table: str = "lineitem") -> StreamingQuery:
    """Series of arriving files, batch by batch, merged into the registry in ``folder``; ``source`` streams headers or the table that they are made of."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        upsert_batch(catalog.group_series(**{table: batch}), catalog.keyed_headers(**{table: batch}), folder, batch_id)
        batch.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
