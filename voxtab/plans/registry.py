"""All queries over the given tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.helpers import images
from voxtab.operators import catalog, graph, pet, pixels, presets, roi, tag_edits, volumes
from voxtab.plans.statement import DUCKDB, REGISTRY, over_tables, statement
from voxtab.sources import archives, dicom, views
from voxtab.streaming import jobs, log

#: Modules whose operators are registered by being imported.
MODULES = (catalog, pet, pixels, presets, roi, tag_edits, volumes, archives, views, log)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: over_tables(op) for n, op in REGISTRY.items() if not op.view}
QUERIES |= images.queries()
QUERIES |= {
    "latest_event_per_key": lambda s, d: jobs.latest_event_per_key(over_tables(REGISTRY["requests"])(s, d)),
    "flatten_tags": lambda s, d: dicom.flatten_tags(over_tables(REGISTRY["qido_records"])(s, d)),
}


def _table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_tables(REGISTRY[name])(spark, sf_dir)


def _read_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dicom.read_headers(dicom.header_files(_table("headers", spark, sf_dir)))
    return got.select("path", "sop_uid", "series_uid", "study_uid", "modality", "series_description", "photometric", "rows_", "columns_")


def _write_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.write_catalog(_table("group_series", spark, sf_dir), f"{graph.shared_dir(spark)}/catalog-{uuid.uuid4().hex}")


#: Uids without a header that may go to every task.
STRAY = 1_000_000


def _with_new_uids(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that renames uids: those without a header are found first, by uid alone; if they are few, elements are not moved by uid."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
        folder = f"{graph.shared_dir(spark)}/stray-{uuid.uuid4().hex}"
        REGISTRY["stray_uids"](**given).write.parquet(folder)
        stray = spark.read.parquet(folder)
        return REGISTRY[name](**given, stray_uids=stray, stray=True) if stray.count() <= STRAY else REGISTRY[name](**given)

    return query


def _upsert_series_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series are grouped once and kept in the shared folder: the new registry, the one before it and the search for series that did not come again read them there."""
    series = archives.write_catalog(_table("group_series", spark, sf_dir), f"{graph.shared_dir(spark)}/series-{uuid.uuid4().hex}")
    return catalog.upsert_series_registry(group_series=series, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of lineitem, in three parts, as a stream of three batches into the registry in the shared folder."""
    folder = f"{graph.shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for part in range(3):
        files.filter(F.pmod(F.col("l_orderkey"), F.lit(3)) == part).withColumn("part", F.lit(part)).write.mode("append").partitionBy("part").parquet(f"{folder}/files")
    parts = spark.readStream.schema(files.schema).parquet(f"{folder}/files/part=[0-2]")
    jobs.stream_ingest(parts, f"{folder}/registry", f"{folder}/state").awaitTermination()
    return jobs.registry(spark, f"{folder}/registry")


QUERIES |= {
    "read_headers": _read_headers,
    "decode_slices": lambda s, d: dicom.decode_slices(dicom.slice_files(_table("slices", s, d))).filter("problem IS NULL").selectExpr("path", "rows_", "columns_", "cast(pixels[0] as double) as first_pixel", "aggregate(pixels, 0D, (a, x) -> a + x) as total"),
    "write_catalog": _write_catalog,
    "upsert_series_registry": _upsert_series_registry,
    **{name: _with_new_uids(name) for name in ("remap_uids", "deidentify_tags")},
    "sanitize_upload_paths": lambda s, d: archives.sanitize_upload_paths(archive_members=_table("archive_members", s, d)),
    "stream_ingest": _stream_ingest,
}
ORACLE: dict[str, str] = {n: statement(op, DUCKDB)[0] for n, op in REGISTRY.items() if not op.view}

ORACLE["sanitize_upload_paths"] = f"WITH archive_members AS ({REGISTRY['archive_members'].build(DUCKDB)}), t AS ({REGISTRY['upload_targets'].build(DUCKDB)}) {archives.SANITIZE_ORACLE}"
ORACLE["write_catalog"] = ORACLE["group_series"]
ORACLE["stream_ingest"] = f"SELECT DISTINCT workspace_id, series_key, series_id FROM ({ORACLE['group_series']}) g"
# The fold itself, over each view's list.
ORACLE["latest_event_per_key"] = f"""WITH r AS ({REGISTRY["requests"].build(DUCKDB)}),
fold AS (SELECT view_id, list_reduce(list({{'e': event_id, 'r': render_revision, 'f': is_final}} ORDER BY event_id), lambda a, b: CASE WHEN a.f AND NOT b.f AND NOT coalesce(b.r > a.r, false) THEN a ELSE b END) AS f FROM r GROUP BY view_id),
names AS (SELECT view_id, list(target ORDER BY e, p) AS names FROM (SELECT view_id, target, min(event_id) AS e, min_by(p, event_id * 10 + p) AS p FROM (SELECT view_id, event_id, unnest(targets) AS target, generate_subscripts(targets, 1) AS p FROM r) u GROUP BY view_id, target) g GROUP BY view_id),
whole AS (SELECT view_id, count(*) > count(targets) AS whole FROM r GROUP BY view_id)
SELECT fold.view_id, f.e AS event_id, f.r AS render_revision, f.f AS is_final, CASE WHEN NOT whole THEN names END AS targets FROM fold JOIN whole ON whole.view_id = fold.view_id LEFT JOIN names ON names.view_id = fold.view_id"""
ORACLE["read_headers"] = f"""SELECT path, sop_uid, series_uid, study_uid, modality, series_description, photometric, cast(coalesce(rows_, 0) AS bigint) AS rows_, cast(columns_ AS bigint) AS columns_
FROM ({REGISTRY["headers"].build(DUCKDB)}) h"""
ORACLE["decode_slices"] = f"""SELECT '/data/' || series_id || '/' || i AS path, 8 AS rows_, 8 AS columns_, pixels[1] AS first_pixel, list_sum(pixels) AS total FROM ({REGISTRY["slices"].build(DUCKDB)}) s"""

_RECORD_TAGS = (("00080020", "StudyDate", "Study Date", "DA", "$.\"00080020\".Value[0]"), ("00100010", "PatientName", "Patient Name", "PN", "$.\"00100010\".Value[0].Alphabetic"),
                ("0020000D", "StudyInstanceUID", "Study Instance UID", "UI", "$.\"0020000D\".Value[0]"), ("00201208", "NumberOfStudyRelatedInstances", "Number Of Study Related Instances", "IS", "$.\"00201208\".Value[0]"),
                ("00080030", "StudyTime", "Study Time", "TM", "$.\"00080030\".Value[0]"), ("00201206", "NumberOfStudyRelatedSeries", "Number Of Study Related Series", "IS", "$.\"00201206\".Value[0]"))
_RECORD_ROWS = [f"""SELECT record_no, '{t}' AS tag_path, '{t}' AS tag, '{k}' AS keyword, '{n}' AS name, '{v}' AS vr, json_extract_string(record, '{p}') AS value FROM r""" for t, k, n, v, p in _RECORD_TAGS]
_RECORD_ROWS.append("SELECT record_no, '00091002' AS tag_path, '00091002' AS tag, '' AS keyword, '(0009,1002)' AS name, 'LO' AS vr, 'one, , , two' AS value FROM r")
_RECORD_ROWS.append("""SELECT record_no, '00080061' AS tag_path, '00080061' AS tag, 'ModalitiesInStudy' AS keyword, 'Modalities In Study' AS name, 'CS' AS vr,
  json_extract_string(record, '$."00080061".Value[0]') || ', ' || json_extract_string(record, '$."00080061".Value[1]') AS value FROM r""")
ORACLE["flatten_tags"] = f"""WITH r AS ({REGISTRY["qido_records"].build(DUCKDB)}) SELECT *, 0 AS depth, cast(row_number() OVER (PARTITION BY record_no ORDER BY tag) - 1 AS int) AS ord, cast(NULL AS varchar) AS problem
FROM ({" UNION ALL ".join(_RECORD_ROWS)}) u"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image series with their number of compatibility issues."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    issues = catalog.compatibility_audit(lineitem=lineitem).groupBy("workspace_id", "series_key").count().withColumnRenamed("count", "issues")
    return catalog.series_summary(lineitem=lineitem).join(issues, ["workspace_id", "series_key"], "left").fillna(0, ["issues"])
