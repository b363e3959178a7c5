"""Archive members, uploads and content: screening, path names, quotas, digests, sidecars and DICOM-JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtab.operators.catalog import DENIED
from voxtab.plans.statement import Dialect, operator, quote, view

MAX_ENTRIES, MAX_RATIO, MAX_BYTES = 20_000, 200, 4 * 2**30
UPLOAD_FILES, UPLOAD_BYTES = 20_000, 2 * 2**30


def candidate(d: Dialect, name: str) -> str:
    """Whether a file's name may be an image's: no hidden or __MACOSX part, no denied suffix."""
    denied = ", ".join(f"'{x}'" for x in DENIED)
    return f"NOT {d.matches(name, '(^|/)[.][^./]')} AND NOT {d.matches(name, '(^|/)__MACOSX(/|$)')} AND lower(regexp_extract({name}, '([.][^./]*)$', 1)) NOT IN ({denied})"


@operator
def screen_archive_members(d: Dialect, max_entries: int = MAX_ENTRIES, max_ratio: int = MAX_RATIO, max_bytes: int = MAX_BYTES) -> str:
    """Status of each member in listing order: the first check that fails, with running entries and bytes; members without sizes are held against the whole archive's ratio."""
    return f"""SELECT archive_id, ord, member_name, CASE WHEN running_entries > {max_entries} THEN 'too-many-entries' WHEN is_encrypted THEN 'encrypted' WHEN is_symlink THEN 'symlink'
    WHEN member_name LIKE '/%' OR {d.matches('member_name', '(^|/)[.][.]?(/|$)')} THEN 'unsafe-path' WHEN skipped THEN 'skipped'
    WHEN uncompressed > 0 AND compressed > 0 AND uncompressed > {max_ratio} * compressed THEN 'ratio' WHEN (coalesce(uncompressed, 0) <= 0 OR coalesce(compressed, 0) <= 0) AND all_bytes > {max_ratio} * archive_size THEN 'ratio'
    WHEN running_bytes > {max_bytes} THEN 'too-large' ELSE 'ok' END AS status, running_entries, running_bytes
FROM (SELECT *, cast(count(*) OVER w AS bigint) AS running_entries, cast(sum(CASE WHEN skipped THEN 0 ELSE coalesce(uncompressed, 0) END) OVER w AS bigint) AS running_bytes, sum(coalesce(uncompressed, 0)) OVER (PARTITION BY archive_id) AS all_bytes
  FROM (SELECT *, NOT ({candidate(d, 'member_name')}) AS skipped FROM archive_members) p WINDOW w AS (PARTITION BY archive_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) q"""


@view
def upload_targets(d: Dialect) -> str:
    """Safe relative path of each member before repeats are told apart (an empty one gets a running name), with its family: the folder and name without numbers at its end, and the suffix."""
    parts = d.keep(d.cut("replace(member_name, chr(92), '/')", "/"), "x", "x NOT IN ('', '.', '..') AND right(x, 1) <> ':'")
    joined = f"array_join({parts}, '/')" if d.spark else f"array_to_string({parts}, '/')"
    return f"""SELECT archive_id, ord, target, regexp_replace(stem, '(-[0-9]+)+$', '') AS family, stem, suffix FROM (
  SELECT archive_id, ord, target, regexp_extract(target, '([^/])([.][^./]*)$', 2) AS suffix, substring(target, 1, length(target) - length(regexp_extract(target, '([^/])([.][^./]*)$', 2))) AS stem FROM (
    SELECT archive_id, ord, coalesce(nullif({joined}, ''), 'dicom-' || cast(ord AS {d.text}) || '.dcm') AS target FROM archive_members) p) q"""


def free_names(rows: list[tuple[str, str]]) -> list[str]:
    """Paths of (stem, suffix) rows one after the other; a path that is taken gets the first free of -2, -3, ... before its suffix."""
    taken: set[str] = set()
    following: dict[str, int] = {}
    out = []
    for stem, suffix in rows:
        path = stem + suffix
        if path in taken:
            n = following.get(path, 2)
            while f"{stem}-{n}{suffix}" in taken:
                n += 1
            following[path], path = n + 1, f"{stem}-{n}{suffix}"
        taken.add(path)
        out.append(path)
    return out


def sanitize_upload_paths(**given: DataFrame) -> DataFrame:
    """archive_id, ord, target_path: safe relative paths of members in their order, none given twice.

    Only paths of a family can meet, so a family is a group (an archive has a bounded number of entries).
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        return frame[["archive_id", "ord"]].assign(target_path=free_names(list(zip(frame["stem"], frame["suffix"], strict=True))))

    rows = upload_targets(**given)
    schema = f"archive_id {rows.schema['archive_id'].dataType.simpleString()}, ord bigint, target_path string"
    alone = F.count("*").over(Window.partitionBy("archive_id", "family", "suffix")) == 1
    rows = rows.withColumn("alone", alone)
    several = rows.filter("NOT alone").groupBy("archive_id", "family", "suffix").applyInPandas(run, schema)
    return rows.filter("alone").select("archive_id", F.col("ord").cast("bigint").alias("ord"), F.col("target").alias("target_path")).union(several)


#: The same in DuckDB's SQL: a fold over each family's list.
SANITIZE_ORACLE = """SELECT archive_id, unnest(ords) AS ord, unnest(taken) AS target_path FROM (
  SELECT archive_id, list(ord ORDER BY ord) AS ords, list_reduce(list({'taken': cast([] AS varchar[]), 'stem': stem, 'suffix': suffix} ORDER BY ord),
    lambda a, x: {'taken': list_append(a.taken, CASE WHEN NOT list_contains(a.taken, x.stem || x.suffix) THEN x.stem || x.suffix
      ELSE list_filter(list_transform(range(2, len(a.taken) + 3), lambda n: x.stem || '-' || cast(n AS varchar) || x.suffix), lambda p: NOT list_contains(a.taken, p))[1] END), 'stem': x.stem, 'suffix': x.suffix},
    {'taken': cast([] AS varchar[]), 'stem': '', 'suffix': ''}).taken AS taken FROM t GROUP BY archive_id, family, suffix) q"""


@operator
def upload_quota(d: Dialect, max_files: int = UPLOAD_FILES, max_bytes: int = UPLOAD_BYTES) -> str:
    """Files of a session until it has more than ``max_files`` or ``max_bytes``; empty files go, others that cannot be images are skipped and not counted."""
    return f"""SELECT archive_id, ord, CASE WHEN skipped THEN 'skipped' WHEN files > {max_files} OR running > {max_bytes} THEN 'rejected' ELSE 'accepted' END AS status FROM (
  SELECT archive_id, ord, skipped, sum(CASE WHEN skipped THEN 0 ELSE 1 END) OVER w AS files, sum(CASE WHEN skipped THEN 0 ELSE uncompressed END) OVER w AS running
  FROM (SELECT *, NOT ({candidate(d, 'member_name')}) AS skipped FROM archive_members WHERE uncompressed > 0) p WINDOW w AS (PARTITION BY archive_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) q"""


@operator
def content_fingerprint(d: Dialect) -> str:
    """Digest of each series over the lines ``uid::size:sha256`` of its instances in order; instances without a uid are skipped."""
    own = f"cast(content_size AS {d.text}) || ':' || content_sha256"
    return f"""SELECT workspace_id, series_key, {d.sha256(d.joined('line', chr(10), 'slice_index'))} AS series_digest, count(*) AS files FROM (
  SELECT workspace_id, series_key, slice_index, sop_uid || '::' || {own} AS line FROM instance_numbers i JOIN file_contents c ON c.file_path = i.path WHERE coalesce(sop_uid, '') <> '') q GROUP BY workspace_id, series_key"""


@operator
def registration_sidecar(d: Dialect) -> str:
    """One JSON document for each CT and PET pair: ids, unit, factor, window and registration, numbers with six places."""
    text = lambda c: f"'\"{c}\":\"' || {c} || '\"'"
    number = lambda name, c: f"'\"{name}\":' || {d.format('%.6f', f'cast({c} AS double)')}"
    parts = [text("ct_id"), text("pet_id"), text("unit"), number("low", "low"), number("high", "high"), number("rotation", "rotation"), number("shift_u", "shift_u"), number("shift_v", "shift_v"), number("scale", "coalesce(factor, 1)")]
    return f"SELECT ct_id, pet_id, chr(123) || {(' || chr(44) || ').join(parts)} || chr(125) AS document FROM (SELECT r.*, f.factor FROM registrations r LEFT JOIN pet_scale f ON f.series_id = r.pet_id AND f.unit = r.unit) q"


@operator
def dicom_json_tags(d: Dialect) -> str:
    """Every element of archive answers, of any tag: VR and values as texts. Records that are no objects are left out, elements that are none have no VR and no values."""
    if d.spark:
        return f"""SELECT record_no, e.key AS tag, {d.branch('e.value', 'vr')} AS vr, {d.texts('e.value', 'Value')} AS values_ FROM (SELECT record_no, {d.tree('record')} AS tree FROM qido_records) r, LATERAL variant_explode(CASE WHEN {d.is_object('tree')} THEN tree END) AS e"""
    return f"""SELECT record_no, tag, CASE WHEN {d.is_object('value')} THEN {d.branch('value', 'vr')} END AS vr, {d.texts('value', 'Value')} AS values_ FROM (
  SELECT record_no, tag, json_extract(tree, '$."' || tag || '"') AS value FROM (SELECT record_no, tree, unnest(json_keys(tree)) AS tag FROM (SELECT record_no, {d.tree('record')} AS tree FROM qido_records) r WHERE {d.is_object('tree')}) k) v"""


#: Fields of study answers by tag; fixed values.
STUDY_TAGS = {"study_uid": "0020000D", "patient_name": "00100010", "patient_id": "00100020", "study_date": "00080020", "study_time": "00080030", "accession_number": "00080050", "study_description": "00081030"}
STUDY_COUNTS = {"series_count": "00201206", "instance_count": "00201208"}


@operator
def read_dicom_json(d: Dialect) -> str:
    """Fields of study answers: first values as text, modalities joined, counts as numbers where they are whole; records that are no objects are left out."""
    first = lambda tag: d.at(d.texts("tree", tag, "Value"), 0)
    fields = [f"{f'coalesce({first(t)}, {quote(str())})' if c == 'study_uid' else first(t)} AS {c}" for c, t in STUDY_TAGS.items()]
    counts = [f"CASE WHEN {d.matches(f'trim({first(t)})', '^[-+]?[0-9]+$')} THEN try_cast(trim({first(t)}) AS bigint) END AS {c}" for c, t in STUDY_COUNTS.items()]
    joined = f"array_join({d.texts('tree', '00080061', 'Value')}, ',')" if d.spark else f"array_to_string({d.texts('tree', '00080061', 'Value')}, ',')"
    return f"SELECT record_no, {', '.join(fields)}, {joined} AS modalities, {', '.join(counts)} FROM (SELECT record_no, {d.tree('record')} AS tree FROM qido_records) r WHERE {d.is_object('tree')}"


@operator
def normalize_dicom_date_range(d: Dialect) -> str:
    """Date bounds as archive query text; anything but eight digits is no bound, none of both gives null."""
    bare = lambda x: f"replace(trim({x}), '-', '')"
    clean = lambda x: f"CASE WHEN {d.matches(bare(x), '^[0-9]+$')} AND length({bare(x)}) = 8 THEN {bare(x)} END"
    return f"""SELECT query_no, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a || '-' || b WHEN a IS NOT NULL THEN a || '-' WHEN b IS NOT NULL THEN '-' || b END AS date_range FROM (
  SELECT query_no, {clean('date_from')} AS a, {clean('date_to')} AS b FROM date_queries) q"""


def wildcard(d: Dialect, column: str, pattern: str) -> str:
    """Archive matching: ``*`` for any text, ``?`` for one character, all else as it is; an empty pattern matches everything."""
    if not pattern or set(pattern) == {"*"}:
        return "true"
    if not set(pattern) & set("*?"):
        return f"{column} = {quote(pattern)}"
    sign = {"*": "%", "?": "_"} | {c: f"!{c}" for c in "!%_"}
    return f"{column} LIKE {quote(''.join(sign.get(c, c) for c in pattern))} ESCAPE '!'"


def between(column: str, span: str) -> str:
    """An inclusive date range ``a-b``, ``a-``, ``-b`` or one day; empty for any."""
    low, dash, high = span.partition("-")
    return " AND ".join([f"{column} >= {quote(low)}"] * bool(low) + [f"{column} <= {quote(high if dash else low)}"] * bool(high or (low and not dash))) or "true"


@operator
def query_studies(d: Dialect, study_uid: str = "", patient_id: str = "", patient_name: str = "Customer#*1", accession_number: str = "", study_description: str = "", modality: str = "O", study_date: str = "19930101-19971231", limit: int = 50, offset: int = 0) -> str:
    """Studies that match all filters (empty ones match everything); a page of 1 to 200 in order of their uid."""
    filters = [wildcard(d, c, v) for c, v in (("study_uid", study_uid), ("patient_id", patient_id), ("patient_name", patient_name), ("accession_number", accession_number), ("study_description", study_description))]
    filters += [f"',' || modalities || ',' LIKE '%,' || {quote(modality)} || ',%'" if modality else "true", between("study_date", study_date)]
    return f"""SELECT study_uid, patient_name, patient_id, study_date, study_time, accession_number, study_description, modalities, series_count, instance_count FROM read_dicom_json
WHERE {' AND '.join(filters)} ORDER BY study_uid LIMIT {min(max(limit, 1), 200)} OFFSET {max(offset, 0)}"""


@operator
def query_series(d: Dialect, study_uid: str = "", series_uid: str = "", modality: str = "CT", series_description: str = "S*", limit: int = 100, offset: int = 0) -> str:
    """Series that match all filters (empty ones match everything); a page of 1 to 500 in order of their uid."""
    filters = [wildcard(d, c, v) for c, v in (("study_uid", study_uid), ("series_uid", series_uid), ("modality", modality), ("series_description", series_description))]
    return f"""SELECT series_uid, study_uid, modality, series_description, count(*) AS instance_count FROM dedupe_instances WHERE {' AND '.join(filters)}
GROUP BY series_uid, study_uid, modality, series_description ORDER BY series_uid, study_uid, modality, series_description LIMIT {min(max(limit, 1), 500)} OFFSET {max(offset, 0)}"""


@operator
def job_progress(d: Dialect) -> str:
    """Counts and percentage of background jobs: processed ones between 0 and the total (of any number where that is not known); a job that has succeeded has 100 percent, one without a total none; half-even."""
    return f"""SELECT job_id, status, total, greatest(least(processed, CASE WHEN total > 0 THEN total ELSE processed END), 0) AS processed,
  cast(CASE WHEN status = 'succeeded' THEN 100 WHEN total <= 0 THEN 0 ELSE least(greatest({d.even('100.0 * processed / total')}, 0), 100) END AS bigint) AS percent FROM (SELECT job_id, status, greatest(total, 0) AS total, processed FROM background_jobs) j"""


def write_catalog(df: DataFrame, path: str) -> DataFrame:
    """Keep a catalogue table by workspace and modality in a new folder, and read it back; a folder that exists is an error."""
    df.write.mode("errorifexists").partitionBy("workspace_id", "modality").parquet(path)
    return df.sparkSession.read.parquet(path)
