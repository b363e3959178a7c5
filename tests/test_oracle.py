"""Headline queries, and those whose SQL is not their own statement or a long chain, against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from voxtab.plans import registry

DIR = "/root/testdata/sf0.001"
NAMES = (
    "series_summary", "compatibility_audit", "phase_items", "region_stats", "rect_roi_stats", "reslice_plane", "fuse_pet_ct", "deidentify_tags", "drop_superseded_events", "screen_archive_members",
    "sanitize_upload_paths", "latest_event_per_key", "flatten_tags", "read_headers", "decode_slices", "stream_ingest", "drawing_metrics", "bed_slabs", "adaptive_layers", "surface_iso_value", "dicom_json_tags", "gsps_references",
    "single_series_phases", "spatial_order", "edit_tag", "attach_presentation_states", "clip_volume", "expire_stale",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    relation = duck.sql(registry.ORACLE[name])
    want = plain(relation.fetchall(), relation.columns)
    assert want and plain([tuple(r) for r in df.collect()], df.columns) == want
