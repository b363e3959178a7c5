"""Truths on hand-made rows, in the style of analytic phantoms."""

import math

import numpy as np
import pytest

from voxtab.helpers import grids
from voxtab.helpers.images import detect_phantom, find_phantom, largest_components, mtf_curve
from voxtab.operators import catalog, pet, pixels, roi, tag_edits, volumes
from voxtab.sources import archives
from voxtab.sources.dicom import header
from voxtab.streaming import log


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


AXES = [a + c for a in ("o", "i", "j", "k", "di", "dj", "dk") for c in "xyz"]
GEOMETRY = "series_id string, depth int, nj int, nk int, " + ", ".join(f"{a} double" for a in AXES) + ", voxel_mm3 double"


def cube(spark):
    """arange(27) as a 3 x 3 x 3 volume with unit spacing: slices and geometry."""
    s = spark.createDataFrame([("S", i, 3, 3, [float(9 * i + n) for n in range(9)], 0) for i in range(3)], "series_id string, i int, rows_ int, columns_ int, pixels array<double>, label int")
    unit = [0, 0, 1, 0, 1, 0, 1, 0, 0]
    g = spark.createDataFrame([("S", 3, 3, 3, *map(float, [0, 0, 0, *unit, *unit]), 1.0)], GEOMETRY)
    return s, g


REGION = "series_id string, region_id int, enabled boolean, mode string, threshold double, cx double, cy double, cz double, " + ", ".join(f"{a}{c} double" for a in "uvw" for c in "xyz") + ", hx double, hy double, hz double"
TURNED = [0.6, 0.8, 0.0, -0.8, 0.6, 0.0, 0.0, 0.0, 1.0]


@pytest.mark.parametrize(("mode", "threshold", "count", "effective"), [("hu", 23.0, 3, 23.0), ("percentile", 80.0, 6, 20.8)])
def test_region_stats(spark, mode, threshold, count, effective):
    s, g = cube(spark)
    axes = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    r = spark.createDataFrame([("S", 0, True, mode, threshold, 1.0, 1.0, 1.0, *axes, 1.5, 1.5, 1.5), ("S", 1, False, mode, 0.0, 1.0, 1.0, 1.0, *axes, 1.5, 1.5, 1.5)], REGION)
    (got,) = volumes.region_stats(slices=s, geometry=g, regions=r).collect()
    assert (got["sample_count"], got["effective_threshold_hu"], got["volume_cm3"]) == (count, effective, count / 1000)
    if mode == "hu":
        assert got["hu_mean"] == 25 and abs(got["hu_std_dev"] - math.sqrt(2 / 3)) < 1e-6
    else:
        assert got["hu_min"] == 21


def test_oriented_region(spark):
    s, g = cube(spark)
    r = spark.createDataFrame([("S", 0, True, "hu", -1.0, 1.0, 1.0, 1.0, *TURNED, 0.9, 1.1, 0.4)], REGION)
    got = rows(volumes.region_box_values(slices=s, geometry=g, regions=r), "value")
    want = []
    for i, j, k in np.ndindex(3, 3, 3):
        p = np.array([k - 1, j - 1, i - 1])
        if all(abs(p @ TURNED[3 * a : 3 * a + 3]) <= h + 1e-6 for a, h in enumerate((0.9, 1.1, 0.4))):
            want.append((float(9 * i + 3 * j + k),))
    assert got == sorted(want) and 0 < len(want) < 9


def test_sphere_stats(spark):
    s, g = cube(spark)
    p = spark.createDataFrame([("S", 0, 1.01, 1.0, 1.0, 1.0)], "series_id string, sphere_id int, radius double, cx double, cy double, cz double")
    (got,) = volumes.sphere_stats(slices=s, geometry=g, spheres=p).collect()
    assert (got["sample_count"], got["hu_mean"], got["volume_cm3"]) == (7, 13, 0.007) and abs(got["hu_std_dev"] - math.sqrt(26)) < 1e-6


def test_slabs(spark):
    s, g = cube(spark)
    plane = spark.createDataFrame([("S", "axial", 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 3, 3)], "series_id string, kind string, cx double, cy double, cz double, ux double, uy double, uz double, vx double, vy double, vz double, step double, width int, height int")
    assert rows(volumes.mip_slab(slices=s, geometry=g, planes=plane, thickness=3.0), "r", "c", "maximum", "minimum", "average")[0] == (0, 0, 18.0, 0.0, 9.0)
    assert rows(volumes.mip_slab(slices=s, geometry=g, planes=plane, thickness=2.0), "maximum", "minimum")[0] == (13.5, 4.5), "half steps around the plane"
    assert rows(volumes.mip_slab(slices=s, geometry=g, planes=plane, thickness=3.0, max_samples=1), "maximum")[0] == (9.0,)


FACING = "series_id string, depth int, nj int, nk int, rx double, ry double, rz double, cx double, cy double, cz double, slice_step double, row_step double, column_step double, px double, py double, pz double"


def test_axes_and_standard_volumes(spark):
    """Directions as in numpy: transpose to z, y, x and flip the negative ones."""
    faces = {"axial": [1, 0, 0, 0, 1, 0], "flipped": [-1, 0, 0, 0, 1, 0], "coronal": [1, 0, 0, 0, 0, -1], "sagittal": [0, 1, 0, 0, 0, -1], "none": [None] * 6, "skew": [1, 0.1, 0, 0.9, 0.2, 0]}
    o = spark.createDataFrame([(n, 2, 3, 4, *(None if x is None else float(x) for x in f), 5.0, 2.0, 1.0, 10.0, 20.0, 30.0) for n, f in faces.items()], FACING)
    mapped = {r["series_id"]: r for r in volumes.axis_mapping(orientations=o).collect()}
    assert not mapped["none"]["valid"] and not mapped["skew"]["valid"] and mapped["axial"]["valid"]
    a = np.arange(24.0).reshape(2, 3, 4)
    s = spark.createDataFrame([(n, i, 3, 4, a[i].ravel().tolist(), 0) for n in faces for i in range(2)], "series_id string, i int, rows_ int, columns_ int, pixels array<double>, label int")
    out = volumes.standardize_volume(slices=s, orientations=o).collect()
    for n, f in faces.items():
        want = a
        if mapped[n]["valid"]:
            vectors = [np.cross(f[:3], f[3:]), np.array(f[3:]), np.array(f[:3])]
            axes = [int(np.argmax(np.abs(v))) for v in vectors]
            want = np.transpose(a, [axes.index(c) for c in (2, 1, 0)])
            for at, c in enumerate((2, 1, 0)):
                if vectors[axes.index(c)][c] < 0:
                    want = np.flip(want, at)
        assert {(r["i"], r["j"], r["k"]): r["value"] for r in out if r["series_id"] == n} == {k: float(v) for k, v in np.ndenumerate(want)}, n
    world = {r["series_id"]: r for r in volumes.series_geometry(orientations=o).collect()}
    assert [world["flipped"][c] for c in ("ox", "oy", "oz", "kx")] == [7.0, 20.0, 25.0, 1.0] and [world["none"][c] for c in ("ox", "iz", "jy", "kx")] == [0, 1, 1, 1]


@pytest.mark.parametrize("order", [0, 1])
def test_reslice_matches_numpy(spark, order):
    s, g = cube(spark)
    at = [(0.0, 0.0, 0.0), (0.5, 1.25, 1.75), (2.5, -1.0, 1.0), (1.2, 0.8, 1.6)]
    p = spark.createDataFrame([("S", "p", 0, n, *xyz) for n, xyz in enumerate(at)], "series_id string, kind string, r int, c int, x double, y double, z double")
    got = [r[1] for r in rows(volumes.reslice_plane(slices=s, geometry=g, plane_to_world=p, order=order), "c", "value")]
    a = np.arange(27.0).reshape(3, 3, 3)
    places = np.clip([[z, y, x] for x, y, z in at], 0, 2)
    want = grids.sample_linear(a, places) if order else [a[tuple(np.rint(q).astype(int))] for q in places]
    assert np.allclose(got, want)
    outside = rows(volumes.reslice_plane(slices=s, geometry=g, plane_to_world=p, order=order, boundary="constant", cval=-5.0), "c", "value")
    assert outside[2] == (2, -5.0) and outside[0][1] == 0


MEASURE = "measurement_id string, series_id string, slice_index int, tool_type string, points array<struct<x:double,y:double>>, scope string, sx double, sy double, image_width int, image_height int, kind string"


def measured(spark, *items):
    return spark.createDataFrame([(n, "S", 0, tool, points, "image", *(spacing or (None, None)), 8, 8, "stack") for n, tool, points, spacing in items], MEASURE)


def test_lines_and_angles(spark):
    df = measured(
        spark, ("l", "line", [(2.0, 3.0), (10.0, 7.0)], (0.5, 2.0)), ("p", "line", [(0.0, 0.0), (3.0, 4.0)], None), ("a", "angle", [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)], (0.5, 2.0)),
        ("c", "curve", [(0.0, 0.0), (6.0, 0.0), (6.0, 4.0), (6.0, 5.0)], (0.5, 2.0)), ("x", "line", [(1.0, 1.0)], (0.5, 2.0)),
        ("h", "alignment-horizontal", [(0.0, 0.0), (-40.0, 10.0)], (0.5, 2.0)), ("v", "alignment-vertical", [(0.0, 0.0), (0.0, 30.0)], (0.5, 2.0)), ("s", "alignment-vertical", [(0.0, 0.0), (0.0, 9.0)], (0.5, 2.0)),
    )
    assert [(i, u, round(x, 1)) for i, u, x in rows(roi.line_length(measurements=df), "measurement_id", "unit", "length")] == [("l", "mm", 8.9), ("p", "px", 5.0)]
    assert rows(roi.angle_degrees(measurements=df), "angle_degrees") == [(90.0,)]
    assert rows(roi.curve_length(measurements=df), "length") == [(13.0,)]
    assert rows(roi.alignment_angle(measurements=df), "measurement_id", "angle_degrees") == [("h", -45.0), ("s", None), ("v", 0.0)]
    assert {r["measurement_id"] for r in roi.valid_measurement_points(measurements=df).collect() if not r["valid"]} == {"x"}


def test_polygon_of_many_points(spark):
    ring = [(0.5, 0.5), (6.5, 0.5), (6.5, 6.5), (3.5, 3.5), (0.5, 6.5)]
    df = measured(spark, ("f", "freeform", ring, (0.5, 2.0)), ("r", "rect", [(1.0, 1.0), (3.0, 2.0)], None))
    s = spark.createDataFrame([("S", 0, 8, 8, [float(n) for n in range(64)], 0)], "series_id string, i int, rows_ int, columns_ int, pixels array<double>, label int")
    inside = [8 * j + k for j in range(8) for k in range(8) if sum(((ya > j) != (yb > j)) and k < (xb - xa) * (j - ya) / (yb - ya) + xa for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True) if ya != yb) % 2]
    (got,) = roi.freeform_roi_stats(measurements=df, slices=s).collect()
    assert (got["area"], got["mean"]) == (len(inside), pytest.approx(np.mean(inside)))
    (box,) = roi.rect_roi_stats(measurements=df, slices=s).collect()
    assert (box["area_unit"], box["area"], box["mean"]) == ("px2", 2, np.mean([9, 10, 11, 17, 18, 19]))


def test_smooth_paths(spark):
    df = measured(spark, ("c", "curve", [(0.0, 0.0), (3.0, 3.0), (6.0, 0.0)], None))
    path = rows(roi.smooth_path(measurements=df, samples=4), "n", "x", "y")
    assert len(path) == 9 and path[0][1:] == (0, 0) and path[4][1:] == (3, 3) and path[8][1:] == (6, 0) and path[2][2] == pytest.approx(1.6875)
    assert len(roi.smooth_path(measurements=df, samples=4, closed=True).collect()) == 13


HEADER = "path string, workspace_id string, sop_uid string, series_uid string, study_uid string, modality string, series_description string, instance_number_text string, rows_ int, columns_ int, transfer_syntax_uid string, photometric string, pixel_spacing double, has_position boolean, has_rescale_slope boolean, number_of_frames int, position_z double, sop_class_uid string, file_no bigint, file_part int, patient_id string, position_x double, position_y double, " + ", ".join(f"{a}{c} double" for a in "rc" for c in "xyz") + ", slice_thickness string, " + ", ".join(f"{c} string" for c, *_ in catalog.PHASE_TAGS)


def head(path, sop="1", description="", number="1", **over):
    row = {"path": path, "workspace_id": "w", "sop_uid": sop, "series_uid": "9", "study_uid": "8", "modality": "CT", "series_description": description, "instance_number_text": number, "rows_": 6, "columns_": 6,
           "transfer_syntax_uid": "1.2.840.10008.1.2.1", "photometric": "MONOCHROME2", "pixel_spacing": 1.0, "has_position": True, "has_rescale_slope": True, "number_of_frames": 1, "position_z": 0.0, "sop_class_uid": None, "file_no": 1, "file_part": 1, "patient_id": "p", "position_x": 0.0, "position_y": 0.0} | over
    return tuple(row.get(c.split()[0]) for c in HEADER.split(", "))


def test_phases_become_series(spark):
    df = spark.createDataFrame([head("/data/a/1.dcm", "1", "4D Lung 0%"), head("/data/a/2.dcm", "2", "4D Lung 50％"), head("/data/b/x_ph2.dcm", "3", "MP1")], HEADER)
    assert {r["series_key"] for r in catalog.group_series(headers=df).collect()} == {"uid=9::dir=a::phase=0%", "uid=9::dir=a::phase=50%", "uid=9::dir=b::phase=2"}
    assert {r["label"] for r in catalog.phase_label(headers=df).collect()} == {"Phase 0%", "Phase 50%", "Phase 02"}


def test_numbers_duplicates_and_order(spark):
    df = spark.createDataFrame([head("/data/b.dcm", "1", number="2.0"), head("/data/c.dcm", "1"), head("/data/a.dcm", "2", number="None"), head("/data/d.dcm", "3", number="-1.5")], HEADER)
    got = rows(catalog.slice_index(headers=df), "path", "instance_number", "slice_index")
    assert got == [("/data/a.dcm", 1, 1), ("/data/b.dcm", 2, 2), ("/data/d.dcm", -1, 0)]


def test_audit_counts(spark):
    clean = [head("/data/1.dcm", "1"), head("/data/2.dcm", "2")]
    assert catalog.compatibility_audit(headers=spark.createDataFrame(clean, HEADER)).count() == 0
    flawed = [head("/data/3.dcm", "3", transfer_syntax_uid="1.2.840.10008.1.2.4.50", photometric="RGB", number_of_frames=3, has_position=False, has_rescale_slope=False, pixel_spacing=None), head("/data/4.dcm", "4", pixel_spacing=None, has_position=False)]
    got = dict(rows(catalog.compatibility_audit(headers=spark.createDataFrame(flawed, HEADER)), "code", "affected_instances"))
    detail = dict(rows(catalog.compatibility_audit(headers=spark.createDataFrame(flawed, HEADER)), "code", "detail"))
    assert detail["compressed-transfer-syntax"] == "JPEG Baseline (Process 1)" and detail["unsupported-photometric"] == "RGB"
    assert got == {"compressed-transfer-syntax": 1, "unsupported-photometric": 1, "multiframe-first-frame": 1, "missing-pixel-spacing": 2, "missing-spatial-geometry": 2, "missing-rescale": 1}


def test_empty_headers(spark):
    df = spark.createDataFrame([], HEADER)
    assert catalog.group_series(headers=df).count() == 0 and catalog.compatibility_audit(headers=df).count() == 0


def test_archive_members(spark):
    m = "archive_id int, ord bigint, member_name string, uncompressed bigint, compressed bigint, is_encrypted boolean, is_symlink boolean, archive_size bigint"
    df = spark.createDataFrame([(1, 1, "../x", 1, 1, False, False, 10), (1, 2, "a/ok", 1, 1, False, False, 10), (1, 3, "b", 1000, 1, False, False, 10), (1, 4, "n.txt", 1, 1, False, False, 10), (1, 5, "c", 1, 1, True, False, 10), (1, 6, "l", 1, 1, False, True, 10)], m)
    assert [r[1] for r in rows(archives.screen_archive_members(archive_members=df), "ord", "status")] == ["unsafe-path", "ok", "ratio", "skipped", "encrypted", "symlink"]
    same = spark.createDataFrame([(1, 1, "a\\b.dcm", 1, 1, False, False, 10), (1, 2, "./a/b.dcm", 1, 1, False, False, 10), (1, 3, "..", 1, 1, False, False, 10)], m)
    assert [r[1] for r in rows(archives.sanitize_upload_paths(archive_members=same), "ord", "target_path")] == ["a/b.dcm", "a/b-2.dcm", "dicom-3.dcm"]


def test_quota_counts_what_is_there(spark):
    m = "archive_id int, ord bigint, member_name string, uncompressed bigint"
    df = spark.createDataFrame([(1, 1, "a", 60), (1, 2, "b.txt", 500), (1, 3, "c", 0), (1, 4, "d", 40), (1, 5, "e", 1)], m)
    assert rows(archives.upload_quota(archive_members=df, max_bytes=100), "ord", "status") == [(1, "accepted"), (2, "skipped"), (4, "accepted"), (5, "rejected")]
    assert rows(archives.upload_quota(archive_members=df, max_files=1), "ord", "status")[2:] == [(4, "rejected"), (5, "rejected")]
    assert {r["status"] for r in archives.upload_quota(archive_members=df).collect()} == {"accepted", "skipped"}


def test_study_queries(spark):
    df = spark.createDataFrame([("1.2", "Doe^Jane", "p1", "20240105", "a1", "Chest CT", "CT,SR", 3), ("1.3", "Doe^Jim", "p2", "20240301", "", "Head", "MR", 1)], "study_uid string, patient_name string, patient_id string, study_date string, accession_number string, study_description string, modalities string, instance_count bigint").selectExpr("*", "'10' AS study_time", "1L AS series_count")
    find = lambda **f: [r["study_uid"] for r in archives.query_studies(read_dicom_json=df, **({"patient_name": "", "modality": "", "study_date": ""} | f)).collect()]
    assert find() == ["1.2", "1.3"] and find(patient_name="Doe^J?m") == ["1.3"] and find(patient_name="Doe*") == ["1.2", "1.3"] and find(modality="SR") == ["1.2"]
    assert find(study_date="20240201-") == ["1.3"] and find(study_date="-20240105") == ["1.2"] and find(study_date="20240105") == ["1.2"] and find(study_description="*st CT") == ["1.2"]
    assert find(patient_id="p2", study_uid="1.3") == ["1.3"] and find(offset=1) == ["1.3"] and find(limit=1) == ["1.2"] and find(patient_name="Doe.*") == []


def test_edited_values(spark):
    values = [("IS", "12"), ("IS", "1.5"), ("DS", "1e5"), ("DS", "1e400"), ("DA", "20240230"), ("DA", "20240229"), ("TM", "101530.25"), ("TM", "2561"), ("AS", "045Y"), ("CS", " abc "), ("CS", "a-b"), ("UI", "1.2\\1..3"), ("UI", "1.2\\1.3"), ("LO", ""), ("SH", "x" * 17)]
    df = spark.createDataFrame([("1", "f", n, vr, v) for n, (vr, v) in enumerate(values)], "sop_uid string, file string, ord bigint, vr string, value string")
    bad = {r["ord"] for r in tag_edits.validate_tag_values(edits=df).collect() if r["error"]}
    assert bad == {1, 3, 4, 7, 10, 11, 14}


def test_deidentified_tags(spark):
    t = "sop_uid string, file string, series_uid string, study_uid string, ord bigint, tag_path string, tag string, keyword string, vr string, value string, depth int"
    df = spark.createDataFrame([("1", "f", "2", "3", 1, "00080018", "00080018", "SOPInstanceUID", "UI", "1", 0), ("1", "f", "2", "3", 5, "00081140/0/00081155", "00081155", "", "UI", "1", 2),
                                ("1", "f", "2", "3", 6, "00100010", "00100010", "", "PN", "Doe", 0), ("1", "f", "2", "3", 7, "00110010", "00110010", "", "LO", "x", 0)], t)
    got = dict(rows(tag_edits.deidentify_tags(tags=df, headers=spark.createDataFrame([head("/f", "1")], HEADER)), "tag_path", "value"))
    assert got["00100010"] == "ANONYMIZED" and "00110010" not in got and got["00080018"].startswith("2.25.") and got["00080018"] == got["00081140/0/00081155"]


def test_suv_factor(spark):
    h = "series_id string, label int, units string, weight_kg double, size_m double, sex string, dose double, half_life double, scan_date string, scan_time string, injection_time string, corrected_image string, decay_correction string"
    df = spark.createDataFrame([("P", 1, "BQML", 70.0, 1.7, "M", 350e6, 6586.2, "20240101", "101500", "101500", "ATTN DECY", "START"), ("Q", 1, "BQML", 70.0, 1.7, "M", None, 6586.2, "20240101", "101500", "101500", "ATTN DECY", "START")], h)
    got = {(r["series_id"], r["unit"]): r["factor"] for r in pet.pet_scale(pet_headers=df).collect()}
    assert got["P", "SUVbw"] == pytest.approx(0.0002) and got["Q", "SUVbw"] == 1 and got["P", "kBq/ml"] == 0.001


def test_decayed_dose(spark):
    h = "series_id string, dose double, half_life double, scan_date string, scan_time string, injection_time string, corrected_image string, decay_correction string"
    decay = 100 * math.exp(-math.log(2) * 3600 / 6586.2)
    cases = {"a": ("10:15:00", "091500.0", "ATTN DECY", "START", decay), "b": ("1015", "0915", "DECY", "NONE", decay), "c": ("1015", "0915", "ATTN", "START", 100), "d": ("1015", "0915", "DECY", "ADMIN", 100), "e": ("1015", "soon", "DECY", "START", 100)}
    df = spark.createDataFrame([(n, 100.0, 6586.2, "2024-01-01", *c[:4]) for n, c in cases.items()], h)
    assert {r["series_id"]: r["dose"] for r in pet.pet_decay_dose(pet_headers=df).collect()} == {n: pytest.approx(c[4], abs=0.01) for n, c in cases.items()}


def test_preset_names():
    names = pet.preset_aliases()
    assert [names[x] for x in ("bone-plus-plate", "boneplusplate", "spine", "lung-2", "x-ray", "mra", "cbct-bone-2", "cbct-bone2", "renal-stomach")] == ["bonePlusPlate", "bonePlusPlate", "lumbar", "lung2", "xray", "mrAngio", "cbctBone2", "cbctBone2", "renalsStomach"]


def test_superseded_previews(spark):
    r = "event_id bigint, view_id string, is_final boolean, render_revision bigint, interaction_no bigint"
    df = spark.createDataFrame([(1, "v", False, 1, 0), (2, "v", True, 3, 0), (3, "v", False, 2, 0), (4, "v", False, 4, 0)], r)
    assert [x[0] for x in rows(log.drop_superseded_events(requests=df), "event_id")] == [1, 2, 4]


def test_intensity_stats_read_every_voxel(spark):
    at = spark.range(2_000_002)
    voxels = at.selectExpr("'a' AS series_id", "cast(id div 64 AS int) AS i", "cast(id div 8 % 8 AS int) AS j", "cast(id % 8 AS int) AS k", "CASE WHEN id = 7 THEN 5000.0D WHEN id % 2 = 1 THEN 400.0D ELSE 0.0D END AS value")
    series = spark.createDataFrame([("a", "CT")], "series_id string, modality string")
    (r,) = pixels.intensity_stats(voxels=voxels, image_series=series).collect()
    assert (r["lo"], r["hi"], r["dense_foreground_fraction"]) == (0, 5000, 0.5)


def test_pseudocolour_ends(spark):
    table = {(r["preset"], r["gray"]): (r["r"], r["g"], r["b"]) for r in pixels.colour_table(slices=spark.createDataFrame([], "series_id string")).collect()}
    assert table["hotiron", 0] == (0, 0, 0) and table["hotiron", 255] == (255, 242, 191) and len(table) == 2048


def test_water_disc(spark):
    """The larger of the objects over and under the threshold counts, so a disc that fills over half of the image."""
    y, x = np.indices((64, 64))
    image = np.where((y - 32) ** 2 + (x - 31) ** 2 <= 28**2, 7.0, -1000.0)
    found = detect_phantom(spark.createDataFrame([("S", 0, image.ravel().tolist())], "series_id string, i int, pixels array<double>"))
    (got,) = found.collect()
    assert (got["cx"], got["cy"], got["radius"]) == pytest.approx((31, 32, 0.92 * 28), abs=0.1)
    assert {r["roi_id"]: r["r"] for r in roi.phantom_rois(phantoms=found).collect()}["center"] == 6
    assert find_phantom(np.zeros((9, 9))) is None and find_phantom(np.full((9, 9), np.nan)) is None
    assert find_phantom(-image) == pytest.approx((31, 32, 0.92 * 28), abs=0.1)
    small = np.where((y - 32) ** 2 + (x - 31) ** 2 <= 5**2, 7.0, -1000.0)  # what is around fills over 90 % of the image
    assert find_phantom(small) is None or find_phantom(small)[2] == pytest.approx(0.12 * 64)


def test_gaussian_mtf():
    y, x = np.indices((65, 65))
    bump = 1000 * np.exp(-((y - 33.3) ** 2 + (x - 30.6) ** 2) / (2 * 2.0**2))
    got = mtf_curve(bump, 0.5)
    assert got["mtf50"] == pytest.approx(math.sqrt(math.log(2) / 2) / math.pi, rel=0.08) and got["mtf10"] == pytest.approx(math.sqrt(math.log(10) / 2) / math.pi, rel=0.08)
    assert got["fwhm_w"] == pytest.approx(2.3548, rel=0.03) and got["fwhm_h"] == pytest.approx(2.3548, rel=0.03) and got["peak_value"] == bump.max()
    assert got["sample_count"] == 65 * 65 and got["unit"] == "lp/mm" and len(got["frequencies"]) == 33 and got["frequencies"][0] == 0 and (np.diff(got["responses"]) <= 0).all()
    dark = mtf_curve(50 - bump, (0.5, 1.0))
    assert dark["peak_value"] == (50 - bump).min() and dark["fwhm_h"] == pytest.approx(2 * 2.3548, rel=0.03) and max(dark["frequencies"]) < 0.5
    assert mtf_curve(np.zeros((9, 9)), None)["mtf50"] is None and mtf_curve(np.ones((4, 9)), None)["unit"] == "lp/pixel"


def test_components_of_voxels(spark):
    mask = spark.createDataFrame([("S", 0, 0, 0), ("S", 0, 0, 1), ("S", 1, 0, 1), ("S", 3, 3, 3), ("S", 3, 3, 5)], "series_id string, i int, j int, k int")
    assert rows(largest_components(mask), "voxels") == [(1,), (1,), (3,)]


def test_header_bytes():
    import struct

    def el(g, e, vr, v):
        return struct.pack("<HH2sH", g, e, vr, len(v)) + v

    data = b"\0" * 128 + b"DICM" + el(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + el(8, 0x60, b"CS", b"CT") + el(0x28, 0x10, b"US", b"\x02\0") + el(0x28, 0x11, b"US", b"\x02\0")
    got, _, problem = header(data)
    assert problem is None
    assert got["modality"] == "CT" and got["rows_"] == 2 and got["transfer_syntax_uid"] == "1.2.840.10008.1.2.1"
    assert header(b"not an image")[0] == {}


@pytest.mark.parametrize(("quaternion", "keep"), [((0.0, 0.0, 0.0, 1.0), True), ((0.5, 0.5, 0.5, 0.5), False), ((0.2, -0.4, 0.1, 1.8), True), ((0.0, 0.0, 0.0, 0.0), False)])
def test_clipping_by_a_quaternion(spark, quaternion, keep):
    s, g = cube(spark)
    polygon = ((-0.5, 0.1), (0.8, 0.05), (0.62, 0.7), (0.1, 1.4))
    got = {(r["i"], r["j"], r["k"]): r["value"] for r in volumes.clip_volume(slices=s, geometry=g, polygon=polygon, quaternion=quaternion, keep_inside=keep).collect()}
    q = np.array(quaternion) if any(quaternion) else np.array([0, 0, 0, 1.0])
    q = q / np.linalg.norm(q)
    turn = lambda p: p + 2 * np.cross(q[:3], np.cross(q[:3], p) + q[3] * p)
    corners = np.array([turn(np.array([x, y, z], float)) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)])
    pts = np.clip(polygon, 0, 1)
    for i, j, k in np.ndindex(3, 3, 3):
        p = turn(np.array([k - 1, j - 1, i - 1], float))
        x = (p[0] - corners[:, 0].min()) / np.ptp(corners[:, 0])
        y = 1 - (p[2] - corners[:, 2].min()) / np.ptp(corners[:, 2])
        odd = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(pts, np.roll(pts, -1, axis=0))) % 2 == 1
        assert got[i, j, k] == (9 * i + 3 * j + k if odd == keep else -1.3), (i, j, k, x, y)
    assert len(set(got.values())) > 3
    same = volumes.clip_volume(slices=s, geometry=g, polygon=((0.1, 0.1), (0.1, 0.5), (0.1, 0.9)))
    assert rows(same, "value") == [(float(n),) for n in range(27)]
