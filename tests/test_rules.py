"""Golden rows for names, edits, workspaces, phases and places: each case is worked out by hand."""

import random

import pytest

from tests.test_operators import HEADER, head
from voxtab.operators import catalog, roi, tag_edits
from voxtab.plans.statement import REGISTRY
from voxtab.sources import archives

MEMBERS = "archive_id bigint, ord bigint, member_name string"
TAGS = "sop_uid string, file string, series_uid string, study_uid string, ord bigint, tag_path string, tag string, keyword string, vr string, value string, depth int"


def upload(spark, names):
    rows = [(1, n, x) for n, x in enumerate(names, 1)]
    return [r["target_path"] for r in archives.sanitize_upload_paths(archive_members=spark.createDataFrame(rows, MEMBERS)).orderBy("ord").collect()]


def test_upload_names_never_meet(spark):
    assert upload(spark, ["a.dcm", "a.dcm", "a-2.dcm", "a.dcm", "b/a.dcm", "/b//../a.dcm", "C:\\x\\", "..", ".hidden", ".hidden"]) == ["a.dcm", "a-2.dcm", "a-2-2.dcm", "a-3.dcm", "b/a.dcm", "b/a-2.dcm", "x", "dicom-8.dcm", ".hidden", ".hidden-2"]
    rng = random.Random(1)
    names = [rng.choice(["a", "a-2", "a-2-2", "a-3", "q/a"]) + rng.choice(["", ".dcm"]) for _ in range(200)]
    got, taken = upload(spark, names), set()
    for name, path in zip(names, got, strict=True):
        stem, dot, suffix = name.partition(".")
        want = next(p for p in (name, *(f"{stem}-{n}{dot}{suffix}" for n in range(2, 300))) if p not in taken)
        taken.add(want)
        assert path == want


def test_patterns_are_literal(spark):
    names = ["O'Brien A", "OxBrien A", "O'Brien", "a^b", "axb", "50% off", "50 off", "a_b", "back\\slash", "a!b", "dot.x", "dotyx"]
    df = spark.createDataFrame([(str(n), x) for n, x in enumerate(names)], "study_uid string, patient_name string")
    other = ("patient_id", "study_date", "study_time", "accession_number", "study_description", "modalities")
    for c in other:
        df = df.selectExpr("*", f"'' as {c}")
    df = df.selectExpr("*", "1L as series_count", "1L as instance_count")
    find = lambda p: {r["patient_name"] for r in archives.query_studies(read_dicom_json=df, patient_name=p, modality="", study_date="").collect()}
    assert find("O'Brien*") == {"O'Brien A", "O'Brien"} and find("a^?") == {"a^b"} and find("50%*") == {"50% off"} and find("a_*") == {"a_b"} and find("?_b") == {"a_b"}
    assert find("back\\*") == {"back\\slash"} and find("a!b*") == {"a!b"} and find("dot.?") == {"dot.x"} and find("back\\slash") == {"back\\slash"} and len(find("*")) == len(names)


def tags(spark, rows):
    return spark.createDataFrame([("1.2", f, "9", "8", o, t, t, "", vr, v, 0) for f, o, t, vr, v in rows], TAGS)


def test_uids_go_part_by_part_and_every_file_is_marked(spark):
    df = tags(spark, [("f", 1, "00110010", "LO", "private"), ("f", 2, "00081155", "UI", "1.2\\1.3\\5"), ("f", 3, "00080018", "UI", "1.2"), ("f", 4, "00100010", "PN", "Name"), ("g", 1, "00110010", "LO", "private"), ("g", 2, "00080016", "UI", None), ("g", 3, "00080020", "DA", "20200101")])
    headers = spark.createDataFrame([head("/a", "1.2", series_uid="1.3", study_uid="1.4")], HEADER)
    new = {r["uid"]: r["new_uid"] for r in tag_edits.uid_map(headers=headers).collect()}
    got = {(r["file"], r["tag_path"]): r["value"] for r in tag_edits.deidentify_tags(tags=df, headers=headers).collect()}
    assert got == {
        ("f", "00081155"): f"{new['1.2']}\\{new['1.3']}\\5", ("f", "00080018"): new["1.2"], ("f", "00100010"): "ANONYMIZED", ("g", "00080016"): None, ("g", "00080020"): "",
        **{(f, t): v for f in "fg" for t, v in (("00120062", "YES"), ("00120063", "de-identified"))},
    }
    kept = {(r["file"], r["tag_path"]): r["value"] for r in tag_edits.deidentify_tags(tags=df, headers=headers, fields=("dates",)).collect()}
    assert kept["f", "00081155"] == "1.2\\1.3\\5" and kept["f", "00110010"] == "private" and kept["g", "00080020"] == ""


@pytest.mark.parametrize(("path", "value", "status", "stored"), [("0008103E", "A\\B'c", "edited", "A\\B'c"), ("00080020", "2020-01-01", "invalid", "20200101"), ("00080020", "20200102", "edited", "20200102"), ("00080060", "ct\\mr", "edited", "CT\\MR"), ("00080060", "c,t", "invalid", "CT"), ("00200013", "3\\x", "invalid", "1"), ("00409999", "x", "missing-path", None), ("7FE00010", "x", "binary", "<4>")])
def test_edits(spark, path, value, status, stored):
    df = tags(spark, [("f", 1, "0008103E", "LO", "old"), ("f", 2, "00080020", "DA", "20200101"), ("f", 3, "00080060", "CS", "CT"), ("f", 4, "00200013", "IS", "1"), ("f", 5, "7FE00010", "OW", "<4>")])
    (r,) = tag_edits.edit_tag(tags=df, path=path, value=value, series_uid="9").collect()
    assert (r["status"], r["value"]) == (status, stored) and (r["error"] is not None) == (status == "invalid")


def test_workspaces_stay_apart(spark):
    own = [head("/data/a/1.dcm", "1", "Lung 0%"), head("/data/b/2.dcm", "2", "Lung 50%", series_uid="7")]
    twin = [head("/data/a/1.dcm", "1", "Lung 0%", workspace_id="v")]
    df = spark.createDataFrame(own + twin, HEADER)
    got = [(r["workspace_id"], r["phase_index"], r["label"]) for r in catalog.phase_items(headers=df).orderBy("phase_index").collect()]
    assert got == [("w", 0, "0%"), ("w", 1, "50%")]
    summary = {(r["workspace_id"], r["series_key"][:5]): (r["is_four_d"], r["phase_count"]) for r in catalog.series_summary(headers=df).collect()}
    assert summary == {("w", "uid=9"): (True, 2), ("w", "uid=7"): (True, 2), ("v", "uid=9"): (False, 0)}
    refs = spark.createDataFrame([("/s1", "w", "1"), ("/s2", "v", "2"), ("/s3", "v", "2"), ("/s3", "v", "1")], "state_path string, workspace_id string, ref_uid string")
    attached = {(r["workspace_id"], r["state_path"], r["image_path"]) for r in catalog.attach_presentation_states(headers=df, presentation_references=refs).collect()}
    assert attached == {("w", "/s1", "/data/a/1.dcm"), ("v", "/s3", "/data/a/1.dcm")}
    assert {(r["workspace_id"], r["state_path"]) for r in catalog.unattached_presentation_states(headers=df, presentation_references=refs).collect()} == {("v", "/s2")}


def test_phases_of_headers(spark):
    names = [c for c, *_ in catalog.PHASE_TAGS]
    cases = [
        ({names[0]: "25.0"}, (25, "%", "NominalPercentageOfRespiratoryPhase", "Phase 25%")),
        ({names[1]: "about 30 of 100", names[3]: "2"}, (30, "%", "ActualRespiratoryPhase", "Phase 30%")),
        ({names[2]: "EXHALE", names[3]: "3"}, (3, "", "TemporalPositionIdentifier", "Phase 03")),
        ({names[3]: "12"}, (12, "", "TemporalPositionIdentifier", "Phase 12")),
        ({names[4]: "100.126\\9"}, (100.126, "ms", "TriggerTime", "Phase 100.13ms")),
        ({names[5]: "NaN", names[6]: "-.5"}, (-0.5, "ms", "RespiratoryTriggerDelayThreshold", "Phase -0.5ms")),
        ({names[6]: "none"}, None),
    ]
    df = spark.createDataFrame([head(f"/data/{n}.dcm", str(n), **tags_) for n, (tags_, _) in enumerate(cases)], HEADER)
    got = {r["path"]: (r["sort_value"], r["unit"], r["source"], r["label"]) for r in catalog.phase_from_header(headers=df).collect()}
    assert got == {f"/data/{n}.dcm": want for n, (_, want) in enumerate(cases) if want}
    one = spark.createDataFrame([head(f"/data/{n}.dcm", str(n), number=str(n), trigger_time=str(n % 2 * 100)) for n in range(5)] + [head("/data/x/9.dcm", "9", trigger_time="1")], HEADER)
    got = {(r["virtual_id"].rsplit("::", 1)[1], r["sort_value"], r["source"], r["label"], r["instance_count"]) for r in catalog.single_series_phases(headers=one).collect()}
    assert got == {("0", 0.0, "TriggerTime", "Phase 0ms", 3), ("1", 100.0, "TriggerTime", "Phase 100ms", 2)}
    assert {r["series_key"].count("dir=x"): (r["is_four_d"], r["phase_count"]) for r in catalog.series_summary(headers=one).collect()} == {0: (True, 2), 1: (False, 0)}


def test_texts_without_phases(spark):
    texts = {"4D Lung 50% ex": "4d lung ex", "lung50%": "lung", "Phase 1 phase 2 run": "run", "p1 p2 MP1": "mp1", "50 percentage": "50 percentage", "ph-10,x": "x", "70 pct": ""}
    df = spark.createDataFrame([head(f"/{n}", str(n), t) for n, t in enumerate(texts)], HEADER)
    assert {r["series_description"]: r["group_text"] for r in catalog.phase_group_text(headers=df).collect()} == texts


AXES = {"axial": (1, 0, 0, 0, 1, 0), "flipped": (-1, 0, 0, 0, 1, 0), "oblique": (1, 0, 0, 0, 0.8, 0.6)}


def geometry(axes, place, **more):
    return {a + c: float(axes[3 * n + m]) for n, a in enumerate("rc") for m, c in enumerate("xyz")} | {f"position_{c}": float(v) for c, v in zip("xyz", place, strict=True)} | more


@pytest.mark.parametrize(("axes", "places", "order", "gap"), [("axial", [(0, 0, 4), (0, 0, 0), (9, 9, 1)], [2, 0, 1], 2.0), ("flipped", [(0, 0, 4), (0, 0, 0), (0, 0, 1)], [0, 2, 1], 2.0), ("oblique", [(0, 0, 0), (0, -6, 8), (0, -3, 4)], [0, 2, 1], 5.0)])
def test_places_along_the_slice_direction(spark, axes, places, order, gap):
    rows = [head(f"/data/{n}.dcm", str(n), number=str(n + 1), **geometry(AXES[axes], p)) for n, p in enumerate(places)]
    rows[0] = head("/data/0.dcm", "0", number="1", **{f"position_{c}": float(v) for c, v in zip("xyz", places[0], strict=True)})  # the first has no direction of its own
    df = spark.createDataFrame(rows, HEADER)
    assert [r["spatial_index"] for r in catalog.spatial_order(headers=df).orderBy("path").collect()] == order
    (r,) = catalog.slice_spacing(headers=df).collect()
    assert r["spacing"] == pytest.approx(gap)


def test_spacing_without_places(spark):
    rows = [head("/data/a/1.dcm", "1", series_uid="a", has_position=False, slice_thickness="-2.5"), head("/data/b/1.dcm", "1", series_uid="b", has_position=False, slice_thickness="thin", pixel_spacing=0.0), head("/data/c/1.dcm", "1", series_uid="c", pixel_spacing=None, slice_thickness="4")]
    rows += [head(f"/data/d/{n}.dcm", str(n), series_uid="d", number=str(5 - n), has_position=n != 1, **geometry(AXES["axial"], (0, 0, n))) for n in range(3)]
    df = spark.createDataFrame(rows, HEADER)
    got = {r["series_key"][4]: (r["spacing"], r["in_plane"]) for r in catalog.slice_spacing(headers=df).collect()}
    assert got == {"a": (2.5, 1.0), "b": (1.0, 0.001), "c": (1.0, 1.0), "d": (2.0, 1.0)}
    order = [r["spatial_index"] for r in catalog.spatial_order(headers=df).filter("series_key LIKE 'uid=d%'").orderBy("path").collect()]
    assert order == [2, 1, 0]  # a missing position keeps the order of numbers


def test_answers_of_archives(spark):
    """Any tag survives; lists of names and numbers, empty values, elements and records that are none."""
    records = [
        '{"0020000D": {"vr": "UI", "Value": ["1.2"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "", "Ideographic": "I"}]}, "00080061": {"vr": "CS", "Value": ["CT", "", null, "MR"]}, "00201208": {"vr": "IS", "Value": [12]}, "00201206": {"vr": "IS", "Value": ["x"]}, "00091001": {"vr": "LO", "Value": ["private", 1.5]}, "00080060": ["x"], "00080050": {"vr": "SH"}, "00080030": {"vr": "TM", "Value": "10"}}',
        "[1]", "no", None, "7", "{}",
    ]
    df = spark.createDataFrame(list(enumerate(records)), "record_no bigint, record string")
    got = {r["tag"]: (r["vr"], r["values_"]) for r in archives.dicom_json_tags(qido_records=df).collect()}
    assert got == {"0020000D": ("UI", ["1.2"]), "00100010": ("PN", ["I"]), "00080061": ("CS", ["CT", "MR"]), "00201208": ("IS", ["12"]), "00201206": ("IS", ["x"]), "00091001": ("LO", ["private", "1.5"]), "00080060": (None, []), "00080050": ("SH", []), "00080030": ("TM", [])}
    one, empty = archives.read_dicom_json(qido_records=df).orderBy("record_no").collect()
    assert (one["study_uid"], one["patient_name"], one["modalities"], one["instance_count"], one["series_count"], one["study_time"]) == ("1.2", "I", "CT,MR", 12, None, None)
    assert empty["record_no"] == 5 and empty["study_uid"] == "" and empty["patient_name"] is None and empty["modalities"] == ""


def test_display_lines(spark):
    """All 34 lines of a full header, of one with fall-backs, and of an empty one."""
    full = {
        "manufacturer": " Maker ", "manufacturer_model_name": "M1", "station_name": "ST", "institution_name": "Inn", "study_description": "Exam", "series_description": "Thin", "study_id": "7", "series_number": "3", "patient_name": "A^B", "patient_id": "id", "patient_sex": "F", "patient_age": "045Y",
        "acquisition_date": "20240102", "acquisition_time": "101530.25", "study_date": "20240101", "study_time": "0930", "kvp": "120.0", "xray_tube_current": "80.25", "slice_thickness": "2.50", "modality": "CT", "accession_number": "9", "study_uid": "1", "series_uid": "2", "sop_uid": "3",
        "body_part_examined": "CHEST", "protocol_name": "P", "patient_birth_date": "1970", "referring_physician_name": "Dr", "patient_position": "HFS", "pixel_spacing": "0.50\\0.6254", "rows_": "4", "columns_": "5", "image_position": "1.126\\-3\\x", "image_orientation": "1\\0\\-0.33337",
        "rescale_slope": "1.00", "rescale_intercept": "-1024", "convolution_kernel": "B", "reconstruction_diameter": "350.04", "ctdi_vol": "12.346", "exposure": "n/a", "exposure_time": "500",
    }
    some = {"content_date": "soon", "study_time": "09:30:05", "study_id": "S7", "patient_age": "1Y", "xray_tube_current": " ", "rescale_intercept": "0", "rows_": "4", "manufacturer_model_name": "only"}
    schema = "path string, " + ", ".join(f"{c} string" for c in catalog.TEXT_FIELDS)
    df = spark.createDataFrame([(p, *(v.get(c) for c in catalog.TEXT_FIELDS)) for p, v in (("full", full), ("some", some), ("none", {}))], schema)
    got = {}
    for r in catalog.display_header(header_texts=df).collect():
        got.setdefault(r["path"], {})[r["label"]] = r["line"]
    assert got["full"] == {
        "manufacturerModel": "Maker / M1", "stationName": "ST", "institutionName": "Inn", "examDescription": "Exam", "seriesNumber": "Se: 3", "patientName": "A^B", "patientSummary": "id F / 045Y", "technique": "120kV 80.2mA", "sliceThickness": "2.5mm", "acquisitionDateTime": "2024.01.02 10:15:30",
        "modality": "Modality: CT", "accessionNumber": "Acc: 9", "studyDate": "Study date: 2024.01.01", "studyTime": "Study time: 0930", "studyId": "Study ID: 7", "studyInstanceUid": "Study UID: 1", "seriesInstanceUid": "Series UID: 2", "sopInstanceUid": "SOP UID: 3", "seriesDescription": "Series: Thin",
        "bodyPartExamined": "Body: CHEST", "protocolName": "Protocol: P", "patientBirthDate": "Birth: 1970", "referringPhysicianName": "Referrer: Dr", "patientPosition": "Patient pos: HFS", "pixelSpacing": "Pixel: 0.5 x 0.625mm", "rowsColumns": "Matrix: 4 x 5", "imagePositionPatient": "IPP: 1.13, -3, x",
        "imageOrientationPatient": "IOP: 1, 0, -0.3334", "rescaleSlopeIntercept": "Rescale: m 1  b -1024", "convolutionKernel": "Kernel: B", "reconstructionDiameter": "FOV: 350mm", "ctdiVol": "CTDIvol: 12.35mGy", "exposure": "Exposure: n/amAs", "exposureTime": "Exp time: 500ms",
    }
    assert len(got["full"]) == 34 and "none" not in got
    assert got["some"] == {"manufacturerModel": "only", "examDescription": "S7", "patientSummary": "1Y", "acquisitionDateTime": "soon 09:30:05", "studyTime": "Study time: 09:30:05", "studyId": "Study ID: S7", "rescaleSlopeIntercept": "Rescale: m -  b 0"}


def test_values_of_texts(spark):
    schema = "path string, " + ", ".join(f"{c} string" for c in catalog.TEXT_FIELDS)
    one = lambda p, **v: (p, *(v.get(c) for c in catalog.TEXT_FIELDS))
    df = spark.createDataFrame([one("a", series_number=" 3.9 ", rows_="4", columns_="0", pixel_spacing="0.5\\1e1\\x", series_description=" t "), one("b", series_number="-2", pixel_spacing="1  2"), one("c", series_number="x", pixel_spacing="1\\y", series_description=" "), one("d", series_number=" ", pixel_spacing="7")], schema)
    got = {r["path"]: tuple(r)[1:] for r in catalog.coerce_headers(header_texts=df).collect()}
    assert got == {"a": ("t", 3, True, 4, None, 0.5, 10.0), "b": (None, None, True, None, None, 1.0, 2.0), "c": (None, None, True, None, None, None, None), "d": (None, None, False, None, None, None, None)}


def test_levels_of_a_rollup(spark):
    df = spark.createDataFrame([head("/a/1.dcm", "1"), head("/a/2.dcm", "2"), head("/b/1.dcm", "3", series_uid="7", modality="MR"), head("/c/1.dcm", "4", series_uid="6", study_uid="s", patient_id=None)], HEADER)
    got = sorted((r["level"], r["patient_id"] or "", r["study_uid"] or "", r["modalities"], r["series_count"], r["instance_count"]) for r in catalog.study_rollup(headers=df).collect())
    assert got == [(0, "", "", "CT, MR", 3, 4), (1, "", "", "CT", 1, 1), (1, "p", "", "CT, MR", 2, 3), (2, "", "s", "CT", 1, 1), (2, "p", "8", "CT, MR", 2, 3), (3, "", "s", "CT", 1, 1), (3, "p", "8", "CT", 1, 2), (3, "p", "8", "MR", 1, 1)]


def test_progress_of_jobs(spark):
    rows = [("a", 8, 1, "running"), ("b", 8, 99, "failed"), ("c", 0, 3, "pending"), ("d", 8, 2, "succeeded"), ("e", -5, -3, "running"), ("f", 200, 1, "running"), ("g", 200, 3, "running")]
    df = spark.createDataFrame(rows, "job_id string, total bigint, processed bigint, status string")
    got = {r["job_id"]: (r["processed"], r["total"], r["percent"]) for r in archives.job_progress(background_jobs=df).collect()}
    assert got == {"a": (1, 8, 12), "b": (8, 8, 100), "c": (3, 0, 0), "d": (2, 8, 100), "e": (0, 0, 0), "f": (1, 200, 0), "g": (3, 200, 2)}


STATS = "measurement_id string, unit string, area_unit string, width double, area double, mean double, standard_deviation double"


def box_stats(spark):
    return spark.createDataFrame([("a", "mm", "mm2", 1.5, 18.0, -0.015625, 450.0), ("b", "px", "px2", 0.25, -0.05, None, 0.0), ("c", "px", "px2", 2.0, 4.0, -0.06, 0.04)], STATS)


def test_labels_keep_the_sign_of_small_numbers(spark):
    got = {r["measurement_id"]: (r["area_label"], r["mean_label"], r["sd_label"], r["width_label"]) for r in roi.measurement_labels(rect_roi_stats=box_stats(spark)).collect()}
    assert got == {"a": ("Area: 18.0 mm2", "Mean: -0.0", "SD: 450.0", "W: 1.5 mm"), "b": ("Area: -0.0 px2", "Mean: -", "SD: 0.0", "W: 0.2 px"), "c": ("Area: 4.0 px2", "Mean: -0.1", "SD: 0.0", "W: 2.0 px")}


def test_read_labels_keep_the_sign_of_small_numbers(spark):
    got = [(r["label"], r["concept"], r["number"]) for r in roi.parse_measure_labels(rect_roi_stats=box_stats(spark)).collect() if r["measurement_id"] < "c"]
    assert ("Mean: -0.0", "Mean", 0.0) in got and ("Area: -0.0 px2", "Area", 0.0) in got and len(got) == 7


def test_report_numbers_keep_the_sign_of_small_numbers(spark):
    point = "named_struct('x', 1D, 'y', 2D)"
    boxes = spark.sql(f"SELECT 'a' AS measurement_id, 'S1' AS series_id, 0 AS slice_index, 'rect' AS tool_type, array({point}, {point}) AS points")
    got = {r["path"]: r["text_value"] for r in roi.sr_report_rows(measurements=boxes, rect_roi_stats=box_stats(spark)).collect()}
    assert (got["1.4.1"], got["1.4.2"], got["1.4.3"], got["1.3.2"]) == ("18.0", "-0.0", "450.0", "1.00/2.00")


@pytest.mark.parametrize("stray", [False, True])
def test_uids_without_a_header_stay(spark, stray):
    df = tags(spark, [("f", 1, "00080018", "UI", "1.2"), ("f", 2, "00081155", "UI", "1.3\\7.7\\1.2"), ("f", 3, "00080016", "UI", "7.7"), ("f", 4, "00080060", "CS", "1.2"), ("g", 1, "00081155", "UI", ""), ("g", 2, "0020000D", "UI", None)])
    headers = spark.createDataFrame([head("/a", "1.2", series_uid="1.3", study_uid="1.4")], HEADER)
    assert {r["uid"] for r in REGISTRY["stray_uids"](tags=df, headers=headers).collect()} == {"7.7", ""}
    new = {r["uid"]: r["new_uid"] for r in tag_edits.uid_map(headers=headers).collect()}
    got = {(r["file"], r["ord"]): r["value"] for r in tag_edits.remap_uids(tags=df, headers=headers, stray=stray).collect()}
    assert got == {("f", 1): new["1.2"], ("f", 2): f"{new['1.3']}\\7.7\\{new['1.2']}", ("f", 3): "7.7", ("g", 1): ""}
    named = {(r["file"], r["ord"]): r["value"] for r in tag_edits.deidentify_tags(tags=df, headers=headers, stray=stray).collect() if r["ord"] < 90}
    assert named == {**got, ("f", 4): "1.2", ("g", 2): None}
