"""The given tables as tables of the domain."""

from __future__ import annotations

from voxtab.operators.roi import CLIPPED, ends, shape
from voxtab.plans.statement import REGISTRY, Dialect, operator, view


@view
def headers(d: Dialect) -> str:
    """One row per file: identifiers, text fields, sizes, flags, place, direction and phase tags of a DICOM header; axial, flipped, coronal and oblique series, some without a direction."""
    t = d.text
    pick = lambda n, *v: "cast(CASE l_suppkey % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(v)) + f" END AS double) AS {n}"
    none = "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 1 END"
    geometry = ", ".join(["cast(l_quantity AS double) AS position_x", "cast(l_extendedprice AS double) / 2 AS position_y", pick("rx", 1, -1, 1, none, "NULL"), pick("ry", 0, 0, 0, 0, 0), pick("rz", 0, 0, 0, 0, 0), pick("cx", 0, 0, 0, 0, "NULL"),
                          pick("cy", 1, 1, 0, 0.8, 1), pick("cz", 0, 0, -1, 0.6, 0), f"CASE WHEN l_suppkey % 7 = 0 THEN 'thin' WHEN l_suppkey % 7 = 1 THEN NULL ELSE '2.5' END AS slice_thickness"])
    tag = lambda n, name, value: f"CASE WHEN l_suppkey % 9 = {n} THEN {value} END AS {name}"
    whole = lambda c: f"cast(cast({c} AS bigint) AS {t})"
    phases = ", ".join([tag(0, "nominal_percentage_of_respiratory_phase", f"{whole('l_orderkey % 4 * 25')} || '.0'"), tag(1, "actual_respiratory_phase", f"'about ' || {whole('l_orderkey % 3 * 30')} || ' of 100'"), tag(2, "respiratory_phase", "'EXHALE'"),
                        tag(2, "temporal_position_identifier", whole("l_linenumber")), tag(3, "trigger_time", f"{whole('l_orderkey % 5 * 100')} || '.125'"), tag(4, "nominal_respiratory_trigger_delay_time", "'7'"), tag(5, "respiratory_trigger_delay_threshold", f"{whole('l_orderkey % 2')} || '.50' || chr(92) || '3'")])
    return f"""SELECT '1.2.3.' || cast(l_orderkey AS {t}) || '.' || cast(l_linenumber AS {t}) AS sop_uid,
  '1.2.4.' || cast(l_suppkey AS {t}) AS series_uid,
  '1.2.5.' || cast(cast(floor(l_suppkey / 4) AS bigint) AS {t}) AS study_uid,
  '/data/g' || cast(l_partkey % 3 AS {t}) || '/f' || cast(l_orderkey AS {t}) || '_' || cast(l_linenumber AS {t}) || '_' || cast(l_partkey AS {t})
    || '_' || cast(l_suppkey AS {t}) || '_' || cast(cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS {t})
    || CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN '.txt' ELSE '.dcm' END AS path,
  CASE WHEN l_linenumber = 7 THEN CASE WHEN l_quantity > 45 THEN 'OT' WHEN l_returnflag = 'A' THEN 'PR' ELSE 'SR' END
    ELSE CASE l_suppkey % 3 WHEN 0 THEN 'CT' WHEN 1 THEN 'PT' ELSE 'MR' END END AS modality,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Scan ' || cast(l_suppkey % 3 AS {t}) || ' ' || cast((l_suppkey % 10) * 10 AS {t}) || '%'
    ELSE 'Routine ' || cast(l_suppkey % 5 AS {t}) END AS series_description,
  CASE WHEN l_tax = 0 THEN 'None' WHEN l_tax = 0.01 THEN ' ' ELSE cast(l_linenumber AS {t}) || '.0' END AS instance_number_text,
  cast(CASE WHEN l_discount = 0 THEN NULL ELSE 256 * (1 + l_suppkey % 2) END AS int) AS rows_,
  cast(CASE WHEN l_discount = 0.01 THEN 0 ELSE 512 END AS int) AS columns_,
  CASE WHEN l_linestatus = 'O' THEN '1.2.840.10008.1.2.1' WHEN l_quantity < 5 THEN NULL ELSE '1.2.840.10008.1.2.4.50' END AS transfer_syntax_uid,
  CASE WHEN l_quantity = 1 THEN 'RGB' ELSE 'MONOCHROME2' END AS photometric,
  CASE WHEN l_quantity < 3 THEN NULL ELSE cast(0.5 AS double) END AS pixel_spacing,
  l_quantity <= 48 AS has_position, l_quantity <= 49 AS has_rescale_slope,
  cast(CASE WHEN l_quantity = 2 THEN 4 ELSE 1 END AS int) AS number_of_frames,
  'ws' || cast(l_suppkey % 2 AS {t}) AS workspace_id, 'P' || cast(cast(floor(l_suppkey / 8) AS bigint) AS {t}) AS patient_id,
  cast(l_extendedprice AS double) AS position_z, CASE WHEN l_linenumber <> 7 THEN '1.2.840.10008.5.1.4.1.1.2' WHEN l_returnflag = 'A' AND l_quantity > 25 THEN '1.2.840.10008.5.1.4.1.1.11.1' WHEN l_quantity > 40 THEN '1.2.840.10008.5.1.4.1.1.88.33' END AS sop_class_uid,
  l_orderkey AS file_no, l_linenumber AS file_part, {geometry}, {phases}
FROM lineitem"""


@view
def header_texts(d: Dialect) -> str:
    """Text fields of each file's header as they stand in it: several values between backslashes, some blank or no numbers."""
    t, back = d.text, "chr(92)"
    whole = lambda c: f"cast(cast({c} AS bigint) AS {t})"
    day = lambda c: f"replace(substring(cast({c} AS {t}), 1, 10), '-', '')"
    rare = lambda n, x: f"CASE WHEN l_partkey % {n} <> 0 THEN {x} END"
    fields = {
        "manufacturer": rare(3, "'Maker'"), "manufacturer_model_name": rare(4, "'M' || " + whole("l_partkey % 5")), "station_name": "CASE WHEN l_linenumber = 1 THEN ' ' ELSE 'ST1' END", "institution_name": rare(2, "'Hospital'"),
        "study_description": rare(5, "'Exam'"), "series_description": "h.series_description", "study_id": rare(7, whole("l_suppkey")), "series_number": "CASE WHEN l_linenumber = 3 THEN ' 3.9 ' WHEN l_linenumber = 4 THEN '-2' WHEN l_linenumber = 5 THEN 'x' ELSE " + whole("l_linenumber") + " END", "patient_name": "'P^' || " + whole("l_orderkey"), "patient_id": rare(3, whole("l_orderkey")),
        "patient_sex": rare(2, "'F'"), "patient_age": rare(3, "'045Y'"), "acquisition_date": rare(2, day("l_shipdate")), "content_date": "'soon'", "study_date": day("l_commitdate"), "acquisition_time": rare(2, "'101530.25'"), "content_time": rare(4, "'1015'"), "study_time": "'09:30:05'",
        "kvp": "'120.0'", "xray_tube_current": rare(3, whole("l_quantity") + " || '.25'"), "slice_thickness": "h.slice_thickness", "modality": "h.modality", "accession_number": whole("l_partkey"), "study_uid": "h.study_uid", "series_uid": "h.series_uid", "sop_uid": "h.sop_uid",
        "body_part_examined": rare(2, "'CHEST'"), "protocol_name": rare(3, "'Routine'"), "patient_birth_date": "'19700101'", "referring_physician_name": rare(6, "'Dr'"), "patient_position": "'HFS'", "pixel_spacing": f"CASE WHEN l_quantity >= 30 THEN '0.50' || {back} || '0.6250' WHEN l_quantity >= 20 THEN '0.5  1' WHEN l_quantity >= 10 THEN '0.5' WHEN l_quantity >= 5 THEN '1' || {back} || 'y' END",
        "rows_": f"cast(h.rows_ AS {t})", "columns_": f"cast(h.columns_ AS {t})", "image_position": f"CASE WHEN h.has_position THEN {whole('l_quantity')} || '.125' || {back} || '-3' || {back} || 'x' END", "image_orientation": f"'1' || {back} || '0.00' || {back} || '-0.33335'",
        "rescale_slope": "CASE WHEN h.has_rescale_slope THEN '1.00' END", "rescale_intercept": rare(2, "'-1024'"), "convolution_kernel": rare(2, "'B30f'"), "reconstruction_diameter": "'350.04'", "ctdi_vol": rare(3, "'12.345'"), "exposure": rare(4, "'n/a'"), "exposure_time": rare(2, "'500'"),
    }
    columns = ", ".join(f"{v} AS {k}" for k, v in fields.items())
    return f"""SELECT h.path, {columns} FROM (SELECT h.*, file_no AS l_orderkey, file_part AS l_linenumber, length(path) * 7 + file_no AS l_partkey, cast(right(series_uid, 1) AS bigint) AS l_suppkey, position_x AS l_quantity,
  DATE '1995-01-31' AS l_shipdate, DATE '1996-02-29' AS l_commitdate FROM headers h) h"""


@view
def slices(d: Dialect) -> str:
    """One row per slice: 8 x 8 values after rescaling, row-major, and what the pixels were; series S3 lies on a table of two slices."""
    t = d.text
    return f"""SELECT 'S' || cast(label AS {t}) AS series_id, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS int) AS i, label, 8 AS rows_, 8 AS columns_,
  CASE WHEN label = 8 THEN 'MONOCHROME1' ELSE 'MONOCHROME2' END AS photometric, {d.each('embedding', 'x', 'cast(CASE WHEN table_ THEN abs(floor(cast(x AS double) * 4000)) % 100 ELSE floor(cast(x AS double) * 4000) END AS double)')} AS pixels
FROM (SELECT *, label = 3 AND row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 2 AS table_ FROM embeddings) e"""


@view
def voxels(d: Dialect) -> str:
    """One row per voxel of all series."""
    inner = d.pixels("SELECT series_id, i, label, columns_, pixels FROM slices")
    return f"SELECT series_id, i, cast(floor(p / columns_) AS int) AS j, cast(p % columns_ AS int) AS k, value, label FROM ({inner}) q"


@view
def stored_slices(d: Dialect) -> str:
    """Slices as they are stored: samples of 12 bits, their scale (null for none) and photometric interpretation."""
    return f"""SELECT series_id, i, 8 AS rows_, 8 AS columns_, CASE WHEN i % 4 = 3 THEN 'RGB' WHEN i % 2 = 1 THEN 'MONOCHROME1' ELSE 'MONOCHROME2' END AS photometric,
  CASE WHEN i % 3 = 0 THEN NULL ELSE cast(2 AS double) END AS slope, CASE WHEN i % 3 = 0 THEN NULL ELSE cast(-1024 AS double) END AS intercept, CASE WHEN i % 8 = 3 THEN 12 END AS bits_stored,
  CASE WHEN i % 5 = 0 THEN cast(400 AS double) END AS window_width, CASE WHEN i % 5 = 0 THEN cast(40 AS double) END AS window_center, {d.each('pixels', 'x', 'x + 2048')} AS pixels FROM slices"""


@view
def image_series(d: Dialect) -> str:
    """One row per pixel series: modality, size, study."""
    t = d.text
    return f"""SELECT series_id, 'ST' || cast(cast(floor(label / 2) AS int) AS {t}) AS study_uid, CASE WHEN label = 6 THEN NULL WHEN label % 2 = 0 THEN 'CT' ELSE 'PT' END AS modality,
  CASE label WHEN 2 THEN 'Chest routine' WHEN 4 THEN 'Spine lumbar' WHEN 6 THEN 'CTA body' ELSE 'Plain' END AS series_description,
  CASE label WHEN 8 THEN 'Hip fracture' WHEN 0 THEN 'Abdomen' END AS study_description, label, cast(count(*) AS int) AS depth, max(rows_) AS nj, max(columns_) AS nk FROM slices GROUP BY series_id, label"""


@view
def orientations(d: Dialect) -> str:
    """Direction of rows and columns (unit vectors; null for none), spacing, first position and size of each series: axial, flipped, coronal, oblique."""
    pick = lambda n, *v: "cast(CASE label % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(v)) + f" END AS double) AS {n}"
    return f"""SELECT series_id, label, depth, nj, nk, {pick('rx', 1, -1, 1, 1, 'NULL')}, {pick('ry', 0, 0, 0, 0, 0)}, {pick('rz', 0, 0, 0, 0, 0)}, {pick('cx', 0, 0, 0, 0, 0)}, {pick('cy', 1, 1, 0, 0.866025403784, 1)}, {pick('cz', 0, 0, -1, 0.5, 0)},
  CASE WHEN label % 2 = 0 THEN cast(2.5 AS double) ELSE cast(3.0 AS double) END AS slice_step, CASE WHEN label % 2 = 0 THEN cast(1.0 AS double) ELSE cast(2.0 AS double) END AS row_step,
  CASE WHEN label % 2 = 0 THEN cast(0.5 AS double) ELSE cast(2.0 AS double) END AS column_step, cast(label AS double) AS px, cast(0 AS double) AS py, cast(0 AS double) AS pz FROM image_series"""


@view
def regions(d: Dialect) -> str:
    """Threshold regions: an oriented box around a centre (three unit vectors, half sides), an HU threshold or a percentile of the box."""
    axes = "cast(1 AS double) AS ux, cast(0 AS double) AS uy, cast(0 AS double) AS uz, cast(0 AS double) AS vx, cast(0.8 AS double) AS vy, cast(0.6 AS double) AS vz, cast(0 AS double) AS wx, cast(-0.6 AS double) AS wy, cast(0.8 AS double) AS wz"
    half = lambda n: f"cast({n} AS double) / 2"
    centre = ", ".join(f"o{c} + 20 * i{c} + {half('nj - 1')} * j{c} + {half('nk - 1')} * k{c} AS c{c}" for c in "xyz")
    return f"""SELECT series_id, cast(r AS int) AS region_id, r <> 3 AS enabled, CASE r WHEN 2 THEN 'percentile' ELSE 'hu' END AS mode,
  CASE r WHEN 1 THEN cast(300 AS double) WHEN 2 THEN cast(80 AS double) ELSE cast(0 AS double) END AS threshold, {centre}, {axes}, cast(2.6 AS double) AS hx, cast(4.1 AS double) AS hy, cast(21.3 AS double) AS hz
FROM (SELECT *, {d.rows(d.span('0', '3'))} AS r FROM geometry) q"""


@view
def spheres(d: Dialect) -> str:
    """Spheres of 6 and 15 mm in each series."""
    half = lambda n: f"cast({n} AS double) / 2"
    centre = ", ".join(f"o{c} + 20 * i{c} + {half('nj - 1')} * j{c} + {half('nk - 1')} * k{c} AS c{c}" for c in "xyz")
    return f"""SELECT series_id, cast(r AS int) AS sphere_id, CASE r WHEN 0 THEN cast(6 AS double) ELSE cast(15 AS double) END AS radius, {centre} FROM (SELECT *, {d.rows(d.span('0', '1'))} AS r FROM geometry) q"""


@view
def phantoms(d: Dialect) -> str:
    """Found phantoms: centre and radius in a slice, with its size."""
    return "SELECT series_id, 0 AS i, cast(128 AS double) AS cx, cast(120 + label AS double) AS cy, cast(60 + label * 7 AS double) AS radius, 256 AS rows_, 256 AS columns_ FROM image_series"


@view
def registrations(d: Dialect) -> str:
    """Registration of each CT and PET pair: rotation about the plane's normal in degrees, shift along its columns and rows in millimetres, and how the PET is shown."""
    return """SELECT ct_id, pet_id, CASE WHEN ct_id = 'S0' THEN cast(0 AS double) ELSE cast(6 AS double) END AS rotation, cast(1.5 AS double) AS shift_u, cast(-2.25 AS double) AS shift_v,
  'SUVbw' AS unit, cast(0 AS double) AS low, cast(0.0005 AS double) AS high, cast(0.6 AS double) AS alpha FROM pair_pet_ct"""


@view
def gsps_layout(d: Dialect) -> str:
    """State, annotation item and object of each drawing in the presentation state of its slice, with its units."""
    return f"""SELECT measurement_id, tool_type, series_id || '/' || cast(slice_index AS {d.text}) AS file, CASE WHEN tool_type = 'angle' THEN 1 ELSE 0 END AS annotation,
  row_number() OVER (PARTITION BY series_id, slice_index, tool_type = 'angle' ORDER BY measurement_id) - 1 AS object_no, CASE WHEN scope = 'series' AND tool_type = 'curve' THEN 'DISPLAY' ELSE 'PIXEL' END AS units FROM measurements"""


@view
def state_tags(d: Dialect) -> str:
    """Elements of presentation states by their path: references, layers, graphics with their data as one value of several, and texts for every second drawing."""
    t, back = d.text, chr(92) * (2 if d.spark else 1)
    number = lambda c: f"cast({c} AS {t})"
    field = lambda tag, vr, value: d.struct(tag=f"'{tag}'", vr=f"'{vr}'", value=value)
    own = lambda tags: "SELECT file, '00700001/' || " + number("annotation") + " || '/' || kind || '/' || " + number("object_no") + " || '/' || (x).tag AS tag_path, (x).tag AS tag, (x).vr AS vr, (x).value AS value FROM (" + tags + ") o"
    state = d.array(field("00080018", "UI", "'1.9.' || replace(file, '/', '.')"), d.struct(tag="'00081115/0/00081140/0/00081155'", vr="'UI'", value="'1.2.3.' || replace(file, '/', '.')"))
    layer = d.array(d.struct(tag="'00700002'", vr="'CS'", value="CASE annotation WHEN 1 THEN 'ANNOTATIONS' ELSE 'MEASURE' END"), d.struct(tag="'00081140/0/00081155'", vr="'UI'", value="CASE annotation WHEN 1 THEN '1.2.4.' || replace(file, '/', '.') ELSE '' END"))
    if d.spark:  # drawings are moved once, with their points; their data are written after that, and only where they are read
        clipped = [f"cast(round({c.replace('greatest(', 'greatest(p.')} + 1, 6) AS string)" for c in CLIPPED]
        data = f"array_join(transform(o, p -> {clipped[0]} || chr(92) || {clipped[1]}), chr(92))"
        graphic_type, o = shape(d)
        values = {"units": ("00700009", "00700005", "CS", "units"), "type": ("00700009", "00700023", "CS", f"CASE WHEN tool_type = 'ellipse' THEN 'ELLIPSE' ELSE {graphic_type} END"), "data": ("00700009", "00700022", "FL", "data"),
                  "text": ("00700008", "00700006", "ST", "CASE WHEN object_no % 3 = 2 THEN ' ' ELSE 'label of ' || tool_type END"), "anchor": ("00700008", "00700014", "FL", "'3.5' || chr(92) || '0.5'"), "place": ("00700008", "00700004", "CS", "CASE WHEN object_no % 5 = 4 THEN 'DISPLAY' ELSE 'PIXEL' END")}
        value = "CASE (x).tag " + " ".join(f"WHEN '{tag}' THEN {data.replace('(o,', f'({o},') if k == 'data' else v}" for k, (_, tag, _, v) in values.items()) + " END"
        each = d.array(*(d.struct(kind=f"'{kind}'", tag=f"'{tag}'", vr=f"'{vr}'") for kind, tag, vr, _ in values.values()))
        file = f"series_id || '/' || {number('slice_index')} AS file, CASE WHEN tool_type = 'angle' THEN 1 ELSE 0 END AS annotation"
        return f"""SELECT file, '00700001/' || {number('annotation')} || '/' || (x).kind || '/' || {number('object_no')} || '/' || (x).tag AS tag_path, (x).tag AS tag, (x).vr AS vr, {value} AS value FROM (SELECT *, {d.rows(each)} AS x FROM (SELECT *, {ends(d)}, CASE WHEN scope = 'series' AND tool_type = 'curve' THEN 'DISPLAY' ELSE 'PIXEL' END AS units FROM (
  SELECT {file}, tool_type, scope, points, image_width, image_height, row_number() OVER (PARTITION BY series_id, slice_index, tool_type = 'angle' ORDER BY measurement_id) - 1 AS object_no FROM measurements) l) m) o
UNION ALL SELECT file, '00700001/' || {number('annotation')} || '/' || (x).tag AS tag_path, right((x).tag, 8) AS tag, (x).vr AS vr, (x).value AS value FROM (SELECT file, annotation, {d.rows(layer)} AS x FROM (SELECT DISTINCT {file} FROM measurements) a) b
UNION ALL SELECT file, (x).tag AS tag_path, right((x).tag, 8) AS tag, (x).vr AS vr, (x).value AS value FROM (SELECT file, {d.rows(state)} AS x FROM (SELECT DISTINCT {file.split(', CASE')[0]} FROM measurements) a) b"""
    graphics = f"""SELECT file, annotation, object_no, '00700009' AS kind, {d.rows(d.array(field('00700005', 'CS', 'units'), field('00700023', 'CS', 'graphic_type'), field('00700022', 'FL', 'data')))} AS x FROM (
    SELECT l.file, l.annotation, l.object_no, max(l.units) AS units, max(CASE WHEN l.tool_type = 'ellipse' THEN 'ELLIPSE' ELSE g.graphic_type END) AS graphic_type, {d.joined(f"{number('g.x')} || chr(92) || {number('g.y')}", back, 'g.n')} AS data
    FROM gsps_layout l JOIN gsps_graphics g ON g.measurement_id = l.measurement_id GROUP BY l.file, l.annotation, l.object_no) g"""
    texts = f"""SELECT file, annotation, object_no, '00700008' AS kind, {d.rows(d.array(field('00700006', 'ST', "CASE WHEN object_no % 3 = 2 THEN ' ' ELSE 'label of ' || tool_type END"), field('00700014', 'FL', "'3.5' || chr(92) || '0.5'"), field('00700004', 'CS', "CASE WHEN object_no % 5 = 4 THEN 'DISPLAY' ELSE 'PIXEL' END")))} AS x FROM gsps_layout"""
    return f"""{own(graphics)} UNION ALL {own(texts)}
UNION ALL SELECT file, '00700001/' || {number('annotation')} || '/' || (x).tag AS tag_path, right((x).tag, 8) AS tag, (x).vr AS vr, (x).value AS value FROM (SELECT file, annotation, {d.rows(layer)} AS x FROM (SELECT DISTINCT file, annotation FROM gsps_layout) a) b
UNION ALL SELECT file, (x).tag AS tag_path, right((x).tag, 8) AS tag, (x).vr AS vr, (x).value AS value FROM (SELECT file, {d.rows(state)} AS x FROM (SELECT DISTINCT file FROM gsps_layout) a) b"""


@view
def measurements(d: Dialect) -> str:
    """Measurements with any number of points, the spacing (null for none) and the size of their image."""
    t = d.text
    point = lambda x, y: d.struct(x=f"cast({x} AS double)", y=f"cast({y} AS double)")
    p = [point("x0", "y0"), point("x1", "y1"), point("x2", "y2"), point("y1", "x0")]
    return f"""SELECT measurement_id, series_id, slice_index, tool_type, CASE WHEN slice_index % 13 = 0 THEN {d.array(p[0])} WHEN tool_type IN ('curve', 'freeform') AND n % 2 = 0 THEN {d.array(*p)}
    WHEN tool_type IN ('angle', 'curve', 'freeform') THEN {d.array(*p[:3])} ELSE {d.array(*p[:2])} END AS points, scope,
  CASE WHEN n % 11 = 0 THEN NULL ELSE cast(0.5 * stretch AS double) END AS sx, CASE WHEN n % 11 = 0 THEN NULL ELSE cast(2.0 * stretch AS double) END AS sy, 8 AS image_width, 8 AS image_height, kind FROM (
  SELECT 'm' || cast(l_orderkey AS {t}) || '.' || cast(l_linenumber AS {t}) || '.' || cast(l_partkey AS {t}) || '.'
    || cast(cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS {t}) AS measurement_id,
  'S' || cast(l_suppkey % 10 AS {t}) AS series_id, cast(l_orderkey % 40 AS int) AS slice_index, l_orderkey AS n,
  CASE l_linenumber WHEN 1 THEN 'line' WHEN 2 THEN 'rect' WHEN 3 THEN 'ellipse' WHEN 4 THEN 'angle' WHEN 5 THEN 'curve' WHEN 6 THEN 'freeform'
    ELSE CASE WHEN l_partkey % 2 = 0 THEN 'alignment-horizontal' ELSE 'alignment-vertical' END END AS tool_type, CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS stretch,
  cast(l_partkey % 11 - 1 AS double) AS x0, cast(l_suppkey % 9 AS double) - cast(0.25 AS double) AS y0, cast(l_orderkey % 10 AS double) AS x1,
  cast((l_quantity * 7) % 9 AS double) AS y1, cast(l_partkey % 8 AS double) AS x2, cast(l_orderkey % 7 AS double) AS y2,
  CASE WHEN l_partkey % 2 = 0 THEN 'series' ELSE 'image' END AS scope, CASE WHEN l_partkey % 5 = 0 THEN 'mpr' ELSE 'stack' END AS kind
FROM lineitem) m"""


@view
def shown_slices(d: Dialect) -> str:
    """Slices that views show: every tenth of the first forty."""
    return "SELECT series_id, i FROM slices WHERE i < 40 AND i % 10 = 0"


@view
def circles(d: Dialect) -> str:
    """Five circles on every image of 8 x 8: centre, left, right, top, bottom, with the size of a pixel."""
    rows = "('center', 3.5, 3.5), ('left', 1.5, 3.5), ('right', 5.5, 3.5), ('top', 3.5, 1.5), ('bottom', 3.5, 5.5)"
    return f"""SELECT series_id, roi_id, cast(cx AS double) AS cx, cast(cy AS double) AS cy, cast(1.5 AS double) AS r FROM (SELECT DISTINCT series_id FROM slices) s
JOIN (SELECT * FROM (VALUES {rows}) v(roi_id, cx, cy)) c ON true"""


@view
def archive_members(d: Dialect) -> str:
    """Members of archives in listing order."""
    t = d.text
    return f"""SELECT l_suppkey AS archive_id, cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) AS bigint) AS ord,
  CASE WHEN l_quantity = 50 THEN '../x' WHEN l_quantity = 49 THEN 'a/b.txt' ELSE 'a/f' || cast(l_orderkey AS {t}) END AS member_name,
  cast(floor(l_extendedprice * 100 + 0.5) AS bigint) AS uncompressed, cast(floor(l_extendedprice / (1 + l_linenumber)) + 1 AS bigint) AS compressed,
  l_returnflag = 'A' AND l_quantity = 2 AS is_encrypted, l_returnflag = 'N' AND l_quantity = 2 AS is_symlink, cast(2000000 AS bigint) AS archive_size FROM lineitem"""


@view
def file_contents(d: Dialect) -> str:
    """Size and SHA-256 of the content of each file."""
    body = "photometric || '|' || series_description || '|' || sop_uid"
    return f"SELECT path AS file_path, cast(length({body}) AS bigint) AS content_size, {d.sha256(body)} AS content_sha256 FROM headers"


@view
def date_queries(d: Dialect) -> str:
    """Date bounds as users write them."""
    return "SELECT record_no AS query_no, CASE WHEN record_no % 3 = 0 THEN 'x' ELSE study_date END AS date_from, CASE WHEN record_no % 5 = 0 THEN '' ELSE substring(study_date, 1, 4) || '-12-31' END AS date_to FROM read_dicom_json"


@view
def edits(d: Dialect) -> str:
    """Values that users want to set, right and wrong ones, some of several values."""
    return """SELECT sop_uid, file, ord, vr, CASE WHEN odd AND ord = 2 THEN value || '9' WHEN odd AND ord = 3 THEN value || '-x' WHEN odd AND ord = 1 THEN value || chr(92) || '1.2..3' ELSE value END AS value FROM (SELECT *, right(sop_uid, 1) IN ('1', '3') AS odd FROM tags) a
UNION ALL SELECT sop_uid, file, 20 + ord AS ord, CASE ord WHEN 1 THEN 'TM' WHEN 2 THEN 'AS' WHEN 3 THEN 'IS' ELSE 'DS' END AS vr, CASE ord WHEN 1 THEN CASE WHEN right(sop_uid, 1) = '2' THEN '2561' ELSE '101530.25' END WHEN 2 THEN '045y' WHEN 3 THEN '3' || chr(92) || 'x' ELSE '1e400' END AS value FROM tags WHERE ord <= 4"""


@view
def requests(d: Dialect) -> str:
    """The log of viewing requests."""
    t = d.text
    return f"""SELECT event_id, ts, 'v' || cast(user_id AS {t}) AS view_id, 'ws' || cast(user_id % 5 AS {t}) AS workspace_id,
  event_type = 'purchase' AS is_final, event_id - cast(floor(value) AS bigint) % 7 AS render_revision,
  'i' || cast(cast(floor(event_id / 50) AS bigint) AS {t}) AS interaction_id, cast(floor(event_id / 50) AS bigint) AS interaction_no, CASE WHEN user_id % 3 > 0 THEN 'mpr-group:' || cast(user_id % 4 AS {t}) END AS view_group,
  CASE WHEN event_id % 97 <> 0 THEN {d.array(f"'c' || cast(event_id % 5 AS {t})", f"'c' || cast(user_id % 3 AS {t})")} END AS targets FROM events"""


@view
def stored_items(d: Dialect) -> str:
    """Uploads, cached archives and jobs with their last sight in seconds; archives of running jobs and jobs that have not ended are protected."""
    at = d.seconds("max(ts)")
    return f"""SELECT CASE cast(substring(view_id, 2) AS bigint) % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'cache' ELSE 'job' END AS kind, view_id AS item_id,
  {at} - cast(substring(view_id, 2) AS bigint) % 5 * 43200 AS seen, sum(CASE WHEN is_final THEN 1 ELSE 0 END) % 4 = 0 AS protected FROM requests GROUP BY view_id"""


@view
def pointers(d: Dialect) -> str:
    """Pointer positions over slices."""
    t = d.text
    return f"""SELECT event_id, 'S' || cast(user_id % 10 AS {t}) AS series_id, cast(event_id % 40 AS int) AS slice_index, value / 500 AS x,
  cast(event_id % 97 AS double) / 96 AS y, 64 AS canvas_width, 64 AS canvas_height FROM events"""


@view
def qido_records(d: Dialect) -> str:
    """Archive answers: one DICOM-JSON object a row."""
    t = d.text
    return f"""SELECT o_orderkey AS record_no, '{{{{"0020000D":{{{{"vr":"UI","Value":["1.2.5.' || cast(o_orderkey AS {t}) || '"]}}}},"00100010":{{{{"vr":"PN","Value":[{{{{"Alphabetic":"' || c_name
  || '"}}}}]}}}},"00080020":{{{{"vr":"DA","Value":["' || replace(substring(cast(o_orderdate AS {t}), 1, 10), '-', '') || '"]}}}},"00080061":{{{{"vr":"CS","Value":["CT","' || o_orderstatus
  || '"]}}}},"00201208":{{{{"vr":"IS","Value":[' || cast(o_orderkey % 90 AS {t}) || ']}}}},"00201206":{{{{"vr":"IS","Value":["' || cast(o_orderkey % 7 AS {t}) || '"]}}}},"00080030":{{{{"vr":"TM","Value":["10' || cast(10 + o_orderkey % 50 AS {t})
  || '"]}}}},"00091002":{{{{"vr":"LO","Value":["one","",null,"two"]}}}}}}}}' AS record FROM orders JOIN customer ON o_custkey = c_custkey""".replace("{{", "{{" if d.spark else "{").replace("}}", "}}" if d.spark else "}")


@operator
def presentation_references(d: Dialect) -> str:
    """Presentation state files and the SOP uids that each refers to: one image or two, some of another workspace."""
    t = d.text
    return f"""SELECT path AS state_path, workspace_id, '1.2.3.' || cast(file_no AS {t}) || '.' || cast(n AS {t}) AS ref_uid FROM (
  SELECT path, workspace_id, file_no, {d.rows(d.span('1', '1 + file_no % 2'))} AS n FROM keyed_headers WHERE object_type = 'DICOM_GSPS') s"""


@operator
def registry_before(d: Dialect) -> str:
    """Series registered before: those whose number of instances is no multiple of three."""
    return f"SELECT workspace_id, series_key, 'old-' || substring({d.sha256('series_key')}, 1, 8) AS series_id FROM group_series WHERE instance_count % 3 <> 0"


@view
def registry_paths(d: Dialect) -> str:
    """Instance paths of series that were registered under another key."""
    return f"SELECT workspace_id, path, 'path-' || substring({d.sha256('series_key')}, 1, 8) AS series_id FROM dedupe_instances WHERE file_no % 40 = 0"


@view
def tags(d: Dialect) -> str:
    """One row per data element: path, tag, VR and value."""
    one = lambda o, path, tag, kw, vr, value, depth: d.struct(ord=f"cast({o} AS bigint)", tag_path=f"'{path}'", tag=f"'{tag}'", keyword=f"'{kw}'", vr=f"'{vr}'", value=value, depth=str(depth))
    rows = [
        one(1, "00080018", "00080018", "SOPInstanceUID", "UI", "sop_uid", 0),
        one(2, "00080020", "00080020", "StudyDate", "DA", f"replace(substring(cast(o_orderdate AS {d.text}), 1, 10), '-', '')", 0),
        one(3, "00080060", "00080060", "Modality", "CS", "modality", 0),
        one(4, "0008103E", "0008103E", "SeriesDescription", "LO", "series_description", 0),
        one(5, "00081140/0/00081155", "00081155", "ReferencedSOPInstanceUID", "UI", "sop_uid", 2),
        one(6, "00100010", "00100010", "PatientName", "PN", "c_name", 0),
        one(7, "00110010", "00110010", "", "LO", "'PRIVATE'", 0),
        one(8, "00111001", "00111001", "", "LO", "c_name", 0),
        one(9, "0020000D", "0020000D", "StudyInstanceUID", "UI", "study_uid", 0),
        one(10, "0020000E", "0020000E", "SeriesInstanceUID", "UI", "series_uid", 0),
    ]
    columns = ", ".join(f"(x).{c} AS {c}" for c in ("ord", "tag_path", "tag", "keyword", "vr", "value", "depth"))
    if d.spark:  # customers meet orders first; headers that are not given are made after the join, so that keys and numbers are moved and not their texts
        more = ("JOIN (SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON c_custkey = o_custkey) o ON o_orderkey", ", o_orderdate, c_name")
        source = f"headers {more[0]} = file_no" if "headers" in d.given else f"({REGISTRY['headers'].build(d).removesuffix('FROM lineitem')}{more[1]} FROM lineitem {more[0]} = l_orderkey) h"
        return f"SELECT sop_uid, file, series_uid, study_uid, {columns} FROM (SELECT sop_uid, path AS file, series_uid, study_uid, {d.rows(d.array(*rows))} AS x FROM {source}) w"
    return f"""SELECT sop_uid, file, series_uid, study_uid, {columns} FROM (SELECT sop_uid, path AS file, series_uid, study_uid, {d.rows(d.array(*rows))} AS x
FROM headers JOIN orders ON o_orderkey = file_no JOIN customer ON c_custkey = o_custkey) w"""


@view
def background_jobs(d: Dialect) -> str:
    """A job for each archive: its members, those that are through, and its state."""
    return f"""SELECT archive_id AS job_id, count(*) - CASE WHEN archive_id % 5 = 0 THEN count(*) + 1 ELSE 0 END AS total, count(CASE WHEN status <> 'skipped' THEN 1 END) + CASE WHEN archive_id % 7 = 0 THEN 50 ELSE 0 END AS processed,
  CASE archive_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' ELSE 'running' END AS status FROM screen_archive_members GROUP BY archive_id"""
