"""PET and CT: pairs, units, decay, display values, resampling and fusion; names of presets."""

from __future__ import annotations

import re

from voxtab.operators.volumes import XYZ, grid, index, sampled, world
from voxtab.plans.statement import Dialect, operator, quote, view

#: Aliases of display units; fixed values.
UNITS = {"raw": "source", "source": "source", "BQML": "source", "kBq/ml": "kBq/ml", "kBqml": "kBq/ml", "uptake": "kBq/ml", "SUV": "SUVbw", "SUVbw": "SUVbw", "GML": "SUVbw", "SUVbsa": "SUVbsa", "SUL": "SUL", "%ID/g": "%ID/g", "percentIDg": "%ID/g"}

#: Volume presets, and their names that are not spellings of these; fixed values.
VOLUME_PRESETS = ("bone", "aaa", "red", "cardiac", "muscle", "mip", "xray", "carotid", "bonePlusPlate", "fracture", "lumbar", "hardware", "lung", "lung2", "lung3", "renalsStomach", "vesselOutline", "bones", "coronaryCta", "bodyCta", "neckCta", "mrDefault", "mrMip", "mrAngio", "cbctRealist", "cbctBone", "cbctBone2")
SYNONYMS = {"volume": "bone", "ct-bone": "bone", "cardiac-muscle": "cardiac", "x-ray": "xray", "boneplate": "bonePlusPlate", "spine": "lumbar", "metal": "hardware", "implant": "hardware", "renal-stomach": "renalsStomach", "mra": "mrAngio"}


@view
def preset_texts(d: Dialect) -> str:
    """What users wrote for presets: names of the selected ones in other spellings."""
    return "SELECT 'volume:' || preset AS preset_text FROM select_preset UNION ALL SELECT upper(preset) AS preset_text FROM select_preset UNION ALL SELECT 'x ray' AS preset_text FROM select_preset UNION ALL SELECT ' Bone_Plus plate ' AS preset_text FROM select_preset"


@view
def pet_headers(d: Dialect) -> str:
    """PET series with what their scale needs."""
    return """SELECT series_id, label, CASE label WHEN 7 THEN 'GML' WHEN 9 THEN '' ELSE 'BQML' END AS units, cast(70 AS double) AS weight_kg, cast(1.75 AS double) AS size_m, CASE WHEN label % 4 = 1 THEN 'F' ELSE 'M' END AS sex,
  CASE WHEN label = 5 THEN NULL ELSE cast(350000000 AS double) END AS dose, CASE WHEN label = 9 THEN NULL ELSE cast(6586.2 AS double) END AS half_life, '2024-01-02' AS scan_date, CASE label WHEN 7 THEN '1015' ELSE '10:15:00' END AS scan_time,
  CASE label WHEN 1 THEN '101500' WHEN 3 THEN 'soon' ELSE '09' || '3000.5' END AS injection_time, CASE label WHEN 7 THEN 'DECY ATTN' ELSE 'ATTN DECY' END AS corrected_image, CASE label WHEN 1 THEN 'ADMIN' ELSE 'START' END AS decay_correction
FROM image_series WHERE modality = 'PT'"""


@operator
def pair_pet_ct(d: Dialect) -> str:
    """CT and PET series of the same study."""
    return "SELECT c.series_id AS ct_id, p.series_id AS pet_id, c.study_uid FROM image_series c JOIN image_series p ON p.study_uid = c.study_uid AND c.modality = 'CT' AND p.modality IN ('PT', 'PET')"


def clock(d: Dialect, day: str, time: str) -> str:
    """Seconds of a date and a time text (blanks, dashes and colons dropped): HHMMSS with or without a fraction, HHMM, or the date alone without a time; null for others."""
    digits = lambda x: d.swap(f"coalesce({x}, '')", "[ :-]", "")
    t = digits(time)
    whole = d.seconds(d.moment(f"{digits(day)} || substring({t}, 1, 6)", "yyyyMMddHHmmss", "%Y%m%d%H%M%S"))
    short = d.seconds(d.moment(f"{digits(day)} || {t} || '00'", "yyyyMMddHHmmss", "%Y%m%d%H%M%S"))
    alone = d.seconds(d.moment(f"{digits(day)} || '000000'", "yyyyMMddHHmmss", "%Y%m%d%H%M%S"))
    part = f"coalesce(try_cast(nullif(regexp_extract({t}, '([.][0-9]+)$', 1), '') AS double), 0)"
    return f"CASE WHEN {d.matches(t, '^[0-9][0-9][0-9][0-9][0-9][0-9]([.][0-9]+)?$')} THEN {whole} + {part} WHEN {d.matches(t, '^[0-9][0-9][0-9][0-9]$')} THEN {short} WHEN {t} = '' THEN {alone} END"


@operator
def parse_dicom_datetime(d: Dialect) -> str:
    """Seconds of date and time texts; none where they are no date."""
    return f"SELECT series_id, {clock(d, 'scan_date', 'injection_time')} AS injected_s, {clock(d, 'scan_date', 'scan_time')} AS scanned_s FROM pet_headers"


@operator
def format_dicom_date_time(d: Dialect) -> str:
    """Dates of eight digits as YYYY.MM.DD and times of six or more as HH:MM:SS, others as they are."""
    digits = lambda x: d.swap(x, "[^0-9]", "")
    day, t = digits("scan_date"), digits("injection_time")
    return f"""SELECT series_id, CASE WHEN length({day}) = 8 THEN substring({day}, 1, 4) || '.' || substring({day}, 5, 2) || '.' || substring({day}, 7, 2) ELSE scan_date END AS date_text,
  CASE WHEN length({t}) >= 6 THEN substring({t}, 1, 2) || ':' || substring({t}, 3, 2) || ':' || substring({t}, 5, 2) ELSE injection_time END AS time_text FROM pet_headers"""


@operator
def pet_decay_dose(d: Dialect) -> str:
    """Injected dose decayed to the scan, where the image is decay-corrected to its start (or not stated otherwise) and half-life and both times are known; else the dose itself."""
    return """SELECT h.series_id, round(CASE WHEN upper(corrected_image) LIKE '%DECY%' AND upper(decay_correction) IN ('START', 'NONE') AND half_life > 0 AND scanned_s IS NOT NULL AND injected_s IS NOT NULL
  THEN dose * exp(-ln(2) * greatest(0, scanned_s - injected_s) / half_life) ELSE dose END, 2) AS dose FROM pet_headers h JOIN parse_dicom_datetime t ON t.series_id = h.series_id WHERE dose > 0"""


@operator
def pet_unit(d: Dialect) -> str:
    """Display unit that each alias names."""
    return f"SELECT DISTINCT units, CASE units {' '.join(f'''WHEN '{a}' THEN '{u}' ''' for a, u in UNITS.items())} ELSE 'SUVbw' END AS unit FROM pet_headers"


@operator
def pet_scale(d: Dialect) -> str:
    """Factor from stored to displayed values of each series and unit; missing data leave the source as it is."""
    lbm = "CASE WHEN sex = 'F' THEN 1.07 * weight_kg - 148 * power(weight_kg / (size_m * 100), 2) ELSE 1.10 * weight_kg - 128 * power(weight_kg / (size_m * 100), 2) END"
    return f"""SELECT series_id, unit, CASE WHEN unit = 'source' THEN 1 WHEN unit = 'kBq/ml' THEN CASE WHEN units = 'BQML' THEN 0.001 ELSE 1 END WHEN units = 'GML' AND unit = 'SUVbw' THEN 1 WHEN units <> 'BQML' OR dose IS NULL THEN 1
  WHEN unit = 'SUVbw' THEN round(weight_kg * 1000 / dose, 12) WHEN unit = 'SUVbsa' THEN round(0.007184 * power(size_m * 100, 0.725) * power(weight_kg, 0.425) * 10000 / dose, 12)
  WHEN unit = 'SUL' THEN round(({lbm}) * 1000 / dose, 12) ELSE round(100 / dose, 12) END AS factor
FROM (SELECT h.series_id, units, weight_kg, size_m, sex, p.dose FROM pet_headers h LEFT JOIN pet_decay_dose p ON p.series_id = h.series_id) q
JOIN (SELECT * FROM (VALUES ('source'), ('kBq/ml'), ('SUVbw'), ('SUVbsa'), ('SUL'), ('%ID/g')) v(unit)) u ON true""".replace("THEN 1 ", "THEN cast(1 AS double) ").replace("0.001", "cast(0.001 AS double)")


@operator
def pet_display(d: Dialect, unit: str = "SUVbw") -> str:
    """PET voxels in a display unit."""
    return f"SELECT v.series_id, i, j, k, CASE WHEN abs(factor - 1) < 1e-9 THEN value ELSE value * factor END AS value FROM voxels v JOIN pet_scale s ON s.series_id = v.series_id AND s.unit = {quote(unit)}"


@operator
def nearest_pet_slice(d: Dialect) -> str:
    """PET slice nearest the centre of each CT slice: clamped, half-even."""
    half = lambda n: f"({n} - 1) / cast(2 AS double)"
    centre = ", ".join(f"{world('c.i', half('nj'), half('nk'), x)} AS {x}" for x in XYZ)
    return f"""SELECT ct_id, ct_slice, pet_id, cast(coalesce(least(greatest({d.even('round(' + index('di', 'x', 'y', 'z') + ', 9)')}, 0), depth - 1), 0) AS int) AS pet_slice FROM (
  SELECT c.series_id, c.i AS ct_slice, {centre} FROM slices c JOIN geometry g ON g.series_id = c.series_id) q JOIN pair_pet_ct ON ct_id = series_id JOIN geometry p ON p.series_id = pet_id"""


@operator
def register_plane(d: Dialect) -> str:
    """The plane of every CT slice, turned about its normal by the registration of its pair and moved along its own columns and rows."""
    half = lambda n: f"({n} - 1) / cast(2 AS double)"
    centre = ", ".join(f"{world('c.i', half('nj'), half('nk'), x)} AS c{x}" for x in XYZ)
    unit = ", ".join(f"k{x} / sk AS u{x}, j{x} / sj AS v{x}" for x in XYZ)
    turned = ", ".join(f"round(u{x} * cos(radians(rotation)) + v{x} * sin(radians(rotation)), 9) AS u{x}, round(v{x} * cos(radians(rotation)) - u{x} * sin(radians(rotation)), 9) AS v{x}" for x in XYZ)
    moved = ", ".join(f"round(c{x} + shift_u * u{x} + shift_v * v{x}, 6) AS c{x}" for x in XYZ)
    return f"""SELECT r.ct_id, r.pet_id, ct_slice, {moved}, {turned}, sk AS step_u, sj AS step_v, nk AS width, nj AS height FROM (
  SELECT c.series_id, c.i AS ct_slice, {centre}, {unit}, sk, sj, nk, nj FROM slices c JOIN geometry g ON g.series_id = c.series_id JOIN spacings s ON s.series_id = c.series_id) q JOIN registrations r ON r.ct_id = q.series_id"""


@operator
def resample_pet_to_ct(d: Dialect) -> str:
    """Registered PET on the CT's grid: linear between the eight voxels around each place, as shown (times its factor)."""
    planes = "(SELECT *, 1 AS step FROM register_plane) z"
    at = grid(d, planes).replace("* step * u", "* step_u * u").replace("* step * v", "* step_v * v")
    places = f"SELECT pet_id AS series_id, ct_id, ct_slice, cast(r AS int) AS j, cast(c AS int) AS k, x, y, z FROM ({at}) g"
    return f"""SELECT s.ct_id, s.series_id AS pet_id, s.ct_slice, s.j, s.k, round(s.value * f.factor, 9) AS value FROM ({sampled(d, places, 'ct_id, ct_slice, j, k', 1, 'nearest', 0.0)}) s
JOIN registrations r ON r.ct_id = s.ct_id AND r.pet_id = s.series_id JOIN pet_scale f ON f.series_id = s.series_id AND f.unit = r.unit"""


@operator
def fuse_pet_ct(d: Dialect, preset: str = "petct-rainbow") -> str:
    """CT gray and PET colour blended by alpha times how high the PET value is in its range."""
    mix = lambda c: f"cast(floor(least(greatest(w.gray * (1 - a) + {c} * a, 0), 255)) AS int) AS {c}"
    return f"""SELECT p.ct_id, p.pet_id, p.ct_slice, p.j, p.k, {mix('r')}, {mix('g')}, {mix('b')} FROM (
  SELECT s.*, round(alpha * level / 255.0, 6) AS a FROM (SELECT q.*, alpha, cast(floor(255 * least(greatest((value - low) / CASE WHEN high > low THEN high - low ELSE 1 END, 0), 1) + 1e-6) AS int) AS level FROM resample_pet_to_ct q JOIN registrations r ON r.ct_id = q.ct_id AND r.pet_id = q.pet_id) s) p
JOIN window_to_uint8 w ON w.series_id = p.ct_id AND w.i = p.ct_slice AND w.j = p.j AND w.k = p.k JOIN colour_table t ON t.preset = {quote(preset)} AND t.gray = p.level"""


@operator
def derived_headers(d: Dialect) -> str:
    """Headers of the resampled series: number 1000 above the PET's (1000 if that is none), instance, position of the first pixel, orientation, spacing, place along the normal and units."""
    number = lambda e: f"substring({d.format('%.6f', e)}, 1, 16)"
    corner = ", ".join(f"{number(f'cast(c{x} - (width - 1) / cast(2 AS double) * step_u * u{x} - (height - 1) / cast(2 AS double) * step_v * v{x} AS double) + 0')} AS position_{x}" for x in XYZ)
    facing = " || chr(92) || ".join(number(f"{a}{x} + 0") for a in "uv" for x in XYZ)
    along = " + ".join(f"c{x} * ({v})" for x, v in zip(XYZ, ("uy * vz - uz * vy", "uz * vx - ux * vz", "ux * vy - uy * vx"), strict=True))
    return f"""SELECT p.ct_id, p.pet_id, 1000 + CASE WHEN h.label > 5 THEN h.label ELSE 0 END AS series_number, row_number() OVER (PARTITION BY p.ct_id, p.pet_id ORDER BY ct_slice) AS instance_number, {corner}, {facing} AS orientation,
  {number('step_v')} || chr(92) || {number('step_u')} AS pixel_spacing, {number(f'cast({along} AS double) + 0')} AS slice_location, CASE WHEN r.unit = 'SUVbw' THEN 'GML' WHEN r.unit = 'source' THEN h.units ELSE 'CNTS' END AS units
FROM register_plane p JOIN registrations r ON r.ct_id = p.ct_id AND r.pet_id = p.pet_id JOIN pet_headers h ON h.series_id = p.pet_id"""


@operator
def canvas_affine(d: Dialect, canvas: tuple[int, int] = (64, 64), zoom: float | None = None, rotation: float = 0.0, flip_x: bool = False, flip_y: bool = False, pan: tuple[float, float] = (0.0, 0.0), zooms: tuple[float, float] = (0.1, 20.0)) -> str:
    """Affine map (x, y) -> (a x + c y + e, b x + d y + f) from image to canvas of each series: centre, flip, zoom and aspect of the pixels, rotation by quarter turns, pan. Without a zoom the image fits the canvas."""
    turn = int(round(rotation / 90.0) * 90) % 360
    cos, sin = {0: (1, 0), 90: (0, 1), 180: (-1, 0), 270: (0, -1)}[turn]
    fit = f"least({canvas[0]} / (columns_ * ax), {canvas[1]} / (rows_ * ay))" if zoom is None else quote(float(zoom))
    scale = f"least(greatest({fit}, {quote(zooms[0])}), {quote(zooms[1])})"
    return f"""SELECT series_id, rows_, columns_, round({cos} * x, 9) AS a, round({sin} * x, 9) AS b, round(-({sin}) * y, 9) AS c, round({cos} * y, 9) AS d,
  round({canvas[0] / 2 + pan[0]} - {cos} * x * columns_ / 2 + {sin} * y * rows_ / 2, 9) AS e, round({canvas[1] / 2 + pan[1]} - {sin} * x * columns_ / 2 - {cos} * y * rows_ / 2, 9) AS f FROM (
  SELECT *, {'-1' if flip_x else '1'} * z * ax AS x, {'-1' if flip_y else '1'} * z * ay AS y FROM (SELECT *, {scale} AS z FROM (
    SELECT g.series_id, nj AS rows_, nk AS columns_, greatest(sk / least(sk, sj), 1e-3) AS ax, greatest(sj / least(sk, sj), 1e-3) AS ay FROM geometry g JOIN spacings s ON s.series_id = g.series_id) a) b) w"""


def preset_aliases() -> dict[str, str]:
    """Every spelling of a preset: its name in lower case, with dashes before capitals and numbers, and the fixed synonyms."""
    out = dict(SYNONYMS)
    for name in VOLUME_PRESETS:
        dashed = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()
        out |= {name.lower(): name, dashed: name, re.sub(r"(?<=[a-z])(?=[0-9])", "-", dashed): name}
    return out


@operator
def normalize_preset(d: Dialect) -> str:
    """Name of the preset that each text means: cut after a colon, blanks and underscores as dashes, aliases; ``bone`` for unknown ones."""
    cases = " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in preset_aliases().items())
    return f"""SELECT DISTINCT preset_text, CASE {d.swap("regexp_replace(lower(trim(preset_text)), '^[^:]*:', '')", '[_ ]', '-')} {cases} ELSE 'bone' END AS preset FROM preset_texts"""
