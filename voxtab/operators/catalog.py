"""From file headers to series: candidates, classes, grouping, numbering, 4D phases and compatibility."""

from __future__ import annotations

import re

from voxtab.plans.statement import Dialect, operator, quote, view

#: File suffixes that are never scanned; fixed values.
DENIED = (".7z", ".bz2", ".csv", ".db", ".gz", ".html", ".htm", ".json", ".log", ".md", ".pdf", ".rar", ".tar", ".tgz", ".txt", ".webp", ".xml", ".xz", ".yaml", ".yml", ".zip", ".zst")
#: SOP classes of structured reports and key objects, and of presentation states; fixed values.
SR_CLASSES = ("1.2.840.10008.5.1.4.1.1.88.11", "1.2.840.10008.5.1.4.1.1.88.22", "1.2.840.10008.5.1.4.1.1.88.33", "1.2.840.10008.5.1.4.1.1.88.34", "1.2.840.10008.5.1.4.1.1.88.35", "1.2.840.10008.5.1.4.1.1.88.40", "1.2.840.10008.5.1.4.1.1.88.50", "1.2.840.10008.5.1.4.1.1.88.59")
GSPS_CLASS = "1.2.840.10008.5.1.4.1.1.11.1"
#: Photometric interpretations that are shown as they are; fixed values.
PLAIN_PHOTOMETRIC = ("MONOCHROME1", "MONOCHROME2")
#: Transfer syntaxes: (uid, name, compressed); fixed values.
SYNTAXES = (
    ("1.2.840.10008.1.2", "Implicit VR Little Endian", False),
    ("1.2.840.10008.1.2.1", "Explicit VR Little Endian", False),
    ("1.2.840.10008.1.2.1.99", "Deflated Explicit VR Little Endian", False),
    ("1.2.840.10008.1.2.2", "Explicit VR Big Endian", False),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline (Process 1)", True),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended (Process 2 and 4)", True),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless, Non-Hierarchical (Process 14)", True),
    ("1.2.840.10008.1.2.4.70", "JPEG Lossless, Non-Hierarchical, First-Order Prediction", True),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless Image Compression", True),
    ("1.2.840.10008.1.2.4.81", "JPEG-LS Lossy (Near-Lossless) Image Compression", True),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Image Compression (Lossless Only)", True),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000 Image Compression", True),
    ("1.2.840.10008.1.2.5", "RLE Lossless", True),
)


def stem(d: Dialect, path: str) -> str:
    if d.spark:  # the pattern below begins anew at every character
        return f"regexp_replace(substring_index({path}, '/', -1), '[.][^./]*$', '')"
    return f"regexp_extract({path}, '([^/]*?)([.][^./]*)?$', 1)"


def parent(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


#: Phases in texts: a percentage, ``phase N``, ``pN``; the number is group 2, 3 and 2, what follows a word group 7, 5 and 3.
PERCENT = "(^|[^0-9])(100([.]0+)?|[0-9][0-9]?([.][0-9]+)?)[ _-]*(%|％|﹪|(pct|percent)($|[^a-z0-9_]))"
NAMED = "(^|[^a-z0-9])(phase|ph)[ _:#-]*([0-9][0-9]?[0-9]?([.][0-9]+)?)($|[^a-z0-9])"
SHORT = "(^|[^a-z0-9])p[ _-]*([0-9][0-9]?[0-9]?)($|[^a-z0-9])"
#: Header tags that give a phase, in order, with their unit; fixed values.
PHASE_TAGS = (
    ("nominal_percentage_of_respiratory_phase", "NominalPercentageOfRespiratoryPhase", "%"),
    ("actual_respiratory_phase", "ActualRespiratoryPhase", "%"),
    ("respiratory_phase", "RespiratoryPhase", "%"),
    ("temporal_position_identifier", "TemporalPositionIdentifier", ""),
    ("trigger_time", "TriggerTime", "ms"),
    ("nominal_respiratory_trigger_delay_time", "NominalRespiratoryTriggerDelayTime", "ms"),
    ("respiratory_trigger_delay_threshold", "RespiratoryTriggerDelayThreshold", "ms"),
)


def phase_value(d: Dialect, text: str) -> str:
    """Phase number in a text: a percentage, then ``phase N``, then ``pN``; null without one."""
    lower = f"lower({text})"
    found = f"coalesce(nullif(regexp_extract({lower}, '{PERCENT}', 2), '') || '%', nullif(regexp_extract({lower}, '{NAMED}', 3), ''), nullif(regexp_extract({lower}, '{SHORT}', 2), ''))"
    return f"CASE WHEN {d.matches(text, '[pP%％﹪]')} THEN {found} END"  # every pattern has one of these


def group_text(d: Dialect, text: str) -> str:
    """A text without its phases, for grouping: words of letters and digits. Words that share a blank need a second turn."""
    out = d.swap_around(f"lower({text})", PERCENT, 1, 7)
    for pattern, after in ((NAMED, 5), (NAMED, 5), (SHORT, 3), (SHORT, 3)):
        out = d.swap_around(out, pattern, 1, after)
    return f"trim({d.swap(out, '[^a-z0-9]+', ' ')})"


def number_in(d: Dialect, text: str) -> str:
    """First value of a text as a finite number, else the first number in it."""
    first = f"trim({d.at(d.parts(text), 0)})"
    whole = f"try_cast({first} AS double)"
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN abs({whole}) < 1e300 THEN {whole} WHEN {whole} IS NOT NULL THEN NULL ELSE try_cast(nullif(regexp_extract({first}, '[-+]?[0-9]+([.][0-9]+)?', 0), '') AS double) END"


def label_of(d: Dialect, value: str, unit: str) -> str:
    """Label of a phase: whole numbers plain, others with two places at most; two digits where there is no unit."""
    whole = f"cast(cast(round({value}) AS bigint) AS {d.text})"
    text = f"CASE WHEN abs({value} - round({value})) < 1e-6 THEN {whole} ELSE regexp_replace({d.format('%.2f', d.even(value, 2))}, '[.]?0+$', '') END"
    return f"'Phase ' || CASE WHEN {unit} = '' AND abs({value} - round({value})) < 1e-6 AND length({whole}) = 1 THEN '0' ELSE '' END || {text} || {unit}"


def object_type(d: Dialect) -> str:
    """Class of a header's object: presentation states first, then reports, then images; null for others."""
    reports = ", ".join(f"'{c}'" for c in SR_CLASSES)
    return f"""CASE WHEN sop_class_uid = '{GSPS_CLASS}' OR modality = 'PR' THEN 'DICOM_GSPS' WHEN sop_class_uid IN ({reports}) OR modality = 'SR' THEN 'DICOM_SR' WHEN coalesce(rows_, 0) > 0 AND coalesce(columns_, 0) > 0 THEN 'IMAGE' END"""


def syntaxes(d: Dialect) -> str:
    """The known transfer syntaxes as a table."""
    rows = ", ".join(f"('{u}', '{n}', {'true' if c else 'false'})" for u, n, c in SYNTAXES)
    return f"(SELECT * FROM (VALUES {rows}) v(uid, syntax_name, compressed))"


def candidate(d: Dialect) -> str:
    """Whether a file may be an image: no hidden or __MACOSX part, no denied suffix."""
    denied = ", ".join(f"'{x}'" for x in DENIED)
    return f"NOT {d.matches('path', '(^|/)([.]|__MACOSX(/|$))')} AND lower(regexp_extract(path, '([.][^./]*)$', 1)) NOT IN ({denied})"


@operator
def scan_candidates(d: Dialect) -> str:
    """Files that may be images: no hidden or __MACOSX part, no denied suffix; ``sort_key`` orders them by path components."""
    return f"SELECT path, replace(path, '/', chr(1)) AS sort_key FROM headers WHERE {candidate(d)}"


@operator
def classify_objects(d: Dialect) -> str:
    """Presentation states first, then reports, then images; other objects go."""
    return f"SELECT * FROM (SELECT path, sop_uid, modality, {object_type(d)} AS object_type FROM headers) q WHERE object_type IS NOT NULL"


@operator
def coerce_headers(d: Dialect) -> str:
    """Header texts as values: texts stripped to null, positive whole numbers (cut, not rounded), whether a value is there, and the first two numbers of a spacing, between backslashes or blanks, if both are numbers."""
    whole = lambda c: f"CASE WHEN try_cast(trim({c}) AS double) >= 1 AND try_cast(trim({c}) AS double) < 1e18 THEN cast(floor(try_cast(trim({c}) AS double)) AS bigint) END"
    parts = d.keep(d.cut("replace(coalesce(pixel_spacing, ''), chr(92), ' ')", " "), "x", "x <> ''")
    number = lambda n: f"try_cast({d.at('parts', n)} AS double)"
    pair = lambda n: f"CASE WHEN {number(0)} IS NOT NULL AND {number(1)} IS NOT NULL THEN {number(n)} END"
    return f"""SELECT path, nullif(trim(series_description), '') AS series_description, {whole('series_number')} AS positive_number, coalesce(trim(series_number), '') <> '' AS has_number,
  {whole('rows_')} AS rows_valid, {whole('columns_')} AS columns_valid, {pair(0)} AS row_spacing, {pair(1)} AS column_spacing FROM (SELECT *, {parts} AS parts FROM header_texts) t"""


@operator
def transfer_syntax_flags(d: Dialect) -> str:
    """Name of the transfer syntax and whether it is compressed; unknown ones are not."""
    return f"""SELECT path, coalesce(transfer_syntax_uid, '') AS uid, coalesce(syntax_name, transfer_syntax_uid, '') AS syntax_name, coalesce(compressed, false) AS compressed
FROM headers LEFT JOIN {syntaxes(d)} s ON s.uid = transfer_syntax_uid"""


@operator
def keyed_headers(d: Dialect) -> str:
    """Candidates of any class with their series key."""
    # The phase is a row of its own generator, so that its nine patterns are run once and not wherever the key is used.
    description, folder = phase_value(d, "series_description"), phase_value(d, "replace(folder, '/', ' ')")
    file = phase_value(d, "stem_")
    return f"""SELECT *, CASE WHEN series_uid IS NOT NULL AND series_uid <> '' THEN 'uid=' || series_uid || CASE WHEN folder <> '' THEN '::dir=' || folder ELSE '' END
    || CASE WHEN phase IS NOT NULL THEN '::phase=' || phase ELSE '' END ELSE 'path::' || {parent('path')} END AS series_key
FROM (SELECT *, {d.rows(d.array(f'coalesce({description}, {folder}, {file})'))} AS phase FROM (
  SELECT *, regexp_extract({parent('path')}, '^/data/?(.*)$', 1) AS folder, {stem(d, 'path')} AS stem_,
    {object_type(d)} AS object_type
  FROM headers WHERE {candidate(d)}) p) q WHERE object_type IS NOT NULL"""


@operator
def dedupe_instances(d: Dialect) -> str:
    """Within a series the first file by path of each SOP uid."""
    return """SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY workspace_id, object_type, series_key, coalesce(sop_uid, path) ORDER BY path) AS bigint) AS copy_no
FROM keyed_headers) q WHERE copy_no = 1 AND object_type = 'IMAGE'"""


@operator
def instance_numbers(d: Dialect) -> str:
    """Instance number: the text's number, else the place in path order; and the 0-based slice index in number order."""
    return f"""SELECT *, cast(row_number() OVER (PARTITION BY workspace_id, series_key ORDER BY instance_number, path_place) - 1 AS bigint) AS slice_index
FROM (SELECT *, coalesce(number_, path_place) AS instance_number FROM (
  SELECT workspace_id, series_key, path, sop_uid, rows_, columns_, instance_number_text, position_z, number_of_frames, photometric, transfer_syntax_uid, modality,
    pixel_spacing, has_position, has_rescale_slope, study_uid, series_uid, series_description, phase, position_x, position_y, rx, ry, rz, cx, cy, cz, slice_thickness,
    {', '.join(c for c, *_ in PHASE_TAGS)},
    CASE WHEN abs(try_cast(trim(instance_number_text) AS double)) < 1e15 THEN cast(CASE WHEN try_cast(trim(instance_number_text) AS double) < 0
      THEN ceil(try_cast(trim(instance_number_text) AS double)) ELSE floor(try_cast(trim(instance_number_text) AS double)) END AS bigint) END AS number_,
    cast(row_number() OVER (PARTITION BY workspace_id, series_key ORDER BY path) AS bigint) AS path_place FROM dedupe_instances) p) q"""


@operator
def slice_index(d: Dialect) -> str:
    """Place of each instance in its series."""
    return "SELECT series_key, path, instance_number, slice_index FROM instance_numbers"


@operator
def group_series(d: Dialect) -> str:
    """One row per series, one aggregation; its attributes come from the first file in path order, copies of an instance count once."""
    first = ", ".join(f"{d.first_by(c, 'path')} AS {c}" for c in ("series_uid", "study_uid", "modality", "series_description"))
    return f"""SELECT workspace_id, series_key, substring({d.sha256("workspace_id || '|' || series_key")}, 1, 16) AS series_id, series_uid, study_uid, CASE WHEN object_type = 'DICOM_SR' THEN coalesce(modality, 'SR') ELSE modality END AS modality,
  CASE WHEN object_type = 'DICOM_SR' THEN coalesce(series_description, 'Structured Report') ELSE series_description END AS series_description,
  object_type = 'IMAGE' AS is_image_series, object_type AS standard_object_type, CASE object_type WHEN 'IMAGE' THEN 'Stack' ELSE 'Tag' END AS preferred_view_type, instance_count
FROM (SELECT workspace_id, object_type, series_key, {first}, count(DISTINCT coalesce(sop_uid, path)) AS instance_count FROM keyed_headers GROUP BY workspace_id, object_type, series_key) q"""


@operator
def series_summary(d: Dialect) -> str:
    """Count and first size of each image series, and its phases: those of the group of series that it belongs to, else those of its own instances. One pass over instances, windows over series only."""
    first = lambda c: f"max(CASE WHEN slice_index = 0 THEN {c} END)"
    header = f"coalesce({', '.join(number_in(d, c) for c, *_ in PHASE_TAGS)})"
    return f"""SELECT substring({d.sha256("workspace_id || '|' || series_key")}, 1, 16) AS series_id, workspace_id, series_key, max(instance_count) AS instance_count, max(width) AS width, max(height) AS height, true AS is_image_series, bool_or(phase IS NOT NULL) AS has_phase,
  coalesce(max(CASE WHEN chosen AND phases >= 2 THEN phases END), max(own_phases), 0) >= 2 AS is_four_d, coalesce(max(CASE WHEN chosen AND phases >= 2 THEN phases END), max(CASE WHEN own_phases >= 2 THEN own_phases END), 0) AS phase_count FROM (
  SELECT *, count(CASE WHEN chosen THEN 1 END) OVER (PARTITION BY workspace_id, coalesce(group_key, series_key)) AS phases FROM (
    SELECT *, group_key IS NOT NULL AND row_number() OVER (PARTITION BY workspace_id, coalesce(group_key, series_key), sort_value ORDER BY series_key) = 1 AS chosen FROM (
      SELECT *, {d.rows(f'CASE WHEN phase IS NOT NULL THEN {group_keys(d)} ELSE {d.array(f"cast(NULL AS {d.text})")} END')} AS group_key, cast(replace(phase, '%', '') AS double) AS sort_value FROM (
        SELECT workspace_id, series_key, count(*) AS instance_count, {first('cast(columns_ AS bigint)')} AS width, {first('cast(rows_ AS bigint)')} AS height, max(phase) AS phase, count(DISTINCT own_phase) AS own_phases,
          {', '.join(f'{first(c)} AS {c}' for c in ('study_uid', 'modality', 'series_description', 'rows_', 'columns_', 'path'))}
        FROM (SELECT *, {header} AS own_phase FROM instance_numbers) n GROUP BY workspace_id, series_key) a) b) c) e
GROUP BY workspace_id, series_key"""


@operator
def compatibility_audit(d: Dialect) -> str:
    """Issues of each image series with their severity, number of affected instances and, for syntaxes and photometrics, the first three names; none for zero. One aggregation, then a row for each issue."""
    plain = ", ".join(f"'{p}'" for p in PLAIN_PHOTOMETRIC)
    codes = (
        ("missing-image-size", "error", "bad_size", "''"), ("mixed-image-size", "warning", "mixed", "''"), ("compressed-transfer-syntax", "warning", "compressed", "syntax_names"),
        ("missing-transfer-syntax", "warning", "no_syntax", "''"), ("unsupported-photometric", "warning", "colour", "photometric_names"), ("multiframe-first-frame", "warning", "frames", "''"),
        ("missing-pixel-spacing", "warning", "no_spacing", "''"), ("missing-spatial-geometry", "warning", "no_geometry", "''"), ("missing-rescale", "warning", "no_rescale", "''"),
    )
    each = d.array(*(d.struct(code=f"'{c}'", severity=f"'{s}'", n=f"cast({n} AS bigint)", detail=x) for c, s, n, x in codes))
    when = lambda test: f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"
    colour = f"upper(coalesce(photometric, '')) NOT IN ({plain}, '')"
    return f"""SELECT workspace_id, series_key, (x).code AS code, (x).severity AS severity, (x).n AS affected_instances, (x).detail AS detail FROM (SELECT workspace_id, series_key, {d.rows(each)} AS x FROM (
  SELECT workspace_id, series_key, {when('coalesce(rows_, 0) <= 0 OR coalesce(columns_, 0) <= 0')} AS bad_size, CASE WHEN count(DISTINCT rows_ * cast(1000000 AS bigint) + columns_) > 1 THEN count(*) ELSE 0 END AS mixed,
    {when('coalesce(s.compressed, false)')} AS compressed, {d.names('CASE WHEN s.compressed THEN s.syntax_name END')} AS syntax_names, {when("coalesce(transfer_syntax_uid, '') = ''")} AS no_syntax,
    {when(colour)} AS colour, {d.names(f'CASE WHEN {colour} THEN upper(photometric) END')} AS photometric_names, {when('number_of_frames > 1')} AS frames, {when('pixel_spacing IS NULL')} AS no_spacing,
    CASE WHEN count(*) > 1 THEN {when('NOT has_position')} ELSE 0 END AS no_geometry, CASE WHEN min(upper(modality)) IN ('CT', 'PT', 'PET') THEN {when('NOT has_rescale_slope')} ELSE 0 END AS no_rescale
  FROM dedupe_instances i LEFT JOIN {syntaxes(d)} s ON s.uid = i.transfer_syntax_uid GROUP BY workspace_id, series_key) q) w WHERE (x).n > 0"""


@operator
def study_rollup(d: Dialect) -> str:
    """Series, instances and modalities of each series, study and patient, and of all, by rollup; what is rolled up is null, and ``level`` counts what is not."""
    return f"""SELECT patient_id, study_uid, series_key, 3 - cast(grouping(patient_id) AS int) - cast(grouping(study_uid) AS int) - cast(grouping(series_key) AS int) AS level, {d.names('modality', 100)} AS modalities, count(DISTINCT one_series) AS series_count, count(*) AS instance_count
FROM (SELECT patient_id, study_uid, series_key, workspace_id || '|' || series_key AS one_series, modality FROM dedupe_instances) i GROUP BY ROLLUP (patient_id, study_uid, series_key)"""


@operator
def series_preview(d: Dialect) -> str:
    """Instance count, first size, frames, syntaxes and photometrics in first-seen order, and whether any instance is compressed."""
    new = lambda c: f"CASE WHEN row_number() OVER (PARTITION BY workspace_id, series_key, {c} ORDER BY slice_index) = 1 THEN {c} END"
    return f"""SELECT series_key, workspace_id, count(*) AS instance_count, max(CASE WHEN slice_index = 0 THEN cast(rows_ AS bigint) END) AS first_rows, max(CASE WHEN slice_index = 0 THEN cast(columns_ AS bigint) END) AS first_columns,
  cast(max(number_of_frames) AS bigint) AS max_frames, max(number_of_frames) > 1 AS multi_frame, {d.joined('syntax_new', ',', 'slice_index')} AS transfer_syntaxes, {d.joined('photometric_new', ',', 'slice_index')} AS photometrics, bool_or(coalesce(s.compressed, false)) AS any_compressed
FROM (SELECT *, {new('transfer_syntax_uid')} AS syntax_new, {new('photometric')} AS photometric_new FROM instance_numbers) q LEFT JOIN {syntaxes(d)} s ON s.uid = transfer_syntax_uid GROUP BY series_key, workspace_id"""


@operator
def workspace_filter(d: Dialect, workspace: str = "ws1") -> str:
    """Series of one workspace; an id that is none is an error."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}", workspace):
        raise ValueError(f"no workspace id: {workspace!r}")
    return f"SELECT series_id, series_key, instance_count FROM group_series WHERE workspace_id = {quote(workspace)}"


@operator
def workspace_stats(d: Dialect) -> str:
    """Series (real ones, and virtual ones of phases), views and groups of views of each workspace, and when it was last seen."""
    return f"""SELECT coalesce(s.workspace_id, v.workspace_id) AS workspace_id, coalesce(real_series, 0) + coalesce(virtual_series, 0) AS total_series, coalesce(real_series, 0) AS real_series, coalesce(virtual_series, 0) AS virtual_series, coalesce(image_series, 0) AS image_series,
  coalesce(view_count, 0) AS views, coalesce(group_count, 0) AS view_groups, last_seen FROM (SELECT workspace_id, count(*) AS real_series, count(CASE WHEN is_image_series THEN 1 END) AS image_series FROM group_series GROUP BY workspace_id) s
LEFT JOIN (SELECT workspace_id AS w, count(*) AS virtual_series FROM single_series_phases GROUP BY workspace_id) p ON p.w = s.workspace_id
FULL OUTER JOIN (SELECT workspace_id, count(DISTINCT view_id) AS view_count, count(DISTINCT view_group) AS group_count, {d.seconds('max(ts)')} AS last_seen FROM requests GROUP BY workspace_id) v ON v.workspace_id = s.workspace_id"""


@operator
def attach_presentation_states(d: Dialect) -> str:
    """States joined to the image instance of their workspace that they refer to; of several series the one with the greatest first path."""
    return """SELECT workspace_id, state_path, ref_uid, series_key, path AS image_path FROM (
  SELECT r.workspace_id, r.state_path, r.ref_uid, i.series_key, i.path, row_number() OVER (PARTITION BY r.workspace_id, r.state_path ORDER BY f.first_path DESC, i.path) AS place
  FROM presentation_references r JOIN dedupe_instances i ON i.workspace_id = r.workspace_id AND i.sop_uid = r.ref_uid
  JOIN (SELECT workspace_id, series_key, min(path) AS first_path FROM dedupe_instances GROUP BY workspace_id, series_key) f ON f.series_key = i.series_key AND f.workspace_id = i.workspace_id) q
WHERE place = 1"""


@operator
def unattached_presentation_states(d: Dialect) -> str:
    """States none of whose references is an image of their workspace become document series."""
    return """SELECT workspace_id, state_path, min(ref_uid) AS ref_uid, 'PR' AS modality, 'DICOM_GSPS' AS standard_object_type, 'Tag' AS preferred_view_type FROM (
  SELECT r.workspace_id, r.state_path, r.ref_uid, i.sop_uid FROM presentation_references r LEFT JOIN dedupe_instances i ON i.workspace_id = r.workspace_id AND i.sop_uid = r.ref_uid) q
GROUP BY workspace_id, state_path HAVING count(sop_uid) = 0"""


@operator
def series_catalog(d: Dialect) -> str:
    """Image series, reports and unattached presentation states together."""
    return """SELECT series_key, workspace_id, modality, standard_object_type, instance_count FROM group_series WHERE standard_object_type <> 'DICOM_GSPS'
UNION ALL SELECT 'path::' || state_path AS series_key, workspace_id, modality, standard_object_type, cast(1 AS bigint) AS instance_count FROM unattached_presentation_states"""


@operator
def upsert_series_registry(d: Dialect) -> str:
    """Ids of all series: a registered key keeps its id, else one of its instances' paths does, else it gets a hash of workspace and key; registered series that did not come again stay."""
    return f"""SELECT n.workspace_id, n.series_key, coalesce(r.series_id, p.series_id, n.series_id) AS series_id, r.series_id IS NOT NULL OR p.series_id IS NOT NULL AS known
FROM group_series n LEFT JOIN (SELECT workspace_id, series_key, min(series_id) AS series_id FROM registry_before GROUP BY workspace_id, series_key) r ON r.workspace_id = n.workspace_id AND r.series_key = n.series_key
LEFT JOIN (SELECT i.workspace_id, i.series_key, min(o.series_id) AS series_id FROM dedupe_instances i JOIN registry_paths o ON o.workspace_id = i.workspace_id AND o.path = i.path GROUP BY i.workspace_id, i.series_key) p
  ON p.workspace_id = n.workspace_id AND p.series_key = n.series_key WHERE n.standard_object_type = 'IMAGE'
UNION ALL SELECT workspace_id, series_key, series_id, true AS known FROM registry_before b WHERE NOT EXISTS (SELECT 1 FROM group_series n WHERE n.workspace_id = b.workspace_id AND n.series_key = b.series_key)"""


@operator
def registry_diff(d: Dialect) -> str:
    """Keys that are only in the new registry, only in the old one, or in both."""
    new, old = "SELECT workspace_id, series_key FROM group_series", "SELECT workspace_id, series_key FROM registry_before"
    sides = (("new", f"{new} EXCEPT {old}"), ("old", f"{old} EXCEPT {new}"), ("both", f"{new} INTERSECT {old}"))
    return " UNION ALL ".join(f"SELECT '{side}' AS side, workspace_id, series_key FROM ({rows}) {side}_side" for side, rows in sides)


@operator
def clear_workspace(d: Dialect, workspace: str = "ws1") -> str:
    """The registry without one workspace."""
    return f"SELECT workspace_id, series_key, series_id FROM registry_before WHERE workspace_id <> {quote(workspace)}"


@operator
def phase_from_text(d: Dialect) -> str:
    """Phase that a description names."""
    return f"SELECT DISTINCT series_description, {phase_value(d, 'series_description')} AS phase FROM headers"


@operator
def phase_from_header(d: Dialect) -> str:
    """Phase of each file from the first of seven tags that holds a number, with its unit, tag and label."""
    each = d.array(*(d.struct(v=number_in(d, c), unit=f"'{u}'", source=f"'{k}'") for c, k, u in PHASE_TAGS))
    return f"""SELECT path, (p).v AS sort_value, (p).unit AS unit, (p).source AS source, {label_of(d, '(p).v', '(p).unit')} AS label FROM (
  SELECT path, {d.at(d.keep(each, 'x', 'x.v IS NOT NULL'), 0)} AS p FROM headers) q WHERE p IS NOT NULL"""


@operator
def phase_label(d: Dialect) -> str:
    """Label of each phase of a text."""
    return f"""SELECT phase, {label_of(d, 'v', 'unit')} AS label FROM (SELECT phase, cast(replace(phase, '%', '') AS double) AS v, CASE WHEN right(phase, 1) = '%' THEN '%' ELSE '' END AS unit FROM (SELECT DISTINCT phase FROM keyed_headers WHERE phase IS NOT NULL) a) b"""


@operator
def phase_group_text(d: Dialect) -> str:
    """Description without its phases, for grouping."""
    return f"SELECT series_description, {group_text(d, 'series_description')} AS group_text FROM (SELECT DISTINCT series_description FROM headers) q"


def group_keys(d: Dialect) -> str:
    """Both group keys of a series with a phase: by study and size, and by folder; with modality and description without the phase."""
    text = group_text(d, "series_description")
    number = lambda c: f"coalesce(cast({c} AS {d.text}), '')"
    return d.array(f"study_uid || '|' || modality || '|' || {number('rows_')} || '|' || {number('columns_')} || '|' || {text}", f"{parent('path')} || '|' || modality || '|' || {text}")


@operator
def four_d_groups(d: Dialect) -> str:
    """Group keys of series with a phase; one pass."""
    return f"""SELECT workspace_id, series_key, {d.rows(group_keys(d))} AS group_key, phase, cast(replace(phase, '%', '') AS double) AS sort_value FROM instance_numbers WHERE slice_index = 0 AND phase IS NOT NULL"""


@operator
def dedupe_phases(d: Dialect) -> str:
    """One series for each phase of a group: the lowest key."""
    return """SELECT workspace_id, group_key, sort_value, series_key, phase FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, group_key, sort_value ORDER BY series_key) AS place FROM four_d_groups) q WHERE place = 1"""


@operator
def phase_items(d: Dialect) -> str:
    """Phases of groups with two or more series and phases, numbered by value."""
    return """SELECT workspace_id, group_key, series_key, cast(row_number() OVER (PARTITION BY workspace_id, group_key ORDER BY sort_value, series_key) - 1 AS bigint) AS phase_index, sort_value, phase AS label FROM (
  SELECT *, min(series_key) OVER (PARTITION BY workspace_id, group_key) < max(series_key) OVER (PARTITION BY workspace_id, group_key) AS several_series, count(*) OVER (PARTITION BY workspace_id, group_key) AS phases FROM dedupe_phases) q WHERE several_series AND phases >= 2"""


@operator
def single_series_phases(d: Dialect) -> str:
    """A series whose instances have two or more phases in their headers becomes one virtual series for each, with the tag of its first instance."""
    value = f"coalesce({', '.join(number_in(d, c) for c, *_ in PHASE_TAGS)})"
    which = lambda part: "CASE " + " ".join(f"WHEN {number_in(d, c)} IS NOT NULL THEN '{p}'" for c, *p_ in PHASE_TAGS for p in [p_[part]]) + " END"
    return f"""SELECT workspace_id, series_key, series_key || '::phase::' || cast(row_number() OVER (PARTITION BY workspace_id, series_key ORDER BY sort_value) - 1 AS {d.text}) AS virtual_id, sort_value, source, {label_of(d, 'sort_value', 'unit')} AS label, instance_count FROM (
  SELECT *, count(*) OVER (PARTITION BY workspace_id, series_key) AS phases FROM (
    SELECT workspace_id, series_key, sort_value, {d.first_by('source', 'slice_index')} AS source, {d.first_by('unit', 'slice_index')} AS unit, count(*) AS instance_count FROM (
      SELECT workspace_id, series_key, slice_index, {value} AS sort_value, {which(0)} AS source, {which(1)} AS unit FROM instance_numbers) n WHERE sort_value IS NOT NULL GROUP BY workspace_id, series_key, sort_value) g) q WHERE phases >= 2"""


@view
def projected(d: Dialect) -> str:
    """Instances with their place along the slice direction: the normal of the first orientation in the series' order; null without one or without a position."""
    own = "PARTITION BY workspace_id, series_key"
    first = lambda c: f"max(CASE WHEN slice_index = first_at THEN {c} END) OVER ({own}) AS {c}0"
    return f"""SELECT *, CASE WHEN has_position AND size > 1e-6 THEN (position_x * nx + position_y * ny + position_z * nz) / size END AS place FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM (
  SELECT *, ry0 * cz0 - rz0 * cy0 AS nx, rz0 * cx0 - rx0 * cz0 AS ny, rx0 * cy0 - ry0 * cx0 AS nz FROM (
    SELECT *, {', '.join(map(first, ('rx', 'ry', 'rz', 'cx', 'cy', 'cz')))} FROM (
      SELECT *, min(CASE WHEN rx IS NOT NULL AND cx IS NOT NULL THEN slice_index END) OVER ({own}) AS first_at FROM instance_numbers) a) b) c) e"""


@operator
def spatial_order(d: Dialect) -> str:
    """Instances by their place along the slice direction; series with a missing position or without a direction keep their order."""
    return """SELECT workspace_id, series_key, path, cast(row_number() OVER (PARTITION BY workspace_id, series_key ORDER BY CASE WHEN complete THEN round(place, 6) END, slice_index) - 1 AS bigint) AS spatial_index
FROM (SELECT *, bool_and(place IS NOT NULL) OVER (PARTITION BY workspace_id, series_key) AS complete FROM projected) q"""


@operator
def slice_spacing(d: Dialect) -> str:
    """Median distance over 1e-6 of neighbouring slices along the slice direction, else the first instance's thickness, else 1; spacing in the plane with a floor, 1 in all directions where nothing is known."""
    thickness = f"abs({number_in(d, 'slice_thickness')})"
    return f"""SELECT workspace_id, series_key, round(CASE WHEN gap IS NOT NULL THEN gap WHEN places = 0 AND plane IS NULL THEN 1 WHEN thickness > 0 THEN thickness ELSE 1 END, 6) AS spacing, CASE WHEN plane IS NULL THEN 1 ELSE greatest(abs(plane), 0.001) END AS in_plane FROM (
  SELECT workspace_id, series_key, {d.percentile('CASE WHEN gap > 1e-6 THEN gap END', 0.5)} AS gap, count(place) AS places, max(CASE WHEN slice_index = 0 THEN pixel_spacing END) AS plane, max(CASE WHEN slice_index = 0 THEN {thickness} END) AS thickness FROM (
    SELECT *, abs(place - lag(place) OVER (PARTITION BY workspace_id, series_key ORDER BY place, path)) AS gap FROM projected) q GROUP BY workspace_id, series_key) s"""


@operator
def thumbnail_instance(d: Dialect) -> str:
    """The middle instance of each series."""
    return """SELECT series_key, path FROM (SELECT *, count(*) OVER (PARTITION BY workspace_id, series_key) AS n FROM instance_numbers) q WHERE slice_index = cast(floor(n / 2) AS bigint)"""


@operator
def unique_output_names(d: Dialect) -> str:
    """File names for edited copies; a name that is taken gets -1, -2 and so on."""
    return f"""SELECT path, CASE WHEN place = 1 THEN name || '.dcm' ELSE name || '-' || cast(place - 1 AS {d.text}) || '.dcm' END AS output_name FROM (
  SELECT path, name, row_number() OVER (PARTITION BY workspace_id, name ORDER BY path) AS place FROM (
    SELECT path, workspace_id, {d.swap("coalesce(nullif(series_description, ''), 'series')", '[^A-Za-z0-9]+', '-')} || '-edit-i' || cast(CASE WHEN instance_number > 0 THEN instance_number ELSE slice_index + 1 END AS {d.text}) AS name FROM instance_numbers) p) q"""


#: Text fields of a header that its display lines use, by keyword.
TEXT_FIELDS = (
    "manufacturer", "manufacturer_model_name", "station_name", "institution_name", "study_description", "series_description", "study_id", "series_number", "patient_name", "patient_id", "patient_sex", "patient_age",
    "acquisition_date", "content_date", "study_date", "acquisition_time", "content_time", "study_time", "kvp", "xray_tube_current", "slice_thickness", "modality", "accession_number", "study_uid", "series_uid", "sop_uid",
    "body_part_examined", "protocol_name", "patient_birth_date", "referring_physician_name", "patient_position", "pixel_spacing", "rows_", "columns_", "image_position", "image_orientation", "rescale_slope", "rescale_intercept",
    "convolution_kernel", "reconstruction_diameter", "ctdi_vol", "exposure", "exposure_time",
)


@operator
def display_header(d: Dialect) -> str:
    """The 34 display lines of a header from its text fields, empty ones left out: first text that is there, joined texts, numbers without trailing zeros, dates and times with separators."""
    first = lambda *xs: f"coalesce({', '.join(xs)}, NULL)"
    text = lambda c: f"nullif(trim({c}), '')"
    beside = lambda sep, *xs: f"nullif(concat_ws('{sep}', {', '.join(xs)}), '')"

    def number(c: str, precision: int = 1, suffix: str = "") -> str:
        value = f"try_cast({text(c)} AS double)"
        plain = f"regexp_replace({d.format(f'%.{precision}f', d.even(value, precision))}, '[.]?0+$', '')"
        return f"(CASE WHEN {value} IS NOT NULL THEN {plain} ELSE {text(c)} END || '{suffix}')"

    def numbers(c: str, precision: int, sep: str, suffix: str = "") -> str:
        parts = d.keep(d.each(d.parts(f"coalesce({c}, '')"), "x", number("x", precision)), "t", "t IS NOT NULL")
        return f"(nullif({f'array_join({parts}, {quote(sep)})' if d.spark else f'array_to_string({parts}, {quote(sep)})'}, '') || '{suffix}')"

    digits = lambda c: d.swap(text(c), "[^0-9]", "")
    date = lambda c: f"CASE WHEN {d.matches(text(c), '^[0-9]+$')} AND length({text(c)}) = 8 THEN substring({text(c)}, 1, 4) || '.' || substring({text(c)}, 5, 2) || '.' || substring({text(c)}, 7, 2) ELSE {text(c)} END"
    time = lambda c: f"CASE WHEN length({digits(c)}) >= 6 THEN substring({digits(c)}, 1, 2) || ':' || substring({digits(c)}, 3, 2) || ':' || substring({digits(c)}, 5, 2) ELSE {text(c)} END"
    named = lambda label, x: f"'{label}: ' || {x}"
    slope, cut = number("rescale_slope", 4), number("rescale_intercept", 4)
    lines = {
        "manufacturerModel": beside(" / ", text("manufacturer"), text("manufacturer_model_name")),
        "stationName": text("station_name"),
        "institutionName": text("institution_name"),
        "examDescription": first(text("study_description"), text("study_id"), text("series_description")),
        "seriesNumber": named("Se", text("series_number")),
        "patientName": text("patient_name"),
        "patientSummary": beside(" ", text("patient_id"), beside(" / ", text("patient_sex"), text("patient_age"))),
        "technique": beside(" ", number("kvp", suffix="kV"), number("xray_tube_current", suffix="mA")),
        "sliceThickness": number("slice_thickness", suffix="mm"),
        "acquisitionDateTime": beside(" ", first(*map(date, ("acquisition_date", "content_date", "study_date"))), first(*map(time, ("acquisition_time", "content_time", "study_time")))),
        "modality": named("Modality", text("modality")),
        "accessionNumber": named("Acc", text("accession_number")),
        "studyDate": named("Study date", date("study_date")),
        "studyTime": named("Study time", time("study_time")),
        "studyId": named("Study ID", text("study_id")),
        "studyInstanceUid": named("Study UID", text("study_uid")),
        "seriesInstanceUid": named("Series UID", text("series_uid")),
        "sopInstanceUid": named("SOP UID", text("sop_uid")),
        "seriesDescription": named("Series", text("series_description")),
        "bodyPartExamined": named("Body", text("body_part_examined")),
        "protocolName": named("Protocol", text("protocol_name")),
        "patientBirthDate": named("Birth", date("patient_birth_date")),
        "referringPhysicianName": named("Referrer", text("referring_physician_name")),
        "patientPosition": named("Patient pos", text("patient_position")),
        "pixelSpacing": named("Pixel", numbers("pixel_spacing", 3, " x ", "mm")),
        "rowsColumns": named("Matrix", f"({text('rows_')} || ' x ' || {text('columns_')})"),
        "imagePositionPatient": named("IPP", numbers("image_position", 2, ", ")),
        "imageOrientationPatient": named("IOP", numbers("image_orientation", 4, ", ")),
        "rescaleSlopeIntercept": named("Rescale", f"CASE WHEN {text('rescale_slope')} IS NOT NULL OR {text('rescale_intercept')} IS NOT NULL THEN 'm ' || coalesce({slope}, '-') || '  b ' || coalesce({cut}, '-') END"),
        "convolutionKernel": named("Kernel", text("convolution_kernel")),
        "reconstructionDiameter": named("FOV", number("reconstruction_diameter", 1, "mm")),
        "ctdiVol": named("CTDIvol", number("ctdi_vol", 2, "mGy")),
        "exposure": named("Exposure", number("exposure", 1, "mAs")),
        "exposureTime": named("Exp time", number("exposure_time", 1, "ms")),
    }
    each = d.array(*(d.struct(label=f"'{k}'", line=v) for k, v in lines.items()))
    return f"SELECT path, (x).label AS label, (x).line AS line FROM (SELECT path, {d.rows(each)} AS x FROM header_texts) q WHERE (x).line IS NOT NULL"


@operator
def page(d: Dialect, offset: int = 50, limit: int = 50) -> str:
    """A page of series, by key."""
    return f"SELECT workspace_id, series_key, standard_object_type, instance_count FROM group_series ORDER BY workspace_id, series_key, standard_object_type LIMIT {max(0, limit)} OFFSET {max(0, offset)}"
