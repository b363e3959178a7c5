"""Measurements on slices: validity, lengths, angles, region statistics, labels and report graphics.

A measurement has an array of points, the spacing of its image (null without one) and the image's size.
"""

from __future__ import annotations

from voxtab.plans.statement import Dialect, operator, quote, view

#: Units of measurement labels and their UCUM codes; fixed values.
UNITS = {"": "1", "mm": "mm", "cm": "cm", "m": "m", "mm2": "mm2", "cm2": "cm2", "deg": "deg", "degree": "deg", "degrees": "deg", "px": "{pixel}", "pixel": "{pixel}", "pixels": "{pixel}", "%": "%", "hu": "[hnsf'U]"}
#: Spacing and units with the fall-back to pixels.
SX, SY = "coalesce(sx, 1)", "coalesce(sy, 1)"
UNIT = "CASE WHEN sx IS NULL THEN 'px' ELSE 'mm' END AS unit"
LINES = ("line", "alignment-horizontal", "alignment-vertical")


def xy(d: Dialect, n: str | int) -> tuple[str, str]:
    """x and y of a measurement's point."""
    p = d.at("points", n)
    return f"({p}).x", f"({p}).y"


def ends(d: Dialect, *more: str) -> str:
    """Columns x0, y0, x1, y1 of the first two points."""
    return ", ".join(f"{v} AS {c}{n}" for n in (0, 1) for c, v in zip("xy", xy(d, n), strict=True))


def complete(d: Dialect) -> str:
    """Whether a measurement has the number of points that its tool needs."""
    n = d.size("points")
    return f"CASE tool_type WHEN 'angle' THEN {n} = 3 WHEN 'curve' THEN {n} >= 2 WHEN 'freeform' THEN {n} >= 3 ELSE {n} = 2 END"


@operator
def valid_measurement_points(d: Dialect) -> str:
    """Whether a measurement has the number of points that its tool needs."""
    return f"SELECT measurement_id, tool_type, cast({d.size('points')} AS bigint) AS points, {complete(d)} AS valid FROM measurements"


@operator
def clamp_points(d: Dialect) -> str:
    """Points brought inside the image, by their number."""
    x, y = xy(d, "n")
    return f"""SELECT measurement_id, cast(n AS int) AS n, least(greatest({x}, 0), image_width - 1) AS x, least(greatest({y}, 0), image_height - 1) AS y FROM (
  SELECT *, {d.rows(d.span('0', d.size('points') + ' - 1'))} AS n FROM measurements) q"""


def length(d: Dialect, a: str, b: str) -> str:
    (xa, ya), (xb, yb) = xy(d, a), xy(d, b)
    return f"sqrt(power(({xb} - {xa}) * {SX}, 2) + power(({yb} - {ya}) * {SY}, 2))"


@operator
def line_length(d: Dialect) -> str:
    """Length of each line, in millimetres if there is a spacing."""
    return f"SELECT measurement_id, {UNIT}, round({length(d, '0', '1')}, 6) AS length FROM measurements WHERE tool_type = 'line' AND {complete(d)}"


@operator
def curve_length(d: Dialect) -> str:
    """Length of each curve: the sum over its consecutive points."""
    parts = d.each(d.span("0", d.size("points") + " - 2"), "n", length(d, "n", "n + 1"))
    return f"SELECT measurement_id, {UNIT}, round({d.total(parts)}, 6) AS length FROM (SELECT * FROM measurements WHERE tool_type = 'curve' AND {d.size('points')} >= 2) m"


@operator
def angle_degrees(d: Dialect) -> str:
    """Angle at the middle point after physical scaling; 0 for a side of no length."""
    (xa, ya), (xb, yb), (xc, yc) = xy(d, 0), xy(d, 1), xy(d, 2)
    return f"""SELECT measurement_id, CASE WHEN a <= 1e-6 OR b <= 1e-6 THEN 0 ELSE round(degrees(acos(least(greatest(dot / (a * b), -1), 1))), 5) END AS angle_degrees FROM (
  SELECT measurement_id, sqrt(ax * ax + ay * ay) AS a, sqrt(bx * bx + by_ * by_) AS b, ax * bx + ay * by_ AS dot FROM (
    SELECT measurement_id, ({xa} - {xb}) * {SX} AS ax, ({ya} - {yb}) * {SY} AS ay, ({xc} - {xb}) * {SX} AS bx, ({yc} - {yb}) * {SY} AS by_ FROM measurements WHERE tool_type = 'angle' AND {complete(d)}) p) q"""


@operator
def alignment_angle(d: Dialect, shortest: float = 20.0) -> str:
    """Physical length of alignment lines and their angle to the row or column direction in [-90, 90), none under ``shortest`` mm; lines without a valid spacing are left out."""
    turn = lambda a, b: d.mod(f"degrees(atan2({a}, {b})) + 90", "180")
    return f"""SELECT measurement_id, round(sqrt(dx * dx + dy * dy), 6) AS length, CASE WHEN sqrt(dx * dx + dy * dy) >= {quote(shortest)} THEN round(CASE WHEN tool_type = 'alignment-horizontal' THEN {turn('dy', 'dx')} ELSE {turn('dx', 'dy')} END - 90, 5) END AS angle_degrees
FROM (SELECT measurement_id, tool_type, (x1 - x0) * sx AS dx, (y1 - y0) * sy AS dy FROM (SELECT *, {ends(d)} FROM measurements WHERE tool_type LIKE 'alignment-%' AND {complete(d)} AND sx > 0 AND sy > 0) m) q"""


def inside_polygon(d: Dialect, points: str, x: str, y: str) -> str:
    """Whether a place is inside a polygon (array of points) by the even-odd rule."""
    a = d.at(points, "n")
    b = d.at(points, f"CASE WHEN n = {d.size(points)} - 1 THEN 0 ELSE n + 1 END")
    crosses = f"CASE WHEN (({a}).y > {y}) <> (({b}).y > {y}) AND {x} < (({b}).x - ({a}).x) * ({y} - ({a}).y) / CASE WHEN ({b}).y = ({a}).y THEN 1 ELSE ({b}).y - ({a}).y END + ({a}).x THEN cast(1 AS double) ELSE cast(0 AS double) END"
    return f"({d.total(d.each(d.span('0', d.size(points) + ' - 1'), 'n', crosses))} % 2 = 1)"


REGIONS = ("rect", "ellipse", "freeform")


def region_boxes(d: Dialect) -> str:
    """Rectangles, ellipses and freeforms with the inclusive box of pixels that they look at."""
    xs, ys = d.each("points", "p", "p.x"), d.each("points", "p", "p.y")
    side = lambda free, box: f"cast(CASE WHEN tool_type = 'freeform' THEN {free} ELSE {d.even(box)} END AS int)"
    sides = {"l": side(f"ceil({d.least_of(xs)})", "least(x0, x1)"), "r": side(f"floor({d.most_of(xs)})", "greatest(x0, x1)"), "t": side(f"ceil({d.least_of(ys)})", "least(y0, y1)"), "b": side(f"floor({d.most_of(ys)})", "greatest(y0, y1)")}
    if d.spark:  # a box is a row of its own generator, so that filters on it are not written out down to the tables
        return f"SELECT *, box.l AS l, box.r AS r, box.t AS t, box.b AS b FROM (SELECT *, {d.rows(d.array(d.struct(**sides)))} AS box FROM (SELECT *, {ends(d)} FROM measurements WHERE tool_type IN {REGIONS} AND {complete(d)}) e) x"
    return f"""SELECT *, {side(f'ceil({d.least_of(xs)})', 'least(x0, x1)')} AS l, {side(f'floor({d.most_of(xs)})', 'greatest(x0, x1)')} AS r,
  {side(f'ceil({d.least_of(ys)})', 'least(y0, y1)')} AS t, {side(f'floor({d.most_of(ys)})', 'greatest(y0, y1)')} AS b
FROM (SELECT *, {ends(d)} FROM measurements WHERE tool_type IN {REGIONS} AND {complete(d)}) e"""


def in_region(d: Dialect) -> str:
    """Whether a pixel c (j, k) of the box belongs to the region."""
    half = lambda a, b, v: f"power(({v} - ({a} + {b}) / 2) / greatest(abs({b} - {a}) / 2, 1e-6), 2)"
    return f"CASE tool_type WHEN 'rect' THEN true WHEN 'ellipse' THEN {half('x0', 'x1', 'c.k')} + {half('y0', 'y1', 'c.j')} <= 1 ELSE {inside_polygon(d, 'points', 'c.k', 'c.j')} END"


def with_cells(d: Dialect, rows: str, where: str = "true") -> str:
    """Rows (boxes with the pixels of a slice) with ``cells``, the array of the box's pixels (j, k, value) that are in the image."""
    if d.spark and where == in_region(d):  # a row of the image meets the polygon's sides once and not at every pixel; cells are a row of their own generator, so that filters do not make them again
        a, b = d.at("points", "n"), d.at("points", f"CASE WHEN n = {d.size('points')} - 1 THEN 0 ELSE n + 1 END")
        side = f"CASE WHEN (({a}).y > j) <> (({b}).y > j) THEN (({b}).x - ({a}).x) * (j - ({a}).y) / CASE WHEN ({b}).y = ({a}).y THEN 1 ELSE ({b}).y - ({a}).y END + ({a}).x END"
        sides = f"CASE WHEN tool_type = 'freeform' THEN {d.each(d.span('0', d.size('points') + ' - 1'), 'n', side)} END"
        inside = where.replace(inside_polygon(d, "points", "c.k", "c.j"), f"({d.size(d.keep('sides', 'x', 'c.k < x'))} % 2 = 1)")
        line = d.each(d.span("greatest(l, 0)", "least(r, columns_ - 1)"), "k", d.struct(j="cast(j AS int)", k="cast(k AS int)", value=d.at("pixels", "j * columns_ + k")))
        lines = d.each(d.span("greatest(t, 0)", "least(b, rows_ - 1)"), "j", f"element_at({d.each(d.array(sides), 'sides', d.keep(line, 'c', inside))}, 1)")
        return f"SELECT *, {d.rows(d.array(f'flatten({lines})'))} AS cells FROM ({rows}) b WHERE l <= columns_ - 1 AND r >= 0 AND t <= rows_ - 1 AND b >= 0 AND l <= r AND t <= b"
    k = d.each(d.span("greatest(l, 0)", "least(r, columns_ - 1)"), "k", d.struct(j="cast(j AS int)", k="cast(k AS int)", value=d.at("pixels", "j * columns_ + k")))
    cells = f"flatten({d.each(d.span('greatest(t, 0)', 'least(b, rows_ - 1)'), 'j', k)})"
    return f"SELECT *, {d.keep(cells, 'c', where)} AS cells FROM ({rows}) b WHERE l <= columns_ - 1 AND r >= 0 AND t <= rows_ - 1 AND b >= 0 AND l <= r AND t <= b"


@operator
def roi_pixels(d: Dialect) -> str:
    """Pixels in the box of each rectangle, ellipse and freeform."""
    inner = f"SELECT m.*, s.pixels, s.columns_, s.rows_ FROM ({region_boxes(d)}) m JOIN slices s ON s.series_id = m.series_id AND s.i = m.slice_index"
    return f"SELECT measurement_id, tool_type, series_id, slice_index, (c).j AS j, (c).k AS k, (c).value AS value FROM (SELECT measurement_id, tool_type, series_id, slice_index, {d.rows('cells')} AS c FROM ({with_cells(d, inner)}) w) v"


@view
def roi_values(d: Dialect) -> str:
    """Regions with the array of their pixels' values on their own slice: no row a pixel and no grouping."""
    inner = f"SELECT m.*, s.pixels, s.columns_, s.rows_ FROM ({region_boxes(d)}) m JOIN slices s ON s.series_id = m.series_id AND s.i = m.slice_index"
    return f"SELECT measurement_id, tool_type, sx, sy, l, r, t, b, x0, y0, x1, y1, {d.each('cells', 'c', 'c.value')} AS vals FROM ({with_cells(d, inner, in_region(d))}) w"


def statistics(d: Dialect) -> str:
    """Mean, population deviation and extremes of the array ``vals``."""
    n = f"cast({d.size('vals')} AS double)"
    mean, square = f"{d.total('vals')} / {n}", f"{d.total(d.each('vals', 'x', 'x * x'))} / {n}"
    return f"round({mean}, 6) AS mean, round(sqrt(greatest({square} - power({mean}, 2), 0)), 6) AS standard_deviation, {d.least_of('vals')} AS minimum, {d.most_of('vals')} AS maximum"


ROI_UNIT = "CASE WHEN sx IS NULL THEN 'px' ELSE 'mm' END AS unit, CASE WHEN sx IS NULL THEN 'px2' ELSE 'mm2' END AS area_unit"


@operator
def rect_roi_stats(d: Dialect) -> str:
    """Size, area and statistics of each rectangle's inclusive box."""
    return f"SELECT measurement_id, {ROI_UNIT}, (r - l) * {SX} AS width, (b - t) * {SY} AS height, (r - l) * (b - t) * {SX} * {SY} AS area, {statistics(d)} FROM roi_values WHERE tool_type = 'rect'"


@operator
def ellipse_roi_stats(d: Dialect) -> str:
    """Size, area and statistics of the pixels inside each ellipse."""
    return f"""SELECT measurement_id, {ROI_UNIT}, abs(x1 - x0) * {SX} AS width, abs(y1 - y0) * {SY} AS height, round(pi() / 4 * abs(x1 - x0) * abs(y1 - y0) * {SX} * {SY}, 6) AS area, {statistics(d)}
FROM roi_values WHERE tool_type = 'ellipse' AND {d.size('vals')} > 0"""


@operator
def freeform_roi_stats(d: Dialect) -> str:
    """Area and statistics of the pixels inside each polygon by the even-odd rule."""
    return f"SELECT measurement_id, {ROI_UNIT}, {d.size('vals')} * {SX} * {SY} AS area, {statistics(d)} FROM roi_values WHERE tool_type = 'freeform' AND {d.size('vals')} > 0"


@operator
def drawing_metrics(d: Dialect) -> str:
    """Region drawings that each shown slice of the stack has, with their numbers on that slice: those of the slice itself, and those of the whole series read anew from its pixels."""
    inner = f"""SELECT m.*, s.i, s.pixels, s.columns_, s.rows_ FROM (SELECT s.series_id, s.i, s.pixels, s.columns_, s.rows_ FROM slices s JOIN shown_slices v ON v.series_id = s.series_id AND v.i = s.i) s
  JOIN ({region_boxes(d)}) m ON m.series_id = s.series_id WHERE m.kind = 'stack' AND (m.scope = 'series' OR m.slice_index = s.i)"""
    return f"""SELECT series_id, i, measurement_id, scope, tool_type, cast({d.size('vals')} AS bigint) AS sample_count, {statistics(d)} FROM (
  SELECT series_id, i, measurement_id, scope, tool_type, {d.each('cells', 'c', 'c.value')} AS vals FROM ({with_cells(d, inner, in_region(d))}) w) x WHERE {d.size('vals')} > 0"""


@operator
def circle_roi_stats(d: Dialect) -> str:
    """Statistics of the finite pixels in each circle of each slice; zeros for a circle without any."""
    inner = "SELECT s.series_id, s.i, s.columns_, roi_id, cx, cy, c.r AS radius, s.pixels FROM slices s JOIN circles c ON c.series_id = s.series_id"
    hit = "power(p % columns_ - cx, 2) + power(floor(p / columns_) - cy, 2) <= radius * radius AND abs(value) < 1e300"
    v = f"CASE WHEN {hit} THEN value END"
    return f"""SELECT series_id, i, roi_id, count({v}) AS sample_count, coalesce(round(avg({v}), 6), 0) AS mean, coalesce(round(sqrt(greatest(avg({v.replace('THEN value', 'THEN value * value')}) - power(avg({v}), 2), 0)), 6), 0) AS standard_deviation,
  min({v}) AS minimum, max({v}) AS maximum FROM ({d.pixels(inner)}) c GROUP BY series_id, i, roi_id"""


@operator
def water_qa_metrics(d: Dialect) -> str:
    """Accuracy, uniformity and noise of a water phantom from its five regions, two places, with the regions' size in millimetres."""
    return f"""SELECT s.series_id, s.i, s.roi_id, {d.even('mean', 2)} AS mean, {d.even('mean - centre', 2)} AS deviation_from_center, {d.even('centre', 2)} AS accuracy, {d.even('worst', 2)} AS max_deviation, {d.even('noise', 2)} AS noise,
  {d.even('2 * c.r * g.sk', 2)} AS diameter_x_mm, {d.even('2 * c.r * g.sj', 2)} AS diameter_y_mm
FROM (SELECT *, max(abs(mean - centre)) OVER (PARTITION BY series_id, i) AS worst FROM (SELECT *, max(CASE WHEN roi_id = 'center' THEN mean END) OVER (PARTITION BY series_id, i) AS centre,
    max(CASE WHEN roi_id = 'center' THEN standard_deviation END) OVER (PARTITION BY series_id, i) AS noise FROM circle_roi_stats) p) s
JOIN circles c ON c.series_id = s.series_id AND c.roi_id = s.roi_id JOIN spacings g ON g.series_id = s.series_id"""


@operator
def phantom_rois(d: Dialect) -> str:
    """Regions of found phantoms: five of water at 0.55 of the radius, each of radius max(6, 0.12 R), and one of air: the first of left, right, top and bottom outside that fits the image."""
    water = ", ".join(d.struct(roi_id=f"'{n}'", dx=f"cast({x} AS double)", dy=f"cast({y} AS double)") for n, x, y in (("center", 0, 0), ("left", -1, 0), ("right", 1, 0), ("top", 0, -1), ("bottom", 0, 1)))
    air = ", ".join(d.struct(dx=f"cast({x} AS double)", dy=f"cast({y} AS double)") for x, y in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    fits = "cx + p.dx * (radius + 2 * small) BETWEEN small AND columns_ - 1 - small AND cy + p.dy * (radius + 2 * small) BETWEEN small AND rows_ - 1 - small"
    return f"""SELECT series_id, i, (w).roi_id AS roi_id, round(cx + (w).dx * 0.55 * radius, 6) AS x, round(cy + (w).dy * 0.55 * radius, 6) AS y, small AS r FROM (
  SELECT *, {d.rows(d.array(water))} AS w FROM (SELECT *, greatest(cast(6 AS double), round(0.12 * radius, 6)) AS small FROM phantoms) p) q
UNION ALL SELECT series_id, i, 'air' AS roi_id, round(cx + (a).dx * (radius + 2 * small), 6) AS x, round(cy + (a).dy * (radius + 2 * small), 6) AS y, small AS r FROM (
  SELECT *, {d.at(d.keep(d.array(air), 'p', fits), 0)} AS a FROM (SELECT *, greatest(cast(6 AS double), round(0.12 * radius, 6)) AS small FROM phantoms) p) q WHERE a IS NOT NULL"""


@operator
def measurement_labels(d: Dialect) -> str:
    """Label texts of each rectangle: fixed one-place numbers with their sign, also where they round to zero, ``-`` for none."""
    text = lambda c: f"coalesce({d.fixed(c)}, '-')"
    return f"SELECT measurement_id, 'Area: ' || {text('area')} || ' ' || area_unit AS area_label, 'Mean: ' || {text('mean')} AS mean_label, 'SD: ' || {text('standard_deviation')} AS sd_label, 'W: ' || {text('width')} || ' ' || unit AS width_label FROM rect_roi_stats"


@operator
def parse_measure_labels(d: Dialect) -> str:
    """First number, unit code and concept (the text before) of label texts; labels without a number are left out."""
    number = "[-+]?[0-9]+([.][0-9]+)?"
    codes = "CASE unit " + " ".join(f"WHEN '{u}' THEN '{c.replace(chr(39), chr(39) * 2)}'" for u, c in UNITS.items() if "{" not in c) + " WHEN 'px' THEN pixel WHEN 'pixel' THEN pixel WHEN 'pixels' THEN pixel ELSE unit END"
    unit = f"lower(replace(replace(trim(regexp_extract(label, '{number}[ ]*([^ ]*)', 2)), '°', 'deg'), '^2', '2'))"
    return f"""SELECT measurement_id, label, coalesce(nullif(regexp_replace(regexp_extract(label, '^([^0-9]*?)[ :-]*{number}', 1), '^[ :-]+', ''), ''), 'Measurement Value') AS concept, number, {codes} AS code FROM (
  SELECT measurement_id, label, number, chr(123) || 'pixel' || chr(125) AS pixel, CASE WHEN unit LIKE 'sq_%' THEN substring(unit, 3) || '2' ELSE unit END AS unit FROM (
    SELECT measurement_id, label, try_cast(regexp_extract(label, '{number}', 0) AS double) AS number, {unit} AS unit FROM (
      SELECT measurement_id, {d.rows(d.array('area_label', 'mean_label', 'sd_label', 'width_label'))} AS label FROM measurement_labels) l) p) q WHERE number IS NOT NULL"""


@operator
def hover_sample(d: Dialect) -> str:
    """Pixel under a pointer: canvas position through the inverse of the image's affine map; 1-based row and column, (0, 0) outside; stored sign of MONOCHROME1 restored."""
    back = lambda p, q, r: f"({p} * (px - e) + {q} * (py - f)) / ({r})"
    return f"""SELECT p.event_id, p.r AS row_, p.c AS col_, CASE WHEN s.photometric = 'MONOCHROME1' THEN -1 ELSE 1 END * {d.at('s.pixels', '(p.r - 1) * s.columns_ + p.c - 1')} AS value, CASE WHEN m.modality = 'CT' THEN 'HU' END AS unit,
  coalesce(cast(cast({d.at('s.pixels', '(p.r - 1) * s.columns_ + p.c - 1')} * CASE WHEN s.photometric = 'MONOCHROME1' THEN -1 ELSE 1 END AS bigint) AS {d.text}), '-') AS display_text
FROM (SELECT event_id, series_id, slice_index, CASE WHEN u >= 0 AND v >= 0 AND u < columns_ AND v < rows_ THEN cast(floor(u) + 1 AS int) ELSE 0 END AS c,
    CASE WHEN u >= 0 AND v >= 0 AND u < columns_ AND v < rows_ THEN cast(floor(v) + 1 AS int) ELSE 0 END AS r FROM (
  SELECT *, {back('d', '-c', 'a * d - b * c')} AS u, {back('-b', 'a', 'a * d - b * c')} AS v FROM (
    SELECT q.event_id, q.series_id, q.slice_index, least(least(greatest(q.x, 0), 1) * canvas_width, canvas_width - 1e-6) AS px, least(least(greatest(q.y, 0), 1) * canvas_height, canvas_height - 1e-6) AS py, t.a, t.b, t.c, t.d, t.e, t.f, t.rows_, t.columns_
    FROM pointers q JOIN canvas_affine t ON t.series_id = q.series_id) w) z) p
JOIN image_series m ON m.series_id = p.series_id LEFT JOIN slices s ON s.series_id = p.series_id AND s.i = p.slice_index AND p.r > 0"""


@operator
def drawings_on_slice(d: Dialect) -> str:
    """Drawings that each stack or mpr slice shows: those of the whole series and of the slice itself, of its own kind, each counted before the join."""
    return f"""SELECT s.series_id, s.i, s.kind, coalesce(n_series, 0) + coalesce(n_image, 0) AS drawings, coalesce(n_series, 0) AS of_series FROM (SELECT series_id, i, {d.rows(d.array("'stack'", "'mpr'"))} AS kind FROM slices) s
LEFT JOIN (SELECT series_id, kind, count(*) AS n_series FROM measurements WHERE scope = 'series' GROUP BY series_id, kind) a ON a.series_id = s.series_id AND a.kind = s.kind
LEFT JOIN (SELECT series_id, kind, slice_index, count(*) AS n_image FROM measurements WHERE scope <> 'series' GROUP BY series_id, kind, slice_index) b ON b.series_id = s.series_id AND b.kind = s.kind AND b.slice_index = s.i"""


@operator
def reproject_measurements(d: Dialect) -> str:
    """Points of every measurement of the stack in millimetres, and their row and column on every other plane of the series."""
    x, y = xy(d, "n")
    w = ", ".join(f"o{c} + ({y}) * j{c} + ({x}) * k{c} + slice_index * i{c} AS w{c}" for c in "xyz")
    on = lambda a: f"(wx - cx) * {a}x + (wy - cy) * {a}y + (wz - cz) * {a}z"
    return f"""SELECT measurement_id, p.kind AS plane, cast(n AS int) AS n, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz, round(({on('u')}) / step + (width - 1) / cast(2 AS double), 6) AS plane_column, round(({on('v')}) / step + (height - 1) / cast(2 AS double), 6) AS plane_row
FROM (SELECT m.series_id, measurement_id, n, {w} FROM (SELECT *, {d.rows(d.span('0', d.size('points') + ' - 1'))} AS n FROM measurements WHERE kind = 'stack') m JOIN geometry g ON g.series_id = m.series_id) q
JOIN planes p ON p.series_id = q.series_id AND p.kind <> 'axial'"""


@operator
def smooth_path(d: Dialect, closed: bool = False, samples: int = 12) -> str:
    """Each curve as a smooth path: cubic Bezier segments with controls at a sixth of the neighbours' distance, ``samples`` points a segment after the first point."""
    n = d.size("points")
    if closed:  # only paths of three points and more close
        place = lambda e: f"CASE WHEN {n} > 2 THEN ({e} + {n}) % {n} ELSE least(greatest({e}, 0), {n} - 1) END"
        segments = f"CASE WHEN {n} > 2 THEN {n} ELSE {n} - 1 END"
    else:
        place, segments = (lambda e: f"least(greatest({e}, 0), {n} - 1)"), f"{n} - 1"
    at = {k: xy(d, place(e)) for k, e in (("b", "seg - 1"), ("s", "seg"), ("e", "seg + 1"), ("a", "seg + 2"))}

    def curve(c: int) -> str:
        b, s, e, a = (at[k][c] for k in "bsea")
        return f"round(power(1 - u, 3) * {s} + 3 * power(1 - u, 2) * u * ({s} + ({e} - {b}) / 6) + 3 * (1 - u) * u * u * ({e} - ({a} - {s}) / 6) + power(u, 3) * {e}, 6)"

    return f"""SELECT measurement_id, cast(m AS int) AS n, {curve(0)} AS x, {curve(1)} AS y FROM (
  SELECT *, CASE WHEN m = 0 THEN 0 ELSE cast(floor((m - 1) / {samples}) AS int) END AS seg, CASE WHEN m = 0 THEN cast(0 AS double) ELSE ((m - 1) % {samples} + 1) / cast({samples} AS double) END AS u FROM (
    SELECT *, {d.rows(d.span('0', f'({segments}) * {samples}'))} AS m FROM measurements WHERE tool_type = 'curve' AND {n} >= 2) p) q"""


def shape(d: Dialect) -> tuple[str, str]:
    """Graphic type and array of the points of a measurement's outline, from its points and the columns of ``ends``."""
    point = lambda x, y: d.struct(x=x, y=y)
    rect = d.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"), point("x0", "y0"))
    turn = d.each(d.span("0", "32"), "n", point("(x0 + x1) / 2 + abs(x1 - x0) / 2 * cos(2 * pi() * (n % 32) / 32)", "(y0 + y1) / 2 + abs(y1 - y0) / 2 * sin(2 * pi() * (n % 32) / 32)"))
    first, last = d.at("points", 0), d.at("points", d.size("points") + " - 1")
    join = "concat(points, slice(points, 1, 1))" if d.spark else "list_concat(points, points[1:1])"
    closed = f"CASE WHEN {d.size('points')} > 2 AND NOT (({first}).x = ({last}).x AND ({first}).y = ({last}).y) THEN {join} ELSE points END"
    return (
        f"CASE WHEN {d.size('points')} = 1 THEN 'POINT' ELSE 'POLYLINE' END",
        f"CASE WHEN {d.size('points')} = 1 THEN points WHEN tool_type = 'rect' THEN {rect} WHEN tool_type = 'ellipse' THEN {turn} WHEN tool_type = 'freeform' THEN {closed} ELSE points END",
    )


def outline(d: Dialect) -> str:
    """Points (n, x, y) of each measurement's outline: rectangles as five corners, ellipses as 33 points, freeforms closed, others as they are."""
    graphic_type, o = shape(d)
    return f"""SELECT measurement_id, graphic_type, cast(n AS int) AS n, ({d.at('o', 'n')}).x AS x, ({d.at('o', 'n')}).y AS y, image_width, image_height FROM (SELECT *, {d.rows(d.span('0', d.size('o') + ' - 1'))} AS n FROM (
  SELECT measurement_id, image_width, image_height, {graphic_type} AS graphic_type, {o} AS o
  FROM (SELECT *, {ends(d)} FROM measurements) m) a) b"""


CLIPPED = "least(greatest(x, 0), image_width - 1)", "least(greatest(y, 0), image_height - 1)"


@operator
def sr_graphics(d: Dialect) -> str:
    """Outlines for reports: points counted from 0, inside the image."""
    return f"SELECT measurement_id, graphic_type, n, round({CLIPPED[0]}, 6) AS x, round({CLIPPED[1]}, 6) AS y FROM ({outline(d)}) o"


@operator
def gsps_graphics(d: Dialect) -> str:
    """Outlines for presentation states: points counted from 1, inside the image."""
    return f"SELECT measurement_id, graphic_type, n, round({CLIPPED[0]} + 1, 6) AS x, round({CLIPPED[1]} + 1, 6) AS y FROM ({outline(d)}) o"


#: Tags of presentation states: annotations, their layer, objects and texts, and the fields of these; fixed values.
ANNOTATIONS, LAYER, OBJECTS, TEXTS = "00700001", "00700002", "00700009", "00700008"
FIELDS = {"units": "00700005", "graphic_type": "00700023", "data": "00700022", "text_value": "00700006", "anchor": "00700014", "anchor_units": "00700004"}
ANNOTATION_LAYERS = ("ANNOT", "ANNOTATION", "ANNOTATIONS")


@view
def gsps_objects(d: Dialect) -> str:
    """Graphic and text objects of presentation states, a row each: elements regrouped by the item that their path goes through."""
    field = lambda n, tag: f"max(CASE WHEN leaf = '{tag}' THEN trim(value) END) AS {n}"
    return f"""SELECT file, annotation, kind, object_no, {', '.join(field(n, t) for n, t in FIELDS.items())} FROM (
  SELECT file, cast(split_part(tag_path, '/', 2) AS int) AS annotation, split_part(tag_path, '/', 3) AS kind, cast(split_part(tag_path, '/', 4) AS int) AS object_no, split_part(tag_path, '/', 5) AS leaf, value
  FROM state_tags WHERE tag_path LIKE '{ANNOTATIONS}/%/{OBJECTS}/%/%' OR tag_path LIKE '{ANNOTATIONS}/%/{TEXTS}/%/%') e WHERE leaf <> '' GROUP BY file, annotation, kind, object_no"""


@view
def gsps_graphics_read(d: Dialect) -> str:
    """Graphics in pixels with two numbers or more, numbered anew in their annotation, with 0-based points floored at 0."""
    numbers = d.keep(d.each(d.parts("coalesce(data, '')"), "x", "try_cast(trim(x) AS double)"), "x", "x IS NOT NULL")
    point = lambda n: d.each(d.span("0", f"cast(floor({d.size('numbers')} / 2) AS int) - 1"), "i", f"greatest({d.at('numbers', f'2 * i + {n}')} - 1, 0)")
    return f"""SELECT file, annotation, cast(row_number() OVER (PARTITION BY file, annotation ORDER BY object_no) - 1 AS int) AS item, upper(graphic_type) AS graphic_type, {point(0)} AS xs, {point(1)} AS ys
FROM (SELECT *, {numbers} AS numbers FROM gsps_objects WHERE kind = '{OBJECTS}' AND upper(coalesce(units, '')) IN ('', 'PIXEL')) n WHERE {d.size('numbers')} >= 2"""


@view
def gsps_texts_read(d: Dialect) -> str:
    """Texts that are not empty, numbered anew in their annotation, with their anchor if it is in pixels."""
    at = lambda n: f"CASE WHEN upper(coalesce(anchor_units, '')) IN ('', 'PIXEL') THEN greatest(try_cast(trim({d.at(d.parts('anchor'), n)}) AS double) - 1, 0) END"
    return f"""SELECT file, annotation, cast(row_number() OVER (PARTITION BY file, annotation ORDER BY object_no) - 1 AS int) AS item, text_value, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y
FROM (SELECT *, {at(0)} AS x, {at(1)} AS y FROM gsps_objects WHERE kind = '{TEXTS}' AND coalesce(text_value, '') <> '') t"""


@operator
def gsps_references(d: Dialect) -> str:
    """Image that each annotation of a presentation state refers to: the first of its own references, else the first of the state's."""
    is_own = f"tag_path LIKE '{ANNOTATIONS}/%/00081140/%/00081155' AND trim(value) <> ''"
    is_default = "tag_path LIKE '00081115/%/00081140/%/00081155' AND trim(value) <> ''"
    place = "cast(split_part(tag_path, '/', 2) AS bigint) * 1000000 + cast(split_part(tag_path, '/', 4) AS bigint)"
    if d.spark:  # one pass; only references keep their value, so that a state's many objects fall together before they are moved or sorted
        return f"""SELECT file, annotation, coalesce(uid, default_uid) AS ref_uid FROM (SELECT *, max(CASE WHEN annotation IS NULL THEN uid END) OVER (PARTITION BY file) AS default_uid FROM (
  SELECT file, annotation, {d.first_by('uid', 'at')} AS uid FROM (SELECT DISTINCT file, CASE WHEN tag_path LIKE '{ANNOTATIONS}/%/%' THEN cast(split_part(tag_path, '/', 2) AS int) END AS annotation,
    CASE WHEN {is_own} THEN cast(split_part(tag_path, '/', 4) AS bigint) WHEN {is_default} THEN {place} END AS at, CASE WHEN ({is_own}) OR ({is_default}) THEN trim(value) END AS uid
    FROM state_tags WHERE tag_path LIKE '{ANNOTATIONS}/%/%' OR {is_default}) r GROUP BY file, annotation) a) f WHERE annotation IS NOT NULL"""
    return f"""SELECT a.file, a.annotation, coalesce(a.own, f.uid) AS ref_uid FROM (
  SELECT file, annotation, CASE WHEN count(own_at) > 0 THEN {d.first_by('value', 'own_at')} END AS own FROM (
    SELECT file, cast(split_part(tag_path, '/', 2) AS int) AS annotation, trim(value) AS value, CASE WHEN {is_own} THEN cast(split_part(tag_path, '/', 4) AS bigint) END AS own_at FROM state_tags WHERE tag_path LIKE '{ANNOTATIONS}/%/%') e GROUP BY file, annotation) a
LEFT JOIN (SELECT file, {d.first_by('trim(value)', place)} AS uid FROM state_tags WHERE {is_default} GROUP BY file) f ON f.file = a.file"""


def gsps_items(d: Dialect) -> str:
    """Spark's one pass over the elements of presentation states: graphics and texts with their number in the annotation, the text of a graphic's place, and what the annotation and the state say of them.

    Elements are moved once, by file; sorted by annotation, kind and object, a state's own row comes before its annotations and an annotation's before its objects.
    """
    is_object = f"(tag_path LIKE '{ANNOTATIONS}/%/{OBJECTS}/%/%' OR tag_path LIKE '{ANNOTATIONS}/%/{TEXTS}/%/%') AND split_part(tag_path, '/', 5) <> ''"
    is_own, is_default = f"tag_path LIKE '{ANNOTATIONS}/%/00081140/%/00081155' AND trim(value) <> ''", "tag_path LIKE '00081115/%/00081140/%/00081155' AND trim(value) <> ''"
    is_layer, is_state = f"tag_path LIKE '{ANNOTATIONS}/%/{LAYER}'", "tag_path = '00080018'"
    place = "cast(split_part(tag_path, '/', 2) AS bigint) * 1000000 + cast(split_part(tag_path, '/', 4) AS bigint)"
    role = f"CASE WHEN {is_own} THEN 'own' WHEN {is_layer} THEN 'layer' WHEN {is_object} THEN split_part(tag_path, '/', 5) WHEN {is_default} THEN 'default' WHEN {is_state} THEN 'state' END"
    of = lambda n, leaf: f"max(CASE WHEN role = '{leaf}' THEN value END) AS {n}"
    at = lambda n: f"CASE WHEN upper(coalesce(anchor_units, '')) IN ('', 'PIXEL') THEN greatest(try_cast(trim({d.at(d.parts('anchor'), n)}) AS double) - 1, 0) END"
    numbers = d.keep(d.each(d.parts("coalesce(data, '')"), "x", "try_cast(trim(x) AS double)"), "x", "x IS NOT NULL")
    point = lambda n: d.each(d.span("0", f"cast(floor({d.size('numbers')} / 2) AS int) - 1"), "i", f"greatest({d.at('numbers', f'2 * i + {n}')} - 1, 0)")
    shape = f"CASE WHEN is_graphic THEN {d.struct(xs=point(0), ys=point(1))} END"  # a row of its own generator, so that filters do not make it again
    run = "OVER (PARTITION BY file ORDER BY annotation, kind, object_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    place_of = "OVER (PARTITION BY file, annotation, item)"
    return f"""SELECT file, annotation, cast(item AS int) AS item, is_graphic, sop_uid, ref_uid, annotates, graphic_type, text_value, label, has_graphic, shape.xs AS xs, shape.ys AS ys,
  CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM (SELECT *, {d.rows(d.array(shape))} AS shape FROM (
  SELECT *, max(is_graphic) {place_of} AS has_graphic, max(CASE WHEN NOT is_graphic THEN text_value END) {place_of} AS label FROM (
    SELECT file, annotation, item, is_graphic, sop_uid, coalesce(CASE WHEN head.annotation = annotation THEN head.own END, default_uid) AS ref_uid, coalesce(CASE WHEN head.annotation = annotation THEN head.layer END, '') IN {ANNOTATION_LAYERS} AS annotates,
      upper(graphic_type) AS graphic_type, numbers, text_value, CASE WHEN NOT is_graphic THEN {at(0)} END AS x, CASE WHEN NOT is_graphic THEN {at(1)} END AS y FROM (
      SELECT *, kind = '{OBJECTS}' AS is_graphic, max(state) {run} AS sop_uid, max(default_uid_) {run} AS default_uid, max(CASE WHEN kind = '' AND annotation IS NOT NULL THEN named_struct('annotation', annotation, 'own', own, 'layer', layer) END) {run} AS head FROM (
        SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY file, annotation, kind ORDER BY object_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS item FROM (
          SELECT *, CASE kind WHEN '{OBJECTS}' THEN upper(coalesce(units, '')) IN ('', 'PIXEL') AND {d.size('numbers')} >= 2 WHEN '{TEXTS}' THEN coalesce(text_value, '') <> '' ELSE false END AS valid FROM (
            SELECT *, CASE WHEN kind = '{OBJECTS}' THEN {numbers} END AS numbers FROM (
              SELECT file, annotation, kind, object_no, {', '.join(of(*x) for x in (*FIELDS.items(), ('state', 'state')))}, upper(max(CASE WHEN role = 'layer' THEN value END)) AS layer, {d.first_by("CASE WHEN role = 'own' THEN value END", "CASE WHEN role = 'own' THEN at END")} AS own,
                {d.first_by("CASE WHEN role = 'default' THEN value END", "CASE WHEN role = 'default' THEN at END")} AS default_uid_ FROM (
                SELECT file, role, trim(value) AS value, CASE WHEN role NOT IN ('default', 'state') THEN cast(split_part(tag_path, '/', 2) AS int) END AS annotation, CASE WHEN role IN ('own', 'layer', 'default', 'state') THEN '' ELSE split_part(tag_path, '/', 3) END AS kind,
                  CASE WHEN role NOT IN ('own', 'layer', 'default', 'state') THEN cast(split_part(tag_path, '/', 4) AS int) END AS object_no, CASE role WHEN 'own' THEN cast(split_part(tag_path, '/', 4) AS bigint) WHEN 'default' THEN {place} END AS at
                FROM (SELECT file, tag_path, value, {d.rows(d.array(role))} AS role FROM state_tags) w WHERE role IS NOT NULL DISTRIBUTE BY file) e GROUP BY file, annotation, kind, object_no) g) n) v) p) h
      WHERE valid) k WHERE coalesce(ref_uid, '') <> '') q) s"""


@operator
def parse_gsps(d: Dialect) -> str:
    """Measurements and annotations of presentation states from their elements: a graphic's shape says the tool, the text of the same place is its label, texts that are left over become annotations. States without a reference are left out."""
    n = d.size("xs")
    first, last = (lambda c: d.at(c, 0)), (lambda c: d.at(c, f"{n} - 1"))
    four = lambda c: f"{d.size(distinct(d, d.each(d.span('0', '3'), 'i', f'round({d.at(c, "i")}, 3)')))}"
    closed = f"{n} = 5 AND abs({first('xs')} - {last('xs')}) <= 1e-3 AND abs({first('ys')} - {last('ys')}) <= 1e-3 AND {four('xs')} = 2 AND {four('ys')} = 2"
    tool = f"CASE WHEN annotates THEN 'arrow' WHEN graphic_type IN ('ELLIPSE', 'CIRCLE') THEN 'ellipse' WHEN graphic_type = 'POLYLINE' THEN CASE WHEN {n} = 2 THEN 'line' WHEN {closed} THEN 'rect' ELSE 'freeform' END END"
    ends = lambda c: f"CASE tool_type WHEN 'arrow' THEN {d.array(first(c), last(c))} WHEN 'ellipse' THEN {d.array(d.least_of(c), d.most_of(c))} WHEN 'rect' THEN {d.array(first(c), d.at(c, 2))} ELSE {c} END"
    overlay = f"coalesce(nullif(sop_uid, ''), 'gsps') || ':' || cast(annotation AS {d.text}) || ':' || cast(item AS {d.text})"
    if d.spark:
        text = f"'gsps-text-' || {overlay}"
        measure = f"CASE WHEN annotates THEN 'gsps-annotation-' ELSE 'gsps-measure-' END || {overlay}"
        by = lambda graphic, other: f"CASE WHEN is_graphic THEN {graphic} ELSE {other} END"
        return f"""SELECT file, ref_uid, {by(measure, text)} AS overlay_id, CASE WHEN is_graphic AND NOT annotates THEN 'measurement' ELSE 'annotation' END AS kind, {by('tool_type', "'arrow'")} AS tool_type,
  {by(ends('xs'), d.array('x', 'x + 1'))} AS xs, {by(ends('ys'), d.array('y', 'y + 1'))} AS ys, {by("coalesce(label, '')", 'text_value')} AS label
FROM (SELECT *, CASE WHEN is_graphic THEN {tool} END AS tool_type FROM ({gsps_items(d)}) i WHERE CASE WHEN is_graphic THEN {n} >= 2 ELSE NOT has_graphic AND x IS NOT NULL END) t WHERE NOT is_graphic OR tool_type IS NOT NULL"""
    return f"""WITH layers AS (SELECT r.file, r.annotation, r.ref_uid, s.sop_uid, coalesce(l.layer, '') IN {ANNOTATION_LAYERS} AS annotates FROM gsps_references r
  LEFT JOIN (SELECT file, cast(split_part(tag_path, '/', 2) AS int) AS annotation, upper(trim(value)) AS layer FROM state_tags WHERE tag_path LIKE '{ANNOTATIONS}/%/{LAYER}') l ON l.file = r.file AND l.annotation = r.annotation
  LEFT JOIN (SELECT file, trim(value) AS sop_uid FROM state_tags WHERE tag_path = '00080018') s ON s.file = r.file WHERE coalesce(r.ref_uid, '') <> '')
SELECT file, ref_uid, CASE WHEN annotates THEN 'gsps-annotation-' ELSE 'gsps-measure-' END || {overlay} AS overlay_id, CASE WHEN annotates THEN 'annotation' ELSE 'measurement' END AS kind, tool_type, {ends('xs')} AS xs, {ends('ys')} AS ys, label FROM (
  SELECT *, {tool} AS tool_type FROM (SELECT g.*, l.ref_uid, l.sop_uid, l.annotates, coalesce(t.text_value, '') AS label FROM gsps_graphics_read g JOIN layers l ON l.file = g.file AND l.annotation = g.annotation
    LEFT JOIN gsps_texts_read t ON t.file = g.file AND t.annotation = g.annotation AND t.item = g.item) a WHERE {n} >= 2) b WHERE tool_type IS NOT NULL
UNION ALL SELECT t.file, l.ref_uid, 'gsps-text-' || {overlay.replace('sop_uid', 'l.sop_uid').replace('annotation AS', 't.annotation AS').replace('item AS', 't.item AS')} AS overlay_id, 'annotation' AS kind, 'arrow' AS tool_type, {d.array('t.x', 't.x + 1')} AS xs, {d.array('t.y', 't.y + 1')} AS ys, t.text_value AS label
FROM gsps_texts_read t JOIN layers l ON l.file = t.file AND l.annotation = t.annotation LEFT JOIN (SELECT file, annotation, count(*) AS graphics FROM gsps_graphics_read GROUP BY file, annotation) c ON c.file = t.file AND c.annotation = t.annotation
WHERE t.item >= coalesce(c.graphics, 0) AND t.x IS NOT NULL"""


def distinct(d: Dialect, array: str) -> str:
    return f"array_distinct({array})" if d.spark else f"list_distinct({array})"


@operator
def sr_report_rows(d: Dialect) -> str:
    """Report tree of every measurement, one row an item: its path in the tree, concept and text. Group, then tool and place, coordinates, and the numbers of rectangles."""
    item = lambda path, concept, text: d.struct(path=path, concept=f"'{concept}'", text_value=text)
    joined = lambda a, b: f"concat({a}, {b})" if d.spark else f"list_concat({a}, {b})"
    head = d.array(item("'1'", "Imaging Measurement", "measurement_id"), item("'1.1'", "Tool", "tool_type"), item("'1.2'", "Source", f"series_id || '/' || cast(slice_index AS {d.text})"))
    p = d.at("points", "n")
    points = d.each(d.span("0", d.size("points") + " - 1"), "n", item(f"'1.3.' || cast(n + 1 AS {d.text})", "Coordinate", f"{d.format('%.2f', f'({p}).x')} || '/' || {d.format('%.2f', f'({p}).y')}"))
    numbers = d.array(*(item(f"'1.4.{n}'", c.title(), d.fixed(c)) for n, c in enumerate(("area", "mean", "standard_deviation"), 1)))
    return f"""SELECT measurement_id, (x).path AS path, (x).concept AS concept, (x).text_value AS text_value FROM (SELECT measurement_id, {d.rows(joined(joined(head, points), 'CASE WHEN mean IS NULL THEN ' + d.keep(numbers, 'n', 'false') + ' ELSE ' + numbers + ' END'))} AS x
FROM (SELECT m.*, area, mean, standard_deviation FROM measurements m LEFT JOIN rect_roi_stats r ON r.measurement_id = m.measurement_id) q) w"""
