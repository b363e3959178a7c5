"""Geometry, planes, regions and reslicing of volumes.

A volume's map from indices to millimetres is any affine one: world = o + i * (ix, iy, iz) + j * (jx, jy, jz) + k * (kx, ky, kz), for slice i,
row j and column k; ``geometry`` also has the rows of its inverse (di, dj, dk). Regions meet slices by their
slice range, and only the pixels of those slices become rows.
"""

from __future__ import annotations

from voxtab.plans.statement import Dialect, operator, quote

XYZ = "xyz"


def world(i: str, j: str, k: str, c: str) -> str:
    """A coordinate of the voxel at (i, j, k)."""
    return f"(o{c} + ({i}) * i{c} + ({j}) * j{c} + ({k}) * k{c})"


def index(row: str, x: str, y: str, z: str) -> str:
    """Index of a point along the axis of an inverse row."""
    return f"(({x} - ox) * {row}x + ({y} - oy) * {row}y + ({z} - oz) * {row}z)"


def dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{c} * {b}{c}" for c in XYZ) + ")"


def cross(a: str, b: str) -> tuple[str, str, str]:
    return tuple(f"({a}{y} * {b}{z} - {a}{z} * {b}{y})" for y, z in ("yz", "zx", "xy"))


def one_each(columns: tuple[str, ...], inner: str) -> str:
    """A statement with one row a series as an aggregation, so that Catalyst does not write its expressions out wherever they are named."""
    return f"SELECT series_id, {', '.join(f'max({c}) AS {c}' for c in columns)} FROM ({inner}) q GROUP BY series_id"


MAPPING = ("depth", "nj", "nk", "slice_step", "row_step", "column_step", "px", "py", "pz", *(v + c for v in "rcs" for c in XYZ), *(f"{v}_{what}" for what in ("axis", "sign") for v in ("slice", "column", "row")), *(f"{what}_{c}" for what in ("from", "sign") for c in "zyx"), "valid")

STATS = """count(*) AS sample_count, round(sum(value) / count(*), 6) AS hu_mean, min(value) AS hu_min, max(value) AS hu_max,
  round(sqrt(greatest(sum(value * value) / count(*) - power(sum(value) / count(*), 2), 0)), 6) AS hu_std_dev, round(count(*) * max(voxel_mm3) / 1000, 6) AS volume_cm3"""


@operator
def axis_mapping(d: Dialect) -> str:
    """Patient axis (0 x, 1 y, 2 z) and sign of each series' slice, column and row direction, and the order that brings them to z, y, x; null axes where two directions share one or there is none."""
    unit = lambda v: ", ".join(f"{v}{c} / n{v} AS {v}{c}" for c in XYZ)
    axis = lambda v: f"CASE WHEN abs({v}x) >= abs({v}y) AND abs({v}x) >= abs({v}z) THEN 0 WHEN abs({v}y) >= abs({v}z) THEN 1 ELSE 2 END"
    sign = lambda v, a: f"CASE WHEN CASE {a} WHEN 0 THEN {v}x WHEN 1 THEN {v}y ELSE {v}z END >= 0 THEN 1 ELSE -1 END"
    place = lambda axis: f"CASE {axis} WHEN slice_axis THEN 0 WHEN column_axis THEN 1 ELSE 2 END"
    by = lambda axis: f"CASE {axis} WHEN slice_axis THEN slice_sign WHEN column_axis THEN column_sign ELSE row_sign END"
    s = cross("r", "c")
    return one_each(MAPPING, f"""SELECT series_id, depth, nj, nk, slice_step, row_step, column_step, px, py, pz, rx, ry, rz, cx, cy, cz, sx, sy, sz, slice_axis, column_axis, row_axis, slice_sign, column_sign, row_sign,
  CASE WHEN valid THEN {place('2')} END AS from_z, CASE WHEN valid THEN {place('1')} END AS from_y, CASE WHEN valid THEN {place('0')} END AS from_x,
  CASE WHEN valid THEN {by('2')} END AS sign_z, CASE WHEN valid THEN {by('1')} END AS sign_y, CASE WHEN valid THEN {by('0')} END AS sign_x, coalesce(valid, false) AS valid FROM (
  SELECT *, {sign('s', 'slice_axis')} AS slice_sign, {sign('c', 'column_axis')} AS column_sign, {sign('r', 'row_axis')} AS row_sign, slice_axis <> column_axis AND slice_axis <> row_axis AND column_axis <> row_axis AS valid FROM (
    SELECT *, {axis('s')} AS slice_axis, {axis('c')} AS column_axis, {axis('r')} AS row_axis FROM (
      SELECT series_id, depth, nj, nk, slice_step, row_step, column_step, px, py, pz, {unit('r')}, {unit('c')}, {unit('s')} FROM (
        SELECT *, CASE WHEN sqrt({dot('s', 's')}) > 1e-6 THEN sqrt({dot('s', 's')}) END AS ns FROM (
          SELECT *, {', '.join(f'{v} / (nr * nc) AS s{c}' for c, v in zip(XYZ, s, strict=True))} FROM (
            SELECT *, CASE WHEN sqrt({dot('r', 'r')}) > 1e-6 THEN sqrt({dot('r', 'r')}) END AS nr, CASE WHEN sqrt({dot('c', 'c')}) > 1e-6 THEN sqrt({dot('c', 'c')}) END AS nc FROM orientations) a) b) e) f) g) h""")


@operator
def geometry(d: Dialect) -> str:
    """Affine map of each series from stored indices to millimetres, its inverse and the volume of a voxel; the identity where the orientation is missing."""
    return series_affine(d, "CASE WHEN valid THEN {0} ELSE {1} END")


def series_affine(d: Dialect, either: str) -> str:
    one = {"i": "z", "j": "y", "k": "x"}
    part = {"i": ("s", "slice_step"), "j": ("c", "row_step"), "k": ("r", "column_step")}
    vector = ", ".join(f"{either.format(f'{v}{c} * {step}', f'cast({int(one[a] == c)} AS double)')} AS {a}{c}" for a, (v, step) in part.items() for c in XYZ)
    origin = ", ".join(f"{either.format(f'p{c}', 'cast(0 AS double)')} AS o{c}" for c in XYZ)
    rows = {"di": cross("j", "k"), "dj": cross("k", "i"), "dk": cross("i", "j")}
    inverse = ", ".join(f"{v} / det AS {r}{c}" for r, vs in rows.items() for c, v in zip(XYZ, vs, strict=True))
    columns = ("depth", "nj", "nk", *(a + c for a in ("o", "i", "j", "k", "di", "dj", "dk") for c in XYZ), "voxel_mm3")
    return one_each(columns, f"""SELECT series_id, depth, nj, nk, ox, oy, oz, ix, iy, iz, jx, jy, jz, kx, ky, kz, {inverse}, abs(det) AS voxel_mm3 FROM (
  SELECT *, {' + '.join(f'i{c} * {v}' for c, v in zip(XYZ, cross('j', 'k'), strict=True))} AS det FROM (SELECT series_id, depth, nj, nk, {origin}, {vector} FROM axis_mapping) a) b""")


@operator
def spacings(d: Dialect) -> str:
    """Distance of neighbouring slices, rows and columns."""
    return "SELECT series_id, " + ", ".join(f"round(sqrt({dot(a, a)}), 9) AS s{a}" for a in "ijk") + " FROM geometry"


@operator
def series_geometry(d: Dialect) -> str:
    """Affine map of each standardised volume: axes in the order z, y, x, directions positive, the origin moved for those that were negative."""
    steps = {"0": ("s", "slice_step", "depth"), "1": ("c", "row_step", "nj"), "2": ("r", "column_step", "nk")}
    pick = lambda key, f: f"CASE {key} " + " ".join(f"WHEN {n} THEN {f(*v)}" for n, v in steps.items()) + " END"
    vector = ", ".join(f"CASE WHEN valid THEN sign_{c} * {pick(f'from_{c}', lambda v, s, n, e=e: f'{v}{e} * {s}')} ELSE {int(c == e)} END AS {a}{e}" for a, c in (("i", "z"), ("j", "y"), ("k", "x")) for e in XYZ)
    origin = ", ".join(
        f"CASE WHEN valid THEN p{e}" + "".join(f" + CASE WHEN sign_{c} < 0 THEN {pick(f'from_{c}', lambda v, s, n, e=e: f'{v}{e} * {s} * ({n} - 1)')} ELSE 0 END" for c in "zyx") + f" ELSE 0 END AS o{e}" for e in XYZ
    )
    shape = ", ".join(f"CASE WHEN valid THEN {pick(f'from_{c}', lambda v, s, n: n)} ELSE {n0} END AS {name}" for name, c, n0 in (("n_i", "z", "depth"), ("n_j", "y", "nj"), ("n_k", "x", "nk")))
    cells = ", ".join(f"round({a}{c} + 0, 6) AS {a}{c}" for a in "oijk" for c in XYZ)
    return f"SELECT series_id, n_i, n_j, n_k, {cells} FROM (SELECT series_id, {shape}, {origin}, {vector} FROM axis_mapping) q"


@operator
def standardize_volume(d: Dialect) -> str:
    """Voxels in the order z, y, x with positive directions; series of mixed shape are left out."""
    raw = {"0": ("i", "depth"), "1": ("j", "nj"), "2": ("k", "nk")}
    pick = lambda key, n: f"CASE {key} " + " ".join(f"WHEN {a} THEN v.{v[0]}" if n == 0 else f"WHEN {a} THEN {v[1]}" for a, v in raw.items()) + " END"
    new = lambda c, old: f"CASE WHEN NOT valid THEN v.{old} WHEN sign_{c} < 0 THEN {pick(f'from_{c}', 1)} - 1 - {pick(f'from_{c}', 0)} ELSE {pick(f'from_{c}', 0)} END AS {old}"
    return f"""SELECT v.series_id, {new('z', 'i')}, {new('y', 'j')}, {new('x', 'k')}, v.value FROM voxels v JOIN axis_mapping m ON m.series_id = v.series_id
JOIN (SELECT series_id FROM slices GROUP BY series_id HAVING min({d.size('pixels')}) = max({d.size('pixels')})) ok ON ok.series_id = v.series_id"""


@operator
def ijk_to_world(d: Dialect, slice_: int | None = None) -> str:
    """Position of each voxel of one slice, the middle one if none is named."""
    at = "cast(floor(depth / 2) AS int)" if slice_ is None else quote(slice_)
    return f"SELECT v.series_id, i, j, k, {', '.join(f'round({world("i", "j", "k", c)}, 6) AS {c}' for c in XYZ)} FROM voxels v JOIN geometry g ON g.series_id = v.series_id WHERE v.i = {at}"


@operator
def world_to_ijk(d: Dialect) -> str:
    """Index of the centre of each sphere."""
    return f"SELECT s.series_id, sphere_id, {', '.join(f'round({index("d" + n, "cx", "cy", "cz")}, 6) AS c{n}' for n in 'ijk')} FROM spheres s JOIN geometry g ON g.series_id = s.series_id"


@operator
def planes(d: Dialect) -> str:
    """Axial, coronal, sagittal and oblique planes through the centre: centre, unit vectors, step and size."""
    rows = "('axial', 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), ('coronal', 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), ('sagittal', 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), ('oblique', 1.0, 0.0, 0.0, 0.0, 0.866025403784, 0.5)"
    cast = ", ".join(f"cast({c} AS double) AS {c}" for c in ("ux", "uy", "uz", "vx", "vy", "vz"))
    half = lambda n: f"({n} - 1) / cast(2 AS double)"
    centre = ", ".join(f"{world(half('depth'), half('nj'), half('nk'), c)} AS c{c}" for c in XYZ)
    return f"SELECT series_id, kind, {centre}, {cast}, sqrt({dot('k', 'k')}) AS step, nk AS width, nj AS height FROM geometry JOIN (SELECT * FROM (VALUES {rows}) v(kind, ux, uy, uz, vx, vy, vz)) p ON true"


@operator
def derive_planes(d: Dialect) -> str:
    """Right-handed basis of each plane: the row direction made orthogonal to the column direction, and the normal."""
    n = cross("u", "v")
    fixed = ", ".join(f"v{c} - {dot('u', 'v')} * u{c} AS v{c}" for c in XYZ)
    return f"""SELECT series_id, kind, {', '.join(f'round(v{c} / size_, 6) + 0 AS v{c}' for c in XYZ)}, {', '.join(f'round(({v}) / size_, 6) + 0 AS n{c}' for c, v in zip(XYZ, n, strict=True))} FROM (
  SELECT *, sqrt({dot('v', 'v')}) AS size_ FROM (SELECT series_id, kind, ux, uy, uz, {fixed} FROM planes) a) b WHERE size_ > 1e-6"""


def grid(d: Dialect, table: str) -> str:
    """Row, column and position of every sample of a table of planes; the grid is centred on the plane."""
    half = lambda n: f"({n} - 1) / cast(2 AS double)"
    at = ", ".join(f"c{c} + (c - {half('width')}) * step * u{c} + (r - {half('height')}) * step * v{c} AS {c}" for c in XYZ)
    return f"""SELECT *, {at} FROM (SELECT *, {d.rows(d.span('0', 'width - 1'))} AS c FROM (SELECT *, {d.rows(d.span('0', 'height - 1'))} AS r FROM {table}) a) b"""


@operator
def plane_to_world(d: Dialect) -> str:
    """Position of every sample of every plane."""
    return f"SELECT series_id, kind, cast(r AS int) AS r, cast(c AS int) AS c, x, y, z FROM ({grid(d, 'planes')}) g"


@operator
def world_to_plane(d: Dialect) -> str:
    """Row and column of each sphere's centre on each plane."""
    on = lambda a: " + ".join(f"(s.c{c} - p.c{c}) * {a}{c}" for c in XYZ)
    return f"""SELECT p.series_id, p.kind, sphere_id, round(({on('u')}) / step + (width - 1) / cast(2 AS double), 6) AS c, round(({on('v')}) / step + (height - 1) / cast(2 AS double), 6) AS r
FROM planes p JOIN spheres s ON s.series_id = p.series_id"""


def sampled(d: Dialect, places: str, key: str, order: int, boundary: str, cval: float) -> str:
    """value of each row of places (columns key, series_id, x, y, z) in its volume by interpolation of order 0 or 1.

    ``nearest`` clamps places to the volume, ``constant`` gives cval outside. Corners without weight are never joined, and
    the corners of one slice look their pixels up in one array.
    """
    axes = {"i": "depth", "j": "nj", "k": "nk"}
    raw = ", ".join(f"round({index('d' + a, 'x', 'y', 'z')}, 9) AS f{a}" for a in axes)
    clamp = ", ".join(f"least(greatest(f{a}, 0), {n} - 1) AS f{a}" for a, n in axes.items())
    outside = " OR ".join(f"f{a} < 0 OR f{a} > {n} - 1" for a, n in axes.items())
    columns = f"{key}, series_id, nk"
    placed = f"SELECT {columns}, depth, nj, {'false' if boundary == 'nearest' else outside} AS away, {clamp} FROM (SELECT {key}, p.series_id, g.depth, g.nj, g.nk, {raw} FROM ({places}) p JOIN geometry g ON g.series_id = p.series_id) q"
    if order <= 0:
        near = lambda a: f"cast({d.even(f'f{a}')} AS int)"
        terms = [("cast(1 AS double)", near("i"), near("j"), near("k"))]
    else:
        low = lambda a: f"cast(floor(f{a}) AS int)"
        frac = lambda a: f"(f{a} - floor(f{a}))"
        pick = lambda a, b: (f"{frac(a)}" if b else f"(1 - {frac(a)})", f"{low(a)} + {b}")
        corners = [[pick(a, (n >> s) & 1) for a, s in (("i", 2), ("j", 1), ("k", 0))] for n in range(8)]
        terms = [(" * ".join(w for w, _ in c), *(at for _, at in c)) for c in corners]
    slices_ = {}
    for w, i, j, k in terms:
        slices_.setdefault(i, []).append((w, j, k))
    rows = [d.struct(i=i, p=d.array(*(d.struct(w=w, at=f"({j}) * nk + {k}") for w, j, k in ps))) for i, ps in slices_.items()]
    weight = d.total(d.each("(s).p", "e_", "e_.w"))
    total = d.total(d.each("(s).p", "e_", f"CASE WHEN e_.w > 0 THEN e_.w * {d.at('v.pixels', 'e_.at')} ELSE cast(0 AS double) END"))
    inner = f"SELECT {columns}, away, s, (s).i AS i FROM (SELECT {columns}, away, {d.rows(d.array(*rows))} AS s FROM ({placed}) a) b"
    return f"""SELECT {key}, series_id, round(CASE WHEN max(CASE WHEN away THEN 1 ELSE 0 END) = 1 THEN {quote(cval)} ELSE sum(part) END, 6) AS value FROM (
  SELECT {', '.join('w.' + k.strip() for k in key.split(','))}, w.series_id, away, {total} AS part FROM (SELECT * FROM ({inner}) c WHERE {weight} > 0) w JOIN slices v ON v.series_id = w.series_id AND v.i = w.i) x GROUP BY {key}, series_id"""


@operator
def reslice_plane(d: Dialect, order: int = 1, boundary: str = "nearest", cval: float = 0.0) -> str:
    """Samples of every plane: order 0 or 1 (others are brought to these), places outside clamped or of a constant value."""
    return f"SELECT series_id, kind, r, c, value FROM ({sampled(d, 'SELECT series_id, kind, r, c, x, y, z FROM plane_to_world', 'kind, r, c', order, boundary, cval)}) s"


@operator
def orthogonal_planes(d: Dialect) -> str:
    """The middle plane of each axis: one pass over the voxels."""
    one = lambda kind, axis, n, r, c: f"CASE WHEN v.{axis} = cast(floor({n} / 2) AS int) THEN {d.struct(kind=repr(kind), r=r, c=c)} END"
    each = d.array(one("axial", "i", "depth", "v.j", "v.k"), one("coronal", "j", "nj", "v.i", "v.k"), one("sagittal", "k", "nk", "v.i", "v.j"))
    return f"""SELECT series_id, (p).kind AS kind, (p).r AS r, (p).c AS c, value FROM (SELECT v.series_id, value, {d.rows(each)} AS p FROM voxels v JOIN geometry g ON g.series_id = v.series_id
  WHERE v.i = cast(floor(depth / 2) AS int) OR v.j = cast(floor(nj / 2) AS int) OR v.k = cast(floor(nk / 2) AS int)) q WHERE p IS NOT NULL"""


@operator
def downsample_planes(d: Dialect, enlarge: int = 50, factor: float = 0.33, least: int = 96, viewport: int = 512, samples: int = 3) -> str:
    """Reduced sampling grid of previews of planes ``enlarge`` times as fine: sides up to ``least`` stay, others shrink by ``factor`` but not below it, and the viewport's sides shrink and bound them the same way; slabs have at most ``samples`` samples."""
    small = lambda n: f"CASE WHEN {n} <= {least} THEN {n} ELSE greatest({least}, {d.even(f'{factor} * ({n})')}) END"
    side = lambda n: f"cast(least({small(n)}, {small(str(viewport))}) AS int)"
    return f"""SELECT series_id, kind, full_width, full_height, {side('full_width')} AS width, {side('full_height')} AS height, round(step * full_width / {side('full_width')}, 6) AS column_step, round(step * full_height / {side('full_height')}, 6) AS row_step,
  {samples} AS max_samples FROM (SELECT series_id, kind, step, width * {enlarge} AS full_width, height * {enlarge} AS full_height FROM planes) q"""


@operator
def mip_slab(d: Dialect, thickness: float = 5.0, max_samples: int | None = None) -> str:
    """Maximum, minimum, mean and sum of a slab on every plane: as many samples along the normal as steps fit its thickness, centred on the plane, at most ``max_samples`` spread over the same depth."""
    n = cross("u", "v")
    normal = ", ".join(f"{v} AS n{c}" for c, v in zip(XYZ, n, strict=True))
    along = " + ".join(f"abs({' + '.join(f'd{a}{c} * n{c}' for c in XYZ)})" for a in "ijk")
    count = f"greatest(1, cast(ceil(round({quote(thickness)} / step_n, 9)) AS int))"
    kept = count if max_samples is None else f"least({count}, {max(1, max_samples)})"
    offset = "CASE WHEN kept = 1 THEN cast(0 AS double) ELSE (2 * m / cast(kept - 1 AS double) - 1) * (full_n - 1) / 2 * step_n END"
    planes_ = f"""SELECT series_id, kind, m, {', '.join(f'c{c} + ({offset}) * n{c} AS c{c}' for c in XYZ)}, ux, uy, uz, vx, vy, vz, step, width, height FROM (
  SELECT *, {d.rows(d.span('0', 'kept - 1'))} AS m FROM (SELECT *, {count} AS full_n, {kept} AS kept FROM (SELECT *, 1 / greatest({along}, 1e-6) AS step_n FROM (
    SELECT p.*, {normal}, {', '.join(f'g.d{a}{c}' for a in 'ijk' for c in XYZ)} FROM planes p JOIN geometry g ON g.series_id = p.series_id) a) b) e) f"""
    places = f"SELECT series_id, kind, m, cast(r AS int) AS r, cast(c AS int) AS c, x, y, z FROM ({grid(d, '(' + planes_ + ') s')}) g"
    return f"""SELECT series_id, kind, r, c, max(value) AS maximum, min(value) AS minimum, round(avg(value) + 1e-7, 3) AS average, round(sum(value) + 1e-7, 2) AS total
FROM ({sampled(d, places, 'kind, m, r, c', 1, 'nearest', 0.0)}) v GROUP BY series_id, kind, r, c"""


@operator
def coronal_mip(d: Dialect) -> str:
    """Maximum over rows, head first."""
    return "SELECT v.series_id, depth - 1 - v.i AS r, k AS c, max(value) AS value FROM voxels v JOIN geometry g ON g.series_id = v.series_id GROUP BY v.series_id, depth, v.i, k"


@operator
def region_box_values(d: Dialect) -> str:
    """Voxels inside the oriented box of each enabled region: the slices that the box can reach, then their pixels."""
    reach = " + ".join(f"abs({' + '.join(f'di{c} * {a}{c}' for c in XYZ)}) * h{h}" for a, h in zip("uvw", XYZ, strict=True))
    inside = " AND ".join(f"abs({' + '.join(f'({world("i", "j", "k", c)} - c{c}) * {a}{c}' for c in XYZ)}) <= h{h} + 1e-6" for a, h in zip("uvw", XYZ, strict=True))
    reached = f"SELECT r.*, {', '.join('g.' + c for c in (*(a + x for a in 'oijk' for x in XYZ), 'nk', 'voxel_mm3'))}, {index('di', 'cx', 'cy', 'cz')} AS mid, {reach} + 1e-6 AS reach FROM regions r JOIN geometry g ON g.series_id = r.series_id WHERE enabled"
    inner = f"SELECT b.*, s.i, s.pixels FROM ({reached}) b JOIN slices s ON s.series_id = b.series_id AND s.i BETWEEN floor(mid - reach) AND ceil(mid + reach)"
    return f"""SELECT series_id, region_id, mode, threshold, i, j, k, value, voxel_mm3 FROM (SELECT *, cast(floor(p / nk) AS int) AS j, cast(p % nk AS int) AS k FROM ({d.pixels(inner)}) x) y WHERE {inside}"""


@operator
def region_stats(d: Dialect) -> str:
    """Statistics of each region's voxels over its threshold; a percentile threshold is that of its box's values."""
    return f"""SELECT series_id, region_id, round(effective, 6) AS effective_threshold_hu, {STATS} FROM (
  SELECT *, CASE WHEN mode = 'percentile' THEN lower_ + (upper_ - lower_) * share ELSE least(greatest(threshold, -1024), 3071) END AS effective FROM (
    SELECT *, max(CASE WHEN place = floor(rank_) THEN value END) OVER b AS lower_, max(CASE WHEN place = ceil(rank_) THEN value END) OVER b AS upper_, rank_ - floor(rank_) AS share FROM (
      SELECT *, round(threshold / 100 * (n - 1), 9) AS rank_ FROM (SELECT *, row_number() OVER (PARTITION BY series_id, region_id ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY series_id, region_id) AS n FROM region_box_values) o) p
    WINDOW b AS (PARTITION BY series_id, region_id)) q) v WHERE value > effective GROUP BY series_id, region_id, effective"""


@operator
def sphere_stats(d: Dialect) -> str:
    """Statistics of the voxels in each sphere: the slices that it can reach, then their pixels."""
    norm = f"sqrt({dot('di', 'di')})"
    reached = f"SELECT s.*, greatest(s.radius, 1e-6) AS rr, {', '.join('g.' + c for c in (*(a + x for a in 'oijk' for x in XYZ), 'nk', 'voxel_mm3'))}, {index('di', 'cx', 'cy', 'cz')} AS mid, (s.radius + 1e-6) * {norm} + 1e-6 AS reach FROM spheres s JOIN geometry g ON g.series_id = s.series_id"
    inner = f"SELECT b.*, v.i, v.pixels FROM ({reached}) b JOIN slices v ON v.series_id = b.series_id AND v.i BETWEEN floor(mid - reach) AND ceil(mid + reach)"
    apart = " + ".join(f"power({world('i', 'j', 'k', c)} - c{c}, 2)" for c in XYZ)
    return f"""SELECT series_id, sphere_id, {STATS} FROM (SELECT *, cast(floor(p / nk) AS int) AS j, cast(p % nk AS int) AS k FROM ({d.pixels(inner)}) x) y WHERE {apart} <= rr * rr + 1e-6 GROUP BY series_id, sphere_id"""


@operator
def region_plane_mask(d: Dialect) -> str:
    """Samples of the resliced planes inside a region's box and over its effective threshold."""
    inside = " AND ".join(f"abs({' + '.join(f'(w.{c} - g.c{c}) * g.{a}{c}' for c in XYZ)}) <= h{h} + 1e-6" for a, h in zip("uvw", XYZ, strict=True))
    return f"""SELECT q.series_id, q.kind, q.r, q.c, g.region_id FROM reslice_plane q JOIN plane_to_world w ON w.series_id = q.series_id AND w.kind = q.kind AND w.r = q.r AND w.c = q.c
JOIN regions g ON g.series_id = q.series_id AND g.enabled JOIN region_stats t ON t.series_id = g.series_id AND t.region_id = g.region_id WHERE {inside} AND value > t.effective_threshold_hu"""


@operator
def mask_union(d: Dialect) -> str:
    """Samples in any region, with the number of regions."""
    return "SELECT series_id, kind, r, c, count(*) AS regions FROM region_plane_mask GROUP BY series_id, kind, r, c"


@operator
def mask_bbox(d: Dialect) -> str:
    """Normalised bounding box of each region's mask."""
    side = lambda e, n: f"({e}) / cast(max({n}) AS double)"
    return f"""SELECT m.series_id, m.kind, region_id, {side('min(c)', 'width')} AS x_min, {side('min(r)', 'height')} AS y_min, {side('max(c) + 1', 'width')} AS x_max, {side('max(r) + 1', 'height')} AS y_max
FROM region_plane_mask m JOIN planes p ON p.series_id = m.series_id AND p.kind = m.kind GROUP BY m.series_id, m.kind, region_id"""


@operator
def legacy_threshold_mask(d: Dialect, lower: float = -200.0, upper: float = 900.0, box: tuple[float, float, float, float] = (0.2, 0.1, 0.7, 0.9), opacity: float = 0.5) -> str:
    """Voxels of the middle slice between two bounds (swapped if reversed, clamped to -1024..3071) and inside a normalised box (x0, y0, x1, y1); none without opacity."""
    lo, hi = sorted(min(max(x, -1024.0), 3071.0) for x in (lower, upper))
    x0, y0, x1, y1 = (quote(float(v)) for v in box)
    return f"""SELECT v.series_id, v.i, j, k FROM voxels v JOIN geometry g ON g.series_id = v.series_id WHERE v.i = cast(floor(depth / 2) AS int) AND value BETWEEN {quote(lo)} AND {quote(hi)} AND {quote(float(opacity))} > 0
AND j >= floor({y0} * nj) AND j < ceil({y1} * nj) AND k >= floor({x0} * nk) AND k < ceil({x1} * nk)"""


@operator
def sphere_on_plane(d: Dialect) -> str:
    """Distance of each sphere from each plane and the radius it shows there."""
    n = cross("u", "v")
    return f"""SELECT series_id, kind, sphere_id, round(dist, 6) AS distance, abs(dist) <= radius AS intersects, round(sqrt(greatest(radius * radius - dist * dist, 0)), 6) AS shown FROM (
  SELECT p.series_id, p.kind, sphere_id, radius, {' + '.join(f'(s.c{c} - p.c{c}) * {v}' for c, v in zip(XYZ, n, strict=True))} AS dist FROM planes p JOIN spheres s ON s.series_id = p.series_id) q"""


@operator
def volume_extent_on_plane(d: Dialect) -> str:
    """Width and height that a volume's eight corners take on each plane."""
    end = lambda bit, n: f"CASE WHEN {bit} = 0 THEN -0.5 ELSE {n} - 0.5 END"
    at = ", ".join(f"{world(end('b % 2', 'depth'), end('floor(b / 2) % 2', 'nj'), end('floor(b / 4)', 'nk'), c)} AS {c}" for c in XYZ)
    on = lambda a: " + ".join(f"({c} - c{c}) * {a}{c}" for c in XYZ)
    return f"""SELECT p.series_id, kind, round(2 * max(abs({on('u')})), 6) AS width_mm, round(2 * max(abs({on('v')})), 6) AS height_mm FROM planes p JOIN (
  SELECT series_id, {at} FROM (SELECT *, {d.rows(d.span('0', '7'))} AS b FROM geometry) c) q ON q.series_id = p.series_id GROUP BY p.series_id, kind"""


def rotation_of(quaternion: tuple[float, float, float, float]) -> list[list[float]]:
    """Rotation matrix of a quaternion (x, y, z, w) of any length; none for zero."""
    size = sum(q * q for q in quaternion) ** 0.5
    x, y, z, w = (q / size for q in quaternion) if size > 1e-12 else (0.0, 0.0, 0.0, 1.0)
    v = (x, y, z)
    turn = lambda r, c: 0.0 if r == c else (-w if (c - r) % 3 == 1 else w) * v[3 - r - c]
    return [[2 * (v[r] * v[c] + turn(r, c)) + (1 - 2 * (1 - w * w) if r == c else 0.0) for c in range(3)] for r in range(3)]


@operator
def clip_volume(d: Dialect, polygon: tuple[tuple[float, float], ...] = ((0.1, 0.2), (0.9, 0.2), (0.6, 0.9)), quaternion: tuple[float, float, float, float] = (0.258819, 0.0, 0.0, 0.965926), keep_inside: bool = True) -> str:
    """Voxels outside (or inside) a polygon on the screen become air: places in millimetres from the centre, turned by a quaternion, normalised by the bounds of the turned volume. A polygon without extent changes nothing."""
    from voxtab.operators.roi import inside_polygon

    corners = [tuple(min(max(float(v), 0.0), 1.0) for v in p) for p in polygon]
    spread = [max(c) - min(c) for c in zip(*corners, strict=True)] if corners else [0.0, 0.0]
    if len(corners) < 3 or min(spread) < 1e-4:
        return "SELECT series_id, i, j, k, value FROM voxels"
    rows = rotation_of(quaternion)
    points = d.array(*(d.struct(x=quote(x), y=quote(y)) for x, y in corners))
    on = lambda row: " + ".join(f"{quote(r)} * m{a}" for r, a in zip(row, "kji", strict=True))
    reach = lambda row: " + ".join(f"{quote(abs(r))} * h{a}" for r, a in zip(row, "kji", strict=True))
    half = lambda a: f"(n{a} - 1) / cast(2 AS double)"
    step = lambda a: f"greatest(g.s{a}, 1e-6)"
    placed = ", ".join(f"(v.{a} - {half(a)}) * {step(a)} AS m{a}, {half(a)} * {step(a)} AS h{a}" for a in "ijk")
    xs, ys = zip(*corners, strict=True)
    inside = f"x BETWEEN {quote(min(xs))} AND {quote(max(xs))} AND y BETWEEN {quote(min(ys))} AND {quote(max(ys))} AND {inside_polygon(d, 'polygon', 'x', 'y')}"
    kept = inside if keep_inside else f"NOT ({inside})"
    return f"""SELECT series_id, i, j, k, CASE WHEN {kept} THEN value ELSE air END AS value FROM (
  SELECT series_id, i, j, k, value, air, round((sx + bx) / greatest(2 * bx, 1e-6), 9) AS x, round(1 - (up + by_) / greatest(2 * by_, 1e-6), 9) AS y, {points} AS polygon FROM (
    SELECT *, {on(rows[0])} AS sx, {on(rows[2])} AS up, {reach(rows[0])} AS bx, {reach(rows[2])} AS by_ FROM (
      SELECT v.series_id, v.i, v.j, v.k, v.value, a.air, {placed} FROM (SELECT v.*, m.depth AS ni, m.nj, m.nk FROM voxels v JOIN geometry m ON m.series_id = v.series_id) v
      JOIN air_value a ON a.series_id = v.series_id JOIN spacings g ON g.series_id = v.series_id) p) t) w"""


@operator
def orientation_text(d: Dialect, least: float = 0.1, most: int = 3) -> str:
    """Letters of each plane's row direction: components over ``least``, largest first, at most ``most``."""
    parts = d.array(*(d.struct(priority=n, size_=f"abs({a})", letter=f"CASE WHEN {a} >= 0 THEN '{p}' ELSE '{m}' END") for n, (a, p, m) in enumerate((("vx", "L", "R"), ("vy", "P", "A"), ("vz", "S", "I")))))
    return f"""SELECT series_id, kind, {d.joined('letter', '', 'place')} AS letters FROM (SELECT series_id, kind, (x).letter AS letter, row_number() OVER (PARTITION BY series_id, kind ORDER BY (x).size_ DESC, (x).priority) AS place FROM (
  SELECT series_id, kind, {d.rows(parts)} AS x FROM planes) a WHERE (x).size_ > {quote(float(least))}) b WHERE place <= {most} GROUP BY series_id, kind"""


@operator
def location_text(d: Dialect) -> str:
    """Position of each series' second slice along the three body axes, in millimetres with two places."""
    one = lambda c, minus, plus: f"CASE WHEN {c} < 0 THEN '{minus}' ELSE '{plus}' END || {d.format('%.2f', d.even(f'abs({c})', 2))}"
    return f"SELECT series_id, {one('z', 'I', 'S')} AS location_z, {one('y', 'A', 'P')} AS location_y, {one('x', 'R', 'L')} AS location_x FROM (SELECT series_id, ox + ix AS x, oy + iy AS y, oz + iz AS z FROM geometry) q"


@operator
def hashed_grid(d: Dialect, most: int = 12) -> str:
    """Mask samples in order of a mixing of row and column, the first of each plane: a repeatable sample."""
    mix = "((r * 7919 + c * 104729) * 31 + 17) % 65521"
    return f"SELECT series_id, kind, r, c FROM (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY {mix}, r, c) AS place FROM mask_union) q WHERE place <= {most}"
