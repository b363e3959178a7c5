"""Slices and voxels: rescaling, windows, statistics, histograms, colour and storage."""

from __future__ import annotations

from voxtab.plans.statement import Dialect, operator, quote, view

#: Colour stops of each preset: (position, red, green, blue); fixed values.
PRESETS = {
    "blackbody": ((0.00, "000000"), (0.22, "5b0f00"), (0.46, "c73a00"), (0.70, "ffb000"), (1.00, "fff6d5")),
    "bw": ((0.00, "000000"), (0.36, "3f3f3f"), (0.70, "9f9f9f"), (1.00, "ffffff")),
    "bwinverse": ((0.00, "ffffff"), (0.34, "b8b8b8"), (0.68, "626262"), (1.00, "000000")),
    "cardiac": ((0.00, "09111c"), (0.24, "124d79"), (0.46, "1da6a6"), (0.72, "f4d35e"), (1.00, "f1635e")),
    "hotiron": ((0.00, "000000"), (0.24, "520000"), (0.48, "b10d0d"), (0.72, "ff7a00"), (1.00, "fff2bf")),
    "pet": ((0.00, "14003d"), (0.18, "1b4cff"), (0.38, "00b7ff"), (0.56, "1de5a3"), (0.78, "ffe14a"), (1.00, "ff4d5a")),
    "petct-rainbow": ((0.00, "000000"), (0.12, "3a0000"), (0.30, "8d0000"), (0.52, "e21b00"), (0.72, "ff8a00"), (0.88, "ffe100"), (1.00, "fffef0")),
    "rainbow": ((0.00, "5b00d6"), (0.18, "1558ff"), (0.34, "00b0ff"), (0.52, "00cf7c"), (0.74, "ffd000"), (1.00, "ff5d39")),
}


@operator
def rescale_pixels(d: Dialect) -> str:
    """Stored gray values times slope (1 if there is none) plus intercept (0); negated for MONOCHROME1."""
    inner = d.pixels("SELECT * FROM stored_slices WHERE photometric <> 'RGB'")
    return f"""SELECT series_id, i, cast(floor(p / columns_) AS int) AS j, cast(p % columns_ AS int) AS k, (value * coalesce(slope, 1) + coalesce(intercept, 0)) * CASE WHEN photometric = 'MONOCHROME1' THEN -1 ELSE 1 END AS value FROM ({inner}) v"""


@operator
def rescale_color(d: Dialect) -> str:
    """Colour samples as 8 bits: times 255 over the greatest value of their bits, or over the slice's own maximum where bits are not stated; clipped and truncated."""
    inner = d.pixels(f"SELECT *, CASE WHEN bits_stored IS NOT NULL THEN power(2, bits_stored) - 1 ELSE greatest({d.most_of('pixels')}, 1e-9) END AS top FROM stored_slices WHERE photometric = 'RGB'")
    return f"SELECT series_id, i, cast(floor(p / columns_) AS int) AS j, cast(p % columns_ AS int) AS k, cast(floor(least(greatest(value * 255 / top, 0), 255)) AS int) AS value FROM ({inner}) v"


@operator
def slice_range(d: Dialect) -> str:
    """Extremes, 1st, 5th, 95th and 99th percentile of each slice."""
    return f"""SELECT series_id, i, min(value) AS lo, max(value) AS hi, round({d.percentile('value', 0.01)}, 6) AS p1, round({d.percentile('value', 0.05)}, 6) AS p5,
  round({d.percentile('value', 0.95)}, 6) AS p95, round({d.percentile('value', 0.99)}, 6) AS p99 FROM (SELECT series_id, i, CASE WHEN abs(value) < 1e300 THEN value END AS value FROM voxels) v GROUP BY series_id, i"""


@operator
def default_window(d: Dialect) -> str:
    """Window of each slice: the header's, else from its extremes."""
    return """SELECT r.series_id, r.i, CASE WHEN window_width > 0 AND window_center IS NOT NULL THEN window_width ELSE greatest(1, hi - lo) END AS ww, CASE WHEN window_width > 0 AND window_center IS NOT NULL THEN window_center ELSE (hi + lo) / 2 END AS wl
FROM slice_range r JOIN stored_slices s ON s.series_id = r.series_id AND s.i = r.i"""


@operator
def percentile_window(d: Dialect, ww: float | None = None, wl: float | None = None) -> str:
    """Low and high of each slice: a given window's, else 1st and 99th percentile, the extremes where they meet, and one more where those do; (0, 1) without finite values."""
    if ww is not None and ww > 0 and wl is not None:
        return f"SELECT series_id, i, {quote(wl - ww / 2)} AS low, {quote(wl + ww / 2)} AS high FROM slice_range"
    return "SELECT series_id, i, coalesce(CASE WHEN p99 > p1 THEN p1 ELSE lo END, 0) AS low, coalesce(CASE WHEN p99 > p1 THEN p99 WHEN hi > lo THEN hi ELSE lo + 1 END, 1) AS high FROM slice_range"


@view
def volume_extent(d: Dialect) -> str:
    """Finite values of each series: number, extremes, those over -700, bounds of the middle, low HU; whether it looks like CT, and then has enough foreground."""
    return f"""SELECT *, is_ct AND n_air >= greatest(64, floor(n * 0.0005)) AS is_ct_hu,
  n < 16 OR high <= low OR (n <= 50 AND n - CASE WHEN lo < low THEN 1 ELSE 0 END - CASE WHEN hi > high THEN 1 ELSE 0 END < 16) AS whole FROM (
  SELECT v.series_id, count(value) AS n, min(value) AS lo, max(value) AS hi, count(CASE WHEN value > -700 THEN 1 END) AS n_air, {d.percentile('value', 0.02)} AS low, {d.percentile('value', 0.998)} AS high,
    cast(count(CASE WHEN value BETWEEN -950 AND -300 THEN 1 END) AS double) / greatest(1, count(value)) AS low_fraction,
    coalesce(max(CASE WHEN trim(modality) = '' THEN NULL ELSE upper(trim(modality)) END) IN ('CT', 'CTA', 'CBCT'), min(value) <= -850 AND max(value) >= 80) AS is_ct
  FROM (SELECT series_id, CASE WHEN abs(value) < 1e300 THEN value END AS value FROM voxels) v JOIN image_series s ON s.series_id = v.series_id GROUP BY v.series_id) q"""


#: Percentiles of the foreground of a volume.
PERCENTS = (10, 25, 50, 75, 90, 95, 99, 99.5)


@operator
def volume_percentiles(d: Dialect) -> str:
    """Percentiles, size and dense values of the foreground of each series: values over -700 of what is CT, else the middle from the 2nd to the 99.8th percentile, all if that is too small."""
    cols = ", ".join(f"round({d.percentile('value', p / 100)}, 6) AS p{str(p).replace('.', '_')}" for p in PERCENTS)
    return f"""SELECT v.series_id, {cols}, count(*) AS foreground_count, count(CASE WHEN value >= 350 THEN 1 END) AS dense, count(CASE WHEN value >= 1000 THEN 1 END) AS very_dense FROM voxels v JOIN volume_extent t ON t.series_id = v.series_id
WHERE abs(value) < 1e300 AND CASE WHEN is_ct_hu THEN value > -700 WHEN whole THEN true ELSE value BETWEEN low AND high END GROUP BY v.series_id"""


@operator
def intensity_stats(d: Dialect) -> str:
    """Summary of each series: extremes, sizes, percentiles of the foreground, fractions, and whether it is CT in HU; fixed values without a finite value."""
    none = (0, 0, 0, 0.25, 0.5, 0.75, 1, 1)
    cols = ", ".join(f"coalesce(p{str(p).replace('.', '_')}, {v}) AS p{str(p).replace('.', '_')}" for p, v in zip(PERCENTS, none, strict=True))
    share = lambda c: f"coalesce(round(cast({c} AS double) / greatest(1, foreground_count), 6), 0)"
    return f"""SELECT e.series_id, coalesce(lo, 0) AS lo, coalesce(hi, 1) AS hi, coalesce(foreground_count, 0) AS foreground_count, n AS sample_count, coalesce(round(cast(foreground_count AS double) / greatest(1, n), 6), 0) AS foreground_fraction,
  {cols}, round(low_fraction, 6) AS low_hu_fraction, {share('dense')} AS dense_foreground_fraction, {share('very_dense')} AS very_dense_foreground_fraction, coalesce(is_ct_hu, false) AS is_ct_hu
FROM volume_extent e LEFT JOIN volume_percentiles p ON p.series_id = e.series_id"""


@operator
def pet_default_window(d: Dialect, unit: str = "source") -> str:
    """Window of a PET volume: fixed for SUV units, else from 0 (or the 1st percentile below it) to the 99.5th percentile of positive values."""
    if unit.startswith("SUV") or unit == "SUL":
        return "SELECT series_id, cast(4.49 AS double) AS ww, cast(2.245 AS double) AS wl FROM image_series WHERE modality IN ('PT', 'PET')"
    return f"""SELECT series_id, round(greatest(high - low, 1), 6) AS ww, round((high + low) / 2, 6) AS wl FROM (
  SELECT v.series_id, CASE WHEN min(value) >= 0 THEN 0 ELSE {d.percentile('value', 0.01)} END AS low, coalesce({d.percentile('CASE WHEN value > 0 THEN value END', 0.995)}, {d.percentile('value', 0.995)}) AS high
  FROM voxels v JOIN image_series s ON s.series_id = v.series_id WHERE modality IN ('PT', 'PET') GROUP BY v.series_id) q"""


@operator
def window_to_uint8(d: Dialect, fused: bool = False) -> str:
    """Slices as gray values of their window, clipped and truncated; no range is black, or one wide if ``fused``."""
    high = "CASE WHEN high <= low THEN low + 1 ELSE high END" if fused else "high"
    return f"""SELECT series_id, i, j, k, cast(CASE WHEN top <= low THEN 0 ELSE floor((least(greatest(value, low), top) - low) * 255 / (top - low)) END AS int) AS gray
FROM (SELECT v.series_id, v.i, v.j, v.k, value, low, {high} AS top FROM voxels v JOIN percentile_window w ON w.series_id = v.series_id AND w.i = v.i) q"""


@operator
def histogram_256(d: Dialect) -> str:
    """Counts of each slice's values in 256 bins between its extremes."""
    return """SELECT v.series_id, v.i, cast(CASE WHEN hi > lo THEN floor((value - lo) * 255 / (hi - lo)) ELSE 0 END AS int) AS bin, count(*) AS n
FROM voxels v JOIN slice_range r ON r.series_id = v.series_id AND r.i = v.i GROUP BY 1, 2, 3"""


@operator
def otsu_threshold(d: Dialect) -> str:
    """First bin of the greatest between-class variance of each slice's histogram."""
    return """SELECT series_id, i, cast(bin AS int) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY round(between_, 6) DESC, bin) AS place FROM (
  SELECT series_id, i, bin, CASE WHEN w0 = 0 OR w0 = total THEN 0 ELSE w0 * (total - w0) * power(s0 / w0 - (all_ - s0) / (total - w0), 2) END AS between_ FROM (
    SELECT series_id, i, bin, cast(sum(n) OVER a AS double) AS w0, cast(sum(n * bin) OVER a AS double) AS s0, cast(sum(n) OVER w AS double) AS total, cast(sum(n * bin) OVER w AS double) AS all_
    FROM histogram_256 WINDOW a AS (PARTITION BY series_id, i ORDER BY bin ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY series_id, i)) p) q) r WHERE place = 1"""


@view
def colour_stops(d: Dialect) -> str:
    """Stops of the colour presets on the scale 0..255, each with the one after it."""
    rows = []
    for name, stops in PRESETS.items():
        for (a, x), (b, y) in zip(stops, stops[1:], strict=False):
            c = [str(int(v[n : n + 2], 16)) for v in (x, y) for n in (0, 2, 4)]
            rows.append(f"('{name}', {a * 255:.2f}, {b * 255:.2f}, {', '.join(c)})")
    return f"SELECT preset, cast(a AS double) AS a, cast(b AS double) AS b, r0, g0, b0, r1, g1, b1 FROM (VALUES {', '.join(rows)}) v(preset, a, b, r0, g0, b0, r1, g1, b1)"


@view
def colour_table(d: Dialect) -> str:
    """256 colours of each preset, linear between stops, truncated."""
    mix = lambda c: f"cast(floor({c}0 + ({c}1 - {c}0) * (gray - a) / (b - a) + 1e-9) AS int) AS {c if c != 'b' else 'b_'}"
    return f"""SELECT preset, cast(gray AS int) AS gray, {mix('r')}, {mix('g')}, cast(floor(b0 + (b1 - b0) * (gray - a) / (b - a) + 1e-9) AS int) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY preset, gray ORDER BY a) AS place FROM (SELECT {d.rows(d.span('0', '255'))} AS gray) n JOIN colour_stops ON gray >= a - 1e-9 AND gray <= b + 1e-9) q WHERE place = 1"""


@operator
def pseudocolor(d: Dialect, preset: str = "hotiron") -> str:
    """Windowed slices through a preset's colours; the part before a colon is cut, unknown presets are ``bw``."""
    name = preset.split(":")[-1].strip().lower()
    return f"SELECT p.series_id, p.i, p.j, p.k, c.r, c.g, c.b FROM window_to_uint8 p JOIN colour_table c ON c.preset = {quote(name if name in PRESETS else 'bw')} AND c.gray = p.gray"


@operator
def montage_pixels(d: Dialect, ct_preset: str = "bw", pet_preset: str = "pet", unit: str = "SUVbw") -> str:
    """The middle slice of each series, in display values for PET, windowed by its percentiles and coloured."""
    middle = f"""SELECT v.series_id, v.j, v.k, s.modality, v.value * CASE WHEN s.modality IN ('PT', 'PET') THEN coalesce(f.factor, 1) ELSE 1 END AS value FROM voxels v JOIN image_series s ON s.series_id = v.series_id AND v.i = cast(floor(s.depth / 2) AS int)
  LEFT JOIN pet_scale f ON f.series_id = v.series_id AND f.unit = {quote(unit)}"""
    return f"""SELECT g.series_id, g.j, g.k, c.r, c.g, c.b FROM (SELECT series_id, j, k, modality, cast(floor((least(greatest(value, low), high) - low) * 255 / (high - low) + 1e-9) AS int) AS gray FROM (
  SELECT m.*, CASE WHEN p99 > p1 THEN p1 ELSE lo END AS low, CASE WHEN p99 > p1 THEN p99 WHEN hi > lo THEN hi ELSE lo + 1 END AS high FROM ({middle}) m JOIN (
    SELECT series_id, min(value) AS lo, max(value) AS hi, {d.percentile('value', 0.01)} AS p1, {d.percentile('value', 0.99)} AS p99 FROM ({middle}) a GROUP BY series_id) r ON r.series_id = m.series_id) w) g
JOIN colour_table c ON c.preset = CASE WHEN g.modality IN ('PT', 'PET') THEN {quote(pet_preset)} ELSE {quote(ct_preset)} END AND c.gray = g.gray"""


@operator
def storage_type(d: Dialect) -> str:
    """Smallest lossless type of each series."""
    return """SELECT series_id, CASE WHEN whole AND lo >= -32768 AND hi <= 32767 THEN 'int16' WHEN whole AND lo >= 0 AND hi <= 65535 THEN 'uint16' ELSE 'float32' END AS dtype FROM (
  SELECT series_id, min(value) AS lo, max(value) AS hi, bool_and(abs(value - round(value)) <= 1e-5) AS whole FROM voxels GROUP BY series_id) q"""


@operator
def rescale_for_export(d: Dialect) -> str:
    """Slope and intercept that bring each series to 16 bits."""
    return "SELECT series_id, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / 65535 ELSE 1 END AS slope, min(value) AS intercept FROM voxels GROUP BY series_id"


@operator
def encode_uint16(d: Dialect) -> str:
    """Voxels as unsigned 16-bit numbers of their series' slope and intercept, half-even; not finite ones as the intercept, all 0 without a slope."""
    return f"""SELECT v.series_id, i, j, k, cast(CASE WHEN abs(slope) < 1e-12 OR NOT coalesce(abs(value) < 1e300, false) THEN 0 ELSE least(greatest({d.even('round((value - intercept) / slope, 6)')}, 0), 65535) END AS int) AS stored
FROM voxels v JOIN rescale_for_export e ON e.series_id = v.series_id"""


@operator
def air_value(d: Dialect) -> str:
    """Value of air in each series, from its finite values; 0 without any."""
    return """SELECT series_id, coalesce(CASE WHEN lo <= -300 THEN least(lo, -1000) ELSE lo - 0.05 * greatest(hi - lo, 1) END, 0) AS air FROM (
  SELECT series_id, min(value) AS lo, max(value) AS hi FROM (SELECT series_id, CASE WHEN abs(value) < 1e300 THEN value END AS value FROM voxels) v GROUP BY series_id) r"""


@operator
def bed_thresholds(d: Dialect) -> str:
    """Seed and candidate HU of each series from quartiles of its finite values over -700, of all if those are fewer than 32; 130 and 180 without any."""
    q = lambda p: f"CASE WHEN count(CASE WHEN value > -700 THEN 1 END) >= 32 THEN {d.percentile('CASE WHEN value > -700 THEN value END', p)} ELSE {d.percentile('value', p)} END"
    return f"""SELECT series_id, CASE WHEN p50 IS NULL THEN 180 ELSE greatest(seed + 24, least(230, greatest(p75 + 10, seed + 36))) END AS candidate_hu, coalesce(seed, 130) AS seed_hu FROM (
  SELECT *, CASE WHEN p50 IS NOT NULL THEN greatest(80, least(180, greatest(p25 + 28, p50 + 12))) END AS seed FROM (
    SELECT series_id, round({q(0.25)}, 6) AS p25, round({q(0.5)}, 6) AS p50, round({q(0.75)}, 6) AS p75 FROM (SELECT series_id, CASE WHEN abs(value) < 1e300 THEN value END AS value FROM voxels) v GROUP BY series_id) a) b"""


@operator
def plane_fractions(d: Dialect, low: float = -520.0, dense: float = 350.0) -> str:
    """Share of candidate (``low`` to the series' bound) and dense voxels in every plane of every axis, one pass over the voxels."""
    axes = d.array(*(d.struct(axis=f"'{a}'", idx=f"v.{a}") for a in "ijk"))
    share = lambda lo, hi: f"round(avg(CASE WHEN value BETWEEN {lo} AND {hi} THEN cast(1 AS double) ELSE 0 END), 6)"
    return f"""SELECT series_id, (a).axis AS axis, (a).idx AS idx, {share(quote(low), 'candidate_hu')} AS candidate, {share(quote(dense), '1e300')} AS dense FROM (
  SELECT v.series_id, value, candidate_hu, {d.rows(axes)} AS a FROM voxels v JOIN bed_thresholds t ON t.series_id = v.series_id) q GROUP BY series_id, (a).axis, (a).idx"""


@operator
def boolean_runs(d: Dialect, share: float = 0.5) -> str:
    """Maximal runs of planes whose candidate share is over a bound."""
    return f"""SELECT series_id, axis, cast(min(idx) AS int) AS begin_, cast(max(idx) + 1 AS int) AS end_ FROM (
  SELECT *, idx - row_number() OVER (PARTITION BY series_id, axis ORDER BY idx) AS island FROM plane_fractions WHERE candidate > {quote(share)}) q GROUP BY series_id, axis, island"""


@operator
def bed_slabs(d: Dialect, most_dense: float = 0.018) -> str:
    """Thin runs of planes near an edge that are full of candidates and not dense."""
    return f"""SELECT series_id, axis, begin_, end_ FROM (SELECT series_id, axis, length_, cast(min(idx) AS int) AS begin_, cast(max(idx) + 1 AS int) AS end_ FROM (
  SELECT f.*, length_, idx - row_number() OVER (PARTITION BY f.series_id, f.axis ORDER BY idx) AS island FROM plane_fractions f JOIN (
    SELECT series_id, axis, count(*) AS length_, {d.percentile('candidate', 0.84)} AS p84 FROM plane_fractions GROUP BY series_id, axis HAVING count(*) >= 8) t
    ON t.series_id = f.series_id AND t.axis = f.axis WHERE candidate >= greatest(0.07, 0.78 * p84) AND dense <= {quote(most_dense)}) q GROUP BY series_id, axis, length_, island) r
WHERE end_ - begin_ <= greatest(2, {d.even('0.12 * length_')}) AND least(begin_, length_ - end_) <= 0.28 * length_"""


@operator
def sample_slices(d: Dialect, n: int = 48) -> str:
    """Slices of a representative sample: all of a short series, else ``n`` places spread evenly, half-even."""
    return f"""SELECT DISTINCT series_id, cast(CASE WHEN depth <= {n} THEN n ELSE {d.even(f'round(n * (depth - 1) / cast({max(1, n - 1)} AS double), 9)')} END AS int) AS i FROM (
  SELECT series_id, depth, {d.rows(d.span('0', str(n - 1)))} AS n FROM image_series) q WHERE depth > {n} OR n < depth"""


@view
def border_pixels(d: Dialect) -> str:
    """Voxels with whether they are at the edge of their slice."""
    return "SELECT v.series_id, v.i, value, j = 0 OR k = 0 OR j = nj - 1 OR k = nk - 1 AS edge FROM voxels v JOIN image_series s ON s.series_id = v.series_id"


@operator
def slice_scores(d: Dialect) -> str:
    """Content score of each sampled slice: foreground against the border's median, times its spread."""
    return f"""SELECT series_id, i, round(CASE WHEN hi <= lo OR finite_n < 16 THEN 0 ELSE least(ratio, 0.72) * greatest(p99 - p1, spread) END, 6) AS score FROM (
  SELECT v.series_id, v.i, lo, hi, p1, p99, avg(CASE WHEN abs(value - back) > greatest(0.06 * (p99 - p1), CASE WHEN lo >= 0 AND hi <= 255 THEN 1 ELSE 8 END) THEN cast(1 AS double) ELSE 0 END) AS ratio,
    coalesce({d.percentile('CASE WHEN abs(value - back) > greatest(0.06 * (p99 - p1), CASE WHEN lo >= 0 AND hi <= 255 THEN 1 ELSE 8 END) THEN value END', 0.95)} - {d.percentile('CASE WHEN abs(value - back) > greatest(0.06 * (p99 - p1), CASE WHEN lo >= 0 AND hi <= 255 THEN 1 ELSE 8 END) THEN value END', 0.05)}, 0) AS spread, count(value) AS finite_n
  FROM voxels v JOIN sample_slices s ON s.series_id = v.series_id AND s.i = v.i JOIN slice_range r ON r.series_id = v.series_id AND r.i = v.i
  JOIN (SELECT series_id, i, {d.percentile('value', 0.5)} AS back FROM border_pixels WHERE edge GROUP BY series_id, i) b ON b.series_id = v.series_id AND b.i = v.i
  GROUP BY v.series_id, v.i, lo, hi, p1, p99) q"""


@operator
def representative_slice(d: Dialect) -> str:
    """The slice with the best score, of equals (and of all if none has any) the one nearest the middle."""
    return """SELECT series_id, i, score FROM (SELECT s.series_id, s.i, score, row_number() OVER (PARTITION BY s.series_id ORDER BY round(score, 6) DESC, abs(s.i - (depth - 1) / 2.0), s.i) AS place
FROM slice_scores s JOIN image_series m ON m.series_id = s.series_id) q WHERE place = 1"""


@operator
def pet_background(d: Dialect) -> str:
    """PET slices with values at or below the border's level lowered under the window."""
    return f"""SELECT v.series_id, v.i, v.j, v.k, CASE WHEN level > low AND value <= level THEN low - greatest(1, 0.02 * (high - low)) ELSE value END AS value FROM voxels v JOIN (
  SELECT w.series_id, w.i, low, high, least(p75, low + 0.35 * (high - low)) AS level FROM percentile_window w JOIN (
    SELECT series_id, i, round({d.percentile('value', 0.75)}, 6) AS p75 FROM border_pixels WHERE edge GROUP BY series_id, i) b ON b.series_id = w.series_id AND b.i = w.i) t
  ON t.series_id = v.series_id AND t.i = v.i JOIN image_series s ON s.series_id = v.series_id WHERE s.modality IN ('PT', 'PET')"""


@operator
def select_preset(d: Dialect) -> str:
    """Volume preset of a series from modality, words of its and its study's description and fractions of dense values."""
    has = lambda *w: "(" + " OR ".join(f"words LIKE '%{x}%'" for x in w) + ")"
    return f"""SELECT s.series_id, CASE WHEN modality IN ('MR', 'MRI') THEN CASE WHEN {has('angio', 'mra', 'vessel')} THEN 'mrAngio' WHEN {has('mip')} THEN 'mrMip' ELSE 'mrDefault' END
  WHEN modality = 'CBCT' OR {has('cbct', 'cone beam')} THEN CASE WHEN {has('bone2', 'bone 2')} THEN 'cbctBone2' WHEN {has('bone')} THEN 'cbctBone' ELSE 'cbctRealist' END
  WHEN modality IN ('CT', 'CTA') OR is_ct_hu THEN CASE WHEN {has('coronary')} THEN 'coronaryCta' WHEN {has('carotid')} THEN 'carotid' WHEN {has('neck')} AND {has('cta', 'angio', 'vessel')} THEN 'neckCta'
    WHEN {has('cta', 'angio', 'vessel')} THEN 'bodyCta' WHEN {has('hardware', 'metal', 'implant')} THEN 'hardware' WHEN {has('plate', 'screw')} THEN 'bonePlusPlate' WHEN {has('fracture')} THEN 'fracture'
    WHEN {has('lumbar', 'spine', 'vertebra')} THEN 'lumbar' WHEN {has('lung', 'chest')} OR low_hu_fraction >= 0.24 THEN 'lung'
    WHEN dense_foreground_fraction >= 0.18 AND very_dense_foreground_fraction >= 0.04 THEN 'hardware' WHEN dense_foreground_fraction >= 0.22 THEN 'bones' ELSE 'aaa' END ELSE 'bone' END AS preset
FROM intensity_stats s JOIN (SELECT series_id, upper(trim(coalesce(modality, ''))) AS modality, lower(replace(replace(coalesce(modality, '') || ' ' || coalesce(series_description, '') || ' ' || coalesce(study_description, ''), '_', ' '), '-', ' ')) AS words FROM image_series) m ON m.series_id = s.series_id"""
