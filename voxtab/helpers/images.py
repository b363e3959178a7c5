"""Per-image and per-volume jobs: point-source MTF, phantom detection, components and hashed samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.helpers import grids
from voxtab.operators.graph import components


MTF = ("mtf50", "mtf10", "fwhm_w", "fwhm_h", "peak_value", "sample_count", "unit", "frequencies", "responses")


def _crossing(x: np.ndarray, y: np.ndarray, level: float) -> float | None:
    """First place, linear between points, where falling values reach a level; None if they do not."""
    at = np.flatnonzero((y[1:] <= level) & (y[:-1] >= level))
    if not len(at):
        return None
    n = at[0]
    fall = y[n] - y[n + 1]
    return float(x[n + 1] if fall <= 1e-12 else x[n] + (y[n] - level) / fall * (x[n + 1] - x[n]))


def _width(line: np.ndarray) -> float:
    """Full width at half of the maximum over the line's least value, in pixels; the pixels over the half if it is open on a side."""
    v = line - line.min()
    half, top = v.max() / 2, int(v.argmax())
    if v.max() <= 0:
        return 0.0
    sides = []
    for side in (v[top::-1], v[top:]):
        under = np.flatnonzero(side < half)
        if not len(under):
            return float((v >= half).sum())
        n = under[0]
        sides.append(n - 1 + (side[n - 1] - half) / (side[n - 1] - side[n]))
    return float(sum(sides))


def mtf_curve(image: np.ndarray, spacing: tuple[float, float] | float | None) -> dict:
    """Modulation transfer of a point source in a region of 5 x 5 pixels or more; nulls where it has none.

    The polarity with more contrast, less the 15th percentile; centre of mass around the smoothed peak; the centred square less
    the median of its border, windowed, transformed, averaged over rings of frequency, smoothed, made monotone.
    """
    dx, dy = (abs(s) if s else 1.0 for s in (spacing if isinstance(spacing, tuple) else (spacing, spacing)))
    raw = image.astype(float)
    empty = dict.fromkeys(MTF) | {"sample_count": int(raw.size), "unit": "lp/mm" if spacing else "lp/pixel"}
    if min(raw.shape) < 5 or not np.isfinite(raw).all():
        return empty
    middle = np.median(raw)
    dark = middle - raw.min() > raw.max() - middle
    a = -raw if dark else raw
    a = np.maximum(a - np.percentile(a, 15), 0)
    peak = np.array(np.unravel_index(grids.gaussian(a).argmax(), a.shape))
    lo, hi = np.maximum(0, peak - 5), np.minimum(a.shape, peak + 6)
    patch = a[lo[0] : hi[0], lo[1] : hi[1]]
    y, x = np.mgrid[lo[0] : hi[0], lo[1] : hi[1]]
    centre = np.array([(patch * y).sum(), (patch * x).sum()]) / patch.sum() if patch.sum() > 0 else peak.astype(float)
    size = min(a.shape) - (min(a.shape) + 1) % 2
    begin = (np.array(a.shape) - size) // 2
    y, x = np.mgrid[begin[0] : begin[0] + size, begin[1] : begin[1] + size]
    at = np.stack([y.ravel(), x.ravel()], axis=1) - (size // 2 - centre)
    psf = grids.sample_linear(a, at).reshape(size, size)
    psf = np.maximum(psf - np.median(np.r_[psf[0], psf[-1], psf[:, 0], psf[:, -1]]), 0)
    psf = psf * np.outer(np.hanning(size), np.hanning(size))
    if psf.sum() <= 0:
        return empty
    otf = np.abs(np.fft.fft2(psf / psf.sum()))
    ring = np.hypot(np.fft.fftfreq(size, dx)[None, :], np.fft.fftfreq(size, dy)[:, None]).ravel()
    top, n = min(0.5 / dx, 0.5 / dy), max(min(size // 2, 128), 8)
    edges = np.linspace(0, top, n + 1)
    bins = np.where(ring == top, n - 1, np.searchsorted(edges, ring, side="right") - 1)
    own = bins < n
    count = np.bincount(bins[own], minlength=n)
    mean = np.bincount(bins[own], otf.ravel()[own], minlength=n) / np.maximum(count, 1)
    filled = np.maximum.accumulate(np.where(count > 0, np.arange(n), 0))  # an empty ring has the one before
    mean = np.convolve(np.pad(mean[filled], 1, mode="edge"), np.ones(3) / 3, mode="valid")
    values = np.r_[1.0, np.minimum.accumulate(np.r_[1.0, np.clip(mean[1:], 0, 1)])]
    frequencies = np.r_[0.0, (edges[:-1] + edges[1:]) / 2]
    crossing = lambda level: round(frequencies[-1] if (f := _crossing(frequencies, values, level)) is None else f, 4)
    rows, columns = np.arange(a.shape[0], dtype=float), np.arange(a.shape[1], dtype=float)
    across = grids.sample_linear(a, np.stack([np.full(len(columns), centre[0]), columns], axis=1))
    down = grids.sample_linear(a, np.stack([rows, np.full(len(rows), centre[1])], axis=1))
    return empty | {
        "mtf50": crossing(0.5), "mtf10": crossing(0.1), "fwhm_w": round(_width(across) * dx, 4), "fwhm_h": round(_width(down) * dy, 4),
        "peak_value": float(raw.min() if dark else raw.max()), "frequencies": frequencies.round(6).tolist(), "responses": values.round(6).tolist(),
    }


def _images(frame: pd.DataFrame) -> list[np.ndarray]:
    """Pixels of slices as images; square ones where rows and columns are not given."""
    pixels = [np.asarray(p, dtype=float) for p in frame["pixels"]]
    if "rows_" not in frame:
        return [p.reshape(int(round(len(p) ** 0.5)), -1) for p in pixels]
    return [p.reshape(int(r), int(c)) for p, r, c in zip(pixels, frame["rows_"], frame["columns_"], strict=True)]


def _chosen(slices: DataFrame) -> DataFrame:
    return slices.select("series_id", "i", "pixels", *[c for c in ("rows_", "columns_") if c in slices.columns])


def mtf_analysis(slices: DataFrame, spacing: tuple[float, float] | float | None = 0.5) -> DataFrame:
    """MTF of the point source on each slice, with its curve (frequency, value); spacing of columns and rows in mm, none for pixels."""

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = [{"series_id": s, "i": i} | mtf_curve(a, spacing) for s, i, a in zip(frame["series_id"], frame["i"], _images(frame), strict=True)]
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in ("series_id", "i", *MTF)})

    found = _chosen(slices).mapInPandas(run, "series_id string, i int, mtf50 double, mtf10 double, fwhm_w double, fwhm_h double, peak_value double, sample_count bigint, unit string, frequencies array<double>, responses array<double>")
    curve = F.transform(F.arrays_zip("frequencies", "responses"), lambda p: F.struct(p["frequencies"].alias("frequency"), p["responses"].alias("value")))
    return found.withColumn("curve", curve).drop("frequencies", "responses")


def otsu(values: np.ndarray) -> int:
    """First threshold of the greatest between-class variance of 256 gray levels."""
    h = np.bincount(values.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    ok = (w > 0) & (w < w[-1])
    between = np.zeros(256)
    between[ok] = w[ok] * (w[-1] - w[ok]) * (s[ok] / w[ok] - (s[-1] - s[ok]) / (w[-1] - w[ok])) ** 2
    return int(between.argmax())


def find_phantom(image: np.ndarray) -> tuple[float, float, float] | None:
    """Centre and radius of the larger of the largest objects over and under the threshold that fills 2 to 90 % of the image."""
    finite = np.isfinite(image)
    if not finite.any() or (lo := image[finite].min()) >= (hi := image[finite].max()):
        return None
    gray = np.clip(np.where(finite, (np.where(finite, image, lo) - lo) * 255 / (hi - lo), 0), 0, 255).astype(int)
    at = max(8, otsu(gray))
    objects = sorted(map(grids.largest, (gray > at, (gray <= at) & finite)), key=np.count_nonzero, reverse=True)
    fits = [m for m in objects if 0.02 * m.size <= m.sum() <= 0.9 * m.size]
    if not fits:
        return None
    y, x = np.nonzero(fits[0])
    side = min(image.shape)
    radius = max(0.12 * side, min(0.92 * min(np.ptp(x) / 2, np.ptp(y) / 2, np.sqrt(len(x) / np.pi)), 0.46 * side))
    return float(x.mean()), float(y.mean()), float(radius)


def detect_phantom(slices: DataFrame) -> DataFrame:
    """Centre and radius of the phantom on each slice, with the slice's size (as ``phantoms`` of ``phantom_rois``); nulls where none is found."""

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            rows = [(s, i, *(find_phantom(a) or (None, None, None)), *a.shape) for s, i, a in zip(frame["series_id"], frame["i"], _images(frame), strict=True)]
            yield pd.DataFrame(rows, columns=["series_id", "i", "cx", "cy", "radius", "rows_", "columns_"])

    return _chosen(slices).mapInPandas(run, "series_id string, i int, cx double, cy double, radius double, rows_ int, columns_ int")


def largest_components(mask: DataFrame) -> DataFrame:
    """Face-connected components of mask voxels (series_id, i, j, k) and their sizes, by joins and star contractions."""
    v = mask.select("series_id", F.struct("series_id", "i", "j", "k").alias("node"), "i", "j", "k")
    edges = None
    for axis in "ijk":
        other = v.select(F.col("series_id").alias("s"), *[(F.col(c) - int(c == axis)).alias(c + "2") for c in "ijk"], F.col("node").alias("b"))
        found = v.join(other, (F.col("series_id") == F.col("s")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & (F.col("k") == F.col("k2"))).select(F.col("node").alias("a"), "b")
        edges = found if edges is None else edges.union(found)
    named = components(edges).select("node", "root")
    out = v.join(named, "node", "left").select("series_id", F.coalesce("root", "node").alias("root"))
    return out.groupBy("series_id", "root").agg(F.count("*").alias("voxels")).select("series_id", F.col("root.i").alias("i"), F.col("root.j").alias("j"), F.col("root.k").alias("k"), "voxels")


def hashed_sample_topk(pixels: DataFrame, k: int) -> DataFrame:
    """The k pixels (series_id, i, j, k, value) of each slice with the smallest 64-bit mix of row and column: a repeatable sample."""

    @F.pandas_udf("long")
    def mixed(row: pd.Series, col: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            h = row.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ col.to_numpy().astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return pd.Series((h ^ (h >> np.uint64(32))).view(np.int64))

    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("series_id", "i").orderBy("h", "j", "k"))
    out = pixels.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("h", mixed("j", "k")).withColumn("place", place)
    return out.filter(F.col("place") <= k).select("series_id", "i", (F.col("k") + 0.5).alias("x"), (F.col("j") + 0.5).alias("y"), "value")


def queries() -> dict:
    from voxtab.operators import bed
    from voxtab.plans.statement import REGISTRY, over_tables

    def read(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_tables(REGISTRY[name])(spark, sf_dir)

    return {
        "mtf_analysis": lambda s, d: mtf_analysis(read("slices", s, d)),
        "detect_phantom": lambda s, d: detect_phantom(read("slices", s, d)),
        "remove_bed": lambda s, d: bed.remove_bed(read("slices", s, d)),
        "largest_components": lambda s, d: largest_components(read("voxels", s, d).filter("value > 600")),
        "hashed_sample_topk": lambda s, d: hashed_sample_topk(read("voxels", s, d).filter("value > 0"), 12),
    }
