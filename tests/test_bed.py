"""Bed removal over slabs against one piece of numpy."""

import numpy as np
import pytest

from voxtab.helpers import grids
from voxtab.operators import bed


def plain(v):
    """The same rules on a whole volume, labels by minima along axes."""
    finite = np.isfinite(v)
    fore = v[finite & (v > -700)]
    fore = fore if fore.size >= 32 else v[finite]
    p25, p50, p75 = np.percentile(fore, [25, 50, 75])
    seed_hu = max(80, min(180, max(p25 + 28, p50 + 12)))
    cand_hu = max(seed_hu + 24, min(230, max(p75 + 10, seed_hu + 36)))
    at = lambda lo, hi: finite & (v >= lo) & (v <= hi)
    cand, dense = at(-520, cand_hu), finite & (v >= 350)
    close = lambda m: grids.erode(grids.dilate(m))
    shape = np.array(v.shape)

    def parts(mask, least):
        ids, n = grids.label(mask)
        for m in range(1, n + 1):
            where = np.argwhere(ids == m)
            if len(where) >= least:
                lo, hi = where.min(axis=0), where.max(axis=0) + 1
                span = sorted((hi - lo) / shape)
                yield ids == m, lo, hi, span, len(where) / np.prod(hi - lo), bool(((lo <= 1) | (hi >= shape - 1)).any())

    keep = np.zeros(v.shape, bool)
    for m, lo, hi, span, fill, touch in parts(close(at(-520, seed_hu)), max(48, round(v.size * 3e-5))):
        shell = (np.minimum(lo, shape - hi) / shape <= 0.08).any()
        flat, rail = span[2] >= 0.48 and span[0] <= 0.18 and fill <= 0.68, span[2] >= 0.4 and span[1] <= 0.24 and fill <= 0.58
        if touch and (flat or rail or (span[2] >= 0.55 and fill <= 0.44)) or shell and (flat or rail):
            keep |= m
    remove = grids.dilate(keep)
    body = np.zeros(v.shape, bool)
    for m, lo, hi, span, fill, touch in parts(grids.dilate(grids.erode(close(at(max(88, min(125, seed_hu - 15)), max(cand_hu + 45, seed_hu + 58))))), max(64, round(v.size * 5e-5))):
        mid = (((lo + hi) / 2 / shape >= 0.12) & ((lo + hi) / 2 / shape <= 0.88)).sum() >= 2
        thick, compact = span[1] >= 0.16 and span[0] >= 0.055 and fill >= 0.08, span[1] >= 0.12 and fill >= 0.16 and mid
        if not touch and (thick or compact) or mid and thick and fill >= 0.12:
            body |= m
    for axis in range(3):
        if shape[axis] < 8:
            continue
        others = tuple(a for a in range(3) if a != axis)
        full = (cand.mean(axis=others) >= max(0.07, np.percentile(cand.mean(axis=others), 84) * 0.78)) & (dense.mean(axis=others) <= 0.018)
        edge = np.flatnonzero(np.diff(np.r_[0, full.astype(int), 0]))
        for lo, hi in zip(edge[::2], edge[1::2], strict=True):
            if hi - lo <= max(2, round(shape[axis] * 0.12)) and min(lo, shape[axis] - hi) <= 0.28 * shape[axis]:
                np.moveaxis(remove, axis, 0)[lo:hi] = True
    out = v.copy()
    out[remove & cand & ~dense & ~grids.dilate(body, 2)] = min(v[finite].min(), -1000) if v[finite].min() <= -300 else v[finite].min() - 0.05 * max(np.ptp(v[finite]), 1)
    return out


def phantom(rng, n=26, m=20):
    """A body with bone on a curved table, air, noise, a rail and some values that are no numbers."""
    z, y, x = np.indices((n, m, m))
    v = np.full((n, m, m), -1000.0) + rng.normal(0, 20, (n, m, m))
    v[((y - 8) / 5.0) ** 2 + ((x - 10) / 7.0) ** 2 < 1] = 60
    v[((y - 8) / 4.0) ** 2 + ((x - 10) / 5.0) ** 2 < 1] = 110
    v[((y - 8) ** 2 + (x - 10) ** 2 < 3)] = 700
    table = (y == 16 + (abs(x - 10) > 6)) & (x > 2)
    v[table] = -60 + rng.normal(0, 10, table.sum())
    v[(y > 17) & (x < 2)] = 30
    v[rng.random(v.shape) < 0.01] = rng.choice([np.nan, 100.0, 400.0, -300.0])
    return v


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_slabs_are_one_piece(spark, size):
    rng = np.random.default_rng(1)
    volumes = {"a": phantom(rng), "b": phantom(rng, 9, 30), "c": rng.choice([-1000.0, -100.0, 50.0, 120.0, 500.0], (12, 10, 10), p=[0.4, 0.2, 0.2, 0.15, 0.05]), "d": np.full((3, 8, 8), np.nan)}
    rows = [(s, i, 1, v.shape[1], v.shape[2], v[i].ravel().tolist()) for s, v in volumes.items() for i in range(len(v))]
    df = spark.createDataFrame(rows, "series_id string, i int, label int, rows_ int, columns_ int, pixels array<double>")
    got = {(r["series_id"], r["i"]): np.array(r["pixels"]) for r in bed.remove_bed(df, size).collect()}
    assert len(got) == len(rows)
    for s, v in volumes.items():
        want = plain(v) if s != "d" else v
        assert s == "d" or (want != v)[np.isfinite(v)].sum() > 20
        for i in range(len(v)):
            np.testing.assert_allclose(got[s, i], want[i].ravel())


def test_runs_label_as_voxels_do():
    rng = np.random.default_rng(1)
    for _ in range(30):
        mask = rng.random((5, 6, 7)) < rng.uniform(0.1, 0.7)
        z, y, x0, x1, root = grids.label_runs(mask)
        ids = np.zeros(mask.shape, int)
        for n in range(len(z)):
            ids[z[n], y[n], x0[n] : x1[n]] = root[n] + 1
        want, _ = grids.label(mask)
        assert (ids > 0).tolist() == mask.tolist() and len(set(zip(ids[mask].tolist(), want[mask].tolist()))) == len(set(want[mask].tolist())) == len(set(ids[mask].tolist()))
