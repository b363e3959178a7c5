"""Volume statistics against numpy, and preset rules on hand-made statistics."""

import numpy as np
import pytest

from voxtab.operators import pixels, presets

NAMES = ("p10", "p25", "p50", "p75", "p90", "p95", "p99", "p99_5")
STATS = "series_id string, lo double, hi double, foreground_count bigint, " + ", ".join(f"{n} double" for n in NAMES) + ", low_hu_fraction double, dense_foreground_fraction double, very_dense_foreground_fraction double, is_ct_hu boolean"
P = (-50.0, 0.0, 40.0, 60.0, 100.0, 300.0, 600.0, 800.0)


def layers(spark, preset, ct=True, p=P, dense=0.05):
    stats = spark.createDataFrame([("S", -1000.0, 2000.0, 99, *p, 0.1, dense, 0.001, ct)], STATS)
    chosen = spark.createDataFrame([("S", preset)], "series_id string, preset string")
    return {r["layer"]: r for r in presets.adaptive_layers(intensity_stats=stats, select_preset=chosen).collect()}


def triple(r):
    return (r["enabled"], r["ww"], r["wl"], r["opacity"])


@pytest.mark.parametrize(
    ("preset", "ct", "want"),
    [
        ("aaa", True, {"softTissue": (True, 220, 75, 0.287), "blood": (True, 340, 200, 0.65), "bone": (True, 1220, 760, 0.74), "muscle": (False, 260, 125, 0.38), "lung": (False, 1500, -550, 0.22)}),
        ("coronaryCta", True, {"blood": (True, 420, 200, 0.68), "softTissue": (True, 240, 70, 0.1), "bone": (True, 1400, 800, 0.34)}),
        ("vesselOutline", True, {"blood": (True, 420, 200, 0.82), "softTissue": (False, 240, 70, 0.1)}),
        ("lung2", True, {"lung": (True, 1584, -688, 0.34), "bone": (True, 950, 600, 0.22), "softTissue": (True, 420, 70, 0.08)}),
        ("hardware", True, {"bone": (True, 1184, 800, 0.76), "softTissue": (False, 260, 70, 0.05)}),
        ("fracture", True, {"bone": (True, 1184, 600, 0.94), "softTissue": (True, 260, 70, 0.05)}),
        ("mip", True, {"bone": (True, 1258, 600, 0.42), "blood": (True, 576, 160, 0.82)}),
        ("red", True, {"softTissue": (True, 283.2, 70, 0.2), "bone": (True, 520, 115, 0.86), "muscle": (False, 320, 45, 0.55)}),
        ("muscle", True, {"muscle": (True, 240, 70, 0.54), "softTissue": (True, 283.2, 70, 0.24), "bone": (False, 500, 400, 1.0)}),
        ("mrAngio", False, {"custom": (True, 1184, 600, 0.72), "blood": (True, 1184, 600, 0.76), "bone": (False, 500, 400, 1.0)}),
        ("mrDefault", False, {"muscle": (True, 266, 70, 0.46), "softTissue": (True, 266, 70, 0.26), "lung": (False, 1500, -550, 0.22)}),
        ("aaa", False, {"softTissue": (True, 212.8, 70, 0.26), "blood": (True, 624, 180, 0.58), "bone": (True, 784, 600, 0.62), "muscle": (False, 260, 125, 0.38)}),
    ],
)
def test_adaptive_layers(spark, preset, ct, want):
    got = layers(spark, preset, ct)
    assert len(got) == 6
    for layer, values in want.items():
        assert triple(got[layer]) == pytest.approx(values, abs=1e-3), layer


def test_soft_distribution_and_colours(spark):
    soft = layers(spark, "aaa", p=(20.0, 45.0, 80.0, 110.0, 130.0, 150.0, 200.0, 240.0), dense=0.005)
    assert triple(soft["muscle"]) == pytest.approx((True, 280, 65, 0.34)) and triple(soft["bone"]) == pytest.approx((True, 520, 300, 0.58)) and triple(soft["blood"]) == pytest.approx((True, 220, 145, 0.55))
    assert layers(spark, "vesselOutline")["blood"]["color_start"] == "#ffe9a8" and layers(spark, "carotid")["blood"]["color_start"] == "#f6c45b" and layers(spark, "red")["bone"]["color_end"] == "#ff5b5b"


@pytest.mark.parametrize(("modality", "ct", "want"), [("CT", True, (220, 700, -5)), ("MR", True, (92.5, 152, 40)), (None, False, (92.5, 152, 40))])
def test_surfaces(spark, modality, ct, want):
    stats = spark.createDataFrame([("S", -1000.0, 2000.0, 99, *P, 0.1, 0.05, 0.001, ct), ("none", 0.0, 1.0, 0, *P, 0.0, 0.0, 0.0, True)], STATS)
    series = spark.createDataFrame([("S", modality), ("none", "CT")], "series_id string, modality string")
    got = {(r["series_id"], r["surface"]): r["iso"] for r in presets.surface_iso_value(intensity_stats=stats, image_series=series).collect()}
    assert tuple(got["S", n] for n in ("bone", "highDensity", "softTissue")) == want and got["none", "bone"] == 240 and got["none", "highDensity"] == 420


def test_intensity_stats(spark):
    rng = np.random.default_rng(3)
    volumes = {
        "ct": ("CT", np.r_[rng.normal(-1000, 10, 400), rng.normal(40, 30, 300), rng.normal(900, 200, 60), np.nan]),
        "little": ("CT", np.r_[rng.normal(-1000, 10, 700), rng.normal(40, 5, 60)]),
        "mr": ("MR", rng.gamma(2, 100, 500)),
        "unknown": (None, np.r_[np.full(200, -1000.0), rng.normal(100, 50, 200)]),
        "few": ("MR", rng.normal(0, 1, 12)),
        "seventeen": ("MR", rng.normal(0, 1, 17)),
        "flat": ("PT", np.full(30, 7.0)),
        "empty": ("CT", np.array([np.nan, np.inf])),
    }
    voxels = spark.createDataFrame([(s, i, 0, 0, float(x), 0) for s, (_, v) in volumes.items() for i, x in enumerate(v)], "series_id string, i int, j int, k int, value double, label int")
    series = spark.createDataFrame([(s, m) for s, (m, _) in volumes.items()], "series_id string, modality string")
    got = {r["series_id"]: r for r in pixels.intensity_stats(voxels=voxels, image_series=series).collect()}
    for s, (modality, raw) in volumes.items():
        v, r = raw[np.isfinite(raw)], got[s]
        if s == "empty":
            assert (r["lo"], r["hi"], r["p75"], r["sample_count"], r["is_ct_hu"]) == (0, 1, 0.25, 0, False)
            continue
        fore, ct = v[v > -700], modality == "CT" or (modality is None and v.min() <= -850 and v.max() >= 80)
        ct = ct and len(fore) >= max(64, int(len(v) * 0.0005))
        if not ct:
            lo, hi = np.percentile(v, [2, 99.8])
            fore = v[(v >= lo) & (v <= hi)] if len(v) >= 16 and hi > lo else v
            fore = fore if len(fore) >= 16 else v
        assert r["is_ct_hu"] == ct and r["foreground_count"] == len(fore) and r["sample_count"] == len(v), s
        np.testing.assert_allclose([r[n] for n in NAMES], np.percentile(fore, [10, 25, 50, 75, 90, 95, 99, 99.5]), atol=1e-5)
        assert r["dense_foreground_fraction"] == pytest.approx((fore >= 350).mean(), abs=1e-6) and r["low_hu_fraction"] == pytest.approx(((v >= -950) & (v <= -300)).mean(), abs=1e-6)
