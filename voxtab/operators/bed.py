"""Bed removal over slabs of slices, so that no task holds a series.

Each series is cut into slabs; a slab's task also gets the slices within reach of its morphology on both sides (halo rows).
Masks are labelled within a slab as runs of voxels; runs that touch over a slab border are edges, and their connected
components make labels of the whole series. Shapes are aggregates over runs. What is kept goes back to the slabs as runs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.helpers import grids
from voxtab.operators import pixels
from voxtab.operators.graph import components, shared_dir

#: Slices of a slab.
SLAB = 16
#: Slices that closing and opening look at, and that growing looks at.
REACH, GROWN = 4, 2
#: HU: lower end of the masks, dense voxels that always stay.
LEAST_HU, DENSE_HU = -520.0, 350.0

RUNS = "j array<int>, k0 array<int>, k1 array<int>, node array<bigint>"


def with_halo(slices: DataFrame, size: int, reach: int) -> DataFrame:
    """slices once for each slab that looks at them; ``core`` tells whether the slab owns the slice."""
    place = lambda shift: F.floor((F.col("i") + shift) / size)
    out = slices.withColumn("slab", F.explode(F.sequence(place(-reach), place(reach))))
    return out.withColumn("core", F.col("slab") == place(0))


def bed_info(slices: DataFrame) -> DataFrame:
    """Size, HU bounds, value of air and slabs of planes of each series."""
    size = slices.groupBy("series_id").agg((F.max("i") + 1).alias("ni"), F.max("rows_").alias("nj"), F.max("columns_").alias("nk"))
    planes = pixels.bed_slabs(slices=slices).groupBy("series_id").agg(F.collect_list(F.struct("axis", "begin_", "end_")).alias("planes"))
    return size.join(pixels.bed_thresholds(slices=slices), "series_id").join(pixels.air_value(slices=slices), "series_id").join(planes, "series_id", "left")


def _volume(frame: pd.DataFrame) -> np.ndarray:
    nj, nk = int(frame["nj"].iloc[0]), int(frame["nk"].iloc[0])
    return np.stack([np.asarray(p, dtype=float).reshape(nj, nk) for p in frame["pixels"]])


def masks(volume: np.ndarray, seed: float, candidate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed, candidate, dense and body masks of a volume."""
    finite = np.isfinite(volume)
    v = np.where(finite, volume, -1e30)
    floor, top = max(88.0, min(125.0, seed - 15)), max(candidate + 45, seed + 58)
    return (v >= LEAST_HU) & (v <= seed), (v >= LEAST_HU) & (v <= candidate), v >= DENSE_HU, (v >= floor) & (v <= top)


def _labels(frame: pd.DataFrame) -> pd.DataFrame:
    """Labelled runs of the closed seed and the cleaned body mask, a row for each slice that the slab owns."""
    frame = frame.sort_values("i", ignore_index=True)
    core = np.flatnonzero(frame["core"])
    if not len(core):
        return pd.DataFrame(columns=["series_id", "i", "kind", "j", "k0", "k1", "node"])
    first = frame.iloc[0]
    seed, _, _, body = masks(_volume(frame), first["seed_hu"], first["candidate_hu"])
    closed = lambda m: grids.erode(grids.dilate(m))
    rows = []
    for kind, mask in (("bed", closed(seed)), ("body", grids.dilate(grids.erode(closed(body))))):
        z, j, k0, k1, root = grids.label_runs(mask[core[0] : core[-1] + 1])
        i = frame["i"].to_numpy()[core[0]] + z
        node = ((i.astype(np.int64) * first["nj"] + j) * first["nk"] + k0)[root]
        for n in np.unique(i):
            own = i == n
            rows.append((first["series_id"], n, kind, j[own], k0[own], k1[own], node[own]))
    return pd.DataFrame(rows, columns=["series_id", "i", "kind", "j", "k0", "k1", "node"])


def _shape_tests() -> dict[str, Column]:
    """Whether a component is bed or body, from its voxels v, its box (i0, i1, ...) and the size of its series."""
    axes = ("i", "j", "k")
    span = {a: F.expr(f"({a}1 - {a}0) / n{a}") for a in axes}
    spans = F.sort_array(F.array(*span.values()))
    fill = F.expr("v / ((i1 - i0) * (j1 - j0) * (k1 - k0))")
    touches = F.expr(" OR ".join(f"{a}0 <= 1 OR {a}1 >= n{a} - 1" for a in axes))
    shell = F.expr(" OR ".join(f"least({a}0, n{a} - {a}1) / n{a} <= 0.08" for a in axes))
    flat = (spans[2] >= 0.48) & (spans[0] <= 0.18) & (fill <= 0.68)
    rail = (spans[2] >= 0.40) & (spans[1] <= 0.24) & (fill <= 0.58)
    broad = touches & (spans[2] >= 0.55) & (fill <= 0.44)
    middle = F.expr(" + ".join(f"cast(({a}0 + {a}1) / 2 / n{a} BETWEEN 0.12 AND 0.88 AS int)" for a in axes)) >= 2
    thick = (spans[1] >= 0.16) & (spans[0] >= 0.055) & (fill >= 0.08)
    compact = (spans[1] >= 0.12) & (fill >= 0.16) & middle
    least = lambda most, share: F.expr(f"v >= greatest({most}, bround(ni * nj * nk * {share}))")
    bed = least(48, 0.00003) & (touches & (flat | rail | broad) | shell & (flat | rail))
    body = least(64, 0.00005) & (~touches & (thick | compact) | middle & thick & (fill >= 0.12))
    return {"bed": bed, "body": body}


def kept_runs(labels: DataFrame, info: DataFrame, size: int) -> DataFrame:
    """series_id, i, bed, body: runs (j, k0, k1) of each slice that belong to components of such a shape; labels: written."""
    runs = labels.select("series_id", "i", "kind", F.inline(F.arrays_zip("j", "k0", "k1", "node")))
    node = F.struct("series_id", "kind", "node")
    below = runs.filter(F.col("i") % size == size - 1).select("series_id", "kind", (F.col("i") + 1).alias("i"), "j", F.col("k0").alias("x0"), F.col("k1").alias("x1"), node.alias("a"))
    above = runs.filter((F.col("i") % size == 0) & (F.col("i") > 0)).select("series_id", "kind", "i", "j", "k0", "k1", node.alias("b"))
    edges = below.join(above, ["series_id", "kind", "i", "j"]).filter("x0 < k1 AND k0 < x1").select("a", "b").distinct()
    roots = components(edges).select(F.col("node.series_id").alias("series_id"), F.col("node.kind").alias("kind"), F.col("node.node").alias("node"), F.col("root.node").alias("root"))
    box = [f(c).alias(n) for f, c, n in ((F.min, "i", "i0"), (F.max, F.col("i") + 1, "i1"), (F.min, "j", "j0"), (F.max, F.col("j") + 1, "j1"), (F.min, "k0", "k0"), (F.max, "k1", "k1"))]
    parts = runs.groupBy("series_id", "kind", "node").agg(F.sum(F.col("k1") - F.col("k0")).alias("v"), *box)
    parts = parts.join(roots, ["series_id", "kind", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    whole = parts.groupBy("series_id", "kind", "root").agg(F.sum("v").alias("v"), *[f(c).alias(c) for c, f in (("i0", F.min), ("i1", F.max), ("j0", F.min), ("j1", F.max), ("k0", F.min), ("k1", F.max))])
    tests = _shape_tests()
    kept = whole.join(info.select("series_id", "ni", "nj", "nk"), "series_id").filter(F.when(F.col("kind") == "bed", tests["bed"]).otherwise(tests["body"]))
    kept = parts.join(kept.select("series_id", "kind", "root"), ["series_id", "kind", "root"]).select("series_id", "kind", "node")
    found = runs.join(kept, ["series_id", "kind", "node"], "left_semi")
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("j", "k0", "k1"))).alias(kind)
    return found.groupBy("series_id", "i").agg(of("bed"), of("body"))


def _painted(frame: pd.DataFrame, kind: str, nj: int, nk: int) -> np.ndarray:
    out = np.zeros((len(frame), nj, nk), dtype=bool)
    for z, runs in enumerate(frame[kind]):
        for r in runs if runs is not None else ():
            out[z, r["j"], r["k0"] : r["k1"]] = True
    return out


def _filled(frame: pd.DataFrame) -> pd.DataFrame:
    """The slices that the slab owns, with air for bed voxels."""
    frame = frame.sort_values("i", ignore_index=True)
    core = np.flatnonzero(frame["core"])
    if not len(core):
        return pd.DataFrame(columns=["series_id", "i", "pixels"])
    first, own = frame.iloc[core[0]], frame.iloc[core]
    nj, nk, i = int(first["nj"]), int(first["nk"]), own["i"].to_numpy()
    grown = lambda kind, times: grids.dilate(_painted(frame, kind, nj, nk), times)[core[0] : core[-1] + 1]
    volume = _volume(own)
    _, candidate, dense, _ = masks(volume, first["seed_hu"], first["candidate_hu"])
    bed, body = grown("bed", 1), grown("body", 2)
    for plane in first["planes"] if first["planes"] is not None else ():
        inside = lambda at, p=plane: (at >= p["begin_"]) & (at < p["end_"])
        at = {"i": inside(i)[:, None, None], "j": inside(np.arange(nj))[None, :, None], "k": inside(np.arange(nk))[None, None, :]}
        bed = bed | at[plane["axis"]]
    volume[bed & candidate & ~dense & ~body] = first["air"]
    return pd.DataFrame({"series_id": own["series_id"].to_numpy(), "i": i, "pixels": [a.ravel() for a in volume]})


def remove_bed(slices: DataFrame, size: int = SLAB) -> DataFrame:
    """series_id, i, pixels of each series (series_id, i from 0, rows_, columns_, pixels, label) with its bed as air.

    Bed are parts of the closed seed mask that are flat, rail-like or broad and lie at the edge, grown by one voxel, and thin slabs of planes full
    of candidates; dense voxels and the body, grown by two, stay. Values that are no numbers come back as NaN.
    """
    info = bed_info(slices)
    folder = f"{shared_dir(slices.sparkSession)}/bed-{uuid.uuid4().hex}"
    info.write.parquet(f"{folder}/info")
    info = slices.sparkSession.read.parquet(f"{folder}/info")
    known = slices.select("series_id", "i", "pixels").join(info, "series_id")
    rows = with_halo(known.drop("planes", "air", "ni"), size, REACH)
    rows.groupBy("series_id", "slab").applyInPandas(_labels, f"series_id string, i int, kind string, {RUNS}").write.parquet(f"{folder}/labels")
    kept = kept_runs(slices.sparkSession.read.parquet(f"{folder}/labels"), info, size)
    rows = with_halo(known.join(kept, ["series_id", "i"], "left"), size, GROWN)
    rows = rows.withColumn("pixels", F.when(F.col("core"), F.col("pixels")))
    out = rows.groupBy("series_id", "slab").applyInPandas(_filled, "series_id string, i int, pixels array<double>")
    return out.withColumn("pixels", F.transform("pixels", lambda x: F.coalesce(x, F.lit(float("nan")))))  # pandas has made nulls of them

