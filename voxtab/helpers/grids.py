"""Numpy versions of a few grid filters: linear interpolation, smoothing, labels and binary morphology."""

from __future__ import annotations

import numpy as np


def gaussian(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian filter with radius 4 sigma and mirrored edges (edge values repeat)."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in range(a.ndim):
        wide = np.pad(a, [(r, r) if x == axis else (0, 0) for x in range(a.ndim)], mode="symmetric")
        a = sum(w[n] * np.take(wide, range(n, n + a.shape[axis]), axis=axis) for n in range(2 * r + 1))
    return a


def sample_linear(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Multilinear samples of a at points (points, ndim), coordinates clamped to the grid."""
    top = np.array(a.shape) - 1
    at = np.clip(at, 0, top)
    low = np.minimum(np.floor(at).astype(int), np.maximum(top - 1, 0))
    f = at - low
    out = np.zeros(len(at))
    for corner in np.ndindex(*(2,) * a.ndim):
        c = np.array(corner)
        out += np.prod(np.where(c == 1, f, 1 - f), axis=1) * a[tuple(np.minimum(low + c, top).T)]
    return out


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Face-connected components, numbered from 1, by repeated minima along runs of each axis."""
    ids = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        before = ids
        for axis in range(mask.ndim):
            for flip in (1, -1):
                a = np.moveaxis(ids, axis, 0)[::flip].copy()
                for n in range(1, len(a)):
                    both = (a[n] > 0) & (a[n - 1] > 0)
                    a[n][both] = np.minimum(a[n], a[n - 1])[both]
                ids = np.moveaxis(a[::flip], 0, axis)
        if (ids == before).all():
            break
    names, out = np.unique(ids, return_inverse=True)
    out = out.reshape(mask.shape)
    return (out, len(names) - 1) if names[0] == 0 else (out + 1, len(names))


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Binary dilation with the cross of face neighbours; outside is false."""
    for _ in range(times):
        out = mask.copy()
        for axis in range(mask.ndim):
            a, o = np.moveaxis(mask, axis, 0), np.moveaxis(out, axis, 0)
            o[1:] |= a[:-1]
            o[:-1] |= a[1:]
        mask = out
    return mask


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Binary erosion with the cross of face neighbours; outside is false."""
    for _ in range(times):
        wide = np.pad(mask, 1)
        out = wide.copy()
        for axis in range(mask.ndim):
            out &= np.roll(wide, 1, axis) & np.roll(wide, -1, axis)
        mask = out[tuple(slice(1, -1) for _ in range(mask.ndim))]
    return mask


def largest(mask: np.ndarray) -> np.ndarray:
    """The largest component; of equals the first."""
    ids, n = label(mask)
    return ids == np.bincount(ids.ravel())[1:].argmax() + 1 if n else mask


def label_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a 3-D mask along its last axis (z, y, first x, end x), and the first run of the face-connected component of each."""
    wide = np.zeros((*mask.shape[:2], mask.shape[2] + 2), dtype=np.int8)
    wide[:, :, 1:-1] = mask
    step = np.diff(wide, axis=2)
    z, y, x0 = np.nonzero(step == 1)
    x1 = np.nonzero(step == -1)[2]
    ids = np.full(mask.size, -1, dtype=np.int64)
    ids[mask.ravel()] = np.repeat(np.arange(len(z)), x1 - x0)
    ids = ids.reshape(mask.shape)
    pairs = [np.zeros(0, dtype=np.int64)]
    for a, b in ((ids[:, 1:], ids[:, :-1]), (ids[1:], ids[:-1])):
        both = (a >= 0) & (b >= 0)
        pairs.append(np.unique(a[both] * max(1, len(z)) + b[both]))
    a, b = np.divmod(np.concatenate(pairs), max(1, len(z)))
    root = np.arange(len(z))
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo < hi
        if not apart.any():
            return z, y, x0, x1, root
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]
