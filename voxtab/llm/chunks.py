"""Texts as byte chunks for numpy models: Arrow batches in, small blocks of chunks out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column without nulls, one after the other, and the n + 1 offsets of its values."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), at


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, stride: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Up to ``rows`` chunks at a time: bytes (rows, length), how many of them are real, and the value they belong to.

    Chunks begin every ``stride`` bytes and cover every value whole; an empty value is one chunk of no bytes.
    """
    size = np.diff(offsets)
    count = np.maximum(1, -(-(size - (length - stride)) // stride))
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin, end = offsets[owner] + nth * stride, offsets[owner + 1]
    for lo in range(0, len(owner), rows):
        b, e = begin[lo : lo + rows], end[lo : lo + rows]
        at = b[:, None] + np.arange(length)
        inside = at < e[:, None]
        x = data[np.where(inside, at, 0)] if len(data) else np.zeros(at.shape, dtype=np.uint8)
        yield np.where(inside, x, 0), np.minimum(e - b, length), owner[lo : lo + rows]


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.weights[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.weights[k].dtype)
