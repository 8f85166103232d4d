"""Sorted hash arrays in files of the shared folder, which workers map into their memory.

Keys are 64-bit hashes; file k of n holds the keys in the k-th of n equal ranges, sorted, and their values in files beside it.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STRIDE = 1 << 21  # key k of file f has the number f * STRIDE + k


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def part_column(key: str, parts: int) -> Column:
    return F.expr(f"CAST(shiftright(shiftrightunsigned({key}, 33) * {parts}L, 31) AS INT)")


class Files:
    """The arrays of a folder by kind and number, mapped when first read; empty where there is no file."""

    def __init__(self, folder: str) -> None:
        self.folder, self.held = folder, {}

    def __call__(self, kind: str, k: int) -> np.ndarray:
        if (kind, k) not in self.held:
            path = f"{self.folder}/{kind}-{k}.npy"
            self.held[kind, k] = np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else np.zeros(0, np.uint64)
        return self.held[kind, k]

    def save(self, kind: str, k: int, values: np.ndarray) -> None:
        if len(values):
            path = f"{self.folder}/{kind}-{k}"
            np.save(made := f"{path}.{uuid.uuid4().hex}.npy", values)
            os.replace(made, f"{path}.npy")

    def find(self, kind: str, parts: int, hashes: np.ndarray, values: tuple[str, ...]) -> list[np.ndarray]:
        """For sorted hashes their numbers, or -1 where absent, and their values, or 0."""
        part = part_of(hashes, parts)
        out = [np.full(len(hashes), -1, np.int64), *(np.zeros(len(hashes), np.int64) for _ in values)]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
            k = int(part[a])
            own, some = self(kind, k), hashes[a:b]
            if len(own):
                at = np.minimum(np.searchsorted(own, some), len(own) - 1)
                hit = own[at] == some
                out[0][a:b] = np.where(hit, k * STRIDE + at, -1)
                for x, value in zip(out[1:], values, strict=True):
                    x[a:b] = np.where(hit, self(value, k)[at], 0)
        return out


def small(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n
