"""Perceptual hash of small grey frames, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places to which coefficients are rounded, so that flat frames give no noise bits.
PLACES = 6


def cosine_basis(size: int, low: int) -> np.ndarray:
    """First rows of the unnormalised DCT-II matrix."""
    k, n = np.arange(low)[:, None], np.arange(size)[None, :]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * size))


def hash_frames(frames: np.ndarray, low: int = 8) -> np.ndarray:
    """Signed 64-bit hashes of frames (n, height, width): the low-frequency coefficients above their median."""
    rows, columns = cosine_basis(frames.shape[1], low), cosine_basis(frames.shape[2], low)
    c = np.round(rows @ frames.astype(np.float64) @ columns.T, PLACES).reshape(len(frames), -1)
    bits = c > np.median(c, axis=1, keepdims=True)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)


def phash(gray: Column, width: int = 32, height: int = 32, func: Callable[[np.ndarray], np.ndarray] = hash_frames) -> Column:
    """Fingerprint of a BINARY column of width x height grey bytes; null where the size is wrong.

    func maps frames (n, height, width) to n signed 64-bit hashes and may be replaced.
    """

    @F.pandas_udf("bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in parts:
            out = pd.Series([None] * len(raw), dtype="Int64")
            good = [i for i, b in enumerate(raw) if b is not None and len(b) == width * height]
            if good:
                frames = np.frombuffer(b"".join(raw.iloc[i] for i in good), np.uint8).reshape(-1, height, width)
                out.iloc[good] = func(frames)
            yield out

    return run(gray)
