"""Arrays of whole numbers as bytes for a shuffle: the eight planes of their bytes one behind another, compressed."""

from __future__ import annotations

import zlib

import numpy as np


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed_rising(x: np.ndarray) -> bytes:
    """Numbers that rise, as steps."""
    return packed(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpacked_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)
