"""Word shingles of texts as sorted 64-bit hashes, computed over whole batches with numpy."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_ODD, -1, 1 << 64))
_SALTS = np.array([((k * 0xD6E8FEB86659FD93) ^ 0xA5A5A5A5A5A5A5A5) & _MASK | 1 for k in range(1, 66)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: A random word for each byte value; white space (0x20, 0x09 to 0x0D) is told apart by _SPACE.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        _POWERS["up"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _ODD, dtype=np.uint64))])
        _POWERS["down"] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, _INVERSE, dtype=np.uint64))])
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each run of other than white space, in order."""
    b = np.frombuffer(data, dtype=np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The distinct ``size``-word shingles of each text, A-Z lower-cased; fewer words make one shingle."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    weight = 0

    def flush() -> None:
        words = word_hashes(b"\n".join(batch))
        counts = [len(x.split()) for x in batch]
        at = 0
        for n in counts:
            w = words[at : at + n]
            at += n
            k = min(size, n)
            if not k:
                out.append(np.zeros(0, dtype=np.uint64))
                continue
            h = np.full(n - k + 1, k, dtype=np.uint64)
            for j in range(k):
                h = h * np.uint64(_ODD) + w[j : n - k + 1 + j] * _SALTS[j % 64]
            out.append(np.unique(_mix(h)))

    for t in texts:
        batch.append((t or "").encode("utf-8", "surrogatepass").lower())
        weight += len(batch[-1])
        if weight > 1_000_000:
            flush()
            batch, weight = [], 0
    if batch:
        flush()
    return out
