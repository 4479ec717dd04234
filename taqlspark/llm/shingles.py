"""Hashes of a text's word shingles, which near-duplicate operators share.

Words are runs without ASCII white space, lower-cased in A-Z only. A text of fewer words than a shingle
counts as one shingle; a null text or one without words has none.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 16


def hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a UTF-8 text, in its order, repeats included."""
    import xxhash

    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(parts) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    return np.fromiter((digest(line[i:j], 42) for i, j in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))


def majority(hashed: np.ndarray) -> int:
    """The unsigned SimHash of hashes: the bits that are set in over half of them; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashed), _BLOCK):
        bits = np.unpackbits(hashed[k : k + _BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashed)).tobytes(), "big")
