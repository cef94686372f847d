"""Arrays of unsigned integers as compact bytes, for shuffles of packed rows."""

from __future__ import annotations

import numpy as np


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, led by their number of bytes."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(raw.T).tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    body = [_planes(a) for a in arrays]
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", count, 4).tolist()
    at, out = 4 + 4 * count, []
    for n in sizes:
        width = raw[at]
        flat = np.zeros((n, 8), np.uint8)
        flat[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(flat.reshape(-1).view("<u8"))
        at += 1 + n * width
    return out


def differences(values: np.ndarray) -> np.ndarray:
    """Ascending values as differences."""
    return np.diff(values, prepend=np.uint64(0)) if len(values) else values
