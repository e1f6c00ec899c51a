"""FNV-1a hashes of ordered bytes, equal on every host: numbers are little-endian of a stated width.

They are sequential by definition, so they run over an already ordered, bounded object (a tour, a path system, a catalog); a graph's
snapshot is cut into blocks, whose effects are worked out apart and then applied in turn. Change detection inside a plan uses xxhash64.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

# The hash's basis and prime, the tour's own basis, and the names that start catalog hashes.
BASIS = 14695981039346656037
TOUR_BASIS = 1469598103934665603
PRIME = 1099511628211
COMPATIBILITY_NAME = b"CUDAEE_PATH_COMPATIBILITY_V1"
PATHS_NAME = b"CUDAEE_NORMALIZED_PATH_SYSTEM_V1"
TEMPLATES_NAME = b"CUDAEE_KOPT_RECONNECT_TEMPLATES_V1"
DISTANCE_CODES = {"EUC_2D": 0, "CEIL_2D": 1}

_MASK = (1 << 64) - 1


def fnv1a(data: bytes, basis: int = BASIS) -> int:
    h = basis
    for byte in data:
        h = ((h ^ byte) * PRIME) & _MASK
    return h


def effect(data: bytes) -> bytes:
    """What ``data`` does to any hash, for ``after``: the power of the prime that it multiplies by, and where it takes each of the 256 lowest bytes.

    A byte changes the lowest bits alone before all are multiplied, so a hash of low + rest ends at end(low) + rest * power. Runs of the data
    are walked side by side from all 256 values, then applied one after the other.
    """
    import numpy as np

    low = np.arange(256, dtype=np.uint64)
    runs = min(64, len(data) // 64) or 1
    each = len(data) // runs
    cells = np.frombuffer(data, np.uint8)
    end = low
    for part in (cells[: runs * each].reshape(runs, each), cells[runs * each :].reshape(1, -1)):
        h = np.repeat(low[None, :], len(part), axis=0)
        for column in part.T.astype(np.uint64):
            h ^= column[:, None]
            h *= np.uint64(PRIME)
        power = np.uint64(pow(PRIME, part.shape[1], 1 << 64))
        for one in h:
            first = end & np.uint64(255)
            end = one[first.astype(np.intp)] + (end - first) * power
    return struct.pack("<Q", pow(PRIME, len(data), 1 << 64)) + end.astype("<u8").tobytes()


def after(h: int, effects: Iterable[bytes]) -> int:
    """The hash ``h`` after blocks of these effects."""
    for e in effects:
        low = h & 255
        h = (struct.unpack_from("<Q", e, 8 + 8 * low)[0] + (h - low) * struct.unpack_from("<Q", e)[0]) & _MASK
    return h


def text(h: int) -> str:
    return f"{h:016x}"


def graph_head(kind: str, integer: bool, points: int) -> bytes:
    return struct.pack("<iBB", points, DISTANCE_CODES[kind], integer)


def graph_hash(kind: str, integer: bool, points: Iterable[tuple], edges: Iterable[tuple[int, int, int, bool]]) -> str:
    """Of a snapshot: points in id order (two integers, or two doubles), edges in edge_id order with their active flag."""
    points = list(points)
    out = [graph_head(kind, integer, len(points))]
    out += [struct.pack("<qq" if integer else "<dd", *p) for p in points]
    out += [struct.pack("<iiqB", u, v, w, a) for u, v, w, a in edges]
    return text(fnv1a(b"".join(out)))


def tour_hash(dimension: int, edges: Iterable[tuple[int, int]]) -> str:
    """Of a tour's undirected edges, sorted: neither start nor direction matters."""
    return text(fnv1a(struct.pack("<i", dimension) + b"".join(struct.pack("<ii", *e) for e in sorted(edges)), TOUR_BASIS))


def paths_hash(paths: list[list[int]]) -> str:
    out = [PATHS_NAME, struct.pack("<IQ", len(paths), sum(len(p) - 1 for p in paths))]
    out += [struct.pack(f"<I{len(p)}I", len(p), *p) for p in paths]
    return text(fnv1a(b"".join(out)))


def compatibility_hash(m: int, outside: int, inside: int, words: int, coverage: Iterable[int]) -> str:
    """Of a compatibility table, one row of 64-bit words for each inside matching."""
    return text(fnv1a(COMPATIBILITY_NAME + struct.pack("<4I", m, outside, inside, words) + b"".join(struct.pack("<Q", w) for w in coverage)))


def templates_hash(k: int, templates: list[list[int]]) -> str:
    return text(fnv1a(TEMPLATES_NAME + struct.pack("<II", k, len(templates)) + b"".join(bytes(t) for t in templates)))
