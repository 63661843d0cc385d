"""XXH64 hashes of word shingles, computed for many texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
SLICE = 1 << 16

# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotate(x * P2, 31) * P1


def xxh64_slices(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``buffer[start : start + length]`` for each pair; slices of equal length are hashed together."""
    if not len(starts):
        return np.empty(0, np.uint64)
    raw = np.concatenate((buffer, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(buffer) + 1,), "<u8", raw, strides=(1,))
    fours = np.ndarray((len(buffer) + 1,), "<u4", raw, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(ordered)) + 1, [len(order)])).tolist()
    with np.errstate(over="ignore"):
        first = np.uint64(seed)
        for low, high in zip(edges, edges[1:]):
            rows, n = order[low:high], int(ordered[low])
            at = starts[rows]
            done = 0
            if n >= 32:
                v = [np.full(len(at), x, np.uint64) for x in (first + P1 + P2, first + P2, first, first - P1)]
                while done + 32 <= n:
                    v = [_rotate(v[i] + eights[at + done + 8 * i] * P2, 31) * P1 for i in range(4)]
                    done += 32
                h = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
                for x in v:
                    h = (h ^ _lane(x)) * P1 + P4
            else:
                h = np.full(len(at), first + P5, np.uint64)
            h += np.uint64(n)
            while done + 8 <= n:
                h = _rotate(h ^ _lane(eights[at + done]), 27) * P1 + P4
                done += 8
            if done + 4 <= n:
                h = _rotate(h ^ (fours[at + done].astype(np.uint64) * P1), 23) * P2 + P3
                done += 4
            while done < n:
                h = _rotate(h ^ (raw[at + done].astype(np.uint64) * P5), 11) * P1
                done += 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts as lower-cased (A-Z) bytes in groups of about CHUNK_BYTES; null counts as empty."""
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8").lower()
        if group and size + len(raw) > CHUNK_BYTES:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield group


def shingle_hashes(group: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-joined word shingles of each text in order, and how many each text has.

    Words are runs of bytes other than ASCII white space. A text with fewer words than ``width`` has one
    shingle of all its words; one without words has none.
    """
    raw = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    text_ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
    gap = SPACE[raw]
    keep = ~gap
    keep[1:] |= keep[:-1].copy()
    at = np.flatnonzero(keep)
    joined = np.where(gap, np.uint8(32), raw)[at]
    ends = np.flatnonzero(gap[at])
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    upto = np.searchsorted(at[ends], text_ends)
    words = np.diff(upto, prepend=0)
    counts = np.maximum(words - width + 1, (words > 0).astype(np.int64))
    total = int(counts.sum())
    first = np.repeat(upto - words - (np.cumsum(counts) - counts), counts) + np.arange(total)
    last = np.minimum(first + width, np.repeat(upto, counts)) - 1
    s, n = starts[first], ends[last] - starts[first]
    parts = [xxh64_slices(joined, s[i : i + SLICE], n[i : i + SLICE], seed) for i in range(0, total, SLICE)]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts
