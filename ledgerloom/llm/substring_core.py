"""Arrays behind the repeated-substring operator: anchors of windows, and sorted suffixes. Used inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, 2 ** bits of each."""
    out = []
    for b in (_BASE, _INVERSE):
        x = np.array([1], np.uint64)
        step = b
        for _ in range(bits):
            x = np.concatenate((x, x * np.uint64(step)))
            step = step * step % (1 << 64)
        out.append(x)
    return out[0], out[1]


def window_runs(data: bytes, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `width` bytes with the same anchor, over texts joined in data (ends: where each ends).

    A window's anchor is the leftmost of its `gram`-byte strings with the least hash, so it depends on the
    window's bytes alone, and equal windows have equal anchors at the same place. Returns, for each run:
    hash of the anchor, hash of all bytes under the run (with the anchor's place in it), first window, windows, and
    the anchor's distance from the first window."""
    n = len(data)
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < width:
        return none
    powers, inverses = _powers(max(23, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[np.frombuffer(data, np.uint8)] * powers[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1])
    bits = np.uint64(n.bit_length())
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    reach, span = 1, width - gram + 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(ends, np.arange(n - width + 1), "right")
    valid = np.flatnonzero(np.arange(width, n + 1) <= ends[text])
    if not len(valid):
        return none
    at = anchor[valid]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))))
    first = valid[new]
    count = np.diff(np.concatenate((new, [len(valid)])))
    stop = first + count + width - 1
    under = mix((sums[stop] - sums[first]) * inverses[first])
    place = (at[new] - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64)
    return grams[at[new]], mix(under ^ mix(place)), first, count, at[new] - first


def sorted_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of equally long byte strings, rows(n, 8k) of uint8, eight bytes to a key. All open groups are cut at
    once: each by its middle row's key into smaller, equal and greater ones, of which only the equal ones go on to the next
    key. Returns the order and, along it, the number of each distinct row (its group's first place)."""
    n = len(rows)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)
    places, depth = np.arange(n), np.zeros(n, np.int64)  # places of the order that are not settled, and their groups' key
    while len(places) > 1:
        of = group[places]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        size = np.diff(np.concatenate((starts, [len(places)])))
        key = words[order[places], depth]
        pivot = np.repeat(key[starts + size // 2], size)
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        number = np.repeat(np.arange(len(starts)) * 3, size) + side
        by = np.argsort(number, kind="stable")
        order[places], number, depth = order[places][by], number[by], (depth + (side == 1))[by]
        first = np.concatenate(([True], number[1:] != number[:-1]))
        group[places] = places[np.flatnonzero(first)][np.cumsum(first) - 1]
        size = np.diff(np.concatenate((np.flatnonzero(first), [len(places)])))
        open_ = np.repeat(size > 1, size) & (depth < words.shape[1])
        places, depth = places[open_], depth[open_]
    return order, group
