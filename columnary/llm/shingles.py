"""Word shingles of whole texts as 64-bit hashes, in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import keeps

#: Words whose hashes a Python worker keeps at most.
CACHE = 200_000
#: Characters handled together; bounds the memory of a task.
CHUNK_CHARS = 2_000_000

_KNOWN: dict[bytes, int] = {}
keeps("shingles", _KNOWN.clear)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every word; A-Z count as a-z, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    try:
        return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    except KeyError:
        fresh = {w for w in words if w not in _KNOWN}
        if len(_KNOWN) + len(fresh) > CACHE:
            _KNOWN.clear()
            fresh = set(words)
        _KNOWN.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
        return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one none."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    if n < width:
        # the length goes in, so a short text never equals part of a longer one
        return mix(np.asarray([int(sum(int(a) * int(b) for a, b in zip(h, _ODD)) + n) & (2**64 - 1)], np.uint64))
    total = h[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        total += h[k: n - width + 1 + k] * _ODD[k]
    return np.unique(mix(total))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK_CHARS`` characters."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= CHUNK_CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def similarity_sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketch of every set: ``size`` 64-bit coordinates.

    In round i every element falls into one hashed bin with a hashed value, and
    a bin keeps its least (round, value). The first ``size`` rounds choose bins
    at random, round ``size + b`` fills bin b, so each bin is filled after at
    most two times ``size`` rounds; most sets end after one. Rows of empty sets
    are all ones.
    """
    out = np.full((len(sets), size), np.uint64(2**64 - 1))
    flat = out.reshape(-1)
    active = np.asarray([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(active):
        return out
    values = np.concatenate([sets[i] for i in active])
    owner = np.repeat(active, [len(sets[i]) for i in active])
    for i in range(2 * size):
        h = mix(values + np.uint64((i * 0x9E3779B97F4A7C15 + 0x51ED27) & (2**64 - 1)))
        if i < size:
            bins = (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(h), i - size, np.int64)
        value = (np.uint64(i) << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(flat, owner * size + bins, value)
        open_rows = (out[active] == np.uint64(2**64 - 1)).any(axis=1)
        if not open_rows.any():
            break
        if not open_rows.all():
            active = active[open_rows]
            still = np.zeros(len(sets), bool)
            still[active] = True
            keep = still[owner]
            values, owner = values[keep], owner[keep]
    return out
