"""Vectorised 64-bit hashing of words and word shingles over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import joined_bytes

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Places of a word whose byte values are looked up.
_SHORT = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _worth(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random value for each byte at each place of a word."""
    return stir((place.astype(np.uint64) * np.uint64(256) + byte + np.uint64(1)) * _STEP)


_TABLE = _worth(np.tile(np.arange(256, dtype=np.uint8), _SHORT), np.repeat(np.arange(_SHORT), 256))


def words(column: pa.Array, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (in its text) of every word of the lower-cased (A-Z) texts, and the n+1 word offsets of the texts.

    A hash is the sum of random values for the word's bytes, each at its place, so no pattern of bytes cancels out.
    """
    raw, offsets = joined_bytes(column)
    raw = _LOWER[raw]
    dark = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = dark.copy()
    first[1:] &= ~dark[:-1] | edge[1:-1]
    last = dark.copy()
    last[:-1] &= ~dark[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = (stop - start).astype(np.uint64) * _STEP
    for low in range(0, len(raw), piece):
        here = low + np.flatnonzero(dark[low : low + piece])
        if not len(here):
            continue
        own = np.searchsorted(start, here[0], side="right") - 1 + np.append(0, np.cumsum(first[here[1:]]))
        place = here - start[own]
        worth = _TABLE[np.minimum(place, _SHORT - 1) * 256 + raw[here]]
        long = np.flatnonzero(place >= _SHORT)
        worth[long] = _worth(raw[here[long]], place[long])
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[head]] += np.add.reduceat(worth, head)
    out = stir(out)
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return out, start - offsets[text], stop - offsets[text], bounds


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter (none for no word)."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _STEP + hashes[k : n - size + 1 + k]
    return stir(out)
