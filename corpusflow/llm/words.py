"""Vectorised word hashing of whole texts (numpy, inside tasks)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes of text worked on at a time

_M1, _M2, _M3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
# A random value per byte and an odd base: a word's hash is the sum of value * base^position.
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))
_BASE = np.uint64(0xD1342543DE82EF95)


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of every word of a buffer; words are separated by ASCII white space."""
    raw = np.frombuffer(buf, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    lengths = ends - starts
    power = np.cumprod(np.full(lengths.max(), _BASE, np.uint64))
    chars = np.flatnonzero(solid)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    return starts, lengths, mix(np.add.reduceat(_BYTE[raw[chars]] * power[place], first) ^ lengths.astype(np.uint64))


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of a very long text, cut at white space (a word is never split)."""
    at = 0
    while at < len(text):
        gap = re.compile(rb"[ \t-\r]").search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
