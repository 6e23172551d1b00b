"""Hashes of the words of a text, and of runs of them, in numpy."""

from __future__ import annotations

import numpy as np

from cartulary.llm.neardup_sketch import mix64


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 2**64)
        self.known = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, length: int) -> list[np.ndarray]:
        while len(self.known[0]) < length:
            for at, base in enumerate(self.bases):
                own = self.known[at]
                self.known[at] = np.concatenate([own, own * np.uint64(pow(base, len(own), 2**64))])
        return self.known


BYTES, WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)
_VALUES = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SLAB = 1 << 22


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span: differences of one polynomial, shifted to its start."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_in(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word; beyond a few megabytes a text goes through in slabs that end at white space."""
    parts, at = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while at < len(text):
        end = min(at + _SLAB, len(text))
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(~_SPACE[data], prepend=False, append=False))
        parts.append((span_hashes(_VALUES[data], edges[::2], edges[1::2], BYTES), edges[::2] + at, edges[1::2] + at))
        at = end
    return tuple(map(np.concatenate, zip(*parts)))


def word_codes(text: bytes) -> np.ndarray:
    return words_in(text)[0]
