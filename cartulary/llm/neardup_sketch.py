"""Shingle sets, banded MinHash signatures and odd sketches, in numpy, for batches of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def mix64(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; ``values`` is uint64."""
    values = (values ^ (values >> np.uint64(31))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _FAR
    return values ^ (values >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of a word, computed once per worker; forgets all when it grows beyond ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted; fewer words than ``width`` make one shingle, none an empty set."""
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    rows = len(words) - size + 1
    total = np.full(rows, np.uint64(size), np.uint64)
    for step in range(size):
        total = mix64(total) + one[step : step + rows]
    return np.unique(mix64(total))


class Signer:
    """MinHash of ``bands * rows`` permutations with band keys, and an odd sketch of all the samples."""

    def __init__(self, bands: int, rows: int, sketch_bits: int, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, sketch_bits
        count = bands * rows
        self.factor = (random.integers(0, 2**32, count, np.uint32) | np.uint32(1))[:, None]
        self.shift = random.integers(0, 2**32, count, np.uint32)[:, None]
        self.salt = mix64(np.arange(1, count + 1, dtype=np.uint64) * _FAR)

    def samples(self, items: np.ndarray) -> np.ndarray:
        """The least value of each permutation over the set; uint32. Long sets go through in slabs."""
        low = (items & _LOW).astype(np.uint32)
        high = (items >> np.uint64(32)).astype(np.uint32)
        best = np.full(self.factor.shape[0], 0xFFFFFFFF, np.uint32)
        for at in range(0, len(items), 2048):
            part = low[None, at : at + 2048] * self.factor
            part += self.shift
            part ^= high[None, at : at + 2048]
            part *= np.uint32(0x9E3779B1)
            np.minimum(best, part.min(axis=1), out=best)
        return best

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One int64 per band; it holds the band's number, so bands never meet each other."""
        grid = samples.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * _MIX
        for column in range(self.rows):
            key = mix64(key + grid[:, column])
        return key.astype(np.int64)

    def sketch(self, samples: np.ndarray) -> bytes:
        """Parity bitmap: each sample flips the bit that it hashes to."""
        bit = (mix64(samples.astype(np.uint64) + self.salt) % np.uint64(self.bits)).astype(np.int64)
        parity = (np.bincount(bit, minlength=self.bits) & 1).astype(np.uint8)
        return np.packbits(parity).tobytes()


def sketch_similarity(differing: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Estimate of the Jaccard similarity from XOR population counts of two odd sketches.

    Samples that differ flip two independent bits; ``d`` set bits of ``bits`` stand for
    ``-bits / 2 * ln(1 - 2 d / bits)`` flips. Saturated counts give the lowest estimate.
    """
    share = np.minimum(2.0 * differing / bits, 1.0 - 1.0 / bits)
    flips = -bits / 2.0 * np.log1p(-share)
    return 1.0 - flips / (2.0 * samples)
