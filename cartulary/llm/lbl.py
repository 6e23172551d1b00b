"""Log-bilinear language model over word classes, in numpy, trained with noise-contrastive estimation.

The most frequent tokens are classes of their own, all others share classes by their last two bytes. The model
predicts a class from the two before it: their vectors pass position matrices and are summed, and the product with
each class's output vector plus its bias is the class's score. Training compares data with noise from the class
unigram; scoring normalises over all classes, for all contexts at once, by batched matrix products.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

CLASSES, SHAPES, WIDTH, CONTEXT = 256, 64, 24, 2
OWN = CLASSES - SHAPES
_SIZES = ((CLASSES, WIDTH), (CLASSES, WIDTH), (CONTEXT * WIDTH, WIDTH), (CLASSES,))
PARAMETERS = sum(int(np.prod(s)) for s in _SIZES)


def shape_of(ending: bytes) -> int:
    """Shared class of the words that end in these bytes."""
    return OWN + zlib.crc32(ending[-2:]) % SHAPES


class WordShapes:
    """Shared classes by the last two bytes, or the only one, of a word."""

    def __init__(self) -> None:
        self.one = np.array([shape_of(bytes([x])) for x in range(256)], np.uint8)
        self.two = np.array([shape_of(bytes(divmod(x, 256))) for x in range(65_536)], np.uint8)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last = data[ends - 1].astype(np.int64)
        return np.where(ends - starts > 1, self.two[data[np.maximum(ends - 2, 0)].astype(np.int64) << 8 | last], self.one[last])


@dataclass(frozen=True)
class Training:
    batch: int = 2048
    noise: int = 48
    ratio: float = 16.0
    rate: float = 0.02
    seed: int = 5


def split(flat: np.ndarray) -> list[np.ndarray]:
    """Input vectors, output vectors, position matrices and biases as views of one array."""
    out, at = [], 0
    for size in _SIZES:
        count = int(np.prod(size))
        out.append(flat[at : at + count].reshape(size))
        at += count
    return out


def start(shares: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small vectors, near-identity position matrices, log shares as biases."""
    random = np.random.default_rng(seed)
    flat = random.normal(0, 0.1, PARAMETERS).astype(np.float32)
    parts = split(flat)
    parts[2][:] = np.tile(np.eye(WIDTH, dtype=np.float32), (CONTEXT, 1)) / CONTEXT
    parts[3][:] = np.log(shares)
    return flat


def _sum_by(classes: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(classes, kind="stable")
    sizes = np.bincount(classes, minlength=CLASSES)
    held = np.flatnonzero(sizes)
    into[held] += np.add.reduceat(rows[order], (np.cumsum(sizes) - sizes)[held], axis=0)


class Trainer:
    """Adam over minibatches of (class, previous, one before); the step size falls with the batches seen."""

    def __init__(self, flat: np.ndarray, shares: np.ndarray, settings: Training = Training(), part: int = 0) -> None:
        self.flat, self.settings, self.shares = flat.copy(), settings, shares
        self.log_noise = np.log(settings.ratio * shares).astype(np.float32)
        self.mean, self.square = np.zeros_like(flat), np.zeros_like(flat)
        self.random, self.turn = np.random.default_rng((settings.seed, part)), 0

    def learn(self, target: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        for at in range(0, len(target), self.settings.batch):
            cut = slice(at, at + self.settings.batch)
            self._step(target[cut], first[cut], second[cut])

    def _step(self, target: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        inputs, outputs, places, bias = split(self.flat)
        slope = np.zeros_like(self.flat)
        to_inputs, to_outputs, to_places, to_bias = split(slope)
        context = np.concatenate((inputs[first], inputs[second]), axis=1)
        hidden = context @ places
        noise = self.random.choice(CLASSES, self.settings.noise, p=self.shares)
        data = (hidden * outputs[target]).sum(axis=1) + bias[target] - self.log_noise[target]
        other = hidden @ outputs[noise].T + (bias[noise] - self.log_noise[noise])
        pull = 1 / (1 + np.exp(np.clip(data, -30, 30)))
        push = (self.settings.ratio / self.settings.noise) / (1 + np.exp(np.clip(-other, -30, 30)))
        to_hidden = pull[:, None] * outputs[target] - push @ outputs[noise]
        _sum_by(target, np.concatenate((pull[:, None] * hidden, pull[:, None]), axis=1), both := np.zeros((CLASSES, WIDTH + 1), np.float32))
        np.subtract.at(both, noise, np.concatenate((push.T @ hidden, push.sum(axis=0)[:, None]), axis=1))
        to_outputs[:], to_bias[:] = both[:, :WIDTH], both[:, WIDTH]
        to_places[:] = context.T @ to_hidden
        back = to_hidden @ places.T
        _sum_by(first, back[:, :WIDTH], to_inputs)
        _sum_by(second, back[:, WIDTH:], to_inputs)
        slope /= len(target)
        self.turn += 1
        self.mean += 0.1 * (slope - self.mean)
        self.square += 0.01 * (slope * slope - self.square)
        rate = self.settings.rate / (1 + self.turn / 100) ** 0.5
        step = self.mean / (1 - 0.9**self.turn) / (np.sqrt(self.square / (1 - 0.99**self.turn)) + 1e-6)
        self.flat += np.float32(rate) * step


def log10_table(flat: np.ndarray) -> np.ndarray:
    """log10 P(class | previous, one before) for every context, row ``previous * CLASSES + one before``."""
    inputs, outputs, places, bias = split(flat)
    near, far = inputs @ places[:WIDTH], inputs @ places[WIDTH:]
    out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
    for previous in range(CLASSES):
        scores = (near[previous] + far) @ outputs.T + bias
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        out[previous * CLASSES : (previous + 1) * CLASSES] = scores / np.log(10.0)
    return out
