"""Log-probabilities of spelled words by logistic context mixing over the bits of their bytes.

Each bit of a word is predicted by several hashed contexts (the last 1, 2, 3 and 5 bytes of the word so
far, and all of it) whose counts come from one of each training word. Their stretched probabilities
are mixed with weights that are gated by how often the longest and the 3-byte context were seen, and
an adaptive probability map refines the mix. Weights and map are learned online in passes over training
words with each word's own counts left out; what several mixers learned is averaged (the weights, by
words) and pooled (the map). A word is its bytes and a closing space, the end token one line feed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.common import _powers, mix64

END = b"\n"
ORDERS = (1, 2, 3, 5)
BITS = (16, 19, 19, 19, 21)  # of each order's table, and of the whole word's
_OFFSETS = np.concatenate(([0], np.cumsum([1 << b for b in BITS])))
SLOTS = int(_OFFSETS[-1])
_STEEP = np.uint64(0xD6E8FEB86659FD93)
_FAR = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) * _STEEP  # of each node


class WordBits:
    """The bytes of many words with the hash of each context."""

    def __init__(self, words: list[bytes]):
        joined = b"".join(w if w == END else w + b" " for w in words)
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((1 if w == END else len(w) + 1 for w in words), np.int64, len(words))
        self.begin = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(len(words)), sizes)
        first = self.begin[self.word]
        n = len(self.data)
        value = self.data.astype(np.uint64) + np.uint64(1)
        self.hashes = []
        near = np.zeros(n, np.uint64)
        place = np.arange(n) - first
        step = 0
        for order in ORDERS:
            while step < order:
                step += 1
                back = np.zeros(n, np.uint64)
                back[step:] = value[: n - step]
                back[place < step] = 0
                near = near * np.uint64(0x100000001B3) + back
            self.hashes.append(mix64(near + np.uint64(order)))
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=total[1:])
        self.hashes.append(mix64((total[:-1] - total[first]) * down[first] + place.astype(np.uint64) + np.uint64(97)))

    def steps(self) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For each of the eight bits: the bit of every byte, and its slot in the joint table for each context."""
        steep = [h * _STEEP for h in self.hashes]
        for j in range(8):
            node = self.data >> np.uint8(8 - j) | np.uint8(1 << j)
            bit = (self.data >> np.uint8(7 - j)) & np.uint8(1)
            far, slots = _FAR.take(node), []
            for h, b, o in zip(steep, BITS, _OFFSETS):
                slot = h + far
                slot >>= np.uint64(64 - b)
                slot += np.uint64(o)
                slots.append(slot.view(np.int64))
            yield bit, slots


def count_bits(words: list[bytes], table: np.ndarray, batch: int = 4096) -> None:
    """Add one of each word to the table [2, SLOTS], some words at a time, as their slots take much more memory than they do."""
    flat, unit = table.reshape(-1), table.dtype.type(1)
    for a in range(0, len(words), batch):
        for bit, slots in WordBits(words[a : a + batch]).steps():
            ones = bit.astype(np.int64) * SLOTS
            for slot in slots:
                np.add.at(flat, slot + ones, unit)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.05) / (n0 + 0.05))


def _gate(longest: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Weight set by how often the longest and the 3-byte context were seen."""
    return np.minimum(np.log2(longest + 1), 15).astype(np.int64) * 8 + np.minimum(np.log2(middle + 1) / 2, 7).astype(np.int64)


class Mixer:
    """Gated mixing weights and an adaptive probability map over fixed context counts."""

    CELLS = 33

    def __init__(self, table: np.ndarray):
        self.table = table
        self.weights = np.full((128, len(BITS)), 0.25)
        self.map = np.tile(1 / (1 + np.exp(-(np.arange(self.CELLS) - 16) / 2.0)), (128, 1))
        self.seen = np.full((128, self.CELLS), 30.0)
        self.inputs = self.gates = None

    def learn(self, words: list[bytes], batch: int = 4096, rate: float = 0.02) -> None:
        """One online pass over words, each once; a word's own counts are left out."""
        rng = np.random.default_rng(11)
        order = rng.permutation(len(words))
        weights = np.ascontiguousarray(self.weights.T)
        pairs = np.ascontiguousarray(self.table.T, np.float32).view(np.uint64).ravel()  # both counts of a slot in one look-up; a table that lies so isn't copied
        for a in range(0, len(order), batch):
            at = WordBits([words[i] for i in order[a : a + batch]])
            for bit, slots in at.steps():
                ones = bit.astype(np.float32)
                zeros, st = 1 - ones, []
                for k, slot in enumerate(slots):
                    n = pairs.take(slot).view(np.float32)
                    n0, n1 = n[::2] - zeros, n[1::2] - ones
                    np.maximum(n0, 0, out=n0)
                    np.maximum(n1, 0, out=n1)
                    st.append(_stretch(n0, n1))
                    if k == 2:
                        middle = n0 + n1
                gate = _gate(n0 + n1, middle)
                mixed = st[0] * weights[0].astype(np.float32).take(gate)
                for k in range(1, len(st)):
                    mixed += st[k] * weights[k].astype(np.float32).take(gate)
                np.clip(mixed, -15, 15, out=mixed)
                err, seen = ones - 1 / (1 + np.exp(-mixed)), np.bincount(gate, minlength=128)
                for k, x in enumerate(st):
                    weights[k] += rate * np.bincount(gate, err * x, 128) / np.maximum(1, np.sqrt(seen))
                cells = 128 * self.CELLS
                flat = gate * self.CELLS + np.clip(np.rint(mixed * 2) + 16, 0, self.CELLS - 1).astype(np.int64)
                found = np.bincount(flat + bit * np.int64(cells), minlength=2 * cells).reshape(2, 128, self.CELLS)
                n = found[0] + found[1]
                self.map = (self.map * self.seen + found[1]) / (self.seen + n)
                self.seen = self.seen + n
            rate = max(0.002, rate * 0.96)
        self.weights = weights.T.copy()

    def learned(self, volume: int) -> np.ndarray:
        """What this mixer learned from so much, as numbers that may be added to those of others: see take_over()."""
        prior = type(self)(self.table)
        return np.concatenate(([volume], (self.weights * volume).ravel(), (self.map * self.seen - prior.map * prior.seen).ravel(), (self.seen - prior.seen).ravel()))

    def take_over(self, total: np.ndarray) -> None:
        """Mean weights and pooled map of mixers whose learned() was added up."""
        cuts = np.cumsum([1, self.weights.size, self.map.size])
        volume, weights, ones, seen = np.split(total, cuts)
        if volume[0]:
            self.weights = weights.reshape(self.weights.shape) / volume[0]
            self.map = (self.map * self.seen + ones.reshape(self.map.shape)) / (self.seen + seen.reshape(self.map.shape))
            self.seen = self.seen + seen.reshape(self.seen.shape)

    def freeze(self) -> None:
        """Turn counts into the numbers that scoring needs."""
        n0, n1 = self.table[0].astype(np.float64), self.table[1].astype(np.float64)
        self.inputs = _stretch(n0, n1).astype(np.float32)
        self.gates = np.minimum(np.log2(n0 + n1 + 1) * 16, 255).astype(np.uint8)
        self.table = None
        self.weights = self.weights.astype(np.float32)
        self.map = np.clip(self.map, 1e-6, 1 - 1e-6).astype(np.float32)

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        out = np.zeros(len(words))
        weights, flat = np.ascontiguousarray(self.weights.T), self.map.reshape(-1)
        for a in range(0, len(words), 2048):
            at = WordBits(words[a : a + 2048])
            total = np.ones(len(at.data))
            for bit, slots in at.steps():
                gate = ((self.gates.take(slots[-1]) >> 4 << 3) + (self.gates.take(slots[2]) >> 5)).astype(np.intp)
                mixed = self.inputs.take(slots[0]) * weights[0].take(gate)
                for k in range(1, len(slots)):
                    mixed += self.inputs.take(slots[k]) * weights[k].take(gate)
                np.clip(mixed, -15, 15, out=mixed)
                gate *= self.CELLS
                gate += np.clip(np.rint(mixed * 2) + 16, 0, self.CELLS - 1).astype(np.intp)
                p = 0.5 / (1 + np.exp(-mixed)) + 0.5 * flat.take(gate)
                total *= np.where(bit == 1, p, 1 - p)  # eight factors of 1e-8 or more
            out[a : a + 2048] = np.add.reduceat(np.log10(total), at.begin)
        return out


