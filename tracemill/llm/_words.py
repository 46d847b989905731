"""Words and word n-grams of Arrow text batches as numpy arrays; nothing here loops over words."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a slice of its own.
SLICE = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[b for b in range(33, 128) if not chr(b).isalnum()]] = 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of the texts lo..hi of a batch: byte bounds in data, the text each is in, and a hash of its bytes."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def first(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(self.hi - self.lo + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all runs of n words inside one text."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = self.hash[:count] * _GRAM[0]
        for k in range(1, n):
            total += self.hash[k : count + k] * _GRAM[k]
        inside = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return inside, mix(total[inside])


def read_words(texts: pa.Array, lower: bool = False, plain: bool = False) -> Iterator[Words]:
    """The words of a batch of texts in slices; null counts as empty. lower folds A-Z only; plain also makes ASCII punctuation a gap."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    every = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        hi = min(hi, len(texts))
        data = every[offsets[lo] : offsets[hi]]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
        if plain:
            data = _PLAIN[data]
        yield _slice(lo, hi, data, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _slice(lo: int, hi: int, data: np.ndarray, bounds: np.ndarray) -> Words:
    gap = _SPACE[data]
    full = bounds[1:] > bounds[:-1]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[bounds[:-1][full]] = True
    after[bounds[1:][full] - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    if not len(start):
        return Words(lo, hi, data, start, end, doc, np.zeros(0, np.uint64))
    place = np.arange(start[0], len(data)) - np.repeat(start, np.diff(start, append=len(data)))
    value = _BYTE[data[start[0] :]] * _PLACE[place & 255] + (place >> 8).astype(np.uint64)
    value[gap[start[0] :]] = 0
    return Words(lo, hi, data, start, end, doc, mix(np.add.reduceat(value, start - start[0])))
