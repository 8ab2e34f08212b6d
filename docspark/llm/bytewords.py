"""Words of many texts at once, found and hashed on UTF-8 bytes with numpy.

All separators used here are ASCII, so no character is ever cut. Texts come as
Arrow string arrays; `chunks` hands out groups of whole texts of a few MB, so
that memory follows the chunk and not the Arrow batch. A text longer than a
chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LETTER_OR_DIGIT = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B)])

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(_SPACE)] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[list(_LETTER_OR_DIGIT)] = True
ALPHANUMERIC[128:] = True

_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits, so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 4 * CHUNK_BYTES:
            return have[:n]
        _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of one chunk. `bounds[d]:bounds[d + 1]` are the words of text d."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; with `lower`, A-Z counts as a-z."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * _power(_STEP, n), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _power(_STEP_INVERSE, n + 1)[self.starts]
        return mix(h)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-word value over each text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the n + 1 offsets; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held, ends


def chunks(texts: pa.Array, word_bytes: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Groups of whole texts with their word positions."""
    held, ends = text_bytes(texts)
    at, n = 0, len(ends) - 1
    while at < n:
        upto = int(np.searchsorted(ends, ends[at] + chunk_bytes, side="right")) - 1
        upto = min(max(upto, at + 1), n)
        offsets = ends[at:upto + 1] - ends[at]
        yield _words(at, held[ends[at]:ends[upto]], offsets, word_bytes)
        at = upto


def _words(first: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    inside = word_bytes[data]
    n = len(data)
    fresh = np.ones(n + 1, dtype=bool)
    fresh[1:n] = ~inside[:-1] if n else True
    fresh[offsets] = True
    starts = np.flatnonzero(inside & fresh[:n])
    last = np.ones(n + 1, dtype=bool)
    last[:n - 1] = ~inside[1:] if n else True
    last[offsets[offsets > 0] - 1] = True
    ends = np.flatnonzero(inside & last[:n]) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(first, data, offsets, starts, ends, bounds)
