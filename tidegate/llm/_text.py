"""Words of many texts at once: byte-level numpy over Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, the same rule as the regular
expression ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text. Word hashes are 64-bit polynomials; they choose
minimisers and order, and where a hash stands for equality the operator says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The white space that parts words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at a time; one longer text is handled alone.
BLOCK_BYTES = 1 << 20
#: Longer words are hashed one by one, so that no array is as long as such a word.
LONG_WORD = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        a = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        a[0] = 1
        _powers[kind] = np.multiply.accumulate(a)
    return _powers[kind][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of the texts ``first .. first + n - 1`` of a batch."""

    first: int
    n: int
    data: np.ndarray  # bytes of the texts, one after the other
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] .. bounds[i + 1]

    def hashes(self) -> np.ndarray:
        """A hash of each word, the same wherever the word stands; the text is gone through in pieces."""
        n = len(self.starts)
        out, i = np.zeros(n, np.uint64), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + BLOCK_BYTES, "right")))
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            if hi - lo <= BLOCK_BYTES:
                up, down = _grown("up", _BASE, hi - lo), _grown("down", _INVERSE, hi - lo)
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
                start, end = self.starts[i:j] - lo, self.ends[i:j] - lo
                out[i:j] = mix((total[end] - total[start]) * down[start], 1)
            i = j
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def _binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())


def blocks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[Words]:
    """The texts of a string column in blocks of about ``size`` bytes; a null counts as empty.

    ``lower`` lower-cases A-Z only.
    """
    column = _binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    everything = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        at = offsets[i : j + 1] - offsets[i]
        data = everything[offsets[i] : offsets[j]]
        if lower and len(data):
            data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        yield Words(i, j - i, data, *_parted(data, at))
        i = j


def _parted(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~inside[:-1]
    before[at[at < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~inside[1:]
    after[at[at > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, in order, and bounds as in Words.

    A text with fewer words has one shingle, of all of them; one without words has none.
    """
    h = words.hashes()
    count = np.diff(words.bounds)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=bounds[1:])
    total = len(h)
    if not total:
        return np.zeros(0, np.uint64), bounds
    rolled = np.zeros(total, np.uint64)
    for k in range(n):
        rolled[: total - k] = mix(rolled[: total - k] ^ h[k:], k + 2) if k < total else rolled[: total - k]
    text = np.repeat(np.arange(len(per)), per)
    at = words.bounds[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    out = rolled[at]
    for i in np.flatnonzero((count > 0) & (count < n)):
        x = np.zeros(1, np.uint64)
        for k, v in enumerate(h[words.bounds[i] : words.bounds[i + 1]]):
            x = mix(x ^ v, k + 2)
        out[bounds[i]] = mix(x, 99)[0]
    return out, bounds
