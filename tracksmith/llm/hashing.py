"""Hashes of all words and character n-grams of many texts at once, with numpy.

A word's hash takes in its length and then 8 bytes at a time, mixed after each, for all words together; words of
more than LONG bytes are hashed one by one. Words of up to 8 bytes and of one length never collide; of n longer
words, two have the same hash by chance, n**2 / 2**65 at most. A hash of n characters is a polynomial over random
values of its bytes. Texts are joined with a space between, so that no word spans two texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Masks for the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes go through XXH3.
LONG = 256
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """hash: of each word, in order; text: the number of the text it stands in; starts, ends: in the joined bytes."""

    hash: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray  # the joined bytes
    offsets: np.ndarray  # where each text begins in them, and the end


def words(texts: list[bytes], lower: bool = False) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    inside = np.concatenate([[False], ~_SPACES[data]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    return Words(word_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1, starts, ends, data, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = (ends - starts).astype(np.uint64)
    out = mix(size * _BASE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the 8 bytes that begin at each place
    out = mix(out * _BASE ^ (eight[starts] & _FIRST[np.minimum(size, np.uint64(8))]))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, int(size[live].max(initial=0)), 8):
        live = live[size[live] > k]
        block = eight[starts[live] + k] & _FIRST[np.minimum(size[live] - np.uint64(k), np.uint64(8))]
        out[live] = mix(out[live] * _BASE ^ block)
    for i in np.flatnonzero(size > LONG).tolist():
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the n characters at each place of each text; none goes over a text's end."""
    begins = np.flatnonzero((w.data & 0xC0) != 0x80)  # where characters begin; each text has a space behind it
    first, last = begins[: len(begins) - n], begins[n:]
    text = np.searchsorted(w.offsets, first, "right") - 1
    inside = last < w.offsets[text + 1]
    first, last, text = first[inside], last[inside], text[inside]
    out = np.zeros(len(first), np.uint64)
    values = _VALUES[w.data]
    for k in range(int((last - first).max(initial=0))):  # 4 n steps at most
        use = first + k < last
        if use.all():
            out = out * _BASE + values[first + k]
        else:
            out[use] = out[use] * _BASE + values[first[use] + k]
    return mix(out), text
