"""Words of texts as 128-bit keys, and keys of runs of words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

from .common import mix64

LONG = 64  # bytes beyond which a word is digested on its own
TOGETHER = 1 << 16  # bytes of texts whose words are taken at a time
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MULTIPLY = np.array([0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15], np.uint64)


def word_keys(text: bytes) -> np.ndarray:
    """Keys of the words of one text."""
    return _keys(text)[0]


def keyed_texts(texts: Iterable[tuple]) -> Iterator[tuple]:
    """(mark, keys of the words) for each (mark, text), in order; short texts are worked on together."""
    held: list[tuple] = []

    def flush() -> Iterator[tuple]:
        keys, start = _keys(b" ".join(text for _, text in held))
        ends = np.cumsum([len(text) + 1 for _, text in held])
        return zip((mark for mark, _ in held), np.split(keys, np.searchsorted(start, ends[:-1]), axis=1), strict=True)

    size = 0
    for pair in texts:
        held.append(pair)
        size += len(pair[1])
        if size > TOGETHER:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first bytes). Two rows of uint64 with a column for each word, a maximal run of bytes other than space and \\t-\\r: two hashes of its
    length and its bytes, eight at a time, by chains that share nothing. A chain alone is one-to-one on words of up to
    eight bytes of one length; both together make 128 bits. Very long words have BLAKE2b digests instead."""
    padded = text + bytes(9)
    space = _SPACE[np.frombuffer(padded, np.uint8)]
    space[len(text) :] = True
    edge = np.flatnonzero(np.r_[True, space[:-1]] != space)
    start, end = edge[::2], edge[1::2]
    size = end - start
    eights = np.ndarray((len(text) + 2,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    keys = np.empty((2, len(start)), np.uint64)
    with np.errstate(over="ignore"):
        keys[:] = mix64(size.astype(np.uint64)) * _MULTIPLY[:, None]
        left = slice(None)
        for at in range(0, LONG, 8):
            if at:
                left = np.flatnonzero(size > at)
                if not len(left):
                    break
            part = eights[start[left] + at]
            spare = np.maximum(8 - (size[left] - at), 0).astype(np.uint64) * np.uint64(8)
            part = part << spare >> spare
            keys[:, left] = mix64((keys[:, left] ^ part) * _MULTIPLY[:, None])
    for i in np.flatnonzero(size > LONG):
        keys[:, i] = np.frombuffer(hashlib.blake2b(text[start[i] : end[i]], digest_size=16).digest(), "<u8")
    return keys, start


def run_keys(words: np.ndarray, length: int, seed: int = 0, row: int | None = None) -> np.ndarray:
    """Key of each run of ``length`` consecutive words, in two rows like the keys of words; or one ``row`` alone. The
    rows are mixed apart from each other, by multipliers of their own."""
    words, multiply = (words, _MULTIPLY[:, None]) if row is None else (words[row], _MULTIPLY[row])
    n = words.shape[-1] - length + 1
    if n <= 0:
        return words[..., :0]
    with np.errstate(over="ignore"):
        out = np.full((*words.shape[:-1], n), np.uint64(seed))
        for i in range(length):
            out *= multiply
            out += words[..., i : i + n]
            out ^= out >> np.uint64(32)
    return mix64(out)


def double_keys(runs: np.ndarray, length: int) -> np.ndarray:
    """Keys of runs of ``2 * length`` words from those of ``length`` words at neighbouring places."""
    with np.errstate(over="ignore"):
        return mix64(mix64(runs[:-length]) * _MULTIPLY[0] + runs[length:])
