"""Words of many texts at once: places and 64-bit hashes, as NumPy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np

_SPAN = 64  # bytes of a string up to which many are hashed at once
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_spans(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each byte string x[start:end], alike for equal ones.

    No polynomial: two lanes take in eight bytes at a time, each with its own constants, and only what
    both make is seen, so strings that meet under every polynomial do not meet here. Strings over
    _SPAN bytes are hashed by BLAKE2b.
    """
    size = end - start
    padded = np.concatenate((x, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    a = np.full(len(size), 0x243F6A8885A308D3, np.uint64) ^ size.astype(np.uint64)
    b = np.full(len(size), 0x13198A2E03707344, np.uint64)
    for k in range(_SPAN // 8):
        more = np.flatnonzero(size > 8 * k) if k else slice(None)
        at, left = start[more] + 8 * k, size[more] - 8 * k
        if k and not len(at):
            break
        word = eights[np.minimum(at, len(eights) - 1)] & _MASK[np.clip(left, 0, 8)]
        a[more] = mix(a[more] * np.uint64(0xA0761D6478BD642F) + word)
        b[more] = mix((b[more] ^ word) * np.uint64(0xE7037ED1A0B428DB))
    out = mix(a + (b << np.uint64(32) | b >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > _SPAN):
        out[k] = int.from_bytes(blake2b(x[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """``x`` holds the texts, each followed by a newline; text k is x[first[k]:first[k + 1] - 1]."""

    x: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def ids(self, at: np.ndarray) -> np.ndarray:
        """Numbers of the words ``at``, equal for equal words alone."""
        number: dict[bytes, int] = {}
        return np.array([number.setdefault(self.x[a:b].tobytes(), len(number)) for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)], np.int64)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``n`` words within a text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = len(self.hash) - n + 1
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0xA0761D6478BD642F) + self.hash[at + k])
        return at, h


def split_words(texts: list[bytes]) -> Words:
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    x = np.frombuffer(b"\n".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    n = len(x)
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~_SPACE[x]
    edge = np.diff(word)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(first, start, "right") - 1
    return Words(x, first, start, end, doc, hash_spans(x, start, end))


def text_slices(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of about ``most`` bytes; a larger text stands alone."""
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(at, k)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield slice(at, len(sizes))
