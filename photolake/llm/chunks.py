"""Cutting texts where a byte-level BPE pretokenizer always cuts, and a bounded table of results.

The pretokenizer starts a new piece at every space or newline after a character that is no white
space, after a newline that stands alone between two such characters, and at a mark after a letter.
What lies between these places can be encoded on its own; words repeat, and so do these chunks. Cuts, look-ups and the
gathering of ids run over whole blocks of texts as NumPy arrays; only chunks that a worker has not
met before, or that are long, are encoded one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .words import mix

#: Bytes of a chunk that the table holds; longer ones are encoded each time they come.
LONGEST = 32
_KEYS = LONGEST // 8 + 2
_WINDOW = 1 << 17  # chunks looked up at once
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_FULL = np.zeros(256, bool)  # characters that are surely no white space, by first byte
_FULL[0x21:0x7F] = True
_FULL[0xC3:0xF5] = True
_FULL[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARKS = ",.;:!?)"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def _ends_full(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place (of valid UTF-8) is no white space."""
    last = x[at - 1]
    full = (last > 0x20) & (last != 0x7F)
    high = np.flatnonzero(last >= 0x80)
    a, b, c = last[high], x[at[high] - 2], x[at[high] - 3]
    space = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    space |= (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    space |= (c == 0xE2) & (b == 0x81) & (a == 0x9F)
    space |= (c == 0xE1) & (((b == 0x9A) & (a == 0x80)) | ((b == 0xA0) & (a == 0x8E)))
    space |= (c == 0xE3) & (b == 0x80) & (a == 0x80)
    full[high] = ~space
    return full


def chunk_starts(x: np.ndarray, edges: np.ndarray, marks: str = MARKS) -> np.ndarray:
    """Where the chunks of the texts x[edges[k]:edges[k + 1]] begin; empty texts have none. No added
    token may contain white space or one of ``marks``."""
    cut = np.zeros(len(x) + 1, bool)
    blank = (x == 0x20) | (x == 0x0A)
    at = np.flatnonzero(blank[1:]) + 1
    at = at[_ends_full(x, at)]
    cut[at] = True
    alone = at[x[at] == 0x0A]
    alone = alone[alone + 1 < len(x)]
    cut[alone[_FULL[x[alone + 1]]] + 1] = True
    # a mark between an ASCII letter, or one of U+00C0 to U+00FF, and white space
    is_mark = np.zeros(256, bool)
    is_mark[list(marks.encode())] = True
    at = at[is_mark[x[at - 1]]] - 1
    at = at[at > 0]
    last = x[at - 1]
    cut[at[_LETTER[last] | ((x[at - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    cut[edges] = True
    return np.flatnonzero(cut[:-1])


class ChunkTable:
    """Ids of chunks in flat arrays, found by a hash of a chunk's bytes in an open table. A hit is
    checked against all its bytes and their number; a full table is begun anew."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], added: Iterable[str] = (), entries: int = 1_000_000):
        if any(c.isspace() for token in added for c in token):
            raise ValueError("added tokens with white space are not supported")
        self.marks = "".join(m for m in MARKS if not any(m in token for token in added))
        self.encode, self.entries = encode, max(entries, _WINDOW)
        self.slots = 1 << (2 * self.entries).bit_length()
        self._begin()

    def _begin(self) -> None:
        self.slot = np.full(self.slots, -1, np.int32)
        self.key = np.zeros((_KEYS, self.entries), np.uint64)  # hash of all, all bytes by eights, their number
        self.first = np.zeros(self.entries + 1, np.int64)
        self.pool = np.zeros(4 * self.entries, "<u4")
        self.held = 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Entry of each column of ``key``, or -1."""
        out = np.full(key.shape[1], -1, np.int64)
        todo = np.arange(key.shape[1])
        place = (key[0] >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(todo):
            entry = self.slot[place]
            some = entry >= 0
            todo, place, entry = todo[some], place[some], entry[some]
            hit = self.key[0][entry] == key[0][todo]
            same = np.flatnonzero(hit)
            hit[same] = (self.key[1:, entry[same]] == key[1:, todo[same]]).all(0)
            out[todo[hit]] = entry[hit]
            todo, place = todo[~hit], (place[~hit] + 1) & (self.slots - 1)
        return out

    def _add(self, key: np.ndarray, ids: list[np.ndarray]) -> None:
        """New, distinct keys."""
        n, at = key.shape[1], self.held
        sizes = np.fromiter(map(len, ids), np.int64, n)
        end = int(self.first[at] + sizes.sum())
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(end - len(self.pool), len(self.pool)), "<u4")))
        self.pool[self.first[at] : end] = np.concatenate(ids)
        self.first[at + 1 : at + n + 1] = self.first[at] + np.cumsum(sizes)
        self.key[:, at : at + n] = key
        self.held += n
        todo = np.arange(at, at + n, dtype=np.int32)
        place = (key[0] >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(todo):
            free = self.slot[place] < 0
            self.slot[place[free]] = todo[free]
            left = self.slot[place] != todo
            todo, place = todo[left], (place[left] + 1) & (self.slots - 1)

    def _keys(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        key = np.zeros((_KEYS, len(start)), np.uint64)
        key[-1] = size
        key[1] = words[start] & _MASK[np.minimum(size, 8)]
        key[0] = mix(key[1] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in range(1, LONGEST // 8):
            more = np.flatnonzero(size > 8 * k)
            word = words[start[more] + 8 * k] & _MASK[np.minimum(size[more] - 8 * k, 8)]
            key[0][more] = mix(key[0][more] * np.uint64(0xA0761D6478BD642F) + word)
            key[k + 1][more] = word
        return key

    def encode_block(self, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each text) of the texts x[edges[k]:edges[k + 1]]."""
        padded = np.concatenate((x, np.zeros(LONGEST, np.uint8)))
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        start = chunk_starts(x, edges, self.marks)
        size = np.diff(start, append=len(x))
        ids, counts = [np.zeros(0, "<u4")], []
        for a in range(0, len(start), _WINDOW):
            some, n = self._window(x, words, start[a : a + _WINDOW], size[a : a + _WINDOW])
            ids.append(some)
            counts.append(n)
        before = np.concatenate(([0], np.cumsum(np.concatenate(counts)) if counts else [])).astype(np.int64)
        return np.concatenate(ids), np.diff(before[np.searchsorted(start, edges)])

    def _window(self, x: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = np.flatnonzero(size <= LONGEST)
        key = self._keys(words, start[short], size[short])
        entry = self._find(key)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, once = np.unique(key[0][new], return_index=True)
            if self.held + len(once) > self.entries:
                self._begin()
                new = np.arange(len(short))
                _, once = np.unique(key[0], return_index=True)
            once = new[once]
            at = short[once]
            self._add(key[:, once], self.encode([x[a:b].tobytes() for a, b in zip(start[at].tolist(), (start[at] + size[at]).tolist(), strict=True)]))
            entry[new] = self._find(key[:, new])
        count, source = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        known = entry >= 0
        source[short[known]] = self.first[entry[known]]
        count[short[known]] = self.first[entry[known] + 1] - self.first[entry[known]]
        # long chunks, and any that share their hash with another
        alone = np.ones(len(start), bool)
        alone[short[known]] = False
        alone = np.flatnonzero(alone)
        ids = self.encode([x[a:b].tobytes() for a, b in zip(start[alone].tolist(), (start[alone] + size[alone]).tolist(), strict=True)]) if len(alone) else []
        count[alone] = list(map(len, ids))
        end = np.cumsum(count)
        total = end[-1] if len(end) else 0
        out = self.pool.take(np.repeat(source - (end - count), count) + np.arange(total), mode="clip")
        for k, own in zip(alone.tolist(), ids, strict=True):
            out[end[k] - len(own) : end[k]] = own
        return out, count


def text_blocks(texts: pa.StringArray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, edges) of runs of texts of about ``most`` bytes; a larger one stands
    alone. Null texts are empty."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    x = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, x[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b
