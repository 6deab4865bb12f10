"""BPE as a bounded-lookahead streaming transducer, and its inverse as a byte-to-text state machine.

Sufficient lookahead. Take two texts that agree up to byte p. Apply the merges by rank to both: the
leftmost place where their token boundaries differ starts at p and moves left only when a rule
(u, v) fires in one of them with v starting at that place; it moves by |u|. The next rule that moves
it has a higher rank, and its v' starts where u started, so u lies on the left spine of v' (v', its
left part, that one's left part, ...). The longest chain of such steps, found by one pass over the
rules in rank order, bounds how far any right context reaches to the left: ``MergeTable.lookahead``.
Tokens that end that far before the last known byte are final and are emitted; the rest waits.

This rests on the list being proper (a rule's parts are made by earlier rules), which is checked.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import LONGEST, MARKS, byte_chars, chunk_starts
from .shared import fresh

#: Fixed value: the published pretokenizer pattern of byte-level BPE.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
_SHORT = 48  # bytes of a word up to which the plain merge loop is the faster one
_PENDING = 1 << 15  # bytes without a sure cut from which single pieces are peeled off
_ROWS = 128  # texts that are Python objects at once
_STEP = 1 << 16  # code points, or ids, that are fed at once
#: Distinct chunks whose ids an encoder remembers; when they are more, it forgets the half that has
#: not been met for longest.
ENTRIES = 1_000_000


class MergeTable:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        chars = byte_chars()
        code = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {i: bytes(code[c] for c in t) for t, i in vocab.items()}
        self.byte_ids = [vocab[c] for c in chars]
        self.added = {a["content"]: a["id"] for a in model["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in model["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        made = {i: -1 for i in self.byte_ids}
        parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if u not in made or v not in made:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            if t not in made:
                made[t], parts[t] = rank, (u, v)
            self.rules[u, v] = (rank, t)
        self.lookahead = self._lookahead(merges, vocab, parts)
        known = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self._flat = np.frombuffer(b"".join(known), np.uint8)
        self._ends = np.concatenate(([0], np.cumsum([len(b) for b in known])))

    def expand(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, where each begins and the last ends)."""
        start = self._ends[ids]
        size = self._ends[ids + 1] - start
        ends = np.concatenate(([0], np.cumsum(size)))
        return self._flat[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])], ends

    def _lookahead(self, merges, vocab, parts) -> int:
        reach: dict[int, int] = {}
        most = 0
        for a, b in merges:
            u, spine, before = vocab[a], vocab[b], 0
            while True:
                before = max(before, reach.get(spine, 0))
                if spine not in parts:
                    break
                spine = parts[spine][0]
            far = len(self.bytes_of[u]) + before
            reach[u] = max(reach.get(u, 0), far)
            most = max(most, far)
        return most

    def merge(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= _SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rules, none = self.rules, (1 << 60, 0)
        best = [rules.get(p, none) for p in zip(ids, ids[1:])]
        while best:
            low = min(best)
            if low is none:
                break
            k = best.index(low)
            ids[k : k + 2] = [low[1]]
            del best[k]
            if k:
                best[k - 1] = rules.get((ids[k - 1], ids[k]), none)
            if k < len(best):
                best[k] = rules.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        rules, n = self.rules, len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := rules.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, t = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = t, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := rules.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (r[0], left, ids[left], ids[right], r[1]))
        return [x for x, live in zip(ids, alive, strict=True) if live]


class WordEncoder:
    """Streams one word's bytes to final token ids with ``lookahead`` bytes of delay."""

    def __init__(self, table: MergeTable):
        self.table, self.held = table, bytearray()

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        window = 4 * self.table.lookahead
        while len(self.held) >= window:
            sure, at = window - self.table.lookahead, 0
            for token in self.table.merge(bytes(self.held[:window])):
                end = at + len(self.table.bytes_of[token])
                if end > sure:
                    break
                out.append(token)
                at = end
            del self.held[:at]
        return out

    def close(self) -> list[int]:
        out = self.table.merge(bytes(self.held)) if self.held else []
        self.held.clear()
        return out


class StreamEncoder:
    """Text in pieces of any size to little-endian 32-bit ids, equal to encoding it whole.

    What it holds back is bounded (``held``): a possible start of an added token, the text since the
    last sure cut (at most ``_PENDING`` bytes and a piece), and the lookahead of an open word. Only a
    run of white space is held until it ends. What lies before a sure cut is final; it falls into
    chunks, which repeat, so the ids of up to ``entries`` short ones are remembered by their bytes.
    """

    def __init__(self, table: MergeTable, entries: int = ENTRIES):
        if any(c.isspace() for token in table.added for c in token):
            raise ValueError("added tokens with white space are not supported")
        self.table, self.entries = table, entries
        self.marks = "".join(m for m in MARKS if not any(m in token for token in table.added))
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(table.added, key=len, reverse=True))) if table.added else None
        self.starts = {token[:k] for token in table.added for k in range(1, len(token))}
        self.tail, self.pending, self.open = "", b"", None
        self.single = False  # whether pending is one chunk, with nothing after its cut
        self.longest = max(map(len, table.added), default=1)

    def held(self) -> int:
        """Bytes that wait for what comes next."""
        return len(self.tail.encode()) + len(self.pending) + (len(self.open[1].held) if self.open else 0)

    def _pieces(self, text: str) -> list[int]:
        return [i for piece in PATTERN.findall(text) for i in self._piece(piece)]

    def feed(self, text: str) -> bytes:
        text = self.tail + text
        if not self.special:
            self.tail = ""
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), self._end_plain(), np.array([self.table.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        keep = next((k for k in range(min(self.longest - 1, len(text) - at), 0, -1) if text[-k:] in self.starts), 0)
        self.tail = text[len(text) - keep :]
        out.append(self._plain(text[at : len(text) - keep]))
        return b"".join(out)

    def close(self) -> bytes:
        out, self.tail = self._plain(self.tail), ""
        return out + self._end_plain()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        self.pending += text.encode()
        self.single = False
        out = b""
        if self.open:
            out = self._go_on()
            if self.open:
                return out
        if self.pending:
            out += self._final(False)
        if len(self.pending) > _PENDING:
            out += self._peel()
        return out

    def _final(self, whole: bool) -> bytes:
        """Ids of the chunks of ``pending``, which keeps the last one unless the text is ``whole``."""
        data = self.pending
        if whole and self.single:
            self.pending = b""
            return self.known.get(data) or self._chunk(data)
        cuts = chunk_starts(np.frombuffer(data, np.uint8), np.array([0, len(data)]), self.marks).tolist()
        if whole:
            cuts.append(len(data))
        self.pending, self.single = data[cuts[-1] :], True
        chunks = [data[a:b] for a, b in pairwise(cuts)]
        ids = list(map(self.known.get, chunks))
        if None in ids:
            ids = [self._chunk(c) if i is None else i for c, i in zip(chunks, ids, strict=True)]
        return b"".join(ids)

    def _chunk(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk) or np.array(self._pieces(chunk.decode()), "<u4").tobytes()
        if len(chunk) <= LONGEST:
            if len(self.known) >= self.entries // 2:
                self.before, self.known = self.known, {}
            self.known[chunk] = ids
        return ids

    def _peel(self) -> bytes:
        """Pieces that can no longer change; a word that reaches the end is opened."""
        text = self.pending.decode()
        ids, at, size = [], 0, len(text)
        for m in PATTERN.finditer(text):
            if m.end() < size - 3:
                ids += self._piece(m[0])
                at = m.end()
                continue
            kind = next((r for r in _RUNS if r.fullmatch(m[0].lstrip(" "))), None)
            if m.end() == size and kind and size - m.start() > 16:
                self.open = (kind, WordEncoder(self.table))
                ids += self.open[1].feed(m[0].encode())
                at = size
            break
        self.pending, self.single = text[at:].encode(), False
        return np.array(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) <= 4 * self.table.lookahead:
            return self.table.merge(data)
        word = WordEncoder(self.table)
        return word.feed(data) + word.close()

    def _go_on(self) -> bytes:
        kind, word = self.open
        text = self.pending.decode()
        m = kind.match(text)
        end = m.end() if m else 0
        ids = word.feed(text[:end].encode())
        if end < len(text):
            ids += word.close()
            self.open = None
        self.pending, self.single = text[end:].encode(), False
        return np.array(ids, "<u4").tobytes()

    def _end_plain(self) -> bytes:
        out = b""
        if self.open:
            out = np.array(self.open[1].close(), "<u4").tobytes()
            self.open = None
        return out + self._final(True) if self.pending else out


class StreamDecoder:
    """Ids to text; a character split over tokens waits for its last byte, ill-formed bytes become
    U+FFFD."""

    def __init__(self, table: MergeTable):
        self.table, self.machine = table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.machine.decode(self.table.expand(ids)[0].tobytes())

    def close(self) -> str:
        return self.machine.decode(b"", True)


_machines: dict[str, tuple[MergeTable, StreamEncoder]] = {}


def _machine(path: str) -> tuple[MergeTable, StreamEncoder]:
    """One for each worker process; between texts the encoder holds nothing but its table."""
    if path not in _machines:
        table = MergeTable(path)
        _machines[path] = table, StreamEncoder(table)
    return _machines[path]


def encode_text(encoder: StreamEncoder, text: str, step: int = _STEP) -> bytes:
    return b"".join([encoder.feed(text[k : k + step]) for k in range(0, len(text), step)]) + encoder.close()


def decode_ids(table: MergeTable, ids: np.ndarray, step: int = _STEP) -> str:
    decoder = StreamDecoder(table)
    return "".join([decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)]) + decoder.close()


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with token_ids.

    Null and empty texts give no ids; a text of any length is fed in pieces. A column named
    token_ids is replaced; all others, and repeated rows, pass through. An empty table gives an
    empty one.
    """
    rest = docs.drop("token_ids")
    body = fresh(rest.columns, "body")
    schema = T.StructType([*rest.schema, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield _encoded(batch.slice(at, _ROWS), _machine(tokenizer_path)[1])

    return rest.withColumn(body, F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def _encoded(batch: pa.RecordBatch, encoder: StreamEncoder) -> pa.RecordBatch:
    """``batch`` with token_ids instead of its last column, the text. Each text is fed and closed."""
    ids = [encode_text(encoder, text.as_py()) for text in batch.column(batch.num_columns - 1)]
    ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "token_ids"])


def decode_documents(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``tokens`` with decoded, the text of token_ids (null: empty). A column named decoded is
    replaced; all others pass through."""
    rest = tokens.drop("decoded")
    schema = T.StructType([*rest.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield _decoded(batch.slice(at, _ROWS), _machine(tokenizer_path)[0])

    return rest.mapInArrow(run, schema)


def _decoded(batch: pa.RecordBatch, table: MergeTable) -> pa.RecordBatch:
    """``batch`` with decoded; each list of ids is fed and closed."""
    lists = batch["token_ids"]
    ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    texts = [decode_ids(table, ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of decode_documents()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            lists = batch["token_ids"]
            ids, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            hashes = [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(ends).astype(np.int64)), pa.array(hashes, pa.string()), batch["decoded_sha256"]],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    hashed = decoded.select("doc_id", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return hashed.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
