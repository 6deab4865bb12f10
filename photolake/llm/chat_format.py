"""Chat formatting with loss masks that are aligned to tokens by character offsets.

A conversation is rendered whole and encoded once; the tokens' widths in bytes give their offsets in
characters. The turns' spans in the rendered text are sorted and disjoint, so the tokens of a span are
found by two binary searches over the token starts and ends. The template's markers are registered
with the tokenizer as tokens of their own, so no token straddles a turn's edge.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, text_blocks
from .token_orc import chunk_table

MARK_OPEN, MARK_BODY, MARK_CLOSE = "<|turn|>", "<|says|>", "<|done|>"
_CONVERSATIONS = 256  # formatted at once
_MARKS = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|done\|>\n", re.S)
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

SCHEMA = (
    "conv_id long, n_turns long, formatted string, token_ids array<int>, token_starts array<int>, "
    "token_ends array<int>, loss_mask array<boolean>"
)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str


def escape(text: str) -> str:
    """Break every ``<|`` with a backslash, and lengthen such runs that a text already holds, so
    that no text can spell a marker or any other control token of the ``<|...|>`` family."""
    return _CONTROL.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def render(turns: list[Turn]) -> tuple[str, np.ndarray]:
    """The conversation's text, and the [start, end) code point spans of the turns' texts."""
    parts, spans, at = [], np.empty((len(turns), 2), np.int64), 0
    for k, turn in enumerate(turns):
        head, body, tail = MARK_OPEN + escape(turn.role) + MARK_BODY, escape(turn.text), MARK_CLOSE + "\n"
        spans[k] = at + len(head), at + len(head) + len(body)
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def span_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint spans."""
    edge = np.zeros(len(starts) + 1, np.int64)
    spans = spans[spans[:, 1] > spans[:, 0]]
    np.add.at(edge, np.searchsorted(ends, spans[:, 0], "right"), 1)
    np.add.at(edge, np.searchsorted(starts, spans[:, 1], "left"), -1)
    return np.cumsum(edge[:-1]) > 0


def parse(formatted: str) -> list[Turn]:
    """The turns that a rendered text holds."""
    return [Turn(unescape(m[1]), unescape(m[2])) for m in _MARKS.finditer(formatted)]


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """All text under the loss mask, unescaped span by span."""
    on = np.flatnonzero(mask)
    if not len(on):
        return ""
    breaks = np.flatnonzero(starts[on[1:]] > np.maximum.accumulate(ends[on])[:-1]) + 1
    firsts, lasts = on[np.r_[0, breaks]], on[np.r_[breaks - 1, len(on) - 1]]
    return "".join(unescape(formatted[starts[a] : ends[b]]) for a, b in zip(firsts, lasts, strict=True))


def encode_with_offsets(table: ChunkTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends, edges): text k has the tokens from edges[k] to edges[k + 1], with their
    offsets in its characters. A token that holds a part of a character counts it whole."""
    coded = pa.array(texts, pa.string())
    ids, starts, ends, counts = [], [], [], []
    for _, _, x, edges in text_blocks(coded):
        some, n = table.encode_block(x, edges)
        last = np.cumsum(table.widths[some])
        first = last - table.widths[some]
        # characters before each byte and the next, from the start of its text
        char = np.cumsum((x & 0xC0) != 0x80)
        base = np.repeat(np.concatenate(([0], char))[edges[:-1]], n)
        ids.append(some)
        starts.append(char[first] - 1 - base if len(some) else first)
        ends.append(char[last - 1] - base if len(some) else last)
        counts.append(n)
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
    return join(ids, np.uint32), join(starts, np.int32), join(ends, np.int32), np.concatenate(([0], np.cumsum(join(counts, np.int64))))


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row per conversation, see SCHEMA.

    Null roles and texts count as empty. Turns go by ascending ``turn`` (nulls first); ties and
    repeated rows are kept, by role and text. Rows without a conv_id form one conversation. Other
    columns are not read; an empty table gives an empty one.
    """
    blank = F.lit("")
    rows = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(rows)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = chunk_table(tokenizer_path, (MARK_OPEN, MARK_BODY, MARK_CLOSE))
            for at in range(0, batch.num_rows, _CONVERSATIONS):
                some = batch.slice(at, _CONVERSATIONS)
                said = [list(map(Turn, *turns)) for turns in zip(some["roles"].to_pylist(), some["texts"].to_pylist(), strict=True)]
                texts, spans = zip(*map(render, said), strict=True)
                ids, starts, ends, edges = encode_with_offsets(table, texts)
                masks = [
                    span_mask(starts[a:b], ends[a:b], own[[t.role in loss_roles for t in turns]])
                    for turns, own, a, b in zip(said, spans, edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                ]
                lists = lambda values: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))  # noqa: B023, E731
                columns = [
                    some["conv_id"].cast(pa.int64()), pa.array(list(map(len, said)), pa.int64()), pa.array(texts, pa.string()),
                    lists(ids.view(np.int32)), lists(starts), lists(ends), lists(np.concatenate(masks)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return whole.mapInArrow(run, SCHEMA)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and loss text, taken from nothing but the formatted output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch["formatted"][k].as_py()
                starts, ends, mask = (batch[c][k].values.to_numpy(zero_copy_only=False) for c in ("token_starts", "token_ends", "loss_mask"))
                said, loss = parse(text), masked_text(text, starts, ends, mask)
                digest = hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in said).encode()).hexdigest()
                rows.append(
                    (batch["conv_id"][k].as_py(), len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                )
            names = [x.split()[0] for x in READ_BACK.split(", ")]
            kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    return formatted.mapInArrow(run, READ_BACK)


#: The digests from the rows themselves; a turn adds 25 characters of markers and a newline.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}')) v),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t) AS turns,
    coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '') AS loss,
    CAST(sum(25 + length(regexp_replace(r, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""
