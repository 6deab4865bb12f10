import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from photolake.llm import bpe_stream as bs
from photolake.llm import chunks as ch
from photolake.llm.queries import TOKENIZER
from photolake.llm.token_orc import chunk_table


@pytest.fixture(scope="module")
def table():
    return bs.MergeTable(TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


TEXTS = [
    "", " ", "  two  spaces \n\n and\ttabs ", "it's we'll I'd 'tis 're '", "naïve übung 🙂👩‍👩‍👧 日本語", "<|endoftext|>a <|endoftext|> b<|endoftext|>",
    "<|endof", "x" * 5000, "ab" * 4000 + " tail", "é" * 3000, "a b c  d", "\x1c \x85 x ᠎ y", "'" * 70_000, "z" * 100_000 + "'s", " " * 5000 + "x", "12345 678 9,0.1",
]


PARTS = ["a", "bc", "é", "×", "日", "本", " ", "  ", "\n", "\n\n", "\t", "\x85", "\xa0", " ", "　", "\x1c", "<|endoftext|>", "'s", "1", "23", "!", "...", "🙂", "᠎", " ", "à", "€", "word ", " the", "a, ", "a.\n", "ö. ", "×. ", "x.y", "z;"]


def random_texts(n):
    rng = random.Random(5)
    alphabet = ["a", "b", "e", "th", "the", " ", " ", "\n", "'", "s", "re", "é", "ß", "🙂", "1", "9", ".", "<|endoftext|>", "<|", " ", "\t"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_equals_the_library_however_the_text_is_fed(table, library):
    rng = random.Random(1)
    encoder = bs.StreamEncoder(table)
    pieces = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(50))) for _ in range(1500)]
    for text in TEXTS + random_texts(400) + pieces:
        want = library.encode(text, add_special_tokens=False).ids
        for step in (1 << 16, rng.randrange(1, 9) if len(text) < 9000 else 40_000):
            ids = np.frombuffer(bs.encode_text(encoder, text, step), "<u4").tolist()
            assert ids == want, (text[:80], step)
        assert bs.decode_ids(table, np.array(want, np.int32), rng.randrange(1, 9)) == library.decode(want, skip_special_tokens=False)


def test_lookahead_is_small_and_sufficient(table):
    assert 0 < table.lookahead < 2000
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice("aethnio") for _ in range(6 * table.lookahead)).encode()
        stream = bs.WordEncoder(table)
        got = []
        for k in range(0, len(word), 777):
            got += stream.feed(word[k : k + 777])
            assert len(stream.held) <= 4 * table.lookahead + 777
        assert got + stream.close() == table.merge(word)


def test_decoder_replaces_ill_formed_bytes(table, library):
    ids = library.encode("🙂", add_special_tokens=False).ids
    assert bs.decode_ids(table, np.array(ids[:1], np.int32)) == library.decode(ids[:1]) != ""


def test_documents(spark, library):
    rows = [(1, "hello world", "c"), (1, "hello world", "c"), (2, None, "c"), (None, "", None), (3, "long é " * 40_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = bs.digests(bs.decode_documents(bs.encode_documents(df, TOKENIZER), TOKENIZER)).collect()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bs.digests(bs.decode_documents(bs.encode_documents(df.limit(0), TOKENIZER), TOKENIZER)).count() == 0


def test_table_is_bounded(monkeypatch):
    monkeypatch.setattr(ch, "_WINDOW", 8)
    table = ch.ChunkTable(lambda xs: [np.frombuffer(x, np.uint8).astype("<u4") for x in xs], entries=10)
    for k in range(50):
        data = np.frombuffer(f"{k} {k + 1} {'long' * k}".encode(), np.uint8)
        ids, n = table.encode_block(data, np.array([0, 0, len(data)]))
        assert ids.tolist() == data.tolist() and n.tolist() == [0, len(data)] and table.held <= 10




#: Two chunks that a hash of 64 bits and their first 16 bytes do not tell apart.
TWINS = ["abcdefghijklmnopqrstuvwxyzabcdef", "abcdefghijklmnopk4VMky6Oa^MJ\\C^z"]


def test_chunks_whose_hashes_collide_stay_apart(library, monkeypatch):
    monkeypatch.setattr(ch, "mix", lambda h: h & np.uint64(0))  # all collide
    table = chunk_table(TOKENIZER)
    texts = [*TWINS, "a", "a\0", "a\0\0", "ab", "abcdefgh", "abcdefgh\0", *TWINS, "short words that collide too"]
    for _ in range(2):
        for _, _, x, edges in ch.text_blocks(pa.array(texts)):
            ids, n = table.encode_block(x, edges)
            for text, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                assert own.tolist() == library.encode(text, add_special_tokens=False).ids


def test_built_twins(table, library):
    encoder, known = bs.StreamEncoder(table), chunk_table(TOKENIZER)
    for text in TWINS * 2:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bs.encode_text(encoder, text), "<u4").tolist() == want
        for _, _, x, edges in ch.text_blocks(pa.array([text])):
            assert known.encode_block(x, edges)[0].tolist() == want


def test_every_text_is_fed_and_little_is_held(table, library, monkeypatch):
    """What op9 runs on a batch: each text goes through feed, its ids through the decoder's feed, and
    between feeds no more is held than a step, the pending bytes and an open word."""
    fed, most, back = [], [0], []
    feed, decode = bs.StreamEncoder.feed, bs.StreamDecoder.feed

    def counted(self, text):
        fed.append(len(text))
        out = feed(self, text)
        most[0] = max(most[0], self.held())
        return out

    monkeypatch.setattr(bs.StreamEncoder, "feed", counted)
    monkeypatch.setattr(bs.StreamDecoder, "feed", lambda self, ids: back.append(len(ids)) or decode(self, ids))
    texts = ["some words", "", "x" * 300_000, "many words of a long text, " * 20_000, "\u00e9" * 200_000, "a\u65e5\u672c" * 60_000, *random_texts(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "body"])
    coded = bs._encoded(batch, bs.StreamEncoder(table))
    assert len(fed) == sum(-(-len(t) // bs._STEP) for t in texts) and sum(fed) == sum(map(len, texts))
    assert most[0] <= bs._PENDING + 4 * table.lookahead + 64
    for text, ids, again in zip(texts, coded["token_ids"].to_pylist(), bs._decoded(coded, table)["decoded"].to_pylist(), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids and again == text
    assert sum(back) == sum(map(len, coded["token_ids"].to_pylist()))


def test_what_is_remembered_is_bounded(table, library):
    encoder = bs.StreamEncoder(table, 20)
    for text in random_texts(100):
        assert np.frombuffer(bs.encode_text(encoder, text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 10 and len(encoder.before) <= 10


def test_blocks_of_texts_equal_the_library(library):
    rng = random.Random(9)
    texts = [None, *TEXTS, *("".join(rng.choice(PARTS) for _ in range(rng.randrange(50))) for _ in range(3000))]
    table = chunk_table(TOKENIZER)
    for a, b, x, edges in ch.text_blocks(pa.array(texts, pa.string()), 1 << 12):
        ids, n = table.encode_block(x, edges)
        ends = np.cumsum(n)
        for text, own in zip(texts[a:b], np.split(ids, ends[:-1]), strict=True):
            assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
