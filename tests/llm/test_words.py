"""Words and their hashes: equal for equal words, and not for strings built to collide."""

import random

import numpy as np
import pandas as pd

from photolake.llm import kneser_ney, quality_mcd, words


def thue_morse(n, a="a", b="b"):
    """Two strings that every polynomial hash modulo 2**64 takes for one, from some length on."""
    text = [a]
    while len(text) < n:
        text += [b if c == a else a for c in text]
    return "".join(text), "".join(b if c == a else a for c in text)


def test_hashes_of_spans():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é日") for _ in range(rng.randrange(200))) for _ in range(300)] + ["x" * k for k in range(150)] + ["", "a", "a\0", "a\0\0", "\0"]
    x = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    found = {}
    for t, h in zip(texts, words.hash_spans(x, ends - [len(t.encode()) for t in texts], ends).tolist(), strict=True):
        assert found.setdefault(h, t) == t
    assert len(found) == len(set(texts))
    # where a string stands does not matter
    y = np.frombuffer(b"....." + texts[0].encode(), np.uint8)
    assert words.hash_spans(y, np.array([5]), np.array([len(y)]))[0] == words.hash_spans(x, np.array([0]), ends[:1])[0]


def test_thue_morse_words_stay_apart():
    for n in (8, 16, 64, 1024, 4096):
        one, two = thue_morse(n)
        w = words.split_words([one.encode(), two.encode(), one.encode()])
        assert w.hash[0] == w.hash[2] != w.hash[1]
        assert w.ids(np.arange(3)).tolist() == [0, 1, 0]
        lines = quality_mcd.text_stats(pd.Series([f"{one} x\n{two} x", f"{one} x\n{one} x"]))
        assert lines["n_dup_lines"].tolist() == [0, 1]
        windows = quality_mcd.text_stats(pd.Series([f"a b c {one} d . a b c {two} d", f"a b c {one} d . a b c {one} d"]))
        assert windows["n_repeat_words"].tolist() == [0, 10]
        tokens, _ = kneser_ney.tokens_of([one.encode(), two.encode()])
        assert len(set(tokens.tolist())) == 3


def test_base_columns_hold_where_all_hashes_collide(monkeypatch):
    """Repeated lines and windows are confirmed by their bytes."""
    monkeypatch.setattr(words, "hash_spans", lambda x, start, end: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(quality_mcd, "hash_spans", words.hash_spans)
    stats = quality_mcd.text_stats(pd.Series(["one two\nthree four\none two\n\none two", "a b c d e f g a b c d e", "a b c d e f g h i j k l"]))
    assert stats["n_dup_lines"].tolist() == [2, 0, 0] and stats["n_repeat_words"].tolist() == [0, 10, 0]
