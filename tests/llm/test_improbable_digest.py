import hashlib
import random
from collections import Counter

import numpy as np

from photolake.llm import improbable_digest as im


def words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_window_sums_equal_counting():
    x = np.frombuffer(words(random.Random(1), 60).encode() + b"aaaa" * 30, np.uint8)
    sums = im.window_sums(x)
    for k in range(len(x) - im.WINDOW + 1):
        assert sums[k] == sum(im._CLOGC[c] for c in Counter(x[k : k + im.WINDOW].tolist()).values())


def brute_choice(text):
    if not text:
        return []
    x = np.frombuffer(text.ljust(im.WINDOW, b"\0"), np.uint8)
    rank = im.rarity(im.window_sums(x))
    votes = Counter()
    for s in range(-im.SPAN + 1, len(rank)):
        span = range(max(0, s), min(len(rank), s + im.SPAN))
        votes[min(span, key=lambda k: (rank[k], k))] += 1
    seen = []
    for k in sorted(votes):
        if votes[k] >= im.VOTES and (w := x[k : k + im.WINDOW].tobytes()) not in seen:
            seen.append(w)
    return seen


def test_features_equal_brute_force():
    rng = random.Random(2)
    texts = [b"", b"a", b"short", words(rng, 30).encode(), words(rng, 300).encode(), b"x" * 500, ("é" * 50).encode()]
    for text, got in zip(texts, im.fingerprints(texts), strict=True):
        chosen = brute_choice(text)
        assert len(got) == -(-len(chosen) // im.PER_FILTER)
        assert np.bitwise_count(got).sum() <= im.HASHES * len(chosen)
        assert not chosen or np.bitwise_count(got).sum() >= 0.7 * im.HASHES * min(len(chosen), 100)
        assert (im.fingerprints([text])[0] == got).all()  # batch mates do not matter
        assert (im.from_string(im.to_string(got)) == got).all()


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(20, 2000)) for _ in range(80)]
    near, far = [], []
    for a, b in zip(texts, texts[1:]):
        cut = len(a) // 4
        fa, fb, fe = im.fingerprints([a.encode(), b.encode(), (a[: len(a) - cut] + b[:cut]).encode()])
        near.append(im.likeness(fa, fe))
        far.append(im.likeness(fa, fb))
    assert min(near) > max(far) and np.median(near) > 0.6 and max(far) < 0.3


def test_report_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k * 3, words(rng, rng.randrange(1, 200))) for k in range(60)] + [(7, None), (8, ""), (9, "é🙂" * 30_000), (9, "tie"), (None, "no id"), (30, words(rng, 5))]
    got = im.neighbour_report(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")).collect()
    assert len(got) == len(rows)
    by_id = Counter(d for d, _ in rows)
    ordered = sorted(((d is not None, d or 0, t or "") for d, t in rows), key=lambda r: r[:2])
    for k, (_, d, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)]
        if by_id[d] > 1 or by_id[nxt[1]] > 1 or not ordered[k][0]:
            continue
        row = next(r for r in got if r.doc_id == d)
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[2][:cut]
        fa, fe, fn = im.fingerprints([t.encode(), edited.encode(), nxt[2].encode()])
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == im.to_string(fa) and row.edited_fingerprint == im.to_string(fe)
        assert abs(row.near_next - (1.0 if t == nxt[2] else im.likeness(fa, fn))) < 1e-12


def test_one_and_no_document(spark):
    schema = "doc_id long, text string"
    assert im.neighbour_report(spark.createDataFrame([], schema)).count() == 0
    assert im.neighbour_report(spark.createDataFrame([(1, "ab cd ef gh")], schema)).head().near_next == 1.0


def test_pieces_of_a_text_have_the_features_of_the_whole():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(n)).encode() for n in (2, 40, 400, 3000)] + [b"", b"short", b"z" * 500 + b" end of it and more"]
    whole = im.fingerprints(texts, 1 << 20)
    for block in (33, 100, 1000, 7777):
        for a, b in zip(whole, im.fingerprints(texts, block), strict=True):
            assert a.shape == b.shape and (a == b).all()


def test_memory_does_not_grow_with_the_batch():
    import tracemalloc

    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1 << 20)).encode()
    tracemalloc.start()
    im.fingerprints([text[:1_000_000]] * 2)
    small = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    im.fingerprints([text, text[:3_000_000], text[:1_000_000]])
    assert tracemalloc.get_traced_memory()[1] < 2.5 * small
    tracemalloc.stop()
