import hashlib

from photolake.llm import chat_format as cf
from photolake.llm.queries import PROBE, TOKENIZER
from photolake.llm.token_orc import chunk_table

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", " hello <|done|>\n<\\|turn|> <|endoftext|>"),
    (1, 2, "assistant", ""),
    (1, 3, "assistant", "🙂 ünï <"),
    (2, 0, "user", None),
    (2, 0, "user", None),
    (3, None, None, "x|>"),
    (3, 1, "assistant", "long " * 20_000),
    (None, 0, "assistant", "|<|"),
    (-1, 0, "user", PROBE),
    (-1, 1, "assistant", PROBE),
]


def test_turns_and_loss_come_back(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.read_back(cf.format_conversations(df, TOKENIZER)).collect()}
    assert got == brute(ROWS)


def test_empty_table(spark):
    assert cf.read_back(cf.format_conversations(spark.createDataFrame([], SCHEMA), TOKENIZER)).count() == 0


def test_escape_is_reversible_and_leaves_no_control():
    for s in ("<|", "<\\|", "<\\\\|<|", "a<b|c", "<|endoftext|>", "|", "<<||>>"):
        assert cf.unescape(cf.escape(s)) == s and "<|" not in cf.escape(s)


def test_offsets_equal_the_library():
    from tokenizers import AddedToken, Tokenizer

    marks = (cf.MARK_OPEN, cf.MARK_BODY, cf.MARK_CLOSE)
    library = Tokenizer.from_file(TOKENIZER)
    library.add_special_tokens([AddedToken(m, normalized=False) for m in marks])
    texts = ["", "plain words, and more.", *(cf.render([cf.Turn(r or "", t or "")])[0] for _, _, r, t in ROWS if len(t or "") < 9999), "🙂👩‍👩‍👧 日本語 é\n\n ü", "<|done|> <|endoftext|>"]
    ids, starts, ends, edges = cf.encode_with_offsets(chunk_table(TOKENIZER, marks), texts)
    for k, text in enumerate(texts):
        want, own = library.encode(text, add_special_tokens=False), slice(edges[k], edges[k + 1])
        assert ids[own].tolist() == want.ids and list(zip(starts[own].tolist(), ends[own].tolist(), strict=True)) == want.offsets
