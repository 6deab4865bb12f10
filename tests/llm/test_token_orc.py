import zlib

import numpy as np
from tokenizers import Tokenizer

from photolake.llm import token_orc as to
from photolake.llm.queries import TOKENIZER


def test_files_hold_all_ids_in_order(spark, tmp_path):
    library = Tokenizer.from_file(TOKENIZER)
    rows = [(k * 7 % 101, f"text {k}  with\nlines <|endoftext|> {'é' * (k % 5)}", 1) for k in range(101)] + [(500, None, 1), (501, "", 1), (502, "big word " * 30_000, 1)]
    path = str(tmp_path / "orc")
    to.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start int"), path, TOKENIZER)
    got = {r.doc_id: tuple(r)[1:] for r in to.with_crc(to.read_tokens(spark, path)).collect()}
    start = 0
    for d, t, _ in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = to.find_documents(spark, path, [502])
    assert one.count() == 1 and "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()


def test_ties_and_empty(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c")]
    to.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), TOKENIZER)
    got = sorted(r.start for r in to.read_tokens(spark, str(tmp_path / "a")).collect())
    assert got == [0, 2, 4, 6]
    to.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), TOKENIZER)
    assert to.with_crc(to.read_tokens(spark, str(tmp_path / "b"))).count() == 0
