"""Extra columns of any name, nulls, repeated rows and empty tables, for every stage and operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from photolake.llm import bpe_stream, improbable_digest, line_dedup, mixing

NAMES = """row _id node bucket slice label pivot a b text_ averages mean precision scatter distance kept failed base_failed lang_source language
stats f name start target centre size source_size copies _key _size _rank _last _copy repeats extra lot lost_keys lines n_lines n_dropped key
body _body token_ids decoded fingerprint n_tokens exact h at guard class_id known_id stays class_docs""".split()
LINE = "a line that is long enough to be counted and that several documents share"
ROWS = [
    *((k, f"{LINE}\nhere are some words of a text numbered {k} " + f"and word{k} more{k} " * (k % 3) + "that is quite short", "en", "s") for k in range(8)),
    (8, None, "en", "s"), (9, "", None, None), (None, "a text without a number that has enough words to stay in here", None, "t"), (1, "another text of the same number with its own dozen of words", "de", "t"),
    *[(10, "one row that comes twice with more than ten words and no other like it", "en", "s")] * 2, (11, "very long text " + " ".join(f"w{k * k % 977}" for k in range(20_000)), "en", "t"),
]


def table(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES))


def unchanged(rows, but=()):
    return all(r[c] == f"{c}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for c in NAMES if c not in but)


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, name, stage):
    docs = table(spark)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and unchanged(rows)
    assert {(r.doc_id, r.text) for r in rows} <= {(r[0], r[1]) for r in ROWS} or name == "line_dedup"
    empty = stage(spark, table(spark, []), "")
    assert empty.columns == docs.columns and empty.count() == 0
    got = sorted((str(r.doc_id), str(r.text)[:12]) for r in rows)
    if name == "quality_rules":
        assert not any(d in ("8", "9") for d, _ in got) and sum(d == "10" for d, _ in got) in (0, 2)
    elif name == "line_dedup":
        assert len(got) == len(ROWS) and sum((r.text or "").startswith(LINE) for r in rows) == 1 and next(r for r in rows if r.doc_id == 8).text is None
    elif name == "near_dedup":
        assert sum(d == "10" for d, _ in got) == 1 and sum(d in ("8", "9") for d, _ in got) == 1 and sum(d == "None" for d, _ in got) == 1


def test_last_stage(spark):
    rows = cp.STAGES[-1][1](spark, table(spark), "").collect()
    assert len(rows) == len(ROWS) and all(r.exact for r in rows) and [len(r.token_ids) for r in rows if r.doc_id in (8, 9)] == [0, 0]
    assert cp.STAGES[-1][1](spark, table(spark, []), "").count() == 0


@pytest.mark.parametrize(
    "operator,made",
    [
        (lambda d: bpe_stream.decode_documents(bpe_stream.encode_documents(d, cp.TOKENIZER), cp.TOKENIZER), ["token_ids", "decoded"]),
        (improbable_digest.fingerprint_documents, ["fingerprint"]),
        (mixing.plan_mix, ["size", "source_size", "target", "copies"]),
        (line_dedup.drop_lines, ["n_lines", "n_dropped"]),
    ],
)
def test_operators_replace_only_what_they_name(spark, operator, made):
    docs = table(spark)
    out = operator(docs)
    assert out.columns == [*(c for c in docs.columns if c not in made), *made]
    rows = out.collect()
    assert len(rows) == len(ROWS) and unchanged(rows, made)
    assert operator(table(spark, [])).count() == 0
