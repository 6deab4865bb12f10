from collections import Counter

import corpus_pipeline as cp
from photolake.llm import mixing
from tests.llm.test_bagminhash import brute as near_brute
from tests.llm.test_line_dedup import brute as line_brute

SF = "/root/testdata/sf0.001"


def test_each_stage_acts_on_what_its_predecessor_kept(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        after[name] = docs
        if name != "bpe":
            assert docs.columns == columns
        rows = {k: d.collect() for k, d in (("in", before), ("out", docs))}
        if name == "quality_rules":
            assert {r.doc_id for r in rows["out"]} < {r.doc_id for r in rows["in"]}
        elif name == "line_dedup":
            import hashlib

            want = sorted((d, h) for d, _, _, h in line_brute([(r.doc_id, r.text) for r in rows["in"]]))
            assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows["out"]) == want
            assert all(r.n_chars == len(r.text) for r in rows["out"])
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in rows["out"]) == sorted({c for _, c, _ in near_brute([(r.doc_id, r.text) for r in rows["in"]])})
        elif name == "mixing":
            times = Counter(r.doc_id for r in rows["out"])
            plan = {r.doc_id: r for r in mixing.plan_mix(before).collect()}
            assert all(times[d] == r.copies for d, r in plan.items())
        else:
            library = Tokenizer.from_file(cp.TOKENIZER)
            texts = {r.doc_id: r.text for r in rows["in"]}
            assert len(rows["out"]) == len(rows["in"]) and all(r.exact for r in rows["out"])
            assert all(r.token_ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids for r in rows["out"])
