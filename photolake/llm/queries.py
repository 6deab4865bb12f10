"""One query opN_<name> for each operator, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe_stream, chat_format, improbable_digest, jump_shard, kneser_ney, line_dedup, mixing, quality_mcd, rank_profiles, source_divergence, token_orc, whitening
from .shared import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Rows of an Arrow batch. Texts may be long, and a batch is in a worker's memory whole.
ARROW_ROWS = "1000"
PROBE = "</s>[INST] ok [/INST]"


def lean_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(probe), TOKENIZER))


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judge_documents(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_orc.write_tokens(_table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_orc.with_crc(token_orc.read_tokens(spark, path))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = kneser_ney.train(docs.filter(~F.col("held_out")))
    return kneser_ney.score_documents(docs, model)


def op6_jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shard.shard_rows(_table(spark, sf_dir, "documents"), shards=16)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_stream.encode_documents(docs, TOKENIZER).drop("text")
    return bpe_stream.digests(bpe_stream.decode_documents(coded, TOKENIZER))


def op10_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return improbable_digest.neighbour_report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", rank_profiles.held_out().alias("held_out"))
    profiles = rank_profiles.train(docs.filter(~F.col("held_out")))
    return rank_profiles.identify(docs.drop("lang"), profiles).drop("text")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_mcd": op2_quality_mcd,
    "op3_mixing": op3_mixing,
    "op4_token_orc": op4_token_orc,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_jump_shard": op6_jump_shard,
    "op7_line_dedup": op7_line_dedup,
    "op8_bagminhash": op8_bagminhash,
    "op9_bpe_stream": op9_bpe_stream,
    "op10_improbable_digest": op10_improbable_digest,
    "op11_rank_profiles": op11_rank_profiles,
    "op12_source_divergence": op12_source_divergence,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE.format(probe=PROBE),
    "op6_jump_shard": jump_shard.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op11_rank_profiles": rank_profiles.ORACLE,
    "op12_source_divergence": source_divergence.ORACLE,
}
