"""The corpus pipeline: documents through the dealt operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again before the next one
sees it. All but the last return the columns of their docs, whatever their names and however many.

In all stages null texts count as empty, texts of any length are read whole, rows without a doc_id,
language or source take part, repeated rows are rows like others unless a stage says otherwise, and
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.llm import bagminhash, bpe_stream, line_dedup, mixing, quality_mcd
from photolake.llm.queries import TOKENIZER, lean_batches
from photolake.llm.shared import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules (null and empty texts do) or are outliers of their language
    and source go. Repeated rows, and texts whose statistics tie, share one verdict."""
    lean_batches(spark)
    return quality_mcd.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in one of them, that of the largest doc_id; n_chars
    follows the text. Null texts stay null; repeated doc_ids count as one document, rows without one
    for none."""
    cut = line_dedup.cut_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("row.text").cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select(F.col("row").withField("n_chars", n_chars).alias("row")).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays (nulls first; on a tie the least text), and
    of rows repeated in both, one. Null and empty texts are copies of each other."""
    lean_batches(spark)
    return bagminhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them; those that repeat in doc_id and text,
    or tie in rank, are taken alike."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids; ``exact`` says that they decode to the text. Only the columns named here are read."""
    lean_batches(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    coded = bpe_stream.decode_documents(bpe_stream.encode_documents(docs, TOKENIZER), TOKENIZER)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", exact.alias("exact"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: Robust estimates, Poisson signatures, the knapsack and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
