"""The corpus pipeline: language ID, near-duplicates, decontamination, secret scans, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
docs, the last one the tokens. Clean documents stay: only texts without an identifiable language,
copies of a document that stays, and contaminated texts go; secrets are masked in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import bpe, langid, minhash, secrets, wumanber
from quirespark.llm.common import cut, table
from quirespark.llm.registry import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those documents whose language is identified; texts that are null, have no letter or score below calibration go."""
    return langid.identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id (of rows with one doc_id, one)."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept.select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those documents that aren't contaminated by the benchmark."""
    found = wumanber.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return found.where("not contaminated").select("kept.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    findings, _ = secrets.scan(docs)
    hits = findings.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("blob"))
    joined = rows.join(hits, "blob", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(secrets.masked(F.col("row.text"), F.col("spans")))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe.encode(docs, tokenizer_path(), with_ids=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("tokens", tokenize)]

#: SQL can't express a trained classifier; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
