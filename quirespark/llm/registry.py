"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automatondedup, bpe, langid, licenses, minhash, pieces, rules, secrets, suffixdedup, wumanber
from .common import table
from .oracles import ORACLES  # noqa: F401


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, langid.learn(docs)).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wumanber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(secrets.said(own), 256).alias("base_sha256"), secrets.said(F.col("spans")).alias("spans"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automatondedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.learn_from(docs, table(spark, sf_dir, "labels"))
    return rules.judge(docs, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_licenses, op2_language, op3_minhash, op4_decontaminate, op5_token_counts, op6_secrets, op7_suffix_array, op8_substrings, op9_quality, op10_bpe)}
