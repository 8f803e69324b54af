"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm import bpe, decontaminate, fertility, jaccard, katz, language, licences, manifest, naming, repair, repeats, toxicity, warc
from sessionmill.llm.frames import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second copy of the archives with known damage: bytes overwritten, records cut short, records lost."""
    text, page = warc.record(F.col("url"), F.col("html")), F.col("page_id")
    replica = (
        F.when(page % 211 == 7, F.overlay(text, F.lit("~~~"), F.lit(200)))
        .when(page % 307 == 11, F.left(text, (F.length(text) / 2).cast("int")))
        .when(page % 401 == 13, F.lit(None))
        .otherwise(text)
    )
    return warc.audited(read(spark, sf_dir, "pages"), replica)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "expected", "n_words", "spans")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.held_out_predictions(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "bit_errors")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.held_out_scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "chars_per_byte_token", "fallback_share", "entropy",
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return manifest.verified(manifest.leaves(docs, manifest.tampered(docs)))


def op12_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.duplicates(read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_katz": op5_katz,
    "op6_licences": op6_licences,
    "op7_jaccard": op7_jaccard,
    "op8_fertility": op8_fertility,
    "op9_repeats": op9_repeats,
    "op10_decontaminate": op10_decontaminate,
    "op11_manifest": op11_manifest,
    "op12_naming": op12_naming,
    "op13_repair": op13_repair,
}
