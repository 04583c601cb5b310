"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .common import table


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import LENGTH, PASSAGE, remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=LENGTH, passage=PASSAGE).drop("kept")


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_lattice import score_documents

    return score_documents(table(spark, sf_dir, "documents"), class_col="lang")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_tree import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    f = judge(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def llm_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed part of op8, which SQL can express."""
    from .quality import features

    f = features(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import match_urls, rules_frame

    return match_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_benchmark

    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))} | {"llm_quality_base": llm_quality_base}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeated_substrings": oracle.OP3,
        "op4_warc": oracle.OP4,
        "op5_ngram_jaccard": oracle.OP5,
        "op7_url_rules": oracle.OP7,
        "op10_decontamination": oracle.OP10,
        "llm_quality_base": oracle.QUALITY_BASE,
    }
