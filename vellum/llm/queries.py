"""The corpus operators as queries over whole tables, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import oracle
from vellum.llm.common import table
from vellum.llm.compression_quality import quality_scores
from vellum.llm.decontamination import decontaminate
from vellum.llm.language_id import languages
from vellum.llm.line_quality import quality_rules
from vellum.llm.merkle import manifest
from vellum.llm.mixing import MIX_SQL, mixed
from vellum.llm.near_dup import near_duplicates
from vellum.llm.prefix_trie import prefix_trie
from vellum.llm.secret_scan import secret_spans
from vellum.llm.sharding import sharded
from vellum.llm.substring_dedup import substring_dedup
from vellum.llm.token_counts import section_tokens
from vellum.llm.url_filter import blocked_pages, url_filter


def _docs(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def _substrings(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": _docs(secret_spans),
        "op2_quality_rules": _docs(quality_rules),
        "op3_quality_classifier": lambda spark, d: quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_mixing": _docs(lambda docs: mixed(docs).drop("copies")),
        "op5_decontamination": lambda spark, d: decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_token_counts": _docs(section_tokens),
        "op7_near_dedup": _docs(near_duplicates),
        "op8_substring_dedup": _docs(_substrings),
        "op9_language_id": _docs(languages),
        "op10_sharding": _docs(sharded),
        "op11_merkle_manifest": _docs(lambda docs: manifest(docs).drop("path")),
        "op12_prefix_trie": lambda spark, d: prefix_trie(table(spark, d, "conversations")),
        "op13_url_filter": lambda spark, d: url_filter(table(spark, d, "pages"), blocked_pages(table(spark, d, "pages"), table(spark, d, "labels"))),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op4_mixing": MIX_SQL, **oracle.SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
