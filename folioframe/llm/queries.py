"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arc_convert, block_centroids, bpe_rounds, cube_mix, ecoc_langid, glob_filter, gray_index, imatch, log_bloom, mincut_html, pii_crf, quality_ledger, source_audit
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cube_mix": lambda s, d: cube_mix.digest(table(s, d, "documents")),
        "op2_pii_crf": lambda s, d: pii_crf.digest(table(s, d, "documents")),
        "op3_simhash_gray": lambda s, d: gray_index.digest(table(s, d, "documents")),
        "op4_imatch": lambda s, d: imatch.digest(table(s, d, "documents")),
        "op5_ecoc_langid": lambda s, d: ecoc_langid.digest(table(s, d, "documents")),
        "op6_bpe_rounds": lambda s, d: bpe_rounds.digest(table(s, d, "documents")),
        "op7_arc_convert": lambda s, d: arc_convert.digest(table(s, d, "pages")),
        "op8_glob_filter": lambda s, d: glob_filter.digest(table(s, d, "pages")),
        "op9_quality_ledger": lambda s, d: quality_ledger.digest(table(s, d, "documents")),
        "op10_mincut_html": lambda s, d: mincut_html.digest(table(s, d, "pages")),
        "op11_source_audit": lambda s, d: source_audit.digest(table(s, d, "documents")),
        "op12_log_bloom": lambda s, d: log_bloom.digest(table(s, d, "documents")),
        "op13_block_centroids": lambda s, d: block_centroids.digest(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_glob_filter": glob_filter.ORACLE,
        "op9_quality_ledger": quality_ledger.ORACLE,
        "op11_source_audit": source_audit.ORACLE,
        "op13_block_centroids": block_centroids.ORACLE,
    }
