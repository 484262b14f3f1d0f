"""The registered queries of the subpackage and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import (bpe, html_diff, importance, kd_shards, langid, mixing, ngram_join, phrases, pii, ppm, quality, url_rules,
               webp)
from .text import read


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(read(configure(spark), folder, table))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": _over("pages", html_diff.extract),
        "op2_mix_sources": _over("documents", mixing.mix_digest),
        "op3_quality_rules": lambda spark, folder: quality.judge_digest(
            read(configure(spark), folder, "documents"), read(spark, folder, "labels")),
        "op4_language_id": _over("documents", langid.predict_digest),
        "op5_webp": _over("documents", webp.media_digest),
        "op6_ppm": _over("documents", ppm.score_digest),
        "op7_pii": _over("documents", pii.span_digest),
        "op8_ngram_jaccard": _over("documents", ngram_join.class_digest),
        "op9_bpe": _over("documents", bpe.digest),
        "op10_url_rules": lambda spark, folder: url_rules.judge(
            read(configure(spark), folder, "pages"), read(spark, folder, "labels")),
        "op11_importance": lambda spark, folder: importance.resample_digest(
            read(configure(spark), folder, "documents"), read(spark, folder, "benchmark")),
        "op12_kd_shards": _over("documents", kd_shards.shard_digest),
        "op13_phrases": _over("documents", phrases.collocations),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.SQL, "op11_importance": importance.SQL, "op12_kd_shards": kd_shards.SQL,
            "op13_phrases": phrases.SQL}
