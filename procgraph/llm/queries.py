"""The queries of this subpackage, each over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procgraph.llm import ann, bpe, katz, langid, lexical, licenses, packing, quality, secrets, simhash, suffix, superkmers, whitening
from procgraph.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_katz_scores,
        op3_suffix_dedup,
        op4_best_fit_packing,
        op5_nearest_neighbours,
        op6_quality_rules,
        op7_byte_bpe,
        op8_simhash_near_dedup,
        op9_secret_scan,
        op10_language_id,
        op11_lexical_search,
        op12_embedding_whitening,
        op13_substring_dedup,
    )
}

_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.KNOWN.items()))

ORACLE: dict[str, str] = {
    "op1_license_scan": f"""
WITH known AS (SELECT {licenses.digest_sql("t", "duckdb")} AS digest, min(id) AS license_id FROM (VALUES {_KNOWN}) AS v(id, t) GROUP BY 1),
d AS (SELECT doc_id, {licenses.digest_sql("text", "duckdb")} AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known USING (digest)
""",
    "op6_quality_rules": quality.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op13_substring_dedup": superkmers.oracle(),
}
