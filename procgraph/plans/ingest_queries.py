"""Documents as files that are read in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.plans.registry import query
from procgraph.sources import ingest
from procgraph.sources.tables import table


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files, a page after each sentence that ends a line; each thirteenth starts with a byte that no text has."""
    d = table(spark, sf_dir, "documents")
    body = F.encode(F.replace("text", F.lit(".\n"), F.lit(".\n\f")), "UTF-8")
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(F.unhex(F.lit("FF")), body)).otherwise(body)
    return d.select(F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v1.txt")).alias("path"), content.alias("content"))


@query(
    """WITH f AS (SELECT 'in/' || source || '/' || doc_id || '.v1.txt' AS source, doc_id || '.v1' AS title, text, text IS NOT NULL AND doc_id % 13 <> 0 AS ok, string_split(text, '.' || chr(10)) AS ps FROM documents)
       SELECT source, title, CASE WHEN ok THEN len(ps) ELSE 0 END AS page_count, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CASE WHEN ok THEN length(text) END AS n_chars, CASE WHEN ok THEN len(list_filter(ps, lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '')) END AS n_filled FROM f"""
)
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with its pages, and how many of them hold a text."""
    got = ingest.ingested(document_files(spark, sf_dir))
    pages = got["pages"].groupBy("doc_id").agg(F.sum(F.length("text")).alias("n_chars"), F.count_if(~F.col("text").rlike(r"^(\.?\s*)$")).alias("n_filled"))
    return got["documents"].join(pages, "doc_id", "left").select("source", "title", "page_count", "status", "n_chars", "n_filled")
