"""Files and messages as input: page texts, payloads of extraction, requests. External steps stand behind providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.functions.jsonx import disposition_name, extension_of, file_name_of_url, first_field, json_part
from procgraph.functions.text import strip

#: What an extraction returns for a section; every field may be missing.
EXTRACTION = """
processes array<struct<name:string,description:string,evidence:string,confidence:double,order:string>>,
tasks array<struct<name:string,description:string,task_type:string,performer_role:string,parent_process:string,order:string,next_task:string,previous_task:string>>,
roles array<struct<name:string,description:string,org_unit:string,persona_hint:string>>,
gateways array<struct<name:string,gateway_type:string,parent_process:string,incoming_task:string,description:string,condition:string>>,
events array<struct<name:string,event_type:string,trigger:string,parent_process:string>>,
decisions array<struct<name:string,description:string,input_data:array<string>,output_data:array<string>,related_role:string>>,
rules array<struct<when:string,then:string,condition:string,result:string,confidence:double,decision_id:string>>,
task_role_mappings array<struct<task_name:string,role_name:string>>,
task_process_mappings array<struct<task_name:string,process_name:string>>,
sequence_flows array<struct<from_task:string,to_task:string,condition:string,process_name:string>>
"""
OFFICE = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".odt", ".odp", ".ods", ".rtf")
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff")

Provider = Callable[[pd.DataFrame], pd.DataFrame]


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a path with their bytes. Spark's scan leaves out files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def route(path: str | Column) -> Column:
    """Which converter a file needs: pdf, office, image, or other, by its extension."""
    ext = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\.[^./]+)$", 1))
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*OFFICE), "office").when(ext.isin(*IMAGES), "image").otherwise("other")


def provided(df: DataFrame, provider: Provider, schema: str) -> DataFrame:
    """Rows of an external step, batch by batch in Arrow; a provider that fails gives its error in status and error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            yield provider(p)

    return df.mapInPandas(run, schema)


def no_extraction(p: pd.DataFrame) -> pd.DataFrame:
    """Stub of the extraction: empty payloads."""
    return pd.DataFrame({"section_id": p["section_id"], "payload": "{}", "status": "ok", "error": None})


def pages_with_text(pages: DataFrame, most: int = 50) -> DataFrame:
    """Pages for text recognition: those with images, up to a page number."""
    return pages.where(F.col("has_images") & (F.col("page") <= most))


def parse_extraction(payloads: DataFrame) -> DataFrame:
    """section_id and the arrays of an extraction. payloads: section_id, payload (text with JSON in it)."""
    return payloads.select("section_id", F.from_json(json_part(F.col("payload")), EXTRACTION.replace("\n", " ").strip()).alias("x")).select("section_id", "x.*")


def exploded(parsed: DataFrame, kind: str) -> DataFrame:
    """One row for each record of a kind: section_id, seq (place in the section), and its fields."""
    return parsed.select("section_id", F.posexplode(F.col(kind)).alias("seq", "_r")).select("section_id", F.col("seq").cast("long").alias("seq"), "_r.*")


def requests(rows: DataFrame, column: str) -> DataFrame:
    """url, name, description of requests: a JSON object, else one after a mark, else key: value text, else a bare URL.

    Of the keys for a field the first that is there counts, even if it is empty. A missing name comes from the URL.
    """
    x = F.coalesce(F.col(column), F.lit(""))
    whole = F.when(strip(x).startswith("{") & F.try_parse_json(x).isNotNull(), x)
    marked = F.nullif(F.regexp_extract(x, r"(?s)\[InputData\]\s*(\{[^}]+\})", 1), F.lit(""))
    marked = F.when(F.try_parse_json(marked).isNotNull(), marked)
    said = lambda k: F.nullif(F.regexp_extract(x, rf"{k}[:\s]+([^\s,]+)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(x, r"(https?://[^\s\"'<>]+)", 1), F.lit(""))
    free = whole.isNull() & marked.isNull()
    url = F.coalesce(first_field(whole, "pdf_url", "fileUrl", "pdf_file_url", "fullPath", "publicUrl"), first_field(marked, "fullPath", "publicUrl", "path"), F.when(free, F.coalesce(said("pdf_file_url"), said("pdf_url"), bare)))
    name = F.coalesce(first_field(whole, "pdf_name", "fileName", "pdf_file_name", "originalFileName"), first_field(marked, "originalFileName", "fileName"), F.when(free, F.coalesce(said("pdf_file_name"), said("pdf_name"))), F.nullif(file_name_of_url(url), F.lit("")))
    return rows.select("*", url.alias("url"), name.alias("name"), first_field(whole, "description").alias("description"))


def download_name(header: Column, url: Column, mime: Column) -> Column:
    """File name of a download: header, else URL, else download; with the extension of its type if it has none."""
    name = F.coalesce(disposition_name(header), F.nullif(file_name_of_url(url), F.lit("")), F.lit("download"))
    return F.when(name.rlike(r"\.[A-Za-z0-9]{1,5}$"), name).otherwise(F.concat(name, extension_of(mime)))
