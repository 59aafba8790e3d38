"""Many files in one scan: documents, pages, sections and chunks, numbered by file; a file that can't be read is a row, too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions.text import strip
from procgraph.operators import sections
from procgraph.operators.graph import checkpointed
from procgraph.operators.merge import merge_lines

#: What reads a file: path and bytes to (text, whether the page has images) of each page.
Reader = Callable[[str, bytes], list[tuple[str, bool]]]
PAGES = "path string, page int, text string, has_images boolean, status string, error string"
#: Characters of an error that are kept.
ERROR = 500


def text_pages(path: str, content: bytes) -> list[tuple[str, bool]]:
    """Reader of plain text in UTF-8, whose pages end with a form feed."""
    return [(t, False) for t in content.decode("utf-8").split("\f")]


def title(path: str | Column) -> Column:
    """Name of a file without folders and its last extension; a name that is all extension stays."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def read_pages(files: DataFrame, reader: Reader) -> DataFrame:
    """path, page (from 1), text, has_images, status, error. A failed file, or one without content, is a row with page 0.

    Files are read where they lie, one at a time, and nothing is shuffled; how many bytes of them a task holds at once is
    bounded by spark.sql.execution.arrow.maxBytesPerBatch. A file without pages has one that is empty. files: path, content.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    if content is None:
                        raise ValueError("no content")
                    got = [(path, n, t or "", bool(i), "ok", None) for n, (t, i) in enumerate(reader(path, bytes(content)) or [("", False)], 1)]
                except Exception as e:  # whatever a reader raises belongs to its file and is kept as a row
                    got = [(path, 0, None, False, "failed", f"{type(e).__name__}: {e}"[:ERROR])]
                yield pd.DataFrame(got, columns=["path", "page", "text", "has_images", "status", "error"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def with_recognised(pages: DataFrame, recognised: DataFrame, most: int = 50) -> DataFrame:
    """pages with the lines that text recognition adds, on pages with images up to a page number. recognised: path, page, seen (one row a page)."""
    due = F.col("has_images") & F.col("page").between(1, most) & (strip("seen") != "")
    return pages.join(recognised.select("path", "page", "seen"), ["path", "page"], "left").withColumn("text", F.when(due, merge_lines(F.col("text"), F.col("seen"))).otherwise(F.col("text"))).drop("seen")


def ingested(files: DataFrame, reader: Reader = text_pages, recognised: DataFrame | None = None, semantic: bool = False) -> dict[str, DataFrame]:
    """documents, pages, sections and chunks of many files; the same as one file at a time. A path occurs once.

    documents: doc_id (of the path, so that a file read again keeps it), title, source, page_count, status, error. The others
    have doc_id, pages and sections from 1, chunks from 0. Pages are read once and written to the checkpoint folder.
    """
    raw = read_pages(files, reader)
    pages = checkpointed((raw if recognised is None else with_recognised(raw, recognised)).withColumn("doc_id", F.md5("path")))
    by_file = pages.groupBy("doc_id", F.col("path").alias("source"))
    documents = by_file.agg(F.max("page").alias("page_count"), F.max("status").alias("status"), F.max("error").alias("error")).select("doc_id", title("source").alias("title"), "source", "page_count", "status", "error")
    read = pages.where("status = 'ok'").select("doc_id", "page", "text")
    chunks = sections.semantic_chunks(read) if semantic else sections.fixed_chunks(read)
    return {"documents": documents, "pages": read, "sections": sections.sections(read), "chunks": chunks}
