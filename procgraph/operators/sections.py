"""From page texts to sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.text import heading_level, paragraphs, strip


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, line, level (null: no heading). pages: doc_id, page, text."""
    each = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.withColumn("level", heading_level("line"))


def sections(pages: DataFrame) -> DataFrame:
    """doc_id, section_no, heading, level, page_from, page_to, content.

    A section goes from a heading line to the next; what stands before the first heading is left out. It ends on the page
    before the next heading's, which may be before it begins, or on the last page. A document without headings is one
    section of level 1, "Document Content", with its text as it is. Lines are stripped, empty ones left out, and each of a
    section's ends with a line feed.
    """
    w = W.partitionBy("doc_id").orderBy("page", "line_no")
    every = W.partitionBy("doc_id")
    numbered = lines(pages).withColumn("section_no", F.count("level").over(w))
    numbered = numbered.select("*", F.max("page").over(every).alias("_last"), F.max("section_no").over(every).alias("_n")).where("section_no > 0 OR _n = 0")
    rows = F.array_sort(F.collect_list(F.struct("page", "line_no", "line")))
    own = F.filter(F.transform(rows, lambda x: strip(x["line"])), lambda x: x != "")
    got = numbered.groupBy("doc_id", "section_no").agg(
        F.coalesce(F.min_by(F.when(F.col("level").isNotNull(), strip("line")), F.struct("page", "line_no")), F.lit("Document Content")).alias("heading"),
        F.coalesce(F.max("level"), F.lit(1)).alias("level"),
        F.when(F.first("_n") == 0, F.lit(1)).otherwise(F.min("page")).cast("int").alias("page_from"),
        F.max("_last").cast("int").alias("_last"),
        F.when(F.first("_n") == 0, F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).otherwise(F.array_join(F.transform(own, lambda x: F.concat(x, F.lit("\n"))), "")).alias("content"),
    )
    after = F.lead("page_from").over(every.orderBy("section_no"))
    return got.select("doc_id", "section_no", "heading", "level", "page_from", F.coalesce(after - 1, F.col("_last")).alias("page_to"), "content")


def long_enough(rows: DataFrame, least: int = 50) -> DataFrame:
    """Sections whose stripped content has at least so many characters."""
    return rows.where(F.length(strip("content")) >= least)


def chunks_of(paras: Column, size: int, overlap: int | None) -> Column:
    """Greedy chunks of an array of paragraphs.

    A paragraph that would make the chunk longer than size closes it; the next begins with the last characters of the
    closed one and a blank, so one that is too long by itself begins with a blank if it is the first; with overlap None it
    begins afresh. Paragraphs are never split. The blank lines between paragraphs count, the next paragraph's don't.
    """
    begin = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(p) <= size
        tail = F.right(acc["cur"], F.lit(overlap or 0))
        joined = F.when(acc["cur"] == "", p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        closed = F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])
        opened = F.concat(tail, F.lit(" "), p) if overlap is not None else p
        return F.struct(F.when(fits, joined).otherwise(opened).alias("cur"), F.when(fits, acc["out"]).otherwise(closed).alias("out"))

    def end(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])

    return F.aggregate(paras, begin, step, end)


def fixed_chunks(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """doc_id, page, chunk_no, text, hash, span: chunks of each page. A span always starts at 0."""
    got = pages.select("doc_id", "page", F.posexplode(chunks_of(paragraphs("text"), size, overlap)).alias("chunk_no", "text"))
    return got.select("*", F.md5("text").alias("hash"), F.concat_ws(":", F.lit("0"), F.length("text").cast("string")).alias("span"))


#: Paragraphs that begin like this open a new semantic section (fixed values).
BREAKS = (r"^제\s*\d+\s*[장절]", r"^\d+\.\s+[A-Z가-힣]", r"^#{1,3}\s+")


def semantic_chunks(pages: DataFrame, size: int = 1000, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_no, page, text: paragraphs of all pages of a document, packed within stretches that a heading opens.

    A heading closes a stretch once it is over half the size; a stretch of up to one and a half sizes is one chunk, with the end
    of the chunk before in front of it; a longer one is packed without overlap. The page is that of the last paragraph.
    """
    paras = pages.select("doc_id", "page", F.posexplode(paragraphs("text")).alias("_n", "p"))
    rows = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "_n", "p"))).alias("rows"))
    is_break = lambda p: F.exists(F.array(*[F.lit(b) for b in BREAKS]), lambda b: F.regexp_like(F.split_part(p, F.lit("\n"), F.lit(1)), b))
    stretch = "struct<page:int,ps:array<string>,n:int>"
    begin = F.struct(F.lit(None).cast(stretch).alias("cur"), F.array().cast(f"array<{stretch}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cur, fresh = acc["cur"], F.struct(x["page"].cast("int").alias("page"), F.array(x["p"]).alias("ps"), F.length(x["p"]).alias("n")).cast(stretch)
        more = F.struct(x["page"].cast("int").alias("page"), F.array_append(cur["ps"], x["p"]).alias("ps"), (cur["n"] + 2 + F.length(x["p"])).alias("n")).cast(stretch)
        close = cur.isNotNull() & is_break(x["p"]) & (cur["n"] > 0.5 * size)
        return F.struct(F.when(cur.isNull() | close, fresh).otherwise(more).alias("cur"), F.when(close, F.array_append(acc["out"], cur)).otherwise(acc["out"]).alias("out"))

    parts = rows.select("doc_id", F.aggregate("rows", begin, step, lambda acc: F.when(acc["cur"].isNotNull(), F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"])).alias("s"))
    emit = "struct<last:string,out:array<struct<page:int,text:string>>>"

    def pack(acc: Column, s: Column) -> Column:
        text = F.array_join(s["ps"], "\n\n")
        whole = F.when((acc["last"] != "") & F.lit(overlap > 0), F.concat(F.right(acc["last"], F.lit(overlap)), F.lit("\n\n"), text)).otherwise(text)
        pieces = F.when(F.length(text) <= 1.5 * size, F.array(whole)).otherwise(chunks_of(s["ps"], size, None))
        out = F.concat(acc["out"], F.transform(pieces, lambda t: F.struct(s["page"].alias("page"), t.alias("text"))))
        return F.struct(F.element_at(pieces, -1).alias("last"), out.alias("out")).cast(emit)

    packed = F.aggregate("s", F.struct(F.lit("").alias("last"), F.array().cast("array<struct<page:int,text:string>>").alias("out")).cast(emit), pack, lambda acc: acc["out"])
    return parts.select("doc_id", F.posexplode(packed).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.page", "c.text")


def evidence(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each section with the first chunk of the page that it begins on. rows: doc_id, section_no, page_from. chunks: doc_id, page, chunk_no."""
    first = chunks.groupBy("doc_id", F.col("page").alias("page_from")).agg(F.min("chunk_no").alias("chunk_no"))
    return rows.select("doc_id", "section_no", "page_from").join(first, ["doc_id", "page_from"], "left")


def pages_between(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """range_id, content: texts of the pages from page_from to page_to of a document, in order, with blank lines between."""
    hit = ranges.join(pages, "doc_id").where("page BETWEEN page_from AND page_to")
    text = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return hit.groupBy("range_id").agg(F.array_join(text, "\n\n").alias("content"))
