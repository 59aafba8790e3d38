"""JSON out of free text: extraction, repair, and payload fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from procgraph.functions.text import strip


def json_part(x: Column) -> Column:
    """What stands in a fenced block, else from the first brace to the last; the text itself if there is neither."""
    fenced = F.regexp_extract(x, r"(?si)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return strip(F.when(fenced != "", fenced).when(braces != "", braces).otherwise(x))


def repaired(text: str | None) -> str | None:
    """Valid JSON from text that has raw white space in strings, other text around it, or was cut off; null if that fails.

    Tried in turn: as it is; with runs of white space as one blank; from the first brace to where its object last closes;
    from there with the open brackets closed, unless a string is open.
    """
    if text is None:
        return None
    plain = re.sub(r"\s{2,}", " ", re.sub(r"[\r\n\t]+", " ", text)).strip()
    tries = [text, plain]
    for t in (text, plain):
        t = t[t.find("{") :] if "{" in t else ""
        stack, quoted, escaped, whole = [], False, False, 0
        for i, c in enumerate(t):
            if quoted:
                quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif stack and c == stack[-1]:
                stack.pop()
                whole = whole if stack else i + 1
        tries += [t[:whole]] if whole else [] if quoted else [t + "".join(reversed(stack))]
    for t in tries:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def repair(x: Column) -> Column:
    """repaired() over a column, in Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return F.pandas_udf(run, "string")(x)


def first_field(x: Column, *keys: str) -> Column:
    """The first of some top-level fields that is there; an empty one counts."""
    return F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys])


def file_name_of_url(url: Column) -> Column:
    return F.url_decode(F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "([^/]*)$", 1))


#: File extensions by MIME type (fixed values).
EXTENSIONS = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-powerpoint": ".ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "text/html": ".html",
    "application/rtf": ".rtf",
    "application/vnd.oasis.opendocument.text": ".odt",
    "application/vnd.oasis.opendocument.spreadsheet": ".ods",
    "application/vnd.oasis.opendocument.presentation": ".odp",
}


def extension_of(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.trim(F.split_part(F.lower(mime), F.lit(";"), F.lit(1)))), F.lit(""))


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition header: encoded form, then quoted, then bare."""
    part = lambda p: F.nullif(F.regexp_extract(header, p, 1), F.lit(""))
    encoded = F.url_decode(F.regexp_replace(part(r"(?i)filename\*=(?:UTF-8'')?([^;]+)"), r"\+", "%2B"))
    return F.coalesce(encoded, part(r'(?i)filename="([^"]+)"'), part(r"(?i)filename=([^;\"]+)"))


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")
