"""License scan by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines, marks of comments and lists, and equivalent
spellings no longer matter),
hashed as a whole, and hash-joined to the digests of known licenses brought to the same form.

Defined results: one row for each row of the input, repeated rows included. A null or empty text, or one of which
nothing is left, has a null digest and no license. A very long text is hashed whole, and a long run of marks or blanks takes
time in proportion to its length. Clashing columns aren't read. If two known licenses have the same digest, the smaller name counts.
Only DataFrame functions run. The known side is joined by broadcast only up to ``broadcast_rows`` licenses, counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.llm.license_texts import KNOWN

#: Spellings that license texts use for one another (fixed values); the first becomes the second.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"),
    ("analog", "analogue"),
    ("analyze", "analyse"),
    ("artifact", "artefact"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("caliber", "calibre"),
    ("canceled", "cancelled"),
    ("capitalizations", "capitalisations"),
    ("catalog", "catalogue"),
    ("categorize", "categorise"),
    ("center", "centre"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("emphasized", "emphasised"),
    ("favor", "favour"),
    ("favorite", "favourite"),
    ("fulfill", "fulfil"),
    ("fulfillment", "fulfilment"),
    ("initialize", "initialise"),
    ("judgment", "judgement"),
    ("labeling", "labelling"),
    ("labor", "labour"),
    ("license", "licence"),
    ("licensed", "licenced"),
    ("licenses", "licences"),
    ("maximize", "maximise"),
    ("modeled", "modelled"),
    ("modeling", "modelling"),
    ("non commercial", "noncommercial"),
    ("offense", "offence"),
    ("optimize", "optimise"),
    ("organization", "organisation"),
    ("organize", "organise"),
    ("per cent", "percent"),
    ("practice", "practise"),
    ("program", "programme"),
    ("realize", "realise"),
    ("recognize", "recognise"),
    ("signaling", "signalling"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilization", "utilisation"),
    ("while", "whilst"),
    ("wilfull", "wilful"),
)

#: Marks of comments at the start of a line. Possessive: a run of any length is read once, and nothing is tried again.
COMMENT = r"^[#*/;%!>| \t-]*+(?:(?:dnl|rem|<!--)[#*/;%!>| \t-]*+)*+"
#: A line that only states a copyright, which takes a sign, a year or a place for one after the word, or reserves rights.
COPYRIGHT_LINE = rf"(?m){COMMENT}(?:(?:portions )?copyright(?: owner| holder)?[ \t]*[:,]?[ \t]*(?:\(c\)|©|&copy;|by[ \t]|[<\[{{{{]|[0-9x]{{4}})|\(c\)[ \t]*(?:copyright|by[ \t]|[<\[{{{{]|[0-9x]{{4}})|©|all rights reserved\.?[ \t*/#]*$)[^\n]*$"
#: The number, letter or bullet of an item of a list.
LIST_MARK = rf"(?m){COMMENT}(?:\(?(?:[0-9]{{1,2}}[.)]|(?:[a-z]|[ivx]{{2,4}})\))|[•·o+])[ \t]+"


def _spellings() -> list[tuple[str, str]]:
    """Whole words only; each spelling ends at the last form that the list leads to."""
    to = {a: b for a, b in SPELLINGS if a != b and " " not in a + b}

    def last(w: str) -> str:
        for _ in range(len(to)):
            if w not in to:
                break
            w = to[w]
        return w

    return [(a, b) for a, b in SPELLINGS if " " in a + b] + [(a, last(a)) for a in to]


def canonical_sql(text: str, dialect: str = "spark") -> str:
    """SQL for the canonical form of a column; dialect is spark or duckdb."""

    def replace(x: str, pattern: str, by: str) -> str:
        if dialect == "spark":
            return f"regexp_replace({x}, '{pattern.replace(chr(92), chr(92) * 2)}', '{by}')"
        return f"regexp_replace({x}, '{pattern.replace('*+', '*')}', '{by}', 'g')"  # that engine never tries again

    x = f"replace(replace(lower(coalesce({text}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = replace(x, COPYRIGHT_LINE, " ")
    x = replace(x, LIST_MARK, " ")
    x = f"trim({replace(x, '[^a-z0-9]+', ' ')})"
    x = f"concat(' ', replace({x}, ' ', '  '), ' ')"  # every word has its own two spaces
    for a, b in _spellings():
        wide = lambda s: " " + s.replace(" ", "  ") + " "
        x = f"replace({x}, '{wide(a)}', '{wide(b)}')"
    return f"trim({replace(x, '[ ]+', ' ')})"


def digest_sql(text: str, dialect: str = "spark") -> str:
    c = canonical_sql(text, dialect)
    return f"CASE WHEN {c} <> '' THEN {'sha2' if dialect == 'spark' else 'sha256'}({c}{', 256' if dialect == 'spark' else ''}) END"


def known_licenses(spark: SparkSession) -> DataFrame:
    """The bundled licenses: license_id, text."""
    return spark.createDataFrame(sorted(KNOWN.items()), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, broadcast_rows: int = 50_000) -> DataFrame:
    """doc_id, digest (of the canonical text), license_id (null if unknown)."""
    known = known if known is not None else known_licenses(docs.sparkSession)
    canon = known.select("license_id", F.expr(canonical_sql("text")).alias("c"))
    known_digests = canon.where("c <> ''").groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    if known.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known_digests = F.broadcast(known_digests)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.expr(canonical_sql("text")).alias("c"))
    return texts.select("doc_id", F.when(F.col("c") != "", F.sha2("c", 256)).alias("digest")).join(known_digests, "digest", "left").select("doc_id", "digest", "license_id")
