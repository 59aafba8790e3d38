"""String functions of the engine as Column expressions. White space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def name_key(x: str | Column) -> Column:
    """Key by which names are the same: lower case, stripped."""
    return F.lower(strip(x))


def text_key(x: str | Column) -> Column:
    """Key by which texts are the same: lower case, no white space at all."""
    return F.regexp_replace(F.lower(col(x)), r"(?U)\s+", "")


def clean_text(x: str | Column) -> Column:
    """Runs of white space as one blank, stripped."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def or_else(x: str | Column, default: str | Column) -> Column:
    """The default where x is null or empty."""
    return F.coalesce(F.nullif(col(x), F.lit("")), default if isinstance(default, Column) else F.lit(default))


def snake_id(x: str | Column) -> Column:
    """Lower-case ASCII letters, digits and single underscores, none at the ends; other characters become underscores."""
    y = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), "[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(y, "_+", "_"), "^_|_$", "")


def short_id(prefix: str, x: str | Column, n: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.left(col(x), F.lit(n)))


def flow_id(source: str | Column, target: str | Column) -> Column:
    raw = F.concat(F.lit("SequenceFlow_"), col(source), F.lit("_"), col(target))
    return F.left(F.regexp_replace(raw, "[^0-9A-Za-z_-]", "_"), F.lit(240))


def file_name(x: str | Column, most: int = 50) -> Column:
    return F.left(F.regexp_replace(col(x), r"[^\p{L}\p{N}._-]", "_"), F.lit(most))


def left_dots(x: str | Column, n: int) -> Column:
    """Stripped and cut to n characters; what is cut off leaves an ellipsis."""
    y = strip(x)
    return F.when(F.length(y) > n, F.concat(F.left(y, F.lit(n)), F.lit("…"))).otherwise(y)


#: Heading patterns in the order in which they are tried, with levels (fixed values).
HEADINGS = (
    (r"^#{1}\s+(.+)$", 1),
    (r"^제\s*\d+\s*장\s*(.+)$", 1),
    (r"^제\s*\d+\s*절\s*(.+)$", 2),
    (r"^#{2}\s+(.+)$", 2),
    (r"^\d+\.\s+([A-Z가-힣].+)$", 1),
    (r"^\d+\.\d+\s+(.+)$", 2),
    (r"^\d+\.\d+\.\d+\s+(.+)$", 3),
    (r"^[IVX]+\.\s+(.+)$", 1),
    (r"^[A-Z]\.\s+(.+)$", 2),
)


def heading_level(line: str | Column) -> Column:
    """Level of the first heading pattern that a stripped line meets; null for other lines."""
    y, out = strip(line), F
    for pattern, level in HEADINGS:
        out = out.when(y.rlike(f"(?U){pattern}"), level)
    return out


def paragraphs(x: str | Column) -> Column:
    """Stripped paragraphs, which blank lines part; empty ones don't count."""
    return F.filter(F.transform(F.split(col(x), r"(?U)\n\s*\n"), strip), lambda p: p != "")


def xml_escape(x: str | Column) -> Column:
    y = F.coalesce(col(x), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        y = F.replace(y, F.lit(a), F.lit(b))
    return y


def either_contains(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    return a.contains(b) | b.contains(a)


def is_uuid(x: str | Column) -> Column:
    return col(x).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def to_order(x: str | Column, default: str | Column) -> Column:
    """A whole number out of an integer, a float or their text; the default for anything else."""
    return F.coalesce(col(x).cast("string").try_cast("double").try_cast("int"), col(default))


def coerce(x: str | Column, allowed: tuple[str, ...], default: str) -> Column:
    """The lower-cased value where it is allowed, else the default."""
    y = F.lower(strip(F.coalesce(col(x), F.lit(""))))
    return F.when(y.isin(*allowed), y).otherwise(F.lit(default))


TASK_TYPES = ("human", "agent", "system")
GATEWAY_TYPES = ("exclusive", "parallel", "inclusive")
EVENT_TYPES = ("start", "end", "intermediate")


def form_id(tool: str | Column, process: str | Column, activity: str | Column) -> Column:
    """Form of an activity: what its tool names, else one made of both ids; slashes become hash marks."""
    process, activity = col(process), col(activity)
    said = strip(F.coalesce(col(tool), F.lit("")))
    own = F.when(said.startswith("formHandler:"), strip(F.regexp_replace(said, "^formHandler:", ""))).otherwise(F.lit(""))
    got = F.when(own == "", F.concat_ws("_", process, activity, F.lit("form"))).otherwise(own)
    return F.when(got == "defaultform", F.concat_ws("_", process, F.lower(activity), F.lit("form"))).otherwise(F.replace(got, F.lit("/"), F.lit("#")))


def any_keyword(x: str | Column, words: tuple[str, ...]) -> Column:
    y = text_key(x)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: y.contains(w))


#: Words in activities that ask for a person, and words that hint at automation (fixed values).
HUMAN_WORDS = (
    "신청", "등록", "접수", "제출", "결재", "결제", "입금", "납부", "승인", "서명",
    "대면", "회의", "면담", "전화", "방문", "출석", "참석", "수령", "발급", "실물", "현장",
)
AUTOMATION_WORDS = (
    "자동", "에이전트", "봇", "생성", "요약", "정리", "분석", "검증", "추출", "조회", "검색",
    "분류", "추천", "채점", "퀴즈", "문항", "리포트", "보고서", "취합", "집계",
)


def keyword_class(x: str | Column, automation: tuple[str, ...] = AUTOMATION_WORDS, human: tuple[str, ...] = HUMAN_WORDS) -> Column:
    """agent if a word hints at automation, else human if one asks for a person, else open."""
    return F.when(any_keyword(x, automation), "agent").when(any_keyword(x, human), "human").otherwise("open")


def procedure_steps(x: str | Column, most: int = 10) -> Column:
    """Steps of a description: what follows numbers, else bullets, else sentences of over five characters (at most so many).

    Failing that the first 200 characters; for no description at all one step that says that the task is done.
    """
    y = F.coalesce(col(x), F.lit(""))
    full = lambda steps: F.filter(F.transform(steps, strip), lambda s: s != "")
    numbered = F.regexp_extract_all(y, F.lit(r"\d+[.)\s]+(.+?)(?=\d+[.)\s]|$)"), F.lit(1))
    bullets = F.regexp_extract_all(y, F.lit(r"[-•]\s*(.+?)(?=[-•]|$)"), F.lit(1))
    sentences = full(F.filter(F.split(y, r"[.。]\s*"), lambda s: F.length(s) > 5))
    whole = F.array(F.when(F.length(y) > 200, F.concat(F.left(y, F.lit(200)), F.lit("..."))).otherwise(y))
    found = F.when(F.size(numbered) > 0, full(numbered)).when(F.size(bullets) > 0, full(bullets)).when(F.size(sentences) > 0, F.slice(sentences, 1, most)).otherwise(whole)
    return F.when(y == "", F.array(F.lit("작업을 수행합니다."))).otherwise(found)
