"""Secret scan by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (a match holds all trigrams of at least one
alternative). The index has a posting (trigram, document) for every trigram that a rule asks for; intersecting postings
gives candidates, and the expression runs over the whole text of a candidate only. Rules without a mandatory trigram run
over every text.

Defined results: a null text is an empty one and has no spans. Matches of one rule are leftmost and don't overlap;
matches that fail the rule's length are dropped after matching. A private key goes from its BEGIN line over the
base64 body to its END line, with up to eight headers; where that doesn't follow, the BEGIN line alone counts. The first
part of a web token has up to 1000 characters behind its mark. With these bounds no expression tries a long run again from
each of its places, nor does a text with very many spans take more than time in proportion to them: places and redacted
texts are put together in groups of spans. Spans of different rules may overlap; spans that start
together keep the order of the rules. Repeated rows are scanned one by one (candidates are a superset, so equal ids do no
harm); other columns of the input don't matter. Only DataFrame functions run.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.llm.quality import let

#: Spans of one text that are worked on together.
GROUP = 256
#: Stands around matches while positions are taken; in a text it is exchanged for another character first.
MARK, OTHER = "\uE000", "\uE001"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # its least length in code points
    base: bool = False


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
#: What lies between the lines of a key: up to eight headers of two kinds, base64, line ends (also written as two characters).
_KEY_BODY = r"(\s*(Proc-Type|DEK-Info): [A-Za-z0-9,-]+){0,8}[A-Za-z0-9+/=\\\s]*"

RULES = (
    Rule("assign", rf"""({_ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----({_KEY_BODY}-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{1,1000}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
)


def _runs(items: Iterable, most: int = 64) -> list[list[str]]:
    """Alternatives of a parsed expression, each a list of strings that occur in every match of it, in lower case.

    The last string of an alternative may go on with what follows; an empty string ends it.
    """
    alts: list[list[str]] = [[""]]

    def then(more: list[list[str]]) -> None:
        nonlocal alts
        if len(alts) * len(more) > most:
            more = [["", ""]]
        alts = [a[:-1] + [a[-1] + m[0]] + m[1:] for a, m in product(alts, more)]
        alts = [list(x) for x in dict.fromkeys(map(tuple, alts))]

    gap = [["", ""]]
    for op, arg in items:
        if op is sre.LITERAL:
            then([[chr(arg).lower()]])
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if chars is not None and kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif chars is not None and kind is sre.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
            then([[c] for c in sorted(chars)] if chars and len(chars) <= 6 else gap)
        elif op is sre.SUBPATTERN:
            then(_runs(arg[3], most))
        elif op is sre.BRANCH:
            then([a for branch in arg[1] for a in _runs(branch, most)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _runs(inner, most)
            if (low, high) == (0, 1):
                then([[""], *one])
            else:
                for _ in range(min(low, 3)):
                    then(one)
                if not (low == high <= 3):
                    then(gap)
        elif op is not sre.AT:
            then(gap)
    return alts


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Trigram sets, one of which is wholly in the lower-cased text of every match; none: the rule scans fully."""
    sets = {frozenset(s[i : i + 3] for s in alt for i in range(len(s) - 2)) for alt in _runs(sre_parser.parse(pattern))}
    if any(not s for s in sets):
        return []
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def index(docs: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """Postings: trigram, doc_id, for the given trigrams."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in sorted(trigrams)]))
    return low.select("doc_id", F.explode(has).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """c_id, kinds: the rules whose trigram query a document meets, among those that have one."""
    clauses = [(r.kind, n, len(c), t) for r in rules for n, c in enumerate(trigram_query(r.pattern)) for t in c]
    if not clauses:
        return docs.sparkSession.createDataFrame([], f"c_id {dict(docs.dtypes)['doc_id']}, kinds array<string>")
    asked = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, need int, trigram string")  # as many as the rules have trigrams
    posts = index(docs, {t for *_, t in clauses})
    met = posts.join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "clause").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need")
    return met.groupBy(F.col("doc_id").alias("c_id")).agg(F.collect_set("kind").alias("kinds"))


def grouped(x: Column) -> Column:
    """An array in slices of GROUP."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / GROUP).cast("int")), lambda g: F.slice(x, g * GROUP + 1, GROUP))


def offsets(groups: Column) -> Column:
    """Of arrays of numbers the sum of all before each, so that no long array is built item by item."""
    step = lambda acc, g: F.struct((acc["at"] + total(g)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(groups, begin, step, lambda acc: acc["out"])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """An array of structs (start, k, stop) of the rule's spans in a text, in code points."""
    marked = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), f"({rule.pattern})", f"{MARK}$1{MARK}"), MARK)
    empty = F.array().cast("array<struct<start:int,k:int,stop:int>>")
    size = lambda x: F.length(F.regexp_extract(x, rule.pattern, rule.group) if rule.group else x)

    def inside(p: Column, lens: Column, base: Column) -> Column:
        """Every other part is a match; places are summed up for those only that are long enough."""
        odd = F.filter(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: size(F.get(p, i)) >= rule.least)
        group = lambda i: F.floor(i / GROUP).cast("int")
        start = lambda i: F.get(base, group(i)) + total(F.slice(lens, group(i) * GROUP + 1, i % GROUP))
        return F.transform(odd, lambda i: let(start(i), lambda at: F.struct(at.alias("start"), F.lit(order).alias("k"), (at + F.get(lens, i)).alias("stop"))))

    found = lambda p: let(F.transform(p, F.length), lambda lens: let(offsets(grouped(lens)), lambda base: inside(p, lens, base)))
    return let(marked, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(empty))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """docs with another column: array of structs (start, k, stop), by start, then by the rule's place k."""
    empty = F.array().cast("array<struct<start:int,k:int,stop:int>>")
    found_in = candidates(docs.select("doc_id", "text"), rules).select(F.col("c_id").alias("_pg_id"), F.col("kinds").alias("_pg_kinds"))
    joined = docs.join(found_in, F.col("doc_id").eqNullSafe(F.col("_pg_id")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for k, r in enumerate(rules):
        spans = spans_of(text, r, k)
        found.append(F.when(F.array_contains("_pg_kinds", r.kind), spans).otherwise(empty) if trigram_query(r.pattern) else spans)
    return joined.withColumn(out, F.array_sort(F.concat(*found))).drop("_pg_id", "_pg_kinds")


def joined_spans(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(kinds, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: counts of the base kinds, the digest of the base spans, all spans."""
    found = find(docs.select("doc_id", "text"), rules).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda k: F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{rules[k].kind}") for k in base]
    base_spans = F.filter(spans, lambda s: s["k"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined_spans(base_spans, rules), 256).alias("base_sha256"), joined_spans(spans, rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = "[SECRET]") -> DataFrame:
    """docs with every span exchanged for a mark; n_chars follows. Spans that overlap or touch become one mark."""
    text = F.col("text")

    furthest = lambda spans: F.array_max(F.transform(spans, lambda s: s["stop"]))

    def part(spans: Column, at: Column, piece: Column) -> Column:
        """What the spans of a group leave of a piece of the text, which begins at a place up to which all is done."""

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, acc["at"] - at + 1, s["start"] - acc["at"])
            first = (s["start"] == 0) & (acc["at"] == 0)
            out = F.when(s["start"] > acc["at"], F.concat(acc["out"], gap, F.lit(by))).when(first & (acc["out"] == ""), F.lit(by)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def cut(groups: Column) -> Column:
        done = F.transform(groups, lambda g, k: F.coalesce(furthest(F.transform(F.slice(groups, 1, k), lambda x: F.struct(furthest(x).alias("stop")))), F.lit(0)))
        upto = lambda g, k, at: F.greatest(at, furthest(g))
        piece = lambda g, k, at: F.substring(text, at + 1, upto(g, k, at) - at)
        return let(done, lambda at: F.array_join(F.transform(groups, lambda g, k: let(piece(g, k, F.get(at, k)), lambda p: part(g, F.get(at, k), p))), ""))

    tail = let(furthest(F.col("_pg_spans")), lambda at: F.substring(text, at + 1, F.length(text)))
    whole = F.concat(let(grouped(F.col("_pg_spans")), cut), tail)
    hit = F.size("_pg_spans") > 0
    out = find(docs, rules, "_pg_spans").withColumn("_pg_text", F.when(hit, whole).otherwise(text))
    cols = [F.col("_pg_text").alias("text") if c == "text" else F.when(hit, F.length("_pg_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)


def _oracle() -> str:
    quote = lambda s: s.replace("'", "''")
    parts = []
    for k, r in enumerate(RULES):
        size = f"len(regexp_extract(p[i], '{quote(r.pattern)}', {r.group}))" if r.group else "len(p[i])"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0)::BIGINT AS s, len(p[i]) AS n, {size} >= {r.least} AS ok "
            f"FROM (SELECT doc_id, p, unnest(range(2, len(p), 2)) AS i FROM (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(57344), chr(57345)), "
            f"'({quote(r.pattern)})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p FROM documents))"
        )
    base = ", ".join(str(k) for k, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(RULES) if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH s AS ({" UNION ALL ".join(parts)}),
j AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans,
             string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (WHERE k IN ({base})) AS b FROM s WHERE ok GROUP BY doc_id)
SELECT doc_id, {names}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN j USING (doc_id)
"""


ORACLE = _oracle()
