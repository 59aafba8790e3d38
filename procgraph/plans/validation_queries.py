"""Queries over whole models that are put in order. The events of a user are a process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.operators.validation import validated
from procgraph.plans.registry import CTE, query
from procgraph.sources.tables import user_events


def event_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are gateways and every third row is a sequence, some without ends or with ends that aren't there; ids occur again."""
    sequence, error, seq = F.expr("seq % 3 = 2"), F.col("event_type") == "error", F.col("seq")
    numbered = lambda glue, n: F.concat(F.col("event_type"), F.lit(glue), n.cast("string"))
    return user_events(spark, sf_dir).select(
        "process_id",
        "seq",
        F.when(sequence, " Sequence").when(error, "GATEWAY").otherwise("activity").alias("kind"),
        F.when(sequence, "").otherwise(numbered(" ", seq % 5)).alias("id"),
        F.when(error & (seq % 2 == 0), "parallel_gateway").alias("type"),
        F.when(seq % 2 == 0, F.col("event_type")).alias("name"),
        F.when(sequence & (seq % 2 == 0), "").when(sequence, numbered(" ", (seq + 1) % 5)).when(seq % 4 == 1, numbered(" ", F.lit(0))).alias("source"),
        F.when(sequence & (seq % 4 < 2), numbered("_", seq % 7)).alias("target"),
        F.when(sequence & (seq % 5 == 0), "yes").alias("condition"),
    )


def _round(i: int) -> str:
    """One round of the collapse in SQL: nodes n<i> and flows f<i> from those before. Rounds beyond the last needed change nothing."""
    a, b = i - 1, i
    return f"""
wk{b} AS MATERIALIZED (SELECT n{a}.*, n{a}.kind = 'Gateway' AND coalesce(c, 0) < 2 AS weak FROM n{a} LEFT JOIN (SELECT p, s, count(*) AS c FROM f{a} GROUP BY ALL) q ON q.p = n{a}.p AND q.s = n{a}.id),
to{b} AS (SELECT p, id, weak, o, coalesce(first_value(CASE WHEN NOT weak THEN {{'o': o, 'id': id}} END IGNORE NULLS) OVER (PARTITION BY p ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  max(CASE WHEN type = 'EndEvent' THEN {{'o': o, 'id': id}} END) OVER (PARTITION BY p)) AS nx FROM wk{b}),
kept{b} AS (SELECT f.*, y.o AS so, CASE WHEN z.weak THEN z.nx END AS nx FROM f{a} f JOIN to{b} y ON y.p = f.p AND y.id = f.s AND NOT y.weak JOIN to{b} z ON z.p = f.p AND z.id = f.t),
u{b} AS (SELECT p, s, t, k, n, m, id, name, condition FROM kept{b} WHERE nx IS NULL UNION ALL SELECT p, s, nx.id, 4, so, nx.o, 'seq_' || s || '_' || nx.id, '', '' FROM kept{b} WHERE nx IS NOT NULL AND nx.id <> s),
f{b} AS MATERIALIZED (SELECT * FROM u{b} QUALIFY k = 0 OR row_number() OVER (PARTITION BY p, s, t ORDER BY k, n, m) = 1),
n{b} AS MATERIALIZED (SELECT * EXCLUDE weak FROM wk{b} WHERE NOT weak)"""


_ROUNDS = 4
_SNAKE = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_SQL = (
    "WITH "
    + CTE["ev"]
    + f""",
x AS (SELECT process_id AS p, seq + 1 AS pos, seq % 3 = 2 AS sq, CASE WHEN seq % 3 = 2 THEN 'Sequence' WHEN event_type = 'error' THEN 'Gateway' ELSE 'Activity' END AS kind,
  CASE WHEN seq % 3 = 2 THEN '' ELSE event_type || ' ' || seq % 5 END AS old, CASE WHEN event_type <> 'error' THEN 'UserActivity' WHEN seq % 2 = 0 THEN 'ParallelGateway' ELSE 'ExclusiveGateway' END AS type,
  CASE WHEN seq % 2 = 0 THEN event_type END AS name, CASE WHEN seq % 3 = 2 THEN CASE WHEN seq % 2 = 0 THEN '' ELSE event_type || ' ' || (seq + 1) % 5 END WHEN seq % 4 = 1 THEN event_type || ' 0' ELSE '' END AS source,
  CASE WHEN seq % 3 = 2 AND seq % 4 < 2 THEN event_type || '_' || seq % 7 ELSE '' END AS target, CASE WHEN seq % 3 = 2 AND seq % 5 = 0 THEN 'yes' ELSE '' END AS condition FROM ev),
b AS (SELECT *, {_SNAKE.format("old")} AS base, row_number() OVER (PARTITION BY p, sq, old ORDER BY pos) AS k FROM x),
us AS (SELECT p, regexp_replace(base, '_[0-9]+$', '') AS base, max(regexp_extract(base, '_([0-9]+)$', 1)::INT) AS most FROM b WHERE NOT sq GROUP BY ALL),
nd AS MATERIALIZED (SELECT b.*, CASE WHEN k = 1 THEN b.base ELSE b.base || '_' || (greatest(coalesce(most, 1), 1) + k - 1) END AS id FROM b LEFT JOIN us ON us.p = b.p AND us.base = b.base WHERE NOT sq),
nm AS (SELECT p, old, arg_max(id, pos) AS id FROM nd GROUP BY ALL),
al AS MATERIALIZED (SELECT p, old AS word, id, 0 AS pri FROM nm UNION ALL SELECT p, id, id, 1 FROM nd),
rs AS (SELECT p, pos, arg_min(al.id, pri) FILTER (word = source OR pri = 1) AS id FROM x JOIN al USING (p) WHERE source <> '' AND (word = source AND pri = 0 OR word = {_SNAKE.format("source")} AND pri = 1) GROUP BY ALL),
rt AS (SELECT p, pos, arg_min(al.id, pri) AS id FROM x JOIN al USING (p) WHERE target <> '' AND (word = target AND pri = 0 OR word = {_SNAKE.format("target")} AND pri = 1) GROUP BY ALL),
fl AS (SELECT x.*, last_value(nd.id IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef, first_value(nd.id IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aft, rs.id AS si, rt.id AS ti, nd.id AS id
  FROM x LEFT JOIN nd ON nd.p = x.p AND nd.pos = x.pos LEFT JOIN rs ON rs.p = x.p AND rs.pos = x.pos LEFT JOIN rt ON rt.p = x.p AND rt.pos = x.pos WINDOW w AS (PARTITION BY x.p ORDER BY x.pos)),
pp AS (SELECT DISTINCT p FROM x),
n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p ORDER BY part, pos) AS o FROM (SELECT p, 1 AS part, pos, kind, id, type, coalesce(name, CASE WHEN kind = 'Activity' THEN '활동 ' || pos ELSE '' END) AS name, coalesce(si, '') AS source FROM fl WHERE NOT sq
  UNION ALL SELECT p, 0, 0, 'Event', 'start_event', 'StartEvent', '프로세스 시작', '' FROM pp UNION ALL SELECT p, 2, 0, 'Event', 'end_event', 'EndEvent', '프로세스 종료', '' FROM pp)),
ch AS (SELECT p, id AS s, lead(id) OVER (PARTITION BY p ORDER BY o) AS t, o FROM n0),
u0 AS (SELECT p, CASE WHEN source = '' THEN bef ELSE si END AS s, CASE WHEN target = '' THEN aft ELSE ti END AS t, 0 AS k, pos AS n, 0 AS m, coalesce(name, '') AS name, condition FROM fl WHERE sq
  UNION ALL SELECT p, si, id, 1, pos, 0, '', '' FROM fl WHERE NOT sq AND si IS NOT NULL UNION ALL SELECT p, s, t, 2, o, 0, '', '' FROM ch),
f0 AS MATERIALIZED (SELECT p, s, t, k, n, m, 'seq_' || s || '_' || t AS id, name, condition FROM u0 WHERE s <> t QUALIFY k = 0 OR row_number() OVER (PARTITION BY p, s, t ORDER BY k, n, m) = 1),"""
    + ",".join(_round(i) for i in range(1, _ROUNDS + 1))
    + f""",
fj AS (SELECT f.*, row_number() OVER (PARTITION BY f.p, s ORDER BY k, n, m) AS j, g.kind = 'Gateway' AS gate FROM f{_ROUNDS} f JOIN n{_ROUNDS} g ON g.p = f.p AND g.id = f.s),
un AS (SELECT a.p, -1 AS k, a.o AS n, 0 AS m, a.kind, a.id, a.type, a.name, coalesce(l.id, '') AS source, '' AS target, '' AS condition FROM n{_ROUNDS} a LEFT JOIN n{_ROUNDS} l ON l.p = a.p AND l.id = a.source
  UNION ALL SELECT p, k, n, m, 'Sequence', id, '', name, s, t, CASE WHEN gate AND condition = '' THEN '조건 ' || j ELSE condition END FROM fj)
SELECT p AS process_id, row_number() OVER (PARTITION BY p ORDER BY k, n, m, id) AS seq, kind, id, type, name, source, target, condition FROM un"""
)


@query(_SQL)
def validated_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models of users in order: nodes, then flows."""
    return validated(event_elements(spark, sf_dir))
