"""Queries over models of elements and the definitions they become. The events of a user are the elements of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procgraph.operators import runtime
from procgraph.plans.registry import query
from procgraph.sources.tables import user_events

_EL = """el AS (SELECT process_id, seq, id, CASE seq % 7 WHEN 0 THEN 'Event' WHEN 3 THEN 'gateway' WHEN 4 THEN 'Sequence' WHEN 5 THEN 'Data' WHEN 6 THEN 'EVENT' ELSE 'Activity' END AS et,
       CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS role, CASE WHEN event_type = 'click' THEN 'formHandler:' || id ELSE '' END AS given FROM ev),
    kd AS (SELECT process_id, seq, id, role, given, CASE seq % 7 WHEN 0 THEN 'event' WHEN 6 THEN 'event' WHEN 3 THEN 'gateway' WHEN 4 THEN 'sequence' ELSE 'activity' END AS kind,
       CASE seq % 7 WHEN 0 THEN CASE WHEN seq = 0 AND role <> 'view' THEN 'startEvent' ELSE 'intermediateCatchEvent' END WHEN 6 THEN CASE WHEN role = 'purchase' THEN 'endEvent' ELSE 'intermediateCatchEvent' END WHEN 3 THEN CASE role WHEN 'view' THEN 'parallelGateway' WHEN '' THEN 'exclusiveGateway' ELSE role END WHEN 4 THEN NULL ELSE 'userTask' END AS type FROM el WHERE et <> 'Data'),
    df AS (SELECT process_id, kind, row_number() OVER (PARTITION BY process_id, kind ORDER BY seq) - 1 AS place, id, type, CASE WHEN kind <> 'sequence' THEN role END AS role,
       CASE WHEN kind = 'activity' THEN CASE WHEN given <> '' THEN given ELSE 'formHandler:def_' || process_id || '_' || id || '_form' END END AS tool, CASE WHEN kind = 'activity' THEN CASE WHEN seq = 0 THEN 5 ELSE seq END END AS duration,
       CASE WHEN kind = 'sequence' THEN CASE WHEN role = '' THEN 'next' ELSE role END END AS condition FROM kd)"""


def event_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    k = F.col("seq") % 7
    kind = F.when(k == 0, "Event").when(k == 3, "gateway").when(k == 4, "Sequence").when(k == 5, "Data").when(k == 6, "EVENT").otherwise("Activity")
    role = F.when(F.col("event_type") != "error", F.col("event_type"))
    sort = F.when(k == 0, F.when((F.col("seq") == 0) & (F.col("event_type") != "view"), "StartEvent").otherwise("Timer")).when(k == 6, F.when(F.col("event_type") == "purchase", "EndEvent").otherwise("Timer")).when(k == 3, F.when(role == "view", "Parallel_Gateway").otherwise(role))
    element = F.struct(kind.alias("elementType"), "id", F.when(k == 4, "next").otherwise(F.col("event_type")).alias("name"), role.alias("role"), sort.alias("type"), F.when(F.col("event_type") == "click", F.concat(F.lit("formHandler:"), "id")).alias("tool"), F.col("seq").alias("duration"), F.when(k == 4, role).alias("condition"))
    rows = e.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("seq", element.alias("x")))).alias("xs"))
    model = F.struct(F.concat(F.lit("Def "), "process_id").alias("processDefinitionId"), F.transform("xs", lambda r: r["x"]).alias("elements"))
    return rows.select("process_id", F.to_json(model).alias("model"))


def listed(runtimes: DataFrame) -> DataFrame:
    """process_id, kind, place, id, type, role, tool, duration, condition of all that definitions hold."""
    out = None
    for kind, name, has in (("activity", "activities", ("type", "role", "tool", "duration")), ("event", "events", ("type", "role")), ("gateway", "gateways", ("type", "role")), ("sequence", "sequences", ("condition",))):
        x = runtimes.select("process_id", F.lit(kind).alias("kind"), F.posexplode(name).alias("place", "x"))
        every = {"type": "string", "role": "string", "tool": "string", "duration": "bigint", "condition": "string"}
        rows = x.select("process_id", "kind", "place", "x.id", *[F.col(f"x.{c}").alias(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in every.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


@query(", " + _EL + " SELECT * FROM df", "ev")
def runtime_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(runtime.runtime(event_models(spark, sf_dir)))


@query(
    ", "
    + _EL
    + """, ro AS (SELECT process_id, coalesce(arg_min(role, place) FILTER (role <> '' AND kind = 'activity'), '사용자') AS f, bool_or(coalesce(type, '') = 'startEvent') AS s, bool_or(coalesce(type, '') = 'endEvent') AS e FROM df GROUP BY 1)
      SELECT process_id, kind, CASE WHEN kind = 'event' AND NOT s THEN place + 1 ELSE place END AS place, id, type, CASE WHEN kind = 'activity' AND role = '' THEN f ELSE role END AS role, tool, duration, condition FROM df JOIN ro USING (process_id)
      UNION ALL SELECT process_id, 'event', 0, 'Event_Start', 'startEvent', f, NULL, NULL, NULL FROM ro WHERE NOT s
      UNION ALL SELECT process_id, 'event', (SELECT count(*) FROM df WHERE df.process_id = ro.process_id AND kind = 'event') + CASE WHEN s THEN 0 ELSE 1 END, 'Event_End', 'endEvent', f, NULL, NULL, NULL FROM ro WHERE NOT e""",
    "ev",
)
def runtime_definitions_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not strict: with roles, a start and an end where a model has none."""
    return listed(runtime.runtime(event_models(spark, sf_dir), strict=False))


@query(", " + _EL + " SELECT process_id, seq, 'unknown kind' AS reason FROM el WHERE et = 'Data'", "ev")
def model_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.rejected(event_models(spark, sf_dir)).select("process_id", F.col("seq").cast("long").alias("seq"), "reason")


@query(", " + _EL + ", ac AS (SELECT el.process_id, el.seq, el.id, df.tool, df.duration FROM el JOIN df ON df.id = el.id AND df.process_id = el.process_id WHERE et = 'Activity') SELECT process_id, seq, id, tool, duration FROM ac", "ev")
def activities_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of models with the tools of their definitions."""
    models = event_models(spark, sf_dir)
    done = runtime.activities_updated(models, runtime.runtime(models))
    return done.select("process_id", F.col("seq").cast("long").alias("seq"), "id", "tool", "duration")
