"""Models of elements (JSON) to definitions that run: activities, events, gateways and sequences as typed lists, and back.

Values of elements are read as text, so 5 and "5" are the same. What is no object, or of no known kind, is no part of a
definition and comes out of `rejected`. A model that isn't a JSON object, or has no list of elements, gives empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions.text import or_else, snake_id, strip

KINDS = ("activity", "event", "gateway", "sequence")
#: Words for a process, a person, a start and an end where a model has none (fixed values).
PROCESS, PERSON, START, END = "프로세스", "사용자", "시작", "종료"
#: Kinds of gateways by their names in models, in lower case (fixed values).
GATEWAYS = {"exclusivegateway": "exclusiveGateway", "exclusive_gateway": "exclusiveGateway", "parallelgateway": "parallelGateway", "parallel_gateway": "parallelGateway", "inclusivegateway": "inclusiveGateway", "inclusive_gateway": "inclusiveGateway"}


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), f"$.{path}", kind)


def _text(path: str) -> Column:
    return F.coalesce(_get("e", path), F.lit(""))


def elements(models: DataFrame) -> DataFrame:
    """process_id, seq, kind (null if unknown), e (variant) of all elements. models: process_id, model (JSON text)."""
    items = F.try_variant_get(F.try_parse_json("model"), "$.elements", "array<variant>")
    kind = F.lower(strip(_get("e", "elementType")))
    return models.select("process_id", F.posexplode(items).alias("seq", "e")).select("process_id", "seq", F.when(kind.isin(*KINDS), kind).alias("kind"), "e")


def rejected(models: DataFrame) -> DataFrame:
    """process_id, seq, reason, element (JSON text) of what no definition takes."""
    is_object = F.try_variant_get("e", "$", "map<string,variant>").isNotNull()
    return elements(models).where("kind IS NULL").select("process_id", "seq", F.when(is_object, "unknown kind").otherwise("no object").alias("reason"), F.to_json("e").alias("element"))


def _duration() -> Column:
    """Digits as a number; 5 for anything else, and for the number 0."""
    t = _get("e", "duration")
    zero = (t == "0") & (F.schema_of_variant(F.try_variant_get("e", "$.duration", "variant")) != "STRING")
    return F.when(t.rlike("^[0-9]{1,18}$") & ~zero, t.cast("long")).otherwise(F.lit(5).cast("long"))


def _list(path: str) -> Column:
    return F.coalesce(_get("e", path, "array<string>"), F.array().cast("array<string>"))


def _typed(process: Column) -> dict[str, Column]:
    """An element as a struct of each kind."""
    common = [_get("e", "id").alias("id"), _text("name").alias("name")]
    role, described, none = _text("role").alias("role"), _text("description").alias("description"), F.lit("{}").alias("properties")
    of = process.alias("process")
    kind = strip(_text("type"))
    event = F.when(kind == "StartEvent", "startEvent").when(kind == "EndEvent", "endEvent").otherwise("intermediateCatchEvent").alias("type")
    known = F.create_map(*[F.lit(x) for pair in GATEWAYS.items() for x in pair])
    gateway = F.coalesce(F.try_element_at(known, F.lower(kind)), or_else(kind, "exclusiveGateway")).alias("type")
    return {
        "activity": F.struct(*common, role, _text("tool").alias("tool"), F.lit("userTask").alias("type"), of, _duration().alias("duration"), _list("inputData").alias("inputData"), _list("outputData").alias("outputData"), none, described, _text("instruction").alias("instruction"), _list("checkpoints").alias("checkpoints"), F.lit(None).cast("string").alias("agent"), F.lit("none").alias("agentMode"), F.lit(None).cast("string").alias("orchestration"), F.array().cast("array<string>").alias("attachments"), F.array().cast("array<string>").alias("customProperties")),
        "event": F.struct(*common, role, event, of, none, described, _text("trigger").alias("trigger")),
        "gateway": F.struct(*common, role, gateway, of, F.lit("").alias("condition"), none, described),
        "sequence": F.struct(*common, _get("e", "source").alias("source"), _get("e", "target").alias("target"), or_else(_get("e", "condition"), _text("name")).alias("condition"), none),
    }


def runtime(models: DataFrame, strict: bool = True) -> DataFrame:
    """process_id, name, definition_id, activities, events, gateways, sequences (typed, in order), roles, participants, data, subProcesses.

    Tools that are missing are named after process and activity, and what a flow is called is its condition if it has none.
    Not strict, a model also gets what it lacks: roles (those its activities name, in order, or one person), a participant,
    the first role for activities without one, a start and an end. models: process_id, model (a process once).
    """
    m = models.withColumn("_m", F.try_parse_json("model"))
    top = m.select("process_id", or_else(_get("_m", "processDefinitionName"), PROCESS).alias("name"), F.coalesce(_get("_m", "processDefinitionId"), F.lit("")).alias("definition_id"), *[F.coalesce(_get("_m", c, "array<variant>"), F.expr("cast(array() as array<variant>)")).alias(c) for c in ("roles", "participants", "data", "subProcesses")])
    rows = elements(models).where("kind IS NOT NULL").join(top.select("process_id", "definition_id"), "process_id")
    typed = _typed(F.col("definition_id"))
    lists = rows.groupBy("process_id").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("seq", v.alias("x")))).alias(k) for k, v in typed.items()])
    names = {"activity": "activities", "event": "events", "gateway": "gateways", "sequence": "sequences"}
    types = dict(lists.dtypes)
    out = top.join(lists, "process_id", "left").select(*top.columns, *[F.transform(F.array_sort(F.coalesce(k, F.array().cast(types[k]))), lambda r: r["x"]).alias(n) for k, n in names.items()])

    def tool(a: Column) -> Column:
        name = F.concat(F.lit("formHandler:"), snake_id(or_else("definition_id", "process")), F.lit("_"), snake_id(F.coalesce(a["id"], F.lit("None"))), F.lit("_form"))
        return F.when(F.trim(a["tool"]) == "", name).otherwise(a["tool"])

    out = out.withColumn("activities", F.transform("activities", lambda a: a.withField("tool", tool(a))))
    if strict:
        return out
    asked = F.array_distinct(F.filter(F.transform("activities", lambda a: strip(a["role"])), lambda r: r != ""))
    asked = F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit(PERSON)))
    made = F.transform(asked, lambda r: F.to_variant_object(F.struct(r.alias("name"), F.lit("").alias("endpoint"), F.lit(None).cast("string").alias("resolutionRule"), F.lit("").alias("default"))))
    part = F.to_variant_object(F.struct(F.concat(F.lit("Participant_"), "definition_id").alias("id"), F.col("name"), F.col("definition_id").alias("processRef")))
    out = out.withColumn("roles", F.when(F.size("roles") > 0, F.col("roles")).otherwise(made)).withColumn("participants", F.when(F.size("participants") > 0, F.col("participants")).otherwise(F.array(part)))
    out = out.withColumn("_first", F.coalesce(F.try_variant_get(F.get("roles", F.lit(0)), "$.name", "string"), F.lit("")))
    out = out.withColumn("activities", F.transform("activities", lambda a: a.withField("role", F.when(strip(a["role"]) == "", F.col("_first")).otherwise(a["role"]))))

    def event(i: str, name: str, kind: str) -> Column:
        return F.array(F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.col("_first").alias("role"), F.lit(kind).alias("type"), F.col("definition_id").alias("process"), F.lit("{}").alias("properties"), F.lit("").alias("description"), F.lit("").alias("trigger")))

    none = F.slice("events", 1, 0)
    has = lambda kind: F.exists("events", lambda e: e["type"] == kind)
    events = F.concat(F.when(has("startEvent"), none).otherwise(event("Event_Start", START, "startEvent")), F.col("events"), F.when(has("endEvent"), none).otherwise(event("Event_End", END, "endEvent")))
    return out.withColumn("events", events).drop("_first")


def definitions(runtimes: DataFrame) -> DataFrame:
    """process_id, definition (JSON text) of typed lists as `runtime` gives them."""
    lists = [F.col(c) for c in ("data", "roles", "events", "activities", "gateways", "sequences", "subProcesses", "participants")]
    whole = F.struct(F.col("name").alias("processDefinitionName"), F.col("definition_id").alias("processDefinitionId"), *lists)
    return runtimes.select("process_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("definition"))


def activities_updated(models: DataFrame, runtimes: DataFrame) -> DataFrame:
    """process_id, seq, id, name, description, role, inputData, outputData, checkpoints, tool, duration, instruction of activities of models.

    What the definition says about an activity with the same id (of several, the last) counts, but an empty name doesn't; others keep theirs.
    """
    rows = elements(models).where(_get("e", "elementType") == "Activity")
    own = rows.select("process_id", "seq", strip(_get("e", "id")).alias("id"), _text("name").alias("name"), _text("description").alias("description"), _text("role").alias("role"), _list("inputData").alias("inputData"), _list("outputData").alias("outputData"), _list("checkpoints").alias("checkpoints"), _text("tool").alias("tool"), _duration().alias("duration"), _text("instruction").alias("instruction"))
    known = runtimes.select("process_id", F.posexplode("activities").alias("_k", "a")).where("a.id <> ''")
    known = known.groupBy("process_id", F.col("a.id").alias("id")).agg(F.max_by("a", "_k").alias("a"))
    new = lambda c: F.coalesce(F.nullif(F.col("a.name"), F.lit("")) if c == "name" else F.col(f"a.{c}"), F.col(c)).alias(c)
    return own.join(known, ["process_id", "id"], "left").select("process_id", "seq", "id", *[new(c) for c in own.columns[3:]])
