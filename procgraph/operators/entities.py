"""What comes out of an extraction, before and after it is in the graph: scopes, pools, explicit mappings, evidence, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.text import name_key, text_key
from procgraph.operators.resolve import containing, pick_user

#: Labels in the order in which an id is looked for (fixed values).
EVIDENCE_LABELS = ("Process", "Task", "Role", "Gateway", "Event", "Skill", "DMNDecision", "DMNRule")


def scoped(rows: DataFrame, processes: DataFrame) -> DataFrame:
    """rows with those that have no process_id given to the first process. processes: proc_id, seq."""
    first = processes.agg(F.min_by("proc_id", F.struct("seq", "proc_id")).alias("_first"))  # one row
    return rows.join(F.broadcast(first)).withColumn("process_id", F.coalesce(F.nullif("process_id", F.lit("")), "_first")).drop("_first")


def shortened(value: Column, most: int) -> Column:
    """A stripped text of at most so many characters; what is cut is shown by an ellipsis."""
    t = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def compact(rows: DataFrame, keys: dict[str, int], most: int, *order: str) -> DataFrame:
    """The first rows in order, with the listed columns shortened, null where nothing is left. keys: column and limit."""
    return rows.orderBy(*order).limit(most).select(*[F.nullif(shortened(F.col(c), n), F.lit("")).alias(c) for c, n in keys.items()])


def without_prefix(stats: DataFrame, prefix: str, column: str = "label") -> DataFrame:
    return stats.where(~F.col(column).startswith(prefix))


def split_questions(questions: DataFrame, state: str = "open") -> tuple[DataFrame, DataFrame]:
    """The resolved and the open ones. questions: status."""
    is_open = F.lower("status").eqNullSafe(state)
    return questions.where(~is_open), questions.where(is_open)


def parent_links(rel: str, children: DataFrame, parents: DataFrame) -> DataFrame:
    """rel, src, dst of children whose parent is there; children without one stay nodes and get no edge. children: id, parent_id."""
    return children.join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select(F.lit(rel).alias("rel"), F.col("parent_id").alias("src"), F.col("id").alias("dst"))


def explicit(mappings: DataFrame, tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """task_id, target_id: each mapping gives its target, if known by name, to the first task whose name holds the mapped one.

    Of several for one task the last mapping wins. mappings: task_name, target_name, seq. tasks: task_id, name, seq.
    targets: id, name, seq (of equal names the last counts).
    """
    known = targets.groupBy(F.lower("name").alias("_target")).agg(F.max_by("id", F.struct("seq", "id")).alias("target_id"))
    asked = mappings.select(F.lower(F.coalesce("task_name", F.lit(""))).alias("_asked"), F.lower(F.coalesce("target_name", F.lit(""))).alias("_target"), F.col("seq").alias("_order")).join(known, "_target")
    named = tasks.select("task_id", F.lower("name").alias("_name"), "seq")
    hit = containing(named, asked.select("_asked").distinct(), "_name", "_asked").select("_asked", "task_id", "seq")
    least = named.agg(F.min_by("task_id", F.struct("seq", "task_id")).alias("task_id"), F.min("seq").alias("seq")).where("task_id IS NOT NULL")
    hit = hit.unionByName(least.select(F.lit("").alias("_asked"), "task_id", "seq"))  # every name holds the empty one
    first = hit.groupBy("_asked").agg(F.min_by("task_id", F.struct("seq", "task_id")).alias("task_id"))
    return asked.join(first, "_asked").groupBy("task_id").agg(F.max_by("target_id", F.struct("_order", "target_id")).alias("target_id"))


def labelled_evidence(entities: DataFrame, chunks: DataFrame, evidence: DataFrame, mode: str = "full") -> DataFrame:
    """SUPPORTED_BY edges (label, src, dst) from the first label that has an entity's id; none at all with mode "off".

    entities: label, id. chunks: chunk_id. evidence: entity_id, chunk_id.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in EVIDENCE_LABELS]), F.col("label"))
    first = entities.where(F.col("label").isin(*EVIDENCE_LABELS)).groupBy("id").agg(F.min_by("label", rank).alias("label"))
    asked = evidence.where(F.lit(mode != "off")).select(F.col("entity_id").alias("id"), "chunk_id").distinct()
    return asked.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").join(first, "id").select("label", F.col("id").alias("src"), F.col("chunk_id").alias("dst"))


def snippets(chunks: DataFrame, key: str, most: int = 200) -> DataFrame:
    """key, page, snippet: the start of the first chunk by page, then by chunk_no."""
    best = chunks.groupBy(key).agg(F.min_by(F.struct("page", F.left("text", F.lit(most)).alias("snippet")), F.struct("page", "chunk_no")).alias("b"))
    return best.select(key, "b.page", "b.snippet")


def heuristic_agent(activities: DataFrame, users: DataFrame, human_words: tuple[str, ...]) -> DataFrame:
    """activity_id, user_id: the agent that an activity's role names; else the first whose name, role or alias the text holds.

    Activities that need a human get none. Texts and names also match the other way round. activities: activity_id, role,
    name, instruction, description. users: user_id, username, role, alias, is_agent, seq.
    """
    said = text_key(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "instruction", "description")]))
    rows = activities.select("activity_id", F.col("role").alias("_role"), said.alias("_text"))
    human = reduce(lambda a, b: a | b, [F.col("_text").contains(w) for w in human_words], F.lit(False))
    rows = rows.where(~human)
    by_role = pick_user(rows.select(F.col("_role").alias("role")).where("role <> ''").distinct(), users).where("tier < 2").select(F.col("role").alias("_role"), F.col("user_id").alias("_by_role"))
    agents = users.where("is_agent").select("user_id", F.col("seq").alias("_seq"), F.explode(F.array("username", "role", "alias")).alias("_v")).select("user_id", "_seq", text_key("_v").alias("_value")).where("_value <> ''").distinct()
    texts = rows.select("_text").where("_text <> ''").distinct()
    cols = ["_text", "user_id", "_seq"]
    hit = containing(texts, agents, "_text", "_value").select(*cols).unionByName(containing(agents, texts, "_value", "_text").select(*cols))
    by_text = hit.groupBy("_text").agg(F.min_by("user_id", F.struct("_seq", "user_id")).alias("_by_text"))
    out = rows.join(by_role, "_role", "left").join(by_text, "_text", "left")
    return out.select("activity_id", F.coalesce("_by_role", "_by_text").alias("user_id")).where("user_id IS NOT NULL")


def participants(found: DataFrame, processes: DataFrame) -> DataFrame:
    """Participants of a collaboration whose process is there, or that name none. found: id, process_ref. processes: proc_id."""
    ref = found.withColumn("process_ref", F.coalesce("process_ref", F.lit("")))
    return ref.where("process_ref = ''").unionByName(ref.join(processes.select(F.col("proc_id").alias("process_ref")).distinct(), "process_ref", "left_semi").select(*ref.columns))


def appended_descriptions(processes: DataFrame) -> DataFrame:
    """proc_id, description of the first process of each name, with what later ones say that isn't in it yet. Has seq."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", "proc_id", F.coalesce("description", F.lit("")).alias("d")))), lambda x: x["d"])
    got = processes.groupBy(name_key("name").alias("_key")).agg(F.min_by("proc_id", F.struct("seq", "proc_id")).alias("proc_id"), rows.alias("ds"))
    more = F.aggregate(F.slice("ds", 2, F.size("ds")), F.element_at("ds", 1), lambda acc, d: F.when((d == "") | acc.contains(d), acc).otherwise(F.concat(acc, F.lit(" "), d)))
    return got.select("proc_id", more.alias("description"))


def flow_lists(nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """id, incoming, outgoing: ids of flows by seq, joined by commas. nodes: id. flows: flow_id, src, dst, seq."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "flow_id"))), lambda x: x["flow_id"]), ",")
    into = flows.groupBy(F.col("dst").alias("id")).agg(ordered.alias("incoming"))
    out = flows.groupBy(F.col("src").alias("id")).agg(ordered.alias("outgoing"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("incoming", "outgoing")])


def map_sizes(edges: DataFrame) -> DataFrame:
    """rel, keys, total: how many keys a map from src to lists of dst has, and how many values all of them."""
    return edges.groupBy("rel", "src").agg(F.count_distinct("dst").alias("n")).groupBy("rel").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("total"))


def mean_positions(places: DataFrame, group: str, at: str) -> DataFrame:
    """process_id, group, mean, rank: groups of a process by the average place of their members."""
    mean = places.groupBy("process_id", group).agg(F.avg(at).alias("mean"))
    return mean.withColumn("rank", F.row_number().over(W.partitionBy("process_id").orderBy("mean", group)))


def type_counts(elements: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """process_id with the number of elements of each kind."""
    return elements.groupBy("process_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def by_role(activities: DataFrame) -> DataFrame:
    """role, activities: for each role that isn't blank what it does, in order, as structs (id, name). Has id, name, seq."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "id", F.coalesce("name", F.lit("")).alias("name"))))
    role = F.trim(F.coalesce("role", F.lit("")))
    return activities.withColumn("role", role).where("role <> ''").groupBy("role").agg(F.transform(rows, lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("activities"))


def most_common(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the value that occurs most often; of several the smallest."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def candidate_pool(listed: DataFrame, used: DataFrame) -> DataFrame:
    """name: those of the list in order, then those that only tasks name, each once by its key. Both: name, seq."""
    both = listed.select(F.lit(0).alias("_side"), "name", "seq").unionByName(used.select(F.lit(1).alias("_side"), "name", "seq"))
    return both.where(F.trim(F.coalesce("name", F.lit(""))) != "").groupBy(name_key("name").alias("_key")).agg(F.min_by("name", F.struct("_side", "seq", "name")).alias("name")).select("name")


def search_text(name: str, description: str) -> Column:
    """What an entity is embedded by: its name, and its description after a full stop where there is one."""
    d = F.trim(F.coalesce(F.col(description), F.lit("")))
    return F.when(d == "", F.coalesce(F.col(name), F.lit(""))).otherwise(F.concat_ws(". ", F.coalesce(F.col(name), F.lit("")), d))


def default_tool(process_id: str, activity_id: str) -> Column:
    return F.concat(F.lit("formHandler:"), process_id, F.lit("_"), activity_id, F.lit("_form"))


def decided(action: str, confidence: str, least: float = 0.72) -> Column:
    """The action, or none where a confidence is too low or no number; asking for a new agent is let through."""
    sure = F.coalesce(F.expr(f"try_cast({confidence} AS double)"), F.lit(0.0)) >= least
    return F.when(sure | (F.col(action) == "create_agent"), F.col(action)).otherwise("none")


def now_iso() -> Column:
    """The time of the query in UTC, as ISO 8601 has it."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def artifacts(rendered: DataFrame, content: str, ending: str) -> DataFrame:
    """proc_id, filename, content: what is served for each process; names keep letters, digits, dash and underscore."""
    safe = F.regexp_replace("proc_id", r"[^0-9A-Za-z가-힣_-]+", "_")
    return rendered.select("proc_id", F.concat(safe, F.lit(ending)).alias("filename"), F.col(content).alias("content"))
