"""JSON trees of a tenant that are changed in place: organisation charts of any depth, process maps of three levels.

Values stay variants throughout, so fields that aren't known here come through; of objects, keys come out sorted. A text that
is no JSON object, or has a key twice in one object, is left as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.operators.graph import checkpointed, first_by

OBJECT, LIST = "map<string,variant>", "array<variant>"
#: Name and ids of the groups that take new processes (fixed values).
GROUP, MEGA_ID, MAJOR_ID = "미분류", "unclassified", "unclassified_major"
#: Maps up to which the names of their groups go to every task.
SMALL = 10_000
#: Fields of a member's data in a chart, besides id, name and flags (fixed values).
PROFILE = ("goal", "persona", "endpoint", "description", "skills", "model", "alias", "tools")


def _field(node: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(node, path, kind)


def _list(node: Column, key: str) -> Column:
    return F.coalesce(_field(node, f"$.{key}", LIST), F.expr(f"cast(array() as {LIST})"))


def _inner(node: Column) -> Column:
    """The JSON text of an object or list (a variant) without its brackets."""
    text = F.to_json(node)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _comma(column: str) -> Column:
    return F.when(F.col(column) == "", "").otherwise(",")


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """tenant, names, head, tail, _items (the list at key of node), _first and _last (text of node's fields before and after key)."""
    fields = rows.select("tenant", "names", "head", "tail", _field(F.col("node"), "$", OBJECT).alias("_fields"), _list(F.col("node"), key).alias("_items"))
    some = lambda keep: _inner(F.to_variant_object(F.map_filter("_fields", lambda k, _: keep(k))))
    return fields.select("tenant", "names", "head", "tail", "_items", some(lambda k: k < key).alias("_first"), some(lambda k: k > key).alias("_last"))


def _opened(rows: DataFrame, key: str, wanted: Callable[[Column], Column], new: Column) -> DataFrame:
    """The first wanted item of node's list at key (new if there is none): tenant, names (its own comes last), node (variant), head and tail (text around it)."""
    at = F.array_position(F.transform("_items", wanted), F.lit(True)).cast("int")
    found = _parts(rows, key).withColumn("_at", at)
    found = found.withColumn("_at", F.when(F.col("_at") > 0, F.col("_at")).otherwise(F.size("_items") + 1))
    before = _inner(F.slice("_items", F.lit(1), F.col("_at") - 1).cast("variant"))
    after = _inner(F.slice("_items", F.col("_at") + 1, F.size("_items")).cast("variant"))
    cut = found.select("*", F.coalesce(F.get("_items", F.col("_at") - 1), new).alias("node"), before.alias("_before"), after.alias("_after"))
    head = F.concat("head", F.lit("{"), "_first", _comma("_first"), F.lit(f'"{key}":['), "_before", _comma("_before"))
    tail = F.concat(_comma("_after"), "_after", F.lit("]"), _comma("_last"), "_last", F.lit("}"), "tail")
    return cut.select("tenant", F.array_append("names", _field(F.col("node"), "$.name", "string")).alias("names"), "node", head.alias("head"), tail.alias("tail"))


def _parsed(value: str, tenant: str) -> Column:
    """JSON text as a variant, null if it is none; one that is too long for a variant is an error."""
    lost = F.octet_length(value) >= 1 << 27
    return F.coalesce(F.try_parse_json(value), F.when(lost, F.raise_error(F.concat(F.lit("map too long: "), F.coalesce(F.col(tenant).cast("string"), F.lit("")))).cast("variant")))


def _put_in(maps: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maps that get new processes (tenant, names of the groups, head, tail: text around the place, size of the group), and those (tenant, id, name, seq).

    Only given maps are variants; ids meet by a join.
    """

    def group(key: str, items: str) -> Column:
        return F.parse_json(F.lit(f'{{"id":"{key}","name":"{GROUP}","{items}":[]}}'))

    def is_group(key: str) -> Callable[[Column], Column]:
        return lambda x: F.coalesce(_field(x, "$.id", "string") == key, F.lit(False)) | F.coalesce(_field(x, "$.name", "string") == GROUP, F.lit(False))

    asked = fresh.where("tenant IS NOT NULL AND id IS NOT NULL").select("tenant", "id", "name", "seq")
    changed = asked.select("tenant").distinct().join(maps.select("tenant", "value"), "tenant", "left").withColumn("_v", _parsed("value", "tenant"))
    root = F.coalesce(F.when(_field(F.col("_v"), "$", OBJECT).isNotNull(), F.col("_v")), F.parse_json(F.lit("{}")))
    roots = changed.select("tenant", F.array().cast("array<string>").alias("names"), root.alias("node"), F.lit("").alias("head"), F.lit("").alias("tail"))
    megas = _opened(roots, "mega_proc_list", is_group(MEGA_ID), group(MEGA_ID, "major_proc_list"))
    subs = _parts(_opened(megas, "major_proc_list", is_group(MAJOR_ID), group(MAJOR_ID, "sub_proc_list")), "sub_proc_list")
    head = F.concat("head", F.lit("{"), "_first", _comma("_first"), F.lit('"sub_proc_list":['), _inner(F.col("_items").cast("variant")))
    tail = F.concat(F.lit("]"), _comma("_last"), "_last", F.lit("}"), "tail")
    ids = F.transform("_items", lambda s: _field(s, "$.id", "string"))
    opened = checkpointed(subs.select("tenant", "names", head.alias("head"), tail.alias("tail"), ids.alias("ids")))
    there = opened.select("tenant", F.explode("ids").alias("id"))
    new = first_by(asked, ["tenant", "id"], "seq", "name").join(there, ["tenant", "id"], "left_anti").withColumn("name", F.coalesce("name", F.lit("")))
    return opened.select("tenant", "names", "head", "tail", F.size("ids").alias("size")), new


def process_maps(maps: DataFrame, fresh: DataFrame, piece: int = 4096) -> DataFrame:
    """tenant, value: each tenant's map with its new processes in the group for those that nobody has sorted yet.

    The group and the one within it are found by id or name and made if missing; a process whose id is in it isn't put in
    again, of new ones with an id the first by seq counts. A tenant without a map gets one. maps: tenant, value (JSON text, a
    tenant once). fresh: tenant, id, name, seq; without tenant or id they are left out.

    New processes are text from the start, put together in pieces of so many. A whole map is a row; where rows of processes do,
    process_map_rows makes none.
    """
    opened, new = _put_in(maps, fresh)
    text = F.to_json(F.struct("id", "name", F.lit(True).alias("new"), F.col("id").alias("path")))
    placed = new.select("tenant", text.alias("_text"), F.row_number().over(W.partitionBy("tenant").orderBy("seq", "id")).alias("_n"))

    def joined(n: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, "_text"))), lambda x: x["_text"]), ",").alias("_text")

    pieces = placed.withColumn("_piece", F.floor(F.col("_n") / piece)).groupBy("tenant", "_piece").agg(joined("_n"))
    both = maps.select("tenant", "value").join(opened, "tenant", "full").join(pieces.groupBy("tenant").agg(joined("_piece")), "tenant", "left")
    between = F.when((F.col("size") > 0) & F.col("_text").isNotNull(), ",").otherwise("")
    return both.select("tenant", F.when(F.col("head").isNull(), F.col("value")).otherwise(F.concat("head", between, F.coalesce("_text", F.lit("")), "tail")).alias("value"))


def map_rows(maps: DataFrame) -> DataFrame:
    """tenant, mega, major, id, name, new of the processes of maps (tenant, value)."""
    name = lambda c: _field(F.col(c), "$.name", "string")
    megas = maps.select("tenant", F.explode(_list(_parsed("value", "tenant"), "mega_proc_list")).alias("_a"))
    majors = megas.select("tenant", name("_a").alias("mega"), F.explode(_list(F.col("_a"), "major_proc_list")).alias("_b"))
    subs = majors.select("tenant", "mega", name("_b").alias("major"), F.explode(_list(F.col("_b"), "sub_proc_list")).alias("_c"))
    return subs.select("tenant", "mega", "major", _field(F.col("_c"), "$.id", "string").alias("id"), name("_c").alias("name"), F.coalesce(_field(F.col("_c"), "$.new", "boolean"), F.lit(False)).alias("new"))


def process_map_rows(maps: DataFrame, fresh: DataFrame) -> DataFrame:
    """map_rows(process_maps(maps, fresh)) where no tenant's new processes come together in a row or a task."""
    opened, new = _put_in(maps, fresh)
    groups = opened.select("tenant", F.get("names", F.lit(0)).alias("mega"), F.get("names", F.lit(1)).alias("major"))
    put = new.join(F.broadcast(groups) if groups.limit(SMALL + 1).count() <= SMALL else groups, "tenant")
    without = maps.select("tenant", "value").join(opened, "tenant", "left").select("tenant", F.coalesce(F.concat("head", "tail"), "value").alias("value"))
    return map_rows(without).unionByName(put.select("tenant", "mega", "major", "id", "name", F.lit(True).alias("new")))


def chart_levels(charts: DataFrame) -> list[DataFrame]:
    """Nodes of charts, a frame a level: tenant, path (places from the root), node (variant), id, items (children or null)."""
    node = F.col("node")
    known = lambda rows: rows.select("tenant", "path", "node", _field(node, "$.id", "string").alias("id"), _field(node, "$.children", LIST).alias("items"))
    level = checkpointed(known(charts.where("tenant IS NOT NULL").select("tenant", F.array().cast("array<int>").alias("path"), F.try_parse_json("chart").alias("node")).where("node IS NOT NULL")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = level.select("tenant", F.col("path").alias("up"), F.posexplode("items").alias("at", "node"))
        level = checkpointed(known(below.select("tenant", F.array_append("up", F.col("at")).alias("path"), "node")))
    return levels


def chart_nodes(charts: DataFrame) -> DataFrame:
    """tenant, parent_id, place, id, name, is_team of every node that is an object; the root has no parent. charts: tenant, chart."""
    out = None
    for level in chart_levels(charts):
        data = F.col("node")
        up = F.slice("path", 1, F.size("path") - 1)
        rows = level.where(_field(data, "$", OBJECT).isNotNull()).select("tenant", "path", F.when(F.size("path") > 0, up).alias("up"), "id", _field(data, "$.data.name", "string").alias("name"), F.coalesce(_field(data, "$.data.isTeam", "boolean"), F.lit(False)).alias("is_team"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return charts.sparkSession.createDataFrame([], "tenant string, parent_id string, place int, id string, name string, is_team boolean")
    above = out.select("tenant", F.col("path").alias("up"), F.col("id").alias("parent_id"))
    return out.join(above, ["tenant", "up"], "left").select("tenant", "parent_id", F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(0).alias("place"), "id", "name", "is_team")


def member_node(row: str = "") -> Column:
    """A user as a node of a chart, as JSON text, from the columns id, username, role, agent_type and the profile."""
    text = lambda c: F.coalesce(F.col(row + c), F.lit("")).alias(c)
    name = F.coalesce(F.col(row + "username"), F.lit("")).alias("name")
    kind = F.col(row + "agent_type")
    data = F.struct(text("id"), name, text("username"), text("role"), *[F.col(row + c).alias(c) for c in PROFILE], F.lit(True).alias("isAgent"), F.lit(True).alias("is_agent"), kind.alias("agent_type"), kind.alias("type"))
    return F.to_json(F.struct(text("id"), name, data.alias("data")), {"ignoreNullFields": "false"})


def add_members(charts: DataFrame, members: DataFrame) -> DataFrame:
    """tenant, chart: charts with members as last children of their teams, in the order of seq, unless they are there already.

    A team is the first node in reading order that has its id. Teams are looked up in the chart as it is given, so a member
    isn't a team for others. An unknown team, or one that is null or empty, changes nothing; a chart that nothing is added
    to keeps its text. A round a level. charts: tenant, chart (JSON text, a tenant once). members: tenant, team_id, id, seq, node (JSON text).
    """
    levels = chart_levels(charts)
    if not levels:
        return charts.select("tenant", "chart")
    ids = [level.select("tenant", "path", "id") for level in levels]
    nodes = ids[0]
    for more in ids[1:]:
        nodes = nodes.unionByName(more)
    asked = members.where("tenant IS NOT NULL AND team_id <> '' AND id <> ''").select("tenant", "team_id", "id", "seq", F.col("node").alias("text"))
    named = nodes.where("id IS NOT NULL")
    teams = named.withColumnRenamed("id", "team_id").join(asked.select("tenant", "team_id").distinct(), ["tenant", "team_id"], "left_semi").groupBy("tenant", "team_id").agg(F.min("path").alias("up"))
    children = named.where(F.size("path") > 0).select("tenant", F.slice("path", 1, F.size("path") - 1).alias("up"), "id")
    fresh = first_by(asked.join(teams, ["tenant", "team_id"]), ["tenant", "up", "id"], "seq", "text").join(children, ["tenant", "up", "id"], "left_anti")
    fresh = checkpointed(fresh.select("tenant", "up", F.lit(2_147_483_647).alias("at"), "seq", "id", "text"))
    touched = fresh.select("tenant").distinct()

    below = None
    for depth in range(len(levels) - 1, -1, -1):
        kids = fresh.where(F.size("up") == depth)
        kids = kids if below is None else kids.unionByName(below)
        # given children come first, at their places; new ones after them
        listed = kids.groupBy("tenant", F.col("up").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", "id", "text"))), lambda x: x["text"]), ",").alias("kids"))
        own = F.to_json(F.map_filter(_field(F.col("node"), "$", OBJECT), lambda k, _: k != "children"))
        put = F.concat(F.left(own, F.length(own) - 1), F.when(own == "{}", "").otherwise(","), F.lit('"children":['), F.col("kids"), F.lit("]}"))
        rows = levels[depth].join(touched, "tenant", "left_semi").join(listed, ["tenant", "path"], "left").select("tenant", "path", F.when(F.col("kids").isNotNull(), put).otherwise(F.to_json("node")).alias("text"))
        if depth:
            below = rows.select("tenant", F.slice("path", 1, depth - 1).alias("up") if depth > 1 else F.array().cast("array<int>").alias("up"), F.element_at("path", -1).alias("at"), F.lit(0).cast(dict(fresh.dtypes)["seq"]).alias("seq"), F.lit("").alias("id"), "text")
    return charts.select("tenant", "chart").join(rows.select("tenant", F.col("text").alias("_new")), "tenant", "left").select("tenant", F.coalesce("_new", "chart").alias("chart"))
