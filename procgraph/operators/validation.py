"""A whole process model put in order: ids, types, flows, start and end, connections, gateways and their conditions.

Elements are rows of one form, nodes and sequences alike, in the order of seq; what comes out has the same form, so the
operator can be applied to its own result, which changes nothing. Afterwards ids are unique in a process, every node can be
reached from a start event and leads to an end event, and every gateway has at least two flows out of it.

Defined results: rows without a process are left out, all other nulls are empty texts (but a null name of an activity, which
gets one); equal places go by the other columns; a process named in ``processes`` that has no elements becomes start, end and
a flow. Repeated ids get numbers that no other id of the process has; what refers to them means the last. A sequence whose
ends are blank gets its neighbours; one with an unknown end, or that ends where it starts, goes. A flow that is there twice
stays so. A process is sorted in one task, so it has to fit there; processes are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procgraph.functions.text import or_else, snake_id, strip
from procgraph.operators.graph import checkpointed, first_by
from procgraph.operators.model import element_type

COLUMNS = ["process_id", "seq", "kind", "id", "type", "name", "source", "target", "condition"]
#: Kinds of elements, and names of what is put in (fixed values).
KINDS = ("Event", "Sequence", "Activity", "Gateway")
START_NAME, END_NAME, ACTIVITY_NAME, CONDITION = "프로세스 시작", "프로세스 종료", "활동", "조건"
_EXPLICIT, _POINTER, _CHAIN, _JOINED, _MOVED = range(5)


def _kinds(elements: DataFrame) -> DataFrame:
    """Rows with kinds and types as they should be, and pos: their place from 1."""
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("id", "type", "source", "target", "condition")]
    e = elements.where("process_id IS NOT NULL").select("process_id", "seq", F.coalesce("kind", F.lit("")).alias("kind"), "name", *blank)
    said = F.lower(strip("kind"))
    e = e.withColumn("kind", F.coalesce(*[F.when(said == k.lower(), F.lit(k)) for k in KINDS], F.col("kind")))
    e = e.withColumn("type", element_type("kind", "type"))
    place = W.partitionBy("process_id").orderBy(F.col("seq").asc_nulls_last(), *[c for c in COLUMNS if c not in ("process_id", "seq")])
    return e.withColumn("pos", F.row_number().over(place))


def _with_ends(e: DataFrame, processes: DataFrame | None) -> DataFrame:
    """Rows with part: 0 for a start event put in, 1 for what was there, 2 for an end event put in."""
    has = lambda t: F.coalesce(F.max((F.col("kind") == "Event") & (F.col("type") == t)), F.lit(False))
    have = e.groupBy("process_id").agg(has("StartEvent").alias("start"), has("EndEvent").alias("end"))
    if processes is not None:
        have = processes.select("process_id").where("process_id IS NOT NULL").distinct().join(have, "process_id", "full").fillna(False, ["start", "end"])
    put = lambda which, part, i, t, name: have.where(~F.col(which)).select("process_id", F.lit("Event").alias("kind"), F.lit(i).alias("id"), F.lit(t).alias("type"), F.lit(name).alias("name"), *[F.lit("").alias(c) for c in ("source", "target", "condition")], F.lit(0).alias("pos"), F.lit(part).alias("part"))
    return e.drop("seq").withColumn("part", F.lit(1)).unionByName(put("start", 0, "start_event", "StartEvent", START_NAME)).unionByName(put("end", 2, "end_event", "EndEvent", END_NAME))


def _numbered(e: DataFrame) -> DataFrame:
    """Rows with node, old (the id as written) and new (of nodes: unique in the process).

    Copies of an id are numbered from above the largest number behind the same stem, so a number never meets another id.
    """
    word = F.when(F.col("kind").isin("Event", "Gateway"), F.lower("kind")).otherwise(F.lit("activity"))
    numbered = lambda word: F.concat(word, F.lit("_"), F.col("pos").cast("string"))
    e = e.withColumn("node", F.col("kind") != "Sequence").withColumn("old", or_else(strip("id"), numbered(word)))
    e = e.withColumn("base", or_else(snake_id("old"), numbered(F.lit("node"))))
    e = e.withColumn("k", F.row_number().over(W.partitionBy("process_id", "node", "base").orderBy(F.col("part") != 1, "part", "pos")))
    tail = F.regexp_extract("base", "_([0-9]{1,9})$", 1)
    used = e.where(F.col("node") & (tail != "")).groupBy("process_id", F.regexp_replace("base", "_[0-9]{1,9}$", "").alias("base")).agg(F.max(tail.cast("long")).alias("most"))
    copy = F.concat_ws("_", "base", (F.greatest(F.coalesce("most", F.lit(1)), F.lit(1)) + F.col("k") - 1).cast("string"))
    e = e.join(used, ["process_id", "base"], "left")
    return e.withColumn("new", F.when(F.col("node"), F.when(F.col("k") == 1, F.col("base")).otherwise(copy))).drop("base", "k", "most")


def _resolved(e: DataFrame) -> DataFrame:
    """Rows whose source and target are ids of nodes, or null where they name none; blank ones stay blank."""
    names = first_by(e.where("node AND part = 1").select("process_id", "old", "new", "pos"), ["process_id", "old"], F.desc("pos")).select("process_id", "old", "new")
    ids = e.where("node").select("process_id", "new")
    for side in ("source", "target"):
        e = e.withColumn(side, strip(side))
        e = e.join(names.select("process_id", F.col("old").alias(side), F.col("new").alias("_said")), ["process_id", side], "left")
        e = e.withColumn("_id", F.coalesce("_said", snake_id(side)))
        e = e.join(ids.select("process_id", F.col("new").alias("_id"), F.lit(True).alias("_known")), ["process_id", "_id"], "left")
        e = e.withColumn(side, F.when(F.col(side) == "", F.lit("")).when(F.col("_known"), F.col("_id"))).drop("_said", "_id", "_known")
    return e


def _once(flows: DataFrame) -> DataFrame:
    """Flows that were written, and of those that were made one for each pair that has none yet."""
    n = F.row_number().over(W.partitionBy("process_id", "src", "dst").orderBy("k", "n", "m"))
    return flows.withColumn("_n", n).where(f"k = {_EXPLICIT} OR _n = 1").drop("_n")


def _made(df: DataFrame, src: Column, dst: Column, k: int, n: Column, m: Column | None = None) -> DataFrame:
    """Flows without a name or condition; n and m give their order among those of one k."""
    f = df.select("process_id", src.alias("src"), dst.alias("dst"), F.lit(k).alias("k"), n.cast("long").alias("n"), (F.lit(0) if m is None else m).cast("long").alias("m"), F.lit("").alias("name"), F.lit("").alias("condition"))
    return f.where("src <> dst").withColumn("id", F.concat_ws("_", F.lit("seq"), "src", "dst"))


def _flows(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flows as written, those that nodes point to, one between neighbours, and those that join what is before a start or after an end."""
    order = W.partitionBy("process_id").orderBy("part", "pos")
    there = F.when(F.col("node") & (F.col("part") == 1), F.col("new"))
    before, after = F.last(there, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.first(there, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    filled = lambda side, other: F.when(F.col(side) == "", other).otherwise(F.col(side))
    said = e.select("*", before.alias("_b"), after.alias("_a")).where("NOT node").select("process_id", filled("source", F.col("_b")).alias("src"), filled("target", F.col("_a")).alias("dst"), F.lit(_EXPLICIT).alias("k"), F.col("pos").cast("long").alias("n"), F.lit(0).cast("long").alias("m"), F.coalesce("name", F.lit("")).alias("name"), "condition", or_else(snake_id("id"), "").alias("id")).where("src <> dst")
    said = said.withColumn("id", or_else("id", F.concat_ws("_", F.lit("seq"), "src", "dst")))
    pointed = _made(e.where("node AND source <> ''"), F.col("source"), F.col("new"), _POINTER, F.col("pos"))
    chain = _made(nodes.withColumn("next", F.lead("new").over(W.partitionBy("process_id").orderBy("o"))).where("next IS NOT NULL"), F.col("new"), F.col("next"), _CHAIN, F.col("o"))
    at = F.struct("o", "new", "type")
    of = lambda agg, t: agg(F.when((F.col("kind") == "Event") & (F.col("type") == t), at))
    ends = nodes.groupBy("process_id").agg(F.min(at).alias("first"), F.max(at).alias("last"), of(F.min, "StartEvent").alias("start"), of(F.max, "EndEvent").alias("end"))
    joined = _made(ends, F.col("start.new"), F.col("first.new"), _JOINED, F.lit(0)).unionByName(_made(ends, F.col("last.new"), F.col("end.new"), _JOINED, F.lit(1)))
    return _once(said.unionByName(pointed).unionByName(chain).unionByName(joined))


def _collapsed(nodes: DataFrame, flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the gateways that fewer than two flows lead out of, over any number of rounds.

    Such a gateway leads to the next node in order, or to the last end event if it is the last: neighbours have a flow. So
    what led to it, over others of its kind, too, leads to the next node that stays.
    """
    while True:
        out = flows.groupBy("process_id", F.col("src").alias("new")).agg(F.count(F.lit(1)).alias("outs"))
        marked = nodes.join(out, ["process_id", "new"], "left")
        marked = checkpointed(marked.withColumn("weak", (F.col("kind") == "Gateway") & (F.coalesce("outs", F.lit(0)) < 2)).drop("outs"))
        weak = marked.where("weak")
        if weak.isEmpty():
            return nodes, flows
        rest = W.partitionBy("process_id").orderBy("o").rowsBetween(W.currentRow, W.unboundedFollowing)
        every = W.partitionBy("process_id")
        at = F.struct("o", "new")
        end = F.max(F.when((F.col("kind") == "Event") & (F.col("type") == "EndEvent"), at)).over(every)
        to = F.coalesce(F.first(F.when(~F.col("weak"), at), ignorenulls=True).over(rest), end)
        led = marked.select("process_id", "new", "o", "weak", to.alias("to")).where("weak")
        kept = flows.join(weak.select("process_id", F.col("new").alias("src")), ["process_id", "src"], "left_anti")
        kept = kept.join(led.select("process_id", F.col("new").alias("dst"), "to"), ["process_id", "dst"], "left")
        stay = kept.where("to IS NULL").select(flows.columns)
        moved = kept.where("to IS NOT NULL").join(marked.select("process_id", F.col("new").alias("src"), F.col("o").alias("_o")), ["process_id", "src"])
        moved = _made(moved, F.col("src"), F.col("to.new"), _MOVED, F.col("_o"), F.col("to.o"))
        flows = checkpointed(_once(stay.unionByName(moved.select(flows.columns))))
        nodes = marked.where("NOT weak").drop("weak")


def validated(elements: DataFrame, processes: DataFrame | None = None) -> DataFrame:
    """The elements put in order: nodes first, then flows. elements: COLUMNS, more are ignored; processes: process_id."""
    e = checkpointed(_resolved(_numbered(_with_ends(_kinds(elements), processes))))
    nodes = e.where("node").withColumn("o", F.row_number().over(W.partitionBy("process_id").orderBy("part", "pos")))
    nodes = nodes.select("process_id", "new", "o", "kind", "type", "name", "source", "pos")
    nodes, flows = _collapsed(nodes, checkpointed(_flows(e, nodes)))

    out = W.partitionBy("process_id", "src")
    gates = nodes.where("kind = 'Gateway'").select("process_id", F.col("new").alias("src"), F.lit(True).alias("gate"))
    flows = flows.join(gates, ["process_id", "src"], "left").withColumn("j", F.row_number().over(out.orderBy("k", "n", "m", "id")))
    blank = F.col("gate") & (strip("condition") == "")
    condition = F.when(blank, F.concat_ws(" ", F.lit(CONDITION), F.col("j").cast("string"))).otherwise(F.col("condition"))

    alive = nodes.select("process_id", F.col("new").alias("source"), F.lit(True).alias("_alive"))
    name = F.when(F.col("kind") == "Activity", F.coalesce("name", F.concat_ws(" ", F.lit(ACTIVITY_NAME), F.col("pos").cast("string")))).otherwise(F.coalesce("name", F.lit("")))
    zero = F.lit(0).cast("long")
    n = nodes.join(alive, ["process_id", "source"], "left").select("process_id", F.lit(-1).alias("k"), F.col("o").cast("long").alias("n"), zero.alias("m"), "kind", F.col("new").alias("id"), "type", name.alias("name"), F.when(F.col("_alive"), F.col("source")).otherwise(F.lit("")).alias("source"), F.lit("").alias("target"), F.lit("").alias("condition"))
    f = flows.select("process_id", "k", "n", "m", F.lit("Sequence").alias("kind"), "id", F.lit("").alias("type"), "name", F.col("src").alias("source"), F.col("dst").alias("target"), condition.alias("condition"))
    seq = F.row_number().over(W.partitionBy("process_id").orderBy("k", "n", "m", "id")).cast("long")
    return n.unionByName(f).withColumn("seq", seq).select(COLUMNS)
