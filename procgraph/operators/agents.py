"""New agents, unless one that is there, or was put in just before, does already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions.text import or_else, strip, text_key
from procgraph.operators.graph import checkpointed
from procgraph.operators.resolve import containing

#: Name of an agent without one (fixed value).
NAMELESS = "자동생성 에이전트"
#: Characters that the longer of two names must have if one only contains the other.
LEAST = 4


def _related(asked: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """k, o: keys of proposals and of any agent that are the same, or one contains the other."""
    k = asked.select(F.col(key).alias("k")).where("k <> ''").distinct()
    o = every.select(F.col(key).alias("o")).where("o <> ''").distinct()
    hits = containing(k, o, "k", "o").select("k", "o").unionByName(containing(o, k, "o", "k").select("k", "o")).distinct()
    return checkpointed(hits.where((F.col("k") == F.col("o")) | (F.greatest(F.length("k"), F.length("o")) >= LEAST)))


def _first_related(links: DataFrame, agents: DataFrame, key: str, *values: Column) -> DataFrame:
    """For each key of proposals the least of some values among the agents whose keys are related to it."""
    names = [f"_{key}{i}" for i in range(len(values))]
    of = agents.where(F.col(key) != "").groupBy(F.col(key).alias("o")).agg(*[F.min(v).alias(n) for v, n in zip(values, names)])
    return links.join(of, "o").groupBy(F.col("k").alias(key)).agg(*[F.min(n).alias(n) for n in names])


def insert_agents(agents: DataFrame, proposals: DataFrame) -> DataFrame:
    """id, user_id, inserted: for each proposal the agent that does for it, in the order of seq (then id).

    That is the first one, of those that are there by seq and then of those put in, whose name or role is the same, or
    contains the other and the longer has four characters. Otherwise the proposal is put in, under its own id. Names are
    compared in lower case without white space; empty ones only count as different. Proposals with the same keys share a
    fate. Undecided ones are decided a round at a time: who has no earlier one to wait for is put in, who is related to one
    put in isn't; a long chain of names, each related to the next only, takes as many rounds as half its length.
    agents: user_id (text), username, role, seq. proposals: id (text), username, role, seq. Both keys of order occur once.
    """
    no = lambda c: text_key(F.coalesce(c, F.lit("")))
    there = agents.select("user_id", no(F.col("username")).alias("name"), no(F.col("role")).alias("job"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("user_id").alias("id")).alias("ord"))
    asked = proposals.select("id", no(or_else(strip("username"), NAMELESS)).alias("name"), no(F.col("role")).alias("job"), F.struct(F.col("seq").cast("long").alias("seq"), "id").alias("ord"))
    asked, keys = checkpointed(asked), ["name", "job"]
    classes = checkpointed(asked.groupBy(*keys).agg(F.min("ord").alias("ord")))
    every = there.select(*keys).unionByName(classes.select(*keys))
    links = {c: _related(classes, every, c) for c in keys}

    def found(rows: DataFrame, among: DataFrame, *values: Column) -> DataFrame:
        """rows with m0, m1, ...: the least value among the related ones."""
        for c in keys:
            rows = rows.join(_first_related(links[c], among, c, *values), c, "left")
        both = [F.least(*[F.col(f"_{c}{i}") for c in keys]).alias(f"m{i}") for i in range(len(values))]
        return rows.select(*keys, "ord", *both)

    known = checkpointed(found(classes, there, F.col("ord")))
    todo = checkpointed(known.where("m0 IS NULL").select(*keys, "ord", F.lit(False).alias("put")))
    put = todo.where("false")
    while not todo.isEmpty():
        among = todo.unionByName(put)
        state = found(todo, among, F.col("ord"), F.when(F.col("put"), F.col("ord")))
        state = checkpointed(state.select(*keys, "ord", (F.coalesce(F.col("m0") >= F.col("ord"), F.lit(True))).alias("put"), F.coalesce(F.col("m1") < F.col("ord"), F.lit(False)).alias("gone")))
        put = checkpointed(put.unionByName(state.where("put").select(*keys, "ord", "put")))
        todo = checkpointed(state.where("NOT put AND NOT gone").select(*keys, "ord", "put"))
    later = found(known.where("m0 IS NULL").select(*keys, "ord"), put, F.col("ord")).withColumn("m0", F.coalesce("m0", "ord"))
    fate = known.where("m0 IS NOT NULL").select(*keys, "m0").unionByName(later.select(*keys, "m0"))
    done = asked.join(fate, keys).join(put.select(*keys, F.col("ord").alias("own")), keys, "left")
    return done.select("id", F.col("m0.id").alias("user_id"), F.coalesce(F.col("own") == F.col("ord"), F.lit(False)).alias("inserted"))
