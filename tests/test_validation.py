"""Validation of whole models against a plain loop over lists, and what it promises of every model."""

import random
import re

import pytest

from procgraph.operators.validation import COLUMNS, validated

SCHEMA = "process_id string, seq long, kind string, id string, type string, name string, source string, target string, condition string"


def snake(x):
    return re.sub("^_|_$", "", re.sub("_+", "_", re.sub("[^a-z0-9_]+", "_", x.lower())))


def plain(rows):
    """The elements of one process put in order, element by element."""
    rows = [dict(zip(COLUMNS, r, strict=True)) for r in rows]
    for pos, r in enumerate(rows, 1):
        r |= {c: (r[c] or "").strip() for c in ("kind", "id", "type", "source", "target")} | {"pos": pos, "old_condition": r["condition"] or ""}
        r["kind"] = {"event": "Event", "sequence": "Sequence", "activity": "Activity", "gateway": "Gateway"}.get(r["kind"].lower(), r["kind"])
        low = r["type"].lower()
        if r["kind"] == "Event":
            r["type"] = {"start": "StartEvent", "startevent": "StartEvent", "end": "EndEvent", "endevent": "EndEvent"}.get(low, r["type"] if r["type"][:1].isupper() else "IntermediateCatchEvent")
        elif r["kind"] == "Gateway":
            r["type"] = {"parallelgateway": "ParallelGateway"}.get(low, r["type"] or "ExclusiveGateway")
        elif r["kind"] == "Activity":
            r["type"] = "UserActivity"
    new, words = [], {"Event": "event", "Gateway": "gateway"}
    nodes = [r for r in rows if r["kind"] != "Sequence"]
    for r in nodes:
        r["old"] = r["id"] or f"{words.get(r['kind'], 'activity')}_{r['pos']}"
        r["base"] = snake(r["old"]) or f"node_{r['pos']}"
    event = lambda i, t, name: {"kind": "Event", "base": i, "type": t, "name": name, "source": "", "old": None, "pos": 0}
    first = [] if any((r["kind"], r["type"]) == ("Event", "StartEvent") for r in nodes) else [event("start_event", "StartEvent", "프로세스 시작")]
    last = [] if any((r["kind"], r["type"]) == ("Event", "EndEvent") for r in nodes) else [event("end_event", "EndEvent", "프로세스 종료")]
    every = nodes + first + last
    most = {}
    for r in every:
        if m := re.fullmatch("(.*)_([0-9]{1,9})", r["base"]):
            most[m[1]] = max(most.get(m[1], 1), int(m[2]))
    for r in every:
        k = sum(1 for b in new if b == r["base"])
        new.append(r["base"])
        r["new"] = r["base"] if not k else f"{r['base']}_{most.get(r['base'], 1) + k}"
    ids, said = {r["new"] for r in every}, {r["old"]: r["new"] for r in nodes}

    def ref(x):
        y = said.get(x, snake(x))
        return "" if x == "" else y if y in ids else None

    flows = []
    for i, r in enumerate(rows):
        if r["kind"] != "Sequence":
            continue
        s, t = ref(r["source"]), ref(r["target"])
        s = next((q["new"] for q in reversed(rows[:i]) if q["kind"] != "Sequence"), None) if s == "" else s
        t = next((q["new"] for q in rows[i + 1 :] if q["kind"] != "Sequence"), None) if t == "" else t
        if s and t and s != t:
            flows.append({"id": snake(r["id"]) or f"seq_{s}_{t}", "name": r["name"] or "", "s": s, "t": t, "c": r["old_condition"]})

    def add(s, t):
        if s != t and not any((f["s"], f["t"]) == (s, t) for f in flows):
            flows.append({"id": f"seq_{s}_{t}", "name": "", "s": s, "t": t, "c": ""})

    for r in nodes:
        r["source"] = ref(r["source"])
        if r["source"]:
            add(r["source"], r["new"])
    order = first + nodes + last
    for a, b in zip(order, order[1:], strict=False):
        add(a["new"], b["new"])
    start = next(r["new"] for r in order if (r["kind"], r["type"]) == ("Event", "StartEvent"))
    end = [r["new"] for r in order if (r["kind"], r["type"]) == ("Event", "EndEvent")][-1]
    add(start, order[0]["new"])
    add(order[-1]["new"], end)
    place = {r["new"]: i for i, r in enumerate(order)}
    while weak := {r["new"] for r in order if r["kind"] == "Gateway" and sum(f["s"] == r["new"] for f in flows) < 2}:
        to, stop = {}, end
        for r in reversed(order):
            if r["new"] in weak:
                to[r["new"]] = stop
            else:
                stop = r["new"]
        moved = sorted({(place[f["s"]], place[to[f["t"]]], f["s"], to[f["t"]]) for f in flows if f["t"] in weak and f["s"] not in weak})
        flows = [f for f in flows if f["s"] not in weak and f["t"] not in weak]
        old = [f for f in flows if not f.get("moved")]
        again = sorted({(*f["moved"], f["s"], f["t"]) for f in flows if f.get("moved")} | set(moved))
        flows = old
        for a, b, s, t in again:
            n = len(flows)
            add(s, t)
            if len(flows) > n:
                flows[-1]["moved"] = (a, b)
        order = [r for r in order if r["new"] not in weak]
    stay = {r["new"] for r in order}
    for r in order:
        outs = [f for f in flows if f["s"] == r["new"]]
        for j, f in enumerate(outs, 1):
            if r["kind"] == "Gateway" and not f["c"].strip():
                f["c"] = f"조건 {j}"
    name = lambda r: r["name"] if r["name"] is not None else f"활동 {r['pos']}" if r["kind"] == "Activity" else ""
    out = [(r["kind"], r["new"], r["type"], name(r), r["source"] if r["source"] in stay else "", "", "") for r in order]
    return out + [("Sequence", f["id"], "", f["name"], f["s"], f["t"], f["c"]) for f in flows]


def models(n=250, seed=3):
    """Random models: odd ids, repeated ids, ids with numbers, unknown and blank ends, chains of gateways, ends in the middle."""
    rng, out = random.Random(seed), []
    ids = ["a", "A", " a ", "a_2", "a_3", "b", "b c", "b-c", "", None, "한글", "start_event", "end_event", "end_event_2", "g", "g_1", "x_0000000007"]
    for p in range(n):
        # the models differ in how many gateways and sequences they have
        kinds = rng.choices(["activity", "Activity", "GATEWAY", "gateway", " sequence", "Sequence", "event", "Thing"], k=rng.randint(1, 14))
        for i, kind in enumerate(kinds):
            t = rng.choice(["start", "END", "Timer", "odd", "", None, "EndEvent", "parallelGateway"])
            out.append((f"p{p:03}", i if rng.random() < 0.97 else None, kind, rng.choice(ids), t, rng.choice(["n", "", None]), rng.choice([*ids, "", "", ""]), rng.choice([*ids, "", "", ""]), rng.choice(["", None, "c", " "])))
    return out


def by_process(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["process_id"], r["seq"])):
        got.setdefault(r["process_id"], []).append(tuple(r)[2:])
    return got


@pytest.fixture(scope="module")
def done(spark):
    rows = models()
    return rows, validated(spark.createDataFrame(rows, SCHEMA)).cache()


def test_same_as_loop(done):
    rows, df = done
    got, blank = by_process(df.collect()), lambda v: (v is not None, v or "")
    for p in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == p]
        # equal places go by the other columns, those that are null in the middle only first
        mine.sort(key=lambda r: (r[1] is None, r[1] or 0, *_tie(r)))
        assert got[p] == plain(mine), p


def _tie(r):
    kind = {"event": "Event", "sequence": "Sequence", "activity": "Activity", "gateway": "Gateway"}.get(r[2].strip().lower(), r[2])
    typed = plain_type(kind, (r[4] or "").strip())
    return (kind, r[3] or "", typed, (r[5] is not None, r[5] or ""), r[6] or "", r[7] or "", r[8] or "")


def plain_type(kind, t):
    low = t.lower()
    if kind == "Event":
        return {"start": "StartEvent", "end": "EndEvent", "endevent": "EndEvent"}.get(low, t if t[:1].isupper() else "IntermediateCatchEvent")
    if kind == "Gateway":
        return {"parallelgateway": "ParallelGateway"}.get(low, t or "ExclusiveGateway")
    return "UserActivity" if kind == "Activity" else t


def test_promises(done):
    for elements in by_process(done[1].collect()).values():
        nodes = [r for r in elements if r[0] != "Sequence"]
        ids, pairs = [r[1] for r in nodes], {(r[4], r[5]) for r in elements if r[0] == "Sequence"}
        assert len(set(ids)) == len(ids) and all(a in ids and b in ids and a != b for a, b in pairs)
        kind = {r[1]: (r[0], r[2]) for r in nodes}
        for which, way in (("StartEvent", pairs), ("EndEvent", {(b, a) for a, b in pairs})):
            seen = {i for i in ids if kind[i] == ("Event", which)}
            while more := {b for a, b in way if a in seen} - seen:
                seen |= more
            assert seen == set(ids)
        outs = [r[4] for r in elements if r[0] == "Sequence"]
        assert all(outs.count(i) > 1 for i in ids if kind[i][0] == "Gateway")
        assert all(r[6].strip() for r in elements if r[0] == "Sequence" and kind[r[4]][0] == "Gateway")


def test_twice_is_once(done):
    again = validated(done[1])
    assert by_process(again.collect()) == by_process(done[1].collect())


def test_order_of_rows_and_other_columns(spark, done):
    rows, df = done
    mixed = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).selectExpr("*", "'x' AS base", "1 AS pos", "2 AS o", "true AS node").repartition(7)
    assert by_process(validated(mixed).collect()) == by_process(df.collect())


def test_empty_and_null(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert validated(none).count() == 0
    got = validated(spark.createDataFrame([(None, 1, "Activity", "a", None, None, None, None, None)], SCHEMA), spark.createDataFrame([("p",), (None,), ("p",)], "process_id string"))
    assert by_process(got.collect()) == {"p": [("Event", "start_event", "StartEvent", "프로세스 시작", "", "", ""), ("Event", "end_event", "EndEvent", "프로세스 종료", "", "", ""), ("Sequence", "seq_start_event_end_event", "", "", "start_event", "end_event", "")]}


def test_chain_of_gateways(spark):
    """Gateways that lead to nothing but each other go in several rounds, and nothing is cut off."""
    kinds = [("Activity", "a")] + [("Gateway", f"g{i}") for i in range(6)] + [("Activity", "z")]
    rows = [("p", i, k, n, "", "n", "", "", "") for i, (k, n) in enumerate(kinds)]
    rows += [("p", 20 + i, "Sequence", f"s{i}", "", "", f"g{i}", f"g{i + 2}", "") for i in range(4)]
    got = by_process(validated(spark.createDataFrame(rows, SCHEMA)).collect())["p"]
    assert [r[1] for r in got if r[0] != "Sequence"] == ["start_event", "a", "z", "end_event"]
    assert [(r[4], r[5]) for r in got if r[0] == "Sequence"] == [("start_event", "a"), ("z", "end_event"), ("a", "z")]
