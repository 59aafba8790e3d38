"""Definitions from models against a loop over dictionaries; odd models; strict and lenient."""

import json
import random

import pytest

from procgraph.operators import runtime


def text(v):
    return "" if v is None else v if isinstance(v, str) else json.dumps(v)


def loop(model, strict):
    """What a model becomes, element by element."""
    pid = text(model.get("processDefinitionId"))
    out = {k: [] for k in ("activities", "events", "gateways", "sequences")}
    for e in model["elements"] if isinstance(model.get("elements"), list) else []:
        kind = text(e.get("elementType")).strip().lower() if isinstance(e, dict) else ""
        if kind == "activity":
            d = e.get("duration")
            tool = text(e.get("tool"))
            safe = lambda x: "_".join(p for p in "".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split())
            out["activities"].append((e.get("id"), text(e.get("name")), text(e.get("role")), tool if tool.strip() else f"formHandler:{safe(pid or 'process')}_{safe(str(e.get('id')))}_form", int(d) if str(d or "").isdigit() else 5))
        elif kind == "event":
            out["events"].append((e.get("id"), {"StartEvent": "startEvent", "EndEvent": "endEvent"}.get(text(e.get("type")).strip(), "intermediateCatchEvent"), text(e.get("role"))))
        elif kind == "gateway":
            t = text(e.get("type")).strip()
            low = t.lower().replace("_", "") if t.lower().count("_") < 2 else ""
            out["gateways"].append((e.get("id"), {"exclusivegateway": "exclusiveGateway", "parallelgateway": "parallelGateway", "inclusivegateway": "inclusiveGateway"}.get(low, t or "exclusiveGateway")))
        elif kind == "sequence":
            out["sequences"].append((e.get("id"), e.get("source"), e.get("target"), text(e.get("condition")) or text(e.get("name"))))
    roles = [r["name"] for r in model.get("roles") or []]
    if not strict:
        roles = roles or list(dict.fromkeys(a[2].strip() for a in out["activities"] if a[2].strip())) or ["사용자"]
        out["activities"] = [(*a[:2], a[2] if a[2].strip() else roles[0], *a[3:]) for a in out["activities"]]
        if not any(t == "startEvent" for _, t, _ in out["events"]):
            out["events"].insert(0, ("Event_Start", "startEvent", roles[0]))
        if not any(t == "endEvent" for _, t, _ in out["events"]):
            out["events"].append(("Event_End", "endEvent", roles[0]))
    return out | {"roles": roles}


def models(rng, n):
    out = {}
    for k in range(n):
        items = []
        for i in range(rng.randrange(9)):
            kind = rng.choice(["Activity", "activity ", "Event", "Gateway", "Sequence", "Data", None])
            e = {"elementType": kind, "id": rng.choice([f"E{i}", f"e-{i} x", None]), "name": rng.choice(["check", "", None, "ü"]), "role": rng.choice(["Sales", " ", None, "Buyer"])}
            e |= {"type": rng.choice(["StartEvent", "EndEvent", "Timer", "Parallel_Gateway", "INCLUSIVEGATEWAY", "Complex", "", None]), "duration": rng.choice([3, "7", 0, "0", "x", None, True, 2.5]), "tool": rng.choice(["formHandler:a", "", " ", None])}
            e |= {"source": rng.choice(["E0", None]), "target": "E1", "condition": rng.choice(["yes", "", None]), "inputData": rng.choice([["a", "b"], [], "no list", None])}
            items.append(rng.choice([e, e, e, e, e, "odd", None, 3]))
        out[f"p{k}"] = {"processDefinitionId": rng.choice([f"Proc {k}", None]), "processDefinitionName": rng.choice(["Name", "", None]), "roles": rng.choice([None, [], [{"name": "Boss", "more": 1}]]), "elements": rng.choice([items, items, items, None])}
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_definitions(spark, strict):
    given = models(random.Random(3), 80)
    df = spark.createDataFrame([(p, json.dumps(m)) for p, m in given.items()] + [("bad", "{"), ("null", None), ("list", "[1]")], "process_id string, model string")
    got = {r["process_id"]: json.loads(r["definition"]) for r in runtime.definitions(runtime.runtime(df, strict)).collect()}
    assert set(got) == {*given, "bad", "null", "list"} and got["bad"]["activities"] == [] and got["null"]["processDefinitionName"] == "프로세스"
    for p, m in given.items():
        d = got[p]
        mine = {"activities": [(a["id"], a["name"], a["role"], a["tool"], a["duration"]) for a in d["activities"]], "events": [(e["id"], e["type"], e["role"]) for e in d["events"]], "gateways": [(g["id"], g["type"]) for g in d["gateways"]], "sequences": [(s["id"], s["source"], s["target"], s["condition"]) for s in d["sequences"]], "roles": [r["name"] for r in d["roles"]]}
        assert mine == loop(m, strict), p
        assert len(d["participants"]) == (0 if strict else 1) and all(a["inputData"] in ([], ["a", "b"]) for a in d["activities"])


def test_rejected(spark):
    items = ["odd", None, {"elementType": "Data", "id": "d"}, {"elementType": "Event"}]
    df = spark.createDataFrame([("p", json.dumps({"elements": items})), ("bad", "{")], "process_id string, model string")
    got = [(r["seq"], r["reason"], json.loads(r["element"])) for r in runtime.rejected(df).orderBy("seq").collect()]
    assert got == [(0, "no object", "odd"), (1, "no object", None), (2, "unknown kind", items[2])]


def test_activities_updated(spark):
    model = {"processDefinitionId": "P", "elements": [{"elementType": "Activity", "id": "a", "name": "old", "role": "r"}, {"elementType": "Activity", "id": "b", "name": "b", "inputData": ["x"]}, {"elementType": "Event", "id": "c"}, {"elementType": "Activity", "name": "no id"}]}
    changed = {"processDefinitionId": "P", "elements": [{"elementType": "activity", "id": "a", "name": "first"}, {"elementType": "activity", "id": "a", "name": "", "role": "s", "outputData": ["y"]}]}
    frame = lambda m: spark.createDataFrame([("p", json.dumps(m))], "process_id string, model string")
    got = runtime.activities_updated(frame(model), runtime.runtime(frame(changed))).orderBy("seq").collect()
    assert [(r["id"], r["name"], r["role"], r["inputData"], r["outputData"], r["tool"]) for r in got] == [("a", "old", "s", [], ["y"], "formHandler:p_a_form"), ("b", "b", "", ["x"], [], ""), (None, "no id", "", [], [], "")]
