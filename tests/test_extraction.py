"""The fold over sections against a plain loop over dictionaries."""

import json
import random

from procgraph.operators import extraction


def loop(payloads):
    """nodes (label, id, process_id, name, kind), edges and flows, section by section with dictionaries of names."""
    nodes, edges, flows = set(), [], []
    maps = {}
    for doc, no, section, text in sorted(payloads, key=lambda p: (p[0], p[1])):
        procs, roles = maps.setdefault(doc, ({}, {}))
        try:
            x = json.loads(text)
        except ValueError:
            x = {}
        get = lambda k, x=x: [r for r in (x.get(k) or []) if r is not None]
        key = lambda v: (v or "").lower()
        made = lambda kind, i, doc=doc, no=no: f"{kind}:{doc}:{no}:{i}"
        new = []
        for i, p in enumerate(get("processes")):
            name = p.get("name") if p.get("name") is not None else "Unknown Process"
            procs[name.lower()] = made("process", i)
            new.append(("Process", made("process", i), made("process", i), name, ""))
        first = made("process", 0) if get("processes") else ""
        for i, r in enumerate(get("roles")):
            name = r.get("name") if r.get("name") is not None else "Unknown Role"
            if name.lower() not in roles:
                roles[name.lower()] = made("role", i)
                new.append(("Role", made("role", i), "", name, ""))
        tasks = []
        for i, t in enumerate(get("tasks")):
            try:
                order = int(float(t.get("order")))
            except (TypeError, ValueError):
                order = i
            pid = (procs.get(key(t.get("parent_process"))) if key(t.get("parent_process")) else None) or first
            kind = key(t.get("task_type")) if key(t.get("task_type")) in ("agent", "system") else "human"
            role = roles.get(key(t.get("performer_role"))) if key(t.get("performer_role")) else None
            tasks.append({"id": made("task", i), "name": t["name"] if t.get("name") is not None else f"Task {i + 1}", "p": pid, "r": role, "o": order, "k": kind, "next": key(t.get("next_task"))})
        for kind, known, field, to in (("task_role_mappings", roles, "role_name", "r"), ("task_process_mappings", procs, "process_name", "p")):
            for m in get(kind):
                for t in tasks:
                    if key(m.get("task_name")) in t["name"].lower() and key(m.get(field)) in known:
                        t[to] = known[key(m.get(field))]
                        break
        new += [("Task", t["id"], t["p"], t["name"], t["k"]) for t in tasks]
        gates = get("gateways")
        new += [("Gateway", made("gateway", i), procs.get(key(g.get("parent_process"))) or first, "", key(g.get("gateway_type")) if key(g.get("gateway_type")) in ("parallel", "inclusive") else "exclusive") for i, g in enumerate(gates)]
        for i, d in enumerate(get("decisions")):
            new.append(("DMNDecision", made("decision", i), "", d["name"] if d.get("name") is not None else "Decision", ""))
            if key(d.get("related_role")) and key(d.get("related_role")) in roles:
                edges.append(("MAKES_DECISION", roles[key(d.get("related_role"))], made("decision", i)))
        here = []

        def end(name, tasks=tasks, gates=gates, made=made):
            for t in tasks:
                if name and (name in t["name"].lower() or t["name"].lower() in name):
                    return t["id"], "task"
            return (made("gateway", len(gates) - 1), "gateway") if name and gates else None

        for f in get("sequence_flows"):
            a, b = end(key(f.get("from_task"))), end(key(f.get("to_task")))
            if a and b:
                here.append((*a, *b, (f.get("condition") or "").strip(), 0))
        for t in tasks:
            if t["next"]:
                hit = next((o for o in tasks if t["next"] in o["name"].lower()), None)
                if hit:
                    here.append((t["id"], "task", hit["id"], "task", "", 1))
        have = {(f[0], f[2]) for f in here}
        for p in dict.fromkeys(t["p"] for t in tasks):
            line = sorted((t for t in tasks if t["p"] == p), key=lambda t: t["o"])
            here += [(a["id"], "task", b["id"], "task", "", 2) for a, b in zip(line, line[1:], strict=False) if (a["id"], b["id"]) not in have]
        flows += here
        nodes |= set(new)
        edges += [("HAS_TASK", t["p"], t["id"]) for t in tasks if t["p"]] + [("PERFORMED_BY", t["id"], t["r"]) for t in tasks if t["r"]]
        edges += [("SUPPORTED_BY", n[1], section) for n in new if section]
    return nodes, edges, flows


def random_payload(rng):
    names, roles, procs = ["check", "Check stock", "ship", "", "Pack it", None], ["Clerk", "clerk", "Boss", None, ""], ["Buy", "Sell", "buy", None]
    some = lambda f, most=4: [f() for _ in range(rng.randint(0, most))]
    pick = rng.choice
    task = lambda: {k: v for k, v in {"name": pick(names), "task_type": pick(["AGENT", "x", None]), "performer_role": pick(roles), "parent_process": pick(procs), "order": pick([1, 2, 2.7, "3", "x", None]), "next_task": pick(names)}.items() if rng.random() < 0.9}
    x = {
        "processes": some(lambda: {"name": pick(procs), "description": "d"}, 2),
        "roles": some(lambda: {"name": pick(roles)}, 3),
        "tasks": some(task),
        "gateways": some(lambda: {"gateway_type": pick(["Parallel", "?", None]), "parent_process": pick(procs)}, 2),
        "decisions": some(lambda: {"name": pick(["a", None]), "related_role": pick(roles)}, 2),
        "task_role_mappings": some(lambda: {"task_name": pick(names), "role_name": pick(roles)}, 3),
        "task_process_mappings": some(lambda: {"task_name": pick(names), "process_name": pick(procs)}, 3),
        "sequence_flows": some(lambda: {"from_task": pick([*names, "gate"]), "to_task": pick([*names, "gate"]), "condition": pick([" if ", None])}),
    }
    return json.dumps({k: v for k, v in x.items() if rng.random() < 0.85})


def check(spark, rows, parts):
    df = spark.createDataFrame(rows, "doc_id string, section_no int, section_id string, payload string").repartition(parts)
    got = extraction.extracted(df)
    nodes, edges, flows = loop(rows)
    keep = ("Process", "Role", "Task", "Gateway", "DMNDecision")
    assert {tuple(r) for r in got.nodes.where(f"label IN {keep}").select("label", "id", "process_id", "name", "kind").collect()} == nodes
    assert sorted(map(tuple, got.edges.select("rel", "src", "dst").collect())) == sorted(edges)
    assert sorted(map(tuple, got.flows.select("src", "src_type", "dst", "dst_type", "condition", "source").collect())) == sorted(flows)


def test_against_a_plain_fold(spark):
    rng = random.Random(7)
    rows = [(f"d{d}", s, pick, random_payload(rng)) for d in range(12) for s, pick in enumerate(rng.choice(["s", ""]) for _ in range(rng.randint(1, 8)))]
    rows += [("e", 0, "s", "no json"), ("e", 1, "s", None or "{}"), ("f", 0, "s", '{"tasks":[{}]}')]
    check(spark, rows, 3)
    check(spark, rows[::-1], 1)


def test_empty(spark):
    got = extraction.extracted(spark.createDataFrame([], "doc_id string, section_no int, section_id string, payload string"))
    assert got.nodes.count() == got.edges.count() == got.flows.count() == 0
