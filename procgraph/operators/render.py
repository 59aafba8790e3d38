"""Artifacts of processes as text columns, and reading process XML back."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procgraph.functions.text import procedure_steps, xml_escape

#: Namespaces of the XML formats (fixed values).
BPMN = "http://www.omg.org/spec/BPMN/20100524/MODEL"
DMN = "https://www.omg.org/spec/DMN/20191111/MODEL/"


def _in_order(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*cols)))


def _lines(rows: Column, line) -> Column:
    return F.array_join(F.transform(rows, line), "")


def bpmn_xml(processes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """proc_id, xml: a process with its lanes, tasks, gateways and flows.

    processes: proc_id, name. nodes: proc_id, id, kind (userTask, exclusiveGateway, startEvent, endEvent), name, role, seq.
    flows: proc_id, src, dst, condition.
    """
    n = nodes.groupBy("proc_id").agg(_in_order("seq", "id", "kind", "name", "role").alias("nodes"))
    f = flows.groupBy("proc_id").agg(_in_order("src", "dst", "condition").alias("flows"))
    body = processes.join(n, "proc_id", "left").join(f, "proc_id", "left")
    roles = F.array_sort(F.array_distinct(F.filter(F.transform("nodes", lambda x: x["role"]), lambda r: r.isNotNull() & (r != ""))))
    member = lambda r: _lines(F.filter("nodes", lambda x: x["role"] == r), lambda x: F.concat(F.lit("<flowNodeRef>"), xml_escape(x["id"]), F.lit("</flowNodeRef>")))
    lanes = F.array_join(F.transform(roles, lambda r, i: F.concat(F.lit('<lane id="Lane_'), i.cast("string"), F.lit('" name="'), xml_escape(r), F.lit('">'), member(r), F.lit("</lane>"))), "")
    node = lambda x: F.concat(F.lit("<"), x["kind"], F.lit(' id="'), xml_escape(x["id"]), F.lit('" name="'), xml_escape(x["name"]), F.lit('"/>'))
    flow = lambda x: F.concat(F.lit('<sequenceFlow id="Flow_'), xml_escape(x["src"]), F.lit("_"), xml_escape(x["dst"]), F.lit('" name="'), xml_escape(x["condition"]), F.lit('" sourceRef="'), xml_escape(x["src"]), F.lit('" targetRef="'), xml_escape(x["dst"]), F.lit('"/>'))
    xml = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><definitions xmlns="{BPMN}"><process id="'),
        xml_escape("proc_id"),
        F.lit('" name="'),
        xml_escape("name"),
        F.lit('"><laneSet>'),
        F.coalesce(lanes, F.lit("")),
        F.lit("</laneSet>"),
        F.coalesce(_lines(F.col("nodes"), node), F.lit("")),
        F.coalesce(_lines(F.col("flows"), flow), F.lit("")),
        F.lit("</process></definitions>"),
    )
    return body.select("proc_id", xml.alias("xml"))


#: Element tags by the order in which they are read (fixed values).
TAGS = ("startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent", "userTask", "serviceTask", "scriptTask", "task", "exclusiveGateway", "parallelGateway", "inclusiveGateway", "sequenceFlow")


def read_bpmn(xmls: DataFrame) -> DataFrame:
    """proc_id, tag, id, name, role, source, target of all elements, by tag order. What can't be read has no rows.

    xmls: proc_id, xml.
    """

    def rows(proc_id: str, xml: str | None) -> list[tuple]:
        try:
            root = ET.fromstring(xml or "")
        except ET.ParseError:
            return []
        local = lambda e: e.tag.rpartition("}")[2]
        lane = {r.text: e.get("name", "") for e in root.iter() if local(e) == "lane" for r in e if local(r) == "flowNodeRef"}
        found = [e for t in TAGS for e in root.iter() if local(e) == t]
        return [(proc_id, local(e), e.get("id", ""), e.get("name", ""), lane.get(e.get("id"), ""), e.get("sourceRef", ""), e.get("targetRef", "")) for e in found]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = [r for i, x in zip(p["proc_id"], p["xml"], strict=True) for r in rows(i, x)]
            yield pd.DataFrame(out, columns=["proc_id", "tag", "id", "name", "role", "source", "target"])

    return xmls.select("proc_id", "xml").mapInPandas(run, "proc_id string, tag string, id string, name string, role string, source string, target string")


def dmn_json(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """decision_id, json: a decision with its rules and the sorted names of its inputs.

    decisions: decision_id, name, inputs (array). rules: decision_id, rule_id, when, then.
    """
    r = rules.groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "when", "then"))).alias("rules"))
    doc = F.struct(F.col("decision_id").alias("id"), "name", F.array_sort(F.array_distinct("inputs")).alias("inputs"), F.coalesce("rules", F.array().cast("array<struct<rule_id:string,when:string,then:string>>")).alias("rules"))
    return decisions.join(r, "decision_id", "left").select("decision_id", F.to_json(doc).alias("json"))


def dmn_xml(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """decision_id, xml: a decision table."""
    r = rules.groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "when", "then"))).alias("rules"))
    entry = lambda tag, x: F.concat(F.lit(f"<{tag}><text>"), xml_escape(x), F.lit(f"</text></{tag}>"))
    rule = lambda x: F.concat(F.lit('<rule id="'), xml_escape(x["rule_id"]), F.lit('">'), entry("inputEntry", x["when"]), entry("outputEntry", x["then"]), F.lit("</rule>"))
    inputs = F.array_join(F.transform(F.array_sort(F.array_distinct("inputs")), lambda i: F.concat(F.lit('<input label="'), xml_escape(i), F.lit('"/>'))), "")
    xml = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><definitions xmlns="{DMN}"><decision id="'),
        xml_escape("decision_id"),
        F.lit('" name="'),
        xml_escape("name"),
        F.lit('"><decisionTable hitPolicy="FIRST">'),
        inputs,
        F.coalesce(_lines(F.col("rules"), rule), F.lit("")),
        F.lit("</decisionTable></decision></definitions>"),
    )
    return decisions.join(r, "decision_id", "left").select("decision_id", xml.alias("xml"))


def skill_markdown(tasks: DataFrame) -> DataFrame:
    """task_id, markdown: a skill for each agent task. tasks: task_id, name, description, task_type."""
    agent = tasks.where("task_type = 'agent'")
    steps = F.transform(procedure_steps("description"), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    md = F.concat(F.lit("# "), F.col("name"), F.lit(" Skill\n\n## Purpose\n"), F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Carries out "), F.col("name"), F.lit("."))), F.lit("\n\n## Procedure\n"), F.array_join(steps, "\n"), F.lit("\n"))
    return agent.select("task_id", md.alias("markdown"))


#: Tags of form fields (fixed values).
FIELD_TAGS = (
    "text-field",
    "select-field",
    "checkbox-field",
    "radio-field",
    "file-field",
    "label-field",
    "boolean-field",
    "textarea-field",
    "user-select-field",
    "report-field",
    "slide-field",
    "bpmn-uengine-field",
)


def form_fields(forms: DataFrame) -> DataFrame:
    """form_id, n, tag, key, text, type, disabled, readonly: field tags of form HTML, in order. forms: form_id, html.

    The key is what the model binding has in brackets, else the name; the type is the tag's where none is stated.
    """
    starts = F.regexp_extract_all("html", F.lit(rf"""(?is)<((?:{"|".join(FIELD_TAGS)})(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?)>"""), F.lit(1))
    quoted = lambda n: F.coalesce(F.nullif(F.regexp_extract("start", rf"""(?is)\s{n}\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.regexp_extract("start", rf"""(?is)\s{n}\s*=\s*'([^']*)'""", 1))
    flag = lambda n: F.when(F.col("start").rlike(rf"(?is)\s{n}(\s|=|/|$)"), quoted(n)).otherwise(F.lit("false"))
    tag = F.lower(F.regexp_extract("start", r"^([a-zA-Z-]+)", 1))
    each = forms.select("form_id", F.posexplode(starts).alias("n", "start"))
    bracket = F.regexp_extract(quoted("v-model"), r"""\[['"](.+?)['"]\]""", 1)
    key = F.coalesce(F.nullif(bracket, F.lit("")), quoted("name"))
    kind = F.coalesce(F.nullif(quoted("type"), F.lit("")), F.replace(tag, F.lit("-field"), F.lit("")))
    return each.select("form_id", "n", tag.alias("tag"), key.alias("key"), quoted("alias").alias("text"), kind.alias("type"), flag("disabled").alias("disabled"), flag("readonly").alias("readonly"))


def save(artifacts: DataFrame, path: str, column: str, by: str) -> None:
    """Writes one text column, parted by another, as UTF-8 text files."""
    artifacts.select(F.col(by), F.col(column).alias("value")).write.partitionBy(by).mode("overwrite").text(path)
