"""Private keys go whole: the lines around them and what lies between."""

import pytest

from procgraph.llm import secrets
from procgraph.llm.queries import ORACLE

BODY = "\n".join(["MIIEowIBAAKCAQEA" + "Qx7/+zT9" * 6] * 20) + "\nab=="
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
TEXTS = [
    f"x\n{BEGIN}\n{BODY}\n{END}\ny",
    f"{BEGIN}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0123AB\r\n\r\n{BODY}\r\n{END} y",
    '"' + f"{BEGIN}\n{BODY}\n{END}\n".replace("\n", "\\n") + '"',
    f"x {BEGIN} is a line, not a key.",
    f"{BEGIN}\n{BODY}\n{END} and {BEGIN}\n{BODY}\n{END}",
    f"{BEGIN}\nMIIE. {BEGIN}\n{BODY}\n{END}",
]
LEFT = ["x\n[SECRET]\ny", "[SECRET] y", '"[SECRET]\\n"', "x [SECRET] is a line, not a key.", "[SECRET] and [SECRET]", "[SECRET]\nMIIE. [SECRET]"]


def test_whole_keys_go(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert [got[i] for i in range(len(TEXTS))] == LEFT


def test_spans_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    rel = con.sql(ORACLE["op9_secret_scan"])
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r.asDict() for r in secrets.scan(docs).collect()}
    assert {r[0]: dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()} == got
