"""Licenses as people lay them out, by the operator and by its SQL."""

import textwrap

import pyarrow as pa

from procgraph.llm import licenses
from procgraph.llm.licenses import KNOWN
from procgraph.llm.queries import ORACLE

SHORT = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "0BSD", "MIT-0", "MPL-2.0-notice", "Apache-2.0-notice")
HEADS = ("", "Copyright (c) 2020 Somebody\n\n", "Copyright 2011-2020 X, Y\n", "Copyright © The Authors\nAll rights reserved.\n\n", "(c) 2020 by Z\n")


def wrapped(text, width, mark):
    return "\n".join(mark + line for p in text.split("\n") for line in (textwrap.wrap(p, width) or [""]))


def layouts():
    for k in SHORT:
        for n, (width, mark) in enumerate([(72, ""), (64, " * "), (76, "# "), (58, "// "), (80, "; ")]):
            yield k, "".join(mark + h + "\n" for h in HEADS[n].split("\n")[:-1]) + wrapped(KNOWN[k], width, mark)
    isc = KNOWN["ISC"]
    yield "ISC", isc.replace("provided that the above copyright notice", "provided that the above\ncopyright notice")
    yield "BSD-2-Clause", KNOWN["BSD-2-Clause"].replace("1. ", " * ").replace("2. ", " * ")
    yield "MIT-title", "// MIT License\n// Copyright 2020 X\n" + wrapped(KNOWN["MIT"], 70, "// ")
    yield None, "Copyright holders have rights.\n" + KNOWN["MIT"]
    yield None, "the copyright (c) 2020 of X"


def test_layouts_by_operator_and_sql(spark, duck):
    want = list(layouts())
    rows = [(i, t) for i, (_, t) in enumerate(want)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(k, got[i]["license_id"]) for i, (k, _) in enumerate(want)] == [(k, k) for k, _ in want]
    con = duck.cursor()
    con.register("own", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    con.sql("CREATE TEMP VIEW documents AS SELECT * FROM own")
    names = con.sql(ORACLE["op1_license_scan"]).columns
    for r in con.sql(ORACLE["op1_license_scan"]).fetchall():
        x = dict(zip(names, r, strict=True))
        assert (x["digest"], x["license_id"]) == (got[x["doc_id"]]["digest"], got[x["doc_id"]]["license_id"])
