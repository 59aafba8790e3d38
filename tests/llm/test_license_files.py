"""Licenses as they lie in files: titles, copyright lines, and the long texts."""

from pathlib import Path

import pytest

from procgraph.llm import licenses
from procgraph.llm.license_texts import KNOWN

COMMON = Path("/usr/share/common-licenses")


def ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_titled_files(spark):
    lead = lambda title: f"{title}\n\nCopyright (c) 2021, Somebody\nAll rights reserved.\n\n"
    texts = [lead("MIT License") + KNOWN["MIT"], lead("BSD 3-Clause License") + KNOWN["BSD-3-Clause"], lead("# ISC License") + KNOWN["ISC"], lead("The MIT License (MIT)") + KNOWN["MIT"], lead("Other License") + KNOWN["MIT"]]
    assert ids(spark, texts) == ["MIT-title", "BSD-3-Clause-title", "ISC-title", "MIT-title-3", None]


@pytest.mark.skipif(not COMMON.exists(), reason="no license texts on this machine")
def test_long_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert ids(spark, [(COMMON / f).read_text() for f in names]) == list(names.values())


def test_terms_and_filled_in_names(spark):
    apache = KNOWN["Apache-2.0"]
    texts = [apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Somebody"), KNOWN["Apache-2.0-terms"] + "\n", apache.split("TERMS AND CONDITIONS")[0]]
    assert ids(spark, texts) == ["Apache-2.0", "Apache-2.0-terms", None]
