"""Files on disk in one scan against one file at a time; failures as rows."""

from pyspark.sql import functions as F

from procgraph.sources import ingest
from procgraph.sources.files import binary_files

TEXTS = {"a.txt": "# One\nfirst line\n\fsecond page\n# Two\nmore", "b.v2.txt": "no heading at all", "empty.txt": "", "sub/a.txt": "# Other\nwith the same name\f\f" + "word " * 700, "ü x.txt": "# Ü\nline\r\nline"}


def all_rows(frames):
    return {n: sorted((tuple(r) for r in f.collect()), key=repr) for n, f in frames.items()}


def test_union_equals_single_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, t in TEXTS.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    files = binary_files(spark, str(tmp_path))
    for semantic in (False, True):
        whole = all_rows(ingest.ingested(files, semantic=semantic))
        single = {n: [] for n in whole}
        for r in files.select("path").collect():
            for n, rows in all_rows(ingest.ingested(files.where(F.col("path") == r["path"]), semantic=semantic)).items():
                single[n] += rows
        assert whole == {n: sorted(rows, key=repr) for n, rows in single.items()}
    assert sorted(r[1] for r in whole["documents"]) == sorted(["a", "a", "b.v2", "bad", "ü x"])  # Spark's scan leaves out files of no bytes
    bad = next(r for r in whole["documents"] if r[1] == "bad")
    assert bad[3:5] == (0, "failed") and bad[5].startswith("UnicodeDecodeError") and not any(r[0] == bad[0] for n in ("pages", "sections", "chunks") for r in whole[n])
    assert sorted(r[3] for r in whole["documents"]) == [0, 1, 1, 2, 3]


def test_recognised_and_odd_files(spark):
    """Lines are added on pages with images only; a reader may fail, give nothing, or null texts; no files, no rows."""

    def reader(path, content):
        if path == "fails":
            raise RuntimeError("x" * 1000)
        return {"pics": [("base\nsame", True), ("plain", False), (None, True)], "none": []}[path]

    files = spark.createDataFrame([("pics", b"1"), ("fails", b"1"), ("none", b"1"), ("null", None)], "path string, content binary")
    nothing = spark.createDataFrame([("blank", b"")], files.schema)
    assert [(r["page"], r["text"]) for r in ingest.ingested(nothing)["pages"].collect()] == [(1, "")]
    seen = spark.createDataFrame([("pics", 1, "same\n new "), ("pics", 2, "unwanted"), ("pics", 3, "only"), ("gone", 1, "x")], "path string, page int, seen string")
    got = ingest.ingested(files, reader, seen)
    pages = {(r["doc_id"], r["page"]): r["text"] for r in got["pages"].collect()}
    docs = {r["source"]: r for r in got["documents"].collect()}
    pics = docs["pics"]["doc_id"]
    assert [pages[pics, n] for n in (1, 2, 3)] == ["base\nsame\nnew", "plain", "only"] and pages[docs["none"]["doc_id"], 1] == ""
    assert len(docs["fails"]["error"]) == 500 and docs["null"]["error"] == "ValueError: no content" and docs["null"]["page_count"] == 0
    assert all(f.count() == 0 for f in ingest.ingested(files.where("false"), reader).values())


def test_title(spark):
    df = spark.createDataFrame([("dir.x/name.tar.gz",), (".hidden",), ("plain",), (None,)], "path string")
    assert [r["t"] for r in df.select(ingest.title("path").alias("t")).collect()] == ["name.tar", ".hidden", "plain", None]
