"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, for a character class of a regular expression.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_procgraph_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="procgraph-")) / "procgraph.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._procgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = local_dir()
    return where.rstrip("/")


@cache
def local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="procgraph-")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again, which cuts lineage. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    p, files = hadoop_path(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table of a frame that stored() gave, once nothing needs it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p, files = hadoop_path(df.sparkSession, folder)
        files.delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets the shuffle files of jobs that are over go now: Spark deletes them when the driver collects garbage, which may be late."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % m


def utf8(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
