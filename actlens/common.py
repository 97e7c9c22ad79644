"""Helpers shared by all operators: text stripping, settled tables, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space, as Python's str.isspace has it.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(col: Column) -> Column:
    """The text without white space (of any script) at both ends."""
    return F.btrim(col, F.lit(WHITE))


def norm(col: Column) -> Column:
    """Stripped and in lower case, for comparisons that ignore both."""
    return F.lower(strip(col))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, not wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) chosen by a digest of the parts: the same for any partitioning, and in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the cluster names it; a temporary one only on a local master."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not hasattr(shared_dir, "own"):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared_dir.own = tempfile.mkdtemp(prefix="actlens-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return shared_dir.own


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per Spark application."""
    sc = spark.sparkContext
    if getattr(ship, "to", None) == sc.applicationId:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="actlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(f"{folder}/{root.name}.zip")
    ship.to = sc.applicationId


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for costly work on few files; larger inputs, whose scans have more, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settle(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors, keeps column pruning."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_settled: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the tables that settle wrote in this process; call it once the results that read them are written."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _settled:
        path = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(hadoop).delete(path, True)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else df as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df
