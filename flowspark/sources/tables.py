"""Tables written in the folder that the cluster shares, and numbering by a total order."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may go without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: what reads it twice computes it once, and a lost executor costs
    nothing before it. The folder goes when the driver's Python ends."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    path, schema = f"{top}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    if top not in _made:
        _made.add(top)
        atexit.register(_remove, spark, top)
    return spark.read.schema(schema).parquet(path)


def _remove(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, *by: str | Column) -> DataFrame:
    """df with the long column name: 0, 1, ... in the order of by, which must be total. Rows are sorted by ranges, written
    with their place in the range, and the ranges' sizes (one row a range) are added up; no task holds all rows."""
    held = written(df.orderBy(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    starts, n = [], 0
    for k, size in sorted(tuple(r) for r in held.groupBy(part.cast("int")).agg(F.count(F.lit(1))).collect()):
        starts += [F.lit(k), F.lit(n).cast("long")]
        n += size
    start = F.create_map(*starts)[part.cast("int")] if n else F.lit(0).cast("long")
    return held.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")
