"""What the corpus operators share: column picking, row keys and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: 0x20 and 0x09 to 0x0D, as one string and as a character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
FEW = 10_000  # keys that need no sieve
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched exactly, so that other columns' names never clash; the first of equal names counts."""
    at = {n: df.columns.index(n) for n in dict.fromkeys(names)}
    short = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return short.select(*[F.col(f"c{i}").alias(n) for n, i in at.items()])


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that equal rows share: computed again after a lost executor it is the same, unlike a running number. Among n
    different rows two share a key with a chance of n * n / 2**65: 3 % for a billion."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\x00")), F.coalesce(text, F.lit("")), text.isNull())


def position(df: DataFrame, name: str) -> int:
    """The place of the first column that is named exactly so."""
    return df.columns.index(name)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: names of a user's columns cannot clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def sieved(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose column, a long, is not among keys' column of that name; none that is goes. A
    bitmap of 16 to 32 bits a key, 8 MB at most, is broadcast for it, so that rows that match nothing are not shuffled
    to an exact join, which must follow. Few keys pass all rows: Spark broadcasts them itself."""
    n = keys.count()
    if n < FEW:
        return rows
    longs = 1 << min(20, max(0, (16 * n - 1).bit_length() - 6))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit("sieve")), F.lit(longs * 64))
    own = keys.select(place(F.col(column)).alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    every = keys.sparkSession.range(longs).withColumnRenamed("id", "i").join(own, "i", "left").select(F.struct("i", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    bitmap = cut(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("__sieve")), "sieve")
    at = place(F.col(column))
    return rows.join(F.broadcast(bitmap), F.getbit(F.get("__sieve", F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1).drop("__sieve")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may go without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flowspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so that a lost executor costs no earlier stage.

    The folder goes when the driver's Python ends. The shuffle files that the table was made of go as soon as it is
    written; those of other jobs go once the driver's JVM has collected their handles, which is asked for here before
    the next job fills the disks.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/flowspark-{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    cleanup = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleanup)
    _written.append(path)
    if top not in _made:
        _made.add(top)
        atexit.register(_remove, spark, top)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def discard(df: DataFrame) -> None:
    """Removes the table that cut gave, once nothing reads it any more."""
    _delete(df.sparkSession, _paths[id(df)])


def cut_last(work: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut of what work returns; the tables that cut made for it meanwhile are then removed."""
    begin = len(_written)
    out = cut(work(), name)
    for path in _written[begin:-1]:
        _delete(out.sparkSession, path)
    del _written[begin:-1]
    return out


_written: list[str] = []  # in order
_paths: dict[int, str] = {}  # of tables that cut gave
_made: set[str] = set()


def _remove(spark: SparkSession, top: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, top)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
