"""K-d tree sharding by weighted medians (DataFrame functions only).

A leaf is a shard. Language and source count by the rank of their whole value among the table's distinct ones. A node
that has to give k leaves is cut along its widest dimension (in units of the whole table's extent) at the weighted
quantile that gives its left side floor(k / 2) of k shares of its bytes. The quantile is found by refining histograms: a
job adds up the bytes of each of at most BINS bins of every open node, picks the bin in which the quantile lies, and the
next job cuts that bin again, until one value is left; then rows of that value are cut in the same way by a hash of the
row (tie). All nodes of a level are refined in the same jobs. Nodes, cuts and histograms are tables, so neither the
driver nor the plan grows with the number of leaves; sums are made before the shuffle, and no key, however hot, meets in
one task.

The hash covers what a row holds and its place among equal rows, so shards do not depend on how files are split. Equal
texts have no tie of their own: copies that a cut falls on go to both sides by their hash, which keeps sizes equal.

Nulls: a null text has no bytes (size 1); a null dimension is the smallest value. Repeated rows each get a slot. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick

BINS = 4096
HASH_BITS = 40
SLOT_ROWS = 100_000


def ranks(rows: DataFrame, name: str) -> DataFrame:
    """The distinct values of the text column name, and d_name: their dense rank in the order of their whole UTF-8 bytes.
    Values are sorted by ranges and numbered in each, so no task holds them all; the driver sees a count for each range."""
    values = rows.select(name).distinct().orderBy(name).select(name, F.monotonically_increasing_id().alias("id"))
    values = cut(values, "kd-values")  # id: the range, and 33 bits for the place in it
    part = F.shiftright("id", 33).cast("int")
    starts, n = [], 0
    for k, held in sorted(tuple(r) for r in values.groupBy(part).agg(F.count(F.lit(1))).collect()):
        starts += [F.lit(k), F.lit(n).cast("long")]
        n += held
    start = F.create_map(*starts)[part] if n else F.lit(0).cast("long")
    return values.select(name, (start + F.col("id").bitwiseAND(F.lit(2**33 - 1))).alias(f"d_{name}"))


def kd_cells(rows: DataFrame, dims: list[str], shards: int) -> tuple[DataFrame, DataFrame]:
    """rows (size, tie and the dims as longs) with the column shard, and the nodes (cell, k, first) at the end. tie
    spreads equal rows."""
    whole = rows.agg(*[F.greatest(F.max(d) - F.min(d), F.lit(1)).alias(f"of_{d}") for d in dims])
    rows = rows.withColumn("cell", F.lit(0).cast("long"))
    nodes = rows.sparkSession.range(1).select(F.col("id").alias("cell"), F.lit(shards).cast("long").alias("k"), F.lit(0).cast("long").alias("first"))
    for _ in range((shards - 1).bit_length()):
        ends = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]
        ranges = rows.groupBy("cell").agg(F.sum("size").alias("size"), *ends).crossJoin(F.broadcast(whole))  # one row
        widest = F.array_max(F.array(*[F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.col(f"of_{d}")).alias("extent"), F.lit(-i).alias("i"), F.col(f"lo_{d}").alias("lo"), F.col(f"hi_{d}").alias("hi")) for i, d in enumerate(dims)]))
        goals = nodes.filter("k > 1").join(ranges, "cell").withColumn("w", widest)
        goals = goals.select("cell", (-F.col("w.i")).alias("dim"), F.lit(None).cast("long").alias("value"), "w.lo", "w.hi", (F.col("size") * F.floor(F.col("k") / 2) / F.col("k")).alias("want"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("cut"))
        found = _refine(rows, goals, dims)
        own = F.get(F.array(*dims), F.col("dim"))
        right = F.coalesce((own > F.col("value")) | ((own == F.col("value")) & (F.col("tie") >= F.col("cut"))), F.lit(False))
        names = rows.columns
        rows = cut(rows.join(found, "cell", "left").withColumn("cell", F.col("cell") * 2 + right.cast("long")).select(*names), "kd-level")
        left = F.floor(F.col("k") / 2)
        split = nodes.join(found.select("cell", F.lit(True).alias("split")), "cell", "left")
        half = lambda i, k, at: F.struct((F.col("cell") * 2 + i).alias("cell"), k.cast("long").alias("k"), (F.col("first") + at).alias("first"))
        # one leaf, or no rows to divide: its other leaves stay empty
        nodes = cut(split.select(F.explode(F.when(F.col("split"), F.array(half(0, left, F.lit(0)), half(1, F.col("k") - left, left))).otherwise(F.array(half(0, F.lit(1), F.lit(0))))).alias("x")).select("x.*"), "kd-nodes")
    return rows.join(nodes.select("cell", F.col("first").cast("int").alias("shard")), "cell").drop("cell"), nodes


def _refine(rows: DataFrame, goals: DataFrame, dims: list[str]) -> DataFrame:
    """cell, dim, value and cut of each goal: rows below (value, cut) hold as near the wanted bytes as one row allows."""
    todo, done = cut(goals, "kd-goals"), None
    while True:
        own = F.get(F.array(*dims), F.col("dim"))
        step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / BINS))
        key = F.when(F.col("value").isNull(), own).otherwise(F.when(own == F.col("value"), F.col("tie")))
        here = rows.select("cell", "size", "tie", *dims).join(todo, "cell").withColumns({"key": key, "step": step}).filter(F.col("key").between(F.col("lo"), F.col("hi")))
        sums = here.groupBy("cell", F.floor((F.col("key") - F.col("lo")) / F.col("step")).alias("bin")).agg(F.sum("size").alias("s"), F.min("key").alias("from"), F.max("key").alias("to"), F.first("want").alias("want"), F.first("below").alias("below"))
        upto = F.col("below") + F.sum("s").over(Window.partitionBy("cell").orderBy("bin"))  # at most BINS rows a cell
        bins = sums.withColumn("upto", upto)
        it = F.struct("bin", "from", "to", "s", "upto")
        pick = bins.groupBy("cell").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("want"), it)), F.max(it)).alias("b"))
        got = todo.drop("below", "lo", "hi").join(pick, "cell")
        single = F.col("b.from") == F.col("b.to")
        before = F.col("b.upto") - F.col("b.s")
        valued = single & F.col("value").isNull()
        nearer = F.when(F.col("b.upto") - F.col("want") < F.col("want") - before, 1).otherwise(0)  # the rows of one tie go to the nearer side
        ends = F.when(single & F.col("value").isNotNull(), F.col("b.from") + nearer)
        got = got.select(
            "cell", "dim", F.when(valued, F.col("b.from")).otherwise(F.col("value")).alias("value"), F.when(valued, 0).otherwise(F.col("b.from")).cast("long").alias("lo"),
            F.when(valued, F.lit(2**HASH_BITS - 1)).otherwise(F.col("b.to")).alias("hi"), "want", before.alias("below"), ends.cast("long").alias("cut"),
        )
        got = cut(got, "kd-goals")
        ready = got.filter("cut is not null").select("cell", "dim", "value", "cut")
        done = ready if done is None else done.unionByName(ready)
        todo = got.filter("cut is null")
        if todo.isEmpty():
            return cut(done, "kd-cuts")


def copies(rows: DataFrame) -> DataFrame:
    """rows (content, uid) with copy: the place among rows of equal content. Only contents that repeat are numbered, in
    each input partition and then over the partitions, so that equal rows are spread as they came."""
    again = rows.groupBy("content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("content")
    twins = rows.join(again, "content", "left_semi").select("content", "uid", F.shiftright("uid", 33).alias("part"))
    upto = Window.partitionBy("content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = twins.groupBy("content", "part").agg(F.count(F.lit(1)).alias("n")).select("content", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    place = twins.withColumn("here", F.row_number().over(Window.partitionBy("content", "part").orderBy("uid")) - 1).join(start, ["content", "part"])
    return rows.join(place.select("uid", (F.col("start") + F.col("here")).alias("copy")), "uid", "left").withColumn("copy", F.coalesce("copy", F.lit(0)))


def with_slots(rows: DataFrame) -> DataFrame:
    """rows with slot: 0, 1, ... in each shard. Rows are numbered in buckets of about SLOT_ROWS and the buckets' counts
    added up, so no task numbers a whole shard."""
    n = rows.count()
    rows = rows.withColumn("bucket", F.pmod(F.col("tie"), F.lit(max(1, -(-n // SLOT_ROWS)))).cast("int"))
    start = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.expr("coalesce(sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0)")).drop("n")
    here = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "content", "copy"))
    return rows.withColumn("here", here).join(start, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("here") - 1)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Give the number of leaves or their target bytes."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = pick(docs, "doc_id", "text", "lang", "source").select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce("text", F.lit("")), *[F.coalesce(c, F.lit("")) for c in ("lang", "source")]).alias("content"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.length(F.coalesce("text", F.lit(""))).cast("long").alias("d_chars"),
    )
    for c in ("lang", "source"):
        rows = rows.join(ranks(pick(docs, c).select(F.coalesce(c, F.lit("")).alias(c)), c), c)
    rows = cut(rows.drop("lang", "source"), "kd-rows")  # from here on the running number is fixed
    rows = cut(copies(rows).withColumn("tie", F.pmod(F.xxhash64("content", "copy"), F.lit(2**HASH_BITS))).drop("uid"), "kd-ties")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    rows, _ = kd_cells(rows, ["d_lang", "d_source", "d_chars"], shards)
    return with_slots(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
