"""Condensation: conversations around one anchor beyond the first K fold into one node.

A flow has an anchor for each of its ends (one if they are equal). Once K expanded flows of a parent have an anchor, the
next new flow folds into that anchor's node; the packet's source is tried first, an expanded flow counts for both of its
anchors, and a folded one for none. So whether a flow folds depends on earlier ones: new flows are taken in the order of
their first packets, as slim rows, by one Arrow stream for each parent in which an anchor reaches K; a count shows which,
and all other parents stay as they are. A flow both of whose anchors are full sends its two directions to two nodes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

MEMBERS = 65_536  # fixed value: members that are counted exactly


def condense(flows: DataFrame, most: int = 256) -> DataFrame:
    """flows: parent, a, b (the two ends as text), src (which of them sent), packet_no, size: a row for each packet. Returns
    parent, anchor (null: an expanded flow, whose ends are a and b), packets and bytes by direction (A is the anchor, or the
    lesser end), members (at most MEMBERS) and whether there were more. most = 0 turns condensation off."""
    flows = flows.select("parent", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "src", "packet_no", "size")
    ends = flows.select("parent", F.explode(F.array_distinct(F.array("a", "b"))).alias("end"), F.xxhash64("a", "b").alias("flow"))
    full = ends.distinct().groupBy("parent", "end").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most) if most else ends.limit(0)
    firsts = flows.groupBy("parent", "a", "b").agg(F.min("packet_no").alias("packet_no")).join(full.select("parent").distinct(), "parent", "left_semi")
    ordered = firsts.repartition("parent").sortWithinPartitions("parent", "packet_no")
    verdict = written(ordered.mapInArrow(_decide(most), "parent string, a string, b string, end string, full_at long"), "condensed")
    folded = verdict.filter("end is null").select("parent", "a", "b", F.lit(True).alias("folded"))
    since = verdict.filter("end is not null")
    one = lambda c: since.select("parent", F.col("end").alias(c), F.col("full_at").alias(f"{c}_at"))
    rows = flows.withColumn("dst", F.when(F.col("src") == F.col("a"), F.col("b")).otherwise(F.col("a"))).join(folded, ["parent", "a", "b"], "left").join(one("src"), ["parent", "src"], "left").join(one("dst"), ["parent", "dst"], "left")
    past = lambda c: F.col("folded") & (F.col(f"{c}_at") < F.col("packet_no"))
    rows = rows.withColumn("anchor", F.when(past("src"), F.col("src")).when(past("dst"), F.col("dst")))
    side = F.when(F.col("anchor").isNull(), F.col("a")).otherwise(F.col("anchor"))
    other = F.when(F.col("anchor") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    rows = rows.select("parent", "anchor", F.when(F.col("anchor").isNull(), F.col("a")).alias("a"), F.when(F.col("anchor").isNull(), F.col("b")).alias("b"), F.when(F.col("src") == side, 0).otherwise(1).alias("dir"), "size", F.when(F.col("anchor").isNotNull(), other).alias("member"))
    per = lambda d, x: F.sum(F.when(F.col("dir") == d, x).otherwise(0)).cast("long")
    group = ["parent", "anchor", "a", "b"]
    each = rows.groupBy(*group, "member").agg(*[per(d, x).alias(f"{n}_{s}") for d, s in ((0, "ab"), (1, "ba")) for n, x in (("packets", F.lit(1)), ("bytes", F.col("size")))])
    sums = [F.sum(f"{n}_{s}").alias(f"{n}_{s}") for s in ("ab", "ba") for n in ("packets", "bytes")]
    return each.groupBy(*group).agg(*sums, F.least(F.count("member"), F.lit(MEMBERS)).alias("members"), (F.count("member") > MEMBERS).alias("overflow"))


def _decide(most: int):
    """Of each parent's flows in order: those that fold, and the packet with which each end became full."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tally = None, Counter()
        for batch in batches:
            rows = []
            for parent, a, b, packet in zip(*(c.to_pylist() for c in batch.columns)):
                if parent != here:
                    here, tally = parent, Counter()
                if tally[a] >= most or tally[b] >= most:
                    rows.append((parent, a, b, None, None))
                    continue
                for x in {a, b}:
                    tally[x] += 1
                    if tally[x] == most:
                        rows.append((parent, None, None, x, packet))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.string()] * 4, pa.int64()])], names=["parent", "a", "b", "end", "full_at"])

    return work


def label(anchor, members, overflow):
    """anchor ↔ :* × N flows"""
    return F.concat(anchor, F.lit(" ↔ :* × "), F.when(overflow, F.lit("≥")).otherwise(F.lit("")), members.cast("string"), F.lit(" flows"))
