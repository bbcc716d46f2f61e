"""Incarnations of a conversation by idle time, why they end, and time that runs backwards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idle_sessions(rows: DataFrame, key: list[str], ts: str, order: str, idle: int, closes: Column | None = None, linger: int = 0) -> DataFrame:
    """rows with session (0, 1, ...): a gap of idle or more starts a new one, equality included (session_window would merge
    there). A session's first closing row sets a deadline linger later, which later rows do not move; the first row at or
    after it starts a new session. Without closing rows this is a window; with them each key's sorted rows go once through
    an Arrow stream that holds one batch, whatever the size of the key."""
    if closes is None:
        w = Window.partitionBy(*key).orderBy(order)
        new = F.coalesce(F.col(ts) - F.lag(ts).over(w) >= idle, F.lit(False))
        return rows.withColumn("new", new.cast("int")).withColumn("session", F.sum("new").over(w)).drop("new")
    marked = rows.withColumns({"__key": F.to_json(F.struct(*key)), "__closes": F.coalesce(closes, F.lit(False))})
    sorted_rows = marked.repartition("__key").sortWithinPartitions("__key", order)
    out = sorted_rows.mapInArrow(_lingering(ts, idle, linger), sorted_rows.withColumn("session", F.lit(0).cast("long")).schema)
    return out.drop("__key", "__closes")


def _lingering(ts: str, idle: int, linger: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, deadline, session = None, None, None, 0
        for b in batches:
            got = []
            columns = (b.column(b.schema.names.index(c)).to_pylist() for c in ("__key", ts, "__closes"))
            for k, t, closing in zip(*columns):
                if k != last:
                    last, at, deadline, session = k, None, None, 0
                elif t is not None and (at is not None and t - at >= idle or deadline is not None and t >= deadline):
                    session, deadline = session + 1, None
                if t is not None:
                    at = t
                    if closing and deadline is None:
                        deadline = t + linger
                got.append(session)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], names=[*b.schema.names, "session"])

    return work


def session_ends(sessions: DataFrame, key: list[str], ts: str, idle: int, closes: Column, linger: int) -> DataFrame:
    """A row for each session: events, first_ts, last_ts and reason, by the clock of the whole table: protocol_close if its
    linger deadline has passed, else idle_timeout if its idle deadline has, else capture_end."""
    clock = sessions.agg(F.max(ts).alias("clock"))
    out = sessions.groupBy(*key, "session").agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min(F.when(closes, F.col(ts))).alias("closed_ts"))
    after = F.lead("first_ts").over(Window.partitionBy(*key).orderBy("session"))
    out = out.crossJoin(F.broadcast(clock)).withColumn("until", F.coalesce(after, F.col("clock")))  # one row
    closed, idled = F.col("closed_ts") + linger <= F.col("until"), F.col("last_ts") + idle <= F.col("until")
    return out.withColumn("reason", F.when(closed, "protocol_close").when(idled, "idle_timeout").otherwise("capture_end")).drop("closed_ts", "clock", "until")


def effective_ends(nodes: DataFrame, idle: int) -> DataFrame:
    """path and ends: when a node may close at the earliest. A node with open children is never closed, so a parent's end is
    the latest of its own and its descendants'."""
    parts = F.split("path", "/")
    ups = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"), (F.col("last_seen") + idle).alias("ends"))
    return ups.groupBy("path").agg(F.max("ends").alias("ends"))


def finish(nodes: DataFrame) -> DataFrame:
    """nodes with closed filled in (capture_end where it is null); sinks take them deepest first, then by creation."""
    closed = F.col("closed") if "closed" in nodes.columns else F.lit(None).cast("string")
    return nodes.withColumn("closed", F.coalesce(closed, F.lit("capture_end"))).orderBy(F.desc("depth"), "first_packet")


def regressions(rows: DataFrame, ts: str, order: str, block: int = 100_000) -> DataFrame:
    """How many rows are earlier than one before them. The running maximum is taken in blocks of the order column and
    carried over one row a block, so no task sees all rows."""
    rows = rows.select(F.col(ts).alias("ts"), F.col(order).alias("ord")).withColumn("block", F.floor(F.col("ord") / block))
    tops = rows.groupBy("block").agg(F.max("ts").alias("top")).withColumn("before", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    here = F.max("ts").over(Window.partitionBy("block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("here", here).join(tops.select("block", "before"), "block")
    return marked.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ts") < F.greatest("here", "before")).cast("long")).alias("regressed"))
