"""Streams of captures and events: sessions with timers, published snapshots and event lines (Structured Streaming).

Spark's clock is the watermark: it runs behind the largest time seen by the delay given, and rows later than that are
dropped, while a batch run takes every row however late. Choose the delay for the capture; the drop count is in the query's
progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import views
from ..sources import pcap


def pcap_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """The packets of capture files as they appear below path (a directory of rotated captures)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    return pcap.decode(files)


_STATE = "session long, first_ts long, last_ts long, events long, closed_ts long"
_ENDED = "session long, first_ts long, last_ts long, events long, reason string"


def live_sessions(rows: DataFrame, key: str, ts: str, idle: int, closes: str, linger: int, delay: str = "10 minutes") -> DataFrame:
    """A row for each session that ends: key, session, first_ts, last_ts, events, reason. ts is a timestamp; idle and linger are
    microseconds. A session ends idle after its last row or linger after its first closing row (closes, a boolean column),
    whichever comes first; the next row of the key starts a new one."""
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.coalesce(F.col(closes), F.lit(False)).alias("closes"))
    return slim.withWatermark("time", delay).groupBy("key").applyInPandasWithState(_sessions(idle, linger), f"key string, {_ENDED}", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _sessions(idle: int, linger: int) -> Callable:
    def deadline(s: tuple) -> int:
        return min(s[2] + idle, s[4] + linger if s[4] is not None else s[2] + idle)

    def ended(key: str, s: tuple, now: int) -> tuple:
        closed = s[4] is not None and s[4] + linger <= now
        return (key, *s[:3], s[3], "protocol_close" if closed else "idle_timeout")

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, out = state.get if state.exists else None, []
        if state.hasTimedOut:
            out.append(ended(key[0], s, deadline(s)))
            state.update((s[0] + 1, None, None, 0, None))  # keeps the number of the next session
        else:
            got = pd.concat(list(batches)).sort_values("ts")
            for t, closing in zip(got["ts"], got["closes"]):
                t = int(t)
                if s is not None and s[1] is not None and deadline(s) <= t:
                    out.append(ended(key[0], s, t))
                    s = (s[0] + 1, None, None, 0, None)
                number, first, last, n, closed = s or (0, None, None, 0, None)
                s = (number, t if first is None else first, t, n + 1, t if closing and closed is None else closed)
            state.update(s)
            state.setTimeoutTimestamp(max(deadline(s) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "session", "first_ts", "last_ts", "events", "reason"])

    return work


def publish(view: DataFrame, path: str, generation: int, finished: bool = False, error: str | None = None) -> None:
    """A snapshot as a generation of its own below path, then the status that points to it: readers see whole snapshots."""
    spark = view.sparkSession
    view.write.mode("overwrite").parquet(f"{path}/snapshot/gen={generation}")
    status = {"generation": generation, "finished": finished, "error": error}
    spark.createDataFrame([(generation, json.dumps(status))], "generation long, status string").coalesce(1).write.mode("append").json(f"{path}/status")


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The snapshot published last, and its status."""
    row = spark.read.schema("generation long, status string").json(f"{path}/status").agg(F.max_by("status", "generation")).first()
    status = json.loads(row[0])
    return spark.read.parquet(f"{path}/snapshot/gen={status['generation']}"), status


def write_events(before: DataFrame | None, after: DataFrame, path: str) -> DataFrame:
    """NDJSON lines of what changed between two snapshots: stream_new, stream_update, stream_closed with the stream's record."""
    none = after.limit(0) if before is None else before
    changed = views.snapshot_diff(none, after).join(after, "path")
    lines = views.json_records(changed).join(changed.select("id", "event"), "id").select(F.to_json(F.struct("event", F.col("json").alias("stream"))).alias("value"))
    lines.write.mode("append").text(path)
    return lines


def run_snapshots(packets: DataFrame, forest_of: Callable[[DataFrame], DataFrame], store: str, path: str, every: str = "1 second"):
    """Starts a query that appends packets to the table store and publishes, a batch at a time, the forest of all of them and
    its event lines below path."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("append").parquet(store)
        old = None
        if number:
            old, _ = latest(spark, path)
        view = forest_of(spark.read.parquet(store))
        publish(view, path, number)
        write_events(old, spark.read.parquet(f"{path}/snapshot/gen={number}"), f"{path}/events")

    return packets.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True) if every == "once" else packets.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime=every)
