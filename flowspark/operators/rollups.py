"""Bounded rollups of a field for each node: accumulate, sample and series. Input: path, ord (total order), value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accumulate(obs: DataFrame, cap: int = 64, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Distinct values in order of first observation, at most cap; all observations; whether more came. Values are
    counted before they meet, so a hot node brings one row a value and task."""
    seen = obs.filter("value is not null").groupBy(*by, "value").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    # Each task first cuts its own part of a node's values to the cap, so no window meets all values of a hot node.
    part = Window.partitionBy(*by, F.pmod(F.xxhash64("value"), F.lit(64))).orderBy("ord")
    slim = seen.withColumn("first", F.row_number().over(part) <= cap)
    ranked = slim.filter("first").withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).filter(F.col("place") <= cap)
    sums = seen.groupBy(*by).agg(F.sum("n").alias("observations"), (F.count(F.lit(1)) > cap).alias("overflow"))
    kept = F.array_sort(F.collect_list(F.when(F.col("place") <= cap, F.struct("ord", "value"))))
    values = ranked.groupBy(*by).agg(F.array_join(F.transform(kept, lambda x: x["value"].cast("string")), ",").alias("kept"))
    return values.join(sums, list(by), "left").select(*by, "kept", "observations", "overflow")


def sample(obs: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """First and last observed value."""
    got = obs.filter("value is not null").groupBy(*by).agg(F.min(F.struct("ord", "value")).alias("a"), F.max(F.struct("ord", "value")).alias("z"))
    return got.select(*by, F.col("a.value").alias("first_value"), F.col("z.value").alias("last_value"))


def series(obs: DataFrame, cap: int = 1024, by: tuple[str, ...] = ("path",), own: str | None = None) -> DataFrame:
    """The last cap observations in order, or as many as the column own says if fewer, and whether cap dropped any. Spark cuts each task to cap rows a node before
    the shuffle (a group limit of the window), so a hot node sends at most cap rows a task."""
    given = obs.filter("value is not null")
    n = given.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    last = given.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ord")))).filter(F.col("place") <= max(1, cap))
    last = last.filter(F.col("place") <= F.greatest(F.lit(1), F.col(own))) if own else last
    points = last.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"].cast("string")), ",").alias("points"))
    return points.join(n, list(by), "left").select(*by, "points", (F.col("n") > max(1, cap)).alias("truncated"))


def observations(dissected: DataFrame, protocols: list | None = None, packet_no: str = "packet_no") -> DataFrame:
    """path, kind, field, cap, ord, ts, dir and value (text) of each field that its protocol rolls up. A field that a layer
    lacks, or that the depth left out, is no observation."""
    from ..functions.protocols import standard

    specs = {p.name: p.rollups for p in (standard() if protocols is None else protocols) if p.rollups}
    kinds = F.create_map(*[c for name, r in specs.items() for c in (F.lit(name), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(n).alias("cap")) for k, f, n in r]))])
    keyed = F.filter("layers", lambda x: x["key"].isNotNull())
    rows = dissected.select(F.col(packet_no).alias("ord"), "ts", keyed.alias("keyed")).select("ord", "ts", "keyed", F.posexplode("keyed").alias("at", "x"))
    path = F.array_join(F.transform(F.slice("keyed", 1, F.col("at") + 1), lambda x: F.concat(x["protocol"], F.lit(":"), x["key"])), "/")
    rows = rows.select(path.alias("path"), "ord", "ts", F.col("x.dir").alias("dir"), F.col("x.fields").alias("fields"), F.explode(kinds[F.col("x.protocol")]).alias("r"))
    value = F.get(F.filter("fields", lambda f: f["name"] == F.col("r.field")), 0)
    text = F.coalesce(value["text"], value["num"].cast("string"), F.lower(F.hex(value["raw"])))
    return rows.select("path", "r.kind", "r.field", "r.cap", "ord", "ts", "dir", text.alias("value")).filter("value is not null")


def of_fields(obs: DataFrame, clamp: int | None = None) -> DataFrame:
    """All rollups of observations: path, field, kind and kept (accumulate: first distinct values; sample: first and last;
    series: the last points as time, direction and value). clamp outranks the caps of series, at least 1. A condition on
    kind or field reaches the observations."""
    by = ("path", "field")
    node = lambda kind: obs.filter(F.col("kind") == kind)
    first = accumulate(node("accumulate").select(*by, "ord", "value"), by=by).select(*by, F.lit("accumulate").alias("kind"), "kept")
    ends = sample(node("sample").select(*by, "ord", "value"), by).select(*by, F.lit("sample").alias("kind"), F.concat_ws(",", "first_value", "last_value").alias("kept"))
    point = F.concat_ws("@", "value", F.concat_ws("/", F.col("ts").cast("string"), F.col("dir").cast("string")))
    out = first.unionByName(ends)
    if clamp is not None:
        last = series(node("series").select(*by, "cap", "ord", point.alias("value")), clamp, (*by, "cap"), "cap")
        return out.unionByName(last.select(*by, F.lit("series").alias("kind"), F.col("points").alias("kept")))
    for cap in [r.cap for r in obs.filter("kind = 'series'").select("cap").distinct().collect()]:  # as many as protocols declare
        last = series(node("series").filter(F.col("cap") == cap).select(*by, "ord", point.alias("value")), cap, by)
        out = out.unionByName(last.select(*by, F.lit("series").alias("kind"), F.col("points").alias("kept")))
    return out
