"""The stream forest: layered records folded into bidirectional conversations.

A record is a packet with layers from the outermost to the innermost; a layer has a protocol, shared key parts and up to
one pair of endpoints. A node is the path of (protocol, canonical key) from its root, so the whole forest is one explode
of path prefixes and one hash aggregation with map-side partial sums; no join and no iteration. Hot nodes cost no more
than others since only counters are shuffled.

Direction 0 (A to B) holds where the first endpoint is not above the second by bytes; a layer without endpoints, or with
equal ones, is always A to B. A layer whose key has a null part forms no node and does not break the chain. first_seen is the
time of the creating packet, last_seen that of the latest by packet number: neither is a minimum or maximum.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import canonical_key, direction
from ..sources.tables import numbered, written


RANGE, RANGES, CROWDED = 1 << 17, 4096, 16  # fixed values: nodes that a range of packets should begin, most ranges, and when ranges are too uneven


@dataclass(frozen=True)
class Layer:
    """One layer of a table's rows: its protocol and the columns of its key."""

    protocol: str
    side_a: tuple[str, ...] = ()
    side_b: tuple[str, ...] = ()
    shared: tuple[str, ...] = ()
    rollups: dict[str, str] = field(default_factory=dict)


def layer_hits(rows: DataFrame, layers: list[Layer], packet_no: Column, ts: Column, size: Column, opaque: Column | None = None) -> DataFrame:
    """A row for each layer of each record that forms a node: path, dir, packet_no (a long), ts, size, opaque (of the innermost
    such layer only)."""
    names = [F.concat(F.lit(f"{x.protocol}:"), canonical_key(x)) for x in layers]
    base = rows.select(packet_no.alias("packet_no"), ts.alias("ts"), size.cast("long").alias("size"), (opaque if opaque is not None else F.lit(0)).cast("long").alias("opaque"), *[n.alias(f"n{i}") for i, n in enumerate(names)], *[direction(x).alias(f"d{i}") for i, x in enumerate(layers)])
    own = [F.col(f"n{i}") for i in range(len(layers))]
    last = lambda i: F.coalesce(*own[i + 1 :], F.lit(None).cast("string")).isNull()
    steps = [F.when(own[i].isNotNull(), F.struct(F.concat_ws("/", *own[: i + 1]).alias("path"), F.col(f"d{i}").alias("dir"), F.when(last(i), F.col("opaque")).otherwise(0).alias("opaque"))) for i in range(len(layers))]
    return base.select("packet_no", "ts", "size", F.explode(F.array(*steps)).alias("x")).filter("x is not null").select("x.path", "x.dir", "packet_no", "ts", "size", "x.opaque")


def packet_hits(dissected: DataFrame, packet_no: str = "packet_no") -> DataFrame:
    """The rows of layer_hits for dissected packets."""
    keyed = F.filter("layers", lambda x: x["key"].isNotNull())
    names = F.transform(keyed, lambda x: F.concat(x["protocol"], F.lit(":"), x["key"]))
    base = dissected.select(F.col(packet_no).alias("packet_no"), "ts", F.col("origlen").cast("long").alias("size"), F.col("opaque_len").cast("long").alias("opaque"), names.alias("names"), keyed["dir"].alias("dirs"))
    hits = base.select("*", F.posexplode("dirs").alias("depth", "dir"))
    inner = F.col("depth") == F.size("names") - 1
    return hits.select(F.array_join(F.slice("names", 1, F.col("depth") + 1), "/").alias("path"), "dir", "packet_no", "ts", "size", F.when(inner, F.col("opaque")).otherwise(0).alias("opaque"))


def of_path(path: Column) -> dict[str, Column]:
    """parent, depth, protocol and key of a path; keys are hexadecimal, so they hold no separator."""
    last = F.substring_index(path, "/", -1)
    return {
        "parent": F.when(F.length(path) > F.length(last), F.left(path, F.length(path) - F.length(last) - 1)),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int"), "protocol": F.substring_index(last, ":", 1), "key": F.substring_index(last, ":", -1),
    }


def streams(hits: DataFrame) -> DataFrame:
    """A row for each node, with counters for each direction, times and initiator. Only the path is a grouping key and all
    buffers are of fixed width, so Spark aggregates by hash, before the shuffle too; the rest of a node follows from its path."""
    per = lambda d, x: F.sum(F.when(F.col("dir") == d, x).otherwise(0)).cast("long")
    one = F.lit(1)
    out = hits.groupBy("path").agg(
        per(0, one).alias("packets_ab"), per(1, one).alias("packets_ba"), per(0, F.col("size")).alias("bytes_ab"), per(1, F.col("size")).alias("bytes_ba"), F.sum("opaque").cast("long").alias("opaque_bytes"),
        F.min("packet_no").alias("first_packet"), F.min_by("ts", "packet_no").alias("first_seen"), F.max_by("ts", "packet_no").alias("last_seen"), F.min_by("dir", "packet_no").alias("initiator"),
    )
    return out.withColumns(of_path(F.col("path"))).withColumns({"packets": F.col("packets_ab") + F.col("packets_ba"), "bytes": F.col("bytes_ab") + F.col("bytes_ba")})


def totals(nodes: DataFrame, packets: DataFrame, size: str = "origlen") -> DataFrame:
    """One row: packets and bytes seen, conversations made, and layers that lack a key field."""
    seen = packets.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("bytes"))
    return seen.crossJoin(nodes.agg(F.count(F.lit(1)).alias("streams_created")))  # two single rows


def with_children(nodes: DataFrame) -> DataFrame:
    """n_children added: direct children."""
    n = nodes.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(n, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def created_seq(nodes: DataFrame) -> DataFrame:
    """created_seq added: 0-based order of creation. nodes are read twice: a written table. Ranges of first_packet of one
    width are numbered each by a window on top of the counts before them, when the column is read; packet numbers with
    gaps that would fill a range beyond CROWDED times its share are sorted as a whole."""
    lo, hi, n = nodes.agg(F.min("first_packet"), F.max("first_packet"), F.count("first_packet")).first()
    if not n:
        return nodes.withColumn("created_seq", F.lit(0).cast("long"))
    share = max(RANGE, n // RANGES)
    width = max(1, -(-(hi - lo + 1) * share // n))
    at = F.floor((F.col("first_packet") - lo) / F.lit(width)).cast("int")
    sizes = dict(tuple(r) for r in nodes.groupBy(at.alias("at")).agg(F.count(F.lit(1))).collect())
    if max(sizes.values()) > CROWDED * share:
        return numbered(nodes, "created_seq", "first_packet", "depth")
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes)))]
    start = F.get(F.expr("array(" + ", ".join(f"{x}L" for x in before) + ")"), at)
    place = F.row_number().over(Window.partitionBy(at).orderBy("first_packet", "depth"))
    return nodes.withColumn("created_seq", start + place - 1)


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes of one (protocol, key) across parents as one row: sums, least first_seen, largest last_seen; and, where nodes
    have created_seq, the list of it."""
    sums = [F.sum(c).alias(c) for c in ("packets_ab", "packets_ba", "bytes_ab", "bytes_ba")]
    more = [F.sort_array(F.collect_list("created_seq")).alias("nodes")] if "created_seq" in nodes.columns else []
    return nodes.groupBy("protocol", "key").agg(*sums, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("n_nodes"), *more)


def summary(nodes: DataFrame) -> DataFrame:
    """Conversations ever made, those still open (closed is null, if nodes have it), packets and bytes of each protocol."""
    live = [F.count(F.when(F.col("closed").isNull(), 1)).alias("live")] if "closed" in nodes.columns else []
    return nodes.groupBy("protocol").agg(F.count(F.lit(1)).alias("ever"), *live, F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def layer_list(nodes: DataFrame, protocol: str) -> DataFrame:
    """The nodes of a protocol; order by created_seq."""
    return nodes.filter(F.col("protocol") == protocol)


def children(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("parent") == path)


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """ancestors added: (protocol, key) from the root to the parent."""
    up = F.split("path", "/")
    return nodes.withColumn("ancestors", F.transform(F.slice(up, 1, F.size(up) - 1), lambda x: F.struct(F.substring_index(x, ":", 1).alias("protocol"), F.substring_index(x, ":", -1).alias("key"))))


ORDERS = {"bytes": "bytes", "packets": "packets", "duration": "duration", "first_seen": None}


def sort_columns(by: str) -> list[Column]:
    """The total order of a view: largest first, ties by creation; first_seen is the order of creation itself."""
    if by not in ORDERS:
        raise ValueError(f"order {by}")
    made = [F.col("first_packet"), F.col("depth")]
    if by == "first_seen":
        return made
    return [F.desc(F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0))) if by == "duration" else F.desc(by), *made]


def sibling_rank(nodes: DataFrame, by: str = "bytes", ends: bool = False) -> DataFrame:
    """rank among siblings and, with ends, end, how many they are. Roots, which may be most of the forest, are numbered by a
    sort over ranges; children of one parent, which one task ranks, are as many as that parent's conversations."""
    below = nodes.filter("depth > 0").withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(*sort_columns(by))))
    top = nodes.filter("depth = 0")
    roots = numbered(top, "rank", *sort_columns(by)).withColumn("rank", (F.col("rank") + 1).cast("int"))
    if ends:
        below = below.withColumn("end", F.count(F.lit(1)).over(Window.partitionBy("parent")).cast("int"))
        roots = roots.withColumn("end", F.lit(top.count()))
    return below.unionByName(roots)


def tree(nodes: DataFrame, by: str = "bytes", most: int | None = None) -> DataFrame:
    """place (0, 1, ... in depth-first order), and last: whether the node is the last of its siblings. A node's sort key is
    the ranks along its path, four bytes each; a level takes it from the level above, so each node meets its parent alone."""
    slim = nodes.select("path", "parent", "depth", "bytes", "packets", "first_seen", "last_seen", "first_packet")
    step = F.unhex(F.lpad(F.hex("rank"), 8, "0"))
    ranked = written(sibling_rank(slim, by, True).select("path", "parent", "depth", (F.col("rank") == F.col("end")).alias("last"), step.alias("step")), "ranks")
    level = ranked.filter("depth = 0").select("path", "depth", "last", F.col("step").alias("at"))
    levels = level
    for d in range(1, (ranked.agg(F.max("depth")).first()[0] or 0) + 1):
        up = level.select(F.col("path").alias("parent"), F.col("at").alias("above"))
        level = ranked.filter(F.col("depth") == d).join(up, "parent", "left").select("path", "depth", "last", F.concat(F.coalesce("above", F.lit(b"")), "step").alias("at"))
        level = written(level, "level")
        levels = levels.unionByName(level)
    placed = numbered(levels, "place", "at")
    return placed.filter(F.col("place") < most) if most is not None else placed


def matches_with_ancestors(nodes: DataFrame, matches: Column) -> DataFrame:
    """Nodes for which the condition holds, and all their ancestors."""
    parts = F.split(F.col("path"), "/")
    up = nodes.filter(matches).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return nodes.join(up, "path", "left_semi")


def timeline(nodes: DataFrame, lanes: int = 64, bins: int = 800) -> DataFrame:
    """lane (null: the rest), bin and n: streams alive in each bin; the largest lanes - 1 by bytes have their own lane. A
    stream counts at its first bin and off behind its last one, and a running sum over at most lanes * bins rows does the rest."""
    lanes, bins = max(1, min(lanes, 512)), max(1, min(bins, 2048))
    slim = written(nodes.select("bytes", "first_packet", "depth", "first_seen", "last_seen"), "spans")
    lo, hi = slim.agg(F.min("first_seen"), F.max("last_seen")).first()
    if lo is None:
        return nodes.select(F.lit(None).cast("long").alias("lane"), F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    span = max(1, hi - lo)
    at = lambda c: F.least(F.floor((F.col(c) - lo) * bins / span), F.lit(bins - 1)).cast("long")
    top = slim.orderBy(*sort_columns("bytes")).limit(lanes - 1).select(F.col("first_packet").alias("lane"), "depth")
    own = slim.join(F.broadcast(top), (slim["first_packet"] == top["lane"]) & (slim["depth"] == top["depth"]), "left")  # at most 511 rows
    ends = own.select("lane", F.explode(F.array(F.struct(at("first_seen").alias("bin"), F.lit(1).alias("d")), F.struct((F.greatest(at("first_seen"), at("last_seen")) + 1).alias("bin"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("lane", "x.bin").agg(F.sum("x.d").cast("long").alias("d"))
    w = Window.partitionBy("lane").orderBy("bin")
    runs = steps.withColumns({"n": F.sum("d").over(w), "next": F.lead("bin").over(w)}).filter("n > 0")
    return runs.select("lane", F.explode(F.sequence("bin", F.col("next") - 1)).alias("bin"), "n")
