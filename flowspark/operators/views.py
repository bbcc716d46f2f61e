"""What a reader of the forest sees: records, row windows, the tree as text, selection, JSON documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rendering
from ..functions.protocols import Protocol, standard
from ..sources.tables import written
from . import forest

Identity = tuple[tuple[str, ...], list[tuple[str, str]], dict[str, int | None]]  # shared fields, pairs of fields, and what is known of their parts (rendering.Known)
PAGE, PAGE_MOST, GATE, FRAME = 200, 500, 20_000, 40  # fixed values: rows of a page, of one document, and tree lines of a live frame


def identities(source: list) -> dict[str, Identity]:
    """Which fields the keys of forest layers or of protocols hold. Layers have numbers; a protocol declares its fields of
    bits and of bytes, and what it reads or adds itself is known from the key alone."""
    out = {}
    for x in source:
        if isinstance(x, Protocol):
            shared = ("app",) if x.app else x.shared
            declared = {} if x.read or x.app else {n: None for n in x.bits} | {n: k for n, (_, k) in x.raw.items()}
            own = (*shared, *(x.pair or ()))
            out[x.name] = (shared, [x.pair] if x.pair else [], declared if all(n in declared for n in own) and not (x.shared and x.extra) else {})
        else:
            out[x.protocol] = (x.shared, list(zip(x.side_a, x.side_b)), dict.fromkeys((*x.shared, *x.side_a, *x.side_b)))
    return out


def records(nodes: DataFrame, source: list | None = None, states: DataFrame | None = None, rollups: DataFrame | None = None, second: int = 1_000_000) -> DataFrame:
    """nodes with what the filter language and the views read: second (time units of a second), id, n_children, key_fields, endpoints, ports (of the node and
    all above it), ancestors, state, closed, and rollups, an array of (name, text, num). states has path, state and closed;
    rollups has path, name, text, num. The nodes are written once; all that is added follows from them when it is read, so
    a view pays for the columns that it asks for only."""
    nodes = written(nodes.withColumn("second", F.lit(second)), "nodes")
    there = {r.protocol for r in nodes.select("protocol").distinct().collect()}  # at most as many as are registered
    own = {n: i for n, i in identities(standard() if source is None else source).items() if n in there}
    out = forest.with_ancestors(forest.with_children(nodes if "created_seq" in nodes.columns else forest.created_seq(nodes))).withColumn("id", F.col("created_seq"))
    kind = "array<struct<name:string,text:string,num:double>>"
    fields = lambda i: rendering.known_fields(F.col("key"), F.col("initiator"), *i) if i[2] else rendering.key_fields(rendering.key_parts(F.col("key")), F.col("initiator"), *i[:2])
    out = out.withColumn("key_fields", _per_protocol(own, lambda i: F.array(*fields(i)).cast(kind), F.array().cast(kind)))
    out = out.withColumn("endpoints", _per_protocol(own, lambda i: rendering.endpoints(fields(i), *i[:2]), F.lit("")))
    ports = lambda fields: F.transform(F.filter(fields, lambda f: F.endswith(f["name"], F.lit("port")) & f["num"].isNotNull()), lambda f: f["num"])
    upper = F.flatten(F.transform("ancestors", lambda a: _ports_of(own, a)))
    out = out.withColumn("ports", F.concat(ports(F.col("key_fields")), upper))
    if states is not None:
        out = out.join(states.select("path", "state", F.col("closed").alias("__closed")), "path", "left").withColumn("closed", F.when(F.col("__closed"), F.lit("protocol_close"))).drop("__closed")
    for c in ("state", "closed"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    if rollups is not None:
        held = rollups.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "text", F.col("num").cast("double").alias("num")))).alias("rollups"))  # bounded by the caps
        return out.join(held, "path", "left").withColumn("rollups", F.coalesce("rollups", F.array().cast(kind)))
    return out.withColumn("rollups", F.array().cast(kind))


def _per_protocol(own: dict[str, Identity], make, other: Column) -> Column:
    out = other
    for name, identity in own.items():
        if identity[0] or identity[1]:
            out = F.when(F.col("protocol") == name, make(identity)).otherwise(out)
    return out


def _ports_of(own: dict[str, Identity], a: Column) -> Column:
    """The port numbers in an ancestor's key."""
    out = F.array().cast("array<double>")
    for name, (shared, sides, _) in own.items():
        places = [i for i, n in enumerate(shared) if n.endswith("port")] + [len(shared) + j + k for k, (x, y) in enumerate(sides) if x.endswith("port") for j in (0, len(sides))]
        if places:
            found = F.transform(F.slice(rendering.key_parts(a["key"]), min(places) + 1, max(places) - min(places) + 1), lambda p: rendering.part_struct("port", p)["num"])
            out = F.when(a["protocol"] == name, found).otherwise(out)
    return out


def window(view: DataFrame, scope: str = "flat", by: str = "bytes", ascending: bool = False, offset: int = 0, limit: int = PAGE, where=None, parent: str | None = None) -> tuple[DataFrame, int, int | None]:
    """Rows offset to offset + limit of a scope (flat, roots, or children of parent), how many the scope has and how many
    match. Tree scopes keep the ancestors of matches, flat keeps matches only; ascending turns the whole order round."""
    limit, offset = max(1, min(limit, PAGE_MOST)), max(0, offset)
    part = {"flat": F.lit(True), "roots": F.col("depth") == 0, "children": F.col("parent").eqNullSafe(F.lit(parent))}[scope]
    rows = view.filter(part)
    total, matched = rows.count(), None
    if where is not None:
        matched = where.filter(view).count()
        rows = where.filter(rows) if scope == "flat" else forest.matches_with_ancestors(view, where.column).filter(part)
    order = forest.sort_columns(by)
    if ascending:
        names = {"bytes": F.col("bytes"), "packets": F.col("packets"), "duration": F.greatest(F.col("last_seen") - F.col("first_seen"), F.lit(0))}
        order = [*([names[by].asc()] if by in names else []), F.desc("first_packet"), F.desc("depth")]
    return rows.orderBy(*order).offset(offset).limit(limit), total, matched


def full_forest(view: DataFrame) -> DataFrame:
    """The whole forest, where it fits in one document."""
    if view.limit(GATE + 1).count() > GATE:
        raise ValueError(f"more than {GATE} streams: ask for a window")
    return view.orderBy("created_seq")


def tree_lines(view: DataFrame, by: str = "bytes", most: int | None = None) -> DataFrame:
    """place and line of each node in depth-first order, drawn with branches."""
    placed = forest.tree(view, by, most)
    own = placed.join(view.select("path", "protocol", "id", "endpoints", "packets", "bytes", "state"), "path")
    parts = F.split("path", "/")
    ups = placed.select(F.col("path").alias("up"), F.col("last").alias("end"), F.col("depth").alias("level"))
    above = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).join(ups, "up").filter("level > 0")
    bars = above.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("level", "end"))).alias("ends"))
    inner = lambda e: F.array_join(F.transform(F.slice(e, 1, F.size(e) - 1), lambda x: F.when(x["end"], "   ").otherwise("│  ")), "")
    glyph = F.coalesce(F.concat(inner(F.col("ends")), F.when(F.element_at("ends", -1)["end"], "└─ ").otherwise("├─ ")), F.lit(""))
    text = F.concat_ws(" ", F.col("protocol"), F.concat(F.lit("#"), F.col("id")), F.nullif(F.col("endpoints"), F.lit("")), F.concat(F.col("packets"), F.lit(" pkts")), rendering.si_bytes(F.col("bytes")), F.when(F.col("state").isNotNull(), F.concat(F.lit("["), F.col("state"), F.lit("]"))))
    return own.join(bars, "path", "left").select("place", F.concat(glyph, text).alias("line"))


def frame(view: DataFrame, most: int = FRAME) -> list[str]:
    """The first lines of the tree for a live display, and how many more there are."""
    n = view.count()
    lines = [r.line for r in tree_lines(view, most=most).orderBy("place").collect()]
    return lines + ([f"… and {n - most} more"] if n > most else [])


def lineage(view: DataFrame) -> DataFrame:
    """path and lineage: the protocols and endpoints from the root to the node."""
    parts = F.split("path", "/")
    up = view.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))).alias("x"))
    name = F.concat_ws(" ", F.col("protocol"), F.concat(F.lit("#"), F.col("id")), F.when(F.col("endpoints") != "", F.concat(F.lit("("), F.col("endpoints"), F.lit(")"))))
    named = view.select(F.col("path").alias("up"), name.alias("name"))
    return up.join(named, F.col("x.up") == F.col("up")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.n", "name"))), lambda x: x["name"]), " ▸ ").alias("lineage"))


def select(view: DataFrame, selector: str) -> DataFrame:
    """One stream: #id, or a protocol and two endpoints in any order; addr:port also needs the address above. Several or
    none are an error that lists them."""
    words = selector.split()
    if len(words) == 1 and words[0].startswith("#") and words[0][1:].isdigit():
        found = view.filter(F.col("id") == int(words[0][1:]))
    elif len(words) == 3:
        found = view.filter(F.lower("protocol") == words[0].lower())
        for w in words[1:]:
            address, _, port = w.rpartition(":") if w.count(":") == 1 else ("", "", "")
            own = lambda t: F.exists("key_fields", lambda f: f["text"] == t)
            if port:
                has = own(port)
                if address:
                    up = view.filter(F.exists("key_fields", lambda f: f["text"] == address)).select(F.col("path").alias("up"))  # noqa: B023
                    found = found.filter(has).join(up, F.startswith(F.col("path"), F.concat(F.col("up"), F.lit("/"))), "left_semi")
                else:
                    found = found.filter(has)
            else:
                found = found.filter(own(w))
    else:
        raise ValueError("a selector is #id, or a protocol and two endpoints")
    some = found.limit(10).collect()
    if len(some) != 1:
        raise ValueError(f"{selector}: " + ("no such stream" if not some else "several: " + ", ".join(f"#{r.id} {r.protocol} {r.endpoints}" for r in some)))
    return found


def search(view: DataFrame, where) -> tuple[DataFrame, DataFrame, int]:
    """Matches, matches with their ancestors, and how many match."""
    matches = where.filter(view).select("id", "path")
    return matches, forest.matches_with_ancestors(view, where.column).select("id", "path"), matches.count()


def json_records(view: DataFrame) -> DataFrame:
    """id and the JSON text of each stream."""
    direction = lambda d: F.struct(F.col(f"packets_{d}").alias("packets"), F.col(f"bytes_{d}").alias("bytes"))
    fields = F.map_from_entries(F.transform("key_fields", lambda f: F.struct(f["name"], f["text"])))
    return view.select("id", F.to_json(F.struct(
        "id", "protocol", "depth", F.col("parent").alias("parent_path"), fields.alias("key"), "endpoints", F.when(F.col("initiator") == 0, "a_to_b").otherwise("b_to_a").alias("initiator"), direction("ab").alias("a_to_b"), direction("ba").alias("b_to_a"),
        "opaque_bytes", rendering.rfc3339(F.col("first_seen")).alias("first_seen"), rendering.rfc3339(F.col("last_seen")).alias("last_seen"), "state", "closed", F.col("n_children").alias("children"), "rollups",
    )).alias("json"))


def document(view: DataFrame, source: str, mode: str = "offline") -> DataFrame:
    """One row with one JSON document: mode, source, summary and streams in order of creation; for forests below the gate."""
    streams = json_records(full_forest(view)).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "json"))), lambda x: x["json"]), ","), F.lit("]")).alias("streams"))
    totals = forest.summary(view).agg(F.to_json(F.array_sort(F.collect_list(F.struct("protocol", "ever", "packets", "bytes")))).alias("protocols"))
    head = F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(source).alias("source")))
    return streams.crossJoin(totals).select(F.concat(F.regexp_replace(head, "}$", ""), F.lit(',"summary":'), "protocols", F.lit(',"streams":'), "streams", F.lit("}")).alias("document"))  # two single rows


def packet_records(dissected: DataFrame) -> DataFrame:
    """index and the JSON line of each packet."""
    return dissected.select(F.col("packet_no").alias("index"), F.to_json(F.struct(F.col("packet_no").alias("index"), F.col("layers.protocol").alias("layers"), "stop", "stop_class", F.col("origlen").alias("length"), "opaque_len")).alias("json"))


def packet_lines(dissected: DataFrame) -> DataFrame:
    """index and the text line of each packet: time, layers, length and why it stopped."""
    chain = F.array_join("layers.protocol", " ▸ ")
    return dissected.select(F.col("packet_no").alias("index"), F.concat_ws(" ", F.col("packet_no").cast("string"), rendering.time_of_day(F.col("ts")), chain, F.concat(F.col("origlen"), F.lit(" B")), F.concat(F.lit("["), F.col("stop"), F.lit("]"))).alias("line"))


def summary_text(totals: dict, stops: dict[str, int], protocols: list[tuple[str, int]]) -> str:
    """The closing summary of a run."""
    lines = [f"{totals['packets']:,} packets, {totals['bytes']:,} bytes, {totals['streams_created']:,} streams"]
    lines += ["stops: " + ", ".join(f"{k} {v:,}" for k, v in sorted(stops.items()))] if stops else []
    return "\n".join(lines + [f"  {p}: {n:,}" for p, n in sorted(protocols)])


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and event: stream_new, stream_update (more packets) or stream_closed between two snapshots."""
    a = before.select("path", F.col("packets").alias("old"), F.col("closed").alias("was"))
    b = after.select("path", "packets", "closed")
    event = F.when(F.col("old").isNull(), "stream_new").when(F.col("closed").isNotNull() & F.col("was").isNull(), "stream_closed").when(F.col("packets") > F.col("old"), "stream_update")
    return b.join(a, "path", "left").select("path", event.alias("event")).filter("event is not null")
