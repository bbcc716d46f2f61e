"""Bytes to layers: each packet is walked from its link layer inwards until nothing claims what is left.

A narrow map in Arrow batches: no shuffle, and memory of one batch. Ethernet, IPv4 and TCP or UDP without options and with
ports that nobody claims, most of any traffic, are read a batch at a time in numpy (Usual); all else is walked. A walk ends as complete (no bytes left), terminal (the
last layer says so), unclaimed_route, truncated, plugin_error (claimed, but no header) or depth_cap. A null packet or link
type counts as empty or unclaimed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.protocols import DEPTHS, PROTOCOLS, Malformed, Protocol, Truncated, ethertype, routes
from ..sources.tables import written

#: The class of each reason.
STOP_CLASSES = {"complete": "clean", "terminal": "clean", "unclaimed_route": "unknown_payload", "unknown_hint": "unknown_payload", "truncated": "malformed", "plugin_error": "malformed", "depth_cap": "suspicious"}
CLASSES = ["clean", "unknown_payload", "malformed", "suspicious"]
MAX_LAYERS = 32
LIKELY, EXPECTED, NEAR, SAMPLE = 50, 15, 5, 256  # fixed values: least score of a guess, what a likely predecessor adds, near misses and bytes kept
LAYER = "struct<protocol string, offset int, header_len int, key string, dir int, guessed boolean, fields array<struct<name string, num long, raw binary, text string>>>"
_FIELD = pa.struct([("name", pa.string()), ("num", pa.int64()), ("raw", pa.binary()), ("text", pa.string())])
_LAYER = pa.struct([("protocol", pa.string()), ("offset", pa.int32()), ("header_len", pa.int32()), ("key", pa.string()), ("dir", pa.int32()), ("guessed", pa.bool_()), ("fields", pa.list_(_FIELD))])
NEAR_MISSES = "array<struct<protocol string, score int>>"


def _field(name: str, x) -> dict:
    """Lists are shown as text, their items joined by commas."""
    if isinstance(x, list):
        x = ",".join(i.hex() if isinstance(i, bytes) else str(i) for i in x)
    return {"name": name, "num": (x if x < 1 << 63 else x - (1 << 64)) if isinstance(x, int) else None, "raw": x if isinstance(x, bytes) else None, "text": x if isinstance(x, str) else None}


def scores(buf: bytes, table: dict[str, Protocol], before: str | None) -> list[tuple[int, Protocol]]:
    """What each protocol's probe gives, best first, ties in order of registration."""
    known = [p for r, p in table.items() if r.startswith("name:") and p.probe]
    got = [(min(100, n + EXPECTED * (before in p.expected)), p) for p in known if (n := p.probe(buf)) > 0]
    return sorted(got, key=lambda x: -x[0])


def walk(buf: bytes, link_type: int | None, table: dict[str, Protocol], most: int = MAX_LAYERS, depth: str = "full", guess: bool = False, entry: str | None = None, until: str | None = None) -> tuple[list[dict], str, str | None, int]:
    """Layers, the reason to stop, the route that nothing claims, and the number of bytes left. entry names the first
    protocol instead of the link type; guess allows probes where a header says that anything may follow, or nothing claims
    the link type; until stops after that protocol."""
    at, layers, before = 0, [], []
    wanted = [f"name:{entry}" if entry else f"link:{link_type}"]
    while at < len(buf):
        here, last = buf[at:], before[-1][0] if before else None
        if not wanted or last is not None and last == until:
            return layers, "terminal", None, len(here)
        if len(layers) == most:
            return layers, "depth_cap", None, len(here)
        able, guessed = [table[r] for r in wanted if r in table], False
        if not able:
            named = wanted[0].removeprefix("name:")
            route = None if wanted == ["unknown"] else f"custom:{named}:0" if wanted[0].startswith("name:") else wanted[0]
            able = [p for n, p in scores(here, table, last) if n >= LIKELY] if guess and (route is None or not layers) else []
            guessed = True
            if not able:
                return layers, "unclaimed_route" if route else "unknown_hint", route, len(here)
        failed = None
        for p in able:
            try:
                v, size = p.parse(here, before)
                if size > len(here):
                    raise Malformed(f"{p.name}: header of {size} bytes")
                break
            except (Malformed, Truncated) as e:
                failed = e
        else:
            if guessed:
                return layers, "unclaimed_route" if wanted != ["unknown"] else "unknown_hint", None if wanted == ["unknown"] else wanted[0], len(here)
            return layers, "truncated" if len(wanted) == 1 and isinstance(failed, Truncated) else "plugin_error", None, len(here)
        key, way = p.key(v) or (None, None)
        shown = [] if depth == "none" else [_field(n, x) for n, x in p.shown(v, depth).items()]
        layers.append({"protocol": p.name, "offset": at, "header_len": size, "key": key, "dir": way, "guessed": guessed, "fields": shown})
        before.append((p.name, v))
        at, wanted = at + size, p.after(v)
    return layers, "complete", None, 0


_HEX = np.array([list(f"{i:02X}".encode()) for i in range(256)], dtype=np.uint8)
_START = (0, 14, 34)  # fixed values: where the usual headers begin


@dataclass(frozen=True)
class Usual:
    """The rows of a batch that are one usual chain: their places, headers, how many bytes are left, and their last port."""

    chain: tuple[Protocol, ...]
    rows: np.ndarray
    head: np.ndarray
    left: np.ndarray

    def number(self, at: int, first: int, bits: int) -> np.ndarray:
        """A field of bits of the header that begins at `at`."""
        a, z = first // 8, (first + bits + 7) // 8
        out = np.zeros(len(self.rows), dtype=np.int64)
        for i in range(a, z):
            out = out << 8 | self.head[:, at + i]
        return out >> (8 * z - first - bits) & ((1 << bits) - 1)

    def key(self, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The canonical keys of a layer, as rows of characters, and the directions."""
        p, at = self.chain[layer], _START[layer]
        if p.pair[0] in p.raw:
            sides = [(at + p.raw[n][0], p.raw[n][1]) for n in p.pair]
            mark = f"00{sides[0][1]:04X}"
        else:
            sides = [(at + p.bits[n][0] // 8, p.bits[n][1] // 8) for n in p.pair]
            mark = "01" + "0" * (16 - 2 * sides[0][1])
        a, b = (self.head[:, x : x + k] for x, k in sides)
        numbers = [np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)]
        for i in range(a.shape[1]):
            numbers = [n << 8 | side[:, i] for n, side in zip(numbers, (a, b))]
        down = numbers[0] > numbers[1]
        lead = np.broadcast_to(np.frombuffer(mark.encode(), dtype=np.uint8), (len(a), len(mark)))
        text = [_HEX[x].reshape(len(a), -1) for x in (np.where(down[:, None], b, a), np.where(down[:, None], a, b))]
        return np.hstack([lead, text[0], lead, text[1]]), down.astype(np.int32)

    def routes(self) -> pa.Array:
        """The route that nobody claims, of rows with bytes left."""
        port = pa.array(self.number(_START[2], *self.chain[2].bits["dst_port"])).cast(pa.string())
        named = pc.binary_join_element_wise(pa.scalar(f"{self.chain[2].name}_port"), port, ":")
        return pc.if_else(pa.array(self.left > 0), named, pa.scalar(None, pa.string()))


def usual_of(table: dict[str, Protocol], most: int, entry: str | None, until: str | None) -> dict | None:
    """What Usual rests on: that the standard protocols have their routes and nothing else was asked for; and the ports that
    are claimed."""
    own = {p.name: p for p in PROTOCOLS}
    needed = {"link:1": "ethernet", ethertype(0x0800): "ipv4", "ip_protocol:6": "tcp", "ip_protocol:17": "udp"}
    if entry or until or most <= 3 or any(table.get(r) is not own[n] for r, n in needed.items()):
        return None
    claimed = {n: np.array([int(r.split(":")[1]) for r in table if r.startswith(f"{n}_port:")], dtype=np.int64) for n in ("tcp", "udp")}
    return {number: ((own["ethernet"], own["ipv4"], own[n]), own[n].least, claimed[n]) for number, n in ((6, "tcp"), (17, "udp"))}


def split(data: pa.Array, links: pa.Array, usual: dict | None) -> tuple[list[Usual], np.ndarray]:
    """The usual rows of a batch, and the places of the others."""
    rest = np.ones(len(data), dtype=bool)
    found = []
    if usual and len(data):
        data = data.cast(pa.large_binary())
        _, places, raw = data.buffers()
        at = np.frombuffer(places, dtype=np.int64)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        size = np.where(data.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
        ethernet = pc.fill_null(pc.equal(links, 1), False).to_numpy(zero_copy_only=False)
        for number, (chain, least, claimed) in usual.items():
            whole = _START[2] + least
            rows = np.flatnonzero(ethernet & (size >= whole))
            if not len(rows):
                continue
            part = at[rows]
            byte = lambda i: raw[part + i]  # noqa: B023, E731
            same = (byte(12) == 8) & (byte(13) == 0) & (byte(14) == 0x45) & (byte(20) & 0x1F == 0) & (byte(21) == 0) & (byte(23) == number)
            if number == 6:
                same &= byte(46) >> 4 == 5
            rows = rows[same]
            one = Usual(chain, rows, raw[at[rows][:, None] + np.arange(whole)], size[rows] - whole)
            ports = [one.number(_START[2], *chain[2].bits[n]) for n in chain[2].pair]
            free = (one.left == 0) | ~(np.isin(ports[0], claimed) | np.isin(ports[1], claimed))
            if free.any():
                found.append(Usual(chain, rows[free], one.head[free], one.left[free]))
                rest[rows[free]] = False
    return found, np.flatnonzero(rest)


def _texts(parts: list[np.ndarray]) -> pa.Array:
    """The rows of matrices of characters as strings: row by row, a string a matrix."""
    n, widths = len(parts[0]), [p.shape[1] for p in parts]
    ends = np.concatenate([[0], np.cumsum(np.tile(widths, n))]).astype(np.int32)
    return pa.StringArray.from_buffers(n * len(parts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(np.hstack(parts))))


def _layers(u: Usual, depth: str) -> pa.Array:
    """The layers of usual rows as dissect gives them."""
    n, keys = len(u.rows), [u.key(i) for i in range(3)]
    names, counts, numbers, known, widths, raw = [], [], [], [], [], [np.zeros((n, 0), dtype=np.uint8)]
    for p, at in zip(u.chain, _START):
        shown = list(p.shown(dict.fromkeys([*p.raw, *p.bits]), depth)) if depth != "none" else []
        names += shown
        counts.append(len(shown))
        for x in shown:
            known.append(x in p.bits)
            numbers.append(u.number(at, *p.bits[x]) if x in p.bits else np.zeros(n, dtype=np.int64))
            widths.append(0 if x in p.bits else p.raw[x][1])
            raw += [] if x in p.bits else [u.head[:, at + p.raw[x][0] : at + sum(p.raw[x])]]
    every = np.tile(known, n).astype(bool)
    ends = np.concatenate([[0], np.cumsum(np.tile(widths, n))]).astype(np.int32)
    fields = pa.StructArray.from_arrays([
        pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(len(names)), n))), pa.array(np.stack(numbers, 1).ravel() if numbers else [], pa.int64(), mask=~every),
        pa.Array.from_buffers(pa.binary(), len(every), [pa.py_buffer(np.packbits(~every, bitorder="little")), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(np.hstack(raw)))]), pa.nulls(len(every), pa.string()),
    ], fields=list(_FIELD))
    three = lambda x, kind: pa.array(np.tile(x, n), kind)
    layers = pa.StructArray.from_arrays([
        pa.array([p.name for p in u.chain]).take(three(np.arange(3), pa.int64())), three(np.array(_START), pa.int32()), three(np.array([p.least for p in u.chain]), pa.int32()), _texts([k for k, _ in keys]),
        pa.array(np.stack([d for _, d in keys], 1).ravel(), pa.int32()), three(np.zeros(3, dtype=bool), pa.bool_()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.tile(counts, n))]), pa.int32()), fields),
    ], fields=list(_LAYER))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 3, pa.int32()), layers)


def _near(tails: list[bytes | None], last: list[str | None], table: dict[str, Protocol]) -> pa.Array:
    """The best scores of the probes on each tail that is there; equal tails are tried once."""
    place, seen, at = {}, [], []
    for t, before in zip(tails, last):
        if t is not None and (t, before) not in place:
            place[t, before] = len(seen)
            seen.append([{"protocol": p.name, "score": n} for n, p in scores(t, table, before)[:NEAR]])
        at.append(None if t is None else place[t, before])
    return pa.array(seen, pa.list_(pa.struct([("protocol", pa.string()), ("score", pa.int32())]))).take(pa.array(at, pa.int64()))


def _mapped(packets: DataFrame, emit: Callable, schema: str, table: dict[str, Protocol], most: int, depth: str, guess: bool, entry: str | None, until: str | None) -> DataFrame:
    """packets with what emit makes of each batch, its usual rows, and the places and walks of its others."""
    usual = usual_of(table, most, entry, until)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, links = (b.column(b.schema.names.index(c)) for c in ("data", "link_type"))
            found, rest = split(data, links, usual)
            others = pa.array(rest, pa.int64())
            out = [walk(d or b"", t, table, most, depth, guess, entry, until) for d, t in zip(data.take(others).to_pylist(), links.take(others).to_pylist())]
            yield emit(b, found, rest, out)

    return packets.mapInArrow(work, schema)


def dissect(packets: DataFrame, add: dict[str, str] | None = None, remove: tuple[str, ...] = (), most: int = MAX_LAYERS, depth: str = "full", guess: bool = False, entry: str | None = None, until: str | None = None, diagnose: bool = False, protocols: list[Protocol] | None = None) -> DataFrame:
    """packets (packet_no, ts, origlen, link_type, data and any others) without data, with layers, stop, stop_class, route
    (that nothing claims) and opaque_len. depth says which fields are taken out: none, keys, structural or full; keys and
    directions are always there. With diagnose, payload that nothing claims behind a layer has near_misses (the best probe
    scores) and sample (its first bytes)."""
    if depth not in DEPTHS:
        raise ValueError(f"depth {depth}")
    table = routes(protocols, add, remove)
    kept = [c for c in packets.columns if c != "data"]
    more = ["near_misses", "sample"] if diagnose else []

    def emit(b: pa.RecordBatch, found: list[Usual], rest: np.ndarray, out: list) -> pa.RecordBatch:
        back = pa.array(np.argsort(np.concatenate([*[u.rows for u in found], rest])))
        whole = lambda usual, walked: pa.concat_arrays([*[usual(u) for u in found], walked]).take(back)
        stop = whole(lambda u: pa.array(["complete", "unclaimed_route"]).take(pa.array((u.left > 0).astype(np.int64))), pa.array([o[1] for o in out], pa.string()))
        classes = pa.array(list(STOP_CLASSES.values())).take(pc.index_in(stop, pa.array(list(STOP_CLASSES))))
        cols = [b.column(b.schema.names.index(c)) for c in kept]
        cols += [whole(lambda u: _layers(u, depth), pa.array([o[0] for o in out], pa.list_(_LAYER))), stop, classes, whole(Usual.routes, pa.array([o[2] for o in out], pa.string())), whole(lambda u: pa.array(u.left, pa.int32()), pa.array([o[3] for o in out], pa.int32()))]
        if diagnose:
            lost = pc.and_(pc.equal(classes, "unknown_payload"), pc.greater(pc.list_value_length(cols[len(kept)]), 0)).to_pylist()
            last = whole(lambda u: pa.array([u.chain[2].name] * len(u.rows), pa.string()), pa.array([o[0][-1]["protocol"] if o[0] else None for o in out], pa.string())).to_pylist()
            data, left = b.column(b.schema.names.index("data")).to_pylist(), cols[-1].to_pylist()
            tails = [d[len(d) - n :] if x else None for d, n, x in zip(data, left, lost)]
            cols += [_near(tails, last, table), pa.array([t if t is None else t[:SAMPLE] for t in tails], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=[*kept, "layers", "stop", "stop_class", "route", "opaque_len", *more])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema if f.name != "data")
    schema = f"{schema}, layers array<{LAYER}>, stop string, stop_class string, route string, opaque_len int" + (f", near_misses {NEAR_MISSES}, sample binary" if diagnose else "")
    return _mapped(packets, emit, schema, table, most, depth, guess, entry, until)


def hits(packets: DataFrame) -> DataFrame:
    """forest.packet_hits of the packets' dissection, made in the worker that dissects: no nested rows in between."""
    table = routes()

    def emit(b: pa.RecordBatch, found: list[Usual], rest: np.ndarray, out: list) -> pa.RecordBatch:
        texts, ways, opaque, rows = [], [], [], []
        for u in found:
            keys = [u.key(i) for i in range(3)]
            n = len(u.rows)
            path = [np.hstack([np.broadcast_to(np.frombuffer(f"{'/' if i else ''}{p.name}:".encode(), dtype=np.uint8), (n, len(p.name) + (2 if i else 1))), k]) for i, (p, (k, _)) in enumerate(zip(u.chain, keys))]
            texts.append(_texts([np.hstack(path[: i + 1]) for i in range(3)]))
            ways.append(np.stack([d for _, d in keys], 1).ravel())
            opaque.append(np.stack([np.zeros_like(u.left), np.zeros_like(u.left), u.left], 1).ravel())
            rows.append(np.repeat(u.rows, 3))
        walked = []
        for i, (layers, _, _, left) in zip(rest.tolist(), out):
            keyed = [x for x in layers if x["key"] is not None]
            names = [f"{x['protocol']}:{x['key']}" for x in keyed]
            walked += [("/".join(names[: k + 1]), x["dir"], left if k == len(keyed) - 1 else 0, i) for k, x in enumerate(keyed)]
        texts.append(pa.array([w[0] for w in walked], pa.string()))
        for held, k in ((ways, 1), (opaque, 2), (rows, 3)):
            held.append(np.array([w[k] for w in walked], dtype=np.int64))
        at = pa.array(np.concatenate(rows), pa.int64())
        own = {c: b.column(b.schema.names.index(c)).take(at) for c in ("packet_no", "ts", "origlen")}
        return pa.RecordBatch.from_arrays([pa.concat_arrays(texts), pa.array(np.concatenate(ways), pa.int32()), own["packet_no"], own["ts"], own["origlen"].cast(pa.int64()), pa.array(np.concatenate(opaque), pa.int64())], names=["path", "dir", "packet_no", "ts", "size", "opaque"])

    kind = dict(packets.dtypes)
    return _mapped(packets, emit, f"path string, dir int, packet_no {kind['packet_no']}, ts {kind['ts']}, size long, opaque long", table, MAX_LAYERS, "none", False, None, None)


def stop_summary(dissected: DataFrame) -> DataFrame:
    return dissected.groupBy("stop_class", "stop").agg(F.count(F.lit(1)).alias("packets"))


def unclaimed(dissected: DataFrame) -> DataFrame:
    """Groups of payload that nothing claims, by the protocol before it and the route asked for."""
    rows = dissected.filter("stop_class = 'unknown_payload'").select(F.try_element_at("layers.protocol", F.lit(-1)).alias("predecessor"), "route", F.col("opaque_len").cast("long").alias("size"), "ts")
    return rows.groupBy("predecessor", "route").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes_total"), F.min("size").alias("bytes_min"), F.max("size").alias("bytes_max"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def unknown_registry(dissected: DataFrame, samples: int = 5, endpoints: int = 64, max_groups: int | None = None) -> DataFrame:
    """Groups of diagnosed payload (dissect with diagnose): the counts of unclaimed, the first distinct endpoints (protocol
    and key of the innermost conversation), whether there were more, the near misses with the best top score (the latest of
    equal ones) and the last samples. max_groups keeps the groups seen last; without it none goes."""
    at = F.col("packet_no")
    keyed = F.filter("layers", lambda x: x["key"].isNotNull())
    inner = F.try_element_at(keyed, F.lit(-1))
    rows = dissected.filter("sample is not null").select(
        F.try_element_at("layers.protocol", F.lit(-1)).alias("predecessor"), "route", F.col("opaque_len").cast("long").alias("size"), "ts", at.alias("packet_no"), "near_misses", "sample",
        F.when(F.size(keyed) > 0, F.concat_ws(":", inner["protocol"], inner["key"])).alias("endpoint"),
    )
    rows = written(rows, "unknown")  # three aggregations read it
    group = ["predecessor", "route"]
    same = lambda a, b: F.col(f"{a}.predecessor").eqNullSafe(F.col(f"{b}.predecessor")) & F.col(f"{a}.route").eqNullSafe(F.col(f"{b}.route"))
    best = F.coalesce(F.try_element_at("near_misses.score", F.lit(1)), F.lit(0))
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes_total"), F.min("size").alias("bytes_min"), F.max("size").alias("bytes_max"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("near_misses", F.struct(best, "packet_no")).alias("near_misses"))
    last = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("packet_no")))).filter(F.col("place") <= samples)
    last = last.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("packet_no", "sample"))), lambda x: x["sample"]).alias("samples"))
    seen = rows.filter("endpoint is not null").groupBy(*group, "endpoint").agg(F.min("packet_no").alias("packet_no"))
    met = seen.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("packet_no"))).filter(F.col("place") <= endpoints + 1)
    met = met.groupBy(*group).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("packet_no", "endpoint"))), 1, endpoints), lambda x: x["endpoint"]).alias("endpoints"), (F.count(F.lit(1)) > endpoints).alias("overflow"))
    out = counts.alias("c").join(last.alias("l"), same("c", "l"), "left").join(met.alias("m"), same("c", "m"), "left").select("c.*", "l.samples", "m.endpoints", F.coalesce("m.overflow", F.lit(False)).alias("overflow"))
    return out.orderBy(F.desc("last_seen")).limit(max_groups) if max_groups else out


def unknown_table(groups: DataFrame, min_count: int = 1, top: int | None = None) -> DataFrame:
    """The groups with at least min_count packets, most first, then by route and predecessor, nulls first."""
    out = groups.filter(F.col("n") >= min_count).orderBy(F.desc("n"), F.asc_nulls_first("predecessor"), F.asc_nulls_first("route"))
    return out.limit(top) if top is not None else out
