"""The engine as a whole: a registry is built once, captures become a forest, and a forest answers questions.

    engine = Engine.standard().route("udp_port:9", "vxlan").build()
    forest = engine.read(spark, "captures/")
    forest.where("proto == tcp and state == closed")
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.protocols import DEPTHS, Protocol, routes, standard
from .operators import dissect, forest, lifecycle, lru, rollups, sessions, views
from .plans.where import Where, compile_where
from .sources import pcap
from .sources.tables import written


def with_keys(depth: str) -> str:
    """Conversations need their keys, so no depth below keys."""
    return DEPTHS[max(1, DEPTHS.index(depth))]


@dataclass(frozen=True)
class Engine:
    """Which protocols there are, who claims which route, and how deep packets are read."""

    protocols: tuple[Protocol, ...] = ()
    add: dict[str, str] = field(default_factory=dict)
    remove: tuple[str, ...] = ()
    depth: str = "structural"
    guess: bool = False
    entry: str | None = None
    diagnose: bool = False
    series: int | None = None  # a cap for all series
    idle: int = 300_000_000
    linger: int = 15_000_000

    @staticmethod
    def standard(**options) -> Engine:
        return Engine(tuple(standard()), **options)

    def plugin(self, protocol: Protocol) -> Engine:
        return replace(self, protocols=(*self.protocols, protocol))

    def route(self, route: str, name: str) -> Engine:
        return replace(self, add={**self.add, route: name})

    def unroute(self, route: str) -> Engine:
        return replace(self, remove=(*self.remove, route))

    def build(self) -> Engine:
        """Checks the registry: an error says what is wrong."""
        routes(list(self.protocols), self.add, self.remove)
        if self.depth not in DEPTHS:
            raise ValueError(f"depth {self.depth}")
        return self

    def dissect(self, packets: DataFrame) -> DataFrame:
        return dissect.dissect(packets, self.add, self.remove, depth=self.depth, guess=self.guess, entry=self.entry, diagnose=self.diagnose, protocols=list(self.protocols))

    def forest(self, packets: DataFrame) -> Forest:
        engine = replace(self, depth=with_keys(self.depth))
        return Forest(engine, written(engine.dissect(packets), "dissected"))

    def read(self, spark: SparkSession, path: str, most: int | None = None) -> Forest:
        return self.forest(pcap.read_pcap(spark, path, most))


@dataclass(frozen=True)
class Forest:
    """A snapshot of conversations; every answer is a DataFrame. The records are written when first asked for."""

    engine: Engine
    packets: DataFrame  # dissected

    @cached_property
    def view(self) -> DataFrame:
        nodes = forest.streams(forest.packet_hits(self.packets))
        own = list(self.engine.protocols)
        held = self.rollups().filter("kind <> 'series'").select("path", F.col("field").alias("name"), F.explode(F.split("kept", ",")).alias("text")).withColumn("num", F.expr("try_cast(text as double)"))
        return written(views.records(nodes, own, lifecycle.stream_states(self.packets), held), "records")

    def rollups(self) -> DataFrame:
        return rollups.of_fields(rollups.observations(self.packets, list(self.engine.protocols)), self.engine.series)

    def streams(self) -> DataFrame:
        return self.view

    def stream(self, selector: str) -> DataFrame:
        return views.select(self.view, selector)

    def roots(self) -> DataFrame:
        return self.view.filter("depth = 0")

    def children(self, path: str) -> DataFrame:
        return forest.children(self.view, path)

    def at_layer(self, protocol: str) -> DataFrame:
        return forest.layer_list(self.view, protocol).orderBy("id")

    def at_layer_merged(self, protocol: str) -> DataFrame:
        return forest.merged(forest.layer_list(self.view, protocol))

    def where(self, text: str | Where) -> DataFrame:
        """Matches and all their ancestors."""
        asked = compile_where(text) if isinstance(text, str) else text
        return forest.matches_with_ancestors(self.view, asked.column)

    def summary(self) -> DataFrame:
        return forest.summary(self.view).orderBy("protocol")

    def stops(self) -> DataFrame:
        """Packets of each class of stops, in their fixed order."""
        order = F.create_map(*[F.lit(x) for pair in enumerate(dissect.CLASSES) for x in pair[::-1]])
        return self.packets.groupBy("stop_class").agg(F.count(F.lit(1)).alias("packets")).orderBy(order[F.col("stop_class")])

    def totals(self) -> DataFrame:
        """One row: packets, bytes, conversations, and layers of protocols with keys that lacked one."""
        named = [p.name for p in self.engine.protocols if p.shared or p.pair or p.app]
        lost = self.packets.agg(F.coalesce(F.sum(F.size(F.filter("layers", lambda x: x["protocol"].isin(named) & x["key"].isNull())).cast("long")), F.lit(0)).alias("key_errors"))
        return forest.totals(self.view, self.packets).crossJoin(lost)  # single rows

    def unknowns(self, min_count: int = 1, top: int | None = None) -> DataFrame:
        return dissect.unknown_table(dissect.unknown_registry(self.packets), min_count, top)

    def unknown_group(self, predecessor: str | None, route: str | None) -> DataFrame:
        """One group with a dump of each of its samples."""
        from .functions import rendering

        one = dissect.unknown_registry(self.packets).filter(F.col("predecessor").eqNullSafe(F.lit(predecessor)) & F.col("route").eqNullSafe(F.lit(route)))
        return one.withColumn("dumps", F.transform("samples", rendering.hex_dump))

    def finish(self) -> DataFrame:
        return sessions.finish(self.view)

    def evictions(self, most: int) -> DataFrame:
        """Which conversations a cap on live ones would close, in order: exact, so one task sees all packets' paths."""
        return lru.evictions(forest.packet_hits(self.packets).select("path", "packet_no"), most)

    def field(self, protocol: str, name: str) -> Column:
        """A column over packets: the field of the innermost layer of that protocol."""
        layer = F.try_element_at(F.filter("layers", lambda x: x["protocol"] == protocol), F.lit(-1))
        return F.get(F.filter(layer["fields"], lambda x: x["name"] == name), 0)


Sink = Callable[[DataFrame], None]


def drain(closed: DataFrame, sink: Sink) -> None:
    """Hands closed conversations to a sink, deepest first."""
    sink(sessions.finish(closed))
