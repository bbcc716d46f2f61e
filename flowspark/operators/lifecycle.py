"""Lifecycles: ordered folds of events through a machine of states.

An event maps every state to a state, and such maps compose. So each key's rows are folded in blocks of their order, each
into the map from the state before the block to the state after it; the maps of the blocks, a row each, are folded in
turn. A hot key is many blocks in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Callable[[Column], Column], str]  # state ('*': any), condition on the event, state after it


@dataclass(frozen=True)
class Machine:
    """The first rule that holds applies; without one, and for an event that is null, a state stays."""

    initial: str
    rules: tuple[Rule, ...]
    closed: tuple[str, ...] = ()

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys([self.initial, *[s for s, _, _ in self.rules if s != "*"], *[to for _, _, to in self.rules]]))

    def step(self, state: Column, event: Column) -> Column:
        """The number of the state after event."""
        n = {s: i for i, s in enumerate(self.states)}
        out = state
        for s, holds, to in reversed(self.rules):
            here = F.coalesce(holds(event), F.lit(False))
            out = F.when(here if s == "*" else here & (state == n[s]), F.lit(n[to])).otherwise(out)
        return out


def fold(rows: DataFrame, key: list[str], order: str, event: Column, machine: Machine, block: int = 100_000) -> DataFrame:
    """key, state, closed (whether that state is a closed one) and n, the number of rows. order is an integer that is unique
    within a key; a block is a range of it."""
    names = machine.states
    slim = rows.select(*key, F.col(order).alias("ord"), event.alias("event"), F.floor(F.col(order) / block).alias("block"))
    lines = slim.groupBy(*key, "block").agg(F.array_sort(F.collect_list(F.struct("ord", "event"))).alias("line"))
    maps = lines.select(*key, "block", F.size("line").cast("long").alias("n"), F.array(*[F.aggregate("line", F.lit(i), lambda s, x: machine.step(s, x["event"])) for i in range(len(names))]).alias("to"))
    whole = maps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "to"))).alias("maps"), F.sum("n").alias("n"))
    last = F.aggregate("maps", F.lit(0), lambda s, x: F.get(x["to"], s))
    state = F.get(F.array(*[F.lit(x) for x in names]), last)
    return whole.select(*key, state.alias("state"), "n").withColumn("closed", F.col("state").isin(*machine.closed) if machine.closed else F.lit(False))


def _bits(on: int, off: int = 0) -> Callable[[Column], Column]:
    return lambda e: (e.bitwiseAND(on) == on) & (e.bitwiseAND(off) == 0)


def _is(*kinds: int) -> Callable[[Column], Column]:
    return lambda e: e.isin(*kinds)


#: The state machines of TCP (events are flags) and SCTP (events are types of first chunks).
FIN, SYN, RST, ACK = 1, 2, 4, 16
MACHINES = {
    "tcp": Machine("new", (
        ("*", _bits(RST), "reset"), ("new", _bits(SYN, ACK), "syn_sent"), ("new", _bits(0, SYN), "established_midstream"), ("syn_sent", _bits(SYN | ACK), "syn_received"),
        ("syn_received", _bits(ACK, SYN | FIN), "established"), ("established", _bits(FIN), "closing"), ("established_midstream", _bits(FIN), "closing"), ("closing", _bits(FIN | ACK), "closed"),
    ), ("closed", "reset")),
    "sctp": Machine("new", (
        ("*", _is(6), "aborted"), ("new", _is(1), "init_sent"), ("new", lambda e: e.isNotNull(), "established_midstream"), ("init_sent", _is(2), "cookie_wait"), ("cookie_wait", _is(10), "cookie_echoed"),
        ("cookie_echoed", _is(11), "established"), ("established", _is(7), "shutdown_pending"), ("established_midstream", _is(7), "shutdown_pending"), ("shutdown_pending", _is(8, 14), "closed"),
    ), ("closed", "aborted")),
}
EVENTS = {"tcp": "flags", "sctp": "first_chunk_type"}


def stream_states(dissected: DataFrame, packet_no: str = "packet_no") -> DataFrame:
    """path, state, closed of each conversation of a protocol with a lifecycle. At depth keys no event is there, so states
    stay new."""
    keyed = F.filter("layers", lambda x: x["key"].isNotNull())
    rows = dissected.select(F.col(packet_no).alias("packet_no"), keyed.alias("keyed"))
    rows = rows.select("packet_no", F.posexplode("keyed").alias("at", "x"), "keyed").filter(F.col("x.protocol").isin(*MACHINES))
    path = F.array_join(F.transform(F.slice("keyed", 1, F.col("at") + 1), lambda x: F.concat(x["protocol"], F.lit(":"), x["key"])), "/")
    field = F.create_map(*[F.lit(v) for x in EVENTS.items() for v in x])[F.col("x.protocol")]
    event = F.get(F.filter("x.fields", lambda f: f["name"] == field), 0)["num"]
    rows = rows.select("packet_no", F.col("x.protocol").alias("protocol"), path.alias("path"), event.alias("event"))
    out = None
    for name, machine in MACHINES.items():
        one = fold(rows.filter(F.col("protocol") == name), ["path"], "packet_no", F.col("event"), machine).select("path", "state", "closed")
        out = one if out is None else out.unionByName(one)
    return out
