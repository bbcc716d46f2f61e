"""Protocols as data: where a header's fields lie, how long it is, what may follow and which fields key a conversation.

A field is a range of bits of the fixed header; address fields are kept as bytes. Routes are texts such as
`ethertype:0x0800` or `udp_port:53`.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field


class Malformed(Exception):
    """The bytes are no such header."""


class Truncated(Exception):
    """The header needs more bytes than there are."""

    def __init__(self, needed: int, have: int):
        super().__init__(needed, have)
        self.needed, self.have = needed, have


Values = dict[str, int | bytes | str | bool | list]
DEPTHS = ("none", "keys", "structural", "full")


class Reader:
    """Reads a buffer from the front; what is missing is Truncated."""

    def __init__(self, buf: bytes, at: int = 0, end: int | None = None):
        self.buf, self.at, self.end = buf, at, len(buf) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise Truncated(self.at + n, self.end)
        self.at += n
        return self.buf[self.at - n : self.at]

    def num(self, n: int, order: str = "big", signed: bool = False) -> int:
        return int.from_bytes(self.take(n), order, signed=signed)

    def left(self) -> int:
        return self.end - self.at

    def rest(self) -> bytes:
        return self.take(self.left())

    def part(self, n: int) -> Reader:
        """A reader of the next n bytes alone."""
        self.take(n)
        return Reader(self.buf, self.at - n, self.at)


def claim(ok: bool, what: str) -> None:
    if not ok:
        raise Malformed(what)


@dataclass(frozen=True)
class Protocol:
    name: str
    claims: tuple[str, ...]
    least: int  # bytes of the fixed header
    bits: dict[str, tuple[int, int]] = field(default_factory=dict)  # name: first bit, number of bits
    raw: dict[str, tuple[int, int]] = field(default_factory=dict)  # name: first byte, number of bytes
    valid: Callable[[Values], bool] = lambda v: True
    length: Callable[[Values, bytes], int] | None = None  # of the whole header; None: the fixed one
    extra: Callable[[Values, bytes], None] | None = None  # sets values that lie behind the fixed header
    after: Callable[[Values], list[str]] = lambda v: []  # routes to try in order; none: nothing follows
    shared: tuple[str, ...] = ()
    pair: tuple[str, str] | None = None
    app: str | None = None  # a constant key: one conversation below each parent
    read: Callable[[Reader, Values, list], int | None] | None = None  # reads the header, given the layers before; may return its length
    full: tuple[str, ...] = ()  # fields of the deepest tier
    rollups: tuple[tuple[str, str, int], ...] = ()  # kind, field, cap (of a series)
    probe: Callable[[bytes], int] | None = None  # how well bytes look like this protocol, 0 to 100
    expected: tuple[str, ...] = ()  # protocols that it is likely below
    lifecycle: str | None = None  # see operators.lifecycle
    condense: bool = False  # whether the pair may be condensed

    def parse(self, buf: bytes, before: list = ()) -> tuple[Values, int]:
        if self.read:
            v: Values = {"app": self.app} if self.app else {}
            r = Reader(buf)
            size = self.read(r, v, before)
            return v, r.at if size is None else size
        if len(buf) < self.least:
            raise Truncated(self.least, len(buf))
        head, width = int.from_bytes(buf[: self.least], "big"), 8 * self.least
        v = {n: buf[a : a + k] for n, (a, k) in self.raw.items()}
        v |= {n: head >> (width - a - k) & ((1 << k) - 1) for n, (a, k) in self.bits.items()}
        if not self.valid(v):
            raise Malformed(self.name)
        size = self.length(v, buf) if self.length else self.least
        if size > len(buf):
            raise Truncated(size, len(buf))
        if self.extra:
            self.extra(v, buf)
        if self.app:
            v["app"] = self.app
        return v, size

    def shown(self, v: Values, depth: str) -> Values:
        """The fields of a tier: keys, structural ones, or all."""
        if depth == "full":
            return v
        keys = (*self.shared, *(self.pair or ()), "app")
        return {n: x for n, x in v.items() if (n in keys if depth == "keys" else n not in self.full)}

    def key(self, v: Values) -> tuple[str, int] | None:
        """The canonical key as hex and the direction; None for protocols without conversations."""
        if self.app:
            return encode(self.app), 0
        if not self.shared and not self.pair:
            return None
        if any(v.get(n) is None for n in (*self.shared, *(self.pair or ()))):
            return None
        a, b = (encode(v[n]) for n in self.pair) if self.pair else ("", "")
        return "".join(encode(v[n]) for n in self.shared) + min(a, b) + max(a, b), int(a > b)


def encode(x) -> str:
    """The hex of a key part. Tag 00 bytes and 04 text (two bytes of length and themselves, at most 65,535
    bytes), 01 numbers of eight bytes, 02 negative ones, 03 truth in one byte, 05 lists (two bytes of length, the items)."""
    if isinstance(x, bool):
        return f"03{int(x):02X}"
    if isinstance(x, int):
        return f"{'01' if x >= 0 else '02'}{x & (1 << 64) - 1:016X}"
    if isinstance(x, list):
        return f"05{min(len(x), 65535):04X}" + "".join(map(encode, x[:65535]))
    raw = (x.encode() if isinstance(x, str) else x)[:65535]
    return f"{'04' if isinstance(x, str) else '00'}{len(raw):04X}{raw.hex().upper()}"


def ethertype(n: int) -> str:
    return f"ethertype:0x{n:04X}"


def _ipv6_length(v: Values, buf: bytes) -> int:
    """The fixed header and up to eight extension headers; the last one names what follows, a fragment its place."""
    at, count = 40, 0
    while v["next_header"] in (0, 43, 44, 60):
        count += 1
        if count > 8:
            raise Malformed("ipv6")
        need = at + 8
        if len(buf) < need:
            raise Truncated(need, len(buf))
        fragment = v["next_header"] == 44
        if fragment:
            v["fragment_offset"] = int.from_bytes(buf[at + 2 : at + 4], "big") >> 3
        v["next_header"], at = buf[at], need if fragment else at + 8 * (buf[at + 1] + 1)
    return at


def _gre_extra(v: Values, buf: bytes) -> None:
    words = [int.from_bytes(buf[a : a + 4], "big") for a in range(4, 4 + 4 * sum(v[b] for b in "cks"), 4)]
    parts = dict(zip([n for n, b in (("checksum", "c"), ("key", "k"), ("sequence", "s")) if v[b]], words))
    v |= {"key": 0} | {n: x >> 16 if n == "checksum" else x for n, x in parts.items()}


def _arp_length(v: Values, buf: bytes) -> int:
    return 8 + 2 * (v["hlen"] + v["plen"])


def _arp_extra(v: Values, buf: bytes) -> None:
    at = 8
    for name, size in (("sender_mac", "hlen"), ("sender_ip", "plen"), ("target_mac", "hlen"), ("target_ip", "plen")):
        v[name] = buf[at : at + v[size]]
        at += v[size]


def _behind(name: str, start: int, size: str) -> Callable[[Values, bytes], None]:
    """Sets a field to the bytes from start, as many words of four as another field says; none leave it out."""

    def extra(v: Values, buf: bytes) -> None:
        if v[size] > 0:
            v[name] = buf[start : start + 4 * v[size]]

    return extra


def _icv(v: Values, buf: bytes) -> None:
    if v["payload_len"] > 1:
        v["icv"] = buf[12 : 8 + 4 * v["payload_len"]]


#: Types of ICMPv6 messages that a protocol of their own reads (multicast listeners and neighbours).
ICMPV6_ROUTED = (130, 131, 132, 133, 134, 135, 136, 137, 143)


def checksum(raw: bytes) -> int:
    """The Internet checksum of RFC 1071: zero for bytes that carry their own right one."""
    total = sum(struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2])) + (raw[-1] << 8 if len(raw) % 2 else 0)
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def _ipv4_probe(b: bytes) -> int:
    size = 4 * (b[0] & 15) if b else 0
    return 90 if b and b[0] >> 4 == 4 and 20 <= size <= len(b) and size <= int.from_bytes(b[2:4], "big") <= len(b) and not checksum(b[:size]) else 0


def _ipv4_options(v: Values, buf: bytes) -> None:
    if v["ihl"] > 5:
        v["options"] = buf[20 : 4 * v["ihl"]]


def _tcp_options(v: Values, buf: bytes) -> None:
    if v["data_offset"] > 5:
        v["options"] = buf[20 : 4 * v["data_offset"]]


def _ports(kind: str) -> Callable[[Values], list[str]]:
    return lambda v: [f"{kind}:{v['dst_port']}", f"{kind}:{v['src_port']}"]


PROTOCOLS = [
    Protocol("ethernet", ("link:1",), 14, {"ethertype": (96, 16)}, {"dst_mac": (0, 6), "src_mac": (6, 6)}, pair=("src_mac", "dst_mac"), rollups=(("accumulate", "ethertype", 64),),
             after=lambda v: [ethertype(v["ethertype"]) if v["ethertype"] >= 0x600 else "custom:eth_llc_frame:0"]),
    Protocol("vlan", (ethertype(0x8100), ethertype(0x88A8)), 4, {"pcp": (0, 3), "dei": (3, 1), "vlan_id": (4, 12), "ethertype": (16, 16)}, after=lambda v: [ethertype(v["ethertype"])]),
    Protocol("ipv4", (ethertype(0x0800), "ip_protocol:4"), 20,
             {"version": (0, 4), "ihl": (4, 4), "dscp": (8, 6), "ecn": (14, 2), "total_len": (16, 16), "id": (32, 16), "flags": (48, 3), "frag_offset": (51, 13), "ttl": (64, 8), "protocol": (72, 8), "checksum": (80, 16)},
             {"src_addr": (12, 4), "dst_addr": (16, 4)}, lambda v: v["version"] == 4 and v["ihl"] >= 5, lambda v, b: 4 * v["ihl"], _ipv4_options, pair=("src_addr", "dst_addr"), full=("dscp", "ecn", "id", "checksum", "options", "version"),
             rollups=(("accumulate", "protocol", 64),), probe=_ipv4_probe, expected=("gtp_u", "mpls", "ppp"),
             after=lambda v: [] if v["frag_offset"] else [f"ip_protocol:{v['protocol']}"]),
    Protocol("ipv6", (ethertype(0x86DD), "ip_protocol:41"), 40, {"version": (0, 4), "traffic_class": (4, 8), "flow_label": (12, 20), "payload_len": (32, 16), "next_header": (48, 8), "hop_limit": (56, 8)},
             {"src_addr": (8, 16), "dst_addr": (24, 16)}, lambda v: v["version"] == 6, _ipv6_length, pair=("src_addr", "dst_addr"), full=("traffic_class", "flow_label", "version"),
             rollups=(("accumulate", "next_header", 64),), probe=lambda b: 75 if len(b) >= 40 and b[0] >> 4 == 6 and int.from_bytes(b[4:6], "big") + 40 <= len(b) else 0, expected=("gtp_u", "mpls", "ppp"),
             after=lambda v: [] if v.get("fragment_offset") else [f"ip_protocol:{v['next_header']}"]),
    Protocol("arp", (ethertype(0x0806),), 8, {"hlen": (32, 8), "plen": (40, 8), "opcode": (48, 16)}, {}, lambda v: v["hlen"] > 0 and v["plen"] > 0, _arp_length, _arp_extra),
    Protocol("icmpv4", ("ip_protocol:1",), 8, {"type": (0, 8), "code": (8, 8)}, {"rest_of_header": (4, 4)}, full=("rest_of_header",)),
    Protocol("igmp", ("ip_protocol:2",), 8, {"type": (0, 8), "max_resp": (8, 8)}, {"group_addr": (4, 4)}),
    Protocol("tcp", ("ip_protocol:6",), 20, {"src_port": (0, 16), "dst_port": (16, 16), "seq": (32, 32), "ack": (64, 32), "data_offset": (96, 4), "flags": (103, 9), "window": (112, 16), "checksum": (128, 16), "urgent": (144, 16)},
             {}, lambda v: v["data_offset"] >= 5, lambda v, b: 4 * v["data_offset"], _tcp_options, after=_ports("tcp_port"), pair=("src_port", "dst_port"), full=("checksum", "urgent", "options"),
             rollups=(("accumulate", "flags", 64), ("series", "flags", 1024)), lifecycle="tcp", condense=True, expected=("ipv4", "ipv6"),
             probe=lambda b: 60 if len(b) >= 20 and 20 <= 4 * (b[12] >> 4) <= len(b) and not b[12] & 14 and 0 < b[13] < 64 and b[13] & 7 in (0, 1, 2, 4) and (b[13] & 32 or b[18:20] == b"\0\0") else 0),
    Protocol("udp", ("ip_protocol:17",), 8, {"src_port": (0, 16), "dst_port": (16, 16), "length": (32, 16), "checksum": (48, 16)}, after=_ports("udp_port"), pair=("src_port", "dst_port"), full=("checksum",), rollups=(("sample", "length", 0),), condense=True),
    Protocol("gre", ("ip_protocol:47",), 4, {"c": (0, 1), "k": (2, 1), "s": (3, 1), "flags": (0, 4), "version": (13, 3), "protocol": (16, 16)}, {}, lambda v: v["version"] == 0,
             lambda v, b: 4 + 4 * (v["c"] + v["k"] + v["s"]), _gre_extra, lambda v: [ethertype(v["protocol"])], ("key",), full=("checksum", "sequence")),
    Protocol("icmpv6", ("ip_protocol:58",), 8, {"type": (0, 8), "code": (8, 8)}, {"rest_of_header": (4, 4)}, after=lambda v: [f"custom:icmpv6_type:{v['type']}"] if v["type"] in ICMPV6_ROUTED else [], full=("rest_of_header",)),
    Protocol("esp", ("ip_protocol:50",), 8, {"spi": (0, 32), "sequence": (32, 32)}, shared=("spi",), rollups=(("sample", "sequence", 0),)),
    Protocol("ah", ("ip_protocol:51",), 12, {"next_header": (0, 8), "payload_len": (8, 8), "spi": (32, 32), "sequence": (64, 32)}, {}, lambda v: v["payload_len"] > 0, lambda v, b: 8 + 4 * v["payload_len"],
             _icv, lambda v: [f"ip_protocol:{v['next_header']}"], ("spi",), full=("icv",)),
    Protocol("geneve", ("udp_port:6081",), 8, {"version": (0, 2), "opt_len": (2, 6), "o_bit": (8, 1), "c_bit": (9, 1), "protocol_type": (16, 16), "vni": (32, 24)}, {}, lambda v: v["version"] == 0,
             lambda v, b: 8 + 4 * v["opt_len"], _behind("options", 8, "opt_len"), lambda v: [ethertype(v["protocol_type"])], ("vni",), full=("options",), rollups=(("accumulate", "protocol_type", 64),)),
    Protocol("ntp", ("udp_port:123",), 48, {"version": (2, 3), "mode": (5, 3), "stratum": (8, 8)}, {"ref_id": (12, 4), "ref_ts": (16, 8), "orig_ts": (24, 8), "recv_ts": (32, 8), "xmit_ts": (40, 8)}, lambda v: v["mode"] > 0, app="ntp", full=("ref_id", "ref_ts", "orig_ts", "recv_ts", "xmit_ts"), rollups=(("accumulate", "mode", 64), ("sample", "stratum", 0))),
    Protocol("vxlan", ("udp_port:4789",), 8, {"flags": (0, 8), "valid": (4, 1), "vni": (32, 24)}, {}, lambda v: v["valid"] == 1, after=lambda v: ["name:ethernet"], shared=("vni",)),
]


def routes(protocols: list[Protocol] | None = None, add: dict[str, str] | None = None, remove: tuple[str, ...] = ()) -> dict[str, Protocol]:
    """Who claims which route. `add` (route to name) and `remove` override the claims; two claims of one route are an error."""
    named: dict[str, Protocol] = {}
    found: dict[str, Protocol] = {}
    for p in standard() if protocols is None else protocols:
        if p.name in named:
            raise ValueError(f"protocol {p.name} is registered twice")
        if p.condense and not p.pair:
            raise ValueError(f"{p.name} has no pair to condense")
        if any(k not in ("accumulate", "sample", "series") or k == "series" and cap < 1 for k, _, cap in p.rollups):
            raise ValueError(f"{p.name} has a rollup of an unknown kind or without a cap")
        named[p.name] = p
        for c in p.claims:
            if c in found:
                raise ValueError(f"{c} is claimed by {found[c].name} and {p.name}")
            found[c] = p
    for route, name in (add or {}).items():
        if name not in named:
            raise ValueError(f"no protocol {name}")
        found[route] = named[name]
    return {r: p for r, p in found.items() if r not in remove} | {f"name:{n}": p for n, p in named.items()}


def standard() -> list[Protocol]:
    """All protocols that come with the engine, in the order of registration."""
    from . import application, link_layer, network_layer

    return [*PROTOCOLS, *link_layer.PROTOCOLS, *network_layer.PROTOCOLS, *application.PROTOCOLS]
