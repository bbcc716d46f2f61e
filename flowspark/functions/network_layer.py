"""Protocols that stand on IP, on its tunnels or on the transport ports of routers."""

from __future__ import annotations

from .protocols import Malformed, Protocol, Reader, Truncated, Values, claim, ethertype


def _options(r: Reader) -> list[tuple[int, bytes]]:
    """Options of a type, a length in units of eight bytes and their data."""
    out = []
    while r.left():
        kind, units = r.num(1), r.num(1)
        claim(units > 0, "an option without length")
        out.append((kind, r.take(8 * units - 2)))
    return out


def _ndp(r: Reader, v: Values, before: list) -> int:
    """The body of a neighbour message: its type and the second word are in the ICMPv6 layer before."""
    head = before[-1][1]
    kind, word = head["type"], int.from_bytes(head["rest_of_header"], "big")
    v["msg_type"] = kind
    if kind == 134:
        v |= {"flags": word >> 8 & 0xFF, "router_lifetime": word & 0xFFFF, "reachable_time": r.num(4), "retrans_timer": r.num(4)}
    elif kind == 136:
        v["flags"] = word >> 24
    if kind in (135, 136, 137):
        v["target_address"] = r.take(16)
    if kind == 137:
        r.take(16)
    names = {1: "source_link_addr", 2: "target_link_addr", 3: "prefix_info"}
    for option, data in _options(r):
        if option in names:
            v.setdefault(names[option], data)


def _mld(r: Reader, v: Values, before: list) -> int | None:
    head = before[-1][1]
    kind, word = head["type"], int.from_bytes(head["rest_of_header"], "big")
    v["msg_type"] = kind
    if kind == 143:
        for i in range(word & 0xFFFF):
            r.num(1)
            extra, n = r.num(1), r.num(2)
            group = r.take(16)
            sources = [r.take(16) for _ in range(n)]
            r.take(4 * extra)
            if not i:
                v |= {"multicast_addr": group, "num_sources": n, "source_addrs": sources}
        return None
    v |= {"max_resp_delay": word >> 16, "multicast_addr": r.take(16)}
    if kind == 130 and r.left() >= 4:
        r.take(2)
        n = r.num(2)
        v |= {"num_sources": n, "source_addrs": [r.take(16) for _ in range(n)]}


def _vrrp(r: Reader, v: Values, before: list) -> None:
    first = r.num(1)
    claim(first >> 4 in (2, 3), "VRRP version")
    v |= {"version": first >> 4, "type": first & 15, "vrid": r.num(1), "priority": r.num(1), "count_ip_addrs": r.num(1)}
    word = r.num(2)
    r.num(2)
    v["adver_int"] = word & 0xFFF if v["version"] == 3 else word & 0xFF
    six = v["version"] == 3 and any(n == "ipv6" for n, _ in before[-1:])
    v["ip_addresses"] = [r.take(16 if six else 4) for _ in range(v["count_ip_addrs"])]
    if v["version"] == 2:
        r.take(min(8, r.left()))


def _hsrp(r: Reader, v: Values, before: list) -> None:
    v["version"] = r.num(1)
    claim(v["version"] == 0, "HSRP version")
    for n in ("opcode", "state", "hellotime", "holdtime", "priority", "group"):
        v[n] = r.num(1)
    r.num(1)
    v |= {"auth_data": r.take(8), "virtual_ip": r.take(4)}


def _ospf(r: Reader, v: Values, before: list) -> int:
    v["version"] = r.num(1)
    claim(v["version"] in (2, 3), "OSPF version")
    v |= {"type": r.num(1), "packet_length": r.num(2), "router_id": r.take(4), "area_id": r.take(4)}
    two = v["version"] == 2
    r.take(12 if two else 4)
    claim(v["packet_length"] >= r.at, "OSPF length")
    if v["packet_length"] > len(r.buf):
        raise Truncated(v["packet_length"], len(r.buf))
    body = Reader(r.buf, r.at, v["packet_length"])
    if v["type"] == 1:
        if two:
            body.take(4)
            v["hello_interval"] = body.num(2)
            body.take(2)
            v["router_dead_interval"] = body.num(4)
        else:
            body.take(8)
            v |= {"hello_interval": body.num(2), "router_dead_interval": body.num(2)}
        v["designated_router"] = body.take(4)
        body.take(4)
        v["neighbors"] = [body.take(4) for _ in range(body.left() // 4)]
    elif v["type"] == 2:
        if two:
            v["interface_mtu"] = body.num(2)
            body.take(2)
        else:
            body.take(4)
            v["interface_mtu"] = body.num(2)
            body.take(2)
        v["dd_sequence"] = body.num(4)
        v["lsa_headers"] = [body.take(20) for _ in range(body.left() // 20)]
    elif v["type"] == 5:
        v["lsa_headers"] = [body.take(20) for _ in range(body.left() // 20)]
    return v["packet_length"]


def _bfd(r: Reader, v: Values, before: list) -> int:
    first, second = r.num(1), r.num(1)
    v |= {"version": first >> 5, "diag": first & 31, "state": second >> 6, "flags": second & 63, "detect_mult": r.num(1), "length": r.num(1)}
    claim(v["version"] == 1 and v["detect_mult"] > 0 and v["length"] >= 24, "BFD header")
    for n in ("my_discriminator", "your_discriminator", "desired_min_tx", "required_min_rx", "required_min_echo_rx"):
        v[n] = r.num(4)
    claim(v["my_discriminator"] > 0, "BFD discriminator")
    r.take(v["length"] - 24)


def _sctp(r: Reader, v: Values, before: list) -> None:
    v |= {"src_port": r.num(2), "dst_port": r.num(2), "verification_tag": r.num(4)}
    r.num(4)
    first = True
    while r.left() >= 4:
        kind, _, size = r.num(1), r.num(1), r.num(2)
        claim(size >= 4, "SCTP chunk length")
        body = r.part(size - 4)
        r.take(min(-size % 4, r.left()))
        if first:
            v["first_chunk_type"], first = kind, False
            if kind in (1, 2):
                v |= {"initiate_tag": body.num(4), "a_rwnd": body.num(4), "num_outbound_streams": body.num(2), "num_inbound_streams": body.num(2), "initial_tsn": body.num(4)}
    claim(not first, "SCTP without a chunk")


def _prefixes(r: Reader) -> list[bytes]:
    out = []
    while r.left():
        bits = r.num(1)
        claim(bits <= 32, "BGP prefix")
        out.append(r.take((bits + 7) // 8).ljust(4, b"\0") + bytes([bits]))
    return out


def _bgp(r: Reader, v: Values, before: list) -> int:
    r.take(16)
    v |= {"length": r.num(2), "msg_type": r.num(1)}
    claim(19 <= v["length"] <= 4096, "BGP length")
    body = r.part(v["length"] - 19)
    if v["msg_type"] == 1:
        claim(body.num(1) == 4, "BGP version")
        v |= {"my_as": body.num(2), "hold_time": body.num(2), "bgp_identifier": body.take(4)}
    elif v["msg_type"] == 2:
        v["withdrawn_routes"] = _prefixes(body.part(body.num(2)))
        attributes = body.part(body.num(2))
        while attributes.left():
            flags, kind = attributes.num(1), attributes.num(1)
            data = attributes.take(attributes.num(2 if flags & 16 else 1))
            if kind == 3 and len(data) == 4:
                v["next_hop"] = data
        v["nlri"] = _prefixes(body)


def _erspan(r: Reader, v: Values, before: list) -> None:
    a, b = r.num(2), r.num(2)
    v |= {"version": a >> 12, "vlan": a & 0xFFF, "cos": b >> 13, "truncated": b >> 10 & 1, "session_id": b & 0x3FF}
    claim(v["version"] in (1, 2), "ERSPAN version")
    if v["version"] == 1:
        v["index"] = r.num(4) & 0xFFFFF
        return
    v |= {"timestamp": r.num(4), "sgt": r.num(2)}
    last = r.num(2)
    v["frame_type"] = last >> 10 & 31
    if last & 1:
        r.take(8)


def _mpls(r: Reader, v: Values, before: list) -> None:
    labels = []
    while True:
        claim(len(labels) < 16, "MPLS stack")
        word = r.num(4)
        labels.append(word >> 12)
        if len(labels) == 1:
            v |= {"label": word >> 12, "tc": word >> 9 & 7, "ttl": word & 0xFF}
        if word >> 8 & 1:
            break
    v |= {"stack_depth": len(labels), "labels": labels}


def _gtp_u(r: Reader, v: Values, before: list) -> None:
    flags = r.num(1)
    claim(flags >> 5 == 1 and flags >> 4 & 1 == 1, "GTP-U version")
    v |= {"flags": flags & 15, "message_type": r.num(1), "length": r.num(2), "teid": r.num(4)}
    if flags & 7:
        sequence, _, following = r.num(2), r.num(1), r.num(1)
        if flags & 2:
            v["sequence_number"] = sequence
        while flags & 4 and following:
            units = r.num(1)
            claim(units > 0, "GTP-U extension")
            following = r.take(4 * units - 1)[-1]


def _l2tpv3(r: Reader, v: Values, before: list) -> None:
    """Over UDP a word with the T bit comes first; over IP a control message has session 0."""
    if before and before[-1][0] == "udp":
        word = r.num(2)
        claim(word & 15 == 3, "L2TPv3 version")
        v["t_bit"] = word >> 15
        if v["t_bit"]:
            r.num(2)
            v["control_connection_id"] = r.num(4)
            r.take(4)
            return
        r.num(2)
        v["session_id"] = r.num(4)
        return
    session = r.num(4)
    v["t_bit"] = int(session == 0)
    if session:
        v["session_id"] = session
        return
    r.num(4)
    v["control_connection_id"] = r.num(4)
    r.take(4)


def _wireguard(r: Reader, v: Values, before: list) -> int:
    kind = r.num(1)
    sizes = {1: 148, 2: 92, 3: 64}  # fixed values: lengths of the handshake messages
    claim(kind in (1, 2, 3, 4) and r.take(3) == b"\0\0\0", "WireGuard type")
    n = len(r.buf)
    claim(n >= 32 and n % 16 == 0 if kind == 4 else n == sizes[kind], "WireGuard length")
    v["msg_type"] = kind
    if kind in (1, 2):
        v["sender_index"] = r.num(4, "little")
    if kind in (2, 3, 4):
        v["receiver_index"] = r.num(4, "little")
    return n


def _ptp(r: Reader, v: Values, before: list) -> int:
    first, second = r.num(1), r.num(1)
    v |= {"msg_type": first & 15, "version": second & 15, "message_length": r.num(2), "domain": r.num(1)}
    claim(v["msg_type"] in (0, 1, 2, 3, 8, 9, 10, 11, 12, 13) and v["version"] == 2 and v["message_length"] >= 34, "PTP header")
    r.num(1)
    v |= {"flags": r.num(2), "correction": r.num(8, signed=True)}
    r.num(4)
    v |= {"clock_identity": r.take(8), "source_port_id": r.num(2), "sequence_id": r.num(2)}
    r.num(1)
    v["log_message_interval"] = r.num(1, signed=True)
    r.take(v["message_length"] - 34)


def _rocev2(r: Reader, v: Values, before: list) -> None:
    v["opcode"], second = r.num(1), r.num(1)
    claim(second & 15 == 0, "RoCEv2 version")
    v |= {"solicited": second >> 7, "mig_req": second >> 6 & 1, "pad_count": second >> 4 & 3, "pkey": r.num(2)}
    r.num(1)
    v["dest_qp"] = r.num(3)
    word = r.num(4)
    v |= {"ack_req": word >> 31, "psn": word & 0xFFFFFF}


def _template(r: Reader, v: Values, before: list) -> None:
    kind, size = r.num(1), r.num(1)
    v |= {"src": r.num(2), "dst": r.num(2), "type": kind, "len": size}


def _inside(v: Values) -> list[str]:
    return {0: ["name:ipv4"], 2: ["name:ipv6"]}.get(v["labels"][-1], ["unknown"])


NDP, MLD = (133, 134, 135, 136, 137), (130, 131, 132, 143)  # fixed values: ICMPv6 types
PROTOCOLS = [
    Protocol("template", ("custom:pktt:0",), 0, read=_template, pair=("src", "dst"), rollups=(("accumulate", "type", 64),), after=lambda v: ["name:template"] if v["type"] == 1 else [], probe=lambda b: 60 if len(b) >= 6 and b[:2] == b"PT" else 0),
    Protocol("ndp", tuple(f"custom:icmpv6_type:{n}" for n in NDP), 0, read=_ndp, full=("source_link_addr", "target_link_addr", "prefix_info", "router_lifetime", "reachable_time", "retrans_timer")),
    Protocol("mld", tuple(f"custom:icmpv6_type:{n}" for n in MLD), 0, read=_mld, full=("num_sources", "source_addrs")),
    Protocol("vrrp", ("ip_protocol:112",), 0, read=_vrrp, shared=("vrid",), full=("ip_addresses",), rollups=(("accumulate", "priority", 64),)),
    Protocol("hsrp", ("udp_port:1985",), 0, read=_hsrp, shared=("group",), full=("virtual_ip", "auth_data"), rollups=(("accumulate", "state", 64), ("accumulate", "priority", 64))),
    Protocol("ospf", ("ip_protocol:89",), 0, read=_ospf, full=("hello_interval", "router_dead_interval", "designated_router", "neighbors", "interface_mtu", "dd_sequence", "lsa_headers")),
    Protocol("bfd", ("udp_port:3784", "udp_port:4784"), 0, read=_bfd, pair=("my_discriminator", "your_discriminator"), full=("desired_min_tx", "required_min_rx", "required_min_echo_rx"), rollups=(("accumulate", "state", 64),)),
    Protocol("sctp", ("ip_protocol:132",), 0, read=_sctp, pair=("src_port", "dst_port"), lifecycle="sctp", full=("initiate_tag", "a_rwnd", "num_outbound_streams", "num_inbound_streams", "initial_tsn"), rollups=(("accumulate", "first_chunk_type", 64),)),
    Protocol("bgp", ("tcp_port:179",), 0, read=_bgp, app="bgp", full=("my_as", "hold_time", "bgp_identifier", "withdrawn_routes", "nlri", "next_hop"), rollups=(("accumulate", "msg_type", 64), ("sample", "my_as", 0))),
    Protocol("erspan", (ethertype(0x88BE), ethertype(0x22EB)), 0, read=_erspan, shared=("session_id",), full=("index", "timestamp", "sgt", "frame_type", "truncated"), after=lambda v: ["name:ethernet"] if not v.get("frame_type") else ["unknown"]),
    Protocol("mpls", (ethertype(0x8847), ethertype(0x8848)), 0, read=_mpls, shared=("label",), full=("labels",), after=_inside),
    Protocol("gtp_u", ("udp_port:2152",), 0, read=_gtp_u, shared=("teid",), full=("sequence_number",), rollups=(("accumulate", "message_type", 64),), after=lambda v: ["unknown"] if v["message_type"] == 255 else []),
    Protocol("wireguard", ("udp_port:51820",), 0, read=_wireguard, app="wireguard", full=("sender_index", "receiver_index"), rollups=(("accumulate", "msg_type", 64),), expected=("udp",),
             probe=lambda b: 50 if len(b) in (148, 92, 64) and b[:4] == bytes([{148: 1, 92: 2, 64: 3}[len(b)], 0, 0, 0]) else 0),
    Protocol("l2tpv3", ("udp_port:1701", "ip_protocol:115"), 0, read=_l2tpv3, shared=("session_id",), after=lambda v: [] if v["t_bit"] else ["name:ethernet"]),
    Protocol("ptp", ("udp_port:319", "udp_port:320", ethertype(0x88F7)), 0, read=_ptp, shared=("domain",), full=("source_port_id", "message_length", "flags", "correction", "log_message_interval"), rollups=(("accumulate", "msg_type", 64),)),
    Protocol("rocev2", ("udp_port:4791",), 0, read=_rocev2, shared=("dest_qp",), full=("psn", "pad_count", "solicited", "mig_req", "ack_req"), rollups=(("accumulate", "opcode", 64),)),
]
