"""Protocols below IP: frames, link control, discovery of neighbours, access and wireless links."""

from __future__ import annotations

from .protocols import Protocol, Reader, Values, claim, ethertype


def _llc(r: Reader, v: Values, before: list) -> None:
    v |= {"dsap": r.num(1), "ssap": r.num(1)}
    first = r.num(1)
    v["control"] = first if first & 3 == 3 else first << 8 | r.num(1)
    if v["dsap"] == v["ssap"] == 0xAA and v["control"] == 3:
        v |= {"oui": r.take(3), "pid": r.num(2)}


def _llc_after(v: Values) -> list[str]:
    if "oui" not in v:
        return [f"custom:llc_dsap:0x{v['dsap']:02X}"]
    return [ethertype(v["pid"])] if v["oui"] == b"\0\0\0" else [f"custom:snap_pid:0x{int.from_bytes(v['oui'][1:], 'big') << 16 | v['pid']:06X}"]


def _tlvs(r: Reader) -> list[tuple[int, bytes]]:
    """Type and length in one word of 7 and 9 bits, up to the end mark."""
    out = []
    while r.left() >= 2:
        word = r.num(2)
        out.append((word >> 9, r.take(word & 0x1FF)))
        if not word:
            break
    return out


def _lldp(r: Reader, v: Values, before: list) -> None:
    found = _tlvs(r)
    claim([k for k, _ in found[:3]] == [1, 2, 3] and all(len(d) >= 2 for _, d in found[:3]) and len(found[2][1]) == 2, "LLDP order")
    (_, chassis), (_, port), (_, ttl) = found[:3]
    v |= {"chassis_id_subtype": chassis[0], "chassis_id": chassis[1:], "port_id_subtype": port[0], "port_id": port[1:], "ttl": int.from_bytes(ttl, "big")}
    for kind, data in found[3:]:
        if kind in (5, 6):
            v["system_name" if kind == 5 else "system_description"] = data.decode("utf-8", "replace")
        elif kind == 7 and len(data) == 4:
            v["capabilities"] = int.from_bytes(data[:2], "big")
        elif kind == 8 and data:
            v["management_address"] = data[2 : 1 + data[0]]


def _cdp(r: Reader, v: Values, before: list) -> None:
    v |= {"version": r.num(1), "ttl": r.num(1), "checksum": r.num(2)}
    names = {1: "device_id", 3: "port_id", 6: "platform"}
    while r.left() >= 4:
        start = r.at
        kind, size = r.num(2), r.num(2)
        if not kind and not size:  # padding of a short frame
            r.at = start
            break
        claim(size >= 4, "CDP length")
        data = r.take(size - 4)
        if kind in names:
            v[names[kind]] = data.decode("utf-8", "replace")
        elif kind == 4 and len(data) == 4:
            v["capabilities"] = int.from_bytes(data, "big")
        elif kind == 10 and len(data) == 2:
            v["native_vlan"] = int.from_bytes(data, "big")
        elif kind == 2 and len(data) >= 13:
            v["ip_address"] = data[9:13]
    claim("device_id" in v, "CDP without a device")


def _lacp(r: Reader, v: Values, before: list) -> None:
    claim(r.num(1) == 1, "slow protocol")
    r.num(1)
    for side, mark in (("actor", 1), ("partner", 2)):
        claim(r.num(1) == mark and r.num(1) == 20, "LACP order")
        r.num(2)
        v[f"{side}_system"] = r.take(6)
        v[f"{side}_key"] = r.num(2)
        r.num(2)
        v[f"{side}_port"] = r.num(2)
        v[f"{side}_state"] = r.num(1)
        r.take(3)
    claim(r.num(1) == 3 and r.num(1) == 16, "LACP collector")
    r.take(14)
    claim(r.num(1) == 0 and r.num(1) == 0, "LACP end")


def _stp(r: Reader, v: Values, before: list) -> None:
    v |= {"protocol_id": r.num(2), "version": r.num(1), "bpdu_type": r.num(1)}
    if v["bpdu_type"] == 0x80:
        return
    v |= {"flags": r.num(1), "root_id": r.take(8), "root_path_cost": r.num(4), "bridge_id": r.take(8), "port_id": r.num(2)}
    for n in ("message_age", "max_age", "hello_time", "forward_delay"):
        v[n] = r.num(2)
    if v["version"] >= 2 and r.left():
        r.num(1)


def _pvst_plus(r: Reader, v: Values, before: list) -> None:
    _stp(r, {}, before)
    r.take(min(1, r.left() % 2))
    claim(r.num(2) == 0 and r.num(2) == 2, "PVST+ VLAN")
    v["originating_vlan"] = r.num(2)


def _eapol(r: Reader, v: Values, before: list) -> int:
    v |= {"version": r.num(1), "packet_type": r.num(1), "body_length": r.num(2)}
    body = r.part(v["body_length"])
    if v["packet_type"] == 3 and body.left() >= 95:
        v |= {"key_descriptor_type": body.num(1), "key_info": body.num(2), "key_length": body.num(2), "replay_counter": body.num(8), "nonce": body.take(32), "key_iv": body.take(16), "key_rsc": body.take(8)}
        body.take(8)
        v |= {"key_mic": body.take(16), "key_data_length": body.num(2)}


def _radiotap(r: Reader, v: Values, before: list) -> int:
    v["it_version"] = r.num(1)
    r.num(1)
    v["it_len"] = r.num(2, "little")
    claim(v["it_version"] == 0 and v["it_len"] >= 8, "radiotap header")
    head = Reader(r.buf, r.at, min(len(r.buf), v["it_len"]))
    words = [head.num(4, "little")]
    while words[-1] >> 31:
        words.append(head.num(4, "little"))
    v["it_present"] = words[0]
    # Alignment, size and name of the first fields.
    for bit, (align, size, name) in enumerate([(8, 8, None), (1, 1, None), (1, 1, "rate"), (2, 4, "channel_freq"), (2, 2, None), (1, 1, "antenna_signal")]):
        if words[0] >> bit & 1:
            head.take(-head.at % align)
            raw = head.take(size)
            if name:
                v[name] = int.from_bytes(raw[:2], "little", signed=name == "antenna_signal")
    return v["it_len"]


def _dot11(r: Reader, v: Values, before: list) -> None:
    control = r.num(2, "little")
    kind, sub = control >> 2 & 3, control >> 4 & 15
    claim(kind < 3, "802.11 extension frame")
    v |= {"frame_type": kind, "frame_subtype": sub, "flags": control >> 8, "duration": r.num(2, "little"), "addr1": r.take(6)}
    if kind == 1:
        if sub in (8, 9, 10, 11, 14, 15):
            v["addr2"] = r.take(6)
        return
    v |= {"addr2": r.take(6), "addr3": r.take(6), "seq_num": r.num(2, "little") >> 4}
    if kind == 2:
        if v["flags"] & 3 == 3:
            v["addr4"] = r.take(6)
        if sub & 8:
            v["qos_control"] = r.num(2, "little")
        return
    fixed = {0: 4, 1: 6, 2: 10, 3: 6, 4: 0, 5: 12, 8: 12, 10: 2, 11: 6, 12: 2}.get(sub, 0)
    r.take(fixed)
    while sub in (0, 2, 4, 5, 8) and r.left() >= 2:
        number, data = r.num(1), r.take(r.num(1))
        if number == 0 and "ssid" not in v:
            v["ssid"] = data.decode("utf-8", "replace")
    r.rest()


def _dot11_after(v: Values) -> list[str]:
    data = v["frame_type"] == 2 and not v["frame_subtype"] & 4 and not v["flags"] & 0x40
    return ["name:llc"] if data else []


def _pppoe(r: Reader, v: Values, before: list) -> None:
    first = r.num(1)
    claim(first == 0x11, "PPPoE version")
    v |= {"version": 1, "type": 1, "code": r.num(1), "session_id": r.num(2)}
    size = r.num(2)
    if v["code"]:
        names = {0x0101: "service_name", 0x0102: "ac_name", 0x0103: "host_uniq"}
        tags = r.part(size)
        while tags.left() >= 4:
            kind, data = tags.num(2), tags.take(tags.num(2))
            if kind in names:
                v[names[kind]] = data if kind == 0x0103 else data.decode("utf-8", "replace")


def _ppp(r: Reader, v: Values, before: list) -> None:
    first = r.num(1)
    v["protocol"] = first if first & 1 else first << 8 | r.num(1)


GROUPS = (b"\x01\x80\xc2\0\0\0", b"\x01\0\x0c\xcc\xcc\xcc", b"\x01\0\x0c\xcc\xcc\xcd")  # fixed values: bridges and discovery
PROTOCOLS = [
    Protocol("cdp", ("custom:snap_pid:0x0C2000",), 0, read=_cdp, full=("device_id", "port_id", "platform", "capabilities", "native_vlan", "ip_address")),
    Protocol("lldp", (ethertype(0x88CC),), 0, read=_lldp, full=("system_name", "system_description", "management_address", "capabilities")),
    Protocol("llc", ("custom:eth_llc_frame:0",), 0, read=_llc, full=("oui", "pid"), after=_llc_after, expected=("ethernet", "dot11"), probe=lambda b: 55 if len(b) >= 3 and b[0] == b[1] and b[0] in (0x42, 0xAA) and b[2] == 3 else 0),
    Protocol("lacp", (ethertype(0x8809),), 0, read=_lacp, pair=("actor_system", "partner_system"), rollups=(("accumulate", "actor_state", 64),)),
    Protocol("stp", ("custom:llc_dsap:0x42",), 0, read=_stp, full=("root_path_cost", "port_id", "message_age", "max_age", "hello_time", "forward_delay")),
    Protocol("pvst_plus", ("custom:snap_pid:0x0C010B",), 0, read=_pvst_plus, full=("originating_vlan",)),
    Protocol("eapol", (ethertype(0x888E),), 0, read=_eapol, full=("key_descriptor_type", "key_info", "key_length", "replay_counter", "nonce", "key_iv", "key_rsc", "key_mic", "key_data_length")),
    Protocol("radiotap", ("link:127",), 0, read=_radiotap, full=("rate", "channel_freq", "antenna_signal"), after=lambda v: ["name:dot11"]),
    Protocol("dot11", ("link:105",), 0, read=_dot11, pair=("addr1", "addr2"), full=("ssid", "addr4", "qos_control"), rollups=(("accumulate", "frame_subtype", 64),), after=_dot11_after),
    Protocol("pppoe", (ethertype(0x8863), ethertype(0x8864)), 0, read=_pppoe, shared=("session_id",), full=("service_name", "ac_name", "host_uniq"), after=lambda v: [] if v["code"] else ["name:ppp"]),
    Protocol("ppp", (), 0, read=_ppp, after=lambda v: {0x0021: [ethertype(0x0800)], 0x0057: [ethertype(0x86DD)]}.get(v["protocol"], [])),
]
