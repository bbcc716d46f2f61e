"""Every protocol on a message of its own: its fields, and rules that all of them keep."""

import random
import struct

import pytest

from flowspark.functions import application
from flowspark.functions.protocols import Malformed, Protocol, Truncated, checksum, encode, ethertype, routes, standard
from flowspark.operators import dissect

H = bytes.fromhex
ALL = {p.name: p for p in standard()}
ICMP6 = [("icmpv6", {"type": 0, "rest_of_header": b"\0" * 4})]
UDP, TCP = [("udp", {})], [("tcp", {})]
IP6 = bytes(range(16))


def icmp6(kind, rest=b"\0" * 4):
    return [("icmpv6", {"type": kind, "rest_of_header": rest})]


def name(text):
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".")) + b"\0"


DNS = struct.pack(">6H", 7, 0x8180, 1, 1, 0, 0) + name("www.example.net") + struct.pack(">HH", 1, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([192, 0, 2, 9])
HELLO = b"\x03\x03" + b"r" * 32 + b"\0" + struct.pack(">HHH", 4, 0x1301, 0x1302) + b"\x01\0" + struct.pack(">H", 27) + struct.pack(">HHHBH", 0, 13, 11, 0, 8) + b"h.exampl" + struct.pack(">HHH", 16, 6, 4) + b"\x03h2x"
LACP_SIDE = lambda kind, mac: bytes([kind, 20]) + struct.pack(">H", 1) + mac + struct.pack(">HHHB", 2, 3, 4, 61) + b"\0" * 3
BPDU = struct.pack(">HBB", 0, 0, 0) + b"\x01" + b"R" * 8 + struct.pack(">I", 9) + b"B" * 8 + struct.pack(">5H", 0x8001, 0, 5120, 512, 3840)
SNMP = H("302602010104067075626c6963a019020104020100020100300e300c06082b060102010101000500")
#: name: message, layers before, and fields that must come out.
MESSAGES = {
    "template": (struct.pack(">BBHH", 2, 6, 5, 4), [], {"src": 5, "dst": 4, "type": 2}),
    "ndp": (IP6 + b"\x01\x01" + b"m" * 6, icmp6(135), {"msg_type": 135, "target_address": IP6, "source_link_addr": b"m" * 6}),
    "mld": (struct.pack(">BBH", 4, 0, 1) + IP6 + IP6, icmp6(143, struct.pack(">HH", 0, 1)), {"multicast_addr": IP6, "num_sources": 1}),
    "vrrp": (struct.pack(">BBBBHH", 0x31, 7, 100, 1, 100, 0) + bytes([10, 1, 1, 1]), [("ipv4", {})], {"vrid": 7, "priority": 100, "version": 3}),
    "hsrp": (bytes([0, 0, 16, 3, 10, 120, 5, 0]) + b"cisco\0\0\0" + bytes([10, 1, 1, 1]), UDP, {"group": 5, "state": 16, "virtual_ip": bytes([10, 1, 1, 1])}),
    "ospf": (struct.pack(">BBH4s4sHHQ", 2, 1, 48, b"rtr1", b"\0\0\0\0", 0, 0, 0) + struct.pack(">IHBBI4s4s4s", 0xFFFFFF00, 10, 0, 1, 40, b"dr01", b"bdr1", b"nbr1"), [], {"router_id": b"rtr1", "hello_interval": 10, "neighbors": [b"nbr1"]}),
    "bfd": (struct.pack(">BBBBIIIII", 0x20, 0xC0, 3, 24, 1, 2, 9, 9, 0), UDP, {"state": 3, "my_discriminator": 1, "your_discriminator": 2}),
    "sctp": (struct.pack(">HHII", 1, 2, 0, 0) + struct.pack(">BBHIIHHI", 1, 0, 20, 5, 6, 7, 8, 9), [], {"first_chunk_type": 1, "initiate_tag": 5, "initial_tsn": 9}),
    "bgp": (b"\xff" * 16 + struct.pack(">HBBHH4sB", 29, 1, 4, 65001, 90, b"id01", 0), TCP, {"msg_type": 1, "my_as": 65001, "hold_time": 90}),
    "erspan": (struct.pack(">HHI", 0x1005, 0x6123, 9), [], {"session_id": 0x123, "vlan": 5, "cos": 3, "index": 9}),
    "mpls": (struct.pack(">II", 100 << 12 | 64, 2 << 12 | 0x100 | 63), [], {"label": 100, "stack_depth": 2, "labels": [100, 2]}),
    "gtp_u": (struct.pack(">BBHIHBB", 0x32, 255, 4, 77, 5, 0, 0), UDP, {"teid": 77, "sequence_number": 5}),
    "wireguard": (b"\x01\0\0\0" + struct.pack("<I", 6) + b"\0" * 140, UDP, {"msg_type": 1, "sender_index": 6}),
    "l2tpv3": (struct.pack(">HHI", 3, 0, 44), UDP, {"session_id": 44, "t_bit": 0}),
    "ptp": (struct.pack(">BBHBBHqI8sHHBb", 11, 2, 34, 3, 0, 0, -5, 0, b"clock123", 1, 9, 5, -2), UDP, {"domain": 3, "correction": -5, "log_message_interval": -2}),
    "rocev2": (struct.pack(">BBHII", 4, 0x40, 0xFFFF, 99, 0x80000005), UDP, {"dest_qp": 99, "psn": 5, "ack_req": 1}),
    "cdp": (b"\x02\xb4\0\0" + struct.pack(">HH", 1, 7) + b"sw1" + struct.pack(">HHH", 10, 6, 99), [], {"device_id": "sw1", "native_vlan": 99, "ttl": 180}),
    "lldp": (struct.pack(">H", 2 << 8 | 7) + b"\x04" + b"m" * 6 + struct.pack(">H", 4 << 8 | 3) + b"\x07p1" + struct.pack(">HH", 6 << 8 | 2, 120) + struct.pack(">H", 10 << 8 | 2) + b"sw" + b"\0\0", [], {"ttl": 120, "port_id": b"p1", "system_name": "sw"}),
    "llc": (H("aaaa03") + b"\0\0\x0c" + H("2000"), [], {"dsap": 0xAA, "pid": 0x2000}),
    "lacp": (b"\x01\x01" + LACP_SIDE(1, b"actor1") + LACP_SIDE(2, b"partn1") + b"\x03\x10" + b"\0" * 14 + b"\0\0", [], {"actor_system": b"actor1", "partner_state": 61}),
    "stp": (BPDU, [], {"root_id": b"R" * 8, "root_path_cost": 9, "forward_delay": 3840}),
    "pvst_plus": (BPDU + b"\0" + struct.pack(">HHH", 0, 2, 55), [], {"originating_vlan": 55}),
    "eapol": (struct.pack(">BBH", 2, 3, 95) + struct.pack(">BHHQ", 2, 0x8A, 16, 1) + b"n" * 32 + b"\0" * 48 + struct.pack(">H", 0), [], {"key_info": 0x8A, "nonce": b"n" * 32}),
    "radiotap": (struct.pack("<BBHI", 0, 0, 15, 0x2C) + bytes([12, 0]) + struct.pack("<HHb", 2412, 0xA0, -60), [], {"rate": 12, "channel_freq": 2412, "antenna_signal": -60}),
    "dot11": (struct.pack("<HH", 0x0080, 0) + b"aaaaaa" + b"bbbbbb" + b"cccccc" + struct.pack("<H", 0x30) + b"\0" * 12 + b"\0\x04home", [], {"frame_subtype": 8, "ssid": "home", "seq_num": 3}),
    "pppoe": (struct.pack(">BBHH", 0x11, 9, 0, 8) + struct.pack(">HH", 0x0101, 4) + b"isp1", [], {"code": 9, "service_name": "isp1"}),
    "ppp": (b"\0\x21", [], {"protocol": 0x21}),
    "dns": (DNS, UDP, {"qname": "www.example.net", "answers": ["www.example.net 1 192.0.2.9"], "ancount": 1}),
    "mdns": (DNS, UDP, {"qname": "www.example.net", "is_multicast_query": 1, "cache_flush": 0}),
    "llmnr": (DNS, UDP, {"conflict": 0, "tentative": 1}),
    "netbios_ns": (struct.pack(">6H", 1, 0x0110, 1, 0, 0, 0) + b" " + b"".join(bytes([65 + (c >> 4), 65 + (c & 15)]) for c in b"HOST".ljust(15) + b"\0") + b"\0" + struct.pack(">HH", 32, 1), UDP, {"name": "HOST", "name_type": 0, "rr_type": 32}),
    "dhcp": (struct.pack(">BBBBI", 1, 1, 6, 0, 77) + b"\0" * 20 + b"mmmmmm" + b"\0" * 202 + H("63825363") + b"\x35\x01\x03\x0c\x02pc\xff", UDP, {"xid": 77, "msg_type": 3, "client_mac": b"mmmmmm", "hostname": "pc"}),
    "dhcpv6": (b"\x07\0\0\x09" + struct.pack(">HH", 1, 2) + b"du" + struct.pack(">HH", 3, 40) + b"\0" * 12 + struct.pack(">HH", 5, 24) + IP6 + struct.pack(">II", 100, 200), UDP, {"transaction_id": 9, "requested_ip": IP6, "valid_lifetime": 200}),
    "modbus": (struct.pack(">HHHBBHH", 1, 0, 6, 17, 3, 107, 3), TCP, {"unit_id": 17, "start_address": 107, "quantity": 3}),
    "mqtt": (b"\x31\x07\0\x03a/bhi", TCP, {"topic": "a/b", "retain": 1, "message_type": 3}),
    "dnp3": (H("0564") + struct.pack("<BBHHH", 8, 0xC4, 4, 3, 0) + b"\xc0\xc1\x01" + b"\0\0", TCP, {"source": 3, "destination": 4, "function_code": 1}),
    "enip": (struct.pack("<HHII", 0x6F, 16, 5, 0) + b"\0" * 12 + b"\0" * 6 + struct.pack("<HHHHH", 2, 0, 0, 0xB2, 0) , TCP, {"session_handle": 5, "command": 0x6F}),
    "bacnet_ip": (b"\x81\x0a\0\x0a\x01\x04\x00\x05\x01\x0c", UDP, {"apdu_type": 0, "service_choice": 12}),
    "syslog": (b"<34>1 2024-01-01T00:00:00Z host app - - - hello", UDP, {"facility": 4, "severity": 2, "hostname": "host", "msg": "hello"}),
    "snmp": (SNMP, UDP, {"version": 1, "community": "public", "pdu_type": 0, "request_id": 4}),
    "radius": (struct.pack(">BBH", 1, 9, 25) + b"\0" * 16 + b"\x01\x05bob", UDP, {"code": 1, "user_name": "bob"}),
    "ssdp": (b"NOTIFY * HTTP/1.1\r\nNTS: ssdp:alive\r\nLOCATION: http://a/\r\n\r\n", UDP, {"method": "NOTIFY", "nts": "ssdp:alive", "location": "http://a/"}),
    "http": (b"GET /x HTTP/1.1\r\nHost: a.example\r\nContent-Length: 3\r\n\r\n", TCP, {"method": "GET", "host": "a.example", "content_length": 3}),
    "tls": (b"\x16\x03\x01" + struct.pack(">H", len(HELLO) + 4) + b"\x01" + struct.pack(">I", len(HELLO))[1:] + HELLO, TCP, {"sni": "h.exampl", "alpn": ["h2x"], "cipher_suites": [0x1301, 0x1302]}),
    "netflow9": (struct.pack(">HHIIII", 9, 1, 0, 0, 5, 6) + struct.pack(">HH", 256, 4), UDP, {"source_id": 6, "flowsets": [256]}),
    "ipfix": (struct.pack(">HHIII", 10, 20, 0, 5, 6) + struct.pack(">HH", 2, 4), UDP, {"domain_id": 6, "sets": [2]}),
}


def test_all_protocols_are_there():
    assert len(ALL) == 62 and set(MESSAGES) == {n for n, p in ALL.items() if p.read}
    assert sum(not (p.shared or p.pair or p.app) for p in ALL.values()) == 16


@pytest.mark.parametrize("which", sorted(MESSAGES))
def test_messages_give_their_fields(which):
    raw, before, want = MESSAGES[which]
    p = ALL[which]
    v, size = p.parse(raw, before)
    assert {k: v.get(k) for k in want} == want and 0 < size <= len(raw)
    keys, some, every = (p.shown(v, d) for d in ("keys", "structural", "full"))
    assert set(keys) <= set(some) <= set(every) == set(v) and set(p.full).isdisjoint(some)
    assert (p.key(v) is None) == (not (p.shared or p.pair or p.app) or any(k not in v for k in p.shared))
    for n in range(len(raw)):  # a cut message is an error or a shorter one
        try:
            assert p.parse(raw[:n], before)[1] <= max(n, size)
        except (Truncated, Malformed):
            pass


def test_random_bytes_are_errors_at_most():
    draw = random.Random(4)
    befores = {"ndp": icmp6(134), "mld": icmp6(143, b"\0\0\0\3")}
    hits = dict.fromkeys(ALL, 0)
    for _ in range(300):
        raw = draw.randbytes(draw.randint(0, 120))
        for p in ALL.values():
            hits[p.name] += bool(p.probe and p.probe(raw) >= dissect.LIKELY)
            try:
                p.parse(raw, befores.get(p.name, UDP))
            except (Truncated, Malformed):
                pass
    assert max(hits.values()) <= 3


def test_sides_swap_and_keys_stay():
    tcp = ALL["tcp"]
    assert tcp.key({"src_port": 1, "dst_port": 9})[0] == tcp.key({"src_port": 9, "dst_port": 1})[0]
    assert tcp.key({"src_port": 1, "dst_port": 9})[1] == 0 and tcp.key({"src_port": 9, "dst_port": 1})[1] == 1 and tcp.key({"src_port": 5, "dst_port": 5})[1] == 0
    assert encode(-1) == "02" + "F" * 16 and encode(True) == "0301" and encode([1, "a"]) == "050002" + encode(1) + encode("a") and len(encode(b"x" * 70000)) == 6 + 2 * 65535


def test_names_and_checksum():
    assert application.dns_name(name("a.b") + b"\xc0\x00", 5) == ("a.b", 7)
    for bad in (b"\xc0\x00", b"\x3f" + b"a", b"\x80", b"\xc0\x05" + b"\0" * 9, name(".".join(["x" * 60] * 5))):
        with pytest.raises(Malformed):
            application.dns_name(bad, 0)
    raw = bytearray(struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20, 1, 0, 64, 6, 0, b"abcd", b"efgh"))
    raw[10:12] = checksum(bytes(raw)).to_bytes(2, "big")
    assert checksum(bytes(raw)) == 0 and ALL["ipv4"].probe(bytes(raw)) == 90 and ALL["ipv4"].probe(bytes(raw[:-1])) == 0


def test_probes_decide_where_anything_may_follow():
    inner = bytearray(struct.pack(">BBHHHBBH4s4s", 0x45, 0, 28, 1, 0, 64, 17, 0, b"abcd", b"efgh"))
    inner[10:12] = checksum(bytes(inner)).to_bytes(2, "big")
    inner += struct.pack(">HHHH", 9, 9, 8, 0)
    gtp = struct.pack(">BBHI", 0x30, 255, len(inner), 5)
    frame = b"\2" * 6 + b"\4" * 6 + H("0800") + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 0, 1, 0, 64, 17, 0, b"abcd", b"efgh") + struct.pack(">HHHH", 1, 2152, 0, 0) + gtp + bytes(inner)

    def chain(**k):
        layers, stop, _, _ = dissect.walk(frame, 1, routes(), **k)
        return [x["protocol"] for x in layers], stop

    assert chain() == (["ethernet", "ipv4", "udp", "gtp_u"], "unknown_hint")
    assert chain(guess=True) == (["ethernet", "ipv4", "udp", "gtp_u", "ipv4", "udp"], "complete")
    assert chain(until="ipv4") == (["ethernet", "ipv4"], "terminal") and dissect.walk(bytes(inner), 1, routes(), entry="ipv4")[1] == "complete"
    assert [x["guessed"] for x in dissect.walk(bytes(inner), 7, routes(), guess=True)[0]] == [True, False]
    plain = frame[:12] + H("0800") + frame[14:34] + struct.pack(">HHHH", 1, 2, 0, 0) + bytes(inner)
    assert dissect.walk(plain, 1, routes(), guess=True)[1:3] == ("unclaimed_route", "udp_port:2")


def test_registry_refuses():
    for bad in (Protocol("a", (), 1, condense=True), Protocol("a", (), 1, rollups=(("series", "x", 0),)), Protocol("a", (), 1, rollups=(("mean", "x", 1),))):
        with pytest.raises(ValueError):
            routes([bad])
    assert ethertype(0x0800) in routes() and "name:dns" in routes()
