"""Capture files, the walk through layers, and the forest of dissected packets."""

import random
import struct

import pyarrow as pa
import pytest

from flowspark.functions.protocols import PROTOCOLS, routes
from flowspark.operators import dissect, forest
from flowspark.sources import pcap

A, B = b"\x02\0\0\0\0\x01", b"\x02\0\0\0\0\x02"
H1, H2 = bytes([172, 16, 9, 7]), bytes([198, 51, 100, 20])


def eth(src, dst, kind, body):
    return dst + src + struct.pack(">H", kind) + body


def ip(src, dst, proto, body, frag=0, ihl=5):
    return struct.pack(">BBHHHBBH", 0x40 | ihl, 0, 20 + len(body), 0, frag, 64, proto, 0) + src + dst + body


def tcp(sport, dport, flags, body=b""):
    return struct.pack(">HHIIHHHH", sport, dport, 0, 0, 0x5000 | flags, 1024, 0, 0) + body


def udp(sport, dport, body=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def there(body):
    return eth(A, B, 0x0800, ip(H1, H2, 6, body))


def back(body):
    return eth(B, A, 0x0800, ip(H2, H1, 6, body))


def session():
    t = 10**6
    return [(7 * t, there(tcp(40100, 8443, 2))), (7 * t, back(tcp(8443, 40100, 18))), (7 * t, there(tcp(40100, 8443, 16))), (8 * t, there(tcp(40100, 8443, 24, b"x" * 90))), (9 * t, back(tcp(8443, 40100, 24, b"y" * 310))), (11 * t, there(tcp(40100, 8443, 17))), (11 * t, back(tcp(8443, 40100, 17)))]


def test_session_file_to_forest(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.write_pcap(session()))
    packets = pcap.read_pcap(spark, str(tmp_path))
    assert packets.count() == 7
    got = {r.protocol: r for r in forest.streams(forest.packet_hits(dissect.dissect(packets))).collect()}
    assert {p: (r.depth, r.packets_ab, r.packets_ba, r.initiator) for p, r in got.items()} == {"ethernet": (0, 4, 3, 0), "ipv4": (1, 4, 3, 0), "tcp": (2, 3, 4, 1)}
    assert got["tcp"].opaque_bytes == 400 and got["tcp"].first_seen == 7 * 10**6 and got["tcp"].last_seen == 11 * 10**6


def names(frame, link=1, **more):
    layers, stop, route, left = dissect.walk(frame, link, routes(), **more)
    return [x["protocol"] for x in layers], stop, route, left


def test_tunnels_and_stops():
    inner = ip(H1, H2, 6, tcp(1, 2, 2))
    assert names(eth(A, B, 0x0800, ip(H1, H2, 47, struct.pack(">HH", 0, 0x0800) + inner))) == (["ethernet", "ipv4", "gre", "ipv4", "tcp"], "complete", None, 0)
    vx = b"\x08\0\0\0" + (5000 << 8).to_bytes(4, "big") + there(tcp(1, 2, 2))
    assert names(eth(A, B, 0x0800, ip(H1, H2, 17, udp(9, 4789, vx))))[0] == ["ethernet", "ipv4", "udp", "vxlan", "ethernet", "ipv4", "tcp"]
    tags = struct.pack(">HHHH", 200, 0x8100, 100, 0x0800)
    assert names(eth(A, B, 0x88A8, tags + inner))[0] == ["ethernet", "vlan", "vlan", "ipv4", "tcp"]
    assert names(eth(A, B, 0x0800, ip(H1, H2, 17, udp(55555, 55555, b"z" * 9)))) == (["ethernet", "ipv4", "udp"], "unclaimed_route", "udp_port:55555", 9)
    assert names(b"abcdef") == ([], "truncated", None, 6)
    assert names(eth(A, B, 0x0800, ip(H1, H2, 6, b"ab"))) == (["ethernet", "ipv4"], "truncated", None, 2)
    assert names(eth(A, B, 0x0800, ip(H1, H2, 6, tcp(1, 2, 2), ihl=1)))[1] == "plugin_error"
    assert names(eth(A, B, 0x0800, ip(H1, H2, 6, b"abc", frag=100))) == (["ethernet", "ipv4"], "terminal", None, 3)
    assert names(b"") == ([], "complete", None, 0) and names(b"x", link=7) == ([], "unclaimed_route", "link:7", 1)
    assert names(eth(A, B, 0x8100, struct.pack(">HH", 1, 0x8100) * 40 + b"x"))[1] == "depth_cap"


def test_ipv6_extensions_and_gre_key():
    six = lambda nxt, body: struct.pack(">IHBB", 6 << 28, len(body), nxt, 64) + b"\1" * 16 + b"\2" * 16 + body
    hop = lambda nxt: bytes([nxt, 0]) + b"\0" * 6
    assert names(eth(A, B, 0x86DD, six(0, hop(60) + hop(17) + udp(1, 2)))) == (["ethernet", "ipv6", "udp"], "complete", None, 0)
    assert names(eth(A, B, 0x86DD, six(0, hop(0) * 8 + hop(17) + udp(1, 2))))[1] == "plugin_error"
    assert names(eth(A, B, 0x86DD, six(44, bytes([17, 0, 0, 80]) + b"\0" * 4 + b"rest")))[1] == "terminal"
    layers = dissect.walk(eth(A, B, 0x0800, ip(H1, H2, 47, struct.pack(">HHII", 0x3000, 0x0800, 77, 5))), 1, routes())[0]
    assert layers[-1]["key"] == f"01{77:016X}" and {f["name"]: f["num"] for f in layers[-1]["fields"]}["sequence"] == 5


def test_further_protocols(spark):
    inside = lambda proto, body: eth(A, B, 0x0800, ip(H1, H2, proto, body))
    assert names(inside(50, struct.pack(">II", 7, 1) + b"secret")) == (["ethernet", "ipv4", "esp"], "terminal", None, 6)
    ah = struct.pack(">BBHII", 6, 4, 0, 9, 1) + b"i" * 12 + tcp(1, 2, 2)
    assert names(inside(51, ah)) == (["ethernet", "ipv4", "ah", "tcp"], "complete", None, 0)
    assert {f["name"]: f["raw"] for f in dissect.walk(inside(51, ah), 1, routes())[0][2]["fields"]}["icv"] == b"i" * 12
    assert names(inside(51, b"\6\0" + ah[2:]))[1] == "plugin_error" and names(inside(51, ah[:14]))[1] == "truncated"
    gen = bytes([1, 0x40]) + struct.pack(">H", 0x6558) + (77 << 8).to_bytes(4, "big") + b"opts"
    assert names(inside(17, udp(5, 6081, gen + b"x"))) == (["ethernet", "ipv4", "udp", "geneve"], "unclaimed_route", "ethertype:0x6558", 1)
    assert names(inside(17, udp(5, 6081, b"\x40" + gen[1:])))[1] == "plugin_error"
    ntp = b"\x23\2" + b"\0" * 10 + b"GPS\0" + b"\xff" * 32
    got = dissect.dissect(spark.createDataFrame([(0, 1, 90, 1, inside(17, udp(123, 9, ntp)))], "packet_no long, ts long, origlen int, link_type int, data binary")).first()
    last = {f.name: f for f in got.layers[-1].fields}
    assert got.stop == "complete" and got.layers[-1].key == "040003" + b"ntp".hex().upper() and last["app"].text == "ntp" and last["mode"].num == 3 and bytes(last["xmit_ts"].raw) == b"\xff" * 8
    assert names(inside(17, udp(123, 9, b"\x20" + ntp[1:])))[1] == "plugin_error"
    assert names(inside(58, bytes([135, 0]) + b"\0" * 6 + b"z"))[1:] == ("truncated", None, 1) and names(inside(58, bytes([128, 0]) + b"\0" * 6 + b"z"))[1] == "terminal"


def test_capture_formats():
    frames = [(1_500_000, b"abc"), (2_000_001, b"defgh")]
    for order in "<>":
        for magic, unit in ((0xA1B2C3D4, 1), (0xA1B23C4D, 1000)):
            raw = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 101)
            for ts, d in frames:
                raw += struct.pack(order + "IIII", ts // 10**6, ts % 10**6 * unit, len(d), len(d) + 4) + d
            assert list(pcap.records(raw)) == [(ts, len(d) + 4, 101, d) for ts, d in frames]
            assert len(list(pcap.records(raw[:-1]))) == 1
    block = lambda o, kind, body: struct.pack(o + "II", kind, len(body) + 12) + body + struct.pack(o + "I", len(body) + 12)
    for o in "<>":
        raw = block(o, 0x0A0D0D0A, struct.pack(o + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(o, 1, struct.pack(o + "HHI", 1, 0, 0) + struct.pack(o + "HHB3xHH", 9, 1, 9, 0, 0))
        raw += block(o, 6, struct.pack(o + "IIIII", 0, 0, 3_000_000_000, 3, 9) + b"abc\0") + block(o, 3, struct.pack(o + "I", 2) + b"hi\0\0")
        assert list(pcap.records(raw)) == [(3_000_000, 9, 1, b"abc"), (0, 2, 1, b"hi")]
    with pytest.raises(ValueError):
        pcap.records(b"nothing")


def test_stops_and_unclaimed_groups(spark):
    rows = [(0, 5, 60, 1, eth(A, B, 0x0800, ip(H1, H2, 17, udp(55555, 55555, b"z" * 9)))), (1, 6, 60, 1, eth(A, B, 0x0800, ip(H1, H2, 17, udp(55555, 55555, b"z" * 4)))), (2, 7, 6, 1, b"abcdef"), (3, 8, 0, 1, None), (4, 9, 1, None, b"x")]
    got = dissect.dissect(spark.createDataFrame(rows, "packet_no long, ts long, origlen int, link_type int, data binary"))
    assert {(r.stop_class, r.stop): r.packets for r in dissect.stop_summary(got).collect()} == {("unknown_payload", "unclaimed_route"): 3, ("malformed", "truncated"): 1, ("clean", "complete"): 1}
    g = {r.route: tuple(r) for r in dissect.unclaimed(got).collect()}
    assert g["udp_port:55555"] == ("udp", "udp_port:55555", 2, 13, 4, 9, 5, 6) and g["link:None"][0] is None


def test_registry():
    with pytest.raises(ValueError):
        routes([*PROTOCOLS, PROTOCOLS[0]])
    with pytest.raises(ValueError):
        routes(add={"udp_port:1": "nothing"})
    assert routes(add={"udp_port:9": "vxlan"})["udp_port:9"].name == "vxlan" and "udp_port:4789" not in routes(remove=("udp_port:4789",))


def _odd_frames():
    draw = random.Random(3)
    raw = lambda n: bytes(draw.randrange(256) for _ in range(n))
    port = lambda: draw.choice([53, 80, 7, 31000, 65535]).to_bytes(2, "big")
    for _ in range(600):
        proto = draw.choice([6, 6, 17, 17, 1])
        head = raw(12) + draw.choice([b"\x08\x00"] * 8 + [b"\x86\xdd"]) + bytes([draw.choice([0x45] * 9 + [0x46, 0x55])]) + raw(5) + draw.choice([b"\0\0"] * 6 + [b"\x20\x01"]) + raw(1) + bytes([proto]) + raw(10)
        body = port() + port() + raw(8) + bytes([draw.choice([0x50] * 6 + [0x60, 0x40])]) + raw(7) if proto == 6 else port() + port() + raw(4)
        whole = head + body + raw(draw.choice([0, 1, 5, 40]))
        yield whole if draw.random() < 0.8 else whole[: draw.randrange(len(whole) + 1)], draw.choice([1, 1, 1, 1, 101, None])
    yield from [(None, 1), (b"", 1)]


@pytest.mark.parametrize("depth", dissect.DEPTHS)
def test_usual_frames_equal_the_walk(spark, depth):
    """Most frames of this kind are read in numpy; all agree with the walk, and the hits with packet_hits."""
    frames = list(_odd_frames())
    made = dissect.dissect(spark.createDataFrame([(i, 5, 100, t, d) for i, (d, t) in enumerate(frames)], "packet_no long, ts long, origlen int, link_type int, data binary"), depth=depth, diagnose=True)
    table = routes()
    usual, rest = dissect.split(pa.array([d for d, _ in frames], pa.binary()), pa.array([t for _, t in frames], pa.int32()), dissect.usual_of(table, 32, None, None))
    assert len(rest) > 100 and len(frames) - len(rest) > 50 and len(usual) == 2
    for r in made.collect():
        data, link = frames[r.packet_no]
        layers, stop, route, left = dissect.walk(data or b"", link, table, depth=depth)
        got = [x.asDict(True) for x in r.layers]
        for x in [f for y in got for f in y["fields"]]:
            x["raw"] = None if x["raw"] is None else bytes(x["raw"])
        assert (got, r.stop, r.stop_class, r.route, r.opaque_len) == (layers, stop, dissect.STOP_CLASSES[stop], route, left)
        lost = r.stop_class == "unknown_payload" and bool(layers)
        assert (r.sample is not None) == lost and (not lost or bytes(r.sample) == data[len(data) - left :][:256])
        assert not lost or [(x.protocol, x.score) for x in r.near_misses] == [(p.name, n) for n, p in dissect.scores(data[len(data) - left :], table, layers[-1]["protocol"])[:5]]


def test_hits_equal_packet_hits(spark):
    packets = spark.createDataFrame([(i, i * 3, 100 + i, t, d) for i, (d, t) in enumerate(_odd_frames())], "packet_no long, ts long, origlen int, link_type int, data binary")
    want = forest.packet_hits(dissect.dissect(packets, depth="none"))
    assert sorted(map(tuple, dissect.hits(packets).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
