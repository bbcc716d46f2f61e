"""The engine's builder, its answers, the command line and the exact cap."""

import json
import random
import struct

import pytest

from flowspark.__main__ import run
from flowspark.engine import Engine, with_keys
from flowspark.functions.protocols import Protocol
from flowspark.operators import lru
from flowspark.sources import pcap
from tests.test_packets import A, B, H1, H2, eth, ip, session, udp
from tests.test_protocols import DNS


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    folder = tmp_path_factory.mktemp("caps")
    other = [(12 * 10**6, eth(A, B, 0x0800, ip(H1, H2, 17, udp(5000, 53, DNS)))), (13 * 10**6, eth(A, B, 0x0800, ip(H1, H2, 17, udp(7, 55555, b"z" * 20)))), (14 * 10**6, eth(A, B, 0x0800, ip(H1, H2, 17, udp(1701, 1701, struct.pack(">HHIII", 0x8003, 0, 9, 0, 0)))))]
    (folder / "a.pcap").write_bytes(pcap.write_pcap(session() + other))
    return str(folder / "a.pcap")


def test_builder():
    own = Protocol("mine", ("udp_port:9999",), 4, {"n": (0, 32)}, shared=("n",))
    engine = Engine.standard().plugin(own).route("udp_port:9", "mine").unroute("udp_port:53").build()
    assert engine.protocols[-1] is own and engine.depth == "structural" and with_keys("none") == "keys" and with_keys("full") == "full"
    for bad in (Engine.standard().plugin(Protocol("dns", (), 1)), Engine.standard().plugin(Protocol("x", ("udp_port:53",), 1)), Engine.standard().route("udp_port:1", "nothing"), Engine.standard(depth="deep")):
        with pytest.raises(ValueError):
            bad.build()


def test_answers(spark, capture):
    f = Engine.standard(depth="full", diagnose=True, series=3).build().read(spark, capture)
    total = f.totals().first()
    assert (total.packets, total.key_errors) == (10, 1) and [r.stop_class for r in f.stops().collect()][0] == "clean"
    assert {r.protocol: r.ever for r in f.summary().collect()} == {"dns": 1, "ethernet": 1, "ipv4": 1, "tcp": 1, "udp": 3}
    assert {r.protocol for r in f.where("qname == www.example.net").collect()} == {"ethernet", "ipv4", "udp", "dns"}
    assert f.at_layer("udp").count() == 3 and f.at_layer_merged("udp").count() == 3 and f.roots().count() == 1 and f.streams().count() == 7
    assert "udp_port:55555" in {r.route for r in f.unknowns().collect()} and f.unknown_group("udp", "udp_port:55555").first().dumps[0].startswith("0000  7a 7a")
    assert f.packets.select(f.field("dns", "qname")["text"].alias("q")).filter("q is not null").first().q == "www.example.net"
    assert [r.depth for r in f.finish().collect()] == sorted([r.depth for r in f.finish().collect()], reverse=True)
    assert f.stream("#0").first().protocol == "ethernet" and f.evictions(3).count() > 0


def test_command_line(spark, capture):
    def ask(*args):
        said = []
        return run(list(args), spark, said.append), said

    code, lines = ask(capture)
    assert code == 0 and lines[0].startswith("ethernet #0") and len(lines) == 7
    assert ask("streams", "-r", "/nowhere", "--where", "packets > x")[0] == 2
    code, lines = ask("streams", "-r", capture, "--where", "proto == tcp", "--format", "json")
    assert [s["protocol"] for s in json.loads(lines[0])["streams"]] == ["ethernet", "ipv4", "tcp"]
    assert len(ask("packets", "-r", capture, "-c", "4")[1]) == 4 and ask("stream", "-r", capture, "#99")[0] == 1
    assert any("55555" in x for x in ask("unknown", "-r", capture)[1]) and len(ask("streams", "-r", capture, "--layer", "udp")[1]) == 3


def plain_lru(rows, most):
    live, times, out = [], {}, []
    packets = {}
    for path, no in rows:
        packets.setdefault(no, []).append(path)
    for no in sorted(packets):
        for path in sorted(packets[no]):
            if path in live:
                live.remove(path)
            live.append(path)
        while len(live) > most:
            leaf = next((p for p in live if not any(q.rpartition("/")[0] == p for q in live)), None)
            if leaf is None:
                break
            live.remove(leaf)
            out.append((leaf, times.get(leaf, 0), no, len(out)))
            times[leaf] = times.get(leaf, 0) + 1
    return out


def test_exact_cap(spark):
    draw = random.Random(6)
    rows = []
    for no in range(300):
        a, b = draw.randrange(4), draw.randrange(9)
        rows += [(f"r{a}", no), (f"r{a}/c{b}", no)]
    for most in (1, 5, 12):
        got = [tuple(r) for r in lru.evictions(spark.createDataFrame(rows, "path string, packet_no long"), most).orderBy("place").collect()]
        assert got == plain_lru(rows, most)
