"""Sessions, lifecycles, condensation, the filter language, views, sinks and streaming, against plain Python."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowspark.functions import rendering
from flowspark.functions.protocols import standard
from flowspark.operators import condense, dissect, forest, lifecycle, rollups, sessions, views
from flowspark.plans import queries
from flowspark.plans.where import QueryError, compile_where
from flowspark.sources import pcap, tables
from flowspark.streaming import live
from tests.test_packets import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, ts, len(d), 1, d) for i, (ts, d) in enumerate(session())]
    return dissect.dissect(spark.createDataFrame(rows, "packet_no long, ts long, origlen int, link_type int, data binary"))


@pytest.fixture(scope="module")
def view(spark, made):
    obs = rollups.of_fields(rollups.observations(made)).filter("kind = 'accumulate'")
    held = obs.select("path", F.col("field").alias("name"), F.explode(F.split("kept", ",")).alias("text")).withColumn("num", F.col("text").cast("double"))
    return tables.written(views.records(forest.streams(forest.packet_hits(made)), None, lifecycle.stream_states(made), held), "view")


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_creation_order_for_any_partitioning(spark, parts):
    nodes = spark.range(3000).select(F.hash("id").cast("string").alias("path"), (F.col("id") * 7919 % 3000).alias("first_packet"), (F.col("id") % 3).alias("depth")).repartition(parts)
    got = forest.created_seq(nodes).orderBy("created_seq").collect()
    assert [r.created_seq for r in got] == list(range(3000)) and [r.first_packet for r in got] == sorted(r.first_packet for r in got)


def test_a_straggler_does_not_move_the_deadline(spark):
    rows = spark.createDataFrame([("a", 0, 0, False), ("a", 1, 10, True), ("a", 2, 12, False), ("a", 3, 30, False), ("a", 4, 31, True), ("a", 5, 46, False), ("b", 6, 5, None), ("b", 7, 105, False)], "k string, n long, ts long, c boolean")
    got = sessions.idle_sessions(rows, ["k"], "ts", "n", 100, F.col("c"), 15)
    assert {r.n: r.session for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 0, 7: 1}
    ends = {(r.k, r.session): r.reason for r in sessions.session_ends(got, ["k"], "ts", 100, F.col("c"), 15).collect()}
    assert ends == {("a", 0): "protocol_close", ("a", 1): "protocol_close", ("a", 2): "capture_end", ("b", 0): "idle_timeout", ("b", 1): "capture_end"}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_machines_fold_in_blocks(spark, block):
    lines = {"a": [2, 18, 16, 24, 17, 17], "b": [16, 1, 17], "c": [2, 4, 16], "d": [None, 2], "e": [2, 18, 18, 16, 20]}
    rows = spark.createDataFrame([(k, i, x) for k, v in lines.items() for i, x in enumerate(v)], "k string, n long, e long")
    got = {r.k: (r.state, r.closed) for r in lifecycle.fold(rows, ["k"], "n", F.col("e"), lifecycle.MACHINES["tcp"], block).collect()}
    assert got == {"a": ("closed", True), "b": ("closed", True), "c": ("reset", True), "d": ("syn_sent", False), "e": ("reset", True)}
    sctp = spark.createDataFrame([("x", i, e) for i, e in enumerate([1, 2, 10, 11, 0, 7, 8])] + [("y", 0, 0), ("y", 1, 6)], "k string, n long, e long")
    assert {r.k: r.state for r in lifecycle.fold(sctp, ["k"], "n", F.col("e"), lifecycle.MACHINES["sctp"], block).collect()} == {"x": "closed", "y": "aborted"}


def plain_condense(rows, most):
    tally, known, out = defaultdict(Counter), {}, defaultdict(lambda: [0, 0, 0, 0, set()])
    for parent, x, y, src, no, size in sorted(rows, key=lambda r: r[4]):
        a, b = sorted((x, y))
        dst = b if src == a else a
        count, flow = tally[parent], (parent, a, b)
        if flow not in known:
            known[flow] = count[a] >= most or count[b] >= most
            if not known[flow]:
                count.update({a, b})
        full = [z for z in (src, dst) if count[z] >= most] if known[flow] else []
        key, side = ((parent, full[0], None, None), full[0]) if full else ((parent, None, a, b), a)
        got = out[key]
        way = 0 if src == side else 1
        got[way] += 1
        got[2 + way] += size
        if full:
            got[4].add(b if full[0] == a else a)
    return {(*k, *v[:4], len(v[4])) for k, v in out.items()}


def test_condensed_flows_match_a_plain_scan(spark):
    import random

    draw = random.Random(8)
    for ends, most in ((6, 2), (12, 3), (40, 4)):
        rows = []
        for n in range(1500):
            a, b = f"x{draw.randrange(ends) if draw.random() < 0.7 else 0}", f"y{draw.randrange(3 * ends)}"
            rows.append((f"p{n % 3}", a, b, draw.choice([a, b]), n, draw.randint(1, 9)))
        rows.append(("p0", "same", "same", "same", 9000, 1))
        got = condense.condense(spark.createDataFrame(rows, "parent string, a string, b string, src string, packet_no long, size long"), most).collect()
        assert {(r.parent, r.anchor, r.a, r.b, r.packets_ab, r.packets_ba, r.bytes_ab, r.bytes_ba, r.members) for r in got} == plain_condense(rows, most)


def test_filters_on_packets(view):
    ask = lambda text: {r.protocol for r in compile_where(text).filter(view).collect()}
    assert ask("state == closed") == {"tcp"} and ask("closed") == {"tcp"} and ask("live") == {"ethernet", "ipv4"} and ask("reason == protocol_close") == {"tcp"}
    assert ask("port == 8443") == {"tcp"} and ask("port > 50000") == set() and ask("port != 8443") == {"tcp"}
    assert ask("endpoint == 172.16.9.7") == {"ipv4"} and ask("host contains 198.51") == {"ipv4"} and ask("parent != ipv4") == {"ethernet", "ipv4"} and ask('parent == ""') == {"ethernet"}
    assert ask("flags == 18") == {"tcp"} and ask("protocol is TCP and dst_port == 8443") == {"tcp"} and ask("ethertype == 2048") == {"ethernet"}
    assert ask("dur >= 4s") == {"ethernet", "ipv4", "tcp"} and ask("nope != 1") == set() and ask("not nope == 1") == {"ethernet", "ipv4", "tcp"} and ask("#2") == {"tcp"} and ask("in ethernet root") == set()
    assert ask("condensed") == set() and ask("/tcp #\\d .* closed$/") == {"tcp"} and ask("proto == /^(tcp|ipv4)$/") == {"tcp", "ipv4"}
    with pytest.raises(QueryError):
        compile_where("/" + "a" * (1 << 20) + "b/")


def test_records_and_lines(spark, made, view):
    by = {r.protocol: r for r in view.collect()}
    assert by["tcp"].endpoints == ":40100 ↔ :8443" and by["ipv4"].endpoints == "172.16.9.7 ↔ 198.51.100.20" and by["ethernet"].endpoints == "02:00:00:00:00:01 ↔ 02:00:00:00:00:02"
    assert by["tcp"].ports == [40100.0, 8443.0] and by["tcp"].state == "closed"
    lines = [r.line for r in views.tree_lines(view).orderBy("place").collect()]
    assert lines[0].startswith("ethernet #0") and lines[1].startswith("└─ ipv4 #1") and lines[2].startswith("   └─ tcp #2 :40100 ↔ :8443 7 pkts") and lines[2].endswith("[closed]")
    assert views.frame(view, 2)[-1] == "… and 1 more"
    assert views.lineage(view).filter("path like '%tcp%'").first().lineage.startswith("ethernet #0 (02:00:00:00:00:01 ↔ 02:00:00:00:00:02) ▸ ipv4 #1")
    doc = json.loads(views.document(view, "a.pcap").first().document)
    assert doc["mode"] == "offline" and [s["protocol"] for s in doc["streams"]] == ["ethernet", "ipv4", "tcp"] and doc["streams"][2]["a_to_b"]["packets"] + doc["streams"][2]["b_to_a"]["packets"] == 7
    first = json.loads(views.packet_records(made).orderBy("index").first().json)
    assert first["layers"] == ["ethernet", "ipv4", "tcp"] and first["stop_class"] == "clean"
    assert "ethernet ▸ ipv4 ▸ tcp" in views.packet_lines(made).first().line
    assert views.summary_text({"packets": 7, "bytes": 1000, "streams_created": 3}, {"clean": 7}, [("tcp", 1)]).startswith("7 packets, 1,000 bytes")


def test_selection_windows_and_search(view):
    assert views.select(view, "#2").first().protocol == "tcp" and views.select(view, "tcp 8443 40100").first().id == 2 and views.select(view, "tcp 172.16.9.7:40100 198.51.100.20:8443").first().id == 2
    for bad in ("#9", "udp 1 2", "tcp 1.1.1.1:40100 8443", "what"):
        with pytest.raises(ValueError):
            views.select(view, bad)
    rows, total, matched = views.window(view, "roots", where=compile_where("proto == tcp"))
    assert [r.protocol for r in rows.collect()] == ["ethernet"] and (total, matched) == (1, 1)
    rows, total, _ = views.window(view, by="first_seen", ascending=True, limit=9999)
    assert [r.id for r in rows.collect()] == [2, 1, 0] and total == 3
    matches, visible, n = views.search(view, compile_where("tcp"))
    assert (matches.count(), visible.count(), n) == (1, 3, 1)
    assert forest.children(view, view.filter("depth = 0").first().path).count() == 1 and views.full_forest(view).count() == 3
    with pytest.raises(ValueError):
        forest.sort_columns("size")


def test_finish_is_deepest_first(view):
    assert [(r.depth, r.closed) for r in sessions.finish(view).collect()] == [(2, "protocol_close"), (1, "capture_end"), (0, "capture_end")]


def test_renderings(spark):
    show = lambda raw, name="x_addr": spark.range(1).select(rendering.value_bytes(name, F.lit(raw))).first()[0]
    import ipaddress

    for text in ("::", "::1", "fe80::1", "2001:db8::1:0:0:1", "2001:db8:0:1:1:1:1:1", "1:2:3:4:5:6:7:8", "1:0:0:2::3", "a::"):
        assert show(bytearray(ipaddress.ip_address(text).packed)) == text, text
    assert show(bytearray(ipaddress.ip_address("::ffff:192.0.2.1").packed)) == "::ffff:192.0.2.1"
    assert show(bytearray(b"\1\2\3\4")) == "1.2.3.4" and show(bytearray(b"\1\2\3\4"), "spi") == "01020304" and show(bytearray(b"\1\2\3\4\5\6"), "x") == "01:02:03:04:05:06" and show(bytearray(b"a" * 33), "x").endswith("61…")


def test_unknown_registry_and_samples(spark, tmp_path):
    frames = queries.frames(spark, SF)
    groups = dissect.unknown_registry(dissect.dissect(frames, diagnose=True), samples=2)
    top = dissect.unknown_table(groups, min_count=2, top=3)
    assert top.count() == 3 and len(pcap.export_samples(top, str(tmp_path))) == 6 and json.loads((tmp_path / "manifest.json").read_text())[0]["count"] >= 2
    assert dissect.unknown_registry(dissect.dissect(frames, diagnose=True), max_groups=5).count() == 5


def test_rollups_by_specification(made):
    got = {(r.field, r.kind): r.kept for r in rollups.of_fields(rollups.observations(made), clamp=2).collect()}
    assert got["flags", "accumulate"] == "2,18,16,24,17" and got["flags", "series"].count(",") == 1 and got["flags", "series"].startswith("17@11000000/")
    keys_only = rollups.observations(made.withColumn("layers", F.transform("layers", lambda x: x.withField("fields", F.array().cast("array<struct<name:string,num:bigint,raw:binary,text:string>>")))))
    assert keys_only.count() == 0


def test_streaming_sessions_and_snapshots(spark, tmp_path):
    rows = [("a", 0, False), ("a", 10, True), ("a", 12, False), ("a", 30, False), ("b", 5, False), ("b", 300, False), ("z", 5000, False)]
    spark.createDataFrame(rows, "k string, s long, c boolean").selectExpr("k", "timestamp_seconds(s + 1000) as t", "c").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp, c boolean").parquet(str(tmp_path / "in"))
    out = live.live_sessions(stream, "k", "t", 100_000_000, "c", 15_000_000, "1 second")
    q = out.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.session): (r.events, r.reason) for r in spark.table("ended").collect()}
    assert got[("a", 0)] == (3, "protocol_close") and got[("b", 0)] == (1, "idle_timeout")
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps" / "a.pcap").write_bytes(pcap.write_pcap(session()))
    build = lambda packets: views.records(forest.streams(forest.packet_hits(dissect.dissect(packets))))
    run = live.run_snapshots(live.pcap_stream(spark, str(tmp_path / "caps")), build, str(tmp_path / "store"), str(tmp_path / "pub"), "once").start()
    run.awaitTermination(120)
    snap, status = live.latest(spark, str(tmp_path / "pub"))
    assert status["generation"] == 0 and snap.count() == 3
    events = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "pub" / "events")).collect()]
    assert Counter(e["event"] for e in events) == {"stream_new": 3}
    assert pcap.stats(pcap.read_pcap(spark, str(tmp_path / "caps"), most=5)).first()["packets"] == 5


def test_records_compute_what_is_read(spark, made):
    """A query of counters reads no keys, children or numbers, and key fields need no search through the key."""
    view = views.records(forest.streams(forest.packet_hits(made)), second=1)
    plan = view.select("path", "packets")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "conv(", "transform("))
    plan = view.select("key_fields", "endpoints")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "aggregate(" not in plan


def test_known_fields_equal_those_found_in_the_key(spark, made):
    nodes = tables.written(forest.streams(forest.packet_hits(made)), "known")
    checked = set()
    for name, identity in views.identities(standard()).items():
        if identity[2]:
            found = rendering.key_fields(rendering.key_parts(F.col("key")), F.col("initiator"), *identity[:2])
            known = rendering.known_fields(F.col("key"), F.col("initiator"), *identity)
            rows = nodes.filter(F.col("protocol") == name).select(F.array(*found).alias("a"), F.array(*known).alias("b")).collect() if name in ("ethernet", "ipv4", "tcp", "udp") else []
            assert all(r.a == r.b for r in rows)
            checked |= {name} if rows else set()
    assert {"ethernet", "ipv4", "tcp"} <= checked


@pytest.mark.parametrize("step, extra", [(1, []), (5, []), (1, [10**12])])
def test_creation_order_with_gaps(spark, step, extra):
    rows = [(str(i), i * step, d) for i in range(400) for d in (1, 0)] + [(f"x{n}", n, 0) for n in extra]
    got = forest.created_seq(spark.createDataFrame(rows, "path string, first_packet long, depth int")).collect()
    assert [r.created_seq for r in sorted(got, key=lambda r: (r.first_packet, r.depth))] == list(range(len(rows)))


def test_clamped_rollups_read_the_packets_once(spark, made):
    """One pass over the packets for a kind and field that is asked for, the same rollups as without a condition, and caps
    of series below the clamp hold."""
    obs = rollups.observations(made)
    one = rollups.of_fields(obs, 2).filter("kind = 'accumulate' and field = 'protocol'")
    assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    every = rollups.of_fields(obs, 2).collect()
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in every if (r.kind, r.field) == ("accumulate", "protocol"))
    rows = spark.createDataFrame([("p", "series", "f", 2, i, i, 0, str(i)) for i in range(5)], "path string, kind string, field string, cap int, ord long, ts long, dir int, value string")
    assert [rollups.of_fields(rows, n).first().kept for n in (1, 3, None)] == ["4@4/0", "3@3/0,4@4/0", "3@3/0,4@4/0"]


def test_tree_meets_only_parents(spark):
    """Places for paths of three levels, against a sort in Python; roots and siblings tie by creation."""
    rows = [(f"r{r}" + "".join(f"/c{c}" for c in down), r * 7 % 5 * 10 + sum(down), r * 100 + sum(down) * 10 + len(down)) for r in range(12) for down in [(), (1,), (2,), (1, 1), (1, 2), (2, 1)]]
    nodes = spark.createDataFrame([(p, p.rpartition("/")[0] or None, p.count("/"), b, b, 0, b, n) for p, b, n in rows], "path string, parent string, depth int, bytes long, packets long, first_seen long, last_seen long, first_packet long")
    key = {p: (-b, n) for p, b, n in rows}
    want = sorted(key, key=lambda p: [key["/".join(p.split("/")[: i + 1])] for i in range(p.count("/") + 1)])
    got = forest.tree(nodes).orderBy("place").collect()
    assert [r.path for r in got] == want and {r.path for r in got if r.last and r.depth == 2} == {p for p in want if p.endswith(("/c1/c1", "/c2/c1"))}
