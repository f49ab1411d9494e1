import random

from wirelore.operators import enrich, fusion, ioc

SESSION = "uid string, ts double, orig_h string, orig_p int, resp_h string, resp_p int, service string, conn_state string"
EVENT = "event_id long, t double, si string, sp int, di string, dp int"


def test_first_session_in_range_wins(spark):
    events = spark.createDataFrame([
        (1, 100.0, "a", 1, "b", 2), (2, 200.0, "a", 1, "b", 2), (3, 300.0, "a", 1, "b", 2), (4, 400.0, "a", None, "b", None),
        (5, 100.0, None, 1, "b", 2)], EVENT)
    sessions = spark.createDataFrame([
        ("late", 100.5, "a", 1, "b", 2, "s", "x"), ("early", 99.2, "a", 1, "b", 2, "s", "x"),
        ("edge", 201.0, "a", 1, "b", 2, "s", "x"), ("beyond", 301.001, "a", 1, "b", 2, "s", "x"),
        ("any", 400.2, "a", 77, "b", 88, "s", "x"), ("other", 99.0, "a", 9, "b", 2, "s", "x")], SESSION)
    got = {r.event_id: r.zeek_uid for r in enrich.match_sessions(events, sessions).collect()}
    assert got == {1: "early", 2: "edge", 3: None, 4: "any", 5: None}


def test_sessions_against_brute_force(spark):
    rng = random.Random(3)
    port = lambda: rng.choice([None, 1, 2])
    events = [(i, rng.randrange(0, 400) / 8, rng.choice("ab"), port(), "z", port()) for i in range(300)]
    sessions = [(f"u{i}", rng.randrange(0, 400) / 8, rng.choice("ab"), rng.choice([1, 2]), "z", rng.choice([1, 2]), "s", "x") for i in range(120)]
    want = {}
    for eid, t, si, sp, di, dp in events:
        hits = [(ts, uid) for uid, ts, h, p, _, q, *_ in sessions
                if h == si and (sp is None or p == sp) and (dp is None or q == dp) and abs(ts - t) <= 1.0]
        want[eid] = min(hits)[1] if hits else None
    matched = enrich.match_sessions(spark.createDataFrame(events, EVENT), spark.createDataFrame(sessions, SESSION))
    got = {r.event_id: r.zeek_uid for r in matched.collect()}
    assert got == want


def test_alert_ends(spark):
    events = spark.createDataFrame([(1, 5.0, "a", 10, "b", 20), (2, 1.0, "c", 11, "d", 21), (3, 0.0, "c", 12, "e", None)], EVENT)
    columns = "alert_key long, src_ip string, src_port int, dst_ip string, dst_port int"
    alerts = spark.createDataFrame([
        (1, "a", 10, "x", 1), (2, "x", 1, "d", 21), (3, "a", 99, "x", 1), (4, "c", None, "q", 1), (5, "x", 1, "e", 5)], columns)
    got = {r.alert_key: r.event_id for r in enrich.match_alerts(alerts, events).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 3, 5: 3}


def test_geography(spark):
    blocks = spark.createDataFrame([
        (0x08000000, 0x080000FF, "AA", "Aland"), (0x08000100, 0x0802FFFF, "BB", "Beland")],
        "lo long, hi long, country_code string, country_name string")
    ips = ["10.1.1.1", "127.0.0.1", "8.0.0.0", "8.0.0.255", "8.0.1.0", "8.2.255.255", "8.3.0.0", "nonsense", "fe80::1", "2001:db9::1"]
    found = enrich.geo_of_addresses(spark.createDataFrame([(x,) for x in ips], "ip string"), blocks).collect()
    got = {r.ip: (r.country_code, r.is_external) for r in found}
    assert got == {
        "10.1.1.1": ("PRIVATE", False), "127.0.0.1": ("PRIVATE", False), "8.0.0.0": ("AA", True), "8.0.0.255": ("AA", True),
        "8.0.1.0": ("BB", True), "8.2.255.255": ("BB", True), "8.3.0.0": ("XX", True), "nonsense": ("XX", False),
        "fe80::1": ("PRIVATE", False), "2001:db9::1": ("XX", True)}


def test_fusion_prefers_session_totals(spark):
    ddl = """`@timestamp` timestamp, `source.ip` string, `source.port` int, `destination.ip` string, `destination.port` int,
        `network.transport` string, `network.protocol` string, `network.bytes` long, risk_score int, alert_id string,
        osi_stack string, `alert.message` string, `data.source` string, `network.community_id` string"""
    row = lambda source, protocol, size, flow, msg=None, alert=None: (
        None, "a", 1, "b", 2, "tcp", protocol, size, 10, alert, "ip", msg, source, flow)
    events = spark.createDataFrame([
        row("zeek", "HTTP", 500, "f1"), row("tshark", "TCP", 40, "f1"), row("tshark", "TCP", 60, "f1"),
        row("zeek", "-", None, "f2"), row("tshark", "DNS", 40, "f2"), row("tshark", "DNS", 60, "f2"),
        row("snort", "ids_alert", 7, "f3", "nmap scan", "1:2:3"), row("tshark", "TCP", 1, "none")], ddl)
    got = {r["network.community_id"]: r for r in fusion.fuse(events).collect()}
    assert set(got) == {"f1", "f2", "f3"}
    assert (got["f1"]["network.protocol"], got["f1"]["network.bytes"], got["f1"]["fused_sources"]) == ("HTTP", 500, "tshark, zeek")
    assert (got["f2"]["network.protocol"], got["f2"]["network.bytes"], got["f2"]["mitre_attack"]) == ("DNS", 100, "None / Benign")
    assert (got["f3"]["network.protocol"], got["f3"]["alert_id"], got["f3"]["mitre_attack"]) == ("unknown", "1:2:3", "Discovery (T1046)")


def test_contains_join_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    texts = sorted({word(rng.randrange(0, 14)) for _ in range(60)})
    needles = sorted({word(rng.randrange(1, 8)) for _ in range(30)})
    got = ioc.contains_join(
        spark.createDataFrame([("k", x) for x in texts], "kind string, text string"),
        spark.createDataFrame([("k", x) for x in needles], "kind string, needle string"))
    assert sorted((r.text, r.needle) for r in got.collect()) == sorted((t, n) for t in texts for n in needles if n in t)
