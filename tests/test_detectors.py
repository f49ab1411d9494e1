import math
import random

from pyspark.sql import functions as F

from wirelore.operators import detect, ttp

T0 = 1706732400.0


def flows(n, step, **more):
    return [{"t": T0 + step(i), "si": "192.168.1.100", "di": "10.0.0.5", "dp": 443, "pr": "tcp", **more} for i in range(n)]


def test_beaconing_every_minute(make_events):
    events = make_events([{**r, "sp": 50000 + i} for i, r in enumerate(flows(10, lambda i: 60.0 * i))])
    row = detect.beaconing(events).first()
    assert row.flagged and row.confidence == "HIGH" and row.events == 10
    assert row.interval_avg == 60.0 and row.cv == 0.0 and abs(row.entropy) < 1e-9
    techniques = {r.technique_id for r in ttp.techniques_of(ttp.detect_patterns(events)).collect()}
    assert "T1071" in techniques


def test_random_gaps_are_not_beaconing(make_events):
    rng = random.Random(1)
    times = sorted(rng.uniform(0, 5000) for _ in range(40))
    assert not detect.beaconing(make_events(flows(40, lambda i: times[i]))).first().flagged


def test_gaps_agree_with_sorting_across_slices(make_events):
    rng = random.Random(7)
    times = [rng.randrange(0, 5000) for _ in range(400)]
    events = make_events(flows(400, lambda i: float(times[i])))
    ordered = sorted(times)
    want = {}
    for a, b in zip(ordered, ordered[1:]):
        want[float(b - a)] = want.get(float(b - a), 0) + 1
    got = {r.gap: r.n for r in detect.gaps(events, ["si"], slice_seconds=60).groupBy("gap").agg(F.sum("n").alias("n")).collect()}
    assert got == want


def test_port_and_network_scan(make_events):
    ports = [{"t": T0 + i, "si": "a", "di": "10.0.0.5", "dp": 80 + i, "pr": "tcp"} for i in range(51)]
    hosts = [{"t": T0 + i, "si": "b", "di": f"10.0.1.{i}", "dp": 80, "pr": "tcp"} for i in range(16)]
    rows = {r.si: r for r in detect.scan_metrics(make_events(ports + hosts)).collect()}
    assert rows["a"].type == "port_scan" and rows["a"].confidence == "HIGH" and rows["a"].duration == 50.0
    assert rows["b"].type == "network_scan" and rows["b"].confidence == "MEDIUM"


def test_dns_tunnel_and_excess(make_events):
    name = "abcdefghijklmnopqrst" * 3
    rows = [{"t": T0, "si": "a", "pr": "dns", "dns_query": name}]
    rows += [{"t": T0 + i, "si": "a", "pr": "dns", "dns_query": f"x{i}.evil.com"} for i in range(21)]
    events = make_events(rows)
    hit = detect.dns_tunnel_queries(events).filter("flagged").collect()
    assert len(hit) == 1 and hit[0].confidence == "HIGH" and math.isclose(hit[0].entropy, math.log2(20))
    assert hit[0].query == name
    excess = {r.domain: r.flagged for r in detect.dns_excess(events).collect()}
    assert excess["evil"] is True
    assert detect.dns_tunnel_queries(make_events(rows[:4])).filter("flagged").count() == 0


def test_large_transfer(make_events):
    events = make_events(flows(2, lambda i: i, bytes_sent=60_000_000))
    assert detect.large_transfers(events).first().flagged
    assert not detect.large_transfers(events.limit(1)).first().flagged


def test_outliers(spark):
    df = spark.createDataFrame([(1000, 10)] * 100 + [(1_000_000, 10), (1000, 95)], "volume long, risk_score int")
    found = {(r.volume, r.risk_score): r.anomaly_type for r in detect.outliers(df, "volume").filter("flagged").collect()}
    assert found == {(1_000_000, 10): "Volume Outlier (Large)", (1000, 95): "Statistical Risk Outlier, Critical Risk Signature"}


def test_time_gaps_find_all_pauses(spark):
    times = [0.0, 0.05, 0.3, 0.3, 1.0, 1.05, 700.0, 1300.5]
    df = spark.createDataFrame([(x,) for x in reversed(times)], "t double")
    got = [(r.t, round(r.delta, 6)) for r in detect.time_gaps(df, slice_seconds=600).collect()]
    assert got == [(0.3, 0.25), (1.0, 0.7), (700.0, 698.95), (1300.5, 600.5)]


def test_few_events_give_no_findings(make_events):
    nine = make_events(flows(9, lambda i: 60.0 * i))
    assert detect.all_detectors(nine).count() == 0
    ten = detect.all_detectors(make_events(flows(10, lambda i: 60.0 * i))).collect()
    assert [r.category for r in ten] == ["beaconing"]
