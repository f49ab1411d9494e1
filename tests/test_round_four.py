"""Steps that met hot keys or too many groups in earlier rounds."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wirelore.operators import ioc, window_sweep
from wirelore.plans import ticket_reports
from wirelore.streaming import beacons

T = datetime(2024, 3, 1)


def brute_sightings(logs, indicators):
    out = []
    for log_type, rows in logs.items():
        for row in rows:
            for kind, field, column, way in ((k, f, c, w) for k, t, c, f, w in ioc.MATCH_RULES if t in (None, log_type)):
                value = row.get(column)
                for wanted_kind, wanted in indicators:
                    if value is None or wanted is None or wanted_kind != kind:
                        continue
                    hit = value == wanted or (way == "suffix" and value.endswith("." + wanted)) or (way == "contains" and wanted != "" and wanted in value)
                    if hit:
                        out.append((wanted_kind, wanted, field, log_type, row["ts"], value))
    return sorted(out)


def test_sightings_meet_values_and_deal_out_hot_ones(spark):
    """A log row offers one look-up per rule, whatever suffixes its names share; values above the spread are dealt out without a loss."""
    http = [{"ts": T + timedelta(seconds=i), "src_ip": "10.0.0.1", "dst_ip": f"10.0.0.{i % 3}", "host": ["www.a.com", "b.com", "com", None][i % 4],
             "uri": f"/p/{i % 5}?u=1", "user_agent": "agent/1"} for i in range(40)]
    mail = [{"ts": T, "src_ip": None, "dst_ip": "10.0.0.2", "mailfrom": "x@a.com", "rcptto": f"x@a.com,y{i}@b.com"} for i in range(6)]
    logs = {
        "http": spark.createDataFrame([tuple(r.values()) for r in http], "ts timestamp_ntz, src_ip string, dst_ip string, host string, uri string, user_agent string"),
        "smtp": spark.createDataFrame([tuple(r.values()) for r in mail], "ts timestamp_ntz, src_ip string, dst_ip string, mailfrom string, rcptto string")}
    wanted = [("domain", "com"), ("domain", "a.com"), ("domain", "www.a.com"), ("ip", "10.0.0.1"), ("ip", "10.0.0.2"), ("url", "/p/3"), ("url", ""),
              ("email", "x@a.com"), ("email", "y2@"), ("user_agent", "agent/1"), ("user_agent", None), ("domain", "agent/1")]
    indicators = spark.createDataFrame(wanted + wanted[:2], "ioc_type string, ioc_value string")
    offered = ioc.stack_logs(logs).selectExpr("max(size(_lookups)) n").first().n
    assert offered == 5  # two addresses, host, uri and agent
    for spread in (3, ioc.SPREAD):
        rows = ioc.sightings(logs, indicators, spread).collect()
        got = sorted((r.ioc_type, r.ioc_value, r.matched_field, r.log_type, r.ts,
                      r[r.matched_field.split(".")[-1]]) for r in rows)
        assert got == brute_sightings({"http": http, "smtp": mail}, wanted)


def test_connections_share_the_state_of_a_bucket(spark, tmp_path):
    """Many connections (a missing and a long port among them) are held in few state rows and come out one by one as they fall silent."""
    big = 2**53 + 1
    events = [(f"s{i % 50}", "d", None if i % 3 == 0 else big, 1.7e9 + i * 10.0) for i in range(1500)]
    batches = [events[:700], events[700:], [("end", "d", 1, 1.8e9)], [("end", "d", 1, 1.9e9)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "si string, di string, dp long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("si string, di string, dp long, t double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    made = beacons.interval_stream(stream, ("si", "dp"), buckets=4)
    query = made.writeStream.format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = max((p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]), default=0)
    got = sorted((r.si, r.dp or 0, r.intervals, r.interval_avg, r.interval_stddev) for r in spark.table("buckets").collect())
    assert rows <= 4
    want = {}
    for si, _, dp, t in events:
        want.setdefault((si, dp or 0), []).append(t)
    assert [g[:3] for g in got] == sorted((*k, len(v) - 1) for k, v in want.items()) and len(got) == 100
    for si, dp, _, mean, sd in got:
        times = want[si, dp]
        gaps = [b - a for a, b in zip(times, times[1:])]
        assert abs(mean - sum(gaps) / len(gaps)) < 1e-6 and abs(sd - (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5) < 1e-4


FULL = "ioc_type string, ioc_value string, log_type string, matched_field string, ts timestamp_ntz, " + ", ".join(
    f"{x} string" for x in ("src_ip", "dst_ip", "query", "qtype_name", "rcode_name", "method", "user_agent", "ja3", "mailfrom", "rcptto"))


def test_sweep_equals_window_pairs(spark):
    """Every feature of the report's windows, against sightings joined with windows; whole hours, repeated times and NULLs among them."""
    rng = random.Random(5)
    pick = lambda *of: rng.choice([None, "", *of])
    rows = []
    for _ in range(400):
        at = T + rng.choice([timedelta(hours=rng.randint(0, 150)), timedelta(seconds=rng.uniform(0, 86400 * 6))])
        log = rng.choice(["conn", "dns", "http", "ssl", "smtp"])
        rows.append(("ip", rng.choice("abc"), log, rng.choice(["src_ip", "dst_ip"]), at, pick("1", "2", "3"), pick("2", "4"), pick("q", "r"), pick("TXT", "NULL"),
                     pick("NXDOMAIN", "3"), pick("POST", "GET"), pick("u", "v"), pick("j"), pick("m"), pick("n", "o")))
    rows += rows[:40] + [("ip", "a", "conn", "src_ip", None, *["9"] * 10), ("ip", "n", "conn", "src_ip", T, *[None] * 10)]
    found = spark.createDataFrame(rows, FULL)
    times = [T + rng.choice([timedelta(hours=rng.randint(-30, 180)), timedelta(seconds=rng.uniform(0, 86400 * 6))]) for _ in range(30)]
    windows = spark.createDataFrame([("ip", rng.choice("abcd"), t) for t in times] + [("ip", "a", None), ("ip", "n", T), ("ip", "b", rows[0][4])],
                                    "ioc_type string, ioc_value string, t0 timestamp_ntz").distinct()
    for hours in (24, 3):
        key = ["ioc_type", "ioc_value", "t0"]
        want = ticket_reports.window_features(ioc.in_ticket_windows(found, windows, hours, keep=["t0"]), key)
        got = window_sweep.window_features(found, windows, hours)
        assert sorted(got.columns) == sorted(want.columns) and len(set(got.dtypes) ^ set(want.dtypes)) == 0
        exact = [c for c in sorted(want.columns) if c != "bucket_variance"]
        shown = lambda df: {tuple(r[k] for k in key): (str([r[c] for c in exact]), r.bucket_variance) for r in df.collect()}
        a, b = shown(got), shown(want)
        assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()} and len(a) > 15
        assert all(abs(a[k][1] - b[k][1]) < 1e-9 for k in a)


def test_report_rows_do_not_grow_with_pairs(spark):
    """2000 sightings in 2000 overlapping windows give the sweep a few rows each; every window reads all of them."""
    found = spark.range(2000).selectExpr("'ip' ioc_type", "'a' ioc_value", "'conn' log_type", "'src_ip' matched_field", "timestampadd(SECOND, id, timestamp_ntz'2024-03-01') ts",
                                         "string(id % 7) src_ip", *[f"cast(null as string) {c.split()[0]}" for c in FULL.split(", ")[6:]])
    windows = found.selectExpr("ioc_type", "ioc_value", "ts as t0")
    rows = window_sweep.window_features(found, windows).collect()
    assert len(rows) == 2000 and {(r.total_sightings, r.distinct_src_ip_count, r.top1_share) for r in rows} == {(2000, 7, 286 / 2000)}
