import json

from pyspark.sql import functions as F

from wirelore.operators import ioc
from wirelore.plans.analysis import analyze_capture
from wirelore.plans.chart_catalog import CATALOG, chart_data
from wirelore.plans.ticket_reports import ticket_reports
from wirelore.schemas import ECS_SCHEMA
from wirelore.sinks import tables


def test_capture_to_report(spark, tmp_path):
    rows = ['"frame.time_epoch","ip.src","ip.dst","tcp.srcport","tcp.dstport","_ws.col.Protocol"']
    rows += [f'"{1706732400 + 60 * i}","192.168.1.100","10.0.0.5","{50000 + i}","443","TCP"' for i in range(12)]
    (tmp_path / "p.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "conn.log").write_text("#fields\n1706732400.4\tC1\t192.168.1.100\t50000\t10.0.0.5\t443\ttcp\tssl\t1\t2\t3\tSF\n")
    (tmp_path / "alert").write_text("01/31-20:20:00.000000 [**] [1:5:1] scan [**] [Priority: 1] {TCP} 192.168.1.100:50001 -> 9.9.9.9:1\n")
    result = analyze_capture(
        spark, str(tmp_path / "p.csv"), str(tmp_path / "store"), str(tmp_path / "tickets"), str(tmp_path / "report"),
        str(tmp_path / "conn.log"), str(tmp_path / "alert"), 2024, ticket_id="SOC-1")
    assert result == {"events_inserted": 12, "primary_indicator": "10.0.0.5", "sightings": 12}
    stored = tables.read_events(spark, str(tmp_path / "store")).orderBy("t").collect()
    assert [r.zeek_uid for r in stored[:2]] == ["C1", None] and [r.alert_sid for r in stored[:3]] == [None, 5, None]
    report = json.loads("".join(p.read_text() for p in (tmp_path / "report").glob("*.json")))
    assert report["summary"]["total_events"] == 12 and "T1071" in {t["technique_id"] for t in report["ttps"]}
    assert report["historical_stats"]["threat_ratio"] == 0.5
    assert spark.read.parquet(str(tmp_path / "tickets")).first().ioc_value == "10.0.0.5"


def test_ticket_report(spark):
    ts = F.to_timestamp_ntz(F.lit("2024-01-10 10:00:00"))
    dns = spark.createDataFrame([("a", "b", "x.evil.com", "TXT")] * 7 + [("a", "c", "notevil.com", "A")], "src_ip string, dst_ip string, query string, qtype_name string")
    far = dns.limit(1).withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-12 10:00:01")))
    logs = {"dns": dns.withColumn("ts", ts).unionByName(far)}
    tickets = spark.createDataFrame(
        [("1", "domain", "evil.com", "Threat"), ("2", "domain", "evil.com", None), ("3", "domain", "none.org", None)],
        "ticket_id string, ioc_type string, ioc_value string, outcome string").withColumns({
            "t0": F.to_timestamp_ntz(F.lit("2024-01-11 10:00:00")), "created_at": ts, "status": F.lit("open"), "severity": F.lit("high")})
    rows = {r.ticket_id: r for r in ticket_reports(logs, tickets).collect()}
    assert rows["2"].current_window.total_ioc_sightings == 7 and rows["2"].history.threat_ratio == 1.0
    assert rows["1"].history.total_tickets == 1 and rows["1"].history.threat_ratio is None
    assert "T1572" in [t.technique_id for t in rows["2"].observed_ttps]
    assert rows["3"].current_window.total_ioc_sightings == 0 and rows["3"].confidence.assessment == "False-positive-consistent"


def test_peer_shares_without_keys(spark):
    found = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d")], "src_ip string, dst_ip string")
    row = ioc.peer_concentration(ioc.peer_counts(found, []), []).first()
    assert (row.total, row.top1_share, row.concentration_level) == (6, 0.5, "low")


def test_every_chart_plans(spark):
    empty = spark.createDataFrame([], ECS_SCHEMA)
    assert len(CATALOG) > 100
    for cid in CATALOG:
        assert chart_data(cid, empty).columns


def test_drop_tables(spark):
    spark.sql("create table if not exists purified_events (a int) using parquet")
    tables.drop_tables(spark)
    assert not spark.catalog.tableExists("purified_events")
