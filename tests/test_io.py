import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wirelore.operators import charts
from wirelore.operators.normalize import events_from_packets
from wirelore.sinks import tables
from wirelore.sources import alerts, generic, packets, sessions, warehouse

LINE = ("01/31-20:45:12.123456 [**] [1:2100498:7] GPL ATTACK_RESPONSE id check returned root [**] "
        "[Classification: Potentially Bad Traffic] [Priority: 2] {TCP} 192.0.78.212:80 -> 192.168.1.8:52917")


def test_alert_line(spark):
    lines = spark.createDataFrame([(LINE,), ("noise [**]",)], "value string")
    row = alerts.parse_alert_lines(lines, 2024).collect()
    assert len(row) == 1 and row[0].sid == 2100498 and row[0].priority == 2 and row[0].dst_port == 52917
    assert row[0].ts == datetime(2024, 1, 31, 20, 45, 12, 123456) and row[0].classification == "Potentially Bad Traffic"
    ecs = alerts.alerts_as_ecs(alerts.parse_alert_lines(lines, 2024)).first()
    assert ecs["risk_score"] == 60 and ecs["alert_id"] == "1:2100498:7" and ecs["network.community_id"].startswith("1:")


def test_packet_file_to_store(spark, tmp_path):
    source = tmp_path / "capture.csv"
    source.write_text(
        '"frame.time_epoch","ip.src","ipv6.src","ip.dst","tcp.srcport","udp.srcport","udp.dstport","_ws.col.Protocol","dns.qry.name"\n'
        '"1706732400.5","192.168.1.100","","8.8.8.8","","54321","53","DNS","google.com"\n'
        '"","1.1.1.1","","8.8.8.8","","1","2","DNS",""\n'
        '"1706732401","0.0.0.0","","8.8.8.8","abc","","2","DNS",""\n'
        '"1706732402","","fe80::1","0.0.0.0","0","","0","TCP",""\n')
    events = events_from_packets(packets.read_packet_fields(spark, str(source)), "capture.csv")
    path = str(tmp_path / "store")
    assert tables.append_events(events, path) == 2
    assert tables.append_events(events, path) == 2
    rows = tables.read_events(spark, path).orderBy("t").collect()
    assert len(rows) == 4
    assert (rows[0].si, rows[0].sp, rows[0].dp, rows[0].pr, rows[0].dns_query) == ("192.168.1.100", 54321, 53, "dns", "google.com")
    assert (rows[3].si, rows[3].di, rows[3].sp, rows[3].dp) == ("fe80::1", None, None, None)


def test_session_lines(spark):
    good = "1.5\tC1\ta\t1\tb\t2\ttcp\t-\t0.1\t5\t6\tSF"
    rows = sessions.parse_session_lines(spark.createDataFrame([("#fields",), (good,), ("1\t2",), (good.replace("\t1\t", "\tx\t"),)], "value string")).collect()
    assert [(r.uid, r.orig_p, r.service, r.conn_state) for r in rows] == [("C1", 1, None, "SF")]


def test_header_words(spark):
    assert generic.map_headers(["packets", "ts", "Src IP", "dst_port", "octets"]) == {
        "ts": "@timestamp", "Src IP": "source.ip", "dst_port": "destination.port", "octets": "network.bytes"}


def test_content_discovery(spark):
    df = spark.createDataFrame([("10.0.0.1", "8.8.8.8", "55", "100000"), (None, "9.9.9.9", "80", "7")], "a string, b string, p string, q string")
    assert generic.discover(df) == {"a": "source.ip", "b": "destination.ip", "p": "source.port"}


def test_loader_rejects_unknown(spark):
    with pytest.raises(ValueError):
        generic.load_file(spark, "x.pcapx")


def test_cidr_blocks(spark):
    blocks = spark.createDataFrame([("8.8.9.7/23", None, "1")], "network string, geoname_id string, registered_country_geoname_id string")
    places = spark.createDataFrame([("1", "AA", "Aland")], "geoname_id string, country_iso_code string, country_name string")
    row = warehouse.geo_blocks(blocks, places).first()
    assert (row.lo, row.hi, row.country_code) == (0x08080800, 0x080809FF, "AA")


def test_zero_filled_series_keeps_the_total(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(base.replace(minute=m, second=s), v) for m, s, v in [(0, 0, 5), (0, 59, 6), (20, 0, 7)]], "`@timestamp` timestamp, v long")
    rows = charts.time_series(df, {"total": ("sum", "v"), "n": ("count", None), "std": ("std", "v")}).orderBy("bucket").collect()
    assert len(rows) == 21 and sum(r.total for r in rows) == 18 and rows[1].total == 0 and rows[20].std == 0
    short = charts.time_series(df.limit(2), {"n": ("count", None)}, width=5).collect()
    assert len(short) == 12


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", "b", "tcp", None, None)], "t double, si string, di string, pr string, zeek_service string, alert_msg string")
    tables.export_table(df, str(tmp_path / "j"), "json")
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text)["si"] == "a"
    assert tables.table_view(df).first().Timestamp == "1970-01-01T00:00:01.000Z"
