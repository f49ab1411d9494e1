"""Cases that earlier results got wrong."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wirelore import session
from wirelore.operators import charts, correlate, enrich, filters, ttp
from wirelore.plans.analysis import analyze_capture
from wirelore.sinks import tables
from wirelore.sources import generic, sessions


def test_a_quote_is_an_ordinary_character_of_a_session_log(spark, tmp_path):
    head = "#separator \\x09\n#fields\tuid\tts\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\torig_bytes\n"
    (tmp_path / "a.log").write_text(head + 'C1\t1.5\t10.0.0.1\t1\t10.0.0.2\t2\ttcp\t"ssl\t77\n')
    (tmp_path / "b.log").write_text('{"ts": "2.5", "id.orig_h": "10.0.0.3", "service": "dns"}\n')
    rows = {r["id.orig_h"]: r for r in sessions.read_session_log(spark, str(tmp_path)).collect()}
    assert rows["10.0.0.1"]["service"] == '"ssl' and rows["10.0.0.1"]["orig_bytes"] == "77" and rows["10.0.0.1"]["ts"] == "1.5"
    assert rows["10.0.0.3"]["service"] == "dns"


def test_files_of_a_log_folder_are_told_apart(spark, tmp_path):
    folder = tmp_path / "mixed.log"
    folder.mkdir()
    (folder / "a").write_text('{"ts": "2.5", "id.orig_h": "10.0.0.3", "service": "dns"}\n')
    (folder / "b").write_text("time,src,dst\n7,10.0.0.8,10.0.0.9\n")
    got = {r["source.ip"]: r["data.source"] for r in generic.load_file(spark, str(folder)).collect()}
    assert got == {"10.0.0.3": "zeek", "10.0.0.8": "csv_mystery"}


def test_a_late_host_name_is_no_address(spark):
    rows = [(f"10.0.0.{i}", str(i)) for i in range(30)] + [("host.example", "70000")]
    assert generic.discover(spark.createDataFrame(rows, "a string, p string")) == {}


def test_history_is_read_before_the_new_ticket(spark, tmp_path):
    rows = ['"frame.time_epoch","ip.src","ip.dst","tcp.srcport","tcp.dstport","_ws.col.Protocol"'] + ['"1706732400","192.168.1.100","10.0.0.5","5","443","TCP"'] * 3
    (tmp_path / "p.csv").write_text("\n".join(rows) + "\n")
    for i, want in enumerate((0, 1)):
        analyze_capture(spark, str(tmp_path / "p.csv"), str(tmp_path / "s"), str(tmp_path / "t"), str(tmp_path / f"r{i}"), ticket_id=f"SOC-{i}")
        assert spark.read.json(str(tmp_path / f"r{i}")).first().historical_stats.total_tickets == want


def test_equal_alerts_stay_apart(spark, tmp_path):
    line = "01/31-20:20:00.000000 [**] [1:5:1] scan [**] [Priority: 1] {TCP} 192.168.1.100:50001 -> 9.9.9.9:1"
    from wirelore.sources import alerts

    rows = alerts.parse_alert_lines(spark.createDataFrame([(line,)] * 3, "value string"), 2024).withColumn("alert_key", F.monotonically_increasing_id())
    events = spark.createDataFrame([(1.0, 7, "192.168.1.100", 50001, "9.9.9.9", 1)], "t double, event_id long, si string, sp int, di string, dp int")
    got = enrich.attach_alerts(events, enrich.match_alerts(rows, events)).first()
    assert got.alert_count == 3


def test_the_innermost_range_counts(spark):
    outer, inner = (0x08000000, 0x0800FFFF, "AA", "A"), (0x08000100, 0x080001FF, "BB", "B")
    blocks = spark.createDataFrame([outer, inner], "lo long, hi long, country_code string, country_name string")
    ips = spark.createDataFrame([("8.0.0.1",), ("8.0.1.7",), ("8.0.5.1",), ("8.1.0.1",)], "ip string")
    assert {r.ip: r.country_code for r in enrich.geo_of_addresses(ips, blocks).collect()} == {"8.0.0.1": "AA", "8.0.1.7": "BB", "8.0.5.1": "AA", "8.1.0.1": "XX"}


def test_of_a_repeated_key_the_last_counts(spark):
    df = spark.createDataFrame([("[META]\na=1\nb=2\na=3",)], "x string").select(correlate.parse_blocks(F.col("x")).alias("b"))
    assert df.first().b[0].kv == {"a": "3", "b": "2"}


def test_a_count_of_a_metric_leaves_nulls_out(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "x"), (datetime(2024, 1, 1), None)], "`@timestamp` timestamp, alert_id string")
    assert charts.time_series(df, {"n": ("count", "alert_id"), "all": ("count", None)}).first().asDict() == {"bucket": 1704067200, "n": 1.0, "all": 2.0}


def test_a_far_time_does_not_stop_the_series(spark):
    times = [datetime(2024, 1, 1), datetime(2190, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "`@timestamp` timestamp")
    assert charts.time_series(df, {"n": ("count", None)}, width=60).agg(F.sum("n").alias("n")).first().n == 2


def test_every_scanner_is_reported(make_events):
    rows = [{"t": float(i), "si": s, "di": "d", "dp": i, "pr": "tcp"} for s in "abc" for i in range(30)]
    assert {r.evidence[0] for r in ttp.scan_pattern(make_events(rows)).collect()} == {"Source: a", "Source: b", "Source: c"}


def test_a_time_filter_prunes_date_folders(spark, make_events, tmp_path):
    path = str(tmp_path / "store")
    from wirelore.operators.normalize import align
    from wirelore.schemas import EVENT_SCHEMA

    tables.append_events(align(make_events([{"t": 86400.0 * d + 5, "si": "a"} for d in range(4)]), EVENT_SCHEMA), path)
    found = filters.query_events(tables.read_events(spark, path), start=86400.0, end=2 * 86400.0 + 10)
    assert [r.t for r in found.collect()] == [172805.0, 86405.0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(), "x")
