import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wirelore.operators import ioc, window_index

SIGHTING = "ioc_type string, ioc_value string, log_type string, matched_field string, ts timestamp_ntz, src_ip string, dst_ip string"
TICKET = "ticket_id string, ioc_type string, ioc_value string, t0 timestamp_ntz"
START = datetime(2024, 3, 1)


def some_sightings(rng, n, days):
    rows = []
    for _ in range(n):
        # Whole hours and repeated times are as likely as odd ones.
        ts = START + rng.choice([timedelta(hours=rng.randint(0, 24 * days)), timedelta(seconds=rng.uniform(0, 86400 * days))])
        log = rng.choice(["conn", "dns"])
        rows.append(("ip", rng.choice("abc"), log, rng.choice(["src_ip", "dst_ip"]), ts, rng.choice(["1", "2", "", None, "3"]), rng.choice(["2", "4", None])))
    return rows + rows[: n // 10] + [("ip", "a", "conn", "src_ip", None, "9", "9")]


def some_tickets(rng, n, days):
    rows = [(f"t{i}", "ip", rng.choice("abcd"), START + rng.choice([timedelta(hours=rng.randint(-30, 24 * days + 30)), timedelta(seconds=rng.uniform(0, 86400 * days))])) for i in range(n)]
    return rows + [("same", *rows[0][1:]), ("none", "ip", "a", None)]


@pytest.mark.parametrize("seed, hours, days", [(1, 24, 6), (2, 1, 2), (3, 5, 40)])
def test_totals_equal_window_pairs(spark, seed, hours, days):
    rng = random.Random(seed)
    found = spark.createDataFrame(some_sightings(rng, 300, days), SIGHTING)
    tickets = spark.createDataFrame(some_tickets(rng, 25, days), TICKET)
    pairs = ioc.in_ticket_windows(found, tickets, hours)
    found = window_index.near_windows(found, tickets, hours)
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))
    assert rows(window_index.ticket_aggregate(found, tickets, hours)) == rows(ioc.window_aggregate(pairs, ["ticket_id"]))
    assert rows(window_index.ticket_assets(found, tickets, hours)) == rows(ioc.window_assets(pairs, ["ticket_id"]))


def test_conditions_equal_window_pairs(spark):
    rng = random.Random(7)
    found = spark.createDataFrame(some_sightings(rng, 300, 5), SIGHTING)
    tickets = spark.createDataFrame(some_tickets(rng, 20, 5), TICKET)
    key = ["ioc_type", "ioc_value", "t0"]
    pairs = ioc.in_ticket_windows(found, tickets.select(key).distinct(), 24, keep=["t0"])
    got = window_index.window_totals(found, tickets, counts={"from_two": F.col("src_ip") == "2"}).select(*key, "sightings", "from_two")
    want = pairs.groupBy(*key).agg(F.count("*").alias("sightings"), F.count_if(F.coalesce(F.col("src_ip") == "2", F.lit(False))).alias("from_two"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_rows_do_not_grow_with_windows(spark):
    """2000 sightings and 2000 windows that all overlap: a few rows each, not four million."""
    found = spark.range(2000).selectExpr(
        "'ip' as ioc_type", "'a' as ioc_value", "'conn' as log_type", "'src_ip' as matched_field",
        "timestampadd(SECOND, id, timestamp_ntz'2024-03-01') as ts", "string(id % 700) as src_ip", "string(id) as dst_ip")
    tickets = spark.range(2000).selectExpr("string(id) as ticket_id", "'ip' as ioc_type", "'a' as ioc_value", "timestampadd(SECOND, id, timestamp_ntz'2024-03-01') as t0")
    written = []
    original = window_index.cut_lineage

    def counting(df, label):
        out = original(df, label)
        written.append(out.count())
        return out

    window_index.cut_lineage = counting
    try:
        rows = window_index.ticket_aggregate(found, tickets).collect()
    finally:
        window_index.cut_lineage = original
    assert {(r.sightings, r.distinct_src, r.distinct_dst) for r in rows} == {(2000, 700, 2000)} and len(rows) == 2000
    assert written == [2 * 2000 + 2 * 700 + 2 * 2000 + 2000]


def test_empty_tables_and_short_windows(spark):
    found, tickets = spark.createDataFrame([], SIGHTING), spark.createDataFrame([], TICKET)
    one = spark.createDataFrame(some_tickets(random.Random(1), 3, 2), TICKET)
    assert window_index.ticket_aggregate(found, one).count() == 0 and window_index.ticket_assets(found, tickets).count() == 0
    with pytest.raises(ValueError):
        window_index.window_totals(found, one, 0)
