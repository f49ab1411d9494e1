import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from wirelore.operators import charts, detect, enrich, filters, ttp


def test_exact_medians_equal_a_plain_median(spark):
    rng = random.Random(3)
    values = [(b, float(rng.choice([rng.randint(0, 5), rng.gauss(0, 100)]))) for b in (0, 60, 120) for _ in range(rng.randint(1, 400))] + [(180, 7.0)]
    rows = spark.createDataFrame(values, "bucket long, _v double").groupBy("bucket", "_v").agg(F.count("*").alias("_k"))
    got = {r.bucket: r["median"] for r in charts.exact_medians(rows).collect()}
    assert got == pytest.approx({b: statistics.median(v for k, v in values if k == b) for b in (0, 60, 120, 180)})


def test_a_bucket_of_a_million_values(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(0).cast("long").alias("bucket"), ((F.col("id") * 7919) % n).cast("double").alias("_v"), F.lit(1).cast("long").alias("_k"))
    found = charts.exact_medians(rows)
    assert [r["median"] for r in found.collect()] == [(n - 1) / 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


BLOCKS = "lo long, hi long, country_code string, country_name string"
NET = 20 << 24


def plain_country(blocks, n):
    over = [(lo, -hi, code) for lo, hi, code, _ in blocks if lo <= n <= hi]
    return max(over)[2] if over else "XX"


def dotted(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def looked_up(spark, blocks, numbers):
    frame = spark.createDataFrame(blocks, BLOCKS)
    ips = spark.createDataFrame([(dotted(n),) for n in numbers], "ip string")
    return {r.ip: r.country_code for r in enrich.geo_of_addresses(ips, frame).collect()}


def test_sweep_of_nested_and_of_crossing_blocks(spark):
    rng = random.Random(8)
    nested = []

    def split(lo, hi, depth):
        nested.append((lo, hi, f"C{len(nested)}", "n"))
        while depth and hi - lo > 4 and rng.random() < 0.9:
            a = rng.randint(lo, hi)
            b = min(hi, a + rng.randint(0, (hi - lo) // 2))
            split(a, b, depth - 1)
            lo = b + 1
    split(NET + 100, NET + 200_000, 5)
    nested += [(lo, hi, "AA", "same") for lo, hi, *_ in nested[:5]]
    crossing = [(a := (21 << 24) + rng.randint(0, 3000), a + rng.randint(0, 500), f"X{i}", "n") for i in range(60)]
    blocks = nested + crossing
    numbers = [NET + rng.randint(0, 200_200) for _ in range(500)] + [(21 << 24) + k for k in range(0, 3600, 7)] + [x for b in nested[:60] for x in (b[0], b[1], b[1] + 1)]
    assert looked_up(spark, blocks, numbers) == {dotted(n): plain_country(blocks, n) for n in numbers}


def test_a_network_full_of_blocks_takes_a_sort(spark):
    frame = spark.range(65_536).select((F.col("id") + NET).alias("lo"), (F.col("id") + NET).alias("hi"), F.concat(F.lit("C"), F.col("id")).alias("country_code"), F.lit("n").alias("country_name"))
    frame = frame.unionByName(spark.createDataFrame([(NET - 5, NET + 70_000, "ALL", "n")], BLOCKS))
    ips = spark.createDataFrame([(dotted(NET + n),) for n in (0, 17, 65_535, 65_536, 69_999)], "ip string")
    start = time.perf_counter()
    got = {r.ip: r.country_code for r in enrich.geo_of_addresses(ips, frame).collect()}
    assert got == {dotted(NET + n): f"C{n}" for n in (0, 17, 65_535)} | {dotted(NET + n): "ALL" for n in (65_536, 69_999)}
    assert time.perf_counter() - start < 60


def test_written_pages(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(40)])) for i in range(1000)]
    table = spark.createDataFrame(rows, "id long, v int").repartition(5)
    for descending in (False, True):
        path = str(tmp_path / f"pages-{descending}")
        filters.write_pages(table, path, "v", descending, ["id"], 6)
        bounds = filters.page_bounds(spark, path)
        assert sum(n for *_, n in bounds) == 1000 and len(bounds) > 1
        for number in (1, 2, 7, 20, 21):
            want = filters.page(table, "v", descending, number, 50, ["id"]).collect()
            assert filters.read_page(spark, path, bounds, number, 50).collect() == want
    deep = filters.read_page(spark, path, bounds, 19, 50)
    # The filter reaches the folders and the rows; nothing before the page is sorted or skipped.
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Offset" not in plan and "_place" in plan.split("PushedFilters")[1].split("]")[0]


def test_tls_evidence_has_every_destination(make_events):
    rows = [dict(t=float(i), si="a", di=f"10.0.0.{i}", dp=443, pr="tls", tls_ja3=f"f{i}") for i in range(9)]
    found = ttp.detect_patterns(make_events(rows)).filter("pattern = 'tls_no_sni'").collect()
    assert {e for r in found for e in r.evidence if e.startswith("Destination: ")} == {f"Destination: 10.0.0.{i}" for i in range(9)}


def test_detectors_count_the_events_once(make_events):
    plan = detect.all_detectors(make_events([dict(t=1.0, si="a", di="b", dp=1, pr="icmp", dns_query="x.y")] * 12))
    assert plan.filter("category = 'protocol_anomalies'").count() == 1
