import csv
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wirelore.operators import detect
from wirelore.operators.normalize import events_from_packets
from wirelore.schemas import PACKET_FIELDS
from wirelore.sources.packets import read_packet_fields
from wirelore.streaming import beacons, ingest, windows

EVENTS = "t double, si string, di string, dp int, bytes_sent long, bytes_recv long"
T0 = 1_700_000_000.0


def land(folder, name, rows):
    """An export with times, sources and ports; written aside and moved in, as a landing folder asks."""
    folder.mkdir(exist_ok=True)
    aside = folder.parent / f"{name}.part"
    with aside.open("w", newline="") as out:
        writer = csv.DictWriter(out, PACKET_FIELDS, quoting=csv.QUOTE_ALL)
        writer.writeheader()
        for t, si, port in rows:
            writer.writerow({"frame.time_epoch": t, "ip.src": si, "ip.dst": "10.0.0.9", "tcp.dstport": port, "ip.len": 100})
    aside.rename(folder / name)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def stored(spark, store):
    return sorted(ingest.stored_events(spark, store).select("t", "si", "dp", "event_date").collect())


def test_stored_stream_equals_the_batch(spark, tmp_path):
    landing, store, checkpoint = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    land(landing, "a.csv", [(T0 + i, f"10.0.0.{i % 3}", 80 + i) for i in range(40)] + [("not a time", "10.0.0.1", 1)])
    land(landing, "b.csv", [(T0 + 100_000 + i, "10.0.0.5", 443) for i in range(30)])
    stream = lambda: ingest.event_stream(spark, str(landing), files_per_batch=1)
    run(ingest.store_events(stream(), store, checkpoint))
    first = stored(spark, store)
    assert len(first) == 70 and len({p.name for p in (tmp_path / "store").iterdir() if p.is_dir()}) == 2
    # A second start finds nothing new; then a file comes.
    run(ingest.store_events(stream(), store, checkpoint))
    assert stored(spark, store) == first
    land(landing, "c.csv", [(T0 + 5, "10.0.0.7", 22)])
    run(ingest.store_events(stream(), store, checkpoint))
    batch = events_from_packets(read_packet_fields(spark, str(landing)))
    dated = batch.select("t", "si", "dp", F.to_date(F.timestamp_micros((F.col("t") * 1e6).cast("long"))).alias("event_date"))
    assert stored(spark, store) == sorted(dated.collect())


def test_a_repeated_batch_counts_once(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")
    land(landing, "a.csv", [(T0 + i * 50_000, "10.0.0.1", i) for i in range(10)])
    events = events_from_packets(read_packet_fields(spark, str(landing))).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    write = ingest.write_batch(store)
    write(events.limit(3).unionByName(events), 0)  # a first try that wrote other rows
    write(events, 0)
    write(events.limit(0), 1)  # a batch without rows
    assert len(stored(spark, store)) == 10


def test_a_run_that_dies_between_write_and_commit_is_repeated(spark, tmp_path):
    landing, store, checkpoint = tmp_path / "landing", str(tmp_path / "store"), str(tmp_path / "checkpoint")
    land(landing, "a.csv", [(T0 + i, "10.0.0.1", i) for i in range(20)])
    write = ingest.write_batch(store)

    def dies(events, number):
        write(events, number)
        raise RuntimeError("lost after the write")

    events = ingest.event_stream(spark, str(landing))
    with pytest.raises(Exception, match="lost after the write"):
        events.writeStream.foreachBatch(dies).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    assert len(stored(spark, store)) == 20  # written, but not committed
    run(ingest.store_events(ingest.event_stream(spark, str(landing)), store, checkpoint))
    assert len(stored(spark, store)) == 20


def stream_of(spark, folder, batches):
    """A stream of one file per batch; the files' order is that of their times."""
    import os

    folder.mkdir()
    for i, rows in enumerate(batches):
        path = str(folder / f"{i:03d}.json")
        with open(path, "w") as out:
            for row in rows:
                out.write("{" + ", ".join(f'"{k}": {v if not isinstance(v, str) else chr(34) + v + chr(34)}' for k, v in row.items() if v is not None) + "}\n")
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    return with_ts(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder)))


def with_ts(df):
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def collect(df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    run(query)
    return sorted((tuple(r) for r in df.sparkSession.table(name).collect()), key=repr)


def event(t, si="a", di="b", dp=1, sent=10, received=1):
    return {"t": T0 + t, "si": si, "di": di, "dp": dp, "bytes_sent": sent, "bytes_recv": received}


FAR = [event(1e6, "end")]  # moves the watermark past everything else


def batch_rows(spark, rows):
    names = [x.split()[0] for x in EVENTS.split(", ")]
    return with_ts(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENTS))


def closed(rows):
    """Rows of windows that the watermark has passed: all but the marker's."""
    return sorted((tuple(r) for r in rows if "end" not in tuple(r)), key=repr)


@pytest.mark.parametrize("make", [
    lambda e: windows.port_scans(e, "5 minutes", "10 minutes", 3), lambda e: windows.network_scans(e, "5 minutes", "10 minutes", 3),
    lambda e: windows.transfers(e, "10 minutes", "10 minutes", threshold=50), lambda e: windows.activity(e, "10 minutes", "10 minutes", ["si"]),
])
def test_windows_equal_the_batch_on_ordered_input(spark, tmp_path, make):
    rng = random.Random(6)
    rows = sorted((event(rng.uniform(0, 7000), rng.choice("abc"), rng.choice("xyzuvw"), rng.choice([None, *range(30)]), rng.randint(0, 60)) for _ in range(600)), key=lambda r: r["t"])
    stream = stream_of(spark, tmp_path / "in", [rows[i:i + 150] for i in range(0, 600, 150)] + [FAR])
    got = closed(collect(make(stream), f"w{abs(hash(str(tmp_path)))}", tmp_path / "cp"))
    assert got == closed(make(batch_rows(spark, rows)).collect()) and len(got) > 10


def test_late_ports_count_within_the_watermark_only(spark, tmp_path):
    first = [event(i, dp=i) for i in range(10)] + [event(700, dp=99)]  # the watermark reaches 100 s after it
    late = [event(150, dp=50), event(3, dp=3), event(5, dp=77), event(1300, dp=98)]  # the first window is open until 300 s
    too_late = [event(5, dp=78), event(2600, dp=97)]
    stream = stream_of(spark, tmp_path / "in", [first, late, too_late, FAR])
    start = T0 - T0 % 300
    got = {r[0].timestamp() if hasattr(r[0], "timestamp") else r[0]: r[3] for r in collect(windows.port_scans(stream, "5 minutes", "10 minutes"), "late_ports", tmp_path / "cp") if r[2] == "a"}
    counts = Counter()
    for e, ports in ((first + late, None),):
        seen = {(math.floor(r["t"] / 300) * 300, r["dp"]) for r in e}
        counts.update(w for w, _ in seen)
    counts.update(math.floor(r["t"] / 300) * 300 for r in too_late[1:])
    assert sorted(got.values()) == sorted(counts.values()) and start in counts


def test_connection_state_equals_the_batch_detector(spark, tmp_path):
    rng = random.Random(12)
    rows = [event(30 * i + rng.uniform(-0.2, 0.2), "s", "d", 443) for i in range(60)]
    rows += [event(rng.choice([1, 1, 2.5]) * rng.randint(0, 900), rng.choice("xy"), "d", rng.choice([1, 2])) for _ in range(300)]
    rows += [event(50, "few", "d", 9)] * 3
    rows.sort(key=lambda r: r["t"])
    # Neighbouring batches overlap by less than the delay, in both orders.
    batches = [rows[i:i + 60] for i in range(0, len(rows), 60)]
    for a, b in zip(batches, batches[1:]):
        a[-5:], b[:5] = b[:5], a[-5:]
        rng.shuffle(a)
    far = [[event(1e6, "end")], [event(2e6, "end")]]
    stream = stream_of(spark, tmp_path / "in", [*batches, *far])
    made = beacons.beacon_stream(stream, silence=20_000, max_interval=1e6)
    names = ["si", "di", "dp", "intervals", "events", "flagged", "confidence", "interval_avg", "interval_stddev", "entropy", "cv"]
    got = {r[:3]: r[3:] for r in collect(made.select(names), "beacons", tmp_path / "cp")}
    want = {tuple(r)[:3]: tuple(r)[3:] for r in detect.beaconing(batch_rows(spark, rows), max_interval=1e6).select(names).collect()}
    assert got.keys() == want.keys() and len(got) >= 4 and any(v[2] for v in got.values())
    for key, values in want.items():
        assert got[key][:4] == values[:4] and got[key][4:] == pytest.approx(values[4:], abs=1e-6), key


def test_long_steady_intervals(spark):
    """Means of 10^6 s with a deviation of 1 s, to six digits."""
    rng = random.Random(1)
    times, t = [], 0.0
    for _ in range(400):
        t += 1e6 + rng.gauss(0, 1)
        times.append(t)
    gaps = [b - a for a, b in zip(times, times[1:])]
    rows = batch_rows(spark, [event(x, "s", "d", 1) for x in times])
    found = detect.interval_metrics(rows).first()
    real = [b - a for a, b in zip([T0 + x for x in times], [T0 + x for x in times[1:]])]
    assert found.interval_stddev == pytest.approx(statistics.pstdev(real), rel=1e-6) and found.interval_avg == pytest.approx(statistics.fmean(gaps), rel=1e-9)
    own = beacons.Intervals(waiting=[T0 + x for x in times])
    for k in range(0, 400, 7):
        own.take(T0 + times[k])
    own.take(math.inf)
    assert own.metrics()[2] == pytest.approx(statistics.pstdev(real), rel=1e-6)
