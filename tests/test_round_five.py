"""Steps that later findings named: number texts, sizes of tasks."""

import random

from pyspark.sql import functions as F

from wirelore.functions.text import one_decimal
from wirelore.operators import correlate, ttp
from wirelore.sources import sessions


def test_one_decimal_is_rounded_from_the_exact_value(spark):
    dice = random.Random(5)
    numbers = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.95, 0.96, 9.95, 99.95, 0.049999999, 439458.25, 439458.75, 1234567.35, 1e13 + 0.25, 3e15, -0.25, -7.35]
    numbers += [dice.randrange(10**7) / 20 for _ in range(500)] + [dice.randrange(10**7) / 8 for _ in range(500)] + [dice.random() * 10**dice.randrange(-3, 7) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", one_decimal(F.col("x")).alias("text")).collect()
    assert [(r["x"], r["text"]) for r in rows if r["text"] != f"{r['x']:.1f}"] == []


def test_beaconing_evidence_of_whole_seconds(spark, make_events):
    """Four intervals with a mean of 10.25 seconds: the tie goes to the even digit."""
    events = make_events([{"t": 1_700_000_000.0 + t, "si": "a", "di": "b", "dp": 80} for t in (0, 10, 20, 30, 41)])
    texts = {r["evidence"][2] for r in ttp.beaconing_pattern(events, max_cv=0.6).collect()}
    assert texts == {"Interval: 10.2s (±0.4s)"}


def test_merged_groups_sort_by_a_hash_of_their_key(spark):
    """Keys that begin alike are told apart by a hash first; the longest value of a fact wins, blocks and facts keep their order."""
    rows = [("k1", "flow", "low", f"p{i}", [("FLOW", {"b": "x" * (i % 3), "a": f"v{i}"}), (None, {"n": "1"}), ("PROTO:IDS", {"id": "7"}), ("META", {"ts": "0"})]) for i in range(5)]
    rows += [("k2", "packet", "high", "q", [("PROTO:DNS", {"c": "d"}), ("EMPTY", {})]), (None, None, None, "r", [("FLOW", {"a": "b"})])]
    df = spark.createDataFrame(rows, "corr_key string, corr_level string, corr_confidence string, ord string, blocks array<struct<type:string,kv:map<string,string>>>")
    merged = correlate.merge_groups(df, "ord")
    assert {r["corr_key"]: r["blocks"] for r in merged.collect()} == {
        "k1": ["[META]\nts=0", "[FLOW]\na=v0\nb=xx", "n=1", "[PROTO:IDS]\nid=7"], "k2": ["[PROTO:DNS]\nc=d"]}
    plan = correlate.merge_groups(df, "ord")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 2, "a shuffle for the facts and one for the groups"


def test_session_log_rows_stay_in_their_split(spark, tmp_path):
    """The heads go to the rows; rows are not shuffled by file, where a task would read whole files."""
    for name, head in (("a.log", "#fields\tts\tuid\n"), ("b.log", "#fields\tuid\tts\n")):
        (tmp_path / name).write_text(head + "".join(f"{i}\t{i + 100}\n" for i in range(3)))
    rows = sessions.read_session_log(spark, str(tmp_path))
    assert sorted((r["ts"], r["uid"]) for r in rows.collect()) == sorted([(str(i), str(i + 100)) for i in range(3)] + [(str(i + 100), str(i)) for i in range(3)])
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sessions.read_session_log(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
