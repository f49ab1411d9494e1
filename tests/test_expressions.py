import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from wirelore.functions import addresses, attack, layers, text
from wirelore.operators import rules, scoring, validate
from wirelore.operators.correlate import merge_groups, parse_blocks, with_correlation
from wirelore.operators.history import verdict_history


def one(spark, value, expression, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expression(F.col("x")).alias("y")).first().y


def test_string_entropy(spark):
    for s in ["", "aaaa", "abcd", "the quick brown fox", "ééàx..x"]:
        n = len(s)
        want = -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if s else 0.0
        assert math.isclose(one(spark, s, text.string_entropy), want, abs_tol=1e-9)
    assert one(spark, None, text.string_entropy) == 0.0


def test_payload(spark):
    assert one(spark, "00:ff:00:ff", text.payload_entropy) == 1.0
    assert one(spark, "xyz", text.payload_entropy) is None


def flow_id(spark, *ends):
    df = spark.createDataFrame([ends], "a string, b string, p int, q int, t string")
    return addresses.add_flow_id(df, "a", "b", "p", "q", "t", "id").first().id


def test_flow_id_vectors(spark):
    assert flow_id(spark, "128.232.110.120", "66.35.250.204", 34855, 80, "tcp") == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="
    assert flow_id(spark, "66.35.250.204", "128.232.110.120", 80, 34855, "TCP") == "1:LQU9qZlK+B5F3KDmev6m5PMibrg="
    assert flow_id(spark, "unknown", "66.35.250.204", 1, 2, "tcp") == "none"


def test_flow_id_of_ipv6(spark):
    import base64
    import ipaddress
    import struct

    a, b = "fe80::200:86ff:fe05:80da", "2001:db8::1"
    x, y = ipaddress.ip_address(b).packed, ipaddress.ip_address(a).packed
    body = struct.pack("!H", 0) + x + y + struct.pack("!BBHH", 17, 0, 53, 4000)
    want = "1:" + base64.b64encode(hashlib.sha1(body).digest()).decode()
    assert flow_id(spark, a, b, 4000, 53, "udp") == want == flow_id(spark, b, a, 53, 4000, "udp")


def test_names_and_ports(spark):
    assert one(spark, "a.b.example.com", text.second_level_label) == "example"
    assert one(spark, "localhost", text.second_level_label) == "localhost"
    assert one(spark, 0, addresses.clean_port, "int") is None
    assert [one(spark, x, addresses.clean_address) for x in ("0.0.0.0", "::", "N/A", "1.2.3.4")] == [None, None, None, "1.2.3.4"]


def test_alert_labels(spark):
    assert tuple(one(spark, "ET scan Beacon", attack.signature_mapping)) == ("Discovery", "T1046")
    assert tuple(one(spark, None, attack.signature_mapping)) == ("Unknown", "None")
    assert one(spark, "plain", attack.signature_label) == "General/Unknown"
    assert [one(spark, x, attack.priority_risk) for x in ("1", "2", "3", "x")] == [90, 60, 30, 10]


def test_layers(spark):
    df = spark.createDataFrame([("eth:ip:tcp:http", 1), ("eth:ip:udp", 53), (None, 443), (None, 50000), (None, None), ("eth", None)], "s string, p int")
    assert [r.y for r in df.select(layers.osi_layer(F.col("s"), F.col("p")).alias("y")).collect()] == [7, 4, 7, 4, 3, 2]


def test_weighted_score(spark):
    score = one(spark, 0.8, lambda x: scoring.weighted_score(x, F.lit(5 / 7)), "double")
    assert math.isclose(score, 0.75 * 0.8 + 0.25 * 5 / 7)
    assert one(spark, score, scoring.assessment, "double") == "THREAT-CONSISTENT"


def test_history_of_unresolved_indicator(spark):
    df = spark.createDataFrame([("ip", "a", None, None), ("ip", "b", "MALICIOUS", None)], "ioc_type string, ioc_value string, verdict string, created_at timestamp")
    assert {r.ioc_value: r.threat_ratio for r in verdict_history(df).collect()} == {"a": 0.5, "b": 1.0}


def test_rules_keep_the_first_of_a_technique(spark):
    row = {"dns_sightings": 20, "has_dns_details": True, "txt_queries": 6, "unique_queries": 51, "nxdomain": 11, "has_http_details": True,
           "post_requests": 1, "unique_user_agents": 6, "has_tls_details": True, "smtp_sightings": 1, "rdp_sightings": 1, "telnet_sightings": 1,
           "top1_share": 0.9, "coverage": 3, "bucket_count": 3, "bucket_avg": 2.0, "bucket_variance": 0.1}
    ttps = rules.map_techniques(spark.createDataFrame([row])).first().observed_ttps
    assert [(t.technique_id, t.confidence) for t in ttps] == [
        ("T1572", 0.75), ("T1071.001", 0.7), ("T1021.004", 0.7), ("T1583.001", 0.65), ("T1573.002", 0.65), ("T1021.001", 0.65)]
    only = rules.map_techniques(spark.createDataFrame([{"dns_sightings": 2}])).first().observed_ttps
    assert [t.justification for t in only] == ["DNS queries observed to IOC-related domain (2 sightings)"]


def correlate_texts(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    return with_correlation(df.withColumn("blocks", parse_blocks(F.col("text"))))


FLOW = "[FLOW]\nsrc_ip=1.1.1.1\ndst_ip=2.2.2.2\nsrc_port=5\ndst_port=6\nproto=tcp"


def test_every_rung_of_the_cascade(spark):
    end = "1.1.1.1:5->2.2.2.2:6"
    cases = {
        "[META]\nframe_number=9\n" + FLOW: ("frame.number=9", "packet", "high"),
        "[META]\npcap_packet_id=3": ("pcap_packet_id=3", "packet", "high"),
        "[META]\nts_precise=7.5\n" + FLOW + "\n[PROTO:IP]\nid=1\n[PROTO:TCP]\nseq=2": (f"ts=7.5,5tuple={end}/tcp,ip_id=1,tcp_seq=2", "packet", "medium"),
        FLOW + "\n[PROTO:DNS]\ntxid=4": (f"dns_id=4,5tuple={end}", "transaction", "medium"),
        FLOW + "\n[PROTO:HTTP]\nstream_id=4": (f"http_stream=4,5tuple={end}", "transaction", "medium"),
        FLOW + "\n[PROTO:TLS]\nhandshake_id=4": (f"tls_handshake=4,5tuple={end}", "transaction", "medium"),
        "[PROTO:DNS]\nid=8": ("dns_id=8", "transaction", "low"),
        "[META]\nzeek_uid=C1\n" + FLOW: ("zeek_uid=C1", "flow", "medium"),
        "[META]\nts=1970-01-01T00:01:00.5\n" + FLOW: (f"5tuple={end}/tcp,ts_bucket=60", "flow", "low"),
        FLOW: (f"5tuple={end}/tcp", "flow", "low"),
        "[META]\nts=5": (None, None, None),
    }
    rows = correlate_texts(spark, *cases).orderBy("ord").collect()
    assert [(r.corr_key, r.corr_level, r.corr_confidence) for r in rows] == list(cases.values())


def test_merge_prefers_longer_then_first(spark):
    a = "[META]\nzeek_uid=C1\n[PROTO:ZZZ]\nk=1\n[PROTO:IDS]\nid=7\n[PROTO:TCP]\nseq=11\nack=1"
    b = "[META]\nzeek_uid=C1\n[PROTO:TCP]\nseq=99\nack=22\n[FLOW]\nproto=tcp"
    group = merge_groups(correlate_texts(spark, a, b), "ord").first()
    assert group.corr_id == "flow_" + hashlib.md5(b"zeek_uid=C1").hexdigest()[:8]
    assert group.blocks == ["[META]\nzeek_uid=C1", "[FLOW]\nproto=tcp", "[PROTO:TCP]\nack=22\nseq=11", "[PROTO:ZZZ]\nk=1", "[PROTO:IDS]\nid=7"]
    ok = validate.gate(merge_groups(correlate_texts(spark, a, b), "ord")).first()
    assert ok.status == "VALID" and ok.summary == "validation_summary=passed (1 CORR_GROUPs validated)"


def test_no_groups_is_a_violation(spark):
    empty = merge_groups(correlate_texts(spark, "[META]\nts=5"), "ord")
    verdict = validate.gate(empty).first()
    assert (verdict.status, verdict.violations) == ("INVALID", 1)
