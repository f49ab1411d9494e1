"""Adapter views that give the supplied tables the shape of network telemetry.

Each view is one SQL text with a few dialect tokens, so that Spark and the checking SQL start
from the same rows. Spark reads the Parquet files in place and prunes unused columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SPARK_TOKENS = {
    "div": "div",
    "str": "string",
    "k": "cast(get_json_object(props, '$.k') as int)",
    "ep_ts": "unix_micros(cast(ts as timestamp)) / 1e6",
    "ep_ship": "unix_micros(cast(l_shipdate as timestamp)) / 1e6",
    "ep_order": "unix_micros(cast(o_orderdate as timestamp)) / 1e6",
}
DUCK_TOKENS = {
    "div": "//",
    "str": "varchar",
    "k": "cast(json_extract_string(props, '$.k') as int)",
    "ep_ts": "epoch_us(ts) / 1e6",
    "ep_ship": "epoch_us(l_shipdate) / 1e6",
    "ep_order": "epoch_us(o_orderdate) / 1e6",
}

VIEWS = {
    # one row per line item: a large flow table
    "v_flows": """
        select {ep_ship} as t, l_shipdate as ts,
          concat('10.0.', cast(l_suppkey {div} 256 as {str}), '.', cast(l_suppkey % 256 as {str})) as si,
          cast(1024 + l_orderkey % 50000 as int) as sp,
          concat('172.16.', cast(l_partkey {div} 256 as {str}), '.', cast(l_partkey % 256 as {str})) as di,
          case l_linenumber when 1 then 22 when 2 then 53 when 3 then 80 when 4 then 443
            when 5 then 445 when 6 then 3389 else 8080 end as dp,
          case l_returnflag when 'R' then 'dns' when 'A' then 'tls' else 'tcp' end as pr,
          case l_linestatus when 'F' then 'tcp' else 'udp' end as transport,
          cast(floor(l_extendedprice) as bigint) as bytes_sent,
          cast(l_quantity * 100 as bigint) as bytes_recv,
          cast(round(l_discount * 1000) as int) as risk_score,
          l_quantity as duration
        from {lineitem}""",
    # one row per event: alerts, names and tool tags
    "v_events": """
        select event_id, ts, {ep_ts} as t,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as si,
          case when event_type = 'view' then null else cast(1024 + event_id % 500 as int) end as sp,
          concat('172.16.0.', cast({k} % 16 as {str})) as di,
          {k} as dp,
          case event_type when 'click' then 'http' when 'view' then 'tls' when 'signup' then 'tcp'
            when 'purchase' then 'dns' else 'icmp' end as pr,
          case event_type when 'purchase' then 'udp' when 'error' then 'icmp' else 'tcp' end as transport,
          case event_type when 'click' then 'zeek' when 'error' then 'snort' else 'tshark' end as data_source,
          cast(floor(value * 1000) as bigint) as bytes_sent,
          cast(floor(value * 100) as bigint) as bytes_recv,
          value as duration,
          case event_type when 'error' then 50 + {k} % 50 else {k} % 60 end as risk_score,
          case when event_type = 'error' then case {k} % 5 when 0 then 'ET SCAN Nmap probe'
            when 1 then 'C2 Beacon checkin' when 2 then 'CVE-2021 Exploit attempt'
            when 3 then 'SSH Brute Force login' else 'Policy notice' end end as alert_msg,
          case when event_type = 'error' then {k} % 3 + 1 end as alert_priority,
          case when event_type = 'error' then 2100000 + {k} end as alert_sid,
          case when event_type = 'error' then concat('1:', cast(2100000 + {k} as {str}), ':1') end as alert_id,
          concat(cast(user_id as {str}), '-', cast({k} % 10 as {str})) as community_id,
          case event_id % 3 when 0 then 'SF' when 1 then 'S0' else 'REJ' end as conn_state,
          case event_type when 'click' then 'eth:ip:tcp:http' when 'view' then 'eth:ip:tcp:tls'
            when 'signup' then 'eth:ip:tcp' when 'purchase' then 'eth:ip:udp:dns'
            else 'eth:ip:icmp' end as osi_stack,
          case when event_type = 'purchase' then concat('h', cast({k} as {str}), '.d',
            cast(user_id % 20 as {str}), '.example.com') end as dns_query,
          case when event_type = 'click' then concat('www', cast({k} % 10 as {str}), '.site',
            cast(user_id % 7 as {str}), '.org') end as http_host,
          case when event_type = 'click' then concat('/p/', cast({k} as {str}), '?u=',
            cast(user_id as {str})) end as http_uri,
          case when event_type = 'click' then case {k} % 2 when 0 then 'GET' else 'POST' end end as http_method,
          case when event_type = 'click' then case {k} % 4 when 0 then 404 when 1 then 500 else 200 end end as http_status,
          case when event_type = 'click' then concat('agent/', cast({k} % 6 as {str})) end as user_agent,
          case when event_type = 'view' and {k} % 3 <> 0 then concat('cdn', cast({k} % 5 as {str}), '.tls.net') end as tls_sni,
          case when event_type = 'view' then md5(cast({k} % 9 as {str})) end as tls_ja3,
          case when event_type = 'view' then case {k} % 2 when 0 then 'TLS 1.2' else 'TLS 1.3' end end as tls_version
        from {events}""",
    # the session log of another tool, half a second later than the packets it describes
    "v_sessions": """
        select concat('C', cast(event_id as {str})) as uid, {ep_ts} + 0.5 as ts,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as orig_h,
          cast(1024 + event_id % 500 as int) as orig_p,
          concat('172.16.0.', cast({k} % 16 as {str})) as resp_h, {k} as resp_p,
          case event_type when 'click' then 'http' else 'ssl' end as service,
          case event_id % 3 when 0 then 'SF' when 1 then 'S0' else 'REJ' end as conn_state
        from {events} where event_type in ('view', 'click')""",
    "v_tickets": """
        select cast(o_orderkey as {str}) as ticket_id, 'ip' as ioc_type,
          concat('10.0.', cast(o_custkey {div} 256 as {str}), '.', cast(o_custkey % 256 as {str})) as ioc_value,
          o_orderdate as created_at, {ep_order} as created_t,
          case o_orderstatus when 'F' then 'MALICIOUS' when 'O' then 'BENIGN' end as verdict,
          case o_orderstatus when 'F' then 'Threat' when 'O' then 'False Positive' end as outcome,
          lower(substring(o_orderpriority, 3)) as severity, o_totalprice as total
        from {orders}""",
    "v_names": """
        select page_id, cast(1704067200 + page_id * 7 as double) as t,
          concat('10.1.0.', cast(page_id % 50 as {str})) as si,
          regexp_extract(url, '://([^/:?#]+)', 1) as host,
          regexp_extract(url, '://[^/]+(/.*)$', 1) as uri, url
        from {pages}""",
    # 20.<nation>.x.y networks of four widths
    "v_geo_blocks": """
        select n_nationkey as geo_id, n_name as country, concat('N', cast(n_nationkey as {str})) as code,
          cast(335544320 + n_nationkey * 4096 as bigint) as lo,
          cast(335544320 + n_nationkey * 4096 + case n_nationkey % 4 when 0 then 4095 when 1 then 2047
            when 2 then 1023 else 255 end as bigint) as hi
        from {nation}""",
    # addresses in and between those networks, some of them private
    "v_hosts": """
        select event_id, cast(floor(value * 1000) as bigint) as bytes_sent, {k} as risk_score,
          case when event_type = 'error' then concat('10.0.0.', cast(user_id % 256 as {str}))
            else concat('20.0.', cast((user_id * 37 + {k} * 11) % 420 {div} 4 as {str}), '.',
              cast((user_id + {k}) % 256 as {str})) end as ip,
          case when event_type = 'error' then null
            else cast(335544320 + ((user_id * 37 + {k} * 11) % 420 {div} 4) * 256 + (user_id + {k}) % 256 as bigint) end as ip_number
        from {events}""",
    # log rows of one kind each, in the shape of a log warehouse
    "v_log_conn": """
        select ts, {ep_ts} as t,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as orig_h,
          concat('172.16.0.', cast({k} % 16 as {str})) as resp_h,
          case when {k} % 10 = 0 then null else concat('C', cast(user_id % 7 as {str})) end as src_country,
          concat('C', cast({k} % 5 as {str})) as dst_country
        from {events}""",
    "v_log_dns": """
        select ts, {ep_ts} as t,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as orig_h,
          concat('172.16.0.', cast({k} % 16 as {str})) as resp_h,
          concat('h', cast({k} as {str}), '.d', cast(user_id % 20 as {str}), '.example.com') as query,
          case {k} % 4 when 0 then 'TXT' when 1 then 'A' when 2 then 'AAAA' else 'NULL' end as qtype_name,
          case {k} % 3 when 0 then 'NXDOMAIN' else 'NOERROR' end as rcode_name
        from {events} where event_type = 'purchase'""",
    "v_log_http": """
        select ts, {ep_ts} as t,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as orig_h,
          concat('172.16.0.', cast({k} % 16 as {str})) as resp_h,
          concat('www', cast({k} % 10 as {str}), '.d', cast(user_id % 20 as {str}), '.example.com') as host,
          concat('/p/', cast({k} as {str}), '?u=', cast(user_id as {str})) as uri,
          case {k} % 2 when 0 then 'GET' else 'POST' end as method,
          case {k} % 4 when 0 then 404 when 1 then 500 else 200 end as status_code,
          concat('agent/', cast({k} % 6 as {str})) as user_agent
        from {events} where event_type = 'click'""",
    "v_log_ssl": """
        select ts, {ep_ts} as t,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as orig_h,
          concat('172.16.0.', cast({k} % 16 as {str})) as resp_h,
          concat('cdn', cast({k} % 5 as {str}), '.d', cast(user_id % 20 as {str}), '.example.com') as server_name,
          case {k} % 2 when 0 then 'TLSv12' else 'TLSv13' end as version,
          md5(cast({k} % 9 as {str})) as ja3
        from {events} where event_type = 'view'""",
    "v_log_smtp": """
        select ts, {ep_ts} as t,
          concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) as orig_h,
          concat('172.16.0.', cast({k} % 16 as {str})) as resp_h,
          concat('u', cast(user_id as {str}), '@d', cast({k} % 20 as {str}), '.example.com') as mailfrom,
          concat('a', cast({k} as {str}), '@corp.org,b', cast(user_id % 9 as {str}), '@corp.org') as rcptto
        from {events} where event_type = 'signup'""",
    # alerts as tickets on five kinds of indicators
    "v_cases": """
        select cast(event_id as {str}) as ticket_id, ts as t0,
          case {k} % 5 when 0 then 'ip' when 1 then 'domain' when 2 then 'url' when 3 then 'email' else 'user_agent' end as ioc_type,
          case {k} % 5
            when 0 then concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str}))
            when 1 then concat('d', cast(user_id % 20 as {str}), '.example.com')
            when 2 then concat('/p/', cast({k} as {str}), '?')
            when 3 then case when user_id % 2 = 0 then concat('a', cast({k} as {str}), '@corp.org')
              else concat('u', cast(user_id as {str}), '@d', cast({k} % 20 as {str}), '.example.com') end
            else concat('agent/', cast({k} % 6 as {str})) end as ioc_value,
          case event_id % 3 when 0 then 'Threat' when 1 then 'False Positive' end as outcome,
          case when event_id % 2 = 0 then 'high' else 'medium' end as severity, 'open' as status, ts as created_at
        from {events} where event_type = 'error'""",
    # packets whose identifying fields are present in different combinations
    "v_packets": """
        select event_id, ts, cast(cast(floor({ep_ts}) as bigint) as {str}) as ts_precise,
          case when event_id % 7 = 0 then cast(event_id as {str}) end as frame_number,
          case when event_type = 'click' and {k} % 10 = 0 then 'unknown'
            else concat('10.0.', cast(user_id {div} 256 as {str}), '.', cast(user_id % 256 as {str})) end as si,
          concat('172.16.0.', cast({k} % 16 as {str})) as di,
          case when {k} % 4 = 0 then null else cast(1024 + user_id % 9 as {str}) end as sp, cast({k} as {str}) as dp,
          case event_type when 'purchase' then 'udp' else 'tcp' end as transport, '64' as ttl,
          case when event_type = 'signup' then cast(event_id % 100 as {str}) end as ip_id,
          case when event_type = 'signup' then cast(event_id * 17 as {str}) end as tcp_seq,
          case when event_type = 'purchase' and user_id % 2 = 0 then cast({k} as {str}) end as dns_id,
          case when event_type = 'purchase' then concat('h', cast({k} as {str}), '.example.com') end as dns_query,
          case when event_type = 'view' then md5(cast({k} % 9 as {str})) end as ja3,
          case when event_type = 'view' then case {k} % 3 when 0 then '-' when 1 then 'N/A' else concat('cdn', cast({k} % 5 as {str}), '.tls.net') end end as sni,
          case when event_type = 'click' then concat('www', cast({k} % 10 as {str}), '.org') end as http_host,
          case when event_type = 'click' then case {k} % 2 when 0 then 'GET' else 'POST' end end as http_method,
          case when event_type = 'click' then cast(200 + {k} as {str}) end as http_status, '00:11:22:33:44:55' as eth_src
        from {events} where event_type <> 'error'""",
    # every turn of a conversation as an application log record
    "v_app_log": """
        select conv_id, turn, role as level, text as message,
          cast(1704067200 + conv_id * 60 + turn as double) as t
        from {conversations}""",
}


def _fill(text: str, tokens: dict[str, str], table: dict[str, str]) -> str:
    for key, value in {**tokens, **table}.items():
        text = text.replace("{" + key + "}", value)
    return text


_REGISTERED: set[tuple[int, str]] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; its file footers are read once per session."""
    return spark.table(_table_view(spark, sf_dir, name))


def _table_view(spark: SparkSession, sf_dir: str, name: str) -> str:
    label = re.sub(r"\W", "_", f"wl_{sf_dir}_{name}")
    key = (id(spark._jsparkSession), label)
    if key not in _REGISTERED or not spark.catalog.tableExists(label):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(label)
        _REGISTERED.add(key)
    return label


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: _table_view(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(_fill(VIEWS[name], SPARK_TOKENS, used))


def sql_views(names: list[str]) -> list[tuple[str, str]]:
    tables = {t: t for t in TABLES}
    return [(n, re.sub(r"\s+", " ", _fill(VIEWS[n], DUCK_TOKENS, tables)).strip()) for n in names]
