"""Registry relations as portable SQL over the provided tables: the same text runs in Spark and in the oracle's engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages")


def mask(x: str, p: str) -> str:
    """The network of address x at prefix length p."""
    return f"(({x} >> CAST(32 - {p} AS INT)) << CAST(32 - {p} AS INT))"


def size_of(p: str) -> str:
    return f"(CAST(1 AS BIGINT) << CAST(32 - {p} AS INT))"


VIEWS = {
    "v_routes": f"""SELECT pk, plen, asn, source, net AS ip_first, net + {size_of("plen")} - 1 AS ip_last FROM (
        SELECT pk, plen, asn, source, {mask("raw", "plen")} AS net FROM (
            SELECT o_orderkey AS pk, CAST(16 + (o_orderkey * 7) % 13 AS INT) AS plen, 64512 + o_custkey % 50 AS asn, 'SRC' || CAST(o_custkey % 5 AS VARCHAR(9)) AS source,
                   CAST(167772160 AS BIGINT) + (o_orderkey * 2654435761) % 16777216 AS raw FROM {{orders}}) a) b""",
    "v_roas": f"""SELECT roa, plen, max_length, asn, net AS ip_first, net + {size_of("plen")} - 1 AS ip_last FROM (
        SELECT roa, plen, max_length, asn, {mask("raw", "plen")} AS net FROM (
            SELECT p_partkey AS roa, CAST(18 + p_size % 7 AS INT) AS plen, CAST(18 + p_size % 7 + p_partkey % 6 AS INT) AS max_length,
                   CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS BIGINT) ELSE 64512 + p_partkey % 50 END AS asn, CAST(167772160 AS BIGINT) + (p_partkey * 40503001) % 16777216 AS raw FROM {{part}}) a) b""",
    "v_pref": "SELECT * FROM (VALUES ('SRC0', 900), ('SRC1', 900), ('SRC2', 200), ('SRC3', 100)) AS t(source, pref)",
    "v_edges": """SELECT DISTINCT source, parent, member FROM (
        SELECT 'SRC0' AS source, 'AS-R' || CAST(n_regionkey AS VARCHAR(9)) AS parent, 'AS-N' || CAST(n_nationkey AS VARCHAR(9)) AS member FROM {nation}
        UNION ALL SELECT 'SRC0', 'AS-N' || CAST(s_nationkey AS VARCHAR(9)), 'AS' || CAST(64512 + s_suppkey % 50 AS VARCHAR(9)) FROM {supplier}
        UNION ALL SELECT 'SRC0', 'AS-N' || CAST(n_nationkey AS VARCHAR(9)), 'AS-R' || CAST((n_regionkey + 2) % 5 AS VARCHAR(9)) FROM {nation} WHERE n_nationkey % 11 = 0
        UNION ALL SELECT 'SRC0', 'AS-N' || CAST(n_nationkey AS VARCHAR(9)), 'AS-UNKNOWN' || CAST(n_nationkey AS VARCHAR(9)) FROM {nation} WHERE n_nationkey % 3 = 0
        UNION ALL SELECT 'SRC1', 'AS-N' || CAST(n_nationkey AS VARCHAR(9)), 'AS' || CAST(64512 + n_nationkey AS VARCHAR(9)) FROM {nation} WHERE n_nationkey % 4 = 0) e""",
    "v_journal": """SELECT event_id AS serial_global, ts, event_type AS source, 'P' || CAST(user_id AS VARCHAR(19)) AS rpsl_pk, CASE WHEN value < 20 THEN 'DEL' ELSE 'ADD' END AS operation,
        CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS serial_nrtm FROM {events}""",
    "v_inetnum": """SELECT pk, source, ip_first, ip_first + 4096 + (k % 61) * 1024 AS ip_last FROM (
        SELECT c_custkey AS k, 'IN' || CAST(c_custkey AS VARCHAR(19)) AS pk, 'SRC' || CAST(c_custkey % 5 AS VARCHAR(9)) AS source, CAST(167772160 AS BIGINT) + (c_custkey * 2246822519) % 16777216 AS ip_first FROM {customer}) a""",
    "v_autnum": "SELECT 'AS' || CAST(64512 + s_suppkey AS VARCHAR(19)) AS rpsl_pk, 64512 + s_suppkey AS asn_first, 64512 + s_suppkey AS asn_last, 'SRC' || CAST(s_suppkey % 5 AS VARCHAR(9)) AS source FROM {supplier}",
    "v_asblock": "SELECT 'AS-BLOCK' || CAST(r_regionkey AS VARCHAR(9)) AS rpsl_pk, CAST(64512 + r_regionkey * 40 AS BIGINT) AS asn_first, CAST(64551 + r_regionkey * 40 AS BIGINT) AS asn_last, 'SRC0' AS source FROM {region}",
    "v_mntner": "SELECT 'MNT-' || CAST(n_nationkey AS VARCHAR(9)) AS rpsl_pk, 'nfy' || CAST(n_nationkey AS VARCHAR(9)) || '@example.net' AS mnt_nfy, 'P' || CAST(n_nationkey + 1 AS VARCHAR(9)) AS admin_c FROM {nation}",
    "v_person": "SELECT 'P' || CAST(p_partkey AS VARCHAR(19)) AS rpsl_pk, p_name AS name, 'p' || CAST(p_partkey AS VARCHAR(19)) || '@example.net' AS email FROM {part}",
    "v_mnt_by": "SELECT pk, 'MNT-' || CAST(pk % 31 AS VARCHAR(9)) AS mntner FROM {v_routes} r1 UNION ALL SELECT pk, 'MNT-' || CAST(pk % 29 AS VARCHAR(9)) FROM {v_routes} r2 WHERE pk % 4 = 0",
    "v_member_of": "SELECT pk, 'RS-' || CAST(pk % 20 AS VARCHAR(9)) AS set_pk FROM {v_routes} r WHERE pk % 3 = 0",
    "v_rs": "SELECT 'RS-' || CAST(n_nationkey AS VARCHAR(9)) AS set_pk, CASE WHEN n_nationkey % 5 = 0 THEN 'ANY' ELSE 'MNT-' || CAST(n_nationkey AS VARCHAR(9)) END AS mbrs_by_ref FROM {nation} WHERE n_nationkey < 20",
    "v_objects": """SELECT k, rpsl_pk, source, object_class, ip_first, ip_last, plen, asn_first, asn_last,
        CASE k % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'not_found' END AS rpki_status, CASE k % 7 WHEN 0 THEN 'out_scope_as' WHEN 1 THEN 'out_scope_prefix' ELSE 'in_scope' END AS scopefilter_status,
        CASE k % 4 WHEN 0 THEN 'suppressed' ELSE 'visible' END AS route_preference_status FROM (
        SELECT pk AS k, 'R' || CAST(pk AS VARCHAR(19)) AS rpsl_pk, source, 'route' AS object_class, ip_first, ip_last, plen, asn AS asn_first, asn AS asn_last FROM {v_routes} r
        UNION ALL SELECT ip_first % 1000, pk, source, 'inetnum', ip_first, ip_last, NULL, NULL, NULL FROM {v_inetnum} i
        UNION ALL SELECT asn_first, rpsl_pk, source, 'aut-num', NULL, NULL, NULL, asn_first, asn_last FROM {v_autnum} a
        UNION ALL SELECT asn_first, rpsl_pk, source, 'as-block', NULL, NULL, NULL, asn_first, asn_last FROM {v_asblock} b
        UNION ALL SELECT CAST(length(name) AS BIGINT), rpsl_pk, 'SRC1', 'person', NULL, NULL, NULL, NULL, NULL FROM {v_person} p) o""",
    "v_suspended": "SELECT 'C' || CAST(c_custkey AS VARCHAR(19)) AS rpsl_pk, 'SRC' || CAST(c_custkey % 5 AS VARCHAR(9)) AS source, 'MNT-' || CAST(c_custkey % 25 AS VARCHAR(9)) AS mntner, c_custkey AS suspended_at FROM {customer} WHERE c_custkey % 7 = 0",
    "v_protected": "SELECT 'P' || CAST(p_partkey AS VARCHAR(19)) AS protected_name, 'SRC' || CAST(p_partkey % 5 AS VARCHAR(9)) AS source FROM {part} WHERE p_partkey % 13 = 0",
    "v_status": """SELECT source, min(serial_nrtm) AS serial_oldest_journal, max(serial_nrtm) AS serial_newest_journal, max(serial_nrtm) + length(source) % 3 AS serial_newest_seen,
        CASE WHEN length(source) % 2 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(2 AS BIGINT) END AS serial_oldest_seen, max(ts) AS updated FROM {v_journal} j GROUP BY source""",
    "v_file": """SELECT pk, CASE WHEN pk % 17 = 0 THEN 'changed' ELSE 'same' END AS body FROM {v_routes} r1 WHERE pk % 11 <> 0 UNION ALL SELECT -pk, 'same' FROM {v_routes} r2 WHERE pk % 23 = 0""",
    "v_requests": "SELECT o_orderkey AS req, o_orderkey - o_orderkey % 10 AS batch, CASE WHEN o_orderkey % 10 = 9 THEN CAST(NULL AS BIGINT) ELSE o_orderkey + 1 END AS refers_to, o_orderkey % 37 = 0 AS broken FROM {orders}",
    "v_scope": "SELECT * FROM (VALUES (CAST(167772160 AS BIGINT), CAST(168820735 AS BIGINT))) AS t(p_first, p_last)",
    "v_queries": f"SELECT pk AS q, {mask('ip_first', '26')} AS q_first, {mask('ip_first', '26')} + 63 AS q_last FROM {{v_routes}} r WHERE pk % 100 = 0",
    "v_acl": "SELECT * FROM (VALUES ('a', CAST(167772160 AS BIGINT), CAST(171966463 AS BIGINT)), ('b', CAST(180355072 AS BIGINT), CAST(180420607 AS BIGINT))) AS t(acl, ip_first, ip_last)",
    "v_now": "SELECT max(ts) AS now FROM {events}",
    "v_tokens": "SELECT 'T' || CAST(s_suppkey AS VARCHAR(19)) AS token, 'MNT-' || CAST(s_nationkey AS VARCHAR(9)) AS mntner, s_suppkey % 2 = 0 AS api_allowed, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE CAST(NULL AS VARCHAR(9)) END AS acl FROM {supplier}",
}
_NAME = re.compile(r"\{(\w+)\}")


class Relations:
    """The relations over one data folder as DataFrames: r("v_routes")."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name].replace("VARCHAR(9)", "STRING").replace("VARCHAR(19)", "STRING"))

    def sql(self, text: str) -> DataFrame:
        used = {n: self(n) for n in _NAME.findall(text)}
        return self.spark.sql(text, **used) if used else self.spark.sql(text)


def inline(text: str) -> str:
    """The same text with every relation written out, for an engine that knows the tables only."""
    return _NAME.sub(lambda m: m[1] if m[1] in TABLES else f"({inline(VIEWS[m[1]])})", text)
