"""Queries over attribute values and mirroring decisions, with their oracle SQL: name to (plan, oracle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fields, ip
from ..operators import mirror

C, L = F.col, F.lit


def _pair(both: tuple[Column, Column]) -> list[Column]:
    return [c.alias(n) for c, n in zip(both, ("first", "last"), strict=True)]


REQUESTS = """SELECT source, serial_newest_journal + 1 AS first, CAST(NULL AS BIGINT) AS last FROM {v_status} a UNION ALL SELECT source, CAST(1 AS BIGINT), CAST(5 AS BIGINT) FROM {v_status} b
 UNION ALL SELECT source, serial_newest_journal, serial_newest_journal + 3 FROM {v_status} c UNION ALL SELECT 'none', CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM {region} d"""
LOCAL = "SELECT source, 's' || CAST(length(source) % 3 AS VARCHAR(9)) AS session_id, serial_newest_seen AS version, source = 'view' AS force_reload FROM {v_status} a"
NOTICE = "SELECT source, 's' || CAST(length(source) % 2 AS VARCHAR(9)) AS n_session, serial_newest_journal + 1 AS n_version, serial_newest_journal + length(source) % 2 AS min_delta FROM {v_status} b"
APPLY = """SELECT pk, body FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY serial DESC) AS n FROM (SELECT rpsl_pk AS pk, -1 AS serial, 'ADD' AS operation, name AS body FROM {v_person} p
 UNION ALL SELECT rpsl_pk, serial_global, operation, 'v' || serial_global FROM {v_journal} j WHERE serial_global > %d) u) t WHERE n = 1 AND operation <> 'DEL'"""


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR(9)", "STRING")


def _applied(r, after: int):
    ops = r("v_journal").filter(C("serial_global") > after).select(C("rpsl_pk").alias("pk"), C("serial_global").alias("serial"), "operation", F.concat(L("v"), C("serial_global").cast("string")).alias("body"))
    return mirror.apply_operations(r("v_person").select(C("rpsl_pk").alias("pk"), C("name").alias("body")), ops, ["pk"]).select("pk", "body")


def _files(r, other: bool):
    hashed = F.when(L(other) & (C("pk") % 100 == 0), "other").otherwise(F.md5(C("pk").cast("string")))
    return r("v_routes").select("source", F.concat(L("delta-"), C("pk").cast("string")).alias("reference"), L("u").alias("url"), hashed.alias("hash"))


def _cycle(r):
    s = r("v_status").join(F.broadcast(r("v_now")))
    s = s.select("source", L(7).cast("long").alias("version"), (C("serial_newest_journal") - 10).alias("published"), L(7).cast("long").alias("snapshot_version"), C("updated").alias("snapshot_at"), "now")
    return mirror.server_cycle(r("v_journal"), s)


def rs_members(routes):
    return routes.withColumn("p", F.concat(ip.dotted(C("ip_first")), L("/"), C("plen").cast("string"), L("^"))).select(
        "pk", fields.route_set_member(F.concat("p", (C("plen") + 1).cast("string"), L("-32"))).alias("ranged"), fields.route_set_member(F.concat("p", (C("plen") - 1).cast("string"))).alias("short"),
        fields.route_set_member(L("rs-one^+")).alias("named"), fields.route_set_member(L("as1.1^24")).alias("number"), fields.route_set_member(C("p")).alias("missing"),
    )


ENTRIES = {
    "fn_clean_ip_error": (
        lambda r: r("v_mntner").select("rpsl_pk", fields.clean_address_error(F.concat(L("IP('193.0.1.1/21') has invalid prefix length (21) "), C("rpsl_pk"))).alias("said")),
        "SELECT rpsl_pk, 'invalid prefix length (21) ' || rpsl_pk AS said FROM {v_mntner} m",
    ),
    "fn_dummify": (
        lambda r: r("v_mntner").select("rpsl_pk", fields.with_placeholders(F.concat(L("mntner:         "), C("rpsl_pk"), L("\nupd-to: a@example.net\nsource: T\n")), C("rpsl_pk"), {"upd-to": "unread@%s.example"}, "one\ntwo").alias("body")),
        "SELECT rpsl_pk, 'mntner:         ' || rpsl_pk || chr(10) || 'upd-to:         unread@' || rpsl_pk || '.example' || chr(10) || 'source: T' || chr(10) || 'remarks:        one' || chr(10) || 'remarks:        two' || chr(10) AS body FROM {v_mntner} m",
    ),
    "fn_strip_nonprint": (
        lambda r: r("v_mntner").select("rpsl_pk", fields.printable(F.concat(L("a\u0007 "), C("rpsl_pk"), L("\u200d\u2028z\tq\n"))).alias("v")),
        "SELECT rpsl_pk, 'a ' || rpsl_pk || chr(8205) || 'z' || chr(9) || 'q' || chr(10) AS v FROM {v_mntner} m",
    ),
    "fn_changed": (
        lambda r: r("v_person").select("rpsl_pk", fields.changed_ok(F.concat(C("email"), L(" 20240229"))).alias("ok"), fields.changed_ok(F.concat(C("email"), L(" 20230229"))).alias("bad"), fields.changed_ok(C("email")).alias("alone")),
        "SELECT rpsl_pk, true AS ok, false AS bad, true AS alone FROM {v_person} p",
    ),
    "fn_dns": (
        lambda r: r("v_person").select("rpsl_pk", fields.dns_ok(F.concat(F.lower("rpsl_pk"), L(".Example.net"))).alias("ok"), fields.dns_ok(F.concat(L("-"), F.lower("rpsl_pk"), L(".net"))).alias("bad")),
        "SELECT rpsl_pk, true AS ok, false AS bad FROM {v_person} p",
    ),
    "fn_url": (lambda r: r("pages").select("page_id", fields.url_ok(C("url")).alias("ok")), "SELECT page_id, regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#]') AS ok FROM {pages} p"),
    "fn_auth": (
        lambda r: r("v_mntner").select("rpsl_pk", fields.auth_ok(F.concat(L("bcrypt-pw "), C("rpsl_pk"))).alias("hash"), fields.auth_ok(L("PGPKey-80f238c6")).alias("key"), fields.auth_ok(F.concat(L("CRYPT-PW "), C("rpsl_pk"))).alias("legacy")),
        "SELECT rpsl_pk, true AS hash, true AS key, false AS legacy FROM {v_mntner} m",
    ),
    "fn_asn_block": (
        lambda r: r("v_asblock").select("rpsl_pk", *_pair(fields.as_block(F.concat(L("AS"), C("asn_first").cast("string"), L(" - as"), C("asn_last").cast("string")))), fields.as_block(L("AS5 - AS4"))[0].alias("turned")),
        "SELECT rpsl_pk, asn_first AS first, asn_last AS last, CAST(NULL AS BIGINT) AS turned FROM {v_asblock} b",
    ),
    "fn_rs_member": (
        lambda r: rs_members(r("v_routes")),
        "SELECT pk, ((ip_first >> 24) & 255) || '.' || ((ip_first >> 16) & 255) || '.' || ((ip_first >> 8) & 255) || '.' || (ip_first & 255) || '/' || plen || '^' || (plen + 1) || '-32' AS ranged, CAST(NULL AS VARCHAR) AS short, 'RS-ONE^+' AS named, 'AS65537^24' AS number, CAST(NULL AS VARCHAR) AS missing FROM {v_routes} r",
    ),
    "fn_set_prefix_required": (lambda r: r("v_edges").select("member", fields.hierarchical(F.concat("member", L(":AS-X"))).alias("ok")).distinct(), "SELECT DISTINCT member, regexp_matches(member, '^AS[0-9]+$') AS ok FROM {v_edges} e"),
    "fn_parse_status_line": (
        lambda r: r("v_status").select(fields.status_line(F.concat("source", L(":y:"), C("serial_oldest_journal").cast("string"), L("-"), C("serial_newest_journal").cast("string"))).alias("s")).select("s.*"),
        "SELECT upper(source) AS source, true AS mirrorable, serial_oldest_journal AS oldest, serial_newest_journal AS newest, CAST(NULL AS BIGINT) AS exported FROM {v_status} s",
    ),
    "unf_age": (
        lambda r: r("v_journal").join(F.broadcast(r("v_now"))).select("serial_global", mirror.older(C("ts"), C("now"), mirror.DAY).alias("old")),
        "SELECT serial_global, ts < now - INTERVAL 86400 SECOND AS old FROM {v_journal} j, {v_now} n",
    ),
    "snapshot_due": (
        lambda r: mirror.snapshot_due(r("v_status").join(F.broadcast(r("v_now"))).select("source", C("serial_oldest_seen").alias("snapshot_version"), C("serial_newest_seen").alias("version"), C("updated").alias("snapshot_at"), "now")),
        "SELECT source, COALESCE(serial_oldest_seen, 0) = 0 OR (serial_oldest_seen <> serial_newest_seen AND updated < now - INTERVAL 14400 SECOND) AS due FROM {v_status} s, {v_now} n",
    ),
    "nrtm3_range_rules": (
        lambda r: mirror.range_answers(r.sql(REQUESTS), r("v_journal"), 4),
        "SELECT source, serial_newest_journal + 1 AS first, CAST(NULL AS BIGINT) AS last, 'warning' AS answer FROM {v_status} a UNION ALL SELECT source, 1, 5, 'ok' FROM {v_status} b UNION ALL SELECT source, serial_newest_journal, serial_newest_journal + 3, 'error' FROM {v_status} c UNION ALL SELECT 'none', 1, 2, 'error' FROM {region} d",
    ),
    "nrtm4_hash_check": (lambda r: mirror.rewritten(_files(r, True), _files(r, False)), "SELECT source, 'delta-' || pk AS reference FROM {v_routes} r WHERE pk % 100 = 0"),
    "nrtm4_next_version": (
        lambda r: mirror.next_versions(r.sql(_spark(LOCAL)), r.sql(_spark(NOTICE))),
        f"""SELECT source, action, CASE WHEN action = 'delta' THEN version + 1 END AS version FROM (SELECT l.source, l.version, CASE WHEN force_reload OR n_session <> session_id THEN 'snapshot' WHEN version > n_version THEN 'error'
         WHEN min_delta > version + 1 THEN 'snapshot' ELSE 'delta' END AS action FROM ({LOCAL}) l JOIN ({NOTICE}) n ON l.source = n.source) x""",
    ),
    "nrtm_apply": (lambda r: _applied(r, 0), APPLY % 0),
    "nrtm4_apply": (lambda r: _applied(r, 500), APPLY % 500),
    "nrtm4_server_cycle": (
        _cycle,
        "SELECT s.source, CAST(8 AS BIGINT) AS version, count(*) FILTER (WHERE serial_nrtm > serial_newest_journal - 10) AS in_delta, count(*) FILTER (WHERE ts < now - INTERVAL 86400 SECOND) AS expired, max(updated) < max(now) - INTERVAL 14400 SECOND AS due FROM {v_status} s JOIN {v_journal} j ON s.source = j.source, {v_now} n GROUP BY s.source",
    ),
    "src_hash_check": (lambda r: r("documents").select("doc_id", F.sha2("text", 256).alias("h")), "SELECT doc_id, sha256(text) AS h FROM {documents} d"),
    "src_full_import": (
        lambda r: mirror.full_import(r("v_file"), r("v_routes").select("pk", L("same").alias("body"))),
        "SELECT COALESCE(f.pk, r.pk) AS pk, CASE WHEN r.pk IS NULL THEN 'new' WHEN f.pk IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM {v_file} f FULL JOIN {v_routes} r ON f.pk = r.pk WHERE r.pk IS NULL OR f.pk IS NULL OR f.body <> 'same'",
    ),
    "parse_submission": (
        lambda r: r("v_mntner").select("rpsl_pk", F.posexplode(fields.submitted(F.concat(L("password: x\r\n\r\nmntner: "), C("rpsl_pk"), L("\ndelete: no more\nsource: T\n\n\nperson: a\nsuspension: suspend\n")))).alias("n", "b")).select("rpsl_pk", C("n").cast("long").alias("n"), "b.text", "b.delete_reason", "b.suspension"),
        "SELECT rpsl_pk, 0::BIGINT AS n, '' AS text, NULL AS delete_reason, NULL AS suspension FROM {v_mntner} a UNION ALL SELECT rpsl_pk, 1, 'mntner: ' || rpsl_pk || chr(10) || 'source: T' || chr(10), 'no more', NULL FROM {v_mntner} b UNION ALL SELECT rpsl_pk, 2, 'person: a' || chr(10), NULL, 'suspend' FROM {v_mntner} c",
    ),
}
