"""Queries over prefixes of both address families, over rendered objects and templates, and over notification files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, ladder, submissions
from ..sources import notification

C, L = F.col, F.lit

#: The third and fourth group of an address in 2001:db8::/32 come from the row's id.
_SIX = "'6:' || substr(lpad(bin(536939960), 32, '0') || lpad(bin(({x} % 65536) * 65536), 32, '0'), 1, {n})"
ROUTES = f"""SELECT pk, '4:' || substr(lpad(bin(ip_first), 32, '0'), 1, plen) AS bits, plen, asn, source FROM {{v_routes}} r4 UNION ALL SELECT pk, {_SIX.format(x="raw", n="plen")} AS bits, plen, asn, source FROM (
 SELECT -1 - o_orderkey AS pk, CAST(36 + (o_orderkey * 7) % 13 AS INT) AS plen, 64512 + o_custkey % 50 AS asn, 'SRC' || CAST(o_custkey % 5 AS VARCHAR(9)) AS source, (o_orderkey * 2654435761) % 16777216 AS raw FROM {{orders}}) r6"""
ROAS = f"""SELECT roa, '4:' || substr(lpad(bin(ip_first), 32, '0'), 1, plen) AS bits, plen, max_length, asn FROM {{v_roas}} a4 UNION ALL SELECT roa, {_SIX.format(x="raw", n="plen")} AS bits, plen, max_length, asn FROM (
 SELECT -1 - p_partkey AS roa, CAST(41 + p_size % 7 AS INT) AS plen, CAST(41 + p_size % 7 + p_partkey % 6 AS INT) AS max_length, 64512 + p_partkey % 50 AS asn, (p_partkey * 40503001) % 16777216 AS raw FROM {{part}}) a6"""
ASKED = f"SELECT pk AS q, substr(bits, 1, CAST(length(bits) - 2 AS INT)) AS bits FROM ({ROUTES}) r WHERE pk % 100 = 0"


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR(9)", "STRING")


def routes(r):
    return r.sql(_spark(ROUTES))


def roas(r):
    return r.sql(_spark(ROAS))


def asked(r):
    return r.sql(_spark(ASKED))


#: Attributes of two classes, in order: name, optional, multiple, primary key, look-up key, strong reference, classes referred to.
PERSON = (
    ("person", False, False, False, True, False, ""), ("address", False, True, False, False, False, ""), ("phone", False, True, False, False, False, ""), ("fax-no", True, True, False, False, False, ""),
    ("e-mail", False, True, False, False, False, ""), ("nic-hdl", False, False, True, True, False, ""), ("remarks", True, True, False, False, False, ""), ("notify", True, True, False, False, False, ""),
    ("mnt-by", False, True, False, True, True, "mntner"), ("changed", True, True, False, False, False, ""), ("source", False, False, False, False, False, ""),
)


def _template(r):
    rows = " UNION ALL ".join(f"SELECT {i} AS i, '{n}' AS name, {o} AS optional, {m} AS multiple, {p} AS primary_key, {k} AS lookup_key, {s} AS strong, '{c}' AS referring" for i, (n, o, m, p, k, s, c) in enumerate(PERSON))
    width = max(len(x[0]) for x in PERSON)
    line = text.template_line(C("name"), L(width), C("optional"), C("multiple"), C("primary_key"), C("lookup_key"), C("strong"), F.filter(F.split("referring", ","), lambda x: x != ""))
    return r.sql(rows).select(C("i").cast("long").alias("i"), line.alias("line"))


def _template_rows() -> str:
    out, width = [], max(len(x[0]) for x in PERSON)
    for i, (n, o, m, p, k, s, c) in enumerate(PERSON):
        said = ", ".join(x for x in ({(1, 1): "primary/look-up key", (1, 0): "primary key", (0, 1): "look-up key"}.get((int(p), int(k)), ""), f"{'strong' if s else 'weak'} references {c}" if c else "") if x)
        out.append(f"({i}, '{n}: {' ' * (width - len(n))}  {'[optional] ' if o else '[mandatory]'}  {'[multiple]' if m else '[single]  '}  [{said}]')")
    return f"SELECT CAST(i AS BIGINT) AS i, line FROM (VALUES {', '.join(out)}) AS t(i, line)"


def _attributes(*pairs):
    return F.array(*[F.struct(L(n).alias("name"), v.alias("value")) for n, v in pairs])


FILES = """SELECT source, 's-' || source AS session_id, CAST(7 AS BIGINT) AS version, CAST(n % 3 + 5 AS BIGINT) AS file_version, 'f' || CAST(n % 3 + 5 AS VARCHAR(9)) AS url, n % 3 = 0 AS is_snapshot FROM (
 SELECT DISTINCT source, k % 3 AS n FROM (SELECT source, serial_nrtm AS k FROM {v_journal} j) x) y"""


def _files(r):
    return r.sql(_spark(FILES)).withColumn("hash", F.sha2("url", 256)).withColumn("timestamp", L("2024-01-01T00:00:00Z"))


SUBMITTED = """SELECT rpsl_pk, length(name) % 3 <> 0 AS has_text, length(name) % 2 = 0 AS has_attributes, CASE length(name) % 4 WHEN 0 THEN 'suspend' WHEN 1 THEN 'reactivate' ELSE 'stop' END AS suspension,
 CASE WHEN length(name) % 5 < 4 THEN 'mntner' ELSE 'person' END AS object_class, length(name) % 7 < 6 AS enabled FROM {v_person} p"""


ENTRIES = {
    "rpki_validate_mixed": (
        lambda r: classify.origin_validity(routes(r), roas(r)),
        f"SELECT r.pk, CASE WHEN max(CASE WHEN a.asn <> 0 AND a.asn = r.asn AND r.plen <= a.max_length THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(a.roa) > 0 THEN 'invalid' ELSE 'not_found' END AS rpki_status FROM ({ROUTES}) r LEFT JOIN ({ROAS}) a ON starts_with(r.bits, a.bits) GROUP BY r.pk",
    ),
    "roa_covering_mixed": (lambda r: ladder.pairs(routes(r), roas(r), "pk", "roa"), f"SELECT r.pk, a.roa FROM ({ROUTES}) r JOIN ({ROAS}) a ON starts_with(r.bits, a.bits)"),
    "route_preference_mixed": (
        lambda r: classify.preference(routes(r), r("v_pref")),
        f"""WITH r AS MATERIALIZED (SELECT r.*, p.pref FROM ({ROUTES}) r LEFT JOIN {{v_pref}} p ON r.source = p.source), b AS MATERIALIZED (SELECT bits, max(pref) AS pref FROM r WHERE pref IS NOT NULL GROUP BY bits),
         c AS MATERIALIZED (SELECT x.bits AS inner_bits, x.pref AS inner_pref, y.bits AS outer_bits, y.pref AS outer_pref FROM (SELECT bits, pref, unnest(range(3, length(bits) + 1)) AS n FROM b) x JOIN b y ON substr(x.bits, 1, x.n) = y.bits),
         t AS (SELECT bits, max(other) AS top FROM (SELECT inner_bits AS bits, outer_pref AS other FROM c UNION ALL SELECT outer_bits, inner_pref FROM c) u GROUP BY bits)
         SELECT r.pk, CASE WHEN t.top > r.pref THEN 'suppressed' ELSE 'visible' END AS status FROM r LEFT JOIN t ON r.bits = t.bits""",
    ),
    "ip_exact_mixed": (lambda r: ladder.meet(asked(r), routes(r).select("bits", "pk"), ["bits"], "q", "pk"), f"SELECT q.q, r.pk FROM ({ASKED}) q JOIN ({ROUTES}) r ON q.bits = r.bits"),
    "ip_less_specific_mixed": (lambda r: ladder.pairs(asked(r), routes(r), "q", "pk"), f"SELECT q.q, r.pk FROM ({ASKED}) q JOIN ({ROUTES}) r ON starts_with(q.bits, r.bits)"),
    "ip_less_specific_one_mixed": (
        lambda r: ladder.next_less_specific(asked(r), routes(r), "q").select("q", C("o_pk").alias("pk")),
        f"SELECT q, pk FROM (SELECT q.q, r.pk, length(r.bits) AS n, max(length(r.bits)) OVER (PARTITION BY q.q) AS m FROM ({ASKED}) q JOIN ({ROUTES}) r ON starts_with(q.bits, r.bits) AND q.bits <> r.bits) x WHERE n = m",
    ),
    "ip_more_specific_mixed": (lambda r: ladder.pairs(routes(r), asked(r), "pk", "q", strict=True).select("q", "pk"), f"SELECT q.q, r.pk FROM ({ASKED}) q JOIN ({ROUTES}) r ON starts_with(r.bits, q.bits) AND q.bits <> r.bits"),
    "ref_objs_techc": (
        lambda r: r("v_mntner").withColumn("tech_c", F.concat(C("admin_c"), L("1"))).select(C("rpsl_pk").alias("mntner"), "tech_c").join(r("v_person"), C("tech_c") == C("rpsl_pk")).select("mntner", "tech_c", "email"),
        "SELECT m.rpsl_pk AS mntner, p.rpsl_pk AS tech_c, p.email FROM {v_mntner} m JOIN {v_person} p ON m.admin_c || '1' = p.rpsl_pk",
    ),
    "fn_render": (
        lambda r: r("v_mntner").select("rpsl_pk", text.render_lines(_attributes(("mntner", C("rpsl_pk")), ("descr", F.concat(L("one\n\n"), C("admin_c"))), ("remarks", L("")), ("last-modified", L("x")), ("source", L("T"))), F.timestamp_seconds(L(1700000000))).alias("body")),
        "SELECT rpsl_pk, 'mntner:         ' || rpsl_pk || chr(10) || 'descr:          one' || chr(10) || '+               ' || chr(10) || '                ' || admin_c || chr(10) || 'remarks:' || chr(10) || 'source:         T' || chr(10) || 'last-modified:  2023-11-14T22:13:20Z' || chr(10) AS body FROM {v_mntner} m",
    ),
    "set_last_modified": (
        lambda r: r("v_mntner").withColumn("auth", F.length("rpsl_pk") % 2 == 0).select("rpsl_pk", F.when(C("auth"), text.render_lines(_attributes(("mntner", C("rpsl_pk")), ("last-modified", L("old"))), F.timestamp_seconds(L(0)))).otherwise(text.render_lines(_attributes(("mntner", C("rpsl_pk")), ("last-modified", L("old"))))).alias("body")),
        "SELECT rpsl_pk, 'mntner:         ' || rpsl_pk || chr(10) || 'last-modified:  ' || CASE WHEN length(rpsl_pk) % 2 = 0 THEN '1970-01-01T00:00:00Z' ELSE 'old' END || chr(10) AS body FROM {v_mntner} m",
    ),
    "fn_template": (_template, _template_rows()),
    "fn_fingerprint": (
        lambda r: r("v_person").select("rpsl_pk", text.fingerprint(F.upper(F.substring(F.sha2("rpsl_pk", 256), 1, 40))).alias("v")),
        "SELECT rpsl_pk, " + " || ".join(f"upper(substr(sha256(rpsl_pk), {1 + 4 * i}, 4))" + (f" || '{' ' * (1 + (i == 4))}'" if i < 9 else "") for i in range(10)) + " AS v FROM {v_person} p",
    ),
    "fn_diff": (
        lambda r: r("v_mntner").select("rpsl_pk", text.unified_diff(F.concat(L("mntner: "), C("rpsl_pk"), L("\na: 1\n")), F.concat(L("mntner: "), C("rpsl_pk"), L("\na: 2\n"))).alias("diff")),
        "SELECT rpsl_pk, '@@ -1,2 +1,2 @@' || chr(10) || ' mntner: ' || rpsl_pk || chr(10) || '-a: 1' || chr(10) || '+a: 2' AS diff FROM {v_mntner} m",
    ),
    "nrtm4_unf": (
        lambda r: notification.write(_files(r)),
        f"""SELECT source, '{{"nrtm_version":4,"type":"notification","source":"' || source || '","session_id":"s-' || source || '","version":7,"timestamp":"2024-01-01T00:00:00Z","snapshot":' || max(CASE WHEN is_snapshot THEN f END) || ',"deltas":[' || string_agg(CASE WHEN NOT is_snapshot THEN f END, ',' ORDER BY file_version) || ']}}' AS content
         FROM (SELECT *, '{{"version":' || file_version || ',"url":"' || url || '","hash":"' || sha256(url) || '"}}' AS f FROM ({FILES}) x) y GROUP BY source""",
    ),
    "src_unf": (
        lambda r: notification.read(notification.write(_files(r)), "content").select("source", "version", "file_version", "url", "hash", "is_snapshot"),
        f"SELECT source, version, file_version, url, sha256(url) AS hash, is_snapshot FROM ({FILES}) x",
    ),
    "submission_model": (lambda r: r.sql(SUBMITTED).select("rpsl_pk", submissions.described_once(C("has_text"), C("has_attributes")).alias("ok")), f"SELECT rpsl_pk, has_text <> has_attributes AS ok FROM ({SUBMITTED}) x"),
    "suspension_checks": (
        lambda r: r.sql(SUBMITTED).select("rpsl_pk", submissions.suspension_status(C("suspension"), C("object_class"), C("enabled")).alias("status")),
        f"SELECT rpsl_pk, CASE WHEN suspension NOT IN ('suspend', 'reactivate') THEN 'error: parsing' WHEN NOT enabled THEN 'error: non-authoritative source' WHEN object_class <> 'mntner' THEN 'error: parsing' ELSE 'processing' END AS status FROM ({SUBMITTED}) x",
    ),
    "gql_specificity": (
        lambda r: r.sql(SUBMITTED).select("rpsl_pk", submissions.specific_enough(F.array_compact(F.array(L("sources"), F.when(C("has_text"), "rpsl_pk"), F.when(C("has_attributes"), "rpki_status"))), F.when(C("has_attributes"), F.array(F.when(C("enabled"), "valid").otherwise("not_found")))).alias("ok")),
        f"SELECT rpsl_pk, has_text OR (has_attributes AND enabled) AS ok FROM ({SUBMITTED}) x",
    ),
}
