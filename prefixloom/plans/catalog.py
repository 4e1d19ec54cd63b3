"""All registered queries and their oracle SQL, over the relations of views.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ip, text
from ..operators import changes, classify, journal, ladder, sets
from ..sources import registry
from . import mixed, more
from .views import Relations, inline

_FOUND: dict[str, tuple[Callable[[Relations], DataFrame], str | None]] = dict(more.ENTRIES) | mixed.ENTRIES


def q(name: str, build: Callable[[Relations], DataFrame], oracle: str | None = None) -> None:
    _FOUND[name] = (build, oracle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, b=b: b(Relations(spark, sf_dir))) for k, (b, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: inline(sql) for k, (_, sql) in _FOUND.items() if sql}


OBJ = "k, rpsl_pk, source, object_class, ip_first, ip_last, asn_first, asn_last"
_cols = [c.strip() for c in OBJ.split(",")]
VISIBLE = "rpki_status IN ('valid', 'not_found') AND scopefilter_status = 'in_scope' AND route_preference_status = 'visible'"
Q_FIRST, Q_LAST = 167772160 + 65536 * 40, 167772160 + 65536 * 40 + 16383
INET = "('inetnum', 'route')"


def objects(r: Relations) -> DataFrame:
    return r("v_objects")


# ---- scans ----
q("scan_objects", lambda r: objects(r).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o")
q("scan_journal", lambda r: r("v_journal"), "SELECT serial_global, ts, source, rpsl_pk, operation, serial_nrtm FROM {v_journal} j")
q("scan_suspended", lambda r: r("v_suspended").orderBy("suspended_at"), "SELECT * FROM {v_suspended} s")
q("scan_status", lambda r: r("v_status"), "SELECT * FROM {v_status} s")
q("scan_roas", lambda r: r("v_roas"), "SELECT * FROM {v_roas} s")
q("scan_protected", lambda r: r("v_protected"), "SELECT * FROM {v_protected} s")

# ---- filters ----
q("flt_pks", lambda r: objects(r).filter(F.col("k").isin(1, 2, 3, 500)).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE k IN (1, 2, 3, 500)")
q("flt_rpsl_pks", lambda r: objects(r).filter(F.col("rpsl_pk").isin(*[x.strip().upper() for x in (" r7", "in3 ", "as64520")])).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE rpsl_pk IN ('R7', 'IN3', 'AS64520')")
q("flt_sources", lambda r: objects(r).filter(F.col("source").isin("SRC3", "SRC1")).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE source IN ('SRC3', 'SRC1')")
q("flt_classes", lambda r: objects(r).filter(F.col("object_class").isin("aut-num", "as-block")).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE object_class IN ('aut-num', 'as-block')")
q("flt_lookup_attr", lambda r: r("v_mnt_by").filter(F.col("mntner").isin("MNT-3", "MNT-28")).select("pk").distinct(), "SELECT DISTINCT pk FROM {v_mnt_by} m WHERE mntner IN ('MNT-3', 'MNT-28')")
q("ip_exact", lambda r: (lambda o, x: o.join(x.select("ip_first", "ip_last", F.col("pk").alias("asked")), ["ip_first", "ip_last"]).select("rpsl_pk", "asked"))(objects(r).filter(F.col("object_class").isin("inetnum", "route")), r("v_routes").filter("pk % 100 = 0")),
  f"SELECT o.rpsl_pk, x.pk AS asked FROM {{v_objects}} o JOIN {{v_routes}} x ON o.ip_first = x.ip_first AND o.ip_last = x.ip_last WHERE x.pk % 100 = 0 AND o.object_class IN {INET}")


def asked_prefixes(r: Relations) -> DataFrame:
    return r("v_queries").select("q", F.col("q_first").alias("ip_first"), F.lit(26).alias("plen"))


def asked_routes(r: Relations) -> DataFrame:
    return r("v_routes").filter("pk % 100 = 0").withColumnRenamed("pk", "q")


def related(r: Relations) -> DataFrame:
    """Routes inside each asked one, equal ones among them, then those that it lies in: no pair is in both parts."""
    within = ladder.pairs(r("v_routes"), asked_routes(r), "pk", "q").select("q", "pk")
    return within.unionByName(ladder.pairs(asked_routes(r), r("v_routes"), "q", "pk", strict=True))


q("ip_less_specific", lambda r: ladder.pairs(asked_prefixes(r), r("v_routes"), "q", "pk"), "SELECT q, pk FROM {v_queries} q JOIN {v_routes} r ON r.ip_first <= q_first AND r.ip_last >= q_last")
q("ip_less_specific_one", lambda r: ladder.next_less_specific(asked_prefixes(r), r("v_routes"), "q").select("q", F.col("o_pk").alias("pk")),
  "SELECT q, pk FROM (SELECT q, pk, rank() OVER (PARTITION BY q ORDER BY plen DESC) AS rk FROM {v_queries} q JOIN {v_routes} r ON r.ip_first <= q_first AND r.ip_last >= q_last AND r.plen <> 26) t WHERE rk = 1")
q("ip_more_specific", lambda r: ladder.pairs(r("v_routes"), asked_routes(r), "pk", "q", strict=True).select("q", "pk"),
  "SELECT q.pk AS q, r.pk FROM {v_routes} q JOIN {v_routes} r ON r.ip_first >= q.ip_first AND r.ip_last <= q.ip_last AND r.plen > q.plen WHERE q.pk % 100 = 0")
q("ip_any", related,
  "SELECT q.pk AS q, r.pk FROM {v_routes} q JOIN {v_routes} r ON (r.ip_first >= q.ip_first AND r.ip_last <= q.ip_last) OR (r.ip_first <= q.ip_first AND r.ip_last >= q.ip_last) WHERE q.pk % 100 = 0")
q("asn_exact", lambda r: objects(r).filter("asn_first = 64520 and asn_last = 64520").select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE asn_first = 64520 AND asn_last = 64520")
q("asns_first", lambda r: objects(r).filter(F.col("asn_first").isin(64512, 64552)).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE asn_first IN (64512, 64552)")
q("asn_less_specific", lambda r: objects(r).filter("asn_first <= 64530 and asn_last >= 64530").select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE 64530 BETWEEN asn_first AND asn_last")
q("flt_status", lambda r: objects(r).filter(F.col("rpki_status").isin("valid", "invalid") & (F.col("scopefilter_status") == "in_scope")).select("k", "rpsl_pk", "object_class", "rpki_status"), "SELECT k, rpsl_pk, object_class, rpki_status FROM {v_objects} o WHERE rpki_status IN ('valid', 'invalid') AND scopefilter_status = 'in_scope'")
q("flt_visible", lambda r: objects(r).filter(classify.visible()).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE {VISIBLE}")
q("text_search", lambda r: (lambda o: o.filter((F.col("object_class").isin("as-block", "as-set", "aut-num")) & (F.col("asn_first") <= 64515) & (F.col("asn_last") >= 64515)).select("rpsl_pk", "object_class").unionByName(r("v_person").filter((F.upper("rpsl_pk") == "RED") | F.col("name").ilike("%red%")).select("rpsl_pk", F.lit("person").alias("object_class"))))(objects(r)),
  "SELECT rpsl_pk, object_class FROM {v_objects} o WHERE object_class IN ('as-block', 'as-set', 'aut-num') AND 64515 BETWEEN asn_first AND asn_last UNION ALL SELECT rpsl_pk, 'person' FROM {v_person} p WHERE upper(rpsl_pk) = 'RED' OR name ILIKE '%red%'")
q("journal_before", lambda r: r("v_journal").join(F.broadcast(r("v_now"))).filter(F.col("ts") < F.expr("now - INTERVAL 5 DAYS")).select("serial_global", "source"), "SELECT serial_global, source FROM {v_journal} j, {v_now} n WHERE ts < now - INTERVAL 5 DAY")
q("journal_serial_range", lambda r: r("v_journal").filter(F.col("serial_nrtm").between(10, 20) | (F.col("serial_global") >= 900)).select("serial_global", "source", "serial_nrtm"), "SELECT serial_global, source, serial_nrtm FROM {v_journal} j WHERE serial_nrtm BETWEEN 10 AND 20 OR serial_global >= 900")
q("suspended_by_mntner", lambda r: r("v_suspended").filter(F.array_contains(F.array("mntner"), "MNT-7")), "SELECT * FROM {v_suspended} s WHERE mntner = 'MNT-7'")
q("roa_covering", lambda r: ladder.pairs(r("v_routes"), r("v_roas"), "pk", "roa"), "SELECT r.pk, a.roa FROM {v_routes} r JOIN {v_roas} a ON a.ip_first <= r.ip_first AND a.ip_last >= r.ip_last")
q("flt_protected", lambda r: r("v_protected").filter("protected_name = 'P26' and source = 'SRC1'"), "SELECT * FROM {v_protected} p WHERE protected_name = 'P26' AND source = 'SRC1'")
q("resolver_defaults", lambda r: objects(r).filter(F.col("source").isin("SRC0", "SRC2") & (F.col("object_class") == "route") & classify.visible()).select(*_cols), f"SELECT {OBJ} FROM {{v_objects}} o WHERE source IN ('SRC0', 'SRC2') AND object_class = 'route' AND {VISIBLE}")
q("gql_projection", lambda r: objects(r).select("k", "rpsl_pk", "object_class", F.when(F.col("plen").isNotNull(), F.concat(ip.dotted(F.col("ip_first")), F.lit("/"), F.col("plen").cast("string"))).alias("prefix"), F.when(F.col("asn_first") == F.col("asn_last"), F.col("asn_first")).alias("asn")),
  "SELECT k, rpsl_pk, object_class, CASE WHEN plen IS NOT NULL THEN ((ip_first >> 24) & 255) || '.' || ((ip_first >> 16) & 255) || '.' || ((ip_first >> 8) & 255) || '.' || (ip_first & 255) || '/' || plen END AS prefix, CASE WHEN asn_first = asn_last THEN asn_first END AS asn FROM {v_objects} o")
q("key_fields_only", lambda r: r("v_edges").select("parent", "member").dropDuplicates(), "SELECT DISTINCT parent, member FROM {v_edges} e")
q("import_class_filter", lambda r: objects(r).filter(F.col("object_class").isin("route", "as-block")).groupBy("object_class").agg(F.count("*").alias("n")), "SELECT object_class, count(*) AS n FROM {v_objects} o WHERE object_class IN ('route', 'as-block') GROUP BY object_class")
q("maintained_objects", lambda r: r("v_routes").join(r("v_mnt_by").filter("mntner in ('MNT-1', 'MNT-2')").select("pk", "mntner").distinct(), "pk").filter("(mntner = 'MNT-1' and source = 'SRC1') or (mntner = 'MNT-2' and source = 'SRC2')").select("pk", "mntner", "source"),
  "SELECT DISTINCT r.pk, m.mntner, r.source FROM {v_routes} r JOIN {v_mnt_by} m ON r.pk = m.pk WHERE (m.mntner, r.source) IN (('MNT-1', 'SRC1'), ('MNT-2', 'SRC2'))")
q("acl_check", lambda r: classify.permitted(r("v_inetnum"), r("v_acl")).select("pk", "permitted"),
  "SELECT pk, EXISTS (SELECT 1 FROM {v_acl} a WHERE i.ip_first BETWEEN a.ip_first AND a.ip_last) AS permitted FROM {v_inetnum} i")
q("set_members_ipv4_only", lambda r: r("v_routes").select("pk", ip.dotted(F.col("ip_first")).alias("member")).filter(~F.col("member").contains(":")), "SELECT pk, ((ip_first >> 24) & 255) || '.' || ((ip_first >> 16) & 255) || '.' || ((ip_first >> 8) & 255) || '.' || (ip_first & 255) AS member FROM {v_routes} r")
q("mask_unless_manager", lambda r: r("v_mntner").select("rpsl_pk", F.when(F.col("rpsl_pk").isin("MNT-1", "MNT-2"), F.concat(F.lit("auth: MD5-PW $1$"), F.col("rpsl_pk"))).otherwise(text.mask_hashes(F.concat(F.lit("auth: MD5-PW $1$"), F.col("rpsl_pk")))).alias("shown")),
  "SELECT rpsl_pk, CASE WHEN rpsl_pk IN ('MNT-1', 'MNT-2') THEN 'auth: MD5-PW $1$' || rpsl_pk ELSE 'auth: MD5-PW DummyValue  # Filtered for security' END AS shown FROM {v_mntner} m")
q("roa_pseudo_objects", lambda r: r("v_roas").select(F.concat(ip.dotted(F.col("ip_first")), F.lit("/"), F.col("plen").cast("string"), F.lit("AS"), F.col("asn").cast("string"), F.lit("/ML"), F.col("max_length").cast("string")).alias("rpsl_pk"), F.lit("RPKI").alias("source"), F.lit("valid").alias("rpki_status")),
  "SELECT ((ip_first >> 24) & 255) || '.' || ((ip_first >> 16) & 255) || '.' || ((ip_first >> 8) & 255) || '.' || (ip_first & 255) || '/' || plen || 'AS' || asn || '/ML' || max_length AS rpsl_pk, 'RPKI' AS source, 'valid' AS rpki_status FROM {v_roas} a")
q("roa_sanity", lambda r: r("v_roas").select((F.sum((F.col("max_length") < F.col("plen")).cast("long"))).alias("bad"), F.count("*").alias("n")), "SELECT CAST(sum(CASE WHEN max_length < plen THEN 1 ELSE 0 END) AS BIGINT) AS bad, count(*) AS n FROM {v_roas} a")

# ---- joins and classification ----
q("rpki_validate_bulk", lambda r: classify.origin_validity(r("v_routes"), r("v_roas")),
  "SELECT r.pk, CASE WHEN max(CASE WHEN a.asn <> 0 AND a.asn = r.asn AND r.plen <= a.max_length THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(a.roa) > 0 THEN 'invalid' ELSE 'not_found' END AS rpki_status FROM {v_routes} r LEFT JOIN {v_roas} a ON a.ip_first <= r.ip_first AND a.ip_last >= r.ip_last GROUP BY r.pk")
q("rpki_validate_one", lambda r: classify.origin_validity(r("v_routes").filter("pk = 777"), r("v_roas")),
  "SELECT r.pk, CASE WHEN max(CASE WHEN a.asn <> 0 AND a.asn = r.asn AND r.plen <= a.max_length THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(a.roa) > 0 THEN 'invalid' ELSE 'not_found' END AS rpki_status FROM {v_routes} r LEFT JOIN {v_roas} a ON a.ip_first <= r.ip_first AND a.ip_last >= r.ip_last WHERE r.pk = 777 GROUP BY r.pk")
PREFERENCE = """WITH b AS (SELECT ip_first, ip_last, plen, max(pref) AS pref FROM {v_routes} r JOIN {v_pref} p ON r.source = p.source GROUP BY ip_first, ip_last, plen),
 t AS (SELECT x.ip_first, x.plen, max(y.pref) AS top FROM b x JOIN b y ON (y.ip_first <= x.ip_first AND y.ip_last >= x.ip_last) OR (y.ip_first >= x.ip_first AND y.ip_last <= x.ip_last) GROUP BY x.ip_first, x.plen)"""
q("route_preference", lambda r: classify.preference(r("v_routes"), r("v_pref")),
  PREFERENCE + " SELECT r.pk, CASE WHEN t.top > p.pref THEN 'suppressed' ELSE 'visible' END AS status FROM {v_routes} r LEFT JOIN {v_pref} p ON r.source = p.source LEFT JOIN t ON r.ip_first = t.ip_first AND r.plen = t.plen")


def preference_subset(r: Relations) -> DataFrame:
    """The same for routes whose prefix is related to a touched one: those that cover or are covered by it."""
    rt = r("v_routes")
    touched = rt.filter("pk % 200 = 0")
    near = ladder.containing(rt, touched).select("pk").unionByName(ladder.containing(touched, rt).select(F.col("o_pk").alias("pk"))).distinct()
    return classify.preference(rt, r("v_pref")).join(near, "pk", "left_semi")


q("route_preference_subset", preference_subset,
  PREFERENCE + " SELECT r.pk, CASE WHEN t.top > p.pref THEN 'suppressed' ELSE 'visible' END AS status FROM {v_routes} r LEFT JOIN {v_pref} p ON r.source = p.source LEFT JOIN t ON r.ip_first = t.ip_first AND r.plen = t.plen WHERE EXISTS (SELECT 1 FROM {v_routes} u WHERE u.pk % 200 = 0 AND ((u.ip_first <= r.ip_first AND u.ip_last >= r.ip_last) OR (u.ip_first >= r.ip_first AND u.ip_last <= r.ip_last)))")
q("scope_filter", lambda r: r("v_routes").select("pk", classify.scope(r("v_routes"), [(167772160, 168820735)], [(64520, 64525), (64530, 64530)]).alias("status")),
  "SELECT pk, CASE WHEN ip_first <= 168820735 AND ip_last >= 167772160 THEN 'out_scope_prefix' WHEN asn BETWEEN 64520 AND 64525 OR asn = 64530 THEN 'out_scope_as' ELSE 'in_scope' END AS status FROM {v_routes} r")
q("set_indirect_members", lambda r: sets.by_reference(r("v_rs"), r("v_member_of"), r("v_mnt_by")), "SELECT DISTINCT s.set_pk, m.pk FROM {v_rs} s JOIN {v_member_of} m ON s.set_pk = m.set_pk WHERE s.mbrs_by_ref = 'ANY' OR EXISTS (SELECT 1 FROM {v_mnt_by} b WHERE b.pk = m.pk AND b.mntner = s.mbrs_by_ref)")
q("ref_objs_mntby", lambda r: r("v_mnt_by").join(r("v_mntner"), F.col("mntner") == F.col("rpsl_pk")).select("pk", "mntner", "mnt_nfy").distinct(), "SELECT DISTINCT pk, mntner, mnt_nfy FROM {v_mnt_by} b JOIN {v_mntner} m ON b.mntner = m.rpsl_pk")
q("ref_objs_adminc", lambda r: r("v_mntner").select(F.col("rpsl_pk").alias("mntner"), "admin_c").join(r("v_person"), F.col("admin_c") == F.col("rpsl_pk")).select("mntner", "admin_c", "email"), "SELECT m.rpsl_pk AS mntner, m.admin_c, p.email FROM {v_mntner} m JOIN {v_person} p ON m.admin_c = p.rpsl_pk")
q("ref_objs_memberof", lambda r: r("v_member_of").join(r("v_rs"), "set_pk").select("pk", "set_pk", "mbrs_by_ref"), "SELECT m.pk, m.set_pk, s.mbrs_by_ref FROM {v_member_of} m JOIN {v_rs} s ON m.set_pk = s.set_pk")
q("ref_objs_mbrsbyref", lambda r: r("v_rs").join(r("v_mntner"), F.col("mbrs_by_ref") == F.col("rpsl_pk")).select("set_pk", "mbrs_by_ref", "mnt_nfy"), "SELECT s.set_pk, s.mbrs_by_ref, m.mnt_nfy FROM {v_rs} s JOIN {v_mntner} m ON s.mbrs_by_ref = m.rpsl_pk")
q("ref_objs_members", lambda r: (lambda e: e.join(e.select(F.col("parent").alias("member")).distinct(), "member", "left_semi").select("source", "parent", "member"))(r("v_edges")), "SELECT source, parent, member FROM {v_edges} e WHERE member IN (SELECT parent FROM {v_edges} f)")
q("object_journal", lambda r: r("v_person").filter("rpsl_pk in ('P1', 'P2', 'P3')").join(r("v_journal"), "rpsl_pk").select("rpsl_pk", "serial_global", "operation"), "SELECT p.rpsl_pk, serial_global, operation FROM {v_person} p JOIN {v_journal} j ON p.rpsl_pk = j.rpsl_pk WHERE p.rpsl_pk IN ('P1', 'P2', 'P3')")
q("next_serial", lambda r: journal.next_serials(r("v_status"), r("v_journal").filter("source <> 'click'")), "SELECT s.source, COALESCE(max(j.serial_nrtm), max(s.serial_newest_seen), 0) + 1 AS next_serial FROM {v_status} s LEFT JOIN (SELECT * FROM {v_journal} x WHERE source <> 'click') j ON s.source = j.source GROUP BY s.source")
q("api_token_join", lambda r: r("v_tokens").join(r("v_mntner"), F.col("mntner") == F.col("rpsl_pk")).filter(F.col("api_allowed") & F.coalesce(F.col("acl") == "a", F.lit(True))).select("token", "mntner"), "SELECT token, mntner FROM {v_tokens} t JOIN {v_mntner} m ON t.mntner = m.rpsl_pk WHERE api_allowed AND (acl IS NULL OR acl = 'a')")
q("ui_permission_join", lambda r: r("v_mntner").select("rpsl_pk").join(r("v_tokens").select(F.col("mntner").alias("rpsl_pk")), "rpsl_pk", "left_anti"), "SELECT rpsl_pk FROM {v_mntner} m WHERE NOT EXISTS (SELECT 1 FROM {v_tokens} t WHERE t.mntner = m.rpsl_pk)")
DIFF = "SELECT COALESCE(f.pk, o.pk) AS pk, CASE WHEN o.pk IS NULL THEN 'new' WHEN f.pk IS NULL THEN 'deleted' WHEN f.body <> 'same' THEN 'modified' ELSE 'retained' END AS change FROM {v_file} f FULL OUTER JOIN {v_routes} o ON f.pk = o.pk"
_stored = lambda r: r("v_routes").select("pk", F.lit("same").alias("body"))
q("snapshot_diff", lambda r: journal.snapshot_diff(r("v_file"), _stored(r)), DIFF)
q("import_counters", lambda r: journal.snapshot_diff(r("v_file"), _stored(r)).groupBy("change").agg(F.count("*").alias("n")), f"SELECT change, count(*) AS n FROM ({DIFF}) d GROUP BY change")
q("pk_intersect", lambda r: r("v_file").select("pk").intersect(r("v_routes").select("pk")), "SELECT pk FROM {v_file} f INTERSECT SELECT pk FROM {v_routes} r")
q("pk_except", lambda r: r("v_routes").select("pk").subtract(r("v_file").select("pk")), "SELECT pk FROM {v_routes} r EXCEPT SELECT pk FROM {v_file} f")
q("enrich_changed", lambda r: (lambda c: c.filter("change = 'modified'").join(r("v_routes"), "pk").select("pk", "source", "asn"))(journal.snapshot_diff(r("v_file"), _stored(r))), "SELECT r.pk, r.source, r.asn FROM {v_routes} r JOIN {v_file} f ON r.pk = f.pk WHERE f.body <> 'same'")
q("refs_broken", lambda r: changes.broken_references(r("v_mnt_by"), r("v_mntner"), "mntner", "rpsl_pk").select("pk", "mntner"), "SELECT pk, mntner FROM {v_mnt_by} b WHERE NOT EXISTS (SELECT 1 FROM {v_mntner} m WHERE m.rpsl_pk = b.mntner)")
q("refs_inbound", lambda r: changes.inbound_references(r("v_mntner"), r("v_mnt_by"), "rpsl_pk", "mntner").select("rpsl_pk"), "SELECT rpsl_pk FROM {v_mntner} m WHERE EXISTS (SELECT 1 FROM {v_mnt_by} b WHERE b.mntner = m.rpsl_pk)")


def route_parent(r: Relations, rt: DataFrame) -> DataFrame:
    """The parent of each route of rt: an inetnum of the same extent, else the next less specific inetnum, else the next less
    specific route, of its source. Ranges of inetnums are not aligned, so each becomes the prefixes it is made of. Of all that
    share a source and a prefix only the best parent is kept, and each distinct prefix of rt climbs but once."""
    key, place = ["source", "o_len", "o_net"], ["source", "ip_first", "plen"]
    parent = lambda size, name: F.struct(size.alias("size"), name.alias("parent"))
    longest = rt.agg(F.coalesce(F.max("plen"), F.lit(0)).alias("most"))
    nums = r("v_inetnum").join(F.broadcast(longest)).withColumn("num", parent(F.col("ip_last") - F.col("ip_first"), F.col("pk")))
    nums = ladder.blocks(nums, "ip_first", "ip_last", F.col("most")).select(*key, "num")
    over = r("v_routes").select("source", F.col("plen").alias("o_len"), F.col("ip_first").alias("o_net"), parent(F.col("ip_last") - F.col("ip_first"), F.concat(F.lit("R"), F.col("pk").cast("string"))).alias("route"))
    best = nums.groupBy(*key).agg(F.min("num").alias("num")).unionByName(over.groupBy(*key).agg(F.min("route").alias("route")), allowMissingColumns=True)
    lengths = nums.select(F.col("o_len").alias("plen")).unionByName(over.select(F.col("o_len").alias("plen")))
    up = ladder.rungs(rt.select(*place).distinct(), lengths).join(best, key)
    found = up.groupBy(*place).agg(F.min("num").alias("num"), F.min(F.when(F.col("o_len") < F.col("plen"), F.col("route"))).alias("route"))
    exact = F.col("num.size") == ip.power(F.lit(32) - F.col("plen")) - 1  # what contains a prefix and is of its size is equal to it
    chosen = lambda kind, c: F.struct(kind.alias("kind"), F.col(f"{c}.size").alias("size"), F.col(f"{c}.parent").alias("parent"))
    found = found.select(*place, F.when(F.col("num").isNotNull(), chosen(F.when(exact, 0).otherwise(1), "num")).when(F.col("route").isNotNull(), chosen(F.lit(2), "route")).alias("m")).filter("m is not null")
    best = rt.join(found, place).groupBy("pk").agg(F.min("m").alias("m"))
    return best.select("pk", F.col("m.kind").alias("kind"), F.col("m.parent").alias("parent"))


q("route_parent", lambda r: route_parent(r, r("v_routes")), """SELECT pk, kind, parent FROM (SELECT pk, kind, parent, row_number() OVER (PARTITION BY pk ORDER BY kind, size, parent) AS n FROM (
    SELECT r.pk, CASE WHEN i.ip_first = r.ip_first AND i.ip_last = r.ip_last THEN 0 ELSE 1 END AS kind, i.ip_last - i.ip_first AS size, i.pk AS parent FROM {v_routes} r JOIN {v_inetnum} i ON i.source = r.source AND i.ip_first <= r.ip_first AND i.ip_last >= r.ip_last
    UNION ALL SELECT r.pk, 2, o.ip_last - o.ip_first, 'R' || o.pk FROM {v_routes} r JOIN {v_routes} o ON o.source = r.source AND o.ip_first <= r.ip_first AND o.ip_last >= r.ip_last AND o.plen < r.plen) c) d WHERE n = 1""")
q("set_parent", lambda r: r.sql("SELECT 'AS' || CAST(64512 + n_nationkey AS STRING) || ':AS-N' || CAST(n_nationkey AS STRING) AS set_pk FROM {nation}").withColumn("rpsl_pk", F.split_part("set_pk", F.lit(":"), F.lit(1))).join(r("v_autnum"), "rpsl_pk").select("set_pk", F.col("rpsl_pk").alias("parent"), "source"),
  "SELECT 'AS' || (64512 + n_nationkey) || ':AS-N' || n_nationkey AS set_pk, a.rpsl_pk AS parent, a.source FROM {nation} n JOIN {v_autnum} a ON a.rpsl_pk = 'AS' || (64512 + n_nationkey)")
CONTACTS = "SELECT DISTINCT b.pk, c.email FROM {v_mnt_by} b JOIN (SELECT rpsl_pk, mnt_nfy AS email FROM {v_mntner} m1 UNION ALL SELECT m.rpsl_pk, p.email FROM {v_mntner} m JOIN {v_person} p ON m.admin_c = p.rpsl_pk) c ON b.mntner = c.rpsl_pk"


def contacts(r: Relations, by: DataFrame) -> DataFrame:
    m = r("v_mntner")
    people = m.join(r("v_person").select(F.col("rpsl_pk").alias("admin_c"), "email"), "admin_c").select("rpsl_pk", "email")
    mail = m.select("rpsl_pk", F.col("mnt_nfy").alias("email")).unionByName(people)
    return by.join(mail, F.col("mntner") == F.col("rpsl_pk")).select("pk", "email").distinct()


def contact_rollup(r: Relations, c: DataFrame) -> DataFrame:
    return c.join(r("v_routes").select("pk", "source"), "pk").groupBy("email").agg(F.countDistinct("pk").alias("objects"), F.array_join(F.array_sort(F.collect_set("source")), " ").alias("sources"))


q("rpki_contacts", lambda r: contacts(r, r("v_mnt_by")), CONTACTS)
q("contact_rollup", lambda r: contact_rollup(r, contacts(r, r("v_mnt_by"))),
  f"SELECT email, count(DISTINCT c.pk) AS objects, string_agg(DISTINCT source, ' ' ORDER BY source) AS sources FROM ({CONTACTS}) c JOIN {{v_routes}} r ON c.pk = r.pk GROUP BY email")
q("slurm_filter", lambda r: r("v_roas").filter(~((F.col("asn") == 64520) | ((F.col("ip_first") >= 167772160) & (F.col("ip_last") <= 168820735)) | ((F.col("asn") == 64530) & (F.col("ip_first") >= 176160768) & (F.col("ip_last") <= 184549375)))).select("roa"),
  "SELECT roa FROM {v_roas} a WHERE NOT (asn = 64520 OR (ip_first >= 167772160 AND ip_last <= 168820735) OR (asn = 64530 AND ip_first >= 176160768 AND ip_last <= 184549375))")
q("pgp_key_lookup", lambda r: (lambda p: p.select(F.col("rpsl_pk").alias("key_cert"), F.upper(F.md5("rpsl_pk")).alias("fp")).join(p.filter("length(name) % 3 = 0").select(F.upper(F.md5("rpsl_pk")).alias("signed")), (F.right("fp", F.lit(8)) == F.right("signed", F.lit(8))) & (F.col("fp") == F.col("signed"))).select("key_cert"))(r("v_person")),
  "SELECT rpsl_pk AS key_cert FROM {v_person} p WHERE length(name) % 3 = 0")

# ---- aggregates ----
q("stats_by_source_class", lambda r: objects(r).groupBy("source", "object_class").agg(F.count("*").alias("n")), "SELECT source, object_class, count(*) AS n FROM {v_objects} o GROUP BY source, object_class")
q("journal_stats", lambda r: r("v_journal").agg(F.max("serial_global").alias("serial"), F.max("ts").alias("ts")), "SELECT max(serial_global) AS serial, max(ts) AS ts FROM {v_journal} j")
q("journal_serial_minmax", lambda r: r("v_journal").groupBy("source").agg(F.min("serial_nrtm").alias("lo"), F.max("serial_nrtm").alias("hi")), "SELECT source, min(serial_nrtm) AS lo, max(serial_nrtm) AS hi FROM {v_journal} j GROUP BY source")
q("serial_seen_bounds", lambda r: r("v_status").select("source", F.least("serial_oldest_seen", "serial_oldest_journal", F.lit(5).cast("long")).alias("oldest"), F.greatest("serial_newest_seen", "serial_newest_journal", F.lit(5).cast("long")).alias("newest")), "SELECT source, least(serial_oldest_seen, serial_oldest_journal, 5) AS oldest, greatest(serial_newest_seen, serial_newest_journal, 5) AS newest FROM {v_status} s")
STATUS = "SELECT COALESCE(source, 'TOTAL') AS source, count(*) AS total, CAST(sum(CASE WHEN object_class = 'route' THEN 1 ELSE 0 END) AS BIGINT) AS routes, CAST(sum(CASE WHEN object_class = 'aut-num' THEN 1 ELSE 0 END) AS BIGINT) AS autnums FROM {v_objects} o GROUP BY ROLLUP (source)"
_status = lambda r: objects(r).rollup("source").agg(F.count("*").alias("total"), F.sum((F.col("object_class") == "route").cast("long")).alias("routes"), F.sum((F.col("object_class") == "aut-num").cast("long")).alias("autnums")).withColumn("source", F.coalesce("source", F.lit("TOTAL")))
q("status_counts", _status, STATUS)
q("status_table", lambda r: _status(r).select(F.concat_ws(" | ", F.rpad("source", 8, " "), F.col("total").cast("string"), F.col("routes").cast("string"), F.col("autnums").cast("string")).alias("line")), f"SELECT rpad(source, 8, ' ') || ' | ' || total || ' | ' || routes || ' | ' || autnums AS line FROM ({STATUS}) s")
q("metrics_text", lambda r: objects(r).groupBy("source", "object_class").agg(F.count("*").alias("n")).select(F.format_string('objects_total{source="%s",class="%s"} %d', "source", "object_class", "n").alias("line")), """SELECT 'objects_total{source="' || source || '",class="' || object_class || '"} ' || count(*) AS line FROM {v_objects} o GROUP BY source, object_class""")
q("origin_prefixes", lambda r: sets.origin_prefixes(r("v_routes")).groupBy("source", "asn").agg(F.count("*").alias("n"), F.min("ip_first").alias("first")), "SELECT source, asn, count(*) AS n, min(ip_first) AS first FROM (SELECT DISTINCT source, asn, ip_first, plen FROM {v_routes} r) d GROUP BY source, asn")
q("routes_for_origins", lambda r: sets.origin_prefixes(r("v_routes")).filter(F.col("source").isin("SRC0", "SRC2") & F.col("asn").isin(64513, 64520)), "SELECT DISTINCT source, asn, ip_first, plen FROM {v_routes} r WHERE source IN ('SRC0', 'SRC2') AND asn IN (64513, 64520)")
q("asn_prefixes", lambda r: r("v_routes").filter(F.col("asn").between(64512, 64520)).select("asn", "ip_first", "plen").distinct(), "SELECT DISTINCT asn, ip_first, plen FROM {v_routes} r WHERE asn BETWEEN 64512 AND 64520")
q("set_members_store", lambda r: sets.by_reference(r("v_rs"), r("v_member_of"), r("v_mnt_by")).select("set_pk", F.concat(F.lit("R"), F.col("pk").cast("string")).alias("member")).unionByName(r("v_edges").select(F.col("parent").alias("set_pk"), "member")).distinct(),
  "SELECT s.set_pk, 'R' || m.pk AS member FROM {v_rs} s JOIN {v_member_of} m ON s.set_pk = m.set_pk WHERE s.mbrs_by_ref = 'ANY' OR EXISTS (SELECT 1 FROM {v_mnt_by} b WHERE b.pk = m.pk AND b.mntner = s.mbrs_by_ref) UNION SELECT parent, member FROM {v_edges} e")
FIRST = "SELECT parent, member FROM {v_edges} e WHERE source = (SELECT min(source) FROM {v_edges} f WHERE f.parent = e.parent AND f.source IN ('SRC0', 'SRC1'))"
_edges = lambda r: sets.first_source(r("v_edges"), ["SRC0", "SRC1"])
q("set_members_first", _edges, FIRST)
q("change_summary", lambda r: r("v_requests").groupBy("broken").pivot("broken", [True, False]).agg(F.count(F.lit(1))).select("broken", F.coalesce("true", F.lit(0)).cast("long").alias("n_broken"), F.coalesce("false", F.lit(0)).cast("long").alias("n_ok")), "SELECT broken, count(*) FILTER (WHERE broken) AS n_broken, count(*) FILTER (WHERE NOT broken) AS n_ok FROM {v_requests} r GROUP BY broken")
q("metrics_age", lambda r: r("v_status").join(F.broadcast(r("v_now"))).select("source", (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("updated").cast("timestamp"))).alias("age")), "SELECT source, CAST(floor(epoch(now)) - floor(epoch(updated)) AS BIGINT) AS age FROM {v_status} s, {v_now} n")
q("journal_expire_count", lambda r: r("v_journal").join(F.broadcast(r("v_now"))).filter(F.expr("ts < now - INTERVAL 10 DAYS")).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM {v_journal} j, {v_now} x WHERE ts < now - INTERVAL 10 DAY")
q("journal_expire", lambda r: r("v_journal").join(F.broadcast(r("v_now"))).filter(F.expr("ts >= now - INTERVAL 10 DAYS")).select("serial_global"), "SELECT serial_global FROM {v_journal} j, {v_now} x WHERE ts >= now - INTERVAL 10 DAY")

# ---- order and limits ----
_rank = lambda: F.when(F.col("source") == "SRC3", 0).when(F.col("source") == "SRC1", 1).otherwise(100000)
RANK = "CASE source WHEN 'SRC3' THEN 0 WHEN 'SRC1' THEN 1 ELSE 100000 END"
_by = lambda: [_rank(), F.col("ip_first").asc_nulls_last(), F.col("asn_first").asc_nulls_last(), F.col("rpsl_pk")]
BY = f"{RANK}, ip_first NULLS LAST, asn_first NULLS LAST, rpsl_pk"
q("order_default", lambda r: objects(r).orderBy(*_by()).limit(500).select("rpsl_pk", "source", "object_class", "ip_first"), f"SELECT rpsl_pk, source, object_class, ip_first FROM {{v_objects}} o ORDER BY {BY} LIMIT 500")
q("order_status", lambda r: r("v_status").select("source", F.row_number().over(Window.orderBy(F.when(F.col("source") == "view", 0).otherwise(100000), "source")).cast("long").alias("place")), "SELECT source, row_number() OVER (ORDER BY CASE source WHEN 'view' THEN 0 ELSE 100000 END, source) AS place FROM {v_status} s")
q("order_journal", lambda r: r("v_journal").orderBy("source", "serial_nrtm").limit(200).select("source", "serial_nrtm", "rpsl_pk"), "SELECT source, serial_nrtm, rpsl_pk FROM {v_journal} j ORDER BY source, serial_nrtm LIMIT 200")
q("limit_first", lambda r: objects(r).filter("object_class = 'route'").orderBy(*_by()).limit(1).select("rpsl_pk", "source"), f"SELECT rpsl_pk, source FROM {{v_objects}} o WHERE object_class = 'route' ORDER BY {BY} LIMIT 1")
q("key_lookup", lambda r: r("v_edges").filter("parent = 'AS-N4'").groupBy("parent").agg(F.min("source").alias("source")), "SELECT parent, min(source) AS source FROM {v_edges} e WHERE parent = 'AS-N4' GROUP BY parent")
q("changelog_recent", lambda r: r("v_journal").orderBy(F.col("ts").desc(), F.col("serial_global").desc()).limit(50).select("serial_global", "ts"), "SELECT serial_global, ts FROM {v_journal} j ORDER BY ts DESC, serial_global DESC LIMIT 50")
q("gql_limit", lambda r: objects(r).orderBy("k", "rpsl_pk").limit(20).select("k", "rpsl_pk"), "SELECT k, rpsl_pk FROM {v_objects} o ORDER BY k, rpsl_pk LIMIT 20")

# ---- sets: closures ----
REACH = f"""WITH RECURSIVE e AS ({FIRST}), w(root, name) AS (SELECT 'AS-R' || r_regionkey, 'AS-R' || r_regionkey FROM {{region}} UNION SELECT w.root, e.member FROM w JOIN e ON e.parent = w.name %s)
 SELECT root, name AS member FROM w WHERE regexp_matches(name, '^AS[0-9]+$')"""
_roots = lambda r: r.sql("SELECT 'AS-R' || CAST(r_regionkey AS STRING) AS root FROM {region}")
q("set_members_recursive", lambda r: sets.closure(_edges(r), _roots(r)), REACH % "")
q("set_members_excluded", lambda r: sets.closure(_edges(r), _roots(r), excluded=["AS-N3", "AS-N7", "AS-N11"]), REACH % "WHERE e.member NOT IN ('AS-N3', 'AS-N7', 'AS-N11')")
q("set_members_direct", lambda r: _edges(r).filter("member <> parent").select(F.col("parent").alias("root"), "member"), f"SELECT parent AS root, member FROM ({FIRST}) x WHERE member <> parent")
q("set_members_depth", lambda r: sets.closure(_edges(r), _roots(r), depth=2), f"WITH e AS ({FIRST}), a AS (SELECT parent AS root, member FROM e WHERE parent LIKE 'AS-R%'), b AS (SELECT root, member FROM a UNION SELECT a.root, e.member FROM a JOIN e ON a.member = e.parent) SELECT root, member FROM b WHERE root <> member")


def per_source(r: Relations) -> DataFrame:
    """Only the root is pinned to a source; below it the first source that has a set decides."""
    own = r("v_edges").filter("parent like 'AS-N%'").select(F.concat_ws("@", "parent", "source").alias("parent"), "member")
    roots = own.select(F.col("parent").alias("root")).distinct()
    return sets.closure(_edges(r).unionByName(own), roots)


q("set_members_per_source", per_source, f"""WITH RECURSIVE f AS ({FIRST}), e AS (SELECT parent, member FROM f UNION ALL SELECT parent || '@' || source, member FROM {{v_edges}} x WHERE parent LIKE 'AS-N%'),
 w(root, name) AS (SELECT DISTINCT parent || '@' || source, parent || '@' || source FROM {{v_edges}} y WHERE parent LIKE 'AS-N%' UNION SELECT w.root, e.member FROM w JOIN e ON e.parent = w.name) SELECT root, name AS member FROM w WHERE regexp_matches(name, '^AS[0-9]+$')""")
q("as_set_prefixes", lambda r: sets.closure(_edges(r), _roots(r)).withColumn("asn", F.regexp_extract("member", r"(\d+)", 1).cast("long")).join(r("v_routes").select("asn", "ip_first", "plen").distinct(), "asn").select("root", "ip_first", "plen").distinct(),
  f"SELECT DISTINCT c.root, r.ip_first, r.plen FROM ({REACH % ''}) c JOIN {{v_routes}} r ON 'AS' || r.asn = c.member")
q("route_set_members", lambda r: (lambda m: m.filter(F.col("pk") % 2 == 0).select("set_pk", F.concat(F.lit("R"), F.col("pk").cast("string"), F.lit("^+")).alias("member")).unionByName(m.filter(F.col("pk") % 2 == 1).select("set_pk", (64512 + F.col("pk") % 50).alias("asn")).distinct().join(r("v_routes").filter("source = 'SRC0'"), "asn").select("set_pk", F.concat(F.lit("R"), F.col("pk").cast("string")).alias("member")).distinct()))(r("v_member_of")),
  "SELECT set_pk, 'R' || pk || '^+' AS member FROM {v_member_of} m WHERE pk % 2 = 0 UNION ALL SELECT * FROM (SELECT DISTINCT m.set_pk, 'R' || r.pk AS member FROM {v_member_of} m JOIN {v_routes} r ON r.asn = 64512 + m.pk % 50 AND r.source = 'SRC0' WHERE m.pk % 2 = 1) x")
q("set_union_members", lambda r: r("v_edges").select("member").union(r("v_rs").select("set_pk")).distinct(), "SELECT member FROM {v_edges} e UNION SELECT set_pk FROM {v_rs} s")
q("resolve_aliases", lambda r: sets.ordered_unique(r.spark.sql("SELECT * FROM (VALUES (1, 'SRC2'), (2, 'ALL'), (3, 'SRC4')) AS t(position, name)"), {"ALL": ["SRC0", "SRC2", "SRC1"]}), "SELECT * FROM (VALUES ('SRC2', 1::BIGINT), ('SRC0', 2::BIGINT), ('SRC1', 3::BIGINT), ('SRC4', 4::BIGINT)) t(source, position)")
CHAIN = "WITH RECURSIVE bad(req, batch) AS (SELECT req, batch FROM {v_requests} r0 WHERE broken UNION SELECT r.req, r.batch FROM {v_requests} r JOIN bad ON r.refers_to = bad.req AND r.batch = bad.batch)"
q("change_fixpoint", lambda r: changes.fixpoint(r("v_requests")), CHAIN + " SELECT req, NOT EXISTS (SELECT 1 FROM bad b WHERE b.req = v.req) AS valid FROM {v_requests} v")
q("suspend_cascade", lambda r: changes.sole_maintained(r("v_mnt_by"), ["MNT-4"]), "SELECT pk FROM {v_mnt_by} m GROUP BY pk HAVING min(CASE WHEN mntner = 'MNT-4' THEN 1 ELSE 0 END) = 1")
q("suspend_candidates", lambda r: changes.sole_maintained(r("v_mnt_by"), ["MNT-4"]).unionByName(r("v_mnt_by").filter("mntner = 'MNT-4'").select("pk")).dropDuplicates(["pk"]), "SELECT DISTINCT pk FROM {v_mnt_by} m WHERE mntner = 'MNT-4'")
q("reactivate", lambda r: r("v_suspended").filter("mntner = 'MNT-7'").join(r("v_autnum").select("rpsl_pk"), "rpsl_pk", "left_anti").select("rpsl_pk", "source"), "SELECT rpsl_pk, source FROM {v_suspended} s WHERE mntner = 'MNT-7' AND rpsl_pk NOT IN (SELECT rpsl_pk FROM {v_autnum} a)")

# ---- journal ----
q("journal_replay", lambda r: journal.replay(r("v_journal"), ["source", "rpsl_pk"]), "SELECT source, rpsl_pk, serial_global FROM (SELECT *, row_number() OVER (PARTITION BY source, rpsl_pk ORDER BY serial_global DESC) AS n FROM {v_journal} j) t WHERE n = 1 AND operation <> 'DEL'")
q("upsert_merge", lambda r: journal.replay(r("v_journal").withColumn("operation", F.when(F.col("serial_global") % 9 == 0, "DEL").otherwise(F.col("operation"))), ["rpsl_pk"]), "SELECT rpsl_pk, serial_global FROM (SELECT rpsl_pk, serial_global, CASE WHEN serial_global % 9 = 0 THEN 'DEL' ELSE operation END AS op, row_number() OVER (PARTITION BY rpsl_pk ORDER BY serial_global DESC) AS n FROM {v_journal} j) t WHERE n = 1 AND op <> 'DEL'")
NEXT = "SELECT s.source, COALESCE(max(j.serial_nrtm), 0) + 1 AS next_serial FROM {v_status} s LEFT JOIN {v_journal} j ON s.source = j.source GROUP BY s.source"
_new = lambda r: r("v_journal").filter("serial_global % 3 = 0").select("source", "serial_global")
q("serial_assign", lambda r: journal.assign_serials(_new(r), journal.next_serials(r("v_status"), r("v_journal"))).select("source", "serial_global", "serial"), f"SELECT j.source, serial_global, next_serial + row_number() OVER (PARTITION BY j.source ORDER BY serial_global) - 1 AS serial FROM {{v_journal}} j JOIN ({NEXT}) n ON j.source = n.source WHERE serial_global % 3 = 0")
q("journal_append", lambda r: (lambda a: r("v_journal").select("source", "serial_nrtm").unionByName(a.select("source", F.col("serial").alias("serial_nrtm"))).groupBy("source").agg(F.count("*").alias("n"), F.max("serial_nrtm").alias("top")))(journal.assign_serials(_new(r), journal.next_serials(r("v_status"), r("v_journal")))), "SELECT source, count(*) + count(*) FILTER (WHERE serial_global % 3 = 0) AS n, max(serial_nrtm) + count(*) FILTER (WHERE serial_global % 3 = 0) AS top FROM {v_journal} j GROUP BY source")
q("nrtm_serial_check", lambda r: journal.out_of_order(r("v_journal").withColumn("s", F.col("serial_nrtm") - F.when(F.col("serial_global") % 50 == 0, 3).otherwise(0)), "source", "s", "serial_global").select("source", "serial_global"), "SELECT source, serial_global FROM (SELECT source, serial_global, s, max(s) OVER (PARTITION BY source ORDER BY serial_global ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT *, serial_nrtm - CASE WHEN serial_global % 50 = 0 THEN 3 ELSE 0 END AS s FROM {v_journal} j) x) y WHERE s < b")
q("nrtm4_contiguous", lambda r: journal.gaps(r("v_journal").filter("serial_nrtm % 40 <> 0").select("source", F.col("serial_nrtm").alias("version"))).select("source", "version"), "SELECT source, version FROM (SELECT source, serial_nrtm AS version, lag(serial_nrtm) OVER (PARTITION BY source ORDER BY serial_nrtm) AS b FROM {v_journal} j WHERE serial_nrtm % 40 <> 0) x WHERE version <> b + 1")
q("status_transition", lambda r: classify.transitions(objects(r).filter("object_class = 'route'"), classify.origin_validity(r("v_routes"), r("v_roas")).withColumnRenamed("pk", "k")),
  f"""WITH n AS (SELECT r.pk AS k, CASE WHEN max(CASE WHEN a.asn <> 0 AND a.asn = r.asn AND r.plen <= a.max_length THEN 1 ELSE 0 END) = 1 THEN 'valid' WHEN count(a.roa) > 0 THEN 'invalid' ELSE 'not_found' END AS s FROM {{v_routes}} r LEFT JOIN {{v_roas}} a ON a.ip_first <= r.ip_first AND a.ip_last >= r.ip_last GROUP BY r.pk),
  t AS (SELECT o.k, ({VISIBLE}) AS was, (n.s IN ('valid', 'not_found') AND scopefilter_status = 'in_scope' AND route_preference_status = 'visible') AS now FROM {{v_objects}} o JOIN n ON o.k = n.k WHERE o.object_class = 'route') SELECT k, CASE WHEN now THEN 'ADD' ELSE 'DEL' END AS operation FROM t WHERE was <> now""")
q("delete_objects", lambda r: r("v_routes").join(r("v_routes").filter("pk % 13 = 0").select("pk"), "pk", "left_anti").select("pk", "source"), "SELECT pk, source FROM {v_routes} r WHERE pk % 13 <> 0")
q("status_rollup", lambda r: r("v_status").select("source", F.coalesce("serial_oldest_seen", "serial_oldest_journal").alias("oldest"), F.greatest("serial_newest_seen", "serial_newest_journal").alias("newest")), "SELECT source, COALESCE(serial_oldest_seen, serial_oldest_journal) AS oldest, greatest(serial_newest_seen, serial_newest_journal) AS newest FROM {v_status} s")
q("serial_sync", lambda r: r("v_status").select("source", (F.coalesce("serial_oldest_seen", F.lit(0)) <= F.col("serial_newest_journal")).alias("synchronised")), "SELECT source, COALESCE(serial_oldest_seen, 0) <= serial_newest_journal AS synchronised FROM {v_status} s")
q("import_needed", lambda r: r("v_status").select("source", (F.lit(100) > F.col("serial_newest_seen")).alias("needed")), "SELECT source, 100 > serial_newest_seen AS needed FROM {v_status} s")
q("import_mode", lambda r: r("v_status").select("source", F.when(F.col("serial_oldest_seen").isNull() | (F.col("source") == "view"), "full").otherwise("incremental").alias("mode")), "SELECT source, CASE WHEN serial_oldest_seen IS NULL OR source = 'view' THEN 'full' ELSE 'incremental' END AS mode FROM {v_status} s")
q("delta_expiry", lambda r: r("v_journal").join(F.broadcast(r("v_now"))).filter(F.expr("ts < now - INTERVAL 24 HOURS")).groupBy("source").agg(F.count("*").alias("expired")), "SELECT source, count(*) AS expired FROM {v_journal} j, {v_now} n WHERE ts < now - INTERVAL 24 HOUR GROUP BY source")
q("preload_dirty_classes", lambda r: r("v_journal").join(r("v_person").select("rpsl_pk"), "rpsl_pk", "left_semi").groupBy("source").agg(F.count("*").alias("dirty")), "SELECT source, count(*) AS dirty FROM {v_journal} j WHERE rpsl_pk IN (SELECT rpsl_pk FROM {v_person} p) GROUP BY source")
q("rate_limit_moving", lambda r: r("v_journal").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp"))).withColumn("n", F.count("*").over(Window.partitionBy("source").orderBy("s").rangeBetween(-3600, 0))).select("serial_global", "n"), "SELECT serial_global, count(*) OVER (PARTITION BY source ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM {v_journal} j")
q("ext_window_tumbling", lambda r: r("v_journal").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "source").agg(F.count("*").alias("n")).select(text.iso_utc(F.col("w.start")).alias("hour"), "source", "n"), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour, source, count(*) AS n FROM {v_journal} j GROUP BY ALL")
q("es_follow", lambda r: r("v_journal").filter("serial_global > 700").select("serial_global", "operation"), "SELECT serial_global, operation FROM {v_journal} j WHERE serial_global > 700")

# ---- sinks as rows ----
q("nrtm4_snapshot", lambda r: objects(r).filter(classify.visible()).filter("object_class = 'aut-num'").select(F.concat(F.lit("\x1e"), F.to_json(F.struct("rpsl_pk", "source")), F.lit("\n")).alias("record")), f"""SELECT chr(30) || '{{"rpsl_pk":"' || rpsl_pk || '","source":"' || source || '"}}' || chr(10) AS record FROM {{v_objects}} o WHERE object_class = 'aut-num' AND {VISIBLE}""".replace('{{"', '{"').replace('"}}', '"}'))
q("nrtm4_delta", lambda r: r("v_journal").filter("serial_global > 900").select("serial_global", F.to_json(F.struct(F.when(F.col("operation") == "ADD", "add_modify").otherwise("delete").alias("action"), F.col("rpsl_pk").alias("primary_key"))).alias("record")), """SELECT serial_global, '{"action":"' || CASE operation WHEN 'ADD' THEN 'add_modify' ELSE 'delete' END || '","primary_key":"' || rpsl_pk || '"}' AS record FROM {v_journal} j WHERE serial_global > 900""")
q("jsonseq_encode", lambda r: r("v_mntner").select(F.concat(F.lit("\x1e"), F.to_json(F.struct("rpsl_pk")), F.lit("\n")).alias("record")), """SELECT chr(30) || '{"rpsl_pk":"' || rpsl_pk || '"}' || chr(10) AS record FROM {v_mntner} m""")
q("nrtm3_response", lambda r: r("v_journal").filter("serial_nrtm <= 40").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial_nrtm", "operation", "rpsl_pk"))), lambda x: F.concat_ws(" ", x["operation"], x["serial_nrtm"].cast("string"), x["rpsl_pk"])), "\n").alias("body")), "SELECT source, string_agg(operation || ' ' || serial_nrtm || ' ' || rpsl_pk, chr(10) ORDER BY serial_nrtm) AS body FROM {v_journal} j WHERE serial_nrtm <= 40 GROUP BY source")
q("es_initial", lambda r: objects(r).filter("object_class = 'as-block'").select(F.to_json(F.struct(F.col("rpsl_pk").alias("pk"), "object_class")).alias("line")), """SELECT '{"pk":"' || rpsl_pk || '","object_class":"' || object_class || '"}' AS line FROM {v_objects} o WHERE object_class = 'as-block'""")
q("export_source", lambda r: r("v_mntner").select(text.render([("mntner", F.col("rpsl_pk")), ("mnt-nfy", F.col("mnt_nfy")), ("admin-c", F.col("admin_c"))]).alias("body")), "SELECT rpad('mntner:', 16, ' ') || rpsl_pk || chr(10) || rpad('mnt-nfy:', 16, ' ') || mnt_nfy || chr(10) || rpad('admin-c:', 16, ' ') || admin_c || chr(10) AS body FROM {v_mntner} m")
q("wire_format", lambda r: r("documents").select("doc_id", F.octet_length(text.wire(F.col("text"))).cast("long").alias("n"), F.md5(text.wire(F.col("text"))).alias("h")), "SELECT doc_id, CAST(strlen(w) AS BIGINT) AS n, md5(w) AS h FROM (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'C' || chr(10) ELSE 'A' || (strlen(text) + 1) || chr(10) || text || chr(10) || 'C' || chr(10) END AS w FROM {documents} d) x")

# ---- scalar functions over texts and literals ----
q("fn_mask_hashes", lambda r: r("v_mntner").select("rpsl_pk", text.mask_hashes(F.concat(F.lit("mntner: "), F.col("rpsl_pk"), F.lit("\nauth: md5-pw $1$abc\nauth: CRYPT-PW x y\nsource: A"))).alias("masked")), "SELECT rpsl_pk, 'mntner: ' || rpsl_pk || chr(10) || 'auth: md5-pw DummyValue  # Filtered for security' || chr(10) || 'auth: CRYPT-PW DummyValue  # Filtered for security' || chr(10) || 'source: A' AS masked FROM {v_mntner} m")
q("fn_strip_last_modified", lambda r: r("v_mntner").select("rpsl_pk", text.strip_last_modified(F.concat(F.lit("a: 1\nlast-modified: 2020-01-01\nm: "), F.col("rpsl_pk"))).alias("kept")), "SELECT rpsl_pk, 'a: 1' || chr(10) || 'm: ' || rpsl_pk AS kept FROM {v_mntner} m")
q("fn_split_lines", lambda r: r("documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("i"), F.md5("line").alias("h")), "SELECT doc_id, i - 1 AS i, md5(trim(s[i], chr(13))) AS h FROM (SELECT doc_id, string_split(trim(text, chr(10)), chr(10)) AS s, unnest(range(1, len(string_split(trim(text, chr(10)), chr(10))) + 1)) AS i FROM {documents} d WHERE text <> '') x")
q("fn_camel", lambda r: r("v_person").select("rpsl_pk", text.camel(F.concat(F.lit("mnt_by-"), F.lower("rpsl_pk"), F.lit("-new_key"))).alias("name")), "SELECT rpsl_pk, 'mntBy' || rpsl_pk || 'NewKey' AS name FROM {v_person} p")
q("fn_normalise_value", lambda r: r("v_mntner").select("rpsl_pk", text.normalise_value(F.concat(F.lit(" a # x\n\n"), F.col("rpsl_pk"), F.lit(" \n# only\nb"))).alias("v")), "SELECT rpsl_pk, 'a,' || rpsl_pk || ',b' AS v FROM {v_mntner} m")
q("fn_attr_pairs", lambda r: r("v_mntner").select("rpsl_pk", F.explode(text.fold_continuations(F.concat(F.lit("mntner: "), F.col("rpsl_pk"), F.lit("\ndescr: one\n  two\n+three\nsource: A")))).alias("line")), "SELECT rpsl_pk, unnest(['mntner: ' || rpsl_pk, 'descr: one' || chr(1) || 'two' || chr(1) || 'three', 'source: A']) AS line FROM {v_mntner} m")
q("fn_route_key", lambda r: r("v_routes").select("pk", text.route_key(F.concat(ip.dotted(F.col("ip_first")), F.lit("/24 - as"), F.col("asn").cast("string"))).alias("key")), "SELECT pk, ((ip_first >> 24) & 255) || '.' || ((ip_first >> 16) & 255) || '.' || ((ip_first >> 8) & 255) || '.' || (ip_first & 255) || '/24AS' || asn AS key FROM {v_routes} r")
q("fn_pk", lambda r: r("v_routes").select("pk", F.upper(F.concat(ip.dotted(F.col("ip_first")), F.lit("/"), F.col("plen").cast("string"), F.lit("as"), F.col("asn").cast("string"))).alias("rpsl_pk")), "SELECT pk, ((ip_first >> 24) & 255) || '.' || ((ip_first >> 16) & 255) || '.' || ((ip_first >> 8) & 255) || '.' || (ip_first & 255) || '/' || plen || 'AS' || asn AS rpsl_pk FROM {v_routes} r")
q("fn_list_field", lambda r: r("v_mntner").select("rpsl_pk", F.explode(text.list_values(F.concat(F.lit("a, "), F.col("rpsl_pk"), F.lit(",, b ")))).alias("v")), "SELECT rpsl_pk, unnest(['a', rpsl_pk, 'b']) AS v FROM {v_mntner} m")
q("fn_canonical_answer", lambda r: r("conversations").select("conv_id", "turn", F.md5(text.canonical_answer(F.col("text"))).alias("h")), r"SELECT conv_id, turn, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''))), ' ')) AS h FROM {conversations} c")
q("fn_email", lambda r: r("v_person").select("rpsl_pk", text.email_ok(F.when(F.length("name") % 2 == 0, F.col("email")).otherwise(F.col("name"))).alias("ok")), "SELECT rpsl_pk, length(name) % 2 = 0 AS ok FROM {v_person} p")
q("fn_parse_asn", lambda r: r("v_autnum").select("rpsl_pk", ip.as_number(F.col("rpsl_pk")).alias("asn"), ip.as_number(F.lit("as1.10")).alias("dotted"), ip.as_number(F.lit("AS4294967296")).alias("big")), "SELECT rpsl_pk, asn_first AS asn, CAST(65546 AS BIGINT) AS dotted, CAST(NULL AS BIGINT) AS big FROM {v_autnum} a")
q("fn_ipv4_prefix", lambda r: r("v_routes").select("pk", *[c.cast("long").alias(n) for c, n in zip(ip.prefix(F.concat(ip.dotted(F.col("ip_first")), F.lit("/"), F.col("plen").cast("string"))), ("first", "length"), strict=True)]), "SELECT pk, ip_first AS first, CAST(plen AS BIGINT) AS length FROM {v_routes} r")
q("fn_ipv4_range", lambda r: r("v_inetnum").select("pk", *[c.alias(n) for c, n in zip(ip.address_range(F.concat(ip.dotted(F.col("ip_first")), F.lit(" - "), ip.dotted(F.col("ip_last")))), ("first", "last"), strict=True)]), "SELECT pk, ip_first AS first, ip_last AS last FROM {v_inetnum} i")
q("fn_ip_bits", lambda r: r("v_routes").select("pk", F.lpad(F.conv(F.col("ip_first").cast("string"), 10, 2), 32, "0").substr(F.lit(1), F.col("plen")).alias("bits")), "SELECT pk, lpad(bin(ip_first), 32, '0')[1:plen] AS bits FROM {v_routes} r")
q("fn_overlaps", lambda r: r("v_inetnum").select("pk", ip.overlaps(F.col("ip_first"), F.col("ip_last"), F.lit(Q_FIRST), F.lit(Q_LAST * 2)).alias("hit")), f"SELECT pk, ip_first <= {Q_LAST * 2} AND ip_last >= {Q_FIRST} AS hit FROM {{v_inetnum}} i")
q("fn_ip_size", lambda r: r("v_inetnum").select("pk", (F.col("ip_last") - F.col("ip_first") + 1).alias("n")), "SELECT pk, ip_last - ip_first + 1 AS n FROM {v_inetnum} i")
q("fn_route_blocklist", lambda r: r("v_routes").filter((F.col("plen") == 0) | ((F.col("ip_first") == 0) & (F.col("plen") == 32)) | F.col("pk").isin(5, 6)).select("pk"), "SELECT pk FROM {v_routes} r WHERE plen = 0 OR (ip_first = 0 AND plen = 32) OR pk IN (5, 6)")
q("fn_iso_utc", lambda r: r("v_journal").select("serial_global", text.iso_utc(F.col("ts")).alias("at")), "SELECT serial_global, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM {v_journal} j")
q("fn_age_days", lambda r: r("v_journal").join(F.broadcast(r("v_now"))).select("serial_global", (F.timestamp_diff("SECOND", F.col("ts"), F.col("now")) > 7 * 86400).alias("old")), "SELECT serial_global, date_diff('second', ts, now) > 7 * 86400 AS old FROM {v_journal} j, {v_now} n")
q("fn_json_get", lambda r: r("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events} e")
q("fn_json_exists", lambda r: r("events").select("event_id", F.map_contains_key(F.from_json("props", "map<string,string>"), "k").alias("has")), "SELECT event_id, json_exists(props, '$.k') AS has FROM {events} e")
q("fn_json_roundtrip", lambda r: r("events").select("event_id", F.to_json(F.from_json("props", "k long")).alias("j")), """SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS j FROM {events} e""")
q("fn_array_concat", lambda r: r("v_mnt_by").groupBy("pk").agg(F.array_join(F.array_sort(F.array_distinct(F.concat(F.collect_list("mntner"), F.array(F.lit("MNT-0"))))), " ").alias("m")), "SELECT pk, array_to_string(list_sort(list_distinct(list_append(list(mntner), 'MNT-0'))), ' ') AS m FROM {v_mnt_by} b GROUP BY pk")
q("fn_set_name", lambda r: r("v_edges").select("member", text.set_name_ok(F.col("member")).alias("ok")).distinct(), "SELECT DISTINCT member, regexp_full_match(member, 'AS-[A-Z0-9_-]*[A-Z0-9]') AS ok FROM {v_edges} e")
q("fn_generic_name", lambda r: r("v_mntner").select("rpsl_pk", text.generic_name_ok(F.col("rpsl_pk")).alias("ok"), text.generic_name_ok(F.lit("as-any")).alias("bad"), text.generic_name_ok(F.lit("rs_any")).alias("word")), "SELECT rpsl_pk, true AS ok, false AS bad, false AS word FROM {v_mntner} m")
q("render_ov_state", lambda r: objects(r).filter("object_class = 'route'").select("k", F.concat(F.lit("rpki-ov-state:  "), F.col("rpki_status")).alias("line")), "SELECT k, 'rpki-ov-state:  ' || rpki_status AS line FROM {v_objects} o WHERE object_class = 'route'")
q("notify_targets", lambda r: r("v_requests").join(r("v_mnt_by").withColumnRenamed("pk", "req"), "req").join(r("v_mntner"), F.col("mntner") == F.col("rpsl_pk")).groupBy("mnt_nfy").agg(F.countDistinct("req").alias("n")), "SELECT mnt_nfy, count(DISTINCT req) AS n FROM {v_requests} r JOIN {v_mnt_by} b ON r.req = b.pk JOIN {v_mntner} m ON b.mntner = m.rpsl_pk GROUP BY mnt_nfy")
q("change_type", lambda r: r("v_file").join(_stored(r).withColumnRenamed("body", "old"), "pk", "left").select("pk", F.when(F.col("old").isNull(), "create").when(F.col("old") == F.col("body"), "no-op").otherwise("modify").alias("type")), "SELECT f.pk, CASE WHEN r.pk IS NULL THEN 'create' WHEN f.body = 'same' THEN 'no-op' ELSE 'modify' END AS type FROM {v_file} f LEFT JOIN {v_routes} r ON f.pk = r.pk")
q("auth_check", lambda r: r("v_mnt_by").groupBy("pk").agg(F.max(F.col("mntner").isin("MNT-1", "MNT-5").cast("int")).alias("a")).select("pk", (F.col("a") == 1).alias("allowed")), "SELECT pk, max(CASE WHEN mntner IN ('MNT-1', 'MNT-5') THEN 1 ELSE 0 END) = 1 AS allowed FROM {v_mnt_by} m GROUP BY pk")
q("rules_check", lambda r: r("v_mnt_by").join(r("v_suspended").select("mntner").distinct(), "mntner", "left_semi").select("pk").distinct(), "SELECT DISTINCT pk FROM {v_mnt_by} m WHERE mntner IN (SELECT mntner FROM {v_suspended} s)")
q("change_status", lambda r: r("v_requests").select("req", F.when(F.col("broken"), "error: parse").when(F.col("req") % 7 == 0, "error: auth").when(F.col("refers_to").isNull(), "ok: leaf").otherwise("ok").alias("status")), "SELECT req, CASE WHEN broken THEN 'error: parse' WHEN req % 7 = 0 THEN 'error: auth' WHEN refers_to IS NULL THEN 'ok: leaf' ELSE 'ok' END AS status FROM {v_requests} r")
q("change_rpki_scope", lambda r: classify.origin_validity(r("v_routes"), r("v_roas")).filter("rpki_status = 'invalid'").select("pk"), "SELECT r.pk FROM {v_routes} r JOIN {v_roas} a ON a.ip_first <= r.ip_first AND a.ip_last >= r.ip_last GROUP BY r.pk HAVING max(CASE WHEN a.asn <> 0 AND a.asn = r.asn AND r.plen <= a.max_length THEN 1 ELSE 0 END) = 0")
q("database_status", lambda r: r("v_status").join(objects(r).groupBy(F.lower("source").alias("s")).agg(F.count("*").alias("n")), F.col("s") == F.col("source"), "left").select("source", "serial_newest_journal", F.coalesce("n", F.lit(0)).alias("objects")), "SELECT source, serial_newest_journal, (SELECT count(*) FROM {v_objects} o WHERE lower(o.source) = s.source) AS objects FROM {v_status} s")

# ---- sources over literal texts ----
_body = lambda r, t: r.spark.createDataFrame([(t,)], "body string")
DUMP = "# head\nroute: 192.0.2.0/24\n% note\ndescr: one\n  two\n\n\n%only\n\nmntner: A\nsource: T\n"
STREAM = "%START Version: 3 TEST 11-14\n\nADD 11\n\nperson: a\n\nDEL 14\n\nroute: b\n\n%END TEST\n"
ROA_JSON = '{"roas":[{"asn":64496,"prefix":"192.0.2.0/25","maxLength":26,"ta":"x"},{"asn":"AS64497","prefix":"2001:db8:1::/48","maxLength":48,"ta":"x"},{"asn":"64498","prefix":"198.51.100.0/24","maxLength":24,"ta":"x"}]}'
SLURM_JSON = '{"slurmVersion":1,"validationOutputFilters":{"prefixFilters":[{"prefix":"192.0.2.0/24"},{"asn":64498}]},"locallyAddedAssertions":{"prefixAssertions":[{"asn":64511,"prefix":"192.0.2.0/24"}]}}'
q("src_rpsl_paragraphs", lambda r: _body(r, DUMP).select(F.explode(registry.paragraphs_of(F.col("body"))).alias("text")), "SELECT * FROM (VALUES ('route: 192.0.2.0/24' || chr(10) || 'descr: one' || chr(10) || '  two' || chr(10)), ('mntner: A' || chr(10) || 'source: T' || chr(10))) t(text)")
q("src_rpsl_comments", lambda r: _body(r, DUMP).select(F.explode(registry.paragraphs_of(F.col("body"), False)).alias("text")), "SELECT * FROM (VALUES ('route: 192.0.2.0/24' || chr(10) || '% note' || chr(10) || 'descr: one' || chr(10) || '  two' || chr(10)), ('%only' || chr(10)), ('mntner: A' || chr(10) || 'source: T' || chr(10))) t(text)")
q("src_roas", lambda r: registry.roas_of(_body(r, ROA_JSON)), "SELECT * FROM (VALUES ('192.0.2.0/25', 64496::BIGINT, 26, 'x'), ('2001:db8:1::/48', 64497::BIGINT, 48, 'x'), ('198.51.100.0/24', 64498::BIGINT, 24, 'x')) t(prefix, asn, max_length, trust_anchor)")
q("src_slurm", lambda r: registry.apply_slurm(registry.roas_of(_body(r, ROA_JSON)), *registry.slurm_of(_body(r, SLURM_JSON))), "SELECT * FROM (VALUES ('2001:db8:1::/48', 64497::BIGINT, 48, 'x'), ('192.0.2.0/24', 64511::BIGINT, 24, 'SLURM file')) t(prefix, asn, max_length, trust_anchor)")
q("src_jsonseq", lambda r: _body(r, '\x1e{"v":1}\n\x1e{"v":2}\n').select(F.explode(registry.jsonseq_of(F.col("body"), "v long")).alias("x")).select("x.v"), "SELECT * FROM (VALUES (1::BIGINT), (2::BIGINT)) t(v)")
q("src_nrtm3", lambda r: registry.mirror_operations(_body(r, STREAM)).select("source", "serial", "operation", "text"), "SELECT * FROM (VALUES ('TEST', 11::BIGINT, 'ADD', 'person: a' || chr(10)), ('TEST', 14::BIGINT, 'DEL', 'route: b' || chr(10))) t(source, serial, operation, text)")
q("rpsl_parse", lambda r: _body(r, DUMP).select(F.explode(registry.paragraphs_of(F.col("body"))).alias("t")).select(F.inline(registry.attributes_of(F.col("t")))), "SELECT * FROM (VALUES ('route', '192.0.2.0/24'), ('descr', 'one' || chr(10) || 'two'), ('mntner', 'A'), ('source', 'T')) t(name, value)")
q("fn_ipv6_prefix", lambda r: _body(r, "2001:db8::/32").select(F.lower(F.hex(ip.ipv6_prefix(F.col("body"))["first"])).alias("first"), ip.ipv6_prefix(F.col("body"))["length"].alias("length")), "SELECT '20010db8000000000000000000000000' AS first, 32 AS length")
