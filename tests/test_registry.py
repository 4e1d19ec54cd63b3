"""Truth tables of the classifications, closures and rules on small frames."""

import ipaddress

from prefixloom.functions import ip
from prefixloom.operators import changes, classify, journal, ladder, sets
from pyspark.sql import functions as F


def prefix(text):
    n = ipaddress.ip_network(text)
    return int(n.network_address), n.prefixlen, int(n.broadcast_address)


def test_origin_validation(spark):
    routes = [("no_roa", "198.51.100.0/24", 1, "A"), ("ok", "192.0.2.0/24", 65546, "A"), ("long", "192.0.2.0/29", 65546, "A"), ("other", "192.0.2.0/24", 7, "A"), ("as0", "203.0.113.1/32", 0, "A"), ("skipped", "192.0.2.0/24", 7, "X")]
    roas = [("192.0.2.0/24", 65546, 28), ("192.0.2.0/24", 65547, 24), ("203.0.113.1/32", 0, 32), ("198.51.100.0/25", 1, 25)]
    r = spark.createDataFrame([(k, *prefix(p), a, s) for k, p, a, s in routes], "pk string, ip_first long, plen int, ip_last long, asn long, source string")
    a = spark.createDataFrame([(*prefix(p), n, m) for p, n, m in roas], "ip_first long, plen int, ip_last long, asn long, max_length int")
    got = {x.pk: x.rpki_status for x in classify.origin_validity(r, a, ("X",)).collect()}
    assert got == {"no_roa": "not_found", "ok": "valid", "long": "invalid", "other": "invalid", "as0": "invalid", "skipped": "not_found"}


def test_preference(spark):
    rows = [("A", "HIGH-A", "192.0.0.0/23"), ("B", "HIGH-B", "192.0.0.0/24"), ("C", "LOWEST", "192.0.0.0/23"), ("D", "LOW", "192.0.0.0/22"), ("E", "LOW", "192.0.1.0/24"), ("F", "LOWEST", "192.0.3.0/24"), ("G", "NONE", "192.0.0.0/24"), ("I", "LOWEST", "198.51.100.0/24")]
    r = spark.createDataFrame([(k, s, *prefix(p)) for k, s, p in rows], "pk string, source string, ip_first long, plen int, ip_last long")
    p = spark.createDataFrame([("HIGH-A", 900), ("HIGH-B", 900), ("LOW", 200), ("LOWEST", 100)], "source string, pref int")
    got = {x.pk: x.status for x in classify.preference(r, p).collect()}
    assert got == dict.fromkeys("ABGI", "visible") | dict.fromkeys("CDEF", "suppressed")


def test_closure_with_cycle_leaf_depth_and_exclusion(spark):
    edges = [("AS-ONE", m) for m in ("AS65547", "AS-ONE", "AS-TWO", "AS-GONE")] + [("AS-TWO", "AS-THREE"), ("AS-TWO", "AS65544"), ("AS-THREE", "AS65545"), ("AS-THREE", "AS-ONE")]
    e = spark.createDataFrame(edges, "parent string, member string")
    root = spark.createDataFrame([("AS-ONE",)], "root string")
    members = lambda **k: sorted(x.member for x in sets.closure(e, root, **k).collect())
    assert members() == ["AS65544", "AS65545", "AS65547"]
    assert members(depth=1) == ["AS-GONE", "AS-TWO", "AS65547"]
    assert members(excluded=["AS-THREE"]) == ["AS65544", "AS65547"]


def test_first_source_wins(spark):
    e = spark.createDataFrame([("B", "S", "x"), ("A", "S", "y"), ("B", "T", "z"), ("C", "T", "w")], "source string, parent string, member string")
    assert sorted((r.parent, r.member) for r in sets.first_source(e, ["A", "B"]).collect()) == [("S", "y"), ("T", "z")]


def test_range_rules():
    ask = lambda *a: journal.range_answer(*a).split(":")[0]
    assert [ask(5, 9, 1, 10), ask(11, None, 1, 10), ask(0, 5, 1, 10), ask(5, 11, 1, 10), ask(6, 5, 1, 10), ask(1, 5, 1, 10, 4), ask(1, 6, 1, 10, 4), ask(1, 2, None, None)] == ["ok", "warning", "error", "error", "error", "ok", "error", "error"]


def test_addresses(spark):
    df = spark.createDataFrame([("192.0.2.0/24",), ("192.0.2.1/24",), ("192.0.02.0",), ("1.2.3.256",), (None,), ("x",)], "t string")
    first, n = ip.prefix(F.col("t"))
    assert [tuple(r) for r in df.select(first.alias("a"), n.alias("n")).collect()] == [(3221225984, 24), (None, None), (3221225984, 32), (None, None), (None, None), (None, None)]
    v6 = spark.createDataFrame([("2001:db8::/32",), ("2001:db8::1/32",), (None,)], "t string").select(ip.ipv6_prefix("t").alias("p")).select("p.length", F.hex("p.last").alias("last")).collect()
    assert v6[0].length == 32 and v6[0].last == "20010DB8" + "F" * 24 and v6[1].length is None and v6[2].length is None
    asn = spark.createDataFrame([("AS1",), ("65000",), ("as1.1",), ("AS4294967296",)], "t string").select(ip.as_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in asn] == [1, None, 65537, None]


def test_plans_have_no_cartesian_product(spark):
    from prefixloom.plans import catalog

    for name in ("rpki_validate_bulk", "route_preference", "route_parent", "ip_more_specific"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_both_address_families(spark):
    routes = spark.createDataFrame([(1, "192.0.2.0/24", 24, 1, "A"), (2, "192.0.2.0/25", 25, 2, "A"), (3, "2001:db8::/32", 32, 1, "A"), (4, "2001:db8:1::/48", 48, 1, "B"), (5, "2001:db9::/32", 32, 9, "B")], "pk long, prefix string, plen int, asn long, source string")
    roas = spark.createDataFrame([("192.0.2.0/24", 24, 24, 1), ("2001:db8::/32", 32, 40, 1), ("::/0", 0, 0, 7)], "prefix string, plen int, max_length int, asn long")
    routes, roas = (t.withColumn("bits", ip.prefix_bits(F.col("prefix"))) for t in (routes, roas))
    got = {r.pk: r.rpki_status for r in classify.origin_validity(routes, roas).collect()}
    assert got == {1: "valid", 2: "invalid", 3: "valid", 4: "invalid", 5: "invalid"}
    rated = spark.createDataFrame([("A", 10), ("B", 20)], "source string, pref int")
    assert {r.pk: r.status for r in classify.preference(routes, rated).collect()} == {1: "visible", 2: "visible", 3: "suppressed", 4: "visible", 5: "visible"}
    asked = spark.createDataFrame([(1, "2001:db8:1:2::/64")], "q long, prefix string").select("q", ip.prefix_bits(F.col("prefix")).alias("bits"))
    assert [r.o_pk for r in ladder.next_less_specific(asked, routes, "q").collect()] == [4]


def test_diff_of_null_bodies(spark):
    new, old = (spark.createDataFrame(x, "pk long, body string") for x in ([(1, None), (2, "a"), (3, "b"), (4, None)], [(1, None), (2, None), (5, None), (3, "b")]))
    assert {r.pk: r.change for r in journal.snapshot_diff(new, old).collect()} == {1: "retained", 2: "modified", 3: "retained", 4: "new", 5: "deleted"}


def test_address_in_two_entries_comes_once(spark):
    a = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "pk long, ip_first long")
    acl = spark.createDataFrame([(0, 10), (5, 6)], "ip_first long, ip_last long")
    assert sorted((r.pk, r.permitted) for r in classify.permitted(a, acl).collect()) == [(1, True), (2, False), (3, False)]


def test_long_chains_of_changes(spark):
    rows = [(i, 1, i + 1 if i < 14 else None, i == 14) for i in range(15)] + [(20, 1, None, False)]
    got = {r.req: r.valid for r in changes.fixpoint(spark.createDataFrame(rows, "req long, batch long, refers_to long, broken boolean")).collect()}
    assert got == dict.fromkeys(range(15), False) | {20: True}


def test_inbound_references_count_a_name_once(spark):
    objects = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "name string, n int")
    refs = spark.createDataFrame([("b",), ("b",), ("c",), (None,)], "to string")
    df = changes.inbound_references(objects, refs, "name", "to")
    assert sorted(r.n for r in df.collect()) == [2, 3]
    assert "Aggregate [" in df._jdf.queryExecution().optimizedPlan().toString()


def prefixes(spark, rng, n, name):
    rows = []
    for i in range(n):
        plen = rng.choice([0, 8, 9, 10, 11])
        first = rng.getrandbits(plen) << (32 - plen)
        rows += [(i, first, plen)] * (2 if i % 7 == 0 else 1)
    return rows, spark.createDataFrame(rows, f"{name} long, ip_first long, plen int")


def test_pairs_in_lists(spark, monkeypatch):
    import random

    monkeypatch.setattr(ladder, "LIST", 3)
    rng, inside = random.Random(1), lambda x, y: x[2] >= y[2] and x[1] >> (32 - y[2]) == y[1] >> (32 - y[2])
    (a, left), (b, right) = prefixes(spark, rng, 60, "a"), prefixes(spark, rng, 40, "b")
    bits = lambda df: df.withColumn("bits", F.concat(F.lit("4:"), F.lpad(F.conv(F.col("ip_first").cast("string"), 10, 2), 32, "0").substr(F.lit(1), F.col("plen"))))
    for turn in (lambda df: df, bits):
        for strict in (False, True):
            got = sorted(tuple(r) for r in ladder.pairs(turn(left), turn(right), "a", "b", strict).collect())
            assert got == sorted((x[0], y[0]) for x in a for y in b if inside(x, y) and not (strict and x[2] == y[2]))
        over = {x[0]: [y for y in b if inside(x, y) and x[2] != y[2]] for x in a}
        want = sorted((x[0], y[0]) for x in a for y in over[x[0]] if y[2] == max(z[2] for z in over[x[0]]))
        assert sorted(tuple(r) for r in ladder.next_less_specific(turn(left), turn(right), "a", "b").collect()) == want


def test_pairs_of_ids_come_last(spark):
    """Ids are paired in lists above every shuffle, so that these carry rows and not pairs."""
    from prefixloom.plans import catalog

    for name in ("ip_more_specific_mixed", "ip_less_specific_mixed", "ip_less_specific_one_mixed", "ip_exact_mixed", "roa_covering_mixed", "roa_covering", "ip_any", "ip_less_specific_one", "ip_more_specific", "ip_less_specific"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(" in plan and plan.index("Generate explode(inner__") < plan.index("Join Inner"), name


def test_ids_of_two_lists_are_not_one_loop(spark):
    """The two explodes of `meet` in one compiled stage would hold LIST * LIST pairs before the first is passed on."""
    import re

    rows = spark.range(4).select("id", F.lit(1).alias("k"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = ladder.meet(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), ["k"], "a", "b")
        stages = re.findall(r"(\*\(\d+\) )?Generate explode\(", df._jdf.queryExecution().executedPlan().toString())
        assert len(stages) == 2 and len(set(stages)) == 2
        assert sorted(tuple(r) for r in df.collect()) == [(a, b) for a in range(4) for b in range(4)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_rows_of_one_prefix_climb_together(spark, monkeypatch):
    climbed, real = [], ladder.rungs_bits
    monkeypatch.setattr(ladder, "LIST", 16)
    monkeypatch.setattr(ladder, "rungs_bits", lambda inside, outside: climbed.append(inside.count()) or real(inside, outside))
    inside = spark.createDataFrame([(i, "4:0101") for i in range(20)] + [(20, "4:011"), (None, "4:01")], "a long, bits string")
    outside = spark.createDataFrame([(1, "4:01"), (2, "4:010"), (2, "4:010"), (3, "6:01")], "b long, bits string")
    got = sorted(tuple(r) for r in ladder.pairs(inside, outside, "a", "b").collect())
    assert got == sorted([(i, b) for i in range(20) for b in (1, 2, 2)] + [(20, 1)])
    assert climbed == [3]


def test_any_keeps_repeated_rows(spark, tmp_path):
    """As in its SQL, a pair of rows is one row, also if its ids repeat."""
    from prefixloom.plans import catalog

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey < 300")
    orders.unionByName(orders.filter("o_orderkey % 100 < 2")).write.parquet(str(tmp_path / "orders.parquet"))
    r = catalog.Relations(spark, str(tmp_path))
    rows = r("v_routes").collect()
    want = sorted((q.pk, x.pk) for q in rows if q.pk % 100 == 0 for x in rows if (x.ip_first >= q.ip_first and x.ip_last <= q.ip_last) or (x.ip_first <= q.ip_first and x.ip_last >= q.ip_last))
    assert sorted(tuple(x) for x in catalog.queries()["ip_any"](spark, str(tmp_path)).collect()) == want


def test_ranges_as_prefixes(spark):
    ranges = [(0, 2**32 - 1), (1, 1), (5, 4), (3, 17), (2**31 - 5, 2**31 + 9), (256, 511)]
    rows = spark.createDataFrame(ranges, "a long, b long")
    got = {}
    for x in ladder.blocks(rows, "a", "b").collect():
        got.setdefault((x.a, x.b), []).append((x.o_net, x.o_net + 2 ** (32 - x.o_len) - 1))
    import ipaddress

    for a, b in ranges:
        want = [(int(n.network_address), int(n.broadcast_address)) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(a), ipaddress.IPv4Address(b))] if a <= b else []
        assert sorted(got.get((a, b), [])) == want
