"""Queries over every row against counts and brute force that know of no sample."""

from prefixloom.plans import catalog, more
from prefixloom.plans.views import Relations

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def test_every_route_gets_a_row(spark):
    r = Relations(spark, DATA)
    pks = sorted(x.pk for x in r("v_routes").select("pk").collect())
    for name in ("set_members_ipv4_only", "fn_route_key", "fn_pk", "fn_ip_bits", "fn_rs_member"):
        assert sorted(x.pk for x in rows(spark, name)) == pks, name
    assert more._files(r, True).count() == len(pks)


def test_covering_authorisations_of_every_route(spark):
    r = Relations(spark, DATA)
    routes, roas = r("v_routes").collect(), r("v_roas").collect()
    over = {(x.pk, a.roa): a.asn != 0 and a.asn == x.asn and x.plen <= a.max_length for x in routes for a in roas if a.ip_first <= x.ip_first and a.ip_last >= x.ip_last}
    assert sorted((x.pk, x.roa) for x in rows(spark, "roa_covering")) == sorted(over)
    assert sorted(x.pk for x in rows(spark, "change_rpki_scope")) == sorted({p for p, _ in over} - {p for (p, _), ok in over.items() if ok})


def test_parent_of_every_route(spark):
    r = Relations(spark, DATA)
    routes, nums, want = r("v_routes").collect(), r("v_inetnum").collect(), {}
    for x in routes:
        found = [(int((i.ip_first, i.ip_last) != (x.ip_first, x.ip_last)), i.ip_last - i.ip_first, i.pk) for i in nums if i.source == x.source and i.ip_first <= x.ip_first and i.ip_last >= x.ip_last]
        found += [(2, o.ip_last - o.ip_first, f"R{o.pk}") for o in routes if o.source == x.source and o.plen < x.plen and o.ip_first <= x.ip_first and o.ip_last >= x.ip_last]
        if found:
            want[x.pk] = (min(found)[0], min(found)[2])
    assert {x.pk: (x.kind, x.parent) for x in rows(spark, "route_parent")} == want


def test_mail_of_every_route_and_request(spark):
    r = Relations(spark, DATA)
    by, mntners, people = r("v_mnt_by").collect(), {m.rpsl_pk: m for m in r("v_mntner").collect()}, {p.rpsl_pk: p.email for p in r("v_person").collect()}
    held = [(b.pk, mntners[b.mntner]) for b in by if b.mntner in mntners]
    mail = {(pk, m.mnt_nfy) for pk, m in held} | {(pk, people[m.admin_c]) for pk, m in held if m.admin_c in people}
    assert sorted((x.pk, x.email) for x in rows(spark, "rpki_contacts")) == sorted(mail)
    of = {}
    for pk, email in mail:
        of.setdefault(email, set()).add(pk)
    source = {x.pk: x.source for x in r("v_routes").select("pk", "source").collect()}
    assert {x.email: (x.objects, x.sources) for x in rows(spark, "contact_rollup")} == {e: (len(p), " ".join(sorted({source[k] for k in p}))) for e, p in of.items()}
    asked = {x.req for x in r("v_requests").select("req").collect()}
    told = {}
    for pk, m in held:
        if pk in asked:
            told.setdefault(m.mnt_nfy, set()).add(pk)
    assert {x.mnt_nfy: x.n for x in rows(spark, "notify_targets")} == {k: len(v) for k, v in told.items()}


def test_members_of_every_set(spark):
    r = Relations(spark, DATA)
    members, by_asn, want = r("v_member_of").collect(), {}, set()
    for x in r("v_routes").filter("source = 'SRC0'").collect():
        by_asn.setdefault(x.asn, []).append(x.pk)
    for m in members:
        want |= {(m.set_pk, f"R{pk}") for pk in by_asn.get(64512 + m.pk % 50, [])} if m.pk % 2 else {(m.set_pk, f"R{m.pk}^+")}
    got = [(x.set_pk, x.member) for x in rows(spark, "route_set_members")]
    assert sorted(got) == sorted(want) and len({s for s, _ in got}) > 2
