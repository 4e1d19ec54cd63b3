"""Attribute values, submissions and mirroring decisions on small frames, nulls and empty texts included."""

from prefixloom.functions import fields, text
from prefixloom.operators import mirror, submissions
from pyspark.sql import functions as F


def values(spark, texts, build):
    return [r.v for r in spark.createDataFrame([(t,) for t in texts], "s string").select(build(F.col("s")).alias("v")).collect()]


def test_members_and_blocks(spark):
    got = values(spark, ["192.0.2.0/24^-", "192.0.2.0/24^23", "192.0.2.0/24^26-25", "192.0.2.1/24", "AS-x:rs-y", "as7^+", "192.0.2.0^", "", None], fields.route_set_member)
    assert got == ["192.0.2.0/24^-", None, None, None, "AS-X:RS-Y", "AS7^+", None, None, None]
    assert values(spark, ["AS1-AS3", "AS3 - AS1", "AS1", "", None], lambda s: fields.as_block(s)[1]) == [3, None, None, None, None]


def test_a_member_is_read_once(spark):
    texts = ["1.2.3.4", "1.2.3.256/32", " 10.0.0.0/8^8-9", "10.0.0.0/8^9-8", "10.0.0.0/33", "10.0.0.0/x", "AS1.65536", "AS4294967296", "as0.7^1", "rs-a^999", "\t1.2.3.0/24"]
    assert values(spark, texts, fields.route_set_member) == ["1.2.3.4/32", None, "10.0.0.0/8^8-9", None, None, None, None, None, "AS7^1", "RS-A^999", "1.2.3.0/24"]
    df = spark.createDataFrame([("x",)], "s string").select(fields.route_set_member(F.col("s")).alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("split(") <= 4 and plan.count("rlike") < 12


def test_placeholders(spark):
    build = lambda s: fields.with_placeholders(s, F.lit("K"), {"a": "x%s"}, "r")
    assert values(spark, ["a: 1\nab: 2\n", "b: 1\n", "", None], build) == ["a:              xK\nab: 2\nremarks:        r\n", "b: 1\n", "", None]


def test_submission(spark):
    found = values(spark, ["override: o\na: 1\ndelete: d:e\n\n\n\nb: 2\n", "", None], fields.submitted)
    assert [(b.text, b.delete_reason, b.suspension, [m.name for m in b.meta]) for b in found[0]] == [("a: 1\n", "d:e", None, ["override", "delete"]), ("b: 2\n", None, None, [])]
    assert not found[1] and found[2] is None


def test_operations_and_versions(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "pk string, body string")
    ops = spark.createDataFrame([("a", 1, "ADD", "9"), ("b", 2, "DEL", None), ("c", 3, "ADD", "x"), ("c", 4, "DEL", None), ("c", 5, "ADD", "y")], "pk string, serial long, operation string, body string")
    assert sorted((r.pk, r.body) for r in mirror.apply_operations(old, ops, ["pk"]).collect()) == [("a", "9"), ("c", "y")]
    assert mirror.apply_operations(old.limit(0), ops.limit(0), ["pk"]).count() == 0
    status = spark.createDataFrame([("new", None, None, False), ("moved", "s", 3, False), ("next", "t", 3, False), ("gap", "t", 1, False), ("ahead", "t", 9, False), ("forced", "t", 3, True)], "source string, session_id string, version long, force_reload boolean")
    notices = status.select("source", F.lit("t").alias("n_session"), F.lit(5).cast("long").alias("n_version"), F.lit(4).cast("long").alias("min_delta"))
    got = {r.source: (r.action, r.version) for r in mirror.next_versions(status, notices).collect()}
    assert got == {"new": ("snapshot", None), "moved": ("snapshot", None), "next": ("delta", 4), "gap": ("snapshot", None), "ahead": ("error", None), "forced": ("snapshot", None)}


def test_lines_names_and_mail(spark):
    df = spark.createDataFrame([("\na\r\n\nb\u2028c\n\n",), ("\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.lines(F.col("t"))).collect()] == [["a", "", "b\u2028c"], [""], [], []]
    names = spark.createDataFrame([("rs_any",), ("RS-ANY",), ("good-name",)], "t string")
    assert [r[0] for r in names.select(text.generic_name_ok(F.col("t"))).collect()] == [False, False, True]
    mail = spark.createDataFrame([("a@[192.0.2.1]",), ("a@[2001:db8::1]",), ("a@localhost",), ("a b@example.net",), ("a@exa mple",), ("a@",)], "t string")
    assert [r[0] for r in mail.select(text.email_ok(F.col("t"))).collect()] == [True, True, True, False, False, False]


def test_rendering_and_differences(spark):
    got = spark.range(1).select(
        text.render_lines(F.array(F.struct(F.lit("descr").alias("name"), F.lit("one\n\ntwo").alias("value")), F.struct(F.lit("remarks").alias("name"), F.lit("").alias("value")))).alias("body"),
        text.unified_diff(F.lit("a\nb"), F.lit("a\nc")).alias("diff"),
        text.unified_diff(F.lit(None).cast("string"), F.lit("a")).alias("none"),
    ).first()
    assert got.body == "descr:          one\n+               \n" + " " * 16 + "two\nremarks:\n"
    assert (got.diff, got.none) == ("@@ -1,2 +1,2 @@\n a\n-b\n+c", None)


def test_suspensions_and_wide_queries(spark):
    rows = spark.createDataFrame([("suspend", "mntner", True), ("SUSPEND", "person", True), ("stop", "mntner", True), ("reactivate", "mntner", None), (None, None, None)], "k string, c string, e boolean")
    assert [r[0] for r in rows.select(submissions.suspension_status(F.col("k"), F.col("c"), F.col("e"))).collect()] == ["processing", "error: parsing", "error: parsing", "error: non-authoritative source", "error: parsing"]
    asked = spark.createDataFrame([(["sources"], None), (["sources", "asn"], None), (["rpki_status"], ["valid"]), (["rpki_status"], ["valid", "invalid"])], "f array<string>, s array<string>")
    assert [r[0] for r in asked.select(submissions.specific_enough(F.col("f"), F.col("s"))).collect()] == [False, True, True, False]
