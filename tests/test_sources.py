"""Files, JSON texts, mirroring streams, and the change log as a stream."""

import datetime as dt

from prefixloom.sources import registry
from prefixloom.streaming import journal
from pyspark.sql import functions as F

DUMP = "# head\nroute: 192.0.2.0/24\n% note\ndescr: one\n  two\norigin: AS1\n\n\n\n%only\n\nmntner: A\n#x\nsource: T\n"


def test_paragraphs_and_attributes(spark, tmp_path):
    (tmp_path / "a.db").write_text(DUMP)
    (tmp_path / "b.db").write_text("")
    got = sorted(r.text for r in registry.read_paragraphs(spark, str(tmp_path)).collect())
    assert got == ["mntner: A\nsource: T\n", "route: 192.0.2.0/24\ndescr: one\n  two\norigin: AS1\n"]
    kept = spark.createDataFrame([(DUMP.replace("\n", "\r\n"),)], "t string").select(registry.paragraphs_of(F.col("t"), False).alias("p")).first().p
    assert kept == ["route: 192.0.2.0/24\n% note\ndescr: one\n  two\norigin: AS1\n", "%only\n", "mntner: A\nsource: T\n"]
    row = spark.createDataFrame([(got[1] + "bad line\n",)], "t string").select(registry.attributes_of(F.col("t")).alias("a")).first().a
    assert [(x.name, x.value) for x in row] == [("route", "192.0.2.0/24"), ("descr", "one\ntwo"), ("origin", "AS1"), (None, "bad line")]


def test_roas_and_slurm(spark, tmp_path):
    (tmp_path / "roas.json").write_text('{"roas":[{"asn":64496,"prefix":"192.0.2.0/25","maxLength":26,"ta":"x"},\n{"asn":"AS64497","prefix":"2001:db8:1::/48","maxLength":48,"ta":"x"},{"asn":"64498","prefix":"198.51.100.0/24","maxLength":24,"ta":"x"},{"asn":64499,"prefix":"203.0.113.0/24","maxLength":24,"ta":"x"}]}')
    roas = registry.read_roas(spark, str(tmp_path / "roas.json"))
    assert sorted(r.asn for r in roas.collect()) == [64496, 64497, 64498, 64499]
    slurm = '{"slurmVersion":1,"validationOutputFilters":{"prefixFilters":[{"prefix":"192.0.2.0/24"},{"asn":64498},{"prefix":"2001:db8::/32","asn":64497},{"prefix":"203.0.113.0/24","asn":1}]},"locallyAddedAssertions":{"prefixAssertions":[{"asn":64511,"prefix":"192.0.2.0/24"}]}}'
    found = registry.slurm_of(spark.createDataFrame([(slurm,)], "body string"))
    out = registry.apply_slurm(roas, *found)
    assert sorted((r.prefix, r.asn, r.max_length, r.trust_anchor) for r in out.collect()) == [("192.0.2.0/24", 64511, 24, "SLURM file"), ("203.0.113.0/24", 64499, 24, "x")]


def test_json_sequences(spark, tmp_path):
    (tmp_path / "x").write_text('\x1e{"v":1}\n\x1e{"v":2}\n')
    assert sorted(r.v for r in registry.read_jsonseq(spark, str(tmp_path / "x"), "v int").collect()) == [1, 2]


def test_mirroring_streams(spark):
    body = "%START Version: 3 TEST 11-14\n\nADD 11\n\nperson: a\nsource: T\n\nDEL 14\n\nroute: b\n\n%END TEST\n"
    good = registry.mirror_operations(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.source, r.serial, r.operation, r.text) for r in good] == [("TEST", 11, "ADD", "person: a\nsource: T\n"), ("TEST", 14, "DEL", "route: b\n")]
    old = body.replace("Version: 3", "Version: 1").replace("ADD 11", "ADD").replace("DEL 14", "DEL")
    bad = {
        None: old, "bad version": body.replace("Version: 3", "Version: 4"), "no end": body.replace("%END TEST", ""), "no start": body.replace("%START", "%BEGIN"), "more than one start": "%START Version: 3 TEST 1-2\n\n" + body,
        "serials out of order": body.replace("DEL 14", "DEL 10"), "too many operations": old.replace("11-14", "11-11"),
    }
    for want, b in bad.items():
        rows = registry.mirror_operations(spark.createDataFrame([(b,)], "body string")).collect()
        assert {r.problem for r in rows} == {want}
        if want is None:
            assert [r.serial for r in rows] == [11, 12]


def test_change_log_as_a_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "serial_global long, ts timestamp, source string, rpsl_pk string, operation string"
    rows = [(1, at, "A", "P1", "ADD"), (2, at, "A", "P2", "ADD"), (3, at + dt.timedelta(hours=1), "A", "P1", "DEL"), (4, at + dt.timedelta(hours=3), "B", "P1", "ADD")]
    path = str(tmp_path / "log")
    for k, df in (("live", lambda s: journal.live_state(s, ["source", "rpsl_pk"])), ("hours", journal.counts_by_window)):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
        q = df(journal.follow(spark, path, schema, after=1)).writeStream.format("memory").queryName(k).outputMode("update").option("checkpointLocation", str(tmp_path / k)).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert {(r.source, r.rpsl_pk, r.operation) for r in spark.table("live").collect()} == {("A", "P2", "ADD"), ("A", "P1", "DEL"), ("B", "P1", "ADD")}
    assert sorted((r.source, r.n) for r in spark.table("hours").collect()) == [("A", 1), ("A", 1), ("B", 1)]
