"""URL filter: host and path rules, and for other urls a verdict from trust and distrust that spread over links between hosts.

Trust is a personalised PageRank from trusted hosts along links; distrust the same from blocked hosts along reversed
links (who links to bad hosts is suspect). A host is a seed if over half of its pages fall under allow (block) rules.
A host whose distrust exceeds its trust by more than `margin` of the mean mass of a host is blocked. DataFrame functions only;
what iterates has a row a host, and links are counted per pair of hosts before any shuffle.

Nulls and urls without `://`: host and path are empty, and no rule fits; the empty host takes no part in the graph, and its
verdict is allow. Null or empty html has no links. Repeated rows count each in the seeds' shares; repeated links add to a
link's weight. An empty table gives no row. Html of any length is read whole. Of rules of one length the last in order fits; a
host on the threshold is allowed. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: (host, path, verdict) of each rule.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s<>]*)"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None)
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    linked = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), link.alias("link"))
    dst = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))[0]
    return linked.select("src", dst.alias("dst")).filter("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(scratch: shared.Scratch, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, change: float = 1e-3) -> DataFrame:
    """(kind, host, mass): one walk for each kind of (kind, src, dst, n), restarting at (kind, host, share); each kind's mass sums to 1.

    A walker at a host without links out restarts too. Rounds end when masses move by less than `change` in all, which they
    do: each round shrinks the difference by the damping at least."""
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = scratch.save(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("p")))
    seeds = scratch.save(seeds)
    mass = scratch.save(seeds.select("kind", "host", F.col("share").alias("mass")))
    while True:
        moved = mass.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("p") * damping).alias("mass"))
        walked = moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        back = walked.groupBy("kind").agg(F.sum("mass").alias("kept"))
        again = seeds.join(F.broadcast(back), "kind", "left").select("kind", "host", (F.col("share") * (1 - F.coalesce(F.col("kept"), F.lit(0.0)))).alias("mass"))
        new = walked.unionByName(again).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        new = scratch.save(new)
        delta = new.unionByName(mass.withColumn("mass", -F.col("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
        scratch.drop(mass)
        mass = new
        if (delta or 0.0) < change:
            return mass


def judge(spark: SparkSession, pages: DataFrame, rules: tuple = RULES, margin: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    scratch = shared.Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    hosts = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), *[F.sum((F.coalesce(F.col("fit.verdict"), F.lit("")) == v).cast("long")).alias(v) for v in ("allow", "block")])
    hosts = scratch.save(hosts)
    seeds = [hosts.filter(F.col(v) * 2 > F.col("n")).select(F.lit(k).alias("kind"), "host") for k, v in ((0, "allow"), (1, "block"))]
    seeds = seeds[0].unionByName(seeds[1])
    share = seeds.groupBy("kind").agg((1.0 / F.count("*")).alias("share"))
    links = scratch.save(host_edges(parsed))
    edges = links.select(F.lit(0).alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    mass = propagate(scratch, edges, seeds.join(F.broadcast(share), "kind"))
    n_hosts = max(1, hosts.count())
    scored = mass.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("mass")).otherwise(0.0)).alias(c) for k, c in ((0, "trust"), (1, "distrust"))])
    bad = scored.select("host", "trust", "distrust", ((F.col("distrust") - F.col("trust")) * n_hosts > margin).alias("bad"))
    verdict = F.when(F.coalesce(F.col("bad"), F.lit(False)), "block").otherwise("allow")
    return ruled.drop("html").join(bad, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), verdict).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(spark, pages)
