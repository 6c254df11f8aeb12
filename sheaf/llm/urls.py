"""URL filters: allow and block rules, and beyond them trust and distrust carried over the host graph.

A url's host stands after its first `://`, up to `/`, `?`, `#` or the end, with A-Z lower-cased; its path runs
on to `?`, `#` or the end. A rule has a host, which fits its subdomains too, and a path that the url's path
must start with; the longest rule that fits decides.

Where no rule fits, the host does. Hosts link to the hosts of the links in their pages that name one (`scheme://` or
`//`), and a host to the nearest host above it by name (m.a.example to a.example), which stands for the links within a site that
relative links make. Trust is personalised PageRank from the hosts of allowed pages along the edges; distrust
is PageRank from the hosts of blocked pages against them, as who links to a bad host is suspect. Both are
carried in units of one decided page, so what a host gets neither shrinks as the table grows nor depends on hosts that it
has no path to, and until no host's score changes any more. A host with more distrust than `bias` times its trust, and
distrust of at least `least` pages, is blocked; a tie allows.

Null urls and urls without `://` have an empty host and path, no rule, and are allowed. Null html has no links.
Repeated rows keep a row each. Seeds count each host once for each of its pages that a rule decides. A very long page is
read whole, in its row, for its links. Among equally long rules the first in the list decides.
An empty table gives an empty report. Columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: tuple) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. Among equally long ones the first in the list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links that name a host, counted, and a link to the nearest host above by name."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("url"))
    linked = linked.withColumn("url", F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url")))
    links = linked.select("src", host_of(F.col("url")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    hosts = pages.where("host <> ''").groupBy("host").count().select("host")
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("n", "up")).where("up <> ''")
    near = above.join(hosts.select(F.col("host").alias("up")), "up").groupBy("host").agg(F.min_by("up", "n").alias("dst"))
    return links.unionByName(near.select(F.col("host").alias("src"), "dst", F.lit(1).cast("long").alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6, least: float = 1e-6) -> DataFrame:
    """(host, score): seeds (host, seed) jump back with 1 - damping; what a host without edges holds is dropped.

    Without a number of rounds it goes on until no host's score changes by more than `tolerance` of itself and `least`.
    A round is a join and a sum over hosts; every fourth is written to the checkpoint folder and compared with the
    round before.
    """
    if rounds is None and not 0 <= damping < 1:
        raise ValueError("without a number of rounds, damping must be below 1")
    out = edges.groupBy("src").agg(F.sum("weight").alias("_all"))
    steps = checkpoint(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")))
    exact = lambda x: x.cast("decimal(38,18)")  # noqa: E731  the order of summands makes no difference
    none = exact(F.lit(0))
    base = seeds.select("host", exact((1 - damping) * F.col("seed")).alias("score"), none.alias("was"))
    scores = seeds.select("host", F.col("seed").cast("double").alias("score"))
    done = 0
    while done != rounds:
        moved = steps.join(scores.select(F.col("host").alias("src"), "score"), "src").select(F.col("dst").alias("host"), exact(damping * F.col("share") * F.col("score")).alias("score"), none.alias("was"))
        before = scores.select("host", none.alias("score"), exact(F.col("score")).alias("was"))
        scores = moved.union(base).union(before).groupBy("host").agg(F.sum("score").cast("double").alias("score"), F.sum("was").cast("double").alias("was"))
        done += 1
        if done % 4 == 0:
            scores = checkpoint(scores)
            change = F.abs(F.col("score") - F.col("was")) / (F.greatest("score", "was") + least)
            if rounds is None and (scores.agg(F.max(change)).first()[0] or 0.0) <= tolerance:
                break
    return scores.select("host", "score")


def url_report(pages: DataFrame, rules: tuple = RULES, damping: float = 0.85, rounds: int | None = None, bias: float = 1.0, least: float = 1e-6) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, and its host's trust and distrust, in pages."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = read.withColumn("_d", decided(F.col("host"), F.col("path"), rules))
    edges = checkpoint(host_edges(read))
    votes = checkpoint(ruled.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("_d.verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("_d.verdict") == "block", 1)).alias("bad")))
    scored = votes.select("host")
    for name, of, graph in (("trust", "good", edges), ("distrust", "bad", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))):
        seeds = votes.where(F.col(of) > 0).select("host", F.col(of).cast("double").alias("seed"))
        scored = scored.join(pagerank(graph, seeds, damping, rounds, least=least).withColumnRenamed("score", f"_{name}"), "host", "left")
    pages_of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = scored.select(F.col("host").alias("_host"), pages_of("_trust").alias("trust"), pages_of("_distrust").alias("distrust"))
    spread = F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int")  # a host may hold a third of all pages
    salted = scored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = ruled.drop("html").withColumn("_s", spread).join(salted, (F.col("host") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    bad = (F.col("distrust") >= least) & (F.col("distrust") > bias * F.col("trust"))
    verdict = F.coalesce(F.col("_d.verdict"), F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("_d.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
