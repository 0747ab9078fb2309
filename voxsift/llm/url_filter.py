"""URL filters: rules on host and path, and trust passed along the links between hosts.

Where no rule speaks, a personalised PageRank from trusted hosts is held against distrust, which runs against the links
from blocked hosts: who links to a blocked host is suspect. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voxsift.staging import stage

#: A link to another host in a page: its scheme and host.
LINK = r"""(?i)href\s{0,9}=\s{0,9}["']?[a-z][a-z0-9+.-]{0,19}://([^/?#"'\s<>]+)"""
DAMPING = 0.85
ROUNDS = 8
#: Rounds after which the scores are written, so that lineage stays short.
WRITE_EVERY = 4
#: A host is a seed if more than this share of its pages is allowed, or blocked, by a rule.
SEED_SHARE = 0.5
#: A host is blocked if distrust makes up more than this share of what reaches it.
THRESHOLD = 0.5

Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``rule, verdict`` of the longest rule that fits; null if none does. A rule fits its host and all subdomains."""
    fitting = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fitting = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``src, dst, n``: links from host to host, and between a host and the host it is a subdomain of, once each way.

    Links are counted in the task that reads the page, so a hot host sends few rows.
    """
    links = F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))
    links = F.when(F.col(html).contains("://"), links).otherwise(F.array().cast("array<string>"))
    rows = pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("dst"))
    linked = rows.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    linked = stage(linked, "links")
    hosts = pages.select(host_of(F.col(url)).alias("h")).union(linked.select("dst")).where("h != ''").distinct()
    hosts = stage(hosts, "hosts")
    parent = hosts.select("h", F.regexp_replace("h", r"^[^.]*\.", "").alias("p")).where("h != p")
    family = parent.join(hosts.select(F.col("h").alias("p")), "p")
    both = family.select(F.col("h").alias("src"), F.col("p").alias("dst")).union(family.select("p", "h"))
    return linked.union(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread_scores(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, host, score``: personalised PageRank over ``kind, src, dst, n`` from ``kind, host, weight``.

    Both kinds run at once. A host passes its score on in proportion to its links; seeds get the rest in every round. What
    a host without links holds is not passed on. Scores are summed by target where the edges are.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    steps = stage(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")), "steps")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = stage(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("all")).alias("score")), "seeds")
    score = start
    for turn in range(1, rounds + 1):
        moved = steps.join(score.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score"))
        score = moved.union(start.select("kind", "host", F.col("score") * (1 - DAMPING))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if turn % WRITE_EVERY == 0 or turn == rounds:
            score = stage(score, "trust")
    return score


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html", trusted: Sequence[str] = (), blocked: Sequence[str] = ()) -> DataFrame:
    """``key, host, path, rule, verdict, trust, distrust`` for every row.

    The longest rule that fits decides; else a host is blocked if distrust outweighs trust, and allowed if neither
    reaches it. Hosts with more than half of their pages under an allowing (blocking) rule are seeds of trust (distrust),
    as are the hosts given. A null url, or one without ``://``, has an empty host, which is no host of the graph: allowed
    unless a rule fits. Null html has no links. Each row is judged by its url, so repeated rows agree.
    """
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = stage(rows.select(key, "host", "path", "_rule.*"), "urls")
    edges = stage(host_edges(pages, url, html), "edges")
    share = {v: F.avg(F.coalesce((F.col("verdict") == v).cast("double"), F.lit(0.0))) for v in ("allow", "block")}
    sites = stage(rows.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), share["allow"].alias("allow"), share["block"].alias("block")), "sites")
    given = {"trust": list(trusted), "distrust": list(blocked)}
    seeds = [
        sites.where((F.col(verdict) > SEED_SHARE) | F.col("host").isin(given[kind])).select(F.lit(kind).alias("kind"), "host", F.log1p("n").alias("weight"))
        for kind, verdict in (("trust", "allow"), ("distrust", "block"))
    ]
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    score = spread_scores(both, seeds[0].union(seeds[1]))
    sums = score.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    known = sites.select("host").join(sums, "host")
    judged = rows.join(known, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > THRESHOLD * (trust + distrust), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(key, "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
