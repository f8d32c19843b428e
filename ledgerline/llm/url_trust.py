"""URL filtering by list rules and, where none fits, by trust carried along host links.

Hosts are nodes; a page's links to other hosts are edges, and (unless turned off) a host and the domain above it are joined both
ways. Personalised PageRank from trusted hosts follows the edges; distrust from blocked hosts follows them
backwards, to those who link there. Hosts with more distrust than trust are blocked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, shared_dir, staged, unboxed
from .components import ONE_TASK

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Hosts with more than one in so many of the pages (fewer than so many hosts) are joined without a shuffle.
MANY = 1000
LINKS = r"""(?i)\shref\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s<>]+)"""


#: Links from a host, or back to those that link to it, that are kept together; more are dealt over several tasks.
HUB = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text host + path (host + / without a path), and its verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + (r[2] or "/")))
    fits = [(((host == h) | host.endswith(f".{h}")) & path.startswith(p), h + (p or "/"), v) for v, h, p in ordered]
    return F.coalesce(*(F.when(f, F.lit(name)) for f, name, _ in fits)), F.coalesce(*(F.when(f, F.lit(v)) for f, _, v in fits))


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """(src, dst, w) between hosts, of boxed pages (host, html): w counts links, absolute ones and those that begin with //.

    With `parents`, a host and the domain above it count as one link each way.
    """
    url = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("url")).select("src", host_path(url)[0].alias("dst"))
    linked = linked.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    if not parents:
        return linked
    above = pages.select("host").where("size(split(host, '[.]')) > 2").distinct().withColumn("above", F.regexp_replace("host", r"^[^.]*\.", ""))
    ways = F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst")))
    both = above.select(F.explode(ways).alias("e")).select("e.*", F.lit(1.0).alias("w"))
    return linked.union(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, one_task: int = ONE_TASK, hub: int = HUB) -> DataFrame:
    """(kind, host, score): personalised PageRank over edges (kind, src, dst, w) from seeds (kind, host, mass).

    Each kind is a graph of its own; its masses sum to 1, and so do its scores. A round passes `damping` of what each
    host received in the last one along its edges and adds it to the scores. What hosts without edges would pass on
    returns to the seeds: that is the same as scaling what the rounds gave to a sum of 1, so it is done once, at the
    end. Rounds go on until what is still under way, and so any later change of all scores together, is at most
    `tolerance`; that is looked at with every checkpoint. A round aggregates partially before its only
    shuffle, so a host with very many links is spread over tasks. Up to `one_task` steps are kept in one partition; the
    rounds and their results are the same.
    """
    shared_dir(edges.sparkSession)
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"), F.ceil(F.count("*") / hub).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("dst"), F.col("chunks")).cast("int")
    moves = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), chunk.alias("chunk"), "dst", (damping * F.col("w") / F.col("all")).alias("share"))
    ends = edges.select("kind", F.explode(F.array("src", "dst")).alias("host")).union(seeds.select("kind", "host")).distinct()
    # a host's step to itself carries its score on; the others bring a share of what came to their source. Each knows the chunks of where it leads
    loops = ends.select("kind", "host", F.lit(0).alias("chunk"), F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))
    dealt = out.where("chunks > 1").select("kind", F.col("src").alias("dst"), "chunks")
    steps = staged(moves.unionByName(loops).join(dealt, ["kind", "dst"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).select("kind", "host", "chunk", "dst", "share", "chunks"), "steps")
    few = steps.count() <= one_task
    kept = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    steps = kept((steps if few else steps.repartition("kind", "host", "chunk")).checkpoint()).hint("merge")
    of = steps.where("share IS NULL").select("kind", "host", "chunks")
    rank = kept(seeds.groupBy("kind", "host").agg(F.sum("mass").alias("score")).withColumn("fresh", F.col("score")).join(of, ["kind", "host"]).checkpoint())
    whole = steps.where("chunks > 1").isEmpty()  # no host has more links than a chunk takes
    for i in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + 1):
        sent = rank.drop("chunks").withColumn("chunk", F.lit(0)) if whole else rank.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        moved = sent.join(steps, ["kind", "host", "chunk"]).where("fresh > 0 OR share IS NULL")
        moved = moved.select("kind", "dst", "chunks", F.when(F.col("share").isNull(), F.col("score")).otherwise(0.0).alias("score"), (F.col("fresh") * F.coalesce("share", F.lit(0.0))).alias("fresh"))
        rank = moved.groupBy("kind", "dst").agg((F.sum("score") + F.sum("fresh")).alias("score"), F.sum("fresh").alias("fresh"), F.max("chunks").alias("chunks")).withColumnRenamed("dst", "host")
        if i % 5 == 0:
            rank = kept(rank.checkpoint())
            if (rank.groupBy("kind").agg(F.sum("fresh").alias("f")).agg(F.max("f")).first()[0] or 0) <= tolerance * (1 - damping):
                break
    rank = rank.checkpoint()
    total = rank.groupBy("kind").agg(F.sum("score").alias("total"))  # a row for each kind
    return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))


def _seeds(hosts: DataFrame, kind: str, column: str) -> DataFrame:
    total = hosts.agg(F.sum(column)).first()[0] or 0
    return hosts.where(F.col(column) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(column) / F.lit(float(max(total, 1)))).alias("mass"))


def judged(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules=RULES, damping: float = 0.85, floor: float = 0.5, parents: bool = True) -> DataFrame:
    """pages with host, path, rule, trust, distrust and verdict (allow or block).

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with its path; the
    longest decides. Pages that none fits take their host's verdict: block if the host's distrust is larger than
    its trust and than `floor` times the mean over hosts. Seeds are the hosts of pages that allow or block rules
    fit, weighted by how many they fit. Null urls, and those without ://, have an empty host and path, no rule, and are
    allowed. `parents` as in host_edges(). Columns of these names are replaced, all others pass through.
    """
    cols = pages.columns
    box = boxed(pages, url=url_col, html=html_col)
    host, path = host_path(F.col("url"))
    box = box.select("row", "html", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    box = box.withColumns({"rule": rule, "said": said})
    hosts = staged(box.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")), "hosts")
    # trust follows the links, distrust goes from a host to those that link to it
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), "src", "dst"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = staged(host_edges(box, parents).select(F.explode(kinds).alias("e"), "w").select("e.*", "w"), "links")
    seeds = _seeds(hosts, "trust", "allowed").union(_seeds(hosts, "distrust", "blocked"))
    scores = propagate(edges, seeds, damping).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    n_pages, n_hosts = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0)), F.count("*")).first()
    scores = staged(hosts.select("host", F.col("pages") > n_pages / MANY).join(scores, "host", "left").na.fill(0.0).toDF("host", "many", "trust", "distrust"), "scores")
    # fewer than MANY hosts have more than so great a share of the pages: these are sent to the tasks, all others are joined by shuffle
    box = box.drop("html").join(F.broadcast(scores.where("many").select("host", F.struct("trust", "distrust").alias("big"))), "host", "left")
    rest = box.where("big IS NULL").drop("big").join(scores.where("NOT many").drop("many"), "host", "left")
    out = box.where("big IS NOT NULL").select("*", "big.*").drop("big").unionByName(rest)
    verdict = F.coalesce("said", F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") * n_hosts > floor), "block").otherwise("allow"))
    return unboxed(out, cols, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), trust=F.coalesce("trust", F.lit(0.0)), distrust=F.coalesce("distrust", F.lit(0.0)), verdict=verdict)
