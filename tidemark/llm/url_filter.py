"""URL verdicts: path rules first, then trust and distrust propagated over the host graph.

Hosts are joined by the links of their pages: absolute and protocol-relative ``href`` values (relative ones stay on the host and say nothing
about others), and a link both ways between a host and the nearest parent domain that is a host itself. Personalised PageRank starts
at trusted seeds and follows links; distrust starts at blocked seeds and follows links backwards, so a host that points at blocked ones is
distrusted. A host is a blocked seed when rules block most of its pages, a trusted one when rules allow some of its pages and block none.
Pages without a rule are blocked where the host's distrust exceeds its trust by more than ``MARGIN`` times the even share; ranks that
differ by less than the share ``EQUAL`` are equal. Rounds go on until every host's rank is settled to the share ``SETTLED`` of itself,
so a host is reached however many links it is away from the seeds, and however small its part is.

Ranks live in DataFrames keyed by host; edges are counted per (from, to) before any exchange, so a host with a third of all pages is one
row per neighbour, and its contributions are summed in each task before they are exchanged. Both ranks take a round in one exchange, and
lineage is cut by files every few rounds.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; the longest rule (host and path
together) wins, equal lengths by the rule that sorts first; repeated pages count as often as they occur; pages without html give no links; without seeds of
a kind that rank is 0 everywhere; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import fold_ascii, stored, text_of
from tidemark.session import small_side

DAMPING = 0.85
#: Rounds go on until no host's rank grows by more than this share of itself.
SETTLED = 1e-10
#: Rounds that damping alone needs to settle all ranks together; single hosts far from the seeds may take more.
ROUNDS = math.ceil(math.log(SETTLED) / math.log(DAMPING))
CUT_EVERY = 8
#: What a walk hands on at least, so that a far host's rank can't vanish in a double.
LEAST = 1e-300
MARGIN = 0.0
#: Trust and distrust count as equal when they differ by less than this share, as ranks are settled no finer.
EQUAL = 1e-8
LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = fold_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda value: F.coalesce(*(F.when(fit, F.lit(value(rule))) for fit, rule in zip(fits, ordered, strict=True)), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def parsed(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target, n) between different hosts."""
    host, _ = host_and_path(F.col("url"))
    links = F.regexp_extract_all(text_of("html"), F.lit(LINK), 1)
    found = pages.select(host.alias("source"), F.explode(links).alias("link"))
    target, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return found.select("source", target.alias("target")).filter("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """Both ways between each host and its nearest parent domain among the hosts."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.struct(F.size(labels) - i, F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    wide = hosts.filter(F.size(labels) > 1).select("host", F.explode(parents).alias("p")).select("host", F.col("p.col1").alias("rest"), F.col("p.col2").alias("parent"))
    met = wide.join(hosts.select(F.col("host").alias("parent")), "parent")
    nearest = met.groupBy("host").agg(F.max(F.struct("rest", "parent")).alias("p")).select("host", F.col("p.parent").alias("parent"))
    up = nearest.select(F.col("host").alias("source"), F.col("parent").alias("target"), F.lit(1).cast("long").alias("n"))
    return up.unionByName(up.select(F.col("target").alias("source"), F.col("source").alias("target"), "n"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """host, trust and distrust; ``seeds`` has host, trusted and banned (0 or 1). Jumps and what hosts without links hold go to the seeds.

    Sums of damped walks from the seeds, each seed counting 1: y = seed + damping * flow(y). Personalised ranks are y over its
    total, as what goes back to the seeds only scales y. y grows from round to round, so no host loses what has reached it.
    """
    both = edges.select(F.lit("trust").alias("kind"), "source", "target", "n")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    out = both.groupBy("kind", "source").agg(F.sum("n").alias("out"))
    shares = stored(both.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("out")).alias("share")), "url-edges")
    shares = small_side(shares)
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("banned").alias("seed"))))
    starts = seeds.select("host", kinds.alias("k")).select("k.kind", "host", F.col("k.seed").cast("double").alias("rank")).filter("rank > 0")
    starts = stored(starts, "url-starts")
    begun, none = starts.withColumn("was", F.lit(0.0)), F.lit(0.0)
    walked = begun
    while True:
        for n in range(CUT_EVERY):
            # The least share keeps what walks have reached above 0, however far it is.
            flows = walked.join(shares, ["kind", "host"]).select("kind", F.col("target").alias("host"), F.greatest(F.col("rank") * F.col("share") * damping, F.lit(LEAST)).alias("rank"), none.alias("was"))
            parts = flows.unionByName(begun)
            if n == CUT_EVERY - 1:  # only here, as a second use of a round doubles the plan of all before it
                parts = parts.unionByName(walked.select("kind", "host", none.alias("rank"), F.col("rank").alias("was")))
            walked = parts.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was"))
        walked = stored(walked, "url-ranks")
        if walked.filter(F.col("rank") - F.col("was") > F.col("rank") * SETTLED).isEmpty():
            break
    totals = {r["kind"]: r["total"] for r in walked.groupBy("kind").agg(F.sum("rank").alias("total")).collect()}  # two rows
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0) / totals.get(kind, 1.0)).alias(kind)
    found = walked.groupBy("host").agg(of("trust"), of("distrust"))
    return seeds.select("host").join(found, "host", "left").fillna(0.0, ["trust", "distrust"])


def host_scores(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """host, trust and distrust of every host that has a page or is linked to."""
    rows = parsed(pages, rules).filter("host <> ''")
    counted = lambda verdict: F.sum(F.when(F.col("rule_verdict") == verdict, 1).otherwise(0))
    judged = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), counted("allow").alias("allowed"), counted("block").alias("blocked"))
    links = stored(host_edges(pages), "url-links")
    every = stored(judged.select("host").unionByName(links.select(F.col("target").alias("host"))).distinct(), "url-every")
    edges = stored(links.unionByName(parent_edges(every)).groupBy("source", "target").agg(F.sum("n").alias("n")), "url-graph")
    seeds = every.join(judged, "host", "left").select(
        "host",
        F.when((F.col("allowed") > 0) & (F.col("blocked") == 0), 1).otherwise(0).alias("trusted"),
        F.when(F.col("blocked") * 2 > F.col("pages"), 1).otherwise(0).alias("banned"),
    )
    seeds = stored(seeds, "url-seeds")
    return ranks(edges, seeds)


def verdicts(pages: DataFrame, rules: Sequence[Rule], margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    scores = stored(host_scores(pages, rules), "url-scores")
    hosts = max(1, scores.count())
    blocked = F.col("distrust") - F.col("trust") > F.greatest(F.lit(margin / hosts), F.col("distrust") * EQUAL)
    marked = scores.withColumn("by_method", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    whole = parsed(pages, rules).join(small_side(marked), "host", "left")
    verdict = F.coalesce("rule_verdict", "by_method", F.lit("allow"))
    return whole.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
