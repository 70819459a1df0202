"""URL filter: allow and block rules, and link-graph trust for the hosts that no rule names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and a path prefix; written like ``net/es/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as text; null if none does."""
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        own = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        fits = F.when(own, F.lit(rule.text)).otherwise(fits)
    return fits


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted over all pages.

    ``pages`` has a host column. Absolute and protocol-relative addresses in href and src count.
    """
    link = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""
    targets = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(link), 1)).alias("dst"))
    targets = targets.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src != '' and dst != '' and src != dst")
    return targets.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 15) -> DataFrame:
    """(kind, host, score): PageRank walks from ``seeds`` (kind, host, mass) over ``edges`` (kind, src, dst, weight).

    Each kind's seed masses add up to 1. A walk ends at a host without edges. Ranks are staged
    every round, so that the plan stays small, a lost executor repeats little, and the edges of a hub host
    can be split over tasks.
    """
    out = stage(edges.groupBy("kind", "src").agg(F.sum("weight").alias("out")))
    step = stage(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out") * damping).alias("share")))
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"))
    ranks = seeds.select("kind", "host", F.col("mass").alias("score"))
    if step.limit(1).count() == 0:
        return start
    for _ in range(rounds):
        moved = ranks.withColumnRenamed("host", "src").join(step, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
        ranks = stage(start.union(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")))
    return ranks


def judge_urls(pages: DataFrame, rules: list[Rule], *, ratio: float = 1.0, damping: float = 0.85, rounds: int = 15, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, trust, distrust).

    The longest fitting rule decides. For other pages the host does: trust is a personalised PageRank
    from the hosts of allowed pages over host links, distrust the same from the hosts of blocked
    pages over reversed links (who links to a blocked host is suspect). A host whose distrust exceeds
    ``ratio`` times its trust is blocked; a host that neither reaches is allowed.

    A null url, or one without ``://``, has an empty host and path: no rule fits, no link starts
    there, it is allowed. Of fitting rules as long as each other the last in the list decides. Null html has no links, very long html just more of them; repeated rows are each returned; an empty table gives no
    rows; other columns are ignored. The text is read twice and never shuffled: links are
    summed by host pair in each task, and pages meet their host's scores as narrow rows.
    """
    with_host = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else None
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = with_host.drop("html").withColumn("rule", rule).withColumn("own", verdicts[F.col("rule")] if rules else F.lit(None).cast("string"))
    hosts = ruled.where("own is not null and host != ''").groupBy("host", "own").agg(F.count("*").alias("pages"))
    hosts = stage(hosts.select(F.when(F.col("own") == "allow", "trust").otherwise("distrust").alias("kind"), "host", F.col("pages").cast("double").alias("pages")))
    total = hosts.groupBy("kind").agg(F.sum("pages").alias("total"))  # two rows at most
    seeds = hosts.join(F.broadcast(total), "kind").select("kind", "host", (F.col("pages") / F.col("total")).alias("mass"))
    forward = stage(host_edges(with_host))
    edges = forward.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(forward.select(F.lit("distrust"), "dst", "src", "weight"))
    ranks = personalised_rank(edges, seeds, damping=damping, rounds=rounds)
    scores = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    judged = ruled.join(stage(scores), "host", "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > trust * ratio, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
