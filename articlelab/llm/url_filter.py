"""URL filters: fixed rules, and for what they leave open link-graph propagation
(native).

Hosts are nodes, links between pages of two hosts are edges. Trust is a
personalised PageRank that restarts at hosts with allowed pages and follows
links; distrust restarts at hosts with blocked pages and follows links
backwards, since who links to a bad host is suspect, not who is linked from one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelab.llm.common import materialize, small_lookup

#: Fixed values of the contract: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Share of a score that follows links, and rounds of propagation.
DAMPING, ROUNDS = 0.85, 20
#: Least distrust at which a host is blocked: what it has by itself if half of its pages are.
LEAST_DISTRUST = 0.5 * (1 - DAMPING)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The place of a link in a page: an attribute that loads or leads to another
#: page, its value with a host of its own (links without one stay on their host).
LINK = r"""(?i)\b(?:href|src|action)\s{0,9}=\s{0,9}["']?\s{0,9}(?:[a-z][a-z0-9+.-]{0,20}:)?//([^/?#"'<>\s]{1,255})"""


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule fits
    its host and all subdomains, if the path starts with the rule's."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    found = None
    for verdict, name, start in longest_first:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, pages``: pages of one host that link to another host.
    ``pages``: host, html."""
    # a page without `//` has no such link: the pattern need not look for one
    found = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    targets = F.array_distinct(F.transform(found, _lower))
    links = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    return links.filter((F.col("dst") != F.col("src")) & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def flows(edges: DataFrame) -> DataFrame:
    """``kind, source, target, share``: how a host's trust is dealt over the hosts
    it links to, and its distrust over the hosts that link to it."""
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), "pages").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("source"), F.col("src").alias("target"), "pages"))
    total = both.groupBy("kind", "source").agg(F.sum("pages").alias("total"))
    return small_lookup(both, total, ["kind", "source"]).select(
        "kind", "source", "target", (F.col("pages") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = ROUNDS) -> DataFrame:
    """``kind, host, score`` after ``steps`` rounds of
    score = (1 - damping) * seed + damping * (what flows in), from
    (1 - damping) * seed. ``seeds``: kind, host, seed. Each round is a join of
    the host scores (broadcast where measured small, else salted) with the
    flows and one aggregation, written to the shared folder."""
    restart = materialize(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score")), "url-seeds")
    streams = materialize(flows(edges), "url-flows")
    if streams.isEmpty():
        return restart
    score = restart
    for _ in range(steps):
        moved = small_lookup(streams, score.select("kind", F.col("host").alias("source"), "score"), ["kind", "source"], salt_by=F.col("target"))
        moved = moved.filter(F.col("score").isNotNull()).select(
            "kind", F.col("target").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
        score = materialize(restart.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-scores")
    return score


def host_verdicts(pages: DataFrame, damping: float = DAMPING, steps: int = ROUNDS, least: float = LEAST_DISTRUST) -> DataFrame:
    """``host, trust, distrust, verdict`` of every host with a seed or a link to one.
    ``pages``: host, html, verdict (of its rule, else null). A host's seed is the
    share of its pages that a rule allows (trust) or blocks (distrust); it is
    blocked if its distrust is ``least`` or more and above its trust."""
    hosts = pages.filter(F.col("host") != "").groupBy("host").agg(
        F.avg((F.coalesce(F.col("verdict"), F.lit("")) == "allow").cast("double")).alias("allow"),
        F.avg((F.coalesce(F.col("verdict"), F.lit("")) == "block").cast("double")).alias("block"))
    pairs = F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")),
                    F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed")))
    seeds = hosts.select("host", F.explode(pairs).alias("s")).select("s.kind", "host", "s.seed").filter(F.col("seed") > 0)
    score = propagate(seeds, host_edges(pages), damping, steps)
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    out = score.groupBy("host").agg(side("trust").alias("trust"), side("distrust").alias("distrust"))
    blocked = (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))
    return out.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
                damping: float = DAMPING, steps: int = ROUNDS, least: float = LEAST_DISTRUST) -> DataFrame:
    """Every row of ``pages`` with its verdict: ``<id>, host, path, rule, verdict,
    trust, distrust``.

    The longest rule that fits decides; ``rule`` is null where none does, and then
    the host's scores decide (see :func:`host_verdicts`). A page without a host
    (null, empty or no `://`) is in no graph and allowed, as is one of a host that
    no link joins to a seed (scores 0). Null html has no links. Repeated rows and
    ids, null ids and clashing extra columns are fine: only the three named columns
    are read. An empty table gives an empty result.

    Links are read once, counted per host pair with partial sums; from then on
    work is by host, not by page."""
    host, path = url_parts(F.col(url_col).cast("string"))
    named = pages.select(F.col(id_col).alias("_page"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    judged = named.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    by_host = host_verdicts(judged.select("host", "html", F.col("_rule.verdict").alias("verdict")), damping, steps, least)
    by_host = materialize(by_host.withColumnRenamed("verdict", "_by_host"), "url-hosts")
    out = small_lookup(judged.drop("html"), by_host, ["host"], salt_by=F.col("path"))
    return out.select(F.col("_page").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
                      F.coalesce(F.col("_rule.verdict"), F.col("_by_host"), F.lit("allow")).alias("verdict"),
                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
