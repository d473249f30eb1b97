"""URL filters: rules by host and path, and for the rest link-graph propagation, in DataFrame operations only.

Rules (longest first) judge the urls they fit. For the others the host's standing decides. Host edges are the links
of the pages to other hosts, and for every subdomain one edge each way with its parent domain, up to the registered domain (two labels,
three where the last but one is a public one such as ``co`` before a country's), whether pages of the parent are known or not.
Trust is personalised PageRank from the hosts whose pages the rules allow; distrust is the same from hosts whose
pages they block, along reversed edges (who links to bad hosts is bad). Both start from the share of a host's pages that
the rules judge so, both are propagated at the same time over one table of (kind, host), each round one join and one
map-side combined sum, written to the shared folder, until a round moves less than ``TOLERANCE`` of all mass (each round moves at
most ``DAMPING`` of what the round before it moved). A host is blocked if its distrust exceeds ``threshold`` times the
mean seed and its trust; pages of hosts that the propagation does not reach are allowed.

Defined cases: a null url, or one without ``://``, has empty host and path and is allowed; a null html has no links;
links to a page's own host do not count, equal links of one host pair count once for each page; repeated rows are each
judged; hosts of any number of pages are summed map-side first; an empty table gives an empty result; other columns of
any name pass through inside ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .license_scan import lowered


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the query's contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.1
#: Second labels that are public below a country's domain: no site of their own.
PUBLIC = "co|com|net|org|ac|gov|edu"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the ``/`` after the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.name) if out is None else out.when(fits, r.name)
    return out if out is not None else F.lit(None).cast("string")


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    out = None
    for r in rules:
        out = F.when(rule == r.name, r.verdict) if out is None else out.when(rule == r.name, r.verdict)
    return out if out is not None else F.lit(None).cast("string")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from (host, links): links to other hosts, and steps between a host and its parent domain."""
    links = pages.select("host", F.explode("links").alias("to")).groupBy("host", "to").agg(F.count("*").cast("double").alias("weight"))
    links = links.filter("host <> '' and to <> '' and host <> to").select(F.col("host").alias("src"), F.col("to").alias("dst"), "weight")
    hosts = pages.select("host").union(pages.select(F.explode("links"))).filter("host <> ''").distinct()
    # a.b.c.d gives a.b.c.d, b.c.d and c.d, and the steps between neighbours
    labels = hosts.select(F.split("host", r"\.").alias("w"))
    chain = labels.select(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.size("w")), ".")).alias("chain"))
    up = chain.select(F.inline(F.transform(F.slice("chain", 2, F.size("chain")), lambda d, i: F.struct(F.get("chain", i).alias("host"), d.alias("parent")))))
    up = up.filter((F.col("parent") != "") & ~F.col("parent").rlike(rf"^({PUBLIC})\.[a-z][a-z]$")).distinct()
    steps = up.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1.0).alias("weight"))
    steps = steps.union(steps.select("dst", "src", "weight"))
    return links.union(steps).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, weight) and seeds (host, trust, distrust).

    Mass of hosts without edges returns to the seeds of its kind. Reached hosts only.
    """
    flow = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    flow = flow.union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight"))
    out = flow.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    flow = materialize(flow.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("p")), "host-flow")
    start = seeds.select(F.lit("trust").alias("kind"), "host", F.col("trust").alias("seed")).union(seeds.select(F.lit("distrust"), "host", "distrust"))
    start = start.filter("seed > 0")
    total = start.groupBy("kind").agg(F.sum("seed").alias("total"))
    start = materialize(start.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed")), "host-seeds")  # two rows
    mass, moving = start.withColumnRenamed("seed", "mass"), flow.limit(1).count() > 0
    while moving:
        moved = mass.join(flow, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("p") * damping).alias("mass"))
        arrived = moved.groupBy("kind").agg(F.sum("mass").alias("arrived"))
        back = start.join(F.broadcast(arrived), "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("arrived", F.lit(0.0)))).alias("mass"))
        none = F.lit(0.0)
        both = moved.union(back).select("*", none.alias("was")).union(mass.select("kind", "host", none, "mass"))
        mass = materialize(both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was")), "host-mass")
        moving = (mass.agg(F.sum(F.abs(F.col("mass") - F.col("was")))).collect()[0][0] or 0.0) > tolerance
        mass = mass.select("kind", "host", "mass")
    return mass.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0.0)).alias("distrust"),
    )


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``; all if None), host, path, rule, verdict, trust and distrust of every page."""
    keep = pages.columns if keep is None else keep
    u = F.col(f"`{url}`").cast("string")
    found = F.regexp_extract_all(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    links = F.transform(found, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)))
    read = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), host_of(u).alias("host"), path_of(u).alias("path"), F.array_distinct(links).alias("links"))
    read = read.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    read = materialize(read.withColumn("ruled", verdict_of(F.col("rule"), rules)), "pages")
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = read.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(host_edges(read), seeds)
    n_seeds = seeds.filter("distrust > 0").agg(F.greatest(F.count("*"), F.lit(1)).alias("n_bad"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold / F.col("n_bad"))
    hosts = scores.crossJoin(F.broadcast(n_seeds)).select("host", "trust", "distrust", bad.alias("bad"))  # one row
    hosts = materialize(hosts, "host-verdicts")
    few = hosts.count() <= 500_000  # beyond, one row a host is joined, and a host of very many pages is split at run time
    out = read.join(F.broadcast(hosts) if few else hosts, "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad") & (F.col("host") != ""), "block").otherwise("allow"))
    return out.select("row", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def base_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """Page, host, path and rule as DuckDB SQL; the method's verdicts are beyond it."""
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    )
    return f"""
SELECT page_id, host, path, CASE {fits} END AS rule FROM (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
"""
