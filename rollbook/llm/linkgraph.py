"""Url filters with link-graph propagation of trust and distrust.

Rules judge urls by host and path. Where none fits, the host's place in the link graph
does: trust spreads from hosts whose judged pages are all allowed along links, distrust
from hosts whose pages are all blocked against them, each by personalised PageRank over
host edges; a host with more distrust than trust is blocked. Rounds go on until what
they still move is below TOLERANCE, so no length of a chain is built in; a walk at a host
without links out starts anew at the seeds, which is the same as ranks scaled to sum to 1.

Built-in functions only. Edges are counted per pair of hosts before anything is joined,
and ranks are sums combined before they are sent, so a hub is no task's load.

Defined results: a url that is null or has no ``://`` has an empty host and path and fits
no rule; hosts that nothing reaches are allowed, as are those whose distrust exceeds their
trust by TOLERANCE of all at most; null html has no links; equal rows are
pages of their own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.sources.staging import forget, stage

#: Fixed by the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING = 0.85
#: Of all rank, what may be still to come when rounds end, and what a verdict must exceed.
TOLERANCE = 1e-9
#: Rounds between two writes to the shared folder, each with a test of convergence.
STRIDE = 4
TRUST, DISTRUST = 0, 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""


def split(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    start = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def links(pages: DataFrame) -> DataFrame:
    """How many links there are from one host to another, in the html of (host, html)."""
    found = pages.select(
        F.col("host").alias("source"),
        F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"),
    )
    target, _ = split(F.regexp_replace("link", r"^(?:[^/]*:)?//", "http://"))
    edges = found.select("source", target.alias("target"))
    edges = edges.filter("source <> target AND source <> '' AND target <> ''")
    return edges.groupBy("source", "target").agg(F.count("*").cast("double").alias("links"))


def ranks(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Personalised PageRanks: walk, host and rank, which sums to 1 per walk.

    ``edges`` has walk, source, target and links, ``seeds`` walk, host and seed, a weight of
    restarts. Several walks, told by a number, go on together.
    """
    out = edges.groupBy("walk", "source").agg(F.sum("links").alias("all"))
    shares = edges.join(out, ["walk", "source"]).select(
        "walk", F.col("source").alias("host"), "target", (F.col("links") / F.col("all")).alias("share")
    )
    shares = stage(shares, "shares", sized=True)
    whole = seeds.groupBy("walk").agg(F.sum("seed").alias("all"))
    start = seeds.join(whole, "walk").select("walk", "host", (F.col("seed") / F.col("all")).alias("rank"))
    start = stage(start, "seeds", sized=True)

    def masses(rows: DataFrame) -> dict[int, float]:
        """The sum of each walk, of which there are a few."""
        return {r["walk"]: r["mass"] for r in rows.groupBy("walk").agg(F.sum("rank").alias("mass")).collect()}

    now, mass = start, masses(start)
    while True:
        # a round only adds: what hosts without links out lose is made good by the scaling
        after = now
        for _ in range(STRIDE):
            moved = shares.join(after, ["walk", "host"]).select(
                "walk", F.col("target").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank")
            )
            after = start.unionByName(moved).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        before = now
        now, last = stage(after, "ranks", sized=True), mass
        if before is not start:
            forget(before)
        mass = masses(now)
        # each stride adds DAMPING ** STRIDE of the one before at most
        ahead = DAMPING**STRIDE / (1 - DAMPING**STRIDE)
        if all(ahead * (mass[walk] - last[walk]) <= TOLERANCE * mass[walk] for walk in mass):
            break
    summed = now.groupBy("walk").agg(F.sum("rank").alias("all"))
    return now.join(summed, "walk").select("walk", "host", (F.col("rank") / F.col("all")).alias("rank"))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict."""
    host, path = split(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    judged = stage(
        placed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_ruled")),
        "judged",
    )
    edges = stage(links(placed), "edges", sized=True)
    known = judged.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("_ruled") == "allow").alias("allowed"),
        F.count_if(F.col("_ruled") == "block").alias("blocked"),
    )
    known = stage(known, "hosts", sized=True)

    trusted = known.filter("allowed > 0 AND blocked = 0").select(
        F.lit(TRUST).alias("walk"), "host", F.col("allowed").cast("double").alias("seed")
    )
    blocked = known.filter("blocked = pages").select(
        F.lit(DISTRUST).alias("walk"), "host", F.col("blocked").cast("double").alias("seed")
    )
    turned = edges.select(
        F.lit(DISTRUST).alias("walk"), F.col("target").alias("source"), F.col("source").alias("target"), "links"
    )
    ranked = ranks(
        edges.select(F.lit(TRUST).alias("walk"), *edges.columns).unionByName(turned),
        trusted.unionByName(blocked),
    )
    of_host = ranked.groupBy("host").agg(
        F.sum(F.when(F.col("walk") == TRUST, -F.col("rank")).otherwise(F.col("rank"))).alias("surplus")
    )
    # only those more distrusted than trusted are joined
    distrusted = of_host.filter(F.col("surplus") > TOLERANCE).select("host", F.lit("block").alias("_spread"))
    final = F.coalesce("_ruled", "_spread", F.lit("allow"))
    return judged.join(distrusted, "host", "left").select(
        "page_id", "host", "path", "rule", final.alias("verdict")
    )
