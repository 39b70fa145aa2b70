"""URL filter: host and path rules, then trust and distrust propagated over the links of hosts.

Everything is DataFrame work. Edges join hosts whose pages link to each other, and a host with its
parent domain where both have pages. Personalised PageRank starts from the hosts that rules allow;
distrust starts from the hosts that rules block and runs against the links. A host is blocked where
its share of distrust exceeds its share of trust by more than a threshold; hosts that neither
reaches are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.storage import discard, durable

Rule = tuple[str, str, str]  # action, host, path

# The rules of the registered query.
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
ROUNDS = 12  # at least
ROUNDS_PER_TABLE = 4
TOLERANCE = 1e-13  # of the largest change of a rank between two tables; below what verdicts round to
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def judge(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls; of equal lengths the first."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later ones override, so the order is from short to long, and from last to first.
    for what, name, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, action = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links between hosts of the table, and hosts with their parent domains."""
    linked = pages.filter(F.col("html").contains("//")).select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    linked = linked.groupBy(F.col("host").alias("src"), ascii_lower(F.col("to")).alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    up = hosts.select(F.col("host").alias("src"), F.substring("host", F.instr("host", ".") + 1, F.length("host")).alias("dst"), F.lit(1.0).alias("weight")).filter("src <> dst AND dst <> ''")
    up = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")
    both = linked.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst", "weight").unionByName(up).unionByName(up.selectExpr("dst AS src", "src AS dst", "weight"))
    return both.filter("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int, name: str) -> DataFrame:
    """(host, rank): personalised PageRank of ``seeds`` (host, mass adding up to 1) over the edges.

    Goes on, after at least ``rounds`` rounds, until no further host is reached and no rank changes by
    more than ``TOLERANCE`` between two tables. What reaches a host without out-links goes back to the
    seeds: that multiplies all ranks by one factor, so they are divided by their sum at the end.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    moves = durable(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total") * damping).alias("share")), f"{name}-moves")
    start = seeds.select("host", (F.col("mass") * (1 - damping)).alias("mass"))
    rank = seeds.select("host", F.col("mass").alias("rank"))
    done, settled = 0, False
    while done < rounds or not settled:
        before = rank
        for _ in range(ROUNDS_PER_TABLE):
            sent = rank.join(moves, rank.host == moves.src).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("mass"))
            rank = start.unionByName(sent).groupBy("host").agg(F.sum("mass").alias("rank"))
        rank = durable(rank, f"{name}-rank")
        done += ROUNDS_PER_TABLE
        if done >= rounds:
            # A host once reached stays so; one that is new has no rank before.
            both = rank.join(before.select("host", F.col("rank").alias("old")), "host", "left")
            settled = both.filter(F.col("old").isNull() | (F.abs(F.col("rank") - F.col("old")) > TOLERANCE)).isEmpty()
        if done > ROUNDS_PER_TABLE:
            discard(before)
    total = rank.agg(F.sum("rank")).first()[0] or 1.0
    return rank.select("host", (F.col("rank") / F.lit(float(total))).alias("rank"))


def verdicts(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    threshold: float = 0.0,
) -> DataFrame:
    """Judge every url: (page_id, host, path, rule, verdict), one row for each row of ``pages``.

    Null urls and urls without "://" have an empty host and path, fit no rule, take no part in the
    graph and are allowed. Null html has no links. Without seeds, or on an empty table, nothing is
    blocked but by rules. Ties stay allowed. Rows with null or repeated page ids are judged each.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, action = judge(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("action", action)
    hosts = durable(
        parsed.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")),
        "hosts",
    )
    edges = durable(host_edges(parsed.filter("html IS NOT NULL AND host <> ''"), hosts), "host-edges")
    total = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()

    def seeds(column: str, of: int | None) -> DataFrame:
        return hosts.filter(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(of or 1))).alias("mass"))

    trust = propagate(edges, seeds("allowed", total[0]), damping, rounds, "trust")
    distrust = propagate(edges.selectExpr("dst AS src", "src AS dst", "weight"), seeds("blocked", total[1]), damping, rounds, "distrust")
    scores = trust.select("host", "rank", F.lit(0.0).alias("against")).unionByName(distrust.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("against")))
    # Shares are rounded, so that the order of additions decides no verdict.
    bad = scores.groupBy("host").agg(F.round(F.sum("against") - F.sum("rank"), 12).alias("excess")).filter(F.col("excess") > threshold).select(F.col("host").alias("bad_host"))
    bad = durable(bad, "blocked-hosts")
    parsed = parsed.drop("html")
    joined = parsed.join(bad, parsed.host == bad.bad_host, "left")
    by_method = F.when(F.col("bad_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("action", by_method).alias("verdict"))
