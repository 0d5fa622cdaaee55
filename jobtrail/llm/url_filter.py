"""URL filters: rules by host and path, and trust spread over the links between hosts.

A rule fits its host and all of its subdomains where the path of the url starts
with the rule's path; the longest rule wins (host and path together, then the
longer host, then blocking). Pages that no rule fits get the verdict of their
host, which comes from the link graph:

* Hosts most of whose pages are allowed by rules are trusted seeds, those most
  of whose pages are blocked are blocked seeds. A host that is only linked to
  counts by the rule for its root path.
* Trust follows links, as in personalised PageRank: each round a host passes
  ``DAMPING`` of its trust to the hosts it links to, by the number of links.
  Distrust goes the other way, from a host to those that link to it. A domain
  and its immediate subdomains are tied in both directions by ``KIN`` links.
* A host is blocked if its distrust is at least ``LIMIT`` of what one blocked
  seed starts with, and more than its trust.

Masses are whole billionths, so sums do not depend on the order of addition.
Everything is joins and sums of DataFrames. Pages are reduced to one row per
pair of linked hosts before the first shuffle; hosts with many pages or links
are met by a broadcast of at most ``SENT_HOSTS`` rows or by salted joins.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html has no links; a host's links to itself
count for nothing; a repeated page is judged each time it stands there; an empty
table gives no rows. Only the page id, url and html columns are read, so other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtrail.functions.frames import salted_join
from jobtrail.llm.shared import ascii_lower, written

ALLOW, BLOCK = "allow", "block"
UNIT = 1_000_000_000
DAMPING, LIMIT, ROUNDS, KIN = 0.85, 0.5, 30, 1
# Rounds planned together before the masses are written.
STEP = 5
# Up to this many hosts their rows travel to every task.
SENT_HOSTS = 50_000
# The host of a link in an anchor: absolute, or without a scheme.
LINK = (r"(?i)<(?:a|area)[ \t\r\n\f][^<>]*?href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?[ \t\r\n\f]*"
        r"(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"' \t\r\n\f<>]*)")
RULES = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark or number sign, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES)


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, links``: links between different hosts, from ``host, html``."""
    found = pages.select(F.col("host").alias("src"),
                         F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", ascii_lower(F.col("dst"))).where("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def kin_links(hosts: DataFrame, links: int) -> DataFrame:
    """Ties between each host and its parent domain of two labels or more."""
    parent = F.regexp_extract("host", r"^[^.]*\.(.*\..*)$", 1)
    pairs = hosts.select("host", parent.alias("parent")).where("parent <> '' AND parent NOT LIKE '.%'")
    ends = F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")),
                             F.struct(F.col("parent").alias("src"), F.col("host").alias("dst"))))
    return pairs.select(ends.alias("e")).select("e.src", "e.dst", F.lit(links).cast("bigint").alias("links"))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, rules``: the rules of each host and its parent domains, strongest first; hosts without rules are left out.

    Suffixes are tried up to as many labels as a rule's host has.
    """
    rules = rules.select("verdict", F.coalesce(ascii_lower(F.col("host")), F.lit("")).alias("host"),
                         F.coalesce("path", F.lit("")).alias("path"))
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0
    name = F.concat("host", "path")
    strength = F.struct((-F.length(name)).alias("length"), (-F.length("host")).alias("host_length"),
                        F.when(F.col("verdict") == BLOCK, 0).otherwise(1).alias("order"), F.col("path"),
                        name.alias("rule"), F.col("verdict"))
    by_host = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(strength).alias("rules"))
    parts = F.split("host", r"\.")
    count = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    named = hosts.where((F.col("host") != "") & F.lit(labels > 0)).select("host", F.explode(suffixes).alias("suffix"))
    fitting = salted_join(named, by_host, ["suffix"], ["host"])
    return fitting.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("rules"))).alias("rules"))


def strongest(rules: Column, path: Column) -> Column:
    """The first rule whose path the url's path starts with."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def with_host_rows(rows: DataFrame, hosts: DataFrame, few: bool, spread: Sequence[str]) -> DataFrame:
    """Left join by host; a host may have any number of rows."""
    if few:
        return rows.join(F.broadcast(hosts), "host", "left")
    return salted_join(rows, hosts, ["host"], spread, how="left")


def seeds_of(counts: DataFrame) -> DataFrame:
    """``kind, host, mass`` of hosts with more than half of their pages allowed or blocked, from ``pages, allowed, blocked``."""
    kind = F.when(F.col("allowed") * 2 > F.col("pages"), "trust").when(F.col("blocked") * 2 > F.col("pages"), "distrust")
    return counts.select(kind.alias("kind"), "host", F.lit(UNIT).cast("bigint").alias("mass")).where("kind IS NOT NULL")


def flows(links: DataFrame) -> DataFrame:
    """``kind, host, to, share``: trust along the links, distrust against them, shares of one host adding up to 1."""
    ways = F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"))))
    both = links.select(ways.alias("w"), "links").select("w.*", "links")
    whole = both.groupBy("kind", "host").agg(F.sum("links").alias("whole"))
    shared = salted_join(both, whole, ["kind", "host"], ["to"])
    return shared.select("kind", "host", "to", (F.col("links") / F.col("whole")).alias("share"))


def spread_masses(seeds: DataFrame, flow: DataFrame, few: bool, rounds: int, damping: float) -> DataFrame:
    """``kind, host, mass`` after ``rounds`` rounds, or earlier if no mass changes any more."""
    passed = F.floor(F.col("mass").cast("double") * F.lit(damping) * F.col("share")).cast("bigint")
    mass, done, total = seeds, 0, None
    while done < rounds:
        step = min(STEP, rounds - done)
        for _ in range(step):
            sent = flow.join(F.broadcast(mass), ["kind", "host"]) if few \
                else salted_join(flow, mass, ["kind", "host"], ["to"])
            moved = sent.select("kind", F.col("to").alias("host"), passed.alias("mass"))
            mass = seeds.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        mass, done = written(mass, "masses"), done + step
        # Masses only grow from the seeds on, so an equal sum means equal masses.
        before, total = total, mass.agg(F.sum("mass")).first()[0]
        if total == before:
            break
    return mass


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
               html_column: str = "html", rounds: int = ROUNDS, damping: float = DAMPING, limit: float = LIMIT,
               kin: int = KIN) -> DataFrame:
    """Verdict of every page: ``page_id, host, path, rule, verdict, trust, distrust`` (masses in billionths)."""
    url = F.col(url_column)
    named = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    linked = written(host_links(pages.select(host_of(url).alias("host"), F.col(html_column).alias("html"))), "host-links")
    crawled = named.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    known = crawled.select("host").unionByName(linked.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    known = written(known, "hosts")
    few = known.count() <= SENT_HOSTS
    host_rules = written(rules_of_hosts(known, rules), "host-rules")

    best = strongest(F.col("rules"), F.col("path"))["verdict"]
    counts = with_host_rows(named.where("host <> ''"), host_rules, few, ["page_id", "path"]) \
        .select("host", best.alias("verdict")).groupBy("host") \
        .agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("verdict") == ALLOW).alias("allowed"),
             F.count_if(F.col("verdict") == BLOCK).alias("blocked"))
    root = strongest(F.col("rules"), F.lit("/"))["verdict"]
    uncrawled = known.join(counts, "host", "left_anti").join(host_rules, "host") \
        .select("host", F.lit(1).cast("bigint").alias("pages"), F.when(root == ALLOW, 1).otherwise(0).alias("allowed"),
                F.when(root == BLOCK, 1).otherwise(0).alias("blocked"))
    seeds = written(seeds_of(counts.unionByName(uncrawled)), "seeds")

    links = linked.unionByName(kin_links(known, kin)).groupBy("src", "dst").agg(F.sum("links").alias("links"))
    flow = written(flows(links.where("links > 0")), "flows")
    mass = spread_masses(seeds, flow, few, rounds, damping)
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0))
    scores = mass.groupBy("host").agg(of_kind("trust").alias("trust"), of_kind("distrust").alias("distrust"))
    hosts = known.join(host_rules, "host", "left").join(scores, "host", "left")

    judged = with_host_rows(named, hosts, few, ["page_id", "path"])
    trust, distrust = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("trust", "distrust"))
    by_host = F.when((distrust >= F.lit(int(limit * UNIT))) & (distrust > trust), BLOCK).otherwise(ALLOW)
    won = strongest(F.col("rules"), F.col("path"))
    return judged.select("page_id", "host", "path", won["rule"].alias("rule"),
                         F.coalesce(won["verdict"], by_host).alias("verdict"), trust.alias("trust"),
                         distrust.alias("distrust"))
