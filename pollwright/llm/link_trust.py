"""URL rules, and trust over the link graph for urls that no rule fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import cut

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Rule = tuple[str, str]  # verdict and "host/path"


def _after_scheme(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no
    ``://`` gives the empty string."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, _UPPER, _UPPER.lower())).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    path = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct ``(size, rule, verdict)`` of the longest fitting rule, or null."""
    fitting = []
    for verdict, rule in rules:
        domain, _, rest = rule.partition("/")
        on_host = (host == domain) | F.endswith(host, F.lit("." + domain))
        fits = on_host & F.startswith(path, F.lit("/" + rest))
        found = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fitting.append(F.when(fits, found))
    return F.array_max(F.array(*fitting))


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts. A relative link stays on its own host,
    and a host's links to itself say nothing about it."""
    found = pages.select(
        F.col("host").alias("src"),
        F.explode(F.expr(r"""regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["\']?([^"\'\\s>]*)', 1)""")).alias("url"),
    )
    absolute = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    return (
        found.where(F.startswith("url", F.lit("//")) | F.rlike("url", F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")))
        .select("src", host_of(absolute).alias("dst"))
        .where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def personalised_rank(
    hosts: DataFrame,
    seed: str,
    links: DataFrame,
    damping: float = 0.85,
    steps: int | None = None,
    tolerance: float = 1e-4,
) -> DataFrame:
    """``host, rank, received``: PageRank that restarts at the seeds, in proportion to the column
    ``seed`` of ``hosts``; the ranks add up to the seeds' sum. Rank on hosts without links goes back
    to the seeds. ``links(src, dst, n)`` are followed in proportion to ``n``. ``received`` is the
    part of the rank that came over links. Ends when the ranks move by less than ``tolerance`` of
    their sum; every step is a checkpoint. A step moves at most ``damping`` of what the one
    before moved, so there are at most log(tolerance / 2) / log(damping) steps."""
    total = hosts.agg(F.sum(seed)).first()[0] or 0
    if not total:
        return hosts.select("host", F.lit(0.0).alias("rank"), F.lit(0.0).alias("received"))
    steps = steps or math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    parts = cut(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("part")))
    known = hosts.select("host", F.col(seed).cast("double").alias("seed"))
    linked = parts.select(F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True))
    base = cut(known.join(linked, "host", "left"))
    ranks = base.withColumns({"rank": F.col("seed"), "received": F.lit(0.0)})
    for _ in range(steps):
        given = (
            ranks.join(parts, ranks.host == parts.src)
            .groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("rank") * F.col("part")).alias("given"))
        )
        lost = ranks.where(F.col("linked").isNull()).agg(F.sum("rank")).first()[0] or 0.0
        back = F.col("seed") * ((1 - damping) + damping * lost / total)
        new = cut(
            ranks.withColumnRenamed("rank", "old")
            .join(given, "host", "left")
            .withColumn("received", damping * F.coalesce("given", F.lit(0.0)))
            .withColumn("rank", back + F.col("received"))
        )
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.drop("old", "given")
        if moved <= tolerance * total:
            break
    return ranks.select("host", "rank", "received")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], least_share: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    The longest fitting rule decides. Where none fits, the host does: it is blocked if rules block
    at least ``least_share`` of its pages, whoever links to it. Else links decide: trust
    starts from the pages that rules allow and follows links; distrust starts from the pages that rules
    block and follows links backwards. A host is blocked if more distrust than trust reaches it and the
    distrust comes to at least ``least_share`` of both; its own blocked pages count under the first
    rule alone. Otherwise, and where there is no host (null url, no ``://``), the verdict is ``allow``.

    Null html has no links. Repeated rows are judged alike and count as pages, other columns are
    not read, an empty table gives no rows.
    """
    split = pages.select(
        F.col("page_id"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("html"),
    )
    ruled = split.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    hosts = cut(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("found.verdict") == "allow").alias("allowed"),
            F.count_if(F.col("found.verdict") == "block").alias("blocked"),
        )
    )
    links = cut(host_links(split))
    # Hosts that are only linked to take part in the ranks.
    ends = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    graph = cut(hosts.join(ends, "host", "full").na.fill(0, ["pages", "allowed", "blocked"]))
    trust = personalised_rank(graph, "allowed", links).select("host", F.col("rank").alias("trust"))
    backwards = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(graph, "blocked", backwards).select("host", F.col("received").alias("distrust"))
    by_pages = (F.col("blocked") > 0) & (F.col("blocked") >= least_share * F.col("pages"))
    both = F.col("distrust") + F.col("trust")
    by_links = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least_share * both)
    bad = (
        hosts.join(trust, "host")
        .join(distrust, "host")
        .where(by_pages | by_links)
        .select("host", F.lit("block").alias("by_host"))
    )
    # A host can have any share of the pages, so its verdict is met under one of 32 salts: the task
    # of a host that has all pages gets 1/32 of them.
    salts = 32
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = ruled.drop("html").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    return spread.join(bad, ["host", "salt"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", "by_host", F.lit("allow")).alias("verdict"),
    )
