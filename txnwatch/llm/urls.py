"""URL filter by a tree of path templates, in DataFrame functions only.

Every host has a tree over the segments of its paths. Segments that look like numbers, dates or hashes become typed
wildcards; a node with many rare children turns them into a wildcard too. Sibling templates whose share of blocked
pages does not differ significantly are merged, and a template is rejected if its smoothed share of labelled pages
that are to be blocked reaches one half. Labels come from a list of rules; the tree judges what no rule covers.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize
from txnwatch.llm.licenses import _LOWER, _UPPER

#: Levels of the tree; deeper segments are one wildcard for the rest.
DEPTH = 6
#: A node has a variable segment if it has so many children with so few pages each.
CHILDREN, PAGES_PER_CHILD = 16, 4.0
#: Two shares differ if they are so many standard errors apart.
APART = 1.96
#: Weight of a host's share for its templates, and of all hosts' share for a host, in pages.
TEMPLATE_PRIOR, HOST_PRIOR = 2.0, 8.0
REJECT = 0.5


class Rule(NamedTuple):
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path: what follows the first ``://``; both empty without it."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equally long ones the one with the longer host."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host), r)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.named_struct(F.lit("rule"), F.lit(r.host + r.path), F.lit("verdict"), F.lit(r.verdict))).otherwise(found)
    return found


def typed_segments(path: Column) -> Column:
    """Segments of a path with numbers, dates and hashes as wildcards; those below the deepest level are one."""
    inner = F.regexp_replace(path, r"^/", "")
    typed = F.concat(F.lit("/"), inner, F.lit("/"))
    for pattern, mark in ((r"(?<=/)[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?(?=/)", "{date}"), (r"(?<=/)[0-9]+(?=[/.])", "{n}"),
                          (r"(?<=/)(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=[/.])", "{hash}")):
        typed = F.regexp_replace(typed, pattern, mark)
    whole = F.split(F.substr(typed, F.lit(2), F.octet_length(typed) - F.lit(2)), "/")
    return F.when(F.size(whole) > DEPTH, F.concat(F.slice(whole, 1, DEPTH - 1), F.array(F.lit("**")))).otherwise(whole)


def grow_tree(nodes: DataFrame) -> DataFrame:
    """``nodes`` (host, segments, pages, ...) with ``template``: variable segments are generalised level by level."""
    deepest = nodes.agg(F.max(F.size("segments"))).head()[0] or 0
    grown = nodes.withColumn("template", F.array().cast("array<string>"))
    for level in range(deepest):
        own = F.get("segments", F.lit(level))
        children = grown.where(own.isNotNull()).groupBy("host", "template", own.alias("child")).agg(F.sum("pages").alias("pages"))
        wide = (children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.sum("pages").alias("pages"))
                .where((F.col("n") >= CHILDREN) & (F.col("pages") < PAGES_PER_CHILD * F.col("n"))).select("host", "template", F.lit(True).alias("wide")))
        step = F.when(own.isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(F.col("wide"), "*").otherwise(own))))
        grown = grown.join(wide, ["host", "template"], "left").withColumn("template", step).drop("wide")
    return grown


def judge_templates(grown: DataFrame) -> DataFrame:
    """(host, template, purity, rejected) from (host, template, labelled, blocked)."""
    leaves = grown.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("blocked").alias("h_blocked"))
    every = hosts.agg(F.sum("h_labelled").alias("labelled"), F.sum("h_blocked").alias("blocked")).head()  # two numbers
    overall = (every["blocked"] / every["labelled"]) if every["labelled"] else 0.0
    host_share = (F.col("h_blocked") + HOST_PRIOR * overall) / (F.col("h_labelled") + HOST_PRIOR)
    known = leaves.join(hosts.select("host", host_share.alias("host_share")), "host")
    share = (F.col("blocked") + TEMPLATE_PRIOR * F.col("host_share")) / (F.col("labelled") + TEMPLATE_PRIOR)
    known = known.withColumn("share", share).withColumn("parent", F.slice("template", F.lit(1), F.greatest(F.size("template") - 1, F.lit(0))))
    siblings = Window.partitionBy("host", "parent").orderBy("share", "template")
    before = F.lag(F.struct("share", "labelled")).over(siblings)
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("labelled") + TEMPLATE_PRIOR)
                   + before.getField("share") * (1 - before.getField("share")) / (before.getField("labelled") + TEMPLATE_PRIOR))
    fresh = F.when(before.isNull() | (F.col("share") - before.getField("share") > APART * error), 1).otherwise(0)
    merged = known.withColumn("fresh", fresh).withColumn("branch", F.sum("fresh").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    of_branch = Window.partitionBy("host", "parent", "branch")
    purity = (F.sum("blocked").over(of_branch) + TEMPLATE_PRIOR * F.col("host_share")) / (F.sum("labelled").over(of_branch) + TEMPLATE_PRIOR)
    return merged.select("host", "template", F.round(purity, 9).alias("purity")).withColumn("rejected", F.col("purity") >= REJECT)


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    ``verdict`` is the rule's where one fits, else ``block`` if the template of the path is rejected and ``allow``
    otherwise. Null urls and urls without ``://`` have an empty host and path, and are judged by the template of
    empty paths. Repeated rows count as often as they stand there. Without rules nothing is labelled and all is allowed.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    told = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", told.getField("rule").alias("rule"), told.getField("verdict").alias("told"), typed_segments(F.col("path")).alias("segments"))
    nodes = rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("pages"), F.count("told").alias("labelled"), F.count_if(F.col("told") == "block").alias("blocked"))
    grown = materialize(grow_tree(materialize(nodes, "url-nodes")), "url-tree")
    leaves = grown.select("host", "segments", "template").join(judge_templates(grown), ["host", "template"])
    judged = rows.join(leaves, ["host", "segments"], "left")
    verdict = F.coalesce("told", F.when(F.col("rejected"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
