"""URL filter by a tree of path templates for each host, in DataFrame functions only.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#`` or the end.
A url that is null or has no ``://`` has an empty host and path. Explicit rules come first: a rule fits its host and all subdomains if the
path begins with the rule's path, and the longest one decides. The urls that rules decide are the labels of the tree:

* Variable segments become wildcards: runs of digits turn into ``#``; where a host has more than ``FAN_OUT`` different segments at a depth,
  those with less than 1 / ``FAN_OUT`` of the urls there turn into ``*``. The tree is as deep as the paths are.
* A branch is merged with its parent unless its rate of blocked labels differs from its siblings' by more than ``Z`` standard errors.
* The share of blocked labels of a branch is smoothed towards its parent's with the weight of ``SMOOTHING`` labels, the root's towards all.
* A url without a rule is blocked if its branch's smoothed share is ``REJECT_AT`` or more, else allowed.

Repeated rows are judged each; all other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_OUT = 50
Z = 3.0
MIN_LABELS = 5
SMOOTHING = 4.0
REJECT_AT = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits; null without one. Of equally long rules the first in alphabetical order."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=False):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def parsed(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, shape, rule, blocked): ``shape`` is the path with ``#`` for runs of digits; ``blocked`` the rule's verdict as 1 or 0."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocking = [r.name for r in rules if r.verdict == "block"]
    blocked = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocking).cast("int"))
    return rows.withColumns({"shape": F.regexp_replace("path", "[0-9]+", "#"), "blocked": blocked})


def templates(rows: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, blocked, steps) of the distinct shapes; ``steps`` are the template's segments."""
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked"))
    segments = shapes.select("host", "shape", "n", F.posexplode(F.filter(F.split("shape", "/"), lambda x: x != "")).alias("depth", "segment"))
    each = segments.groupBy("host", "depth", "segment").agg(F.sum("n").alias("n"))
    level = each.groupBy("host", "depth").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    variable = each.join(level, ["host", "depth"]).filter((F.col("kinds") > FAN_OUT) & (F.col("n") * FAN_OUT < F.col("total"))).select("host", "depth", "segment", F.lit(True).alias("variable"))
    general = segments.join(variable, ["host", "depth", "segment"], "left").select("host", "shape", F.struct("depth", F.when(F.col("variable"), "*").otherwise(F.col("segment")).alias("step")).alias("step"))
    steps = general.groupBy("host", "shape").agg(F.transform(F.array_sort(F.collect_list("step")), lambda x: x["step"]).alias("steps"))
    return shapes.join(steps, ["host", "shape"], "left").withColumn("steps", F.coalesce("steps", F.expr("cast(array() as array<string>)")))


def judged_templates(found: DataFrame) -> DataFrame:
    """(host, shape, template, purity): the branch each shape ends in after merging, and its smoothed share of blocked labels."""
    nodes = found.select("host", "labelled", "blocked", F.explode(F.transform(F.sequence(F.lit(0), F.size("steps")), lambda d: F.struct(d.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice("steps", F.lit(1), d), "/")).alias("node")))).alias("at"))
    tree = nodes.groupBy("host", "at.depth", "at.node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    paths = found.select("host", "shape", F.explode(F.transform(F.sequence(F.lit(0), F.size("steps")), lambda d: F.struct(d.alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice("steps", F.lit(1), d), "/")).alias("node")))).alias("at"))
    along = paths.select("host", "shape", "at.depth", "at.node").join(tree, ["host", "depth", "node"]).groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "labelled", "blocked"))).alias("line"))
    overall = found.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2.0)).alias("rate")).scalar()
    first = F.col("line")[0]
    start = F.struct(
        first["node"].alias("node"),
        F.col("root").alias("purity"),
        first["labelled"].alias("labelled"),
        first["blocked"].alias("blocked"),
    )

    def step(above, node):
        rest, rest_blocked = above["labelled"] - node["labelled"], above["blocked"] - node["blocked"]
        part = F.try_divide  # null instead of an error without labels
        rate = part(above["blocked"], above["labelled"])
        error = F.sqrt(rate * (1.0 - rate) * (part(F.lit(1.0), node["labelled"]) + part(F.lit(1.0), rest)))
        apart = F.when((node["labelled"] >= MIN_LABELS) & (rest > 0), F.abs(part(node["blocked"], node["labelled"]) - part(rest_blocked, rest)) > Z * error).otherwise(False)
        return F.struct(
            F.when(apart, node["node"]).otherwise(above["node"]).alias("node"),
            F.when(apart, (node["blocked"] + SMOOTHING * above["purity"]) / (node["labelled"] + SMOOTHING)).otherwise(above["purity"]).alias("purity"),
            node["labelled"].alias("labelled"),
            node["blocked"].alias("blocked"),
        )

    rooted = along.withColumn("overall", overall).withColumn("root", (first["blocked"] + SMOOTHING * F.col("overall")) / (first["labelled"] + SMOOTHING))
    end = rooted.select("host", "shape", F.aggregate(F.slice("line", F.lit(2), F.size("line")), start, step).alias("end"))
    return end.select("host", "shape", F.col("end.node").alias("template"), F.col("end.purity").alias("purity"))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages``."""
    rows = parsed(pages, rules, page_id, url)
    found = judged_templates(templates(rows))
    blocking = [r.name for r in rules if r.verdict == "block"]
    verdict = F.when(F.col("rule").isin(blocking), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("purity") >= REJECT_AT, "block").otherwise("allow")
    return rows.drop("blocked").join(found, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
