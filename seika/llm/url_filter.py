"""URL filter: allow and block rules, then a path-template tree per host.

Parsing: the host is what follows the first ``://`` up to ``/ ? #`` or the end,
A-Z lower-cased; the path goes on up to ``?`` or ``#``. Of the rules that fit
(the rule's host or a subdomain of it, path prefix) the longest decides.

Pages without a rule are judged by the tree. Every path becomes a leaf: its
segments with digit runs replaced by ``#``. Level by level, where a host's branch
has more than ``max_children`` different segments, that segment becomes the
wildcard ``*``; it ends where no branch has more leaves than that, at whatever depth. Templates of a host with at least ``min_labelled`` labels that differ in literal
segments only are merged, in order of their rates, while a template's rate doesn't differ
significantly from the pooled rate of the branch so far. A branch's purity is
(bad + k * prior) / (labelled + k), with the share of bad
pages among all labelled ones as prior; it is rejected from ``max_purity`` on.
A template with fewer labels belongs to no branch: its purity is its own labels with k times the
purity of its parent, the longest prefix with ``min_labelled`` labels, else the host, else
the prior. Only a parent prefix can reject it: labels elsewhere on its host are none of its own.
Labels are (page_id, bad); without them the pages that a rule decides are the
labelled ones, a block rule meaning bad.

Scale: pages are first reduced to leaf counts by a partial aggregate, so a host
with a third of all pages sends one row per leaf and task; the tree works on leaves.
Each level is written to the shared folder. Branches are made in one pass over sorted
rows; one host's templates of one shape, at most ``max_children`` to the power of the literal
segments, are in one task, which holds one batch of them. Rules are a parameter, a literal expression.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by its (host-less) template, as any other; ties between rules of one length can't disagree unless equal, then the
first listed wins; repeated pages count as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seika.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), _UPPER, _LOWER), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        cond = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits = F.when(cond, value) if fits is None else fits.when(cond, value)
    return fits


def leaf_of(path: Column) -> Column:
    """Segments of the path with digit runs as ``#``."""
    segs = F.split(F.regexp_replace(path, "[0-9]+", "#"), "/")
    return F.when(path.startswith("/"), F.slice(segs, 2, 1_000_000)).otherwise(segs)


def _generalise(leaves: DataFrame, max_children: int) -> DataFrame:
    """(host, leaf, template, n, good, bad): wildcards level by level, while a branch has more than ``max_children`` leaves."""
    tree = stage(leaves.withColumn("template", F.col("leaf")), "url-tree")
    for d in itertools.count():
        at = tree.where(F.size("template") > d).select(
            "host", F.slice("template", 1, d).alias("prefix"), F.get("template", F.lit(d)).alias("seg"))
        open_ = stage(at.groupBy("host", "prefix", "seg").agg(F.count(F.lit(1)).alias("n"))
                      .groupBy("host", "prefix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fan"))
                      .where(F.col("n") > max_children), "url-branches")
        if not open_.limit(1).count():
            return tree
        wide = open_.where(F.col("fan") > max_children).select(F.col("host").alias("h"), "prefix")
        if not wide.limit(1).count():
            continue
        hit = F.col("h").isNotNull() & (F.size("template") > d)
        tree = stage(
            tree.withColumn("pre", F.slice("template", 1, d))
            .join(wide, (F.col("host") == F.col("h")) & (F.col("pre") == F.col("prefix")), "left")
            .withColumn("template", F.when(hit, F.transform("template", lambda x, i: F.when(i == d, F.lit("*")).otherwise(x)))
                        .otherwise(F.col("template"))).drop("h", "prefix", "pre"), "url-tree")


def _fold(z: float):
    """Rows of one host and shape come in order of their rate; a template joins the branch
    whose pooled rate lies within ``z`` standard errors of its own, else it opens the next one."""
    def near(g: int, b: int, good: int, bad: int) -> bool:
        n, m = g + b + 2, good + bad + 2
        pooled, rate = (b + 1) / n, (bad + 1) / m
        return abs(rate - pooled) <= z * (pooled * (1 - pooled) / n + rate * (1 - rate) / m) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, branch, g, b = None, 0, 0, 0
        for rows in batches:
            branches = []
            for host, shape, good, bad in zip(*(rows.column(c).to_pylist() for c in ("host", "shape", "good", "bad")), strict=True):
                if (host, shape) != at:
                    at, branch, g, b = (host, shape), 0, 0, 0
                elif not near(g, b, good, bad):
                    branch, g, b = branch + 1, 0, 0
                g, b = g + good, b + bad
                branches.append(branch)
            yield pa.record_batch([*(rows.column(c) for c in ("host", "template", "shape", "good", "bad")), pa.array(branches, pa.int64())],
                                  ["host", "template", "shape", "good", "bad", "branch"])
    return run


def _merge(templates: DataFrame, z: float) -> DataFrame:
    """(host, template, shape, good, bad, branch): templates of one shape whose smoothed rate is within
    ``z`` standard errors of their branch's pooled rate share it."""
    t = templates.withColumn("shape", F.concat_ws("/", F.transform("template", lambda s: F.when(
        s.contains("#") | s.isin("*", ""), s).otherwise(F.lit("@")))))
    t = t.select("host", "template", "shape", "good", "bad", ((F.col("bad") + 1) / (F.col("good") + F.col("bad") + 2)).alias("rate"))
    return t.repartition("host", "shape").sortWithinPartitions("host", "shape", "rate", "template").mapInArrow(
        _fold(z), "host string, template array<string>, shape string, good long, bad long, branch long")


def _parents(few: DataFrame, templates: DataFrame, min_labelled: int) -> DataFrame:
    """(host, template, level, pg, pb): labels of the longest proper prefix that has ``min_labelled`` of them;
    level 0 is the whole host, no row means that the host has too few as well."""
    def prefixes(frame: DataFrame) -> DataFrame:
        levels = F.sequence(F.lit(0), F.greatest(F.size("template") - 1, F.lit(0)))
        return frame.withColumn("level", F.explode(levels)).withColumn("prefix", F.slice("template", F.lit(1), F.col("level")))

    known = (prefixes(templates.where(F.col("good") + F.col("bad") > 0)).groupBy("host", "level", "prefix")
             .agg(F.sum("good").alias("pg"), F.sum("bad").alias("pb")).where(F.col("pg") + F.col("pb") >= min_labelled))
    return (prefixes(few.select("host", "template")).join(known, ["host", "level", "prefix"])
            .groupBy("host", "template").agg(F.max(F.struct("level", "pg", "pb")).alias("p")).select("host", "template", "p.*"))


def url_filter(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, max_children: int = 8,
               z: float = 2.0, k: float = 10.0, max_purity: float = 0.8,
               min_labelled: int = 5) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per page."""
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("fits", rule_of(F.col("host"), F.col("path"), rules)).withColumn("leaf", leaf_of(F.col("path")))
    if labels is None:
        labelled = p.withColumn("is_bad", F.col("fits.verdict") == "block")
    else:
        known = labels.groupBy(F.col("page_id").alias("id")).agg(F.max(F.col("bad").cast("boolean")).alias("is_bad"))
        labelled = p.join(known, F.col("page_id") == F.col("id"), "left").drop("id")
    leaves = labelled.groupBy("host", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_bad")).alias("good"), F.count_if("is_bad").alias("bad"))
    tree = _generalise(leaves, max_children)
    templates = stage(tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-templates")
    prior = templates.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("good") + F.sum("bad"), F.lit(0)) + 1)).scalar()
    enough = F.col("good") + F.col("bad") >= min_labelled
    merged = stage(_merge(templates.where(enough), z), "url-branches")
    branches = merged.groupBy("host", "shape", "branch").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    own = (merged.join(branches, ["host", "shape", "branch"])
           .withColumn("purity", (F.col("b") + k * prior) / (F.col("g") + F.col("b") + k))
           .select("host", "template", "purity", (F.col("purity") >= max_purity).alias("reject")))
    few = templates.where(~enough)
    above = (few.join(_parents(few, templates, min_labelled), ["host", "template"], "left")
             .withColumn("pg", F.coalesce("pg", F.lit(0))).withColumn("pb", F.coalesce("pb", F.lit(0)))
             .withColumn("parent", (F.col("pb") + k * prior) / (F.col("pg") + F.col("pb") + k))
             .withColumn("purity", (F.col("bad") + k * F.col("parent")) / (F.col("good") + F.col("bad") + k))
             .select("host", "template", "purity", (F.coalesce(F.col("level") > 0, F.lit(False)) & (F.col("purity") >= max_purity)).alias("reject")))
    judged = own.unionByName(above)
    judged = (tree.select("host", "leaf", "template").join(judged, ["host", "template"])
              .select(F.col("host").alias("h"), F.col("leaf").alias("l"), F.array_join("template", "/").alias("template"),
                      "purity", "reject"))
    out = p.join(judged, (F.col("host") == F.col("h")) & (F.col("leaf") == F.col("l")))
    own = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("fits.rule").alias("rule"),
                      F.coalesce(F.col("fits.verdict"), own).alias("verdict"), "template", "purity")
