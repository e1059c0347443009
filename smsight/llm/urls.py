"""URL filters: rules by host and path, and a tree of path templates per host that is judged by labelled purity.

A path's segments are the levels of a host's tree. Numbers, hexadecimal and long mixed segments are variable from the start;
others become a wildcard of their kind where they stand for less than ``LEAST_SHARE`` of the node or are not among its
``MOST_CHILDREN`` most frequent ones. A branch whose labels differ significantly (``KEEP_Z`` standard errors) from those of
all others of its wildcard stays, however rare it is. A node is settled before those below it. A round settles one node on
every path: segments that all paths of a branch have in common are taken as they are, up to the first at which they part. So a
tree is built in as many rounds as a path has nodes with several children, however many segments it has; each round joins
aggregated counts of the paths that go on. Sibling templates, which
differ in their last segment only, are merged and judged together while their labels are alike: in order of their shares,
one joins the group before it if its share lies within ``Z`` standard errors of that of all the group's labels. Templates
without labels stay apart. A group's purity is its good share, smoothed by ``STRENGTH`` rows at the share of its host, which
is smoothed at that of all hosts; below ``LEAST_PURITY`` its templates are rejected.

A rule fits its host and all subdomains if the path starts with the rule's; the longest host and path win, a fitting rule
decides alone. Rules are few and written down by hand; the tree decides about the rest.

Defined results: a null url, or one without ``://``, has empty host and path and is judged like any other; urls without
labels are judged by their host's and the overall share; without any label everything is allowed. Repeated rows count as
often as they stand. Columns with the names of the results are replaced, others are untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from smsight.llm.frames import Scratch, written

MOST_CHILDREN = 50
LEAST_SHARE = 0.01
STRENGTH = 5.0
LEAST_PURITY = 0.5
Z = 1.0
KEEP_Z = 2.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False),
         Rule("com", "/fr/", True), Rule("com", "/de/", False))

# words in host names that the labelled rows of the query call bad
BAD_HOST_WORDS = "adult ads bets casino farm pills poker porn spam xxx".split()


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit("allow" if rule.allow else "block")).otherwise(verdict)
    return name, verdict


def kind_of(segment: Column) -> Column:
    """The wildcard that stands for a segment."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(extension))
    kind = (F.when(stem.rlike(r"^[0-9]+$"), F.lit("{number}")).when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
            .when(stem.rlike(r"[0-9]"), F.lit("{mixed}")).otherwise(F.lit("{word}")))
    return F.when(segment.startswith("{"), segment).otherwise(F.concat(kind, extension))


def _first(segment: Column) -> Column:
    """A segment, or its wildcard if it is variable by its looks."""
    return F.when(segment.rlike(r"[0-9]"), kind_of(segment)).otherwise(segment)


def shape_of(path: Column) -> Column:
    """The segments of a path with variable ones replaced; empty ones at the end say that it ended with ``/``."""
    parts = F.transform(F.split(F.substring(path, 2, 1 << 30), "/"), _first)
    return F.when(F.length(path) == 0, F.array().cast("array<string>")).otherwise(parts)


def _differ(good: Column, bad: Column, pool_good: Column, pool_bad: Column, z: float) -> Column:
    """Whether the shares of two sets of labels differ by more than ``z`` standard errors (corrected for continuity)."""
    n, m = good + bad, pool_good + pool_bad
    share = (good + pool_good) / (n + m)
    gap = F.abs(good / n - pool_good / m) - (1 / n + 1 / m) / 2
    return F.when((n > 0) & (m > 0), (gap > 0) & (gap > z * F.sqrt(share * (1 - share) * (1 / n + 1 / m)))).otherwise(False)


def _chains(tree: DataFrame) -> DataFrame:
    """Lengthen the template of every path by what all paths of its branch that go on have in common.

    Each path is compared with the longest one of its branch. Nothing is in common from where the first one differs from that,
    and a path that ends before only goes as far as it has segments.
    """
    rest = F.slice("shape", F.size("template") + 1, F.size("shape"))
    longest = tree.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(F.max(F.struct(F.size(rest), rest.alias("rest")))["rest"].alias("longest"))
    same_branch = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))
    beside = tree.withColumn("rest", rest).join(longest, same_branch).drop("h", "t")
    other = F.array_position(F.zip_with("rest", "longest", lambda a, b: a.eqNullSafe(b)), False)  # the first other segment, from 1; 0: none
    parted = beside.where((other > 0) & (other <= F.size("rest"))).groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(
        F.min(other - 1).cast("int").alias("common"))
    out = tree.withColumn("rest", rest).join(parted, same_branch, "left")
    common = F.coalesce("common", F.size("rest"))
    return out.select("host", "shape", "n", "good", "bad", F.concat("template", F.slice("rest", F.lit(1), common)).alias("template"))


def templates(shapes: DataFrame, most_children: int = MOST_CHILDREN, least_share: float = LEAST_SHARE, keep_z: float = KEEP_Z,
              keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(host, shape, template) for counted shapes (host, shape, n, good, bad): wildcards node by node; ``keep`` writes each round."""
    tree = shapes.select("host", "shape", "n", "good", "bad", F.array().cast("array<string>").alias("template"))
    ended = F.size("template") == F.size("shape")
    out = tree.where(ended).select("host", "shape", "template")
    tree = tree.where(~ended)
    while not tree.isEmpty():
        tree = keep(_chains(tree), "chains")
        out = out.unionByName(tree.where(ended).select("host", "shape", "template"))
        tree = tree.where(~ended)
        segment = F.get("shape", F.size("template"))
        node = tree.groupBy(F.col("host").alias("h"), F.col("template").alias("t"), segment.alias("s")).agg(
            F.sum("n").alias("k"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        whole = node.groupBy(F.col("h").alias("wh"), F.col("t").alias("wt")).agg(F.sum("k").alias("all"))
        node = node.join(whole, (F.col("h") == F.col("wh")) & (F.col("t") == F.col("wt"))).drop("wh", "wt")
        # a node has at most 1 / least_share children of that share, so the window over them is small at any size
        large = node.where(F.col("k") >= least_share * F.col("all"))
        place = F.row_number().over(Window.partitionBy("h", "t").orderBy(F.desc("k"), "s"))
        large = large.withColumn("place", place).where(F.col("place") <= most_children).select("h", "t", "s")
        small = node.join(large, ["h", "t", "s"], "left_anti").where("good + bad > 0").withColumn("kind", kind_of(F.col("s")))
        pool = small.groupBy("h", "t", "kind").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        apart = _differ(F.col("good"), F.col("bad"), F.col("g") - F.col("good"), F.col("b") - F.col("bad"), keep_z)
        kept = large.unionByName(small.join(pool, ["h", "t", "kind"]).where(apart).select("h", "t", "s"))
        step = tree.join(kept, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (segment == F.col("s")), "left")
        own = F.when(F.col("s").isNotNull(), segment).otherwise(kind_of(segment))
        tree = keep(step.select("host", "shape", "n", "good", "bad", F.concat("template", F.array(own)).alias("template")), "tree")
        out = out.unionByName(tree.where(ended).select("host", "shape", "template"))
        tree = tree.where(~ended)
    return out


def _groups(z: float):
    """Number the groups of alike siblings, which come in order of their shares: each is tested against its whole group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, good, bad = None, 0, 0, 0
        for batch in batches:
            out = []
            for *parent, g, b in zip(*(batch.column(c).to_pylist() for c in ("host", "parent", "length", "good", "bad"))):
                if parent != at:
                    at, number, good, bad = parent, 0, g, b
                elif not g + b or not good + bad:
                    number, good, bad = number + (g + b > 0), g, b
                else:
                    n, m = g + b, good + bad
                    share = (g + good) / (n + m)
                    gap = abs(g / n - good / m) - (1 / n + 1 / m) / 2
                    if gap > 0 and gap > z * math.sqrt(share * (1 - share) * (1 / n + 1 / m)):
                        number, good, bad = number + 1, g, b
                    else:
                        good, bad = good + g, bad + b
                out.append(number)
            keys = ("host", "parent", "length", "template", "good", "bad", "host_share")
            yield pa.record_batch({c: batch.column(c) for c in keys} | {"merged": pa.array(out, pa.int64())})
    return run


def judge(counts: DataFrame, strength: float = STRENGTH, z: float = Z, least_purity: float = LEAST_PURITY) -> DataFrame:
    """(host, template, merged, purity, accept) from (host, template, n, good, bad); merged: number among the siblings."""
    total = counts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    everywhere = ((total.g or 0) + 1) / ((total.g or 0) + (total.b or 0) + 1)
    hosts = counts.groupBy("host").agg(
        ((F.sum("good") + strength * everywhere) / (F.sum(F.col("good") + F.col("bad")) + strength)).alias("host_share"))
    length = F.size("template")
    out = counts.join(hosts, "host").select(
        "host", F.slice("template", F.lit(1), F.greatest(length - 1, F.lit(0))).alias("parent"), length.alias("length"), "template",
        "good", "bad", "host_share")
    known = F.col("good") + F.col("bad")  # those without labels come first and are a group of their own
    share = F.when(known > 0, F.col("good") / known).otherwise(F.lit(-1.0))
    out = out.withColumn("share", share).repartition("host", "parent", "length").sortWithinPartitions("host", "parent", "length", "share", "template")
    out = written(out.drop("share").mapInArrow(
        _groups(z), "host string, parent array<string>, length int, template array<string>, good bigint, bad bigint, host_share double, merged bigint"), "judged")
    group = out.groupBy("host", "parent", "length", "merged").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    purity = (F.col("g") + strength * F.col("host_share")) / (F.col("g") + F.col("b") + strength)
    return out.join(group, ["host", "parent", "length", "merged"]).withColumn("purity", purity).select(
        "host", "template", "merged", "purity", (F.col("purity") >= least_purity).alias("accept"))


def url_verdicts(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity``. labelled: (url, good boolean)."""
    added = ("host", "path", "rule", "verdict", "template", "purity")
    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]
    url = F.col(f"`{url_col}`").cast("string")
    seen = pages.select(host_of(url).alias("host"), shape_of(path_of(url)).alias("shape")).groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    marked = labelled.where("good IS NOT NULL").select(host_of(F.col("url")).alias("host"), shape_of(path_of(F.col("url"))).alias("shape"), "good")
    marked = marked.groupBy("host", "shape").agg(F.sum(F.col("good").cast("int")).alias("good"), F.sum((~F.col("good")).cast("int")).alias("bad"))
    shapes = written(seen.join(marked, ["host", "shape"], "full").select(
        "host", "shape", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "good", "bad"))), "shapes")
    scratch = Scratch(pages.sparkSession)
    tree = written(templates(shapes, keep=scratch.keep).join(shapes, ["host", "shape"]), "templates")
    scratch.drop()
    counted = tree.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "good", "bad")))
    fate = tree.join(judge(counted), ["host", "template"]).select("host", "shape", "template", "purity", "accept")
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"), shape_of(path).alias("shape"))
    out = rows.join(fate, ["host", "shape"], "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_tree = F.when(F.col("accept"), F.lit("allow")).otherwise(F.lit("block"))
    return out.select("row.*", "host", "path", name.alias("rule"), F.coalesce(verdict, by_tree).alias("verdict"),
                      F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
