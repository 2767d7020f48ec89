"""URL verdicts from host rules and a tree of path templates.

Rules label the urls they fit. For each host the distinct paths form a tree: level by level,
segments with little support become wildcards, and literal siblings whose labelled block
rates do not differ significantly become one branch. The tree grows until no branch can split:
its paths go on alike, or it has too few urls for a literal segment. A template is rejected when its block
rate, smoothed towards its parent's and at the top towards that of the same first segment
over all hosts, reaches ``REJECT_AT``. Urls without a rule get the verdict of their template.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inductra.llm.common import store

#: A segment stays literal with at least so many urls, however many its parent has.
MIN_URLS = 3
#: Siblings differ if their block rates are this many standard errors from what they have in common.
DIFFERENT = 1.96
#: Weight of the parent's rate, in labelled urls.
WEIGHT = 2.0
REJECT_AT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty without a scheme mark or for a missing url."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits host and path, as a struct (name, verdict); null if none."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(
            found
        )
    return found


def _branches(counts: DataFrame) -> DataFrame:
    """(host, template, segment, name): labelled siblings by branch, ``name`` the branch's smallest segment.

    All siblings start as one branch. A branch gives off those that lie significantly above or
    below its pooled block rate, for its number of siblings; without such ones it splits at that
    rate if the rates of all differ more than chance lets them. What remains whole is a branch.
    Rounds are sums per branch, so a parent can have any number of segments.
    """
    keys = ["host", "template", "branch"]
    rows = counts.select("host", "template", "segment", "labelled", "blocked", F.lit("").alias("branch"))
    done = []
    while True:
        pools = rows.groupBy(*keys).agg(
            F.sum("blocked").alias("b"), F.sum("labelled").alias("n"), F.count(F.lit(1)).alias("siblings")
        )
        p = (F.col("b") + 1) / (F.col("n") + 2)
        pools = pools.select(*keys, "siblings", p.alias("p"), (p * (1 - p)).alias("pq"))
        spread = F.col("labelled") * F.col("pq")
        off = F.col("blocked") - F.col("labelled") * F.col("p")
        far = (F.abs(off) - 0.5) / F.sqrt(spread) > F.sqrt(F.lit(DIFFERENT**2) + 2 * F.log("siblings"))
        rows = rows.join(pools, keys).withColumns({"off": off, "far": far & (F.col("siblings") > 1)})
        sums = rows.groupBy(*keys).agg(
            F.max("far").alias("any_far"),
            F.sum(F.col("off") * F.col("off") / spread).alias("chi"),
            F.sum(2 + (1 - 6 * F.col("pq")) / spread).alias("variance"),
            F.count(F.lit(1)).alias("k"),
        )
        error = F.sqrt(F.greatest("variance", 2 * (F.col("k") - 1)))
        mixed = (F.col("k") > 1) & ~F.col("any_far") & (F.col("chi") - (F.col("k") - 1) > DIFFERENT * error)
        side = F.when(F.col("off") > 0, "h").otherwise("l")
        part = F.when(F.col("any_far"), F.when(F.col("far"), side).otherwise("m")).when(F.col("mixed"), side)
        judged = rows.join(sums.select(*keys, "any_far", mixed.alias("mixed")), keys)
        rows = judged.select("host", "template", "segment", "labelled", "blocked", "branch", part.alias("part"))
        rows = store(rows, "url-branches")
        whole = rows.where("part IS NULL").drop("part")
        first = F.min("segment").alias("name")
        done.append(whole.join(whole.groupBy(*keys).agg(first), keys).select("host", "template", "segment", "name"))
        rows = rows.where("part IS NOT NULL").withColumn("branch", F.concat("branch", "part")).drop("part")
        if rows.isEmpty():
            return store(reduce(DataFrame.unionByName, done), "url-names")


def _level(paths: DataFrame) -> DataFrame:
    """Move one segment of every distinct path from ``rest`` to ``template``, literal, merged or wildcard.

    A level ends where the path ends. Counting comes before any shuffle of paths, so a host
    with most of the urls is combined on the map side; the join's hot keys can be split.
    """
    segment = F.when(F.size("rest") > 0, F.element_at("rest", 1))
    paths = paths.withColumn("segment", segment)
    sums = [F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]
    counts = paths.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums)
    literal = store(counts.where(F.col("urls") >= MIN_URLS), "url-literals")
    alone = literal.where("labelled = 0").select("host", "template", "segment", F.col("segment").alias("name"))
    names = alone.unionByName(_branches(literal.where("labelled > 0")))
    named = paths.join(names, ["host", "template", "segment"], "left")
    step = F.when(F.col("segment").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("/"), F.coalesce("name", F.lit("*")))
    )
    named = named.withColumns({"template": F.concat("template", step), "rest": F.expr("slice(rest, 2, size(rest))")})
    return named.drop("segment", "name")


def _rated(paths: DataFrame) -> DataFrame:
    """Paths with the rate of their branch, smoothed towards ``rate``, and whether it is ``open``.

    The segments with which all paths of a branch go on become part of its template at once. A
    branch is open if its paths differ behind them and one segment may have enough urls.
    """
    keys = ["host", "template"]
    branches = paths.groupBy(*keys).agg(
        F.sum("urls").alias("n_urls"),
        ((F.sum("blocked") + WEIGHT * F.max("rate")) / (F.sum("labelled") + WEIGHT)).alias("rate"),
        F.min("rest").alias("low"),
        F.max("rest").alias("high"),
    )
    # What the smallest and the largest list begin with, all lists between begin with.
    differ = "filter(zip_with(low, high, (x, y) -> NOT x <=> y), x -> x)"
    alike = F.expr(
        f"CASE WHEN n_urls < {MIN_URLS} THEN 0 WHEN size({differ}) = 0 THEN size(low)"
        " ELSE array_position(zip_with(low, high, (x, y) -> NOT x <=> y), true) - 1 END"
    ).cast("int")
    is_open = (F.col("n_urls") >= MIN_URLS) & (F.col("low") != F.col("high"))
    branches = branches.select(*keys, "rate", is_open.alias("open"), alike.alias("alike"))
    joined = paths.drop("rate").join(branches, keys)
    more = F.expr("array_join(transform(slice(rest, 1, alike), x -> concat('/', x)), '')")
    rest = F.expr("slice(rest, alike + 1, size(rest))")
    return joined.withColumns({"template": F.concat("template", more), "rest": rest}).drop("alike")


def templates(labelled: DataFrame) -> DataFrame:
    """Distinct (host, path) with their template and its smoothed block rate.

    ``labelled`` has host, path and ``blocked`` (1, 0, or null without a label).
    """
    paths = labelled.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("urls"), F.count("blocked").alias("labelled"), F.sum("blocked").alias("blocked")
    )
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = paths.select(
        "host", "path", segments.alias("rest"), F.lit("").alias("template"),
        "urls", "labelled", F.coalesce("blocked", F.lit(0)).alias("blocked"),
    )
    grown = store(_level(paths), "url-templates")
    overall = grown.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).first()
    prior = ((overall["b"] or 0) + 1) / ((overall["n"] or 0) + 2)
    first = grown.groupBy("template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
    top = first.select("template", ((F.col("b") + F.lit(WEIGHT * prior)) / (F.col("n") + WEIGHT)).alias("rate"))
    grown = store(_rated(grown.join(top, "template")), "url-templates")
    done = []
    while True:
        done.append(grown.where("NOT open").select("host", "path", "template", "rate"))
        grown = grown.where("open").drop("open")
        if grown.isEmpty():
            return reduce(DataFrame.unionByName, done)
        grown = store(_rated(store(_level(grown), "url-templates")), "url-templates")


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", row_id: str = "page_id") -> DataFrame:
    """(row id, host, path, rule, verdict, template) for every row.

    The verdict is the rule's where one fits, else ``block`` if the template's smoothed block
    rate reaches ``REJECT_AT`` and ``allow`` below it. Missing urls and urls without a scheme
    mark have an empty host and path, and share the template of the empty path. Repeated rows
    each get a row and count each. An empty table gives no rows. The list of rules is a
    parameter and becomes part of the plan.
    """
    rows = df.select(F.col(row_id).alias("row_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = store(rows, "url-rows").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.when(F.col("found.verdict") == "block", 1).when(F.col("found").isNotNull(), 0)
    learned = templates(rows.select("host", "path", blocked.alias("blocked")))
    learned = learned.select(F.col("host").alias("h"), F.col("path").alias("p"), "template", "rate")
    judged = rows.join(learned, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("rate") >= REJECT_AT, "block").otherwise("allow"))
    return judged.select(
        F.col("row_id").alias(row_id), "host", "path", F.col("found.name").alias("rule"), verdict.alias("verdict"), "template"
    )
