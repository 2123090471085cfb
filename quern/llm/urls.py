"""URL filter by a tree of path templates for each host, in DataFrame functions only.

Method
    Rules judge the urls that they fit, and these are the labelled urls. Paths are counted by host
    and form (numbers and long hexadecimal runs in segments are already variables then). Going
    down each host's tree, a node's branches become one wildcard if there are many different ones
    for its urls; else branches whose labelled bad shares do not differ by more than a Hoeffding
    bound from that of their siblings together are merged into the wildcard. A template - a path of
    fixed and wildcard segments - is rejected if the share of bad among its labelled urls, smoothed
    towards that of the template above it, reaches ``REJECT``; a host's own share is smoothed towards
    ``PRIOR``. So a template without labelled urls is judged by the nearest one above that has some, and
    a host without any is allowed. Urls that no rule fits get the verdict of their template.

Only counts by (host, form) are shuffled, pre-aggregated. The tree is as deep as the paths; in a path of
more than ``DEPTH`` segments - a trap for crawlers rather than a place - those that remain
are one segment of the tree, so every url is judged and the number of levels is bounded.

Defined results: a null url or one without "://" has an empty host and path and belongs to the
root template of host ""; a null id is carried along; repeated rows count and appear as often as
they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, materialise, read_table

#: (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Deepest level of a tree.
DEPTH = 32
#: A node's branches are variable if there are more than so many, and more than this share of its urls.
BRANCHES, VARIETY = 16, 0.2
#: Confidence of the merge test; labelled urls that a branch needs to take part in it.
CONFIDENCE, LEAST_LABELLED = 0.05, 5
#: Smoothing: pseudo-count and prior share of bad urls; smoothed share from which a template goes.
PSEUDO, PRIOR, REJECT = 4.0, 0.2, 0.75

_WILD = "*"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    chain = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:], r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def form_of(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments, numbers and long hexadecimal runs replaced, the rest after ``depth``
    segments joined to one."""
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F]{16,}", "{x}"), "[0-9]+", "{n}")
    parts = F.split(F.regexp_replace(plain, "^/", ""), "/")
    rest = F.array_join(F.slice(parts, depth, F.greatest(F.size(parts) - depth + 1, F.lit(1))), "/")
    return F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth - 1), F.array(rest)))


def _shares(level: DataFrame) -> DataFrame:
    """``level`` with ``bad_share`` - until here the one above - smoothed by each node's labelled urls."""
    bad, labelled = F.sum("bad"), F.sum("good") + F.sum("bad")
    own = level.groupBy("host", "template").agg(((bad + PSEUDO * F.min("bad_share")) / (labelled + PSEUDO)).alias("own_share"))
    return level.join(own, ["host", "template"]).withColumn("bad_share", F.col("own_share")).drop("own_share")


def templates(forms: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``forms`` (host, form, n, good, bad) with ``template``, the array of its segments or wildcards,
    and the template's smoothed share of bad urls."""
    deepest = forms.agg(F.max(F.size("form"))).first()[0] or 0
    level = _shares(forms.select("host", "form", "n", "good", "bad", F.array().cast("array<string>").alias("template"), F.lit(PRIOR).alias("bad_share")))
    ended = None
    margin = math.log(2 / CONFIDENCE) / 2
    for d in range(min(depth, deepest)):
        # One row for each branch, then one for each node. A hot node's urls are summed before they are shuffled.
        level = level.withColumn("segment", F.try_element_at("form", F.lit(d + 1)))
        branches = level.groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        nodes = branches.groupBy("host", "template").agg(
            F.count("*").alias("branches"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        labelled, others = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
        apart = F.abs(F.col("bad") / labelled - (F.col("all_bad") - F.col("bad")) / others)
        similar = F.when(F.least(labelled, others) >= LEAST_LABELLED, apart <= F.sqrt(margin / labelled) + F.sqrt(margin / others)).otherwise(False)
        variable = (F.col("branches") > BRANCHES) & (F.col("branches") > VARIETY * F.col("all_n"))
        merged = (branches.join(nodes, ["host", "template"]).where(variable | similar)
                  .select("host", "template", "segment", F.lit(_WILD).alias("merged")))
        level = level.join(merged, ["host", "template", "segment"], "left").select(
            "host", "form", "n", "good", "bad", F.concat("template", F.array(F.coalesce("merged", "segment"))).alias("template"), "bad_share")
        level = materialise(_shares(level), f"urls{d}")
        done = level.where(F.size("form") == d + 1)
        ended = done if ended is None else ended.unionByName(done)
        level = level.where(F.size("form") > d + 1)
    return level if ended is None else ended


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, and the template with its smoothed bad share."""
    url = F.col(f"`{url_col}`")
    split = df.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = split.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("form", form_of(F.col("path"), depth))
    count = lambda verdict: F.sum((F.col("ruled.verdict") == verdict).cast("long"))
    forms = ruled.groupBy("host", "form").agg(F.count("*").alias("n"), F.coalesce(count("allow"), F.lit(0)).alias("good"),
                                              F.coalesce(count("block"), F.lit(0)).alias("bad"))
    placed = templates(materialise(forms, "urls"), depth)
    known = placed.select("host", "form", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "bad_share")
    own = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return ruled.join(known, ["host", "form"], "left").select(
        "page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(F.col("ruled.verdict"), own).alias("verdict"), "template", "bad_share")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL: dict[str, str] = {}
