"""robots.txt as relations: lines become groups of agents and rules, and URLs are decided by a join with the rules.

A file's lines are exploded; a user-agent line after a rule begins a new group, which a running sum numbers. The group that binds
a crawler is that of the longest agent name that begins its token, or else `*`; groups of one name count as one. Of the
rules whose pattern matches a path the longest decides, and Allow wins ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import robots_like

MAX_DELAY_MS = 30_000
MAX_BYTES = 512 * 1024


def readable(text: Column, most: int = MAX_BYTES) -> Column:
    """A file's first `most` bytes, up to the end of a line: a rule that is cut in two could mean something else."""
    cut = F.regexp_replace(F.substring(text.cast("binary"), 1, most).cast("string"), r"[^\r\n]*$", "")
    return F.when(F.octet_length(text) > most, cut).otherwise(text)


def lines(files: DataFrame) -> DataFrame:
    """(site_id, pos, field, value, grp): the fields of robots.txt files (site_id, text), with the number of their group."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    each = files.select("site_id", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    fields = each.where(bare.contains(":")).select("site_id", "pos", F.lower(F.trim(F.split_part(bare, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_replace(bare, "^[^:]*:", "")).alias("value"))
    kept = fields.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))
    order = Window.partitionBy("site_id").orderBy("pos")
    inner = kept.where("field != 'sitemap'").withColumn("new", ((F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")).cast("int"))
    grouped = inner.withColumn("grp", F.sum("new").over(order)).drop("new").where("grp > 0")
    return grouped.unionByName(kept.where("field = 'sitemap'").withColumn("grp", F.lit(None).cast("bigint")))


def parsed(files: DataFrame) -> DataFrame:
    """(site_id, agent, pos, field, value) of every rule, once per agent of its group; sitemap lines have no agent."""
    rows = lines(files)
    agents = rows.where("field = 'user-agent'").select("site_id", "grp", F.lower("value").alias("agent")).distinct()
    rules = rows.where("field not in ('user-agent', 'sitemap')").join(agents, ["site_id", "grp"]).select("site_id", "agent", "pos", "field", "value")
    empty = agents.select("site_id", "agent", F.lit(-1).alias("pos"), F.lit("group").alias("field"), F.lit("").alias("value")).distinct()
    maps = rows.where("field = 'sitemap'").select("site_id", F.lit(None).cast("string").alias("agent"), "pos", "field", "value")
    return rules.unionByName(empty).unionByName(maps)


def binding(rules: DataFrame, token: str) -> DataFrame:
    """The rules of the group that binds a crawler."""
    named = rules.where(F.col("agent").isNotNull())
    fits = (F.col("agent") == "*") | F.startswith(F.lit(token.lower()), F.col("agent"))
    best = named.where(fits & (F.col("agent") != "")).groupBy("site_id").agg(F.max_by("agent", F.struct((F.col("agent") != "*").alias("named"), F.length("agent").alias("n"))).alias("agent"))
    return named.join(best, ["site_id", "agent"], "left_semi")


def decisions(urls: DataFrame, rules: DataFrame, token: str) -> DataFrame:
    """The rows of `urls` (site_id, path, ...) with `allowed`. Rules join on the site, so each path meets its own site's only."""
    bound = binding(rules, token).where("field in ('allow', 'disallow') and value != ''")
    patterns = F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("by"), (F.col("field") == "disallow").alias("denies"), robots_like(F.col("value")).alias("like"))))
    by_site = bound.groupBy("site_id").agg(patterns.alias("rules"))
    # a site's rules are one file of at most 512 KB: they travel as one sorted list, of which the first match decides
    first = F.get(F.filter("rules", lambda r: F.like(F.col("path"), r["like"])), F.lit(0))
    return urls.join(by_site, "site_id", "left").withColumn("allowed", F.coalesce(~first["denies"], F.lit(True))).drop("rules")


def crawl_delays(rules: DataFrame, token: str) -> DataFrame:
    """(site_id, delay_ms, clamped): the first valid Crawl-delay of the group that binds a crawler."""
    valid = binding(rules, token).where((F.col("field") == "crawl-delay") & F.col("value").rlike(r"^\d+(\.\d+)?$"))
    first = valid.groupBy("site_id").agg(F.min_by("value", "pos").cast("double").alias("s"))
    ms = F.round(F.col("s") * 1000)
    return first.select("site_id", F.least(ms, F.lit(MAX_DELAY_MS)).cast("bigint").alias("delay_ms"), (ms > MAX_DELAY_MS).alias("clamped"))


def disallow_all(rules: DataFrame) -> DataFrame:
    """(site_id, disallow_all): the group of all crawlers disallows / and allows nothing."""
    star = rules.where("agent = '*'")
    return star.groupBy("site_id").agg((F.bool_or((F.col("field") == "disallow") & (F.col("value") == "/")) & ~F.bool_or((F.col("field") == "allow") & (F.col("value") != ""))).alias("disallow_all"))


def sitemaps(rules: DataFrame) -> DataFrame:
    """(site_id, pos, url) of Sitemap lines."""
    return rules.where("field = 'sitemap' and value != ''").select("site_id", "pos", F.col("value").alias("url"))


def states(files: DataFrame, token: str) -> DataFrame:
    """(site_id, present, unreadable): what fetching robots.txt (site_id, status, failure, text) means. Server errors and failures forbid a crawl."""
    ok = F.col("status").between(200, 299)
    return files.select("site_id", F.coalesce(ok, F.lit(False)).alias("present"), (F.col("failure").isNotNull() | F.coalesce(F.col("status") >= 500, F.lit(False))).alias("unreadable"))
