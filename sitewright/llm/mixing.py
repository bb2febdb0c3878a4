"""Mixing sources to target weights, by hash-threshold histograms.

Sizes are summed by source and by the leading bits of a hash of doc_id. In the cumulative histogram of a source, every
bucket below its budget is taken whole and only the bucket that crosses the budget is looked at again, by the next bits,
until the hash is used up: then one threshold per source says which documents are taken once more. Thresholds are nested:
a larger budget takes a superset. Nothing is sorted but histograms.

Defined cases: a null or blank text has size 0, a null source is a source of its own and comes last, a null doc_id hashes
as the empty text, rows with the same doc_id share a hash and so a decision, an empty table gives no rows, and columns
other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, n_words

HASH_BITS = 60
LEVEL_BITS = 12


def doc_hash(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size) -> plus target: `share` of the whole split by weight, at most `cap` sizes each, excess reshared.

    Sources ordered by cap / weight reach their caps one after another as the level rises, so the level at which the
    budget is spent follows from running sums. One row per source goes through these windows, no document does.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * share - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_weight").over(after)
    ranked = by_source.withColumn("_weight", weight).withColumn("_ratio", cap * F.col("source_size") / F.col("_weight")).withColumn("_level", level)
    first = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(Window.partitionBy())
    top = first["_level"]
    return ranked.withColumn("target", F.when(top.isNull(), 1.0 * cap * F.col("source_size")).otherwise(F.least(1.0 * cap * F.col("source_size"), top * F.col("_weight")))).select("source", "source_size", "target")


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: the words the mix takes of every document, repeats counted."""
    sizes = Written(documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("_hash")), "mix-sizes").df
    totals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = Written(totals.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")), "mix-plan")
    for left in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        plan = Written(_refined(sizes, plan.df, left), "mix-plan")
    chosen = plan.df.select(F.col("source").alias("_source"), "source_size", "target", "times", F.col("prefix").alias("_limit"))
    taken = F.col("size") * (F.col("times") + (F.col("_hash") < F.col("_limit")).cast("int"))
    return sizes.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def _refined(sizes: DataFrame, plan: DataFrame, left: int) -> DataFrame:
    """Find in each source the bucket that crosses its need; `left` bits of the hash remain below it.

    `prefix` is the bits decided so far. At the last level it becomes the limit: the crossing bucket itself, or the one
    after it when that comes nearer to the need.
    """
    keys = plan.select(F.col("source").alias("_source"), "need", F.col("prefix").alias("_prefix"))
    bits = F.shiftright("_hash", left)
    inside = sizes.join(keys, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("_hash", left + LEVEL_BITS) == F.col("_prefix")))
    histogram = inside.groupBy("source", "need", bits.alias("bucket")).agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("bucket")
    upto = histogram.withColumn("upto", F.sum("size").over(running))
    crossing = upto.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min_by(F.struct("bucket", "size", "upto"), "bucket").alias("at"))
    at = crossing.select(F.col("source").alias("_at"), "at")
    joined = plan.join(at, F.col("source").eqNullSafe(F.col("_at")), "left")
    below = F.col("at.upto") - F.col("at.size")
    rest = F.when(F.col("at").isNotNull(), F.col("need") - below).otherwise(F.col("need"))
    # no bucket crosses: nothing is left to refine, and the next prefix takes in all that is here
    nxt = F.when(F.col("at").isNotNull(), F.col("at.bucket")).otherwise(F.shiftleft(F.col("prefix") + 1, LEVEL_BITS))
    if left == 0:
        nxt = F.when(F.col("at").isNotNull() & (F.col("at.upto") - F.col("need") < F.col("need") - below), nxt + 1).otherwise(nxt)
    return joined.select("source", "source_size", "target", "times", rest.alias("need"), nxt.cast("long").alias("prefix"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources),
levels AS (
  SELECT *, 2 * source_size / weight AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE - 2 * coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
top AS (SELECT first(level ORDER BY ratio) AS level FROM levels WHERE ratio >= level),
aimed AS (
  SELECT source, source_size, CASE WHEN top.level IS NULL THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, top.level * weight) END AS target
  FROM levels, top),
needed AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM aimed),
grouped AS (
  SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
summed AS (
  SELECT g.*, n.target - n.times * n.source_size AS need, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM grouped g JOIN needed n ON g.source IS NOT DISTINCT FROM n.source),
crossing AS (
  SELECT source, first(CASE WHEN upto - need < need - (upto - size) THEN h + 1 ELSE h END ORDER BY h) AS lim
  FROM summed WHERE upto > need GROUP BY source)
SELECT s.doc_id, s.size, s.source, n.source_size, n.target,
       CAST(s.size * (n.times + CASE WHEN c.lim IS NULL OR s.h < c.lim THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN needed n ON s.source IS NOT DISTINCT FROM n.source
LEFT JOIN crossing c ON s.source IS NOT DISTINCT FROM c.source
"""
