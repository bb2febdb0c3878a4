"""Lab results: JSON documents of an external page-speed tool, as rows of scores and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Names in the tool's JSON.
SCORES = {"performance": "performance", "accessibility": "accessibility", "best_practices": "best-practices", "seo": "seo"}
METRICS = {"fcp_ms": "first-contentful-paint", "lcp_ms": "largest-contentful-paint", "tbt_ms": "total-blocking-time", "cls": "cumulative-layout-shift", "speed_index_ms": "speed-index"}


def parsed(results: DataFrame) -> DataFrame:
    """(site_id, url, json) -> four scores of 0 to 100, five metrics, version and error; what isn't a number is null."""
    v = F.try_parse_json("json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)

    def score(name: str) -> Column:
        x = get(f'$.categories["{name}"].score', "double")
        return F.when(x.between(0, 1), F.floor(x * 100 + 0.5).cast("int"))

    code, version = get("$.runtimeError.code", "string"), get("$.lighthouseVersion", "string")
    return results.select(
        "site_id",
        "url",
        *[score(n).alias(k) for k, n in SCORES.items()],
        *[F.when(~F.isnan(get(f'$.audits["{n}"].numericValue', "double")), get(f'$.audits["{n}"].numericValue', "double")).alias(k) for k, n in METRICS.items()],
        F.when(version.rlike(r"^[0-9A-Za-z.+-]{1,40}$"), version).alias("version"),
        F.when(v.isNull(), "the result isn't JSON").when(code.rlike("^[A-Z_]{1,60}$") & (code != "NO_ERROR"), code).when(code.isNotNull() & (code != "NO_ERROR"), "unknown error").alias("error"),
    )


def sections(pages: DataFrame) -> DataFrame:
    """(site_id, status, version): ok if any page has a score, else failed; the first version that is named."""
    scored = F.coalesce(*[F.col(k) for k in SCORES]).isNotNull()
    return pages.groupBy("site_id").agg(F.when(F.bool_or(scored), "ok").otherwise("failed").alias("status"), F.min_by("version", F.when(F.col("version").isNotNull(), F.col("url"))).alias("version"))


def chosen(pages: DataFrame, sites: DataFrame, most: int = 3) -> DataFrame:
    """(site_id, url) to run the tool on: the start page, then other pages by their final URL, each once."""
    from pyspark.sql import Window

    own = sites.select("site_id", F.col("start_url").alias("url"), F.lit(-1.0).alias("ord"))
    rows = own.unionByName(pages.where("is_page").select("site_id", F.col("final_url").alias("url"), "ord")).groupBy("site_id", "url").agg(F.min("ord").alias("ord"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("ord", "url"))).where(F.col("k") <= most).select("site_id", "url")


def shown(pages: DataFrame) -> DataFrame:
    """The numbers as reports print them."""
    seconds = lambda c: F.when(F.col(c).isNull(), "-").otherwise(T.seconds(F.col(c)))
    return pages.select("site_id", "url", *[F.coalesce(F.col(k).cast("string"), F.lit("-")).alias(k) for k in SCORES], *[seconds(k).alias(k) for k in METRICS if k != "cls"], F.when(F.col("cls").isNull(), "-").otherwise(T.fixed(F.col("cls"), 2)).alias("cls"))
