"""A feed of captured pages, audited as it comes: an extra. Rules on single pages need no state.

Each micro-batch is extracted and held against the page rules in one pass; findings are appended, and counts by rule and window of
time can be kept with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules as R
from ..operators import views as V
from ..sources import html as H


def findings(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Findings of page rules on a stream of pages (site_id, final_url, html, status, ...) with a static table of sites."""
    kept = [c for c in pages.columns if c not in ("html", "final_url")]
    docs = H.documents(H.parsed(pages, *kept))
    url = docs if "url" in docs.columns else docs.withColumn("url", F.col("final_url"))
    return R.packed(V.with_views(url.withColumn("is_html", F.lit(True)), sites), "pages")


def appended(pages: DataFrame, sites: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write findings of a stream to Parquet files below `path`."""
    return findings(pages, sites).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Findings by rule and window of event time; those that come too late are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "check_id").agg(F.count(F.lit(1)).alias("n"))
