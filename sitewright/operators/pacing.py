"""When requests to a host may start: batch renditions of a gate that keeps a gap, and of retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def starts(requests: DataFrame, gap_ms: int | Column) -> DataFrame:
    """requests (host, request, arrive_ms) with start_ms: in order of arrival, each `gap_ms` after the one before it at least.

    start_j = max over i <= j of (arrive_i + (j - i) * gap), so one running maximum per host is all that is needed.
    """
    gap = F.lit(gap_ms) if isinstance(gap_ms, int) else gap_ms
    order = Window.partitionBy("host").orderBy("arrive_ms", "request")
    place = F.row_number().over(order)
    numbered = requests.withColumn("_place", place)
    latest = F.max(F.col("arrive_ms") - F.col("_place") * gap).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start_ms", (F.col("_place") * gap + latest).cast("bigint")).drop("_place")


def bounded_starts(requests: DataFrame, gap_ms: int, in_flight: int) -> DataFrame:
    """(host, request, start_ms, end_ms): as `starts`, with at most `in_flight` requests of a host open at once.

    requests has took_ms too. A host's requests are folded in order of arrival, with the ends of those that are open as state.
    """
    rows = requests.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("arrive_ms", "request", "took_ms"))).alias("rows"))
    zero = F.struct(F.lit(-(1 << 60)).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("open"), F.array().cast("array<struct<request:bigint,start_ms:bigint,end_ms:bigint>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        free = F.when(F.size(s["open"]) < in_flight, F.lit(-(1 << 60)).cast("bigint")).otherwise(F.element_at(s["open"], 1))
        start = F.greatest(r["arrive_ms"], s["last"] + gap_ms, free)
        end = start + r["took_ms"]
        kept = F.when(F.size(s["open"]) < in_flight, s["open"]).otherwise(F.slice(s["open"], 2, 1 << 20))
        return F.struct(start.alias("last"), F.array_sort(F.concat(kept, F.array(end))).alias("open"), F.concat(s["out"], F.array(F.struct(r["request"].cast("bigint").alias("request"), start.alias("start_ms"), end.alias("end_ms")))).alias("out"))

    return rows.select("host", F.inline(F.aggregate("rows", zero, step, lambda s: s["out"])))


def final_attempts(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """(url, status, attempts, throttled): the first attempt that isn't throttled, or else the last; `attempts` has url, n, status.

    `throttled` says that every attempt was, after which a host's gap is doubled.
    """
    used = attempts.where(F.col("n") <= retries + 1)
    throttled = F.coalesce(F.col("status").isin(429, 503), F.lit(False))
    return used.groupBy("url").agg(F.coalesce(F.min_by("status", F.when(~throttled, F.col("n"))), F.max_by("status", "n")).alias("status"), F.coalesce(F.min(F.when(~throttled, F.col("n"))), F.max("n")).alias("attempts"), F.bool_and(throttled).alias("throttled"))


def doubled_gap(gap_ms: Column) -> Column:
    """The gap after a host throttled all attempts: twice as long, a second at least."""
    return F.greatest(gap_ms * 2, F.lit(1000))
