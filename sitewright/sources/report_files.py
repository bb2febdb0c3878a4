"""JSON reports of sites of any size: sorted fragments, written by many tasks and joined to one file per site.

A report is a relation of fragments: its head, the begin and the end of each rule, a line per finding and per page. They are dealt
out by ranges of their order, written by each task as it reads them, and a site's files are then copied one after another into its
report. No finding is held beside another: memory does not grow with a site. Files are named by the task's attempt that wrote them,
and a report gets its name when it is whole, so a lost executor leaves nothing half done.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import rollups
from ..operators import rules as R
from ..plans.audit import Audit
from .reports import SCHEMA_VERSION, escape_invisible, registry_table
from .tables import kept, shared_dir

ORDER = ("section", "number", "kind", "ord", "url", "severity", "detail")
BLOCK = 1 << 20


def _of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def writable(path: str) -> None:
    """Make the folder and a file in it, so that a run that could not write its reports doesn't begin. A store that only Spark's writers know is left to them."""
    try:
        where, folder = _of(path)
    except (pa.ArrowInvalid, OSError):
        return
    try:
        where.create_dir(folder, recursive=True)
        probe = f"{folder}/.probe-{uuid.uuid4().hex}"
        with where.open_output_stream(probe) as out:
            out.write(b"")
        where.delete_file(probe)
    except (OSError, pa.ArrowException) as error:
        raise ValueError(f"can't write to {path}: {error}") from error


def fragments(a: Audit) -> DataFrame:
    """(site_id, *ORDER, item, text): the pieces of each site's report; between two items that follow each other belongs a comma."""
    none = {"number": F.lit(0), "ord": F.lit(0.0), "url": F.lit(None).cast("string"), "severity": F.lit(""), "detail": F.lit("")}

    def piece(rows: DataFrame, section: int, kind: int, text, item: bool = False, **place) -> DataFrame:
        at = none | place
        return rows.select("site_id", F.lit(section).alias("section"), at["number"].cast("int").alias("number"), F.lit(kind).alias("kind"), at["ord"].cast("double").alias("ord"), at["url"].alias("url"), at["severity"].alias("severity"), at["detail"].alias("detail"), F.lit(item).alias("item"), text.alias("text"))

    json = lambda *columns: escape_invisible(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    inner = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)
    facts = a.facts.select("site_id", "start_url", "origin")
    scope = a.scope if a.scope is not None else facts.select("site_id", F.lit(None).cast("array<struct<label:string,value:string>>").alias("scope"))
    groups = {g: k for k, g in enumerate([*R.GROUPS, "Total"])}
    place = F.create_map(*[x for g, k in groups.items() for x in (F.lit(g), F.lit(k))])[F.col("group")]
    summary = a.summary.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "group", *R.SEVERITIES))), lambda s: F.struct(s["group"].alias("group"), *[s[x].alias(x) for x in R.SEVERITIES])).alias("summary"))
    first = a.fix_first.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("rank", "check_id", "severity", "affected"))).alias("fix_first"))
    head = facts.join(scope, "site_id", "left").join(summary, "site_id", "left").join(first, "site_id", "left").join(rollups.status_counts(a.outcomes), "site_id", "left")
    head = head.withColumn("fix_first", F.coalesce("fix_first", F.array().cast("array<struct<rank:int,check_id:string,severity:string,affected:bigint>>")))
    begin = F.concat(F.lit(f'{{"schema_version":{SCHEMA_VERSION},'), inner(json(*head.columns)), F.lit(',"checks":[\n'))
    titles = F.broadcast(registry_table(a.findings.sparkSession).select("check_id", "title", "heuristic"))
    # a site has as many rules as there are, whatever its size
    checks = kept(a.outcomes.join(titles, "check_id").withColumn("number", F.row_number().over(Window.partitionBy("site_id").orderBy("check_id")) - 1), "report-checks")
    number = {"number": F.col("number")}
    opened = F.concat(F.when(F.col("number") > 0, ",\n").otherwise(""), F.lit("{"), inner(json("check_id", "group", "severity", "title", "heuristic", "status")), F.lit(',"findings":['))
    found = a.findings.join(checks.select("site_id", "check_id", "number"), ["site_id", "check_id"])
    line = F.concat(F.lit("\n"), json("url", "severity", "detail", "evidence"))
    page = F.concat(F.lit("\n"), json("url", "status", *R.SEVERITIES))
    pieces = [
        piece(head, 0, 0, begin), piece(checks, 1, 0, opened, **number), piece(found, 1, 1, line, True, number=F.col("number"), url=F.col("url"), severity=F.col("severity"), detail=F.coalesce("detail", F.lit(""))),
        piece(checks, 1, 2, F.lit("]}"), **number), piece(head, 2, 0, F.lit('],\n"pages":[')), piece(a.page_counts, 2, 1, page, True, ord=F.col("ord"), url=F.col("url")), piece(head, 3, 0, F.lit("\n]}\n")),
    ]
    out = pieces[0]
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out


def _writing(folder: str):
    """Sorted fragments -> a file for each site in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _of(folder)
        part, site, out, row = TaskContext.get().partitionId(), None, None, None

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("site_id", pa.string()), ("part", pa.int32()), ("file", pa.string()), ("begins", pa.bool_()), ("ends", pa.bool_())]))

        for batch in batches:
            for own, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if out is None or own != site:
                    if out is not None:
                        yield done()
                    site, file = own, f"{base}/{uuid.uuid4().hex}"
                    out, row = where.open_output_stream(file), {"site_id": own, "part": part, "file": file, "begins": item, "ends": item}
                elif item and row["ends"]:
                    out.write(b",")
                out.write(text.encode())
                row["ends"] = item
        if out is not None:
            yield done()

    return run


def _joining(folder: str, target: str):
    """(site_id, files in their order) -> the site's report, copied block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, (where, base) = _of(folder)[0], _of(target)
        for batch in batches:
            for site, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/site={re.sub(r'[^A-Za-z0-9.-]', '_', site)}"
                where.create_dir(name, recursive=True)
                part, size, item = f"{name}/.{uuid.uuid4().hex}", 0, False
                with where.open_output_stream(part) as out:
                    for f in files:
                        if item and f["begins"]:
                            size += out.write(b",")
                        item = f["ends"]
                        with source.open_input_stream(f["file"]) as read:
                            while block := read.read(BLOCK):
                                size += out.write(block)
                where.move(part, f"{name}/report.json")
                yield pa.RecordBatch.from_pydict({"site_id": [site], "file": [f"{name}/report.json"], "bytes": pa.array([size], pa.int64())})

    return run


def write_json(a: Audit, path: str) -> DataFrame:
    """Write each site's report as `site=.../report.json` below `path`; (site_id, file, bytes) of what was written."""
    writable(path)
    spark = a.findings.sparkSession
    folder = f"{shared_dir(spark)}/sitewright/report-parts-{uuid.uuid4().hex}"
    where, base = _of(folder)
    where.create_dir(base, recursive=True)
    dealt = fragments(a).repartitionByRange("site_id", *ORDER).sortWithinPartitions("site_id", *ORDER).select("site_id", "item", "text")
    parts = kept(dealt.mapInArrow(_writing(folder), "site_id string, part int, file string, begins boolean, ends boolean"), "report-parts")
    by_site = parts.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "file", "begins", "ends"))), lambda p: F.struct(p["file"].alias("file"), p["begins"].alias("begins"), p["ends"].alias("ends"))).alias("files"))
    done = kept(by_site.mapInArrow(_joining(folder, path), "site_id string, file string, bytes long"), "report-files")
    where.delete_dir(base)
    return done
