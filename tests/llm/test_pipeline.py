"""The pipeline: what each stage keeps, against the operators' own results and brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitewright.llm import mixing

from .helpers import SCHEMA, documents
from .test_pairs import classes
from .test_single import exact


def test_stages_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns and 0 < len(rows) <= before
        before = len(rows)
        kept.append([(r.doc_id, r.text) for r in rows])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = [i for i, t in labels.items() if i not in dict(kept[0])]
    assert sum(labels[i] for i in gone) >= 0.6 * len(gone)
    _, root = classes(kept[0])
    assert sorted(i for i, _ in kept[1]) == sorted(i for i in root if root[i] == i)
    assert [i for i, _ in kept[2]] and sorted(i for i, _ in kept[2]) == sorted(i for i, _ in kept[1])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in kept[3]) == sorted(e[0] for e in exact(kept[2], bench) if not e[5])
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert mixed.count() == len(kept[3]) and mixed.where(F.col("taken") > 2 * F.col("size")).count() == 0
    assert mixed.columns == mixing.mix(docs).columns


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, k):
    """Nulls in every column, blank, short and long texts, repeated rows, and more columns with names that operators use."""
    odd = documents() + [(None, None, None, None, None), (None, None, None, None, None), (None, "", None, None, 0), (None, "no id here", "en", "a", 10), (70, None, None, None, None)]
    names = ("_id", "_tag", "_key", "_spans", "spans", "toxic", "n_words", "component_id", "taken", "size", "bucket", "item_id")
    docs = spark.createDataFrame(odd, SCHEMA).withColumns({n: F.lit("x") for n in names})
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and all(r[n] == "x" for r in rows for n in names)
    before, after = (Counter((r[0], r[1]) for r in x) for x in (odd, ((r.doc_id, r.text) for r in rows) if k < 4 else ()))
    if k in (2, 4):
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd)
    else:
        # whatever a stage rejects, rows without words stay
        assert not after - before and {50, 51, 52, 70, None} <= {i for i, _ in after}
    if k == 1:
        _, root = classes([(r[0], r[1]) for r in odd if r[0] is not None])
        assert {i for i, _ in after} - {None} == {i for i in root if root[i] == i}
    if k == 3:
        assert after == before
    assert stage(spark, docs.where("doc_id = -5"), "/root/testdata/sf0.001").count() == 0
