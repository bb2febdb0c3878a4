"""What the operators share: intermediate tables, word counts and document keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

#: The white space that separates words, as a trim set and as a Java regular expression class.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"

_scopes: list[list["Written"]] = []


@contextmanager
def scoped() -> Iterator[list["Written"]]:
    """Tables written inside are dropped at the end, but for those taken out of the list."""
    held: list[Written] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.remove(held)
        for table in held:
            table.drop()


@contextmanager
def _cleaned_shuffles(spark: SparkSession):
    """Shuffle files of a finished write are of no more use: let Spark remove them at its end."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Written:
    """A table written to the shared folder: its lineage is cut, and lost executors don't cost it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/sitewright/{name}-{uuid.uuid4().hex}"
        with _cleaned_shuffles(self.spark):
            df.write.parquet(self.path)
        self._schema = df.schema
        if _scopes:
            _scopes[-1].append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files, when nothing that is still to run reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_out(df: DataFrame, name: str) -> DataFrame:
    return Written(df, name).df


def words(text: Column) -> Column:
    """The words of a text, as an array; of a null text, none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE + "+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame hasn't got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id as text, for hold-outs; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
