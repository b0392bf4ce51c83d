"""Sources that come in pages, by a fetch function that is handed in; several are taken over together or not at all.

A Python data source deals page numbers to tasks in strides: task k of n reads pages k, k + n and so on until it meets an
empty one. Rows are kept as JSON with their page and place, so that what they hold is looked at by Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from clausewright.operators.joins import per_field_last
from clausewright.sources.writers import publish

#: Gives the rows of a page, counted from 1; an empty list ends the source.
Fetch = Callable[[int], Sequence[dict]]
SCHEMA = "page long, pos int, row string"


class SourceFailed(RuntimeError):
    """Which source failed, and where."""


class _Stride(InputPartition):
    def __init__(self, first: int):
        self.first = first


def source(name: str, fetch: Fetch, strides: int) -> type[DataSource]:
    """A data source class over ``fetch``, which travels to the tasks with it."""

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [_Stride(k + 1) for k in range(strides)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            page = partition.first
            while True:
                try:
                    rows = fetch(page)
                except Exception as e:
                    raise SourceFailed(f"source {name} failed on page {page}: {e}") from e
                if not rows:
                    return
                for pos, row in enumerate(rows):
                    yield page, pos, json.dumps(row, ensure_ascii=False)
                page += strides

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"paged_{name}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

    return Paged


def pages(spark: SparkSession, name: str, fetch: Fetch, strides: int = 4) -> DataFrame:
    """page, pos, row (JSON) of all rows of all pages up to the first empty one."""
    spark.dataSource.register(source(name, fetch, strides))
    return spark.read.format(f"paged_{name}").load()


def take(spark: SparkSession, sources: Mapping[str, Fetch], folder: str, now: str, offline: bool = False, strides: int = 4) -> dict[str, DataFrame]:
    """The rows of each source, as they are stored in ``folder``.

    All sources are read first; only then do all of them, and ``downloaded_at`` with ``now``, take the place of what was stored. If one
    fails nothing changes and the error names it. ``offline`` reads what is stored; a source that is not is an error that names it.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = lambda p: (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)
    if offline:
        missing = [n for n in sources if not there(f"{folder}/{n}")]
        if missing:
            raise SourceFailed(f"offline, and not stored: {', '.join(missing)}")
    else:
        run = uuid.uuid4().hex
        staged = {}
        try:
            for name, fetch in sources.items():
                at = f"{folder}/_{name}-{run}"
                staged[at] = f"{folder}/{name}"
                try:
                    pages(spark, name, fetch, strides).write.parquet(at)
                except Exception as e:
                    raise SourceFailed(f"source {name} failed: {e}") from e
            stamp = f"{folder}/_downloaded_at-{run}"
            staged[stamp] = f"{folder}/downloaded_at"
            spark.range(1).select(F.lit(json.dumps({"downloaded_at": now})).alias("value")).coalesce(1).write.text(stamp)
        except Exception:
            for at in staged:
                where = jvm.org.apache.hadoop.fs.Path(at)
                where.getFileSystem(conf).delete(where, True)
            raise
        publish(spark, staged)
    return {n: spark.read.schema(SCHEMA).parquet(f"{folder}/{n}") for n in sources}


def downloaded_at(spark: SparkSession, folder: str) -> str | None:
    """When all sources were last taken over; None where they never were."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/downloaded_at")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(f"{folder}/downloaded_at").head()["value"])["downloaded_at"]


def _value(path: str) -> Column:
    return F.get_json_object("row", path)


def numbered(rows: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """id and ``fields`` ({name: JSON path}) of rows whose key is a number: each field the last one that is set, rows without any left out."""
    ident = _value(key)
    found = rows.where(ident.rlike(r"\A[0-9]+\z")).select(ident.cast("long").alias("id"), "page", "pos", *(F.nullif(_value(p), F.lit("")).alias(n) for n, p in fields.items()))
    found = found.where(F.coalesce(*fields).isNotNull())
    return per_field_last(found, ["id"], [F.col("page"), F.col("pos")], list(fields))


def with_value(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """id and ``name`` of the rows that have a value at a JSON path, such as that of the first of a list; the last one of an id."""
    found = rows.select(_value(key).cast("long").alias("id"), "page", "pos", _value(value).alias(name)).where(F.col("id").isNotNull() & F.col(name).isNotNull())
    return found.groupBy("id").agg(F.max_by(name, F.struct("page", "pos")).alias(name))


def by_format(rows: DataFrame, key: str, values: Mapping[str, str]) -> DataFrame:
    """id, format, value of the formats ({name: JSON path}) that a row has a value of, in one pass."""
    each = F.array(*(F.struct(F.lit(n).alias("format"), F.nullif(_value(p), F.lit("")).alias("value")) for n, p in values.items()))
    found = rows.select(_value(key).cast("long").alias("id"), "page", "pos", F.explode(each).alias("x")).where("x.value IS NOT NULL AND id IS NOT NULL")
    return found.groupBy("id", "x.format").agg(F.max_by("x.value", F.struct("page", "pos")).alias("value"))
