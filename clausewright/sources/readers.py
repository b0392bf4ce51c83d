"""Sources: SQLite files, JSON maps and documents, pages in a folder; what may be missing has a default."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """In whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """``spark.read.format("sqlite")`` with options path, query, and for a partitioned scan key, low, high, partitions. The file lies where all executors see it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("sqlite needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.names

    def partitions(self) -> Sequence[InputPartition]:
        n = int(self.options.get("partitions", "1"))
        if "key" not in self.options or n < 2:
            return [_Range(None, None)]
        low, high = int(self.options["low"]), int(self.options["high"]) + 1
        cuts = [low + (high - low) * i // n for i in range(1, n)]
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = [f'"{self.options["key"]}" {op} {at}' for op, at in ((">=", partition.low), ("<", partition.high)) if at is not None]
        columns = ", ".join(f'"{n}"' for n in self.names)
        query = f"SELECT {columns} FROM ({self.options['query']})" + (" WHERE " + " AND ".join(where) if where else "")
        connection = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            yield from connection.execute(query)
        finally:
            connection.close()


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).options(path=path, query=query, **options).load()


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """The raw entity rows of a card database: its two tables joined on id."""
    columns = "id, ot, alias, setcode, type, atk, def, level, race, attribute"
    rows = read_sqlite(spark, path, f"SELECT {columns} FROM datas", "id long, ot int, alias long, setcode long, type long, atk int, def int, level long, race long, attribute long")
    return rows.join(read_sqlite(spark, path, 'SELECT id, name, "desc" FROM texts', "id long, name string, desc string"), "id")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return read_sqlite(spark, path, "SELECT id, name FROM texts", "id long, name string")


def read_json_map(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """A JSON object of id strings as rows (key long, value); ``value`` is a type."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("k", "v"))
    return entries.where(F.col("k").rlike(r"\A[0-9]+\z")).select(F.col("k").cast("long").alias(key), F.col("v").alias("value"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_optional(spark: SparkSession, path: str, schema: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` gives; no rows of the schema where the path does not exist."""
    return read() if exists(spark, path) else spark.createDataFrame([], schema)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """cid, html of the files ``<number>.html`` in a folder; other names are passed over."""
    raw = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"\A([0-9]+)\.html\z", 1).alias("cid"), F.col("value").alias("html"))
    return raw.where("cid <> ''").select(F.col("cid").cast("int").alias("cid"), "html")


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """id, cid, seq of all dumps in a folder; seq is the file's name, so the first or last by name can win."""
    schema = "data array<struct<id: long, misc_info: array<struct<konami_id: long>>>>"
    rows = spark.read.schema(schema).json(folder, multiLine=True).select(F.explode("data").alias("d"), F.col("_metadata.file_name").alias("seq"))
    given = F.filter(F.col("d")["misc_info"], lambda m: m["konami_id"].isNotNull())
    return rows.select(F.col("d")["id"].alias("id"), F.get(given, 0)["konami_id"].alias("cid"), "seq").where("cid IS NOT NULL")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, digest: 16 hex digits of each file's content."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))
