"""Orders of results: the domain order of seven levels, single keys with nulls last, and pages."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewright.functions.vocab import ATTR, CAT, RACE, SUB_M, SUB_S, SUB_T
from clausewright.plans.lineage import checkpoint_path, checkpointed

#: Sort keys with the direction that they begin with; the domain order has none.
KEYS = {"dom": "", "atk": "desc", "df": "desc", "lv": "desc", "n": "asc", "id": "asc"}
#: Page sizes on offer.
PAGE_SIZES = (50, 100, 200, 500)
FRAMES = tuple(c for c in SUB_M.groups[0][1] if c != "pendulum")


def sort_of(key: str | None, direction: str | None = None) -> tuple[str, str]:
    """A valid (key, direction): an unknown key is the domain order, a bad direction the key's own."""
    key = key if key in KEYS else "dom"
    return key, (direction if direction in ("asc", "desc") else KEYS[key]) if KEYS[key] else ""


def level_of(level: Column, link: Column) -> Column:
    return F.coalesce(link, level, F.lit(-1))


def frame_rank(cat: Column, subs: Column) -> Column:
    """The last declared frame that an entity has; pendulum is no frame."""
    return F.when(cat == "m", SUB_M.last_rank(subs, FRAMES)).when(cat == "s", SUB_S.last_rank(subs)).when(cat == "t", SUB_T.last_rank(subs)).otherwise(len(FRAMES))


def domain_key() -> list[Column]:
    """Category, frame, pendulum last, level from high to low, attribute, race, id: all ascending."""
    pendulum = F.coalesce(F.array_contains("subs", "pendulum"), F.lit(False)).cast("int")
    return [CAT.rank(F.col("cat")), frame_rank(F.col("cat"), F.col("subs")), pendulum, -level_of(F.col("level"), F.col("link")), ATTR.rank(F.col("attr")), RACE.rank(F.col("race")), F.col("id")]


def known(value: Column) -> Column:
    """A statistic without the unknown ones."""
    return F.when(value >= 0, value)


def sort_value(key: str) -> Column:
    return {"atk": known(F.col("atk")), "df": known(F.col("def")), "lv": F.col("level"), "n": F.col("name_zh"), "id": F.col("id")}[key]


def ordering(key: str | None = "dom", direction: str | None = None) -> list[Column]:
    """Sort columns: nulls last in either direction, ties by the domain order."""
    key, direction = sort_of(key, direction)
    if key == "dom":
        return domain_key()
    value = sort_value(key)
    return [value.desc_nulls_last() if direction == "desc" else value.asc_nulls_last(), *domain_key()]


def sort(found: DataFrame, key: str | None = "dom", direction: str | None = None) -> DataFrame:
    return found.orderBy(*ordering(key, direction))


def pages(total: int, size: int) -> int:
    return max(1, -(-total // size))


#: Rows up to the end of a page that are found by a top-k; later pages are sought in sorted parts.
TOP = 10_000


def page(found: DataFrame, number: int, size: int, key: str | None = "dom", direction: str | None = None) -> DataFrame:
    """One page; a number out of bounds is the nearest page. An early page is a top-k in each task, a later one is read from the parts of a range sort that hold it."""
    number = min(max(1, number), pages(found.count(), size))
    if number * size > TOP:
        return Sorted.of(found, *ordering(key, direction)).page(number, size)
    return sort(found, key, direction).offset((number - 1) * size).limit(size)


@dataclass(frozen=True)
class Sorted:
    """Rows in a total order, stored in the parts of one range sort; ``counts``: rows of each part, as many numbers as there are parts."""

    spark: SparkSession
    path: str
    counts: dict[int, int]
    schema: StructType

    @classmethod
    def of(cls, found: DataFrame, *order: Column) -> Sorted:
        """Sorts once and writes to the checkpoint folder, in a folder a part, with each row's place in its part."""
        path = f"{checkpoint_path(found.sparkSession)}/sorted-{uuid.uuid4().hex}"
        at = F.monotonically_increasing_id()
        rows = found.orderBy(*order).withColumn("_at", at)
        rows = rows.withColumns({"_place": F.col("_at").bitwiseAND(2**33 - 1), "_part": F.shiftright("_at", 33)}).drop("_at")
        rows.write.partitionBy("_part").parquet(path)
        counts = cls(found.sparkSession, path, {}, rows.schema).stored().groupBy("_part").agg(F.count("*").alias("n")).collect()
        return cls(found.sparkSession, path, {r["_part"]: r["n"] for r in counts}, rows.schema)

    def stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def total(self) -> int:
        return sum(self.counts.values())

    def rows(self, first: int, last: int) -> DataFrame:
        """Rows ``first`` to ``last`` - 1, in order, from the parts that hold them."""
        low, wanted = 0, []
        for part, n in sorted(self.counts.items()):
            a, b = max(first - low, 0), min(last - low, n)
            wanted += [(F.col("_part") == part) & (F.col("_place") >= a) & (F.col("_place") < b)] if a < b else []
            low += n
        held = self.stored().where(reduce(lambda x, y: x | y, wanted) if wanted else F.lit(False))
        return held.orderBy("_part", "_place").drop("_part", "_place")

    def page(self, number: int, size: int) -> DataFrame:
        """A page; a number out of bounds is the nearest one."""
        number = min(max(1, number), pages(self.total, size))
        return self.rows((number - 1) * size, number * size)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows with their place from 1: one range sort, whose parts are checkpointed with the places in them, and what the parts before hold added up; no task sees more than a part."""
    cut = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))  # part << 33 | place in it
    part = F.shiftright("_at", 33)
    sizes = cut.groupBy(part.alias("_part")).agg((F.max(F.col("_at").bitwiseAND(2**33 - 1)) + 1).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a part
    return cut.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_at").bitwiseAND(2**33 - 1) + F.col("_before") + 1).drop("_part", "_at", "_before")


def page_numbers(count: int, current: int, width: int = 2) -> list[int | None]:
    """Pages to show: the first and last ``width`` and those around the current one; None for a gap."""
    if count <= 1:
        return []
    out: list[int | None] = []
    last = 0
    for p in (p for p in range(1, count + 1) if p <= width or p > count - width or abs(p - current) <= width):
        out += [None, p] if p - last > 1 else [p]
        last = p
    return out
