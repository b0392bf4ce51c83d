"""A stored search index: entities with their domain rank, clauses bucketed by entity, and postings of three signs.

All three are written once. Entities and clauses are tables in as many buckets by id, so that neither is shuffled where
they meet. What a kind filter sees of a clause (own types hidden, values with their combinations) is stored with it, so all
clause conditions reach the clause table's scan. A keyword asks the postings: rows of (three signs, block of ids, ids) that
are sorted by their signs, so that a scan skips all files and row groups without them. The ids that have all triples of a
keyword are then looked up and verified; a keyword without a part of three signs is tried on every clause.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import predicates as P
from clausewright.functions.vocab import KIND, OPTIONAL
from clausewright.plans import order
from clausewright.plans.lineage import checkpoint_path
from clausewright.plans.query import Condition, entity_predicate

#: Ids that one row of postings may hold.
BLOCK = 4096
#: Clauses that one bucket holds, about, and the fewest buckets: a task sorts one bucket, whatever the size of the whole.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 8
SIGNS = 3
PARTS = ("entities", "clauses", "postings")


def grams(clauses: DataFrame, *others: str) -> DataFrame:
    """others, gram: a row for every run of three signs of a text as it stands, line ends included; none where it is shorter. Runs are cut by compiled code, a place at a time."""
    long = clauses.where(F.char_length("text") >= SIGNS)
    places = long.select(*others, "text", F.explode(F.sequence(F.lit(1), F.char_length("text") - SIGNS + 1)).alias("_at"))
    return places.select(*others, F.substring(F.col("text"), F.col("_at"), F.lit(SIGNS)).alias("gram"))


def asked(keyword: str | None) -> list[str]:
    """The triples that a text with the parts of a keyword has for certain; none where all parts are shorter."""
    return sorted({part[i : i + SIGNS] for part in P.like_parts(P.term(keyword)) for i in range(len(part) - SIGNS + 1)})


@dataclass(frozen=True)
class Index:
    """Names of the tables ``entities`` (index rows without clauses, with ``rank``), ``clauses`` (id, pos, section, label, text, kind, opt, role, shown, codes) and ``postings`` (gram, block, ids)."""

    spark: SparkSession
    name: str
    folder: str
    buckets: int

    @property
    def entities(self) -> DataFrame:
        return self.spark.table(f"{self.name}_entities")

    @property
    def clauses(self) -> DataFrame:
        return self.spark.table(f"{self.name}_clauses")

    @property
    def postings(self) -> DataFrame:
        return self.spark.table(f"{self.name}_postings")

    def drop(self) -> None:
        """Takes the tables out of the session's catalog; their files stay."""
        for part in PARTS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def candidates(self, keyword: str) -> DataFrame | None:
        """id of entities with a clause that may meet a keyword; None where the postings cannot tell."""
        grams = asked(keyword)
        if not grams:
            return None
        held = self.postings.where(F.col("gram").isin(grams)).select("gram", F.explode("ids").alias("id"))
        return held.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")

    def hits(self, q: Condition) -> DataFrame | None:
        """id, rows: places of the clauses that meet all clause conditions; None where none is set."""
        test = clause_test(q)
        if test is None:
            return None
        found = self.clauses
        few = self.candidates(q.text)
        if few is not None:
            found = found.join(few, "id", "left_semi")
        return found.where(test).groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("rows"))

    def run(self, q: Condition) -> DataFrame:
        """Entities that meet the query, with ``rows`` as ``query.run`` gives them."""
        out = self.entities.where(entity_predicate(q))
        hits = self.hits(q)
        return out.withColumn("rows", F.lit(None).cast("array<int>")) if hits is None else out.join(hits, "id")


def clause_test(q: Condition) -> Column | None:
    """The conjunction that one stored clause must meet; None where no clause condition is set."""
    parts = P.like_parts(P.term(q.text))
    tests = []
    if parts:
        hit = P.like_match(F.col("text"), parts)
        tests.append(hit if q.text_materials else hit & ~F.coalesce(F.col("role") == "mat", F.lit(False)))
    if any(q.kind.values()):
        tests.append(P.tri_hit(F.col("shown"), q.kind))
    if any(q.opt.values()):
        tests.append(P.tri_hit(F.col("codes"), q.opt, True))
    return reduce(lambda a, b: a & b, tests) if tests else None


def posted(clauses: DataFrame) -> DataFrame:
    """gram, block, ids: the ids of a block of ``BLOCK`` whose clauses have the three signs; so a triple that every clause has is many rows."""
    each = grams(clauses, "id").distinct()
    return each.groupBy("gram", F.expr(f"floor(id / {BLOCK})").alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def bucket_count(rows: int) -> int:
    """Buckets for so many clauses."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def write(entities: DataFrame, clauses: DataFrame, buckets: int | None = None, folder: str | None = None) -> Index:
    """Writes the tables under ``folder`` (by default one of its own in the checkpoint folder, which all executors share).

    ``entities``: ``entities.faces`` of all entities; ``clauses``: id, pos, section, label, text, kind, opt, role; a clause of no
    entity is left out. ``buckets``: by default as many as the clauses need (``bucket_count``).
    """
    buckets = bucket_count(clauses.count()) if buckets is None else buckets
    spark = entities.sparkSession
    name = f"index_{uuid.uuid4().hex}"
    index = Index(spark, name, folder or f"{checkpoint_path(spark)}/{name}", buckets)

    def save(rows: DataFrame, part: str, bucketed: bool = True) -> None:
        out = rows.write.format("parquet").option("path", f"{index.folder}/{part}")
        (out.bucketBy(buckets, "id").sortBy("id") if bucketed else out).saveAsTable(f"{name}_{part}")

    save(order.ranked(entities, *order.domain_key()).repartition(buckets, "id"), "entities")
    typed = clauses.join(index.entities.select("id", "cat", "subs"), "id")
    shown = P.kind_at(F.col("kind"), F.col("cat"), F.col("subs"), KIND.own)
    rows = typed.select("id", "pos", "section", "label", "text", "kind", "opt", "role", shown.alias("shown"), P.optional_at(F.col("kind"), F.col("opt"), OPTIONAL.combos).alias("codes"))
    save(rows.repartition(buckets, "id"), "clauses")
    save(posted(index.clauses).repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), "postings", False)
    return index


def opened(spark: SparkSession, folder: str, buckets: int) -> Index:
    """The index that another session has written to ``folder`` with so many buckets."""
    index = Index(spark, f"index_{uuid.uuid4().hex}", folder, buckets)
    for part in PARTS:
        columns = spark.read.parquet(f"{folder}/{part}")._jdf.schema().toDDL()
        dealt = "" if part == "postings" else f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {index.name}_{part} ({columns}) USING parquet {dealt} LOCATION '{folder}/{part}'")
    return index
