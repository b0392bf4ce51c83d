"""Work for people: clauses that wait for a judgment, with all that is known of their entity, in batches of fixed size."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators.entities import card_type
from clausewright.plans.lineage import checkpointed
from clausewright.plans.order import ranked
from clausewright.sources import json_array

#: Entities of a batch, for clauses alone and for texts to be split.
BATCH_SIZES = {"kind": 300, "split": 200}
_KEY = re.compile(r"([0-9]+):(main|pendulum):([^,:]+)")


def pending(clauses: DataFrame) -> DataFrame:
    """Clauses without a kind."""
    return clauses.where("kind IS NULL")


def only(rows: DataFrame, ids: Sequence[int], key: str = "id") -> DataFrame:
    """The rows of the listed ids; ids that no row has are an error that names them all."""
    listed = rows.sparkSession.createDataFrame([(int(i),) for i in ids], "_id long")
    unknown = [r["_id"] for r in listed.join(rows.select(F.col(key).alias("_id")), "_id", "left_anti").distinct().orderBy("_id").collect()]  # of the list
    if unknown:
        raise KeyError(f"not among the rows: {', '.join(map(str, unknown))}")
    return rows.join(listed.distinct(), F.col(key) == F.col("_id"), "left_semi")


def numbered_batches(rows: DataFrame, size: int, *order: Column, name: str = "batch") -> DataFrame:
    """Rows with the number of their batch, from 1; the last one may be short."""
    return ranked(rows, *order, name="_place").withColumn(name, F.ceil(F.col("_place") / size).cast("long")).drop("_place")


def quote_hints(supplement: Column, text_norm: Column, quotes_norm: Column) -> Column:
    """Quotes of the official text that lie in a text, once each: hints where it may be cut. ``*_norm``: as ``text.normalised`` gives them."""
    held = F.zip_with(T.quotes(F.coalesce(supplement, F.lit(""))), quotes_norm, lambda q, n: F.when((n != "") & F.contains(text_norm, n), q))
    return F.array_distinct(F.array_compact(held))


def contexts(cards: DataFrame, supplements: DataFrame) -> DataFrame:
    """id, name_zh, name_ja, card_type, card_text_zh (without its alias line), card_text_ja, supplement, pendulum (struct, null where there is none).

    ``cards``: id, type, name_zh, name_ja, body; ``supplements``: id, name_ja, card_text, supplement, pen_effect, pen_supplement.
    """
    said = supplements.select("id", F.col("name_ja").alias("_ja"), "card_text", "supplement", "pen_effect", "pen_supplement")
    rows = cards.join(said, "id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    pendulum = F.when((blank("pen_effect") != "") | (blank("pen_supplement") != ""), F.struct(blank("pen_effect").alias("card_text_ja"), blank("pen_supplement").alias("supplement")))
    return rows.select(
        "id", "name_zh", F.coalesce("name_ja", "_ja").alias("name_ja"), card_type(F.col("type")).alias("card_type"), F.regexp_replace(blank("body"), r"\n\n※[^\n]*\z", "").alias("card_text_zh"),
        blank("card_text").alias("card_text_ja"), blank("supplement").alias("supplement"), pendulum.alias("pendulum"),
    )


_ROW = ("label", "section", "text_zh", "text_ja", "rule_predicted")


def payloads(clauses: DataFrame, blobs: DataFrame, context: DataFrame) -> DataFrame:
    """``context`` of every entity with a clause that waits or a text that is not split: with clauses, split_targets and series.

    An unsplit text counts even where it has a kind already: splitting and judging are two things. ``blobs``: id,
    section, text_zh, text_ja. series: split where there are targets, else kind.
    """
    waiting = pending(clauses).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", *_ROW))).alias("clauses"))
    told = blobs.join(context.select("id", "supplement", "pendulum"), "id", "left")
    supplement = F.when(F.col("section") == "pendulum", F.col("pendulum.supplement")).otherwise(F.col("supplement"))
    told = told.withColumn("_said", F.coalesce(supplement, F.lit(""))).withColumns({"_norm": T.normalised(F.coalesce("text_ja", F.lit(""))), "_raw": T.quotes(F.col("_said"))})
    told = told.withColumn("_quotes", T.normalised_each(F.col("_raw")))
    targets = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("section", "text_zh", "text_ja", quote_hints(F.col("_said"), F.col("_norm"), F.col("_quotes")).alias("hints")))).alias("split_targets"))
    both = waiting.join(targets, "id", "full")
    series = F.when(F.col("split_targets").isNotNull(), "split").otherwise("kind")
    rows = both.withColumn("series", series).join(context, "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("clauses", "split_targets")})


def batched(payload: DataFrame) -> DataFrame:
    """``payload`` with the number of its batch, each series of its own size, by id."""
    parts = [numbered_batches(payload.where(F.col("series") == s), n, F.col("id")) for s, n in BATCH_SIZES.items()]
    return parts[0].unionByName(parts[1])


def parse_keys(spec: str) -> list[tuple[int, str, str]] | None:
    """``id:section:label,...`` as keys; None where anything else is in it."""
    found = [_KEY.fullmatch(part.strip()) for part in spec.split(",")]
    return [(int(m[1]), m[2], m[3]) for m in found] if all(found) else None


def rejudgments(clauses: DataFrame, context: DataFrame, keys: Iterable[tuple[int, str, str]]) -> DataFrame:
    """``context`` of the named clauses' entities, with clauses that carry their present judgment and source. A key without a clause, or whose clause was never judged, is an error."""
    spark = clauses.sparkSession
    named = spark.createDataFrame(list(keys), "id long, section string, label string").distinct()
    rows = named.join(clauses.withColumn("_here", F.lit(True)), ["id", "section", "label"], "left")
    wrong = rows.where("_here IS NULL OR kind IS NULL").select("id", "section", "label", F.when(F.col("_here").isNull(), "no such clause").otherwise("not judged yet").alias("why")).orderBy("id", "section", "label").collect()  # of the keys
    if wrong:
        raise KeyError("; ".join(f"{r['id']}:{r['section']}:{r['label']}: {r['why']}" for r in wrong))
    row = F.struct("pos", *_ROW, F.lit(True).alias("rejudge"), F.struct("kind", "optional", "role", "source").alias("current"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("clauses")).join(context, "id", "left")


class BatchRefused(ValueError):
    """Why no batch is written."""


def chosen_batches(payload: DataFrame, series: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """``batched`` payloads of the asked series (all, where none is named), the first ``limit`` batches of each, with ``remaining``: how many more its series has."""
    unknown = sorted(set(series) - set(BATCH_SIZES))
    if unknown:
        raise BatchRefused(f"no such series: {', '.join(unknown)}")
    rows = batched(payload.where(F.col("series").isin(*(series or BATCH_SIZES))))
    rows = rows.withColumn("remaining", F.max("batch").over(Window.partitionBy("series")) - F.col("batch"))
    return rows if limit is None else rows.where(F.col("batch") <= limit)


def write_batches(payload: DataFrame, folder: str, series: Sequence[str] = (), limit: int | None = None, start: int = 1, name: str | None = None) -> list[str]:
    """Writes each batch as a JSON array of its entities, ``<series>-<number>.json`` from ``start`` on, and returns the names.

    ``name`` is for exactly one batch. A file that is there already is not overwritten: then, as where ``name`` meets more than one
    batch, nothing is written at all.
    """
    rows = checkpointed(chosen_batches(payload, series, limit))
    found = [(r["series"], r["batch"]) for r in rows.select("series", "batch").distinct().orderBy("series", "batch").collect()]  # a row a file
    if name is not None and len(found) != 1:
        raise BatchRefused(f"{name} names one batch, and there are {len(found)}")
    files = {(s, n): f"{name or f'{s}-{n + start - 1:03d}'}.json" for s, n in found}
    taken = [f for f in files.values() if json_array.exists(f"{folder}/{f}")]
    if taken:
        raise BatchRefused(f"there already: {', '.join(sorted(taken))}")
    for (s, n), file in files.items():
        part = rows.where((F.col("series") == s) & (F.col("batch") == n)).drop("batch", "series", "remaining").orderBy("id")
        json_array.write(part, f"{folder}/{file}")
    return sorted(files.values())


def write_rejudgments(clauses: DataFrame, context: DataFrame, keys: str, folder: str, name: str | None, **others) -> str:
    """Writes the batch of clauses that are to be judged again; ``keys``: ``id:section:label,...``. It goes by no series, so it needs a name and takes none of the flags of the others."""
    if not name:
        raise BatchRefused("a batch of rejudgments needs a name")
    flags = sorted(k for k, v in others.items() if v)
    if flags:
        raise BatchRefused(f"clauses are named one by one, so these do not go with it: {', '.join(flags)}")
    parsed = parse_keys(keys)
    if parsed is None:
        raise BatchRefused("keys are id:section:label, joined by commas")
    path = f"{folder}/{name}.json"
    if json_array.exists(path):
        raise BatchRefused(f"there already: {name}.json")
    json_array.write(rejudgments(clauses, context, parsed).orderBy("id"), path)
    return f"{name}.json"
