"""Equi-joins with precedence: fallback keys, first or last wins, overrides, diffs, and merging along parent pointers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.operators import versions
from clausewright.plans.lineage import checkpointed


def lookup_with_fallback(left: DataFrame, key: str, others: str, right: DataFrame, right_key: str, value: str, out: str | None = None) -> DataFrame:
    """``left`` with ``value`` of ``right`` by ``key``, else by the first of the array ``others`` that has one.

    ``right_key`` is unique. The keys of a row are looked up as rows of their own, so the join is one hash join.
    """
    keys = left.select(F.col(key).alias("_row"), F.posexplode(F.concat(F.array(key), F.coalesce(others, F.array().cast(left.schema[others].dataType)))).alias("_pos", "_key")).distinct()
    found = keys.join(right.select(F.col(right_key).alias("_key"), F.col(value).alias("_value")).where("_value IS NOT NULL"), "_key")
    best = found.groupBy("_row").agg(F.min_by("_value", "_pos").alias(out or value))
    return left.join(best, left[key] == best["_row"], "left").drop("_row")


def not_covered(left: DataFrame, key: str, others: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of ``left`` for which neither ``key`` nor any of ``others`` is in ``right``."""
    keys = left.select(F.col(key).alias("_row"), F.explode(F.concat(F.array(key), F.coalesce(others, F.array().cast(left.schema[others].dataType)))).alias("_key"))
    covered = keys.join(right.select(F.col(right_key).alias("_key")).where("_key IS NOT NULL"), "_key", "left_semi").select("_row").distinct()
    return left.join(covered, left[key] == covered["_row"], "left_anti")


def unmatched(right: DataFrame, right_key: str, left: DataFrame, key: str) -> DataFrame:
    """Rows of ``right`` that no row of ``left`` has used."""
    return right.join(left.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct(), F.col(right_key) == F.col("_key"), "left_anti")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a given order; counted up before the shuffle."""
    rest = F.struct(*(c for c in df.columns if c not in keys))
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(rest, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def per_field_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str]) -> DataFrame:
    """For each key and field the last value that is set, each field on its own."""
    seq = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields))


def overridden(base: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """A mapping with the values of another over it."""
    over = overrides.select(key, F.col(value).alias("_over"))
    return base.select(key, value).join(over, key, "full").select(key, F.coalesce("_over", value).alias(value))


def mapping_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new, change: added, removed or changed; nothing for equal values. Only the buckets whose digests differ are joined."""
    old, new = versions.narrowed(old.select(key, value), new.select(key, value), [key]) or (old.limit(0), new.limit(0))
    both = old.select(key, F.col(value).alias("old"), F.lit(True).alias("_o")).join(new.select(key, F.col(value).alias("new"), F.lit(True).alias("_n")), key, "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "old", "new", "change")


def only_grew(diff: DataFrame) -> DataFrame:
    """One row: is_safe, whether nothing was removed or changed."""
    return diff.agg(F.coalesce(F.bool_and(F.col("change") == "added"), F.lit(True)).alias("is_safe"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str] | None = None) -> DataFrame:
    """key, change (added or changed), fields: sorted names of fields that differ. Rows that are gone are passed over.

    Digests of buckets are compared first; only the rows of buckets that differ are joined.
    """
    fields = [f for f in (fields or new.columns) if f != key]
    old, new = versions.narrowed(old.select(key, *fields), new.select(key, *fields), [key]) or (old.limit(0), new.limit(0))
    before = old.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = new.select(key, *fields).join(before, F.col(key) == F.col("_key"), "left")
    differing = F.array_sort(F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields))))
    change = F.when(F.col("_key").isNull(), "added").when(F.size(differing) > 0, "changed")
    return both.select(key, change.alias("change"), F.when(F.col("_key").isNotNull(), differing).otherwise(F.array().cast("array<string>")).alias("fields")).where("change IS NOT NULL")


def benign_changes(diff: DataFrame, entities: DataFrame, key: str = "id", others: str = "alt_ids") -> DataFrame:
    """A mapping diff with ``same_entity``: whether old and new value belong to one entity; an unknown id does not."""
    owner = entities.select(F.col(key).alias("_owner"), F.explode(F.concat(F.array(key), F.coalesce(others, F.array().cast(entities.schema[others].dataType)))).alias("_id"))
    out = diff.join(owner.select(F.col("_id").alias("old"), F.col("_owner").alias("_a")), "old", "left").join(owner.select(F.col("_id").alias("new"), F.col("_owner").alias("_b")), "new", "left")
    return out.select(*diff.columns, F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same_entity"))


def key_differences(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, side: missing (expected alone) or extra (actual alone)."""
    expected, actual = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return expected.subtract(actual).withColumn("side", F.lit("missing")).unionByName(actual.subtract(expected).withColumn("side", F.lit("extra")))


def upserted(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` instead of those with the same keys."""
    return base.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def alias_merge(entities: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(merged, exceptions) from id, alias (0: none) and name.

    A row whose alias leads to a row of the same name is merged into the nearest row up the pointers that stays, which
    gets its id in the sorted ``alt_ids``. Rows that lead into a cycle (unresolved), whose target is not here
    (target_missing) or has another name (name_mismatch) stay and are exceptions (id, reason).

    Pointers are doubled each round, so chains of n need log n joins.
    """
    rows = entities.select("id", F.nullif(F.col("alias"), F.lit(0).cast("long")).alias("up"), "name")
    target = rows.select(F.col("id").alias("up"), F.col("name").alias("up_name"), F.lit(True).alias("here"))
    rows = checkpointed(rows.join(target, "up", "left").select("id", "up", "name", "up_name", F.coalesce("here", F.lit(False)).alias("here")))

    def doubled(jump: DataFrame, rounds: int) -> DataFrame:
        """Pointers followed to their ends; whether a round moved any is told by its own join."""
        for _ in range(rounds):
            following = jump.select(F.col("id").alias("to"), F.col("to").alias("next"))
            jump = checkpointed(jump.select("id", "to").join(following, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            if jump.where("moved").isEmpty():
                break
        return jump.select("id", "to")

    # A row resolves if its pointers end; ends point to themselves, rows on a cycle never reach one.
    ends = rows.where("up IS NULL OR NOT here").select(F.col("id").alias("end"))
    reach = checkpointed(rows.select("id", F.when(F.col("up").isNotNull() & F.col("here"), F.col("up")).otherwise(F.col("id")).alias("to")))
    reach = doubled(reach, max(1, reach.count()).bit_length())  # on a cycle pointers never end
    resolved = reach.join(ends, F.col("to") == F.col("end"), "left_semi").select("id", F.lit(True).alias("resolved"))
    told = rows.join(resolved, "id", "left")
    reason = F.when(F.col("resolved").isNull(), "unresolved").when(F.col("up").isNull(), None).when(~F.col("here"), "target_missing").when(~F.col("name").eqNullSafe(F.col("up_name")), "name_mismatch")
    told = checkpointed(told.withColumn("reason", reason).withColumn("goes", F.col("up").isNotNull() & reason.isNull()))
    owner = doubled(told.select("id", F.when(F.col("goes"), F.col("up")).otherwise(F.col("id")).alias("to")), most_rounds)
    alts = owner.where("id <> to").groupBy(F.col("to").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("alt_ids"))
    gone = told.where("goes").select("id")
    merged = entities.join(gone, "id", "left_anti").drop("alt_ids").join(alts, "id", "left").withColumn("alt_ids", F.coalesce("alt_ids", F.array().cast("array<long>")))
    return merged, told.where("reason IS NOT NULL").select("id", "reason")


def consuming_lookup(left: DataFrame, key: str, others: str, sources: Mapping[str, DataFrame], value: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unmatched): ``left`` with a column for each source (id, value), by ``key``, else by the first of ``others``; unmatched: source, id of source rows that no row has used.

    A value on an alternate id stays unused where the main id has one.
    """
    out, rest = left, None
    for name, source in sources.items():
        keys = left.select(F.col(key).alias("_row"), F.posexplode(F.concat(F.array(key), F.coalesce(others, F.array().cast(left.schema[others].dataType)))).alias("_pos", "_key")).distinct()
        found = keys.join(source.select(F.col("id").alias("_key"), F.col(value).alias("_value")).where("_value IS NOT NULL"), "_key")
        best = found.groupBy("_row").agg(F.min_by(F.struct("_value", "_key"), "_pos").alias("_b"))
        out = out.join(best.select(F.col("_row").alias(key), F.col("_b._value").alias(name)), key, "left")
        unused = source.join(best.select(F.col("_b._key").alias("id")), "id", "left_anti").select(F.lit(name).alias("source"), "id")
        rest = unused if rest is None else rest.unionByName(unused)
    return out, rest


def split_by(rows: DataFrame, excluded: Column) -> tuple[DataFrame, DataFrame]:
    """(rest, excluded): rows for which the condition does not hold (or is null), and rows for which it does."""
    hit = F.coalesce(excluded, F.lit(False))
    return rows.where(~hit), rows.where(hit)


def missing_by_region(entities: DataFrame, covered: DataFrame, covered_key: str, region: str = "ot", elsewhere: int = 2) -> tuple[DataFrame, DataFrame]:
    """(missing, excluded): entities (id, alt_ids, region) that no covered key names; excluded: those of a region that the source does not serve."""
    return split_by(not_covered(entities, "id", "alt_ids", covered, covered_key), F.col(region) == elsewhere)


def resolved(entities: DataFrame, mapping: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(targets, unresolved): entities with ``value`` of the mapping (id, value) by id or an alternate one, and those without."""
    return split_by(lookup_with_fallback(entities, "id", "alt_ids", mapping, "id", value), F.col(value).isNull())


def verified(entities: DataFrame, entries: DataFrame, key: str, filled: str) -> tuple[DataFrame, DataFrame]:
    """(ok, bad): entities with an entry, by id or else an alternate one, whose ``filled`` is neither null nor empty.

    The first id that has an entry counts, even where another's is filled.
    """
    marked = entries.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.coalesce(F.col(filled) != "", F.lit(False)).alias("_ok")).groupBy("_id").agg(F.max("_ok").alias("_ok"))
    bad, ok = split_by(lookup_with_fallback(entities, "id", "alt_ids", marked, "_id", "_ok"), F.coalesce("_ok", F.lit(False)))
    return ok.drop("_ok"), bad.drop("_ok")


def newly_filled(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, gained: names of fields that a new crawl has and the old one had not, sorted; only rows that gained some."""
    held = lambda p: F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"{p}.{f}") != "", F.lit(False)), f) for f in sorted(fields))))
    both = new.select(key, F.struct(*fields).alias("n")).join(old.select(key, F.struct(*fields).alias("o")), key, "left")
    return both.select(key, F.array_except(held("n"), held("o")).alias("gained")).where("size(gained) > 0")


def effective_mapping(dumps: DataFrame, overrides: DataFrame, key: str, value: str, order: Sequence[Column]) -> DataFrame:
    """The mapping of all dumps, the first in order winning, with overrides over it."""
    return overridden(one_per_key(dumps.select(key, value, *order), [key], order).select(key, value), overrides, key, value)


def inverted(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """value, keys: a mapping turned round, the keys of each value sorted; null values are left out."""
    return pairs.where(F.col(value).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def coverage_report(entities: DataFrame, entries: DataFrame | None, key: str, shown: int = 10) -> list[str]:
    """Lines that say what official entries lack; where there are none yet, that this was passed over."""
    if entries is None:
        return ["no official entries yet: not compared"]
    missing, excluded = missing_by_region(entities, entries, key)
    lines = [f"without an entry: {missing.count()}; of another region: {excluded.count()}"]
    lines += [f"  {r['id']}" for r in missing.orderBy("id").limit(shown).collect()]
    return lines + (["  they can be fetched again"] if len(lines) > 1 else [])
