"""Consistency checks as one table of violations, and gates over it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.functions import vocab as V
from clausewright.operators import versions


def violations(rows: DataFrame, checks: Mapping[str, tuple[Column, Column]], key: str = "id") -> DataFrame:
    """check, id, detail: a row for each check (condition, detail) that a row fails; one pass over the rows."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("check"), detail.cast("string").alias("detail"))) for n, (bad, detail) in checks.items())))
    return rows.select(F.col(key).alias("id"), F.explode(found).alias("_v")).select("_v.check", "id", "_v.detail")


def both_ways(left: Column, right: Column) -> Column:
    """Violated where one holds without the other; null counts as not."""
    return F.coalesce(left, F.lit(False)) != F.coalesce(right, F.lit(False))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def summary(found: DataFrame) -> DataFrame:
    """check, n."""
    return found.groupBy("check").agg(F.count("*").alias("n"))


def gates(found: DataFrame, names: list[str]) -> DataFrame:
    """gate, ok, n of each named check, those without violations included."""
    listed = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("gate"))
    return listed.join(summary(found), F.col("gate") == F.col("check"), "left").select("gate", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n"))


def same_rows(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> bool:
    """Whether two frames have equal rows, each as often: a rerun on its own output must change nothing. One pass over each."""
    return versions.same(a, b, keys or a.columns)


class CheckFailed(ValueError):
    """What was found wrong, all of it."""


def require(found: DataFrame, most: int = 50) -> None:
    """Raise if there are violations; the message lists counts of all and the first ``most``."""
    counts = {r["check"]: r["n"] for r in summary(found).collect()}
    if counts:
        rows = found.orderBy("check", "id").limit(most).collect()
        raise CheckFailed("; ".join(f"{k}: {n}" for k, n in sorted(counts.items())) + "\n" + "\n".join(f"{r['check']} {r['id']} {r['detail']}" for r in rows))


# The index


# Heads of sections, which no clause holds, and the mark of an alias.
SECTION_HEADS = ("【靈擺效果】", "【怪獸效果】", "【怪獸敘述】")
ALIAS_MARK = "※"


def gap_kind(gap: Column) -> Column:
    """header or alias: what the clauses of a text may leave of it; null for anything else."""
    rest = gap
    for head in SECTION_HEADS:
        rest = F.replace(rest, F.lit(head), F.lit(""))
    rest = T.trimmed(rest)
    return F.when(rest == "", "header").when(F.startswith(rest, F.lit(ALIAS_MARK)), "alias")


def buttons(domains: Mapping[str, V.Domain] | None = None) -> dict[str, list[str]]:
    """Codes of each domain that a client can choose."""
    return {name: [i["code"] for i in one["items"]] for name, one in V.export(domains).items()}


def pruned(exported: dict, counts: Mapping[str, int], domain: str = "kind") -> dict:
    """An exported vocabulary without the buttons of codes that are counted as 0; a group without buttons goes, items stay for display."""
    one = exported[domain]
    groups = [{**g, "codes": kept} for g in one.get("groups", []) if (kept := [c for c in g["codes"] if counts.get(c, 1)])]
    return {**exported, domain: {**one, "groups": groups}}


#: What a row is told of: the check it fails and the detail.
_FOUND = "array<struct<check:string,detail:string>>"


def _named(check: str, details: Column) -> Column:
    """A row's violations of one check, from an array of details."""
    return F.coalesce(F.transform(details, lambda d: F.struct(F.lit(check).alias("check"), d.cast("string").alias("detail"))), F.array()).cast(_FOUND)


def _if(check: str, bad: Column, detail: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail")))).otherwise(F.array()).cast(_FOUND)


def _exploded(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select("id", F.explode(found).alias("_v")).select("_v.check", "id", "_v.detail")


def unexported_found(chosen: Mapping[str, list[str]] | None = None) -> Column:
    """Codes of an index row that are no buttons, as ``column:code``."""
    chosen = chosen or buttons()
    side = F.col("cat")
    single = {"cat": "cat", "attr": "attr", "race": "race", "rarity": "rarity", "region": "ot", "ban_o": "ban_o", "ban_t": "ban_t", "ban_m": "ban_m"}
    coded = lambda column, codes, allowed: F.transform(F.filter(F.coalesce(codes, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "") & ~c.isin(allowed)), lambda c: F.concat(F.lit(f"{column}:"), c))
    found = [coded(c, F.array(F.col(c)), chosen[d]) for c, d in single.items()]
    found += [coded("markers", F.col("markers"), chosen["lm"])]
    found += [coded("subs", F.when(side == s, F.col("subs")), chosen[f"sub_{s}"]) for s in ("m", "s", "t")]
    found += [coded(c, F.col(f"clauses.{c}"), chosen[d]) for c, d in (("kind", "kind"), ("opt", "optional"), ("role", "role"))]
    return _named("not_exported", F.concat(*found))


def off_carriers_found(carriers: tuple[str, ...] = V.OPTIONAL.carriers) -> Column:
    """Labels of an index row's clauses with a value on a kind that carries none."""
    bad = F.filter("clauses", lambda c: c["opt"].isNotNull() & ~F.coalesce(c["kind"].isin(*carriers), F.lit(False)))
    return _named("optional_on_non_carrier", F.transform(bad, lambda c: c["label"]))


def coverage_found(flavor: Column | None = None) -> Column:
    """What an index row's clauses and flavour leave of its text and may not, clauses that are not in it in their order, and an alias that is a gap and was not taken out, or the other way round. Blanks do not count on either side."""
    bare = lambda c: T.without_blanks(F.coalesce(c, F.lit("")))
    pieces = F.transform("clauses", lambda c: bare(c["text"]))
    pieces = F.concat(pieces, F.array(bare(flavor))) if flavor is not None else pieces
    held = T.coverage(bare(F.col("body")), F.filter(pieces, lambda p: p != ""))
    alias = F.coalesce("alias", F.lit(""))
    unknown = F.filter(held["gaps"], lambda g: gap_kind(g).isNull())
    has_alias = F.exists(held["gaps"], lambda g: F.coalesce(gap_kind(g) == "alias", F.lit(False)))
    return F.concat(_named("coverage_gaps", unknown), _named("clauses_not_in_text", held["missing"]), _if("alias_gap_not_extracted", both_ways(has_alias, alias != ""), alias))


def unexported(index: DataFrame, chosen: Mapping[str, list[str]] | None = None) -> DataFrame:
    """check, id, detail (column:code): codes of index rows that are no buttons."""
    return _exploded(index, unexported_found(chosen))


def optional_off_carriers(index: DataFrame, carriers: tuple[str, ...] = V.OPTIONAL.carriers) -> DataFrame:
    """check, id, detail (label): clauses with a value on a kind that carries none."""
    return _exploded(index, off_carriers_found(carriers))


def coverage_faults(index: DataFrame, flavor: Column | None = None) -> DataFrame:
    """check, id, detail of what ``coverage_found`` finds."""
    return _exploded(index, coverage_found(flavor))


#: The checks of an index, in the order in which a row is told of them.
INDEX_CHECKS = (
    "monster_without_parameters", "parameters_without_monster", "unexplained_type_bits", "unknown_attribute", "unknown_race", "missing_from_index", "duplicate_id", "without_clause_entry",
    "clause_without_kind", "optional_on_non_carrier", "not_exported", "coverage_gaps", "clauses_not_in_text", "alias_gap_not_extracted",
)


def checked_index(cards: DataFrame, index: DataFrame, clauses: DataFrame, flavor: Column | None = None) -> DataFrame:
    """``index`` rows with ``problems`` (array of check and detail), and a row with a null ``id`` column but a ``card_id`` for each card without one.

    ``cards``: decoded entities (id, type, race, attribute, level, atk, def); ``index``: ``entities.index_rows`` of them;
    ``clauses``: id. Each of them is read once: they meet by id, and all checks are columns of the joined row.
    """
    names = ("type", "race", "attribute", "level", "atk", "def")
    by_id = Window.partitionBy("card_id")
    mine = cards.select(F.col("id").alias("card_id"), *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_card"))
    mine = mine.withColumns({"_n": F.count("*").over(by_id), "_k": F.row_number().over(by_id.orderBy("_type"))})
    told = index.withColumns({"_row": F.lit(True), "id": F.col("id")})
    both = mine.join(told, mine["card_id"] == told["id"], "full").withColumn("_key", F.coalesce("card_id", "id"))
    entries = clauses.select(F.col("id").alias("_key"), F.lit(True).alias("_entry")).distinct()
    rows = both.join(entries, "_key", "left")
    c = {n: F.col(f"_{n}") for n in names}
    card, first = F.coalesce("_card", F.lit(False)), F.coalesce(F.col("_k") == 1, F.lit(False))
    monster = c["type"].bitwiseAND(F.lit(1)) != 0
    given = reduce(lambda a, b: a | b, (F.coalesce(c[n] != 0, F.lit(False)) for n in names[1:]))
    whole = F.coalesce(c["race"] != 0, F.lit(False)) & F.coalesce(c["attribute"] != 0, F.lit(False))
    bits = V.unexplained_type_bits(c["type"])
    own = [
        _if("monster_without_parameters", card & monster & ~whole, c["type"]), _if("parameters_without_monster", card & ~monster & given, c["type"]), _if("unexplained_type_bits", card & (bits != 0), F.hex(bits)),
        *(_if(f"unknown_{n}", card & d.is_unknown(c[n]), c[n]) for n, d in (("attribute", V.ATTR), ("race", V.RACE))),
        _if("missing_from_index", card & F.col("_row").isNull(), F.lit(None)), _if("duplicate_id", card & first & (F.col("_n") > 1), F.col("_n")), _if("without_clause_entry", card & F.col("_entry").isNull(), F.lit(None)),
    ]
    untyped = F.transform(F.filter("clauses", lambda x: F.coalesce(x["kind"], F.lit("")) == ""), lambda x: x["label"])
    rest = F.concat(_named("clause_without_kind", untyped), off_carriers_found(), unexported_found(), coverage_found(flavor))
    # Of cards with one id each meets the same index row, which is told of once.
    rows = rows.withColumn("problems", F.concat(*own, F.when(F.coalesce("_row", F.lit(False)) & (first | ~card), rest).otherwise(F.array().cast(_FOUND))))
    return rows.select(*index.columns, "card_id", "problems")


def index_problems(cards: DataFrame, index: DataFrame, clauses: DataFrame, flavor: Column | None = None) -> DataFrame:
    """check, id, detail: everything that is wrong with an index, as ``checked_index`` finds it. An empty result is what lets an index be published (``require``)."""
    rows = checked_index(cards, index, clauses, flavor)
    return rows.select(F.coalesce("card_id", "id").alias("id"), F.explode("problems").alias("_v")).select("_v.check", "id", "_v.detail")


def vocabulary_problems(spark, problems: list[str]) -> DataFrame:
    """The same table for what ``vocab.problems`` and ``rules.problems`` find, with no id."""
    return spark.createDataFrame([("vocabulary", None, p) for p in problems], "check string, id long, detail string")


def known_values(rows: DataFrame, columns: Mapping[str, V.Domain]) -> DataFrame:
    """``rows``, unless one of the columns has a value that its domain does not know: then all such values are named in the error."""
    require(violations(rows, {f"unknown_{c}": (d.is_unknown(F.col(c)), F.col(c)) for c, d in columns.items()}))
    return rows


def guarded_mapping(diff: DataFrame, force: bool = False) -> DataFrame:
    """A mapping diff that only adds, or any with ``force``; else an error that names what was removed or changed."""
    if not force:
        require(diff.where("change <> 'added'").select(F.col("change").alias("check"), F.col(diff.columns[0]).alias("id"), F.concat_ws(" -> ", F.col("old").cast("string"), F.col("new").cast("string")).alias("detail")))
    return diff


#: Lists that must have stopped growing, and faults that must be none, before a sheet is sealed.
CONVERGED = ("judgment_orphans", "judgment_rejudge_refused", "late_official_conflict", "pending")
INTEGRITY = ("split_malformed", "split_stale", "split_coverage_failed", "split_quote_violations", "split_unused", "bullet_split_mismatch", "bullet_coverage_failed", "bullet_quote_violations", "kind_conflicts")


def sealed(found: DataFrame, sheet: DataFrame, rerun: DataFrame, keys: list[str]) -> DataFrame:
    """gate, ok, n of all gates: the lists above, keys that are not unique, and rows that a rerun on the sheet would change, for which both are read once unless there are any."""
    lists = gates(found, [*CONVERGED, *INTEGRITY])
    repeated = sheet.groupBy(*keys).count().where("count > 1")
    changed = versions.differing(sheet, rerun, keys)
    more = [f.agg(F.count("*").alias("n")).select(F.lit(g).alias("gate"), (F.col("n") == 0).alias("ok"), "n") for g, f in (("unique_keys", repeated), ("fixpoint", changed))]
    return lists.unionByName(more[0]).unionByName(more[1])
