"""Split records: stored cuts of texts without numerals, checked against the text and the official quotes before they apply.

A record names the parts of an entity's section in both languages. Records and texts meet in one join; the checks of a
pair are one Arrow function over a few hundred signs, in a fixed order: malformed, stale, coverage, quotes.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from clausewright.functions import spans as S
from clausewright.functions import text as T
from clausewright.operators.attest import NON_EFFECT
from clausewright.operators.checks import violations
from clausewright.operators.clauses import preamble_role
from clausewright.plans.lineage import in_small_batches

#: Labels that a part may have, and the problems that a record can have, in the order in which they are looked for.
_LABEL = re.compile(r"0(-[2-9][0-9]*)?|[1-9][0-9]*")
PROBLEMS = ("split_malformed", "split_stale", "split_coverage_failed", "split_quote_violations")
_PLACE = StructType([StructField(n, IntegerType()) for n in ("zh_start", "zh_end", "ja_start", "ja_end")])
_CHECKED = StructType([StructField("problem", StringType()), StructField("detail", StringType()), StructField("places", ArrayType(_PLACE))])
KEYS = ("id", "section")


def is_preamble(label: Column) -> Column:
    return (label == "0") | F.startswith(label, F.lit("0-"))


def _order(given: list[int] | None, n: int) -> list[int] | None:
    order = list(range(n)) if given is None else [int(i) for i in given]
    return order if sorted(order) == list(range(n)) else None


def _excused(quote: str, parts: list[tuple[str, str]], denied: list[str]) -> bool:
    """Whether a quote that the text says is no effect is a run of whole parts that are all preambles."""
    wanted = S.normal(quote).rstrip("。")
    if quote not in denied or not wanted:
        return False
    body = "".join(p for p, _ in parts)
    seams = [0, *accumulate(len(p) for p, _ in parts)]
    for m in re.finditer(re.escape(wanted) + "。*", body):
        if m.start() in seams and m.end() in seams:
            run = parts[seams.index(m.start()) : len(seams) - 1 - seams[::-1].index(m.end())]
            if all(label == "0" or label.startswith("0-") for _, label in run):
                return True
    return False


def _checked(parts, hashed, order, zh: str, ja: str, now: str, quotes, denied) -> tuple[str | None, str | None, list | None]:
    """(problem, detail, places) of one record."""
    parts = [] if parts is None else list(parts)
    labels = [p["label"] or "" for p in parts]
    order = _order(order, len(parts))
    if not parts or not hashed or order is None or len(set(labels)) < len(labels) or not all(map(_LABEL.fullmatch, labels)):
        return PROBLEMS[0], None, None
    if hashed != now:
        return PROBLEMS[1], None, None
    zh_at = S.covering(zh, [p["text_zh"] or "" for p in parts])
    ja_read = S.covering(ja, [parts[i]["text_ja"] or "" for i in order])
    if zh_at is None or ja_read is None:
        return PROBLEMS[2], "zh" if zh_at is None else "ja", None
    ja_at = [ja_read[order.index(i)] for i in range(len(parts))]
    reading = sorted((span, label) for span, label in zip(ja_at, labels, strict=True) if span)
    parts_read = [(S.normal(ja[a:b]), label) for (a, b), label in reading]
    cut = [q for q in S.severed(ja, ja_at, quotes) if not _excused(q, parts_read, denied)]
    if cut:
        return PROBLEMS[3], "|".join(cut), None
    places = [dict(zip(("zh_start", "zh_end", "ja_start", "ja_end"), (*(z or (None, None)), *(j or (None, None))), strict=True)) for z, j in zip(zh_at, ja_at, strict=True)]
    return None, None, places


@F.pandas_udf(_CHECKED)
def checked(parts: pd.Series, hashed: pd.Series, order: pd.Series, zh: pd.Series, ja: pd.Series, now: pd.Series, quotes: pd.Series, denied: pd.Series) -> pd.DataFrame:
    rows = [_checked(*r[:6], [] if r[6] is None else list(r[6]), [] if r[7] is None else list(r[7])) for r in zip(parts, hashed, order, zh, ja, now, quotes, denied, strict=True)]
    return pd.DataFrame(rows, columns=["problem", "detail", "places"])


def denied_quotes(supplement: Column) -> Column:
    """Quotes of the lines that say that something is no effect."""
    lines = F.filter(F.split(F.coalesce(supplement, F.lit("")), "\n"), lambda x: F.regexp_replace(x, "[（(][^（()）]*[）)]", "").rlike(NON_EFFECT))
    return F.flatten(F.transform(lines, T.quotes))


def judged_splits(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Records with the text that they are of: problem, detail and places.

    ``records``: id, section, text_hash, segments (array of label, text_zh, text_ja), ja_order (array<int>, may be
    null); ``texts``: id, section, text_zh, text_ja, supplement, numbered (whether it has numerals), type. A record
    without its text, or of effects where the text is numbered, is ``split_unused``.
    """
    text = texts.select(*KEYS, F.coalesce("text_zh", F.lit("")).alias("zh"), F.coalesce("text_ja", F.lit("")).alias("ja"), "supplement", "numbered", "type", F.lit(True).alias("here"))
    rows = in_small_batches(records).join(text, list(KEYS), "left")
    fits = F.col("here") & (~F.coalesce("numbered", F.lit(False)) | (F.forall("segments", lambda s: is_preamble(F.coalesce(s["label"], F.lit("")))) & (F.size("segments") > 0)))
    now = T.split_hash(F.col("zh"), F.col("ja"))
    found = checked("segments", "text_hash", "ja_order", F.coalesce("zh", F.lit("")), F.coalesce("ja", F.lit("")), now, T.quotes(F.coalesce("supplement", F.lit(""))), denied_quotes(F.col("supplement")))
    rows = rows.withColumn("_found", found).withColumn("_fits", F.coalesce(fits, F.lit(False)))
    return rows.select(*records.columns, "zh", "ja", "type", F.when(F.col("_fits"), F.col("_found.problem")).otherwise("split_unused").alias("problem"), F.when(F.col("_fits"), F.col("_found.detail")).alias("detail"), F.when(F.col("_fits"), F.col("_found.places")).alias("places"))


def split_clauses(judged: DataFrame) -> DataFrame:
    """id, section, pos, label, text_zh, text_ja, text_hash, kind, role, source of the parts of records without a problem. Preambles are no effect (x) by rule; effects wait for a judgment."""
    rows = judged.where("problem IS NULL").select(*KEYS, "zh", "ja", "type", "segments", F.posexplode("places").alias("pos", "at"))
    cut = lambda text, a, b: F.coalesce(F.substring(F.col(text), F.col("at")[a] + 1, F.col("at")[b] - F.col("at")[a]), F.lit(""))
    rows = rows.select(*KEYS, "pos", F.get("segments", F.col("pos"))["label"].alias("label"), cut("zh", "zh_start", "zh_end").alias("text_zh"), cut("ja", "ja_start", "ja_end").alias("text_ja"), "type")
    before = is_preamble(F.col("label"))
    return rows.withColumns({"text_hash": T.text_hash(F.col("text_ja"), F.col("text_zh")), "kind": F.when(before, "x"), "role": F.when(before, preamble_role(F.col("text_zh"), F.col("type"))), "source": F.when(before, "rule")}).drop("type")


def split_problems(judged: DataFrame) -> DataFrame:
    """check, id, detail of records that do not apply."""
    return judged.where("problem IS NOT NULL").select(F.col("problem").alias("check"), "id", F.coalesce("detail", "section").alias("detail"))


def records_of_judgments(results: DataFrame, blobs: DataFrame, ticket: str) -> tuple[DataFrame, DataFrame]:
    """(records, rest): split records of judgment results, and why the others give none.

    ``results``: id, section, split, note, clauses (array of label, text_zh, text_ja), ja_order; ``blobs``: id,
    section, text_zh, text_ja of the texts that are not yet split. reason: not_open (no such text), no_reason
    (neither parts nor a note), or skipped (a note says why it cannot be split).
    """
    asked = results.where("split").join(blobs.select(*KEYS, T.split_hash(F.col("text_zh"), F.col("text_ja")).alias("text_hash"), F.lit(True).alias("here")), list(KEYS), "left")
    empty = F.coalesce(F.size("clauses") <= 0, F.lit(True))
    reason = F.when(F.col("here").isNull(), "not_open").when(empty & (F.coalesce("note", F.lit("")) == ""), "no_reason").when(empty, "skipped")
    asked = asked.withColumn("reason", reason)
    records = asked.where("reason IS NULL").select(*KEYS, F.lit(ticket).alias("ticket"), "text_hash", F.col("clauses").alias("segments"), "ja_order")
    return records, asked.where("reason IS NOT NULL").select(*KEYS, "reason", "note")


def refused(records: DataFrame, judged: DataFrame, orphans: DataFrame, events: DataFrame) -> DataFrame:
    """check, id, detail: what keeps new records from being taken over: their own problems, judgments without a clause, and rejudgments that a higher source refused."""
    own = split_problems(judged.join(records.select(*KEYS), list(KEYS), "left_semi"))
    lost = orphans.select(F.lit("judgment_orphans").alias("check"), "id", F.col("section").alias("detail"))
    kept = violations(events, {"judgment_rejudge_refused": (F.col("event") == "judgment_rejudge_refused", F.col("section"))})
    return own.unionByName(lost).unionByName(kept)


# Corrections of the texts that stored records and clauses are cut from


def synced_records(records: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, problems) after one correction (id, from, to) an entity: the one part that holds ``from`` once gets ``to`` and the hash is made anew. Done twice it changes nothing.

    Problems (id, reason): bad_order; hash_mismatch, where the parts do not give the stored hash; ambiguous, where ``from`` runs over
    a cut or occurs more than once.
    """
    rows = records.join(corrections.select("id", "from", "to"), "id", "left")
    count = F.size("segments")
    order = F.coalesce("ja_order", F.sequence(F.lit(0), count - 1))
    valid = (F.array_sort(order) == F.sequence(F.lit(0), count - 1)) & (count > 0)
    zh = F.array_join(F.transform("segments", lambda s: F.coalesce(s["text_zh"], F.lit(""))), "")
    ja = F.array_join(F.transform(order, lambda i: F.coalesce(F.get("segments", i)["text_ja"], F.lit(""))), "")
    holding = F.filter("segments", lambda s: F.contains(s["text_zh"], F.col("from")))
    once = (F.size(holding) == 1) & (T.occurrences(F.get(holding, 0)["text_zh"], F.col("from")) == 1)
    some = F.col("from").isNotNull()
    problem = F.when(some & ~F.coalesce(valid, F.lit(False)), "bad_order").when(some & ~T.split_hash(zh, ja).eqNullSafe(F.col("text_hash")), "hash_mismatch").when(some & F.contains(zh, F.col("from")) & ~once, "ambiguous")
    change = F.coalesce(some & problem.isNull() & F.contains(zh, F.col("from")), F.lit(False))
    new = F.transform("segments", lambda s: F.struct(s["label"].alias("label"), F.replace(s["text_zh"], F.col("from"), F.col("to")).alias("text_zh"), s["text_ja"].alias("text_ja")))
    rows = rows.withColumns({"_problem": problem, "_change": change, "_new": new})
    new_zh = F.array_join(F.transform("_new", lambda s: F.coalesce(s["text_zh"], F.lit(""))), "")
    hashed = F.when(F.col("_change"), T.split_hash(new_zh, ja)).otherwise(F.col("text_hash"))
    segments = F.when(F.col("_change"), F.col("_new")).otherwise(F.transform("segments", lambda s: F.struct(s["label"].alias("label"), s["text_zh"].alias("text_zh"), s["text_ja"].alias("text_ja"))))
    done = rows.withColumns({"text_hash": hashed, "segments": segments}).select(*records.columns)
    return done, rows.where("_problem IS NOT NULL").select("id", F.col("_problem").alias("reason"))


def synced_clauses(clauses: DataFrame, corrections: DataFrame) -> DataFrame:
    """Clauses (id, text_zh, text_ja, text_hash, ...) with the correction of their entity in the text, hashes made anew where it changed."""
    rows = clauses.join(corrections.select("id", F.col("from").alias("_from"), F.col("to").alias("_to")), "id", "left")
    hit = F.coalesce(F.contains("text_zh", F.col("_from")), F.lit(False))
    new = F.when(hit, F.replace("text_zh", F.col("_from"), F.col("_to"))).otherwise(F.col("text_zh"))
    hashed = F.when(hit, T.text_hash(F.col("text_ja"), new)).otherwise(F.col("text_hash"))
    return rows.withColumns({"text_zh": new, "text_hash": hashed}).select(*clauses.columns)


# A rule for cuts, tried out against the official quotes


def cut_rule_violations(texts: DataFrame, rule: str, exception: str | None = None) -> DataFrame:
    """id, section, n_cuts, quotes: texts (id, section, text_ja, supplement) that a cut rule would cut, with the official quotes that it would cut apart."""

    @F.pandas_udf("n_cuts int, quotes array<string>")
    def tried(text: pd.Series, supplement: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, supplement, strict=True):
            at = S.cuts(t or "", rule, exception)
            rows.append((len(at), S.quotes_cut(t or "", at, S.quoted(s))))
        return pd.DataFrame(rows, columns=["n_cuts", "quotes"])

    return texts.select(*KEYS, tried("text_ja", "supplement").alias("t")).where("t.n_cuts > 0").select(*KEYS, "t.n_cuts", "t.quotes")
