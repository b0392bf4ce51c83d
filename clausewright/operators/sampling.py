"""Stratified samples with quotas, and scores by class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators.attest import NON_EFFECT
from clausewright.plans.order import ranked

#: Rows that may be left out of a score as ambiguous or for faults of the process.
MOST_EXCLUDED = 5


def _largest_remainder(seats: int, weights: Mapping[str, int], room: Mapping[str, int]) -> dict[str, int]:
    """``seats`` in proportion to ``weights``: whole parts, then one each by remainder, weight and name; none beyond its room."""
    whole, over = {}, []
    for name, weight in weights.items():
        part, rest = divmod(seats * weight, sum(weights.values()))
        whole[name] = min(part, room[name])
        over.append((-rest, -weight, name))
    spare = seats - sum(whole.values())
    for *_, name in sorted(over):
        if spare and whole[name] < room[name]:
            whole[name] += 1
            spare -= 1
    return whole


def quotas(available: Mapping[str, int], total: int, least: int = 0) -> dict[str, int]:
    """How many of each class: ``least`` of each as far as there are, then the rest by largest remainder, again and again until it is given out or nothing is left."""
    given = {c: min(least, n) for c, n in available.items()}
    while sum(given.values()) < total and (open_ := {c: n for c, n in available.items() if n > given[c]}):
        more = _largest_remainder(total - sum(given.values()), open_, {c: n - given[c] for c, n in open_.items()})
        given = {c: n + more.get(c, 0) for c, n in given.items()}
    return given


def stratified(rows: DataFrame, by: str, quota: Mapping[str, int], seed: int, *key: str, salts: int = 64) -> DataFrame:
    """The rows of each class that come first by a seeded hash of the key, as many as its quota.

    Rows are ranked within a part of their class first, and only as many of each part as the quota could take are ranked again: no task sorts a class.
    """
    wanted = F.broadcast(rows.sparkSession.createDataFrame(list(quota.items()), f"`{by}` string, _quota long"))
    draw = F.xxhash64(F.lit(seed), *key)
    held = rows.join(wanted, by).withColumn("_draw", draw).withColumn("_salt", F.pmod(F.xxhash64("_draw"), F.lit(salts)))
    for part in ([by, "_salt"], [by]):
        held = held.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy("_draw", *key))).where("_rank <= _quota")
    return held.drop("_rank", "_quota", "_draw", "_salt")


def recall_by_class(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """class, n, right, recall (null where n is 0)."""
    each = rows.select(truth.alias("class"), F.coalesce(truth == said, F.lit(False)).alias("ok")).where("class IS NOT NULL")
    return each.groupBy("class").agg(F.count("*").alias("n"), F.count_if("ok").alias("right")).withColumn("recall", F.try_divide("right", "n"))


def overall(scored: DataFrame) -> DataFrame:
    """One row: scored, right, accuracy (null where nothing is scored)."""
    return scored.where("status IN ('right', 'wrong', 'blank')").agg(F.count("*").alias("scored"), F.count_if(F.col("status") == "right").alias("right")).withColumn("accuracy", F.try_divide("right", "scored"))


def score(sample: DataFrame, answers: DataFrame, now: DataFrame, keys: list[str], kinds: Sequence[str] | None = None, ambiguous: DataFrame | None = None, pipeline: DataFrame | None = None) -> DataFrame:
    """keys, status, class, answer of each sampled row, and of answers and exclusions that are for none.

    ``sample``: keys and text; ``answers``: keys and kind; ``now``: keys, text, kind and source; ``ambiguous`` and
    ``pipeline``: keys of rows that are left out because the official text is ambiguous, or the process was at fault.

    stale: the row is gone or its text changed; withdrawn: its kind is no longer official or none of ``kinds``;
    ambiguous, pipeline: left out; missing: no answer; invalid: an answer that is no kind; else right, wrong, or blank
    for an answer without a kind. extra: an answer, and unknown: an exclusion, for a row that is not in the sample.
    """
    given = answers.groupBy(*keys).agg(F.max("kind").alias("answer"), F.lit(True).alias("answered"))
    current = now.select(*keys, F.col("text").alias("now_text"), F.col("kind").alias("class"), "source", F.lit(True).alias("here"))
    rows = sample.select(*keys, "text", F.lit(True).alias("sampled")).join(given, keys, "full").join(current, keys, "left")
    left_out = [(name, frame) for name, frame in (("ambiguous", ambiguous), ("pipeline", pipeline)) if frame is not None]
    for name, frame in left_out:
        rows = rows.join(frame.select(*keys, F.lit(True).alias(f"_{name}")).distinct(), keys, "full")
    out_of = {name: F.coalesce(F.col(f"_{name}"), F.lit(False)) if name in dict(left_out) else F.lit(False) for name in ("ambiguous", "pipeline")}
    known = (lambda c: c.isin(*kinds)) if kinds else (lambda c: c.isNotNull())
    sampled, here = F.coalesce("sampled", F.lit(False)), F.col("here").isNotNull()
    status = (
        F.when(~sampled & F.col("answered").isNotNull(), "extra")
        .when(~sampled, "unknown")
        .when(~here | ~F.col("text").eqNullSafe(F.col("now_text")), "stale")
        .when(~F.col("source").eqNullSafe(F.lit("official")) | ~F.coalesce(known(F.col("class")), F.lit(False)), "withdrawn")
        .when(out_of["ambiguous"], "ambiguous")
        .when(out_of["pipeline"], "pipeline")
        .when(F.col("answered").isNull(), "missing")
        .when(F.col("answer").isNull(), "blank")
        .when(~known(F.col("answer")), "invalid")
        .when(F.col("answer") == F.col("class"), "right")
        .otherwise("wrong")
    )
    return rows.select(*keys, status.alias("status"), "class", "answer")


def passed(scored: DataFrame, excluded: int = 0) -> bool:
    """Whether nothing is stale, missing, extra, invalid or unknown, few rows were left out of each kind, there is a class, and every class was recalled in full.

    Withdrawn rows are the data's own progress and do not count.
    """
    counts = {r["status"]: r["count"] for r in scored.groupBy("status").count().collect()}  # one a status
    caps = max(excluded, counts.get("ambiguous", 0), counts.get("pipeline", 0)) <= MOST_EXCLUDED
    return caps and counts.get("right", 0) > 0 and not set(counts) - {"right", "withdrawn", "ambiguous", "pipeline"} and fully_recalled(scored)


def fully_recalled(scored: DataFrame) -> bool:
    """Whether every class of the rows that count has some, and all of them right."""
    by = scored.where("class IS NOT NULL AND status IN ('right', 'wrong', 'blank', 'ambiguous', 'pipeline')").groupBy("class").agg(F.count_if(F.col("status") == "right").alias("right"), F.count_if(F.col("status").isin("right", "wrong", "blank")).alias("n"))
    return by.where("n = 0 OR right < n").isEmpty()


# Blind samples


def excluded_ids(*samples: DataFrame, ids: Sequence[int] = ()) -> DataFrame:
    """id of all entities of earlier samples and of a list, once each."""
    spark = samples[0].sparkSession
    out = spark.createDataFrame([(int(i),) for i in ids], "id long")
    for s in samples:
        out = out.unionByName(s.select(F.col("id").cast("long").alias("id")))
    return out.distinct()


def candidates(clauses: DataFrame, kinds: Sequence[str], excluded: DataFrame | None = None) -> DataFrame:
    """Clauses with an official kind of ``kinds``; excluded entities go with all their clauses, since they share one official text."""
    rows = clauses.where((F.col("source") == "official") & F.col("kind").isin(*kinds))
    return rows if excluded is None else rows.join(excluded.select("id"), "id", "left_anti")


def preamble_contexts(clauses: DataFrame) -> DataFrame:
    """id, section, preamble: the original texts of a section's preambles, in order, a line each."""
    own = clauses.where(F.col("label").rlike(r"\A0(-.*)?\z") & (F.coalesce("text_ja", F.lit("")) != ""))
    held = own.groupBy("id", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "text_ja"))).alias("_p"))
    return held.select("id", "section", F.array_join(F.transform("_p", lambda x: x["text_ja"]), "\n").alias("preamble"))


#: What tells the answer in an official text.
CONCLUSIONS = "誘発即時効果|誘発効果|起動効果|永続効果|分類されない|必ず発動"
_RESIDUE = r"(?U)\A[\s。、，,・…（）()「」『』■\-—]*\z"


def without_conclusions(supplement: Column) -> Column:
    """An official text without the sentences that tell a kind; headings stay, closing brackets that have lost their opening ones and lines with nothing left go."""

    def line(raw: Column) -> Column:
        head = F.regexp_extract(raw, r"\A(【[^】]*】)", 1)
        kept = F.filter(F.split(F.substring(raw, F.length(head) + 1, F.length(raw)), "(?<=。)"), lambda s: ~s.rlike(f"{CONCLUSIONS}|{NON_EFFECT}"))
        body = F.array_join(kept, "")
        surplus = F.length(F.regexp_replace(body, "[^）)]", "")) - F.length(F.regexp_replace(body, "[^（(]", ""))
        hanging = F.greatest(F.lit(0), F.least(surplus, F.length(F.regexp_extract(body, "([）)]*)\\z", 1))))
        tidy = T.trimmed(F.substring(body, F.lit(1), F.length(body) - hanging))
        return F.concat(head, F.when(tidy.rlike(_RESIDUE), "").otherwise(tidy))

    masked = F.transform(F.split(F.coalesce(supplement, F.lit("")), "\n"), lambda x: line(T.trimmed(x)))
    return F.array_join(F.filter(masked, lambda x: x != ""), "\n")


def blind_rows(chosen: DataFrame, clauses: DataFrame, cards: DataFrame, supplements: DataFrame) -> DataFrame:
    """id, section, label, name_zh, name_ja, text_zh, text_ja, preamble, supplement of chosen clauses: all that helps to judge them, and nothing that tells the answer.

    A preamble itself gets no preamble; a pendulum's clause gets the pendulum's official text.
    """
    said = supplements.select("id", F.col("name_ja").alias("_ja"), F.col("supplement").alias("_main"), "pen_supplement")
    rows = chosen.select("id", "section", "label", "text_zh", "text_ja").join(preamble_contexts(clauses), ["id", "section"], "left").join(cards.select("id", "name_zh", "name_ja"), "id", "left").join(said, "id", "left")
    text = F.when(F.col("section") == "pendulum", F.col("pen_supplement")).otherwise(F.col("_main"))
    preamble = F.when(F.col("label").rlike(r"\A0(-.*)?\z"), "").otherwise(F.coalesce("preamble", F.lit("")))
    name = F.coalesce(F.nullif("_ja", F.lit("")), "name_ja", F.lit(""))
    return rows.select("id", "section", "label", F.coalesce("name_zh", F.lit("")).alias("name_zh"), name.alias("name_ja"), "text_zh", "text_ja", preamble.alias("preamble"), without_conclusions(text).alias("supplement"))


def answer_key(clauses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind: what is official now; a judged kind is no answer to hold a judge against."""
    return clauses.select(*keys, F.when(F.col("source") == "official", F.col("kind")).alias("kind"))


def evenly(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """``n`` rows at even steps of an order, both ends included."""
    total = rows.count()
    if n <= 0 or not total:
        return rows.limit(0)
    places = sorted({round(i * (total - 1) / (n - 1)) + 1 for i in range(n)}) if n > 1 else [1]
    numbered = ranked(rows, *order, name="_place")
    return numbered.where(F.col("_place").isin([int(p) for p in places if p <= total])).drop("_place")
