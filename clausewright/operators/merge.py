"""Merging fresh annotations with stored ones by the authority of their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.functions.vocab import OPTIONAL

KEYS = ("id", "section", "label")
#: Sources whose values outlive a fresh run.
KEPT = ("llm", "llm_then_rule", "manual", "official")


def merge(fresh: DataFrame, prior: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fresh rows merged with prior ones of the same keys, and ``event``: what is to be reported.

    Both have text, text_hash, kind, optional, role, source, needs_review, tags; fresh may have rejudge and
    optional_official (the official text itself gave the value).

    none or rule before: fresh. official on official: fresh over prior, field by field. Judged on judged with rejudge:
    fresh. Else prior's values stay with fresh's text; a late official statement fills them in where it does not
    contradict, and where the text changed or either side asks for it the row needs review.
    """
    values = ("kind", "optional", "role")
    for name, kind in (("rejudge", False), ("optional_official", False)):
        if name not in fresh.columns:
            fresh = fresh.withColumn(name, F.lit(kind))
    old = prior.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"p_{c}") for c in (*values, "source", "needs_review", "text_hash", "tags")), F.lit(True).alias("p_here"))
    both = fresh.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    f, p = (lambda c: F.col(c)), (lambda c: F.col(f"p_{c}"))

    def differ(names: Sequence[str] = values) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | ~f(n).eqNullSafe(p(n))
        return out

    rejudge = F.coalesce(f("rejudge"), F.lit(False)) & (f("source") == "llm")
    mode = (
        F.when(p("here").isNull(), "new")
        .when(p("source").isNull() | ~p("source").isin(*KEPT), "fresh")
        .when((p("source") == "official") & (f("source") == "official"), "official")
        .when(p("source").isin("llm", "llm_then_rule") & rejudge, "rejudged")
        .when((f("source") == "official") & (p("source") != "manual") & (p("kind").isNull() | (p("kind") == f("kind"))), "upgrade")
        .when((f("source") == "official") & ~p("kind").eqNullSafe(f("kind")), "conflict")
        .otherwise("kept")
    )
    mode = F.coalesce(mode, F.lit("kept"))
    both = both.withColumn("_mode", mode)
    m = F.col("_mode")

    def value(n: str) -> Column:
        over = F.coalesce(f(n), p(n))
        official = F.when(F.coalesce(f("optional_official"), F.lit(False)), over).otherwise(F.coalesce(p(n), f(n))) if n == "optional" else over
        return F.when(m.isin("new", "fresh", "rejudged"), f(n)).when(m == "official", official).when(m == "upgrade", over).otherwise(p(n))

    merged = {n: value(n) for n in values}
    source = F.when(m.isin("new", "fresh", "rejudged", "official", "upgrade"), f("source")).otherwise(p("source"))
    tags = F.when(m.isin("new", "fresh"), f("tags")).otherwise(p("tags"))
    review = F.when(m.isin("new", "fresh", "official", "rejudged"), f("needs_review")).otherwise(F.coalesce(p("needs_review"), F.lit(False)) | F.coalesce(f("needs_review"), F.lit(False)) | ~f("text_hash").eqNullSafe(p("text_hash")))
    event = (
        F.when((m == "fresh") & (p("source") == "rule") & differ(), "rule_changed")
        .when((m == "official") & differ(), "official_changed")
        .when((m == "rejudged") & differ(), "judgment_rejudged")
        .when((m == "kept") & rejudge & differ(), "judgment_rejudge_refused")
        .when(m == "upgrade", "late_official_upgrade")
        .when(m == "conflict", "late_official_conflict")
        .when((m == "kept") & (f("source") == "llm") & differ(), "judgment_overridden")
    )
    out = both.withColumns({"_source": source, "_tags": tags, "_review": review, "event": event} | {f"_{n}": v for n, v in merged.items()})
    same = [c for c in fresh.columns if c not in (*values, "source", "tags", "needs_review", "rejudge", "optional_official")]
    return out.select(*same, *(F.col(f"_{n}").alias(n) for n in values), F.col("_source").alias("source"), F.col("_tags").alias("tags"), F.col("_review").alias("needs_review"), "event")


def orphans(prior: DataFrame, fresh: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stored rows that no fresh row has the keys of."""
    return prior.join(fresh.select(*keys).distinct(), list(keys), "left_anti")


def judged(clauses: DataFrame, judgments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Clauses with the last judgment of each key by seq, ``judged_optional`` (the optional value that it gives) and ``judgment``: what came of it.

    A kind that official text gave is confirmed, or gives way to the judged one, which makes the row need review
    (late_official_conflict): the likeliest cause is a wrong cut. A kind that a rule set stands (judgment_vs_rule where they
    differ). Where there is none yet the judged kind and role are taken (judged), unless it is blank (judgment_blank).
    The optional value counts beside an official kind and with a kind that is taken, and is dropped with the others.
    """
    last = judgments.groupBy(*keys).agg(F.max_by(F.struct("kind", "optional", "role"), "seq").alias("j"))
    rows = clauses.join(last, list(keys), "left")
    kind, here, given = F.col("kind"), F.col("j").isNotNull(), F.nullif(F.col("j")["kind"], F.lit(""))
    official = F.coalesce(F.col("source") == "official", F.lit(False))
    outcome = (
        F.when(here & official & given.isNotNull() & ~given.eqNullSafe(kind), "late_official_conflict")
        .when(here & official, "judgment_confirmed")
        .when(here & kind.isNotNull() & ~given.eqNullSafe(kind), "judgment_vs_rule")
        .when(here & kind.isNull() & given.isNull(), "judgment_blank")
        .when(here & kind.isNull(), "judged")
    )
    rows = rows.withColumn("judgment", outcome)
    said = F.coalesce(F.col("judgment"), F.lit(""))
    take, conflict = said == "judged", said == "late_official_conflict"
    return rows.withColumns(
        {
            "kind": F.when(take | conflict, given).otherwise(kind),
            "role": F.when(take, F.col("j")["role"]).otherwise(F.col("role")),
            "source": F.when(take | conflict, "llm").otherwise(F.col("source")),
            "needs_review": F.coalesce("needs_review", F.lit(False)) | conflict,
            "judged_optional": F.when(take | conflict | (said == "judgment_confirmed"), F.nullif(F.col("j")["optional"], F.lit(""))),
        }
    ).drop("j")


#: Kinds that are activated, which a rule may give an optional value; the other kinds that carry one take it from official text or a judgment alone.
ACTIVATED = ("q", "t")
CARRIED = tuple(k for k in OPTIONAL.carriers if k not in ACTIVATED)


def optional_by_rule(text_ja: Column, unsplit: Column, activation: Column | None = None) -> Column:
    """struct<value, reason>: the value by the activation clause, or why there is none: unsplit (the first sentence of a text that is not yet cut need not be one), no_text or no_activation."""
    bare = F.coalesce(text_ja, F.lit("")) == ""
    whole = F.coalesce(unsplit, F.lit(False))
    value = F.when(~whole & ~bare, T.optional_by_rule(text_ja, activation))
    return F.struct(value.alias("value"), F.when(value.isNull(), F.when(whole, "unsplit").when(bare, "no_text").otherwise("no_activation")).alias("reason"))


def optionals(clauses: DataFrame, rule: Column | None = None) -> DataFrame:
    """Clauses (kind, text_ja, unsplit, mandatory, judged_optional; no texts where ``optional_by_rule`` is given as ``rule``) with ``optional``, and how it came about.

    optional_by: official (text that says that it is mandatory), llm or rule; null where there is no value. pending: why an activated
    clause has none. dropped: array of what is left out, mandatory_kind_unknown or mandatory_other_kind (official text says mandatory of
    a clause without a kind, or of one that carries no value) and judgment_optional_dropped. validation: what the rule says where
    official text says mandatory: agree, disagree, or why it says nothing.
    """
    kind, must, told = F.col("kind"), F.coalesce("mandatory", F.lit(False)), F.col("judged_optional")
    rule = optional_by_rule(F.col("text_ja"), F.col("unsplit")) if rule is None else rule
    activated, carried = (F.coalesce(kind.isin(*kinds), F.lit(False)) for kinds in (ACTIVATED, CARRIED))
    value = F.when(activated | carried, F.when(must, "m").otherwise(F.coalesce(told, F.when(activated, F.col("_rule")["value"]))))
    by = F.when(activated | carried, F.when(must, "official").when(told.isNotNull(), "llm").when(activated & F.col("_rule")["value"].isNotNull(), "rule"))
    other = ~activated & ~carried
    dropped = F.array_compact(F.array(F.when(other & must, F.when(kind.isNull(), "mandatory_kind_unknown").otherwise("mandatory_other_kind")), F.when(other & told.isNotNull(), "judgment_optional_dropped")))
    outcome = F.when(must, F.when(F.col("_rule")["value"] == "m", "agree").when(F.col("_rule")["value"].isNotNull(), "disagree").otherwise(F.col("_rule")["reason"]))
    out = clauses.withColumn("_rule", rule).withColumns({"optional": value, "optional_by": by, "dropped": dropped, "validation": outcome})
    return out.withColumn("pending", F.when(activated & F.col("optional").isNull(), F.col("_rule")["reason"])).drop("_rule")


def optional_tally(clauses: DataFrame) -> DataFrame:
    """attested, predicted, agree, disagree, unsplit, no_text, no_activation: how far the rule reaches the values that official text gives, in one row."""
    said = F.col("validation")
    return clauses.agg(F.count(said).alias("attested"), F.count_if(said.isin("agree", "disagree")).alias("predicted"), *(F.count_if(said == n).alias(n) for n in ("agree", "disagree", "unsplit", "no_text", "no_activation")))


def spread_review(clauses: DataFrame, by: str = "id") -> DataFrame:
    """One flagged clause flags its entity."""
    return clauses.withColumn("needs_review", F.coalesce(F.max("needs_review").over(Window.partitionBy(by)), F.lit(False)))


def upgraded_source(source: Column, kind: Column, predicted: Column) -> Column:
    """A judged value that a rule agrees with is llm_then_rule."""
    return F.when((source == "llm") & (kind == predicted), "llm_then_rule").otherwise(source)


def judgment(kind: Column, optional: Column, role: Column) -> Column:
    """The three values that a judgment gives, for comparing: nulls are equal."""
    return F.struct(kind.alias("kind"), optional.alias("optional"), role.alias("role"))


def judgment_text(kind: Column, optional: Column, role: Column) -> Column:
    """A judgment to read: kind or a dash, role and value, those that there are."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("/", F.coalesce(blank(kind), F.lit("—")), blank(role), blank(optional))


def attested(clauses: DataFrame, assigned: DataFrame) -> DataFrame:
    """Clauses with the kinds that official statements give them, which make them official, and ``mandatory``.

    ``assigned``: id, section, label, kind (may be null), mandatory, as ``attest.attest`` gives it.
    """
    told = assigned.select("id", "section", "label", F.col("kind").alias("_kind"), F.col("mandatory").alias("_must"))
    rows = clauses.drop("mandatory").join(told, ["id", "section", "label"], "left")
    kind, source = F.coalesce("_kind", "kind"), F.when(F.col("_kind").isNotNull(), "official").otherwise(F.col("source"))
    return rows.withColumns({"kind": kind, "source": source, "mandatory": F.coalesce("_must", F.lit(False))}).drop("_kind", "_must")
