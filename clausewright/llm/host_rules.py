"""Quality rules with host verdicts: rule failures by domain, shrunk by an empirical beta prior, joined back to documents.

All of it is built-in functions. A document's features come from one pass over its text; its word windows are hashed
inside the row, so nothing but a few numbers for each document is shuffled, and failures are added up per host before
they move. Hosts here are the values of ``source``.

Defined results: a null text has no words and fails; a null source is a host of its own; repeated rows count as rows
of their own; no documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import WORD, checkpointed


def rule_features(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    last = F.size("_words") - width + 1
    rows = rows.withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    # A window's hash is that of its words' hashes: no array is made for it.
    window = lambda i: F.xxhash64(*(F.get("_each", i + j) for j in range(width)))
    rows = rows.withColumn("_hashes", F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_sorted"),
    )
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("_again", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.transform("_again", lambda p, k: F.least(F.lit(width), F.coalesce(F.get("_again", k + 1) - p, F.lit(width))))
    return rows.select(
        "doc_id",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(judged: DataFrame, most: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_kept, from rows of source and base_failed.

    The beta prior has the mean m of all rows and, by moments, the strength m (1 - m) / v - 1 for the variance v of
    the hosts' rates, between 1 and 10,000. A host whose shrunk rate is over ``most`` is rejected.
    """
    hosts = judged.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    hosts = checkpointed(hosts.withColumn("own", F.col("n_failed") / F.col("n_docs")))
    # Two rows of sums, whatever the number of hosts.
    (mean,) = hosts.agg(F.sum("n_failed") / F.sum("n_docs")).head()
    mean = F.lit(mean).cast("double")
    (spread,) = hosts.agg(F.avg((F.col("own") - mean) * (F.col("own") - mean))).head()
    strength = F.coalesce(F.try_divide(mean * (1 - mean), F.lit(spread).cast("double")) - 1, F.lit(10000.0))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(10000.0), strength))
    rate = (F.col("n_failed") + strength * mean) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= most).alias("host_kept"))


def judge(docs: DataFrame, least_words: int = 20, most_repeated: int = 30, most: float = 0.5) -> DataFrame:
    """The features with base_failed and kept: a document is kept if it passes the base rules and its host is kept."""
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = checkpointed(rule_features(docs).withColumn("base_failed", failed))
    hosts = host_verdicts(judged, most)
    joined = judged.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("rate", 9).alias("host_rate"), (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))
