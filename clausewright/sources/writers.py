"""Sinks: Parquet in versioned folders, JSON lines in key order, and a JSON sidecar."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clausewright.operators.checks import INDEX_CHECKS, CheckFailed, require


def write_versioned(df: DataFrame, folder: str, version: str) -> str:
    """Parquet under folder/version=..., written whole or not at all by Spark's commit; versions sort by name. An existing version is an error."""
    path = f"{folder}/version={version}"
    df.write.parquet(path)
    return path


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The version that sorts last."""
    versions = spark.read.parquet(folder).select("version").distinct().agg(F.max("version").alias("v")).head()["v"]
    return spark.read.parquet(f"{folder}/version={versions}")


def write_checked(df: DataFrame, found: DataFrame, path: str) -> None:
    """Write only if there are no violations; raise with all of them otherwise."""
    require(found)
    df.write.mode("overwrite").parquet(path)


def publish(spark: SparkSession, staged: Mapping[str, str]) -> None:
    """Moves written folders or files to their targets, {staged: target}; what a target held before goes only after all have moved, and comes back if one cannot."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    moved: list[tuple[str, str | None]] = []
    for source, target in staged.items():
        to, old = path(target), None
        fs = to.getFileSystem(conf)
        try:
            if fs.exists(to):
                old = f"{target}.old-{uuid.uuid4().hex}"
                if not fs.rename(to, path(old)):
                    raise OSError(f"cannot move {target}")
            if not fs.rename(path(source), to):
                raise OSError(f"cannot move {source} to {target}")
        except Exception:
            if old is not None and not fs.exists(to):
                fs.rename(path(old), to)
            for done, before in reversed(moved):
                fs.delete(path(done), True)
                if before is not None:
                    fs.rename(path(before), path(done))
            raise
        moved.append((target, old))
    for target, old in moved:
        if old is not None:
            path(old).getFileSystem(conf).delete(path(old), True)


def write_index(checked: DataFrame, path: str) -> int:
    """Writes the rows of ``checks.checked_index`` and counts their problems in the same pass; the number of rows that are there then.

    The rows are written beside the target, which they become only if there are no problems; else nothing is left of them
    and the error has the count of every check.
    """
    spark = checked.sparkSession
    told = Observation()
    of = lambda name: F.sum(F.size(F.filter("problems", lambda p: p["check"] == name)))
    counts = {n: of(n) for n in INDEX_CHECKS}
    seen = checked.observe(told, F.count("id").alias("rows"), *(c.alias(n) for n, c in counts.items()))
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    seen.where("id IS NOT NULL").drop("card_id", "problems").write.parquet(staged)
    found = told.get
    problems = {n: found[n] for n in INDEX_CHECKS if found[n]}
    if problems:
        at = spark._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        raise CheckFailed("; ".join(f"{n}: {k}" for n, k in sorted(problems.items())))
    publish(spark, {staged: path})
    return found["rows"]


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """One object a line with the columns' order of keys, nulls left out, in the order of ``order`` over all files."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_sidecar(spark: SparkSession, content: dict, path: str) -> None:
    """A small JSON document with sorted keys."""
    text = json.dumps(content, ensure_ascii=False, sort_keys=True, indent=1)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def missing_keys(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that are still to be fetched."""
    return wanted.select(key).distinct().join(cached.select(key), key, "left_anti")
