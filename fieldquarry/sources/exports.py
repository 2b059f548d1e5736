"""Exports with manifests, verification, fingerprints and stage isolation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: columns that tell an outcome and must not reach a selector
OUTCOMES = ("heldout", "held_out", "recovered", "recall", "covered_", "detected")


def fingerprint(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def row_digest(df: DataFrame, columns: list[str] | None = None):
    """SHA-256 of a row's JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"}), 256)


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_count, content_sha256): the digest of each key's row digests, which no order changes.

    Digests are summed as numbers, so a key's rows need not meet in one task.
    """
    d = row_digest(df)
    parts = [F.sum(F.conv(F.substring(d, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256).alias("content_sha256"))


def export_folds(df: DataFrame, path: str, keys: list[str] = ("pair_id", "repeat")) -> DataFrame:
    """Write a fold table partitioned by its keys, and its manifest beside it (S13); returns the manifest."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/data")
    manifest(df, [*keys]).write.mode("overwrite").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def verify_export(spark: SparkSession, path: str, keys: list[str] = ("pair_id", "repeat")) -> DataFrame:
    """Keys whose data and manifest disagree, or which only one of them has; none if all is well."""
    now = manifest(spark.read.parquet(f"{path}/data"), [*keys]).withColumnsRenamed({"row_count": "rows_now", "content_sha256": "sha_now"})
    told = spark.read.parquet(f"{path}/manifest")
    both = told.join(now, [*keys], "full")
    return both.filter(~(F.col("row_count").eqNullSafe(F.col("rows_now")) & F.col("content_sha256").eqNullSafe(F.col("sha_now"))))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def leaked_columns(df: DataFrame) -> list[str]:
    """Columns that tell an outcome (S14): selector inputs must have none."""
    return [c for c in df.columns if c.lower().startswith(OUTCOMES)]


def staged(stages: list[tuple[str, Callable[[], DataFrame]]], path: str, spark: SparkSession) -> DataFrame:
    """Write each stage apart, in order; a failing one ends the run and leaves the earlier ones as they are.

    Returns one row: the stages done, the one that failed, and why.
    """
    done, failed, why = [], None, None
    for name, make in stages:
        try:
            make().write.mode("overwrite").parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001 - whatever a stage raises is its failure, reported in the row
            failed, why = name, str(e).splitlines()[0] if str(e) else type(e).__name__
            break
        done.append(name)
    return spark.createDataFrame([(done, failed, why)], "completed_stages array<string>, failed_stage string, failure string")
