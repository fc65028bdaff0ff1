"""Manifests against files: what matches, changed, is missing or extra, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest (rel, sha256), files (rel, sha256): (rel, state) by a full outer join."""
    m, f = manifest.select("rel", F.col("sha256").alias("want"), F.lit(True).alias("_m")), files.select("rel", F.col("sha256").alias("have"), F.lit(True).alias("_f"))
    state = F.when(F.col("_m").isNull(), "extra").when(F.col("_f").isNull(), "missing").when(F.col("want").eqNullSafe(F.col("have")), "ok").otherwise("changed")
    return m.join(f, "rel", "full_outer").select("rel", state.alias("state"))


def status(compared: DataFrame) -> DataFrame:
    """One row of counts."""
    return compared.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("ok", "changed", "missing", "extra")))


def recommendation(has_manifest: Column, head: Column, revision: Column, changed: Column, missing: Column, extra: Column) -> Column:
    """One of six next steps."""
    clean, synced = (changed == 0) & (missing == 0) & (extra == 0), head.isNotNull() & head.eqNullSafe(revision)
    return (
        F.when(~has_manifest, "never pushed").when(head.isNull(), "remote missing").when(clean & synced, "in sync")
        .when(clean, "remote ahead").when(synced, "local changes").otherwise("diverged")
    )


def fetched(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files to fetch that are there with the right hash already, those there with another, those not there."""
    j = manifest.select("rel", "sha256").join(files.select("rel", F.col("sha256").alias("have")), "rel", "left")
    same = F.col("have") == F.col("sha256")
    return j.agg(F.count_if(same).alias("present"), F.count_if(~same).alias("mismatched"), F.count_if(F.col("have").isNull()).alias("to_fetch"))


def manifest_of(files: DataFrame) -> DataFrame:
    """files (rel, content): (rel, sha256, bytes)."""
    return files.select("rel", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes"))


def totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("n_bytes"))
