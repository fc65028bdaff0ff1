"""What independent annotations of the same instance agree on: votes, ranges, agreement.

Input: `candidates` (inst, run, file, s, e), lines s to e of a file as one run named them; e < s names the file alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOTES = 2


def coverage(candidates: DataFrame) -> DataFrame:
    """(inst, file, s, e, k): stretches of lines that the same number k of runs name, in ranges from end to end: a line costs nothing.

    Each run's ranges are merged first, so a line counts once per run. One shuffle by file serves every step.
    """
    real = candidates.where("e >= s").select("inst", "run", "file", "s", "e").repartition("inst", "file")
    by_run = Window.partitionBy("inst", "file", "run").orderBy("s", "e")
    reach = F.max("e").over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    apart = real.withColumn("_new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(by_run.rowsBetween(Window.unboundedPreceding, 0)))
    merged = apart.groupBy("inst", "file", "run", "_i").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    ends = merged.select("inst", "file", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy("inst", "file", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    by_file = Window.partitionBy("inst", "file").orderBy("at")
    k = F.sum("d").over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    return ends.select("inst", "file", F.col("at").alias("s"), (F.lead("at").over(by_file) - 1).alias("e"), k.alias("k")).where("k > 0")


def joined(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, s, e) that do not overlap; those that touch become one."""
    w = Window.partitionBy(*keys).orderBy("s")
    new = F.coalesce((F.col("s") > F.lag("e").over(w) + 1).cast("int"), F.lit(1))
    flagged = ranges.withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return flagged.groupBy(*keys, "_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_i")


def voted_ranges(candidates: DataFrame, votes: int = VOTES) -> DataFrame:
    """Files named by `votes` runs with the ranges whose every line was named by `votes` runs; a file without such lines has null ends."""
    files = candidates.groupBy("inst", "file").agg(F.countDistinct("run").alias("runs")).where(F.col("runs") >= votes)
    kept = coverage(candidates).where(F.col("k") >= votes).select("inst", "file", "s", "e")
    return files.join(joined(kept, ["inst", "file"]), ["inst", "file"], "left")


def file_agreement(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per instance: files all runs name, files any names, and the floored percentage (null if none). Runs come from `runs` (inst, run)."""
    n = runs.groupBy("inst").agg(F.countDistinct("run").alias("n_runs"))
    by_file = candidates.groupBy("inst", "file").agg(F.countDistinct("run").alias("named"))
    both = n.join(by_file, "inst", "left").groupBy("inst", "n_runs").agg(F.count_if(F.col("named") == F.col("n_runs")).alias("shared"), F.count("named").alias("total"))
    return both.withColumn("percent", F.when(F.col("total") > 0, F.expr("100 * shared div total")))


def split_files(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(inst, file, named): files that some runs of the instance name and others do not."""
    n = runs.groupBy("inst").agg(F.countDistinct("run").alias("n_runs"))
    return candidates.groupBy("inst", "file").agg(F.countDistinct("run").alias("named")).join(n, "inst").where("named < n_runs").select("inst", "file", "named")


def line_iou(runs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per file that all runs name: lines all runs name, lines any names, their ratio (0 if there is no line)."""
    n = runs.groupBy("inst").agg(F.countDistinct("run").alias("n_runs"))
    shared = candidates.groupBy("inst", "file").agg(F.countDistinct("run").alias("named")).join(n, "inst").where("named = n_runs").select("inst", "file", "n_runs")
    size = F.col("e") - F.col("s") + 1
    out = shared.join(coverage(candidates), ["inst", "file"], "left").groupBy("inst", "file")
    out = out.agg(F.coalesce(F.sum(F.when(F.col("k") == F.col("n_runs"), size)), F.lit(0)).alias("both"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    return out.withColumn("iou", F.when(F.col("total") > 0, F.col("both") / F.col("total")).otherwise(F.lit(0.0)))
