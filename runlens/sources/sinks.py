"""Writers: combined tables with a sidecar, ledger shards, manifests, reports."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import annotations, grading, ledger, reconcile
from runlens.session import discard, materialise
from runlens.sources import files as disk

ROLLOUT = ("sweep", "inst", "rollout")
KEY = (*ROLLOUT, "task", "attempt")


def write_combined(rows: DataFrame, path: str) -> DataFrame:
    """One row per instance, in order of id; an empty input writes an empty table of the same two columns. Returns the sidecar."""
    annotations.combined(rows).withColumnRenamed("inst", "instance_id").repartitionByRange("instance_id").sortWithinPartitions("instance_id").write.mode("overwrite").parquet(path)
    return sidecar(rows.sparkSession, path)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, snippets, when it was made, and the digest of the table's file - of several, over their digests in order."""
    table = spark.read.parquet(path).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.json_array_length("relevant_snippets")), F.lit(0)).cast("bigint").alias("n_snippets")).first()
    files = disk.digested(disk.listed(spark, path, "*.parquet")).select("rel", F.col("sha256").alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rel", "h"))), lambda x: x["h"])
    digest = files.agg(F.when(F.count("*") == 1, F.first("h")).otherwise(F.sha2(F.array_join(ordered, ""), 256)).alias("sha256")).first()
    one = spark.createDataFrame([(table["n_rows"], table["n_snippets"], digest["sha256"])], "n_rows bigint, n_snippets bigint, sha256 string")
    return one.withColumn("built_at", F.current_timestamp())


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Adds attempts to the ledger, partitioned by sweep, instance and rollout: a row of the same full key is replaced, all others stay.

    Of several rows of one key the latest by run_ts counts; nulls in a key are a value like others.
    """
    spark = attempts.sparkSession
    own = attempts.select(*ROLLOUT).distinct()
    same = lambda a, b, keys: reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))
    try:
        held = spark.read.schema(attempts.schema).parquet(path)
        held = held.join(own, same(held, own, ROLLOUT), "left_semi")
        rows = attempts.unionByName(held.join(attempts, same(held, attempts, KEY), "left_anti"))
    except AnalysisException as e:  # the first write finds no ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = attempts
    latest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c not in KEY)), F.coalesce("run_ts", F.lit(""))).alias("r")).select(*KEY, "r.*")
    beside = materialise(spark, latest)  # the ledger is read and written: what goes in is written down first
    beside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ROLLOUT).parquet(path)
    discard(beside)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Keep bytes under a path of any file system: written beside it, then renamed over it, so that nobody sees half of them or none."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    beside, fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp"), to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside)
    out.write(bytearray(data))
    out.close()
    fs.mkdirs(to.getParent())
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark._sc._gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, to, over)


def get_bytes(spark: SparkSession, path: str) -> bytes:
    """What is kept under a path; a missing one is an error."""
    row = spark.read.format("binaryFile").load(path).first()
    if row is None:
        raise FileNotFoundError(path)
    return bytes(row["content"])


def write_terminal(spark: SparkSession, folder: str, marker: str) -> None:
    """The marker of a finished run, written last."""
    put_bytes(spark, f"{folder.rstrip('/')}/terminal.json", marker.encode())


def store_runs(runs: DataFrame, path: str) -> None:
    """runs (inst, label, annotation, last_exchange; JSON texts): one row a run in partitions by instance and label, which a run written again replaces."""
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("inst", "label").parquet(path)


def artifact_keys(files: DataFrame, keys: list[str]) -> DataFrame:
    """files (keys, name, key, exists): the recorded artifacts; a file that is not there is left out. A repeated name is an error."""
    kept = F.filter(F.collect_list(F.struct("name", "key", "exists")), lambda x: x["exists"])
    return files.groupBy(*keys).agg(F.map_from_entries(F.transform(kept, lambda x: F.struct(x["name"], x["key"]))).alias("artifact_keys"))


def write_manifest(files: DataFrame, path: str) -> DataFrame:
    """files (rel, content). Returns the totals."""
    reconcile.manifest_of(files).write.mode("overwrite").parquet(path)
    return reconcile.totals(files.sparkSession.read.parquet(path))


def run_prefix() -> Column:
    """The folder of an attempt below the store's root."""
    return ledger.store_key()


def persist(records: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Publishes runs: records (sweep, inst, rollout, task, attempt, …), files (the same keys, name, source). Returns the records with artifact_keys.

    All files of a run and then its run.json are written beside, and one rename puts the folder in its place: a run is there whole, or as
    it was before. Files that are not there are left out of the record and the run is published all the same. The records
    returned are written down, so that they can be appended to the ledger.
    """
    spark = records.sparkSession
    base, stage = root.rstrip("/"), f"{root.rstrip('/')}/.stage-{uuid.uuid4().hex}"
    prefixed = records.withColumn("_prefix", run_prefix())
    wanted = files.join(prefixed.select(*KEY, "_prefix"), list(KEY)).select(*KEY, "name", "source", F.concat(F.lit(stage + "/"), "_prefix", F.lit("/"), "name").alias("target"), F.concat_ws("/", "_prefix", "name").alias("key"))
    done = materialise(spark, disk.copied(wanted))
    kept = artifact_keys(done.select(*KEY, "name", "key", F.col("n_bytes").isNotNull().alias("exists")), list(KEY))
    own = prefixed.drop("artifact_keys").join(kept, list(KEY), "left").withColumn("artifact_keys", F.coalesce("artifact_keys", F.create_map().cast("map<string,string>")))
    shards = materialise(spark, own.withColumn("_json", F.to_json(F.struct(*(c for c in own.columns if c != "_prefix")))))
    disk.written(shards.select(F.concat(F.lit(stage + "/"), "_prefix", F.lit("/run.json")).alias("target"), F.col("_json").alias("text"))).write.format("noop").mode("overwrite").save()
    # a task whose move is interrupted after the first rename finds the folder aside and the new one still staged
    folders = shards.select(F.concat(F.lit(stage + "/"), "_prefix").alias("source"), F.concat(F.lit(base + "/"), "_prefix").alias("target"))
    disk.moved(folders).write.format("noop").mode("overwrite").save()
    disk.removed(stage)
    discard(done)
    return shards.drop("_json", "_prefix")


def promote(records: DataFrame, workspaces: DataFrame, root: str) -> DataFrame:
    """`persist` for whole workspaces: workspaces (keys, folder); every file below a folder keeps its place in it."""
    files = disk.walked(workspaces.select(*KEY, "folder")).select(*KEY, F.col("rel").alias("name"), F.col("path").alias("source"))
    return persist(records, files, root)


def report(results: DataFrame, instances: DataFrame, path: str) -> str:
    """Writes below `path` what is not OK, all of it in order of verdict and instance, as a table, then summary.json and report.md. Returns the latter's text.

    The text and the summary hold the verdict table with all verdicts in it, how many instances were verified and when.
    """
    spark, base = results.sparkSession, path.rstrip("/")
    found = {r["verdict"]: r["n"] for r in grading.histogram(results.select("verdict")).collect()}
    counts = {v: found[v] for v in grading.VERDICTS}
    span = grading.coverage(instances, results).first()
    grading.not_ok(results).write.mode("overwrite").parquet(f"{base}/not_ok")
    bad = spark.read.parquet(f"{base}/not_ok").count()
    summary = {"total": span["total"], "verified": span["verified"], "first": span["first"] or None, "last": span["last"] or None, "verdicts": counts, "not_ok": bad}
    rows = "\n".join(f"| {v} | {n} |" for v, n in counts.items())
    text = f"# Verification\n\n{span['verified']} of {span['total']} instances, {span['first'] or '-'} to {span['last'] or '-'}\n\n| verdict | n |\n| --- | --- |\n{rows}\n\n{bad} not OK, listed in {base}/not_ok\n"
    put_bytes(spark, f"{base}/summary.json", (json.dumps(summary, indent=2, sort_keys=True) + "\n").encode())
    put_bytes(spark, f"{base}/report.md", text.encode())
    return text
