"""Readers, writers and the stream form, over files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.operators import grading
from runlens.sources import sinks, tables
from runlens.streaming import shards


def shard(root, inst, rollout, attempt, **more):
    d = root / inst / f"r{rollout}" / "t" / f"a{attempt}"
    d.mkdir(parents=True, exist_ok=True)
    (d / "run.json").write_text(json.dumps({"sweep": "s", "inst": inst, "rollout": rollout, "task": "t", "attempt": attempt, "run_ts": "1", "status": "success", "metrics": {"m": 1.0}} | more))


def test_find_and_load(spark, tmp_path):
    path = tmp_path / "d" / "data"
    spark.range(3).select(F.concat(F.lit("i"), "id").alias("inst")).coalesce(1).write.parquet(str(path))
    found = tables.find_parquet(spark, str(tmp_path), "d")
    df = tables.load(spark, found, tables.Kind(("inst",)))
    assert [(r.inst, r.row_index) for r in df.orderBy("row_index").collect()] == [("i0", 0), ("i1", 1), ("i2", 2)]
    assert tables.require(df, "inst", "i2").row_index == 2
    for bad in (lambda: tables.require(df, "inst", "no"), lambda: tables.load(spark, found, tables.Kind(("x",))), lambda: tables.find_parquet(spark, str(tmp_path), "e"), lambda: tables.require_unique(df.union(df), "inst")):
        with pytest.raises((KeyError, ValueError, FileNotFoundError)):
            bad()


def test_sweep(spark, tmp_path):
    for rollout in (10, 2):
        shard(tmp_path, "i", rollout, 0)
    df = tables.scan_sweep(spark, str(tmp_path))
    assert [r.rollout for r in df.orderBy("inst", "rollout").collect()] == [2, 10] and df.first().metrics == {"m": 1.0}


def test_annotation_files(spark, tmp_path):
    assert tables.scan_annotations(spark, str(tmp_path)).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "aggregate.json").write_text(json.dumps({"instance_id": "a", "snippets": [{"file_path": "f", "start_line": 1, "end_line": 2, "category": "core", "description": "é"}]}))
    got = tables.scan_annotations(spark, str(tmp_path)).select("instance_id", F.inline("snippets"))
    rows = got.withColumnRenamed("instance_id", "inst").withColumn("pos", F.lit(0))
    side = sinks.write_combined(rows, str(tmp_path / "out")).first()
    assert (side.n_rows, side.n_snippets, len(side.sha256)) == (1, 1, 64)
    assert "é" in spark.read.parquet(str(tmp_path / "out")).first().relevant_snippets
    empty = sinks.write_combined(rows.limit(0), str(tmp_path / "none")).first()
    assert (empty.n_rows, empty.n_snippets) == (0, 0)


def test_run_folders(spark, tmp_path):
    for run, files in {"a": {"patch.diff": b"x\xff", "conversation.json": b"[]"}, "b": {"git_integrity.json": b"{ bad"}}.items():
        (tmp_path / run).mkdir()
        for name, data in files.items():
            (tmp_path / run / name).write_bytes(data)
    got = {r.run: (r.diff, r.conversation, r.report) for r in tables.scan_runs(spark, str(tmp_path)).collect()}
    assert got == {"a": ("x\\xff", "[]", None), "b": (None, None, None)}
    total = sinks.write_manifest(tables.scan_files(spark, str(tmp_path), "*"), str(tmp_path.parent / "m")).first()
    assert (total.n_files, total.n_bytes) == (3, 9)


def test_ledger_and_stream(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "ledger")
    shard(root, "i", 0, 0)
    for status, ts in (("success", "1"), ("failed", "2")):
        shard(root, "i", 0, 1, status=status, run_ts=ts)
        if ts == "2":
            (root / "i" / "r0" / "t" / "a1" / "run.json").rename(root / "i" / "r0" / "t" / "a1" / "old.json")
            shard(root, "i2", 0, 0)
            (root / "i" / "r0" / "t" / "b1").mkdir()
            (root / "i" / "r0" / "t" / "a1" / "old.json").rename(root / "i" / "r0" / "t" / "b1" / "run.json")
        shards.upsert(shards.read_shards(spark, str(root)), out, str(tmp_path / "ck")).awaitTermination()
    got = {(r.inst, r.attempt): r.status for r in spark.read.parquet(out).collect()}
    assert got == {("i", 0): "success", ("i", 1): "failed", ("i2", 0): "success"}


def test_appended_attempts_stay(spark, tmp_path):
    """Another attempt of a rollout is added; the same key is replaced."""
    one = lambda attempt, status, ts="1": spark.createDataFrame([("s", "i", 0, "t", attempt, ts, status)], "sweep string, inst string, rollout int, task string, attempt int, run_ts string, status string")
    path = str(tmp_path / "ledger")
    for row in (one(0, "a"), one(1, "b"), one(1, "c")):
        sinks.append_attempts(row, path)
    assert sorted((r.attempt, r.status) for r in spark.read.parquet(path).collect()) == [(0, "a"), (1, "c")]


def test_bytes_and_runs(spark, tmp_path):
    path = str(tmp_path / "store" / "k")
    for data in (b"one", b"two\x00"):
        sinks.put_bytes(spark, path, data)
        assert sinks.get_bytes(spark, path) == data
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no"):
        sinks.get_bytes(spark, str(tmp_path / "none"))
    sinks.write_terminal(spark, str(tmp_path / "run"), "{}")
    assert sinks.get_bytes(spark, str(tmp_path / "run" / "terminal.json")) == b"{}"
    runs = spark.createDataFrame([("i", "candidate-1", "{}", "{}"), ("i", "candidate-2", "{}", "{}")], "inst string, label string, annotation string, last_exchange string")
    for _ in range(2):
        sinks.store_runs(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_candidates_and_summaries(spark, tmp_path):
    (tmp_path / "go__run1.json").write_text('{"x": 1}')
    (tmp_path / "py__run12.json").write_text("{ bad")
    (tmp_path / "summary.jsonl").write_text('{"lang": "go", "instance_id": "a", "candidate_counts": [1, 2], "valid": true, "cost_usd": 0.5}\n')
    got = {(r.lang, r.run): r.ok for r in tables.scan_candidates(spark, str(tmp_path)).select("lang", "run", F.col("candidate").isNotNull().alias("ok")).collect()}
    assert got == {("go", 1): True, ("py", 12): False} and tables.scan_candidates(spark, str(tmp_path), "go").count() == 1
    assert tables.scan_summaries(spark, str(tmp_path)).first().candidate_counts == [1, 2]


def test_named_tables(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "d" / "data"))
    tables.register("two ids", tables.Kind(("id",), lambda df: df.where("id > 0")))
    with pytest.raises(ValueError):
        tables.register("two ids", tables.Kind(("id",)))
    tables.KINDS["d"] = tables.KINDS.pop("two ids")
    assert [r.id for r in tables.load_named(spark, str(tmp_path), "d").collect()] == [1]
    del tables.KINDS["d"]


def test_report_lists_all(spark, tmp_path):
    kinds = ["OK", "ERROR", "GOLDEN_FAIL"]
    r = spark.createDataFrame([(f"i{i:04}", kinds[i % 3], "1", "2") for i in range(3600)], "inst string, verdict string, started_at string, finished_at string")
    want = sorted((v, f"i{i:04}") for v in kinds[1:] for i in range(3600) if kinds[i % 3] == v)
    path = str(tmp_path / "report")
    for _ in range(2):  # a report may be written again
        text = sinks.report(r, r, path)
    assert f"2400 not OK, listed in {path}/not_ok" in text and "| GOLDEN_FAIL | 1200 |" in text and "1 to 2" in text
    assert sorted((x.verdict, x.inst) for x in spark.read.parquet(f"{path}/not_ok").collect()) == want
    assert (tmp_path / "report" / "report.md").read_text() == text
    got = json.loads((tmp_path / "report" / "summary.json").read_text())
    assert (got["total"], got["verified"], got["not_ok"], got["first"], got["last"]) == (3600, 3600, 2400, "1", "2") and got["verdicts"] == {v: 1200 if v in kinds else 0 for v in grading.VERDICTS}


def test_null_keys_of_the_ledger(spark, tmp_path):
    one = lambda inst, attempt, status: spark.createDataFrame([("s", inst, 0, "t", attempt, "1", status)], "sweep string, inst string, rollout int, task string, attempt int, run_ts string, status string")
    path = str(tmp_path / "ledger")
    for row in (one(None, 0, "a"), one("i", 0, "b"), one(None, 1, "c"), one(None, 1, "d")):
        sinks.append_attempts(row, path)
    assert sorted((r.inst or "", r.attempt, r.status) for r in spark.read.parquet(path).collect()) == [("", 0, "a"), ("", 1, "d"), ("i", 0, "b")]


def test_artifacts(spark):
    f = spark.createDataFrame([(1, "a", "k/a", True), (1, "b", "k/b", False)], "run int, name string, key string, exists boolean")
    assert sinks.artifact_keys(f, ["run"]).first().artifact_keys == {"a": "k/a"}
