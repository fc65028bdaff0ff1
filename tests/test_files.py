"""Run folders as a data source, digests of large files, and runs published whole or not at all."""

import hashlib
import json
import os

import pytest

from runlens.session import BATCH_CONF, importable
from runlens.sources import files, runs, sinks, tables


@pytest.fixture
def folders(tmp_path):
    root = tmp_path / "runs"
    content = {
        "a/one": {"patch.diff": b"x\xff", "conversation.json": b"[1]"}, "a/two": {"git_integrity.json": b"{ bad", "conversation.json": b"{}"}, "b": {"patch.diff": b""},
        "c/deep/er": {"git_integrity.json": b'{"purged": true}', "other.txt": b"n"}, "d": {"other.txt": b"n"},
    }
    for run, named in content.items():
        (root / run).mkdir(parents=True)
        for name, data in named.items():
            (root / run / name).write_bytes(data)
    return str(root)


WANT = {("a/one", "x\\xff", "[1]", None), ("a/two", None, "{}", None), ("b", "", None, None), ("c/deep/er", None, None, '{"purged": true}')}


def test_data_source(spark, folders):
    runs.register(spark)
    load = lambda **o: spark.read.format("runlens_runs").options(**o).load(folders)
    assert {tuple(r) for r in load().collect()} == WANT == {tuple(r) for r in tables.scan_runs(spark, folders).collect()}
    assert {tuple(r) for r in load(partitionBytes=1).collect()} == WANT
    assert spark.read.format("runlens_runs").load("file://" + folders).count() == 4
    with pytest.raises(Exception, match="needs the path"):
        spark.read.format("runlens_runs").load().count()


def test_data_source_prunes(spark, folders):
    """A filter on the name leaves folders out before they are dealt: fewer partitions, and none of their files is read."""
    runs.register(spark)
    df = spark.read.format("runlens_runs").option("partitionBytes", 1).load(folders)
    parts = lambda d: d.rdd.getNumPartitions()
    assert parts(df) == 4 and parts(df.where("run = 'b'")) == 1 and parts(df.where("run LIKE 'a/%'")) == 2 and parts(df.where("run IN ('b', 'a/two')")) == 2
    os.chmod(os.path.join(folders, "b", "patch.diff"), 0)
    assert {r.run for r in df.where("run LIKE 'a/%' AND diff IS NOT NULL").collect()} == {"a/one"}
    assert df.where("run = 'none'").count() == 0


def test_data_source_in_sql(spark, folders):
    runs.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW run_folders USING runlens_runs OPTIONS (path '{folders}')")
    assert [tuple(r) for r in spark.sql("SELECT run, length(diff) AS n FROM run_folders WHERE run LIKE 'a/%' ORDER BY run").collect()] == [("a/one", 5), ("a/two", None)]
    spark.catalog.dropTempView("run_folders")


def test_digests_of_large_files(spark, tmp_path):
    """A file that no row could hold, by blocks; an empty one, one that is not there."""
    big = tmp_path / "big.bin"
    with big.open("wb") as f:
        f.write(b"head")
        f.truncate((2 << 30) + 12_345_678)
        f.seek(0, 2)
        f.write(b"tail")
    (tmp_path / "empty").write_bytes(b"")
    listed = files.listed(spark, str(tmp_path))
    assert {r.rel: r.n_bytes for r in listed.collect()} == {"big.bin": (2 << 30) + 12_345_682, "empty": 0}
    gone = spark.createDataFrame([(str(tmp_path / "gone"), "gone", 0), (None, "null", 0)], "path string, rel string, n_bytes bigint")
    got = {r.rel: r.sha256 for r in files.digested(listed.unionByName(gone)).collect()}
    with big.open("rb") as f:
        assert got == {"big.bin": hashlib.file_digest(f, "sha256").hexdigest(), "empty": hashlib.sha256().hexdigest(), "gone": None, "null": None}


KEYS = "sweep string, inst string, rollout int, task string, attempt int"


def published(spark, tmp_path, named, status="success"):
    records = spark.createDataFrame([("s", "i", 0, "t", 0, status), ("s", "j", 1, "t", 2, status)], KEYS + ", status string")
    rows = [("s", i, r, "t", a, name, str(path)) for (i, r, a) in (("i", 0, 0), ("j", 1, 2)) for name, path in named.items()]
    return sinks.persist(records, spark.createDataFrame(rows, KEYS + ", name string, source string"), str(tmp_path / "store"))


def test_persist(spark, tmp_path):
    for name, data in (("patch.diff", "DIFF"), ("log", "L")):
        (tmp_path / name).write_text(data)
    got = published(spark, tmp_path, {"patch.diff": tmp_path / "patch.diff", "sub/log": tmp_path / "log", "gone": tmp_path / "gone"}, "RUN_ERROR").collect()
    store = tmp_path / "store"
    assert {r.inst: r.artifact_keys for r in got} == {i: {n: f"{p}/{n}" for n in ("patch.diff", "sub/log")} for i, p in (("i", "s/i/r0/t/a0"), ("j", "s/j/r1/t/a2"))}
    for r in got:
        assert all((store / key).is_file() for key in r.artifact_keys.values())
    shard = json.loads((store / "s/j/r1/t/a2/run.json").read_text())
    assert (shard["status"], shard["attempt"], shard["artifact_keys"]["sub/log"]) == ("RUN_ERROR", 2, "s/j/r1/t/a2/sub/log")
    assert [p.name for p in store.iterdir()] == ["s"]  # nothing is left beside
    assert tables.scan_sweep(spark, str(store / "s")).count() == 2
    (tmp_path / "patch.diff").write_text("NEW")
    published(spark, tmp_path, {"patch.diff": tmp_path / "patch.diff"})
    assert (store / "s/i/r0/t/a0/patch.diff").read_text() == "NEW" and not (store / "s/i/r0/t/a0/sub").exists()  # the whole folder is replaced


def test_a_failure_between_two_files_leaves_the_old_run(spark, tmp_path):
    (tmp_path / "patch.diff").write_text("OLD")
    published(spark, tmp_path, {"patch.diff": tmp_path / "patch.diff"})
    (tmp_path / "patch.diff").write_text("NEW")
    with pytest.raises(Exception, match="(?s)."):
        published(spark, tmp_path, {"patch.diff": tmp_path / "patch.diff", "bad\0name": tmp_path / "patch.diff"})
    assert (tmp_path / "store/s/i/r0/t/a0/patch.diff").read_text() == "OLD"


def test_promote(spark, tmp_path):
    for folder, named in {"w1": {"a": "1", "diagnostics/b": "2"}, "w2": {}}.items():
        (tmp_path / folder / "diagnostics").mkdir(parents=True)
        for name, data in named.items():
            (tmp_path / folder / name).write_text(data)
    records = spark.createDataFrame([("s", "i", 0, "t", 0, "formal"), ("s", "j", 0, "t", 0, "formal"), ("s", "k", 0, "t", 0, "formal")], KEYS + ", tier string")
    spaces = spark.createDataFrame([("s", "i", 0, "t", 0, str(tmp_path / "w1")), ("s", "j", 0, "t", 0, str(tmp_path / "w2")), ("s", "k", 0, "t", 0, str(tmp_path / "none"))], KEYS + ", folder string")
    got = {r.inst: set(r.artifact_keys) for r in sinks.promote(records, spaces, str(tmp_path / "store")).collect()}
    assert got == {"i": {"a", "diagnostics/b"}, "j": set(), "k": set()}
    assert (tmp_path / "store/s/i/r0/t/a0/diagnostics/b").read_text() == "2" and (tmp_path / "store/s/k/r0/t/a0/run.json").is_file()


def test_batch_sizes_with_units(spark):
    before = spark.conf.get(BATCH_CONF)
    for held, want in (("64m", str(4 << 20)), ("1m", "1m"), ("1048576", "1048576")):
        spark.conf.set(BATCH_CONF, held)
        importable(spark)
        assert spark.conf.get(BATCH_CONF) == want
    spark.conf.set(BATCH_CONF, before)
