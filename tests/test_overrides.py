"""Overrides: each way to spell one, each reason to refuse one, and what is left of the entries."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import overrides

SCHEMA = (
    "key string NOT NULL, timeout double NOT NULL, retries int NOT NULL, sandbox struct<network: boolean NOT NULL, env: map<string,string> NOT NULL> NOT NULL, inputs array<string> NOT NULL, "
    "task struct<text: string NOT NULL, count: int NOT NULL, ratio: double NOT NULL, flag: boolean NOT NULL, where: string, names: array<string> NOT NULL, env: map<string,string> NOT NULL, "
    "harness: struct<model: string NOT NULL, capture: string NOT NULL> NOT NULL, odd: array<int> NOT NULL, limit: int> NOT NULL"
)
ENTRY = ("probe", 10.0, 0, (True, {}), [], ("t", 1, 0.5, False, "/w", [], {}, ("opus", "stream"), [1], 3))


@pytest.fixture(scope="module")
def entries(spark):
    one = spark.createDataFrame([ENTRY, ("other", *ENTRY[1:])], SCHEMA)
    return spark.createDataFrame([(1, *r) for r in one.collect()], overrides.T.StructType([overrides.T.StructField("wf", overrides.T.IntegerType()), *one.schema.fields]))


@pytest.fixture(scope="module")
def declared(entries):
    codex = F.struct(F.lit("gpt").alias("model"), F.lit("proxy").alias("capture"))
    return overrides.Declared(overrides.T.StructType(entries.schema.fields[1:]), {"task.harness.capture": ("stream", "proxy")}, {"task.harness": {"codex": codex}})


def judge(spark, entries, declared, *args):
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(args)], "wf int, pos int, arg string")
    return overrides.judged(df, entries, declared, ["wf"])


def apply(spark, entries, declared, *args):
    out = overrides.applied(entries, judge(spark, entries, declared, *args), declared, ["wf"])
    assert out.columns == entries.columns
    rows = {r.key: r for r in out.collect()}
    assert tuple(rows["other"])[1:] == tuple(entries.where("key = 'other'").first())[1:]
    return rows["probe"]


def test_parts(spark):
    args = ["--rollout.harness.model=opus", "--probe.env=A=1,B=2", "--p.x="]
    df = spark.createDataFrame(list(enumerate(args)), "pos int, arg string")
    got = [(r.entry, r.path, r.value, r.problem) for r in overrides.parsed(df, []).orderBy("pos").collect()]
    assert got == [("rollout", ["harness", "model"], "opus", None), ("probe", ["env"], "A=1,B=2", None), ("p", ["x"], "", None)]


REFUSED = [
    ("--persits", "unrecognized argument"), ("nonsense", "unrecognized argument"), (None, "unrecognized argument"), ("-p.x=1", "unrecognized argument"), ("--rollout=x", "names an entry and a field path"), ("--.model=x", "names an entry and a field path"),
    ("--rollout..model=x", "empty path segment"), ("--probe.task.=x", "empty path segment"), ("--probe.nope=1", "nope is not a field"), ("--probe.sandbox.nope=1", "is not a field"), ("--lint.timeout=1", "no entry lint"),
    ("--probe.text.upper=1", "no fields to walk into"), ("--probe.env.A=1", "no fields to walk into"), ("--probe.flag=maybe", "expected true or false"), ("--probe.harness.capture=telepathy", "expected one of stream, proxy"), ("--probe.harness=ghost", "expected one of codex"),
    ("--probe.count=many", "is not int"), ("--probe.count=1.0", "is not int"), ("--probe.ratio=nan", "not a finite number"), ("--probe.ratio=-inf", "not a finite number"), ("--probe.ratio=1e999", "not a finite number"), ("--probe.ratio=1d", "is not float"), ("--probe.timeout=x", "is not float"),
    ("--probe.env=A", "A is not k=v"), ("--probe.env=A=1,=2", "=2 is not k=v"), ("--probe.key=other", "identity"), ("--probe.task=something", "not a value an argument can spell"), ("--probe.sandbox=x", "not a type"), ("--probe.odd=1", "not a type"), ("--probe.count=none", "none is no value"),
]


def test_each_reason(spark, entries, declared):
    each = entries.drop("wf").crossJoin(spark.range(len(REFUSED)).select(F.col("id").cast("int").alias("wf")))  # a workflow for each argument
    args = spark.createDataFrame([(i, 0, a) for i, (a, _) in enumerate(REFUSED)], "wf int, pos int, arg string")
    got = {r.wf: r.problem for r in overrides.judged(args, each, declared, ["wf"]).collect()}
    for i, (arg, why) in enumerate(REFUSED):
        assert got[i] is not None and why in got[i], (arg, got[i])
    twice = judge(spark, entries, declared, "--probe.count=1", "--probe.count=2", "--other.count=1", "--probe.ratio=1").orderBy("pos").collect()
    assert [r.problem for r in twice] == [None, "overrides the same field", None, None]


def test_every_shape(spark, entries, declared):
    r = apply(spark, entries, declared, "--probe.text=hi", "--probe.count= 1_7 ", "--probe.ratio=1.5e1", "--probe.flag=YES", "--probe.where=/tmp/x", "--probe.names=a,,b", "--probe.task.env=A=1,B=2=3,A=4", "--probe.timeout=60", "--probe.retries=2", "--probe.sandbox.network=false", "--probe.sandbox.env=C=3", "--probe.inputs=one/patch")
    t = r.task
    assert (t.text, t["count"], t.ratio, t.flag, t.where, t.names, t.env, t.limit) == ("hi", 17, 15.0, True, "/tmp/x", ["a", "b"], {"A": "4", "B": "2=3"}, 3)
    assert (r.timeout, r.retries, r.sandbox.network, r.sandbox.env, r.inputs, t.harness.model) == (60.0, 2, False, {"C": "3"}, ["one/patch"], "opus")


def test_paths(spark, entries, declared):
    r = apply(spark, entries, declared, "--probe.env=B=2", "--probe.sandbox.env=A=1", "--probe.where=None", "--probe.limit=none", "--probe.task.text=none")
    assert (r.task.env, r.sandbox.env, r.task.where, r.task.limit, r.task.text) == ({"B": "2"}, {"A": "1"}, None, None, "none")
    for args in [("--probe.harness=codex", "--probe.harness.model=o3"), ("--probe.harness.model=o3", "--probe.harness=codex")]:  # the shorter path lands first
        assert tuple(apply(spark, entries, declared, *args).task.harness) == ("o3", "proxy")
    for args in [("--probe.text=a", "--probe.task.text=b"), ("--probe.task.text=b", "--probe.text=a")]:  # two spellings of one field
        assert apply(spark, entries, declared, *args).task.text == "b"
    assert apply(spark, entries, declared).task == entries.where("key = 'probe'").first().task


def test_one_refusal_refuses_all(spark, entries, declared):
    with pytest.raises(Exception, match="expected true or false"):
        apply(spark, entries, declared, "--probe.text=hi", "--probe.flag=maybe")
