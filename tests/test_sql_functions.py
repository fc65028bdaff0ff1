"""The session's SQL functions against the operators they stand for."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import grading, integrity, sql_functions

BLOCK = "run bigint, pos int, type string, text string, command string, file_path string, workdir string"
BLOCKS = [
    (1, 0, "tool_use", None, "git log --all; git status && curl x", "../../etc/passwd", "/app"), (1, 1, "text", "According to the fix, found the patch", None, None, None),
    (1, 2, "tool_use", "found the patch", "\u2003git log\u00a0| git blame a\ngit log --remotes", "//x/../y", "/app"), (1, 3, "reasoning", "the commit shows it", "curl", "/etc", "/app"), (2, 0, "tool_use", None, None, "", "/app"),
    (2, 1, "tool_use", None, "", "/app", "/app/"), (2, 2, None, "found the fix", "curl x", "/etc", "/app"), (3, 0, "tool_use", None, "git grep x", "a/./b", None), (3, 1, "tool_use", None, "git fetch " + "x" * 500, "/tmp/../etc", "/"),
    (3, 2, "tool_use", None, "git clone a; pip install git+https://b", "../app/x", "/app"), (None, 0, "tool_use", None, "wget y", "../app2", "/app"), (2, 3, "tool_result", "found the fix", "curl", "/etc", "/app"),
]


@pytest.fixture(scope="module")
def sql(spark):
    sql_functions.register(spark)
    sql_functions.register(spark)  # again: the same
    return spark.sql


def test_trace_findings(spark, sql):
    df = spark.createDataFrame(BLOCKS, BLOCK).repartition(3)
    text = "SELECT run, pos, ord, f.rule, f.finding FROM (SELECT run, pos, runlens_trace_findings(type, text, command, file_path, workdir) AS found FROM {df}) LATERAL VIEW posexplode(found) f AS ord, one LATERAL VIEW inline(array(one)) f AS rule, finding"
    got = {}
    for r in sorted(sql(text, df=df).collect(), key=lambda r: (r.run or -1, r.pos, r.ord)):
        got.setdefault((r.run, r.rule), []).append(r.finding)
    want = {(r.run, rule): r[rule] for r in integrity.trace_findings(df, ["run"]).collect() for rule in integrity.TRACE_RULES if r[rule]}
    assert got == want and {rule for _, rule in got} == set(integrity.TRACE_RULES)
    plan = sql(text, df=spark.createDataFrame(BLOCKS, BLOCK))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Python", "Arrow"))
    assert sql(text, df=df.limit(0)).count() == 0


def test_verdict(spark, sql):
    outputs = ['{"tests":[{"name":"a","status":"PASSED"},{"name":"b","status":"PASSED"},{"name":"b","status":"PASSED"},3,{"name":null,"status":"PASSED"}]}', '{"tests":[{"name":"a","status":"FAILED"}]}', '{"tests":4}', "{}", "[]", "{", "", None]
    required = [(["a"], ["b", "a"]), (["a"], []), ([], []), (["z", "y"], ["b"])]
    df = spark.createDataFrame([(i, f, p, o) for i, o in enumerate(outputs) for f, p in required], "i int, f2p array<string>, p2p array<string>, output string")
    got = sql("SELECT i, f2p, p2p, x.* FROM (SELECT *, runlens_verdict(f2p, p2p, output) AS x FROM {df})", df=df)
    want = grading.grade(df).select("i", "f2p", "p2p", "output_state", "passed", "missing", "score", "resolved", *(F.col(c).cast("int") for c in ("n_required", "n_passed", "n_missing")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.where("resolved").count() > 2


def test_instance_verdict(spark, sql):
    full = [(i, phase, status, f2p, ["p"], out) for i, (phase, status, f2p, out) in enumerate(
        (phase, status, f2p, out) for phase in ("base", "golden") for status in ("success", "failed") for f2p in (["a"], []) for out in (None, "[]", "{}", '{"tests":[{"name":"a","status":"PASSED"}]}', '{"tests":[{"name":"a","status":"PASSED"},{"name":"p","status":"PASSED"}]}')
    )]
    pairs = [(f"{a[0]}-{b[0]}", *x[1:]) for a in full for b in full for x in (a, b)]  # every pair of runs, those without one of the phases too
    df = spark.createDataFrame(pairs, "inst string, phase string, status string, f2p array<string>, p2p array<string>, output string").repartition(4)
    got = sql("""WITH g AS (SELECT *, runlens_verdict(f2p, p2p, output) AS x FROM {df})
      SELECT inst, runlens_instance_verdict(bool_or(status <> 'success' OR x.output_state <> 'ok'), count_if(phase = 'base'), count_if(phase = 'golden'), bool_or(x.resolved) FILTER (WHERE phase = 'golden'),
        bool_or(x.resolved OR size(array_intersect(f2p, x.passed)) > 0) FILTER (WHERE phase = 'base')) AS verdict FROM g GROUP BY inst""", df=df)
    want = grading.classify(grading.grade(df))
    assert {r.inst: r.verdict for r in got.collect()} == (w := {r.inst: r.verdict for r in want.collect()}) and set(w.values()) == set(grading.VERDICTS)
