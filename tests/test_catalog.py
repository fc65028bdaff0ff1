"""Every registered query against DuckDB on the smallest tables, and that the cases it is about occur."""

import glob
import os

import duckdb
import pytest

from runlens.operators import integrity
from runlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == columns
    assert got == sorted(repr([r[at[c]] for c in columns]) for r in rel.fetchall())


def seen(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_adapters_bring_out_every_case(spark):
    q = lambda name: catalog.QUERIES[name](spark, SF)
    assert seen(q("verdicts"), "output_state") == {"ok", "absent", "unparseable"}
    assert seen(q("base_golden_classes"), "verdict") >= {"OK", "GOLDEN_FAIL", "BASE_UNEXPECTED_PASS", "ERROR"}
    assert seen(q("workflow_bindings"), "state") == {"bound", "unbound", "ambiguous", "not earlier", "left out"}
    assert seen(q("exit_codes"), "code") == {"ok", "failed", "unresolved"}
    assert seen(q("blocked_entries"), "outcome") == {"succeeded", "failed", "blocked"}
    assert seen(q("error_classes"), "class") == {"retryable", "usage_limit", "fatal"}
    assert seen(q("manifest_compare"), "state") == {"ok", "changed", "missing", "extra"}
    assert seen(q("stream_outcomes"), "outcome") >= {"finished", "truncated", "max_turns", "finished_with_api_error"}
    assert {r.rule: r.n > 0 for r in q("rule_counts").collect()} == dict.fromkeys(("planted_auto_load_hook", "test_files_touched", "ci_files_touched", "required_test_literal"), True)
    assert len(seen(q("snippet_problems"), "problems")) >= 6
    assert q("reads_outside").count() > 0 and q("orphan_markers").count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_plans_push_filters_and_prune_columns(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = plan(catalog.QUERIES["point_lookup"](spark, SF))
    assert "EqualTo(c_custkey,42)" in one and "c_acctbal" not in one
    vote = plan(catalog.QUERIES["line_vote_ranges"](spark, SF))
    assert "l_extendedprice" not in vote and "Cartesian" not in vote and "NestedLoop" not in vote


def test_replay_reads_every_conversation(spark):
    """Each trace rule's runs are those of the rule's own query."""
    got = {r.run: r for r in catalog.QUERIES["replayed_traces"](spark, SF).collect()}
    own = {r.conv_id: r for r in catalog.QUERIES["trace_findings"](spark, SF).collect()}
    away = {r.conv_id for r in catalog.QUERIES["reads_outside"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/part.parquet").count() and own.keys() <= got.keys()
    for run, r in got.items():
        o = own.get(run)
        assert (r.n_git, r.n_egress, r.n_said) == ((o.n_git, o.n_egress, o.n_said) if o else (0, 0, 0)) and (r.away != "") == (run in away)
        assert r.n_flagged == len(r.flagged.split(",") if r.flagged else [])
    assert {x for r in got.values() for x in r.flagged.split(",") if x} == set(integrity.RULES)


def test_resume_list_is_whole(spark):
    read = lambda t, c: {r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()}
    done = {r[0] for r in spark.read.parquet(f"{SF}/events.parquet").where("event_id % 12 = 5").select("user_id").collect()}
    rows = catalog.QUERIES["pending_instances"](spark, SF).collect()
    assert [r.inst for r in rows] == sorted(read("customer", "c_custkey") - done) and {r.shard for r in rows} == {0, 1}
    assert [r.inst for r in catalog.QUERIES["resume_list"](spark, SF).collect()] == [r.inst for r in rows if r.shard == 1][:500]
