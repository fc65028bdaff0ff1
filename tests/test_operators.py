"""Operators on small tables whose answers are plain to see."""

import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import annotations, consensus, grading, integrity, ledger, normalize, patches, reconcile, traces, workflow


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text(spark):
    samples = ["", "a", "a\nb\n", "a\r\nb\x0bc\x1cd e\x85f", "\n\n", " \t a 　\n"]
    assert values(spark, text.lines, samples) == [s.splitlines() for s in samples]
    assert values(spark, text.strip, samples) == [s.strip() for s in samples]
    assert values(spark, text.addressable_lines, ["x\ny\nz\n", "x\ny\nz", ""]) == [4, 3, 0]
    assert values(spark, text.integer, ["4", " 7 ", "4.0", "x", "1_0", ""]) == [4, 7, None, None, 10, None]


def test_votes_and_islands(spark):
    rows = [("i", 1, "f", 1, 5), ("i", 2, "f", 3, 8), ("i", 3, "f", 7, 9), ("i", 1, "g", 1, 2), ("i", 2, "h", 5, 3), ("i", 3, "h", 5, 3)]
    c = spark.createDataFrame(rows, "inst string, run bigint, file string, s bigint, e bigint")
    got = sorted((r.file, r.s, r.e) for r in consensus.voted_ranges(c).collect() if r.s is not None)
    assert got == [("f", 3, 5), ("f", 7, 8)]
    assert [r.file for r in consensus.voted_ranges(c).where("s is null").collect()] == ["h"]
    runs = spark.createDataFrame([("i", 1), ("i", 2), ("i", 3), ("j", 1)], "inst string, run bigint")
    assert {r.inst: (r.shared, r.total, r.percent) for r in consensus.file_agreement(runs, c).collect()} == {"i": (1, 3, 33), "j": (0, 0, None)}
    assert [(r.both, r.total, r.iou) for r in consensus.line_iou(runs, c).collect()] == [(0, 9, 0.0)]
    assert sorted(r.file for r in consensus.split_files(runs, c).collect()) == ["g", "h"]


def graded(spark, rows):
    df = spark.createDataFrame(rows, "inst string, phase string, status string, f2p array<string>, p2p array<string>, output string")
    return grading.grade(df)


def test_output_states_and_scores(spark):
    good = json.dumps({"tests": [{"name": "a", "status": "PASSED"}, {"name": "b", "status": "PASSED"}, {"name": "b", "status": "FAILED"}, 3]})
    rows = [("1", "g", "success", ["a"], ["b"], good), ("2", "g", "success", ["a"], ["z"], good), ("3", "g", "success", ["a"], [], None), ("4", "g", "success", ["a"], [], "{ this is not json"), ("5", "g", "success", ["a"], [], "[1, 2]"), ("6", "g", "success", [], [], '{"tests": []}')]
    got = {r.inst: (r.output_state, r.score, r.missing, r.first_missing) for r in graded(spark, rows).collect()}
    assert got == {"1": ("ok", 1.0, [], None), "2": ("ok", 0.0, ["z"], "z"), "3": ("absent", 0.0, ["a"], "a"), "4": ("unparseable", 0.0, ["a"], "a"), "5": ("unparseable", 0.0, ["a"], "a"), "6": ("ok", 1.0, [], None)}


def test_classes(spark):
    out = lambda *p: json.dumps({"tests": [{"name": x, "status": "PASSED"} for x in p]})
    cases = {
        "ok": (("success", out("t2")), ("success", out("t1", "t2")), "OK"), "golden": (("success", out("t2")), ("success", out("t2")), "GOLDEN_FAIL"),
        "base": (("success", out("t1")), ("success", out("t1", "t2")), "BASE_UNEXPECTED_PASS"), "both": (("success", out("t1", "t2")), ("success", out("t1", "t2")), "BASE_UNEXPECTED_PASS"),
        "infra": (("timeout", out("t2")), ("success", out("t1", "t2")), "ERROR"), "none": (("success", out("t2")), ("success", None), "ERROR"), "first": (("success", None), ("success", out()), "ERROR"),
    }
    rows = [(k, phase, s, ["t1"], ["t2"], o) for k, v in cases.items() for phase, (s, o) in zip(("base", "golden"), v, strict=False)]
    rows.append(("half", "base", "success", ["t1"], ["t2"], out("t2")))
    got = {r.inst: r.verdict for r in grading.classify(graded(spark, rows)).collect()}
    assert got == {k: v[2] for k, v in cases.items()} | {"half": "ERROR"}
    h = {r.verdict: r.n for r in grading.histogram(spark.createDataFrame([("OK",), ("ODD",)], "verdict string")).collect()}
    assert h == {"OK": 1, "GOLDEN_FAIL": 0, "BASE_UNEXPECTED_PASS": 0, "ERROR": 0}


HOOK = "diff --git a/conftest.py b/conftest.py\nnew file mode 100644\n--- /dev/null\n+++ b/conftest.py\n+import os\n"


def test_patch_rules(spark):
    edit = "diff --git a/pyproject.toml b/pyproject.toml\n--- a/pyproject.toml\n+++ b/pyproject.toml\n+x = 'test_parse_header'\n"
    other = "diff --git a/x b/x\n--- a/x\n+++ b/pkg/hack.pth\n+++ b/app/Foo_test.go\n"
    runs = spark.createDataFrame([(1, HOOK), (2, edit), (3, ""), (4, other), (5, None)], "run int, diff string")
    need = spark.createDataFrame([(2, "t/a.py::T::test_parse_header[x]"), (2, "short"), (1, "t::test_parse_header")], "run int, test string")
    got = {r.run: r for r in integrity.patch_findings(runs, ["run"], need).collect()}
    assert got[1].planted_auto_load_hook == ["conftest.py"] and got[2].planted_auto_load_hook == [] and got[4].planted_auto_load_hook == []
    assert got[2].required_test_literal == ["test_parse_header"] and got[1].required_test_literal == []
    assert got[4].test_files_touched == ["app/Foo_test.go"] and got[3].ci_files_touched == [] and got[5].ci_files_touched == []


def test_binary_sections(spark):
    text_ = "diff --git a/a b/a\n--- a/a\n+++ b/a\n+x\n"
    binary = "diff --git a/p.png b/p.png\nBinary files a/p.png and b/p.png differ\n"
    git = "diff --git a/q b/q\nGIT binary patch\nliteral 0\n"
    assert values(spark, patches.without_binary, [text_ + binary + git, text_, "", binary]) == [text_, text_, "", ""]
    assert values(spark, patches.is_empty, [text_, "", " \n", "junk"]) == [False, True, True, True]
    assert values(spark, patches.gold_files, [text_ + binary, "diff --git a/a b b/a b\n"]) == [["a", "p.png"], []]
    assert values(spark, patches.test_leaf, ["p::C::test_x[a[b]]", "a.b.c", " q "]) == ["test_x", "c", "q"]


def test_trace_rules(spark):
    cheat = ["git log --all", "git show abc123; git blame x", "curl http://x", "git clone y"]
    plain = ["git status && git diff go.mod", "git log -n 5", "git grep x", "git checkout -- f", "git ls-files"]
    rows = [(1, i, "tool_use", None, c, None, "/app") for i, c in enumerate(cheat)] + [(2, i, "tool_use", None, c, "src/a.py", "/app") for i, c in enumerate(plain)]
    rows.append((1, 9, "text", "The FIX commit is upstream patch; the fix commit", None, None, "/app"))
    b = spark.createDataFrame(rows, "run int, pos int, type string, text string, command string, file_path string, workdir string")
    got = {r.run: r for r in integrity.trace_findings(b, ["run"]).collect()}
    assert got[1].suspicious_git == ["git log --all", "git show abc123", "git blame x", "git clone y"] and len(got[1].egress_attempts) == 2 and len(got[1].retrieval_language) == 3
    assert (got[2].suspicious_git, got[2].egress_attempts, got[2].reads_outside_workdir) == ([], [], [])


def test_outside_reads(spark):
    paths = ["src/a.py", "../../etc/passwd", "/etc/shadow", "/tmp/scratch", "/app-other/secret", "", None]
    assert values(spark, lambda c: integrity.outside_workdir(c, F.lit("/app")), paths) == [None, "/etc/passwd", "/etc/shadow", None, "/app-other/secret", None, None]
    assert values(spark, lambda c: integrity.outside_workdir(c, F.lit("/")), paths) == [None] * 7


def test_controls(spark):
    report = lambda **k: json.dumps({"purged": True, "before": {"future_commits": 2}, "after": {"future_commits": 0}} | k)
    rows = [None, report(), report(after={"future_commits": 3, "solution_reachable": True, "base_reachable": None}), report(purged=False), report(before={"future_commits": 0}), report(violations=["v"])]
    got = values(spark, integrity.control_failures, rows)
    assert got[1] == [] and len(got[0]) == 1 and len(got[2]) == 3 and len(got[3]) == 1 and got[4][0].startswith("note:") and got[5] == ["v"]


def test_merge_and_flags(spark):
    runs = spark.createDataFrame([(1, HOOK), (2, "")], "run int, diff string")
    b = spark.createDataFrame([(1, 0, "tool_use", None, "git blame x", None, "/")], "run int, pos int, type string, text string, command string, file_path string, workdir string")
    reports = spark.createDataFrame([(1, '{"purged": true, "after": {}}')], "run int, report string")
    got = {r.run: r for r in integrity.replay(runs, b, reports, ["run"]).collect()}
    assert got[1].flagged == ["planted_auto_load_hook", "suspicious_git"] and got[1].high_confidence == ["planted_auto_load_hook"]
    assert got[2].flagged == ["control_failure"] and got[2].n_flagged == 1.0
    assert values(spark, lambda c: integrity.report_violations(c, F.lit(False), F.lit(True), F.lit(2)), [""])[0][0].startswith("base commit <unknown>")


def test_only_two_rules_are_high_confidence(spark):
    some = ["x"]
    row = {r: some for r in integrity.RULES} | {"error": None}
    df = spark.createDataFrame([(1, *row.values())], "run int, " + ", ".join(f"{r} array<string>" for r in integrity.RULES) + ", error string")
    got = integrity.flags(df).first()
    assert got.high_confidence == ["planted_auto_load_hook", "control_failure"] and got.n_high_confidence == 2.0 and got.ok == 1.0
    broken = spark.createDataFrame([(1, "late"), (2, None)], "run int, error string"), spark.createDataFrame([(1, "first")], "run int, error string")
    got = {r.run: (r.error, r.ok) for r in integrity.flags(integrity.merged([broken[1], broken[0]], ["run"])).collect()}
    assert got == {1: ("first", 0.0), 2: (None, 1.0)}


def test_paths_are_trimmed_and_text_sections_stay(spark):
    hook = "diff --git a/my hook.pth b/my hook.pth\n--- /dev/null\n+++ b/my hook.pth\t\n+import x\n"
    got = integrity.patch_findings(spark.createDataFrame([(1, hook)], "run int, diff string"), ["run"]).first()
    assert got.planted_auto_load_hook == ["my hook.pth"]
    text = "diff --git a/n b/n\nBinary files are listed here\n+x\n"
    assert values(spark, patches.without_binary, [text, text + "Binary files a/n and b/n differ\n", "diff --git a/q b/q\nGIT binary patch of a kind\n"]) == [text, "", "diff --git a/q b/q\nGIT binary patch of a kind\n"]


def test_timeout_asks_first(spark):
    df = spark.createDataFrame([("timeout", True, True, None), ("success", True, True, "no_output"), ("success", True, False, "no_output"), ("success", False, False, "finished")], "status string, valid boolean, leaked boolean, outcome string")
    c = F.col
    got = [tuple(r) for r in df.select(*(ledger.retry_rollout(c("status"), c("valid"), c("leaked"), c("outcome"), t) for t in (False, True))).collect()]
    assert got == [(False, True), (False, False), (True, True), (True, True)]


def test_rollup_tells_the_total_from_a_null_language(spark):
    rows = [("go", None, True, 2, 1, 1, 1, 1), ("go", "x", None, 9, 9, 9, 9, 9), (None, None, False, 3, None, 1, None, 2)]
    df = spark.createDataFrame(rows, "lang string, error string, valid boolean, cost int, input int, cache_creation int, cache_read int, output int")
    got = {(r.lang, r.total): (r.n_runs, r.n_ok, r.n_valid, r.cost, r.input_tokens) for r in annotations.cost_rollup(df).collect()}
    assert got == {("go", False): (2, 1, 1, 2, 3), (None, False): (1, 1, 0, 3, 1), (None, True): (3, 2, 1, 5, 4)}


def test_output_files(spark):
    """The shapes of a broken output file; a null category is an unknown one; whole numbers stay exact."""
    outs = [None, "{ bad", "7", '{"snippets": 1}', "[5]", "{}", '"ab"', "[]"]
    got = {(r.i, r.pos, r.problem) for r in annotations.output_problems(spark.createDataFrame(list(enumerate(outs)), "i int, output string"), ["i"]).collect()}
    assert got == {(0, -1, annotations.NO_FILE), (1, -1, annotations.NO_JSON), (2, -1, annotations.NO_SHAPE), (3, -1, annotations.NO_LIST), (4, 0, annotations.NO_OBJECT), (6, 0, annotations.NO_OBJECT), (6, 1, annotations.NO_OBJECT)}
    one = spark.createDataFrame([(1, '[{"file_path": "f", "start_line": 1, "end_line": 2, "category": null}]')], "inst int, output string")
    files = spark.createDataFrame([(1, "f", 4)], "inst int, file_path string, last_line int")
    assert annotations.problems(annotations.fields(annotations.snippets(one, ["inst"])), files, ["inst"], ["core"]).first().problems == ["unknown category"]
    as_int = values(spark, lambda c: annotations.as_int(F.try_parse_json(c)), ["9007199254740993", "7.9", "-7.9", '" 12 "', "true", "1e3", '"1.5"', "null"])
    assert as_int == [9007199254740993, 7, -7, 12, None, 1000, None, None]


def proxy_record():
    text = "The user's email address is jane@roe.example.\nworking dir: /home/jane/x/file.py"
    body = {"model": "m", "max_tokens": 9, "system": [{"type": "text", "text": "Git user: Jane Roe\nrest"}], "tools": [{"name": "Read"}], "messages": [{"role": "user", "content": [{"type": "text", "text": text}]}], "metadata": {"user_id": "d"}}
    answer = {"role": "assistant", "content": [{"type": "text", "text": 'do"ne'}], "id": "msg_1", "model": "m", "stop_reason": "end_turn", "usage": {"output_tokens": 3}}
    return {"complete": True, "request": {"body": body, "headers": {"Authorization": "Bearer SECRET", "X-App": "cli"}}, "response": {"message": answer, "headers": {"Anthropic-Organization-Id": "org"}, "status": 200}}


def test_proxy_records(spark):
    raw = json.dumps(proxy_record())
    logs = spark.createDataFrame([(1, f"junk\n{raw}\n\n"), (2, ""), (3, f"{raw}\n[1]\n")], "run int, raw string")
    lenient, strict = traces.last_record(logs, ["run"]), traces.last_record(logs, ["run"], strict=True)
    assert {r.run for r in lenient.where("record is not null").collect()} == {1, 3} and {r.run for r in strict.where("record is not null").collect()} == {1}
    with pytest.raises(Exception, match="MALFORMED"):
        traces.last_record(spark.createDataFrame([(1, "{ bad")], "run int, raw string"), ["run"], strict=True).collect()
    got = {r.run: r.exchange for r in traces.exchange_of_proxy(lenient, ["run"], home="/home/jane", name="Jane Roe", email="jane@roe.example").collect()}
    record = json.loads(got[1])
    assert got[2] is None and set(record) == {"source", "complete", "model", "messages", "system", "tools", "extra_info"} and record["complete"] is True
    assert all(set(m) == set(traces.MESSAGE_FIELDS) for m in record["messages"]) and record["messages"][0]["id"] is None and record["messages"][-1]["content"][0]["text"] == 'do"ne'
    assert not any(x in got[1] for x in ("jane@roe", "Jane Roe", "/home/jane", "SECRET")) and record["system"][0]["text"] == f"Git user: {traces.NAME}\nrest"
    assert record["messages"][0]["content"][0]["text"] == f"The user's email address is {traces.EMAIL}\nworking dir: {traces.HOME}/x/file.py"
    extra = record["extra_info"]
    assert extra["request_headers"] == {"Authorization": "<redacted>", "X-App": "cli"} and extra["response_headers"] == {"Anthropic-Organization-Id": "<redacted>"} and extra["metadata"] == {} and extra["request_params"]["max_tokens"] == 9
    b = traces.conversation_of_proxy(lenient.where("run = 1"), ["run"]).orderBy("pos").collect()
    assert [r.role for r in b] == ["system", "user", "assistant"]


def test_workflows(spark):
    names = values(spark, lambda c: workflow.bad_env_names(F.create_map(c, F.lit("v"))), ["A_1", "1A", "a b", "A\n"])
    assert names == [[], ["1A"], ["a b"], ["A\n"]]
    maps = spark.createDataFrame([(1, {"a": 1}), (1, {"b": 2})], "run int, m map<string,int>")
    assert workflow.union_maps(maps, ["run"], "m").first().m == {"a": 1, "b": 2} and workflow.repeated_map_keys(maps.union(maps), ["run"], "m").count() == 2
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        workflow.union_maps(maps.union(maps), ["run"], "m").collect()
    lines = values(spark, workflow.report_line, ['warning\n{"a": 1}\n{"b": 2}\nend', "none"])
    assert lines == ['{"b": 2}', None]
    keys = spark.range(1).select(*(c.alias(k) for k, c in workflow.report_keys(F.lit('{"b": 2, "x": 1}'), ["a", "b"]).items())).first()
    assert (keys.lacking, keys.unknown) == (["a"], ["x"])
    meta = spark.range(1).select(workflow.run_metadata(F.lit('{"modelUsage": {"m1": {}, "m2": {}}, "num_turns": 3, "session_id": "s", "total_cost_usd": 0.5}'), F.lit("m"), F.lit("candidate"), F.lit(4), F.lit(1), F.lit(True)).alias("r")).first().r
    assert (meta.model, meta.num_turns, meta.run_id, meta.cost_usd, meta.snippet_count, meta.invalid_snippet_count) == ("m1, m2", 3, "s", 0.5, 4, 1)
    assert [r.path for r in workflow.by_depth(spark.createDataFrame([("a.b.c", 0), ("d", 1), ("a.b", 2), ("c", 3)], "path string, row_index int"), "path").collect()] == ["d", "c", "a.b", "a.b.c"]
    new = workflow.new_records(spark.createDataFrame([("i",)], "inst string")).first()
    assert (new.rollout, new.attempt, new.tier) == (0, 0, "formal") and new.run_ts
    records = spark.createDataFrame([("i", '{"inst":"i","entries":[]}')], "inst string, record string")
    known = spark.createDataFrame([("i", "flaky", None)], "inst string, known_flaky string, env_fix string")
    assert [json.loads(r.summary) for r in workflow.summaries(records, known, ["inst"]).collect()] == [{"inst": "i", "entries": [], "known_flaky": "flaky"}]
    assert [json.loads(r.summary) for r in workflow.summaries(records, known.select("inst", "env_fix"), ["inst"]).collect()] == [{"inst": "i", "entries": []}]


def test_coverage_of_ranges(spark):
    rows = [("i", 1, "f", 1, 10**9), ("i", 1, "f", 5, 7), ("i", 2, "f", 3, 4), ("i", 2, "f", 5, 8), ("i", 3, "f", 9, 2)]
    df = spark.createDataFrame(rows, "inst string, run int, file string, s bigint, e bigint")
    got = consensus.voted_ranges(df).collect()
    assert [(r.runs, r.s, r.e) for r in got] == [(3, 3, 8)]
    runs = df.select("inst", "run").distinct().where("run < 3")
    iou = consensus.line_iou(runs, df.where("run < 3")).first()
    assert (iou.both, iou.total) == (6, 10**9)


def test_ledger(spark):
    a = spark.createDataFrame([("i", 0, "t", 0, "ts-1", "ok"), ("i", 0, "t", 1, "ts-0", "old"), ("i", 10, "t", 0, "ts-1", "ok"), ("i", 2, "t", 0, "ts-1", "bad")], "inst string, rollout int, task string, attempt int, run_ts string, status string")
    m = spark.createDataFrame([("i", 0, "t", "ts-1", 1), ("i", 2, "t", "ts-9", 1)], "inst string, rollout int, task string, run_ts string, attempts int")
    assert [r.rollout for r in ledger.in_order(a).collect()] == [0, 0, 2, 10]
    assert {r.rollout: r.status for r in ledger.final_shards(a, m).collect()} == {0: "ok", 2: None}
    assert [r.rollout for r in ledger.orphans(a, m).collect()] == [2]
    inst = spark.createDataFrame([(k, i) for i, k in enumerate("hijkl")], "inst string, row_index bigint")
    assert [r.inst for r in ledger.to_do(inst, a, 2, 0, 1, 2).collect()] == ["h", "j"]
    with pytest.raises(ValueError):
        ledger.shard(inst, 3, 3)
    entries = spark.createDataFrame([(1, 0, "succeeded"), (1, 1, "failed"), (1, 2, "succeeded")], "wf int, pos int, outcome string")
    assert [r.outcome for r in ledger.blocked(entries, ["wf"]).orderBy("pos").collect()] == ["succeeded", "failed", "blocked"]


def trace(spark, *events_):
    raw = "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events_)
    return spark.createDataFrame([(1, raw)], "run int, raw string")


@pytest.mark.parametrize(
    "result,outcome",
    [({"subtype": "success"}, "finished"), ({"subtype": "success", "is_error": True}, "finished_with_api_error"), ({"subtype": "error_max_turns"}, "max_turns"), ({"subtype": "error_max_budget_usd"}, "max_budget"),
     ({"subtype": "error_max_structured_output_retries"}, "max_output_retries"), ({"subtype": "error_during_execution"}, "execution_error"), ({"subtype": "new"}, "execution_error"), ({}, "execution_error"), (None, "truncated")],
)
def test_outcomes(spark, result, outcome):
    t = trace(spark, {"type": "system"}, "", "junk", *([{"type": "result"} | result] if result is not None else []))
    assert traces.outcomes(t, ["run"]).first().outcome == outcome


def test_no_events(spark):
    assert traces.outcomes(spark.createDataFrame([(1, ""), (2, None), (3, "[1]\nx")], "run int, raw string"), ["run"]).select("outcome").distinct().collect() == [("no_output",)]


def test_blocks(spark):
    t = trace(
        spark, {"type": "user", "message": {"role": "user", "content": "hi"}}, {"type": "user", "message": {"role": "user", "content": ""}}, {"type": "user", "message": {"role": "developer", "content": "x"}},
        {"type": "assistant", "message": {"role": "assistant", "model": "m1", "content": [{"type": "thinking", "thinking": "w"}, {"type": "image"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "content": "s"}]}},
        {"type": "result", "subtype": "success", "is_error": False},
    )
    b = traces.blocks(t, ["run"]).orderBy("pos", "block_pos").collect()
    assert [(r.role, r.type, r.text) for r in b] == [("user", "text", "hi"), ("assistant", "reasoning", "w"), ("assistant", "tool_use", None), ("user", "tool_result", "a\n\nb"), ("user", "tool_result", "s")]
    assert json.loads(b[2].input) == {"command": "ls"}
    x = json.loads(traces.exchange_of_stream(t, ["run"]).first().exchange)
    assert (len(x["messages"]), x["model"], x["complete"]) == (5, "m1", True) and list(x["messages"][0]) == list(traces.MESSAGE_FIELDS)


def test_errors_and_redaction(spark):
    texts = ["", "  \n", "Usage limit reached", "HTTP 529", "quota and connection", "TypeError"]
    assert values(spark, traces.error_class, texts) == ["retryable", "retryable", "usage_limit", "retryable", "usage_limit", "fatal"]
    got = values(spark, lambda c: traces.redact(c, "/home/me", "Me", "me@x.org"), ["/home/me/a Me me@x.org\nGit user: Q R\nThe user's email address is z@z.z ok"])[0]
    assert got == f"{traces.HOME}/a {traces.NAME} {traces.EMAIL}\nGit user: {traces.NAME}\nThe user's email address is {traces.EMAIL} ok"
    m = spark.sql("select map('Authorization', 'a', 'x', 'b') as h, map('user_id', 'u', 'k', 'v') as m").select(traces.scrub_headers(F.col("h")), traces.scrub_metadata(F.col("m"))).first()
    assert m[0] == {"Authorization": "<redacted>", "x": "b"} and m[1] == {"k": "v"}


def test_snippets(spark):
    one = lambda **k: {"file_path": "f", "start_line": 1, "end_line": 2, "category": "core"} | k
    outs = [json.dumps([one(start_line="3", end_line=7.0)]), json.dumps({"snippets": [one(start_line=True), 5]}), json.dumps([one(category="odd", start_line=5, end_line=3)]), json.dumps([{"file_path": "f"}]), "{ bad", '"abc"', json.dumps([one(file_path="no")])]
    df = spark.createDataFrame(list(enumerate(outs)), "inst int, output string")
    files = spark.createDataFrame([(i, "f", 4) for i in range(7)], "inst int, file_path string, last_line int")
    got = {r.inst: r.problems for r in annotations.problems(annotations.fields(annotations.snippets(df, ["inst"])), files, ["inst"], ["core"]).collect()}
    assert got == {0: ["ends past the last line"], 1: ["not a line number"], 2: ["unknown category", "ends before it starts"], 3: [f"missing key {k}" for k in ("start_line", "end_line", "category")], 6: ["file not found"]}


def test_acceptable_misses(spark):
    paths = ["README.md", "a/go.sum", "Makefile", "CHANGELOG", "x_pb2.py", "vendor/a.go", "app/locale/de.json", "app/local/de.json", "src/a.py"]
    assert values(spark, annotations.acceptable_miss, paths) == [True] * 7 + [False] * 2


def test_stalls(spark):
    rows = [("a", 200.0, 80.0), ("b", 200.0, 79.0), ("c", 5.0, None), ("d", 1.0, 9.0)]
    got = {r.inst: (r.worst, r.stalled) for r in annotations.stalls(spark.createDataFrame(rows, "inst string, wall double, active double")).collect()}
    assert got == {"a": (120.0, False), "b": (121.0, True), "c": (0.0, False), "d": (0.0, False)}


def test_manifests(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "rel string, sha256 string")
    assert {r.rel: r.state for r in reconcile.compare(m, f).collect()} == {"a": "ok", "b": "changed", "c": "missing", "d": "extra"}
    assert reconcile.fetched(m, f).first() == (1, 1, 1)
    cases = [(False, None, None, 0), (True, None, "r", 0), (True, "r", "r", 0), (True, "s", "r", 0), (True, "r", "r", 1), (True, "s", "r", 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m boolean, h string, r string, c int")
    got = [r[0] for r in df.orderBy("i").select(reconcile.recommendation(F.col("m"), F.col("h"), F.col("r"), F.col("c"), F.lit(0), F.lit(0))).collect()]
    assert got == ["never pushed", "remote missing", "in sync", "remote ahead", "local changes", "diverged"]


def test_instances(spark):
    assert values(spark, normalize.parse_list, ["['a::t1', \"b::t2\"]", "['a\\x41']", "[1]", "{}", "junk", None, "[]"]) == [["a::t1", "b::t2"], ["aA"], ["1"], None, None, None, []]
    assert values(spark, normalize.unwrap, ['"**T**\\n\\nB"', "plain", '"broken', '"a" b', "12"]) == ["**T**\n\nB", "plain", '"broken', '"a" b', "12"]
    sha = "0123456789abcdef0123456789abcdef01234567"
    assert values(spark, normalize.fix_sha, [f"x-{sha}-vnan", f"x-{sha}", "x-123"]) == [sha, sha, None]
    assert values(spark, normalize.artifact_name_ok, ["a", "", ".", "..", "a/b", "a\\b"]) == [True, False, False, False, False, False]
    assert values(spark, lambda c: normalize.counter(c, "oom_kill", F.lit(True)), ["oom_kill 3\n", "x", "oom_kill 0"]) == [3.0, 1.0, 1.0]
    assert values(spark, lambda c: normalize.render(c, {"A": F.lit("1")}), ["x@A@", "x"]) == ["x1", None]
    df = spark.createDataFrame([("i", ["a", "b"]), ("j", ["a"])], "inst string, f2p array<string>")
    fix = spark.createDataFrame([("i", "a", "aa")], "inst string, name string, better string")
    assert {r.inst: r.f2p for r in normalize.corrected(df, fix).collect()} == {"i": ["aa", "b"], "j": ["a"]}
    with pytest.raises(ValueError):
        normalize.normalise(df, ["nope"], [])


def raw_row(**own):
    row = dict.fromkeys(normalize.COLUMNS, "") | dict.fromkeys(normalize.LIST_COLUMNS, "[]") | own
    return tuple(row[c] for c in normalize.COLUMNS)


def test_instances(spark):
    kind = ", ".join(f"{c} string" for c in normalize.COLUMNS)
    sha = "0123456789" * 4
    rows = [raw_row(instance_id=f"instance_a__b-c-{sha}-v1", base_commit=sha, problem_statement='"a\\nb"', requirements="r", fail_to_pass="['x', 'y']", before_repo_set_cmd="one\r\n two \x0b"), raw_row(instance_id="i2", fail_to_pass="['x']", interface='"open')]
    fix = spark.createDataFrame([("i2", "x", "long x")], "inst string, name string, better string")
    got = {r.instance_id: r for r in normalize.instances(spark.createDataFrame(rows, kind).withColumn("more", F.lit(1)), fix).collect()}
    one, two = got[f"instance_a__b-c-{sha}-v1"], got["i2"]
    assert one.fail_to_pass == ["x", "y"] and two.fail_to_pass == ["long x"] and one.problem_statement == "a\nb" and two.interface == '"open' and one.issue_categories == [] and list(one.asDict()) == list(normalize.COLUMNS)
    df = spark.createDataFrame([one, two], "repo string, instance_id string, base_commit string, patch string, test_patch string, problem_statement string, requirements string, interface string, repo_language string, fail_to_pass array<string>, pass_to_pass array<string>, issue_specificity array<string>, issue_categories array<string>, before_repo_set_cmd string, selected_test_files_to_run array<string>, dockerhub_tag string")
    c = F.col
    seen = df.select(normalize.fix_sha_objection(c("instance_id"), c("base_commit")), normalize.last_line(c("before_repo_set_cmd")), normalize.prompt(c("problem_statement"), c("requirements"), c("interface"))).collect()
    assert [tuple(r) for r in seen] == [("the fix commit is the base commit", " two", "a\nb\n\nRequirements:\nr\n\nNew interfaces introduced:\n"), ("no fix commit in the id", "", '\n\nRequirements:\n\n\nNew interfaces introduced:\n"open')]
    with pytest.raises(ValueError, match="missing columns: repo"):
        normalize.instances(spark.createDataFrame(rows, kind).drop("repo"))
    with pytest.raises(Exception, match="no list in pass_to_pass"):
        normalize.instances(spark.createDataFrame([raw_row(pass_to_pass="{'a': 1}")], kind)).collect()


def test_run_valid_and_resumed(spark):
    df = spark.createDataFrame([(1, True, 0), (2, True, 1), (3, False, 0), (4, None, 0), (5, True, None)], "i int, c boolean, n int")
    assert [r.v for r in df.select(annotations.run_valid(F.col("c"), F.col("n")).alias("v")).collect()] == [True, False, False, False, False]
    tasks = spark.createDataFrame([("a", 0, "t"), ("b", 0, "t"), ("c", 0, "t")], "inst string, rollout int, task string")
    marks = spark.createDataFrame([("a", 0, "t", 2, "ts"), ("b", 0, "t", 1, "ts")], "inst string, rollout int, task string, attempts int, run_ts string")
    tries = spark.createDataFrame([("a", 0, "t", 0, "ts", "failed"), ("a", 0, "t", 1, "ts", "success"), ("b", 0, "t", 0, "other", "success"), ("c", 0, "t", 0, "ts", "success")], "inst string, rollout int, task string, attempt int, run_ts string, status string")
    assert {r.inst: (r.state, r.status) for r in ledger.resumed(tasks, marks, tries).collect()} == {"a": ("resumed", "success"), "b": ("contradicted", None), "c": ("to run", None)}


def test_resolved_inputs(spark):
    inputs = spark.createDataFrame([(1, "p", n) for n in ("a", "b", "c", "d")] + [(2, "p", "a"), (1, "q", "a")], "wf int, producer string, name string")
    records = spark.createDataFrame([(1, "p", {"a": "k/a", "b": "k/b", "c": "k/c"}), (2, "p", {})], "wf int, producer string, artifact_keys map<string,string>")
    payloads = spark.createDataFrame([("k/a", bytearray(b"x")), ("k/b", bytearray()), ("k/z", bytearray(b"z"))], "key string, content binary")
    got = {(r.wf, r.producer, r.name): r.state for r in workflow.resolved_inputs(inputs, records, payloads, ["wf"]).collect()}
    assert got == {(1, "p", "a"): "usable", (1, "p", "b"): "empty", (1, "p", "c"): "absent", (1, "p", "d"): "unrecorded", (2, "p", "a"): "unrecorded", (1, "q", "a"): "unrecorded"}


def test_checksum_states(spark):
    manifest = json.dumps({"platforms": {"linux": {"checksum": "h"}, "mac": {"checksum": ""}, "bsd": {"checksum": 5}, "odd": 1}})
    files = spark.createDataFrame([("1", p, s) for p in ("linux", "mac", "bsd", "odd", "none") for s in ("h", "x", None)] + [("2", "linux", "h"), ("3", "linux", "h")], "version string, platform string, sha256 string")
    got = {(r.version, r.platform, r.sha256): r.state for r in workflow.checksum_state(files, spark.createDataFrame([("1", manifest), ("2", "{ bad")], "version string, manifest string")).collect()}
    assert {k[2]: v for k, v in got.items() if k[:2] == ("1", "linux")} == {"h": "ok", "x": "mismatch", None: "absent"}
    assert {v for k, v in got.items() if k[:2] != ("1", "linux")} == {"no checksum"}
