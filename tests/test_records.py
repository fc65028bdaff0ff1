"""Unified records: redaction of values at any depth, records of both kinds of trace, what is read from them."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from runlens.functions.json_text import map_leaves, truthy
from runlens.operators import annotations, patches, traces

HOME, NAME, EMAIL = "/home/max", "max", "m@x.org"


def redacted(text):
    for old, new in ((HOME, traces.HOME), (NAME, traces.NAME), (EMAIL, traces.EMAIL)):
        text = text.replace(old, new)
    text = re.sub(r"(The user's email address is )\S+", rf"\g<1>{traces.EMAIL}", text)
    return re.sub(r"(Git user: )[^\n]+", rf"\g<1>{traces.NAME}", text)


def walked(value):
    if isinstance(value, str):
        return redacted(value)
    if isinstance(value, dict):
        return {k: walked(v) for k, v in value.items()}
    return [walked(v) for v in value] if isinstance(value, list) else value


def anything(r, depth=0):
    texts = ["max", "/home/max/a", 'say "max"', "back\\slash", '\\"', ":", '":', "{", "[max]", "Git user: Q\nR", "The user's email address is z@z.z\tok", "", "é 日本 \x01\x02\x1f", "m@x.org,", "\\", "\\\\max\\"]
    kind = r.choice("sssnbdl" if depth < 5 else "s")
    if kind == "s":
        return "".join(r.choice(texts) for _ in range(r.randint(0, 3)))
    if kind in "nb":
        return r.choice([1, -2.5, True, False, None])
    if kind == "d":
        return {r.choice(texts) + str(i): anything(r, depth + 1) for i in range(r.randint(0, 4))}
    return [anything(r, depth + 1) for _ in range(r.randint(0, 4))]


def test_leaves_of_any_shape(spark):
    """Values at any depth change, keys do not; compact texts, spread-out ones, and ones that escape what they need not."""
    r = random.Random(1)
    values = [{"max_tokens": 1, "max": "max"}, [], {}, "max", *(anything(r) for _ in range(400))]
    texts = [f(v) for v in values for f in (json.dumps, lambda v: json.dumps(v, indent=1, ensure_ascii=False), lambda v: json.dumps(v, separators=(",", " : ")))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", traces.redact_json(F.col("x"), HOME, NAME, EMAIL).alias("y"))
    for i, y in df.collect():
        assert json.loads(y) == walked(values[i // 3]), texts[i]


def test_leaves_deep_and_long(spark):
    deep = "[" * 900 + '"max"' + "]" * 900
    long = json.dumps({"max": 'a\n"\\max' * 100_000})
    got = [r.y for r in spark.createDataFrame([(deep,), (long,), (None,)], "x string").select(map_leaves(F.col("x"), F.upper).alias("y")).collect()]
    assert got[0] == deep.replace("max", "MAX") and json.loads(got[1]) == {"max": 'A\n"\\MAX' * 100_000} and got[2] is None


def test_truth(spark):
    values = ["true", "false", "0", "0.0", "-1", "0.5", '""', '"no"', "[]", "[0]", "{}", '{"a": 0}', "null", None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", truthy(F.try_parse_json("x")).alias("y"))
    assert [r.y for r in df.orderBy("i").collect()] == [bool(json.loads(v)) if v else False for v in values]


def stream(*events):
    return "".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in events)


def record_of(raw):
    """The record by plain Python."""
    if raw is None:
        return {}
    events = []
    for line in raw.splitlines():
        try:
            x = json.loads(line.strip())
        except ValueError:
            continue
        if isinstance(x, dict):
            events.append(x)
    result = ([e for e in events if e.get("type") == "result"] or [{}])[-1]
    talk = [e for e in events if e.get("type") in ("user", "assistant") and isinstance(e.get("message"), dict)]
    last = [e["message"] for e in talk if e["type"] == "assistant"]
    return walked({
        "source": "stream", "complete": result.get("subtype") == "success" and not result.get("is_error", False), "model": last[-1].get("model") if last else None,
        "messages": [{f: e["message"].get(f) for f in traces.MESSAGE_FIELDS} for e in talk], "system": None, "tools": None, "extra_info": {"result": result},
    })


def test_stream_records(spark):
    user = {"type": "user", "message": {"role": "user", "content": f"see {HOME}/x of max m@x.org", "max": "max", "other": 1}}
    said = {"type": "assistant", "message": {"role": "assistant", "model": "m1", "content": [{"type": "tool_use", "input": {"max": {"a": [HOME, 3, None]}}}], "usage": {"max_tokens": 4}, "stop_reason": None}}
    end = {"type": "result", "subtype": "success", "is_error": False, "duration_ms": 2500, "result": "Git user: max\nend", "modelUsage": {"max": {"n": 1}}}
    raws = [
        None, "", "junk\n[1]\n7\n", stream(user, said, end), stream(user, "junk\n", said, {"type": "assistant", "message": None}, {"type": "assistant", "message": "text"}),
        stream(end, user, {**end, "subtype": "error_max_turns", "duration_ms": "12"}), stream(user, {**end, "is_error": "yes"}), stream({**end, "is_error": None}), stream({**end, "is_error": 0, "duration_ms": 0.5}), stream(said, {"type": "assistant", "message": {}}),
        stream({"type": "user", "message": {"content": ["max", {"max": "max"}]}}, {"type": 3, "message": {}}),
    ]
    files = spark.createDataFrame([(i, "stream", raw) for i, raw in enumerate(raws)], "run int, capture string, raw string")
    got = traces.exchange_of_file(files, ["run"], HOME, NAME, EMAIL).select("run", "exchange", traces.active_seconds(F.col("exchange")).alias("active"))
    for run, exchange, active in got.collect():
        want = record_of(raws[run])
        assert json.loads(exchange) == want
        took = want.get("extra_info", {}).get("result", {}).get("duration_ms")
        assert active == (took / 1000 if isinstance(took, (int, float)) else None)
    assert traces.exchange_of_stream(files, ["run"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_trace_files_of_both_kinds(spark):
    log = json.dumps({"complete": True, "request": {"body": {"model": "m", "max_tokens": 5, "messages": [{"role": "user", "content": "max"}]}}})
    rows = [(1, "proxy", f"junk\n{log}\n"), (2, "proxy", None), (3, "proxy", "[1]\n"), (4, "stream", None), (5, "stream", "")]
    got = {r.run: json.loads(r.exchange) for r in traces.exchange_of_file(spark.createDataFrame(rows, "run int, capture string, raw string"), ["run"], name="max").collect()}
    assert got[2] == got[3] == got[4] == {} and got[5]["source"] == "stream" and got[5]["extra_info"] == {"result": {}} and got[5]["messages"] == []
    assert got[1]["source"] == "proxy" and got[1]["messages"][0]["content"] == traces.NAME and got[1]["extra_info"]["request_params"]["max_tokens"] == 5
    with pytest.raises(Exception, match="MALFORMED"):
        traces.exchange_of_file(spark.createDataFrame([(1, "proxy", "{ bad")], "run int, capture string, raw string"), ["run"]).collect()


def test_coarse_outcome(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "i int, c boolean")
    assert [r.o for r in df.select("i", traces.coarse_outcome(F.col("c")).alias("o")).orderBy("i").collect()] == ["no_output", "finished", "truncated"]


def test_new_files(spark):
    section = lambda path, new: f"diff --git a/{path} b/{path}\n" + ("new file mode 100644\n" if new else "") + f"--- a/{path}\n+++ b/{path}\n+x\n"
    diff = section("a.py", True) + section("b.py", False) + section("c d.py", True) + section("e/f.py", True)
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None), (4, "new file mode 100644\n")], "run int, diff string")
    assert sorted(tuple(r) for r in patches.new_files(df, ["run"]).collect()) == [(1, "a.py"), (1, "e/f.py")]


def test_miss_audit(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "inst string, path string")
    gold = pairs([("a", "src/x.py"), ("a", "README.md"), ("b", "src/y.py"), ("c", "src/z.py"), ("d", "src/w.py"), ("e", "docs/x.md")])
    seen = pairs([("a", "src/other.py"), ("b", "src/y.py"), ("d", "src/v.py"), ("e", "q"), ("f", "src/x.py")])
    assert tuple(annotations.miss_audit(gold, seen, pairs([("d", "src/w.py")])).first()) == (4, 1)
    assert tuple(annotations.miss_audit(gold.limit(0), seen, seen.limit(0)).first()) == (0, 0)


def test_tool_results(spark):
    found = spark.createDataFrame([(1, 0, 0, "tool_use", None, "Bash", "{}"), (1, 1, 0, "tool_result", "out", None, None), (1, 2, 0, "tool_use", None, "Read", "{}")], "run int, pos int, block_pos int, type string, text string, name string, input string")
    ids = spark.createDataFrame([(1, 0, 0, "u1"), (1, 1, 0, "u1"), (1, 2, 0, "u2")], "run int, pos int, block_pos int, use_id string")
    assert sorted((r.use_id, r.name, r.result) for r in traces.tool_results(found, ["run"], ids).collect()) == [("u1", "Bash", "out"), ("u2", "Read", None)]
