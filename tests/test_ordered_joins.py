"""Joins by order and by pattern: prefixes, positions, earlier producers, many words in one text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from runlens.operators import integrity, ledger, normalize, ordered, patches, workflow


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_against_all_pairs(spark):
    """Names that begin each other, equal names and tests, repeated rows, characters beyond ASCII, the empty name, nulls."""
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abé￿🙂") for _ in range(r.randint(0, n)))
    names = [(r.choice("ij"), text(3)) for _ in range(120)] + [("i", ""), ("k", "a"), ("i", "zz"), (None, "a"), ("i", None)]
    tests = [(r.choice("ij"), text(5)) for _ in range(400)] + [("i", "zz"), ("i", None), ("l", "a")]
    tests += tests[:50]
    got = normalize.unique_longer(spark.createDataFrame(names, "inst string, name string").repartition(5), spark.createDataFrame(tests, "inst string, test string"))
    want = []
    for inst, name in names:
        hits = {t for i, t in tests if inst and name is not None and t is not None and i == inst and t.startswith(name) and t != name}
        want.append((inst, name, len(hits), next(iter(hits)) if len(hits) == 1 else None))
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_prefixes_of_one_hot_instance(spark):
    """One instance with nearly all rows is dealt over many parts by its order, and no row stands for a pair."""
    names = [("hot", f"tests/a_{i:05d}") for i in range(0, 3000, 3)] + [("other", "x")]
    tests = [("hot", f"tests/a_{i:05d}::t") for i in range(3000)] + [("other", "xy")]
    df = normalize.unique_longer(spark.createDataFrame(names, "inst string, name string"), spark.createDataFrame(tests, "inst string, test string"))
    assert {(r.n, r.test is not None) for r in df.collect()} == {(1, True)} and df.count() == len(names)
    assert "startswith" not in plan(df).lower() and "StartsWith" not in plan(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else be one part
    try:
        p = ordered.placed(spark.createDataFrame(tests, "inst string, test string").repartition(3), ["inst", "test"])
        assert p.groupBy("_part").count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_across_parts(spark):
    r = random.Random(1)
    rows = [(i, r.random() < 0.1, f"v{i}") for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = ordered.running(spark.createDataFrame(rows, "i int, f boolean, v string").repartition(6), ["i"], F.col("f"), F.col("v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n, last, want = 0, None, []
    for i, f, v in rows:
        n, last = (n + 1, v) if f else (n, last)
        want.append((i, n, last))
    assert [(x.i, x.n_so_far, x.latest) for x in df.orderBy("i").collect()] == want


def test_strict_zip(spark):
    a = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int").repartition(4)
    b = spark.createDataFrame([(f"{i:03d}", -i) for i in range(101)], "y string, z int").repartition(3)
    got = ordered.zipped(a, b, ["x"], ["z"]).orderBy("position").collect()
    assert [(r.position, r.left.x, r.right.z) for r in got] == [(i, i, i - 100) for i in range(101)]
    with pytest.raises(ValueError, match="101 rows beside 100"):
        ordered.zipped(a, b.where("z < 0"), ["x"], ["z"])
    assert ordered.zipped(a.limit(0), b.limit(0), ["x"], ["y"]).count() == 0


def bound(needs, produces, given):
    """Entry by entry, as a workflow is bound."""
    out = []
    for wf, pos, name, via, required, builder in needs:
        earlier = ["inputs" for w, n in given if (w, n) == (wf, name)] + [k for w, p, k, n in sorted(produces) if w == wf and n == name and p < pos]
        if via is not None:
            hit = [k for k in earlier if k == via]
            out.append((wf, pos, name, len(hit), via if hit else None, "bound" if hit else "not earlier"))
        elif len(earlier) == 1:
            out.append((wf, pos, name, 1, earlier[0], "bound"))
        else:
            out.append((wf, pos, name, len(earlier), None, "ambiguous" if earlier else "left out" if builder or not required else "unbound"))
    return sorted(out)


def test_bindings(spark):
    r = random.Random(3)
    produces = [(w, p, f"e{p}", f"x{r.randint(0, 2)}") for w in range(30) for p in range(5)]
    given = [(w, "x0") for w in range(0, 30, 3)]
    needs = [(w, p, f"x{x}", r.choice([None, None, "inputs", f"e{r.randint(0, 5)}", "ghost"]), r.random() < 0.6, r.random() < 0.2) for w in range(31) for p in range(5) for x in range(3)]
    n = spark.createDataFrame(needs, "wf int, pos int, name string, via string, required boolean, builder boolean")
    m, g = spark.createDataFrame(produces, "wf int, pos int, key string, name string"), spark.createDataFrame(given, "wf int, name string")
    got = ledger.bindings(n, m, g)
    assert sorted(tuple(x) for x in got.collect()) == bound(needs, produces, given)
    assert {x.state for x in got.collect()} == {"bound", "not earlier", "ambiguous", "unbound", "left out"}
    assert ledger.bindings(n, m, g)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    plain = ledger.bindings(n.select("wf", "pos", "name"), m)
    assert sorted(tuple(x) for x in plain.collect()) == bound([(*x[:3], None, True, False) for x in needs], produces, [])


def test_declarations_of_nothing(spark):
    entries = spark.createDataFrame([(1, 0, "a", ["x"], [None, "b/x"], 1.0, 0)], "wf int, pos int, key string, inputs array<string>, bindings array<string>, timeout double, retries int")
    wfs = spark.createDataFrame([(1,), (2,), (2,)], "wf int")
    got = sorted((tuple(r) for r in workflow.declaration_problems(entries, wfs).collect()), key=repr)
    assert got == [(1, "a", "malformed binding "), (2, None, workflow.NO_ENTRIES)] and workflow.declaration_problems(entries).count() == 1


def test_many_words_in_one_text(spark):
    """3,000 test names and a patch of a megabyte: one pass over one copy of the text, the rows of a plain search."""
    r = random.Random(2)
    word = lambda: "test_" + "".join(r.choice("abcd") for _ in range(r.randint(3, 8)))
    tests = sorted({word() for _ in range(12_000)})[:3000]
    body = "\n".join("+" + " ".join(word() for _ in range(20)) for _ in range(5500))
    assert len(body) > 1_000_000 and len(tests) == 3000
    runs = [(1, body), (2, "+x test_nothing_here"), (3, None), (4, body)]
    required = [(1, f"a/b.py::T::{t}[p]") for t in tests] + [(2, t) for t in tests] + [(3, "test_abcabc"), (1, None), (5, "test_abcabc")]
    df = integrity.patch_findings(spark.createDataFrame(runs, "run int, diff string"), ["run"], spark.createDataFrame(required, "run int, test string"))
    begin = time.perf_counter()
    got = {x.run: x.required_test_literal for x in df.collect()}
    took = time.perf_counter() - begin
    added = "\n".join(line[1:] for line in body.split("\n"))
    assert got == {1: [t for t in tests if len(t) >= 8 and t in added], 2: [], 3: [], 4: []} and len(got[1]) > 1000
    assert "Contains(" not in plan(df) and "contains(" not in plan(df) and took < 60


def test_words_that_hold_each_other(spark):
    rows = [("abcabx", ["abc", "ab", "x", "bca", "abcabxy", "", "ab"]), ("", ["a"]), (None, ["a"]), ("a", None), ("é日本🙂", ["日", "🙂", "é日"])]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, t string, w array<string>").select("i", patches.found_in(F.col("t"), F.col("w")).alias("y"))
    assert [x.y for x in df.orderBy("i").collect()] == [["ab", "abc", "bca", "x"], [], [], [], sorted(["日", "🙂", "é日"])]
