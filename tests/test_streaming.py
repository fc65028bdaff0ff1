"""Endings of runs from a stream with late, repeated and reordered events, across a restart."""

import random
import time

import pytest
from pyspark.sql import functions as F

from runlens.operators import traces
from runlens.streaming import endings

EVENTS = "run string, pos bigint, type string, subtype string, is_error boolean"


@pytest.fixture
def source(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    endings.use_state_store(spark)
    folder = tmp_path / "events"
    folder.mkdir()

    def add(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))

    def start(idle_ms, trigger):
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return endings.endings(stream, idle_ms).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep).trigger(**trigger).start()

    def run():
        q = start(None, {"availableNow": True})
        assert q.awaitTermination(120)
        if q.exception():
            raise q.exception()

    out = []

    def keep(batch, _):
        out.extend(batch.collect())

    yield add, run, out, start
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_late_repeated_reordered_and_restarted(source):
    add, run, out, start = source
    add([("a", 5, "result", "success", False), ("a", 1, "user", None, None), ("b", 2, "result", "error_max_turns", None), ("c", 1, "user", None, None)])
    add([("a", 3, "result", "error_max_turns", False), ("a", 5, "result", "success", False)])  # an earlier one late, and one again
    run()
    assert sorted((r.run, r.pos, r.outcome) for r in out) == [("a", 5, "finished"), ("b", 2, "max_turns")]
    out.clear()
    add([("a", 9, "result", "success", True), ("a", 7, "result", "error_new", None), ("b", 2, "result", "error_max_turns", None), ("c", 4, "result", "error_new", None)])
    run()  # a new query on the same checkpoint: the state is still there
    assert sorted((r.run, r.pos, r.outcome, r.n_events) for r in out) == [("a", 9, "finished_with_api_error", 6), ("c", 4, "execution_error", 2)]


def test_any_order_gives_the_outcome_of_the_whole_trace(spark, source):
    """Shuffled events in several files end where the batch operator ends for the whole traces."""
    add, run, out, start = source
    r = random.Random(4)
    rows = [(f"r{i}", p, r.choice(["user", "result", "result"]), r.choice(["success", "error_max_turns", "error_max_budget_usd", None]), r.choice([True, False])) for i in range(20) for p in range(r.randint(1, 6))]
    shuffled = rows + rows[::3]
    r.shuffle(shuffled)
    for i in range(3):
        add(shuffled[i::3])
    run()
    last = {}
    for x in out:
        last[x.run] = x.outcome
    import json

    text = {}
    for run_, _, kind, subtype, err in rows:
        text[run_] = text.get(run_, "") + json.dumps({"type": kind, "subtype": subtype, "is_error": err}) + "\n"
    whole = traces.outcomes(spark.createDataFrame(list(text.items()), "run string, raw string"), ["run"])
    assert last == {x.run: x.outcome for x in whole.where(F.col("outcome") != "truncated").collect()}


def test_idle_runs_are_given_up(source):
    """Timers by the clock keep a query going, so this one is stopped by hand."""
    add, _, out, start = source
    add([("a", 5, "result", "success", False)])
    q = start(500, {"processingTime": "200 milliseconds"})
    try:
        until(lambda: len(out) == 1)
        time.sleep(3)  # the timer passes, and the state of `a` goes
        add([("a", 2, "result", "error_max_turns", False)])
        until(lambda: len(out) == 2)
    finally:
        q.stop()
    assert [(r.run, r.pos) for r in out] == [("a", 5), ("a", 2)]


def until(done, seconds=45):
    end = time.monotonic() + seconds
    while not done() and time.monotonic() < end:
        time.sleep(0.2)
    assert done()
