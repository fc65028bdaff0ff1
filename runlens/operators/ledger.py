"""The ledger of attempts: which are done, final, fair to retry, blocked.

Attempts are keyed (sweep, inst, rollout, task, attempt): rollouts are samples, attempts are retries of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings that are not of the agent's making.
RETRYABLE = ("no_output", "truncated", "finished_with_api_error", "execution_error")
ORDER = ("inst", "rollout", "task", "attempt")


def store_key(sweep: str = "sweep") -> Column:
    """The path of an attempt's shard."""
    return F.concat_ws("/", sweep, "inst", F.concat(F.lit("r"), "rollout"), "task", F.concat(F.lit("a"), "attempt"))


def in_order(attempts: DataFrame) -> DataFrame:
    """Numeric order: rollout 10 after rollout 2."""
    return attempts.orderBy(*ORDER)


def of_rollout(attempts: DataFrame, sweep: str, inst, rollout: int, task: str | None = None) -> DataFrame:
    """One rollout's shards, of one task if named: filters that reach the scan."""
    found = attempts.where((F.col("sweep") == sweep) & (F.col("inst") == inst) & (F.col("rollout") == rollout))
    return found if task is None else found.where(F.col("task") == task)


def shard(instances: DataFrame, index: int, count: int, position: str = "row_index") -> DataFrame:
    """Every count-th instance from index on."""
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    return instances.where(F.pmod(F.col(position), F.lit(count)) == index)


def to_do(instances: DataFrame, attempts: DataFrame, rollout: int, index: int = 0, count: int = 1, limit: int | None = None, position: str = "row_index") -> DataFrame:
    """Instances of the shard without a record for the rollout - a recorded failure counts as done - and then the first `limit`."""
    done = attempts.where(F.col("rollout") == rollout).select("inst").distinct()
    left = shard(instances, index, count, position).join(done, "inst", "left_anti").orderBy(position)
    return left if limit is None else left.limit(limit)


def final_shards(attempts: DataFrame, markers: DataFrame) -> DataFrame:
    """The shard each marker (inst, rollout, task, attempts, run_ts) was written for; a marker without one has a null status."""
    own = attempts.select("inst", "rollout", "task", "run_ts", (F.col("attempt") + 1).alias("attempts"), "attempt", "status")
    return markers.join(own, ["inst", "rollout", "task", "run_ts", "attempts"], "left")


def orphans(attempts: DataFrame, markers: DataFrame) -> DataFrame:
    return final_shards(attempts, markers).where("attempt is null").select(markers.columns)


def resumed(tasks: DataFrame, markers: DataFrame, attempts: DataFrame) -> DataFrame:
    """tasks (inst, rollout, task) met with their markers: `state` is to run (no marker), resumed (with the status of the shard it was written for), or contradicted (a marker without its shard)."""
    final = final_shards(attempts, markers).select("inst", "rollout", "task", "attempts", "status", F.lit(True).alias("_marked"))
    state = F.when(F.col("_marked").isNull(), "to run").when(F.col("status").isNull(), "contradicted").otherwise("resumed")
    return tasks.join(final, ["inst", "rollout", "task"], "left").withColumn("state", state).drop("_marked")


def derived_status(timed_out: Column, setup_error: Column, run_error: Column) -> Column:
    return F.when(setup_error, "setup_error").when(timed_out, "timeout").when(run_error, "run_error").otherwise("success")


def outputs_valid(status: Column, required: Column, artifacts: Column) -> Column:
    """Success with every required output among the recorded ones."""
    return (status == "success") & (F.size(F.array_except(required, F.map_keys(artifacts))) == 0)


def retryable(outcome: Column) -> Column:
    return outcome.isin(*RETRYABLE)


def retry_rollout(status: Column, valid: Column, leaked: Column, outcome: Column, on_timeout: bool = False) -> Column:
    """Whether a rollout may run again: a timeout asks its own setting first; never after a leak, always after a failure that was not the agent's. Reads no patch and no grade."""
    return F.when(status == "timeout", F.lit(on_timeout)).when(leaked, False).when(~valid, True).otherwise(F.coalesce(retryable(outcome), F.lit(False)))


def retry_grading(status: Column, valid: Column, resolved: Column, on_timeout: bool = False) -> Column:
    """Whether a grading may run again: after an invalid run, or one that did not resolve (null: no verdict)."""
    return F.when(status == "timeout", F.lit(on_timeout)).otherwise(~valid | F.coalesce(~resolved, F.lit(False)))


def first_success(attempts: DataFrame, keys: list[str], good: Column) -> DataFrame:
    """The attempt at which the loop stopped: the first good one, or else the last."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(good, F.col("attempt"))).over(w)
    return attempts.withColumn("_stop", F.coalesce(first, F.max("attempt").over(w))).where("attempt = _stop").drop("_stop")


def blocked(entries: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Entries after the first failure did not run: outcome becomes `blocked`."""
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.max((F.col("outcome") == "failed").cast("int")).over(before)
    return entries.withColumn("outcome", F.when(failed == 1, "blocked").otherwise(F.col("outcome")))


def bindings(needs: DataFrame, produces: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Which producer each input of a workflow's entries is bound to.

    needs (wf, pos, name; optional: via, required, builder), produces (wf, pos, key, name), given (wf, name): what the caller hands in, a
    producer named `inputs` that is earlier than any entry. Per need: n, its earlier producers (of a need that names one in `via`: those of that key),
    the producer's key and how it ends: bound; not earlier (`via` is no earlier producer of the name); ambiguous; unbound; or
    left out, where nothing produces an input that is optional or that the task's own builder makes.

    Needs and producers stand in one sorted stream by name, each producer once for whoever asks for it by key and once for all
    others; a running count and the last producer seen answer every need, in one shuffle.
    """
    have = set(needs.columns)
    option = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    need = needs.select(
        "wf", "pos", "name", option("via", F.lit(None).cast("string")).alias("via"), F.lit(0).alias("made"), F.lit(None).cast("string").alias("key"),
        (option("required", F.lit(True)) & ~option("builder", F.lit(False))).alias("wanted"),
    )
    made = produces.select("wf", "pos", "key", "name")
    if given is not None:
        made = made.unionByName(given.select("wf", F.lit(-1).alias("pos"), F.lit("inputs").alias("key"), "name"))
    made = made.withColumn("via", F.explode(F.array(F.col("key"), F.lit(None).cast("string")))).withColumns({"made": F.lit(1), "wanted": F.lit(None).cast("boolean")})
    earlier = Window.partitionBy("wf", "name", "via").orderBy("pos", "made").rowsBetween(Window.unboundedPreceding, 0)  # at one place needs come first
    seen = need.unionByName(made).withColumns({"n": F.sum("made").over(earlier), "last": F.last("key", ignorenulls=True).over(earlier)}).where("made = 0")
    named = F.col("via").isNotNull()
    state = F.when(named, F.when(F.col("n") > 0, "bound").otherwise("not earlier")).when(F.col("n") == 1, "bound").when(F.col("n") > 1, "ambiguous").when(F.col("wanted"), "unbound").otherwise("left out")
    return seen.select("wf", "pos", "name", "n", F.when(state == "bound", F.col("last")).alias("producer"), state.alias("state"))


def unused(inputs: DataFrame, needs: DataFrame) -> DataFrame:
    """Inputs given that no entry consumes."""
    return inputs.join(needs.select("wf", "name").distinct(), ["wf", "name"], "left_anti")


def exit_code(succeeded: Column, metrics: Column) -> Column:
    """failed, unresolved (a metric named *.resolved below 1) or ok."""
    low = F.exists(F.map_entries(metrics), lambda m: m["key"].endswith(".resolved") & (m["value"] < 1))
    return F.when(~succeeded, "failed").when(low, "unresolved").otherwise("ok")


def measured(metrics: Column) -> Column:
    """A metric that is absent was not measured; it is never 0."""
    return F.map_filter(metrics, lambda k, v: v.isNotNull())


def fix_sha_problem(sha: Column, future_commits: Column, reachable: Column, is_future: Column) -> Column:
    """Why a solution commit cannot be trusted: absent although there is future history, or an ancestor. Null: no objection."""
    return F.when(sha.isNull() | (F.coalesce(future_commits, F.lit(0)) == 0), None).when(~F.coalesce(reachable, F.lit(False)), "absent").when(~is_future, "ancestor")
