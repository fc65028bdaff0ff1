"""Test results to verdicts, base and golden runs to findings about an instance, and the summary over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.json_text import once

OK, UNPARSEABLE, ABSENT = "ok", "unparseable", "absent"
VERDICTS = ("OK", "GOLDEN_FAIL", "BASE_UNEXPECTED_PASS", "ERROR")


def _state(output: Column, parsed: Column) -> Column:
    return F.when(output.isNull(), ABSENT).when(F.schema_of_variant(parsed).startswith("OBJECT"), OK).otherwise(UNPARSEABLE)


def _passed(parsed: Column) -> Column:
    tests = F.try_variant_get(parsed, "$.tests", "array<struct<name:variant,status:variant>>")
    text = lambda v: F.try_variant_get(v, "$", "string")
    named = F.array_compact(F.transform(tests, lambda t: F.when(text(t["status"]) == "PASSED", text(t["name"]))))
    return F.coalesce(F.array_sort(F.array_distinct(named)), F.array().cast("array<string>"))


def output_state(output: Column) -> Column:
    """absent (null), unparseable (no JSON object) or ok."""
    return _state(output, F.try_parse_json(output))


def passed_tests(output: Column) -> Column:
    """Distinct names of tests whose status is PASSED, sorted; items that are no objects are skipped."""
    return _passed(F.try_parse_json(output))


def required_tests(f2p: Column, p2p: Column) -> Column:
    return F.array_sort(F.array_union(f2p, p2p))


def listed_tests(f2p: Column, p2p: Column) -> Column:
    """As a record lists them: one after the other, repeats kept."""
    return F.concat(f2p, p2p)


def mean_score(graded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_score), and as an extension pass_at(k) is left to the caller's arithmetic on n and the resolved."""
    return graded.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.count_if("resolved").alias("resolved"))


def verdict(required: Column, passed: Column, state: Column) -> dict[str, Column]:
    """missing (sorted), score, resolved, and the counts reports use. With nothing required a parsed output resolves."""
    missing = F.array_sort(F.array_except(required, passed))
    score = F.when((state == OK) & (F.size(missing) == 0), 1.0).otherwise(0.0)
    return {
        "missing": missing, "score": score, "resolved": score >= 1.0, "first_missing": F.array_min(missing),
        "n_required": F.size(required).cast("double"), "n_passed": F.size(passed).cast("double"), "n_missing": F.size(missing).cast("double"),
    }


def grade(runs: DataFrame) -> DataFrame:
    """runs (…, f2p, p2p, output): adds output_state, passed and the verdict's columns. Tests count only in an ok output."""
    read = once(F.try_parse_json("output"), lambda v: F.struct(_state(F.col("output"), v).alias("output_state"), _passed(v).alias("passed")))
    out = runs.drop("output_state", "passed").withColumn("_r", read)
    out = out.withColumns({"output_state": F.col("_r.output_state"), "passed": F.when(F.col("_r.output_state") == OK, F.col("_r.passed")).otherwise(F.array().cast("array<string>"))}).drop("_r")
    return out.withColumns(verdict(required_tests(F.col("f2p"), F.col("p2p")), F.col("passed"), F.col("output_state")))


def detail(graded: DataFrame) -> DataFrame:
    """Adds what a base run's report shows: bug tests that pass already, and other tests that do not."""
    return graded.withColumns({
        "fail_to_pass_passed": F.array_sort(F.array_intersect("f2p", "passed")),
        "pass_to_pass_missing": F.array_sort(F.array_except("p2p", "passed")),
    })


def classify(graded: DataFrame) -> DataFrame:
    """(inst, verdict) from graded rows with inst, phase (base, golden) and status: ERROR before GOLDEN_FAIL before BASE_UNEXPECTED_PASS before OK."""
    broken = (F.col("status") != "success") | F.col("output_state").isNull() | (F.col("output_state") != OK)
    base, golden = F.col("phase") == "base", F.col("phase") == "golden"
    one = graded.groupBy("inst").agg(
        F.bool_or(broken).alias("broken"), F.count_if(base).alias("bases"), F.count_if(golden).alias("goldens"),
        F.bool_or(F.when(golden, F.col("resolved"))).alias("golden_ok"),
        F.bool_or(F.when(base, F.col("resolved") | (F.size(F.array_intersect("f2p", "passed")) > 0))).alias("base_ok"),
    )
    found = F.when(F.col("broken") | (F.col("bases") == 0) | (F.col("goldens") == 0), "ERROR").when(~F.col("golden_ok"), "GOLDEN_FAIL")
    return one.select("inst", found.when(F.col("base_ok"), "BASE_UNEXPECTED_PASS").otherwise("OK").alias("verdict"))


def histogram(verdicts: DataFrame) -> DataFrame:
    """All four verdicts, those that do not occur with 0; others are not counted."""
    every = verdicts.sparkSession.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return F.broadcast(every).join(verdicts.groupBy("verdict").count(), "verdict", "left").select("verdict", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


def coverage(instances: DataFrame, results: DataFrame) -> DataFrame:
    """One row: instances in all, those with a result of any verdict, and the time span of non-blank stamps."""
    total = instances.agg(F.countDistinct("inst").alias("total"))
    stamp = lambda c: F.when(F.col(c) != "", F.col(c))
    done = results.agg(F.countDistinct("inst").alias("verified"), F.min(stamp("started_at")).alias("first"), F.max(stamp("finished_at")).alias("last"))
    return total.join(F.broadcast(done))  # one row each


def not_ok(results: DataFrame) -> DataFrame:
    return results.where("verdict <> 'OK'").orderBy("verdict", "inst")
