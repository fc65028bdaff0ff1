"""Workflows as tables: what their declarations get wrong, what their entries are given, and the record of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.normalize import ENV_NAME, TASK_NAME

#: Fixed value: the key that stands for a workflow's own inputs.
INPUTS = "inputs"
NO_ENTRIES = "a workflow needs at least one entry"


def contract_problems(declared: Column, required: Column, generated: Column, staged: Column) -> dict[str, Column]:
    """Of arrays of names: inputs made but not declared, made although staged, and required but neither made nor staged."""
    return {
        "undeclared": F.array_sort(F.array_except(generated, declared)), "colliding": F.array_sort(F.array_intersect(generated, staged)),
        "missing": F.array_except(required, F.array_union(generated, staged)),
    }


def bad_env_names(env: Column) -> Column:
    """Names of a map that are no identifiers, sorted."""
    return F.array_sort(F.filter(F.map_keys(env), lambda k: ~k.rlike(ENV_NAME.replace("$", r"\z"))))


def declaration_problems(entries: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """entries (wf, pos, key, inputs, bindings, timeout, retries): (wf, key, problem); with workflows (wf) also those without entries, of null key.

    A binding is `<producer>/<name>`, cut at the first slash; a null one is malformed.
    """
    e = entries.withColumn("same", F.count("*").over(Window.partitionBy("wf", "key")))
    cut = F.transform(F.transform("bindings", lambda b: F.coalesce(b, F.lit(""))), lambda b: F.struct(b.alias("b"), F.substring_index(b, "/", 1).alias("producer"), F.when(b.contains("/"), F.substr(b, F.instr(b, "/") + 1)).otherwise("").alias("name")))
    good = F.filter(cut, lambda x: (x["producer"] != "") & (x["name"] != ""))
    names = F.transform(good, lambda x: x["name"])
    twice = F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1))
    found = F.array(
        F.when(F.col("same") > 1, "duplicate key"), F.when(F.col("key") == INPUTS, "reserved key"), F.when(~F.col("key").rlike(TASK_NAME.replace("$", r"\z")), "malformed key"),
        F.when(~(F.col("timeout") > 0) | (F.col("timeout") == float("inf")) | F.isnan("timeout"), "timeout is not finite and positive"), F.when(F.col("retries") < 0, "negative retries"),
    )
    found = F.concat(
        F.array_compact(found), F.transform(F.filter(cut, lambda x: (x["producer"] == "") | (x["name"] == "")), lambda x: F.concat(F.lit("malformed binding "), x["b"])),
        F.transform(F.array_distinct(F.array_except(names, F.col("inputs"))), lambda n: F.concat(F.lit("binds undeclared "), n)), F.transform(twice, lambda n: F.concat(F.lit("binds twice "), n)),
    )
    out = e.select("wf", "key", F.explode(found).alias("problem")).distinct()
    if workflows is None:
        return out
    bare = workflows.select("wf").distinct().join(entries.select("wf"), "wf", "left_anti")
    return out.unionByName(bare.select("wf", F.lit(None).cast("string").alias("key"), F.lit(NO_ENTRIES).alias("problem")))


def resolved_inputs(inputs: DataFrame, records: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """inputs (keys, producer, name), records (keys, producer, artifact_keys), payloads (key, content): adds key and state.

    usable; unrecorded (the producer's record names no such artifact), absent, or empty: none of these three can be mounted.
    """
    recorded = records.select(*keys, "producer", F.explode("artifact_keys").alias("name", "key"))
    bytes_ = payloads.select("key", F.octet_length("content").alias("_n"), F.lit(True).alias("_there"))
    out = inputs.join(recorded, [*keys, "producer", "name"], "left").join(bytes_, "key", "left")
    state = F.when(F.col("key").isNull(), "unrecorded").when(F.col("_there").isNull(), "absent").when(F.coalesce("_n", F.lit(0)) == 0, "empty").otherwise("usable")
    return out.select(*keys, "producer", "name", "key", state.alias("state"))


def checksum_state(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (version, platform, sha256; null: not there), manifests (version, manifest): adds `expected` and `state`: no checksum, absent, mismatch or ok."""
    j = files.join(manifests, "version", "left")
    entry = F.try_variant_get(F.try_variant_get(F.try_parse_json("manifest"), "$.platforms", "map<string,variant>")[F.col("platform")], "$.checksum", "variant")
    expected = F.nullif(F.when(F.schema_of_variant(entry) == "STRING", F.try_variant_get(entry, "$", "string")), F.lit(""))
    state = F.when(F.col("expected").isNull(), "no checksum").when(F.col("sha256").isNull(), "absent").when(F.col("sha256") != F.col("expected"), "mismatch").otherwise("ok")
    return j.withColumn("expected", expected).withColumn("state", state).select(*files.columns, "expected", "state")


def workflow_records(entries: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """entries (keys, pos, key, status, missing_inputs), runs (keys, key, attempts, resumed, artifact_keys, metrics): (keys, succeeded, record).

    The record is JSON text with all entries in order; one that never ran has zeroed counters and names what it lacked.
    """
    j = entries.join(runs, [*keys, "key"], "left")
    map_ = lambda c, kind: F.coalesce(F.col(c), F.create_map().cast(kind))
    one = F.struct(
        "pos", "key", "status", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("resumed", F.lit(False)).alias("resumed"),
        map_("artifact_keys", "map<string,string>").alias("artifact_keys"), map_("metrics", "map<string,double>").alias("metrics"), F.when(F.size("missing_inputs") > 0, F.col("missing_inputs")).alias("missing_inputs"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(one.dropFields("pos")).alias("e")))), lambda x: x["e"])
    got = j.groupBy(*keys).agg(F.bool_and(F.col("status") == "succeeded").alias("succeeded"), listed.alias("e"))
    ids = F.to_json(F.struct(*keys))
    record = F.concat(F.regexp_replace(ids, r"\}$", ""), F.lit(',"succeeded":'), F.col("succeeded").cast("string"), F.lit(',"entries":['), F.array_join("e", ","), F.lit("]}"))
    return got.select(*keys, "succeeded", record.alias("record"))


def summaries(records: DataFrame, provenance: DataFrame, keys: list[str]) -> DataFrame:
    """Workflow records with what is known of their instance (provenance: inst and any columns) merged in: (keys, summary)."""
    known = [c for c in provenance.columns if c != "inst"]
    j = records.join(provenance, "inst", "left")
    more = F.regexp_replace(F.to_json(F.struct(*known)), r"^\{", ",")
    return j.select(*keys, F.regexp_replace(F.concat(F.regexp_replace("record", r"\}$", ""), more), r",\}$", "}").alias("summary"))


def corrected_export(rows: DataFrame, corrections: DataFrame, columns: list[str]) -> DataFrame:
    """rows (inst, array columns), corrections (inst, name, better): the rows with exact names replaced, and `changes`: (column, name, better) of each in order."""
    fix = corrections.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("name", "better"))).alias("_fix"))
    j = rows.join(fix, "inst", "left")
    hit = lambda c: F.transform(F.filter(c, lambda x: F.try_element_at("_fix", x).isNotNull()), lambda x: F.struct(F.lit(c).alias("column"), x.alias("name"), F.try_element_at("_fix", x).alias("better")))
    out = j.withColumn("changes", F.flatten(F.array(*(F.coalesce(hit(c), F.array().cast("array<struct<column:string,name:string,better:string>>")) for c in columns))))
    return out.withColumns({c: F.transform(c, lambda x: F.coalesce(F.try_element_at("_fix", x), x)) for c in columns}).drop("_fix")


def union_maps(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The union of maps; a key that two of them hold is an error."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries(column)))).alias(column))


def repeated_map_keys(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, name, n): keys of maps that several rows hold, which `union_maps` would refuse."""
    return rows.select(*keys, F.explode(F.map_keys(column)).alias("name")).groupBy(*keys, "name").agg(F.count("*").alias("n")).where("n > 1")


def renumbered(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows that are left, numbered anew from 1 in the order of their position."""
    return rows.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(position)).cast("bigint"))


def by_depth(rows: DataFrame, path: str) -> DataFrame:
    """Shortest dotted paths first; paths of one depth in their order by row_index."""
    return rows.orderBy(F.size(F.split(path, r"\.")), "row_index")


def port(base: int, index: Column, samples: int = 0) -> Column:
    """The first port of an instance's block: one for each sample and one more."""
    return F.lit(base) + index * (samples + 1)


def new_records(rows: DataFrame) -> DataFrame:
    """Attempts with the defaults of a new record where they lack a column: rollout 0, attempt 0, tier formal, a fresh stamp."""
    defaults = {"rollout": F.lit(0), "attempt": F.lit(0), "tier": F.lit("formal"), "run_ts": F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")}
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def run_metadata(result: Column, requested: Column, kind: Column, n_snippets: Column, n_invalid: Column, complete: Column) -> Column:
    """What is noted of a run, from its result event (JSON text): models used joined by comma, else the one asked for; counts and cost."""
    v = F.try_parse_json(result)
    used = F.array_join(F.map_keys(F.try_variant_get(v, "$.modelUsage", "map<string,variant>")), ", ")
    return F.struct(
        kind.alias("kind"), F.when(F.coalesce(used, F.lit("")) != "", used).otherwise(requested).alias("model"), requested.alias("model_requested"), F.try_variant_get(v, "$.session_id", "string").alias("run_id"),
        F.try_variant_get(v, "$.num_turns", "bigint").alias("num_turns"), F.try_variant_get(v, "$.total_cost_usd", "double").alias("cost_usd"), complete.alias("complete"),
        n_snippets.alias("snippet_count"), n_invalid.alias("invalid_snippet_count"),
    )


def report_line(text: Column) -> Column:
    """The last line of an output that begins an object; null if there is none."""
    from runlens.functions.text import lines, strip

    return F.try_element_at(F.filter(lines(strip(text)), lambda x: x.startswith("{")), F.lit(-1))


def report_keys(line: Column, expected: list[str]) -> dict[str, Column]:
    """Keys that a report lacks, and keys that nobody declared: either makes it unreadable."""
    have = F.json_object_keys(line)
    want = F.array(*map(F.lit, expected))
    return {"lacking": F.array_sort(F.array_except(want, have)), "unknown": F.array_sort(F.array_except(have, want))}
