"""Raw task rows to typed instances, and the names, keys and templates derived from them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.text import lines, strip
from runlens.operators import ordered

FIX_SHA = r"-([0-9a-f]{40})(?:-|$)"
#: The columns of a raw row, those that hold lists, those whose texts may be wrapped, and a prompt's headers.
COLUMNS = (
    "repo", "instance_id", "base_commit", "patch", "test_patch", "problem_statement", "requirements", "interface", "repo_language", "fail_to_pass", "pass_to_pass",
    "issue_specificity", "issue_categories", "before_repo_set_cmd", "selected_test_files_to_run", "dockerhub_tag",
)
LIST_COLUMNS = ("fail_to_pass", "pass_to_pass", "issue_specificity", "issue_categories", "selected_test_files_to_run")
TEXT_COLUMNS = ("problem_statement", "requirements", "interface")
PROMPT_HEADERS = ("\n\nRequirements:\n", "\n\nNew interfaces introduced:\n")
TASK_NAME, ENV_NAME = r"^[a-z][a-z0-9_-]*$", r"^[A-Za-z_][A-Za-z0-9_]*$"


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_list(raw: pd.Series) -> pd.Series:
    """A list as Python writes it; no JSON, and no built-in reads its escapes. Null where there is none."""

    def one(x: str | None) -> list[str] | None:
        try:
            v = ast.literal_eval(x)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        return [str(i) for i in v] if isinstance(v, list) else None

    return raw.map(one)


def unwrap(raw: Column) -> Column:
    """A text that is a JSON string is that string; any other text stays as it is."""
    v = F.try_parse_json(F.when(raw.rlike(r'^"(?:[^"\\\x00-\x1f]|\\.)*"\s*$'), raw))
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(raw)


def normalise(raw: DataFrame, lists: list[str], texts: list[str]) -> DataFrame:
    """List columns parsed, wrapped texts unwrapped; a column that is missing is an error."""
    if lost := [c for c in (*lists, *texts) if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return raw.withColumns({c: parse_list(c) for c in lists} | {c: unwrap(F.col(c)) for c in texts})


def instances(raw: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Raw task rows (all columns texts) as typed instances: exactly COLUMNS, lists parsed, wrapped texts unwrapped, names of
    `fail_to_pass` corrected (corrections: inst, name, better). Missing columns are an error, and so is a list column that holds no list, when it is read."""
    if lost := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    rows = raw.select(*COLUMNS)
    held = lambda c: F.coalesce(parse_list(c), F.raise_error(F.concat_ws(" ", F.lit("no list in"), F.lit(c), "instance_id")).cast("array<string>"))
    out = rows.withColumns({c: held(c) for c in LIST_COLUMNS} | {c: unwrap(F.col(c)) for c in TEXT_COLUMNS})
    if corrections is not None:
        out = corrected(out.withColumnRenamed("instance_id", "inst"), corrections, "fail_to_pass").withColumnRenamed("inst", "instance_id")
    return out.select(*COLUMNS)


def fix_sha(inst: Column) -> Column:
    """The first 40 hex digits between hyphens of an id; null if there are none."""
    return F.nullif(F.regexp_extract(inst, FIX_SHA, 1), F.lit(""))


def fix_sha_objection(inst: Column, base_commit: Column) -> Column:
    """Why an id's solution commit cannot be used, null if it can."""
    return F.when(fix_sha(inst).isNull(), "no fix commit in the id").when(fix_sha(inst) == base_commit, "the fix commit is the base commit")


def last_line(script: Column) -> Column:
    """The last line of a script without white space around it, empty if there is none."""
    return F.coalesce(F.try_element_at(lines(strip(script)), F.lit(-1)), F.lit(""))


def prompt(statement: Column, requirements: Column, interface: Column) -> Column:
    """The task's three texts under fixed headers, whether or not they say anything."""
    return F.concat(statement, F.lit(PROMPT_HEADERS[0]), requirements, F.lit(PROMPT_HEADERS[1]), interface)


def image_ref(repository: str, tag: Column) -> Column:
    return F.concat(F.lit(f"{repository}:"), tag)


def raw_url(base: str, repo: str, commit: str, inst: Column, file: Column) -> Column:
    """Where one of an instance's files is kept at a pinned commit."""
    return F.concat(F.lit(f"{base}/{repo}/{commit}/run_scripts/"), inst, F.lit("/"), file)


def repo_slug(repo: Column) -> Column:
    """owner/name as one part of a path."""
    return F.replace(repo, F.lit("/"), F.lit("__"))


def corrected(rows: DataFrame, corrections: DataFrame, column: str = "f2p") -> DataFrame:
    """corrections (inst, name, better): exact names of an instance are replaced, order kept."""
    fix = corrections.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("name", "better"))).alias("_fix"))
    out = rows.join(fix, "inst", "left")
    return out.withColumn(column, F.transform(column, lambda x: F.coalesce(F.try_element_at("_fix", x), x))).drop("_fix")


def provenance(rows: DataFrame, fixes: DataFrame, flaky: DataFrame) -> DataFrame:
    """Adds env_fix and known_flaky where the dimensions (inst, …) have them."""
    return rows.join(fixes.select("inst", "env_fix"), "inst", "left").join(flaky.select("inst", "known_flaky"), "inst", "left")


def unique_longer(names: DataFrame, passed: DataFrame) -> DataFrame:
    """names (inst, name), passed (inst, test): for a name cut short, `n`, the longer passed tests it begins, and the one it begins (null if none or several).

    In the order of their bytes the tests that a name begins stand together: after the name itself and before the name
    with a byte that no text holds. One sorted stream of tests and of both ends of each name tells how many stand between,
    and which is the last; a name is never held against the tests one by one, and one instance may hold most of the rows.
    """
    order = ["inst", "at", "kind"]
    row = lambda at, kind, text: (F.col("inst"), at.alias("at"), F.lit(kind).alias("kind"), text.alias("text"))
    bytes_ = lambda c: F.encode(c, "UTF-8")
    own = names.where("inst is not null and name is not null").select("inst", "name").distinct()
    test = passed.where("test is not null").select("inst", "test").distinct().select(*row(bytes_(F.col("test")), 0, F.col("test")))
    begin = own.select(*row(bytes_(F.col("name")), 1, F.col("name")))
    end = own.select(*row(F.concat(bytes_(F.col("name")), F.lit(b"\xff")), 2, F.col("name")))
    seen = ordered.running(test.unionByName(begin).unionByName(end), order, F.col("kind") == 0, F.col("text"))
    ends = seen.where("kind > 0").groupBy("inst", F.col("text").alias("name")).agg(
        F.sum(F.when(F.col("kind") == 2, F.col("n_so_far")).otherwise(-F.col("n_so_far"))).alias("n"), F.max(F.when(F.col("kind") == 2, F.col("latest"))).alias("test")
    )
    return names.join(ends, ["inst", "name"], "left").select("inst", "name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("test")).alias("test"))


def artifact_name_ok(name: Column) -> Column:
    return ~name.isin("", ".", "..") & ~name.rlike(r"[/\\]")


def qualified(namespace: Column, name: Column) -> Column:
    return F.concat_ws(".", namespace, name)


def render(template: Column, values: dict[str, Column]) -> Column:
    """@NAME@ replaced for each value; null if a name has no place in the template."""
    ok, out = F.lit(True), template
    for name, value in values.items():
        ok, out = ok & template.contains(f"@{name}@"), F.replace(out, F.lit(f"@{name}@"), value)
    return F.when(ok, out)


def counter(text: Column, name: str, flag: Column) -> Column:
    """The number on the counter's line, 1 at least where the flag is set; null if there is none."""
    n = F.nullif(F.regexp_extract(text, rf"(?m)^{name} (\d+)$", 1), F.lit("")).cast("double")
    return F.when(flag, F.greatest(F.coalesce(n, F.lit(1.0)), F.lit(1.0))).otherwise(n)


def excerpt(rows: DataFrame, keys: list[str], words: list[str], limit: int = 400) -> DataFrame:
    """(keys, pos, line): the first lines that hold one of the words."""
    flat = rows.select(*keys, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.greatest(*(F.col("line").contains(w) for w in words), F.lit(False)))
    from pyspark.sql import Window

    return flat.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("_r") <= limit).drop("_r")
