"""Rules and grading as functions of the session, for those who write SQL.

Each is a SQL function that Spark puts in place of its call: no Python, no join, no shuffle of its own. A function of a block that
finds several things gives an array, called in a subquery and laid out beside it; what belongs to a group is built from built-in
aggregates, which combine before the shuffle, and named by a last function:

    SELECT run, pos, f.rule, f.finding FROM (SELECT run, pos, runlens_trace_findings(type, text, command, file_path, workdir) AS found FROM blocks) LATERAL VIEW inline(found) f AS rule, finding
    SELECT inst, runlens_instance_verdict(bool_or(...), count_if(...), ...) FROM graded GROUP BY inst

Results are those of `integrity.trace_findings`, `grading.grade` and `grading.classify`; null arguments give what they give there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from runlens.functions.text import STRIP_ENDS
from runlens.operators import integrity as rules

_FOUND = "ARRAY<STRUCT<rule: STRING, finding: STRING>>"
_VERDICT = "STRUCT<output_state: STRING, passed: ARRAY<STRING>, missing: ARRAY<STRING>, score: DOUBLE, resolved: BOOLEAN, n_required: INT, n_passed: INT, n_missing: INT>"


def _text(value: str) -> str:
    """A literal in which nothing is escaped."""
    if "'" in value:
        raise ValueError(f"a raw literal holds no quote: {value}")
    return f"r'{value}'"


def _lies_in(path: str, folder: str) -> str:
    return f"({path} = {folder} OR startswith({path}, concat({folder}, '/')))"


def _normal(path: str) -> str:
    return f"""concat(CASE WHEN {path} RLIKE '^//(?!/)' THEN '//' ELSE '/' END, array_join(aggregate(filter(split({path}, '/', -1), p -> p NOT IN ('', '.')), CAST(array() AS ARRAY<STRING>),
        (kept, p) -> CASE WHEN p = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0)) ELSE concat(kept, array(p)) END), '/'))"""


def _unusual_git(command: str) -> str:
    return f"""({command} RLIKE {_text(rules.GIT_ANY)} AND NOT {command} RLIKE {_text(rules.GIT_ORDINARY)}
        AND NOT ({command} RLIKE {_text(rules.GIT_LOG)} AND NOT {command} RLIKE {_text(rules.GIT_LOG_BROAD)}))"""


_PASSED = """coalesce(array_sort(array_distinct(array_compact(transform(try_variant_get(v, '$.tests', 'array<struct<name:variant,status:variant>>'),
        t -> CASE WHEN try_variant_get(t.status, '$', 'string') = 'PASSED' THEN try_variant_get(t.name, '$', 'string') END)))), CAST(array() AS ARRAY<STRING>))"""

#: Name and parameters, result, expression; a function stands after those that it calls. Calls cannot stand inside a lambda, so what
#: lambdas share is text that is put in place above.
FUNCTIONS = (
    ("runlens_outside_workdir(path STRING, workdir STRING)", "STRING", f"""CASE WHEN path <> '' AND workdir <> '' AND workdir <> '/' THEN
        try_element_at(filter(array({_normal("CASE WHEN startswith(path, '/') THEN path ELSE concat_ws('/', workdir, path) END")}), x -> NOT {_lies_in("x", _normal("workdir"))} AND NOT {_lies_in("x", "'/tmp'")}), 1) END"""),
    ("runlens_trace_findings(type STRING, text STRING, command STRING, file_path STRING, workdir STRING)", _FOUND, f"""concat(
        transform(filter(transform(split(coalesce(command, ''), {_text(rules.COMMAND_SPLIT)}, -1), x -> regexp_replace(x, {_text(STRIP_ENDS)}, '')), x -> type = 'tool_use' AND {_unusual_git("x")}), x -> struct('suspicious_git' AS rule, left(x, 200) AS finding)),
        filter(array(struct('egress_attempts' AS rule, left(command, 200) AS finding)), x -> type = 'tool_use' AND command RLIKE {_text(rules.EGRESS)}),
        transform(filter(regexp_extract_all(coalesce(text, ''), {_text(rules.RETRIEVAL)}, 0), x -> type IN ('text', 'reasoning')), x -> struct('retrieval_language' AS rule, left(x, 120) AS finding)),
        filter(array(struct('reads_outside_workdir' AS rule, left(runlens_outside_workdir(file_path, workdir), 200) AS finding)), x -> type = 'tool_use' AND x.finding IS NOT NULL))"""),
    ("runlens_verdict(f2p ARRAY<STRING>, p2p ARRAY<STRING>, output STRING)", _VERDICT, f"""element_at(transform(transform(transform(array(try_parse_json(output)),
          v -> struct(CASE WHEN output IS NULL THEN 'absent' WHEN startswith(schema_of_variant(v), 'OBJECT') THEN 'ok' ELSE 'unparseable' END AS state, {_PASSED} AS named)),
        r -> struct(r.state AS state, CASE WHEN r.state = 'ok' THEN r.named ELSE CAST(array() AS ARRAY<STRING>) END AS passed, array_union(f2p, p2p) AS required)),
        r -> struct(r.state AS output_state, r.passed AS passed, array_sort(array_except(r.required, r.passed)) AS missing,
          CASE WHEN r.state = 'ok' AND size(array_except(r.required, r.passed)) = 0 THEN 1.0D ELSE 0.0D END AS score, r.state = 'ok' AND size(array_except(r.required, r.passed)) = 0 AS resolved,
          size(r.required) AS n_required, size(r.passed) AS n_passed, size(array_except(r.required, r.passed)) AS n_missing)), 1)"""),
    ("runlens_instance_verdict(broken BOOLEAN, bases BIGINT, goldens BIGINT, golden_ok BOOLEAN, base_ok BOOLEAN)", "STRING",
     "CASE WHEN broken OR bases = 0 OR goldens = 0 THEN 'ERROR' WHEN NOT golden_ok THEN 'GOLDEN_FAIL' WHEN base_ok THEN 'BASE_UNEXPECTED_PASS' ELSE 'OK' END"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to this session, in place of older ones of the same names; returns the names."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    return [signature.split("(")[0] for signature, _, _ in FUNCTIONS]
