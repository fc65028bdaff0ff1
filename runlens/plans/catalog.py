"""Registered queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import annotations, consensus, grading, integrity, ledger, normalize, ordered, overrides, patches, reconcile, sql_functions, traces, workflow
from runlens.plans import adapters as A
from runlens.session import importable, table

TABLES = ("lineitem", "orders", "events", "customer", "part", "documents", "labels", "conversations", "benchmark", "supplier", "nation", "region")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """The driver's tables as views, and adapters over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        importable(spark)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **own: DataFrame) -> DataFrame:
        """Tables and `own` stand in the text as parameters, so that the session's views are left alone."""
        frames = {name: self.table(name) for name in TABLES if re.search(rf"\b{name}\b", text)} | own
        if not frames:
            return self.spark.sql(text)
        found = re.compile(r"(\b(?:FROM|JOIN)\s+)(" + "|".join(frames) + r")\b")
        return self.spark.sql(found.sub(r"\1{\2}", text.replace("{", "{{").replace("}", "}}")), **frames)


def query(oracle: str | None = None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_VOTES = f"""WITH c AS ({A.CANDIDATES}), l AS (SELECT DISTINCT inst, run, file, unnest(generate_series(s, e)) AS line FROM c WHERE e >= s)"""


@query(f"""{_VOTES}, f AS (SELECT inst, file, count(DISTINCT run) AS runs FROM c GROUP BY ALL HAVING count(DISTINCT run) >= 2),
  k AS (SELECT inst, file, line, line - row_number() OVER (PARTITION BY inst, file ORDER BY line) AS g FROM l GROUP BY inst, file, line HAVING count(*) >= 2),
  r AS (SELECT inst, file, min(line) AS s, max(line) AS e FROM k GROUP BY inst, file, g)
  SELECT f.inst, f.file, f.runs, r.s, r.e FROM f LEFT JOIN r ON f.inst = r.inst AND f.file = r.file""")
def line_vote_ranges(v: Views) -> DataFrame:
    return consensus.voted_ranges(v.sql(A.CANDIDATES))


@query(f"""WITH c AS ({A.CANDIDATES}), r AS ({A.RUNS}), n AS (SELECT inst, count(DISTINCT run) AS n_runs FROM r GROUP BY inst), f AS (SELECT inst, file, count(DISTINCT run) AS k FROM c GROUP BY ALL)
  SELECT inst, n_runs, count(*) FILTER (k = n_runs) AS shared, count(k) AS total, CASE WHEN count(k) > 0 THEN CAST(100 * count(*) FILTER (k = n_runs) // count(k) AS BIGINT) END AS percent FROM n LEFT JOIN f USING (inst) GROUP BY ALL""")
def file_agreement(v: Views) -> DataFrame:
    return consensus.file_agreement(v.sql(A.RUNS), v.sql(A.CANDIDATES))


@query(f"""WITH c AS ({A.CANDIDATES}), r AS ({A.RUNS}), n AS (SELECT inst, count(DISTINCT run) AS n FROM r GROUP BY inst)
  SELECT c.inst, file, count(DISTINCT run) AS named FROM c JOIN n USING (inst) GROUP BY c.inst, file, n HAVING count(DISTINCT run) < n""")
def split_files(v: Views) -> DataFrame:
    return consensus.split_files(v.sql(A.RUNS), v.sql(A.CANDIDATES))


@query(f"""{_VOTES}, r AS ({A.RUNS}), n AS (SELECT inst, count(DISTINCT run) AS n FROM r GROUP BY inst),
  f AS (SELECT c.inst, file, n FROM c JOIN n USING (inst) GROUP BY c.inst, file, n HAVING count(DISTINCT run) = n), k AS (SELECT inst, file, line, count(*) AS k FROM l GROUP BY ALL)
  SELECT f.inst, f.file, count(*) FILTER (k = n) AS both, count(line) AS total, CASE WHEN count(line) > 0 THEN count(*) FILTER (k = n) / count(line) ELSE 0.0 END AS iou
  FROM f LEFT JOIN k ON f.inst = k.inst AND f.file = k.file GROUP BY f.inst, f.file""")
def line_iou(v: Views) -> DataFrame:
    return consensus.line_iou(v.sql(A.RUNS), v.sql(A.CANDIDATES))


# Grading

_GRADED = f"""WITH o AS ({A.OUTPUTS}), j AS (SELECT *, CASE WHEN output IS NULL THEN 'absent' WHEN json_valid(output) AND output[1] = '{{' THEN 'ok' ELSE 'unparseable' END AS state FROM o),
  p AS (SELECT *, CASE WHEN state = 'ok' THEN list_sort(list_distinct(list_transform(list_filter(from_json(output -> '$.tests', '[{{"name":"VARCHAR","status":"VARCHAR"}}]'), lambda t: t.status = 'PASSED'), lambda t: t.name))) ELSE [] END AS passed,
    list_sort(list_distinct([f2p1, p2p1, p2p2])) AS required FROM j),
  g AS (SELECT *, list_sort(list_filter(required, lambda x: NOT list_contains(passed, x))) AS missing FROM p), r AS (SELECT *, state = 'ok' AND len(missing) = 0 AS resolved FROM g)"""


def _graded(v: Views) -> DataFrame:
    o = v.sql(A.OUTPUTS)
    return grading.grade(o.withColumns({"f2p": F.array("f2p1"), "p2p": F.array("p2p1", "p2p2")}))


@query(f"""{_GRADED} SELECT inst, phase, state AS output_state, CASE WHEN resolved THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, resolved, array_to_string(missing, ',') AS missing, missing[1] AS first_missing,
  CAST(len(required) AS DOUBLE) AS n_required, CAST(len(passed) AS DOUBLE) AS n_passed, CAST(len(missing) AS DOUBLE) AS n_missing,
  CASE WHEN list_contains(passed, f2p1) THEN f2p1 ELSE '' END AS early, array_to_string(list_filter(list_sort([p2p2, p2p1]), lambda x: NOT list_contains(passed, x)), ',') AS p2p_missing FROM r""")
def verdicts(v: Views) -> DataFrame:
    g = grading.detail(_graded(v)).withColumns({"early": F.array_join("fail_to_pass_passed", ","), "p2p_missing": F.array_join("pass_to_pass_missing", ",")})
    return g.withColumn("missing", F.array_join("missing", ",")).select("inst", "phase", "output_state", "score", "resolved", "missing", "first_missing", "n_required", "n_passed", "n_missing", "early", "p2p_missing")


_CLASSES = f"""{_GRADED}, b AS (SELECT inst, bool_or(status <> 'success' OR state <> 'ok') AS broken, count(*) FILTER (phase = 'base') AS nb, count(*) FILTER (phase = 'golden') AS ng,
  bool_or(resolved) FILTER (phase = 'golden') AS golden, bool_or(resolved OR list_contains(passed, f2p1)) FILTER (phase = 'base') AS base FROM r GROUP BY inst),
  k AS (SELECT inst, CASE WHEN broken OR nb = 0 OR ng = 0 THEN 'ERROR' WHEN NOT golden THEN 'GOLDEN_FAIL' WHEN base THEN 'BASE_UNEXPECTED_PASS' ELSE 'OK' END AS verdict FROM b)"""


@query(f"{_CLASSES} SELECT * FROM k")
def base_golden_classes(v: Views) -> DataFrame:
    return grading.classify(_graded(v))


@query(f"""{_CLASSES} SELECT k.inst, k.verdict, CAST(sum(len(passed)) AS BIGINT) AS n_passed, CAST(sum(len(missing)) AS BIGINT) AS n_missing, min(missing[1]) AS first_missing, max(CASE WHEN resolved THEN 1.0 ELSE 0.0 END)::DOUBLE AS best
  FROM k JOIN r USING (inst) GROUP BY k.inst, k.verdict""")
def verdicts_in_sql(v: Views) -> DataFrame:
    """Grading and classification as SQL: what aggregates combine before the shuffle, no run is gathered whole."""
    sql_functions.register(v.spark)
    return v.sql("""WITH g AS (SELECT inst, phase, status, array(f2p1) AS f2p, runlens_verdict(array(f2p1), array(p2p1, p2p2), output) AS x FROM graded_outputs),
      a AS (SELECT inst, bool_or(status <> 'success' OR x.output_state <> 'ok') AS broken, count_if(phase = 'base') AS bases, count_if(phase = 'golden') AS goldens, bool_or(x.resolved) FILTER (WHERE phase = 'golden') AS golden_ok,
        bool_or(x.resolved OR size(array_intersect(f2p, x.passed)) > 0) FILTER (WHERE phase = 'base') AS base_ok, sum(size(x.passed)) AS n_passed, sum(x.n_missing) AS n_missing, min(array_min(x.missing)) AS first_missing, max(x.score) AS best FROM g GROUP BY inst)
      SELECT inst, runlens_instance_verdict(broken, bases, goldens, golden_ok, base_ok) AS verdict, n_passed, n_missing, first_missing, best FROM a""", graded_outputs=v.sql(A.OUTPUTS))


@query(f"{_CLASSES}, e AS (SELECT unnest(['OK', 'GOLDEN_FAIL', 'BASE_UNEXPECTED_PASS', 'ERROR']) AS verdict) SELECT e.verdict, count(k.inst) AS n FROM e LEFT JOIN k USING (verdict) GROUP BY e.verdict")
def verdict_histogram(v: Views) -> DataFrame:
    return grading.histogram(grading.classify(_graded(v)))


@query(f"WITH o AS ({A.OUTPUTS}) SELECT (SELECT count(DISTINCT inst) FROM o) AS total, count(DISTINCT inst) AS verified, min(nullif(stamp, '')) AS first, max(nullif(stamp, '')) AS last FROM o WHERE status = 'success'")
def verification_span(v: Views) -> DataFrame:
    o = v.sql(A.OUTPUTS)
    return grading.coverage(o, o.where("status = 'success'").withColumns({"started_at": F.col("stamp"), "finished_at": F.col("stamp")}))


@query(f"{_CLASSES} SELECT * FROM k WHERE verdict <> 'OK'")
def not_ok_instances(v: Views) -> DataFrame:
    return grading.not_ok(grading.classify(_graded(v)))


# Ledger

_LEDGER = f"WITH attempts AS ({A.ATTEMPTS})"


@query(f"{_LEDGER} SELECT concat_ws('/', sweep, inst, concat('r', rollout), task, concat('a', attempt)) AS key, inst, rollout, task, attempt, row_number() OVER (PARTITION BY inst ORDER BY rollout, task, attempt) AS place FROM attempts")
def attempts_in_order(v: Views) -> DataFrame:
    from pyspark.sql import Window

    a = ledger.in_order(v.sql(A.ATTEMPTS))
    place = F.row_number().over(Window.partitionBy("inst").orderBy("rollout", "task", "attempt")).cast("bigint")
    return a.select(ledger.store_key().alias("key"), "inst", "rollout", "task", "attempt", place.alias("place"))


@query(f"{_LEDGER} SELECT inst, rollout, task, attempt, status FROM attempts WHERE sweep = 's1' AND inst = 7 AND rollout = 3 AND task = 'click'")
def attempts_of_rollout(v: Views) -> DataFrame:
    return ledger.of_rollout(v.sql(A.ATTEMPTS), "s1", 7, 3, "click").select("inst", "rollout", "task", "attempt", "status")


@query(f"{_LEDGER}, i AS (SELECT c_custkey AS inst, c_custkey - 1 AS row_index FROM customer) SELECT inst, row_index FROM i WHERE row_index % 2 = 1 AND inst NOT IN (SELECT inst FROM attempts WHERE rollout = 5) ORDER BY row_index LIMIT 500")
def resume_list(v: Views) -> DataFrame:
    i = v.table("customer").select(F.col("c_custkey").alias("inst"), (F.col("c_custkey") - 1).alias("row_index"))
    return ledger.to_do(i, v.sql(A.ATTEMPTS), 5, 1, 2, 500)


@query(f"{_LEDGER}, i AS (SELECT c_custkey AS inst, c_custkey - 1 AS row_index FROM customer) SELECT inst, row_index, (row_index % 2 + 2) % 2 AS shard FROM i WHERE NOT EXISTS (FROM attempts a WHERE a.rollout = 5 AND a.inst = i.inst)")
def pending_instances(v: Views) -> DataFrame:
    """The whole resume list, each row with its shard of two; `resume_list` is the start of one shard."""
    i = v.table("customer").select(F.col("c_custkey").alias("inst"), (F.col("c_custkey") - 1).alias("row_index"))
    return ledger.to_do(i, v.sql(A.ATTEMPTS), 5).withColumn("shard", F.pmod("row_index", F.lit(2)))


@query(f"{_LEDGER}, m AS ({A.MARKERS}) SELECT m.*, a.attempt, a.status FROM m LEFT JOIN attempts a ON a.inst = m.inst AND a.rollout = m.rollout AND a.task = m.task AND a.run_ts = m.run_ts AND a.attempt = m.attempts - 1")
def final_shards(v: Views) -> DataFrame:
    a = v.sql(A.ATTEMPTS)
    return ledger.final_shards(a, v.sql(A.MARKERS, attempts=a))


@query(f"{_LEDGER}, m AS ({A.MARKERS}) SELECT m.* FROM m WHERE NOT EXISTS (FROM attempts a WHERE a.inst = m.inst AND a.rollout = m.rollout AND a.task = m.task AND a.run_ts = m.run_ts AND a.attempt = m.attempts - 1)")
def orphan_markers(v: Views) -> DataFrame:
    a = v.sql(A.ATTEMPTS)
    return ledger.orphans(a, v.sql(A.MARKERS, attempts=a))


@query(f"""{_LEDGER} SELECT inst, rollout, task, attempt, CASE WHEN leaked THEN false WHEN status = 'timeout' THEN false WHEN NOT valid THEN true ELSE outcome IN ('no_output', 'truncated', 'finished_with_api_error', 'execution_error') END AS rollout_retry,
  status = 'timeout' OR (NOT leaked AND (NOT valid OR outcome IN ('no_output', 'truncated', 'finished_with_api_error', 'execution_error'))) AS rollout_retry_timed,
  CASE WHEN status = 'timeout' THEN true ELSE NOT valid OR coalesce(NOT resolved, false) END AS grading_retry FROM attempts""")
def retry_audit(v: Views) -> DataFrame:
    c = F.col
    return v.sql(A.ATTEMPTS).select(
        "inst", "rollout", "task", "attempt", ledger.retry_rollout(c("status"), c("valid"), c("leaked"), c("outcome")).alias("rollout_retry"),
        ledger.retry_rollout(c("status"), c("valid"), c("leaked"), c("outcome"), True).alias("rollout_retry_timed"),
        ledger.retry_grading(c("status"), c("valid"), c("resolved"), True).alias("grading_retry"),
    )


@query(f"""{_LEDGER}, w AS (SELECT *, min(CASE WHEN resolved THEN attempt END) OVER p AS f, max(attempt) OVER p AS l FROM attempts WINDOW p AS (PARTITION BY inst, rollout, task))
  SELECT inst, rollout, task, attempt, resolved FROM w WHERE attempt = coalesce(f, l)""")
def stopping_attempts(v: Views) -> DataFrame:
    return ledger.first_success(v.sql(A.ATTEMPTS), ["inst", "rollout", "task"], F.col("resolved")).select("inst", "rollout", "task", "attempt", "resolved")


@query(f"""{_LEDGER}, e AS (SELECT inst, event_id, CASE WHEN status = 'success' THEN 'succeeded' ELSE 'failed' END AS outcome FROM attempts),
  b AS (SELECT *, max(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY inst ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM e)
  SELECT inst, event_id, CASE WHEN f = 1 THEN 'blocked' ELSE outcome END AS outcome FROM b""")
def blocked_entries(v: Views) -> DataFrame:
    e = v.sql(A.ATTEMPTS).select("inst", "event_id", F.when(F.col("status") == "success", "succeeded").otherwise("failed").alias("outcome"))
    return ledger.blocked(e, ["inst"], "event_id")


_NEEDS = "SELECT l_orderkey AS wf, CAST(l_linenumber AS BIGINT) AS pos, concat('x', l_suppkey % 5) AS name FROM lineitem"
_MAKES = "SELECT l_orderkey AS wf, CAST(l_linenumber AS BIGINT) AS pos, concat('x', l_partkey % 5) AS name FROM lineitem"


_ASKED = """SELECT DISTINCT l_orderkey AS wf, CAST(l_linenumber AS BIGINT) AS pos, concat('x', l_suppkey % 5) AS name, CASE l_partkey % 7 WHEN 0 THEN concat('e', l_linenumber - 1) WHEN 1 THEN concat('e', l_linenumber) WHEN 2 THEN 'inputs' END AS via,
  l_suppkey % 3 <> 0 AS required, l_partkey % 5 = 0 AS builder FROM lineitem"""
_MADE = "SELECT l_orderkey AS wf, CAST(l_linenumber AS BIGINT) AS pos, concat('e', l_linenumber) AS key, concat('x', l_partkey % 5) AS name FROM lineitem"
_GIVEN = "SELECT o_orderkey AS wf, concat('x', o_custkey % 5) AS name FROM orders WHERE o_orderkey % 3 = 0"


@query(f"""WITH n AS ({_ASKED}), m AS ({_MADE} UNION ALL SELECT wf, -1, 'inputs', name FROM ({_GIVEN})),
  j AS (SELECT n.*, (SELECT count(*) FROM m WHERE m.wf = n.wf AND m.name = n.name AND m.pos < n.pos AND (n.via IS NULL OR n.via = m.key)) AS n, (SELECT max(m.key) FROM m WHERE m.wf = n.wf AND m.name = n.name AND m.pos < n.pos AND (n.via IS NULL OR n.via = m.key)) AS k FROM n),
  s AS (SELECT *, CASE WHEN via IS NOT NULL THEN CASE WHEN n > 0 THEN 'bound' ELSE 'not earlier' END WHEN n = 1 THEN 'bound' WHEN n > 1 THEN 'ambiguous' WHEN required AND NOT builder THEN 'unbound' ELSE 'left out' END AS state FROM j)
  SELECT wf, pos, name, n, CASE WHEN state = 'bound' THEN k END AS producer, state FROM s""")
def workflow_bindings(v: Views) -> DataFrame:
    """By name, by explicit producer, from the caller's inputs, optional inputs and those that a builder makes."""
    return ledger.bindings(v.sql(_ASKED), v.sql(_MADE), v.sql(_GIVEN))


@query(f"WITH n AS ({_NEEDS}), m AS ({_MAKES}) SELECT m.* FROM m WHERE NOT EXISTS (FROM n WHERE n.wf = m.wf AND n.name = m.name)")
def unused_inputs(v: Views) -> DataFrame:
    return ledger.unused(v.sql(_MAKES), v.sql(_NEEDS))


@query(f"{_LEDGER} SELECT event_id, CASE WHEN status <> 'success' THEN 'failed' WHEN value / 100 < 1 THEN 'unresolved' ELSE 'ok' END AS code FROM attempts")
def exit_codes(v: Views) -> DataFrame:
    a = v.sql(A.ATTEMPTS)
    metrics = ledger.measured(F.create_map(F.lit("grade.resolved"), F.col("value") / 100, F.lit("other"), F.lit(None).cast("double")))
    return a.select("event_id", ledger.exit_code(F.col("status") == "success", metrics).alias("code"))


@query(f"{_LEDGER} SELECT event_id, CASE WHEN leaked THEN 'setup_error' WHEN status = 'timeout' THEN 'timeout' WHEN status = 'run_error' THEN 'run_error' ELSE 'success' END AS state, status = 'success' AND valid AS outputs_valid FROM attempts")
def attempt_status(v: Views) -> DataFrame:
    s = F.col("status")
    made = F.map_filter(F.create_map(F.lit("patch"), F.lit("k"), F.lit("log"), F.lit("k")), lambda k, x: F.col("valid") | (k != "patch"))
    return v.sql(A.ATTEMPTS).select("event_id", ledger.derived_status(s == "timeout", F.col("leaked"), s == "run_error").alias("state"), ledger.outputs_valid(s, F.array(F.lit("patch")), made).alias("outputs_valid"))


# Patches and integrity

_LINES = f"""WITH d AS ({A.DIFFS}), x AS (SELECT run, test, diff, string_split(diff, chr(10)) AS w FROM d), l AS (SELECT run, unnest(w) AS line, unnest(range(len(w))) AS pos FROM x),
  t AS (SELECT *, lag(line) OVER (PARTITION BY run ORDER BY pos) AS prev FROM l),
  p AS (SELECT run, trim(substring(line, 7), concat(' ', chr(9))) AS path, bool_or(line[:6] = '+++ b/' AND coalesce(prev LIKE '--- /dev/null%', false)) AS created FROM t WHERE line[:6] IN ('+++ b/', '--- a/') GROUP BY ALL)"""


@query(f"{_LINES} SELECT * FROM p")
def patch_paths(v: Views) -> DataFrame:
    return patches.paths(v.sql(A.DIFFS), ["run"])


_FOUND = rf"""{_LINES}, h AS (SELECT run, string_agg(path, ',' ORDER BY path) FILTER (created AND (path = 'conftest.py' OR suffix(path, '.pth'))) AS hooks,
    string_agg(path, ',' ORDER BY path) FILTER (regexp_matches(path, '(?i)(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]+$|_test\.[a-z]+$|\.(test|spec)\.[jt]sx?$')) AS tests,
    string_agg(path, ',' ORDER BY path) FILTER (path LIKE '.github/workflows/%') AS ci FROM p GROUP BY run),
  a AS (SELECT run, string_agg(substring(line, 2), chr(10) ORDER BY pos) AS added FROM t WHERE line[1] = '+' AND line[:3] <> '+++' GROUP BY run),
  f AS (SELECT d.run, coalesce(hooks, '') AS hooks, coalesce(tests, '') AS tests, coalesce(ci, '') AS ci,
    CASE WHEN contains(coalesce(added, ''), split_part(split_part(test, '::', 3), '[', 1)) THEN split_part(split_part(test, '::', 3), '[', 1) ELSE '' END AS literals
    FROM d LEFT JOIN h USING (run) LEFT JOIN a USING (run))"""


def _found(v: Views) -> DataFrame:
    d = v.sql(A.DIFFS)
    return integrity.patch_findings(d.select("run", "diff"), ["run"], d.select("run", "test"))


@query(f"{_FOUND} SELECT * FROM f")
def patch_findings(v: Views) -> DataFrame:
    names = dict(zip(("hooks", "tests", "ci", "literals"), integrity.PATCH_RULES, strict=True))
    return _found(v).select("run", *(F.array_join(r, ",").alias(n) for n, r in names.items()))


@query(f"""{_FOUND} SELECT unnest(['planted_auto_load_hook', 'test_files_touched', 'ci_files_touched', 'required_test_literal']) AS rule,
  unnest([count(*) FILTER (hooks <> ''), count(*) FILTER (tests <> ''), count(*) FILTER (ci <> ''), count(*) FILTER (literals <> '')]) AS n, count(*) AS runs FROM f""")
def rule_counts(v: Views) -> DataFrame:
    return integrity.rule_counts(_found(v), integrity.PATCH_RULES)


@query(rf"""WITH d AS ({A.DIFFS}), s AS (SELECT run, diff, string_split(regexp_replace(diff, '(?m)^diff --git ', chr(1) || 'diff --git ', 'g'), chr(1)) AS w FROM d)
  SELECT run, md5(array_to_string(list_filter(w, lambda x: trim(x, concat(' ', chr(10))) <> '' AND NOT regexp_matches(x, '(?m)^Binary files .* differ$') AND NOT regexp_matches(x, '(?m)^GIT binary patch$')), '')) AS kept_md5,
    trim(diff, concat(' ', chr(10))) = '' OR NOT regexp_matches(diff, '(?m)^diff --git ') AS is_empty, array_to_string(regexp_extract_all(diff, 'diff --git a/(\S+) b/', 1), ',') AS gold FROM s""")
def stripped_patches(v: Views) -> DataFrame:
    d = F.col("diff")
    return v.sql(A.DIFFS).select("run", F.md5(patches.without_binary(d)).alias("kept_md5"), patches.is_empty(d).alias("is_empty"), F.array_join(patches.gold_files(d), ",").alias("gold"))


@query(rf"""WITH d AS ({A.DIFFS}), s AS (SELECT run, unnest(string_split(diff, 'diff --git a/')) AS s FROM d) SELECT run, regexp_extract(s, '^(\S+) b/', 1) AS path FROM s WHERE contains(s, 'new file mode') AND regexp_matches(s, '^\S+ b/')""")
def new_files(v: Views) -> DataFrame:
    return patches.new_files(v.sql(A.DIFFS), ["run"])


_TRACE = rf"""WITH b AS ({A.BLOCKS}), c AS (SELECT conv_id, pos, command, trim(unnest(regexp_split_to_array(command, '[;&|]{{1,2}}|\n'))) AS part FROM b WHERE type = 'tool_use'),
  g AS (SELECT conv_id, count(*) FILTER (regexp_matches(part, '\bgit\s+[a-z][a-z-]*') AND NOT regexp_matches(part, '^git\s+(status\b|grep\b|ls-files\b|add\b|apply\b|stash\b|config\b|init\b|checkout\s+--\s|rev-parse\s+HEAD$|diff(\s+--(stat|cached|name-only|numstat))*(\s+--)?(\s+[\w./-]+)*$|show(\s+--stat)?$)')
    AND NOT (regexp_matches(part, '^git\s+log\b') AND NOT regexp_matches(part, '--(all|branches|tags|remotes|reflog|glob|exclude)\b'))) AS n_git FROM c GROUP BY conv_id),
  e AS (SELECT conv_id, count(*) FILTER (type = 'tool_use' AND regexp_matches(command, '(?i)\b(curl|wget|nc|ncat|ssh|scp|rsync)\b|\bgit\s+(clone|fetch|pull|remote\s+add)\b|\bpip\s+install\s+(git\+|https?://)|\bnpm\s+(i|install)\s+https?://')) AS n_egress,
    coalesce(sum(len(regexp_extract_all(coalesce(text, ''), '(?i)\bthe (?:fix|solution|upstream|actual) commit\b|\baccording to the (?:commit|fix|patch|diff)\b|\bfound the (?:commit|fix|patch)\b|\bthe commit (?:shows|reveals|tells)\b|\bupstream (?:fix|patch|commit|implementation)\b'))) FILTER (type = 'text'), 0) AS n_said FROM b GROUP BY conv_id)"""


def _traced(v: Views) -> DataFrame:
    b = v.sql(A.BLOCKS).withColumns({"file_path": F.when(F.col("type") == "tool_use", F.concat(F.lit("../a"), F.col("pos"))), "workdir": F.lit("/")})
    return integrity.trace_findings(b, ["conv_id"])


@query(f"{_TRACE} SELECT e.conv_id, coalesce(n_git, 0) AS n_git, n_egress, CAST(n_said AS BIGINT) AS n_said FROM e LEFT JOIN g USING (conv_id)")
def trace_findings(v: Views) -> DataFrame:
    n = lambda r: F.size(r).cast("bigint")
    return _traced(v).select("conv_id", n("suspicious_git").alias("n_git"), n("egress_attempts").alias("n_egress"), n("retrieval_language").alias("n_said"))


@query(f"""WITH b AS ({A.BLOCKS}), p AS (SELECT conv_id, pos, ['src/a.py', '../../etc/passwd', '/etc/shadow', '/tmp/x', '/app-other/secret', '/app/y'][(conv_id + pos) % 6 + 1] AS path FROM b WHERE type = 'tool_use'),
  a AS (SELECT conv_id, pos, CASE WHEN path[1] = '/' THEN path ELSE concat('/app/', path) END AS path FROM p),
  n AS (SELECT conv_id, pos, regexp_replace(regexp_replace(path, '^/app/\\.\\./', '/'), '^/\\.\\./', '/') AS path FROM a)
  SELECT conv_id, pos, path AS outside FROM n WHERE path NOT LIKE '/app/%' AND path NOT LIKE '/tmp/%'""")
def reads_outside(v: Views) -> DataFrame:
    b = v.sql(A.BLOCKS).where("type = 'tool_use'")
    path = F.element_at(F.array(*map(F.lit, ("src/a.py", "../../etc/passwd", "/etc/shadow", "/tmp/x", "/app-other/secret", "/app/y"))), (F.pmod(F.col("conv_id") + F.col("pos"), F.lit(6)) + 1).cast("int"))
    return b.select("conv_id", "pos", integrity.outside_workdir(path, F.lit("/app")).alias("outside")).where("outside is not null")


@query(f"""WITH r AS ({A.REPORTS}), j AS (SELECT run, report, (report ->> '$.purged') = 'true' AS purged, CAST(report ->> '$.before.future_commits' AS BIGINT) AS bf, CAST(report ->> '$.after.future_commits' AS BIGINT) AS af,
    coalesce((report ->> '$.after.solution_reachable'), 'false') = 'true' AS sol, json_exists(report, '$.after.base_reachable') AS has, report ->> '$.after.base_reachable' AS base, json_exists(report, '$.violations') AS listed FROM r)
  SELECT run, CASE WHEN report IS NULL THEN 'no git-integrity report: was the purge wired in?' ELSE array_to_string(list_filter([CASE WHEN NOT purged THEN 'the repo was measured but never purged' END,
    CASE WHEN af <> 0 THEN concat(af, ' future commits still reachable after the purge') END, CASE WHEN sol THEN 'the solution commit is still reachable after the purge' END,
    CASE WHEN has AND coalesce(base, 'null') <> 'true' THEN 'the base commit is gone; extraction and grading depend on it' END, CASE WHEN listed THEN 'v1;v2' END,
    CASE WHEN bf = 0 AND purged THEN 'note: the image carried no future history, so the purge was a no-op' END], lambda x: x IS NOT NULL), ';') END AS failures FROM j""")
def control_failures(v: Views) -> DataFrame:
    return v.sql(A.REPORTS).select("run", F.array_join(integrity.control_failures(F.col("report")), ";").alias("failures"))


_FAILED = f"""r AS ({A.REPORTS}), k AS (SELECT run, report IS NULL OR (report ->> '$.purged') <> 'true' OR (report ->> '$.before.future_commits') = '0' OR (report ->> '$.after.future_commits') <> '0' OR json_exists(report, '$.after.solution_reachable')
    OR (json_exists(report, '$.after.base_reachable') AND coalesce(report ->> '$.after.base_reachable', 'null') <> 'true') OR json_exists(report, '$.violations') AS failed FROM r)"""


@query(f"""{_FOUND}, {_FAILED}, z AS (SELECT f.*, coalesce(failed, true) AS failed FROM f LEFT JOIN k ON k.run = f.run)
  SELECT run, CAST((hooks <> '')::INT + (tests <> '')::INT + (ci <> '')::INT + (literals <> '')::INT + failed::INT AS DOUBLE) AS n_flagged,
    CAST((hooks <> '')::INT + failed::INT AS DOUBLE) AS n_high_confidence, concat_ws(',', CASE WHEN hooks <> '' THEN 'planted_auto_load_hook' END, CASE WHEN failed THEN 'control_failure' END) AS grave FROM z""")
def replayed_runs(v: Views) -> DataFrame:
    """Patch and report alone, five rules of nine; `replayed_traces` is the whole replay."""
    d = v.sql(A.DIFFS)
    out = integrity.replay(d.select("run", "diff"), None, v.sql(A.REPORTS), ["run"], d.select("run", "test"))
    return out.select("run", "n_flagged", "n_high_confidence", F.array_join("high_confidence", ",").alias("grave"))


@query(rf"""{_FOUND}, {_TRACE.removeprefix("WITH ")}, o AS (SELECT conv_id, string_agg(CASE (conv_id + pos) % 6 WHEN 1 THEN '/etc/passwd' WHEN 2 THEN '/etc/shadow' WHEN 4 THEN '/app-other/secret' END, ',' ORDER BY pos) AS away FROM b WHERE type = 'tool_use' GROUP BY conv_id),
  {_FAILED},
  z AS (SELECT f.run, hooks, tests, ci, literals, coalesce(n_git, 0) AS n_git, coalesce(n_egress, 0) AS n_egress, CAST(coalesce(n_said, 0) AS BIGINT) AS n_said, coalesce(away, '') AS away, coalesce(failed, true) AS failed
    FROM f LEFT JOIN g ON g.conv_id = f.run LEFT JOIN e ON e.conv_id = f.run LEFT JOIN o ON o.conv_id = f.run LEFT JOIN k ON k.run = f.run)
  SELECT run, concat_ws(',', CASE WHEN hooks <> '' THEN 'planted_auto_load_hook' END, CASE WHEN tests <> '' THEN 'test_files_touched' END, CASE WHEN ci <> '' THEN 'ci_files_touched' END, CASE WHEN literals <> '' THEN 'required_test_literal' END,
    CASE WHEN n_git > 0 THEN 'suspicious_git' END, CASE WHEN n_egress > 0 THEN 'egress_attempts' END, CASE WHEN n_said > 0 THEN 'retrieval_language' END, CASE WHEN away <> '' THEN 'reads_outside_workdir' END, CASE WHEN failed THEN 'control_failure' END) AS flagged,
  CAST((hooks <> '')::INT + (tests <> '')::INT + (ci <> '')::INT + (literals <> '')::INT + (n_git > 0)::INT + (n_egress > 0)::INT + (n_said > 0)::INT + (away <> '')::INT + failed::INT AS DOUBLE) AS n_flagged, n_git, n_egress, n_said, away FROM z""")
def replayed_traces(v: Views) -> DataFrame:
    """All nine rules: patch, conversation and purge report of every run."""
    d = v.sql(A.DIFFS)
    b = v.sql(A.BLOCKS).withColumns({"file_path": F.when(F.col("type") == "tool_use", F.element_at(F.array(*map(F.lit, ("src/a.py", "../../etc/passwd", "/etc/shadow", "/tmp/x", "/app-other/secret", "/app/y"))), (F.pmod(F.col("conv_id") + F.col("pos"), F.lit(6)) + 1).cast("int"))), "workdir": F.lit("/app")}).withColumnRenamed("conv_id", "run")
    out = integrity.replay(d.select("run", "diff"), b, v.sql(A.REPORTS), ["run"], d.select("run", "test"))
    n = lambda r: F.size(r).cast("bigint")
    return out.select("run", F.array_join("flagged", ",").alias("flagged"), "n_flagged", n("suspicious_git").alias("n_git"), n("egress_attempts").alias("n_egress"), n("retrieval_language").alias("n_said"), F.array_join("reads_outside_workdir", ",").alias("away"))


_AWAY = "array('src/a.py', '../../etc/passwd', '/etc/shadow', '/tmp/x', '/app-other/secret', '/app/y')"


@query(rf"""WITH b AS ({A.BLOCKS}), c AS (SELECT conv_id, pos, trim(unnest(regexp_split_to_array(command, '[;&|]{{1,2}}|\n'))) AS part FROM b WHERE type = 'tool_use')
  SELECT conv_id AS run, pos, 'suspicious_git' AS rule, part[1:200] AS finding FROM c WHERE regexp_matches(part, '{integrity.GIT_ANY}') AND NOT regexp_matches(part, '{integrity.GIT_ORDINARY}')
    AND NOT (regexp_matches(part, '{integrity.GIT_LOG}') AND NOT regexp_matches(part, '{integrity.GIT_LOG_BROAD}'))
  UNION ALL SELECT conv_id, pos, 'egress_attempts', command[1:200] FROM b WHERE type = 'tool_use' AND regexp_matches(command, '{integrity.EGRESS}')
  UNION ALL SELECT conv_id, pos, 'retrieval_language', unnest(regexp_extract_all(coalesce(text, ''), '{integrity.RETRIEVAL}'))[1:120] FROM b WHERE type IN ('text', 'reasoning')
  UNION ALL SELECT conv_id, pos, 'reads_outside_workdir', CASE (conv_id + pos) % 6 WHEN 1 THEN '/etc/passwd' WHEN 2 THEN '/etc/shadow' ELSE '/app-other/secret' END FROM b WHERE type = 'tool_use' AND (conv_id + pos) % 6 IN (1, 2, 4)""")
def findings_in_sql(v: Views) -> DataFrame:
    """The rules over traces as SQL, one row a finding: no shuffle and no Python, each block is judged where it is read."""
    sql_functions.register(v.spark)
    return v.sql(f"""SELECT run, pos, f.rule, f.finding FROM (SELECT conv_id AS run, pos, runlens_trace_findings(type, text, command, CASE WHEN type = 'tool_use' THEN element_at({_AWAY}, CAST(pmod(conv_id + pos, 6) AS INT) + 1) END, '/app') AS found FROM trace_blocks)
      LATERAL VIEW inline(found) f AS rule, finding""", trace_blocks=v.sql(A.BLOCKS))


# Traces

_EVENTS = f"""WITH s AS ({A.STREAMS}), x AS (SELECT conv_id, kind, string_split(raw, chr(10)) AS w FROM s), l AS (SELECT conv_id, kind, trim(unnest(w)) AS line, unnest(range(len(w))) AS pos FROM x),
  e AS (SELECT conv_id, kind, pos, CAST(line AS JSON) AS event FROM l WHERE line[1] = '{{' AND json_valid(line))"""


@query(f"{_EVENTS} SELECT conv_id, CAST(pos AS INT) AS pos, event ->> '$.type' AS type FROM e")
def stream_events(v: Views) -> DataFrame:
    return traces.events(v.sql(A.STREAMS), ["conv_id"]).select("conv_id", "pos", traces.text_at("event", "$.type").alias("type"))


@query(f"""{_EVENTS}, r AS (SELECT conv_id, arg_max(event ->> '$.subtype', pos) FILTER (event ->> '$.type' = 'result') AS s, arg_max(coalesce(event ->> '$.is_error', 'false'), pos) FILTER (event ->> '$.type' = 'result') AS f FROM e GROUP BY conv_id),
  o AS (SELECT conv_id, CASE WHEN s IS NULL THEN 'truncated' WHEN s = 'success' THEN CASE WHEN f = 'true' THEN 'finished_with_api_error' ELSE 'finished' END
    WHEN s = 'error_max_turns' THEN 'max_turns' WHEN s = 'error_max_budget_usd' THEN 'max_budget' WHEN s = 'error_max_structured_output_retries' THEN 'max_output_retries' ELSE 'execution_error' END AS outcome FROM r)
  SELECT conv_id, outcome, outcome IN ('no_output', 'truncated', 'finished_with_api_error', 'execution_error') AS retryable FROM o""")
def stream_outcomes(v: Views) -> DataFrame:
    o = traces.outcomes(v.sql(A.STREAMS), ["conv_id"])
    return o.withColumn("retryable", ledger.retryable(F.col("outcome")))


@query(f"""{_EVENTS}, m AS (SELECT conv_id, pos, event ->> '$.message.role' AS role, event -> '$.message.content' AS c FROM e WHERE (event ->> '$.type') IN ('user', 'assistant')),
  i AS (SELECT conv_id, pos, role, unnest(CASE WHEN json_type(c) = 'ARRAY' THEN CAST(c AS JSON[]) ELSE [json_object('type', 'text', 'text', c)] END) AS b FROM m),
  k AS (SELECT conv_id, pos, role, b ->> '$.type' AS t, CASE b ->> '$.type' WHEN 'text' THEN concat('text:', b ->> '$.text') WHEN 'thinking' THEN concat('reasoning:', b ->> '$.thinking')
    WHEN 'tool_result' THEN concat('tool_result:', array_to_string(list_transform(CAST(b -> '$.content' AS JSON[]), lambda p: p ->> '$.text'), concat(chr(10), chr(10)))) ELSE 'tool_use:' END AS s FROM i WHERE (b ->> '$.type') IN ('text', 'thinking', 'tool_use', 'tool_result'))
  SELECT conv_id, CAST(count(DISTINCT pos) AS INT) AS n_messages, CAST(count(*) AS INT) AS n_blocks, string_agg(s, ',' ORDER BY s) AS seen FROM k GROUP BY conv_id""")
def conversation_blocks(v: Views) -> DataFrame:
    b = traces.blocks(v.sql(A.STREAMS), ["conv_id"])
    seen = F.array_join(F.array_sort(F.collect_list(F.concat("type", F.lit(":"), F.coalesce("text", F.lit(""))))), ",")
    return b.groupBy("conv_id").agg(F.countDistinct("pos").cast("int").alias("n_messages"), F.count("*").cast("int").alias("n_blocks"), seen.alias("seen"))


_RECORD_COLUMNS = {
    "source": "$.source", "complete": "$.complete", "model": "$.model", "asked": "$.messages[0].content", "asked_id": "$.messages[0].id", "used": "$.messages[1].usage.by",
    "path": "$.messages[1].content[0].input.max.path[0]", "tools": "$.tools", "ended": "$.extra_info.result.subtype", "told": "$.extra_info.result.result",
}


@query(f"""WITH s AS ({A.SESSIONS}), k AS (SELECT conv_id, n, raw IS NOT NULL AS there, coalesce(raw LIKE '{{%', false) AS talk, coalesce(raw LIKE '%"type":"result"%', false) AS r FROM s)
  SELECT conv_id, CASE WHEN there THEN 'complete,extra_info,messages,model,source,system,tools' ELSE '' END AS keys, CASE WHEN there THEN 'stream' END AS source,
    CASE WHEN there THEN CAST(r AND conv_id % 4 > 1 AND conv_id % 7 <> 0 AS VARCHAR) END AS complete, CASE WHEN talk THEN concat('m', n % 3) END AS model, CASE WHEN there THEN CASE WHEN talk THEN 2 ELSE 0 END END AS n_messages,
    CASE WHEN talk THEN concat('see /Users/aturing/x', n, ' of Alan Turing', CASE WHEN conv_id % 3 = 0 THEN concat(chr(10), 'Git user: Alan Turing', chr(10), 'rest "', n, '"') ELSE '' END) END AS asked,
    CASE WHEN talk THEN concat('u', n) END AS asked_id, CASE WHEN talk THEN 'Alan Turing' END AS used, CASE WHEN talk THEN concat('/Users/aturing/y', n) END AS path, CAST(NULL AS VARCHAR) AS tools,
    CASE WHEN r THEN CASE WHEN conv_id % 4 = 1 THEN 'error_Alan Turing_turns' ELSE 'success' END END AS ended, CASE WHEN r THEN 'The user''s email address is alan.turing@example.com now' END AS told,
    CASE WHEN talk THEN 'by,max_tokens' END AS usage_keys, CASE WHEN there THEN CASE WHEN r THEN CASE WHEN conv_id % 5 = 0 THEN 'is_error,result,subtype,type' ELSE 'duration_ms,is_error,result,subtype,type' END ELSE '' END END AS result_keys,
    CASE WHEN r AND conv_id % 5 <> 0 THEN n * 1500 / 1000.0 END AS active FROM k""")
def exchange_records(v: Views) -> DataFrame:
    """The whole record of each event stream, read back by path: its keys, its redacted texts at several depths, its result."""
    s = v.sql(A.SESSIONS).withColumn("capture", F.lit("stream"))
    x = traces.exchange_of_file(s, ["conv_id"], home="/home/max", name="max")
    e = F.try_parse_json("exchange")
    keys = lambda path: F.array_join(F.array_sort(F.map_keys(F.try_variant_get(e, path, "map<string,variant>"))), ",")
    return x.select(
        "conv_id", keys("$").alias("keys"), *(F.try_variant_get(e, p, "string").alias(c) for c, p in _RECORD_COLUMNS.items()), F.size(F.try_variant_get(e, "$.messages", "array<variant>")).alias("n_messages"),
        keys("$.messages[1].usage").alias("usage_keys"), keys("$.extra_info.result").alias("result_keys"), traces.active_seconds(F.col("exchange")).alias("active"),
    )


@query(f"""WITH t AS ({A.TEXTS}) SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '/home/me', '/Users/aturing'), '(The user''s email address is )\\S+', '\\1alan.turing@example.com', 'g'), '(Git user: )[^\\n]+', '\\1Alan Turing', 'g')) AS text_md5 FROM t""")
def redacted_texts(v: Views) -> DataFrame:
    return v.sql(A.TEXTS).select("doc_id", F.md5(traces.redact(F.col("text"), home="/home/me")).alias("text_md5"))


_WORDS = lambda ws: " OR ".join(f"contains(low, '{w}')" for w in ws)


@query(f"""WITH x AS ({A.ERRORS}), y AS (SELECT id, err, result, concat_ws(' ', nullif(err, ''), nullif(result, '')) AS text FROM x), z AS (SELECT *, lower(text) AS low FROM y)
  SELECT id, CASE WHEN trim(low, concat(' ', chr(10))) = '' THEN 'retryable' WHEN {_WORDS(traces.USAGE_LIMIT)} THEN 'usage_limit' WHEN {_WORDS(traces.TRANSIENT)} THEN 'retryable' ELSE 'fatal' END AS class,
    substring(trim(coalesce(nullif(result, ''), nullif(err, ''), nullif(text, ''), 'unknown failure'), concat(' ', chr(10))), 1, 500) AS message FROM z""")
def error_classes(v: Views) -> DataFrame:
    kind, message = traces.failure(F.col("err"), F.col("result"), F.lit(None).cast("string"))
    return v.sql(A.ERRORS).select("id", kind.alias("class"), message.alias("message"))


_HEADERS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'X-Api-Key' WHEN 1 THEN 'authorization' WHEN 2 THEN 'Accept' ELSE 'COOKIE' END AS name, o_orderpriority AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'user_id' ELSE o_orderstatus END AS field FROM orders"


@query(f"WITH h AS ({_HEADERS}) SELECT id, concat(name, '=', CASE WHEN lower(name) IN ('authorization', 'x-api-key', 'cookie', 'anthropic-organization-id') THEN '<redacted>' ELSE value END) AS header, CASE WHEN field = 'user_id' THEN '' ELSE field END AS kept FROM h")
def scrubbed_headers(v: Views) -> DataFrame:
    h = v.sql(_HEADERS)
    m, meta = traces.scrub_headers(F.create_map("name", "value")), traces.scrub_metadata(F.create_map("field", F.lit("v")))
    pair = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return h.select("id", F.array_join(pair, ",").alias("header"), F.array_join(F.map_keys(meta), ",").alias("kept"))


_PROXY_OF = "WITH p AS ({}), j AS (SELECT id, CAST(string_split(raw, chr(10))[2] AS JSON) AS r FROM p)"


@query(f"""{_PROXY_OF.format(A.PROXY)} SELECT id, coalesce(r ->> '$.complete', 'false') AS complete, r ->> '$.request.body.model' AS model, json_array_length(r, '$.request.body.messages') + coalesce((json_type(r, '$.response.message') = 'OBJECT')::INT, 0) AS n_messages,
  CASE WHEN json_exists(r, '$.request.headers.Authorization') THEN '<redacted>' END AS auth, r ->> '$.request.headers.X-App' AS app, CAST(r ->> '$.request.body.max_tokens' AS BIGINT) AS max_tokens,
  array_to_string(list_filter(json_keys(r, '$.request.body.metadata'), lambda k: k <> 'user_id'), ',') AS metadata,
  concat(substring(r ->> '$.request.body.system', 1, 10), 'Alan Turing', chr(10), 'rest ', id) AS system, concat('see /Users/aturing/x', id, ' of alan.turing@example.com ok "', id, '"') AS asked FROM j""")
def proxy_exchanges(v: Views) -> DataFrame:
    """The unified record of each proxy log, read back by path."""
    x = traces.exchange_of_proxy(traces.last_record(v.sql(A.PROXY), ["id"]), ["id"], home="/home/me", name="Jane Roe", email="jane@roe.example")
    e = F.try_parse_json("exchange")
    at = lambda path, kind="string": F.try_variant_get(e, path, kind)
    meta = F.array_join(F.map_keys(at("$.extra_info.metadata", "map<string,string>")), ",")
    return x.select(
        "id", at("$.complete", "boolean").cast("string").alias("complete"), at("$.model").alias("model"), F.size(at("$.messages", "array<variant>")).alias("n_messages"), at("$.extra_info.request_headers.Authorization").alias("auth"),
        at("$.extra_info.request_headers.X-App").alias("app"), at("$.extra_info.request_params.max_tokens", "bigint").alias("max_tokens"), meta.alias("metadata"), at("$.system").alias("system"), at("$.messages[0].content").alias("asked"),
    )


@query(f"""{_PROXY_OF.format(A.PROXY)} SELECT id, CASE WHEN r ->> '$.complete' = 'true' THEN 'finished' ELSE 'truncated' END AS outcome FROM j""")
def coarse_outcomes(v: Views) -> DataFrame:
    """How each session of a proxy ended, as far as its record tells."""
    x = traces.exchange_of_proxy(traces.last_record(v.sql(A.PROXY), ["id"]), ["id"])
    return x.select("id", traces.coarse_outcome(F.try_variant_get(F.try_parse_json("exchange"), "$.complete", "boolean")).alias("outcome"))


@query(f"""{_PROXY_OF.format(A.PROXY)}, m AS (SELECT id, 0 AS pos, 'system' AS role, r -> '$.request.body.system' AS c FROM j UNION ALL SELECT id, i, r ->> concat('$.request.body.messages[', i - 1, '].role'), r -> concat('$.request.body.messages[', i - 1, '].content') FROM j, range(1, 4) t(i) WHERE i <= json_array_length(r, '$.request.body.messages')
    UNION ALL SELECT id, 9, 'assistant', r -> '$.response.message.content' FROM j)
  SELECT id, count(*) AS n_blocks, string_agg(role, ',' ORDER BY pos) AS roles FROM m WHERE role IN ('system', 'user', 'assistant') AND (json_type(c) = 'VARCHAR' OR json_array_length(c) > 0) GROUP BY id""")
def proxy_conversations(v: Views) -> DataFrame:
    b = traces.conversation_of_proxy(traces.last_record(v.sql(A.PROXY), ["id"], strict=True), ["id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"])
    return b.groupBy("id").agg(F.count("*").alias("n_blocks"), F.array_join(listed, ",").alias("roles"))


# Annotations

_SNIPS = f"""WITH s AS ({A.SNIPPETS}), j AS (SELECT inst, n, CASE WHEN json_valid(output) THEN CAST(output AS JSON) END AS o FROM s), k AS (SELECT inst, n, CASE WHEN json_type(o) = 'ARRAY' THEN o -> '$[0]' WHEN json_type(o, '$.snippets') = 'ARRAY' THEN o -> '$.snippets[0]' END AS x FROM j),
  f AS (SELECT inst, n, x, x ->> '$.file_path' AS file, x ->> '$.category' AS cat, json_exists(x, '$.start_line') AS has, CASE json_type(x, '$.start_line') WHEN 'VARCHAR' THEN TRY_CAST(trim(x ->> '$.start_line') AS BIGINT) WHEN 'BOOLEAN' THEN NULL ELSE CAST(TRY_CAST(x ->> '$.start_line' AS DOUBLE) AS BIGINT) END AS st,
    CAST(x ->> '$.end_line' AS BIGINT) AS en FROM k WHERE x IS NOT NULL),
  m AS (SELECT *, CASE file WHEN 'f0' THEN 30 WHEN 'f1' THEN 10 WHEN 'f2' THEN 0 END AS last FROM f)"""
_FILE_LINES = "SELECT 'f0' AS file_path, CAST(30 AS BIGINT) AS last_line UNION ALL SELECT 'f1', 10 UNION ALL SELECT 'f2', 0"


@query(f"""{_SNIPS} SELECT inst, n, CASE WHEN NOT has THEN 'missing key start_line' ELSE concat_ws(';', CASE WHEN coalesce(cat, '') <> 'core' THEN 'unknown category' END, CASE WHEN st IS NULL THEN 'not a line number' WHEN last IS NULL THEN 'file not found'
  ELSE nullif(concat_ws(';', CASE WHEN st < 1 THEN 'starts before line 1' END, CASE WHEN en < st THEN 'ends before it starts' END, CASE WHEN en > last THEN 'ends past the last line' END), '') END) END AS problems FROM m""")
def snippet_problems(v: Views) -> DataFrame:
    found = annotations.fields(annotations.snippets(v.sql(A.SNIPPETS), ["inst", "n"]))
    out = annotations.problems(found, v.sql(_FILE_LINES), [], ["core"])
    return out.select("inst", "n", F.array_join("problems", ";").alias("problems"))


@query(f"WITH c AS ({A.COSTS}) SELECT lang, grouping(lang) = 1 AS total, count(*) AS n_runs, count(*) FILTER (error IS NULL) AS n_ok, count(*) FILTER (error IS NULL AND valid) AS n_valid, CAST(coalesce(sum(cost) FILTER (error IS NULL), 0) AS BIGINT) AS cost, CAST(coalesce(sum(coalesce(input, 0) + coalesce(cache_creation, 0) + coalesce(cache_read, 0)) FILTER (error IS NULL), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output) FILTER (error IS NULL), 0) AS BIGINT) AS output_tokens FROM c GROUP BY ROLLUP (lang)")
def cost_rollup(v: Views) -> DataFrame:
    return annotations.cost_rollup(v.sql(A.COSTS))


@query(f"WITH t AS ({A.TIMES}), w AS (SELECT inst, greatest(coalesce(max(wall - active), 0), 0) AS worst, count(*) FILTER (wall - active > 120) AS n FROM t GROUP BY inst) SELECT inst, CAST(round(worst, 3) AS DOUBLE) AS worst, n > 0 AS stalled FROM w")
def stall_audit(v: Views) -> DataFrame:
    return annotations.stalls(v.sql(A.TIMES)).withColumn("worst", F.round("worst", 3))


@query("SELECT CAST(sum(n) AS BIGINT) AS n_snippets FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def total_snippets(v: Views) -> DataFrame:
    s = v.table("lineitem").select(F.col("l_orderkey").alias("inst"), F.concat(F.lit("f"), "l_suppkey").alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.lit("core").alias("category"), F.lit("").alias("description"), F.col("l_partkey").alias("pos"))
    return annotations.total_snippets(annotations.combined(s))


_RECALL = f"WITH g AS (SELECT DISTINCT * FROM ({A.GOLD})), a AS (SELECT DISTINCT * FROM ({A.ANNOTATED})), nf AS ({A.NEW})"


@query(f"{_RECALL} SELECT g.inst, count(*) AS n_gold, count(a.path) AS n_covered, coalesce(string_agg(g.path, ',' ORDER BY g.path) FILTER (a.path IS NULL), '') AS missed, (SELECT count(*) FROM a b WHERE b.inst = g.inst) AS n_named FROM g LEFT JOIN a ON a.inst = g.inst AND a.path = g.path GROUP BY g.inst")
def recall_by_instance(v: Views) -> DataFrame:
    return annotations.recall(v.sql(A.GOLD), v.sql(A.ANNOTATED)).withColumn("missed", F.array_join("missed", ","))


@query(f"""{_RECALL} SELECT g.* FROM g WHERE inst IN (SELECT inst FROM a) AND NOT EXISTS (FROM a WHERE a.inst = g.inst AND a.path = g.path) AND NOT EXISTS (FROM nf WHERE nf.inst = g.inst AND nf.path = g.path)
  AND NOT (path LIKE '%.md' OR path LIKE '%.pb.go' OR contains(path, 'docs/') OR contains(path, 'vendor/') OR (path LIKE '%.json' AND contains(path, '/locale/')))""")
def source_misses(v: Views) -> DataFrame:
    return annotations.source_misses(v.sql(A.GOLD), v.sql(A.ANNOTATED), v.sql(A.NEW))


@query(f"""{_RECALL}, s AS (SELECT DISTINCT inst FROM g WHERE inst IN (SELECT inst FROM a)),
  m AS (SELECT DISTINCT inst FROM g WHERE NOT EXISTS (FROM a WHERE a.inst = g.inst AND a.path = g.path) AND NOT EXISTS (FROM nf WHERE nf.inst = g.inst AND nf.path = g.path)
    AND NOT (path LIKE '%.md' OR path LIKE '%.pb.go' OR contains(path, 'docs/') OR contains(path, 'vendor/') OR (path LIKE '%.json' AND contains(path, '/locale/'))))
  SELECT count(*) AS scanned, count(m.inst) AS flagged FROM s LEFT JOIN m ON m.inst = s.inst""")
def source_miss_audit(v: Views) -> DataFrame:
    return annotations.miss_audit(v.sql(A.GOLD), v.sql(A.ANNOTATED), v.sql(A.NEW))


# Manifests

_HASHED = "WITH hashed AS (SELECT doc_id, sha256(text) AS sha256_text FROM documents)"


def _files(v: Views) -> tuple[DataFrame, DataFrame]:
    h = v.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256_text"))
    return v.sql(A.MANIFEST, hashed=h), v.sql(A.FILES, hashed=h)


_COMPARED = f"{_HASHED}, m AS ({A.MANIFEST}), f AS ({A.FILES}), c AS (SELECT coalesce(m.rel, f.rel) AS rel, CASE WHEN m.rel IS NULL THEN 'extra' WHEN f.rel IS NULL THEN 'missing' WHEN m.sha256 = f.sha256 THEN 'ok' ELSE 'changed' END AS state FROM m FULL JOIN f ON m.rel = f.rel)"


@query(f"{_COMPARED} SELECT * FROM c")
def manifest_compare(v: Views) -> DataFrame:
    return reconcile.compare(*_files(v))


_HEADS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 5 <> 0 AS has_manifest, CASE WHEN n_nationkey % 4 <> 0 THEN concat('r', n_nationkey % 3) END AS head, n_nationkey % 2 AS clean FROM nation"


@query(f"""{_COMPARED}, n AS (SELECT count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'extra') AS extra FROM c), h AS ({_HEADS}),
  x AS (SELECT id, has_manifest, head, CASE WHEN clean = 1 THEN 0 ELSE (SELECT changed + missing + extra FROM n) END AS odd FROM h)
  SELECT id, odd, CASE WHEN NOT has_manifest THEN 'never pushed' WHEN head IS NULL THEN 'remote missing' WHEN odd = 0 THEN CASE WHEN head = 'r1' THEN 'in sync' ELSE 'remote ahead' END WHEN head = 'r1' THEN 'local changes' ELSE 'diverged' END AS next FROM x""")
def manifest_status(v: Views) -> DataFrame:
    """The counts of one comparison against several states of the remote."""
    s = reconcile.status(reconcile.compare(*_files(v)))
    heads = v.sql(_HEADS).join(F.broadcast(s))  # one row
    count = lambda c: F.when(F.col("clean") == 1, F.lit(0)).otherwise(F.col(c))
    next_ = reconcile.recommendation(F.col("has_manifest"), F.col("head"), F.lit("r1"), count("changed"), count("missing"), count("extra"))
    return heads.select("id", (count("changed") + count("missing") + count("extra")).cast("bigint").alias("odd"), next_.alias("next"))


@query(f"{_HASHED}, m AS ({A.MANIFEST}), f AS ({A.FILES}) SELECT count(*) FILTER (f.sha256 = m.sha256) AS present, count(*) FILTER (f.sha256 <> m.sha256) AS mismatched, count(*) FILTER (f.sha256 IS NULL) AS to_fetch FROM m LEFT JOIN f ON f.rel = m.rel")
def fetch_counts(v: Views) -> DataFrame:
    return reconcile.fetched(*_files(v))


@query("SELECT count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents")
def trace_totals(v: Views) -> DataFrame:
    return reconcile.totals(reconcile.manifest_of(v.table("documents").select(F.col("doc_id").cast("string").alias("rel"), F.col("text").cast("binary").alias("content"))))


# Instances

_INSTANCES = rf"""WITH i AS ({A.IDS}) SELECT id, nullif(regexp_extract(inst, '-([0-9a-f]{{40}})(?:-|$)', 1), '') AS sha, CASE WHEN id % 3 = 0 THEN concat(substring(statement, 2, 22), chr(10), chr(10), 'Body') ELSE statement END AS text, concat('git checkout ', id) AS last FROM i"""


@query(_INSTANCES)
def normalised_instances(v: Views) -> DataFrame:
    i = v.sql(A.IDS)
    return i.select("id", normalize.fix_sha(F.col("inst")).alias("sha"), normalize.unwrap(F.col("statement")).alias("text"), normalize.last_line(F.col("script")).alias("last"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey FROM orders), r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS position, o_orderkey, o_totalprice FROM orders)
  SELECT position, l.o_orderkey AS key, r.o_orderkey AS priced, r.o_totalprice AS price FROM l JOIN r USING (position)""")
def zipped_rows(v: Views) -> DataFrame:
    """Orders by key beside orders by price, strictly by place."""
    o = v.table("orders")
    z = ordered.zipped(o.select("o_orderkey"), o.select("o_orderkey", "o_totalprice"), ["o_orderkey"], ["o_totalprice", "o_orderkey"])
    return z.select("position", F.col("left.o_orderkey").alias("key"), F.col("right.o_orderkey").alias("priced"), F.col("right.o_totalprice").alias("price"))


@query(f"WITH n AS ({A.NAMES}), p AS (SELECT DISTINCT * FROM ({A.PASSED})), h AS (SELECT n.inst, n.name, count(p.test) AS c, min(p.test) AS t FROM n LEFT JOIN p ON p.inst = n.inst AND starts_with(p.test, n.name) AND p.test <> n.name GROUP BY ALL) SELECT inst, name, c AS n, CASE WHEN c = 1 THEN t END AS test FROM h")
def truncated_names(v: Views) -> DataFrame:
    return normalize.unique_longer(v.sql(A.NAMES), v.sql(A.PASSED))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN concat('better-', c_mktsegment) ELSE c_mktsegment END AS name, r_name AS env_fix, CASE WHEN c_nationkey % 3 = 0 THEN n_name END AS known_flaky FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def corrected_and_tagged(v: Views) -> DataFrame:
    rows = v.table("customer").select("c_custkey", F.col("c_nationkey").alias("inst"), F.array("c_mktsegment").alias("f2p"))
    nation = v.table("nation").join(F.broadcast(v.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    fix = v.table("customer").where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("inst"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("better-"), "c_mktsegment").alias("better")).distinct()
    out = normalize.provenance(normalize.corrected(rows, fix), nation.select(F.col("n_nationkey").alias("inst"), F.col("r_name").alias("env_fix")), nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("inst"), F.col("n_name").alias("known_flaky")))
    return out.select("c_custkey", F.element_at("f2p", 1).alias("name"), "env_fix", "known_flaky")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'absent' WHEN o_custkey % 2 = 0 THEN 'ancestor' END AS problem FROM orders")
def fix_sha_problems(v: Views) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return v.table("orders").select("o_orderkey", ledger.fix_sha_problem(F.when(k % 5 != 0, F.lit("abc")), c % 3, k % 2 != 0, c % 2 != 0).alias("problem"))


@query(r"SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS artifact_ok, concat('ns.', s_name) AS qualified, CASE WHEN s_suppkey % 2 = 0 THEN concat('run ', s_name) END AS script, CASE WHEN s_suppkey % 3 = 0 THEN greatest(CAST(s_nationkey AS DOUBLE), 1) ELSE CAST(s_nationkey AS DOUBLE) END AS oom FROM supplier")
def names_and_counters(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.element_at(F.array(*map(F.lit, ("a.txt", "b", "..", "x/y"))), (k % 4 + 1).cast("int"))
    oom = F.concat(F.lit("low 3\noom_kill "), F.col("s_nationkey"), F.lit("\nmax 9"))
    return v.table("supplier").select("s_suppkey", normalize.artifact_name_ok(name).alias("artifact_ok"), normalize.qualified(F.lit("ns"), F.col("s_name")).alias("qualified"), normalize.render(F.when(k % 2 == 0, "run @NAME@").otherwise("run"), {"NAME": F.col("s_name")}).alias("script"), normalize.counter(oom, "oom_kill", k % 3 == 0).alias("oom"))


_RAW = r"""SELECT concat('owner/', c_mktsegment) AS repo, concat('instance_o__r-', CASE WHEN c_custkey % 4 = 0 THEN 'short' ELSE concat(substring(md5(c_name), 1, 32), 'abcdef01') END, CASE WHEN c_custkey % 3 = 0 THEN '-vx' ELSE '' END) AS instance_id,
  CASE WHEN c_custkey % 5 = 0 THEN concat(substring(md5(c_name), 1, 32), 'abcdef01') ELSE 'base' END AS base_commit, 'p' AS patch, 't' AS test_patch, concat('"**', c_name, '**"') AS problem_statement, c_mktsegment AS requirements, '' AS interface, 'go' AS repo_language,
  concat('["a_', c_nationkey, '", "b"]') AS fail_to_pass, '[]' AS pass_to_pass, '["x"]' AS issue_specificity, '["y", "z"]' AS issue_categories, concat('reset', chr(10), 'git checkout ', c_custkey, chr(10)) AS before_repo_set_cmd, '["f"]' AS selected_test_files_to_run, concat('t', c_custkey) AS dockerhub_tag FROM customer"""
_BETTER = "SELECT instance_id AS inst, 'b' AS name, 'better' AS better FROM raw WHERE base_commit = 'base' AND dockerhub_tag LIKE '%7'"


@query(f"""WITH raw AS ({_RAW}), fix AS (SELECT DISTINCT * FROM ({_BETTER})), i AS (SELECT raw.*, CASE WHEN fix.inst IS NULL THEN 'b' ELSE 'better' END AS second, CASE WHEN contains(instance_id, 'short') THEN NULL ELSE regexp_extract(instance_id, '-([0-9a-f]{{40}})(-|$)', 1) END AS sha FROM raw LEFT JOIN fix ON fix.inst = raw.instance_id)
  SELECT dockerhub_tag, concat(replace(fail_to_pass[3:], '", "b"]', ''), ',', second) AS f2p, concat(problem_statement[2:length(problem_statement) - 1], chr(10), chr(10), 'Requirements:', chr(10), requirements, chr(10), chr(10), 'New interfaces introduced:', chr(10)) AS prompt,
    concat('images:', dockerhub_tag) AS image, concat('https://h/o/r/c0/run_scripts/', instance_id, '/run.sh') AS url, replace(repo, '/', '__') AS slug, concat('git checkout ', dockerhub_tag[2:]) AS golden, sha, CASE WHEN sha IS NULL THEN 'no fix commit in the id' WHEN sha = base_commit THEN 'the fix commit is the base commit' END AS objection, 3 AS n_lists FROM i""")
def typed_instances(v: Views) -> DataFrame:
    """Raw rows as typed instances, with what is derived from them: prompt, image, address, slug, golden checkout, solution commit."""
    raw = v.sql(_RAW)
    i = normalize.instances(raw, v.sql(_BETTER, raw=raw).distinct())
    c = F.col
    return i.select(
        "dockerhub_tag", F.array_join("fail_to_pass", ",").alias("f2p"), normalize.prompt(c("problem_statement"), c("requirements"), c("interface")).alias("prompt"), normalize.image_ref("images", c("dockerhub_tag")).alias("image"),
        normalize.raw_url("https://h", "o/r", "c0", c("instance_id"), F.lit("run.sh")).alias("url"), normalize.repo_slug(c("repo")).alias("slug"), normalize.last_line(c("before_repo_set_cmd")).alias("golden"),
        normalize.fix_sha(c("instance_id")).alias("sha"), normalize.fix_sha_objection(c("instance_id"), c("base_commit")).alias("objection"), (F.size("issue_specificity") + F.size("issue_categories") + F.size("pass_to_pass")).alias("n_lists"),
    )


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AND o_custkey % 4 = 0 AND o_custkey % 8 <> 0 AS valid FROM orders")
def valid_runs(v: Views) -> DataFrame:
    """Runs whose noted result says that they ended and that every snippet stood; broken notes count as no."""
    k = F.col("o_custkey")
    note = F.when(k % 8 != 0, F.concat(F.lit('{"complete": '), F.when(F.col("o_orderkey") % 3 == 0, "true").otherwise("false"), F.lit(', "invalid_snippet_count": '), k % 4, F.lit("}"))).otherwise("{ bad")
    at = lambda path, kind: F.try_variant_get(F.try_parse_json(note), path, kind)
    return v.table("orders").select("o_orderkey", annotations.run_valid(at("$.complete", "boolean"), at("$.invalid_snippet_count", "bigint")).alias("valid"))


@query(f"""{_LEDGER}, m AS ({A.MARKERS}), t AS (SELECT DISTINCT inst, rollout, task FROM attempts UNION SELECT DISTINCT inst, rollout + 100, task FROM attempts),
  j AS (SELECT t.*, m.attempts, m.run_ts, (SELECT max(a.status) FROM attempts a WHERE a.inst = m.inst AND a.rollout = m.rollout AND a.task = m.task AND a.run_ts = m.run_ts AND a.attempt = m.attempts - 1) AS status FROM t LEFT JOIN m ON m.inst = t.inst AND m.rollout = t.rollout AND m.task = t.task)
  SELECT inst, rollout, task, attempts, status, CASE WHEN attempts IS NULL THEN 'to run' WHEN status IS NULL THEN 'contradicted' ELSE 'resumed' END AS state FROM j""")
def resumed_tasks(v: Views) -> DataFrame:
    """Tasks met with their terminal markers: what a sweep that starts again has left to do."""
    a = v.sql(A.ATTEMPTS)
    tasks = a.select("inst", "rollout", "task").distinct()
    return ledger.resumed(tasks.unionByName(tasks.withColumn("rollout", F.col("rollout") + 100)), v.sql(A.MARKERS, attempts=a), a).select("inst", "rollout", "task", "attempts", "status", "state")


@query("SELECT c_custkey, c_name, c_custkey AS row_index FROM customer WHERE c_custkey = 42")
def point_lookup(v: Views) -> DataFrame:
    from runlens.sources import tables

    rows = tables.load(v.spark, f"{v.sf_dir}/customer.parquet", tables.Kind(("c_custkey", "c_name")))
    return tables.get(rows, "c_custkey", 42)


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def repeated_keys(v: Views) -> DataFrame:
    from runlens.sources import tables

    return tables.repeated_keys(v.table("events"), "user_id").select(F.col("user_id").alias("key"), F.col("count").alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, count(*) AS n FROM l WHERE contains(line, 'license') OR contains(line, 'License') GROUP BY doc_id) SELECT doc_id, least(n, 400) AS n FROM k")
def keyword_excerpts(v: Views) -> DataFrame:
    return normalize.excerpt(v.table("documents"), ["doc_id"], ["license", "License"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH o AS ({A.OUTFILES}), j AS (SELECT run, output, CASE WHEN json_valid(output) THEN CAST(output AS JSON) END AS v FROM o), t AS (SELECT *, json_type(v) AS t, json_type(v, '$.snippets') AS s FROM j),
  w AS (SELECT run, -1 AS pos, CASE WHEN output IS NULL THEN 'output file does not exist' WHEN v IS NULL THEN 'not valid JSON' WHEN t NOT IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN 'must be a JSON object or list'
    WHEN t = 'OBJECT' AND s IS NOT NULL AND s NOT IN ('ARRAY', 'VARCHAR') THEN '''snippets'' must be a list' END AS problem FROM t),
  i AS (SELECT run, CASE WHEN t = 'VARCHAR' THEN list_transform(range(length(v ->> '$')), lambda x: true) WHEN s = 'VARCHAR' THEN list_transform(range(length(v ->> '$.snippets')), lambda x: true)
    WHEN t = 'ARRAY' THEN list_transform(CAST(v AS JSON[]), lambda x: coalesce(json_type(x), 'NULL') <> 'OBJECT') WHEN s = 'ARRAY' THEN list_transform(CAST(v -> '$.snippets' AS JSON[]), lambda x: coalesce(json_type(x), 'NULL') <> 'OBJECT') END AS odd FROM t),
  e AS (SELECT run, CAST(generate_subscripts(odd, 1) - 1 AS INT) AS pos, unnest(odd) AS odd FROM i)
  SELECT * FROM w WHERE problem IS NOT NULL UNION ALL SELECT run, pos, 'snippet must be an object' FROM e WHERE odd""")
def output_problems(v: Views) -> DataFrame:
    return annotations.output_problems(v.sql(A.OUTFILES), ["run"])


# Workflows

_INPUTS = "SELECT c_custkey AS wf, CASE WHEN c_custkey % 3 = 0 THEN 'build' ELSE 'agent' END AS producer, CASE WHEN c_custkey % 5 = 0 THEN 'log' ELSE 'patch' END AS name FROM customer"
_RECORDED = "SELECT c_custkey AS wf, 'agent' AS producer, 'patch' AS name, concat('k/', c_custkey % 700) AS key FROM customer WHERE c_custkey % 7 <> 0"
_PAYLOADS = "SELECT concat('k/', p_partkey) AS key, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS content FROM part WHERE p_partkey < 600"


@query(f"""WITH i AS ({_INPUTS}), r AS ({_RECORDED}), p AS ({_PAYLOADS}) SELECT i.wf, i.producer, i.name, r.key, CASE WHEN r.key IS NULL THEN 'unrecorded' WHEN p.key IS NULL THEN 'absent' WHEN p.content = '' THEN 'empty' ELSE 'usable' END AS state
  FROM i LEFT JOIN r ON r.wf = i.wf AND r.producer = i.producer AND r.name = i.name LEFT JOIN p ON p.key = r.key""")
def resolved_inputs(v: Views) -> DataFrame:
    r = v.sql(_RECORDED).select("wf", "producer", F.create_map("name", "key").alias("artifact_keys"))
    return workflow.resolved_inputs(v.sql(_INPUTS), r, v.sql(_PAYLOADS).withColumn("content", F.col("content").cast("binary")), ["wf"])


_BINARIES = "SELECT s_suppkey AS id, concat('v', s_suppkey % 4) AS version, CASE WHEN s_suppkey % 5 = 0 THEN 'mac' ELSE 'linux' END AS platform, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('h', s_suppkey % 3) END AS sha256 FROM supplier"
_MANIFESTS = """SELECT 'v0' AS version, '{"platforms": {"linux": {"checksum": "h0"}, "mac": {"checksum": "h1"}}}' AS manifest UNION ALL SELECT 'v1', '{"platforms": {"linux": {"checksum": ""}}}' UNION ALL SELECT 'v2', '[1]'"""


@query(f"""WITH b AS ({_BINARIES}), m AS ({_MANIFESTS}), j AS (SELECT b.*, nullif(m.manifest ->> concat('$.platforms.', platform, '.checksum'), '') AS expected FROM b LEFT JOIN m ON m.version = b.version)
  SELECT *, CASE WHEN expected IS NULL THEN 'no checksum' WHEN sha256 IS NULL THEN 'absent' WHEN sha256 <> expected THEN 'mismatch' ELSE 'ok' END AS state FROM j""")
def checksum_states(v: Views) -> DataFrame:
    return workflow.checksum_state(v.sql(_BINARIES), v.sql(_MANIFESTS))


_CONTRACT = "SELECT o_orderkey AS id, concat('n', o_custkey % 4) AS d1, concat('n', o_custkey % 7) AS g1, concat('n', o_orderkey % 5) AS g2, concat('n', o_orderkey % 3) AS s1, CASE o_orderkey % 3 WHEN 0 THEN '1x' WHEN 1 THEN 'A_b' ELSE 'x-y' END AS e1 FROM orders"


@query(f"""WITH c AS ({_CONTRACT}) SELECT id, array_to_string(list_sort(list_distinct(list_filter([g1, g2], lambda x: x NOT IN (d1, 'n0')))), ',') AS undeclared, array_to_string(list_sort(list_distinct(list_filter([g1, g2], lambda x: x = s1))), ',') AS colliding,
  CASE WHEN d1 IN (g1, g2, s1) THEN '' ELSE d1 END AS missing, CASE WHEN e1 = 'A_b' THEN '' ELSE e1 END AS bad_env FROM c""")
def input_contracts(v: Views) -> DataFrame:
    found = workflow.contract_problems(F.array("d1", F.lit("n0")), F.array("d1"), F.array("g1", "g2"), F.array("s1"))
    return v.sql(_CONTRACT).select("id", *(F.array_join(c, ",").alias(k) for k, c in found.items()), F.array_join(workflow.bad_env_names(F.create_map("e1", F.lit("v"))), ",").alias("bad_env"))


_ENTRIES = """SELECT l_orderkey AS wf, CAST(l_linenumber AS BIGINT) AS pos, CASE WHEN l_partkey % 9 = 0 THEN 'inputs' WHEN l_partkey % 9 = 1 THEN 'Bad' ELSE concat('t', l_suppkey % 6) END AS key, 'patch' AS input,
  CASE l_partkey % 6 WHEN 0 THEN 'a/patch' WHEN 1 THEN 'patch' WHEN 2 THEN 'a/log' WHEN 3 THEN '/patch' ELSE 'a/patch' END AS binding, CAST(l_partkey % 5 - 1 AS DOUBLE) AS timeout, l_suppkey % 4 - 1 AS retries FROM lineitem"""


@query(f"""WITH e AS ({_ENTRIES}), n AS (SELECT *, count(*) OVER (PARTITION BY wf, key) AS same FROM e), p AS (SELECT wf, key, unnest([CASE WHEN same > 1 THEN 'duplicate key' END, CASE WHEN key = 'inputs' THEN 'reserved key' END, CASE WHEN key = 'Bad' THEN 'malformed key' END,
    CASE WHEN timeout <= 0 THEN 'timeout is not finite and positive' END, CASE WHEN retries < 0 THEN 'negative retries' END, CASE WHEN binding IN ('patch', '/patch') THEN concat('malformed binding ', binding) END, CASE WHEN binding = 'a/log' THEN 'binds undeclared log' END]) AS problem FROM n)
  SELECT DISTINCT * FROM p WHERE problem IS NOT NULL UNION ALL SELECT o_orderkey + 1, NULL, 'a workflow needs at least one entry' FROM orders WHERE o_orderkey + 1 NOT IN (SELECT wf FROM e)""")
def declaration_problems(v: Views) -> DataFrame:
    e = v.sql(_ENTRIES)
    return workflow.declaration_problems(e.withColumns({"inputs": F.array("input"), "bindings": F.array("binding")}), v.table("orders").select((F.col("o_orderkey") + 1).alias("wf")))


_SET = """SELECT l_orderkey AS wf, l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey AS pos, CASE l_partkey % 12 WHEN 0 THEN concat('--run.timeout=', l_suppkey) WHEN 1 THEN concat('--run.timeout=', l_suppkey, 'x') WHEN 2 THEN '--run.flag=yes' WHEN 3 THEN '--run.flag=maybe'
  WHEN 4 THEN concat('--run.task.model=m', l_suppkey) WHEN 5 THEN concat('--run.model=n', l_suppkey) WHEN 6 THEN concat('--lint.model=', l_suppkey) WHEN 7 THEN '--run..model=x' WHEN 8 THEN '--run.key=x' WHEN 9 THEN 'model' WHEN 10 THEN '--run.names=a,,b' ELSE '--run.nope=1' END AS arg FROM lineitem"""
_JUDGED = f"""WITH a AS ({_SET}), p AS (SELECT *, CASE WHEN arg[:2] = '--' THEN string_split(string_split(arg, '=')[1][3:], '.') END AS w FROM a),
  t AS (SELECT *, row_number() OVER (PARTITION BY wf, w ORDER BY pos) AS turn, split_part(arg, '=', 2) AS value FROM p),
  j AS (SELECT wf, pos, CASE WHEN w IS NULL THEN 'unrecognized argument' WHEN len(w) = 3 AND w[2] = '' THEN 'empty path segment' WHEN turn > 1 THEN 'overrides the same field' WHEN w[1] = 'lint' THEN 'no entry lint' WHEN w[2] = 'key' THEN 'an entry''s key is its identity' WHEN w[2] = 'nope' THEN 'nope is not a field'
    WHEN value = 'maybe' THEN 'expected true or false' WHEN w[2] = 'timeout' AND value LIKE '%x' THEN concat(value, ' is not float') END AS problem, CASE WHEN len(w) = 3 THEN w[3] ELSE w[2] END AS name, len(w) AS n, value FROM t)"""


def _overridden(v: Views) -> tuple[DataFrame, DataFrame, overrides.Declared]:
    task = F.struct(F.lit("m").alias("model"), F.lit(False).alias("flag"), F.array().cast("array<string>").alias("names"))
    e = v.table("orders").select(F.col("o_orderkey").alias("wf"), F.lit("run").alias("key"), F.lit(1.0).alias("timeout"), task.alias("task"))
    declared = overrides.Declared(e.drop("wf").schema)
    return e, overrides.judged(v.sql(_SET), e, declared, ["wf"]), declared


@query(f"{_JUDGED} SELECT wf, pos, problem FROM j")
def override_problems(v: Views) -> DataFrame:
    return _overridden(v)[1].select("wf", "pos", "problem")


@query(f"""{_JUDGED}, ok AS (SELECT * FROM j WHERE problem IS NULL), m AS (SELECT wf, max(value) FILTER (name = 'timeout') AS t, arg_max(value, n) FILTER (name = 'model') AS m, count(*) FILTER (name = 'flag') AS f, count(*) FILTER (name = 'names') AS n FROM ok GROUP BY wf)
  SELECT o_orderkey AS wf, coalesce(CAST(t AS DOUBLE), 1.0) AS timeout, coalesce(m, 'm') AS model, coalesce(f, 0) > 0 AS flag, CASE WHEN coalesce(n, 0) > 0 THEN 'a,b' ELSE '' END AS names FROM orders LEFT JOIN m ON wf = o_orderkey""")
def overridden_entries(v: Views) -> DataFrame:
    """What the arguments that stand make of the entries."""
    e, j, declared = _overridden(v)
    out = overrides.applied(e, j.where("problem is null"), declared, ["wf"])
    return out.select("wf", "timeout", "task.model", "task.flag", F.array_join("task.names", ",").alias("names"))


_STEPS = "SELECT user_id AS inst, CAST(event_id AS BIGINT) AS pos, concat('e', event_id) AS key, CASE WHEN event_id % 5 = 0 THEN 'blocked' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM events"


@query(f"""WITH s AS ({_STEPS}) SELECT inst, bool_and(status = 'succeeded') AS succeeded, count(*) AS n_entries, count(*) FILTER (status <> 'blocked') AS attempts, count(*) FILTER (status = 'blocked') AS n_missing, arg_min(key, pos) AS first_key FROM s GROUP BY inst""")
def workflow_records(v: Views) -> DataFrame:
    """The record of each workflow, read back: blocked entries have zeroed counters and name what they lacked."""
    s = v.sql(_STEPS).withColumn("missing_inputs", F.when(F.col("status") == "blocked", F.array(F.lit("patch"))))
    runs = s.where("status <> 'blocked'").select("inst", "key", F.lit(1).alias("attempts"), F.lit(False).alias("resumed"), F.create_map(F.lit("patch"), F.col("key")).alias("artifact_keys"), F.create_map(F.lit("m"), F.lit(1.0)).alias("metrics"))
    r = workflow.workflow_records(s, runs, ["inst"])
    kept = F.from_json("record", "inst bigint, succeeded boolean, entries array<struct<key:string,status:string,attempts:bigint,resumed:boolean,artifact_keys:map<string,string>,metrics:map<string,double>,missing_inputs:array<string>>>")
    e = r.select("inst", "succeeded", kept["entries"].alias("e"))
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda n, x: n + x["attempts"])
    return e.select("inst", "succeeded", F.size("e").cast("bigint").alias("n_entries"), total.alias("attempts"), F.size(F.filter("e", lambda x: F.size(x["missing_inputs"]) > 0)).cast("bigint").alias("n_missing"), F.element_at("e", 1)["key"].alias("first_key"))


@query("WITH c AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment AS a, concat('x', c_custkey % 3) AS b FROM customer) SELECT id, CASE WHEN c_nationkey % 2 = 0 THEN concat('better-', a) ELSE a END AS f2p, b AS p2p, CASE WHEN c_nationkey % 2 = 0 THEN concat('f2p:', a, '>better-', a) ELSE '' END AS changes FROM c")
def corrected_rows(v: Views) -> DataFrame:
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("inst"), F.array("c_mktsegment").alias("f2p"), F.array(F.concat(F.lit("x"), (F.col("c_custkey") % 3).cast("string"))).alias("p2p"))
    fix = v.table("customer").where("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("inst"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("better-"), "c_mktsegment").alias("better")).distinct()
    out = workflow.corrected_export(c, fix, ["f2p", "p2p"])
    told = F.transform("changes", lambda x: F.concat(x["column"], F.lit(":"), x["name"], F.lit(">"), x["better"]))
    return out.select("id", F.array_join("f2p", ",").alias("f2p"), F.array_join("p2p", ",").alias("p2p"), F.array_join(told, ",").alias("changes"))


@query(f"{_GRADED} SELECT phase, count(*) AS n, round(avg(CASE WHEN resolved THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS mean_score, count(*) FILTER (resolved) AS resolved, sum(len([f2p1, p2p1, p2p2]))::BIGINT AS n_listed FROM r GROUP BY phase")
def mean_scores(v: Views) -> DataFrame:
    g = _graded(v)
    listed = g.groupBy("phase").agg(F.sum(F.size(grading.listed_tests(F.col("f2p"), F.col("p2p")))).alias("n_listed"))
    return grading.mean_score(g, ["phase"]).join(listed, "phase").withColumn("mean_score", F.round("mean_score", 9))


@query("WITH k AS (SELECT l_orderkey AS inst, l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey * 1000000 + l_suppkey AS pos, l_suppkey FROM lineitem WHERE l_returnflag <> 'R') SELECT inst, row_number() OVER (PARTITION BY inst ORDER BY pos) AS pos, l_suppkey, 3000 + inst * 4 AS port FROM k")
def renumbered_candidates(v: Views) -> DataFrame:
    k = v.table("lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("inst"), F.expr("l_linenumber * 1000000000000L + l_partkey * 1000000 + l_suppkey").alias("pos"), "l_suppkey")
    return workflow.renumbered(k, ["inst"], "pos").withColumn("port", workflow.port(3000, F.col("inst"), 3))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["line_vote_ranges"](spark, sf_dir)

