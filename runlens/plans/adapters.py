"""Views that give the driver's tables the shapes the operators read. Both engines run them as they stand."""

from __future__ import annotations

#: Independent annotations: three runs, a few files per instance, ranges of which some are empty.
CANDIDATES = """SELECT l_orderkey AS inst, CAST(l_linenumber % 3 + 1 AS BIGINT) AS run, CAST(l_suppkey % 3 AS BIGINT) AS file,
  CAST(l_quantity AS BIGINT) AS s, CAST(l_quantity AS BIGINT) + l_partkey % 12 - 2 AS e FROM lineitem"""
RUNS = """SELECT DISTINCT l_orderkey AS inst, CAST(l_linenumber % 3 + 1 AS BIGINT) AS run FROM lineitem"""

#: Base and golden test runs with outputs absent, broken, of the wrong shape, or good.
OUTPUTS = """SELECT CAST(floor(event_id / 2) AS BIGINT) AS inst, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'golden' END AS phase,
  CASE WHEN event_id % 23 = 5 THEN 'timeout' ELSE 'success' END AS status,
  concat('a', event_id % 4) AS f2p1, concat('c', event_id % 3) AS p2p1, 'b' AS p2p2,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 17 = 1 THEN '{ this is not json' WHEN event_id % 17 = 2 THEN '[1, 2, 3]'
    ELSE concat('{"tests": [{"name": "a', event_id % 5, '", "status": "', CASE WHEN event_id % 2 = 1 OR event_id % 7 = 0 THEN 'PASSED' ELSE 'FAILED' END,
      '"}, {"name": "b", "status": "PASSED"}, {"name": "b", "status": "PASSED"}, {"name": "c', event_id % 3, '", "status": "',
      CASE WHEN event_id % 11 = 3 THEN 'FAILED' ELSE 'PASSED' END, '"}]}') END AS output,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(ts AS VARCHAR(30)) END AS stamp FROM events"""

#: The ledger: attempts of users' tasks, in order of time.
ATTEMPTS = """SELECT 's1' AS sweep, user_id AS inst, CAST(event_id % 12 AS BIGINT) AS rollout, event_type AS task,
  row_number() OVER (PARTITION BY user_id, event_id % 12, event_type ORDER BY ts, event_id) - 1 AS attempt,
  concat('ts-', CAST(floor(event_id / 1000) AS BIGINT)) AS run_ts,
  CASE WHEN value < 10 THEN 'timeout' WHEN value < 30 THEN 'run_error' ELSE 'success' END AS status,
  CASE event_id % 9 WHEN 0 THEN 'no_output' WHEN 1 THEN 'truncated' WHEN 2 THEN 'max_turns' WHEN 3 THEN 'max_budget' WHEN 4 THEN 'finished_with_api_error'
    WHEN 5 THEN 'execution_error' WHEN 6 THEN 'max_output_retries' ELSE 'finished' END AS outcome,
  event_id % 29 = 0 AS leaked, event_id % 6 <> 0 AS valid, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS resolved, value, event_id FROM events"""
MARKERS = """SELECT inst, rollout, task, CAST(1 + max(attempt) - max(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS attempts, max(run_ts) AS run_ts
  FROM attempts GROUP BY inst, rollout, task"""

#: Diffs: a created hook, test and CI files, edits, binary sections, and junk without sections.
DIFFS = """SELECT p_partkey AS run, concat('tests/unit/test_part.py::TestSuite::test_size_', p_size, '[x]') AS test,
  CASE WHEN p_partkey % 19 = 0 THEN '' WHEN p_partkey % 19 = 1 THEN concat('no diff here', chr(10)) ELSE concat(
    CASE WHEN p_size % 5 = 0 THEN concat('diff --git a/conftest.py b/conftest.py', chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/conftest.py', chr(10), '@@ -0,0 +1 @@', chr(10), '+import os', chr(10)) ELSE '' END,
    'diff --git a/src/', lower(p_type), '.py b/src/', lower(p_type), '.py', chr(10), '--- a/src/part', p_size, '.py', chr(10), '+++ b/src/part', p_size, '.py', chr(10), '@@ -1 +1 @@', chr(10), '-', p_name, chr(10),
    '+', CASE WHEN p_partkey % 4 = 0 THEN concat('if name == "test_size_', p_size, '": return') ELSE p_name END, chr(10),
    CASE WHEN p_size % 3 = 0 THEN concat('diff --git a/tests/test_', p_size, '.py b/tests/test_', p_size, '.py', chr(10), '--- a/tests/test_', p_size, '.py', chr(10), '+++ b/tests/test_', p_size, '.py', chr(10), '+assert True', chr(10)) ELSE '' END,
    CASE WHEN p_size % 7 = 0 THEN concat('diff --git a/logo.png b/logo.png', chr(10), 'Binary files a/logo.png and b/logo.png differ', chr(10)) ELSE '' END,
    CASE WHEN p_size % 11 = 0 THEN concat('diff --git a/.github/workflows/ci.yml b/.github/workflows/ci.yml', chr(10), '--- a/.github/workflows/ci.yml', chr(10), '+++ b/.github/workflows/ci.yml', chr(10), '+on: push', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 8 = 3 THEN concat('diff --git a/my hook.pth b/my hook.pth', chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/my hook.pth', chr(9), chr(10), '+import os', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 6 = 1 THEN concat('diff --git a/notes.txt b/notes.txt', chr(10), 'Binary files are listed below', chr(10), '--- a/notes.txt', chr(10), '+++ b/notes.txt', chr(10), '+x', chr(10)) ELSE '' END) END AS diff FROM part"""

#: Gold files and annotated files of instances, some of each missing.
GOLD = """SELECT ps AS inst, concat(CASE x % 9 WHEN 0 THEN 'docs/' WHEN 1 THEN 'src/locale/' WHEN 2 THEN 'vendor/' ELSE 'src/' END, 'f', x % 6,
  CASE x % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.pb.go' WHEN 2 THEN '.json' ELSE '.py' END) AS path FROM (SELECT l_orderkey AS ps, l_partkey AS x FROM lineitem) g"""
ANNOTATED = """SELECT l_orderkey AS inst, concat('src/f', l_suppkey % 6, '.py') AS path FROM lineitem WHERE l_orderkey % 5 <> 0"""
NEW = """SELECT DISTINCT l_orderkey AS inst, concat('src/f', l_linenumber % 6, '.py') AS path FROM lineitem WHERE l_linenumber % 4 = 0"""

#: Shell commands and talk of agents, some of them suspicious.
BLOCKS = """SELECT conv_id, CAST(turn AS BIGINT) AS pos, CASE WHEN turn % 2 = 1 THEN 'tool_use' ELSE 'text' END AS type,
  CASE WHEN turn % 2 = 1 THEN CASE (conv_id + turn) % 12 WHEN 0 THEN 'git status && git log --all' WHEN 1 THEN 'git show abc123; ls' WHEN 2 THEN 'git log -n 5 | cat'
    WHEN 3 THEN 'curl -s https://x.test/fix.patch' WHEN 4 THEN 'pip install git+https://x.test/y' WHEN 5 THEN 'git diff --stat -- src/a.py' WHEN 6 THEN 'git blame src/a.py'
    WHEN 7 THEN 'git checkout -- f' WHEN 8 THEN 'git fetch origin' WHEN 9 THEN 'sudo git log' ELSE 'grep -r x .' END END AS command,
  CASE WHEN turn % 2 = 0 THEN concat(text, CASE (conv_id + turn) % 5 WHEN 0 THEN ' I found the fix, and the commit shows it.' WHEN 1 THEN ' See the upstream patch.' ELSE '' END) END AS text FROM conversations"""

#: Event streams, a JSON object a line, with junk between them and every kind of ending.
STREAMS = """SELECT conv_id, concat('{"type":"system","n":', n, '}', chr(10), chr(10), 'not json', chr(10), '[1]', chr(10),
    '{"type":"user","message":{"role":"user","content":"hello ', n, '"}}', chr(10),
    '{"type":"assistant","message":{"role":"assistant","model":"m', n % 3, '","content":[{"type":"text","text":"t"},{"type":"thinking","thinking":"why"},{"type":"image"},',
    '{"type":"tool_use","id":"u1","name":"Bash","input":{"command":"ls"}}]}}', chr(10),
    '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"u1","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}}', chr(10),
    CASE conv_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat('{"type":"result","subtype":"success","is_error":true}', chr(10)) WHEN 2 THEN concat('{"type":"result","subtype":"error_max_turns"}', chr(10))
      WHEN 3 THEN concat('{"type":"result","subtype":"error_new"}', chr(10)) WHEN 4 THEN concat('{"type":"result","subtype":"error_max_budget_usd","is_error":true}', chr(10))
      ELSE concat('{"type":"result","subtype":"error_max_turns"}', chr(10), '{"type":"result","subtype":"success","is_error":false}', chr(10)) END) AS raw,
  conv_id % 8 AS kind FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c"""

#: Sessions whose texts name their user, in values at several depths and in keys: null for a run without a trace file, junk, results without a duration.
SESSIONS = """SELECT conv_id, n, CASE conv_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'no event here' ELSE concat('{"type":"system","cwd":"/home/max"}', chr(10), 'junk', chr(10),
    '{"type":"user","message":{"role":"user","id":"u', n, '","content":"see /home/max/x', n, ' of max', CASE WHEN conv_id % 3 = 0 THEN concat(chr(92), 'nGit user: Some One', chr(92), 'nrest ', chr(92), '"', n, chr(92), '"') ELSE '' END, '"}}', chr(10),
    '{"type":"assistant","message":{"role":"assistant","model":"m', n % 3, '","usage":{"max_tokens":', n, ',"by":"max"},"content":[{"type":"tool_use","name":"Read","input":{"max":{"path":["/home/max/y', n, '"]}}}]}}', chr(10),
    '{"type":"assistant","message":null}', chr(10),
    CASE WHEN conv_id % 4 = 0 THEN '' ELSE concat('{"type":"result","subtype":"', CASE WHEN conv_id % 4 = 1 THEN 'error_max_turns' ELSE 'success' END, '","is_error":', CASE WHEN conv_id % 7 = 0 THEN '"yes"' ELSE 'false' END,
      CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat(',"duration_ms":', n * 1500) END, ',"result":"The user''s email address is me@here.org now"}', chr(10)) END) END AS raw
  FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c"""

#: Purge reports: present, absent, and with every kind of defect.
REPORTS = """SELECT o_orderkey AS run, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('{"purged": ', CASE WHEN o_orderkey % 7 = 0 THEN 'false' ELSE 'true' END,
  ', "before": {"future_commits": ', o_custkey % 3, '}, "after": {"future_commits": ', CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END,
  CASE o_orderkey % 4 WHEN 0 THEN ', "base_reachable": true' WHEN 1 THEN ', "base_reachable": null' WHEN 2 THEN ', "base_reachable": false' ELSE '' END,
  CASE WHEN o_orderkey % 6 = 0 THEN ', "solution_reachable": true' ELSE '' END, '}', CASE WHEN o_orderkey % 17 = 0 THEN ', "violations": ["v1", "v2"]' ELSE '' END, '}') END AS report FROM orders"""

ERRORS = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'Claimed: Usage Limit reached, resets at 5' WHEN 2 THEN 'HTTP 529 Overloaded' WHEN 3 THEN 'TypeError: x'
  WHEN 4 THEN concat('connection lost after quota at ', c_name) WHEN 5 THEN concat('  ', chr(10)) WHEN 6 THEN '401 authentication_error' WHEN 7 THEN concat('fatal: ', c_name) ELSE 'timed out' END AS err,
  CASE WHEN c_custkey % 4 = 0 THEN concat(' ', c_mktsegment, ' ') ELSE '' END AS result FROM customer"""

TEXTS = """SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN concat(chr(10), 'Git user: Some One', chr(10), 'end') WHEN 1 THEN ' The user''s email address is me@here.org now /home/me/x' ELSE '' END) AS text FROM documents"""

MANIFEST = """SELECT concat('t/', doc_id) AS rel, CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE sha256_text END AS sha256 FROM hashed WHERE doc_id % 3 <> 0"""
FILES = """SELECT concat('t/', doc_id) AS rel, sha256_text AS sha256 FROM hashed WHERE doc_id % 7 <> 0"""

COSTS = """SELECT CASE WHEN d.doc_id % 13 <> 0 THEN d.lang END AS lang, d.doc_id AS inst, CASE WHEN d.doc_id % 11 = 0 THEN 'failed' END AS error, l.quality = 1 AS valid, CAST(d.n_chars AS BIGINT) AS cost,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.n_chars * 2 END AS input, d.doc_id % 100 AS cache_creation, CASE WHEN d.doc_id % 2 = 0 THEN 7 END AS cache_read, d.n_chars AS output
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
TIMES = """SELECT o_custkey AS inst, o_totalprice / 1000 AS wall, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 - o_orderkey % 400 END AS active FROM orders"""

SNIPPETS = """SELECT l_orderkey AS inst, l_linenumber AS n, CASE l_partkey % 11 WHEN 0 THEN '{ bad' WHEN 1 THEN '{"snippets": "abc"}' ELSE concat(CASE WHEN l_suppkey % 2 = 0 THEN '[' ELSE '{"snippets": [' END,
  '{"file_path": "f', l_suppkey % 4, '", ', CASE WHEN l_partkey % 11 = 2 THEN '' ELSE concat('"start_line": ', CASE WHEN l_partkey % 11 = 3 THEN '" 3 "' WHEN l_partkey % 11 = 4 THEN '7.0' WHEN l_partkey % 11 = 5 THEN 'true' ELSE CAST(l_partkey % 40 - 1 AS VARCHAR(9)) END, ', ') END,
  '"end_line": ', CAST(l_quantity AS BIGINT), ', "category": ', CASE l_partkey % 11 WHEN 6 THEN '"odd"' WHEN 7 THEN 'null' ELSE '"core"' END, '}, 5', CASE WHEN l_suppkey % 2 = 0 THEN ']' ELSE ']}' END) END AS output FROM lineitem"""

#: Output files: absent, broken, of a wrong shape, with items that are no objects, and good.
OUTFILES = """SELECT o_orderkey AS run, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '{ bad' WHEN 2 THEN '7' WHEN 3 THEN '"ab"' WHEN 4 THEN '{"snippets": 3}' WHEN 5 THEN '{"snippets": "xyz"}' WHEN 6 THEN concat('[{"a": ', o_custkey, '}, 5, "t"]')
  WHEN 7 THEN '{"other": 1}' WHEN 8 THEN '{"snippets": [null, {}, []]}' ELSE '[]' END AS output FROM orders"""

#: Proxy logs: a broken line, then the record of a session with secrets and identities in it.
PROXY = """SELECT c_custkey AS id, concat('not json', chr(10), '{"request": {"headers": {', CASE WHEN c_custkey % 3 = 0 THEN '"Authorization": "Bearer s", ' ELSE '' END, '"X-App": "a', c_custkey % 4, '"}, "body": {"model": "m', c_custkey % 3, '", "max_tokens": ', c_custkey,
    ', "system": "Git user: Jane Roe', chr(92), 'nrest ', c_custkey, '", "metadata": {', CASE WHEN c_custkey % 2 = 0 THEN '"user_id": "u"' ELSE '"user_id": "u", "k": 1' END, '}, "messages": [{"role": "user", "content": "see /home/me/x', c_custkey, ' of jane@roe.example ok ', chr(92), '"', c_custkey, chr(92), '""}',
    CASE WHEN c_custkey % 4 = 0 THEN ', {"role": "developer", "content": "x"}, {"role": "assistant", "content": []}' ELSE '' END, ']}}, "response": {', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '"message": {"role": "assistant", "content": [{"type": "text", "text": "done"}]}, ' END, '"status": 200}',
    CASE WHEN c_custkey % 2 = 0 THEN ', "complete": true' ELSE '' END, '}', chr(10)) AS raw FROM customer"""

NAMES = """SELECT CAST(item_id AS BIGINT) AS inst, substring(text, 1, 40) AS name FROM benchmark"""
PASSED = """SELECT b.item_id AS inst, CASE WHEN k = 0 THEN b.text ELSE concat(substring(b.text, 1, 30 + 7 * k), '!') END AS test FROM benchmark b, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE b.item_id % 3 < 3 - CASE WHEN k = 2 THEN 1 ELSE 0 END"""

IDS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN concat('instance_x-v', c_custkey) ELSE concat('instance_x__y-', substring(md5(c_name), 1, 32), 'abcdef01', CASE WHEN c_custkey % 2 = 0 THEN '-vnan' ELSE '' END) END AS inst,
  CASE c_custkey % 3 WHEN 0 THEN concat('"**', c_name, '**', chr(92), 'n', chr(92), 'nBody"') WHEN 1 THEN concat('"', c_name) ELSE c_name END AS statement,
  concat('git checkout a', chr(10), 'git checkout ', c_custkey, chr(10)) AS script FROM customer"""
