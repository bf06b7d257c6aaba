"""Queries that follow a run step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import detect
from quillspan.operators import assembly, spans, trace as ops
from quillspan.plans.base import AGENTS, NOW, TIER, now, register


def _calls(x):
    return x.events.where("kind = 'tool-call'").selectExpr("*", "CASE WHEN seq % 13 = 0 THEN '{\"x\":' ELSE concat('{\"b\": ', CAST(floor(seq / 3) AS BIGINT) % 2, ', \"a\" : \"', tool, ' x\"}') END AS arguments")


_STEPS = """steps AS (SELECT seq, session_id, agent_id, CASE WHEN coalesce(tool, '') = '' OR coalesce(tool_use_id, '') = '' THEN 'missing-call-identity' WHEN seq % 13 = 0 THEN 'unsupported-arguments' ELSE 'known' END AS state,
    CASE WHEN coalesce(tool, '') <> '' AND coalesce(tool_use_id, '') <> '' AND seq % 13 > 0 THEN sha256('step' || chr(10) || tool || chr(10) || '{"b":' || (seq // 3 % 2) || ',"a":"' || tool || ' x"}') END AS signature FROM agent_events WHERE kind = 'tool-call')"""
register("trace_steps", lambda x: ops.trace_steps(_calls(x)), "SELECT * FROM steps", _STEPS)


def _runs(x):
    """Agents with a task, an outcome and an end."""
    return x.events.where("agent_id <> ''").groupBy("session_id", "agent_id").agg(F.max("ts").alias("ended_at"), F.count_if("error").alias("errors")).selectExpr(
        "session_id", "agent_id", "ended_at", "CASE WHEN agent_id = 'main' THEN NULL ELSE concat('task', session_id % 5) END AS task_hash", "CASE WHEN errors > 2 THEN 'failed' WHEN errors = 0 THEN 'succeeded' ELSE 'stalled' END AS outcome"
    )


_RUNS = """runs_of AS (SELECT session_id, agent_id, max(ts) AS ended_at, CASE WHEN agent_id = 'main' THEN NULL ELSE 'task' || (session_id % 5) END AS task_hash, CASE WHEN count(*) FILTER (WHERE error) > 2 THEN 'failed' WHEN count(*) FILTER (WHERE error) = 0 THEN 'succeeded' ELSE 'stalled' END AS outcome
    FROM agent_events WHERE agent_id <> '' GROUP BY 1, 2),
div_pairs AS (SELECT c.session_id AS left_session, c.agent_id AS left_agent, g.session_id AS right_session, g.agent_id AS right_agent FROM (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS helpers FROM runs_of WHERE task_hash IS NOT NULL) WHERE outcome IN ('failed', 'stalled') OR helpers = 1
        QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY CASE outcome WHEN 'failed' THEN 0 WHEN 'stalled' THEN 1 ELSE 2 END, agent_id) = 1) c
    JOIN (SELECT * FROM runs_of WHERE outcome = 'succeeded' AND task_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_hash, session_id ORDER BY ended_at DESC NULLS LAST, agent_id DESC) = 1) g ON g.task_hash = c.task_hash AND g.session_id <> c.session_id
    QUALIFY row_number() OVER (PARTITION BY c.session_id, c.agent_id ORDER BY g.ended_at DESC NULLS LAST, g.session_id) = 1)"""
register("divergence_pairs", lambda x: ops.divergence_pairs(_runs(x)), "SELECT * FROM div_pairs", _RUNS)
# Alignment is a search for the best path, which SQL does not express; tests hold it against brute force.
register("aligned_runs", lambda x: ops.align_runs(ops.trace_steps(_calls(x)), ops.divergence_pairs(_runs(x))))
# A counter that a result resets runs through an agent's events in order; tests hold it against a plain loop.
register("retries", lambda x: ops.retries(x.events))
register(
    "sparklines",
    lambda x: ops.sparklines(x.events).selectExpr("session_id", "agent_id", "array_join(heights, ',') AS heights"),
    """SELECT a.session_id, a.agent_id, string_agg(CAST(CAST(round(coalesce(n, 0) * 100 / most) AS INT) AS VARCHAR), ',' ORDER BY r.i) AS heights FROM (SELECT session_id, agent_id, max(n) AS most FROM slices GROUP BY 1, 2) a CROSS JOIN range(24) r(i)
    LEFT JOIN slices s ON s.session_id = a.session_id AND s.agent_id = a.agent_id AND s.i = r.i GROUP BY 1, 2""",
    """slices AS (SELECT session_id, agent_id, CAST(least(23, (t - t0) * 24 // span) AS BIGINT) AS i, count(*) AS n FROM (SELECT session_id, agent_id, epoch_us(ts) // 1000 AS t FROM agent_events WHERE agent_id <> '' AND ts IS NOT NULL)
        JOIN (SELECT session_id, agent_id, min(epoch_us(ts) // 1000) AS t0, greatest(max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000), 1) AS span FROM agent_events WHERE agent_id <> '' AND ts IS NOT NULL GROUP BY 1, 2) USING (session_id, agent_id) GROUP BY 1, 2, 3)""",
)
register(
    "state_at",
    lambda x: ops.state_at(x.events, F.col("seq") < 600),
    "SELECT session_id, agent_id, count(*) AS events, count(*) FILTER (WHERE kind = 'tool-call') AS calls, count(*) FILTER (WHERE error) AS errors, arg_max(struct_pack(t := ts), seq).t AS last_at FROM agent_events WHERE seq < 600 AND agent_id <> '' GROUP BY 1, 2",
)


def _scripts(x):
    """Events whose tools edit scripts and whose results complain of them, by seq."""
    tool = "CASE WHEN kind = 'tool-call' THEN CASE seq % 3 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Write' ELSE 'Read' END END"
    text = "CASE WHEN kind = 'tool-call' THEN concat('{\"file_path\":\"a', CASE WHEN seq % 4 = 0 THEN '.py' ELSE '.mjs' END, '\"}') ELSE concat('at x.js ', CASE seq % 5 WHEN 0 THEN 'SyntaxError: Unexpected token' WHEN 1 THEN 'Unexpected identifier' ELSE 'fine' END) END"
    return x.events.drop("tool", "text").selectExpr("*", f"{tool} AS tool", f"{text} AS text")


_HOOKS = """hooks AS (SELECT session_id, bool_or(edit) AS edited, count(*) FILTER (WHERE complaint AND after) AS errors FROM (SELECT *, coalesce(bool_or(edit) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after
    FROM (SELECT session_id, seq, kind = 'tool-call' AND seq % 3 < 2 AND seq % 4 > 0 AS edit, kind = 'tool-result' AND seq % 5 < 2 AS complaint FROM agent_events)) GROUP BY 1)"""
register("hook_evidence", lambda x: ops.hook_evidence(_scripts(x)), "SELECT * FROM hooks", _HOOKS)
register(
    "hook_summary",
    lambda x: ops.hook_summary(ops.hook_evidence(_scripts(x))),
    "SELECT *, edited >= 5 AND with_errors > 0 AS proposed FROM (SELECT count(*) AS sessions, count(*) FILTER (WHERE edited) AS edited, count(*) FILTER (WHERE edited AND errors > 0) AS with_errors, CAST(coalesce(sum(errors) FILTER (WHERE edited AND errors > 0), 0) AS BIGINT) AS errors FROM hooks)",
    _HOOKS,
)
register("hook_examples", lambda x: ops.hook_examples(ops.hook_evidence(_scripts(x))), "SELECT session_id, errors FROM hooks WHERE edited AND errors > 0 ORDER BY errors DESC, session_id LIMIT 6", _HOOKS)
register(
    "model_hook_summary",
    lambda x: ops.model_hook_summary(x.usage),
    """SELECT CASE WHEN u = 0 THEN 'attributed' WHEN u = n THEN 'unattributed' ELSE 'partly-attributed' END AS state, count(*) AS sessions, CAST(sum(u) AS BIGINT) AS observations FROM (SELECT session_id, count(*) FILTER (WHERE trim(model) = '') AS u, count(*) AS n FROM usage GROUP BY 1) GROUP BY 1""",
)


def _spawns(x):
    """Tool spans as spawns whose structured child id is that of the next session, or of none."""
    child = "CASE session_id % 4 WHEN 2 THEN concat('n', session_id + 1) WHEN 3 THEN '' ELSE concat('n', session_id + 2) END"
    return spans.tool_spans(x.events).selectExpr("seq", "session_id", "state AS span_state", f"{child} AS child_native_id")


def _one_place(x):
    return x.tables.sessions.withColumns({"machine_id": F.lit("m"), "provider": F.lit("p")})


register(
    "delegation_children",
    lambda x: ops.delegation_children(_spawns(x), _one_place(x)),
    """SELECT p.seq, p.session_id, CASE WHEN span_state <> 'matched' THEN 'call-result-' || span_state WHEN child = '' THEN 'missing-child-identity' WHEN s.id IS NULL THEN 'missing-parent-identity' WHEN t.n > 1 THEN 'ambiguous-parent' WHEN c.n IS NULL THEN 'child-not-indexed-or-parent-mismatch' WHEN c.n > 1 THEN 'ambiguous-child'
        ELSE 'resolved' END AS state, CASE WHEN span_state = 'matched' AND child <> '' AND t.n = 1 AND c.n = 1 THEN c.id END AS child
    FROM (SELECT seq, session_id, state AS span_state, CASE session_id % 4 WHEN 2 THEN 'n' || (session_id + 1) WHEN 3 THEN '' ELSE 'n' || (session_id + 2) END AS child FROM spans) p LEFT JOIN sessions s ON s.id = p.session_id LEFT JOIN (SELECT native_id, count(*) AS n FROM sessions GROUP BY 1) t ON t.native_id = s.native_id
    LEFT JOIN (SELECT parent_native_id, native_id, count(*) AS n, min(id) AS id FROM sessions WHERE parent_native_id <> '' GROUP BY 1, 2) c ON c.parent_native_id = s.native_id AND c.native_id = p.child""",
)
_AT = "2024-01-25 12:00:00"
_RECENT = "CAST(TIMESTAMP{z} '{at}' AS TIMESTAMP{z}) - INTERVAL 1 SECOND * (id % 1500)"


def _recent_sessions(x):
    return x.tables.sessions.drop("last_activity").selectExpr("*", f"TIMESTAMP_NTZ '{_AT}' - make_dt_interval(0, 0, 0, id % 1500) AS last_activity")


def _recent_events(x):
    return x.events.drop("ts").selectExpr("*", f"TIMESTAMP_NTZ '{_AT}' - make_dt_interval(0, 0, 0, seq % 700) AS ts")


register(
    "recent_runs",
    lambda x: ops.recent_runs(_recent_sessions(x), x.tables.sources.withColumn("modified_at", F.lit("2024-01-25 11:00:00").cast("timestamp_ntz")), _recent_events(x), F.lit(_AT).cast("timestamp_ntz")),
    f"""SELECT r.session_id, machine_id, last_activity, active, synced, CASE WHEN synced AND coalesce(known, true) THEN coalesce(late, false) AND active END AS stalled
    FROM (SELECT s.id AS session_id, s.machine_id, TIMESTAMP '{_AT}' - INTERVAL 1 SECOND * (s.id % 1500) AS last_activity, s.id % 1500 < 600 AS active, so.durable_offset = so.indexed_offset AS synced FROM sessions s JOIN log_sources so ON so.source_id = s.source_id WHERE s.id % 1500 <= 1200) r
    LEFT JOIN (SELECT session_id, bool_and(named AND calls <= 1 AND results <= 1) AS known, bool_or(named AND calls = 1 AND results = 0 AND age > 120) AS late FROM (SELECT session_id, agent_id, tool_use_id, coalesce(tool_use_id, '') <> '' AS named, count(*) FILTER (WHERE kind = 'tool-call') AS calls,
        count(*) FILTER (WHERE kind = 'tool-result') AS results, min(seq % 700) FILTER (WHERE kind = 'tool-call') AS age FROM agent_events WHERE kind IN ('tool-call', 'tool-result') AND seq % 700 <= 600 GROUP BY ALL) GROUP BY 1) k USING (session_id)""",
)
register(
    "live_agents",
    lambda x: ops.live_agents(_recent_events(x).where("agent_id <> ''").groupBy((F.col("session_id") % 9).alias("session_id"), F.concat("agent_id", F.lit("/"), "session_id").alias("agent_id")).agg(F.max("ts").alias("last_at"), F.expr("max(seq) % 5 = 0").alias("stuck")), F.lit(_AT).cast("timestamp_ntz")),
    f"""SELECT session_id, agent_id, last_at, live FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS live, row_number() OVER (PARTITION BY session_id ORDER BY last_at DESC, agent_id) AS n FROM (SELECT session_id % 9 AS session_id, agent_id || '/' || session_id AS agent_id, max(TIMESTAMP '{_AT}' - INTERVAL 1 SECOND * (seq % 700)) AS last_at, max(seq) % 5 = 0 AS stuck
        FROM agent_events WHERE agent_id <> '' GROUP BY agent_events.session_id, agent_events.agent_id) WHERE last_at > TIMESTAMP '{_AT}' - INTERVAL 10 MINUTE AND NOT stuck) WHERE n <= 6""",
)
register(
    "chunk_gaps",
    lambda x: ops.chunk_gaps(x.events.selectExpr("source_id", "seq * 100 AS offset", "CASE WHEN seq % 3 = 0 THEN 50 ELSE 100 END AS length").where("offset % 700 <> 0")),
    "SELECT source_id, \"offset\", expected FROM (SELECT *, coalesce(lag(\"offset\" + length) OVER (PARTITION BY source_id ORDER BY \"offset\"), 0) AS expected FROM (SELECT source_id, seq * 100 AS \"offset\", CASE WHEN seq % 3 = 0 THEN 50 ELSE 100 END AS length FROM agent_events) WHERE \"offset\" % 700 <> 0) WHERE \"offset\" <> expected",
)
_INPUT = "CASE seq % 4 WHEN 0 THEN '{\"command\":\"cd x && git push\"}' WHEN 1 THEN '{\"file_path\":\"/w/src/a.ts\"}' WHEN 2 THEN '{\"url\":\"https://docs.example.com/x\"}' ELSE '{}' END"
_TOOL = "CASE seq % 4 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'WebFetch' ELSE 'Bash' END"
for _name, _rule, _covers in (
    ("command", "Bash(git:*)", "CASE seq % 4 WHEN 0 THEN true WHEN 3 THEN NULL ELSE false END"),
    ("path", "Read(src/**)", "seq % 4 = 1"),
    ("domain", "WebFetch(domain:example.com)", "seq % 4 = 2"),
):
    register(
        f"permission_preview_{_name}",
        lambda x, rule=_rule: ops.permission_preview(ops.recent_calls(x.events.drop("tool").selectExpr("*", f"{_TOOL} AS tool", f"{_INPUT} AS input"), 100), rule),
        f"""SELECT seq, session_id, {_TOOL} AS tool, CASE seq % 4 WHEN 0 THEN 'command' WHEN 1 THEN 'path' WHEN 2 THEN 'url' END AS argument_kind, CASE seq % 4 WHEN 0 THEN 'cd x && git push' WHEN 1 THEN '/w/src/a.ts' WHEN 2 THEN 'https://docs.example.com/x' END AS argument, {_covers} AS covered
        FROM agent_events WHERE kind = 'tool-call' ORDER BY seq DESC LIMIT 100""",
    )
#: A written rule of three readable lines and one that is conditional.
RULES = "never use tool1\nalways run tool2 before tool3\nscout / builder must use sonnet\nnever use tool4 unless asked\n"
_CLAUSES = detect.read_rules(RULES, {f"tool{i}": f"tool{i}" for i in range(6)})[0]
_RANK = f"CASE {TIER} WHEN 'cheap' THEN 0 WHEN 'mid' THEN 1 WHEN 'premium' THEN 2 WHEN 'flagship' THEN 3 END"
_TIER_ROW = lambda i, role: f"""SELECT {i} AS clause, 'tier' AS kind, '{role}' AS a, 'mid' AS b, count(*) FILTER (WHERE known) AS applicable, count(*) FILTER (WHERE known AND bad) AS broken, count(*) FILTER (WHERE NOT known) AS unjudged
    FROM (SELECT session_id, bool_or(coalesce({_RANK} > 1, false)) AS bad, bool_or({_RANK} IS NOT NULL) AS known FROM agents WHERE name LIKE '{role}%' GROUP BY 1)"""  # noqa: E731
register(
    "rule_report",
    lambda x: ops.rule_report(_CLAUSES, x.events, x.agents),
    f"""SELECT *, applicable >= 3 AS enough FROM (SELECT 0 AS clause, 'ban' AS kind, 'tool1' AS a, 'tool1' AS b, count(*) AS applicable, count(*) FILTER (WHERE bad) AS broken, CAST(0 AS BIGINT) AS unjudged FROM (SELECT session_id, bool_or(tool = 'tool1') AS bad FROM agent_events WHERE kind = 'tool-call' GROUP BY 1)
    UNION ALL SELECT 1, 'order', 'tool2', 'tool3', count(*), count(*) FILTER (WHERE bad), 0 FROM (SELECT session_id, bool_or(NOT seen) AS bad FROM (SELECT *, coalesce(bool_or(tool = 'tool2') OVER (PARTITION BY session_id, agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen
        FROM agent_events WHERE kind = 'tool-call' AND tool IN ('tool2', 'tool3')) WHERE tool = 'tool3' GROUP BY 1) UNION ALL {_TIER_ROW(2, "scout")} UNION ALL {_TIER_ROW(3, "builder")})""",
    *AGENTS,
)


def _helpers(x):
    return x.events.where("agent_id <> '' AND agent_id <> 'main'").groupBy("session_id", F.concat("agent_id", F.lit("-x")).alias("agent_id")).agg(F.min("ts").alias("first_at"))


register(
    "spawn_pairs",
    lambda x: ops.spawn_pairs(_helpers(x), x.events.where("kind = 'tool-call' AND seq % 3 > 0").selectExpr("session_id", "concat('c', lpad(seq, 9, '0')) AS call_id", "CASE WHEN seq % 5 = 1 THEN concat('agent-', seq % 3) ELSE '' END AS child_id", "ts")),
    """SELECT session_id, agent_id, call_id, CASE WHEN n IS NULL THEN 'id' WHEN call_id IS NULL THEN 'none' ELSE 'order' END AS "by" FROM (SELECT session_id, agent_id, call_id, NULL AS n FROM exact UNION ALL BY NAME
        SELECT r.session_id, r.agent_id, f.call_id, r.n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_at NULLS FIRST, agent_id) AS n FROM helpers WHERE (session_id, agent_id) NOT IN (SELECT (session_id, agent_id) FROM exact)) r
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, call_id) AS n FROM spawns WHERE (session_id, call_id) NOT IN (SELECT (session_id, call_id) FROM exact)) f ON f.session_id = r.session_id AND f.n = r.n)""",
    "helpers AS (SELECT session_id, agent_id || '-x' AS agent_id, min(ts) AS first_at FROM agent_events WHERE agent_id <> '' AND agent_id <> 'main' GROUP BY agent_events.session_id, agent_events.agent_id)",
    "spawns AS (SELECT session_id, 'c' || lpad(CAST(seq AS VARCHAR), 9, '0') AS call_id, CASE WHEN seq % 5 = 1 THEN 'agent-' || (seq % 3) ELSE '' END AS child_id, ts FROM agent_events WHERE kind = 'tool-call' AND seq % 3 > 0)",
    "exact AS (SELECT h.session_id, h.agent_id, arg_min(s.call_id, struct_pack(t := coalesce(s.ts, TIMESTAMP '0001-01-01'), c := s.call_id)) AS call_id FROM helpers h JOIN spawns s ON s.session_id = h.session_id AND s.child_id <> '' AND starts_with(h.agent_id, s.child_id) GROUP BY 1, 2)",
)


def _results(x):
    """Tool calls with the records of their results: well formed ones, other calls' and sessions', repeated keys at several depths, JSON in a text, and prose."""
    record = """CASE seq % 11
        WHEN 0 THEN concat('{"type":"user","sessionId":"n', session_id, '","message":{"content":[{"type":"text","text":"x"},{"type":"tool_result","tool_use_id":"c', seq, '"}]},"toolUseResult":{"agentId":"a', seq, '"}}')
        WHEN 1 THEN concat('{"type":"user","sessionId":"n', session_id, '","message":{"content":[{"type":"tool_result","tool_use_id":"c', seq, '"},{"type":"tool_result","tool_use_id":"c', seq, '"}]},"toolUseResult":{"agentId":"a"}}')
        WHEN 2 THEN concat('{"type":"user","sessionId":"other","message":{"content":[{"type":"tool_result","tool_use_id":"c', seq, '"}]},"toolUseResult":{"agentId":"a"}}')
        WHEN 3 THEN concat('{"type":"user","sessionId":"n', session_id, '","message":{"content":[{"type":"tool_result","tool_use_id":"c', seq, '"}]},"toolUseResult":{"agentId":"a","agentId":"b"}}')
        WHEN 4 THEN concat('{"type":"user","sessionId":"n', session_id, '","message":{"content":[{"type":"tool_result","tool_use_id":"c', seq, '","note":{"k":1,"k":2}}]},"toolUseResult":{"agentId":"a', seq, '"}}')
        WHEN 5 THEN concat('{"type":"user","type":"user","sessionId":"n', session_id, '"}')
        WHEN 6 THEN concat('{"type":"response_item","payload":{"type":"function_call_output","call_id":"c', seq, '","output":"{\\\\"agent_id\\\\":\\\\"t', seq, '\\\\"}"}}')
        WHEN 7 THEN concat('{"type":"response_item","payload":{"type":"function_call_output","call_id":"c', seq, '","output":{"agent_id":"t', seq, '"}}}')
        WHEN 8 THEN concat('{"type":"response_item","payload":{"type":"function_call_output","call_id":"c', seq, '","output":"{\\\\"agent_id\\\\":\\\\"t\\\\",\\\\"agent_id\\\\":\\\\"u\\\\"}"}}')
        WHEN 9 THEN concat('{"type":"response_item","payload":{"type":"function_call_output","call_id":"c', seq, '","output":"the agent is t9"}}')
        ELSE concat('{"type":"response_item","payload":{"type":"function_call_output","call_id":"d', seq, '","output":{"agent_id":"t"}}}') END"""
    return x.events.where("kind = 'tool-call'").selectExpr("seq", "session_id", "concat('c', seq) AS call_id", "concat('n', session_id) AS native_id", "'main' AS agent_id", "CASE WHEN seq % 11 < 6 THEN 'messages' ELSE 'rollout' END AS provider_kind", f"{record} AS record")


register(
    "spawned_children",
    lambda x: ops.spawned_children(_results(x)).select("seq", "session_id", "child_state", "child_native_id"),
    """SELECT seq, session_id, CASE WHEN seq % 11 IN (0, 4, 6, 7) THEN 'known' WHEN seq % 11 IN (1, 2, 5, 10) THEN 'source-record-mismatch' ELSE 'unsupported-result' END AS child_state,
    CASE WHEN seq % 11 IN (0, 4) THEN 'a' || seq WHEN seq % 11 IN (6, 7) THEN 't' || seq END AS child_native_id FROM agent_events WHERE kind = 'tool-call'""",
)


def _files(x):
    """Each session's events as those of a main file and two helpers' files; some have no time, many the same."""
    events = x.events.selectExpr("seq", "session_id", "concat('f', session_id, '-', seq % 3) AS source_id", "struct(seq AS line) AS at", "0 AS place", "agent_id", "CASE WHEN seq % 17 > 0 THEN date_trunc('hour', ts) END AS ts")
    files = events.select("source_id", "session_id").distinct().selectExpr("source_id", "session_id", "CASE WHEN source_id LIKE '%-0' THEN 'main' ELSE 'subagent' END AS kind", "concat('sub:', source_id) AS agent_id")
    return events.drop("session_id"), files


register(
    "assembled_sessions",
    lambda x: assembly.assemble(*_files(x)).selectExpr("seq", "session_id", "agent_id", "global_seq"),
    """SELECT seq, session_id, CASE WHEN seq % 3 = 0 THEN agent_id ELSE 'sub:f' || session_id || '-' || (seq % 3) END AS agent_id,
    row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN seq % 17 > 0 THEN date_trunc('hour', ts) END NULLS LAST, seq % 3 > 0, seq % 3, seq) - 1 AS global_seq FROM agent_events""",
)
