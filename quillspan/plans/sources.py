"""Queries over transcripts and spans: the test tables written as a provider's lines, then read by the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.plans.base import register
from quillspan.sources import transcripts as ops

_AT = "struct(CAST(turn AS BIGINT) AS block, CAST(0 AS BIGINT) AS line)"
_STAMP = "concat('2024-01-01T00:00:', lpad(CAST(turn % 60 AS STRING), 2, '0'), '.5Z')"


def _message_lines(x) -> DataFrame:
    """conversations as message transcripts: plain texts, texts with a call, results of three kinds of error, and broken lines."""
    quoted = "substring(to_json(array(coalesce(text, ''))), 2, length(to_json(array(coalesce(text, '')))) - 2)"
    head = f"""concat('{{"type":"message","sessionId":"s","timestamp":"', {_STAMP}, '","message":{{"role":"', role, '",')"""
    error = "CASE turn % 3 WHEN 0 THEN ',\"is_error\":true' WHEN 1 THEN ',\"is_error\":\"true\"' ELSE '' END"
    value = f"""CASE turn % 4
        WHEN 0 THEN concat({head}, '"content":', q, '}}}}')
        WHEN 1 THEN concat({head}, '"id":"', CASE WHEN turn % 8 = 1 THEN '' ELSE concat('m', turn) END, '","model":"opus-1","usage":{{"input_tokens":', turn, ',"output_tokens":', length(q), ',"cache_read_input_tokens":"odd"}},',
            '"content":[{{"type":"text","text":', q, '}},{{"type":"tool_use","id":"c', turn, '","name":"Read","input":{{"b": 1, "a": ', turn, '}}}}]}}}}')
        WHEN 2 THEN concat({head}, '"content":[{{"type":"tool_result","tool_use_id":"c', turn - 1, '"', {error}, ',"content":', q, '}}]}}}}')
        ELSE '{{"type":"broken' END"""
    return x.tables.turns.selectExpr("*", f"{quoted} AS q").selectExpr("concat('s', conv_id) AS source_id", f"{_AT} AS at", f"{value} AS value")


_TS = "TIMESTAMP '2024-01-01 00:00:00.5' + INTERVAL 1 SECOND * (turn % 60)"
register(
    "transcript_events",
    lambda x: ops.message_events(_message_lines(x)).selectExpr("source_id", "at.block AS turn", "place", "agent_id", "kind", "ts", "text", "tool", "tool_use_id", "error"),
    f"""WITH c AS (SELECT 's' || conv_id AS source_id, turn, role, coalesce(text, '') AS t, {_TS} AS ts, role IN ('user', 'assistant') AS said FROM conversations)
    SELECT source_id, turn, 0 AS place, 'main' AS agent_id, CASE WHEN said THEN role || '-text' ELSE 'source-record' END AS kind, ts, CASE WHEN turn % 4 = 2 THEN '' ELSE t END AS text, NULL AS tool, NULL AS tool_use_id, CAST(NULL AS BOOLEAN) AS error FROM c WHERE turn % 4 <> 3 AND (NOT said OR turn % 4 < 2 AND t <> '')
    UNION ALL SELECT source_id, turn, 2, 'main', 'tool-call', ts, '{{"a":' || turn || ',"b":1}}', 'Read', 'c' || turn, NULL FROM c WHERE said AND turn % 4 = 1
    UNION ALL SELECT source_id, turn, 1, 'main', 'tool-result', ts, t, NULL, 'c' || (turn - 1), CASE WHEN turn % 3 = 0 THEN true END FROM c WHERE said AND turn % 4 = 2
    UNION ALL SELECT source_id, turn, 0, 'main', 'indexing-error', NULL, 'malformed record', NULL, NULL, NULL FROM c WHERE turn % 4 = 3""".replace("WITH c AS (", "SELECT * FROM (WITH c AS (", 1)
    + ")",
)
register(
    "transcript_usage",
    lambda x: ops.message_usage(_message_lines(x)).selectExpr("source_id", "at.block AS turn", "agent_id", "CASE WHEN message_id LIKE 'line:%' THEN 'line' ELSE message_id END AS message_id", "kind", "ts", "tokens_in", "tokens_cache", "tokens_write", "tokens_out > 0 AS has_output", "model", "array_join(present, ',') AS present"),
    f"""SELECT 's' || conv_id AS source_id, turn, 'main' AS agent_id, CASE WHEN turn % 8 = 1 THEN 'line' ELSE 'm' || turn END AS message_id, CASE WHEN turn % 8 = 1 THEN 'message-without-id' ELSE 'message-partial' END AS kind, {_TS} AS ts,
    CAST(turn AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_cache, CAST(0 AS BIGINT) AS tokens_write, true AS has_output, 'opus-1' AS model, 'tokens_in,tokens_out,model' AS present FROM conversations WHERE role = 'assistant' AND turn % 4 = 1""",
)


def _counter_lines(x) -> DataFrame:
    """The events table as rollouts with cumulative counters: some reports come twice, and after some a lower one."""
    rows = x.spark.sql("SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY seq) AS c FROM (SELECT seq, session_id, CAST(seq % 9 + 1 AS BIGINT) AS n FROM {e})", e=x.tables.events)
    usage = lambda i, k, o: f"'{{\"input_tokens\":', {i}, ',\"cached_input_tokens\":', {k}, ',\"output_tokens\":', {o}, '}}'"
    report = lambda lower: f"""concat('{{"type":"event_msg","timestamp":"2024-01-01T00:00:00Z","payload":{{"type":"token_count","model":"m', CAST(floor(seq / 25) AS BIGINT) % 2, '","info":{{"total_token_usage":', {usage(f'2 * c - {lower}', 'c', 'c')}, ',"last_token_usage":', {usage('2 * n', 'n', 'n')}, '}}}}}}')"""
    copies = "CASE WHEN seq % 5 = 0 THEN array(0, 1) WHEN seq % 7 = 0 THEN array(0, 0) ELSE array(0) END"
    rows = rows.selectExpr("*", f"posexplode({copies}) AS (line, lower)")
    return rows.selectExpr("concat('s', session_id) AS source_id", "struct(CAST(seq AS BIGINT) AS block, CAST(line AS BIGINT) AS line) AS at", f"{report('lower')} AS value")


register(
    "counter_deltas",
    lambda x: ops.counter_deltas(ops.counter_reports(_counter_lines(x))).selectExpr("source_id", "from_json(at_key, 'at struct<block bigint, line bigint>').at.block AS seq", "scope", "part", "model", "kind", "tokens_in", "tokens_cache", "tokens_write", "tokens_out"),
    """SELECT 's' || session_id AS source_id, seq, 's' || session_id AS scope, CASE WHEN same THEN 'delta' ELSE 'last' END AS part, model, CASE WHEN same THEN 'cumulative-delta' ELSE 'reported-last-call' END AS kind, n AS tokens_in, n AS tokens_cache, CAST(0 AS BIGINT) AS tokens_write, n AS tokens_out
    FROM (SELECT *, coalesce(lag(model) OVER (PARTITION BY session_id ORDER BY seq) = model, false) AS same FROM (SELECT seq, session_id, CAST(seq % 9 + 1 AS BIGINT) AS n, 'm' || (seq // 25 % 2) AS model FROM all_events))
    UNION ALL SELECT 's' || session_id, seq, 's' || session_id, 'counter', '', 'counter-discontinuity', 0, 0, 0, 0 FROM all_events WHERE seq % 5 = 0""",
)
register(
    "rollout_events",
    lambda x: ops.rollout_events(_counter_lines(x).unionByName(_items(x))).selectExpr("source_id", "at.block AS seq", "kind", "text", "tool", "tool_use_id"),
    """SELECT 's' || session_id AS source_id, seq, CASE seq % 5 WHEN 0 THEN 'session-meta' WHEN 1 THEN 'model-context' WHEN 2 THEN 'user-text' WHEN 3 THEN 'tool-call' ELSE 'tool-result' END AS kind,
    CASE seq % 5 WHEN 0 THEN '' WHEN 1 THEN 'm1' WHEN 2 THEN 'one' || chr(10) || 'two' WHEN 3 THEN '{"a": 1}' ELSE '{"out":[1,2]}' END AS text, CASE WHEN seq % 5 = 3 THEN 'shell' END AS tool, CASE WHEN seq % 5 >= 3 THEN 'c' || seq END AS tool_use_id FROM all_events""",
)


def _items(x) -> DataFrame:
    value = """CASE seq % 5 WHEN 0 THEN '{"type":"session_meta","payload":{"id":"n","cwd":"/w"}}' WHEN 1 THEN '{"type":"turn_context","payload":{"model":"m1"}}'
        WHEN 2 THEN '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"one"},{"type":"image"},{"type":"input_text","text":"two"}]}}'
        WHEN 3 THEN concat('{"type":"response_item","payload":{"type":"function_call","name":"shell","call_id":"c', seq, '","arguments":"{\\\\"a\\\\": 1}"}}')
        ELSE concat('{"type":"response_item","payload":{"type":"function_call_output","call_id":"c', seq, '","output":{"out": [1, 2]}}}') END"""
    return x.tables.events.selectExpr("concat('s', session_id) AS source_id", "struct(CAST(seq AS BIGINT) AS block, CAST(9 AS BIGINT) AS line) AS at", f"{value} AS value")


def _bodies(x) -> DataFrame:
    """The events table as OTLP bodies, a span each, with attributes of three conventions; some names come twice, some values are lists or zero."""
    value = """concat('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc', session_id % 3, '"}}]},"scopeSpans":[{"spans":[{"spanId":"', seq, '","name":"step","startTimeUnixNano":"', 1700000000000000000 + seq * 1000, '","endTimeUnixNano":"',
        1700000000000000000 + seq * 2000, '","status":{"code":', CASE WHEN error THEN 2 ELSE 1 END, '},"attributes":[', CASE seq % 3
        WHEN 0 THEN concat('{"key":"gen_ai.request.model","value":{"stringValue":"old"}},{"key":"gen_ai.request.model","value":{"stringValue":"m"}},{"key":"gen_ai.usage.input_tokens","value":{"intValue":"', CASE WHEN seq % 2 = 0 THEN 0 ELSE seq END,
            '"}},{"key":"llm.token_count.prompt","value":{"intValue":"', seq, '"}},{"key":"agent.name","value":{"stringValue":"a"}}', CASE WHEN seq % 2 = 0 THEN ',{"key":"gen_ai.prompt","value":{"arrayValue":{"values":[{"stringValue":"do"},{"intValue":"7"},{"boolValue":true}]}}},{"key":"output.value","value":{"stringValue":"done"}}' ELSE '' END)
        WHEN 1 THEN '{"key":"openinference.span.kind","value":{"stringValue":"TOOL"}},{"key":"llm.model_name","value":{"stringValue":"m2"}},{"key":"tool.name","value":{"stringValue":"grep"}},{"key":"input.value","value":{"stringValue":"x"}},{"key":"retry.count","value":{"intValue":"2"}}' ELSE '' END, ']}]}]}]}')"""
    return x.tables.events.selectExpr(f"{value} AS body")


register(
    "otlp_spans",
    lambda x: ops.spans(_bodies(x)),
    """SELECT 'otel:svc' || (session_id % 3) AS session_id, CAST(seq AS VARCHAR) AS span_id, CASE WHEN seq % 3 = 0 THEN 'sub:a' ELSE 'main' END AS agent_id, CASE WHEN seq % 3 = 0 THEN 'model-call' ELSE 'tool-call' END AS kind,
    CASE seq % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'm2' END AS model, CASE seq % 3 WHEN 1 THEN 'grep' WHEN 2 THEN 'step' END AS tool, CASE seq % 3 WHEN 1 THEN 'x' WHEN 2 THEN '' END AS arguments, make_timestamp(1700000000000000 + seq) AS started_at, make_timestamp(1700000000000000 + 2 * seq) AS ended_at,
    CASE WHEN seq % 3 = 0 THEN seq ELSE 0 END AS tokens_in, CAST(0 AS BIGINT) AS tokens_out, coalesce(error, false) AS error FROM all_events""",
)
register(
    "otlp_events",
    lambda x: ops.span_events(_bodies(x)),
    """SELECT 'otel:svc' || (session_id % 3) AS session_id, CAST(seq AS VARCHAR) AS span_id, CASE WHEN seq % 3 = 0 THEN 'sub:a' ELSE 'main' END AS agent_id, CASE WHEN k = 1 THEN 1 ELSE 0 END AS place,
    CASE WHEN seq % 3 > 0 THEN 'tool-call' WHEN seq % 2 = 0 AND k = 0 THEN 'user-text' ELSE 'assistant-text' END AS kind, make_timestamp(1700000000000000 + CASE WHEN seq % 3 > 0 OR seq % 2 = 0 AND k = 0 THEN seq ELSE 2 * seq END) AS ts,
    CASE WHEN seq % 3 = 1 THEN 'x' WHEN seq % 3 = 2 THEN '' WHEN seq % 2 = 1 THEN 'step (m)' WHEN k = 0 THEN 'do, 7, true' ELSE 'done' END AS text, CASE seq % 3 WHEN 1 THEN 'grep' WHEN 2 THEN 'step' END AS tool,
    CASE WHEN seq % 3 > 0 OR seq % 2 = 1 OR k = 1 THEN coalesce(error, false) END AS error, CASE WHEN seq % 3 = 1 THEN CAST(2 AS BIGINT) END AS retry
    FROM all_events JOIN (VALUES (0), (1)) v(k) ON k = 0 OR seq % 3 = 0 AND seq % 2 = 0""",
)
register(
    "scaled_windows",
    lambda x: ops.scaled_to_total(x.usage.selectExpr("source_id", "agent_id", "tokens_out AS tokens").groupBy("source_id", "agent_id").agg(F.sum("tokens").alias("tokens")), x.usage.selectExpr("source_id", "tokens_in AS total")),
    """SELECT source_id, agent_id, tokens, CAST(CASE WHEN a > 0 THEN round(tokens * total / a) ELSE 0 END AS BIGINT) AS scaled FROM (SELECT source_id, agent_id, CAST(sum(tokens_out) AS BIGINT) AS tokens FROM usage GROUP BY 1, 2)
    JOIN (SELECT source_id, sum(tokens_out) AS a, max(tokens_in) AS total FROM usage GROUP BY 1) USING (source_id)""",
)
register(
    "source_kinds",
    lambda x: x.tables.sources.selectExpr("path", "CASE WHEN diagnostics = 1 THEN replace(path, 'Session', 'x/subagents/agent-') WHEN source_id LIKE '%7' THEN replace(path, 'Session', 'rollout-') WHEN source_id LIKE '%5' THEN replace(path, '.jsonl', '.txt') ELSE path END AS file").select("path", ops.source_kind(F.col("file")).alias("kind")),
    "SELECT path, CASE WHEN diagnostics = 1 THEN 'subagent' WHEN source_id LIKE '%7' THEN 'rollout' WHEN source_id LIKE '%5' THEN NULL ELSE 'main' END AS kind FROM log_sources",
)
