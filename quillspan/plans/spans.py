"""Queries over the events of sessions: tool spans, agents, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import spans as ops
from quillspan.operators import trace
from quillspan.plans.base import NOW, now, register

register(
    "tool_spans",
    lambda x: ops.tool_spans(x.events),
    """SELECT seq, session_id, agent_id, tool, state, CASE WHEN state = 'matched' THEN r_seq END AS result_seq, CASE WHEN state = 'matched' THEN epoch_us(r_ts) // 1000 - epoch_us(ts) // 1000 END AS duration_ms,
    CASE WHEN state = 'matched' THEN r_error END AS error FROM spans""",
)
register(
    "agent_lifecycle",
    lambda x: ops.agent_lifecycle(x.events, x.tables.sources, now()),
    f"""SELECT session_id, agent_id, pending_seq, unc AS uncertain_calls, CASE WHEN last_kind = 'tool-call' OR NOT last_error THEN false WHEN last_error AND n = 1 AND results = 1 AND call_seq < last_seq THEN true END AS retrying,
    CASE WHEN pending_seq IS NULL THEN CASE WHEN unc = 0 THEN false END WHEN pending_at <= TIMESTAMP '{NOW}' AND modified_at <= TIMESTAMP '{NOW}' THEN
        CASE WHEN pending_at < TIMESTAMP '{NOW}' - INTERVAL 2 MINUTE AND modified_at > TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE THEN true WHEN unc = 0 THEN false END END AS stalled
    FROM (SELECT a.session_id, a.agent_id, p.pending_seq, coalesce(p.doubtful, 0) + a.unnamed AS unc, l.kind AS last_kind, l.error AS last_error, l.seq AS last_seq, q.calls AS n, q.results, q.call_seq, w.ts AS pending_at, s.modified_at
        FROM (SELECT session_id, agent_id, source_id, count(*) FILTER (WHERE coalesce(tool_use_id, '') = '') AS unnamed, max(seq) AS last FROM agent_events WHERE agent_id <> '' AND kind IN ('tool-call', 'tool-result') GROUP BY 1, 2, 3) a
        JOIN agent_events l ON l.seq = a.last
        LEFT JOIN (SELECT session_id, agent_id, max(call_seq) FILTER (WHERE calls = 1 AND results = 0) AS pending_seq, count(*) FILTER (WHERE calls <> 1 OR results > 1 OR results = 1 AND coalesce(r_seq, 0) <= coalesce(call_seq, 0)) AS doubtful FROM pairs GROUP BY 1, 2) p
            ON p.session_id = a.session_id AND p.agent_id = a.agent_id
        LEFT JOIN pairs q ON q.session_id = a.session_id AND q.agent_id = a.agent_id AND q.tool_use_id = l.tool_use_id
        LEFT JOIN agent_events w ON w.seq = p.pending_seq LEFT JOIN log_sources s ON s.source_id = a.source_id)""",
)
register("agent_tools", lambda x: ops.agent_tools(x.events), "SELECT session_id, agent_id, coalesce(tool, '') AS tool, count(*) AS calls FROM agent_events WHERE kind = 'tool-call' GROUP BY 1, 2, 3")
register(
    "tool_rollup",
    lambda x: ops.tool_rollup(x.events),
    r"""SELECT session_id, CASE WHEN coalesce(tool, '') = '' OR strlen(tool) > 4096 THEN '(unattributed tool)' ELSE regexp_replace(tool, '^mcp__[^_]+__', '') END AS tool, count(*) AS calls FROM agent_events WHERE kind = 'tool-call' GROUP BY 1, 2""",
)
register(
    "session_stats",
    lambda x: ops.session_stats(x.events, x.usage),
    """SELECT session_id, agents, coalesce(events, 0) AS events, coalesce(tool_calls, 0) AS tool_calls, coalesce(errors, 0) AS errors, coalesce(unknown_results, 0) AS unknown_results, coalesce(indexing_errors, 0) AS indexing_errors,
    least(e_first, u_first) AS first_at, greatest(e_last, u_last) AS last_at, epoch_us(greatest(e_last, u_last)) // 1000 - epoch_us(least(e_first, u_first)) // 1000 AS duration_ms
    FROM (SELECT session_id, count(DISTINCT agent_id) AS agents FROM (SELECT session_id, agent_id FROM agent_events UNION ALL SELECT session_id, agent_id FROM usage) GROUP BY 1)
    LEFT JOIN (SELECT session_id, count(*) AS events, count(*) FILTER (WHERE kind = 'tool-call') AS tool_calls, count(*) FILTER (WHERE error) AS errors, count(*) FILTER (WHERE kind = 'tool-result' AND error IS NULL) AS unknown_results,
        count(*) FILTER (WHERE kind = 'indexing-error') AS indexing_errors, min(ts) AS e_first, max(ts) AS e_last FROM agent_events GROUP BY 1) USING (session_id)
    LEFT JOIN (SELECT session_id, min(ts) AS u_first, max(ts) AS u_last FROM usage GROUP BY 1) USING (session_id)""",
)
register(
    "session_fingerprint",
    lambda x: ops.fingerprint(x.events),
    """SELECT session_id, CAST(CASE WHEN ts IS NULL THEN -1 WHEN t1 <= t0 THEN 0 ELSE least(23, floor((epoch_us(ts) - epoch_us(t0)) * 24 / (epoch_us(t1) - epoch_us(t0)))) END AS INT) AS bucket, count(*) AS events, count(*) FILTER (WHERE error) AS errors
    FROM agent_events JOIN (SELECT session_id, min(ts) AS t0, max(ts) AS t1 FROM agent_events GROUP BY 1) USING (session_id) GROUP BY 1, 2""",
)
register(
    "events_around",
    lambda x: ops.events_around(x.events, x.events.where("error").groupBy("session_id").agg(F.max("seq").alias("seq")), 20, 20).select("session_id", "anchor", "seq", "kind"),
    """SELECT session_id, anchor, seq, kind FROM (SELECT e.session_id, anchor, e.seq, e.kind, row_number() OVER (PARTITION BY e.session_id, e.seq < anchor ORDER BY CASE WHEN e.seq < anchor THEN -e.seq ELSE e.seq END) AS n
    FROM agent_events e JOIN (SELECT session_id, max(seq) AS anchor FROM agent_events WHERE error GROUP BY 1) USING (session_id)) WHERE n <= CASE WHEN seq < anchor THEN 20 ELSE 21 END""",
)
register("consecutive_runs", lambda x: ops.consecutive_runs(x.events), "SELECT * FROM runs")
_SHORT = """CASE WHEN len(parts) > 2 THEN parts[-2] || '/' || parts[-1] ELSE s END"""
_TARGETS = f"""targets AS (SELECT seq, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS target FROM (SELECT seq, {_SHORT} AS t FROM (SELECT seq, s, list_filter(regexp_split_to_array(s, '[\\\\/]'), lambda x: x <> '') AS parts
    FROM (SELECT seq, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM agent_events))))"""
register(
    "failure_diagnosis",
    lambda x: ops.diagnose(x.events),
    """SELECT session_id, kind, tool, target, count, errors FROM (SELECT session_id, CASE WHEN errors > 0 THEN 1 ELSE 0 END AS rank, start, CASE WHEN errors > 0 THEN 'retry-storm' ELSE 'looping' END AS kind, tool, target, length AS count, errors
        FROM runs JOIN targets ON seq = start WHERE length >= 2 AND lower(tool) NOT IN ('edit', 'write', 'multiedit', 'notebookedit') AND (errors > 0 OR length >= 3)
        UNION ALL SELECT e.session_id, 2, e.seq, 'stalled', e.tool, t.target, 1, 0 FROM (SELECT session_id, count(*) FILTER (WHERE kind = 'tool-call' AND tool IS NOT NULL) AS calls, max(seq) FILTER (WHERE kind = 'tool-call' AND tool IS NOT NULL) AS last,
            max(seq) FILTER (WHERE kind IN ('tool-call', 'tool-result', 'assistant-text')) AS moved, bool_or(kind = 'tool-result') AS sees FROM agent_events GROUP BY 1) a JOIN agent_events e ON e.seq = a.last JOIN targets t ON t.seq = e.seq
        WHERE calls >= 2 AND sees AND moved = last AND coalesce(e.tool_use_id, '') <> '') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rank DESC, start DESC) = 1""",
    _TARGETS,
)
_SAID = "(agent_id = 'main' AND kind IN ('user-text', 'user-queued', 'assistant-text'))"
_STORY = f"""story AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS block FROM (SELECT *, {_SAID} AS said, CASE WHEN {_SAID} OR coalesce(lag({_SAID}) OVER (PARTITION BY session_id ORDER BY seq), true) THEN 1 ELSE 0 END AS opens FROM agent_events))"""
register(
    "story_blocks",
    lambda x: trace.story(x.events),
    """SELECT session_id, block, CASE WHEN NOT said THEN 'burst' WHEN kind = 'assistant-text' THEN 'reply' ELSE 'prompt' END AS type, start, events, errors, sub_replies, coalesce(tools, '') AS tools
    FROM (SELECT session_id, block, min(seq) AS start, count(*) AS events, count(*) FILTER (WHERE error) AS errors, bool_or(said) AS said, min(kind) AS kind, count(*) FILTER (WHERE NOT said AND agent_id <> 'main' AND kind = 'assistant-text') AS sub_replies FROM story GROUP BY 1, 2)
    LEFT JOIN (SELECT session_id, block, string_agg(tool || '×' || n, ' · ' ORDER BY p) AS tools FROM (SELECT session_id, block, tool, n, row_number() OVER (PARTITION BY session_id, block ORDER BY n DESC, tool) AS p
        FROM (SELECT session_id, block, regexp_replace(tool, '^mcp__[^_]+__', '') AS tool, count(*) AS n FROM story WHERE NOT said AND tool IS NOT NULL GROUP BY 1, 2, 3)) WHERE p <= 4 GROUP BY 1, 2) USING (session_id, block)""",
    _STORY,
)
register(
    "span_timeline",
    lambda x: ops.timeline(ops.tool_spans(x.events), x.events),
    """SELECT seq, session_id, round(100 * (epoch_us(ts) // 1000 - epoch_us(t0) // 1000) / greatest(epoch_us(t1) // 1000 - epoch_us(t0) // 1000, 1), 4) AS offset_pct, round(100 * (epoch_us(r_ts) // 1000 - epoch_us(ts) // 1000) / greatest(epoch_us(t1) // 1000 - epoch_us(t0) // 1000, 1), 4) AS width_pct
    FROM spans JOIN (SELECT session_id, min(ts) AS t0, max(ts) AS t1 FROM agent_events GROUP BY 1) USING (session_id) WHERE state = 'matched'""",
)
_LATER = "2024-01-20 00:00:00"
_FINISHED = "session_id % 3 = 0 AND agent_id = 'agent-1'"
register(
    "agent_status",
    lambda x: ops.agent_status(x.events.where(f"ts IS NULL OR ts <= TIMESTAMP_NTZ '{_LATER}'"), F.lit(_LATER).cast("timestamp_ntz"), x.events.where(_FINISHED).select("session_id", "agent_id").distinct()),
    f"""WITH e AS (SELECT * FROM agent_events WHERE agent_id <> '' AND (ts IS NULL OR ts <= TIMESTAMP '{_LATER}')), l AS (SELECT session_id, agent_id, max(seq) AS last, max(ts) AS last_at, max(seq) FILTER (WHERE kind IN ('tool-call', 'tool-result')) AS step FROM e GROUP BY 1, 2),
    p AS (SELECT session_id, agent_id, arg_max(struct_pack(t := ts), seq).t AS since FROM e WHERE kind = 'tool-call' AND tool_use_id IS NOT NULL AND (session_id, tool_use_id) NOT IN (SELECT (session_id, tool_use_id) FROM e WHERE kind = 'tool-result' AND tool_use_id IS NOT NULL) GROUP BY 1, 2)
    SELECT session_id, agent_id, last_at, CASE WHEN retrying THEN CASE WHEN recent THEN 'retrying' ELSE 'failed' END WHEN bad AND (done OR NOT recent) THEN 'failed' WHEN since < TIMESTAMP '{_LATER}' - INTERVAL 2 MINUTE AND NOT done THEN 'stalled' WHEN done THEN 'done'
        WHEN last_at > TIMESTAMP '{_LATER}' - INTERVAL 20 SECOND THEN 'working' ELSE 'idle' END AS status
    FROM (SELECT l.session_id, l.agent_id, l.last_at, coalesce(s.kind = 'tool-result' AND s.error, false) AS retrying, coalesce(l.last_at > TIMESTAMP '{_LATER}' - INTERVAL 10 MINUTE, false) AS recent, coalesce(e.error, false) AS bad, p.since,
        l.session_id % 3 = 0 AND l.agent_id = 'agent-1' AS done FROM l JOIN e ON e.seq = l.last LEFT JOIN e s ON s.seq = l.step LEFT JOIN p ON p.session_id = l.session_id AND p.agent_id = l.agent_id)""".replace("WITH e AS (", "SELECT * FROM (WITH e AS (", 1)
    + ")",
)
