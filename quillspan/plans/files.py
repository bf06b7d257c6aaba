"""Queries over files that agents touched and commands that undid work."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import files as ops
from quillspan.plans.base import NOW, now, register


def _sessions(x):
    """Three machines and one project, so that files gather sessions."""
    return x.tables.sessions.withColumns({"machine_id": F.expr("concat('m', id % 3)"), "own_project": F.lit("p")})


def _checkpoints(x):
    behind = "CASE WHEN CAST(substring(source_id, 2) AS BIGINT) % 19 = 0 THEN indexed_offset - 1 ELSE indexed_offset END AS edit_offset"
    return x.tables.sources.selectExpr("source_id", "generation", behind, "diagnostics")


def _touches(x, only=None):
    return ops.file_touches(_sessions(x), x.events, x.tables.sources, _checkpoints(x), now(), only)


_NAMED = "coalesce(tool_use_id, '') <> '' AND agent_id <> ''"
_TOUCHES = f"""touches AS (WITH p AS (SELECT session_id, source_id, agent_id, tool_use_id, count(*) FILTER (WHERE kind = 'tool-call') AS calls, count(*) FILTER (WHERE kind = 'tool-result') AS results, coalesce(max(seq) FILTER (WHERE kind = 'tool-call'), 0) AS c, coalesce(max(seq) FILTER (WHERE kind = 'tool-result'), 0) AS r
    FROM agent_events WHERE kind IN ('tool-call', 'tool-result') GROUP BY ALL),
  w AS (SELECT session_id, source_id, agent_id, max(c) FILTER (WHERE calls = 1 AND results = 0 AND {_NAMED}) AS seq, bool_or(calls <> 1 OR results > 1 OR NOT ({_NAMED}) OR results = 1 AND r <= c) AS doubtful FROM p GROUP BY ALL),
  st AS (SELECT w.session_id, bool_or(w.seq IS NOT NULL AND coalesce(e.ts < TIMESTAMP '{NOW}' - INTERVAL 2 MINUTE AND so.modified_at > TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND so.modified_at <= TIMESTAMP '{NOW}', false)) AS stalled,
    bool_or(doubtful OR w.seq IS NOT NULL AND (e.ts IS NULL OR e.ts > TIMESTAMP '{NOW}' OR so.modified_at IS NULL OR so.modified_at > TIMESTAMP '{NOW}')) AS unpaired FROM w JOIN log_sources so ON so.source_id = w.source_id LEFT JOIN agent_events e ON e.seq = w.seq GROUP BY 1),
  o AS (SELECT session_id, bool_or(coalesce(error, false)) AS failed, bool_or(kind = 'indexing-error' OR kind = 'tool-result' AND error IS NULL) AS unsaid FROM agent_events GROUP BY 1)
  SELECT t.session_id, 'm' || (s.id % 3) AS machine_id, 'p' AS project, t.path, coalesce(so.modified_at, s.last_activity) AS touched_at, coalesce(o.failed, false) OR coalesce(st.stalled, false) AS bad,
    NOT (coalesce(o.failed, false) OR coalesce(st.stalled, false)) AND (o.unsaid OR coalesce(st.unpaired, false) OR s.id % 19 = 0 OR so.diagnostics > 0) AS unknown
  FROM (SELECT DISTINCT session_id, path FROM agent_events WHERE kind = 'tool-call' AND path IS NOT NULL) t JOIN sessions s ON s.id = t.session_id JOIN log_sources so ON so.source_id = s.source_id LEFT JOIN o ON o.session_id = s.id LEFT JOIN st ON st.session_id = s.id)"""
_FILES = """(SELECT machine_id, project, path, count(*) AS sessions, count(*) FILTER (WHERE bad) AS bad, count(*) FILTER (WHERE unknown) AS unknown, max(touched_at) AS last_touched,
    CASE WHEN count(*) >= 5 AND count(*) FILTER (WHERE unknown) = 0 THEN count(*) FILTER (WHERE bad) * 100.0::DOUBLE / count(*) END AS rate FROM touches GROUP BY 1, 2, 3)"""
register("trouble_files", lambda x: ops.trouble_files(_touches(x)), f"SELECT * FROM {_FILES}", _TOUCHES)
for _by, _key in {"sessions": "sessions DESC", "rate": "coalesce(rate, -1) DESC", "lastTouched": "last_touched DESC NULLS LAST"}.items():
    register(f"trouble_files_by_{_by.lower()}", lambda x, by=_by: ops.sorted_files(ops.trouble_files(_touches(x)), by, limit=50, offset=5), f"SELECT * FROM {_FILES} ORDER BY {_key}, machine_id, project, path LIMIT 50 OFFSET 5", _TOUCHES)
register(
    "trouble_file_sessions",
    lambda x: _touches(x, (F.col("machine_id") == "m1") & F.col("path").like("src/file1%")),
    "SELECT * FROM touches WHERE machine_id = 'm1' AND path LIKE 'src/file1%'",
    _TOUCHES,
)
register(
    "trouble_files_newest",
    lambda x: ops.trouble_files_newest(x.tables.sessions, x.events, 60),
    """WITH s AS (SELECT id FROM sessions WHERE last_activity IS NOT NULL AND id IN (SELECT session_id FROM agent_events) ORDER BY last_activity DESC, id LIMIT 60)
    SELECT path, count(*) AS sessions, count(*) FILTER (WHERE bad) AS bad, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (WHERE bad) * 100 / count(*)) END AS rate
    FROM (SELECT DISTINCT session_id, path FROM agent_events WHERE kind = 'tool-call' AND path IS NOT NULL) JOIN (SELECT session_id, bool_or(coalesce(error, false)) AS bad FROM agent_events WHERE session_id IN (SELECT id FROM s) GROUP BY 1) USING (session_id) GROUP BY 1""".replace("WITH s AS (", "SELECT * FROM (WITH s AS (", 1)
    + ")",
)
register(
    "unsaved_candidates",
    lambda x: ops.unsaved_candidates(_sessions(x), x.events),
    """SELECT session_id, machine_id, project, path, working_directory, last_touched, sessions FROM (SELECT *, count(*) OVER f AS sessions, row_number() OVER (f ORDER BY last_touched DESC NULLS LAST, session_id) AS n
        FROM (SELECT session_id, 'm' || (session_id % 3) AS machine_id, 'p' AS project, path, CASE WHEN path LIKE '/%' THEN '' ELSE coalesce(working_directory, '') END AS working_directory, max(ts) AS last_touched FROM agent_events
            WHERE kind = 'tool-call' AND path IS NOT NULL AND session_id IN (SELECT id FROM sessions) GROUP BY ALL) WINDOW f AS (PARTITION BY machine_id, project, path, working_directory)) WHERE n = 1""",
)

#: A command of each kind that undoes work, and some that do not.
COMMANDS = ("git reset --hard HEAD~1", "cd a && git checkout -- a.txt 'b c.txt'", "git status; git restore --staged x", "git restore src/x.js", "git revert --abort", 'echo "git reset --hard"', "git revert abc; ls", "git log 'unfinished")


def _calls(x):
    text = F.get(F.array(*map(F.lit, COMMANDS)), (F.col("seq") % len(COMMANDS)).cast("int"))
    return x.events.withColumns({"tool": F.when(F.col("kind") == "tool-call", F.when(F.col("seq") % 3 == 0, F.lit("functions.exec")).otherwise("Bash")), "input": F.when(F.col("kind") == "tool-call", F.to_json(F.struct(text.alias("command"))))})


_UNDO = """undo AS (SELECT seq, session_id, source_id, ts, CASE WHEN seq % 3 = 0 THEN 'unsupported-input' WHEN seq % 8 = 7 THEN 'incomplete-shell' ELSE 'analyzed' END AS state,
    CASE WHEN seq % 3 > 0 THEN CASE seq % 8 WHEN 0 THEN 'reset' WHEN 1 THEN 'checkout' WHEN 3 THEN 'restore' WHEN 6 THEN 'revert' END END AS rule,
    CASE WHEN seq % 3 > 0 THEN CASE seq % 8 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 6 THEN 0 END END AS path_count FROM agent_events WHERE kind = 'tool-call')"""
_SEEN = "rule IS NOT NULL OR state <> 'analyzed'"
register(
    "undo_history",
    lambda x: ops.undo_history(_calls(x)).selectExpr("seq", "session_id", "ts", "state", "rule", "array_join(paths, '|') AS paths", "path_count"),
    f"SELECT seq, session_id, ts, state, rule, CASE path_count WHEN 0 THEN '' WHEN 1 THEN 'src/x.js' WHEN 2 THEN 'a.txt|b c.txt' END AS paths, CAST(path_count AS BIGINT) AS path_count FROM undo WHERE {_SEEN}",
    _UNDO,
)
register(
    "prior_edits",
    lambda x: ops.prior_edits(ops.undo_history(_calls(x)), _calls(x), 5),
    """SELECT undo_seq, seq, path, CASE WHEN seq % 3 = 0 THEN 'functions.exec' ELSE 'Bash' END AS tool FROM (SELECT u.seq AS undo_seq, e.seq, e.path, row_number() OVER (PARTITION BY u.seq ORDER BY e.seq DESC) AS n
    FROM undo u JOIN agent_events e ON e.source_id = u.source_id AND e.seq < u.seq AND e.kind = 'tool-call' AND e.path IS NOT NULL WHERE u.rule IS NOT NULL) WHERE n <= 5""",
    _UNDO,
)
register(
    "undo_by_project",
    lambda x: ops.undo_by_project(ops.undo_history(_calls(x)), x.tables.sessions),
    "SELECT own_project AS project, count(*) AS attempts, count(DISTINCT session_id) AS sessions, CAST(sum(path_count) AS BIGINT) AS paths, max(ts) AS latest FROM undo JOIN sessions s ON s.id = session_id WHERE rule IS NOT NULL GROUP BY 1",
    _UNDO,
)
register("undo_summary", lambda x: ops.undo_summary(ops.undo_history(_calls(x))), f"SELECT coalesce(rule, '') AS rule, count(*) AS calls, count(DISTINCT session_id) AS sessions FROM undo WHERE {_SEEN} GROUP BY 1", _UNDO)


def _written(x):
    """Files whose content holds a made-up credential in every fifth row; some are not to be scanned, some hold more than are listed."""
    tail = "Q7mZ2kP9Q7mZ2kP9Q7mZ2kP9Q7mZ2kP9Q7mZ2kP9"
    content = (
        F.when(F.col("seq") % 5 == 0, F.concat(F.lit("first line\n\nkey AKIA"), F.lit("Q7MZ2KP9R4NT6VW8\n"))).when(F.col("seq") % 5 == 1, F.lit(f"EXAMPLE ghp_{tail[:36]}")).when(F.col("seq") % 5 == 2, F.lit(f"ghp_{tail[:36]}"))
        .when(F.col("seq") % 35 == 3, F.repeat(F.lit("x"), 600_000)).when(F.col("seq") % 35 == 8, F.lit("a\0b")).when(F.col("seq") % 35 == 13, F.repeat(F.lit(f"ghp_{tail[:36]}\n"), 7)).when(F.col("seq") % 35 == 18, F.lit(None)).otherwise("text")
    )
    return x.events.where("path IS NOT NULL").select(F.concat("path", F.lit("#"), "seq").alias("path"), content.alias("content"))


register(
    "secrets_in_files",
    lambda x: ops.secrets_in_files(_written(x)),
    """SELECT path || '#' || seq AS path, CASE seq % 35 WHEN 3 THEN 'too-large' WHEN 8 THEN 'binary' WHEN 18 THEN 'missing' ELSE 'scanned' END AS state, seq % 35 = 13 AS capped, CASE WHEN seq % 5 = 0 THEN 'An Amazon Web Services key' WHEN seq % 35 = 13 OR seq % 5 = 2 THEN 'A GitHub token' END AS kind,
    CASE WHEN seq % 5 = 0 THEN 3 WHEN seq % 5 = 2 THEN 1 WHEN seq % 35 = 13 THEN k END AS line, CASE WHEN seq % 5 = 0 THEN 'AKIA…' WHEN seq % 35 = 13 OR seq % 5 = 2 THEN 'ghp_…' END AS fragment
    FROM agent_events JOIN range(1, 6) r(k) ON k = 1 OR seq % 35 = 13 WHERE path IS NOT NULL AND (seq % 5 IN (0, 2) OR seq % 35 IN (3, 8, 13, 18))""",
)
