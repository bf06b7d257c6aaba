"""Queries that search texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.storage import fresh_path
from quillspan.operators import index, text as ops
from quillspan.plans.base import register

_LINE = "' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), ' ') || ' '"
register(
    "search_events",
    lambda x: ops.search_events(x.events, 'view "k 5"', after=20, limit=50).select("seq", "session_id", "kind", "text"),
    _EVENTS := f"SELECT seq, session_id, kind, text FROM agent_events WHERE seq > 20 AND contains({_LINE}, ' view ') AND contains({_LINE}, ' k 5 ') ORDER BY seq LIMIT 50",
)
register(
    "search_events_any",
    lambda x: ops.search_events(x.events, "step1 signup", every=False, kinds=("tool-call", "user-text"), limit=80).select("seq", "session_id", "kind", "text"),
    _ANY := f"SELECT seq, session_id, kind, text FROM agent_events WHERE kind IN ('tool-call', 'user-text') AND (contains({_LINE}, ' step1 ') OR contains({_LINE}, ' signup ')) ORDER BY seq LIMIT 80",
)
_WORDS = "w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents)"
register(
    "related_texts",
    lambda x: ops.related(x.tables.texts.select(F.col("doc_id").alias("id"), "text"), "the license of this work", 20),
    _RELATED := """SELECT id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM (SELECT id, n, t, tf, count(*) OVER (PARTITION BY t) AS df FROM (SELECT id, len(w) AS n, t, count(*) AS tf FROM (SELECT id, w, unnest(w) AS t FROM w)
        WHERE t IN ('the', 'license', 'of', 'this', 'work') GROUP BY ALL)), (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w) GROUP BY id ORDER BY score DESC, id LIMIT 20""",
    _WORDS,
)
register(
    "search_sessions",
    lambda x: ops.search_sessions(x.tables.turns.selectExpr("conv_id AS session_id", "turn AS seq", "role AS kind", "text"), " the "),
    """SELECT session_id, seq, kind, CASE WHEN s > 1 THEN '…' ELSE '' END || substr(t, CAST(s AS INT), CAST(p - s + 5 + 90 AS INT)) || CASE WHEN p + 5 + 90 <= length(t) THEN '…' ELSE '' END AS snippet FROM (SELECT *, greatest(1, p - 60) AS s, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n
        FROM (SELECT conv_id AS session_id, turn AS seq, role AS kind, t, strpos(lower(t), ' the ') AS p FROM (SELECT *, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM conversations)) WHERE p > 0) WHERE n <= 3 ORDER BY session_id, seq LIMIT 120""",
)
register(
    "task_search",
    lambda x: ops.task_search(x.tables.turns.where("role = 'user'").select(F.expr("conv_id * 1000 + turn").alias("id"), F.col("text").alias("task")), "how do they then list no more than the best of them into it, not please", 25),
    """SELECT id, round(s / sqrt(n), 6) AS score FROM (SELECT id, n, sum(tf * (ln((docs + 1) / (df + 1)) + 1)) AS s FROM (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM (SELECT id, len(w) AS n, t, count(*) AS tf FROM (SELECT id, w, unnest(w) AS t FROM k) WHERE t IN ('how', 'do', 'they', 'list', 'more', 'best', 'them', 'please') GROUP BY ALL)),
        (SELECT count(*) AS docs FROM k) GROUP BY id, n) ORDER BY score DESC, id LIMIT 25""",
    """k AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.]{1,}'), lambda t: t NOT IN ('the', 'a', 'an', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'with', 'by', 'from', 'at', 'as', 'is', 'are', 'be', 'it', 'this', 'that', 'into', 'then', 'than', 'not', 'no')) AS w
        FROM conversations WHERE role = 'user') WHERE len(w) > 0)""",
)




def _indexed(x, docs, **options):
    return index.text_index(x.spark, fresh_path(x.spark, "index"), docs, **options)


def _events_by_index(x, query, every=True, kinds=(), after=0, limit=100):
    """search_events() by the index of the events' texts."""
    rows = x.events.where(F.col("kind").isin(*kinds)) if kinds else x.events
    found = _indexed(x, x.events.select(F.col("seq").alias("id"), "text"), span=512, buckets=16).search(query, every)
    return rows.where(F.col("seq") > after).join(found.withColumnRenamed("id", "seq"), "seq", "left_semi").orderBy("seq").limit(limit).select("seq", "session_id", "kind", "text")


register("search_events_indexed", lambda x: _events_by_index(x, 'view "k 5"', after=20, limit=50), _EVENTS)
register("search_events_any_indexed", lambda x: _events_by_index(x, "step1 signup", every=False, kinds=("tool-call", "user-text"), limit=80), _ANY)
register(
    "related_texts_indexed",
    lambda x: _indexed(x, x.tables.texts.select(F.col("doc_id").alias("id"), "text"), span=256, buckets=16).best("the license of this work", 20)[0],
    _RELATED,
    _WORDS,
)


def _two_segments(x):
    """The same from two segments that were merged."""
    docs = x.tables.texts.select(F.col("doc_id").alias("id"), "text")
    own = _indexed(x, docs.where("id % 3 > 0"), span=256, buckets=16)
    own.add(docs.where("id % 3 = 0"), 2, ops.tokens(F.col("text")))
    own.merge([1, 2], 3)
    return own.best("the license of this work", 20)[0]


register("related_texts_merged", _two_segments, _RELATED, _WORDS)


def _delegations(x):
    """User turns as delegated jobs: seven instructions that recur, some too short, some without one."""
    prompt = "concat('Check  part ', turn % 7, ' of the work', CASE WHEN turn % 5 = 0 THEN '' ELSE ' in full detail and report back what you found in it' END)"
    return x.tables.turns.where("role = 'user'").selectExpr(
        "conv_id * 1000 + turn AS seq", "conv_id AS session_id", f"CASE WHEN turn % 11 = 10 THEN '{{\"prompt\":' WHEN turn % 3 = 0 AND turn % 2 = 1 THEN '{{\"other\":1}}' ELSE to_json(named_struct('prompt', {prompt})) END AS arguments"
    )


_STATES = """states AS (SELECT conv_id * 1000 + turn AS seq, conv_id AS session_id, turn % 7 AS part, CASE WHEN turn % 11 = 10 THEN 'invalid-arguments' WHEN turn % 3 = 0 AND turn % 2 = 1 THEN 'missing-instruction' WHEN turn % 5 = 0 THEN 'too-vague' ELSE 'known' END AS state FROM conversations WHERE role = 'user')"""
register("prompt_states", lambda x: ops.prompt_states(_delegations(x)).selectExpr("seq", "session_id", "state", "prompt_hash IS NOT NULL AS hashed"), "SELECT seq, session_id, state, state = 'known' AS hashed FROM states", _STATES)
register(
    "delegation_matches",
    lambda x: ops.delegation_matches(ops.prompt_states(_delegations(x))),
    """SELECT a.seq, a.session_id, count(b.seq) AS matches, count(DISTINCT b.session_id) AS sessions, max(b.seq) AS latest_seq FROM (SELECT * FROM states WHERE state = 'known') a LEFT JOIN (SELECT * FROM states WHERE state = 'known') b ON a.part = b.part AND a.session_id <> b.session_id GROUP BY 1, 2""",
    _STATES,
)
