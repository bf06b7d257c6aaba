"""Queries over usage and prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.operators import upkeep, usage as ops
from quillspan.plans.base import ALL, BIG, TOKEN_SUMS, coverage, register

_KEYS = {
    "project": "project",
    "machine": "machine_id",
    "provider": "provider",
    "model": "model",
    "day": "strftime(ts, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', ts), '%Y-%m-%d')",
    "month": "strftime(ts, '%Y-%m')",
    "year": "strftime(ts, '%Y')",
    "agentKind": """CASE WHEN coalesce(agent_id, '') = '' THEN 'unattributed' WHEN provider = 'alpha' AND agent_id = native_agent_id AND native_agent_id <> '' THEN 'child-agent' WHEN agent_id = 'main' AND parent_native_id <> '' THEN 'child-thread'
        WHEN agent_id = 'main' THEN 'main' ELSE 'unclassified' END""",
}
_NAMELESS = f"CASE WHEN model = '' OR kind = 'incomplete-attribution' THEN {ALL.replace('tokens_', 'p.tokens_')} ELSE 0 END"
_GROUPS = lambda key, keep="true": f"""SELECT *, {coverage(ALL)} AS coverage FROM (SELECT coalesce({key}, '') AS key, count(DISTINCT c.id) AS sessions, count(p.id) AS observations, {", ".join(BIG("p." + t, t) for t in ("tokens_in", "tokens_cache", "tokens_write", "tokens_out", "priced_tokens"))}, {BIG(_NAMELESS, "unattributed_tokens")},
        round(sum(cost), 4) AS cost FROM (SELECT id, project, machine_id, provider, native_agent_id, parent_native_id FROM cat) c LEFT JOIN priced p ON p.session_id = c.id WHERE {keep} GROUP BY 1)"""  # noqa: E731
for _by, _key in _KEYS.items():
    register("usage_by_" + ("agent_kind" if _by == "agentKind" else _by), lambda x, by=_by: ops.grouped_usage(x.all_priced, x.identities, by, "alpha"), _GROUPS(_key))
register(
    "usage_by_model_in_range",
    lambda x: ops.grouped_usage(x.all_priced, x.identities, "model", "alpha", F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")),
    _GROUPS("model", "ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'"),
)


def _half_stale(x, by):
    """Usage by a dimension from parts of which every second session's are of an older revision, with other numbers."""
    old = F.col("session_id") % 2 == 0
    parts = upkeep.usage_parts(x.all_priced).withColumns({"revision": F.when(old, F.col("revision") - 1).otherwise(F.col("revision")), "tokens_in": F.when(old, F.col("tokens_in") * 2).otherwise(F.col("tokens_in"))})
    covered = upkeep.projections(x.identities).withColumn("revision", F.when(old, F.col("revision") - 1).otherwise(F.col("revision")))
    return upkeep.grouped_by_parts(upkeep.current_parts(parts, covered, x.all_priced, x.identities), x.identities, by)


for _by in upkeep.PART_DIMENSIONS:
    register(f"usage_by_{_by}_from_parts", lambda x, by=_by: _half_stale(x, by), _GROUPS(_KEYS[_by]))
register("usage_by_day_next_page", lambda x: ops.groups_after(ops.grouped_usage(x.all_priced, x.identities, "day", "alpha"), "1994-06-01"), f"SELECT * FROM ({_GROUPS(_KEYS['day'])}) WHERE key > '1994-06-01' ORDER BY key LIMIT 100")

register(
    "session_pricing",
    lambda x: ops.session_totals(x.priced).selectExpr("session_id", "tokens_in", "tokens_cache", "tokens_write", "tokens_out", "priced_tokens", "unattributed_tokens", "round(cost_estimate, 10) AS cost_estimate", "observations"),
    "SELECT session_id, tokens_in, tokens_cache, tokens_write, tokens_out, priced_tokens, unattributed_tokens, round(cost_estimate, 10) AS cost_estimate, observations FROM totals",
)
register(
    "observation_prices",
    lambda x: x.priced.selectExpr("id", "session_id", "rate_id", "tier", "round(cost, 10) AS cost", "priced_tokens", "unattributed_tokens"),
    "SELECT id, session_id, rate_id, tier, round(cost, 10) AS cost, priced_tokens, unattributed_tokens FROM priced",
)
register("tier_split", lambda x: ops.tier_split(x.priced), f"SELECT tier, count(*) AS observations, {BIG('priced_tokens', 'tokens')}, round(sum(cost), 4) AS cost FROM priced WHERE rate_id IS NOT NULL GROUP BY tier")
for _by in ("model", "agent_id"):
    register(
        f"attribution_prices_{_by.removesuffix('_id')}",
        lambda x, by=_by: ops.attribution_prices(x.priced, by),
        f"SELECT *, recorded_tokens - priced_tokens AS unpriced_tokens FROM (SELECT session_id, {_by} AS key, {BIG('priced_tokens')}, {BIG('unattributed_tokens')}, {BIG(ALL, 'recorded_tokens')}, round(sum(cost), 4) AS cost FROM priced GROUP BY 1, 2)",
    )
register(
    "session_models",
    lambda x: ops.session_models(x.usage),
    f"SELECT session_id, model, count(DISTINCT agent_id) AS agents, count(*) AS observations, {TOKEN_SUMS}, model <> '' AS attributed FROM usage GROUP BY session_id, model",
)
register(
    "first_report",
    lambda x: ops.first_report(x.usage).select("id", "session_id", "agent_id", "message_id", "ts", "tokens_in", "tokens_out"),
    "SELECT id, session_id, agent_id, message_id, ts, tokens_in, tokens_out FROM usage QUALIFY row_number() OVER (PARTITION BY session_id, agent_id, message_id ORDER BY ts NULLS LAST, id) = 1",
)
_FIELDS = ("tokens_in", "tokens_cache", "tokens_write", "tokens_out", "model")
_LAST = lambda x: f"arg_max({x}, struct_pack(t := coalesce(ts, TIMESTAMP '0001-01-01'), i := id)) FILTER (WHERE contains(present_mask, '{x}'))"
register(
    "merged_reports",
    lambda x: ops.merged_reports(x.usage.withColumn("present", F.split("present_mask", ","))),
    f"""SELECT session_id, agent_id, message_id, {", ".join(f"CAST(coalesce(m_{t}, 0) AS BIGINT) AS {t}" for t in _FIELDS[:4])}, coalesce(m_model, '') AS model, reports, ts,
    CASE WHEN no_id THEN 'message-without-id' WHEN m_model <> '' AND {" AND ".join(f"h_{t}" for t in _FIELDS)} THEN 'message-final' ELSE 'message-partial' END AS kind
    FROM (SELECT session_id, agent_id, message_id, {", ".join(f"{_LAST(t)} AS m_{t}, bool_or(contains(present_mask, '{t}')) AS h_{t}" for t in _FIELDS)}, count(*) AS reports, max(ts) AS ts,
        bool_and(kind = 'message-without-id') AS no_id FROM usage GROUP BY 1, 2, 3)""",
)

#: Usage as cumulative counters give it, over (id, session_id, native_id, message_id, ts, model and tokens).
_COUNTER = {
    "kind": "CASE WHEN model = '' THEN 'incomplete-attribution' WHEN tokens_in % 20 = 0 THEN 'reported-last-call' ELSE 'cumulative-delta' END",
    "counter_scope": "concat('thread:', native_id)",
    "evidence": """concat('{"offset":', session_id, ',"previousCounter":{"input":', CASE WHEN message_id LIKE '%:1' THEN 0 ELSE 1 END, ',"output":0},"counter":{"input":', tokens_in + tokens_cache + tokens_write, ',"cache":', tokens_cache, ',"cacheWrite":', tokens_write, ',"output":', tokens_out, '}}')""",
}


def _threads(x):
    """All sessions as threads of one provider on one machine."""
    return x.tables.sessions.withColumns({"provider": F.lit("beta"), "machine_id": F.lit("m")})


def _counters(x):
    """Usage as counters, where a session that carries its neighbour's native id also repeats the neighbour's observations, as a
    resumed transcript does, and a fork begins with a counter of the thread that it left."""
    other = lambda column, place: f"struct(CAST(substring({column}, 2) AS BIGINT) AS session_id, id AS other_id, native_id, {place} AS place)"
    # Usage is read once: a session takes its own, that of the session whose native id it carries, and the beginning of the one that it left.
    taken = x.tables.sessions.selectExpr(f"""inline(filter(array(struct(id AS session_id, id AS other_id, native_id, 0 AS place), CASE WHEN native_id <> concat('n', id) THEN {other("native_id", 1)} END,
        CASE WHEN forked_from_id <> '' THEN {other("forked_from_id", 2)} END), t -> t IS NOT NULL))""")
    rows = x.usage.drop("kind").join(taken, "session_id").where("place < 2 OR message_id LIKE '%:1'")
    copied = {"id": "concat(id, '/', other_id)", "source_id": "concat('s', other_id)"}
    own = [f"CASE WHEN place = 0 THEN {c} ELSE {v} END AS {c}" for c, v in copied.items()]
    kept = [c for c in x.usage.columns if c not in ("kind", "id", "source_id", "session_id", "model")]
    rows = rows.selectExpr(*kept, *own, "other_id AS session_id", "CASE WHEN place = 2 THEN '' ELSE model END AS model", "native_id")
    return rows.selectExpr("*", *[f"{v} AS {k}" for k, v in _COUNTER.items()]).drop("native_id").withColumn("present", F.array().cast("array<string>"))


_COUNTERS = f"""counters AS (SELECT r.* EXCLUDE (kind), s.native_id, s.forked_from_id, {", ".join(f"{v} AS {k}" for k, v in _COUNTER.items())}, tokens_in + tokens_cache + tokens_write + tokens_out AS total
    FROM (SELECT * FROM usage UNION ALL BY NAME SELECT u.* REPLACE (s.id AS session_id, concat(u.id, '/', s.id) AS id, 's' || s.id AS source_id) FROM usage u JOIN sessions s ON s.native_id <> concat('n', s.id) AND CAST(substr(s.native_id, 2) AS BIGINT) = u.session_id
        UNION ALL BY NAME SELECT u.* REPLACE (s.id AS session_id, concat(u.id, '/', s.id) AS id, 's' || s.id AS source_id, '' AS model) FROM usage u JOIN sessions s ON s.forked_from_id <> '' AND CAST(substr(s.forked_from_id, 2) AS BIGINT) = u.session_id WHERE u.message_id LIKE '%:1') r
    JOIN sessions s ON s.id = r.session_id)"""
_SOUND = "(SELECT *, message_id LIKE '%:1' AS first FROM counters WHERE agent_id = 'main' AND ts IS NOT NULL AND total > 0)"
_DUPLICATES = f"""duplicates AS (SELECT id, session_id, owner, CASE WHEN candidates = 2 AND n = 2 THEN CASE WHEN session_id = owner THEN other ELSE owner END END AS twin_session, CASE WHEN candidates = 2 AND n = 2 THEN 'matched' ELSE 'ambiguous' END AS state
    FROM {_SOUND} JOIN (SELECT native_id, ts, model, kind, tokens_in, tokens_cache, tokens_write, tokens_out, first, count(*) AS candidates, min(session_id) AS owner, max(session_id) AS other, count(DISTINCT session_id) AS n FROM {_SOUND} GROUP BY ALL HAVING count(DISTINCT session_id) > 1)
    USING (native_id, ts, model, kind, tokens_in, tokens_cache, tokens_write, tokens_out, first))"""
register("duplicate_usage", lambda x: ops.duplicate_usage(_counters(x), _threads(x), "beta"), "SELECT * FROM duplicates", _COUNTERS, _DUPLICATES)
register(
    "fork_baselines",
    lambda x: ops.fork_baselines(_counters(x), _threads(x), "beta"),
    f"""SELECT session_id, m.parent_session, m.parent_id, CAST(m.total AS BIGINT) AS tokens, CASE WHEN m.session_id IS NULL THEN 'unverified' ELSE 'matched' END AS state FROM (SELECT session_id FROM forks) LEFT JOIN
    (SELECT f.session_id, any_value(f.total) AS total, arg_min(p.session_id, struct_pack(s := p.session_id, i := p.id)) AS parent_session, arg_min(p.id, struct_pack(s := p.session_id, i := p.id)) AS parent_id
        FROM forks f JOIN {_SOUND} p ON p.native_id = f.forked_from_id AND p.tokens_in + p.tokens_cache + p.tokens_write = c_in AND p.tokens_cache = c_cache AND p.tokens_write = c_write AND p.tokens_out = c_out WHERE parts = 1 GROUP BY 1) m USING (session_id)""",
    _COUNTERS,
    f"""forks AS (SELECT session_id, any_value(forked_from_id) AS forked_from_id, count(*) AS parts, min(tokens_in + tokens_cache + tokens_write) AS c_in, min(tokens_cache) AS c_cache, min(tokens_write) AS c_write, min(tokens_out) AS c_out, sum(total) AS total
        FROM {_SOUND} WHERE first AND kind <> 'cumulative-delta' AND forked_from_id <> '' GROUP BY session_id)""",
)
_PROOFS = lambda x: ops.select_exclusions(ops.duplicate_usage(_counters(x), _threads(x), "beta").where("state = 'matched' AND session_id <> owner").selectExpr("id", "concat(substring_index(id, '/', 1)) AS owner_id"))
register("usage_exclusions", _PROOFS, "SELECT id, split_part(id, '/', 1) AS owner_id FROM duplicates WHERE state = 'matched' AND session_id <> owner AND contains(id, '/')", _COUNTERS, _DUPLICATES)
register(
    "contribution_totals",
    lambda x: ops.contribution_totals(_counters(x), _PROOFS(x)),
    f"""SELECT *, recorded - excluded AS counted FROM (SELECT {BIG(ALL, "recorded")}, CAST(coalesce(sum({ALL}) FILTER (WHERE id IN (SELECT id FROM duplicates WHERE state = 'matched' AND session_id <> owner AND contains(id, '/'))), 0) AS BIGINT) AS excluded FROM counters)""",
    _COUNTERS,
    _DUPLICATES,
)


#: Part keys that a document of the catalogs spans.
CATALOG_KEYS = 8192


def _catalogs(x):
    """A catalog a brand with a rate a part, in documents of CATALOG_KEYS keys; some have no price, a wrong one, an odd tier, an alias, an unknown field or one that comes twice, and some hold longer than others."""
    rate = """concat('{"id":"r', p_partkey, '","model":"', p_brand, '","aliases":["', p_brand, CASE WHEN p_partkey % 7 = 0 THEN concat('","', p_brand, '-latest') ELSE '' END, '"],"context":"standard","source":"s","tier":"', CASE WHEN p_partkey % 13 = 0 THEN 'odd' ELSE 'mid' END,
        '","effectiveFrom":"', date_add(DATE '2000-01-01', CAST(p_partkey AS INT)), ' 00:00:00","effectiveTo":"', date_add(DATE '2000-01-01', CAST(p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 60 ELSE 1 END AS INT)), ' 00:00:00","input":', CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE p_size END, ',"cacheRead":0.5',
        CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ',"cacheWrite":1.25' END, CASE WHEN p_partkey % 19 = 0 THEN ',"colour":1' ELSE '' END, CASE WHEN p_partkey % 23 = 0 THEN ',"Output":7' ELSE '' END, CASE WHEN p_partkey % 29 = 0 THEN ',"cacheRead":0.5' ELSE '' END, ',"output":5}')"""
    own = ("p_brand", "block")
    parts = x.tables.parts.selectExpr("p_brand", f"p_partkey DIV {CATALOG_KEYS} AS block", "p_partkey", f"{rate} AS rate")
    rows = parts.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "rate"))).alias("rates"))
    # One narrow row a document.
    earlier = Window.partitionBy("p_brand").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy(*own).agg(F.count("*").alias("n")).select(*own, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return rows.join(first, list(own)).select(F.col("p_brand").alias("catalog_id"), "first", F.concat(F.lit('{"rates":['), F.array_join("rates.rate", ","), F.lit("]}")).alias("json"))


_RATES = lambda x: ops.read_rates(_catalogs(x))
_RATE_ROWS = """rate_rows AS (SELECT p_brand AS catalog_id, p_partkey AS k, 'r' || p_partkey AS rate_id, p_brand || a AS model, CASE WHEN p_partkey % 13 = 0 THEN 'odd' ELSE 'mid' END AS tier, CAST(CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE p_size END AS DOUBLE) AS input,
    CASE WHEN p_partkey % 11 > 0 THEN 1.25::DOUBLE END AS cache_write, 5.0::DOUBLE AS output, p_partkey AS d0, p_partkey + CASE WHEN p_partkey % 10 = 0 THEN 60 ELSE 1 END AS d1 FROM part JOIN (VALUES (''), ('-latest')) v(a) ON a = '' OR p_partkey % 7 = 0)"""
register("read_rates", lambda x: _RATES(x).select("catalog_id", "rate_id", "model", "tier", "input", "cache_write", "output"), "SELECT catalog_id, rate_id, model, tier, input, cache_write, output FROM rate_rows", _RATE_ROWS)
register(
    "rate_problems",
    lambda x: ops.rate_problems(_RATES(x).unionByName(_RATES(x).where("rate_id LIKE '%7' AND model LIKE '%-latest'"))),
    """SELECT DISTINCT rate_id, problem FROM (SELECT rate_id, unnest([CASE WHEN tier = 'odd' THEN 'tier' END, CASE WHEN cache_write IS NULL THEN 'missing-price' END, CASE WHEN input < 0 THEN 'invalid-price' END, CASE WHEN rate_id LIKE '%7' AND model LIKE '%-latest' THEN 'duplicate' END]) AS problem FROM rate_rows) WHERE problem IS NOT NULL""",
    _RATE_ROWS,
)
register(
    "rate_field_problems",
    lambda x: ops.rate_field_problems(_catalogs(x)),
    """SELECT catalog_id, place, problem FROM (SELECT p_brand AS catalog_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, unnest([CASE WHEN p_partkey % 23 = 0 OR p_partkey % 29 = 0 THEN 'repeated-field' END, CASE WHEN p_partkey % 19 = 0 AND p_partkey % 29 > 0 THEN 'unknown-field' END]) AS problem FROM part) WHERE problem IS NOT NULL""",
)
register(
    "rate_conflicts",
    lambda x: ops.rate_conflicts(_RATES(x)),
    """SELECT a.rate_id AS left_id, b.rate_id AS right_id, a.model FROM rate_rows a JOIN rate_rows b ON a.model = b.model AND a.rate_id < b.rate_id AND a.d0 < b.d1 AND b.d0 < a.d1""",
    _RATE_ROWS,
)
