"""Queries over costs, models and agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import economics as ops
from quillspan.plans.base import AGENTS, ALL, BIG, MONEY, NOW, TIER, now, register

_LANES = ("cost_input", "cost_cache_read", "cost_cache_write", "cost_output")
_LANE_CAT = f"lanes AS (SELECT c.*, {', '.join('x.' + c for c in _LANES)} FROM cat c LEFT JOIN (SELECT session_id, {', '.join(f'sum({c}) AS {c}' for c in _LANES)} FROM priced GROUP BY 1) x ON x.session_id = c.id)"
register(
    "economics_costs",
    lambda x: ops.economics_costs(x.catalog),
    f"""SELECT *, sessions - sessions_with_breakdown AS sessions_without_breakdown, recorded_tokens - priced_tokens AS unpriced_tokens, priced_tokens - broken_down_tokens AS priced_without_breakdown FROM (SELECT count(*) AS sessions, {BIG(ALL, "recorded_tokens")}, {BIG("priced_tokens")},
    round(sum(cost_estimate), 4) AS known_cost, count(cost_input) AS sessions_with_breakdown, {BIG("CASE WHEN cost_input IS NOT NULL THEN priced_tokens END", "broken_down_tokens")}, {", ".join(MONEY(f"coalesce(sum({c}), 0)") + f" AS {c}" for c in _LANES)} FROM lanes)""",
    _LANE_CAT,
)
_BUCKET = lambda n: f"CASE WHEN {n} = 0 THEN -1 WHEN {n} <= 2 THEN 0 WHEN {n} <= 5 THEN 1 WHEN {n} <= 10 THEN 2 WHEN {n} <= 20 THEN 3 WHEN {n} <= 40 THEN 4 WHEN {n} <= 80 THEN 5 WHEN {n} <= 160 THEN 6 ELSE 7 END"
_LABELS = "['1–2', '3–5', '6–10', '11–20', '21–40', '41–80', '81–160', '161+']"
_ZERO = lambda *names: ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in names)
register(
    "economics_lifetimes",
    lambda x: ops.economics_lifetimes(x.catalog, x.usage, "alpha"),
    f"""SELECT CAST(b AS INT) AS bucket, {_ZERO("agents", "messages", "recorded_tokens", "unstable_agents", "eligible_agents", "eligible_messages")}, comparable_cost, CASE WHEN b >= 0 THEN {_LABELS}[b + 1] END AS label FROM range(-1, 8) r(b) LEFT JOIN (
    SELECT {_BUCKET("messages")} AS bucket, count(*) AS agents, sum(messages) AS messages, sum(recorded) AS recorded_tokens, count(*) FILTER (WHERE unstable > 0) AS unstable_agents, count(*) FILTER (WHERE ok) AS eligible_agents,
        sum(CASE WHEN ok THEN messages END) AS eligible_messages, round(sum(CASE WHEN ok THEN cost_estimate END), 4) AS comparable_cost
    FROM (SELECT *, messages > 0 AND unsupported = 0 AND observed = recorded AND recorded > 0 AND observations > 0 AND priced_tokens = recorded AND cost_estimate IS NOT NULL AS ok FROM (
        SELECT c.id, {ALL.replace("tokens_", "c.tokens_")} AS recorded, c.priced_tokens, c.cost_estimate, c.observations, coalesce(messages, 0) AS messages, coalesce(unstable, 0) AS unstable, coalesce(unsupported, 0) AS unsupported, coalesce(observed, 0) AS observed
        FROM cat c LEFT JOIN (SELECT u.session_id, count(*) FILTER (WHERE u.agent_id = s.native_agent_id AND kind IN ('message-final', 'message-partial')) AS messages, count(*) FILTER (WHERE u.agent_id = s.native_agent_id AND kind = 'message-without-id') AS unstable,
            count(*) FILTER (WHERE u.agent_id <> s.native_agent_id OR kind NOT IN ('message-final', 'message-partial')) AS unsupported, sum({ALL}) AS observed FROM usage u JOIN sessions s ON s.id = u.session_id GROUP BY 1) x ON x.session_id = c.id
        WHERE c.provider = 'alpha' AND c.native_agent_id <> '')) GROUP BY 1) ON bucket = b""",
)
_FLOW = """flow AS (SELECT session_id, agent_id, CASE WHEN sum(priced_tokens) > 0 THEN round(sum(cost), 10) END AS cost, CAST(sum(tokens_out) AS DOUBLE) AS output FROM priced GROUP BY 1, 2)"""
register(
    "cost_flow",
    lambda x: ops.cost_flow(x.priced, x.names),
    """SELECT session_id, agent_id, "by", value, CAST(position AS INT) AS position, coalesce(name, '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY session_id, "by" ORDER BY value DESC, agent_id) AS position FROM (
        SELECT session_id, agent_id, 'cost' AS "by", cost AS value FROM flow WHERE cost > 0 UNION ALL SELECT session_id, agent_id, 'output', output FROM flow WHERE output > 0)) LEFT JOIN names USING (session_id, agent_id) WHERE position <= 14""",
    _FLOW,
)
_AGENT_COUNTS = ("events", "tool_calls", "errors", "observations", "tokens_in", "tokens_cache", "tokens_write", "tokens_out", "unknown_model_tokens")
register(
    "session_agents",
    lambda x: ops.session_agents(x.events, x.usage, x.priced),
    f"""SELECT session_id, agent_id, {_ZERO(*_AGENT_COUNTS)}, CASE WHEN priced > 0 THEN round(cost, 10) END AS cost, CASE WHEN priced > 0 THEN CAST(priced AS BIGINT) END AS priced_tokens
    FROM (SELECT session_id, agent_id, count(*) AS events, count(*) FILTER (WHERE kind = 'tool-call') AS tool_calls, count(*) FILTER (WHERE error) AS errors FROM agent_events GROUP BY 1, 2)
    FULL JOIN (SELECT session_id, agent_id, count(*) AS observations, {", ".join(f"sum({t}) AS {t}" for t in _AGENT_COUNTS[4:8])}, sum(CASE WHEN model = '' THEN {ALL} ELSE 0 END) AS unknown_model_tokens, sum(cost) AS cost, sum(priced_tokens) AS priced FROM priced GROUP BY 1, 2)
    USING (session_id, agent_id)""",
)


def _comparisons(x):
    """Comparisons of every third session at the rates of 1996, some of them of an older offset."""
    usage = x.usage.where("session_id % 3 = 0")
    from quillspan.operators.usage import price

    totals = price(usage, x.tables.rates, at=F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("session_id").agg(F.sum("priced_tokens").cast("long").alias("priced_tokens"), F.sum("unattributed_tokens").cast("long").alias("unattributed_tokens"), F.sum("cost").alias("cost"))
    return totals.selectExpr("*", "1 AS generation", "1 AS revision", "CAST(1000 + session_id AS BIGINT) AS indexed_offset")


register(
    "comparison_totals",
    lambda x: ops.comparison_totals(x.catalog, _comparisons(x), x.tables.sources),
    f"""SELECT *, recorded_tokens - priced_tokens AS unpriced_tokens FROM (SELECT count(*) AS sessions, count(k.session_id) AS sessions_with_comparison, CAST(sum({ALL.replace("tokens_", "c.tokens_")}) AS BIGINT) AS recorded_tokens, {BIG("k.priced", "priced_tokens")}, {BIG("k.unattributed", "unattributed_tokens")},
        round(sum(CASE WHEN k.priced > 0 THEN k.cost END), 4) AS cost_estimate FROM cat c LEFT JOIN log_sources so ON so.source_id = c.source_id
        LEFT JOIN (SELECT session_id, 1000 + session_id AS at, sum(CASE WHEN rate_id IS NOT NULL AND ok THEN {ALL} ELSE 0 END) AS priced, sum(CASE WHEN model = '' OR kind <> 'message-final' THEN {ALL} ELSE 0 END) AS unattributed,
            sum(CASE WHEN rate_id IS NOT NULL AND ok THEN (tokens_in * input + tokens_cache * cache_read + tokens_write * cache_write + tokens_out * output) / 1e6 END) AS cost
            FROM (SELECT u.*, r.* EXCLUDE (m), kind <> 'message-partial' AS ok FROM usage u LEFT JOIN (SELECT model AS m, any_value(rate_id) AS rate_id, any_value(input) AS input, any_value(cache_read) AS cache_read, any_value(cache_write) AS cache_write, any_value(output) AS output FROM rates
                WHERE effective_from <= TIMESTAMP '1996-01-01' AND (effective_to IS NULL OR effective_to > TIMESTAMP '1996-01-01') GROUP BY model HAVING count(*) = 1) r ON r.m = u.model WHERE session_id % 3 = 0) GROUP BY 1) k ON k.session_id = c.id AND k.at = so.indexed_offset)""",
)
register(
    "name_costs",
    lambda x: x.named_usage.selectExpr("id", "model", "round(cost, 10) AS cost"),
    "SELECT id, model, round(cost, 10) AS cost FROM named",
    *AGENTS,
)
_MODELS = f"""models AS (SELECT session_id, model, any_value({TIER}) AS tier, count(DISTINCT agent_id) AS agents, coalesce(sum(cost), 0) AS cost, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM named WHERE agent_id <> '' AND model <> '' GROUP BY 1, 2)"""
register(
    "model_breakdown",
    lambda x: ops.model_breakdown(x.named_usage),
    f"""SELECT session_id, model, tier, agents, {MONEY("cost")} AS cost, tokens_out, CASE WHEN total > 0 THEN round(top / total, 3) END AS top_tier_share
    FROM models JOIN (SELECT session_id, sum(cost) AS total, sum(CASE WHEN tier IN ('flagship', 'premium') THEN cost ELSE 0 END) AS top FROM models GROUP BY 1) USING (session_id)""",
    *AGENTS,
    _MODELS,
)
register(
    "tier_mix",
    lambda x: ops.tier_mix(x.named_usage),
    "SELECT session_id, " + ", ".join(MONEY(f"coalesce(sum(cost) FILTER (WHERE tier = '{t}'), 0)") + f" AS {t}" for t in ("flagship", "premium", "mid", "cheap", "unknown")) + " FROM models GROUP BY 1",
    *AGENTS,
    _MODELS,
)
_PRICE = lambda k: "CASE " + " ".join(f"WHEN contains(model, '{m}') THEN {(i, o)[k]}::DOUBLE" for m, i, o in (("fable", 10.0, 50.0), ("mythos", 10.0, 50.0), ("opus", 5.0, 25.0), ("sonnet", 3.0, 15.0), ("haiku", 1.0, 5.0), ("gpt-5", 1.25, 10.0), ("gpt-4", 2.5, 10.0), ("o3", 2.0, 8.0), ("o4", 1.1, 4.4))) + " END"
_SPLIT = f"""split AS (SELECT *, tokens_in * {_PRICE(0)} / 1e6 AS cost_input, tokens_cache * 0.1::DOUBLE * {_PRICE(0)} / 1e6 AS cost_cache_read, tokens_write * 1.25::DOUBLE * {_PRICE(0)} / 1e6 AS cost_cache_write, tokens_out * {_PRICE(1)} / 1e6 AS cost_output FROM named)"""
_SUBS = "count(*) AS subs, round(coalesce(sum(CASE WHEN replies <= 2 THEN coalesce(cost, 0) END), 0), 2) AS one_shot_cost, count(*) FILTER (WHERE priced_replies < 0.9 * replies) AS unpriced_agents FROM agents WHERE agent_id <> 'main' AND replies > 0"
register(
    "session_economics",
    lambda x: ops.session_economics(x.named_usage, x.agents, "session_id"),
    f"""SELECT session_id, {", ".join(_LANES)}, coalesce(subs, 0) AS subs, coalesce(one_shot_cost, 0) AS one_shot_cost, coalesce(unpriced_agents, 0) AS unpriced_agents FROM (SELECT session_id, {", ".join(f"round(coalesce(sum({c}), 0), 2) AS {c}" for c in _LANES)} FROM split GROUP BY 1)
    LEFT JOIN (SELECT session_id, {_SUBS} GROUP BY 1) USING (session_id)""",
    *AGENTS,
    _SPLIT,
)
_CURVE = f"""curve AS (SELECT {_BUCKET("replies")} AS bucket, count(*) AS agents, CAST(sum(replies) AS BIGINT) AS turns, round(sum(coalesce(cost, 0)), 2) AS cost FROM agents WHERE agent_id <> 'main' AND replies > 0 AND priced_replies >= 0.9 * replies GROUP BY 1)"""
_SWEET = f"""sweet AS (SELECT bucket, {_LABELS}[bucket + 1] AS label, p FROM (SELECT bucket, cost / turns AS p, count(*) OVER () AS n FROM curve WHERE agents >= 5) WHERE n >= {{least}} ORDER BY p, bucket LIMIT 1)"""
register("lifetime_curve", lambda x: ops.lifetime_curve(x.agents), "SELECT * FROM curve", *AGENTS, _CURVE)
register("sweet_spot", lambda x: ops.sweet_spot(ops.lifetime_curve(x.agents), least_buckets=1), "SELECT CAST(bucket AS INT) AS bucket, label, round(p, 6) AS cost_per_turn FROM sweet", *AGENTS, _CURVE, _SWEET.format(least=1))
register(
    "economics_snapshot",
    lambda x: ops.economics_snapshot(x.named_usage, x.agents),
    f"""SELECT subs, round(total, 2) AS total_usd, CASE WHEN total >= 1 THEN round((cost_cache_read + cost_cache_write) / total, 2) END AS context_share, CASE WHEN total >= 1 THEN round(cost_output / total, 2) END AS output_share, CASE WHEN a >= 10 THEN round(t / a, 2) END AS top_tier_share,
    round(coalesce(c, 0), 2) AS cheap_usd, one_shot_cost, CAST(bucket AS INT) AS sweet_bucket, round(round(p, 6), 3) AS sweet_per_turn
    FROM (SELECT *, cost_input + cost_cache_read + cost_cache_write + cost_output AS total FROM (SELECT {", ".join(f"round(coalesce(sum({c}), 0), 2) AS {c}" for c in _LANES)} FROM split)), (SELECT {_SUBS}),
        (SELECT sum(cost) AS a, coalesce(sum(CASE WHEN {TIER} IN ('flagship', 'premium') THEN cost END), 0) AS t, sum(CASE WHEN {TIER} = 'cheap' THEN cost END) AS c FROM named) LEFT JOIN sweet ON true""",
    *AGENTS,
    _SPLIT,
    _CURVE,
    _SWEET.format(least=3),
)
register(
    "session_summaries",
    lambda x: ops.session_summaries(x.catalog, x.agents, x.named_usage, now()),
    f"""SELECT id, title, machine_id, project, coalesce(agents, 0) AS agents, CAST(coalesce(errors, 0) AS BIGINT) AS errors, tokens_in, tokens_out, {MONEY("cost")} AS cost, CASE WHEN cost > 0 THEN round(top / cost, 3) END AS top_tier_share,
    coalesce(last_at > TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND last_at <= TIMESTAMP '{NOW}', false) AS active FROM cat LEFT JOIN (SELECT session_id, count(*) AS agents, sum(errors) AS errors, max(last_at) AS last_at FROM agents GROUP BY 1) a ON a.session_id = id
    LEFT JOIN (SELECT session_id, sum(cost) AS cost, sum(CASE WHEN tier IN ('flagship', 'premium') THEN cost ELSE 0 END) AS top FROM (SELECT session_id, cost, {TIER} AS tier FROM named WHERE agent_id <> '' AND model <> '') GROUP BY 1) m ON m.session_id = id""",
    *AGENTS,
)
_BARS = {
    "day": "strftime(last_activity, '%Y-%m-%d')", "month": "strftime(last_activity, '%Y-%m')", "year": "strftime(last_activity, '%Y')",
    "week": "strftime(last_activity, '%Y') || '-W' || lpad(CAST(CAST(ceil((epoch_us(last_activity - CAST(date_trunc('year', last_activity) AS TIMESTAMP)) / 86400000000 + dayofweek(date_trunc('year', last_activity)) + 1) / 7) AS INT) AS VARCHAR), 2, '0')",
}
for _by, _metric, _value in (("week", "cost", "round(sum(coalesce(cost_estimate, 0)), 4)"), ("month", "tokens", "CAST(sum(tokens_in + tokens_out) AS DOUBLE)"), ("year", "sessions", "CAST(count(*) AS DOUBLE)")):
    register(f"usage_bars_{_by}", lambda x, by=_by, metric=_metric: ops.usage_bars(x.catalog, by, metric), f"SELECT {_BARS[_by]} AS bucket, provider, {_value} AS value, count(*) AS sessions FROM cat WHERE last_activity IS NOT NULL GROUP BY 1, 2")
_HISTORY = """SELECT CAST(date_trunc('month', last_activity) AS {ts}) AS "at", sum(cost_estimate) AS known_cost, CAST(sum(tokens_in + tokens_cache + tokens_write + tokens_out) AS BIGINT) AS recorded_tokens, CAST(sum(priced_tokens) + CASE WHEN max(id) % 5 = 0 THEN 1000000000 ELSE 0 END AS BIGINT) AS priced_tokens"""


def _history(x):
    return x.catalog.where("last_activity IS NOT NULL").groupBy(F.date_trunc("month", "last_activity").cast("timestamp_ntz").alias("at")).agg(
        F.sum("cost_estimate").alias("known_cost"), F.sum(F.expr("tokens_in + tokens_cache + tokens_write + tokens_out")).alias("recorded_tokens"), (F.sum("priced_tokens") + F.when(F.max("id") % 5 == 0, 1_000_000_000).otherwise(0)).alias("priced_tokens"),
    )


register(
    "economics_history_series",
    lambda x: ops.history_series(_history(x)).withColumn("known_cost", F.round("known_cost", 4)),
    f"""SELECT "at", round(known_cost, 4) AS known_cost, recorded_tokens, round(CASE WHEN recorded_tokens > 0 THEN 100 * priced_tokens / recorded_tokens END, 4) AS coverage_pct FROM ({_HISTORY.format(ts="TIMESTAMP")} FROM cat WHERE last_activity IS NOT NULL GROUP BY 1)
    WHERE priced_tokens BETWEEN 0 AND recorded_tokens""",
)
register(
    "agent_rollup",
    lambda x: ops.agent_rollup(x.agents, x.tables.sources, now()),
    f"""SELECT machine_id, coalesce(parsed, 0) AS parsed, coalesce(active, 0) AS active, coalesce(discovered, 0) AS discovered FROM (SELECT machine_id, count(*) AS parsed, count(*) FILTER (WHERE coalesce(last_at > TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AND last_at <= TIMESTAMP '{NOW}', false)) AS active FROM agents GROUP BY 1)
    FULL JOIN (SELECT machine_id, count(*) AS discovered FROM log_sources GROUP BY 1) USING (machine_id)""",
    *AGENTS,
)
register(
    "fleet_cards",
    lambda x: ops.fleet_cards(x.agents.where("last_at IS NOT NULL AND machine_id < 'M'").groupBy("machine_id").agg(F.countDistinct("session_id").alias("sessions"), F.max("last_at").alias("last_seen")), x.catalog.groupBy("machine_id").agg(F.count("*").alias("sessions"), F.max("last_activity").alias("latest"))),
    """SELECT machine_id, l.machine_id IS NOT NULL AS live, coalesce(l.sessions, h.sessions) AS sessions, coalesce(last_seen, latest) AS last_seen FROM (SELECT machine_id, count(DISTINCT session_id) AS sessions, max(last_at) AS last_seen FROM agents WHERE last_at IS NOT NULL AND machine_id < 'M' GROUP BY 1) l
    FULL JOIN (SELECT machine_id, count(*) AS sessions, max(last_activity) AS latest FROM cat GROUP BY 1) h USING (machine_id)""",
    *AGENTS,
)
_MEASURE = f"""SELECT {{at}} AS "at", known_cost, recorded_tokens, priced_tokens FROM (SELECT round(sum(cost_estimate), 4) AS known_cost, {BIG(ALL, "recorded_tokens")}, {BIG("priced_tokens")} FROM cat)"""
for _name, _at, _timed in (("due", "2002-01-01 00:00:00", True), ("asked", "1900-01-01 00:00:00", False)):
    # The timer may only add a point 20 hours after the last; whoever asks gets one at once.
    register(
        f"economics_capture_{_name}",
        lambda x, at=_at, timed=_timed: ops.capture(_history(x), ops.economics_costs(x.catalog).select("known_cost", "recorded_tokens", "priced_tokens"), F.lit(at).cast("timestamp_ntz"), timed=timed),
        _MEASURE.format(at=f"TIMESTAMP '{_at}'"),
    )
