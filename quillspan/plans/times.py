"""Queries over civil time: calendar, rhythm, rings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspan.operators import economics, timeview as ops
from quillspan.plans.base import AGENTS, ALL, BIG, DAY, MONEY, TIER, register

START, END = dt.date(1997, 7, 1), dt.date(1998, 7, 31)


def _days(x):
    return ops.civil_days(x.spark, START, END)


def _calendar(x):
    return ops.calendar(x.catalog, x.health, _days(x))


def _dated(df, column):
    """A date as text, which every client reads alike."""
    return df.withColumn(column, F.date_format(column, DAY))


def _rhythm(x):
    return ops.rhythm(x.catalog, x.health, x.usage.groupBy("session_id").agg(F.min("ts").alias("first_usage")))


_CALENDAR = f"""cal AS (SELECT CAST(d AS DATE) AS day, count(c.id) AS sessions, round(sum(cost_estimate), 2) AS cost, count(cost_estimate) AS with_cost, {BIG(ALL, "tokens")}, {BIG("priced_tokens")}, {BIG("errors")}, {BIG("incomplete")}, {BIG("agents")}
    FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}', INTERVAL 1 DAY) s(d) LEFT JOIN (SELECT cat.*, errors, incomplete, agents FROM cat LEFT JOIN health h ON h.session_id = cat.id) c ON CAST(c.last_activity AS DATE) = CAST(d AS DATE) GROUP BY 1)"""
register("calendar", lambda x: _dated(_calendar(x), "day"), "SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM cal", _CALENDAR)
register(
    "busiest_day",
    lambda x: _dated(ops.busiest_day(_calendar(x)), "day"),
    "SELECT (SELECT strftime(day, '%Y-%m-%d') FROM cal ORDER BY sessions DESC, day LIMIT 1) AS day, max(sessions) AS sessions, CAST(sum(sessions) AS BIGINT) AS total, count(*) FILTER (WHERE sessions > 0) AS active_days FROM cal",
    _CALENDAR,
)
_RHYTHM = f"""starts AS (SELECT c.id, errors, incomplete, {ALL} AS tokens, least(h.first_at, u.first_usage) AS start FROM cat c LEFT JOIN health h ON h.session_id = c.id LEFT JOIN (SELECT session_id, min(ts) AS first_usage FROM usage GROUP BY 1) u ON u.session_id = c.id),
slots AS (SELECT 'hour' AS kind, CAST(i AS INT) AS slot FROM range(24) r(i) UNION ALL SELECT 'weekday', CAST(i AS INT) FROM range(7) r(i) UNION ALL SELECT 'undated', 0 UNION ALL SELECT 'outside', 0),
placed AS (SELECT *, 'hour' AS kind, hour(start) AS slot FROM starts WHERE start IS NOT NULL UNION ALL SELECT *, 'weekday', isodow(start) - 1 FROM starts WHERE start IS NOT NULL UNION ALL SELECT *, 'undated', 0 FROM starts WHERE start IS NULL),
rhythm AS (SELECT kind, slot, count(id) AS sessions, count(*) FILTER (WHERE errors > 0) AS with_errors, count(*) FILTER (WHERE incomplete > 0) AS with_incomplete, {BIG("tokens")} FROM slots LEFT JOIN placed USING (kind, slot) GROUP BY 1, 2)"""
register("rhythm", _rhythm, "SELECT * FROM rhythm", _RHYTHM)
register(
    "rhythm_metric",
    lambda x: ops.rhythm_metric(_rhythm(x)),
    """SELECT kind, slot, rate, sessions >= 3 AND with_incomplete = 0 AS judged, CASE WHEN sessions = 0 THEN 'none' WHEN sessions < 3 OR with_incomplete > 0 THEN 'dim' WHEN rate > 30 THEN 'red' WHEN rate >= 10 THEN 'amber' ELSE 'green' END AS level
    FROM (SELECT *, CASE WHEN sessions > 0 THEN CAST(floor(100 * with_errors / sessions + 0.5) AS BIGINT) END AS rate FROM rhythm)""",
    _RHYTHM,
)
_SIDES = ", ".join(f"CAST(sum({c}) FILTER (WHERE slot {'< 6' if s == 'night' else '>= 6'}) AS BIGINT) AS {s}_{k}" for k, c in (("n", "sessions"), ("e", "with_errors"), ("i", "with_incomplete")) for s in ("night", "day"))
register(
    "rhythm_overnight",
    lambda x: ops.overnight(_rhythm(x)),
    f"""SELECT night_n, day_n, night_e, day_e, night_i, day_i, round(nr, 4) AS night_rate, round(dr, 4) AS day_rate, CASE WHEN night_n < 15 OR day_n < 15 THEN 'not-enough-sessions' WHEN night_i > 0 OR day_i > 0 THEN 'incomplete-evidence'
        WHEN abs(nr - dr) <= greatest(10.0, 200 * greatest(sqrt(nr / 100 * (1 - nr / 100) / night_n), sqrt(dr / 100 * (1 - dr / 100) / day_n))) THEN 'too-close' WHEN nr > dr THEN 'night-higher' ELSE 'night-lower' END AS verdict
    FROM (SELECT *, CASE WHEN night_n > 0 THEN 100 * night_e / night_n END AS nr, CASE WHEN day_n > 0 THEN 100 * day_e / day_n END AS dr FROM (SELECT {_SIDES} FROM rhythm WHERE kind = 'hour'))""",
    _RHYTHM,
)
_RINGS = lambda keep, at="last_activity": f"""SELECT strftime(w, '%Y-%m-%d') AS week, count(c.id) AS sessions, count(*) FILTER (WHERE errors > 0) AS with_errors, {BIG(ALL, "tokens")}, round(sum(cost_estimate), 2) AS cost
    FROM (SELECT unnest(generate_series(greatest(first, last - INTERVAL 63 DAY), last, INTERVAL 7 DAY)) AS w FROM (SELECT CAST(date_trunc('week', max({at})) AS TIMESTAMP) AS last, CAST(date_trunc('week', min({at})) AS TIMESTAMP) AS first FROM cat WHERE {keep}) WHERE last IS NOT NULL)
    LEFT JOIN (SELECT cat.*, errors FROM cat LEFT JOIN health h ON h.session_id = cat.id WHERE {keep}) c ON date_trunc('week', {at}) = w GROUP BY 1"""  # noqa: E731
register("rings", lambda x: _dated(ops.rings(x.catalog, x.health), "week"), _RINGS("NOT archived"))
_TIERS = """tiers AS (SELECT session_id AS id, CAST(coalesce(sum(priced_tokens) FILTER (WHERE tier <> 'unknown'), 0) AS BIGINT) AS tier_tokens, sum(cost) FILTER (WHERE tier <> 'unknown') AS classified_cost, sum(CASE WHEN tier IN ('flagship', 'premium') THEN cost WHEN tier <> 'unknown' THEN 0 END) AS top_cost
    FROM priced WHERE rate_id IS NOT NULL GROUP BY 1)"""
#: Berlin's summer times in the years that the queries in a zone look at, in UTC.
_BERLIN = "(last_activity + CASE WHEN last_activity >= TIMESTAMP '1997-03-30 01:00:00' AND last_activity < TIMESTAMP '1997-10-26 01:00:00' OR last_activity >= TIMESTAMP '1998-03-29 01:00:00' AND last_activity < TIMESTAMP '1998-10-25 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END)"


def _shifted(x):
    """The catalog of the zone's years, with activity spread over the hours of the day."""
    at = F.col("last_activity") + F.make_dt_interval(F.lit(0), F.col("id").cast("int") % 24, F.col("id").cast("int") % 60)
    return x.catalog.withColumn("last_activity", at).where("last_activity >= TIMESTAMP_NTZ '1997-02-01' AND last_activity < TIMESTAMP_NTZ '1998-12-01'")


_SHIFTED = "cat_z AS (SELECT * FROM (SELECT * REPLACE (last_activity + INTERVAL 1 HOUR * (id % 24) + INTERVAL 1 MINUTE * (id % 60) AS last_activity) FROM cat) WHERE last_activity >= TIMESTAMP '1997-02-01' AND last_activity < TIMESTAMP '1998-12-01')"
register("rings_in_zone", lambda x: _dated(ops.rings(_shifted(x), x.health, tz="Europe/Berlin", project="assigned"), "week"), _RINGS("NOT archived AND project = 'assigned'", _BERLIN).replace("FROM cat ", "FROM cat_z cat "), _SHIFTED)
_ZONE_DAYS = (dt.date(1997, 9, 20), dt.date(1998, 4, 10))
register(
    "calendar_in_zone",
    lambda x: _dated(ops.calendar(_shifted(x), x.health, ops.civil_days(x.spark, *_ZONE_DAYS, "Europe/Berlin"), "Europe/Berlin", ops.session_tiers(x.priced)), "day").select("day", "sessions", "tokens", "errors", "top_cost", "tier_tokens"),
    f"""SELECT strftime(d, '%Y-%m-%d') AS day, count(c.id) AS sessions, {BIG(ALL, "tokens")}, {BIG("errors")}, round(sum(top_cost), 4) AS top_cost, {BIG("tier_tokens")} FROM generate_series(TIMESTAMP '{_ZONE_DAYS[0]}', TIMESTAMP '{_ZONE_DAYS[1]}', INTERVAL 1 DAY) s(d)
    LEFT JOIN (SELECT cat_z.*, {_BERLIN} AS here, errors, t.top_cost, t.tier_tokens FROM cat_z LEFT JOIN health h ON h.session_id = cat_z.id LEFT JOIN tiers t ON t.id = cat_z.id) c ON CAST(c.here AS DATE) = CAST(d AS DATE) GROUP BY d""",
    _SHIFTED,
    _TIERS,
)
_RANGE = ("1996-01-01", "2000-01-01")
_RANGED = f"""ranged AS (SELECT kind, slot, count(id) AS sessions, {BIG("tokens")}, {BIG("tier_tokens")}, round(sum(classified_cost), 4) AS classified_cost, round(sum(top_cost), 4) AS top_cost FROM slots LEFT JOIN (SELECT p.*, t.tier_tokens, t.classified_cost, t.top_cost FROM (
    SELECT * FROM placed WHERE kind = 'undated' OR start >= TIMESTAMP '{_RANGE[0]}' AND start < TIMESTAMP '{_RANGE[1]}' UNION ALL BY NAME SELECT * REPLACE ('outside' AS kind, 0 AS slot) FROM placed WHERE kind = 'hour' AND NOT (start >= TIMESTAMP '{_RANGE[0]}' AND start < TIMESTAMP '{_RANGE[1]}')) p
    LEFT JOIN tiers t ON t.id = p.id) USING (kind, slot) GROUP BY 1, 2)"""


def _ranged(x):
    bounds = [F.lit(d).cast("timestamp_ntz") for d in _RANGE]
    return ops.rhythm(x.catalog, x.health, x.usage.groupBy("session_id").agg(F.min("ts").alias("first_usage")), "UTC", *bounds, ops.session_tiers(x.priced))


register("rhythm_in_range", lambda x: _ranged(x).select("kind", "slot", "sessions", "tokens", "tier_tokens", "classified_cost", "top_cost"), "SELECT * FROM ranged", _RHYTHM, _TIERS, _RANGED)
register(
    "rhythm_top_tier",
    lambda x: ops.rhythm_metric(_ranged(x).withColumn("tier_tokens", F.when(F.col("slot") % 2 == 0, F.col("tokens")).otherwise(F.col("tier_tokens"))), "topTier"),
    """SELECT kind, slot, rate, judged, CASE WHEN sessions = 0 THEN 'none' WHEN NOT judged THEN 'dim' WHEN rate > 66 THEN 'red' WHEN rate >= 33 THEN 'amber' ELSE 'green' END AS level
    FROM (SELECT *, sessions >= 3 AND tokens > 0 AND (slot % 2 = 0 OR tier_tokens = tokens) AND rate IS NOT NULL AS judged FROM (SELECT *, CASE WHEN classified_cost > 0 THEN CAST(floor(100 * top_cost / classified_cost + 0.5) AS BIGINT) END AS rate FROM ranged))""",
    _RHYTHM,
    _TIERS,
    _RANGED,
)
_TIER_NAMES = ("flagship", "premium", "mid", "cheap", "unknown")
register(
    "top_tier_metric",
    lambda x: ops.top_tier_metric(economics.tier_mix(x.named_usage).join(x.tables.sessions.selectExpr("id AS session_id", "last_activity"), "session_id").where("last_activity IS NOT NULL"), F.date_format("last_activity", "yyyy-MM")),
    f"""SELECT bucket, n, rate, n >= 3 AND rate IS NOT NULL AS judged FROM (SELECT bucket, count(*) AS n, CASE WHEN sum(total) > 0 THEN least(100.0, round(100 * sum(top) / sum(total))) END AS rate FROM (SELECT session_id, strftime(s.last_activity, '%Y-%m') AS bucket, {MONEY("coalesce(sum(cost) FILTER (WHERE tier = 'flagship'), 0)")} + {MONEY("coalesce(sum(cost) FILTER (WHERE tier = 'premium'), 0)")} AS top,
        {" + ".join(MONEY(f"coalesce(sum(cost) FILTER (WHERE tier = '{t}'), 0)") for t in _TIER_NAMES)} AS total FROM (SELECT *, {TIER} AS tier FROM named WHERE agent_id <> '' AND model <> '') JOIN sessions s ON s.id = session_id WHERE s.last_activity IS NOT NULL GROUP BY 1, 2) GROUP BY 1)""",
    *AGENTS,
)
register(
    "bucket_metric",
    lambda x: ops.bucket_metric(x.catalog.where("last_activity IS NOT NULL"), x.health, F.date_format("last_activity", "yyyy-MM-dd")),
    """SELECT bucket, n, bad, CASE WHEN n >= 3 THEN round(100 * bad / n, 4) END AS trouble_pct FROM (SELECT strftime(last_activity, '%Y-%m-%d') AS bucket, count(*) AS n, count(*) FILTER (WHERE errors > 0) AS bad
    FROM cat LEFT JOIN health h ON h.session_id = cat.id WHERE last_activity IS NOT NULL GROUP BY 1)""",
)
