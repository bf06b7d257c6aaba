"""Queries over the session catalog, machines and sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspan.functions.columns import all_tokens, flow_role, identity, json_flag, json_type, utc_text
from quillspan.functions.storage import fresh_path, settle
from quillspan.operators import catalog as ops, index, upkeep
from quillspan.operators.catalog import SessionQuery
from quillspan.plans.base import ALL, BIG, NOW, coverage, now, register

_PAGE = ("id", "title", "project", "machine_id", "provider", "last_activity", "archived", "pinned", "tokens_in", "tokens_out", "observations")
_SORTS = {"activity": ("last_activity", "DESC"), "cost": ("round(cost_estimate, 4)", "DESC"), "tokens": (ALL, "DESC"), "title": ("lower(title)", "ASC")}
for _sort, (_key, _way) in _SORTS.items():
    register(
        f"sessions_by_{_sort}",
        lambda x, sort=_sort, down=_way == "DESC": ops.list_sessions(x.catalog, SessionQuery(archived=False), sort, down, limit=200).select(*_PAGE),
        f"SELECT {', '.join(_PAGE)} FROM cat WHERE NOT archived ORDER BY pinned DESC, {_key} {_way} NULLS LAST, id LIMIT 200",
    )
register(
    "sessions_next_page",
    lambda x: ops.list_sessions(x.catalog, SessionQuery(), "tokens", True, limit=100, after=(False, 1_000_000, 0)).select(*_PAGE),
    f"SELECT {', '.join(_PAGE)} FROM cat WHERE NOT pinned AND ({ALL} < 1000000 OR {ALL} = 1000000 AND id > 0) ORDER BY pinned DESC, {ALL} DESC, id LIMIT 100",
)
register(
    "sessions_search",
    lambda x: x.catalog.where(ops.matches(SessionQuery(text="RENAMED", start=dt.datetime(1993, 1, 1), end=dt.datetime(1997, 1, 1)))).select(*_PAGE),
    f"SELECT {', '.join(_PAGE)} FROM cat WHERE contains(lower(concat_ws(' ', title, project, machine_id, provider, native_id, id, note)), 'renamed') AND last_activity >= TIMESTAMP '1993-01-01' AND last_activity < TIMESTAMP '1997-01-01'",
)
register(
    "sessions_filtered",
    lambda x: x.catalog.where(ops.matches(SessionQuery(provider="alpha", unassigned=True))).select(*_PAGE),
    f"SELECT {', '.join(_PAGE)} FROM cat WHERE provider = 'alpha' AND project = ''",
)
_TOTALS = f"""SELECT *, {ALL} AS recorded_tokens, {ALL} - priced_tokens AS unpriced_tokens, round(CASE WHEN {ALL} > 0 THEN priced_tokens / {ALL} END, 6) AS token_coverage, {coverage(ALL, "awaiting_tokens")} AS coverage
FROM (SELECT count(*) AS sessions, {", ".join(BIG(c, n) for c, n in (("event_count", "events"), ("tokens_in", None), ("tokens_cache", None), ("tokens_write", None), ("tokens_out", None)))}, round(sum(cost_estimate), 2) AS cost_estimate,
    count(cost_estimate) AS with_estimate, count(*) - count(cost_estimate) AS without_estimate, {BIG("priced_tokens")}, {BIG("unattributed_tokens")}, {BIG(f"CASE WHEN observations = 0 THEN {ALL} ELSE 0 END", "awaiting_tokens")} FROM cat WHERE """
register("catalog_totals", lambda x: ops.totals(x.catalog, SessionQuery()), _TOTALS + "true)")
register("catalog_totals_machine", lambda x: ops.totals(x.catalog, SessionQuery(machine="FRANCE", archived=False)), _TOTALS + "machine_id = 'FRANCE' AND NOT archived)")
_GROUPED = f"count(*) AS sessions, max(last_activity) AS latest, {BIG(ALL, 'tokens')}, round(sum(cost_estimate), 2) AS cost_estimate FROM cat GROUP BY 1"
register("catalog_projects", lambda x: ops.grouped(x.catalog, "project"), f"SELECT project AS key, {_GROUPED}")
register("catalog_machines", lambda x: ops.grouped(x.catalog, "machine_id"), f"SELECT machine_id AS key, {_GROUPED}")


def _by_changes(x):
    """catalog_machines by changes: an older catalog lacks some sessions, has others with other numbers and some that go; the change is applied twice, and what came first is folded."""
    new = settle(x.catalog.select("id", "machine_id", "last_activity", all_tokens().cast("decimal(38,12)").alias("tokens"), F.col("cost_estimate").cast("decimal(38,12)").alias("cost")), "catalog")
    other = F.col("id") % 5 == 0
    old = new.where("id % 7 > 0").withColumns({"tokens": F.when(other, F.col("tokens") + 17).otherwise(F.col("tokens")), "cost": F.when(other, F.col("cost") * 2).otherwise(F.col("cost")), "machine_id": F.when(F.col("id") % 11 == 0, "elsewhere").otherwise(F.col("machine_id"))})
    gone = new.where("id % 3 = 0").withColumns({"id": F.col("id") + 10**12, "last_activity": F.col("last_activity") + F.expr("INTERVAL 9 YEARS")})
    old = old.unionByName(gone)
    totals = upkeep.SignedTotals(x.spark, fresh_path(x.spark, "totals"), ("machine_id",), ("tokens", "cost"), "last_activity")
    totals.apply(upkeep.signed(new.limit(0), old, "id"), 0)
    totals.apply(upkeep.signed(old, new, "id"), 1)
    totals.apply(upkeep.signed(old, new, "id"), 1)
    totals.fold(0)
    return totals.totals().select(F.col("machine_id").alias("key"), F.col("n").alias("sessions"), F.col("last_activity").alias("latest"), F.col("tokens").cast("long").alias("tokens"), F.round(F.col("cost").cast("double"), 2).alias("cost_estimate"))


register("catalog_machines_by_changes", _by_changes, f"SELECT machine_id AS key, {_GROUPED}")
register("ranked_projects", lambda x: ops.ranked_projects(x.catalog), f"SELECT project AS key, {_GROUPED} ORDER BY sessions DESC, latest DESC NULLS LAST, key LIMIT 100")
register("source_only_machines", lambda x: ops.source_only_machines(x.tables.sources, x.catalog), "SELECT DISTINCT machine_id FROM log_sources WHERE machine_id NOT IN (SELECT machine_id FROM cat)")
register(
    "search_sources",
    lambda x: ops.search_sources(x.tables.sources, "session1", after=("m1", "")).select("source_id", "machine_id", "path", "durable_offset"),
    "SELECT source_id, machine_id, path, durable_offset FROM log_sources WHERE contains(lower(path), 'session1') AND (machine_id, path) > ('m1', '') ORDER BY machine_id, path LIMIT 100",
)
register(
    "indexing_progress",
    lambda x: ops.indexing_progress(x.tables.sources),
    """SELECT count(*) AS sources, count(*) FILTER (WHERE NOT rebuilding AND indexed_offset >= durable_offset AND diagnostics = 0) AS ready, count(*) FILTER (WHERE NOT rebuilding AND indexed_offset < durable_offset) AS awaiting,
    count(*) FILTER (WHERE NOT rebuilding AND indexed_offset >= durable_offset AND diagnostics > 0) AS blocked, count(*) FILTER (WHERE rebuilding) AS rebuilding, CAST(sum(durable_offset - indexed_offset) AS BIGINT) AS bytes_left FROM log_sources""",
)
register(
    "lineage",
    lambda x: ops.lineage(x.tables.sessions),
    """SELECT s.id, CASE WHEN s.parent_native_id = '' THEN 'root' WHEN k.n IS NULL THEN 'unresolved' WHEN k.n = 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN s.parent_native_id <> '' AND k.n = 1 THEN k.parent END AS parent, coalesce(c.children, 0) AS children
    FROM sessions s LEFT JOIN (SELECT machine_id, provider, native_id, count(*) AS n, min(id) AS parent FROM sessions GROUP BY 1, 2, 3) k ON s.machine_id = k.machine_id AND s.provider = k.provider AND s.parent_native_id = k.native_id
    LEFT JOIN (SELECT machine_id, provider, parent_native_id, count(*) AS children FROM sessions WHERE parent_native_id <> '' GROUP BY 1, 2, 3) c ON s.machine_id = c.machine_id AND s.provider = c.provider AND s.native_id = c.parent_native_id""",
)
register(
    "quiet_machines",
    lambda x: ops.quiet_machines(x.catalog, now()),
    f"""SELECT machine_id, sessions, span_ms, median_gap_ms, p90_gap_ms, sessions >= 5 AND span_ms >= 7 * 86400000 AS enough_history, least(21600000, greatest(1800000, 2 * p90_gap_ms)) AS threshold_ms, epoch_ms(TIMESTAMP '{NOW}') - last AS silence_ms,
    sessions >= 5 AND span_ms >= 7 * 86400000 AND epoch_ms(TIMESTAMP '{NOW}') - last > least(21600000, greatest(1800000, 2 * p90_gap_ms)) AS quiet
    FROM (SELECT machine_id, count(*) AS sessions, max(t) - min(t) AS span_ms, max(t) AS last, median(gap) AS median_gap_ms, CAST(quantile_disc(gap, 0.9) AS BIGINT) AS p90_gap_ms
        FROM (SELECT machine_id, t, t - lag(t) OVER (PARTITION BY machine_id ORDER BY t, id) AS gap FROM (SELECT machine_id, id, epoch_ms(last_activity) AS t FROM cat WHERE last_activity IS NOT NULL)) GROUP BY 1)""",
)

def cat_with_labels(x):
    """The catalog with labels for a third of the machines."""
    from quillspan.operators.usage import PROJECTION, session_totals

    labels = x.tables.sessions.select("machine_id").distinct().where("length(machine_id) % 3 = 2").selectExpr("machine_id", "concat('Rack ', length(machine_id)) AS label")
    return ops.catalog(x.tables.sessions, x.tables.metadata, session_totals(x.all_priced, *PROJECTION), labels)


for _name, _text, _keep in (("notes", "see note 3", "contains(lower(note), 'see note 3')"), ("labels", "RACK 8", "length(machine_id) = 8")):
    register(f"sessions_search_{_name}", lambda x, text=_text: cat_with_labels(x).where(ops.matches(SessionQuery(text=text))).select(*_PAGE), f"SELECT {', '.join(_PAGE)} FROM cat WHERE {_keep}")


def _by_grams(x, text):
    """The sessions that contain a text, by the index of their grams."""
    rows = settle(x.catalog.withColumn("folded", ops.searched_text()).select(*_PAGE, "folded"), "catalog")
    grams = index.gram_index(x.spark, fresh_path(x.spark, "grams"), rows.selectExpr("id", "folded AS text"), span=512, buckets=16)
    return index.containing(grams, rows, F.col("folded"), text).select(*_PAGE)


register("sessions_search_indexed", lambda x: _by_grams(x, "RENAMED"), f"SELECT {', '.join(_PAGE)} FROM cat WHERE contains(lower(concat_ws(' ', title, project, machine_id, provider, native_id, id, note)), 'renamed')")
register("sessions_assigned", lambda x: x.catalog.where(ops.matches(SessionQuery(assignment="assigned", archived=True))).select(*_PAGE), f"SELECT {', '.join(_PAGE)} FROM cat WHERE assignment = 'assigned' AND archived")
register(
    "sessions_without_evidence",
    lambda x: ops.without_evidence(x.catalog, x.tables.sources.selectExpr("source_id", "generation", "1 AS revision")).select(*_PAGE),
    f"SELECT {', '.join(_PAGE)} FROM cat WHERE source_id NOT IN (SELECT source_id FROM log_sources)",
)
register(
    "search_source_titles",
    lambda x: ops.search_sources(x.tables.sources, "HIGH", titles=x.tables.sessions.select("source_id", "title"), limit=500).select("source_id", "machine_id", "path", "title"),
    "SELECT l.source_id, l.machine_id, l.path, s.title FROM log_sources l LEFT JOIN sessions s USING (source_id) WHERE contains(lower(l.path), 'high') OR contains(lower(coalesce(s.title, '')), 'high') ORDER BY l.machine_id, l.path LIMIT 500",
)


def _second_page(x):
    rows = settle(ops.grouped(x.catalog, "machine_id"), "machines")
    order = [F.desc("sessions"), F.col("key")]
    _, after = ops.page_of(rows, order, 7)
    return ops.page_of(rows, order, 7, after)[0]


register("machines_second_page", _second_page, f"SELECT machine_id AS key, {_GROUPED} ORDER BY sessions DESC, key LIMIT 7 OFFSET 7")
_JSON = "CASE seq % 6 WHEN 0 THEN '{\"error\":true}' WHEN 1 THEN '{\"error\":false}' WHEN 2 THEN '{\"error\":\"true\"}' WHEN 3 THEN '{\"error\":null}' WHEN 4 THEN '{}' ELSE '{\"error\":' END"
register(
    "json_error_states",
    lambda x: x.tables.events.selectExpr("seq", f"{_JSON} AS data").select("seq", json_flag(F.col("data"), "$.error").alias("error"), json_type(F.col("data"), "$.error").alias("type")),
    "SELECT seq, CASE seq % 6 WHEN 0 THEN true WHEN 1 THEN false END AS error, CASE seq % 6 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'BOOLEAN' WHEN 2 THEN 'STRING' WHEN 3 THEN 'VOID' END AS type FROM all_events",
)
register(
    "utc_texts",
    lambda x: x.tables.events.select("seq", utc_text(F.expr("CASE seq % 6 WHEN 0 THEN '2024-03-01T10:00:00+02:00' WHEN 1 THEN '2024-03-01T10:00:00.5Z' WHEN 2 THEN 'yesterday' WHEN 3 THEN '0001-01-01T00:00:00Z' WHEN 4 THEN '2024-13-01T00:00:00Z' ELSE '2024-03-01T00:30:00.123456789+05:30' END")).alias("at")),
    "SELECT seq, CASE seq % 6 WHEN 0 THEN '2024-03-01T08:00:00.000000Z' WHEN 1 THEN '2024-03-01T10:00:00.500000Z' WHEN 5 THEN '2024-02-29T19:00:00.123456Z' ELSE '' END AS at FROM all_events".replace(" AS at ", ' AS "at" '),
)
register("flow_roles", lambda x: x.names.select("session_id", "agent_id", flow_role(F.col("name")).alias("role")), "SELECT session_id, agent_id, CASE WHEN name = '' THEN 'Unnamed helper identity' WHEN name LIKE 'scout%' THEN 'scout' WHEN name LIKE 'reviewer%' THEN 'reviewer ·' ELSE name END AS role FROM names")
register("identities", lambda x: x.tables.sessions.select("id", identity(F.col("machine_id"), F.col("native_id")).alias("sha")), "SELECT id, sha256(strlen(machine_id) || ':' || machine_id || ',' || strlen(native_id) || ':' || native_id || ',') AS sha FROM sessions")
