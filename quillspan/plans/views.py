"""The engine's domain tables over the star-schema test tables.

Column expressions are written once, in SQL that Spark and DuckDB read alike: ``load`` builds the
DataFrames from them and ``SQL`` the oracle's common table expressions. Adapters only; no operator
lives here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Revision 1 is the current projection of every session; revision 0 rows are superseded.
SESSION_COLUMNS = {
    "id": "o_orderkey",
    "source_id": "concat('s', o_orderkey)",
    "generation": "1",
    "revision": "1",
    "machine_id": "n_name",
    "provider": "CASE o_orderstatus WHEN 'F' THEN 'alpha' WHEN 'O' THEN 'beta' ELSE 'gamma' END",
    "own_project": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) END",
    "title": "concat('Order ', o_orderkey, ' ', o_orderpriority)",
    "native_id": "concat('n', CASE WHEN o_orderkey % 50 = 1 THEN o_orderkey - 1 ELSE o_orderkey END)",
    "parent_native_id": "CASE WHEN o_orderkey % 4 = 3 THEN concat('n', o_orderkey - 1) WHEN o_orderkey % 4 = 2 THEN 'n-none' ELSE '' END",
    "native_agent_id": "CASE WHEN o_orderkey % 4 = 3 THEN concat('agent-', o_orderkey % 5) ELSE '' END",
    "forked_from_id": "CASE WHEN o_orderkey % 50 = 2 THEN concat('n', o_orderkey - 2) ELSE '' END",
    "last_activity": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate END",
    "event_count": "CAST(o_orderkey % 40 AS BIGINT)",
    "completeness": "CASE WHEN o_orderkey % 9 = 0 THEN 'partial' ELSE 'complete' END",
}
METADATA_COLUMNS = {
    "session_id": "o_orderkey",
    "archived": "o_orderkey % 13 = 0",
    "pinned": "o_orderkey % 17 = 0",
    "name": "CASE WHEN o_orderkey % 19 = 0 THEN concat('Renamed ', o_orderkey) ELSE '' END",
    "note": "CASE WHEN o_orderkey % 23 = 0 THEN concat('See Note ', o_orderkey % 7) ELSE '' END",
    "project": "CASE WHEN o_orderkey % 5 = 0 THEN 'assigned' ELSE '' END",
    "project_override": "o_orderkey % 10 = 0",
}
USAGE_COLUMNS = {
    "id": "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity) AS BIGINT), CAST(floor(l_extendedprice * 100) AS BIGINT))",
    "message_id": "concat_ws(':', l_orderkey, l_linenumber)",
    "session_id": "l_orderkey",
    "source_id": "concat('s', l_orderkey)",
    "generation": "1",
    "revision": "CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END",
    "agent_id": "CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'main' ELSE concat('agent-', l_suppkey % 5) END",
    "part": "l_partkey",
    "kind": "CASE l_returnflag WHEN 'A' THEN 'message-final' WHEN 'N' THEN 'message-partial' ELSE 'message-without-id' END",
    "ts": "l_shipdate",
    # The fields that a report gives, zero or not.
    "present_mask": """CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber % 3 WHEN 0 THEN 'tokens_in,model' WHEN 1 THEN 'tokens_cache,tokens_out' ELSE 'tokens_in,tokens_cache,tokens_write,model' END
        ELSE 'tokens_in,tokens_cache,tokens_write,tokens_out,model' END""",
    "tokens_in": "CAST(floor(l_quantity) AS BIGINT) * 10",
    "tokens_cache": "CAST(floor(l_extendedprice) AS BIGINT)",
    "tokens_write": "CAST(floor(l_discount * 100) AS BIGINT)",
    "tokens_out": "CAST(floor(l_tax * 1000) AS BIGINT)",
}
EVENT_COLUMNS = {
    "seq": "event_id",
    "session_id": "user_id",
    "source_id": "concat('s', user_id)",
    "generation": "1",
    "revision": "CASE WHEN event_id % 41 = 0 THEN 0 ELSE 1 END",
    "agent_id": "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'main' WHEN 2 THEN 'main' ELSE concat('agent-', event_id % 3) END",
    "kind": "CASE event_type WHEN 'click' THEN 'tool-call' WHEN 'view' THEN 'tool-result' WHEN 'error' THEN 'tool-result' WHEN 'signup' THEN 'user-text' ELSE 'assistant-text' END",
    "ts": "CASE WHEN event_id % 53 = 0 THEN NULL ELSE ts END",
    "tool": "CASE WHEN event_type IN ('click', 'view', 'error') THEN concat(CASE WHEN event_id % 4 = 0 THEN 'mcp__srv__' ELSE '' END, 'tool', CAST(floor(value) AS BIGINT) % 6) END",
    "tool_use_id": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('c', CAST(floor(event_id / 300) AS BIGINT)) END",
    # Three states: true, false, and unknown for results that do not say.
    "error": "CASE WHEN event_type = 'error' THEN true WHEN event_type = 'view' AND event_id % 7 > 0 THEN false ELSE NULL END",
    "path": "CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN concat(CASE WHEN event_id % 9 = 0 THEN '/abs/' ELSE 'src/' END, 'file', event_id % 37, '.txt') END",
    "working_directory": "CASE WHEN event_type = 'click' AND event_id % 4 < 3 THEN concat('/home/u', user_id % 2) END",
    # Calls of one tool often repeat word for word.
    "text": "CASE WHEN event_type = 'click' THEN concat('run  src/a/b/step', CAST(floor(value) AS BIGINT) % 2) ELSE concat(event_type, ' ', props) END",
}
#: The display name of a session's helper.
NAME = """CASE agent_id WHEN 'agent-0' THEN 'tester' WHEN 'agent-1' THEN concat('scout #', session_id % 9) WHEN 'agent-2' THEN concat('reviewer 0123456789ab-', session_id % 2)
    WHEN 'agent-3' THEN 'builder' ELSE '' END"""
#: A model's name as vendors write it, for rules that read names; such usage is 997 times the tokens.
MODEL_NAME = """CASE WHEN model = '' THEN '' ELSE concat(CASE substr(model, 7, 1) WHEN '1' THEN 'opus-' WHEN '2' THEN 'sonnet-' WHEN '3' THEN 'haiku-' WHEN '4' THEN 'gpt-5-' ELSE 'other-' END,
    CASE WHEN substr(model, 8, 1) = '1' THEN 'mini' ELSE substr(model, 8, 1) END) END"""
_TOKENS = ("tokens_in", "tokens_cache", "tokens_write", "tokens_out")
SOURCE_COLUMNS = {
    "source_id": "concat('s', id)",
    "generation": "1",
    "machine_id": "concat('m', id % 7)",
    "path": "concat('/logs/', id % 7, '/Session', id, '.jsonl')",
    "durable_offset": "CAST(1000 + id AS BIGINT)",
    "indexed_offset": "CAST(1000 + id - CASE WHEN id % 10 = 3 THEN 5 ELSE 0 END AS BIGINT)",
    "rebuilding": "id % 31 = 0",
    "diagnostics": "CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END",
    "modified_at": "CASE WHEN id % 29 = 0 THEN NULL ELSE last_at END",
}

#: Fixed demonstration rates by rule: brand mn costs m in and 5 n out, 10 % more from the change on.
CHANGE = "1995-06-17"


def rate_rows() -> list[tuple]:
    """(rate_id, model, context, tier, effective_from, effective_to, input, cache_read, cache_write, output)."""
    rows = []
    tiers = ("flagship", "premium", "mid", "cheap", "unknown")
    for m in range(1, 6):
        for n in range(1, 6):
            brand = f"Brand#{m}{n}"
            if brand == "Brand#55":
                continue  # a model without a price
            for part, (start, end, more) in enumerate((("1900-01-01", CHANGE, 1.0), (CHANGE, None, 1.1))):
                rows.append((f"{brand}/{part}", brand, "standard", tiers[m - 1], start, end, m * more, m * more / 10, m * more * 1.25, 5.0 * n * more))
            if brand == "Brand#54":  # a second match: no price
                rows.append((f"{brand}/x", brand, "standard", "unknown", "1900-01-01", None, 1.0, 1.0, 1.0, 1.0))
    return rows


RATE_SCHEMA = "rate_id string, model string, context string, tier string, effective_from string, effective_to string, input double, cache_read double, cache_write double, output double"


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def _rates_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)"
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rate_rows())
    names = ", ".join(x.split()[0] for x in RATE_SCHEMA.split(", "))
    return f"SELECT * REPLACE (CAST(effective_from AS TIMESTAMP) AS effective_from, CAST(effective_to AS TIMESTAMP) AS effective_to) FROM (VALUES {values}) r({names})"


#: Common table expressions of the oracle, in order.
SQL = {
    "sessions": f"SELECT {_list(SESSION_COLUMNS)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "metadata": f"SELECT {_list(METADATA_COLUMNS)} FROM orders",
    "all_usage": f"SELECT {_list(USAGE_COLUMNS)}, CASE WHEN l_partkey % 29 = 0 THEN '' ELSE p_brand END AS model FROM lineitem JOIN part ON l_partkey = p_partkey",
    "usage": "SELECT u.* FROM all_usage u JOIN sessions s ON u.session_id = s.id AND u.source_id = s.source_id AND u.generation = s.generation AND u.revision = s.revision",
    "all_events": f"SELECT {_list(EVENT_COLUMNS)} FROM events",
    "agent_events": "SELECT * FROM all_events WHERE revision = 1",
    "log_sources": f"SELECT {_list(SOURCE_COLUMNS)} FROM (SELECT user_id AS id, max(ts) AS last_at FROM events GROUP BY user_id)",
    "rates": _rates_sql(),
    "names": f"SELECT session_id, agent_id, {NAME} AS name FROM (SELECT session_id, agent_id FROM usage UNION SELECT session_id, agent_id FROM agent_events) WHERE agent_id <> ''",
    "named_usage": f"SELECT * REPLACE ({MODEL_NAME} AS model, {', '.join(f'997 * {t} AS {t}' for t in _TOKENS)}) FROM usage",
}


@dataclass
class Tables:
    """The domain tables as DataFrames; usage and events are whole, with superseded rows."""

    sessions: DataFrame
    metadata: DataFrame
    usage: DataFrame
    events: DataFrame
    sources: DataFrame
    rates: DataFrame
    turns: DataFrame
    texts: DataFrame
    parts: DataFrame


def load(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    exprs = lambda columns: [f"{v} AS {k}" for k, v in columns.items()]
    orders = read("orders")
    owners = read("customer").selectExpr("c_custkey", "c_mktsegment", "c_nationkey AS n_nationkey").join(read("nation"), "n_nationkey")
    sessions = orders.join(owners, orders["o_custkey"] == owners["c_custkey"]).selectExpr(*exprs(SESSION_COLUMNS))
    parts = read("part").selectExpr("p_partkey AS l_partkey", "p_brand")
    usage = read("lineitem").join(parts, "l_partkey").selectExpr(*exprs(USAGE_COLUMNS), "CASE WHEN l_partkey % 29 = 0 THEN '' ELSE p_brand END AS model")
    events = read("events")
    sources = events.groupBy("user_id").agg({"ts": "max"}).selectExpr("user_id AS id", "`max(ts)` AS last_at").selectExpr(*exprs(SOURCE_COLUMNS))
    rates = spark.createDataFrame(rate_rows(), RATE_SCHEMA)
    rates = rates.selectExpr(*[f"CAST({c} AS TIMESTAMP_NTZ) AS {c}" if c.startswith("effective") else c for c in rates.columns])
    return Tables(sessions, orders.selectExpr(*exprs(METADATA_COLUMNS)), usage, events.selectExpr(*exprs(EVENT_COLUMNS)), sources, rates, read("conversations"), read("documents"), read("part"))


def agent_name() -> Column:
    """The name of a named agent, which follows from its keys: what agent_names() lists."""
    return F.expr(NAME)


def agent_names(usage: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, agent_id, name) of all named agents."""
    ids = usage.select("session_id", "agent_id").unionByName(events.select("session_id", "agent_id")).where("agent_id <> ''").distinct()
    return ids.selectExpr("session_id", "agent_id", f"{NAME} AS name")


def named_usage(usage: DataFrame) -> DataFrame:
    kept = [c for c in usage.columns if c not in ("model", *_TOKENS)]
    return usage.selectExpr(*kept, f"{MODEL_NAME} AS model", *[f"997 * {t} AS {t}" for t in _TOKENS])


def with_views(sql: str, *more: str) -> str:
    """The oracle's text: the views, then more CTEs (name AS (...)), then sql."""
    views = [f"{k} AS ({v})" for k, v in SQL.items()]
    return "WITH RECURSIVE " + ",\n".join([*views, *more]) + "\n" + sql
