"""Tool spans, agent lifecycle and other views of one session's events, for all sessions at once.

``error`` has three states: true, false and null for a result that does not say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import flow_tool, millis_between

PAIR = ["session_id", "agent_id", "tool_use_id"]


def _pairs(events: DataFrame) -> DataFrame:
    """Calls and results of each (session, agent, call id)."""
    is_call, is_result = F.col("kind") == "tool-call", F.col("kind") == "tool-result"
    return events.where(is_call | is_result).groupBy(*PAIR).agg(
        F.count_if(is_call).alias("calls"), F.count_if(is_result).alias("results"), F.max(F.when(is_call, F.col("seq"))).alias("call_seq"),
        F.max(F.when(is_result, F.struct("seq", "ts", "error"))).alias("result"),
    )


def tool_spans(events: DataFrame) -> DataFrame:
    """Each tool call with its span's state, duration and error.

    States: missing-agent, missing-id, missing-result, ambiguous, invalid-time-or-order, matched."""
    calls = events.where("kind = 'tool-call'").select("seq", *PAIR, "tool", "ts")
    pairs = _pairs(events.where("agent_id <> '' AND tool_use_id <> ''"))
    out = calls.join(pairs.drop("call_seq"), PAIR, "left")
    r = F.col("result")
    good = F.col("ts").isNotNull() & r["ts"].isNotNull() & (r["ts"] >= F.col("ts")) & (r["seq"] > F.col("seq"))
    state = (
        F.when(F.col("agent_id") == "", "missing-agent")
        .when(F.coalesce("tool_use_id", F.lit("")) == "", "missing-id")
        .when((F.col("calls") != 1) | (F.col("results") > 1), "ambiguous")
        .when(F.col("results") == 0, "missing-result")
        .when(good, "matched")
        .otherwise("invalid-time-or-order")
    )
    matched = F.col("state") == "matched"
    out = out.withColumn("state", state)
    return out.select(
        "seq", "session_id", "agent_id", "tool", "state", F.when(matched, r["seq"]).alias("result_seq"), F.when(matched, millis_between(F.col("ts"), r["ts"])).alias("duration_ms"),
        F.when(matched, r["error"]).alias("error"),
    )


def agent_lifecycle(events: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Per session and agent: pending call, uncertain calls, retrying and stalled (null unless provable).

    Stalled: the pending call is over two minutes old and the source was modified in the last ten."""
    ev = events.where("agent_id <> '' AND kind IN ('tool-call', 'tool-result')")
    named = F.coalesce("tool_use_id", F.lit("")) != ""
    result_seq = F.coalesce(F.col("result.seq"), F.lit(0))
    doubtful = (F.col("calls") != 1) | (F.col("results") > 1) | ((F.col("results") == 1) & (result_seq <= F.coalesce("call_seq", F.lit(0))))
    pairs = _pairs(ev.where(named)).groupBy("session_id", "agent_id").agg(
        F.max(F.when((F.col("calls") == 1) & (F.col("results") == 0), F.col("call_seq"))).alias("pending_seq"), F.count_if(doubtful).alias("doubtful"),
    )
    agents = ev.groupBy("session_id", "agent_id").agg(
        F.count_if(~named).alias("unnamed"), F.max(F.struct("seq", "kind", "tool_use_id", "error")).alias("last"), F.first("source_id").alias("source_id"),
    )
    times = ev.select(F.col("seq").alias("pending_seq"), F.col("ts").alias("pending_at"))
    out = agents.join(pairs, ["session_id", "agent_id"], "left").join(times, "pending_seq", "left").join(sources.select("source_id", "modified_at"), "source_id", "left")
    # Retrying is known to be false after a call or a result without error; true needs one call, earlier than its one errored result.
    ids = _pairs(ev.where(named)).select(*PAIR, "calls", "results", "call_seq")
    last = out.withColumn("tool_use_id", F.col("last.tool_use_id")).join(ids, PAIR, "left")
    proved = (F.col("calls") == 1) & (F.col("results") == 1) & (F.col("call_seq") < F.col("last.seq"))
    retrying = F.when((F.col("last.kind") == "tool-call") | ~F.col("last.error"), F.lit(False)).when(F.col("last.error") & proved, F.lit(True))
    uncertain = F.coalesce("doubtful", F.lit(0)) + F.col("unnamed")
    old, live = F.col("pending_at") < now - F.expr("INTERVAL 2 MINUTES"), F.col("modified_at") > now - F.expr("INTERVAL 10 MINUTES")
    dated = (F.col("pending_at") <= now) & (F.col("modified_at") <= now)
    stalled = F.when(F.col("pending_seq").isNull(), F.when(uncertain == 0, F.lit(False))).when(dated & old & live, F.lit(True)).when(dated & (uncertain == 0), F.lit(False))
    return last.select("session_id", "agent_id", "pending_seq", uncertain.cast("long").alias("uncertain_calls"), retrying.alias("retrying"), stalled.alias("stalled"))


def agent_tools(events: DataFrame) -> DataFrame:
    """Calls of each tool by session and agent; a tool that is no text is ''."""
    return events.where("kind = 'tool-call'").groupBy("session_id", "agent_id", F.coalesce("tool", F.lit("")).alias("tool")).agg(F.count("*").alias("calls"))


def session_stats(events: DataFrame, usage: DataFrame) -> DataFrame:
    """Per session: events, calls, errors, unknown results, agents (the empty one counts), bounds and duration."""
    call, result = F.col("kind") == "tool-call", F.col("kind") == "tool-result"
    ev = events.groupBy("session_id").agg(
        F.count("*").alias("events"), F.count_if(call).alias("tool_calls"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"), F.count_if(result & F.col("error").isNull()).alias("unknown_results"),
        F.count_if(F.col("kind") == "indexing-error").alias("indexing_errors"), F.min("ts").alias("e_first"), F.max("ts").alias("e_last"),
    )
    us = usage.groupBy("session_id").agg(F.min("ts").alias("u_first"), F.max("ts").alias("u_last"))
    agents = events.select("session_id", "agent_id").unionByName(usage.select("session_id", "agent_id")).distinct().groupBy("session_id").agg(F.count("*").alias("agents"))
    out = agents.join(ev, "session_id", "left").join(us, "session_id", "left")
    counts = ["events", "tool_calls", "errors", "unknown_results", "indexing_errors"]
    first, last = F.least("e_first", "u_first"), F.greatest("e_last", "u_last")
    return out.select("session_id", "agents", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], first.alias("first_at"), last.alias("last_at"), millis_between(first, last).alias("duration_ms"))


def fingerprint(events: DataFrame, buckets: int = 24) -> DataFrame:
    """Events and errors in equal slices of each session's time; undated events stand in bucket -1."""
    bounds = events.groupBy("session_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = us("t1") - us("t0")
    at = F.when(F.col("ts").isNull(), -1).when(span <= 0, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((us("ts") - us("t0")) * buckets / span)))
    rows = events.join(bounds, "session_id").withColumn("bucket", at.cast("int"))
    return rows.groupBy("session_id", "bucket").agg(F.count("*").alias("events"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"))


def events_around(events: DataFrame, anchor: DataFrame, before: int = 20, after: int = 20) -> DataFrame:
    """The events next to an anchor (session_id, seq) in its session, itself included; 249 a side at most."""
    near = events.join(anchor.withColumnRenamed("seq", "anchor"), "session_id")
    earlier = near.where("seq < anchor").withColumn("n", F.row_number().over(Window.partitionBy("session_id", "anchor").orderBy(F.desc("seq")))).where(F.col("n") <= min(before, 249))
    later = near.where("seq >= anchor").withColumn("n", F.row_number().over(Window.partitionBy("session_id", "anchor").orderBy("seq"))).where(F.col("n") <= min(after, 249) + 1)
    return earlier.unionByName(later).drop("n")


def consecutive_runs(events: DataFrame) -> DataFrame:
    """Runs of equal consecutive calls of an agent: tool, length, errored calls."""
    errored = events.where("kind = 'tool-result' AND error AND tool_use_id IS NOT NULL").select("session_id", "tool_use_id").distinct().withColumn("bad", F.lit(True))
    calls = events.where("kind = 'tool-call' AND tool IS NOT NULL").join(errored, ["session_id", "tool_use_id"], "left")
    w = Window.partitionBy("session_id", "agent_id").orderBy("seq")
    signature = F.concat("tool", F.lit("::"), F.substring(F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, 160))
    calls = calls.withColumn("sig", signature)
    calls = calls.withColumn("new", F.when(F.lag("sig").over(w) == F.col("sig"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return calls.groupBy("session_id", "agent_id", "run").agg(F.first("tool").alias("tool"), F.min("seq").alias("start"), F.count("*").alias("length"), F.count_if(F.coalesce("bad", F.lit(False))).alias("errors"))


def _clean(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def target(text: Column) -> Column:
    """What a call was about, in short: of a path its last two parts, 60 characters at most."""
    s = _clean(text)
    parts = F.filter(F.split(s, r"[\\/]"), lambda x: x != "")
    short = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(s)
    return F.when(F.length(short) > 60, F.concat(F.substring(short, 1, 59), F.lit("…"))).otherwise(short)


def diagnose(events: DataFrame) -> DataFrame:
    """What broke a session, where the arithmetic shows it: (session_id, kind, tool, target, count, errors).

    stalled: the last call has an id, no result and nothing after it, in a session that records results. Else the latest run of two or
    more equal calls with an error is a retry-storm, else the latest of three or more is looping. Writing tools repeat in ordinary work
    and do not count."""
    is_call = (F.col("kind") == "tool-call") & F.col("tool").isNotNull()
    moves = F.col("kind").isin("tool-call", "tool-result", "assistant-text")
    ends = events.groupBy("session_id").agg(
        F.count_if(is_call).alias("calls"), F.max(F.when(is_call, F.struct("seq", "tool", "tool_use_id", target(F.col("text")).alias("target")))).alias("call"), F.max(F.when(moves, F.col("seq"))).alias("moved"),
        F.bool_or(F.col("kind") == "tool-result").alias("sees"),
    )
    stalled = ends.where((F.col("calls") >= 2) & F.col("sees") & (F.coalesce("call.tool_use_id", F.lit("")) != "") & (F.col("moved") == F.col("call.seq")))
    stalled = stalled.select("session_id", F.lit(2).alias("rank"), F.col("call.seq").alias("start"), F.lit("stalled").alias("kind"), "call.tool", "call.target", F.lit(1).cast("long").alias("count"), F.lit(0).cast("long").alias("errors"))
    runs = consecutive_runs(events).where((F.col("length") >= 2) & ~F.lower("tool").isin("edit", "write", "multiedit", "notebookedit"))
    kind = F.when(F.col("errors") > 0, "retry-storm").when(F.col("length") >= 3, "looping")
    first = events.select("session_id", F.col("seq").alias("start"), target(F.col("text")).alias("target"))
    found = runs.withColumn("kind", kind).where("kind IS NOT NULL").join(first, ["session_id", "start"])
    found = found.select("session_id", F.when(F.col("kind") == "retry-storm", 1).otherwise(0).alias("rank"), "start", "kind", "tool", "target", F.col("length").alias("count"), "errors")
    best = found.unionByName(stalled).groupBy("session_id").agg(F.max(F.struct("rank", "start", "kind", "tool", "target", "count", "errors")).alias("b"))
    return best.select("session_id", "b.kind", "b.tool", "b.target", "b.count", "b.errors")


def timeline(spans: DataFrame, events: DataFrame) -> DataFrame:
    """Matched spans as percent of their session's time: offset and width, to 4 places."""
    ms = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1000)
    bounds = events.groupBy("session_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    rows = spans.where("state = 'matched'").join(events.select("seq", "ts"), "seq").join(bounds, "session_id")
    span = F.greatest(ms("t1") - ms("t0"), F.lit(1))
    return rows.select("seq", "session_id", F.round(100 * (ms("ts") - ms("t0")) / span, 4).alias("offset_pct"), F.round(100 * F.col("duration_ms") / span, 4).alias("width_pct"))


def agent_status(events: DataFrame, now: Column, finished: DataFrame | None = None) -> DataFrame:
    """retrying, failed, stalled, done, working or idle of each agent as of now, in this order of precedence.

    retrying: an errored result with nothing of the agent's since, in the last ten minutes; failed where it is older. stalled: a call
    of over two minutes without a result. finished (session_id, agent_id) are helpers whose result came back. working: active in the last 20 seconds."""
    named = events.where("agent_id <> ''")
    last = named.groupBy("session_id", "agent_id").agg(F.max(F.struct("seq", "kind", F.coalesce("error", F.lit(False)).alias("error"))).alias("last"), F.max("ts").alias("last_at"))
    results = named.where("kind = 'tool-result' AND tool_use_id IS NOT NULL").select("session_id", "tool_use_id").distinct()
    pending = named.where("kind = 'tool-call' AND tool_use_id IS NOT NULL").join(results, ["session_id", "tool_use_id"], "left_anti").groupBy("session_id", "agent_id").agg(F.max_by("ts", "seq").alias("since"))
    calls = named.where("kind IN ('tool-call', 'tool-result')").groupBy("session_id", "agent_id").agg(F.max(F.struct("seq", "kind", F.coalesce("error", F.lit(False)).alias("error"))).alias("step"))
    rows = last.join(pending, ["session_id", "agent_id"], "left").join(calls, ["session_id", "agent_id"], "left")
    done = F.lit(False)
    if finished is not None:
        rows, done = rows.join(finished.withColumn("_done", F.lit(True)), ["session_id", "agent_id"], "left"), F.coalesce("_done", F.lit(False)) & (F.col("agent_id") != "main")
    recent = F.coalesce((F.col("last_at") > now - F.expr("INTERVAL 10 MINUTES")) & (F.col("last_at") <= now), F.lit(False))
    retrying = F.coalesce((F.col("step.kind") == "tool-result") & F.col("step.error"), F.lit(False))
    state = (
        F.when(retrying, F.when(recent, "retrying").otherwise("failed")).when(F.col("last.error") & (done | ~recent), "failed")
        .when((F.col("since") < now - F.expr("INTERVAL 2 MINUTES")) & ~done, "stalled").when(done, "done")
        .when((F.col("last_at") > now - F.expr("INTERVAL 20 SECONDS")) & (F.col("last_at") <= now), "working").otherwise("idle")
    )
    return rows.select("session_id", "agent_id", "last_at", state.alias("status"))


def tool_rollup(events: DataFrame) -> DataFrame:
    """Calls of each tool by session, under the tool's name without its server."""
    return events.where("kind = 'tool-call'").groupBy("session_id", flow_tool(F.col("tool")).alias("tool")).agg(F.count("*").alias("calls"))
