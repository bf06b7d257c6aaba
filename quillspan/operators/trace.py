"""What one run did, step by step: signatures, alignment with another run, retries, playback."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.functions import detect, permissions
from quillspan.functions.columns import flow_role, flow_tool, model_tier
from quillspan.functions.strict import strict_variant
from quillspan.functions.workers import ship

#: Fixed file names and messages of the hook evidence.
EDITING = ("Edit", "Write", "MultiEdit", "NotebookEdit")
SCRIPT = r"(?i)\.(?:js|mjs|cjs)(?:[\"'\s]|$)"
SYNTAX = ("SyntaxError", "Unexpected token", "Unexpected identifier", "Unexpected end of input", "Invalid or unexpected token")
LEAST_EDITED, EXAMPLES = 5, 6


def trace_steps(calls: DataFrame) -> DataFrame:
    """Tool calls (seq, session_id, agent_id, tool, tool_use_id, arguments) with the state and signature of each step: tool and compact arguments, in their own order of keys."""
    valid = F.try_parse_json("arguments").isNotNull()
    compact = F.get_json_object("arguments", "$")
    state = F.when((F.coalesce("tool", F.lit("")) == "") | (F.coalesce("tool_use_id", F.lit("")) == ""), "missing-call-identity").when(~F.coalesce(valid, F.lit(False)), "unsupported-arguments").otherwise("known")
    out = calls.withColumn("state", state)
    return out.select("seq", "session_id", "agent_id", "state", F.when(F.col("state") == "known", F.sha2(F.concat(F.lit("step\n"), "tool", F.lit("\n"), compact), 256)).alias("signature"))


def _aligned(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b) -> list[dict]:
        rows = []
        for i, j in detect.align(list(a), list(b)):
            x, y = (None if i is None else a[i]), (None if j is None else b[j])
            state = "unknown" if (i is not None and x is None) or (j is not None and y is None) else "same" if x is not None and x == y else "different"
            rows.append({"a": i, "b": j, "state": state})
        return rows

    return pd.Series([one(a, b) for a, b in zip(left, right)])


def align_runs(steps: DataFrame, pairs: DataFrame, most: int = detect.MAX_STEPS) -> DataFrame:
    """Pairs of agents' runs (left_session, left_agent, right_session, right_agent) aligned step by step: rows same, different or unknown.

    Steps are those of trace_steps(); the first most of each run are compared, and whole tells whether these are all."""
    ship(steps.sparkSession)
    order = Window.partitionBy("session_id", "agent_id").orderBy("seq")
    first = steps.withColumn("n", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy("session_id", "agent_id"))).where(F.col("n") <= most)
    runs = first.groupBy("session_id", "agent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "signature"))), lambda x: x["signature"]).alias("steps"), (F.first("all") <= most).alias("whole"))
    side = lambda s: runs.select(F.col("session_id").alias(f"{s}_session"), F.col("agent_id").alias(f"{s}_agent"), F.col("steps").alias(f"{s}_steps"), F.col("whole").alias(f"{s}_whole"))
    both = pairs.join(side("left"), ["left_session", "left_agent"]).join(side("right"), ["right_session", "right_agent"])
    out = both.withColumn("rows", pandas_udf(_aligned, "array<struct<a:int,b:int,state:string>>")("left_steps", "right_steps"))
    return out.select(*pairs.columns, (F.col("left_whole") & F.col("right_whole")).alias("whole"), F.posexplode("rows").alias("position", "r")).select(*pairs.columns, "whole", "position", "r.a", "r.b", "r.state")


def divergence_pairs(agents: DataFrame) -> DataFrame:
    """For the helper of a session that is to blame the latest clean run of the same task in another session.

    To blame is one that failed, else one that stalled, else the only one that was given a task.
    agents: session_id, agent_id, task_hash (null: no task of its own to tell by), outcome, ended_at."""
    tasks = agents.where("task_hash IS NOT NULL")
    blame = F.when(F.col("outcome") == "failed", 0).when(F.col("outcome") == "stalled", 1).otherwise(2)
    first = tasks.groupBy("session_id").agg(F.min(F.struct(blame.alias("blame"), "agent_id", "task_hash")).alias("c"), F.count("*").alias("helpers"))
    culprit = first.where("c.blame < 2 OR helpers = 1").select("session_id", "c.agent_id", "c.task_hash")
    good = agents.where("outcome = 'succeeded' AND task_hash IS NOT NULL").groupBy("task_hash", "session_id").agg(F.max(F.struct("ended_at", "agent_id")).alias("g"))
    # Two sessions a task hold the latest run that is not the culprit's own.
    latest = Window.partitionBy("task_hash").orderBy(F.col("g.ended_at").desc_nulls_last(), "session_id")
    good = good.withColumn("n", F.row_number().over(latest)).where("n <= 2").select("task_hash", F.col("session_id").alias("right_session"), F.col("g.agent_id").alias("right_agent"), "n")
    rows = culprit.select("task_hash", F.col("session_id").alias("left_session"), F.col("agent_id").alias("left_agent")).join(good, "task_hash").where("left_session <> right_session")
    best = rows.groupBy("left_session", "left_agent").agg(F.min(F.struct("n", "right_session", "right_agent")).alias("b"))
    return best.select("left_session", "left_agent", "b.right_session", "b.right_agent")


def spawn_pairs(helpers: DataFrame, spawns: DataFrame) -> DataFrame:
    """The spawn call of each helper (session_id, agent_id, first_at): that whose child id begins its own, else the next by time that is free.

    spawns: session_id, call_id, child_id ('' for unknown), ts. Helpers and calls left over stand in time order side by side."""
    by_id = helpers.join(spawns.where("child_id <> ''"), "session_id").where(F.col("agent_id").startswith(F.col("child_id")))
    exact = by_id.groupBy("session_id", "agent_id").agg(F.min(F.struct("ts", "call_id"))["call_id"].alias("call_id"))
    free = spawns.join(exact.select("session_id", "call_id").distinct(), ["session_id", "call_id"], "left_anti")
    rest = helpers.join(exact, ["session_id", "agent_id"], "left_anti")
    place = lambda t, i: F.row_number().over(Window.partitionBy("session_id").orderBy(F.col(t).asc_nulls_first(), i))
    paired = rest.withColumn("n", place("first_at", "agent_id")).join(free.select("session_id", "call_id", place("ts", "call_id").alias("n")), ["session_id", "n"], "left")
    return exact.withColumn("by", F.lit("id")).unionByName(paired.select("session_id", "agent_id", "call_id", F.when(F.col("call_id").isNotNull(), "order").otherwise("none").alias("by")))


def retries(events: DataFrame) -> DataFrame:
    """Tool calls (seq, session_id, agent_id, tool, retry): how often in a row an agent called a tool again right after its error.

    Rows of an agent are read as a sorted stream; only the running counts are held."""
    ship(events.sparkSession)
    schema = "seq long, session_id long, agent_id string, tool string, retry long"
    calls = events.where("kind = 'tool-call' AND tool_use_id IS NOT NULL").groupBy("session_id", "tool_use_id").agg(F.min_by("tool", "seq").alias("failed_tool"))
    rows = events.where("kind IN ('tool-call', 'tool-result')").join(calls, ["session_id", "tool_use_id"], "left").select("seq", "session_id", "agent_id", "kind", "tool", F.coalesce("error", F.lit(False)).alias("error"), "failed_tool")
    rows = rows.repartition("session_id", "agent_id").sortWithinPartitions("session_id", "agent_id", "seq")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, failed, runs = None, None, {}
        for batch in batches:
            out = []
            for seq, session, agent, kind, tool, error, failed_tool in batch.itertuples(index=False):
                if (session, agent) != key:
                    key, failed, runs = (session, agent), None, {}
                if kind == "tool-result":
                    failed = failed_tool if error and failed_tool is not None else failed if error else None
                    continue
                if failed is not None and failed == tool:
                    runs[tool] = runs.get(tool, 0) + 1
                    out.append((seq, session, agent, tool, runs[tool]))
                else:
                    runs.pop(tool, None)
                failed = None
            yield pd.DataFrame(out, columns=["seq", "session_id", "agent_id", "tool", "retry"])

    return rows.mapInPandas(count, schema)


def sparklines(events: DataFrame, buckets: int = 24) -> DataFrame:
    """Each agent's dated events in equal slices of its own time: (session_id, agent_id, heights), heights in percent of the fullest slice."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    dated = events.where("agent_id <> '' AND ts IS NOT NULL").select("session_id", "agent_id", ms.alias("t"))
    bounds = dated.groupBy("session_id", "agent_id").agg(F.min("t").alias("t0"), F.greatest(F.max("t") - F.min("t"), F.lit(1)).alias("span"))
    at = F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("t0")) * buckets / F.col("span")))
    counts = dated.join(bounds, ["session_id", "agent_id"]).groupBy("session_id", "agent_id", at.cast("int").alias("i")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("session_id", "agent_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), F.max("n").alias("most"))  # buckets entries at most
    height = lambda i: F.round(F.coalesce(F.try_element_at("m", i), F.lit(0)) * 100 / F.col("most")).cast("int")
    return maps.select("session_id", "agent_id", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), height).alias("heights"))


def state_at(events: DataFrame, upto: Column) -> DataFrame:
    """Each agent as playback shows it before an event: events, calls, errors and the last time of the rows that upto keeps."""
    return events.where(upto).where("agent_id <> ''").groupBy("session_id", "agent_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("kind") == "tool-call").alias("calls"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"), F.max_by("ts", "seq").alias("last_at"),
    )


def story(events: DataFrame) -> DataFrame:
    """A session's story: each prompt and reply of the main agent, and the bursts of other events between them with their errors and most used tools."""
    main_text = (F.col("agent_id") == "main") & F.col("kind").isin("user-text", "user-queued", "assistant-text")
    order = Window.partitionBy("session_id").orderBy("seq")
    before = F.coalesce(F.lag(main_text.cast("int")).over(order), F.lit(1))
    rows = events.withColumn("said", main_text).withColumn("opens", F.when(F.col("said") | (before == 1), 1).otherwise(0)).withColumn("block", F.sum("opens").over(order))
    blocks = rows.groupBy("session_id", "block").agg(
        F.min("seq").alias("start"), F.count("*").alias("events"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"), F.bool_or("said").alias("said"), F.min("kind").alias("kind"),
        F.count_if(~F.col("said") & (F.col("agent_id") != "main") & (F.col("kind") == "assistant-text")).alias("sub_replies"),
    )
    tools = rows.where("NOT said AND tool IS NOT NULL").groupBy("session_id", "block", flow_tool(F.col("tool")).alias("tool")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("session_id", "block").orderBy(F.desc("n"), "tool")
    tools = tools.withColumn("p", F.row_number().over(best)).where("p <= 4").groupBy("session_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "tool", "n"))), lambda x: F.concat(x["tool"], F.lit("×"), x["n"])), " · ").alias("tools"))
    kind = F.when(~F.col("said"), "burst").when(F.col("kind") == "assistant-text", "reply").otherwise("prompt")
    out = blocks.join(tools, ["session_id", "block"], "left")
    return out.select("session_id", "block", kind.alias("type"), "start", "events", "errors", "sub_replies", F.coalesce("tools", F.lit("")).alias("tools"))


def hook_evidence(events: DataFrame) -> DataFrame:
    """Per session: whether an agent edited a script, and how many later results complain of its syntax."""
    edit = F.coalesce((F.col("kind") == "tool-call") & F.col("tool").isin(*EDITING) & F.col("text").rlike(SCRIPT), F.lit(False))
    complaint = F.coalesce((F.col("kind") == "tool-result") & F.col("text").rlike(SCRIPT) & F.col("text").rlike("|".join(SYNTAX)), F.lit(False))
    earlier = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("edit", edit).withColumn("after", F.coalesce(F.max("edit").over(earlier), F.lit(False)))
    return rows.groupBy("session_id").agg(F.bool_or("edit").alias("edited"), F.count_if(complaint & F.col("after")).alias("errors"))


def hook_summary(evidence: DataFrame) -> DataFrame:
    """The fleet's hook evidence, and whether a hook is proposed: five edited sessions or more, and one with errors."""
    hit = F.col("edited") & (F.col("errors") > 0)
    out = evidence.agg(F.count("*").alias("sessions"), F.count_if("edited").alias("edited"), F.count_if(hit).alias("with_errors"), F.coalesce(F.sum(F.when(hit, F.col("errors"))), F.lit(0)).alias("errors"))
    return out.withColumn("proposed", (F.col("edited") >= LEAST_EDITED) & (F.col("with_errors") > 0))


def hook_examples(evidence: DataFrame) -> DataFrame:
    """The sessions with most such errors."""
    return evidence.where("edited AND errors > 0").orderBy(F.desc("errors"), "session_id").limit(EXAMPLES).select("session_id", "errors")


def model_hook_summary(usage: DataFrame) -> DataFrame:
    """Sessions by whether their usage names its models: none recorded without one, some, or all unknown."""
    per = usage.groupBy("session_id").agg(F.count_if(F.btrim("model") == "").alias("unknown"), F.count("*").alias("n"))
    state = F.when(F.col("unknown") == 0, "attributed").when(F.col("unknown") == F.col("n"), "unattributed").otherwise("partly-attributed")
    return per.groupBy(state.alias("state")).agg(F.count("*").alias("sessions"), F.sum("unknown").cast("long").alias("observations"))


def spawned_children(results: DataFrame) -> DataFrame:
    """results (provider_kind: messages or rollout, record, call_id, native_id, agent_id, ...) with child_native_id and child_state, read from the raw result record.

    A record must be the call's own: of its kind, its session, its caller and its call, with no other call's result beside it
    (source-record-mismatch). The child's id must stand in the structured result (unsupported-result): never in prose. An object
    that repeats a key is no object."""
    ship(results.sparkSession)
    kind_of = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    is_object = lambda v: kind_of(v).startswith("OBJECT")
    text = lambda v, path: F.when(kind_of(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    equals = lambda a, b: F.coalesce(a == b, F.lit(False))
    r = F.col("_r")
    rows = results.withColumn("_r", strict_variant(F.col("record")))
    rows = rows.withColumn("_blocks", F.try_variant_get(r, "$.message.content", "array<variant>"))
    outer = is_object(r) & (F.coalesce("call_id", F.lit("")) != "")
    # A message: one tool result, of this call, and beside it the structured result.
    theirs = equals(text(r, "$.type"), F.lit("user")) & equals(text(r, "$.sessionId"), F.nullif("native_id", F.lit(""))) & equals(F.coalesce(F.nullif(text(r, "$.agentId"), F.lit("")), F.lit("main")), F.col("agent_id"))
    results_in = F.filter("_blocks", lambda b: equals(text(b, "$.type"), F.lit("tool_result")))
    readable = is_object(F.try_variant_get(r, "$.message", "variant")) & F.col("_blocks").isNotNull() & (F.size("_blocks") <= 4096) & F.forall("_blocks", is_object)
    only = (F.size(results_in) == 1) & equals(text(F.get(results_in, 0), "$.tool_use_id"), F.col("call_id"))
    message_child = text(r, "$.toolUseResult.agentId")
    # A rollout: the call's output, an object or the text of one.
    output = F.coalesce(strict_variant(text(r, "$.payload.output")), F.try_variant_get(r, "$.payload.output", "variant"))
    rows = rows.withColumn("_output", F.when(F.col("provider_kind") == "rollout", output))
    own = equals(text(r, "$.type"), F.lit("response_item")) & equals(text(r, "$.payload.type"), F.lit("function_call_output")) & equals(text(r, "$.payload.call_id"), F.col("call_id"))
    rollout = F.col("provider_kind") == "rollout"
    child = F.when(rollout, text(F.col("_output"), "$.agent_id")).otherwise(message_child)
    sound = (child != "") & (F.octet_length(child) <= 512) & ~child.contains("\0") & ~child.contains("\ufffd")
    state = (
        F.when(~outer | F.when(rollout, ~own).otherwise(~theirs), "source-record-mismatch").when(~rollout & ~readable, "unsupported-result").when(~rollout & ~only, "source-record-mismatch")
        .when(F.coalesce(sound, F.lit(False)), "known").otherwise("unsupported-result")
    )
    out = rows.withColumn("child_state", state).withColumn("child_native_id", F.when(F.col("child_state") == "known", child))
    return out.drop("_r", "_blocks", "_output")


def delegation_children(spawns: DataFrame, sessions: DataFrame) -> DataFrame:
    """The child session of each spawn call (seq, session_id, span_state, child_native_id): only structured ids count.

    States: call-result-<state of the span>, missing-child-identity, missing-parent-identity, ambiguous-parent,
    child-not-indexed-or-parent-mismatch, ambiguous-child, resolved."""
    who = ["machine_id", "provider"]
    parents = sessions.select(F.col("id").alias("session_id"), *who, F.col("native_id").alias("parent"))
    twins = sessions.groupBy(*who, F.col("native_id").alias("parent")).agg(F.count("*").alias("parents"))
    children = sessions.where("parent_native_id <> ''").groupBy(*who, F.col("parent_native_id").alias("parent"), F.col("native_id").alias("child_native_id")).agg(F.count("*").alias("children"), F.min("id").alias("child"))
    rows = spawns.join(parents, "session_id", "left").join(twins, [*who, "parent"], "left").join(children, [*who, "parent", "child_native_id"], "left")
    state = (
        F.when(F.col("span_state") != "matched", F.concat(F.lit("call-result-"), "span_state"))
        .when(F.coalesce("child_native_id", F.lit("")) == "", F.coalesce("child_state", F.lit("missing-child-identity")) if "child_state" in spawns.columns else F.lit("missing-child-identity"))
        .when(F.coalesce("parent", F.lit("")) == "", "missing-parent-identity")
        .when(F.col("parents") > 1, "ambiguous-parent")
        .when(F.col("children").isNull(), "child-not-indexed-or-parent-mismatch")
        .when(F.col("children") > 1, "ambiguous-child")
        .otherwise("resolved")
    )
    return rows.select("seq", "session_id", state.alias("state"), F.when(state == "resolved", F.col("child")).alias("child"))


def recent_runs(sessions: DataFrame, sources: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Sessions of the last 20 minutes: active in the last ten, read to the end, and stalled (null unless known).

    A run that has been silent for ten minutes is taken to be over, not to have succeeded."""
    ago = lambda n: now - F.expr(f"INTERVAL {n} MINUTES")
    recent = sessions.where((F.col("last_activity") >= ago(20)) & (F.col("last_activity") <= now))
    rows = recent.join(sources.select("source_id", "generation", "durable_offset", "indexed_offset", "modified_at"), ["source_id", "generation"])
    active = F.col("last_activity") > ago(10)
    synced = (F.col("durable_offset") == F.col("indexed_offset")) & (F.col("modified_at").isNull() | (F.col("modified_at") <= now))
    rows = rows.select(F.col("id").alias("session_id"), "machine_id", "last_activity", active.alias("active"), synced.alias("synced"))
    window = events.where((F.col("ts") >= ago(10)) & (F.col("ts") <= now)).join(rows.select("session_id"), "session_id", "left_semi").where("kind IN ('tool-call', 'tool-result')")
    named = F.coalesce("tool_use_id", F.lit("")) != ""
    pairs = window.groupBy("session_id", "agent_id", "tool_use_id").agg(F.count_if(F.col("kind") == "tool-call").alias("calls"), F.count_if(F.col("kind") == "tool-result").alias("results"), F.max(F.when(F.col("kind") == "tool-call", F.col("ts"))).alias("at"))
    per = pairs.groupBy("session_id").agg(
        F.bool_and(named & (F.col("calls") <= 1) & (F.col("results") <= 1)).alias("known"), F.bool_or(named & (F.col("calls") == 1) & (F.col("results") == 0) & (F.col("at") < ago(2))).alias("late"),
    )
    out = rows.join(per, "session_id", "left")
    return out.select("session_id", "machine_id", "last_activity", "active", "synced", F.when(F.col("synced") & F.coalesce("known", F.lit(True)), F.coalesce("late", F.lit(False)) & F.col("active")).alias("stalled"))


def live_agents(agents: DataFrame, now: Column, limit: int = 6) -> DataFrame:
    """Agents (session_id, agent_id, last_at, stuck) active in the last ten minutes, the newest few of each session, with their true number; stuck ones do not count."""
    live = agents.where((F.col("last_at") > now - F.expr("INTERVAL 10 MINUTES")) & (F.col("last_at") <= now) & ~F.col("stuck"))
    whole = Window.partitionBy("session_id")
    ranked = live.withColumns({"live": F.count("*").over(whole), "n": F.row_number().over(whole.orderBy(F.desc("last_at"), "agent_id"))})
    return ranked.where(F.col("n") <= limit).select("session_id", "agent_id", "last_at", "live")


def chunk_gaps(chunks: DataFrame) -> DataFrame:
    """Chunks (source_id, offset, length) that do not begin where the one before ended: expected and actual offset."""
    order = Window.partitionBy("source_id").orderBy("offset")
    rows = chunks.withColumn("expected", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0)))
    return rows.where("offset <> expected").select("source_id", "offset", "expected")


def recent_calls(calls: DataFrame, limit: int = 400) -> DataFrame:
    """The newest tool calls of all agents with a readable argument: command, path or url."""
    v = F.try_parse_json("input")
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    argument = F.coalesce(get("command"), get("file_path"), get("url"))
    kind = F.when(get("command").isNotNull(), "command").when(get("file_path").isNotNull(), "path").when(get("url").isNotNull(), "url")
    return calls.where("kind = 'tool-call'").orderBy(F.desc("seq")).limit(limit).select("seq", "session_id", "tool", kind.alias("argument_kind"), argument.alias("argument"))


def permission_preview(calls: DataFrame, rule: str) -> DataFrame:
    """recent_calls() with whether a permission rule covers each; null where the rule's form does not decide."""
    return calls.withColumn("covered", permissions.covers(rule, F.col("tool"), F.col("argument_kind"), F.col("argument")))


def rule_report(clauses: list[tuple[str, str, str]], events: DataFrame, agents: DataFrame, least: int = 3) -> DataFrame:
    """Clauses of detect.read_rules() against the record: sessions to which each applies, those that break it, and those that cannot be judged.

    ban: sessions with calls; broken by a call of the tool. order: agents that ran the second tool; broken without the first before it.
    tier: sessions with such a role under a known model; broken by a model above the tier."""
    spark = events.sparkSession
    calls = events.where("kind = 'tool-call'")
    out = [spark.createDataFrame([], "clause int, kind string, a string, b string, applicable long, broken long, unjudged long")]
    rank = F
    for tier, n in detect.TIER_RANK.items():
        rank = rank.when(model_tier(F.col("model")) == tier, n)
    for i, (kind, a, b) in enumerate(clauses):
        if kind == "ban":
            rows = calls.groupBy("session_id").agg(F.bool_or(F.col("tool") == a).alias("bad"), F.lit(True).alias("known"))
        elif kind == "order":
            before = Window.partitionBy("session_id", "agent_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
            seen = F.coalesce(F.max(F.col("tool") == a).over(before), F.lit(False))
            rows = calls.where(F.col("tool").isin(a, b)).withColumn("seen", seen).where(F.col("tool") == b).groupBy("session_id").agg(F.bool_or(~F.col("seen")).alias("bad"), F.lit(True).alias("known"))
        else:
            role = agents.where(flow_role(F.col("name")).rlike(rf"(?i)\b\Q{a}\E\b")).withColumn("rank", rank)
            rows = role.groupBy("session_id").agg(F.bool_or(F.coalesce(F.col("rank") > detect.TIER_RANK[b], F.lit(False))).alias("bad"), F.bool_or(F.col("rank").isNotNull()).alias("known"))
        one = rows.agg(F.count_if("known").alias("applicable"), F.count_if(F.col("known") & F.coalesce("bad", F.lit(False))).alias("broken"), F.count_if(~F.col("known")).alias("unjudged"))
        out.append(one.select(F.lit(i).alias("clause"), F.lit(kind).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), "applicable", "broken", "unjudged"))
    return reduce(DataFrame.unionByName, out).withColumn("enough", F.col("applicable") >= least)
