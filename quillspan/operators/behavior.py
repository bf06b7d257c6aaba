"""How agents work across the fleet: team shapes, roles, outcomes, and what follows from them.

An outcome is only clean where the evidence is whole: errors beat unknowns, and unknowns beat silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import TOP_TIERS, all_tokens, flow_role, flow_tool, millis_between, model_tier, money, top_tier
from quillspan.operators.economics import with_names

#: Fixed rough prices of a million output tokens by tier, for what a cheaper tier would have cost.
TIER_RATE = {"flagship": 50.0, "premium": 25.0, "mid": 15.0, "cheap": 5.0}
WHOLE = ("complete", "indexed-source")


def _incomplete() -> Column:
    """Whether a session's evidence is not whole; on a row of sessions joined with sources."""
    return ~F.col("completeness").isin(*WHOLE) | F.col("indexed_offset").isNull() | (F.col("indexed_offset") < F.col("durable_offset"))


def _with_sources(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    return sessions.join(sources.select("source_id", "generation", "indexed_offset", "durable_offset"), ["source_id", "generation"], "left")


def team(events: DataFrame, usage: DataFrame) -> DataFrame:
    """Per session: distinct named agents of events and usage, and whether anything has no agent."""
    scopes = events.select("session_id", "agent_id").unionByName(usage.select("session_id", "agent_id")).distinct()
    return scopes.groupBy("session_id").agg(F.count_if(F.col("agent_id") != "").alias("agents"), F.bool_or(F.col("agent_id") == "").alias("unattributed"))


def _event_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"),
        F.count_if((F.col("kind") == "tool-result") & F.col("error").isNull()).alias("unknown_results"), F.count_if(F.col("kind") == "indexing-error").alias("indexing_errors"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )


def top_tools(events: DataFrame, limit: int = 3) -> DataFrame:
    """Per session the names of its most called tools as a JSON list: calls falling, then name."""
    calls = events.where("kind = 'tool-call'").groupBy("session_id", flow_tool(F.col("tool")).alias("name")).agg(F.count("*").alias("calls"))
    order = Window.partitionBy("session_id").orderBy(F.desc("calls"), "name")
    best = calls.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return best.groupBy("session_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"])).alias("tools"))


def patterns_of(sessions: DataFrame, events: DataFrame, usage: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, last_activity, fanout, tools, outcome) of each session."""
    keyed = _with_sources(sessions, sources).withColumn("session_id", F.col("id"))
    rows = keyed.join(team(events, usage), "session_id", "left").join(_event_counts(events, "session_id"), "session_id", "left").join(top_tools(events), "session_id", "left")
    n = F.coalesce("agents", F.lit(0))
    fanout = (
        F.when(F.col("unattributed"), "incomplete-attribution").when(n == 0, "unobserved").when(n == 1, "solo").when(n <= 5, "small-team").when(n <= 30, "team").otherwise("fleet")
    )
    outcome = (
        F.when(F.col("errors") > 0, "reported-errors")
        .when(F.coalesce("events", F.lit(0)) == 0, "no-indexed-events")
        .when((F.col("unknown_results") + F.col("indexing_errors") > 0) | _incomplete(), "unknown")
        .otherwise("no-reported-errors")
    )
    return rows.select("id", "last_activity", fanout.alias("fanout"), F.coalesce("tools", F.lit("[]")).alias("tools"), outcome.alias("outcome"))


def behavior_patterns(sessions: DataFrame, events: DataFrame, usage: DataFrame, sources: DataFrame) -> DataFrame:
    """Sessions by team shape, most called tools and outcome; the example is the smallest id of the latest activity."""
    latest = F.struct((-F.coalesce(F.unix_micros(F.col("last_activity").cast("timestamp")), F.lit(-(2**62)))).alias("t"), F.col("id").alias("id"))
    out = patterns_of(sessions, events, usage, sources).groupBy("fanout", "tools", "outcome")
    return out.agg(F.count("*").alias("sessions"), F.min(latest)["id"].alias("example"), F.max("last_activity").alias("last_activity"))


def behavior_roles(sessions: DataFrame, events: DataFrame, usage: DataFrame, priced: DataFrame, names: DataFrame | Column, sources: DataFrame, child_provider: str = "claude") -> DataFrame:
    """Helpers by role: appearances, outcomes, mean time, tokens and cost; main agents count only where they are helpers.

    A main agent is one where its session has a parent, or is itself the session's native agent with child_provider. names is as in with_names();
    where usage and priced are the same table, it is read once."""
    keys = ["session_id", "agent_id"]
    tokens = [F.sum(all_tokens()).cast("long").alias("tokens"), F.sum(F.when(F.col("model") == "", all_tokens()).otherwise(0)).cast("long").alias("unattributed")]
    cost = [F.sum("cost").alias("cost"), F.sum("priced_tokens").cast("long").alias("priced")]
    used = priced.groupBy(*keys).agg(*tokens, *cost) if usage is priced else usage.groupBy(*keys).agg(*tokens).join(priced.groupBy(*keys).agg(*cost), keys, "left")
    rows = _event_counts(events, *keys).join(used, keys, "full_outer").where("agent_id <> ''")
    rows = rows.join(_with_sources(sessions, sources).withColumn("session_id", F.col("id")), "session_id")
    helper = (F.col("agent_id") != "main") | (F.col("parent_native_id") != "") | ((F.col("provider") == child_provider) & (F.col("native_agent_id") == F.col("agent_id")))
    rows = rows.where(helper)
    rows = with_names(rows, names)
    priced_tokens, tokens = F.coalesce("priced", F.lit(0)), F.coalesce("tokens", F.lit(0))
    outcome = (
        F.when(F.coalesce("errors", F.lit(0)) > 0, "errors")
        .when((F.coalesce("events", F.lit(0)) == 0) | (F.coalesce("unknown_results", F.lit(0)) > 0) | (F.coalesce("indexing_errors", F.lit(0)) > 0) | _incomplete(), "unknown")
        .otherwise("no-reported-errors")
    )
    rows = rows.withColumns(
        {
            "role": flow_role(F.col("name")), "outcome": outcome, "observed_ms": F.when(F.col("last_at") >= F.col("first_at"), millis_between(F.col("first_at"), F.col("last_at"))),
            "tokens": tokens, "priced": priced_tokens, "unpriced": F.greatest(tokens - priced_tokens, F.lit(0)), "cost": F.when(priced_tokens > 0, F.col("cost")),
        }
    )
    latest = F.struct((-F.coalesce(F.unix_micros(F.col("last_activity").cast("timestamp")), F.lit(-(2**62)))).alias("t"), F.col("session_id").alias("id"), "agent_id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.groupBy("role").agg(
        F.count("*").alias("appearances"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("machine_id").alias("machines"), total("errors"),
        *[F.count_if(F.col("outcome") == k).alias(n) for k, n in (("errors", "with_errors"), ("no-reported-errors", "without_errors"), ("unknown", "unknown"))],
        F.count("observed_ms").alias("timed"), F.round(F.avg("observed_ms"), 3).alias("mean_ms"), *map(total, ("tokens", "priced", "unpriced", "unattributed")),
        F.round(F.sum("cost"), 4).alias("cost"), F.count("cost").alias("with_cost"), F.min(latest)["id"].alias("example"), F.max("last_activity").alias("last_activity"),
    )


# --- insights over agents (session_id, agent_id, machine_id, name, model, errors, cost, ...) ------------------


def _roles(agents: DataFrame) -> DataFrame:
    return agents.where("agent_id <> 'main'").withColumn("role", flow_role(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("subagent"))))


def _runs(rows: DataFrame, keys: str | list[str], *more: Column) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(F.col("errors") == 0).alias("clean"), F.sum("cost").alias("cost"), F.bool_and(top_tier(F.col("model"))).alias("only_top"), *more)


def failing_roles(agents: DataFrame) -> DataFrame:
    """Roles with three runs or more of which fewer than 70 % were clean."""
    rows = _runs(_roles(agents), "role").where("runs >= 3 AND clean / runs < 0.7")
    return rows.select("role", "runs", "clean", F.round(1 - F.col("clean") / F.col("runs"), 4).alias("failing"))


def environment_roles(agents: DataFrame) -> DataFrame:
    """Roles whose clean share differs by more than 30 points between machines with two runs or more each."""
    by = _runs(_roles(agents), ["role", "machine_id"]).where("runs >= 2").withColumn("rate", F.col("clean") / F.col("runs"))
    ends = by.groupBy("role").agg(
        F.count("*").alias("machines"), F.min(F.struct((-F.col("rate")).alias("r"), F.col("machine_id").alias("m"))).alias("best"), F.min(F.struct(F.col("rate").alias("r"), F.col("machine_id").alias("m"))).alias("worst"),
    )
    out = ends.where((F.col("machines") >= 2) & (-F.col("best.r") - F.col("worst.r") > 0.3))
    return out.select("role", "machines", F.col("best.m").alias("best_machine"), F.round(-F.col("best.r"), 4).alias("best_rate"), F.col("worst.m").alias("worst_machine"), F.round("worst.r", 4).alias("worst_rate"))


def delegation(agents: DataFrame) -> DataFrame:
    """Per session: agents, and the cost of the main agent, of helpers, of helpers and of all on the two top tiers."""
    main, top = F.col("agent_id") == "main", top_tier(F.col("model"))
    part = lambda keep: F.coalesce(F.sum(F.when(keep, F.coalesce("cost", F.lit(0.0)))), F.lit(0.0))
    return agents.groupBy("session_id").agg(F.count("*").alias("agents"), part(main).alias("main_cost"), part(~main).alias("sub_cost"), part(~main & top).alias("sub_top_cost"), part(top).alias("top_cost"))


def flat_delegation(sessions: DataFrame, least: float = 20, least_sub: float = 10) -> DataFrame:
    """Sessions of delegation() that gave their work to agents as dear as their own, and what the middle tier would have cost."""
    rows = sessions.where((F.col("main_cost") + F.col("sub_cost") > least) & (F.col("sub_cost") > least_sub) & (F.col("sub_top_cost") / F.col("sub_cost") > 0.7))
    return rows.select("session_id", "agents", money("sub_cost").alias("sub_cost"), money("sub_top_cost").alias("sub_top_cost"), money(F.col("sub_top_cost") * TIER_RATE["mid"] / TIER_RATE["premium"]).alias("at_mid_tier"))


def hoarding(sessions: DataFrame, least: float = 20, least_sub: float = 10) -> DataFrame:
    """Sessions of delegation() that spent over 60 % in the main agent beside more than five agents, and did not delegate flatly."""
    total = F.col("main_cost") + F.col("sub_cost")
    flat = (F.col("sub_cost") > least_sub) & (F.try_divide("sub_top_cost", "sub_cost") > 0.7)
    rows = sessions.where((total > least) & ~F.coalesce(flat, F.lit(False)) & (F.col("main_cost") / total > 0.6) & (F.col("agents") > 5))
    return rows.select("session_id", "agents", F.round(F.col("main_cost") / total, 4).alias("share"), F.round(total, 4).alias("total"))


def healthy_tiering(sessions: DataFrame, least: float = 20) -> DataFrame:
    """One row where helpers cost more than the least in all, and under 40 % of it on the top tiers; else none."""
    out = sessions.agg(F.sum("sub_cost").alias("s"), F.sum("sub_top_cost").alias("t")).where((F.col("s") > least) & (F.col("t") / F.col("s") < 0.4))
    return out.select(F.round("s", 4).alias("sub_cost"), F.round(1 - F.col("t") / F.col("s"), 4).alias("cheaper_share"))


def reliable_roles(agents: DataFrame) -> DataFrame:
    """The three roles with most runs of those with three or more, 85 % of them clean; none where fewer than two qualify."""
    good = _runs(_roles(agents), "role").where("runs >= 3 AND clean / runs >= 0.85").select("role", "runs", "clean")
    best = good.orderBy(F.desc("runs"), "role").limit(3)
    return best.join(best.agg(F.count("*").alias("n")), F.col("n") >= 2).drop("n")


def model_costs(usage_costs: DataFrame) -> DataFrame:
    """Cost and output of each model over agents (session_id, agent_id, model, cost, tokens_out): an agent that used several models counts for each."""
    return usage_costs.where("model <> ''").groupBy("model").agg(F.countDistinct("session_id", "agent_id").alias("agents"), F.sum("cost").alias("cost"), F.sum("tokens_out").cast("long").alias("tokens_out"))


def downgrade_candidates(agents: DataFrame, usage_costs: DataFrame, least: float = 20) -> DataFrame:
    """Where over 60 % of the cost is on the top tiers: the three dearest roles that ran only there and are reliable, and what the middle tier would save."""
    spent = model_costs(usage_costs).agg(F.sum("cost").alias("all"), F.sum(F.when(top_tier(F.col("model")), F.col("cost"))).alias("top"))
    spent = spent.where((F.col("all") > least) & (F.col("top") / F.col("all") > 0.6))
    rate = F
    for tier in TOP_TIERS:
        rate = rate.when(model_tier(F.col("model")) == tier, TIER_RATE[tier])
    named = F.coalesce("model", F.lit("")) != ""
    runs = _runs(_roles(agents), "role", F.bool_or(named).alias("named"), F.max(F.when(named, rate)).alias("rate"))
    good = runs.where("runs >= 3 AND clean / runs >= 0.85 AND only_top AND named").join(spent.select("top", "all"), F.lit(True))
    out = good.orderBy(F.desc(F.round("cost", 4)), "role").limit(3)
    return out.select("role", "runs", F.round("cost", 4).alias("cost"), F.round(F.col("cost") * (1 - TIER_RATE["mid"] / F.col("rate")), 4).alias("saved"))


def session_shapes(agents: DataFrame, events: DataFrame) -> DataFrame:
    """Per session its shape in words: team size with the main agent, most called tools, and whether anything failed."""
    tools = top_tools(events).select("session_id", F.array_join(F.from_json("tools", "array<string>"), "+").alias("tools"))
    n = agents.groupBy("session_id").agg(F.count("*").alias("agents"))
    failed = events.groupBy("session_id").agg(F.bool_or(F.coalesce("error", F.lit(False))).alias("failed"))
    fan = F.when(F.col("agents") <= 1, "solo").when(F.col("agents") <= 5, "small-team").when(F.col("agents") <= 30, "team").otherwise("fleet")
    rows = n.join(tools, "session_id", "left").join(failed, "session_id", "left")
    shape = F.concat_ws(" · ", fan, F.coalesce("tools", F.lit("no-tools")), F.when(F.coalesce("failed", F.lit(False)), "errors").otherwise("clean"))
    return rows.select("session_id", shape.alias("shape"))


def flow_clusters(shapes: DataFrame) -> DataFrame:
    """Sessions of each shape; a shape of one session is an outlier."""
    out = shapes.groupBy("shape").agg(F.count("*").alias("sessions"), F.min("session_id").alias("example"))
    return out.withColumn("outlier", F.col("sessions") == 1)


def directive_impact(sessions: DataFrame, created_at: Column) -> DataFrame:
    """Top-tier share of cost before and after a rule was set, over delegation() joined with last_activity; a verdict needs five sessions after it."""
    after = F.col("last_activity") >= created_at
    total = F.col("main_cost") + F.col("sub_cost")
    rows = sessions.where(total > 0).withColumn("total", total).withColumn("after", F.coalesce(after, F.lit(False)))
    part = lambda x, when: F.sum(F.when(when, F.col(x)).otherwise(0.0))
    out = rows.agg(
        F.count_if(~F.col("after")).alias("before_sessions"), F.count_if("after").alias("after_sessions"),
        F.round(100 * F.try_divide(part("top_cost", ~F.col("after")), part("total", ~F.col("after")))).alias("before_pct"), F.round(100 * F.try_divide(part("top_cost", F.col("after")), part("total", F.col("after")))).alias("after_pct"),
    )
    verdict = (
        F.when(F.col("after_sessions") < 5, "too early").when(F.col("before_pct").isNull(), "nothing before").when(F.col("after_pct") < F.col("before_pct"), "improving")
        .when(F.col("after_pct") > F.col("before_pct"), "not helping").otherwise("flat")
    )
    return out.withColumn("verdict", verdict)
