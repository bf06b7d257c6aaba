"""Where the money goes: lanes, lifetimes, models, and how these change from day to day.

Costs that the evidence does not give stay null; what is unpriced or without a breakdown is counted by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import TOKENS, TOP_TIERS, all_tokens, model_tier, money, name_prices

LANES = ("cost_input", "cost_cache_read", "cost_cache_write", "cost_output")
#: Fixed bounds of the lifetime buckets, in replies of an agent.
LIFETIMES = ((1, 2), (3, 5), (6, 10), (11, 20), (21, 40), (41, 80), (81, 160), (161, None))
TOP_FLOW = 14


def _long(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def lifetime_bucket(replies: Column) -> Column:
    """The index of the lifetime bucket, -1 for none."""
    bucket = F.when(replies <= 0, -1)
    for i, (_, most) in enumerate(LIFETIMES[:-1]):
        bucket = bucket.when(replies <= most, i)
    return bucket.otherwise(len(LIFETIMES) - 1)


def lifetime_label(bucket: Column) -> Column:
    names = [f"{a}–{b}" if b else f"{a}+" for a, b in LIFETIMES]
    return F.get(F.array(*map(F.lit, names)), bucket)


def with_names(rows: DataFrame, names: DataFrame | Column) -> DataFrame:
    """rows with the names of their agents: from a table, or where a name follows from the keys, by a column without a join."""
    if isinstance(names, Column):
        return rows.withColumn("name", names)
    return rows.join(names.select("session_id", "agent_id", "name"), ["session_id", "agent_id"], "left")


def agent_facts(usage: DataFrame, events: DataFrame, names: DataFrame | Column, sessions: DataFrame) -> DataFrame:
    """One row for each agent of a session: name, machine, first model, errors, cost, output and replies.

    names is as in with_names(). usage carries its cost; a reply without one is not priced, and an agent without usage has no cost."""
    keys = ["session_id", "agent_id"]
    first = F.struct(F.coalesce("ts", F.lit("9999-01-01").cast("timestamp_ntz")), "id")
    named = F.col("model") != ""
    used = usage.where("agent_id <> ''").groupBy(*keys).agg(
        F.min_by(F.when(named, F.col("model")), F.when(named, first)).alias("model"), F.sum("cost").alias("cost"), F.sum("tokens_out").cast("long").alias("tokens_out"),
        F.count("*").alias("replies"), F.count("cost").alias("priced_replies"),
    )
    seen = events.where("agent_id <> ''").groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
    )
    rows = with_names(used.join(seen, keys, "full_outer"), names).join(sessions.select(F.col("id").alias("session_id"), "machine_id", "last_activity"), "session_id")
    zero = ("errors", "events", "tokens_out", "replies", "priced_replies")
    return rows.withColumns({k: F.coalesce(k, F.lit(0)) for k in zero})


def economics_costs(cat: DataFrame) -> DataFrame:
    """Recorded and priced tokens and the four lanes of known cost of a catalog; tokens priced without a breakdown are counted apart."""
    known = F.col("cost_input").isNotNull()
    out = cat.agg(
        F.count("*").alias("sessions"), _long(all_tokens()).alias("recorded_tokens"), _long("priced_tokens").alias("priced_tokens"), F.round(F.sum("cost_estimate"), 4).alias("known_cost"),
        F.count_if(known).alias("sessions_with_breakdown"), _long(F.when(known, F.col("priced_tokens"))).alias("broken_down_tokens"),
        *[money(F.coalesce(F.sum(c), F.lit(0.0))).alias(c) for c in LANES],
    )
    return out.withColumns(
        {
            "sessions_without_breakdown": F.col("sessions") - F.col("sessions_with_breakdown"), "unpriced_tokens": F.col("recorded_tokens") - F.col("priced_tokens"),
            "priced_without_breakdown": F.col("priced_tokens") - F.col("broken_down_tokens"),
        }
    )


def economics_lifetimes(cat: DataFrame, usage: DataFrame, provider: str = "claude") -> DataFrame:
    """Child agents' sessions by number of messages, in eight buckets (-1: none seen), with the comparable cost of those that qualify.

    One qualifies where every observation is its own and a message, what was observed is what was recorded, and all of it is priced."""
    children = cat.where((F.col("provider") == provider) & (F.col("native_agent_id") != "")).select(
        F.col("id").alias("session_id"), "native_agent_id", all_tokens().alias("recorded"), "priced_tokens", "pricing_known", "cost_estimate"
    )
    own = F.col("agent_id") == F.col("native_agent_id")
    message = F.col("kind").isin("message-final", "message-partial")
    per = usage.join(children.select("session_id", "native_agent_id"), "session_id").groupBy("session_id").agg(
        F.count_if(own & message).alias("messages"), F.count_if(own & (F.col("kind") == "message-without-id")).alias("unstable"), F.count_if(~own | ~message).alias("unsupported"), F.sum(all_tokens()).alias("observed"),
    )
    rows = children.join(per, "session_id", "left").fillna(0, ["messages", "unstable", "unsupported", "observed"])
    eligible = (F.col("messages") > 0) & (F.col("unsupported") == 0) & (F.col("observed") == F.col("recorded")) & (F.col("recorded") > 0) & F.col("pricing_known") & (F.col("priced_tokens") == F.col("recorded")) & F.col("cost_estimate").isNotNull()
    rows = rows.withColumns({"bucket": lifetime_bucket(F.col("messages")), "eligible": eligible})
    found = rows.groupBy("bucket").agg(
        F.count("*").alias("agents"), _long("messages").alias("messages"), _long("recorded").alias("recorded_tokens"), F.count_if(F.col("unstable") > 0).alias("unstable_agents"),
        F.count_if("eligible").alias("eligible_agents"), _long(F.when(F.col("eligible"), F.col("messages"))).alias("eligible_messages"), F.round(F.sum(F.when(F.col("eligible"), F.col("cost_estimate"))), 4).alias("comparable_cost"),
    )
    spine = cat.sparkSession.range(-1, len(LIFETIMES)).select(F.col("id").cast("int").alias("bucket"))
    counts = [c for c in found.columns if c not in ("bucket", "comparable_cost")]
    return spine.join(F.broadcast(found), "bucket", "left").fillna(0, counts).withColumn("label", F.when(F.col("bucket") >= 0, lifetime_label(F.col("bucket"))))


def sweet_spot(buckets: DataFrame, least_agents: int = 5, least_buckets: int = 3) -> DataFrame:
    """The lifetime with the least cost a reply of buckets (bucket, agents, turns, cost), among those with enough agents; none where few have."""
    shown = buckets.where((F.col("agents") >= least_agents) & (F.col("turns") > 0) & (F.col("bucket") >= 0)).withColumn("per_turn", F.col("cost") / F.col("turns"))
    out = shown.agg(F.count("*").alias("n"), F.min(F.struct("per_turn", "bucket")).alias("b")).where(F.col("n") >= least_buckets)
    return out.select(F.col("b.bucket").alias("bucket"), lifetime_label(F.col("b.bucket")).alias("label"), F.round("b.per_turn", 6).alias("cost_per_turn"))


def lane_costs() -> dict[str, Column]:
    """The four lanes of a row's cost by the model's name; null for a model without a price."""
    price_in, price_out = name_prices(F.col("model"))
    return {
        "cost_input": F.col("tokens_in") * price_in / 1e6, "cost_cache_read": F.col("tokens_cache") * 0.1 * price_in / 1e6,
        "cost_cache_write": F.col("tokens_write") * 1.25 * price_in / 1e6, "cost_output": F.col("tokens_out") * price_out / 1e6,
    }


def session_economics(usage: DataFrame, agents: DataFrame, *keys: str) -> DataFrame:
    """By the given keys (none: the fleet): four lanes of cost, helpers, those of one or two replies and their cost, and helpers under 90 % priced."""
    lanes = usage.withColumns(lane_costs()).groupBy(*keys).agg(*[F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(c) for c in LANES])
    subs = agents.where("agent_id <> 'main' AND replies > 0")
    cost = F.coalesce("cost", F.lit(0.0))
    counts = subs.groupBy(*keys).agg(
        F.count("*").alias("subs"), F.round(F.coalesce(F.sum(F.when(F.col("replies") <= 2, cost)), F.lit(0.0)), 2).alias("one_shot_cost"), F.count_if(F.col("priced_replies") < 0.9 * F.col("replies")).alias("unpriced_agents"),
    )
    joined = lanes.join(counts, list(keys), "left") if keys else lanes.join(counts, F.lit(True))
    return joined.fillna(0, ["subs", "unpriced_agents"]).fillna(0.0, ["one_shot_cost"])


def lifetime_curve(agents: DataFrame) -> DataFrame:
    """Helpers, replies and cost by lifetime; helpers of which under 90 % of the replies are priced stay out."""
    subs = agents.where("agent_id <> 'main' AND replies > 0 AND priced_replies >= 0.9 * replies").withColumn("bucket", lifetime_bucket(F.col("replies")))
    return subs.groupBy("bucket").agg(F.count("*").alias("agents"), F.sum("replies").cast("long").alias("turns"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 2).alias("cost"))


def economics_snapshot(usage: DataFrame, agents: DataFrame) -> DataFrame:
    """The fleet's ratios of a day: context and output share where a dollar was spent, top-tier share where ten were, and the sweet spot."""
    lanes = session_economics(usage, agents)
    total = sum((F.col(c) for c in LANES[1:]), F.col(LANES[0]))
    tiers = usage.agg(F.sum("cost").alias("all"), F.sum(F.when(model_tier(F.col("model")).isin(*TOP_TIERS), F.col("cost"))).alias("top"), F.sum(F.when(model_tier(F.col("model")) == "cheap", F.col("cost"))).alias("cheap"))
    best = sweet_spot(lifetime_curve(agents)).select(F.col("bucket").alias("sweet_bucket"), F.round("cost_per_turn", 3).alias("sweet_per_turn"))
    out = lanes.join(tiers, F.lit(True)).join(best, F.lit(True), "left")
    ratio = lambda part, whole, least: F.when(whole >= least, F.round(part / whole, 2))
    return out.select(
        "subs", F.round(total, 2).alias("total_usd"), ratio(F.col("cost_cache_read") + F.col("cost_cache_write"), total, 1).alias("context_share"), ratio(F.col("cost_output"), total, 1).alias("output_share"),
        ratio(F.coalesce("top", F.lit(0.0)), F.col("all"), 10).alias("top_tier_share"), F.round(F.coalesce("cheap", F.lit(0.0)), 2).alias("cheap_usd"), "one_shot_cost", "sweet_bucket", "sweet_per_turn",
    )


def capture(history: DataFrame, snapshot: DataFrame, at: Column, least_hours: float = 20, timed: bool = True) -> DataFrame:
    """The rows to append to a history (at, ...): the snapshot stamped with at, or none where a timer asks too soon after the last."""
    last = history.agg(F.max("at").alias("last"))
    due = F.col("last").isNull() | (at >= F.col("last") + F.make_dt_interval(hours=F.lit(int(least_hours)))) if timed else F.lit(True)
    return snapshot.join(last.where(due), F.lit(True)).drop("last").withColumn("at", at)


def history_series(history: DataFrame) -> DataFrame:
    """The points of a history (at, known_cost, recorded_tokens, priced_tokens) that are consistent, with the share priced in percent."""
    fine = (F.col("recorded_tokens") >= 0) & F.col("priced_tokens").between(0, F.col("recorded_tokens")) & (F.col("known_cost").isNull() | (F.col("known_cost") >= 0))
    return history.where(fine).select("at", "known_cost", "recorded_tokens", F.round(F.when(F.col("recorded_tokens") > 0, 100 * F.col("priced_tokens") / F.col("recorded_tokens")), 4).alias("coverage_pct"))


def session_agents(events: DataFrame, usage: DataFrame, priced: DataFrame) -> DataFrame:
    """Each session's agents: events, errors, tokens, tokens without a model, and a price only where the priced rows' tokens are those recorded."""
    keys = ["session_id", "agent_id"]
    seen = events.groupBy(*keys).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "tool-call").alias("tool_calls"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"))
    used = usage.groupBy(*keys).agg(F.count("*").alias("observations"), *[F.sum(t).cast("long").alias(t) for t in TOKENS], F.sum(F.when(F.col("model") == "", all_tokens()).otherwise(0)).cast("long").alias("unknown_model_tokens"))
    cost = priced.groupBy(*keys).agg(F.sum("cost").alias("cost"), F.sum("priced_tokens").cast("long").alias("priced_tokens"), F.sum(all_tokens()).cast("long").alias("_recorded"))
    out = seen.join(used, keys, "full_outer").join(cost, keys, "left")
    counts = ["events", "tool_calls", "errors", "observations", *TOKENS, "unknown_model_tokens"]
    out = out.fillna(0, counts)
    agree = (F.col("_recorded") == all_tokens()) & (F.col("priced_tokens") > 0)
    return out.select(*keys, *counts, F.when(agree, F.round("cost", 10)).alias("cost"), F.when(agree, F.col("priced_tokens")).alias("priced_tokens"))


def cost_flow(priced: DataFrame, names: DataFrame) -> DataFrame:
    """Of each session the 14 agents of most cost and the 14 of most output, zero left out: (session_id, by, position, agent_id, name, value)."""
    sums = priced.groupBy("session_id", "agent_id").agg(F.sum("cost").alias("cost"), F.sum("priced_tokens").alias("priced"), F.sum("tokens_out").cast("double").alias("output"))
    cost = F.struct(F.lit("cost").alias("by"), F.when(F.col("priced") > 0, F.round("cost", 10)).alias("value"))
    rows = sums.select("session_id", "agent_id", F.explode(F.array(cost, F.struct(F.lit("output").alias("by"), F.col("output").alias("value")))).alias("x"))
    rows = rows.select("session_id", "agent_id", "x.by", "x.value").where("value > 0")
    order = Window.partitionBy("session_id", "by").orderBy(F.desc("value"), "agent_id")
    best = rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= TOP_FLOW)
    return best.join(names.select("session_id", "agent_id", "name"), ["session_id", "agent_id"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def comparison_totals(cat: DataFrame, comparisons: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals of a catalog at compared rates; a comparison counts only for its session's projection, priced up to the source's indexed offset."""
    now = sources.select("source_id", "generation", "indexed_offset")
    rows = cat.join(now, ["source_id", "generation"], "left")
    own = comparisons.select(F.col("session_id").alias("id"), "generation", "revision", "indexed_offset", F.col("priced_tokens").alias("c_priced"), F.col("unattributed_tokens").alias("c_unattributed"), F.col("cost").alias("c_cost"))
    out = rows.join(own, ["id", "generation", "revision", "indexed_offset"], "left").agg(
        F.count("*").alias("sessions"), F.count("c_priced").alias("sessions_with_comparison"), _long(all_tokens()).alias("recorded_tokens"), _long("c_priced").alias("priced_tokens"),
        _long("c_unattributed").alias("unattributed_tokens"), F.round(F.sum(F.when(F.col("c_priced") > 0, F.col("c_cost"))), 4).alias("cost_estimate"),
    )
    return out.withColumn("unpriced_tokens", F.col("recorded_tokens") - F.col("priced_tokens"))


def model_breakdown(usage: DataFrame) -> DataFrame:
    """Models of each session: tier, agents, cost and output, and the session's share of cost on the top tiers (null without money)."""
    rows = usage.where("agent_id <> '' AND model <> ''").groupBy("session_id", "model").agg(
        F.countDistinct("agent_id").alias("agents"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.sum("tokens_out").cast("long").alias("tokens_out"),
    ).withColumn("tier", model_tier(F.col("model")))
    # A window over the few models of a session; a join with its sums would work out the rows twice.
    own = Window.partitionBy("session_id")
    rows = rows.withColumns({"all": F.sum("cost").over(own), "top": F.sum(F.when(F.col("tier").isin(*TOP_TIERS), F.col("cost")).otherwise(0.0)).over(own)})
    share = F.when(F.col("all") > 0, F.round(F.col("top") / F.col("all"), 3))
    return rows.select("session_id", "model", "tier", "agents", money("cost").alias("cost"), "tokens_out", share.alias("top_tier_share"))


def tier_mix(usage: DataFrame) -> DataFrame:
    """Cost of each session by tier, a column each."""
    tier = model_tier(F.col("model"))
    tiers = ("flagship", "premium", "mid", "cheap", "unknown")
    rows = usage.where("agent_id <> '' AND model <> ''")
    return rows.groupBy("session_id").agg(*[money(F.coalesce(F.sum(F.when(tier == t, F.col("cost"))), F.lit(0.0))).alias(t) for t in tiers])


def session_summaries(cat: DataFrame, agents: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """What a fleet list shows of a session: title, machine, agents, errors, tokens, cost, top-tier share, and whether it was active in ten minutes."""
    per = agents.groupBy("session_id").agg(F.count("*").alias("agents"), F.sum("errors").cast("long").alias("errors"), F.max("last_at").alias("last_at"))
    spent = usage.where("agent_id <> '' AND model <> ''").groupBy("session_id").agg(F.sum("cost").alias("cost"), F.sum(F.when(model_tier(F.col("model")).isin(*TOP_TIERS), F.col("cost")).otherwise(0.0)).alias("top"))
    rows = cat.withColumn("session_id", F.col("id")).drop("cost").join(per, "session_id", "left").join(spent, "session_id", "left")
    recent = F.coalesce((F.col("last_at") > now - F.expr("INTERVAL 10 MINUTES")) & (F.col("last_at") <= now), F.lit(False))
    return rows.select(
        "id", "title", "machine_id", "project", F.coalesce("agents", F.lit(0)).alias("agents"), F.coalesce("errors", F.lit(0)).alias("errors"), "tokens_in", "tokens_out",
        money("cost").alias("cost"), F.when(F.col("cost") > 0, F.round(F.col("top") / F.col("cost"), 3)).alias("top_tier_share"), recent.alias("active"),
    )


def usage_bars(cat: DataFrame, by: str, metric: str = "cost") -> DataFrame:
    """Sums of a metric by day, week, month or year of last activity and by provider; weeks are counted from January 1 and begin on Sunday."""
    at = F.col("last_activity")
    january = F.date_trunc("year", at)
    days = F.unix_micros(at.cast("timestamp")) - F.unix_micros(january.cast("timestamp"))
    week = F.ceil((days / 86_400_000_000 + F.dayofweek(january)) / 7)
    key = {
        "day": F.date_format(at, "yyyy-MM-dd"), "month": F.date_format(at, "yyyy-MM"), "year": F.date_format(at, "yyyy"),
        "week": F.concat(F.date_format(at, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0")),
    }[by]
    value = {"cost": F.round(F.sum(F.coalesce("cost_estimate", F.lit(0.0))), 4), "tokens": F.sum(F.col("tokens_in") + F.col("tokens_out")).cast("double"), "sessions": F.count("*").cast("double")}[metric]
    return cat.where(at.isNotNull()).groupBy(key.alias("bucket"), "provider").agg(value.alias("value"), F.count("*").alias("sessions"))


def agent_rollup(parsed: DataFrame, discovered: DataFrame, now: Column) -> DataFrame:
    """Agents of each machine: parsed from logs, discovered in sources, and active in the last ten minutes."""
    active = F.coalesce((F.col("last_at") > now - F.expr("INTERVAL 10 MINUTES")) & (F.col("last_at") <= now), F.lit(False))
    rows = parsed.groupBy("machine_id").agg(F.count("*").alias("parsed"), F.count_if(active).alias("active"))
    return rows.join(discovered.groupBy("machine_id").agg(F.count("*").alias("discovered")), "machine_id", "full_outer").fillna(0, ["parsed", "active", "discovered"])


def fleet_cards(live: DataFrame, history: DataFrame) -> DataFrame:
    """Machines that are live or known from the catalog: a live heartbeat's values win, and history alone is kept."""
    l, h = live.withColumn("is_live", F.lit(True)), history.withColumnsRenamed({"sessions": "h_sessions", "latest": "h_latest"})
    out = l.join(h, "machine_id", "full_outer")
    return out.select("machine_id", F.coalesce("is_live", F.lit(False)).alias("live"), F.coalesce("sessions", "h_sessions").alias("sessions"), F.coalesce("last_seen", "h_latest").alias("last_seen"))
