"""Calendar, rhythm and ring views in civil time.

Bounds of civil days come from the zone's own rules on the driver: one row a day, 400 at most.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.columns import all_tokens

MOST_DAYS = 400


def civil_days(spark: SparkSession, start: dt.date, end: dt.date, tz: str = "UTC") -> DataFrame:
    """day, from_at, to_at (UTC) of each civil day from start to end, both included; the first midnight counts."""
    n = (end - start).days + 1
    if not 1 <= n <= MOST_DAYS:
        raise ValueError(f"between 1 and {MOST_DAYS} days")
    zone = ZoneInfo(tz)
    at = lambda d: dt.datetime.combine(d, dt.time(), zone).astimezone(dt.timezone.utc).replace(tzinfo=None)
    rows = [(d, at(d), at(d + dt.timedelta(days=1))) for d in (start + dt.timedelta(days=i) for i in range(n))]
    return spark.createDataFrame(rows, "day date, from_at timestamp_ntz, to_at timestamp_ntz")


def _on_day(cat: DataFrame, days: DataFrame, tz: str) -> DataFrame:
    """Sessions with the civil day of their last activity: an equi-join on the local date instead of a range join."""
    local = F.to_date(F.from_utc_timestamp(F.col("last_activity").cast("timestamp"), tz))
    return cat.where("last_activity IS NOT NULL").withColumn("day", local).join(days.select("day"), "day", "left_semi")


def session_health(events: DataFrame) -> DataFrame:
    """errors, unknown results and agents of each session."""
    result = F.col("kind") == "tool-result"
    return events.groupBy("session_id").agg(
        F.count_if(F.coalesce("error", F.lit(False))).alias("errors"), F.count_if(result & F.col("error").isNull() | (F.col("kind") == "indexing-error")).alias("incomplete"),
        F.countDistinct(F.nullif(F.col("agent_id"), F.lit(""))).alias("agents"), F.min("ts").alias("first_at"),
    )


def session_tiers(priced: DataFrame) -> DataFrame:
    """Per session: priced tokens of a known tier, their cost, and the cost of the two top tiers (null where nothing is classified)."""
    known, top = F.col("tier").isin("flagship", "premium", "mid", "cheap"), F.col("tier").isin("flagship", "premium")
    out = priced.where(F.col("rate_id").isNotNull()).groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(known, F.col("priced_tokens"))), F.lit(0)).cast("long").alias("tier_tokens"), F.sum(F.when(known, F.col("cost"))).alias("classified_cost"), F.sum(F.when(top, F.col("cost")).when(known, 0.0)).alias("top_cost"),
    )
    return out.withColumnRenamed("session_id", "id")


def calendar(cat: DataFrame, health: DataFrame, days: DataFrame, tz: str = "UTC", tiers: DataFrame | None = None) -> DataFrame:
    """One row a civil day, empty ones too; a session counts once, on the day of its last activity. With session_tiers() also top-tier cost."""
    rows = _on_day(cat, days, tz).join(health.withColumnRenamed("session_id", "id"), "id", "left")
    if tiers is not None:
        rows = rows.join(tiers, "id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = rows.groupBy("day").agg(
        F.count("*").alias("sessions"), F.round(F.sum("cost_estimate"), 2).alias("cost"), F.count("cost_estimate").alias("with_cost"), zero(all_tokens()).alias("tokens"), zero("priced_tokens").alias("priced_tokens"),
        zero("errors").alias("errors"), zero("incomplete").alias("incomplete"), zero("agents").alias("agents"), *([F.round(F.sum("top_cost"), 4).alias("top_cost"), zero("tier_tokens").alias("tier_tokens")] if tiers is not None else []),
    )
    counts = ["sessions", "with_cost", "tokens", "priced_tokens", "errors", "incomplete", "agents", *(["tier_tokens"] if tiers is not None else [])]
    return days.select("day").join(found, "day", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def rhythm(cat: DataFrame, health: DataFrame, first_usage: DataFrame, tz: str = "UTC", start: Column | None = None, end: Column | None = None, tiers: DataFrame | None = None) -> DataFrame:
    """24 hours and 7 weekdays (Monday 0) of when sessions start: the earliest dated event or usage.

    Sessions without a date have the kind undated, those that start outside of the range (half open) the kind outside."""
    rows = cat.join(health.withColumnRenamed("session_id", "id"), "id", "left").join(first_usage.withColumnRenamed("session_id", "id"), "id", "left")
    if tiers is not None:
        rows = rows.join(tiers, "id", "left")
    at = F.least("first_at", "first_usage")
    beyond = F.lit(False)
    beyond = beyond | (at < start) if start is not None else beyond
    beyond = beyond | (at >= end) if end is not None else beyond
    rows = rows.withColumns({"beyond": beyond, "start": F.from_utc_timestamp(at.cast("timestamp"), tz)})
    slot = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.alias("slot"))
    slots = F.when(F.col("start").isNull(), F.array(slot("undated", F.lit(0)))).when(F.col("beyond"), F.array(slot("outside", F.lit(0)))).otherwise(F.array(slot("hour", F.hour("start")), slot("weekday", F.weekday("start"))))
    rows = rows.withColumn("b", F.explode(slots))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = rows.groupBy("b.kind", "b.slot").agg(
        F.count("*").alias("sessions"), F.count_if(F.coalesce("errors", F.lit(0)) > 0).alias("with_errors"), F.count_if(F.coalesce("incomplete", F.lit(0)) > 0).alias("with_incomplete"), zero(all_tokens()).alias("tokens"),
        *([zero("tier_tokens").alias("tier_tokens"), F.round(F.sum("classified_cost"), 4).alias("classified_cost"), F.round(F.sum("top_cost"), 4).alias("top_cost")] if tiers is not None else []),
    )
    spark = cat.sparkSession
    spine = spark.range(24).selectExpr("'hour' AS kind", "CAST(id AS INT) AS slot").union(spark.range(7).selectExpr("'weekday'", "CAST(id AS INT)")).union(spark.range(2).selectExpr("CASE id WHEN 0 THEN 'undated' ELSE 'outside' END", "0"))
    counts = ["sessions", "with_errors", "with_incomplete", "tokens", *(["tier_tokens"] if tiers is not None else [])]
    return spine.join(found, ["kind", "slot"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def overnight(rhythm_rows: DataFrame) -> DataFrame:
    """Error shares of starts from 0 to 6 against the rest; a verdict needs 15 sessions a side, whole evidence and a gap
    above 10 points and twice the larger standard error."""
    side = lambda night: (F.col("slot") < 6) if night else (F.col("slot") >= 6)
    hours = rhythm_rows.where("kind = 'hour'")
    total = lambda c, night: F.coalesce(F.sum(F.when(side(night), F.col(c))), F.lit(0))
    names = {"n": "sessions", "e": "with_errors", "i": "with_incomplete"}
    out = hours.agg(*[total(c, night).cast("long").alias(f"{'night' if night else 'day'}_{k}") for k, c in names.items() for night in (True, False)])
    rate = lambda s: F.when(F.col(f"{s}_n") > 0, 100 * F.col(f"{s}_e") / F.col(f"{s}_n"))
    out = out.withColumns({"night_rate": rate("night"), "day_rate": rate("day")})
    se = lambda s: F.sqrt(F.col(f"{s}_rate") / 100 * (1 - F.col(f"{s}_rate") / 100) / F.col(f"{s}_n"))
    close = F.abs(F.col("night_rate") - F.col("day_rate")) <= F.greatest(F.lit(10.0), 200 * F.greatest(se("night"), se("day")))
    verdict = (
        F.when((F.col("night_n") < 15) | (F.col("day_n") < 15), "not-enough-sessions")
        .when((F.col("night_i") > 0) | (F.col("day_i") > 0), "incomplete-evidence")
        .when(close, "too-close")
        .when(F.col("night_rate") > F.col("day_rate"), "night-higher")
        .otherwise("night-lower")
    )
    return out.withColumn("verdict", verdict).withColumns({k: F.round(k, 4) for k in ("night_rate", "day_rate")})


def rhythm_metric(rows: DataFrame, metric: str = "trouble") -> DataFrame:
    """The rate of each slot and whether it may be judged: three sessions and whole evidence.

    trouble: sessions with errors, colours at 10 and 30. topTier: the top tiers' share of classified cost where all recorded tokens are
    classified, colours at 33 and 66; it needs rhythm() with tiers."""
    if metric == "topTier":
        rate, whole, low, high = F.when(F.col("classified_cost") > 0, F.floor(100 * F.col("top_cost") / F.col("classified_cost") + 0.5).cast("long")), (F.col("tokens") > 0) & (F.col("tier_tokens") == F.col("tokens")), 33, 66
    else:
        rate, whole, low, high = F.when(F.col("sessions") > 0, F.floor(100 * F.col("with_errors") / F.col("sessions") + 0.5).cast("long")), F.col("with_incomplete") == 0, 10, 30
    judged = (F.col("sessions") >= 3) & whole & rate.isNotNull()
    level = F.when(F.col("sessions") == 0, "none").when(~judged, "dim").when(rate > high, "red").when(rate >= low, "amber").otherwise("green")
    return rows.select("kind", "slot", rate.alias("rate"), judged.alias("judged"), level.alias("level"))


def rings(cat: DataFrame, health: DataFrame, weeks: int = 10, tz: str = "UTC", project: str | None = None) -> DataFrame:
    """The last weeks (from the zone's Monday) up to the latest activity and from the earliest on, without archived sessions; empty weeks too."""
    live = cat.where(~F.col("archived") & F.col("last_activity").isNotNull())
    live = live.where(F.col("project") == project) if project is not None else live
    live = live.withColumn("week", F.to_date(F.date_trunc("week", F.from_utc_timestamp(F.col("last_activity").cast("timestamp"), tz))))
    ends = live.agg(F.max("week").alias("last"), F.min("week").alias("first")).where("last IS NOT NULL")
    spine = ends.select(F.explode(F.expr(f"sequence(greatest(first, date_sub(last, {7 * (weeks - 1)})), last, INTERVAL 7 DAYS)")).alias("week"))
    rows = live.join(F.broadcast(spine), "week", "left_semi").join(health.withColumnRenamed("session_id", "id"), "id", "left")
    found = rows.groupBy("week").agg(
        F.count("*").alias("sessions"), F.count_if(F.coalesce("errors", F.lit(0)) > 0).alias("with_errors"), F.coalesce(F.sum(all_tokens()), F.lit(0)).cast("long").alias("tokens"), F.round(F.sum("cost_estimate"), 2).alias("cost"),
    )
    return spine.join(found, "week", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sessions", "with_errors", "tokens")})


def busiest_day(days: DataFrame) -> DataFrame:
    """The day with most sessions, the earliest of equals, and the totals of the range."""
    return days.agg(F.max_by("day", F.struct(F.col("sessions"), -F.unix_date("day"))).alias("day"), F.max("sessions").alias("sessions"), F.sum("sessions").alias("total"), F.count_if(F.col("sessions") > 0).alias("active_days"))


def bucket_metric(cat: DataFrame, health: DataFrame, bucket: Column, least: int = 3) -> DataFrame:
    """Percent of sessions with errors in each bucket; null under the least number of sessions."""
    rows = cat.join(health.withColumnRenamed("session_id", "id"), "id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("errors", F.lit(0)) > 0).alias("bad"))
    return rows.withColumn("trouble_pct", F.when(F.col("n") >= least, F.round(100 * F.col("bad") / F.col("n"), 4)))


def top_tier_metric(mixes: DataFrame, bucket: Column, least: int = 3) -> DataFrame:
    """Percent of each bucket's cost on the top tiers over sessions with their tier_mix(); judged from the least number of sessions on, null without cost."""
    total = sum((F.col(t) for t in ("premium", "mid", "cheap", "unknown")), F.col("flagship"))
    rows = mixes.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(total).alias("total"), F.sum(F.col("flagship") + F.col("premium")).alias("top"))
    rate = F.when(F.col("total") > 0, F.least(F.lit(100.0), F.round(100 * F.col("top") / F.col("total"))))
    return rows.select("bucket", "n", rate.alias("rate"), ((F.col("n") >= least) & rate.isNotNull()).alias("judged"))
