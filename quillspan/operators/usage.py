"""Token usage: pricing, grouping, merging of revisions, duplicates and baselines.

Missing is not zero: a cost or status that the evidence does not give stays null and is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import TOKENS, all_tokens, coverage_state, monday
from quillspan.functions.storage import settle
from quillspan.functions.strict import listed_fields
from quillspan.functions.workers import ship

PROJECTION = ["source_id", "generation", "revision"]
NEVER_PRICED = ("incomplete-attribution", "message-partial")
UNATTRIBUTED = ("incomplete-attribution", "message-partial", "message-without-id")
#: Rates are a table written by hand; past this size the join is left to Spark's own choice.
BROADCAST_RATES = 100_000


def current(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """The facts of each session's current projection: all four keys agree."""
    keys = sessions.select(F.col("id").alias("session_id"), *PROJECTION)
    return facts.join(keys, ["session_id", *PROJECTION], "left_semi")


def price(usage: DataFrame, rates: DataFrame, context: str = "standard", at: Column | None = None) -> DataFrame:
    """usage with rate_id, tier, four cost lanes, cost and priced_tokens.

    A rate counts where context and model agree and effective_from <= time < effective_to. Two rates that match
    give no price, and partial or unattributed observations are never priced."""
    at = F.col("ts") if at is None else at
    r = rates.where(F.col("context") == context).select("rate_id", F.col("model").alias("rate_model"), "tier", "effective_from", "effective_to", "input", "cache_read", "cache_write", "output")
    few = rates.count() <= BROADCAST_RATES
    keyed = usage.withColumn("_at", at)
    holds = (F.col("model") == F.col("rate_model")) & (F.col("_at") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("_at") < F.col("effective_to")))
    # One rate for each model and interval: the intervals where more than one holds are cut out beforehand.
    matched = keyed.join(F.broadcast(_unambiguous(r)) if few else _unambiguous(r), holds, "left")
    ok = F.col("rate_id").isNotNull() & ~F.col("kind").isin(*NEVER_PRICED)
    lanes = {"cost_input": ("tokens_in", "input"), "cost_cache_read": ("tokens_cache", "cache_read"), "cost_cache_write": ("tokens_write", "cache_write"), "cost_output": ("tokens_out", "output")}
    out = matched.withColumns({k: F.when(ok, F.col(t) * F.col(p) / 1e6) for k, (t, p) in lanes.items()})
    out = out.withColumn("cost", F.col("cost_input") + F.col("cost_cache_read") + F.col("cost_cache_write") + F.col("cost_output"))
    out = out.withColumn("priced_tokens", F.when(ok, all_tokens()).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("unattributed_tokens", F.when((F.col("model") == "") | F.col("kind").isin(*UNATTRIBUTED), all_tokens()).otherwise(F.lit(0)).cast("long"))
    keep = [*usage.columns, *lanes, "cost", "priced_tokens", "unattributed_tokens"]
    return out.select(*keep, F.when(ok, F.col("rate_id")).alias("rate_id"), F.when(ok, F.col("tier")).alias("tier"))


def _unambiguous(rates: DataFrame) -> DataFrame:
    """The rates cut at every boundary of their model, without the pieces on which two hold."""
    w = Window.partitionBy("rate_model").orderBy("b")
    bounds = rates.select("rate_model", F.col("effective_from").alias("b")).union(rates.select("rate_model", F.col("effective_to").alias("b")).where("b IS NOT NULL")).distinct()
    pieces = bounds.select("rate_model", F.col("b").alias("p_from"), F.lead("b").over(w).alias("p_to"))
    inside = (F.col("p_from") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("p_from") < F.col("effective_to")))
    cut = pieces.join(rates, "rate_model").where(inside)
    lonely = cut.withColumn("_n", F.count("*").over(Window.partitionBy("rate_model", "p_from"))).where("_n = 1")
    return lonely.drop("_n", "effective_from", "effective_to").withColumnsRenamed({"p_from": "effective_from", "p_to": "effective_to"})


def sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names]


def session_totals(priced: DataFrame, *more: str) -> DataFrame:
    """Tokens, price and coverage of each session, or of each of its projections where more names their keys."""
    return priced.groupBy("session_id", *more).agg(
        *sums(*TOKENS, "priced_tokens", "unattributed_tokens"), F.sum("cost").alias("cost_estimate"),
        *[F.sum(c).alias(c) for c in ("cost_input", "cost_cache_read", "cost_cache_write", "cost_output")], F.count("*").alias("observations"),
    )


def dimension(name: str, child_provider: str = "claude") -> Column:
    """The key of a grouping dimension over sessions with their usage, null without it."""
    return {
        "project": F.col("project"),
        "machine": F.col("machine_id"),
        "provider": F.col("provider"),
        "model": F.col("model"),
        "day": F.date_format("ts", "yyyy-MM-dd"),
        "week": F.date_format(monday(F.col("ts")), "yyyy-MM-dd"),
        "month": F.date_format("ts", "yyyy-MM"),
        "year": F.date_format("ts", "yyyy"),
        "agentKind": F.when(F.coalesce("agent_id", F.lit("")) == "", "unattributed")
        .when((F.col("provider") == child_provider) & (F.col("agent_id") == F.col("native_agent_id")) & (F.col("native_agent_id") != ""), "child-agent")
        .when((F.col("agent_id") == "main") & (F.col("parent_native_id") != ""), "child-thread")
        .when(F.col("agent_id") == "main", "main")
        .otherwise("unclassified"),
    }[name]


def grouped_usage(priced: DataFrame, sessions: DataFrame, by: str, child_provider: str = "claude", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Sessions and their usage by one of nine dimensions with its pricing coverage; key '' is unknown.

    Sessions without usage count too, unless a time range (half open) asks for usage in it. priced may hold superseded rows: only
    those of a session's current projection join it."""
    keys = ["session_id", *PROJECTION]
    own = sessions.select(F.col("id").alias("session_id"), *PROJECTION, "project", "machine_id", "provider", "native_agent_id", "parent_native_id")
    joined = own.join(priced.select("id", *keys, "agent_id", "model", "kind", "ts", *TOKENS, "priced_tokens", "cost"), keys, "left")
    if start is not None:
        joined = joined.where(F.col("ts") >= start)
    if end is not None:
        joined = joined.where(F.col("ts") < end)
    nameless = F.when((F.col("model") == "") | (F.col("kind") == "incomplete-attribution"), all_tokens()).otherwise(0)
    out = joined.withColumn("unattributed_tokens", nameless).groupBy(F.coalesce(dimension(by, child_provider), F.lit("")).alias("key")).agg(
        F.countDistinct("session_id").alias("sessions"), F.count("id").alias("observations"), *sums(*TOKENS, "priced_tokens", "unattributed_tokens"),
        F.round(F.sum("cost"), 4).alias("cost"),
    )
    state = coverage_state(all_tokens(), F.lit(0), F.col("priced_tokens"), F.col("unattributed_tokens"))
    return out.withColumn("coverage", state)


def groups_after(groups: DataFrame, after: str, limit: int = 100) -> DataFrame:
    """A page of groups by key, those beyond the last key seen."""
    return groups.where(F.col("key") > after).orderBy("key").limit(limit)


def session_models(usage: DataFrame) -> DataFrame:
    """Per session and model: agents, observations, buckets, and whether the model is known."""
    out = usage.groupBy("session_id", "model").agg(F.countDistinct("agent_id").alias("agents"), F.count("*").alias("observations"), *sums(*TOKENS))
    return out.withColumn("attributed", F.col("model") != "")


def first_report(usage: DataFrame) -> DataFrame:
    """Each provider message once, its first report counting: the order is time, then id."""
    w = Window.partitionBy("session_id", "agent_id", "message_id").orderBy(F.col("ts").asc_nulls_last(), "id")
    return usage.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_reports(usage: DataFrame) -> DataFrame:
    """Each provider message once, later reports merged in: of each field the last value among reports that have it in present.

    A zero that is present counts as a value; a field that no report has keeps zero, or '' for the model. The kind is message-final once
    all five fields are known and the model is named."""
    key = ["session_id", "agent_id", "message_id"]
    at = F.struct(F.coalesce("ts", F.lit("0001-01-01").cast("timestamp_ntz")), "id")
    has = {t: F.array_contains("present", t) for t in (*TOKENS, "model")}
    aggs = [F.max_by(F.when(h, F.col(t)), F.when(h, at)).alias(t) for t, h in has.items()]
    known = [F.bool_or(h).alias(f"_{t}") for t, h in has.items()]
    out = usage.groupBy(*key).agg(*aggs, *known, F.count("*").alias("reports"), F.max("ts").alias("ts"), F.bool_and(F.col("kind") == "message-without-id").alias("_no_id"))
    whole = F.col("model") != ""
    for t in has:
        whole = whole & F.col(f"_{t}")
    kind = F.when(F.col("_no_id"), "message-without-id").when(whole, "message-final").otherwise("message-partial")
    return out.withColumn("kind", kind).withColumns({t: F.coalesce(t, F.lit(0)).cast("long") for t in TOKENS}).withColumn("model", F.coalesce("model", F.lit(""))).drop("_no_id", *[f"_{t}" for t in has])


COUNTED = ("incomplete-attribution", "cumulative-delta", "reported-last-call")


_COUNTS = "input:string,cache:string,cacheWrite:string,output:string"


def counted(usage: DataFrame, sessions: DataFrame, provider: str = "codex") -> DataFrame:
    """Observations from cumulative counters whose evidence is whole, with their session's identity, the evidence without its offset (same), and its counters c and previous p.

    Those of the main agent in its thread's own scope, of a known time, with tokens and without a presence mask; a model is named
    exactly where the kind says that it is known."""
    s = sessions.where(F.col("provider") == provider).select(F.col("id").alias("session_id"), "machine_id", "provider", "native_id", "source_id", "forked_from_id")
    named = (F.col("model") != "") == (F.col("kind") != "incomplete-attribution")
    keep = (F.col("agent_id") == "main") & F.col("ts").isNotNull() & (all_tokens() > 0) & (F.size("present") == 0) & F.col("kind").isin(*COUNTED) & named
    rows = usage.drop("source_id").where(keep).join(s, "session_id").where(F.col("counter_scope") == F.concat(F.lit("thread:"), "native_id"))
    e = F.from_json("evidence", f"offset string, counter struct<{_COUNTS}>, previousCounter struct<{_COUNTS}>")
    fields = F.map_filter(F.from_json("evidence", "map<string,string>"), lambda k, _: k != "offset")
    numbers = lambda c: F.struct(*[F.coalesce(F.col(f"e.{c}.{n}").try_cast("long"), F.lit(0)).alias(n) for n in ("input", "cache", "cacheWrite", "output")])
    # As a generated column the evidence is read once a row; as a projected one it is read again in every filter, and before the joins.
    rows = rows.withColumn("e", F.explode(F.array(e))).where((F.col("e.offset").try_cast("long") >= 0) & F.col("e.previousCounter").isNotNull() & (F.col("e.counter.output").try_cast("long") >= 0))
    return rows.withColumns({"same": F.to_json(F.sort_array(F.map_entries(fields))), "offset": F.col("e.offset").try_cast("long"), "c": numbers("counter"), "p": numbers("previousCounter")}).drop("e")


def _value_key(*columns: str) -> Column:
    """128 bits that stand for the values of some columns."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def duplicate_usage(usage: DataFrame, sessions: DataFrame, provider: str = "codex") -> DataFrame:
    """Counter observations that another source of the same thread and machine repeats in every value.

    One row for each with a twin: the twin's session where there is exactly one, the owner (the smaller session)
    and the state: matched, or ambiguous from three on. Evidence is read in threads that several sources hold; values meet by 128
    bits of them, worked out once, and only narrow rows are shuffled."""
    value = ("machine_id", "native_id", "ts", "model", "kind", *TOKENS, "same")
    thread = sessions.where(F.col("provider") == provider).groupBy(F.col("machine_id").alias("m"), F.col("native_id").alias("n"))
    several = thread.agg(F.min("id").alias("i1"), F.max("id").alias("i2"), F.min("source_id").alias("s1"), F.max("source_id").alias("s2")).where("i1 < i2 AND s1 < s2")
    held = sessions.join(several, F.col("machine_id").eqNullSafe(F.col("m")) & (F.col("native_id") == F.col("n")), "left_semi")
    rows = settle(counted(usage, held, provider).select("id", "session_id", "source_id", _value_key(*value).alias("v")), "counters")
    groups = rows.groupBy("v").agg(
        F.count("*").alias("candidates"), F.min("session_id").alias("owner"), F.max("session_id").alias("other"), F.min("source_id").alias("s1"), F.max("source_id").alias("s2"),
    ).where("owner < other AND s1 < s2").drop("s1", "s2")
    out = rows.join(groups, "v")
    twin = F.when(F.col("candidates") == 2, F.when(F.col("session_id") == F.col("owner"), F.col("other")).otherwise(F.col("owner")))
    return out.select("id", "session_id", "owner", twin.alias("twin_session"), F.when(twin.isNotNull(), "matched").otherwise("ambiguous").alias("state"))


def fork_baselines(usage: DataFrame, sessions: DataFrame, provider: str = "codex", sources: DataFrame | None = None) -> DataFrame:
    """Forked threads whose first counter is a counter of the thread that they were forked from: (session_id, parent_session, parent_id, tokens, state).

    A child's first counter stands in one or two observations of like evidence, an unattributed and a last call, whose previous
    counter is zero in every part: summed up they must be the whole counter. Where sources (source_id, indexed_offset) are
    given, both sides must lie inside what was published of their source. No match means unverified, never independent. Evidence is
    read in forks and in the threads that they name."""
    forks = sessions.where((F.col("forked_from_id") != "") & (F.col("forked_from_id") != F.col("native_id")))
    origins = forks.where(F.col("provider") == provider).select("machine_id", F.col("forked_from_id").alias("native_id")).distinct()

    def published(threads: DataFrame) -> DataFrame:
        rows = counted(usage, threads, provider)
        return rows if sources is None else rows.join(sources.select("source_id", "indexed_offset"), "source_id").where("offset < indexed_offset")

    names = ("input", "cache", "cacheWrite", "output")
    zero = F.lit(True)
    for n in names:
        zero = zero & (F.col(f"p.{n}") == 0)
    first = published(forks).where(zero & F.col("kind").isin("incomplete-attribution", "reported-last-call")).groupBy("session_id").agg(
        F.first("machine_id").alias("machine_id"), F.first("source_id").alias("source_id"), F.first("forked_from_id").alias("forked_from_id"), F.min("c").alias("c"), F.min("same").alias("least"), F.max("same").alias("most"),
        F.count("*").alias("parts"), F.min("kind").alias("k1"), F.max("kind").alias("k2"), *[F.sum(t).alias(t) for t in TOKENS],
    )
    whole = (F.col("tokens_in") == F.col("c.input") - F.col("c.cache") - F.col("c.cacheWrite")) & (F.col("tokens_cache") == F.col("c.cache")) & (F.col("tokens_write") == F.col("c.cacheWrite")) & (F.col("tokens_out") == F.col("c.output"))
    alike = (F.col("least") == F.col("most")) & ((F.col("parts") == 1) | (F.col("parts") == 2) & (F.col("k1") != F.col("k2")))
    parents = published(sessions.join(origins, ["machine_id", "native_id"], "left_semi")).select("machine_id", F.col("native_id").alias("forked_from_id"), "c", F.col("session_id").alias("parent_session"), F.col("id").alias("parent_id"), F.col("source_id").alias("parent_source"))
    best = first.where(whole & alike).join(parents, ["machine_id", "forked_from_id", "c"]).where("parent_source <> source_id").groupBy("session_id").agg(F.min(F.struct("parent_session", "parent_id", all_tokens().cast("long").alias("tokens"))).alias("m"))
    out = first.select("session_id").join(best, "session_id", "left")
    return out.select("session_id", "m.parent_session", "m.parent_id", "m.tokens", F.when(F.col("m").isNotNull(), "matched").otherwise("unverified").alias("state"))


def select_exclusions(proofs: DataFrame) -> DataFrame:
    """The observations to leave out of counted totals, of proofs (id, owner_id): one owner each, and none whose owner is itself left out."""
    one = proofs.where("id <> owner_id").groupBy("id").agg(F.min("owner_id").alias("owner_id"), F.countDistinct("owner_id").alias("n")).where("n = 1").drop("n")
    return one.join(one.select(F.col("id").alias("owner_id")), "owner_id", "left_anti").select("id", "owner_id")


def contribution_totals(usage: DataFrame, excluded: DataFrame) -> DataFrame:
    """Recorded, excluded and counted tokens: counted = recorded - active exclusions (excluded: id)."""
    flagged = usage.join(excluded.select("id").distinct().withColumn("_x", F.lit(True)), "id", "left")
    tokens = all_tokens()
    out = flagged.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("recorded"), F.coalesce(F.sum(F.when(F.col("_x"), tokens)), F.lit(0)).cast("long").alias("excluded"))
    return out.withColumn("counted", F.col("recorded") - F.col("excluded"))


def tier_split(priced: DataFrame) -> DataFrame:
    """Cost and tokens by the tier of the rate that priced them."""
    rows = priced.where(F.col("rate_id").isNotNull()).groupBy("tier")
    return rows.agg(F.count("*").alias("observations"), F.sum("priced_tokens").cast("long").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def attribution_prices(priced: DataFrame, by: str) -> DataFrame:
    """Price and coverage of each session's agents or models."""
    out = priced.groupBy("session_id", F.col(by).alias("key")).agg(*sums("priced_tokens", "unattributed_tokens"), F.sum(all_tokens()).cast("long").alias("recorded_tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    return out.withColumn("unpriced_tokens", F.col("recorded_tokens") - F.col("priced_tokens"))


def _seconds(at: str) -> Column:
    """Whole seconds of a time on its own clock."""
    return F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def rate_conflicts(rates: DataFrame) -> DataFrame:
    """Pairs of rates of one context and model whose intervals overlap; a valid catalog has none.

    Of two that overlap the later one begins within the other. An interval lies in at most two bins whose width is the least power
    of two above its length, and a beginning is looked up in one bin of each width in use; one without an end is met by all that begin later."""
    own = settle(rates.select("context", "model", "rate_id", "effective_from", "effective_to").where("effective_from IS NOT NULL"), "rates")
    rows = own.withColumns({"s": _seconds("effective_from"), "e": _seconds("effective_to")})
    level = F.when(F.col("e").isNotNull(), F.ceil(F.log2(F.col("e") - F.col("s") + 1)).cast("int")).otherwise(-1)
    held = rows.where("e IS NULL OR e >= s").withColumn("level", level)
    levels = sorted(r.level for r in held.select("level").distinct().collect())  # at most one for each power of two
    place = lambda c: F.expr(f"CASE WHEN level < 0 THEN 0 ELSE CAST(({c} - pmod({c}, shiftleft(1L, level))) DIV shiftleft(1L, level) AS BIGINT) END")
    at = ("context", "model", "level", "bin")
    values = ("rate_id", "effective_from", "effective_to")
    side = lambda df, x: df.select(*at, *[F.col(c).alias(f"{c}_{x}") for c in values])
    a = side(held.withColumn("bin", F.explode(F.sequence(place("s"), F.coalesce(place("e"), F.lit(0))))), "a")
    b = side(rows.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bin", place("s")), "b")
    begins = (F.col("effective_from_b") > F.col("effective_from_a")) | (F.col("effective_from_b") == F.col("effective_from_a")) & (F.col("rate_id_a") < F.col("rate_id_b"))
    within = F.col("effective_to_a").isNull() | (F.col("effective_from_b") < F.col("effective_to_a"))
    lasts = F.col("effective_to_b").isNull() | (F.col("effective_from_a") < F.col("effective_to_b"))
    pairs = a.join(b, list(at)).where(begins & within & lasts & (F.col("rate_id_a") != F.col("rate_id_b")))
    return pairs.select(F.least("rate_id_a", "rate_id_b").alias("left_id"), F.greatest("rate_id_a", "rate_id_b").alias("right_id"), "model")


RATE = "struct<id:string,model:string,aliases:array<string>,context:string,tier:string,source:string,effectiveFrom:timestamp_ntz,effectiveTo:timestamp_ntz,input:double,cacheRead:double,cacheWrite:double,output:double>"


def read_rates(catalogs: DataFrame) -> DataFrame:
    """The rates of catalogs (catalog_id, json): one row for each model and alias of a rate."""
    rows = catalogs.select("catalog_id", F.explode(F.from_json("json", f"struct<rates:array<{RATE}>>")["rates"]).alias("r"))
    names = F.array_distinct(F.concat(F.array("r.model"), F.coalesce("r.aliases", F.array().cast("array<string>"))))
    fields = {"rate_id": "id", "context": "context", "tier": "tier", "source": "source", "effective_from": "effectiveFrom", "effective_to": "effectiveTo", "input": "input", "cache_read": "cacheRead", "cache_write": "cacheWrite", "output": "output"}
    return rows.select("catalog_id", F.explode(names).alias("model"), *[F.col(f"r.{f}").alias(c) for c, f in fields.items()])


#: Fixed names of a rate's fields.
RATE_FIELDS = ("id", "model", "aliases", "context", "effectivefrom", "effectiveto", "source", "tier", "input", "cacheread", "cachewrite", "output")


def rate_field_problems(catalogs: DataFrame) -> DataFrame:
    """(catalog_id, place, problem) of the rates of catalogs (catalog_id, json) that name a field twice, whatever its case, or one that a rate does not have; malformed where a catalog is no list of rates.

    A catalog may lie in several documents; then first says how many of its rates stand before a document."""
    ship(catalogs.sparkSession)
    before = F.col("first") if "first" in catalogs.columns else F.lit(0)
    rows = catalogs.select("catalog_id", before.alias("first"), listed_fields(F.col("json"), "rates").alias("rates"))
    broken = rows.where("rates IS NULL").select("catalog_id", F.lit(-1).alias("place"), F.lit("malformed").alias("problem")).distinct()
    each = rows.select("catalog_id", "first", F.posexplode("rates").alias("at", "names"))
    names = F.transform("names", F.lower)
    twice = F.col("names").isNull() | (F.size(F.array_distinct(names)) < F.size("names"))
    odd = F.exists(names, lambda n: ~n.isin(*RATE_FIELDS))
    found = F.array_compact(F.array(F.when(twice, "repeated-field"), F.when(odd, "unknown-field")))
    return broken.unionByName(each.select("catalog_id", (F.col("first") + F.col("at")).cast("int").alias("place"), F.explode(found).alias("problem")))


def rate_problems(rates: DataFrame) -> DataFrame:
    """(rate_id, problem) of rates that a catalog must not hold; a valid catalog gives no row and no rate_conflicts()."""
    prices = ("input", "cache_read", "cache_write", "output")
    nan = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    checks = {
        "identity": (F.coalesce("rate_id", F.lit("")) == "") | (F.coalesce("model", F.lit("")) == "") | (F.coalesce("context", F.lit("")) == "") | F.col("effective_from").isNull(),
        "tier": ~F.coalesce("tier", F.lit("")).isin("", "unknown", "flagship", "premium", "mid", "cheap"),
        "interval": F.col("effective_to") <= F.col("effective_from"),
        "missing-price": F.greatest(*[F.col(c).isNull().cast("int") for c in prices]) == 1,
        "invalid-price": F.greatest(*[((F.col(c) < 0) | nan(c)).cast("int") for c in prices]) == 1,
    }
    one = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]
    found = rates.select("rate_id", F.explode(F.filter(F.array(*one), lambda x: x.isNotNull())).alias("problem"))
    again = rates.groupBy("rate_id", "model").agg(F.count("*").alias("n")).where("n > 1").select("rate_id", F.lit("duplicate").alias("problem"))
    return found.unionByName(again).distinct()
