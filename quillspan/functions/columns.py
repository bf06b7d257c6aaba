"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = ("tokens_in", "tokens_cache", "tokens_write", "tokens_out")


def all_tokens() -> Column:
    return F.col("tokens_in") + F.col("tokens_cache") + F.col("tokens_write") + F.col("tokens_out")


def effective_project() -> Column:
    """The owner's assignment where it overrides, else the first name that is not empty."""
    own = F.coalesce("project", F.lit(""))
    return F.when(F.coalesce("project_override", F.lit(False)), own).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.coalesce("own_project", F.lit(""))))


def effective_title() -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("title"))


def coverage_state(recorded: Column, awaiting: Column, priced: Column, unattributed: Column) -> Column:
    """One of the five states of pricing coverage."""
    return (
        F.when(recorded == 0, "no-recorded-usage")
        .when(awaiting > 0, "pending-pricing")
        .when(recorded > priced, "partially-priced")
        .when(unattributed > 0, "priced-with-incomplete-attribution")
        .otherwise("all-recorded-usage-priced")
    )


def flow_tool(name: Column) -> Column:
    """A tool's name without the prefix of its server."""
    n = F.coalesce(name, F.lit(""))
    return F.when((n == "") | (F.octet_length(n) > 4096), "(unattributed tool)").otherwise(F.regexp_replace(n, r"^mcp__[^_]+__", ""))


def flow_role(name: Column) -> Column:
    """A helper's role: its name without a running number and long identifiers, 30 characters at most."""
    n = F.coalesce(name, F.lit(""))
    role = F.regexp_replace(F.regexp_replace(n, r"\s*#\d+$", ""), r"[0-9a-f-]{12,}", "·")
    return F.when(n == "", "Unnamed helper identity").otherwise(F.substring(role, 1, 30))


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts, each after its length in bytes."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p, F.lit(","))]), 256)


#: Fixed name patterns of model tiers; the first that matches counts.
TIER_PATTERNS = (
    ("mini|nano|flash|haiku|lite", "cheap"),
    ("fable|mythos", "flagship"),
    ("sonnet|codex|gpt-4", "mid"),
    ("opus|gpt-5|o3|o1", "premium"),
    ("gpt-3", "cheap"),
)
#: Fixed prices by a part of the model's name, USD per million tokens in and out; the first that matches counts.
NAME_PRICES = (
    ("fable", 10.0, 50.0),
    ("mythos", 10.0, 50.0),
    ("opus", 5.0, 25.0),
    ("sonnet", 3.0, 15.0),
    ("haiku", 1.0, 5.0),
    ("gpt-5", 1.25, 10.0),
    ("gpt-4", 2.5, 10.0),
    ("o3", 2.0, 8.0),
    ("o4", 1.1, 4.4),
)


def model_tier(model: Column) -> Column:
    m, tier = F.lower(F.coalesce(model, F.lit(""))), F
    for pattern, name in TIER_PATTERNS:
        tier = tier.when(m.rlike(pattern), name)
    return tier.otherwise("unknown")


#: The two tiers that make most of a bill.
TOP_TIERS = ("flagship", "premium")


def top_tier(model: Column) -> Column:
    return model_tier(model).isin(*TOP_TIERS)


def name_prices(model: Column) -> tuple[Column, Column]:
    """Input and output price by the name table; null for an unknown model."""
    m, both = F.coalesce(model, F.lit("")), (F, F)
    for part, *prices in NAME_PRICES:
        both = tuple(x.when(m.contains(part), p) for x, p in zip(both, prices))
    return tuple(x.otherwise(F.lit(None).cast("double")) for x in both)


def name_cost(model: Column) -> Column:
    """Cost by the name table: cache reads at 0.1 and cache writes at 1.25 of the input price; null for an unknown model."""
    price_in, price_out = name_prices(model)
    fresh = F.col("tokens_in") + F.col("tokens_cache") * 0.1 + F.col("tokens_write") * 1.25
    return (fresh * price_in + F.col("tokens_out") * price_out) / 1e6


def money(amount: Column | str, digits: int = 4) -> Column:
    """A sum of dollars rounded half up as a decimal number, so that the noise of sums decides no cent."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.round(amount.cast("decimal(30,8)"), digits).cast("double")


def monday(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, each instant cut to milliseconds first."""
    at = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / 1000)
    return (at(end) - at(start)).cast("long")


def json_flag(json: Column, path: str) -> Column:
    """A field that is JSON true or false; null where it is missing, null, or of another type such as the text "true"."""
    v = F.try_parse_json(json)
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def json_type(json: Column, path: str) -> Column:
    """The type of a field as VARIANT names it; null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def utc_text(text: Column) -> Column:
    """A time with its offset as text of fixed width in UTC, to the microsecond; '' where it is none, or the year 1 that stands for none."""
    whole = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$")
    at = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    shown = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.coalesce(F.when(whole & (F.year(at) > 1), shown), F.lit(""))


def preview(text: Column, most: int = 500) -> Column:
    """The start of a text, with a mark where more follows."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
