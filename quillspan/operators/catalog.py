"""The session catalog: filters, pages, totals, projects, machines and sources."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import TOKENS, all_tokens, coverage_state, effective_project, effective_title
from quillspan.functions.storage import settle
from quillspan.operators.usage import PROJECTION

PAGE, LARGEST_PAGE = 100, 500


@dataclass(frozen=True)
class SessionQuery:
    """Filters that the whole catalog shares; the time range is half open."""

    machine: str | None = None
    provider: str | None = None
    project: str | None = None
    unassigned: bool = False
    assignment: str | None = None
    archived: bool | None = None
    text: str = ""
    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def __post_init__(self) -> None:
        if self.project and self.unassigned:
            raise ValueError("conflicting project filters")
        if self.start and self.end and self.start >= self.end:
            raise ValueError("empty time range")
        if len(self.text) > 4096 or len(self.assignment or "") > 1024:
            raise ValueError("search text or assignment too long")


def identities(sessions: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row for each session with its effective project and title, and its projection's keys."""
    out = sessions.join(metadata.withColumnRenamed("session_id", "id"), "id", "left").withColumn("assignment", F.coalesce("project", F.lit("")))
    return out.withColumns({"project": effective_project(), "title": effective_title()})


def catalog(sessions: DataFrame, metadata: DataFrame, totals: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One narrow row for each session: identity, effective names, tokens and price, and its machine's label where labels (machine_id, label) are given.

    Totals by projection join only where they are of the session's current one, so that their facts need no join with the sessions."""
    keys = ["id", *[c for c in PROJECTION if c in totals.columns]]
    out = identities(sessions, metadata).join(totals.withColumnRenamed("session_id", "id"), keys, "left")
    out = out.join(labels, "machine_id", "left") if labels is not None else out.withColumn("label", F.lit(None).cast("string"))
    zero = [*TOKENS, "priced_tokens", "unattributed_tokens", "observations"]
    flags = {k: F.coalesce(k, F.lit(False)) for k in ("archived", "pinned")}
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in zero} | flags).withColumn("pricing_known", F.col("observations") > 0).drop("own_project", "name", "project_override")


def searched_text() -> Column:
    """The folded text of a catalog row in which substrings are looked for."""
    return F.lower(F.concat_ws(" ", "title", "project", "machine_id", "label", "provider", "native_id", F.col("id").cast("string"), "note"))


def matches(q: SessionQuery) -> Column:
    keep = F.lit(True)
    for column, value in (("machine_id", q.machine), ("provider", q.provider), ("project", q.project)):
        if value:
            keep = keep & (F.col(column) == value)
    if q.unassigned:
        keep = keep & (F.col("project") == "")
    if q.assignment is not None:
        keep = keep & (F.col("assignment") == q.assignment)
    if q.archived is not None:
        keep = keep & (F.col("archived") == q.archived)
    if q.text:
        keep = keep & searched_text().contains(q.text.lower())
    if q.start:
        keep = keep & (F.col("last_activity") >= F.lit(q.start).cast("timestamp_ntz"))
    if q.end:
        keep = keep & (F.col("last_activity") < F.lit(q.end).cast("timestamp_ntz"))
    return keep


def list_sessions(cat: DataFrame, q: SessionQuery, sort: str = "activity", descending: bool = True, limit: int = PAGE, after: tuple | None = None) -> DataFrame:
    """A page of sessions: pinned first, the sort key with nulls last both ways, then id.

    after: (pinned, key or None, id) of the previous page's last row."""
    key = {"activity": F.col("last_activity"), "cost": F.round("cost_estimate", 4), "tokens": all_tokens(), "title": F.lower("title")}[sort]
    rows = cat.where(matches(q)).withColumn("sort_key", key)
    if after is not None:
        pinned, value, last = after
        if value is None:
            beyond = F.col("sort_key").isNull() & (F.col("id") > last)
        else:
            further = F.col("sort_key") < F.lit(value) if descending else F.col("sort_key") > F.lit(value)
            beyond = further | F.col("sort_key").isNull() | ((F.col("sort_key") == F.lit(value)) & (F.col("id") > last))
        rows = rows.where((F.col("pinned") < pinned) | ((F.col("pinned") == pinned) & beyond))
    order = F.col("sort_key").desc_nulls_last() if descending else F.col("sort_key").asc_nulls_last()
    return rows.orderBy(F.desc("pinned"), order, "id").limit(min(limit, LARGEST_PAGE))


def without_evidence(cat: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Sessions whose current projection has no row in checkpoints (source_id, generation, revision): what is still to be read."""
    return cat.join(checkpoints.select("source_id", "generation", "revision"), ["source_id", "generation", "revision"], "left_anti")


def cursor(**place) -> str:
    """An opaque place in a list: JSON in base64 for URLs, without padding."""
    return base64.urlsafe_b64encode(json.dumps(place, sort_keys=True, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def place_of(text: str, *names: str) -> dict:
    """The place of a cursor; ValueError where it is none or lacks a name."""
    try:
        place = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, UnicodeDecodeError) as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(place, dict) or any(n not in place for n in names):
        raise ValueError("invalid cursor")
    return place


class ListChanged(ValueError):
    """A list is no longer what a cursor was made for."""


def snapshot(rows: DataFrame) -> str:
    """A hash of a list's rows, whatever their order: sums of two hashes and the count."""
    columns = [F.to_json(F.struct(*rows.columns))]
    sums = rows.agg(F.count("*"), *[F.sum(F.xxhash64(*columns, F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]).first()
    return hashlib.sha256(repr(tuple(sums)).encode()).hexdigest()


def page_of(rows: DataFrame, order: list, limit: int, after: str | None = None) -> tuple[DataFrame, str]:
    """A page of an ordered list and the cursor of the next; ListChanged where the list is not that of the cursor.

    The list is worked out once, so that the page is of what the hash stands for."""
    rows = settle(rows, "list")
    now = snapshot(rows)
    place = place_of(after, "snapshot", "offset") if after else {"snapshot": now, "offset": 0}
    if place["snapshot"] != now:
        raise ListChanged("the list has changed; start again")
    return rows.orderBy(*order).offset(place["offset"]).limit(limit), cursor(snapshot=now, offset=place["offset"] + limit)


def totals(cat: DataFrame, q: SessionQuery) -> DataFrame:
    """One row of fleet totals with the coverage state."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = cat.where(matches(q)).agg(
        F.count("*").alias("sessions"), zero(F.col("event_count")).alias("events"), *[zero(F.col(t)).alias(t) for t in TOKENS],
        F.round(F.sum("cost_estimate"), 2).alias("cost_estimate"), F.count("cost_estimate").alias("with_estimate"), (F.count("*") - F.count("cost_estimate")).alias("without_estimate"),
        zero(F.col("priced_tokens")).alias("priced_tokens"), zero(F.col("unattributed_tokens")).alias("unattributed_tokens"), zero(F.when(~F.col("pricing_known"), all_tokens()).otherwise(0)).alias("awaiting_tokens"),
    )
    recorded = all_tokens()
    return out.withColumns(
        {
            "recorded_tokens": recorded,
            "unpriced_tokens": recorded - F.col("priced_tokens"),
            "token_coverage": F.round(F.when(recorded > 0, F.col("priced_tokens") / recorded), 6),
            "coverage": coverage_state(recorded, F.col("awaiting_tokens"), F.col("priced_tokens"), F.col("unattributed_tokens")),
        }
    )


def grouped(cat: DataFrame, by: str) -> DataFrame:
    """Sessions, latest activity, tokens and known cost of each project or machine."""
    return cat.groupBy(F.col(by).alias("key")).agg(
        F.count("*").alias("sessions"), F.max("last_activity").alias("latest"), F.sum(all_tokens()).cast("long").alias("tokens"), F.round(F.sum("cost_estimate"), 2).alias("cost_estimate"),
    )


def ranked_projects(cat: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """Projects by sessions, latest activity, then name."""
    return grouped(cat, "project").orderBy(F.desc("sessions"), F.col("latest").desc_nulls_last(), "key").offset(offset).limit(limit)


def source_only_machines(sources: DataFrame, cat: DataFrame) -> DataFrame:
    """Machines with sources but without a session in the catalog."""
    return sources.select("machine_id").distinct().join(cat.select("machine_id").distinct(), "machine_id", "left_anti")


def search_sources(sources: DataFrame, text: str = "", machine: str | None = None, after: tuple | None = None, limit: int = PAGE, titles: DataFrame | None = None) -> DataFrame:
    """Sources by (machine, path) whose path, or title of titles (source_id, title), has the text, letters A-Z folded; after is the last row's pair."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = fold(F.col("path")).contains(fold(F.lit(text)))
    if titles is not None:
        sources = sources.join(titles.select("source_id", "title"), "source_id", "left")
        has = has | fold(F.coalesce("title", F.lit(""))).contains(fold(F.lit(text)))
    rows = sources.where(has)
    if machine:
        rows = rows.where(F.col("machine_id") == machine)
    if after:
        rows = rows.where(F.struct("machine_id", "path") > F.struct(F.lit(after[0]).alias("machine_id"), F.lit(after[1]).alias("path")))
    return rows.orderBy("machine_id", "path").limit(limit)


def indexing_progress(sources: DataFrame) -> DataFrame:
    """Work states of the sources: rebuilding (a staged revision is under way), else awaiting index, blocked by diagnostics, or ready."""
    behind = F.col("indexed_offset") < F.col("durable_offset")
    work = ~F.col("rebuilding")
    return sources.agg(
        F.count("*").alias("sources"), F.count_if(work & ~behind & (F.col("diagnostics") == 0)).alias("ready"), F.count_if(work & behind).alias("awaiting"),
        F.count_if(work & ~behind & (F.col("diagnostics") > 0)).alias("blocked"), F.count_if("rebuilding").alias("rebuilding"),
        F.sum(F.col("durable_offset") - F.col("indexed_offset")).cast("long").alias("bytes_left"),
    )


def lineage(sessions: DataFrame) -> DataFrame:
    """Each session's parent state (root, unresolved, unique or ambiguous), its parent where unique, and its children."""
    identity = ["machine_id", "provider", "native_id"]
    known = sessions.groupBy(*identity).agg(F.count("*").alias("n"), F.min("id").alias("parent"))
    known = known.withColumnRenamed("native_id", "parent_native_id")
    children = sessions.where("parent_native_id <> ''").groupBy("machine_id", "provider", F.col("parent_native_id").alias("native_id")).agg(F.count("*").alias("children"))
    out = sessions.join(known, ["machine_id", "provider", "parent_native_id"], "left").join(children, identity, "left")
    state = F.when(F.col("parent_native_id") == "", "root").when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return out.select("id", state.alias("state"), F.when(state == "unique", F.col("parent")).alias("parent"), F.coalesce("children", F.lit(0)).alias("children"))


def quiet_machines(cat: DataFrame, now: Column) -> DataFrame:
    """Machines whose silence is longer than their own rhythm: twice the 90th percentile gap between sessions, 30 minutes
    at least and 6 hours at most; a verdict needs 5 sessions over 7 days."""
    ms = F.floor(F.unix_micros(F.col("last_activity").cast("timestamp")) / 1000)
    # Gaps inside a day come from a window a machine and day; those between days from the ends of each day, a row a day.
    day = ["machine_id", "day"]
    rows = cat.where("last_activity IS NOT NULL").select("machine_id", F.to_date("last_activity").alias("day"), "id", ms.alias("t"))
    inside = rows.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*day).orderBy("t", "id")))
    ends = rows.groupBy(*day).agg(F.min("t").alias("first"), F.max("t").alias("end"))
    between = ends.withColumn("between", F.col("first") - F.lag("end").over(Window.partitionBy("machine_id").orderBy("day"))).select(*day, F.col("first").alias("t"), "between")
    firsts = inside.where("gap IS NULL").drop("gap").join(between, [*day, "t"]).withColumnRenamed("between", "gap")
    rows = inside.where("gap IS NOT NULL").unionByName(firsts)
    out = rows.groupBy("machine_id").agg(
        F.count("*").alias("sessions"), (F.max("t") - F.min("t")).alias("span_ms"), F.max("t").alias("last"), F.median("gap").alias("median_gap_ms"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY gap)").cast("long").alias("p90_gap_ms"),
    )
    enough = (F.col("sessions") >= 5) & (F.col("span_ms") >= 7 * 86_400_000)
    out = out.withColumns({"enough_history": enough, "threshold_ms": F.least(F.lit(21_600_000), F.greatest(F.lit(1_800_000), 2 * F.col("p90_gap_ms")))})
    silence = (F.floor(F.unix_micros(now.cast("timestamp")) / 1000) - F.col("last")).cast("long")
    return out.withColumns({"silence_ms": silence, "quiet": enough & (silence > F.col("threshold_ms"))}).drop("last")
