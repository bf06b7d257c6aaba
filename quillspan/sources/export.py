"""Export of sessions as JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_lines(sessions: DataFrame, events: DataFrame, usage: DataFrame) -> DataFrame:
    """(session_id, part, at, value): for each session a header, the session, its events by seq, its usage by id, and a trailer with the counts.

    Parts sort in that order; a session's lines are never gathered into one row."""
    line = lambda kind, body: F.to_json(F.struct(F.lit(kind).alias("type"), body.alias("value")))
    part = lambda df, key, n, at, value: df.select(key.alias("session_id"), F.lit(n).alias("part"), at.cast("string").alias("at"), value.alias("value"))
    whole = lambda df, but=(): F.struct(*[c for c in df.columns if c not in but])
    counted = [df.groupBy("session_id").agg(F.count("*").alias(name)) for df, name in ((events, "events"), (usage, "usage"))]
    ids = sessions.select(F.col("id").alias("session_id"))
    counts = ids.join(counted[0], "session_id", "left").join(counted[1], "session_id", "left").fillna(0)
    none: Column = F.lit("")
    parts = [
        part(sessions, F.col("id"), 0, none, line("header", F.struct(F.lit(1).alias("version")))), part(sessions, F.col("id"), 1, none, line("session", whole(sessions))),
        part(events.join(ids, "session_id", "left_semi"), F.col("session_id"), 2, F.lpad(F.col("seq").cast("string"), 20, "0"), line("event", whole(events))),
        part(usage.join(ids, "session_id", "left_semi"), F.col("session_id"), 3, F.col("id"), line("usage", whole(usage))), part(counts, F.col("session_id"), 4, none, line("trailer", F.struct("events", "usage"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_exports(lines: DataFrame, path: str) -> None:
    """One folder of text for each session, its lines in order."""
    lines.repartition("session_id").sortWithinPartitions("session_id", "part", "at").select("session_id", "value").write.partitionBy("session_id").mode("overwrite").text(path)
