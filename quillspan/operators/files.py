"""Files that agents touched: where trouble gathers, what may be unsaved, what was undone, what holds a secret."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.functions import detect
from quillspan.functions.workers import ship

LEAST_SESSIONS, NEWEST_SESSIONS = 5, 150


def session_trouble(events: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """(session_id, failed, stalled, uncertain) of sessions with a sign of trouble or of missing evidence.

    Failed: a result says error. Stalled: a pending call of over two minutes while its source was written in the last ten.
    Uncertain: results that do not say, indexing errors, calls that do not pair, or times that do not fit."""
    is_call, is_result = F.col("kind") == "tool-call", F.col("kind") == "tool-result"
    named = (F.coalesce("tool_use_id", F.lit("")) != "") & (F.col("agent_id") != "")
    pairs = events.where(is_call | is_result).groupBy("session_id", "source_id", "agent_id", "tool_use_id").agg(
        F.count_if(is_call).alias("calls"), F.count_if(is_result).alias("results"),
        F.coalesce(F.max(F.when(is_call, F.col("seq"))), F.lit(0)).alias("call_seq"), F.coalesce(F.max(F.when(is_result, F.col("seq"))), F.lit(0)).alias("result_seq"),
    )
    doubtful = (F.col("calls") != 1) | (F.col("results") > 1) | ~named | ((F.col("results") == 1) & (F.col("result_seq") <= F.col("call_seq")))
    pending = pairs.groupBy("session_id", "source_id", "agent_id").agg(
        F.max(F.when((F.col("calls") == 1) & (F.col("results") == 0) & named, F.col("call_seq"))).alias("seq"), F.bool_or(doubtful).alias("doubtful"),
    )
    waiting = pending.where("seq IS NOT NULL OR doubtful").join(events.select("seq", F.col("ts").alias("at")), "seq", "left").join(sources.select("source_id", "modified_at"), "source_id")
    old = F.col("at") < now - F.expr("INTERVAL 2 MINUTES")
    live = (F.col("modified_at") > now - F.expr("INTERVAL 10 MINUTES")) & (F.col("modified_at") <= now)
    unknown = F.col("at").isNull() | (F.col("at") > now) | F.col("modified_at").isNull() | (F.col("modified_at") > now)
    stalls = waiting.groupBy("session_id").agg(
        F.bool_or(F.col("seq").isNotNull() & F.coalesce(old & live, F.lit(False))).alias("stalled"), F.bool_or(F.col("doubtful") | (F.col("seq").isNotNull() & unknown)).alias("unpaired"),
    )
    error = F.coalesce("error", F.lit(False))
    outcomes = events.groupBy("session_id").agg(F.bool_or(error).alias("failed"), F.bool_or((F.col("kind") == "indexing-error") | (is_result & F.col("error").isNull())).alias("unsaid"))
    out = outcomes.join(stalls, "session_id", "left")
    return out.select("session_id", "failed", F.coalesce("stalled", F.lit(False)).alias("stalled"), (F.col("unsaid") | F.coalesce("unpaired", F.lit(False))).alias("uncertain"))


def file_touches(sessions: DataFrame, events: DataFrame, sources: DataFrame, checkpoints: DataFrame, now: Column, only: Column | None = None) -> DataFrame:
    """(session_id, machine_id, project, path, touched_at, bad, unknown): each file of each session once, with the session's outcome.

    checkpoints (source_id, generation, edit_offset, diagnostics) say how far edits were read. Of the sessions that only
    selects by their touched rows the whole history counts."""
    keys = sessions.select(F.col("id").alias("session_id"), "machine_id", F.col("own_project").alias("project"), "last_activity", "source_id", "generation")
    edits = events.where("kind = 'tool-call' AND path IS NOT NULL").select("session_id", "path").distinct().join(keys, "session_id")
    if only is not None:
        edits = edits.where(only)
        events = events.join(edits.select("session_id").distinct(), "session_id", "left_semi")
    rows = edits.join(sources.select("source_id", "generation", "modified_at", "indexed_offset"), ["source_id", "generation"]).join(checkpoints, ["source_id", "generation"], "left")
    rows = rows.join(session_trouble(events, sources, now), "session_id", "left")
    false = F.lit(False)
    bad = F.coalesce("failed", false) | F.coalesce("stalled", false)
    behind = F.col("edit_offset").isNull() | (F.col("edit_offset") != F.col("indexed_offset")) | (F.col("diagnostics") > 0)
    return rows.select(
        "session_id", "machine_id", "project", "path", F.coalesce("modified_at", "last_activity").alias("touched_at"), bad.alias("bad"), (~bad & (F.coalesce("uncertain", false) | behind)).alias("unknown"),
    )


def trouble_files(touches: DataFrame) -> DataFrame:
    """Files by machine and project: sessions, failed and unknown ones, and a rate only from five sessions on without unknowns."""
    out = touches.groupBy("machine_id", "project", "path").agg(F.count("*").alias("sessions"), F.count_if("bad").alias("bad"), F.count_if("unknown").alias("unknown"), F.max("touched_at").alias("last_touched"))
    return out.withColumn("rate", F.when((F.col("sessions") >= LEAST_SESSIONS) & (F.col("unknown") == 0), F.col("bad") * 100.0 / F.col("sessions")))


def sorted_files(files: DataFrame, by: str = "sessions", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of trouble_files(); a file without a rate sorts as -1, ties go by machine, project and path."""
    key = {"path": F.col("path"), "sessions": F.col("sessions"), "bad": F.col("bad"), "unknown": F.col("unknown"), "lastTouched": F.col("last_touched"), "rate": F.coalesce("rate", F.lit(-1.0))}[by]
    order = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return files.orderBy(order, "machine_id", "project", "path").offset(offset).limit(min(limit, 100))


def trouble_files_newest(sessions: DataFrame, events: DataFrame, newest: int = NEWEST_SESSIONS) -> DataFrame:
    """Files of the newest sessions: sessions, failed ones, and the rounded rate from five sessions on."""
    latest = sessions.where("last_activity IS NOT NULL").join(events.select(F.col("session_id").alias("id")).distinct(), "id", "left_semi").orderBy(F.desc("last_activity"), "id").limit(newest).select(F.col("id").alias("session_id"))
    mine = events.join(latest, "session_id", "left_semi")
    failed = mine.groupBy("session_id").agg(F.bool_or(F.coalesce("error", F.lit(False))).alias("bad"))
    out = mine.where("kind = 'tool-call' AND path IS NOT NULL").select("session_id", "path").distinct().join(failed, "session_id").groupBy("path").agg(F.count("*").alias("sessions"), F.count_if("bad").alias("bad"))
    return out.withColumn("rate", F.when(F.col("sessions") >= LEAST_SESSIONS, F.round(F.col("bad") * 100 / F.col("sessions"))))


def unsaved_candidates(sessions: DataFrame, events: DataFrame, machine: str | None = None) -> DataFrame:
    """Files that sessions edited, by machine, project, path and working directory (that of relative paths): latest session, time and number of sessions."""
    keys = sessions.select(F.col("id").alias("session_id"), "machine_id", F.col("own_project").alias("project"))
    keys = keys.where(F.col("machine_id") == machine) if machine else keys
    absolute = F.col("path").rlike(r"^(?:[/\\]|.:)")
    file = ["machine_id", "project", "path", "working_directory"]
    edits = events.where("kind = 'tool-call' AND path IS NOT NULL").join(keys, "session_id").withColumn("working_directory", F.when(absolute, "").otherwise(F.coalesce("working_directory", F.lit(""))))
    touches = edits.groupBy("session_id", *file).agg(F.max("ts").alias("last_touched"))
    # The latest session of a file, of equal times that with the smallest id; both add up before the shuffle.
    place = F.struct(F.col("last_touched").isNull().alias("never"), (-F.unix_micros(F.col("last_touched").cast("timestamp"))).alias("ago"), "session_id", "last_touched")
    files = touches.groupBy(*file).agg(F.min(place).alias("latest"), F.count("*").alias("sessions"))
    return files.select("latest.session_id", *file, "latest.last_touched", "sessions")


def undo_history(events: DataFrame) -> DataFrame:
    """Attempts to undo work with git in tool calls (tool, input): (seq, session_id, ts, state, rule, paths, path_count, command).

    Calls that could not be read are kept with their state; a cheap look for the word comes before any parsing."""
    ship(events.sparkSession)

    @pandas_udf("state string, rule string, paths array<string>, path_count long, command string")
    def undo_calls(tool: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(tool, text):
            state, hit = detect.undo_of_call(t, x)
            rows.append((state, *(hit[k] if hit else None for k in ("rule", "paths", "path_count", "command"))))
        return pd.DataFrame(rows, columns=["state", "rule", "paths", "path_count", "command"]).astype({"path_count": "Int64"})

    calls = events.where("kind = 'tool-call' AND input LIKE '%git%'")
    found = calls.select("seq", "session_id", "source_id", "ts", undo_calls("tool", "input").alias("u")).select("seq", "session_id", "source_id", "ts", "u.*")
    return found.where("rule IS NOT NULL OR state IN ('incomplete-shell', 'unsupported-input')")


def prior_edits(undone: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """The newest edits of the same source before each undo: (undo_seq, seq, path, tool).

    Edits and undos of a source are read as one sorted stream, of which the last edits are held: each row is handled once,
    however many undos a source has."""
    rows_of = lambda df, undo, path, tool: df.select("source_id", "seq", F.lit(undo).alias("undo"), path.alias("path"), tool.alias("tool")).where("source_id IS NOT NULL")
    none = F.lit(None).cast("string")
    edits = rows_of(events.where("kind = 'tool-call' AND path IS NOT NULL"), False, F.col("path"), F.col("tool"))
    undos = rows_of(undone.where("rule IS NOT NULL"), True, none, none)
    stream = edits.unionByName(undos).repartition("source_id").sortWithinPartitions("source_id", "seq", F.desc("undo"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, last = None, deque(maxlen=limit)
        for batch in batches:
            out = []
            for own, seq, undo, path, tool in batch.itertuples(index=False, name=None):
                if own != source:
                    source = own
                    last.clear()
                if undo:
                    out += [(seq, *edit) for edit in last]
                else:
                    last.append((seq, path, tool))
            yield pd.DataFrame(out, columns=["undo_seq", "seq", "path", "tool"])

    return stream.mapInPandas(read, "undo_seq long, seq long, path string, tool string")


def undo_by_project(undone: DataFrame, sessions: DataFrame) -> DataFrame:
    """Undo attempts by recorded project: attempts, sessions, named paths and the latest."""
    keys = sessions.select(F.col("id").alias("session_id"), F.col("own_project").alias("project"))
    return undone.where("rule IS NOT NULL").join(keys, "session_id").groupBy("project").agg(
        F.count("*").alias("attempts"), F.countDistinct("session_id").alias("sessions"), F.sum("path_count").cast("long").alias("paths"), F.max("ts").alias("latest"),
    )


def undo_summary(undone: DataFrame) -> DataFrame:
    """The fleet's undo attempts by rule, and the calls that could not be read (rule '')."""
    return undone.groupBy(F.coalesce("rule", F.lit("")).alias("rule")).agg(F.count("*").alias("calls"), F.countDistinct("session_id").alias("sessions"))


def secrets_in_files(files: DataFrame) -> DataFrame:
    """Credentials in written files (path, content): (path, state, capped, kind, line, fragment), four characters of each at most.

    A file that was not scanned (missing, too large or binary) is one row with its state; a scanned file without findings is none.
    capped says that the most findings were reached and there may be more. Texts without one of the shapes' beginnings never reach Python."""
    ship(files.sparkSession)

    @pandas_udf("struct<state:string,capped:boolean,found:array<struct<kind:string,line:int,fragment:string>>>")
    def scan(text: pd.Series) -> pd.DataFrame:
        rows = [detect.secrets_in(t if isinstance(t, str) else None) for t in text]
        return pd.DataFrame({"state": [s for s, _, _ in rows], "capped": [c for _, _, c in rows], "found": [[{"kind": k, "line": n, "fragment": f} for k, n, f in found] for _, found, _ in rows]})

    text = F.col("content")
    worth = text.isNull() | (F.octet_length(text) > detect.MAX_SCAN) | text.contains("\0") | text.rlike(detect.SECRET_BEGINNINGS)
    found = files.where(worth).select("path", scan("content").alias("s")).where("s.state <> 'scanned' OR size(s.found) > 0")
    return found.select("path", "s.state", "s.capped", F.explode_outer("s.found").alias("f")).select("path", "state", "capped", "f.*")
