"""Usage as a stream: revised reports, running counters and sessions that go quiet.

Reports are accepted however late they come, so nothing here has a watermark but the activity of runs. Each batch is
written with its number, and a batch that is run again replaces what it wrote: results are those of one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspan.functions.columns import TOKENS
from quillspan.functions.workers import ship
from quillspan.sources import transcripts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def unique_events(events: DataFrame) -> DataFrame:
    """Events (dedupe_key, source_id, ...) without those whose key their source had before; events without a key all stay and leave no state."""
    keyed = F.coalesce("dedupe_key", F.lit("")) != ""
    return events.where(keyed).dropDuplicates(["source_id", "dedupe_key"]).unionByName(events.where(~keyed))


_MERGED = "session_id long, agent_id string, message_id string, " + ", ".join(f"{t} long" for t in TOKENS) + ", model string, kind string, reports long"


class MergeReports(StatefulProcessor):
    """Keeps one merged report for each provider message: of each field the latest value among reports that give it.

    Reports of one message may come in any order: a field's value is that of its latest report by time, then id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{t} {'string' if t == 'model' else 'long'}, {t}_at string" for t in (*TOKENS, "model"))
        self.state = handle.getValueState("report", f"{fields}, reports long, no_id boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names = (*TOKENS, "model")
        held = self.state.get() if self.state.exists() else None
        best = {n: (held[2 * i + 1], held[2 * i]) if held is not None else (None, None) for i, n in enumerate(names)}
        reports, no_id = (held[-2], held[-1]) if held is not None else (0, True)
        for frame in rows:
            for r in frame.to_dict("records"):
                order = f"{'' if pd.isna(r['ts']) else r['ts'].isoformat()}\n{r['id']}"
                reports, no_id = reports + 1, no_id and r["kind"] == "message-without-id"
                for n in names:
                    if n in r["present"] and (best[n][0] is None or order >= best[n][0]):
                        best[n] = (order, r[n] if n == "model" else int(r[n]))
        self.state.update(tuple(x for n in names for x in (best[n][1], best[n][0])) + (reports, no_id))
        whole = all(best[n][0] is not None for n in names) and best["model"][1] != ""
        kind = "message-without-id" if no_id else "message-final" if whole else "message-partial"
        yield pd.DataFrame([(*key, *(best[n][1] or 0 for n in TOKENS), best["model"][1] or "", kind, reports)], columns=[x.split()[0] for x in _MERGED.split(", ")])

    def close(self) -> None:
        pass


def merged_stream(usage: DataFrame) -> DataFrame:
    """A stream of usage reports (id, session_id, agent_id, message_id, ts, kind, model, tokens, present) as the merged report of each message, again whenever it changes."""
    ship(usage.sparkSession)
    grouped = usage.groupBy("session_id", "agent_id", "message_id")
    return grouped.transformWithStateInPandas(MergeReports(), outputStructType=_MERGED, outputMode="Update", timeMode="None")


_HIGH = ("input", "cache", "cache_write", "output")
#: How long a source may rest before its counters are given up.
REST_MS = 30 * 86_400_000


class RolloutDeltas(StatefulProcessor):
    """Reads the narrow rows of a rollout in the order of (generation, offset) and keeps what later rows need: the model
    last named, the thread that owns the source, and each scope's high-water counter; see counter_deltas for the rules.

    A new generation starts with nothing. A source that rests for rest_ms leaves only a mark that its counters are gone:
    should it go on, each scope's next report is a diagnostic that sets the counter anew, so that nothing counts twice."""

    def __init__(self, rest_ms: int):
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.source = handle.getValueState("source", "generation long, context string, owner string, given_up boolean, timer long")
        self.scopes = handle.getMapState("scopes", "scope string", ", ".join(f"{n} long" for n in _HIGH) + ", model string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["generation", "offset"], kind="stable")
        generation, context, owner, given_up, timer = self.source.get() if self.source.exists() else (-1, None, None, False, None)
        text = lambda v: v if isinstance(v, str) and v else None
        out: list[tuple] = []
        for own, part in frame.groupby("generation", sort=True):
            own = int(own)
            if own < generation:
                continue
            if own > generation:
                generation, context, owner, given_up = own, None, None, False
                self.scopes.clear()
            found = []
            for r in part.to_dict("records"):
                owner = owner or text(r["owner"])
                if not r["counted"]:
                    context = text(r["named"]) or context
                    continue
                own_scope = owner or key[0]
                scope = text(r["thread"]) or own_scope
                found.append(r | {"scope": scope, "model": text(r["model"]) or (scope == own_scope and context) or "", "at_key": f"{generation:010d}:{int(r['offset']):020d}"})
            if not found:
                continue
            for scope, reports in pd.DataFrame(found).groupby("scope", sort=False):
                out += self._read(key[0], scope, reports, given_up)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = int(timer_values.getCurrentProcessingTimeInMs()) + self.rest_ms
        self.handle.registerTimer(timer)
        self.source.update((generation, context, owner, given_up, timer))
        out.sort(key=lambda r: r[1])
        yield pd.DataFrame(out, columns=[x.split()[0] for x in transcripts.DELTA.split(", ")])

    def _read(self, source: str, scope: str, reports: pd.DataFrame, given_up: bool) -> list[tuple]:
        held = self.scopes.getValue((scope,)) if self.scopes.containsKey((scope,)) else None
        high, model = (tuple(held[:4]), held[4]) if held is not None else (None, None)
        out: list[tuple] = []
        if given_up and high is None:
            first = reports.iloc[0]
            totals = [first[f"total_{c}"] for c in _HIGH]
            if not any(pd.isna(x) for x in totals):
                high, model = tuple(int(x) for x in totals), first["model"]
                out.append((source, first["at_key"], scope, "counter", "", "counter-given-up", 0, 0, 0, 0))
        high, model, more = transcripts.deltas_of(reports, (source, scope), high, model)
        if high is not None:
            self.scopes.updateValue((scope,), (*high, model))
        return out + more

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        generation, context, owner, _, _ = self.source.get()
        self.scopes.clear()
        self.source.update((generation, context, owner, True, None))
        yield pd.DataFrame([], columns=[x.split()[0] for x in transcripts.DELTA.split(", ")])

    def close(self) -> None:
        pass


def delta_stream(lines: DataFrame, rest_ms: int = REST_MS) -> DataFrame:
    """A stream of rollout lines (source_id, at = generation and offset, value) as the usage that each count adds.

    Sources are keys, so a row's context is read with it; at_key sorts as the rows do."""
    ship(lines.sparkSession)
    rows = transcripts.counter_fields(lines).withColumns({"generation": F.col("at.generation").cast("long"), "offset": F.col("at.offset")}).drop("at", "ts")
    return rows.groupBy("source_id").transformWithStateInPandas(RolloutDeltas(rest_ms), outputStructType=transcripts.DELTA, outputMode="Append", timeMode="ProcessingTime")


_SIGNED = "key string, sign int, value string"


class Versions(StatefulProcessor):
    """Keeps the current version of each key and gives, for every change, the version that goes (-1) and the one that comes (+1).

    Rows are versions by number; a row of a smaller number than the current one comes too late and changes nothing. A row
    without a value deletes its key; its number stays, so that an older version cannot bring it back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("version", "number long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        number, value = self.state.get() if self.state.exists() else (-1, None)
        before = value
        for n, v in sorted(((int(n), v if isinstance(v, str) else None) for frame in rows for n, v in zip(frame["number"], frame["value"])), key=lambda x: x[0]):
            if n >= number:
                number, value = n, v
        self.state.update((number, value))
        out = [(key[0], s, v) for s, v in ((-1, before), (1, value)) if v is not None] if before != value else []
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _SIGNED.split(", ")])

    def close(self) -> None:
        pass


def change_stream(versions: DataFrame) -> DataFrame:
    """A stream of versions (key, number, value: JSON, null to delete) as signed values, for SignedTotals.apply() batch by batch."""
    ship(versions.sparkSession)
    return versions.groupBy("key").transformWithStateInPandas(Versions(), outputStructType=_SIGNED, outputMode="Append", timeMode="None")


def running_totals(events: DataFrame) -> DataFrame:
    """Counts of events, calls and errors by session and agent, kept up to date as events come (update mode)."""
    return events.groupBy("session_id", "agent_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("kind") == "tool-call").alias("calls"), F.count_if(F.coalesce("error", F.lit(False))).alias("errors"), F.max("ts").alias("last_at"),
    )


def finished_runs(events: DataFrame, idle: str = "10 minutes", horizon: str = "20 minutes") -> DataFrame:
    """Runs of a session: its events with pauses under idle. A run is over, not successful, once the stream has gone on for the horizon without it."""
    timed = events.where("ts IS NOT NULL").select("session_id", F.col("ts").cast("timestamp").alias("at"))
    runs = timed.withWatermark("at", horizon).groupBy("session_id", F.session_window("at", idle).alias("w")).agg(F.count("*").alias("events"))
    return runs.select("session_id", F.col("w.start").cast("timestamp_ntz").alias("started_at"), F.col("w.end").cast("timestamp_ntz").alias("idle_at"), "events")


def append_once(path: str, keys: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer for foreachBatch: each batch has a folder of its own, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch.dropDuplicates(keys) if keys else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def changes(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """The rows of append_once() in batches after a number, which a reader keeps to go on from."""
    return spark.read.option("basePath", path).parquet(path).where(F.col("batch") > after)


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that a stream in update mode wrote again and again the last of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "batch")


def publish(frame: DataFrame, path: str, generation: int, check: Callable[[DataFrame], bool] = lambda df: True) -> bool:
    """Write a rebuilt generation aside, check it as it was written, and make it current; a failed check leaves the old one.

    The pointer is a one-row table of its own for each generation: readers take the largest, so that a switch is one write."""
    spark = frame.sparkSession
    frame.write.mode("overwrite").parquet(f"{path}/generation={generation}")
    if not check(spark.read.parquet(f"{path}/generation={generation}")):
        return False
    spark.createDataFrame([(generation,)], "current long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/{generation:012d}")
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the generation that was published last."""
    newest = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/pointers").agg(F.max("current")).first()[0]
    return spark.read.parquet(f"{path}/generation={newest}")
