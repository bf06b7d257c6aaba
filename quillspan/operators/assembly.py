"""Sessions put together from their main file and their helpers' files, with one sequence for each session.

Positions are exact and need no task that holds a session: rows are dealt out by ranges of (session, order), which Spark
finds from a sample; each part numbers its own rows, and what a session has in earlier parts is a prefix sum over one
number for each session and part. A session of any size lies in as many parts as it fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.storage import fresh_path


def with_sequence(rows: DataFrame, group: str, order: list[str], to: str = "global_seq", parts: int | None = None) -> DataFrame:
    """rows with the position of each in its group, from 0, by order, nulls first. The order's columns must tell rows apart."""
    spark = rows.sparkSession
    keys = [group, *order]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    path = fresh_path(spark, "sequence")
    # Parts are settled: their bounds come from a sample and must not be drawn again.
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy(group, "_part").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(own) - 1)
    joined = numbered.join(offsets, numbered[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn(to, (F.col("_row") + F.col("_offset")).cast("long")).drop("_part", "_row", "_group", "_of", "_offset")


def assemble(events: DataFrame, files: DataFrame, parts: int | None = None) -> DataFrame:
    """Events (source_id, at, place, agent_id, ts, ...) of a session's files (source_id, session_id, kind, agent_id) as one history with global_seq.

    A helper's events belong to that helper, whatever name they carry; those of the main file keep theirs. Events stand by
    time, those without one at the end; at equal times the main file goes first, then files by name, and each file keeps its
    order."""
    rows = events.join(files.select("source_id", "session_id", F.col("kind").alias("_kind"), F.col("agent_id").alias("_helper")), "source_id")
    main = F.col("_kind") == "main"
    rows = rows.withColumns({"agent_id": F.when(main, F.col("agent_id")).otherwise(F.coalesce("_helper", "agent_id")), "_timeless": F.when(F.col("ts").isNull(), 1).otherwise(0), "_later": F.when(main, 0).otherwise(1)})
    return with_sequence(rows, "session_id", ["_timeless", "ts", "_later", "source_id", "at", "place"], parts=parts).drop("_kind", "_helper", "_timeless", "_later")
