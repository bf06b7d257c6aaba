"""Results that are kept beside their facts: totals by signed changes, usage by parts, and tables that are verified by digests.

Totals move by what changes: a row that goes counts -1, a row that comes +1, a revised row both. Sums are decimals, so that
what was added is taken away exactly; the least and the largest value follow from how often each value is there. A batch
has a number and a folder of its own, so that a batch that is run again replaces itself.

Usage parts are partial sums by session, model and day, bound to the projection that they were made of. A session whose
projection has moved on is found by an anti-join; only its usage is read again.

A verified table lies in folders by ranges of its keys' hashes. The digest of a range does not depend on the order of its
rows, and digests of ranges add up to those of larger ones, so that two tables are compared from the top down and only
ranges that differ are read. Progress is stored range by range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.columns import TOKENS, all_tokens, coverage_state
from quillspan.functions.storage import settle
from quillspan.operators.usage import PROJECTION, dimension, sums

# --- totals by signed changes ---------------------------------------------------------------------------

MONEY = "decimal(38,12)"


def signed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The changes between two versions of a table with the same columns: each row that went with sign -1, each that came with +1."""
    values = [c for c in new.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in values]).alias(name))
    both = side(old, "o").join(side(new, "n"), key, "full").where(~F.col("o").eqNullSafe(F.col("n")))
    changes = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(s).alias("sign"), F.col(c).alias("v"))) for c, s in (("o", -1), ("n", 1))]))
    return both.select(key, F.explode(changes).alias("c")).select(key, "c.sign", "c.v.*")


@dataclass
class SignedTotals:
    """Counts, sums and the largest value of some columns by group, from numbered batches of signed rows under a path."""

    spark: SparkSession
    path: str
    by: tuple[str, ...]
    sums: tuple[str, ...]
    latest: str | None = None

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Add a batch of signed rows; the same number again replaces it. The changes are worked out once: both kinds come from their sums by group and value."""
        if not self.latest:
            self._write(self._sums(changes), "sums", batch)
            return
        parts = settle(self._sums(changes, self.latest), "changes")
        self._write(self._added(parts, self.by), "sums", batch)
        self._write(parts.where(F.col(self.latest).isNotNull() & (F.col("n") != 0)).select(*self.by, self.latest, "n"), "values", batch)

    def _sums(self, rows: DataFrame, *more: str) -> DataFrame:
        money = lambda c: F.sum(F.col("sign") * F.coalesce(F.col(c).cast(MONEY), F.lit(0).cast(MONEY))).cast(MONEY).alias(c)
        known = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("sign")).otherwise(0)).alias(f"known_{c}")
        return rows.groupBy(*self.by, *more).agg(F.sum("sign").alias("n"), *map(money, self.sums), *map(known, self.sums))

    def _added(self, parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        add = [c for c in parts.columns if c not in (*self.by, self.latest)]
        return parts.groupBy(*keys).agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in add])

    def _write(self, rows: DataFrame, kind: str, batch: int, folder: str = "batches") -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}/{kind}/batch={batch}")

    def _read(self, kind: str) -> DataFrame:
        """The newest fold and the batches after it."""
        batches = self.spark.read.option("basePath", f"{self.path}/batches/{kind}").parquet(f"{self.path}/batches/{kind}/*")
        try:
            folds = self.spark.read.option("basePath", f"{self.path}/folds/{kind}").parquet(f"{self.path}/folds/{kind}/*")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return batches.drop("batch")
        newest = folds.agg(F.max("batch")).first()[0]
        return folds.where(F.col("batch") == newest).unionByName(batches.where(F.col("batch") > newest)).drop("batch")

    def _totals(self, kind: str) -> DataFrame:
        rows = self._read(kind)
        keys = [*self.by, self.latest] if kind == "values" else list(self.by)
        add = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in add])

    def fold(self, upto: int) -> None:
        """Add the batches up to a number into one table; readers take the newest fold and what came after it. No batch up to that number may be applied again."""
        for kind in ("sums", "values") if self.latest else ("sums",):
            own = self.spark.read.option("basePath", f"{self.path}/batches/{kind}").parquet(f"{self.path}/batches/{kind}/*").where(F.col("batch") <= upto)
            keys = [*self.by, self.latest] if kind == "values" else list(self.by)
            add = [c for c in own.columns if c not in (*keys, "batch")]
            self._write(own.groupBy(*keys).agg(*[F.sum(c).cast(own.schema[c].dataType).alias(c) for c in add]), kind, upto, "folds")

    def totals(self) -> DataFrame:
        """The groups that have rows: n, the sums (null where no row has the value), and the latest value."""
        out = self._totals("sums").where("n > 0")
        out = out.select(*self.by, "n", *[F.when(F.col(f"known_{c}") > 0, F.col(c)).alias(c) for c in self.sums])
        if self.latest:
            there = self._totals("values").where("n > 0").groupBy(*self.by).agg(F.max(self.latest).alias(self.latest))
            out = out.join(there, list(self.by), "left")
        return out


# --- usage by parts --------------------------------------------------------------------------------------

_KEYS = ("session_id", *PROJECTION)
_ADDED = ("observations", *TOKENS, "priced_tokens", "unattributed_tokens")
PART_DIMENSIONS = ("project", "machine", "provider", "model", "day", "week", "month", "year")


def usage_parts(priced: DataFrame) -> DataFrame:
    """Partial sums of priced usage by session, projection, model and day (ts is the day's start)."""
    nameless = F.when((F.col("model") == "") | (F.col("kind") == "incomplete-attribution"), all_tokens()).otherwise(0)
    rows = priced.withColumns({"ts": F.date_trunc("day", "ts").cast("timestamp_ntz"), "unattributed_tokens": nameless})
    return rows.groupBy(*_KEYS, "model", "ts").agg(F.count("*").alias("observations"), *sums(*TOKENS, "priced_tokens", "unattributed_tokens"), F.sum("cost").alias("cost"))


def projections(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("id").alias("session_id"), *PROJECTION)


def stale_sessions(sessions: DataFrame, covered: DataFrame) -> DataFrame:
    """The projections of sessions that no parts were made of; covered has the projections of those that have parts, be they none."""
    return projections(sessions).join(covered.select(*_KEYS), list(_KEYS), "left_anti")


def current_parts(parts: DataFrame, covered: DataFrame, priced: DataFrame, sessions: DataFrame) -> DataFrame:
    """Parts of all sessions' current projections: stored ones where they are fresh, those of stale sessions from their usage alone."""
    own = projections(sessions)
    fresh = parts.join(own.join(covered.select(*_KEYS), list(_KEYS), "left_semi"), list(_KEYS), "left_semi")
    return fresh.unionByName(usage_parts(priced.join(stale_sessions(sessions, covered), list(_KEYS), "left_semi")))


def grouped_by_parts(parts: DataFrame, sessions: DataFrame, by: str) -> DataFrame:
    """grouped_usage() of one of eight dimensions from current parts."""
    if by not in PART_DIMENSIONS:
        raise ValueError(f"parts do not tell {by}")
    own = sessions.select(F.col("id").alias("session_id"), *PROJECTION, "project", "machine_id", "provider", "native_agent_id", "parent_native_id")
    joined = own.join(parts.withColumn("agent_id", F.lit(None).cast("string")), list(_KEYS), "left")
    out = joined.groupBy(F.coalesce(dimension(by), F.lit("")).alias("key")).agg(F.countDistinct("session_id").alias("sessions"), *sums(*_ADDED), F.round(F.sum("cost"), 4).alias("cost"))
    return out.withColumn("coverage", coverage_state(all_tokens(), F.lit(0), F.col("priced_tokens"), F.col("unattributed_tokens")))


# --- verification by digests -----------------------------------------------------------------------------

FANOUT, DEPTH = 16, 2


def _range(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FANOUT**DEPTH)).cast("int")


def write_ranged(frame: DataFrame, path: str, key: str) -> None:
    """Write a table in folders by the ranges of its keys' hashes."""
    frame.withColumn("range", _range(key)).repartition("range").write.mode("overwrite").partitionBy("range").parquet(path)


def digests(ranged: DataFrame) -> DataFrame:
    """(range, n, x, s): the rows of each range by number, exclusive or and sum of two independent hashes of a row."""
    columns = sorted(c for c in ranged.columns if c != "range")
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return ranged.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(row)).alias("x"), F.sum(F.xxhash64(F.lit(7), row).cast("decimal(38,0)")).alias("s"))


def unequal_ranges(left: DataFrame, right: DataFrame) -> tuple[list[int], int]:
    """The ranges whose digests differ, found from the top of the tree, and how many nodes were compared. There are FANOUT ** DEPTH ranges at most."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    nodes, compared = [0], 0
    for level in range(DEPTH + 1):
        width = FANOUT ** (DEPTH - level)
        node = F.floor(F.col("range") / width).cast("int")
        wanted = both if level == 0 else both.where(F.floor(F.col("range") / (width * FANOUT)).cast("int").isin(nodes))
        digest = wanted.groupBy(node.alias("node"), "side").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))
        pair = digest.groupBy("node").agg(*[F.sum(F.when(F.col("side") == 0, F.col(c)).otherwise(-F.col(c))).alias(c) for c in ("n", "s")], F.bit_xor("x").alias("x"))
        rows = pair.collect()  # at most FANOUT nodes for each that differed
        compared += len(rows)
        nodes = sorted(r.node for r in rows if r.n or r.s or r.x)
        if not nodes:
            break
    return nodes, compared


def differences(left: DataFrame, right: DataFrame, key: str, ranges: list[int]) -> DataFrame:
    """(key, state) of the rows of some ranges that only one side has or that differ; keys are unique on each side."""
    values = sorted(c for c in left.columns if c not in (key, "range"))
    side = lambda df, name: df.where(F.col("range").isin(ranges)).select(key, F.struct(*values).alias(name))
    both = side(left, "l").join(side(right, "r"), key, "full").where(~F.col("l").eqNullSafe(F.col("r")))
    return both.select(key, F.when(F.col("l").isNull(), "only-right").when(F.col("r").isNull(), "only-left").otherwise("changed").alias("state"))


@dataclass
class Verification:
    """A comparison of two ranged tables that goes on where it broke off: each step compares some ranges and stores what it found."""

    spark: SparkSession
    left: str
    right: str
    progress: str

    def _done(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("range int, equal boolean").option("recursiveFileLookup", "true").parquet(self.progress)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def left_over(self) -> list[int]:
        done = self._done()
        known = {r.range for r in done.select("range").distinct().collect()} if done is not None else set()
        return [r for r in range(FANOUT**DEPTH) if r not in known]

    def step(self, ranges: int) -> bool:
        """Compare the next ranges, of which only the folders are read; whether any are left."""
        mine = self.left_over()[:ranges]
        if mine:
            own = self.spark.createDataFrame([(r,) for r in mine], "range int")
            sides = [digests(self.spark.read.parquet(p).where(F.col("range").isin(mine))).select("range", F.struct("n", "x", "s").alias(name)) for p, name in ((self.left, "l"), (self.right, "r"))]
            found = own.join(sides[0], "range", "left").join(sides[1], "range", "left").select("range", F.col("l").eqNullSafe(F.col("r")).alias("equal"))
            found.coalesce(1).write.mode("overwrite").parquet(f"{self.progress}/from={mine[0]:06d}")
        return len(self.left_over()) > 0

    def passed(self) -> bool:
        """Whether every range was compared and none differs."""
        done = self._done()
        return done is not None and not self.left_over() and done.where("NOT equal").isEmpty()


def publish_verified(verification: Verification, publish: Callable[[], None]) -> bool:
    """Publish a rebuilt table only after a full pass without a difference."""
    if not verification.passed():
        return False
    publish()
    return True
