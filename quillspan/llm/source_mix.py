"""Mixing sources to target weights [native]: Sainte-Lague apportionment of equal-token blocks.

Sources in code point order, null last, weigh 3, 1, 2 and so on, and share ``share`` of all words; a
target stops at ``most`` times its source's size and the excess is shared again by weight until none is
above. The targets are votes: blocks of ``block`` words go to the highest quotients votes / (2 k - 1),
ties to the earlier source. A source's documents are dealt into shards by a seeded hash, and its blocks
are apportioned by their words in the same way to bundles of ``bundle`` shards, and a bundle's to its shards. Inside a
shard the documents stand in a seeded order and form one stream of words, cut into blocks. A quota of a whole stream or
more takes all of it, once or twice; of the rest, the blocks with the smallest seeded hashes are selected, exactly as many as
the quota has. A shard's row keeps the last hash that is selected, so that each document can tell its own blocks.

Shards have about ``shard_words`` words however large a source is, so no window holds more than one shard's documents, one
bundle's shards or one source's bundles. Of the quotients only those are made that can be among the last seats, about
three for each source, bundle or shard: divisors n / 2 seats above and below bracket the result. The level of the
targets is found by rounds over the sources, each one sum: sources above their cap leave, and the rest share what is left.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source; repeated
rows are taken one by one; a null doc_id hashes as the empty text; an empty table gives an empty result;
extra columns are kept by ``mix`` and must not begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, read, settle, words

#: Fixed weights of the sources in order.
WEIGHTS = (3, 1, 2)
SHARE, MOST, BLOCK, SHARD_WORDS, BUNDLE, SEED = 1.5, 2, 64, 65536, 2048, "mix-1"


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col("source")))


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """_source, source_size, target of each source in sized (source, size)."""
    sources = sized.groupBy(_source_key().alias("_source")).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy("_source")) - 1) % len(weights) + 1)
    sources = settle(sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most), "mix-weights")
    level = None
    while True:
        below = F.lit(True) if level is None else F.col("_w") * level <= F.col("_cap")
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(below, F.col("_w"))).alias("w"), F.coalesce(F.sum(F.when(~below, F.col("_cap"))), F.lit(0)).alias("full")).first()
        reached = (row.all * share - row.full) / row.w if row.w else level  # sums of whole numbers: exact, in any order
        if reached == level:
            break
        level = reached
    cap = F.col("_cap").cast("double")
    return sources.select("_source", "source_size", (cap if level is None else F.least(F.col("_w") * level, cap)).alias("target"))


def apportion(parts: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """parts with _seats: each group's seats by highest quotients votes / (2 k - 1), ties to the smaller key."""
    own = Window.partitionBy(*group)
    v, n, total, all_seats = F.col(votes).cast("double"), F.count("*").over(own), F.sum(F.col(votes).cast("double")).over(own), F.col(seats).cast("double")
    bounds = parts.where(F.col(votes) > 0).withColumn("_n", n).withColumn("_v", total)
    least = F.greatest(F.lit(0), F.floor(v * (all_seats - F.col("_n") / 2) / F.col("_v") + 0.5) - 1)
    most = F.floor(v * (all_seats + F.col("_n") / 2) / F.col("_v") + 0.5) + 1
    bounds = bounds.withColumn("_sure", least.cast("long")).withColumn("_most", F.greatest(most.cast("long"), F.col("_sure") + 1))
    bounds = bounds.withColumn("_open", F.col(seats) - F.sum("_sure").over(own))
    quotients = bounds.select(*group, key, "_open", v.alias("_q"), F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    ranked = quotients.withColumn("_r", F.row_number().over(own.orderBy(F.desc(F.col("_q") / (2 * F.col("_k") - 1)), key)))
    more = ranked.where(F.col("_r") <= F.col("_open")).groupBy(*group, key).agg(F.count("*").alias("_more"))
    out = bounds.join(more, [*group, key], "left").withColumn("_seats", F.col("_sure") + F.coalesce("_more", F.lit(0)))
    return out.select(*parts.columns, "_seats")


def quotas(sized: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shard_words=SHARD_WORDS, bundle=BUNDLE, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, shards) for sized (doc_id, source, size): targets and shard counts; of each shard its words, its quota and the last hash of its selected blocks."""
    sources = targets(sized, weights, share, most).withColumn("_all", F.lit(0))
    sources = sources.withColumn("_blocks", F.round(F.sum("target").over(Window.partitionBy("_all")) / block).cast("long"))
    blocks = apportion(sources, ["_all"], "_source", "target", "_blocks").select("_source", "_seats")
    shards_of = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    sources = sources.select("_source", "source_size", "target", shards_of.alias("_shards")).join(blocks, "_source", "left").fillna({"_seats": 0})
    sources = settle(sources, "mix-sources")
    parts = _with_shard(sized, sources, seed).groupBy("_source", "_shard").agg(F.sum("size").alias("_words"), F.first("_seats").alias("_blocks"))
    parts = settle(parts.withColumn("_bundle", F.floor(F.col("_shard") / bundle).cast("long")), "mix-parts")
    bundles = parts.groupBy("_source", "_bundle").agg(F.sum("_words").alias("_words"), F.first("_blocks").alias("_blocks"))
    bundles = apportion(bundles, ["_source"], "_bundle", "_words", "_blocks").select("_source", "_bundle", F.col("_seats").alias("_blocks"))
    shards = apportion(parts.drop("_blocks").join(bundles, ["_source", "_bundle"]), ["_source", "_bundle"], "_shard", "_words", "_blocks")
    shards = shards.withColumn("_quota", F.least(F.col("_seats") * block, F.col("_words") * most))
    wanted = F.round((F.col("_quota") % F.col("_words")) / block).cast("int")
    hashes = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_words") / block).cast("long") - 1), lambda b: _block_hash(b, seed))
    last = F.when(wanted > 0, F.get(F.sort_array(hashes), wanted - 1))
    return sources, settle(shards.select("_source", "_shard", "_words", "_quota", last.alias("_last")), "mix-shards")


def _with_shard(sized: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """Sources are few beside documents; as the join's smaller side they are not shuffled with a hot key."""
    out = sized.withColumn("_source", _source_key()).withColumn("_h", _hash(seed)).join(sources, "_source")
    return out.withColumn("_shard", F.pmod(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"), F.col("_shards")))


def _block_hash(b: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.col("_source"), F.lit(":"), F.col("_shard").cast("string"), F.lit(":"), b.cast("string")))


def _selected(block: int = BLOCK, seed: str = SEED) -> Column:
    """The blocks of its shard's stream that a document with _start, _end and _last shares with the selection."""
    own = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))
    mine = F.filter(own, lambda b: _block_hash(b, seed) <= F.col("_last"))
    return F.when((F.col("_end") > F.col("_start")) & F.col("_last").isNotNull(), mine).otherwise(F.array().cast("array<bigint>"))


def mix(sized: DataFrame, sources: DataFrame, shards: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """sized (doc_id, source, size and more) with source_size, target, taken, _passes (over the whole document) and _spans: the
    word ranges (at, n) of the selected blocks."""
    dealt = _with_shard(sized, sources, seed).join(shards, ["_source", "_shard"], "left")
    upto = Window.partitionBy("_source", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_end", F.sum("size").over(upto)).withColumn("_start", F.col("_end") - F.col("size"))
    at = lambda b: F.greatest(F.col("_start"), b * block)
    spans = F.transform(_selected(block, seed), lambda b: F.struct((at(b) - F.col("_start")).alias("at"), (F.least(F.col("_end"), (b + 1) * block) - at(b)).alias("n")))
    dealt = dealt.withColumns({"_passes": F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(0).cast("long"), "_spans": spans})
    part = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return dealt.withColumn("taken", (F.col("_passes") * F.col("size") + part).cast("long")).select(*sized.columns, "source_size", "target", "taken", "_passes", "_spans")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them, in their own columns: a row for each whole pass over a
    document, and one with its selected blocks, spacing and lines as they stand and a line break where blocks are apart; those that it never takes go."""
    sized = with_size(docs)
    plan = quotas(settle(sized.select("doc_id", "source", "size"), "mix-sizes"))
    taken = mix(sized, *plan).where("taken > 0")
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_passes")), lambda _: F.array().cast("array<struct<at:bigint,n:bigint>>"))
    whole = F.when(F.col("_passes") > 0, whole).otherwise(F.array().cast("array<array<struct<at:bigint,n:bigint>>>"))
    takes = F.concat(whole, F.when(F.size("_spans") > 0, F.array("_spans")).otherwise(F.array().cast("array<array<struct<at:bigint,n:bigint>>>")))
    passes = taken.withColumn("_take", F.explode(takes))
    pieces = F.regexp_extract_all("text", F.lit(SPACE.replace("+", "*") + WORD), F.lit(0))
    words_of = lambda w, x: F.array_join(F.slice(w, (x["at"] + 1).cast("int"), x["n"].cast("int")), "")

    def block(w: Column, x: Column, i: Column) -> Column:
        before = F.get("_take", i - 1)
        apart = (i > 0) & (before["at"] + before["n"] != x["at"])
        return F.when(apart, F.concat(F.lit("\n"), F.regexp_replace(words_of(w, x), "^" + SPACE, ""))).otherwise(words_of(w, x))

    cut = let(pieces, lambda w: F.array_join(F.transform("_take", lambda x, i: block(w, x, i)), ""))
    text = F.when(F.size("_take") == 0, F.col("text")).otherwise(F.regexp_replace(cut, "^" + SPACE, ""))
    passes = passes.withColumn("text", text)
    return (passes.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else passes).select(*docs.columns)


def op5(spark, sf_dir) -> DataFrame:
    sized = with_size(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    sized = settle(sized, "mix-sizes")
    return mix(sized, *quotas(sized)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS s, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY s) - 1) % 3 + 1] AS w FROM d GROUP BY s),
rounds AS (
    SELECT 0 AS i, s, CAST(w AS DOUBLE) AS w, source_size, false AS at_cap, 1.5 * (sum(source_size) OVER ()) / (sum(CAST(w AS DOUBLE)) OVER ()) AS level FROM src
    UNION ALL
    SELECT i + 1, s, w, source_size, f, CASE WHEN count(*) FILTER (WHERE NOT f) OVER () = 0 THEN level ELSE
        (1.5 * (sum(source_size) OVER ()) - coalesce(sum(2 * source_size) FILTER (WHERE f) OVER (), 0)) / (sum(w) FILTER (WHERE NOT f) OVER ()) END
    FROM (SELECT *, at_cap OR level * w > 2 * source_size AS f FROM rounds WHERE i < 60)),
t AS (SELECT s, source_size, CASE WHEN at_cap THEN CAST(2 * source_size AS DOUBLE) ELSE least(level * w, CAST(2 * source_size AS DOUBLE)) END AS target,
    greatest(1, CAST(ceil(source_size / {SHARD_WORDS}) AS BIGINT)) AS shards FROM rounds WHERE i = 60),
q AS (SELECT s, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, s) AS r, round((SELECT sum(target) FROM t) / {BLOCK}) AS seats
    FROM (SELECT s, target, unnest(range(1, CAST(target / {BLOCK} AS BIGINT) + 3)) AS k FROM t WHERE target > 0)),
b AS (SELECT t.*, coalesce(c, 0) AS blocks FROM t LEFT JOIN (SELECT s, count(*) AS c FROM q WHERE r <= seats GROUP BY s) USING (s)),
e AS (SELECT d.*, source_size, target, blocks, CAST('0x' || substr(h, 1, 15) AS BIGINT) % shards AS shard FROM d JOIN b USING (s)),
p0 AS (SELECT s, shard, shard // {BUNDLE} AS bundle, CAST(sum(size) AS BIGINT) AS words, max(blocks) AS blocks FROM e GROUP BY s, shard),
u AS (SELECT s, bundle, sum(words) AS words, max(blocks) AS blocks FROM p0 GROUP BY s, bundle),
uq AS (SELECT s, bundle, blocks, row_number() OVER (PARTITION BY s ORDER BY words / (2 * k - 1) DESC, bundle) AS r FROM (SELECT s, bundle, words, blocks, unnest(range(1, blocks + 3)) AS k FROM u WHERE words > 0)),
ub AS (SELECT s, bundle, count(*) AS blocks FROM uq WHERE r <= blocks GROUP BY s, bundle),
p AS (SELECT p0.s, p0.shard, p0.bundle, p0.words, coalesce(ub.blocks, 0) AS blocks FROM p0 LEFT JOIN ub USING (s, bundle)),
pq AS (SELECT s, shard, blocks, row_number() OVER (PARTITION BY s, bundle ORDER BY words / (2 * k - 1) DESC, shard) AS r
    FROM (SELECT s, shard, bundle, words, blocks, unnest(range(1, blocks + 3)) AS k FROM p WHERE words > 0)),
z AS (SELECT p.s, p.shard, p.words, least({BLOCK} * coalesce(c, 0), 2 * p.words) AS quota FROM p LEFT JOIN (SELECT s, shard, count(*) AS c FROM pq WHERE r <= blocks GROUP BY s, shard) USING (s, shard)),
f AS (SELECT e.*, words, quota, sum(size) OVER (PARTITION BY e.s, e.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin FROM e JOIN z ON e.s = z.s AND e.shard = z.shard),
y AS (SELECT *, CASE WHEN words > 0 AND round((quota % words) / {BLOCK}) > 0 THEN
    list_sort(list_transform(range(CAST(ceil(words / {BLOCK}) AS BIGINT)), lambda b: md5('{SEED}:' || s || ':' || shard || ':' || b)))[CAST(round((quota % words) / {BLOCK}) AS BIGINT)] END AS last FROM z),
g AS (SELECT f.*, y.last FROM f JOIN y ON f.s = y.s AND f.shard = y.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN words = 0 THEN 0 ELSE (quota // words) * size + CASE WHEN size = 0 OR last IS NULL THEN 0 ELSE coalesce(list_sum(list_transform(
    list_filter(range(CAST((fin - size) // {BLOCK} AS BIGINT), CAST((fin - 1) // {BLOCK} + 1 AS BIGINT)), lambda b: md5('{SEED}:' || s || ':' || shard || ':' || b) <= last),
    lambda b: least(fin, (b + 1) * {BLOCK}) - greatest(fin - size, b * {BLOCK}))), 0) END END AS BIGINT) AS taken FROM g
"""
