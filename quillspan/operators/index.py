"""An inverted index in Parquet: posting lists in blocks, by bucket of the term's hash.

A block holds a term's documents of one range of ids, so that a frequent term's list lies in many blocks and no task
has it whole: ids in order, counts, lengths and places of the term in each, and beside them the numbers of documents and
words, the largest count and the smallest length, from which the block's best score follows. Ids are stored as what they
are beyond the range's first one, places of all documents as one list. Files are sorted by term, one folder a bucket: a
query reads the folders of its terms, and of their files the row groups that hold them.

What is shuffled for a segment is its documents' texts, by range; a task has some ranges whole, makes their blocks and
sorts them. A range with more than PACKED_WORDS words lies in several blocks a term.

Documents are added in segments, each with its numbers of documents and words; segments are merged block by block. The
list of valid segments is written last and numbered, so that a merge that breaks off leaves the old list.

A document's id belongs to one segment; ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.workers import ship
from quillspan.operators.text import B, K1, search_terms, tokens

BUCKETS, SPAN = 64, 4096
#: Ranges whose documents are scored first to find what a document must reach.
FIRST_RANGES = 4
#: Rarest grams that are intersected for a substring; verification does the rest.
GRAMS = 8
GRAM = 3
_LISTS = ("ids", "counts", "lengths", "places")
#: Words that are packed at a time, a long text's more.
PACKED_WORDS = 1 << 20
#: Bytes of texts whose blocks one task makes, of blocks that one task merges, and of texts for which a task is worth while.
TASK_TEXT, TASK_BLOCKS, LEAST_TEXT = 16 << 20, 128 << 20, 1 << 20
#: Bytes of a block in a task's memory, and of a word in it.
BLOCK_BYTES, WORD_BYTES = 200, 8


def _after(rest: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    """What was held back of earlier batches and a batch, as one."""
    return batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]


def whole_ranges(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Batches of documents (id, terms) in order of id, cut between ranges; inside one only beyond PACKED_WORDS words."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _after(rest, batch)
        where = np.floor_divide(rows.column(0).to_numpy(zero_copy_only=False), span)
        cut = int(np.searchsorted(where, where[-1]))
        last = rows.slice(cut)
        if (pc.sum(pc.list_value_length(last.column(1))).as_py() or 0) >= PACKED_WORDS:
            cut, last = rows.num_rows, None
        if cut:
            yield rows.slice(0, cut)
        rest = last
    if rest is not None:
        yield rest


def packed(batch: pa.RecordBatch, span: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a batch of documents (id, terms): term, range, and the lists of ids, counts, lengths and places."""
    ends = np.cumsum(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    where = np.floor_divide(batch.column(0).to_numpy(zero_copy_only=False), span)
    edges = np.append(np.flatnonzero(where[1:] != where[:-1]) + 1, len(ends))
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PACKED_WORDS, "right")))
        edge = edges[np.searchsorted(edges, end, "right") - 1] if edges[0] <= end else 0
        end = int(edge) if edge > begin else end
        part = batch.slice(begin, end - begin)
        if ends[end - 1] > done:
            yield _packed(part, span)
        begin = end


def _packed(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    if np.any(ids[1:] < ids[:-1]):
        batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
    n = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    words = batch.column(1).flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    code = words.indices.to_numpy(zero_copy_only=False)
    # By term; documents and places are in order already.
    keys = code.astype(np.int64) << 32 | np.arange(len(code))
    keys.sort()
    order = keys & 0xFFFFFFFF
    code, doc = code[order], doc[order]

    def starts(*keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.flatnonzero(new)

    entry = starts(code, doc)
    count = np.diff(np.append(entry, len(doc))).astype(np.int32)
    code, doc = code[entry], doc[entry]
    where = np.floor_divide(ids[doc], span)
    block = starts(code, where)
    offsets = pa.array(np.append(block, len(code)).astype(np.int32))
    places = pa.ListArray.from_arrays(pa.array(np.append(entry, len(order)).astype(np.int32)), pa.array(place[order]))
    lists = [pa.array(ids[doc]), pa.array(count), pa.array(n[doc].astype(np.int32)), places]
    columns = [words.dictionary.take(pa.array(code[block])), pa.array(where[block]), *[pa.ListArray.from_arrays(offsets, x) for x in lists]]
    return pa.RecordBatch.from_arrays(columns, ["term", "range", *_LISTS])


def _lists_of(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _id_type(span: int) -> type:
    return np.int16 if span <= 1 << 15 else np.int32


def narrow(batch: pa.RecordBatch, span: int, lists: tuple[str, ...]) -> pa.RecordBatch:
    """packed() blocks as they are stored: ids beyond the range's first one, places as one list that counts part."""
    columns = dict(zip(batch.schema.names, batch.columns))
    ids, places = columns["ids"], columns["places"]
    first = np.repeat(columns["range"].to_numpy() * span, pc.list_value_length(ids).to_numpy())
    columns["ids"] = _lists_of(ids.offsets.to_numpy(), (ids.values.to_numpy() - first).astype(_id_type(span)))
    columns["places"] = pa.ListArray.from_arrays(places.values.offsets.take(places.offsets), places.values.values)
    return pa.RecordBatch.from_pydict({c: columns[c] for c in ("term", "range", *lists)})


def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of blocks (term, range, ids, counts, places) a row for each document: term, range, its id and its places."""
    term, where, ids, counts, places = batch.columns
    block = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy(zero_copy_only=False)))
    each = _lists_of(np.append(0, np.cumsum(counts.flatten().to_numpy())), places.flatten().to_numpy())
    return pa.RecordBatch.from_arrays([term.take(block), where.take(block), ids.flatten(), each], ["term", "range", "id", "places"])


def _new(batch: pa.RecordBatch) -> np.ndarray:
    """Whether a block (term, range, ...) is of another term or range than the one before."""
    other = lambda c: pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.append(True, other(batch.column(0)) | other(batch.column(1)))


def merged(batches: Iterator[pa.RecordBatch], lists: dict[str, type]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, range, docs, small and large: their lists one after the other in one of these) in order of term and range as blocks (term, range, lists): those of one term and range as one. The last ones of a batch wait for the next."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _after(rest, batch)
        new = _new(rows)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield _merged(rows.slice(0, cut), new[:cut], lists)
        rest = rows.slice(cut)
    if rest is not None:
        yield _merged(rest, _new(rest), lists)


def _each(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, n of them."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _merged(rows: pa.RecordBatch, new: np.ndarray, lists: dict[str, type]) -> pa.RecordBatch:
    docs, first = rows.column(2).to_numpy().astype(np.int64), np.flatnonzero(new)
    own = [rows.column(k).flatten().to_numpy() for k in (3, 4)]
    small, large = (pc.list_value_length(rows.column(k)).to_numpy().astype(np.int64) for k in (3, 4))
    data, size = np.concatenate([x.astype(np.int32) for x in own]), small + large
    begin = np.where(small > 0, np.cumsum(small) - small, len(own[0]) + np.cumsum(large) - large)
    sizes = {c: docs if c != "places" else size - docs * (len(lists) - 1) for c in lists}
    flat = {c: data[_each(begin + docs * k, sizes[c])].astype(kind) for k, (c, kind) in enumerate(lists.items())}
    if not new.all():
        order = np.lexsort((flat["ids"], np.repeat(np.cumsum(new), docs)))
        if "places" in lists:
            n = flat["counts"].astype(np.int64)
            flat["places"] = flat["places"][_each((np.cumsum(n) - n)[order], n[order])]
        flat |= {c: flat[c][order] for c in lists if c != "places"}
    ends = {c: np.append(0, np.cumsum(np.add.reduceat(n, first))) for c, n in sizes.items()}
    keys = [rows.column(k).take(pa.array(first)) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, *[_lists_of(ends[c], v) for c, v in flat.items()]], ["term", "range", *flat])


@dataclass
class Index:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    span: int = SPAN
    #: Without counts, lengths and places: for terms that a document has once, in no order. No phrases and no ranking.
    only_ids: bool = False

    @property
    def _stored(self) -> dict[str, str]:
        kinds = {"ids": "array<smallint>" if _id_type(self.span) is np.int16 else "array<int>"}
        return kinds if self.only_ids else kinds | {c: "array<int>" for c in _LISTS[1:]}

    @property
    def _schema(self) -> str:
        return "term string, range bigint, " + ", ".join(f"{c} {k}" for c, k in self._stored.items())

    # --- writing ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _blocks_of(self, docs: DataFrame) -> DataFrame:
        """Blocks of documents (id, terms) that come in order of id."""
        ship(self.spark)
        span, lists = self.span, tuple(self._stored)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole_ranges(batches, span):
                for blocks in packed(batch, span):
                    yield narrow(blocks, span, lists)

        return docs.select(F.col("id").cast("long").alias("id"), "terms").mapInArrow(pack, self._schema)

    def _write(self, blocks: DataFrame, segment: int) -> None:
        """Write blocks (term, range, lists), each task its own."""
        heads = {"docs": F.size("ids"), "words": F.size("ids" if self.only_ids else "places")}
        if not self.only_ids:
            heads |= {"most": F.array_max("counts"), "shortest": F.array_min("lengths")}
        rows = blocks.withColumns({"bucket": self._bucket()} | heads)
        rows = rows.select("bucket", "term", "range", *heads, *self._stored).sortWithinPartitions("bucket", "term", "range")
        rows.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/blocks/segment={segment}")

    def add(self, docs: DataFrame, segment: int, terms: Column | None = None) -> None:
        """Add documents (id, terms: their words in order) as a new segment; or (id, text) and what makes terms of a text, which is smaller to shuffle."""
        size = F.size("terms") * WORD_BYTES if terms is None else F.octet_length("text")
        found = docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("bytes")).first()
        tasks = max(1, -(-found.bytes // TASK_TEXT), min(self.spark.sparkContext.defaultParallelism, found.bytes // LEAST_TEXT))
        first = F.col("id") - F.pmod(F.col("id"), F.lit(self.span))
        dealt = docs.repartition(int(tasks), first).sortWithinPartitions("id")
        self._write(self._blocks_of(dealt.select("id", F.col("terms") if terms is None else terms.alias("terms"))), segment)
        words = self._read([segment]).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(found.docs, words)], "docs long, words long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment={segment}")
        self._publish([*self.segments(), segment])

    def merge(self, segments: list[int], to: int) -> None:
        """Make one segment of several: blocks of one term and range become one, without reading a text again."""
        ship(self.spark)
        own = self._read(segments)
        found = own.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
        tasks = max(1, -(-(found.blocks * BLOCK_BYTES + found.words * WORD_BYTES) // TASK_BLOCKS))
        # One list a block, of 16 bits where that is enough: most blocks are short.
        data, fits = F.concat(*[F.col(c).cast("array<int>") for c in self._stored]), F.array_max("data") < 1 << 15
        own = own.select("term", "range", "docs", data.alias("data"))
        # Empty and not null: Spark's writer of Arrow batches goes through a run of null lists again for each of its rows.
        parts = {k: F.when(keep, F.col("data").cast(f"array<{t}>")).otherwise(F.array().cast(f"array<{t}>")) for k, keep, t in (("small", fits, "smallint"), ("large", ~fits, "int"))}
        own = own.select("term", "range", "docs", *[c.alias(k) for k, c in parts.items()])
        dealt = own.repartition(tasks, "range").sortWithinPartitions(self._bucket(), "term", "range")
        lists = {c: _id_type(self.span) if c == "ids" else np.int32 for c in self._stored}

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return merged(batches, lists)

        self._write(dealt.mapInArrow(merge, self._schema), to)
        self._stats(segments).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/segment={to}")
        self._publish([*(s for s in self.segments() if s not in segments), to])

    def _publish(self, segments: list[int]) -> None:
        number = self._newest() + 1
        rows = self.spark.createDataFrame([(number, s) for s in segments], "list long, segment long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{number:012d}")

    # --- reading ---

    def _lists(self) -> DataFrame | None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema("list long, segment long").option("recursiveFileLookup", "true").parquet(f"{self.path}/lists")

    def _newest(self) -> int:
        lists = self._lists()
        return (lists.agg(F.max("list")).first()[0] or 0) if lists is not None else 0

    def segments(self) -> list[int]:
        newest = self._newest()
        return sorted(r.segment for r in self._lists().where(F.col("list") == newest).collect()) if newest else []

    def _stats(self, segments: list[int]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/stats/segment={s}" for s in segments])
        return rows.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))

    def _read(self, segments: list[int]) -> DataFrame:
        heads = "docs int, words int" if self.only_ids else "docs int, words int, most int, shortest int"
        rows = self.spark.read.schema(f"{self._schema}, {heads}, bucket int").option("basePath", f"{self.path}/blocks")
        return rows.parquet(*[f"{self.path}/blocks/segment={s}" for s in segments])

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of some terms with their ids whole; only their buckets' folders are listed for reading, and terms are pushed into the scan."""
        rows = self._read(self.segments()).withColumn("ids", F.transform("ids", lambda i: i + F.col("range") * self.span))
        if not terms:
            return rows.limit(0)
        hashes = self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).alias(f"b{i}") for i, t in enumerate(terms)]).first()
        return rows.where(F.col("bucket").isin(sorted(set(hashes))) & F.col("term").isin(terms))

    def documents_with(self, terms: list[str]) -> DataFrame:
        """(range, id) of the documents that have every term: first the ranges that all terms share, by the blocks' heads alone; then the lists of those ranges, the shortest first."""
        rows = self.blocks(terms)
        shared = rows.groupBy("range").agg(F.countDistinct("term").alias("t")).where(F.col("t") == len(terms)).select("range")
        lists = rows.select("term", "range", "ids").join(shared, "range", "left_semi").groupBy("range", "term").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        lists = lists.groupBy("range").agg(F.sort_array(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("l"))
        common = F.aggregate(F.col("l.ids"), F.lit(None).cast("array<bigint>"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.array_intersect(acc, x)))
        return lists.select("range", F.explode(common).alias("id"))

    def documents_any(self, terms: list[str]) -> DataFrame:
        return self.blocks(terms).select("range", F.explode("ids").alias("id")).distinct()

    def with_phrase(self, found: DataFrame, words: list[str]) -> DataFrame:
        """Of found (range, id) the documents in which the words follow each other."""
        ship(self.spark)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return map(placed, batches)

        rows = self.blocks(sorted(set(words))).select("term", "range", "ids", "counts", "places").mapInArrow(place, "term string, range bigint, id bigint, places array<int>")
        offsets = self.spark.createDataFrame([(w, k) for k, w in enumerate(words)], "term string, offset int")  # one row for each word of the query
        begins = F.transform("places", lambda p: p - F.col("offset"))
        rows = rows.join(found, ["range", "id"], "left_semi").join(F.broadcast(offsets), "term").groupBy("range", "id").agg(F.collect_list(begins).alias("b"))
        start = F.aggregate(F.slice("b", 2, len(words)), F.col("b")[0], lambda acc, x: F.array_intersect(acc, x))
        return rows.where((F.size("b") == len(words)) & (F.size(start) > 0)).select("range", "id")

    def search(self, query: str, every: bool = True) -> DataFrame:
        """(id) of the documents that have every term of a query, or any; a quoted phrase must stand as it is."""
        terms = [t.split() for t in search_terms(query)]
        words = sorted({w for t in terms for w in t})
        phrases = [t for t in terms if len(t) > 1]
        if every:
            found = self.documents_with(words)
            for phrase in phrases:
                found = self.with_phrase(found, phrase)
            return found.select("id")
        single = sorted({t[0] for t in terms if len(t) == 1})
        parts = ([self.documents_any(single)] if single else []) + [self.with_phrase(self.documents_with(sorted(set(p))), p) for p in phrases]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("id").distinct()

    def best(self, query: str, limit: int = 5) -> tuple[DataFrame, DataFrame]:
        """The documents (id, score) that fit a query best by BM25, ties by id, and the ranges (range, bound) whose documents had to be scored.

        The bound of a range is the sum of its blocks' best scores. The ranges of the highest bounds are scored first; a
        range whose bound is under the last of their best scores cannot add anything and is not read."""
        words = sorted({w for t in search_terms(query) for w in t.split()})
        rows = self.blocks(words)
        stats = self._stats(self.segments()).first()
        counts = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("docs").alias("df")).collect()}  # a row for each word of the query
        mean = stats.words / stats.docs if stats.docs else 1.0
        idf = {t: math.log(1 + (stats.docs - df + 0.5) / (df + 0.5)) for t, df in counts.items()}
        weight = F.lit(0.0)
        for t, x in idf.items():
            weight = F.when(F.col("term") == t, F.lit(x)).otherwise(weight)

        def score(count: Column, length: Column) -> Column:
            return weight * count * (K1 + 1) / (count + K1 * (1 - B + B * length / F.lit(mean)))

        bounds = rows.groupBy("range", "term").agg(F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        bounds = bounds.groupBy("range").agg(F.sum(score(F.col("most"), F.col("shortest"))).alias("bound"))

        def scored(ranges: DataFrame) -> DataFrame:
            lists = rows.join(ranges.select("range"), "range", "left_semi").select("term", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("x"))
            each = lists.select(F.col("x.ids").alias("id"), score(F.col("x.counts"), F.col("x.lengths")).alias("s")).groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))
            return each.orderBy(F.desc("score"), "id").limit(limit)

        first = scored(bounds.orderBy(F.desc("bound"), "range").limit(FIRST_RANGES)).collect()  # limit rows at most
        least = first[-1].score - 2e-6 if len(first) == limit else -1.0
        ranges = bounds.where(F.col("bound") >= least)
        return scored(ranges), ranges


def text_index(spark: SparkSession, path: str, docs: DataFrame, **options: int) -> Index:
    """An index of documents (id, text) by their words, as a first segment."""
    index = Index(spark, path, **options)
    index.add(docs.select("id", "text"), 1, tokens(F.col("text")))
    return index


# --- substrings ---------------------------------------------------------------------------------------


def grams(text: Column) -> Column:
    """The distinct grams of a text that is folded already."""
    n = F.length(text)
    places = F.when(n >= GRAM, F.sequence(F.lit(1), n - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def gram_index(spark: SparkSession, path: str, rows: DataFrame, **options: int) -> Index:
    """An index of rows (id, text: folded) by their grams."""
    index = Index(spark, path, only_ids=True, **options)
    index.add(rows.select("id", "text"), 1, grams(F.col("text")))
    return index


def containing(index: Index, rows: DataFrame, text: Column, part: str) -> DataFrame:
    """The rows (id, ...) whose folded text contains a part: candidates by its rarest grams, then the texts themselves. A part shorter than a gram is looked for in all."""
    part = part.lower()
    own = sorted({part[i : i + GRAM] for i in range(len(part) - GRAM + 1)})
    if own:
        counts = {r.term: r.df for r in index.blocks(own).groupBy("term").agg(F.sum("docs").alias("df")).collect()}  # a row for each gram of the part
        if len(counts) < len(own):
            return rows.limit(0)
        rows = rows.join(index.documents_with(sorted(own, key=lambda g: (counts[g], g))[:GRAMS]).select("id"), "id", "left_semi")
    return rows.where(text.contains(part))
