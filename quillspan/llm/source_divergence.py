"""Source divergence audit by mergeable radix tries.

Each partition counts its terms in a byte trie for each language. A trie branches on the first PREFIX bytes; below such a
node hang its leaves, the rest of each term in byte order, which is the order of UTF-8, with the number of documents
and a counter for each source. Such a subtree is one row. Tries that have grown to LEAVES counters are written out and
begun anew, so that a task's memory is bounded. Subtrees are merged by prefix range: Spark deals them out by ranges of
(language, prefix) and sorts them, and a task reads its range as a stream, merges the subtrees of one node, which
follow each other, and lets only leaves with enough documents go on. Merged subtrees are subtrees again: of a node with very
many, what has come so far is merged before the rest. A corpus of very many terms takes a longer PREFIX.

The kept leaves are then walked in blocks of at most about BLOCK terms of a language, against tiles of at most TILE of
its sources: a block streams the sums of each pair of sources and its ten best candidates of each source, ties by term.
No language, source or term is held whole by one task. Pairs of sources are the result itself, one row for each.

All arithmetic is exact in 64 bits: 1e9 (c + 2) / (N + 2 V) is divided three decimal digits at a time, exact up to
N + 2 V = 9.2e15; p - q is at most 1e9 + 1.

Defined results: null text, lang and source are ''; a source without terms has counts 0; a language without kept terms
gives its pairs the value 0 and no terms; repeated rows count each; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, settle, small

#: Documents of a language that a kept term is in at least, and candidates of a source that are returned.
LEAST_DOCS = 10
TOP = 10
#: Counters of a task's tries, bytes on which a trie branches, leaves that are merged at a time, and of one node.
LEAVES = 300_000
PREFIX = 3
MERGED, MERGED_NODE = 400_000, 2_000_000
#: Terms of a block, sources of a tile.
BLOCK = 8192
TILE = 256

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of bytes whose A-Z are lower-cased already
_SUBTREE = "lang string, prefix binary, size long, names array<string>, suffixes binary, numbers binary"
_LEAF = "lang string, term string, docs long, sources array<string>, counts array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


class Subtree(NamedTuple):
    """The leaves below a node: their suffixes one after the other, and of each its length, its documents and how many of
    the counters (source, count), which stand in the order of the leaves, are its own. Sources are numbers in names."""

    names: list[str]
    suffixes: bytes
    lengths: np.ndarray
    docs: np.ndarray
    sizes: np.ndarray
    sources: np.ndarray
    counts: np.ndarray

    @classmethod
    def unpack(cls, size: int, names: list[str], suffixes: bytes, numbers: bytes) -> Subtree:
        x = np.frombuffer(numbers, "<i8")
        return cls(names, suffixes, *np.split(x, [size, 2 * size, 3 * size, (len(x) + 3 * size) // 2]))

    def pack(self) -> tuple:
        return len(self.docs), self.names, self.suffixes, np.concatenate(self[2:]).astype("<i8").tobytes()


class Counts:
    """One language's terms: documents of each, and occurrences of each in each source."""

    def __init__(self) -> None:
        self.docs: Counter = Counter()
        self.sources: dict[str, Counter] = {}

    def count(self, source: str, text: bytes) -> None:
        terms = _TERM.findall(text.lower())
        self.docs.update(set(terms))
        self.sources.setdefault(source, Counter()).update(terms)

    @property
    def size(self) -> int:
        return sum(map(len, self.sources.values()))

    def trie(self, depth: int) -> Iterator[tuple[bytes, Subtree]]:
        """The trie's nodes at a depth in byte order, each with its subtree."""
        terms = sorted(self.docs)
        place = dict(zip(terms, range(len(terms))))
        docs = np.fromiter(map(self.docs.__getitem__, terms), np.int64, len(terms))
        names = [s for s, c in self.sources.items() if c]
        leaf = np.fromiter(chain.from_iterable(map(place.__getitem__, self.sources[s]) for s in names), np.int64)
        source = np.repeat(np.arange(len(names)), [len(self.sources[s]) for s in names])
        counts = np.fromiter(chain.from_iterable(self.sources[s].values() for s in names), np.int64)
        order = np.argsort(leaf, kind="stable")
        leaf, source, counts = leaf[order], source[order], counts[order]
        sizes = np.bincount(leaf, minlength=len(terms))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        nodes = [t[:depth] for t in terms]
        cuts = [0, *(k for k in range(1, len(nodes)) if nodes[k] != nodes[k - 1]), len(nodes)] if nodes else [0]
        suffixes = [t[depth:] for t in terms]
        lengths = np.fromiter(map(len, suffixes), np.int64, len(terms))
        for a, b in zip(cuts, cuts[1:]):
            own = slice(ends[a], ends[b])
            yield nodes[a], Subtree(names, b"".join(suffixes[a:b]), lengths[a:b], docs[a:b], sizes[a:b], source[own], counts[own])


def _count(most: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The subtrees of the terms of (lang, source, text); tries with more than so many counters are written out."""
        tries: dict[str, Counts] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in tries.items():
                nodes = counts.trie(depth)
                while some := list(islice(nodes, 2048)):
                    columns = zip(*((lang, node, *subtree.pack()) for node, subtree in some))
                    yield _record_batch(_SUBTREE, columns)
            tries.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                tries.setdefault(lang, Counts()).count(source, text)
            if sum(c.size for c in tries.values()) > most:
                yield from flush()
        yield from flush()

    return run


_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _record_batch(schema: str, columns) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


class _Merged:
    """Subtrees of some nodes as one: node, suffix (a place in the dictionary) and documents of each leaf, and the counters (leaf, source, count)."""

    def __init__(self, nodes: list[int], subtrees: list[Subtree]):
        many = [len(t.docs) for t in subtrees]
        join = lambda k: np.concatenate([t[k] for t in subtrees])
        ends = np.concatenate([[0], np.cumsum(join(2))]).astype(np.int64)
        suffixes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(t.suffixes for t in subtrees))]).dictionary_encode()
        self.dictionary = suffixes.dictionary
        keys = np.repeat(np.array(nodes, np.int64), many) * len(self.dictionary) + suffixes.indices.to_numpy()
        distinct, at = np.unique(keys, return_inverse=True)
        self.node, self.suffix = np.divmod(distinct, max(1, len(self.dictionary)))
        self.docs = np.zeros(len(distinct), np.int64)
        np.add.at(self.docs, at, join(3))
        number: dict[str, int] = {}
        of = [np.array([number.setdefault(n, len(number)) for n in t.names], np.int64)[t.sources] for t in subtrees]
        self.names = list(number)
        self.leaf, self.source, self.count = np.repeat(at, join(4)), np.concatenate(of), join(6)

    def sums(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counters (leaf, source, count) of the wanted leaves, by leaf."""
        some = wanted[self.leaf]
        keys, at = np.unique(self.leaf[some] * max(1, len(self.names)) + self.source[some], return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at, self.count[some])
        return *np.divmod(keys, max(1, len(self.names))), counts

    def subtree(self) -> Subtree:
        """The subtree of the one node there is."""
        leaf, source, counts = self.sums(np.ones(len(self.docs), bool))
        suffixes = self.dictionary.take(pa.array(self.suffix)).to_pylist()
        return Subtree(self.names, b"".join(suffixes), np.array(list(map(len, suffixes)), np.int64), self.docs, np.bincount(leaf, minlength=len(self.docs)), source, counts)

    def kept(self, nodes: list[tuple[str, bytes]], least: int) -> pa.RecordBatch:
        wanted = self.docs >= least
        leaf, source, counts = self.sums(wanted)
        some = np.flatnonzero(wanted)
        ends = pa.array(np.append(np.searchsorted(leaf, some), len(leaf)).astype(np.int32))
        terms = [nodes[n][1] + x for n, x in zip(self.node[some].tolist(), self.dictionary.take(pa.array(self.suffix[some])).to_pylist())]
        names = pa.array(self.names, pa.string()).take(pa.array(source))
        langs = [nodes[n][0] for n in self.node[some].tolist()]
        return _record_batch(_LEAF, [langs, pa.array(terms, pa.binary()).cast(pa.string()), self.docs[some], pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(counts))])


def _merge(least: int, merged: int = MERGED, merged_node: int = MERGED_NODE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaves in enough documents, of subtrees in the order of their nodes."""
        held: list[tuple[tuple, Subtree]] = []

        def close(rows: list) -> Iterator[pa.RecordBatch]:
            if rows:
                nodes = list(dict.fromkeys(node for node, _ in rows))
                number = dict(zip(nodes, range(len(nodes))))
                yield _Merged([number[node] for node, _ in rows], [t for _, t in rows]).kept(nodes, least)

        for batch in batches:
            for lang, node, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(((lang, node), Subtree.unpack(*packed)))
            if sum(len(t.docs) for _, t in held) > merged:
                last = held[-1][0]
                first = next(k for k, (node, _) in enumerate(held) if node == last)
                yield from close(held[:first])
                held = held[first:]
                if sum(len(t.docs) for _, t in held) > merged_node:
                    held = [(last, _Merged([0] * len(held), [t for _, t in held]).subtree())]
        yield from close(held)

    return run


def term_counts(docs: DataFrame, least: int = LEAST_DOCS, leaves: int = LEAVES, prefix: int = PREFIX) -> DataFrame:
    """(lang, term, docs, sources, counts) of the terms in at least so many documents of a language; docs has lang, source, text without nulls."""
    parts = docs.select("lang", "source", F.encode("text", "utf-8").alias("text")).mapInArrow(_count(leaves, prefix), _SUBTREE)
    parts = settle(parts, "tries")  # the ranges are found from the subtrees, not by counting twice
    return parts.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(_merge(least), _LEAF)


def _share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 (count + 2) / whole) without leaving 64 bits."""
    out, rest = np.divmod(count + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return 1 + out


def _block(key: tuple, leaves: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """One block of terms against two tiles of sources: part sums of the pairs and, on the diagonal, the candidates."""
    lang, _, row, column = key
    out: list[tuple] = []
    if len(leaves):
        leaves = leaves.iloc[np.argsort(leaves["term"].str.encode("utf-8").to_numpy(), kind="stable")]
        lengths = leaves["sources"].map(len).to_numpy()
        at = np.repeat(np.arange(len(leaves)), lengths)
        of = np.concatenate(leaves["sources"].to_numpy())
        n = np.concatenate(leaves["counts"].to_numpy()).astype(np.int64)

        def shares(tile: int) -> tuple[list[str], np.ndarray, np.ndarray]:
            own = groups[groups["tile"] == tile].sort_values("no")
            number = {s: i for i, s in enumerate(own["source"])}
            i = np.array([number.get(s, -1) for s in of], np.int64)
            counts = np.zeros((len(own), len(leaves)), np.int64)
            counts[i[i >= 0], at[i >= 0]] = n[i >= 0]
            whole = (own["n"] + 2 * own["v"]).to_numpy(np.int64)
            return list(own["source"]), counts, _share(counts, whole[:, None])

        names, counts, p = shares(row)
        others, _, q = (names, counts, p) if row == column else shares(column)
        for i, name in enumerate(names):
            some = range(i + 1, len(others)) if row == column else range(len(others))
            for j in some:
                gap = p[i] - q[j]
                out.append((lang, name, "pair", others[j], int((gap * gap // (p[i] + q[j])).sum())))
        if row == column:
            totals = np.zeros(len(leaves), np.int64)
            np.add.at(totals, at, n)
            base = _share(totals, np.int64(groups["lang_n"].iloc[0] + 2 * groups["v"].iloc[0]))
            terms = leaves["term"].to_numpy()
            for i, name in enumerate(names):
                more = np.flatnonzero((counts[i] > 0) & (p[i] > base))
                gap = p[i][more] - base[more]
                value = gap * gap // (p[i][more] + base[more])
                for k in np.argsort(-value, kind="stable")[:TOP]:
                    out.append((lang, name, "term", terms[more[k]], int(value[k])))
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def _tiles(row: Column, last: Column) -> Column:
    """Pairs of tiles (row <= column) that a tile is in."""
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(F.least(row, c).alias("i"), F.greatest(row, c).alias("j")))


def divergence(docs: DataFrame, least: int = LEAST_DOCS, block: int = BLOCK, tile: int = TILE, leaves: int = LEAVES) -> DataFrame:
    """lang, source, part, item, value, rank of documents (lang, source, text): how far the sources of a language lie apart, and which terms set one off from its language."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = docs.select(*blank)
    kept = settle(term_counts(docs, least, leaves), "kept-terms")
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "v"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"no": F.row_number().over(by_lang.orderBy("source")) - 1, "lang_n": F.sum("n").over(by_lang)})
    groups = settle(groups.withColumns({"tile": F.floor(F.col("no") / tile).cast("int"), "last": F.floor((F.count("*").over(by_lang) - 1) / tile).cast("int"), "blocks": F.ceil(F.col("v") / block).cast("int")}), "groups")

    langs = groups.where("no = 0 AND blocks > 0").select("lang", "last", "blocks")
    pairs_of = F.flatten(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.transform(F.sequence(i, F.col("last")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    left = kept.join(small(langs), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("t", F.explode(pairs_of))
    right = groups.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("t", F.explode(_tiles(F.col("tile"), F.col("last"))))
    keys = lambda df: df.withColumns({"i": F.col("t.i"), "j": F.col("t.j")}).drop("t").groupBy("lang", "block", "i", "j")
    found = keys(left.drop("docs", "last", "blocks")).cogroup(keys(right.select("lang", "block", "t", "source", "no", "tile", "n", "v", "lang_n")))
    found = settle(found.applyInPandas(_block, _FOUND), "divergence")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    sums = sums.select("lang", both, "part", "value").select("lang", "x.source", "part", "x.item", "value")
    none = groups.where("v = 0").select("lang", "source")
    zero = none.join(none.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    rows = sums.unionByName(zero).unionByName(found.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(f"part = 'pair' OR rank <= {TOP}")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT lang, source, id, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
    g AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
    v AS (SELECT l.lang, l.n, count(k.term) AS v FROM (SELECT lang, sum(n) AS n FROM g GROUP BY lang) l LEFT JOIN k USING (lang) GROUP BY l.lang, l.n),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v)::HUGEINT AS p
        FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (coalesce(sum(c.n), 0) + 2)) // (any_value(v.n) + 2 * any_value(v.v))::HUGEINT AS q
        FROM k JOIN v USING (lang) LEFT JOIN c USING (lang, term) GROUP BY k.lang, k.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
    rows_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
        UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
WHERE part = 'pair' OR rank <= {TOP}
"""
