"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cover the same bytes. np.repeat of the token indices over the tokens' byte lengths gives for each
byte its owner in A and in B: consecutive distinct owner pairs are the overlaps, simultaneous changes of owner the cuts.

Both tokenizers are run on stretches of a text that neither merges across: a stretch ends before a space that follows
a character that is no white space. A's pattern starts a match there, and B has no piece with such a space inside,
which is looked up in its vocabulary (else texts stay whole). Both have a token boundary there, thus a cut, so that a
text's groups are its stretches' groups one after the other. Stretches of up to LONG characters stay in a bounded cache.

Counts over the corpus: each text keeps its distinct id pairs with their number, written to the shared folder once.
Pairs are counted with partial sums before the shuffle. The counts come back by a broadcast of the FREQUENT most
frequent pairs, which is bounded whatever the corpus, and for all rarer pairs by a join on the pair.

Defined results: a text that is null or empty, or whose tokens do not give back its bytes (A's merges without a byte,
B's reading of U+2581 as a space), has no tokens: all numbers 0, groups ''. Repeated rows get equal rows and count
once each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle

#: Entries of a worker's cache of stretches, and the longest stretch that is kept there.
CACHE_STRETCHES = 120_000
LONG = 48
#: Stretches that are encoded as one text.
RUN = 256
#: Id pairs that are sent to every executor.
FREQUENT = 1 << 18

_ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, a array<int>, b array<int>, n array<int>"
_EMPTY = (0, 0, 0, 0, "", np.zeros(0, np.int64))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others for 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Two tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte_of = _byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        apart = not any(re.search(r"\S ", p.replace("▁", " ")) for p in pieces)
        self.cut = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*").findall if apart else lambda text: [text]
        ids = range(max(len(self.a_bytes), len(pieces)))
        self.width = len(ids)
        self.marked = [f"{mark}{i}" for mark in ",;|" for i in ids]
        self.fresh: dict[str, tuple] = {}  # the cache: stretches of late, and those before them
        self.old: dict[str, tuple] = {}

    def _encode(self, runs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that start with a space."""
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in runs], num_threads=1)  # B adds the space itself
        return a, [[self.blank] if s == " " else ids for s, ids in zip(runs, b)]

    def align(self, stretches: list[str]) -> list[tuple | None]:
        """(n_a << 32 | n_b, groups each after a semicolon, id pairs of the links as int64) of each stretch; None where bytes differ.

        Stretches are encoded by runs, since a space after a character that is no white space parts them again."""
        runs: list[list[str]] = [[]]
        for s in stretches:
            if len(runs[-1]) >= RUN or runs[-1] and runs[-1][-1][-1].isspace():
                runs.append([])
            runs[-1].append(s)
        found = dict(self._runs([r for r in runs if r]))
        return [found.get(s) for s in stretches]

    def _runs(self, runs: list[list[str]]) -> Iterator[tuple[str, tuple]]:
        if not runs:
            return
        texts = list(map("".join, runs))
        a, b = self._encode(texts)
        whole = [b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == t.encode() for x, y, t in zip(a, b, texts)]
        yield from self._runs([[s] for run, good in zip(runs, whole) if not good and len(run) > 1 for s in run])
        kept = [k for k, good in enumerate(whole) if good]
        if not kept:
            return
        own = [s for k in kept for s in runs[k]]
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x[k] for k in kept), np.int64) for x in (a, b))
        owner_a, owner_b = np.repeat(np.arange(len(flat_a)), self.a_len[flat_a]), np.repeat(np.arange(len(flat_b)), self.b_len[flat_b])
        new_a, new_b = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (owner_a, owner_b))
        link, cuts = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        pairs = (flat_a[owner_a[link]] << 32 | flat_b[owner_b[link]]).tobytes()
        first = np.concatenate([[0], np.cumsum([len(s.encode()) for s in own])])
        link_at, cut_at = (8 * np.searchsorted(link, first)).tolist(), np.searchsorted(cuts, first)
        a_at, b_at = np.append(owner_a[cuts], len(flat_a)), np.append(owner_b[cuts], len(flat_b))
        # The ids in the order of the groups, A's before B's in each, each with the mark before it.
        group_a, group_b = (np.repeat(np.arange(len(cuts)), np.diff(x)) for x in (a_at, b_at))
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[np.arange(len(flat_a)) + b_at[group_a]] = flat_a + self.width * np.isin(np.arange(len(flat_a)), a_at)
        codes[np.arange(len(flat_b)) + a_at[group_b + 1]] = flat_b + 2 * self.width * np.isin(np.arange(len(flat_b)), b_at)
        shown = list(map(self.marked.__getitem__, codes.tolist()))
        text_at, number = (a_at + b_at)[cut_at].tolist(), (a_at << 32 | b_at)[cut_at]
        for s, n, p, q, x, y in zip(own, np.diff(number).tolist(), text_at, text_at[1:], link_at, link_at[1:]):
            yield s, (n, "".join(shown[p:q]), pairs[x:y])

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """The whole texts' numbers, groups and link pairs."""
        split = [self.cut(" " + t) if t else [] for t in texts]
        if len(self.fresh) > CACHE_STRETCHES:
            self.fresh, self.old = {}, self.fresh
        wanted = set().union(*split) - self.fresh.keys()
        again = wanted & self.old.keys()
        self.fresh.update((s, self.old[s]) for s in again)
        missing = list(wanted - again)
        here = dict(zip(missing, self.align(missing)))
        self.fresh.update((s, x) for s, x in here.items() if len(s) <= LONG)
        long = {s: x for s, x in here.items() if len(s) > LONG}
        find = self.fresh.__getitem__ if not long else lambda s: long[s] if s in long else self.fresh[s]
        out = []
        for some in split:
            parts = list(map(find, some))
            if not parts or None in parts:
                out.append(_EMPTY)
                continue
            n, groups, pairs = zip(*parts)
            total, raw = sum(n), b"".join(pairs)
            groups = "".join(groups)[1:]
            out.append((total >> 32, total & 0xFFFFFFFF, groups.count("|"), len(raw) // 8, groups, np.frombuffer(raw, np.int64)))
        return out


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(files) -> Aligner:
    """This worker's tokenizers for broadcast vocabulary files."""
    key = hash(files.value)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*files.value)
    return _ALIGNERS[key]


def load_files(spark: SparkSession, a_path: str, b_path: str):
    """Both vocabulary files as a broadcast; their size is bounded by the vocabularies."""
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
    return spark.sparkContext.broadcast(tuple(contents))


def aligned(docs: DataFrame, files, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row its id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2`), and its distinct linked ids a and b with the number n of such links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for batch in batches:
            n_a, n_b, n_groups, n_links, groups, pairs = zip(*aligner.texts(batch.column(1).to_pylist())) if batch.num_rows else [()] * 6
            distinct = [np.unique(p, return_counts=True) for p in pairs]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in distinct])]).astype(np.int32))
            keys, counts = (np.concatenate([np.zeros(0, np.int64), *[d[i] for d in distinct]]) for i in (0, 1))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys >> 32, keys & 0xFFFFFFFF, counts)]
            numbers = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(groups, pa.string()), *lists], names=[x.split()[0] for x in _ALIGNED.split(", ")])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, texts, best): how many rows hold an id pair linked, and whether no pair of the same A id is held by more."""
    counts = settle(links.groupBy("a", "b").agg(F.count("*").alias("texts")), "pairs")
    most = counts.groupBy("a").agg(F.max("texts").alias("most"))
    return counts.join(most, "a").select("a", "b", "texts", (F.col("texts") == F.col("most")).alias("best"))


def with_corpus_counts(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows of aligned() under a number of their own (row), settled, with n_best and count_sum over the whole table in place of their lists."""
    links = rows.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("l")).select("row", "l.a", "l.b", "l.n")
    counts = settle(pair_counts(links), "pair-counts")
    each = ["row", F.when(F.col("best"), F.col("n")).otherwise(0).cast("long").alias("best"), (F.col("n") * F.col("texts")).alias("all")]
    if counts.count() <= frequent:
        found = links.join(F.broadcast(counts), ["a", "b"]).select(*each)
    else:
        top = settle(counts.orderBy(F.desc("texts"), "a", "b").limit(frequent), "pair-top")
        near = links.join(F.broadcast(top), ["a", "b"], "left")
        far = near.where("texts IS NULL").drop("texts", "best").join(counts, ["a", "b"])
        found = near.where("texts IS NOT NULL").select(*each).unionByName(far.select(*each))
    sums = found.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("all").alias("count_sum"))
    return rows.drop("a", "b", "n").join(sums, "row", "left").drop("row").na.fill(0, ["n_best", "count_sum"])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = load_files(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = aligned(read(spark, sf_dir, "documents"), files)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.encode("groups", "utf-8"), 256)).alias("groups_sha256")
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest, "a", "b", "n"), "aligned")
    return with_corpus_counts(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
