"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is split by the tokenizer's pattern; each piece is encoded on its own. A piece that is a token
as it stands is that token. Otherwise its bytes are the first tokens, and a segment tree over the byte
positions holds in each node the smallest (rank, position) of the adjacent pairs below it: its root is
the leftmost pair of lowest rank. A merge changes three leaves (the pair's own, its left neighbour's,
and its dead right half), each with a logarithmic number of point updates; live neighbours are a linked
list. Pieces of one length class are merged side by side in numpy, a step of the tree for all at once.

Distinct pieces are encoded once for each worker while they stay in a bounded cache. The rank file is
read on the driver and broadcast: its size is that of a vocabulary, whatever the corpus.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows get equal rows;
an empty table gives an empty result; extra columns are kept by encode() and decode().
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Entries of the cache of encoded pieces in a worker, and characters that are split before a round of merges.
CACHE_PIECES = 250_000
ROUND_CHARS = 400_000
_NONE = np.int64(1) << 62


class Encoder:
    """Ranks of a byte-level BPE vocabulary: pieces to ids and back."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        table = np.array(sorted((a << 32 | b, i) for a, b, i in pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])
        self.cache: dict[str, bytes] = {}
        both = np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)
        self.byte_pairs = self._rank_of(*both)  # by the two bytes

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or _NONE shifted down."""
        if not len(self.pair_keys):
            return np.full(len(left), _NONE >> 32)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE >> 32)

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces whose lengths share a power of two, as little-endian uint32."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows, width = len(pieces), 1 << int(lengths.max() - 1).bit_length()
        columns = np.arange(width + 1)
        inside = columns[None, :] < lengths[:, None]
        token = np.full((rows, width + 1), -1, np.int64)
        byte = np.zeros((rows, width + 1), np.int64)
        byte[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        token[inside] = self.of_byte[byte[inside]]
        after = np.minimum(np.tile(columns + 1, (rows, 1)), lengths[:, None])  # the piece's length stands for "none"
        before = np.tile(columns - 1, (rows, 1))
        tree = np.full((rows, 2 * width), _NONE)
        r, c = np.nonzero(inside[:, 1:])
        tree[r, width + c] = self.byte_pairs[byte[r, c] << 8 | byte[r, c + 1]] << 32 | c
        node = width
        while node > 1:
            node //= 2
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        live = np.arange(rows)
        while True:
            best = tree[live, 1]
            going = best < (_NONE >> 32) << 32
            live, best = live[going], best[going]
            if not len(live):
                break
            at = best & 0xFFFFFFFF
            right = after[live, at]
            beyond, left = after[live, right], before[live, at]
            token[live, at], token[live, right] = best >> 32, -1
            after[live, at], before[live, beyond] = beyond, at
            tree[live, width + right] = _NONE
            has = beyond < lengths[live]
            tree[live, width + at] = np.where(has, self._rank_of(token[live, at], np.where(has, token[live, beyond], 0)) << 32 | at, _NONE)
            has = left >= 0
            l_rows, l_at = live[has], left[has]
            tree[l_rows, width + l_at] = self._rank_of(token[l_rows, l_at], token[l_rows, at[has]]) << 32 | l_at
            for r, leaf in ((live, right), (live, at), (l_rows, l_at)):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                    node >>= 1
        kept = token >= 0
        ends = np.cumsum(kept.sum(axis=1)) * 4
        flat = token[kept].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of the pieces into the cache."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            if (known := self.ranks.get(raw)) is not None:
                self.cache[p] = known.to_bytes(4, "little")
            else:
                classes.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for size, group in classes.items():
            step = max(1, (1 << 19) >> size)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                self.cache.update(zip((p for p, _ in part), self._merge([raw for _, raw in part])))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        rounds, held = [[]], 0
        for t in texts:
            if held > ROUND_CHARS:
                rounds.append([])
                held = 0
            rounds[-1].append(t or "")
            held += len(t or "")
        for some in rounds:
            split = [self.split(t) for t in some]
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            missing = set().union(*split).difference(self.cache)
            if missing:
                self.learn(missing)
            get = self.cache.__getitem__
            out += [b"".join(map(get, pieces)) for pieces in split]
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks, pattern: str) -> Encoder:
    """This worker's encoder for a broadcast rank file."""
    key = (hash(ranks.value), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks.value, pattern)
    return _ENCODERS[key]


def load_ranks(spark: SparkSession, path: str):
    """The rank file as a broadcast; its size is bounded by the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the ids of the text as little-endian uint32 in a binary column."""

    @pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks, pattern)
        for texts in batches:
            yield pd.Series(encoder.encode_all([t if isinstance(t, str) else None for t in texts]), dtype=object)

    return docs.withColumn(to, ids(F.col(text)))


def decode(docs: DataFrame, ranks, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for."""

    @pandas_udf("binary")
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks, pattern)
        for column in batches:
            yield pd.Series([encoder.decode(x) for x in column], dtype=object)

    return docs.withColumn(to, raw(F.col(ids)))


def round_trip(docs: DataFrame, ranks, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids and decoded as encode() and decode() give them, by one Python worker a task instead of two."""

    @pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks, pattern)
        for texts in batches:
            ids = encoder.encode_all([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([encoder.decode(x) for x in ids], dtype=object)})

    coded = docs.withColumn("_c", both(F.col(text)))
    return coded.withColumns({k: F.col("_c")[k] for k in ("ids", "decoded")}).drop("_c")


def token_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    ranks = load_ranks(docs.sparkSession, rank_path)
    coded = round_trip(docs.select("doc_id", "text"), ranks, pattern)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from .common import read

    return token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
