"""Document fingerprints by consistent weighted sampling.

A text is a bag of its lower-cased words, weighted by how often each occurs. Sample k draws for every
term, from a hash of the term and k alone, r and c from Gamma(2, 1) and beta from [0, 1), and keeps the
term with the smallest c / exp(r * (t - beta + 1)), where t = floor(ln(weight) / r + beta). The pair
(term, t) is the sample; two texts agree in a sample with a probability equal to their generalised
Jaccard similarity, sum of min weights / sum of max weights. A fingerprint is SAMPLES samples of 16
hashed bits in hex; ``likeness`` is the share that agrees, less chance hits.

Each text is compared with the next one in falling doc_id. That order is made by cutting the ids at
quantiles into buckets (the driver holds one number a bucket), one shuffle of the texts by bucket,
and a sorted scan of each bucket that ends in a copy of the next bucket's first row.

Defined results: a null text is empty; an empty bag has the fingerprint of a term of its own, so empty
texts are alike and like nothing else; a null doc_id sorts last; rows of one doc_id go by falling text;
a single row is its own next; repeated rows stay; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import mix, read, settle, small

SAMPLES = 128
#: Weighted terms whose draws a worker keeps; 6 bytes a sample each.
CACHE_TERMS = 100_000
_LOWEST = -(2**63)
#: Bytes of text for which a partition is made, and buckets that the driver holds cuts for.
PARTITION_BYTES, MAX_BUCKETS = 16 << 20, 100_000


class Sampler:
    """Consistent weighted samples of bags of words."""

    def __init__(self, samples: int = SAMPLES, cache_terms: int = CACHE_TERMS):
        self.samples, self.cache_terms = samples, cache_terms
        self.salt = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._reset(1024)

    def _reset(self, rows: int) -> None:
        self.row: dict[tuple[bytes, int], int] = {}
        self.height = np.empty((rows, self.samples), np.float32)
        self.code = np.empty((rows, self.samples), np.uint16)

    def draws(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln of what is minimised, and the 16 bits of (term, t), for each term and sample."""
        h = mix(term[:, None] ^ self.salt[None, :])
        g = mix(h + np.uint64(0x9E3779B97F4A7C15))
        unit = lambda x, bits: ((x & np.uint64((1 << bits) - 1)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << bits)
        c = -(np.log(unit(h, 32)) + np.log(unit(h >> np.uint64(32), 32)))
        r = -(np.log(unit(g, 24)) + np.log(unit(g >> np.uint64(24), 24)))
        beta = unit(g >> np.uint64(48), 16)
        r = np.maximum(r, np.float32(1e-6))
        t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + beta)
        code = mix(h ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(48)
        return np.log(np.maximum(c, np.float32(1e-30))) - r * (t - beta + 1), code.astype(np.uint16)

    def _learn(self, new: list[tuple[bytes, int]]) -> None:
        start = len(self.row)
        if start + len(new) > len(self.height):
            rows = max(2 * len(self.height), start + len(new))
            for name in ("height", "code"):
                grown = np.empty((rows, self.samples), getattr(self, name).dtype)
                grown[:start] = getattr(self, name)[:start]
                setattr(self, name, grown)
        for k in range(0, len(new), 2048):
            part = new[k : k + 2048]
            term = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w, _ in part], np.uint64)
            rows = slice(start + k, start + k + len(part))
            self.height[rows], self.code[rows] = self.draws(term, np.array([n for _, n in part]))
        self.row.update(zip(new, range(start, start + len(new))))

    def fingerprint(self, text: str) -> np.ndarray:
        terms = list(Counter(text.lower().encode("utf-8", "surrogatepass").split()).items()) or [(b"", 1)]
        if len(self.row) > self.cache_terms:
            self._reset(len(self.height) if len(self.height) <= 2 * self.cache_terms else 1024)
        if new := [x for x in terms if x not in self.row]:
            self._learn(new)
        rows = np.array([self.row[x] for x in terms])
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint16)
        order = np.arange(self.samples)
        for k in range(0, len(rows), 4096):
            part = rows[k : k + 4096]
            heights = self.height[part]
            least = heights.argmin(axis=0)
            low = heights[least, order]
            won = low < best
            best[won], out[won] = low[won], self.code[part[least[won]], order[won]]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    chance = 1 / 65536
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def as_hex(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


_SAMPLERS: dict[int, Sampler] = {}


def sampler(samples: int = SAMPLES) -> Sampler:
    """This worker's sampler, with its cache."""
    return _SAMPLERS.setdefault(samples, Sampler(samples))


def fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """docs with the fingerprint of a text column."""

    @pandas_udf("string")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([as_hex(sampler(samples).fingerprint(t if isinstance(t, str) else "")) for t in texts])

    return docs.withColumn(to, prints(F.col(text)))


def edited_text(text: str, following: str) -> str:
    """text with its last third replaced by as much of the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next text."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(_LOWEST)).alias("_key"))
    # As many buckets as the texts' bytes need, and several for each partition, so that long texts even out.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return spark.createDataFrame([], _SCHEMA)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    buckets = min(8 * partitions, MAX_BUCKETS)
    quantiles = [i / buckets for i in range(1, buckets)]
    cuts = np.array(sorted(set(rows.select(F.percentile_approx("_key", quantiles, 100_000)).first()[0] or [])), np.int64)

    @pandas_udf("long")
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, keys.to_numpy()))  # 0 has the largest ids

    rows = rows.withColumn("_bucket", bucket_of("_key"))
    # A bucket ends with the first row of the next one; the last bucket with that of the first. One row a bucket.
    firsts = settle(rows.groupBy("_bucket").agg(F.max("_key").alias("_key")), "bucket-ends")
    order = Window.orderBy("_bucket")
    before = F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(Window.partitionBy()))
    ends = rows.drop("_bucket").join(small(firsts.withColumn("_bucket", before)), "_key").groupBy("_key", "_bucket").agg(F.max("text").alias("text"))
    ends = ends.select("text", "_key", "_bucket", F.lit(1).alias("_end"))
    dealt = rows.drop("doc_id").withColumn("_end", F.lit(0)).unionByName(ends).repartition(partitions, "_bucket")
    dealt = dealt.sortWithinPartitions("_bucket", "_end", F.desc("_key"), F.desc("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, held, out = sampler(samples), None, []
        for batch in batches:
            for key, text, bucket, end in zip(batch["_key"], batch["text"], batch["_bucket"], batch["_end"]):
                own = make.fingerprint(text)
                if held is not None and held[2] == bucket:
                    i, t, _, f = held
                    edited = edited_text(t, text)
                    e = make.fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((i, len(t), sha, as_hex(f), as_hex(e), likeness(f, e), likeness(f, own)))
                held = None if end else (key, text, bucket, own)
                if len(out) >= 512:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    return dealt.select("_key", "text", "_bucket", "_end").mapInPandas(scan, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _SCHEMA.split(", ")])
    frame["doc_id"] = pd.array([None if x == _LOWEST else int(x) for x in frame["doc_id"]], "Int64")
    return frame


def op2(spark, sf_dir) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
