"""Language ID by rank-order profiles: out-of-place distance of frequent n-grams.

A text is lower-cased and cut into words of letters, padded with a blank on both sides; its n-grams are
the runs of one to three characters inside a padded word. A language's profile ranks the most frequent
n-grams of all its training texts. A text's own most frequent n-grams are ranked the same way, and its
distance to a profile is the sum of rank differences, an n-gram that the profile lacks costing the
profile's full length. The nearest profile wins; ties go to the smaller language name.

Training counts cover all training rows: tasks count in numpy, Spark adds up, and the driver gets
profile_size rows for each language (the languages are the distinct values of a label column; more
than max_languages is an error). ``score`` is 1 - distance / largest possible distance.

Defined results: a text that is null or has no letters, or any text where nothing could be learned, is
``und`` with score 0; rows with a null lang teach nothing; a null doc_id counts as the empty text in
the held-out rule; repeated rows teach once each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

PROFILE_SIZE = 300
MAX_LANGUAGES = 1000
#: A pipeline drops texts below this score whatever was learned: hardly any of their n-grams are in the nearest profile.
LEAST_SCORE = 0.1


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text as numbers, three code points of 21 bits each."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, np.int64)
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    c = np.concatenate([[0], c, [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one blank between words
    if len(c) < 3:
        return np.zeros(0, np.int64)
    one = c[1:-1]
    d = np.maximum(c, 1)  # a blank is 1, so that n-grams of different lengths never share a number
    two = d[:-1] << 21 | d[1:]
    three = (d[:-2] << 42 | d[1:-1] << 21 | d[2:])[one != 0]  # no blank in the middle
    return np.concatenate([one[one != 0], two, three])


def ranked(text: str | None, size: int) -> np.ndarray:
    """The most frequent n-grams of a text, by falling count, then by number."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, profile_size: int = PROFILE_SIZE, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Profiles of the languages in docs (text, lang): n-grams by rank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts, held, n = [], [], 0
                for t in texts:
                    held.append(grams(t))
                    n += len(held[-1])
                    if n > 2_000_000:
                        parts.append(np.unique(np.concatenate(held), return_counts=True))
                        held, n = [], 0
                parts += [np.unique(np.concatenate(held), return_counts=True)] if held else []
                for found, counts in parts:
                    yield pd.DataFrame({"lang": lang, "gram": found, "n": counts.astype(np.int64)})

    counts = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").mapInPandas(count, "lang string, gram long, n long")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile_size)
    rows = top.select("lang", "gram", "rank").limit(profile_size * max_languages + 1).collect()
    if len(rows) > profile_size * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    profiles: dict[str, list] = {}
    for lang, gram, rank in rows:
        profiles.setdefault(lang, []).append((rank, gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64) for k, v in sorted(profiles.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile_size: int = PROFILE_SIZE) -> DataFrame:
    """docs with lang_pred and score, from the text alone."""
    names = sorted(profiles)
    order = [np.argsort(profiles[k], kind="stable") for k in names]
    tables = [(profiles[k][o], o) for k, o in zip(names, order)]  # n-grams in order, and their ranks

    def one(text) -> tuple[str, float]:
        own = ranked(text, profile_size)
        if not len(own) or not names:
            return "und", 0.0
        distances, places = [], np.arange(len(own))
        for keys, ranks in tables:
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            distances.append(int(np.where(keys[at] == own, np.abs(ranks[at] - places), profile_size).sum()))
        best = int(np.argmin(distances))
        return names[best], 1 - min(1.0, distances[best] / (profile_size * len(own)))

    @pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    # Marked so, a filter on its results reads them; else Spark would run it in the filter and once more for the rows that pass.
    return docs.withColumn("_g", guess.asNondeterministic()("text")).withColumns({k: F.col("_g")[k] for k in ("lang_pred", "score")}).drop("_g")


def language_id(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with held_out, lang_pred and score; learned from the rows that are not held out."""
    profiles = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), profiles)


def thresholds(docs: DataFrame, profiles: dict[str, np.ndarray]) -> dict[str, float]:
    """For each language of docs (text, lang): the least score that a text predicted to be in it is accepted with."""
    own = predict(docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"), profiles).where("lang_pred = lang")
    rows = own.groupBy("lang").agg(F.percentile_approx("score", 0.5, 10_000).alias("median")).collect()  # a row for each language
    return {r.lang: max(LEAST_SCORE, r.median / 2) for r in rows}


def accepted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) with lang_pred and score: the rows that are in a learned language."""
    learned = docs.where(~held_out(F.col("doc_id")))
    profiles = train(learned)
    bounds = docs.sparkSession.createDataFrame(sorted(thresholds(learned, profiles).items()), "lang_pred string, _least double")
    found = predict(docs, profiles).where("lang_pred <> 'und'").join(F.broadcast(bounds), "lang_pred", "left")
    return found.where(F.col("score") >= F.coalesce("_least", F.lit(LEAST_SCORE))).drop("_least")


def op6(spark, sf_dir) -> DataFrame:
    from .common import read

    out = language_id(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
