"""What the index shuffles and stores, and that its stored form says the same as the lists it was made of."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.operators import index, text
from tests.conftest import DATA

LISTS = {"ids": np.int16, "counts": np.int32, "lengths": np.int32, "places": np.int32}


def shuffled(spark) -> int:
    """Bytes that the session's tasks have shuffled so far."""
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}/docs"
    spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id AS id", "text").write.parquet(path)
    return spark.read.parquet(path)


def test_f1_texts_are_shuffled_and_not_their_blocks(spark, docs, tmp_path):
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    own = index.text_index(spark, f"{tmp_path}/words", docs.where("id % 3 > 0"), span=64, buckets=8)
    assert shuffled(spark) - before < size
    own.add(docs.where("id % 3 = 0").select("id", text.tokens(F.col("text")).alias("terms")), 2)
    before = shuffled(spark)
    own.merge([1, 2], 3)
    assert shuffled(spark) - before < 3.5 * size
    # Each term and range has one block, and one task has the whole range: no merge by an aggregate that spills.
    blocks = spark.read.parquet(f"{own.path}/blocks/segment=3")
    assert blocks.count() == blocks.select("term", "range").distinct().count()
    assert dict(blocks.dtypes)["ids"] == "array<smallint>" and dict(blocks.dtypes)["places"] == "array<int>"
    words = docs.select("id", F.posexplode(text.tokens(F.col("text"))).alias("place", "term"))
    want = words.groupBy("term", "id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    some = ["the", "of", "license", "this", "work"]
    of = lambda df: sorted((r.term, r.id, list(r.places)) for r in df.where(F.col("term").isin(some)).collect())
    placed = own.blocks(some).select("term", "range", "ids", "counts", "places").mapInArrow(lambda batches: map(index.placed, batches), "term string, range bigint, id bigint, places array<int>")
    assert of(placed) == of(want)


@pytest.mark.parametrize("cut", [1, 2, 7, 1000])
@pytest.mark.parametrize("most", [3, 40, 1 << 20])
def test_f1_stored_blocks_say_what_the_documents_say(monkeypatch, cut, most):
    """Documents in two segments, packed, stored and merged in batches cut anywhere; ids below zero, empty documents, ranges with more words than are packed at a time."""
    monkeypatch.setattr(index, "PACKED_WORDS", most)
    rng, span = random.Random(cut), 16
    docs = {i: rng.choices("abcde", k=rng.choice([0, 1, 3, 9])) or None for i in range(-40, 60) if rng.random() < 0.8}
    rows = []
    for k in (0, 1):
        own = [(i, t) for i, t in sorted(docs.items()) if i % 3 // 2 == k]
        batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part], pa.list_(pa.string()))], ["id", "terms"]) for part in (own[n : n + cut] for n in range(0, len(own), cut))]
        for whole in index.whole_ranges(iter(batches), span):
            for blocks in index.packed(whole, span):
                rows += index.narrow(blocks, span, tuple(LISTS)).to_pylist()
    assert most < 1 << 20 or len(rows) == len({(i % 3 // 2, i // span, w) for i, t in docs.items() for w in t or ()})
    rows.sort(key=lambda r: (r["term"], r["range"]))
    data = [{"term": r["term"], "range": r["range"], "docs": len(r["ids"]), "small": [], "large": [], rng.choice(["small", "large"]): [x for c in LISTS for x in r[c]]} for r in rows]
    schema = pa.schema([("term", pa.string()), ("range", pa.int64()), ("docs", pa.int32()), ("small", pa.list_(pa.int16())), ("large", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pylist(data[n : n + cut], schema) for n in range(0, len(data), cut)]
    got = list(index.merged(iter(batches), LISTS))
    keys = [(r["term"], r["range"]) for b in got for r in b.to_pylist()]
    assert len(keys) == len(set(keys))
    found = {}
    for b in got:
        assert b.schema.field("ids").type.value_type == pa.int16()
        for r in b.to_pylist():
            assert r["ids"] == sorted(r["ids"])
            places = iter(r["places"])
            for i, n, length in zip(r["ids"], r["counts"], r["lengths"]):
                found[r["term"], i + r["range"] * span] = length, [next(places) for _ in range(n)]
            assert next(places, None) is None
    assert found == {(w, i): (len(t), [k for k, x in enumerate(t) if x == w]) for i, t in docs.items() for w in set(t or ())}
    ids = [{**r, "small": (r["small"] or r["large"])[: r["docs"]], "large": []} for r in data]
    only = [r for b in index.merged(iter([pa.RecordBatch.from_pylist(ids[n : n + cut], schema) for n in range(0, len(ids), cut)]), {"ids": np.int16}) for r in b.to_pylist()]
    assert [(r["term"], r["range"], r["ids"]) for r in only] == [(r["term"], r["range"], r["ids"]) for b in got for r in b.to_pylist()]


def test_f1_wide_ranges_and_empty_segments(spark, tmp_path):
    rows = [(5, "a b a"), (-70_000, "b a"), (99_999, "a b a b"), (2**40, "c"), (7, "d " * 40_000 + "b a")]
    docs = spark.createDataFrame(rows, "id long, text string")
    own = index.text_index(spark, f"{tmp_path}/words", docs, span=100_000, buckets=4)
    own.add(docs.where("id = 8"), 2, text.tokens(F.col("text")))
    for _ in range(2):
        assert sorted(r.id for r in own.search('"b a"').collect()) == [-70_000, 5, 7, 99_999]
        assert [r.id for r in own.search('"d b a"').collect()] == [7]
        assert [(r.id, r.score) for r in own.best("a c", 3)[0].collect()] == [(r.id, r.score) for r in text.related(docs, "a c", 3).collect()]
        if own.segments() == [1, 2]:
            own.merge([1, 2], 3)
    assert own.segments() == [3]


def test_f2_grams_are_ids_only_and_their_texts_are_shuffled(spark, docs, tmp_path):
    rows = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    own = index.gram_index(spark, f"{tmp_path}/grams", rows.where("id % 2 = 0"), span=64, buckets=8)
    assert shuffled(spark) - before < size
    own.add(rows.where("id % 2 = 1"), 2, index.grams(F.col("text")))
    own.merge([1, 2], 3)
    stored = spark.read.parquet(f"{own.path}/blocks/segment=3")
    assert {"counts", "lengths", "places"}.isdisjoint(stored.columns)
    for part in ("the license", "zz top", "of"):
        want = sorted(r.id for r in rows.where(F.col("text").contains(part)).collect())
        assert sorted(r.id for r in index.containing(own, rows, F.col("text"), part).collect()) == want, part
