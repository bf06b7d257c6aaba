"""The inverted index against scans: words, phrases, ranked texts, segments, and substrings by grams."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import catalog, index, text
from quillspan.plans import base, views
from tests.conftest import DATA


@pytest.fixture(scope="module")
def x(spark):
    return base.Inputs(spark, views.load(spark, DATA))


@pytest.fixture(scope="module")
def docs(x, tmp_path_factory):
    """All texts of the test data, settled, and a few with words that stand next to each other in several ways."""
    path = f"{tmp_path_factory.mktemp('docs')}/docs"
    rows = x.tables.texts.selectExpr("doc_id AS id", "text")
    more = x.spark.createDataFrame([(10_000, "a b a"), (10_001, "b a b"), (10_002, "a a"), (10_003, ""), (10_004, None), (10_005, "A, b? C!"), (20_000, "c b a")], "id long, text string")
    rows.unionByName(more).write.parquet(path)
    return x.spark.read.parquet(path)


@pytest.fixture(scope="module")
def words(spark, docs, tmp_path_factory):
    return index.text_index(spark, f"{tmp_path_factory.mktemp('index')}/words", docs, span=64, buckets=16)


def test_words_and_phrases_are_those_of_a_scan(docs, words):
    rng = random.Random(4)
    texts = {r.id: " " + " ".join(r.w) + " " for r in docs.select("id", text.tokens(F.col("text")).alias("w")).collect()}
    some = [t.split() for t in texts.values() if len(t.split()) > 6]
    queries = ["a b a", '"a b a"', '"a a"', '"b a" c', '"a b c"', "nowhere", '"b a"']
    for _ in range(3):
        w = rng.choice(some)
        k = rng.randrange(len(w) - 4)
        queries += [f'{w[0]} {w[-1]}', f'"{" ".join(w[k : k + 3])}" {w[0]}', f'"{" ".join(w[k : k + 2])}"']
    for q in queries:
        terms = text.search_terms(q)
        for every in (True, False):
            want = sorted(i for i, t in texts.items() if (all if every else any)(f" {x} " in t for x in terms))
            assert sorted(r.id for r in words.search(q, every).collect()) == want, (q, every)


def test_ranked_texts_are_those_of_a_scan_and_cost_less(docs, words):
    rng = random.Random(5)
    some = [r.w for r in docs.select(text.tokens(F.col("text")).alias("w")).where(F.size("w") > 9).collect()]
    for q in ["the license of this work", "a b c", "nowhere", " ".join(rng.sample(some[3], 3)), " ".join(rng.sample(some[9], 2) + rng.sample(some[7], 2))]:
        want = [(r.id, r.score) for r in text.related(docs, q, 5).collect()]
        got, ranges = words.best(q, 5)
        assert [(r.id, r.score) for r in got.collect()] == want, q
    # A rare word: blocks of its buckets only, of those only its own, and not all ranges are scored.
    rare = [w for w, n in words.spark.read.parquet(f"{words.path}/blocks").groupBy("term").agg(F.sum("docs").alias("n")).where("n BETWEEN 12 AND 30").orderBy("term").limit(3).collect()]
    blocks = words.blocks([rare[0]])
    everything = words.spark.read.parquet(f"{words.path}/blocks")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < blocks.count() < everything.count() / 100
    common = f"{rare[0]} the"
    got, ranges = words.best(common, 2)
    assert [(r.id, r.score) for r in got.collect()] == [(r.id, r.score) for r in text.related(docs, common, 2).collect()]
    assert ranges.count() < words.blocks(["the"]).select("range").distinct().count()


def test_segments_are_merged(spark, docs, tmp_path):
    own = index.text_index(spark, f"{tmp_path}/words", docs.where("id % 3 = 0"), span=64, buckets=8)
    for k in (1, 2):
        own.add(docs.where(f"id % 3 = {k}").select("id", text.tokens(F.col("text")).alias("terms")), k + 1)
    assert own.segments() == [1, 2, 3]
    want = [(r.id, r.score) for r in text.related(docs, "the license of this work", 7).collect()]
    phrase = sorted(r.id for r in own.search('"b a"').collect())
    before = own.blocks(["the"]).count()
    for segments, to in (([1, 2], 4), ([3, 4], 5)):
        own.merge(segments, to)
        assert [(r.id, r.score) for r in own.best("the license of this work", 7)[0].collect()] == want
        assert sorted(r.id for r in own.search('"b a"').collect()) == phrase == [10_000, 10_001, 20_000]
    assert own.segments() == [5] and own.blocks(["the"]).count() < before


def test_substrings_are_those_of_a_scan(spark, x, tmp_path):
    rows = x.catalog.withColumn("folded", catalog.searched_text()).select("id", "folded")
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    grams = index.gram_index(spark, f"{tmp_path}/grams", rows.withColumnRenamed("folded", "text"), span=64, buckets=8)
    texts = {r.id: r.folded for r in rows.collect()}
    rng = random.Random(6)
    parts = ["re", "x", "nothing like it", "renamed", "RENAMED", "aaa"]
    while len(parts) < 12:
        t = rng.choice(list(texts.values()))
        k = rng.randrange(max(1, len(t) - 12))
        parts.append(t[k : k + rng.randint(3, 11)])
    for part in parts:
        want = sorted(i for i, t in texts.items() if part.lower() in t)
        assert sorted(r.id for r in index.containing(grams, rows, F.col("folded"), part).collect()) == want, part


def test_blocks_are_packed_before_they_are_shuffled(monkeypatch):
    """A batch gives one row for each term and range, however often and in however many documents the term stands; long batches in parts."""
    import pyarrow as pa

    docs = [(5, ["a", "b", "a"]), (3, ["b"]), (70, ["a"]), (64, None), (1, []), (-1, ["b", "b"])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs], pa.list_(pa.string()))], ["id", "terms"])
    rows = lambda: sorted((r["term"], r["range"], r["ids"], r["counts"], r["lengths"], r["places"]) for b in index.packed(batch, 64) for r in b.to_pylist())
    assert rows() == [("a", 0, [5], [2], [3], [[0, 2]]), ("a", 1, [70], [1], [1], [[0]]), ("b", -1, [-1], [2], [2], [[0, 1]]), ("b", 0, [3, 5], [1, 1], [1, 3], [[0], [1]])]
    monkeypatch.setattr(index, "PACKED_WORDS", 2)
    assert [r for r in rows() if r[:2] == ("b", 0)] == [("b", 0, [3], [1], [1], [[0]]), ("b", 0, [5], [1], [3], [[1]])]
