"""Rate catalogs: long ones, those in several documents; overlapping rates."""

import datetime as dt
import random

from quillspan.operators import usage as ops

FINE = '{"id":"r","model":"m","input":1}'
TWICE = '{"id":"r","ID":"s"}'
ODD = '{"id":"r","colour":1}'


def _problems(spark, rows, schema="catalog_id string, first long, json string"):
    return sorted(map(tuple, ops.rate_field_problems(spark.createDataFrame(rows, schema)).collect()))


def test_a_catalog_of_more_than_eight_megabytes_is_read_whole(spark):
    rates = [FINE] * 300_000 + [TWICE, ODD]
    text = '{"rates":[' + ",".join(rates) + "]}"
    assert len(text) > 8 << 20
    assert _problems(spark, [("c", text)], "catalog_id string, json string") == [("c", 300_000, "repeated-field"), ("c", 300_001, "unknown-field")]


def test_places_go_on_over_the_documents_of_a_catalog(spark):
    rows = [("c", 0, f'{{"rates":[{FINE},{ODD}]}}'), ("c", 2, f'{{"rates":[{TWICE},3]}}'), ("d", 0, "no"), ("d", 9, '{"rates":1}'), ("e", 0, '{"rates":[]}')]
    assert _problems(spark, rows) == [("c", 1, "unknown-field"), ("c", 2, "repeated-field"), ("c", 3, "repeated-field"), ("d", -1, "malformed")]


def _rates(spark, rows):
    return spark.createDataFrame(rows, "rate_id string, context string, model string, effective_from timestamp_ntz, effective_to timestamp_ntz")


def test_conflicts_agree_with_all_pairs(spark):
    draw, start = random.Random(5), dt.datetime(1969, 12, 1)
    rows = []
    for i in range(400):
        at = start + dt.timedelta(microseconds=draw.choice([1, 10**6, 86400 * 10**6]) * draw.randrange(90))
        end = draw.choice([None, at, at - dt.timedelta(hours=5), at + dt.timedelta(microseconds=1), *[at + dt.timedelta(seconds=2 ** draw.randrange(23) + draw.randrange(3)) for _ in range(12)]])
        rows.append((f"r{i % 390}", draw.choice("xy"), draw.choice("mno"), None if i % 50 == 0 else at, end))
    want = []
    for i, c, m, f, t in rows:
        for j, d, n, g, u in rows:
            if c == d and m == n and i < j and f and g and (u is None or f < u) and (t is None or g < t):
                want.append((i, j, m))
    assert sorted(map(tuple, ops.rate_conflicts(_rates(spark, rows)).collect())) == sorted(want)


def test_conflicts_of_many_short_rates_need_no_pairs(spark):
    """100 000 rates of one model that follow each other: all pairs would be 5e9."""
    day = dt.datetime(2000, 1, 1)
    frame = spark.range(100_000).selectExpr("CAST(id AS STRING) AS rate_id", "'c' AS context", "'m' AS model", "id * 86400 AS s")
    frame = frame.selectExpr("rate_id", "context", "model", *[f"CAST(timestamp_seconds(s + {n}) AS TIMESTAMP_NTZ) AS {c}" for c, n in (("effective_from", 0), ("effective_to", 86400))])
    assert ops.rate_conflicts(frame.unionByName(_rates(spark, [("last", "c", "m", day, day + dt.timedelta(days=2))]))).count() == 2
