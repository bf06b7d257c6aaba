"""Strict JSON by cases, and exact positions of a session that lies in many parts."""

from pyspark.sql import functions as F

from quillspan.functions import strict
from quillspan.operators import assembly, trace


def test_objects_with_repeated_keys_are_none(spark):
    cases = [
        ('{"a":1}', '{"a":1}', False), ('{"a":1,"a":2}', "null", True), ('{"o":{"k":1,"k":1},"b":2}', '{"b":2,"o":null}', True), ('[{"k":1,"k":2},3]', "[null,3]", True), ('{"a":1} x', None, None), ("", None, None), (None, None, None),
        ('{"s":"{\\"k\\":1,\\"k\\":2}"}', '{"s":"{\\"k\\":1,\\"k\\":2}"}', False), ('{"a":NaN}', None, None), ("[" * 5000 + "]" * 5000, None, False), ('{"é":1,"\\u00e9":2}', "null", True),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = {r.i: (r.j, r.r) for r in rows.select("i", F.to_json(strict.strict_variant(F.col("t"))).alias("j"), strict.repeated_fields(F.col("t")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [(j, r) for _, j, r in cases]


def test_children_of_results_by_cases(spark):
    """One record for each reason to refuse, and those that are taken."""
    import json

    def message(**changes):
        record = {"type": "user", "sessionId": "n", "message": {"content": [{"type": "tool_result", "tool_use_id": "c"}]}, "toolUseResult": {"agentId": "child"}}
        record.update(changes)
        return json.dumps({k: v for k, v in record.items() if v is not None})

    def rollout(output, **changes):
        payload = {"type": "function_call_output", "call_id": "c", "output": output} | changes
        return json.dumps({"type": "response_item", "payload": payload})

    mismatch, unsupported = "source-record-mismatch", "unsupported-result"
    cases = [
        ("messages", message(), ("known", "child")), ("messages", message(agentId="main"), ("known", "child")), ("messages", message(agentId="x"), (mismatch, None)), ("messages", message(sessionId="m"), (mismatch, None)), ("messages", message(type="assistant"), (mismatch, None)),
        ("messages", message(message={"content": "text"}), (unsupported, None)), ("messages", message(message=None), (unsupported, None)), ("messages", message(message={"content": ["x"]}), (unsupported, None)), ("messages", message(message={"content": []}), (mismatch, None)),
        ("messages", message(message={"content": [{"type": "tool_result", "tool_use_id": "d"}]}), (mismatch, None)), ("messages", message(toolUseResult="child"), (unsupported, None)), ("messages", message(toolUseResult={"agentId": 7}), (unsupported, None)),
        ("messages", message(toolUseResult={"agentId": "x" * 513}), (unsupported, None)), ("messages", message(toolUseResult={"agentId": "a\ufffd"}), (unsupported, None)), ("messages", "not json", (mismatch, None)), ("messages", None, (mismatch, None)),
        ("rollout", rollout({"agent_id": "t"}), ("known", "t")), ("rollout", rollout('{"agent_id":"t"}'), ("known", "t")), ("rollout", rollout('{"agent_id":"t","agent_id":"u"}'), (unsupported, None)), ("rollout", rollout("the agent is t"), (unsupported, None)),
        ("rollout", rollout({"agent_id": ""}), (unsupported, None)), ("rollout", rollout({"agent_id": "t"}, call_id="d"), (mismatch, None)), ("rollout", rollout({"agent_id": "t"}, type="message"), (mismatch, None)), ("rollout", message(), (mismatch, None)),
    ]
    rows = spark.createDataFrame([(i, kind, record, "c", "n", "main") for i, (kind, record, _) in enumerate(cases)], "i int, provider_kind string, record string, call_id string, native_id string, agent_id string")
    got = {r.i: (r.child_state, r.child_native_id) for r in trace.spawned_children(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_a_session_of_a_million_events_lies_in_many_parts(spark, tmp_path):
    """Positions of one long and some short sessions, with ties and nulls, equal those of a plain sort."""
    rows = spark.range(1_000_000).selectExpr("'long' AS s", "(id * 7919) % 1000003 % 5000 AS t", "id").unionByName(spark.range(999).selectExpr("CASE WHEN id % 5 = 0 THEN NULL ELSE concat('s', id % 5) END AS s", "CASE WHEN id % 3 > 0 THEN id % 20 END AS t", "id"))
    got = assembly.with_sequence(rows, "s", ["t", "id"], parts=16).withColumn("part", F.spark_partition_id())
    got.write.parquet(f"{tmp_path}/got")
    got = spark.read.parquet(f"{tmp_path}/got")
    # Each position of the long session once, and in order.
    long = got.where("s = 'long'")
    assert long.agg(F.count_distinct("global_seq"), F.min("global_seq"), F.max("global_seq")).first() == (1_000_000, 0, 999_999)
    assert long.select("part").distinct().count() > 4
    want = long.where("id % 1009 = 0").select("t", "id", "global_seq").collect()
    order = {r.id: k for k, r in enumerate(long.select("id").orderBy("t", "id").collect())}
    assert all(order[r.id] == r.global_seq for r in want)
    short = got.where("s IS NULL OR s <> 'long'").collect()
    for s in {r.s for r in short}:
        own = sorted((r for r in short if r.s == s), key=lambda r: (r.t is not None, r.t or 0, r.id))
        assert [r.global_seq for r in own] == list(range(len(own)))


def test_signed_changes_are_worked_out_once(spark, tmp_path):
    from quillspan.operators import upkeep

    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for frame in batches:
            read.add(len(frame))
            yield frame

    rows = [(-1, "a", 2.5, 7), (1, "a", 4.0, 9), (1, "b", None, 3), (1, "b", 1.0, None)]
    schema = "sign int, machine string, cost double, last long"
    changes = spark.createDataFrame(rows, schema).coalesce(1).mapInPandas(passed, schema)
    totals = upkeep.SignedTotals(spark, f"{tmp_path}/totals", ("machine",), ("cost",), "last")
    totals.apply(spark.createDataFrame([(1, "a", 2.5, 7), (1, "a", 0.5, 2)], schema), 0)
    totals.apply(changes, 1)
    assert read.value == len(rows)
    assert sorted((r.machine, r.n, float(r.cost), r.last) for r in totals.totals().collect()) == [("a", 2, 4.5, 9), ("b", 2, 1.0, 3)]
