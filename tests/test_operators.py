import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspan.functions.columns import flow_role, flow_tool, model_tier, name_cost
from quillspan.operators import spans, text, timeview, trace, usage
from quillspan.operators.catalog import SessionQuery
from quillspan.sources import transcripts

EVENT = "seq long, session_id long, source_id string, agent_id string, kind string, ts timestamp_ntz, tool string, tool_use_id string, error boolean, path string, text string"


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def ev(seq, kind, minute, call=None, error=None, tool="Bash", text="x", agent="main"):
    return (seq, 1, "s1", agent, kind, None if minute is None else at(minute), tool if kind == "tool-call" else None, call, error, None, text)


def test_spans_have_a_state_for_each_defect(spark):
    rows = [
        ev(1, "tool-call", 0, "a"), ev(2, "tool-result", 1, "a", False), ev(3, "tool-call", 2, "b"), ev(4, "tool-call", 3, "c"), ev(5, "tool-result", 2, "c"),
        ev(6, "tool-call", 4, "d"), ev(7, "tool-call", 5, "d"), ev(8, "tool-call", 6, None), ev(9, "tool-call", 7, "e", agent=""),
    ]
    got = {r.seq: (r.state, r.duration_ms) for r in spans.tool_spans(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {
        1: ("matched", 60_000), 3: ("missing-result", None), 4: ("invalid-time-or-order", None), 6: ("ambiguous", None), 7: ("ambiguous", None), 8: ("missing-id", None), 9: ("missing-agent", None),
    }


@pytest.mark.parametrize(("minute", "modified", "stalled"), [(0, 9, True), (9, 9.5, False), (0, -5, False), (0, None, None)])
def test_stalled_is_null_unless_provable(spark, minute, modified, stalled):
    events = spark.createDataFrame([ev(1, "tool-call", minute, "a")], EVENT)
    sources = spark.createDataFrame([("s1", None if modified is None else at(modified))], "source_id string, modified_at timestamp_ntz")
    row = spans.agent_lifecycle(events, sources, F.lit(at(10)).cast("timestamp_ntz")).first()
    assert (row.stalled, row.pending_seq, row.uncertain_calls) == (stalled, 1, 0)


def test_diagnosis_prefers_a_retry_storm(spark):
    rows = [ev(i, "tool-call", i, f"a{i}", text="same") for i in range(1, 4)] + [ev(9, "tool-result", 9, "a2", True)]
    rows += [ev(i, "tool-call", i, f"b{i}", text="loop") for i in range(20, 24)]
    row = spans.diagnose(spark.createDataFrame(rows, EVENT)).first()
    assert (row.kind, row.tool, row.target, row["count"], row.errors) == ("stalled", "Bash", "loop", 1, 0)
    row = spans.diagnose(spark.createDataFrame([*rows, ev(30, "assistant-text", 30, None)], EVENT)).first()
    assert (row.kind, row["count"], row.errors) == ("retry-storm", 3, 1)
    row = spans.diagnose(spark.createDataFrame([r for r in [*rows, ev(30, "assistant-text", 30, None)] if r[0] > 9], EVENT)).first()
    assert (row.kind, row["count"], row.errors) == ("looping", 4, 0)


def test_retrying_is_null_unless_proved(spark):
    cases = {
        "proved": [ev(1, "tool-call", 1, "a"), ev(2, "tool-result", 2, "a", True)], "twice": [ev(1, "tool-call", 1, "a"), ev(2, "tool-result", 2, "a", False), ev(3, "tool-result", 3, "a", True)],
        "unsaid": [ev(1, "tool-call", 1, "a"), ev(2, "tool-result", 2, "a", None)], "fine": [ev(1, "tool-call", 1, "a"), ev(2, "tool-result", 2, "a", False)], "called": [ev(1, "tool-result", 1, "a", True), ev(2, "tool-call", 2, "b")],
    }
    sources = spark.createDataFrame([("s1", at(9))], "source_id string, modified_at timestamp_ntz")
    got = {k: spans.agent_lifecycle(spark.createDataFrame(v, EVENT), sources, F.lit(at(10)).cast("timestamp_ntz")).first() for k, v in cases.items()}
    assert {k: r.retrying for k, r in got.items()} == {"proved": True, "twice": None, "unsaid": None, "fine": False, "called": False}
    later = spans.agent_lifecycle(spark.createDataFrame([ev(1, "tool-call", 11, "a")], EVENT), sources, F.lit(at(10)).cast("timestamp_ntz")).first()
    assert later.stalled is None


def test_prices_are_null_on_overlap_and_for_partial_messages(spark):
    day = dt.datetime(2024, 1, 5)
    rates = spark.createDataFrame(
        [(i, m, "standard", "mid", dt.datetime(2024, 1, 1), None, 1.0, 0.1, 1.25, 5.0) for i, m in (("r", "one"), ("s", "two"), ("t", "two"))],
        "rate_id string, model string, context string, tier string, effective_from timestamp_ntz, effective_to timestamp_ntz, input double, cache_read double, cache_write double, output double",
    )
    rows = [(i, m, k, day, 1_000_000, 0, 0, 1_000_000) for i, (m, k) in enumerate((("one", "message-final"), ("two", "message-final"), ("one", "message-partial"), ("one", "message-without-id")))]
    u = spark.createDataFrame(rows, "id int, model string, kind string, ts timestamp_ntz, tokens_in long, tokens_cache long, tokens_write long, tokens_out long")
    got = {r.id: (r.cost, r.priced_tokens, r.unattributed_tokens) for r in usage.price(u, rates).collect()}
    assert got == {0: (6.0, 2_000_000, 0), 1: (None, 0, 0), 2: (None, 0, 2_000_000), 3: (6.0, 2_000_000, 2_000_000)}


def test_merge_keeps_the_last_value_that_is_present(spark):
    rows = [("1", 1, "main", "m", "x", "message-partial", at(0), 5, 7, 0, 1, ["tokens_in", "tokens_cache", "tokens_out", "model"]), ("2", 1, "main", "m", "", "message-partial", at(1), 0, 9, 2, 3, ["tokens_cache", "tokens_write", "tokens_out"])]
    schema = "id string, session_id long, agent_id string, message_id string, model string, kind string, ts timestamp_ntz, tokens_in long, tokens_cache long, tokens_write long, tokens_out long, present array<string>"
    merged = lambda rows: (lambda r: (r.model, r.tokens_in, r.tokens_cache, r.tokens_write, r.tokens_out, r.kind, r.reports))(usage.merged_reports(spark.createDataFrame(rows, schema)).first())
    assert merged(rows) == ("x", 5, 9, 2, 3, "message-final", 2)
    # A zero that is present is a value.
    assert merged([*rows, ("3", 1, "main", "m", "", "message-partial", at(2), 0, 0, 0, 0, ["tokens_cache"])]) == ("x", 5, 0, 2, 3, "message-final", 3)
    assert merged(rows[1:]) == ("", 0, 9, 2, 3, "message-partial", 1)


def test_duplicates_need_counters_of_two_sources(spark):
    sessions = spark.createDataFrame([(k, "m", "codex", "n", f"s{k}" if k < 3 else "s1", "") for k in (1, 2, 3)], "id long, machine_id string, provider string, native_id string, source_id string, forked_from_id string")
    schema = "id string, session_id long, source_id string, agent_id string, model string, kind string, ts timestamp_ntz, tokens_in long, tokens_cache long, tokens_write long, tokens_out long, present array<string>, counter_scope string, evidence string"
    row = lambda i, s, kind="cumulative-delta", model="x", offset=7, out=3: (i, s, f"s{s}", "main", model, kind, at(0), 1, 0, 0, out, [], "thread:n", f'{{"offset":{offset},"previousCounter":{{"input":0}},"counter":{{"output":3}}}}')
    found = lambda rows: sorted((r.id, r.owner, r.twin_session, r.state) for r in usage.duplicate_usage(spark.createDataFrame(rows, schema), sessions).collect())
    assert found([row("a", 1), row("b", 2, offset=9)]) == [("a", 1, 2, "matched"), ("b", 1, 1, "matched")]
    assert found([row("a", 1), row("b", 2, out=4)]) == found([row("a", 1, "message-final"), row("b", 2, "message-final")]) == found([row("a", 1, model=""), row("b", 2, model="")]) == []
    assert found([row("a", 1), row("b", 3)]) == []  # one source


def read_in_filters(df, reader):
    """How many filters and joins of a plan call a reader of texts."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(reader in line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Filter", "Join")))


def test_evidence_is_read_once_and_only_in_threads_of_several_sources(spark):
    schema = "id long, machine_id string, provider string, native_id string, source_id string, forked_from_id string"
    sessions = spark.createDataFrame([(1, None, "codex", "n", "s1", ""), (2, None, "codex", "n", "s2", ""), (3, "m", "codex", "k", "s3", ""), (4, "l", "codex", "k", "s4", "")], schema)
    row = lambda s, t: observed(f"o{s}", s, "cumulative-delta", (9, 1, 1, 4), thread=t)
    facts = spark.createDataFrame([row("1", "n"), row("2", "n"), row("3", "k"), row("4", "k")], COUNTER).withColumn("session_id", F.col("session_id").cast("long"))
    # Without a machine sources are still of one thread; threads of two machines are not.
    assert sorted((r.id, r.twin_session, r.state) for r in usage.duplicate_usage(facts, sessions).collect()) == [("o1", 2, "matched"), ("o2", 1, "matched")]
    assert read_in_filters(usage.counted(facts, sessions), "from_json") == 0
    assert read_in_filters(usage.duplicate_usage(facts, sessions), "from_json") == read_in_filters(usage.fork_baselines(facts, sessions), "from_json") == 0


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("s", '{"type":"session_meta","payload":{"id":"n"}}', 1, 0)], "source_id string, value string, block long, line long").selectExpr("source_id", "struct(block, line) AS at", "value")
    for read in (transcripts.rollout_events, transcripts.counter_reports, transcripts.message_events, transcripts.message_usage):
        assert read_in_filters(read(lines), "parseJson") == 0


def test_counters_that_are_no_whole_numbers(spark):
    """Usage that is missing, no object or of other types, beside one that is whole; one object does not take the other with it."""
    whole, odd = '{"input_tokens":9,"cached_input_tokens":2,"output_tokens":3}', '{"input_tokens":"9","cached_input_tokens":null,"output_tokens":-1}'
    infos = ["null", "7", f'{{"total_token_usage":{whole}}}', f'{{"total_token_usage":{whole},"last_token_usage":5}}', f'{{"total_token_usage":{odd},"last_token_usage":{whole}}}']
    rows = [("s", k, f'{{"type":"event_msg","payload":{{"type":"token_count","model":"m","info":{info}}}}}') for k, info in enumerate(infos)]
    lines = spark.createDataFrame(rows, "source_id string, at long, value string").selectExpr("source_id", "struct(at AS block, 0L AS line) AS at", "value")
    names = [f"{kind}_{c}" for kind in ("total", "last") for c in ("input", "cache", "cache_write", "output")]
    none, full = (None, 0, 0, None), (9, 2, 0, 3)
    reports = transcripts.counter_reports(lines)
    assert [tuple(r) for r in reports.orderBy("at").select(*names).collect()] == [none + none, none + none, full + none, full + none, none + full]
    assert sorted((r.kind, r.tokens_in, r.tokens_cache, r.tokens_out) for r in transcripts.counter_deltas(reports).collect()) == [("incomplete-attribution", 7, 2, 3)] + [("invalid-usage-counter", 0, 0, 0)] * 3


COUNTER = "id string, session_id string, source_id string, agent_id string, counter_scope string, ts timestamp_ntz, model string, kind string, tokens_in long, tokens_cache long, tokens_write long, tokens_out long, present array<string>, evidence string"


def observed(name, session, kind, counter, previous=(0, 0, 0, 0), offset=5, thread=None, tokens=None):
    i, c, w, o = counter
    part = lambda x: f'{{"input":{x[0]},"cache":{x[1]},"cacheWrite":{x[2]},"output":{x[3]}}}'
    tokens = tokens or (i - c - w, c, w, o)
    evidence = f'{{"offset":{offset},"previousCounter":{part(previous)},"counter":{part(counter)}}}'
    return (name, session, f"f-{session}", "main", f"thread:{thread or session}", at(1), "" if kind == "incomplete-attribution" else "m", kind, *tokens, [], evidence)


def test_fork_baselines_need_a_first_counter_of_the_right_kind(spark):
    """A match, a split first counter, and each reason for none: kind, previous counter, third part, same source, beyond what is published."""
    first, last, delta = "incomplete-attribution", "reported-last-call", "cumulative-delta"
    whole = (100, 40, 10, 7)
    rows = [observed("p1", "p", delta, whole, (1, 0, 0, 0))]
    rows += [observed("a1", "a", first, whole), observed("b1", "b", first, whole, tokens=(20, 40, 10, 3)), observed("b2", "b", last, whole, tokens=(30, 0, 0, 4))]
    rows += [observed("c1", "c", delta, whole), observed("d1", "d", first, whole, (0, 0, 1, 0)), observed("e1", "e", first, (100, 40, 10, 8)), observed("g1", "g", first, whole, offset=900)]
    rows += [observed("h1", "h", first, whole, tokens=(20, 40, 10, 3)), observed("h2", "h", last, whole, tokens=(20, 0, 0, 4)), observed("h3", "h", last, whole, tokens=(10, 0, 0, 0))]
    sessions = [(s, "m", "beta", s, f"f-{s}", "" if s == "p" else "p") for s in "pabcdegh"]
    facts = spark.createDataFrame(rows, COUNTER)
    known = spark.createDataFrame(sessions, "id string, machine_id string, provider string, native_id string, source_id string, forked_from_id string")
    published = spark.createDataFrame([(f"f-{s}", 100) for s in "pabcdegh"], "source_id string, indexed_offset long")
    got = {r.session_id: (r.state, r.parent_id, r.tokens) for r in usage.fork_baselines(facts, known, "beta", published).collect()}
    assert got == {"a": ("matched", "p1", 107), "b": ("matched", "p1", 107), "e": ("unverified", None, None), "h": ("unverified", None, None)}
    assert usage.fork_baselines(facts, known, "beta").where("session_id = 'g' AND state = 'matched'").count() == 1


def test_the_helper_to_blame(spark):
    runs = [
        (1, "x", "t1", "failed", 1), (1, "w", "t2", "stalled", 2), (2, "y", "t1", "succeeded", 3), (3, "z", "t1", "succeeded", 9), (4, "v", "t2", "stalled", 4), (4, "u", "t1", "succeeded", 4),
        (5, "s", "t1", "unclear", 5), (6, "r", "t2", "succeeded", 6), (6, "q", "t2", "unclear", 6), (7, "main", None, "failed", 7),
    ]
    agents = spark.createDataFrame(runs, "session_id long, agent_id string, task_hash string, outcome string, ended_at long")
    got = {(r.left_session, r.left_agent): (r.right_session, r.right_agent) for r in trace.divergence_pairs(agents).collect()}
    # Failed before stalled; the only helper of a session whatever its outcome; of two without a fault none.
    assert got == {(1, "x"): (3, "z"), (4, "v"): (6, "r"), (5, "s"): (3, "z"), (2, "y"): (3, "z"), (3, "z"): (4, "u")}


def test_task_search_leaves_out_every_stop_word(spark):
    tasks = spark.createDataFrame([(1, "put it into the list then not"), (2, "no more than that"), (3, "list more")], "id long, task string")
    assert [r.id for r in text.task_search(tasks, "into then than not no").collect()] == []
    assert [r.id for r in text.task_search(tasks, "list into more").collect()] == [3, 2, 1]


def test_spans_of_repeated_names_and_lists(spark):
    body = """{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"1","name":"chat","startTimeUnixNano":"1000000","attributes":[
        {"key":"gen_ai.request.model","value":{"stringValue":"a"}},{"key":"x","value":{"stringValue":"y"}},{"key":"gen_ai.request.model","value":{"stringValue":"b"}},
        {"key":"gen_ai.usage.input_tokens","value":{"intValue":"0"}},{"key":"llm.token_count.prompt","value":{"doubleValue":12.0}},
        {"key":"gen_ai.prompt","value":{"arrayValue":{"values":[{"stringValue":"p"},{"intValue":"1"}]}}}]},{"spanId":"2","name":"run","attributes":[{"key":"gen_ai.request.retry_count","value":{"intValue":"3"}}]}]}]}]}"""
    bodies = spark.createDataFrame([(body,)], "body string")
    one = transcripts.spans(bodies).where("span_id = '1'").first()
    assert (one.session_id, one.model, one.tokens_in, one.kind) == ("otel:otel-agent", "b", 12, "model-call")
    got = [(r.span_id, r.place, r.kind, r.text, r.tool, r.retry) for r in transcripts.span_events(bodies).orderBy("span_id", "place").collect()]
    assert got == [("1", 0, "user-text", "p, 1", None, None), ("1", 1, "assistant-text", "chat (b)", None, None), ("2", 0, "tool-call", "", "run", 3)]


def test_sessions_without_usage_are_in_the_groups(spark):
    sessions = spark.createDataFrame([(1, "p"), (2, "p")], "id long, project string").selectExpr("*", "'s' AS source_id", "1 AS generation", "1 AS revision", "'m' AS machine_id", "'claude' AS provider", "'' AS native_agent_id", "'' AS parent_native_id")
    rows = [("a", 1, 1, "m1"), ("b", 1, 0, "m1")]
    priced = spark.createDataFrame(rows, "id string, session_id long, revision int, model string").selectExpr("*", "'s' AS source_id", "1 AS generation", "'main' AS agent_id", "'message-final' AS kind", "TIMESTAMP_NTZ '2024-01-01' AS ts",
        "1L AS tokens_in", "0L AS tokens_cache", "0L AS tokens_write", "0L AS tokens_out", "1L AS priced_tokens", "0.5D AS cost")
    got = lambda by: {(r.key, r.sessions, r.observations, r.cost) for r in usage.grouped_usage(priced, sessions, by).collect()}
    assert got("project") == {("p", 2, 1, 0.5)} and got("model") == {("m1", 1, 1, 0.5), ("", 1, 0, None)} and got("agentKind") == {("main", 1, 1, 0.5), ("unattributed", 1, 0, None)}


def test_civil_days_follow_the_zone(spark):
    days = timeview.civil_days(spark, dt.date(2024, 3, 30), dt.date(2024, 4, 1), "Europe/Berlin").orderBy("day").collect()
    assert [(d.to_at - d.from_at).total_seconds() / 3600 for d in days] == [24, 23, 24]
    with pytest.raises(ValueError):
        timeview.civil_days(spark, dt.date(2024, 1, 1), dt.date(2025, 12, 31))


def test_session_query_rejects_conflicts():
    for bad in ({"project": "p", "unassigned": True}, {"start": at(1), "end": at(1)}, {"text": "x" * 4097}):
        with pytest.raises(ValueError):
            SessionQuery(**bad)


def test_names(spark):
    row = spark.createDataFrame([("mcp__srv__read", "Explorer #12", "claude-haiku-mini", 1_000_000, 0, 0, 0)], "tool string, role string, model string, tokens_in long, tokens_cache long, tokens_write long, tokens_out long")
    got = row.select(flow_tool(F.col("tool")), flow_role(F.col("role")), model_tier(F.col("model")), name_cost(F.col("model"))).first()
    assert tuple(got) == ("read", "Explorer", "cheap", 1.0)
