"""Transcripts as DataFrames: one JSON object a line, malformed lines kept as diagnostic rows.

Lines are (source_id, at, value); at orders the lines of a source. Fields are read from VARIANT, so that a missing
field, a null and a value of another type stay apart: an error is only true or false where the record says so.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.workers import ship

#: Fixed names of the usage fields and of the columns that hold them.
USAGE_FIELDS = {"input_tokens": "tokens_in", "cache_read_input_tokens": "tokens_cache", "cache_creation_input_tokens": "tokens_write", "output_tokens": "tokens_out"}
EVENT = ("source_id", "at", "place", "agent_id", "kind", "ts", "text", "tool", "tool_use_id", "error")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files under path: the file is the source, and at orders a file's lines, also over its splits."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("source_id"), at.alias("at"), "value")


def source_kind(path: Column) -> Column:
    """main, subagent, workflow or rollout, by where a transcript file lies; null for other files."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(~p.endswith(".jsonl"), F.lit(None))
        .when(p.rlike(r"/rollout-[^/]*\.jsonl$"), "rollout")
        .when(p.rlike(r"/workflows/[^/]+/(?:[^/]+/)*agent-[^/]*\.jsonl$"), "workflow")
        .when(p.rlike(r"/subagents/(?:[^/]+/)*agent-[^/]*\.jsonl$"), "subagent")
        .otherwise("main")
    )


def _text(v: str | Column, path: str) -> Column:
    """A field that is a JSON string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _flag(v: str | Column, path: str) -> Column:
    """A field that is JSON true or false, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _count(v: str | Column, path: str) -> Column:
    """A field that is a whole number of tokens, else null."""
    n = F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.when(n >= 0, n)


def _content(v: Column) -> Column:
    """A message's text: a string itself, of a list its text blocks joined by line breaks."""
    blocks = F.try_variant_get(v, "$", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.when(_text(b, "$.type").isin("text", "input_text", "output_text"), _text(b, "$.text"))), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(_text(v, "$"), F.array_join(texts, "\n"), F.lit(""))


def _timestamp(v: str) -> Column:
    return F.try_to_timestamp(_text(v, "$.timestamp")).cast("timestamp_ntz")


def _parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines that are JSON objects with v, and an event for each other line that is not blank; a null line is one too long to read."""
    # As a generated column a line is parsed once; as a projected one it is parsed again in every filter on its fields.
    rows = lines.where("value IS NULL OR btrim(value) <> ''").withColumn("v", F.explode(F.array(F.try_parse_json("value"))))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    bad = rows.where(~good).select("source_id", "at", F.lit(0).alias("place"), F.lit("main").alias("agent_id"), F.lit("indexing-error").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit("malformed record").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("tool", "tool_use_id")], F.lit(None).cast("boolean").alias("error"))
    return rows.where(good).drop("value"), bad


def _messages(lines: DataFrame) -> DataFrame:
    agent = F.coalesce(F.nullif(_text("v", "$.agentId"), F.lit("")), F.when(_flag("v", "$.isSidechain"), "sidechain:unresolved").otherwise("main"))
    role = F.coalesce(F.nullif(_text("v", "$.message.role"), F.lit("")), _text("v", "$.type"), F.lit(""))
    return lines.select("source_id", "at", "v", agent.alias("agent_id"), role.alias("role"), _timestamp("v").alias("ts"), F.try_variant_get("v", "$.message.content", "variant").alias("content"))


def message_events(lines: DataFrame) -> DataFrame:
    """Events of message transcripts: texts, tool calls and results, reasoning, other records, and lines that could not be read."""
    parsed, bad = _parsed(lines)
    rows = _messages(parsed)
    none = {c: F.lit(None).cast("string").alias(c) for c in ("tool", "tool_use_id")}
    no_error = F.lit(None).cast("boolean").alias("error")
    head = ("source_id", "at", "place", "agent_id")
    said = F.col("role").isin("assistant", "user")
    texts = rows.withColumns({"text": _content(F.col("content")), "place": F.lit(0)}).where(~said | (F.col("text") != ""))
    texts = texts.select(*head, F.when(said, F.concat("role", F.lit("-text"))).otherwise("source-record").alias("kind"), "ts", "text", *none.values(), no_error)
    blocks = rows.where(said).select("source_id", "at", "agent_id", "ts", F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("place", "b")).withColumn("type", _text("b", "$.type"))
    kind = F.when(F.col("type") == "tool_use", "tool-call").when(F.col("type") == "tool_result", "tool-result").when(F.col("type") == "thinking", "assistant-reasoning")
    text = (
        F.when(F.col("type") == "tool_use", F.to_json(F.try_variant_get("b", "$.input", "variant"))).when(F.col("type") == "tool_result", _content(F.try_variant_get("b", "$.content", "variant")))
        .otherwise(F.coalesce(_text("b", "$.thinking"), F.lit("")))
    )
    blocks = blocks.withColumns({"kind": kind, "text": text, "place": F.col("place") + 1}).where("kind IS NOT NULL")
    blocks = blocks.select(*head, "kind", "ts", "text", F.when(F.col("kind") == "tool-call", _text("b", "$.name")).alias("tool"), F.coalesce(_text("b", "$.id"), _text("b", "$.tool_use_id")).alias("tool_use_id"), F.when(F.col("kind") == "tool-result", _flag("b", "$.is_error")).alias("error"))
    return texts.unionByName(blocks).unionByName(bad)


def message_usage(lines: DataFrame) -> DataFrame:
    """Usage reports of message transcripts: one row a report, with the fields that it has in present.

    A report without a message id is a message of its own."""
    parsed, _ = _parsed(lines)
    rows = _messages(parsed).where("role = 'assistant'").withColumns({c: _count("v", f"$.message.usage.{f}") for f, c in USAGE_FIELDS.items()} | {"model": _text("v", "$.message.model"), "message": F.nullif(_text("v", "$.message.id"), F.lit(""))})
    fields = [*USAGE_FIELDS.values(), "model"]
    present = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    rows = rows.where(F.try_variant_get("v", "$.message.usage", "variant").isNotNull()).withColumn("present", present).where(F.size("present") > 0)
    own = F.concat(F.lit("line:"), F.to_json(F.struct("at")))
    return rows.select(
        "source_id", "at", "agent_id", F.coalesce("message", own).alias("message_id"), F.when(F.col("message").isNull(), "message-without-id").otherwise("message-partial").alias("kind"), "ts",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in USAGE_FIELDS.values()], F.coalesce("model", F.lit("")).alias("model"), "present",
    )


def rollout_events(lines: DataFrame) -> DataFrame:
    """Events of rollout transcripts: metadata, contexts, messages, calls and outputs, reasoning, lifecycles and other records."""
    parsed, bad = _parsed(lines)
    p = lambda name: _text("v", f"$.payload.{name}")
    rows = parsed.withColumns({"type": F.coalesce(_text("v", "$.type"), F.lit("")), "item": F.coalesce(p("type"), F.lit(""))}).where("NOT (type = 'event_msg' AND item = 'token_count')")
    of = lambda t, *items: (F.col("type") == t) & (F.col("item").isin(*items) if items else F.lit(True))
    call, output = of("response_item", "function_call", "custom_tool_call"), of("response_item", "function_call_output", "custom_tool_call_output")
    kind = (
        F.when(of("session_meta"), "session-meta").when(of("turn_context") | of("event_msg", "model_reroute"), "model-context").when(of("response_item", "message"), F.concat(F.coalesce(p("role"), F.lit("")), F.lit("-text")))
        .when(call, "tool-call").when(output, "tool-result").when(of("response_item", "reasoning"), "assistant-reasoning").when(of("event_msg", "sub_agent_activity"), "agent-lifecycle").otherwise("source-record")
    )
    variant = lambda name: F.try_variant_get("v", f"$.payload.{name}", "variant")
    text = (
        F.when(of("turn_context"), p("model")).when(of("event_msg", "model_reroute"), p("to_model")).when(of("response_item", "message"), _content(variant("content")))
        .when(call, F.coalesce(F.nullif(p("arguments"), F.lit("")), p("input"))).when(output, F.coalesce(F.nullif(p("output"), F.lit("")), F.to_json(variant("output"))))
        .when(of("response_item", "reasoning"), F.concat(_content(variant("summary")), _content(variant("content")))).when(of("event_msg", "sub_agent_activity"), p("agent_path")).otherwise(p("message"))
    )
    none = F.lit(None)
    out = rows.select(
        "source_id", "at", F.lit(0).alias("place"), F.lit("main").alias("agent_id"), kind.alias("kind"), _timestamp("v").alias("ts"), F.coalesce(text, F.lit("")).alias("text"),
        F.when(call, p("name")).alias("tool"), F.when(call | output, p("call_id")).alias("tool_use_id"), none.cast("boolean").alias("error"),
    )
    return out.unionByName(bad)


_COUNTERS = ("input", "cache", "cache_write", "output")
DELTA = "source_id string, at_key string, scope string, part string, model string, kind string, tokens_in long, tokens_cache long, tokens_write long, tokens_out long"


def counter_fields(lines: DataFrame) -> DataFrame:
    """What counters are read from, a narrow row for each line of four kinds: (source_id, at, counted, named, owner, thread, model, ts, total and last counters).

    named is the model that a line names for what follows it, owner the thread that a source says it is."""
    parsed, _ = _parsed(lines)
    p = lambda name: F.nullif(_text("v", f"$.payload.{name}"), F.lit(""))
    rows = parsed.withColumns({"type": F.coalesce(_text("v", "$.type"), F.lit("")), "item": F.coalesce(_text("v", "$.payload.type"), F.lit(""))})
    rows = rows.where("type IN ('session_meta', 'turn_context') OR item = 'model_reroute' OR type = 'event_msg' AND item = 'token_count'")
    counted = (F.col("type") == "event_msg") & (F.col("item") == "token_count")
    named = F.when(counted, F.lit(None)).when(F.col("item") == "model_reroute", p("to_model")).otherwise(p("model"))
    fields = {"input": "input_tokens", "cache": "cached_input_tokens", "cache_write": "cache_write_input_tokens", "output": "output_tokens"}
    kinds = {"total": "total_token_usage", "last": "last_token_usage"}
    # Both objects are looked up once and not for each of their fields.
    inner = f"struct<{','.join(f'{f}:variant' for f in fields.values())}>"
    rows = rows.withColumns({kind: F.try_variant_get("v", f"$.payload.info.{name}", inner) for kind, name in kinds.items()})
    numbers = [F.coalesce(_count(F.col(f"{kind}.{f}"), "$"), F.lit(0) if c in ("cache", "cache_write") else F.lit(None)).alias(f"{kind}_{c}") for kind in kinds for c, f in fields.items()]
    return rows.select("source_id", "at", counted.alias("counted"), named.alias("named"), F.when(F.col("type") == "session_meta", p("id")).alias("owner"), p("thread_id").alias("thread"), p("model").alias("model"), _timestamp("v").alias("ts"), *numbers)


def counter_reports(lines: DataFrame) -> DataFrame:
    """(source_id, at, scope, model, total and last counters) of the token counts of rollout transcripts.

    The model is that of the count, else the last that its source named before it; the scope is the count's thread, else the source."""
    rows = counter_fields(lines)
    so_far = Window.partitionBy("source_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"context": F.last("named", ignorenulls=True).over(so_far), "owner": F.first("owner", ignorenulls=True).over(so_far)}).where("counted")
    own_scope = F.coalesce("owner", "source_id")
    scope = F.coalesce("thread", own_scope)
    numbers = [f"{kind}_{c}" for kind in ("total", "last") for c in _COUNTERS]
    return rows.select("source_id", "at", scope.alias("scope"), F.coalesce("model", F.when(scope == own_scope, F.col("context")), F.lit("")).alias("model"), "ts", *numbers)


def deltas_of(reports: pd.DataFrame, key: tuple[str, str], high: tuple | None, model: str | None) -> tuple[tuple | None, str | None, list[tuple]]:
    """The usage that reports of one scope add, in their order, with the high-water counter and model before and after them."""
    return _rises(_counters_of(reports), key, high, model)


def _counters_of(reports: pd.DataFrame) -> Iterator[tuple]:
    """(at_key, model, total, last) of each report."""
    numbers = [[None if none else int(x) for x, none in zip(reports[c], reports[c].isna())] for c in (f"{kind}_{c}" for kind in ("total", "last") for c in _COUNTERS)]
    return zip(reports["at_key"], reports["model"], zip(*numbers[:4]), zip(*numbers[4:]))


def _rises(reports: Iterable[tuple], key: tuple[str, str], high: tuple | None, model: str | None) -> tuple[tuple | None, str | None, list[tuple]]:
    def fits(d: tuple) -> bool:
        return min(d) >= 0 and d[1] <= d[0] and d[2] <= d[0] - d[1]

    out: list[tuple] = []
    for at_key, named, total, last in reports:
        head = (key[0], at_key, key[1])
        note = lambda code, head=head: out.append((*head, "counter", "", code, 0, 0, 0, 0))
        add = lambda part, m, kind, d, head=head: out.append((*head, part, m, kind, d[0] - d[1] - d[2], d[1], d[2], d[3])) if d[0] or d[3] else None
        if None in total or not fits(total):
            note("invalid-usage-counter")
            continue
        if total == high:
            continue
        rise = tuple(x - y for x, y in zip(total, high or (0, 0, 0, 0)))
        if not fits(rise):
            note("counter-discontinuity")
            continue
        known = named and high is not None and model == named
        rest = tuple(x - y for x, y in zip(rise, last)) if named and None not in last and fits(last) else None
        high, model = total, named
        if known:
            add("delta", model, "cumulative-delta", rise)
        elif rest is not None and fits(rest):
            add("prior", "", "incomplete-attribution", rest)
            add("last", model, "reported-last-call", last)
        else:
            add("delta", "", "incomplete-attribution", rise)
    return high, model, out


def counter_deltas(reports: DataFrame) -> DataFrame:
    """Usage from cumulative counters, scope by scope in order: the rise since the highest report so far.

    An equal report adds nothing. A report that falls, or whose cache no longer fits, is kept as a diagnostic and the
    high-water mark stays. The first report and one under another model are split: a last call that fits is attributed,
    the rest is incomplete-attribution. Rows of a scope are read as a sorted stream and never held together."""
    ship(reports.sparkSession)
    rows = reports.withColumn("at_key", F.to_json(F.struct("at"))).repartition("source_id", "scope").sortWithinPartitions("source_id", "scope", "at")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = high = model = None
        for batch in batches:
            out = []
            rows = zip(zip(batch["source_id"], batch["scope"]), _counters_of(batch))
            for own, part in groupby(rows, lambda r: r[0]):
                if own != key:
                    key, high, model = own, None, None
                high, model, found = _rises((r for _, r in part), key, high, model)
                out += found
            yield pd.DataFrame(out, columns=[x.split()[0] for x in DELTA.split(", ")])

    return rows.drop("at", "ts").mapInPandas(read, DELTA)


def scaled_to_total(windows: DataFrame, totals: DataFrame) -> DataFrame:
    """Per-agent sums (source_id, agent_id, tokens) scaled so that they add up to their source's largest cumulative total (source_id, total); nothing to scale stays 0."""
    most = totals.groupBy("source_id").agg(F.max("total").alias("total"))
    whole = windows.groupBy("source_id").agg(F.sum("tokens").alias("all"))
    rows = windows.join(whole, "source_id").join(most, "source_id", "left")
    return rows.select("source_id", "agent_id", "tokens", F.when(F.col("all") > 0, F.round(F.col("tokens") * F.coalesce("total", "all") / F.col("all"))).otherwise(0).cast("long").alias("scaled"))


# --- spans ---------------------------------------------------------------------------------------------

_SCALAR = "stringValue:string,intValue:string,doubleValue:double,boolValue:boolean"
_VALUE = f"struct<{_SCALAR},arrayValue:struct<values:array<struct<{_SCALAR}>>>>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
SPANS = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,name:string,"
    f"startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRIBUTES}>>>>>>"
)
#: Fixed attribute names, the first that is given counts.
ATTRIBUTES = {
    "agent": ("gen_ai.agent.name", "agent.name", "crewai.agent.role", "openinference.agent.name", "llm.agent.name", "traceloop.entity.name"),
    "model": ("gen_ai.request.model", "gen_ai.response.model", "llm.model_name", "llm.request.model", "llm.response.model"),
    "span_kind": ("openinference.span.kind", "span.kind"),
    "tokens_in": ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt"),
    "tokens_out": ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion"),
    "tool": ("gen_ai.tool.name", "tool.name"),
    "arguments": ("gen_ai.tool.call.arguments", "tool.parameters", "input.value", "gen_ai.tool.description"),
    "operation": ("gen_ai.operation.name",),
    "prompt": ("gen_ai.prompt", "gen_ai.input.messages", "input.value", "llm.input_messages.0.message.content"),
    "completion": ("gen_ai.completion", "gen_ai.output.messages", "gen_ai.response.text", "output.value", "llm.output_messages.0.message.content"),
    "retry": ("retry.count", "gen_ai.request.retry_count"),
}
_KNOWN = sorted({n for names in ATTRIBUTES.values() for n in names} | {"service.name"})


def _as_map(attributes: Column) -> Column:
    """The known attributes by name; of a name that is repeated the last value counts, a list is its values joined by commas."""
    scalar = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    value = lambda v: F.coalesce(scalar(v), F.array_join(F.transform(v["arrayValue"]["values"], lambda x: F.coalesce(scalar(x), F.lit(""))), ", "))
    known = F.reverse(F.filter(attributes, lambda a: a["key"].isin(*_KNOWN)))
    last = F.filter(known, lambda a, i: F.array_position(F.transform(known, lambda b: b["key"]), a["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], value(a["value"])))), F.create_map().cast("map<string,string>"))


def _span_rows(bodies: DataFrame) -> DataFrame:
    """One row a span of OTLP bodies (body), with what is read from its attributes; an empty text or a zero gives way to the next name."""
    traces = bodies.select(F.explode(F.from_json("body", SPANS)["resourceSpans"]).alias("r"))
    scopes = traces.select(_as_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("s"))
    rows = scopes.select("res", F.explode("s.spans").alias("x")).select("res", "x", _as_map(F.col("x.attributes")).alias("a"))
    first = lambda name: F.coalesce(*[F.nullif(F.try_element_at("a", F.lit(k)), F.lit("")) for k in ATTRIBUTES[name]])
    number = lambda name: F.coalesce(*[F.nullif(F.try_element_at("a", F.lit(k)).try_cast("double"), F.lit(0.0)) for k in ATTRIBUTES[name]], F.lit(0.0)).cast("long")
    kind, model = F.upper(F.coalesce(first("span_kind"), F.lit(""))), first("model")
    operation = F.lower(F.coalesce(first("operation"), F.col("x.name"), F.lit("")))
    is_model = (kind == "LLM") | (~kind.rlike("TOOL|RETRIEVER|EMBEDDING") & (model.isNotNull() | operation.rlike("chat|completion|generate")))
    at = lambda c: F.timestamp_micros((F.col(c).cast("decimal(38,0)") / 1000).cast("long")).cast("timestamp_ntz")
    agent, name = first("agent"), F.nullif(F.col("x.name"), F.lit(""))
    return rows.select(
        F.concat(F.lit("otel:"), F.coalesce(F.nullif(F.try_element_at("res", F.lit("service.name")), F.lit("")), F.lit("otel-agent"))).alias("session_id"), F.col("x.spanId").alias("span_id"),
        F.when(agent.isNull(), "main").otherwise(F.concat(F.lit("sub:"), agent)).alias("agent_id"), F.when(is_model, "model-call").otherwise("tool-call").alias("kind"), model.alias("model"),
        F.when(~is_model, F.coalesce(first("tool"), name, F.lit("span"))).alias("tool"), F.when(~is_model, F.coalesce(first("arguments"), F.lit(""))).alias("arguments"),
        at("x.startTimeUnixNano").alias("started_at"), at("x.endTimeUnixNano").alias("ended_at"), F.when(is_model, number("tokens_in")).otherwise(0).alias("tokens_in"), F.when(is_model, number("tokens_out")).otherwise(0).alias("tokens_out"),
        F.coalesce(F.col("x.status.code") == 2, F.lit(False)).alias("error"), F.when(is_model, first("prompt")).alias("prompt"),
        F.when(is_model, F.coalesce(first("completion"), F.concat(F.coalesce(F.col("x.name"), F.lit("")), F.lit(" ("), F.coalesce(model, F.lit("LLM")), F.lit(")")))).alias("completion"),
        F.when(~is_model, F.nullif(number("retry"), F.lit(0))).alias("retry"),
    )


def spans(bodies: DataFrame) -> DataFrame:
    """Spans of OTLP bodies (body): agent, model call or tool call, times, tokens and error."""
    return _span_rows(bodies).drop("prompt", "completion", "retry")


def span_events(bodies: DataFrame) -> DataFrame:
    """Events of OTLP bodies: a model call's prompt, where it has one, and its completion at the call's end; a tool call with its arguments and retries."""
    at_end = F.coalesce("ended_at", "started_at")
    none = F.lit(None)
    event = lambda kind, ts, text, tool, error, retry: F.struct(F.lit(kind).alias("kind"), ts.alias("ts"), text.alias("text"), tool.cast("string").alias("tool"), error.cast("boolean").alias("error"), retry.cast("long").alias("retry"))
    said = event("user-text", F.col("started_at"), F.col("prompt"), none, none, none)
    answer = event("assistant-text", at_end, F.col("completion"), none, F.col("error"), none)
    call = event("tool-call", F.col("started_at"), F.col("arguments"), F.col("tool"), F.col("error"), F.col("retry"))
    events = F.when(F.col("kind") == "tool-call", F.array(call)).when(F.col("prompt").isNull(), F.array(answer)).otherwise(F.array(said, answer))
    return _span_rows(bodies).select("session_id", "span_id", "agent_id", F.posexplode(events).alias("place", "e")).select("session_id", "span_id", "agent_id", "place", "e.*")
