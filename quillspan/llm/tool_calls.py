"""Chat formatting [native]: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join by identifier (conversation and call id). Repeated identifiers are
ambiguous: the earliest call and the earliest result carry the link, the others are ``duplicate``. A
call may name the call whose result it was made upon (``after``); a call's level is the number of calls
and results that must come before it, its result's level is one more, so that (level, turn) is a
topological order. Levels come from pointer doubling, in as many joins as the longest chain has binary
digits; a chain that ends nowhere (a cycle) has level null.

Arguments are checked against schemas (tool, param, type, required, max_length): malformed, missing,
wrong type, too long, unknown. JSON is canonical: keys in code point order, no white space, one object
for each message, so that a conversation however long is never gathered into one row.

Defined results: a call without a result is ``unanswered``, a result without a call ``orphan``; null
arguments are malformed, with whatever id; a call of an unknown tool has the error ``tool``; null ids link with
nothing; of calls with one id each is checked by itself; repeated rows give repeated rows; an empty table gives an empty result; extra columns are ignored. Turns
that neither call nor answer (role system, any other role, or none) are messages with status ``message``,
level 0, no call_id, no other_turn and no errors; their JSON has content, role and type, without what is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, settle, small

#: Fixed schemas of the production query: tool, parameter, type, required, longest string.
SCHEMAS = [
    ("lookup", "limit", "BIGINT", True, None),
    ("lookup", "query", "STRING", True, 150),
    ("search", "limit", "BIGINT", False, None),
    ("search", "mode", "STRING", False, 10),
    ("search", "query", "STRING", True, None),
    ("translate", "limit", "BIGINT", False, None),
    ("translate", "query", "STRING", True, 400),
]


def canonical(json: Column) -> Column:
    """The canonical form of a JSON text; null where it is malformed."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(row, errors) of the calls (row, tool, arguments) with errors, in order; row is one of its own for each call."""
    spark = calls.sparkSession
    calls = calls.select("row", "tool", F.try_parse_json("arguments").alias("v")).withColumn("is_object", F.schema_of_variant("v").startswith("OBJECT"))
    bad = calls.where("v IS NULL OR NOT is_object").select("row", F.lit("malformed").alias("error"))
    objects = calls.where("is_object")
    known = small(schemas.select("tool").distinct())
    no_tool = objects.join(known, "tool", "left_anti").select("row", F.lit("tool").alias("error"))
    objects = objects.join(known, "tool", "left_semi")
    given = spark.sql("SELECT c.row, c.tool, e.key AS param, e.value FROM {c} c, LATERAL variant_explode(c.v) e", c=objects)
    checked = given.join(small(schemas), ["tool", "param"], "left")
    kind = F.schema_of_variant("value")
    wrong = (
        F.when(F.col("type").isNull(), F.concat(F.lit("unknown:"), "param"))
        .when(kind != F.col("type"), F.concat(F.lit("type:"), "param"))
        .when(F.length(F.try_variant_get("value", "$", "string")) > F.col("max_length"), F.concat(F.lit("long:"), "param"))
    )
    wrong_rows = checked.select("row", wrong.alias("error")).where("error IS NOT NULL")
    needed = objects.join(small(schemas.where("required")), "tool").select("row", "param")
    absent = needed.join(given.select("row", "param"), ["row", "param"], "left_anti").select("row", F.concat(F.lit("missing:"), "param").alias("error"))
    found = bad.unionByName(no_tool).unionByName(wrong_rows).unionByName(absent).distinct()
    return found.groupBy("row").agg(F.array_join(F.array_sort(F.collect_list("error")), ";").alias("errors"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): twice the number of answered calls that a call builds upon, by pointer doubling."""
    now = calls.groupBy("conv_id", "call_id").agg(F.min("after").alias("up")).withColumn("level", F.when(F.col("up").isNotNull(), 2).otherwise(0))
    there = now.select("conv_id", F.col("call_id").alias("up"))
    now = now.join(there.withColumn("_there", F.lit(True)), ["conv_id", "up"], "left")
    now = settle(now.select("conv_id", "call_id", F.when(F.col("_there"), F.col("up")).alias("up"), F.when(F.col("_there"), F.col("level")).otherwise(0).alias("level")), "levels")
    for _ in range(max(1, now.count()).bit_length() + 1):
        if now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        now = now.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        now = settle(now, "levels")
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls (conv_id, turn, call_id, tool, arguments, after) and results (conv_id, turn, call_id, content) as
    rows: conv_id, turn, kind, call_id, other_turn, status, level, errors, json."""
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "after")
    # Verdicts belong to a row and not to its identifier, which may be repeated or null.
    calls = settle(calls.withColumn("row", F.monotonically_increasing_id()), "calls")
    results = results.select("conv_id", "turn", "call_id", "content")
    keys = ["conv_id", "call_id"]
    first_call = calls.groupBy(*keys).agg(F.min("turn").alias("call_turn"))
    first_result = results.groupBy(*keys).agg(F.min("turn").alias("result_turn"))
    pairs = first_call.join(first_result.hint("shuffle_hash"), keys)
    answered = calls.join(pairs.select(*keys), keys, "left_semi")
    after = answered.select("conv_id", F.col("call_id").alias("after")).distinct().withColumn("_ok", F.lit(True))
    ready = calls.join(after, ["conv_id", "after"], "left").withColumn("after", F.when(F.col("_ok"), F.col("after"))).drop("_ok")
    order = levels(ready.select("conv_id", "call_id", "after").where("conv_id IS NOT NULL AND call_id IS NOT NULL"))
    errors = argument_errors(calls, schemas)
    c = calls.join(pairs.hint("shuffle_hash"), keys, "left").join(order, keys, "left").join(errors, "row", "left")
    twin = F.col("call_turn").isNotNull() & (F.col("turn") != F.col("call_turn"))
    c = c.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.when(~twin, F.col("result_turn")).alias("other_turn"),
        F.when(twin, "duplicate").when(F.col("result_turn").isNotNull(), "answered").otherwise("unanswered").alias("status"),
        F.coalesce("level", F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0)).cast("long").alias("level"), F.coalesce("errors", F.lit("")).alias("errors"),
        F.concat(
            F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")), F.lit(","),
            F.substring(F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"), F.lit("call").alias("type"))), 2, 2**31 - 1),
        ).alias("json"),
    )
    r = results.join(pairs.hint("shuffle_hash"), keys, "left").join(order, keys, "left")
    twin = F.col("result_turn").isNotNull() & (F.col("turn") != F.col("result_turn"))
    r = r.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.when(~twin, F.col("call_turn")).alias("other_turn"),
        F.when(twin, "duplicate").when(F.col("call_turn").isNotNull(), "linked").otherwise("orphan").alias("status"),
        F.when(F.col("call_turn").isNotNull(), F.col("level") + 1).otherwise(0).cast("long").alias("level"), F.lit("").alias("errors"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type"))).alias("json"),
    )
    return c.unionByName(r)


def tool_view(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as an agent's log: a user turn calls a tool, the assistant turn after it is the result.

    The tool goes by (conv_id + turn) mod 3; arguments are the text as ``query``, its number of words as
    ``limit`` and, in every fifth turn, a ``mode``; a call builds upon the one two turns before it."""
    ident = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    tool = F.element_at(F.array(F.lit("lookup"), F.lit("search"), F.lit("translate")), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    n = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), F.when(F.pmod("turn", F.lit(5)) == 4, "fast").alias("mode"), n.cast("long").alias("limit")))
    user, assistant = conversations.where("role = 'user'"), conversations.where("role = 'assistant'")
    calls = user.select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), ident(F.col("turn") - 2).alias("after"))
    return calls, assistant.select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that neither call nor answer, in the columns of ``link``: kind system, or other for any other or no role."""
    role = F.col("role")
    kind = F.when(role == "system", "system").otherwise("other")
    rest = conversations.where(role.isNull() | ~role.isin("user", "assistant")).withColumn("kind", kind)
    return rest.select(
        "conv_id", "turn", "kind", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("other_turn"), F.lit("message").alias("status"),
        F.lit(0).cast("long").alias("level"), F.lit("").alias("errors"), F.to_json(F.struct(F.col("text").alias("content"), "role", F.col("kind").alias("type"))).alias("json"),
    )


def _schemas(spark) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean, max_length int")


def op1(spark, sf_dir) -> DataFrame:
    """A message for each row of conversations."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link(*tool_view(turns), _schemas(spark)).unionByName(other_turns(turns))


_LINKED_SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, text, ['lookup', 'search', 'translate'][(conv_id + turn) % 3 + 1] AS tool, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
lv AS (SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u p JOIN a ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 WHERE p.conv_id = u.conv_id AND p.turn = u.turn - 2)
    UNION ALL SELECT u.conv_id, u.turn, lv.level + 2 FROM lv JOIN a ON a.conv_id = lv.conv_id AND a.turn = lv.turn + 1 JOIN u ON u.conv_id = lv.conv_id AND u.turn = lv.turn + 2)
SELECT u.conv_id, u.turn, 'call' AS kind, 'call_' || u.conv_id || '_' || u.turn AS call_id, a.turn AS other_turn, CASE WHEN a.turn IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    CAST(lv.level AS BIGINT) AS level,
    concat_ws(';', CASE WHEN tool = 'lookup' AND length(u.text) > 150 OR tool = 'translate' AND length(u.text) > 400 THEN 'long:query' END, CASE WHEN u.text IS NULL THEN 'missing:query' END,
        CASE WHEN tool <> 'search' AND u.turn % 5 = 4 THEN 'unknown:mode' END) AS errors,
    '{"arguments":{"limit":' || n || CASE WHEN u.turn % 5 = 4 THEN ',"mode":"fast"' ELSE '' END || CASE WHEN u.text IS NULL THEN '' ELSE ',"query":' || CAST(to_json(u.text) AS VARCHAR) END
        || '},"id":"call_' || u.conv_id || '_' || u.turn || '","name":"' || tool || '","type":"call"}' AS json
FROM u JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
UNION ALL
SELECT a.conv_id, a.turn, 'result', 'call_' || a.conv_id || '_' || (a.turn - 1), u.turn, CASE WHEN u.turn IS NULL THEN 'orphan' ELSE 'linked' END, CAST(coalesce(lv.level + 1, 0) AS BIGINT), '',
    '{' || CASE WHEN a.text IS NULL THEN '' ELSE '"content":' || CAST(to_json(a.text) AS VARCHAR) || ',' END || '"id":"call_' || a.conv_id || '_' || (a.turn - 1) || '","type":"result"}'
FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 LEFT JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn"""

ORACLE_SQL = (
    _LINKED_SQL
    + r"""
UNION ALL
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system' ELSE 'other' END, NULL, NULL, 'message', CAST(0 AS BIGINT), '',
    '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || CAST(to_json(text) AS VARCHAR) || ',' END || CASE WHEN role IS NULL THEN '' ELSE '"role":' || CAST(to_json(role) AS VARCHAR) || ',' END
        || '"type":"' || CASE WHEN role = 'system' THEN 'system' ELSE 'other' END || '"}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""
)
