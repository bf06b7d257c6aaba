"""Text search over events, sessions and tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed parameters of the usual ranking of texts by terms.
K1, B = 1.2, 0.75
HITS_A_SESSION, HITS, BEFORE, AFTER = 3, 120, 60, 90
LEAST_PROMPT = 60
#: Fixed words that say nothing of a task.
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "this", "that", "it", "as", "be", "at", "by", "from", "into", "then", "than", "not", "no")


def search_terms(query: str) -> list[str]:
    """The terms of a query: words, and quoted phrases as they stand, lower-cased."""
    found = re.findall(r'"([^"]+)"|(\S+)', query.lower())
    return [" ".join(re.findall(r"\w+", a or b)) for a, b in found if re.search(r"\w", a or b)]


def tokens(text: Column) -> Column:
    """The words of a text, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def search_events(events: DataFrame, query: str, every: bool = True, kinds: tuple[str, ...] = (), after: int = 0, limit: int = 100) -> DataFrame:
    """Events whose text has every term (or any), in order of seq; a quoted phrase must stand as it is."""
    line = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    keep = F.lit(every)
    for term in search_terms(query):
        has = line.contains(f" {term} ")
        keep = keep & has if every else keep | has
    rows = events.where(F.col("kind").isin(*kinds)) if kinds else events
    return rows.where(F.col("seq") > after).where(keep).orderBy("seq").limit(limit)


def related(docs: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The documents (id, text) that fit a query best: BM25 over the query's words; ties go by id."""
    wanted = sorted({w for t in search_terms(query) for w in t.split()})
    rows = docs.select("id", tokens(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    hits = rows.select("id", "n", F.explode(F.filter("w", lambda t: t.isin(wanted))).alias("t")).groupBy("id", "n", "t").agg(F.count("*").alias("tf"))
    df = hits.groupBy("t").agg(F.count("*").alias("df"))  # one row for each word of the query
    scored = hits.join(F.broadcast(df), "t").join(F.broadcast(stats), F.lit(True))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return scored.groupBy("id").agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def search_sessions(events: DataFrame, query: str, per_session: int = HITS_A_SESSION, limit: int = HITS) -> DataFrame:
    """Hits of a phrase in all sessions: the first few of each by seq, with the text around the phrase."""
    text, q = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), query.lower()
    at = F.locate(q, F.lower(text))
    start = F.greatest(F.lit(1), at - BEFORE)
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = events.where(F.lower(text).contains(q)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_session)
    snippet = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, at - start + len(q) + AFTER), F.when(at + len(q) + AFTER <= F.length(text), "…").otherwise(""))
    return rows.select("session_id", "seq", "kind", snippet.alias("snippet")).orderBy("session_id", "seq").limit(limit)


def task_search(tasks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Earlier tasks (id, task) like a query: sum of tf * idf of its words over the root of the task's length; ties go by id."""
    pattern = r"[a-z0-9][a-z0-9_.]{1,}"
    stop = sorted(STOP)
    wanted = sorted({t for t in re.findall(pattern, query.lower()) if t not in STOP})
    words = F.filter(F.regexp_extract_all(F.lower("task"), F.lit(pattern), F.lit(0)), lambda t: ~t.isin(stop))
    rows = tasks.select("id", words.alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    count = rows.agg(F.count("*").alias("docs"))
    hits = rows.select("id", "n", F.explode(F.filter("w", lambda t: t.isin(wanted))).alias("t")).groupBy("id", "n", "t").agg(F.count("*").alias("tf"))
    df = hits.groupBy("t").agg(F.count("*").alias("df"))  # one row for each word of the query
    idf = F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1
    scored = hits.join(F.broadcast(df), "t").join(F.broadcast(count), F.lit(True)).groupBy("id", "n").agg(F.sum(F.col("tf") * idf).alias("s"))
    return scored.select("id", F.round(F.col("s") / F.sqrt("n"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def prompt_states(calls: DataFrame, field: str = "prompt", least: int = LEAST_PROMPT) -> DataFrame:
    """calls (seq, session_id, arguments) with state and prompt_hash: the whole instruction, white space made even.

    Instructions under the least length are too vague to tell two jobs apart and get no hash."""
    v = F.try_parse_json("arguments")
    value = F.try_variant_get(v, f"$.{field}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, f"$.{field}", "string"))
    even = F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w != ""), " ")
    state = (
        F.when(F.coalesce("arguments", F.lit("")) == "", "missing-full-text")
        .when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "invalid-arguments")
        .when(value.isNull(), "missing-instruction")
        .when(text.isNull(), "invalid-arguments")
        .when(text.contains("�"), "ambiguous-unicode")
        .when(F.length(even) < least, "too-vague")
        .otherwise("known")
    )
    return calls.withColumn("state", state).withColumn("prompt_hash", F.when(F.col("state") == "known", F.sha2(F.concat(F.lit("prompt\n"), even), 256)))


def delegation_matches(states: DataFrame) -> DataFrame:
    """Calls of other sessions with the same instruction: per call of prompt_states() how many, in how many sessions, and the latest.

    Counts come from one grouping by hash and one by hash and session; no pairs are made."""
    known = states.where("state = 'known'").select("seq", "session_id", "prompt_hash")
    own = known.groupBy("prompt_hash", "session_id").agg(F.count("*").alias("c"), F.max("seq").alias("last"))
    best = F.max(F.struct("last", "session_id"))
    whole = own.groupBy("prompt_hash").agg(F.sum("c").alias("calls"), F.count("*").alias("sessions"), best.alias("top"))
    second = own.join(whole.select("prompt_hash", F.col("top.session_id").alias("newest")), "prompt_hash").where("session_id <> newest").groupBy("prompt_hash").agg(F.max("last").alias("second"))
    out = known.join(own.select("prompt_hash", "session_id", "c"), ["prompt_hash", "session_id"]).join(whole, "prompt_hash").join(second, "prompt_hash", "left")
    latest = F.when(F.col("top.session_id") == F.col("session_id"), F.col("second")).otherwise(F.col("top.last"))
    return out.select("seq", "session_id", (F.col("calls") - F.col("c")).alias("matches"), (F.col("sessions") - 1).alias("sessions"), latest.alias("latest_seq"))
