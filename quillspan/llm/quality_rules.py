"""Quality rules [native]: a short-circuit cascade, ordered by rejection per cost on a sample.

Every rule is a predicate that is true for a bad text. The base counts are owed for every row; most rules look at the
text again, and that work is what the cascade saves. A bounded sample gives, over its rows that pass the base rule, each
rule's cost and its selectivity (share of rows that it rejects). A cost is counted, not timed: each rule says how many
characters it visits in a row, summed over the sample, and a rule that reads ready counts visits a few. So a rerun finds the
same order on any machine. The cascade asks the rules by falling rejection per cost and stops at the first
that rejects. The order changes the work and ``failed_rule`` only, never the verdict.

Defined results: a null or empty text has no words and fails the base rule; ties in rejection per
cost go by the rule's name; repeated rows get equal rows; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, words

#: Fixed characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array."""

    def spread(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def by_sorting(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            twin = lambda v, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == v["h"])) | (
                (j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == v["h"])
            )
            return spread(F.transform(F.filter(s, twin), lambda v: v["i"]))

        return let(keyed, of_sorted)

    def by_lookup(h: Column, repeated: Column) -> Column:
        starts = F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i))
        return spread(F.array_compact(starts))

    def covered(h: Column) -> Column:
        # Few repeated windows are looked up one by one; with many, the windows are sorted once.
        twins = lambda s: F.array_distinct(F.filter(s, lambda v, j: (j > 0) & (s[F.greatest(j - 1, F.lit(0))] == v)))
        repeats = let(let(F.sort_array(h), twins), lambda r: F.when(F.size(r) > 32, by_sorting(h)).otherwise(by_lookup(h, r)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeats)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    line_counts = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    )
    out = docs.withColumn("_w", let(words(F.col(text)), counts)).withColumn("_l", let(lines, line_counts))
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    return (
        out.withColumn("n_symbols", (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long"))
        .withColumns({k: F.col("_w")[k] for k in ("n_words", "word_chars", "n_repeat_words")} | {k: F.col("_l")[k] for k in ("n_lines", "n_dup_lines")})
        .drop("_w", "_l")
        .withColumn("base_failed", (n < 50) | (100 * rep > 50 * n))
    )


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over the columns of base_counts and the text; visits: SQL for the characters that it looks at in a row."""

    name: str
    rejects: str
    visits: str = "4"


_TEXT = "length(coalesce(text, ''))"
#: The production rules. Integer arithmetic keeps them exact. A replacement reads a text and writes what stays; a repeated
#: group is tried at each character.
RULES = (
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("few_letters", "2 * length(regexp_replace(coalesce(text, ''), '[^\\\\p{L}]+', '')) < word_chars", f"2 * {_TEXT}"),
    Rule("shouting", "10 * length(regexp_replace(coalesce(text, ''), '[^\\\\p{Lu}]+', '')) > 7 * word_chars", f"{_TEXT} + word_chars / 8"),
    Rule("one_character", "coalesce(text, '') RLIKE '([^ ])\\\\1{39}'", f"3 * {_TEXT}"),
    Rule("addresses", "5 * size(regexp_extract_all(coalesce(text, ''), 'https?://', 0)) > n_words", _TEXT),
)
SAMPLE_ROWS = 4000


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, characters a row, share rejected) by falling rejection per cost, over the sample's rows that pass the base rule.

    The sample has the rows whose hash over all columns lies in the lowest sample_rows / rows of its range, repeated rows
    once: the same rows in every run, however they are partitioned, and only they leave the scan. The driver gets one row of
    sums; of rules without a rejection the cheaper go first, then by name.
    """
    rows = max(1, docs.count())
    bound = (2**64 - 1) * min(sample_rows, rows) // rows - 2**63
    hashed = docs.select("text", F.xxhash64(*docs.columns).alias("_h"))
    sample = hashed.where(F.col("_h") <= bound).dropDuplicates(["_h"]).drop("_h")
    sample = base_counts(sample).where("NOT base_failed")
    sums = [x for r in rules for x in (F.count_if(F.expr(r.rejects)), F.sum(F.expr(r.visits)).cast("double"))]
    row = sample.agg(F.count("*"), *sums).first()
    rows = max(1, row[0])
    found = [(r, (row[2 * k + 2] or 0.0) / rows or 1.0, row[2 * k + 1] / rows) for k, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base counts, base_failed, failed_rule (the first rule of the cascade that rejects) and kept."""
    cascade = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in order_rules(docs, rules, sample_rows):
        cascade = cascade.when(F.expr(rule.rejects), F.lit(rule.name))
    return base_counts(docs).withColumn("failed_rule", cascade).withColumn("kept", F.col("failed_rule").isNull())


def op7(spark, sf_dir) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The same rows in DuckDB SQL.
def rules_sql(table: str) -> str:
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {table}),
    w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
    p AS (SELECT rid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM p) WHERE c > 1) GROUP BY rid),
    l AS (SELECT rid, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup FROM (SELECT rid, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS x FROM d)),
    b AS (SELECT d.*, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, l.n_lines, l.n_dup AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS capitals, len(regexp_extract_all(t, 'https?://')) AS addresses,
        list_bool_or(list_transform(range(1, greatest(length(t) - 38, 1)), lambda i: t[i] <> ' ' AND t[i : i + 39] = repeat(t[i], 40))) AS one_character
        FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
    SELECT *, NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
        OR 10 * n_dup_lines > 3 * n_lines OR 2 * letters < word_chars OR 10 * capitals > 7 * word_chars OR coalesce(one_character, false) OR 5 * addresses > n_words) AS kept FROM f"""


ORACLE_SQL = f"""SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM ({rules_sql("documents")})"""
