"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a DataFrame expression over one row, so the operator has no shuffle, no Python and no state.

Defined results: a null or empty text has no words, all counts 0 and fails the base rule (fewer than 50 words);
null ids pass through; repeated rows are each judged; extra columns are ignored, whatever they are called; an empty
table gives an empty result. Stop words count in lower case only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that a it for was on are as with be by at or this "
    "der die und das in den von zu mit sich des auf ist ein eine dem nicht "
    "de la le et les des en un une du que dans pour "
    "el los y las por con no su para"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; an open bound is None."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios are parts of 1. mean_word_chars and the ratios are null for a text without words, which passes no rule.
RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("many_words", "n_words", high=100_000),
    Rule("word_length", "mean_word_chars", low=2, high=12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_words", "repeat_ratio", high=0.5),
    Rule("repeated_lines", "dup_line_ratio", high=0.3),
)

def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, hashes: Column) -> Column:
    """Words that stand in a three-word window found twice or more.

    A text whose window hashes all differ has none. For the others, windows are sorted by hash, so that equal ones are
    neighbours, and neighbours of equal hash count only if their words are equal too.
    """

    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, 3) == F.slice(words, b["i"] + 1, 3))

    def places(rows: Column) -> Column:
        twice = F.filter(
            rows,
            lambda r, k: F.when(k > 0, same(r, F.get(rows, k - 1))).otherwise(False)
            | F.when(k < F.size(rows) - 1, same(r, F.get(rows, k + 1))).otherwise(False),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda r: F.array(r["i"], r["i"] + 1, r["i"] + 2)))))

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(by_hash, places))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and every measure that a rule can name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("words")
    base = docs.select(
        "doc_id",
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("lines"),
    ).withColumn(
        "hashes",
        F.transform(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ),
    )
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(words, F.col("hashes")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    some = F.nullif(F.col("n_words"), F.lit(0))
    return counted.select(
        "*",
        (F.col("word_chars") / some).alias("mean_word_chars"),
        (F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0))).alias("symbol_ratio"),
        (F.col("n_stop_words") / some).alias("stop_ratio"),
        (F.col("n_repeat_words") / some).alias("repeat_ratio"),
        (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_line_ratio"),
    )


def compile_rules(rules=RULES) -> list[Column]:
    """One boolean column ``pass_<name>`` a rule: null measures do not pass."""
    out = []
    for r in rules:
        value, ok = F.col(r.measure), F.lit(True)
        if r.low is not None:
            ok = ok & (value >= r.low)
        if r.high is not None:
            ok = ok & (value <= r.high)
        out.append(F.coalesce(ok, F.lit(False)).alias(f"pass_{r.name}"))
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """Measures, the base rule, a column for each rule, ``failed`` (names of rules not passed) and ``kept``."""
    judged = measures(docs).select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        *compile_rules(rules),
    )
    failed = F.array_compact(F.array(*(F.when(~F.col(f"pass_{r.name}"), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    return judged.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op8_quality_rules(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "mean_word_chars", "symbol_ratio", "stop_ratio",
    )


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL = rf"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM b),
w AS (
  SELECT *, list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS win FROM s),
u AS (SELECT doc_id, unnest(win) AS k, unnest(range(1, len(win) + 1)) AS i FROM w),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM u) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop
  FROM w LEFT JOIN r USING (doc_id)),
q AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    word_chars / nullif(n_words, 0) AS mean_word_chars,
    n_symbols / nullif(word_chars, 0) AS symbol_ratio,
    n_stop / nullif(n_words, 0) AS stop_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, mean_word_chars, symbol_ratio, stop_ratio,
  (NOT base_failed AND n_words BETWEEN 50 AND 100000
   AND coalesce(mean_word_chars BETWEEN 2 AND 12, false) AND coalesce(symbol_ratio <= 0.1, false) AND coalesce(stop_ratio >= 0.02, false)
   AND coalesce(n_repeat_words / nullif(n_words, 0) <= 0.5, false) AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.3, false)) AS kept
FROM q
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {"op8_quality_rules": SQL}
