"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every figure of a document comes from its own row, so the plan is one scan and one projection: no
exchange, and nothing that grows with a key. Null text has no words and fails the base rule; extra
columns are ignored, repeated rows each give a row, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be this by at from or an a "
    "de la le les des et en un une du que qui est pour dans sur au par il elle "
    "der die das und den von zu mit ist ein eine nicht auf für im dem sich auch als "
    "el los las y se del por con para su una no lo al como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; short documents (n_words < applies_from) are exempt."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    applies_from: int = 0


#: metric names are columns of `metrics`.
RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 20.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("stop_words", "stop_ratio", 0.02, None, 30),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullets", "bullet_ratio", None, 0.9),
    Rule("ellipsis", "ellipsis_ratio", None, 0.3),
    Rule("upper_case", "upper_ratio", None, 0.5),
)


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times: a lambda variable cannot be inlined."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def covered_by_repeats(words: Column, width: int = 5) -> Column:
    """How many words lie in a window of width words that occurs at least twice.

    Windows are hashed to 64 bits. Texts whose hashes all differ are done; in the others the hashes are
    sorted with their places, and equal neighbours are repeats.
    """

    def repeats(s):
        last = F.size(s) - 1
        return F.array_sort(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), last),
                    lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"]))
                    | ((k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])),
                ),
                lambda k: s[k]["i"],
            )
        )

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        slow = let(
            placed,
            lambda s: F.aggregate(
                repeats(s),
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, p: F.struct((p + width).alias("end"), (a["n"] + p + width - F.greatest(a["end"], p)).alias("n")),
            )["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)])
    )
    return F.when(F.size(words) > width, let(hashes, covered)).otherwise(F.lit(0)).cast("long")


def metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """One projection of counts and ratios for each document; carry: further columns to keep."""
    body = F.coalesce(F.col(text), F.lit(""))

    def counts(w, lines):
        kept = F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            covered_by_repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            let(
                kept,
                lambda k: F.struct(
                    F.size(k).cast("long").alias("n_lines"),
                    (F.size(k) - F.size(F.array_distinct(k))).cast("long").alias("n_dup_lines"),
                    F.size(F.filter(k, lambda x: x.rlike("^[\\x20\\x09]*[-*•]"))).cast("long").alias("n_bullets"),
                    F.size(F.filter(k, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09\\r]*$"))).cast("long").alias("n_ellipses"),
                ),
            ).alias("line"),
        )

    found = let(words_of(body), lambda w: let(F.split(body, "\n"), lambda x: counts(w, x)))
    out = docs.select(
        F.struct(F.col(doc_id).alias("doc_id"), *carry).alias("own"),
        found.alias("f"),
        (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(body, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )

    def share(a, b):
        return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))

    n, chars, line = F.col("f.n_words"), F.col("f.word_chars"), "f.line."
    return out.select(
        "own.*",
        n.alias("n_words"),
        chars.alias("word_chars"),
        "n_symbols",
        F.col(line + "n_dup_lines").alias("n_dup_lines"),
        F.col("f.n_repeat_words").alias("n_repeat_words"),
        share(chars, n).alias("mean_word_chars"),
        share(F.col("n_symbols"), n).alias("symbol_ratio"),
        share(F.col("f.n_stop_words"), n).alias("stop_ratio"),
        share(F.col(line + "n_dup_lines"), F.col(line + "n_lines")).alias("dup_line_ratio"),
        share(F.col(line + "n_bullets"), F.col(line + "n_lines")).alias("bullet_ratio"),
        share(F.col(line + "n_ellipses"), F.col(line + "n_lines")).alias("ellipsis_ratio"),
        share(F.col("n_upper"), chars).alias("upper_ratio"),
    )


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean expression: true if every rule passes."""
    verdict = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= r.high)
        verdict = verdict & (ok | (F.col("n_words") < r.applies_from))
    return verdict


def base_rule() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_verdict(docs: DataFrame, name: str, rules=RULES, text: str = "text") -> DataFrame:
    """docs with one boolean column more, under a name that docs doesn't have: true if the row passes."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    found = metrics(docs.withColumn(name, F.lit(0)), name, text, (whole,))
    return found.select("whole.*", (~base_rule() & compile_rules(rules)).alias(name))


def apply_rules(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five base counts, base_failed and kept, one row for each row of docs."""
    base = base_rule()
    return metrics(docs, doc_id, text).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & compile_rules(rules)).alias("kept"),
    )


def _sql_rules() -> str:
    def one(r):
        parts = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
        return f"(({' AND '.join(parts)}) OR n_words < {r.applies_from})"

    return " AND ".join(one(r) for r in RULES)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce("text", '') AS body,
         regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce("text", ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(translate(body, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines,
         len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\r]*$'))) AS n_ellipses,
         length(regexp_replace(body, '[^\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM t LEFT JOIN cov ON cov.doc_id = t.doc_id),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullets::DOUBLE / n_lines ELSE 0 END AS bullet_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipses::DOUBLE / n_lines ELSE 0 END AS ellipsis_ratio,
         CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules()} AS kept
FROM r
"""
