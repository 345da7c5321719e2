"""Quality rules: a table of thresholds compiled into one Spark projection; no user functions.

Words are runs without ASCII white space. A rule compares 100 * numerator with percent * denominator in whole
numbers, so the verdict has no rounding. Nulls and empty texts have no words and fail the base rule. Repeated rows get
equal results; extra columns pass through `measure` under their own names (those of the metrics are replaced).
Repeated 5-word windows are compared by 64-bit hashes inside one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[ \t-\r]+"
WS_CHARS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it on was as with be by at this are from "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les de et en un une du que dans pour qui sur pas au avec est "
    "el los las del y se por con para su al lo no"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails when `over` and 100 * numerator > percent * denominator, or not `over` and it is less.
    Applies to texts of at least `min_words` words."""

    name: str
    numerator: str
    denominator: str
    percent: int
    over: bool = True
    min_words: int = 0

    def failed(self) -> Column:
        left, right = F.col(self.numerator) * 100, F.col(self.denominator) * self.percent
        return (F.col("n_words") >= self.min_words) & ((left > right) if self.over else (left < right))

    def sql(self) -> str:
        return (f"(n_words >= {self.min_words} AND 100 * {self.numerator} {'>' if self.over else '<'} "
                f"{self.percent} * {self.denominator})")


BASE = (Rule("few_words", "n_words", "one", 1000, over=False), Rule("repeated_windows", "n_repeat_words", "n_words", 20))
RULES = (
    Rule("short_words", "word_chars", "n_words", 200, over=False),
    Rule("long_words", "word_chars", "n_words", 1500),
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("exclamations", "n_bangs", "n_words", 25),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
    Rule("few_stop_words", "n_stop_words", "n_words", 2, over=False, min_words=50),
)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where the optimizer moves or repeats the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(w: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the words w (five at least)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    same = lambda o, j, k: F.coalesce(F.get(o, j)["h"] == F.get(o, k)["h"], F.lit(False))
    places = lambda o: F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: same(o, j, j - 1) | same(o, j, j + 1))
    covered = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda s, j: s + F.least(
        F.lit(5), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(5))))
    by_hash = lambda g: F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = lambda o: F.sort_array(F.transform(places(o), lambda j: F.get(o, j)["i"]))
    count = lambda g: _let(by_hash(g), lambda o: _let(starts(o), covered))
    # Most texts repeat no window and go no further.
    return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), count(g)).otherwise(F.lit(0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns of `docs` without the text, and the counts that rules refer to."""
    t = F.coalesce(F.col(text), F.lit(""))
    metrics = ["n_words", "word_chars", "n_symbols", "n_bangs", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "one"]
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in metrics and not c.startswith("_q_")]
    words = F.array_remove(F.split(t, WS), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WS_CHARS)) != "")
    a = docs.select(*keep, words.alias("_q_w"), lines.alias("_q_l"), (F.size(F.split(t, "\n")) * (t != "").cast("int")).alias("_q_n"),
                    F.regexp_count(t, F.lit(SYMBOLS)).alias("_q_s"), F.regexp_count(t, F.lit("!")).alias("_q_b"))
    w, n = F.col("_q_w"), F.size("_q_w")
    keep = [F.col(f"`{c}`") for c in a.columns if not c.startswith("_q_")]
    return a.select(
        *keep, n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.col("_q_s").cast("long").alias("n_symbols"), F.col("_q_b").cast("long").alias("n_bangs"), F.col("_q_n").cast("long").alias("n_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(n >= 5, _let(w, _repeated)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"), F.lit(1).cast("long").alias("one"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """base_failed, the names of the failed rules, and kept, from the threshold tables."""
    any_of = lambda rs: F.coalesce(F.greatest(*[r.failed() for r in rs], F.lit(False)), F.lit(False))
    names = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)]))
    return measured.select("*", any_of(base).alias("base_failed"), names.alias("failed_rules")).withColumn("kept", F.size("failed_rules") == 0)


def assess(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return judge(measure(docs, text), rules)


def op10_quality_rules(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS ws, string_split(text, chr(10)) AS ls, doc_id, text FROM d),
g AS (SELECT rid, unnest(range(0, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT rid, i, array_to_string(ws[i + 1 : i + 5], ' ') AS gram FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM k) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_bangs,
  CASE WHEN text = '' THEN 0 ELSE len(ls) END AS n_lines,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^ \t-\r]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^ \t-\r]')))) AS BIGINT) AS n_dup_lines,
  len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({_STOPS}))) AS n_stop_words,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, 1 AS one FROM w LEFT JOIN n USING (rid)),
v AS (SELECT *, {' OR '.join(r.sql() for r in BASE)} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {' OR '.join(r.sql() for r in RULES)}) AS kept FROM v
"""
