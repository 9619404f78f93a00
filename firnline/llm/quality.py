"""Quality rules: a table of thresholds compiled into one projection.

Every metric and the verdict are built-in expressions over one row, so the operator has no
shuffle, no user function and no state; rows of one hot source are as cheap as any others.

Defined results: a null text has no words and fails the length rule, as an empty one does; a
null in any other column is carried through; repeated rows are judged alike, each on its own;
extra columns are kept, whatever their names. Texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.words import NOT_SPACE, table, whole, words_of

# Frequent function words, lower case.
STOP_WORDS = (
    # English
    "the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "it", "for", "on",
    "was", "as", "at", "by", "this", "from", "or", "are", "an", "not", "but",
    # French
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour",
    "pas", "sur", "au", "est", "ce",
    # German
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "ist", "im", "dem", "nicht",
    "ein", "eine", "auf", "für", "als",
    # Spanish
    "el", "y", "los", "se", "del", "las", "por", "con", "su", "para", "al", "lo", "como", "no",
)
SYMBOLS = "[#*$%&|<>]"


class Rule(NamedTuple):
    """low <= 100 * metric / per <= high, in whole numbers; a missing bound is none."""

    name: str
    metric: str
    per: str
    low: int | None
    high: int | None


RULES = (
    Rule("mean word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols per word", "n_symbols", "n_words", None, 10),
    Rule("stop words", "n_stop_words", "n_words", 2, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("lines that trail off", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 90),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_METRICS = "word_chars n_symbols n_stop_words n_lines n_dup_lines n_ellipsis_lines n_bullet_lines n_repeat_words"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, evaluated once however often `body` names it.

    A column of an inner projection is not that: when a filter is pushed through the projection,
    its definition takes the place of every mention, those inside lambdas included.
    """
    return F.get(F.transform(F.array(value), body), 0)


def repeat_words(words: Column, window: int) -> Column:
    """Number of words in windows of `window` words found twice or more in the text.

    Each window is one 64-bit number, its hash in the high bits and its place in the low ones, so
    that one sort of plain numbers brings equal windows together. Neighbours with equal hashes
    count only if their words are equal.
    """

    def of_words(w: Column) -> Column:
        count = F.size(w)
        return bound(
            F.struct(w.alias("words"), F.length(F.bin(count.cast("long"))).alias("bits")),
            lambda s: bound(
                F.struct(s["words"].alias("words"), s["bits"].alias("bits"),
                         (F.call_function("shiftleft", F.lit(1).cast("long"), s["bits"]) - 1).alias("mask")),
                of_bits,
            ),
        )

    def of_bits(s: Column) -> Column:
        w, mask = s["words"], s["mask"]

        def code(_: Column, i: Column) -> Column:
            hashed = F.xxhash64(*[F.get(w, i + j) for j in range(window)])
            # hash * 2^bits, wrapped round as a shift is
            return F.call_function("shiftleft", hashed, s["bits"]).bitwiseOR(i.cast("long"))

        starts = F.slice(w, 1, F.size(w) - (window - 1))
        codes = F.when(F.size(w) >= window, F.sort_array(F.transform(starts, code))).otherwise(
            F.array().cast("array<bigint>")
        )
        return bound(codes, lambda c: bound(twins(w, mask, c), lambda t: covered(t, mask, c)))

    def twins(w: Column, mask: Column, codes: Column) -> Column:
        """i where the windows in places i and i + 1 of the sorted codes are equal."""

        def place(i: Column) -> Column:
            return F.get(codes, i).bitwiseAND(mask).cast("int")

        def equal(i: Column) -> Column:
            same = F.get(codes, i + 1) <= F.get(codes, i).bitwiseOR(mask)
            for j in range(window):
                same = same & (F.get(w, place(i) + j) == F.get(w, place(i + 1) + j))
            return same

        pairs = F.filter(F.sequence(F.lit(0), F.size(codes) - 2), equal)
        return F.when(F.size(codes) >= 2, pairs).otherwise(F.array().cast("array<int>"))

    def covered(twin: Column, mask: Column, codes: Column) -> Column:
        both = F.array_union(twin, F.transform(twin, lambda i: i + 1))
        places = F.sort_array(F.transform(both, lambda i: F.get(codes, i).bitwiseAND(mask)))
        none = F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))

        def add(acc: Column, p: Column) -> Column:
            more = F.least(F.lit(window).cast("long"), p - acc["last"])
            return F.struct(p.alias("last"), (acc["total"] + more).alias("total"))

        return F.aggregate(places, none, add, lambda acc: acc["total"])

    return bound(words, of_words)


def trails_off(line: Column) -> Column:
    line = F.rtrim(line)
    return line.endswith("...") | line.endswith("…")


def starts_as_bullet(line: Column) -> Column:
    return F.substring(F.ltrim(line), 1, 1).isin("-", "*", "•")


def measure(df: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """`_row` with the columns of `df` as they are, and beside it n_words, the metrics of the rules
    and n_repeat_words."""
    row = df.select(F.struct("*").alias("_row"))
    body = whole(F.col("_row").getField(text))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE))
    metrics = (
        row.withColumns({"_words": words_of(body), "_lines": lines})
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumns(
            {
                "word_chars": F.length(F.array_join("_words", "")),
                "n_symbols": F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, "")),
                "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))),
                "n_lines": F.size("_lines"),
                "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
                "n_ellipsis_lines": F.size(F.filter("_lines", trails_off)),
                "n_bullet_lines": F.size(F.filter("_lines", starts_as_bullet)),
            }
        )
    )
    return metrics.withColumn("n_repeat_words", repeat_words(F.col("_words"), window)).select(
        "_row", "n_words", *(F.col(m).cast("long").alias(m) for m in _METRICS.split())
    )


def base_failed(metric: Callable[[str], Column] = F.col) -> Column:
    return (metric("n_words") < MIN_WORDS) | (
        100 * metric("n_repeat_words") > MAX_REPEAT_PERCENT * metric("n_words")
    )


def verdict(rules: tuple[Rule, ...] = RULES, metric: Callable[[str], Column] = F.col) -> Column:
    """All rules of the table as one boolean expression."""
    passed = F.lit(True)
    for rule in rules:
        value = 100 * metric(rule.metric)
        if rule.low is not None:
            passed = passed & (value >= rule.low * metric(rule.per))
        if rule.high is not None:
            passed = passed & (value <= rule.high * metric(rule.per))
    return passed


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `df` that pass, with its columns."""
    passed = bound(
        F.struct("n_words", *_METRICS.split()),
        lambda m: ~base_failed(m.getField) & verdict(rules, m.getField),
    )
    return measure(df, text).where(passed).select("_row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"),
        "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines",
    )


def _rules_sql() -> str:
    parts = []
    for r in RULES:
        parts += [f"100 * {r.metric} >= {r.low} * {r.per}"] if r.low is not None else []
        parts += [f"100 * {r.metric} <= {r.high} * {r.per}"] if r.high is not None else []
    return " AND ".join(parts)


def measured_sql(documents: str = "documents") -> str:
    """DuckDB: doc_id with the metrics and base_failed of every row of `documents`."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
    SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed
    FROM (
      SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(list_filter(words, lambda w: w IN ({stop})))::BIGINT AS n_stop_words,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(lines, lambda s: regexp_matches(s, '(\.\.\.|…) *$')))::BIGINT AS n_ellipsis_lines,
        len(list_filter(lines, lambda s: regexp_matches(s, '^ *[-*•]')))::BIGINT AS n_bullet_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
        FROM {documents}
      ) d LEFT JOIN (
        SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (
              SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {documents}))
          ) WHERE c > 1) GROUP BY doc_id
      ) r ON r.doc_id = d.doc_id
    )"""


OP3_SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {_rules_sql()}) AS kept, n_stop_words, n_lines, n_ellipsis_lines, n_bullet_lines
FROM ({measured_sql()})"""
KEPT_SQL = f"SELECT doc_id FROM ({measured_sql()}) WHERE NOT base_failed AND {_rules_sql()}"
