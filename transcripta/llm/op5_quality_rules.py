"""Quality rules: a threshold table compiled into one projection (native).

The measures of a text (lengths, symbols, stop words, lines) are Spark column
expressions; a table of ``Rule`` rows becomes one boolean projection over
them.  No user function, shuffle or join takes part, so the work is one scan.

Repeated words are found per text in O(n log n): the hashes of all three-word
windows are sorted with their positions, the positions of those that occur
twice are sorted again, and the union of the three-word spans is summed.  The
sort is only evaluated for texts that have a repeated window at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import WORD_GAP, table, text_of, words_of

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Marks that are rare in prose and common in shouting or spam (fixed values).
LOUD = "!?"
#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "by", "this", "or", "an",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "au", "par", "sur", "pas", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "dem", "ist", "im", "ein", "eine", "nicht", "auf", "für", "einen",
    "el", "y", "los", "se", "del", "las", "con", "por", "su", "para", "al", "lo", "como", "es", "una",
)


@dataclass(frozen=True)
class Rule:
    """``measure`` (divided by ``per``, if given) must lie in [low, high]."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: Base rules, then the ratios.  A document is kept if no rule fails.
BASE_RULES = (
    Rule("few_words", "n_words", low=50),
    Rule("repeated_words", "n_repeat_words", per="n_words", high=0.5),
)
RATIO_RULES = (
    Rule("word_length", "word_chars", per="n_words", low=2, high=12),
    Rule("symbols", "n_symbols", per="n_words", high=0.1),
    Rule("loud_marks", "n_loud", per="n_words", high=0.3),
    Rule("stop_words", "n_stop_words", per="n_words", low=0.02),
    Rule("bullet_lines", "n_bullet_lines", per="n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", per="n_lines", high=0.3),
    Rule("dup_lines", "n_dup_lines", per="n_lines", high=0.5),
)


def _count_of(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def _sorted_windows(grams: Column) -> Column:
    """Windows with their positions, sorted; empty if no window repeats."""
    order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), order).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))


def _repeat_places(order: Column) -> Column:
    """Sorted positions of the windows that occur twice or more."""
    hit = F.filter(order, lambda s, j: (F.get(order, j - 1)["g"].eqNullSafe(s["g"]))
                   | (F.get(order, j + 1)["g"].eqNullSafe(s["g"])))
    return F.sort_array(F.transform(hit, lambda s: s["i"]))


def _covered(at: Column) -> Column:
    """Words under the union of the three-word spans that start at ``at``."""
    span = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
    return F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x)


def measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measures of ``text`` (null: empty) as long columns.

    ``prefix`` keeps them clear of columns of the same name; a column that
    has the name of a measure is replaced.
    """
    t, p = text_of(text), prefix
    w, g, lines, order, at = (f"{p}__{x}" for x in ("words", "grams", "lines", "order", "at"))
    out = docs.withColumns({
        w: words_of(t),
        lines: F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, WORD_GAP, "")) > 0),
    })
    out = out.withColumn(g, F.transform(
        F.slice(F.col(w), 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2))))
    # each array is a column of its own, so that a lambda looks into it and does not build it again
    out = out.withColumn(order, _sorted_windows(F.col(g)))
    out = out.withColumn(at, _repeat_places(F.col(order)))
    first = lambda x: F.ltrim(x)
    out = out.withColumns({
        f"{p}n_words": F.size(w).cast("long"),
        f"{p}word_chars": F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        f"{p}n_symbols": _count_of(t, SYMBOLS),
        f"{p}n_loud": _count_of(t, LOUD),
        f"{p}n_stop_words": F.size(F.filter(F.col(w), lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        f"{p}n_lines": F.size(lines).cast("long"),
        f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        f"{p}n_bullet_lines": F.size(F.filter(F.col(lines), lambda x: F.substring(first(x), 1, 1).isin("-", "*", "•"))).cast("long"),
        f"{p}n_ellipsis_lines": F.size(F.filter(F.col(lines), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
        f"{p}n_repeat_words": _covered(F.col(at)),
    })
    return out.drop(w, g, lines, order, at)


def broken(rule: Rule, prefix: str = "") -> Column:
    """True where the rule fails.  Ratios are compared without a division."""
    x = F.col(prefix + rule.measure).cast("double")
    unit = F.col(prefix + rule.per).cast("double") if rule.per else F.lit(1.0)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (x < F.lit(float(rule.low)) * unit)
    if rule.high is not None:
        out = out | (x > F.lit(float(rule.high)) * unit)
    return out


def quality_rules(docs: DataFrame, rules=BASE_RULES + RATIO_RULES, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measures, ``failed`` (names of the rules that fail, in table
    order) and ``kept``.

    Null and empty texts have no words, so ``few_words`` fails.  Repeated rows
    are judged one by one; an empty table gives an empty table.
    """
    out = measures(docs, text, prefix)
    failed = F.array_compact(F.array(*[F.when(broken(r, prefix), F.lit(r.name)) for r in rules]))
    return out.withColumn(f"{prefix}failed", failed).withColumn(f"{prefix}kept", F.size(f"{prefix}failed") == 0)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that pass all rules, with the columns they came with."""
    judged = quality_rules(docs, prefix="__q_").withColumn("__q_row", F.monotonically_increasing_id())
    # the row number holds the filter above the projection; below it, every lambda would build the arrays anew
    return judged.filter(F.col("__q_kept") & (F.col("__q_row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.lit(False)
    for r in BASE_RULES:
        base = base | F.array_contains("failed", r.name)
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "n_loud", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _sql_rule(r: Rule) -> str:
    unit = f" * CAST({r.per} AS DOUBLE)" if r.per else ""
    parts = []
    if r.low is not None:
        parts.append(f"CAST({r.measure} AS DOUBLE) < {float(r.low)}{unit}")
    if r.high is not None:
        parts.append(f"CAST({r.measure} AS DOUBLE) > {float(r.high)}{unit}")
    return "(" + " OR ".join(parts) + ")"


def measures_sql(docs: str = "documents") -> str:
    """DuckDB: one row per document with ``doc_id`` and the measures."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
SELECT doc_id, rid, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (length(t) - length(translate(t, '{LOUD}', '')))::BIGINT AS n_loud,
  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  len(list_filter(l, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
  len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…'))::BIGINT AS n_ellipsis_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words
FROM (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {docs})) d
LEFT JOIN (
  SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM (
        SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
          SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM (
            SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w
            FROM (SELECT row_number() OVER () AS rid, coalesce(text, '') AS t FROM {docs})))))
    WHERE k > 1)
  GROUP BY rid) r USING (rid)"""


ORACLE = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({' OR '.join(_sql_rule(r) for r in BASE_RULES)}) AS base_failed,
  NOT ({' OR '.join(_sql_rule(r) for r in (*BASE_RULES, *RATIO_RULES))}) AS kept,
  n_loud, n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines
FROM ({measures_sql()})"""
