"""Mixing sources to target weights by weighted fair queueing (native).

Each source shuffles its documents by a hash of the id and serves them in
that order, again from the start when they run out, up to ``max_repeats``
times.  A copy's virtual finish time is the source's tokens served up to and
including it, divided by the source's target.  All copies are ordered by
finish time and the order is cut where the running total reaches the budget.

Nothing runs over a whole source or over all rows in one task: running sums go
over value slices (a slice of the hash, a slice of the virtual time), whose
totals are one row each, and only then over the rows of one slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcripta.functions.ranking import global_row_number
from transcripta.llm.common import table, text_of, words_of
from transcripta.session import cut_lineage

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slices of the shuffle order and of the virtual time (powers of 16).
ORDER_DIGITS = 3
TIME_SLICES = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = 1.0,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` (one row a document).

    A target is the budget times the source's share of the weights, but at most
    ``max_repeats`` times its size; the excess goes to the others by weight.
    That is one water level for all: sorted by the level at which a source
    fills up, the level is found from running sums.  One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    per = (per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", w)
           .withColumn("cap", (F.col("source_size") * max_repeats).cast("double")))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
           .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
           .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_left")))
    # the first source that does not fill up at its own level sets the level for it and all after it
    per = per.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level")))
    per = per.withColumn("water", first.over(everything)["level"])
    per = per.withColumn("target", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
    return per.select("source", "source_size", "target")


def _running(*order) -> Window:
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fair_queue(docs: DataFrame, weights=WEIGHTS, budget_share: float = 1.0, max_repeats: int = MAX_REPEATS,
               doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, tie, size, source, source_size, target, copies``.

    ``size`` is the number of words (null text: 0) and ``copies`` how often the
    mix takes the document.  ``tie`` (crc32 of the text) orders rows that share
    an id; rows alike in id, size and text are interchangeable.  Documents of
    size 0 are never taken.  An empty table gives an empty table.
    """
    body = text_of(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                       F.size(words_of(body)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("tie"))
    key = F.md5(F.concat(F.lit(SEED + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # a few dozen bytes a document, written once: the texts are read once and lost executors cost no more than that
    rows = cut_lineage(rows.withColumn("key", F.substring(key, 1, 16)), "mix-rows")
    rows = rows.withColumn("slice", F.substring("key", 1, ORDER_DIGITS))
    targets = source_targets(rows, weights, budget_share, max_repeats)
    budget = targets.agg(F.round(F.sum("target")).cast("long")).first()[0] or 0

    # tokens of the source before each slice of the order: at most 16 ** ORDER_DIGITS rows a source
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    slices = slices.withColumn("start", F.sum("in_slice").over(
        Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_slice"))
    slices = _null_safe(slices.drop("in_slice"), targets)
    inside = (Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie")
              .rowsBetween(Window.unboundedPreceding, 0))
    queue = _null_safe(rows.withColumn("served", F.sum("size").over(inside)), slices, "slice")
    queue = queue.withColumn("served", F.col("served") + F.col("start"))

    # every copy's virtual finish time; the running total in that order ends at the budget
    copies = (queue.filter("size > 0")
              .select("source", "size", "target", F.explode(F.transform(
                  F.sequence(F.lit(0), F.lit(max_repeats - 1)),
                  lambda e: F.col("served") + e * F.col("source_size"))).alias("place"))
              .withColumn("finish", F.col("place").cast("double") / F.col("target"))
              .withColumn("time", F.least(F.floor(F.col("finish") * TIME_SLICES), F.lit(2 * TIME_SLICES))))
    times = copies.groupBy("time").agg(F.sum("size").alias("in_time"))
    times = times.withColumn("time_start", F.sum("in_time").over(_running("time")) - F.col("in_time")).drop("in_time")
    times = times.filter(F.col("time_start") < budget)  # at most 2 * TIME_SLICES + 1 rows
    total = F.col("time_start") + F.sum("size").over(
        Window.partitionBy("time").orderBy("finish", F.col("source").asc_nulls_last(), "place")
        .rowsBetween(Window.unboundedPreceding, 0))
    mix = copies.join(F.broadcast(times), "time").withColumn("total", total).filter(F.col("total") <= budget)
    # a source is served in order, so the last place that made it tells which copies did
    last = mix.groupBy("source").agg(F.max("place").alias("last"))
    queue = _null_safe(queue, last, how="left")
    left_over = F.greatest(F.lit(0), F.coalesce("last", F.lit(0)) - F.col("served") + F.col("source_size"))
    n = F.when(F.col("size") > 0, F.floor(left_over / F.col("source_size"))).otherwise(0).cast("int")
    return queue.select("doc_id", "tie", "size", "source", "source_size", "target", n.alias("copies"))


def _null_safe(left: DataFrame, right: DataFrame, *also: str, how: str = "inner") -> DataFrame:
    """Join on ``source`` (null equals null) and the columns ``also``."""
    names = {c: f"__r_{c}" for c in ("source", *also)}
    r = right.withColumnsRenamed(names)
    on = left["source"].eqNullSafe(r["__r_source"])
    for c in also:
        on = on & (left[c] == r[f"__r_{c}"])
    return left.join(r, on, how).drop(*names.values())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, a document taken n times as n rows, with the columns of ``docs``.

    Rows that share id, source and text are taken together as often as the
    queue took them: their copies are dealt out evenly over them.
    """
    n = fair_queue(docs, **options).groupBy("doc_id", "tie", "size", "source").agg(
        F.sum("copies").alias("__n"), F.count(F.lit(1)).alias("__rows")).filter("__n > 0")
    n = n.withColumnsRenamed({"doc_id": "__id", "tie": "__tie", "size": "__size", "source": "__source"})
    tie = F.crc32(text_of().cast("binary"))
    size = F.size(words_of(text_of())).cast("long")
    out = docs.join(n, docs["doc_id"].eqNullSafe(n["__id"]) & (tie == n["__tie"]) & (size == n["__size"])
                    & docs["source"].eqNullSafe(n["__source"]))
    # repeated rows are numbered by ranges, so that no task holds all rows of one document
    keys = ["__id", "__tie", "__size", "__source"]
    many, _ = global_row_number(out.filter("__rows > 1").withColumn("__at", F.monotonically_increasing_id()), [*keys, "__at"], "__place")
    first = many.groupBy(*keys).agg(F.min("__place").alias("__first")).withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [many[k].eqNullSafe(first[f"{k}_"]) for k in keys]
    many = many.join(first, on[0] & on[1] & on[2] & on[3])
    share = F.floor(F.col("__n") / F.col("__rows")) + F.when(F.col("__place") - F.col("__first") < F.col("__n") % F.col("__rows"), 1).otherwise(0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    every = out.filter("__rows = 1").select(*columns, F.col("__n").cast("int").alias("__n")).unionByName(
        many.select(*columns, share.cast("int").alias("__n")).filter("__n > 0"))
    return every.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns)


def op9_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fair_queue(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_sql(docs: str = "documents", weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> str:
    """DuckDB: ``doc_id, size, source, source_size, target, copies`` by plain windows."""
    ws = "[" + ", ".join(f"{float(w)}" for w in weights) + "]"
    return f"""
WITH rows AS (
  SELECT *, substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS key FROM (
    SELECT row_number() OVER () AS rid, doc_id, source, text AS t0,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs})),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank
  FROM rows GROUP BY source),
lev AS (
  SELECT *, (budget - full_before) / weight_left AS level FROM (
    SELECT *, sum(source_size) OVER () AS budget,
      coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
      sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
    FROM (SELECT *, ({ws})[rank % {len(weights)} + 1] AS weight, ({max_repeats} * source_size)::DOUBLE AS cap FROM per))),
water AS (SELECT arg_min(level, (cap / weight, rank)) FILTER (level * weight <= cap) AS w FROM lev),
tar AS (SELECT source, source_size, least(cap, coalesce((SELECT w FROM water) * weight, cap)) AS target FROM lev),
queue AS (
  SELECT rows.*, source_size, target,
    sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id NULLS LAST, size, rid ROWS UNBOUNDED PRECEDING) AS served
  FROM rows JOIN tar ON rows.source IS NOT DISTINCT FROM tar.source),
copies AS (
  SELECT rid, source, size, served + e * source_size AS place, (served + e * source_size)::DOUBLE / target AS finish
  FROM queue, range(0, {max_repeats}) r(e) WHERE size > 0),
mix AS (
  SELECT rid, count(*) AS n FROM (
    SELECT rid, sum(size) OVER (ORDER BY finish, source NULLS LAST, place ROWS UNBOUNDED PRECEDING) AS total FROM copies)
  WHERE total <= (SELECT round(sum(target))::BIGINT FROM tar) GROUP BY rid)
SELECT doc_id, size, source, source_size, target, coalesce(n, 0)::INTEGER AS copies, rid
FROM queue LEFT JOIN mix USING (rid)"""


ORACLE = f"SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM ({mix_sql()})"
