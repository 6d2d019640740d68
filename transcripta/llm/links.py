"""Links between keyed entries without listing all pairs of a bucket.

Entries ``key, id`` share a bucket if they share a key.  *Indexed* entries are
compared with all others, *probes* with indexed ones only.  ``linked`` finds
the connected components of the verified links in two rounds:

1. every entry of a bucket against the bucket's smallest indexed id (its hub);
2. in buckets that still hold several components, every entry that is not in
   the hub's component against the entries of the other components.

All pairs that round 2 leaves out are in one component already, so the
components are those of all pairs, while a bucket of m mutual copies costs m
comparisons.  Components come from rounds of joins; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transcripta.session import cut_lineage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, comp`` (the smallest id reachable) for every id in ``edges a, b``.

    Alternates the large-star and small-star steps until the edge set is a set
    of stars.  Each step groups by the larger or all ends; a hub's neighbours
    are never gathered, only their minimum.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u != v").distinct(), name)
    while True:
        # large star: each node's larger neighbours point to the smallest of node and neighbours
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(
            e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = (both.filter("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v"))
                 .filter("u != v").distinct())
        large = cut_lineage(large, name)
        # small star: each node and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v"))).filter("u != v").distinct())
        small = cut_lineage(small, name)
        # a set of stars: no node is both an end and a hub, and every end has one hub
        ends = small.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if ends["n"] == ends["d"] and small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        e = small
    return small.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        small.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def linked(index: DataFrame, probes: DataFrame | None, texts_of: Callable[[DataFrame], DataFrame],
           similar: Callable, sketch: Callable, maybe: Callable, name: str = "links") -> DataFrame:
    """``id, comp`` for every id that has a link.

    ``index`` and ``probes``: ``key long, id long``.  ``texts_of`` takes a frame
    of distinct ``id`` and gives ``id, text``; ``similar`` is a ``mapInPandas``
    function from ``a, b, text_a, text_b`` to the pairs ``a, b`` that are links.
    ``sketch`` is one from ``id, text`` to ``id, sketch`` (an array of longs), and
    ``maybe`` a condition on two sketches that holds for links; in round 2 it
    is part of the join, so pairs that only share a bucket are not made.
    """
    index = cut_lineage(index, name)
    heads = index.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top"))
    many = heads.filter("hub != top")
    shared = index.join(many, "key").select("key", "id", "hub", F.lit(True).alias("many"), F.lit(False).alias("probe"))
    if probes is not None:
        shared = shared.unionByName(
            probes.join(heads.hint("shuffle_hash"), "key").filter("id != hub OR hub != top")
            .select("key", "id", "hub", (F.col("hub") != F.col("top")).alias("many"), F.lit(True).alias("probe")))
    shared = cut_lineage(shared, name)
    first = cut_lineage(_pairs(shared.filter("id != hub"), "id", "hub"), name)
    ids = first.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut_lineage(texts_of(ids), name)  # all ids of shared buckets are in a pair of round 1

    def verify(pairs: DataFrame) -> DataFrame:
        full = (pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
                .join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b"))
        return cut_lineage(full.mapInPandas(similar, "a long, b long"), name)

    edges = verify(first)
    comp = cut_lineage(components(edges, name), name)
    # buckets of several indexed ids: entries in the hub's component, and those outside it
    rest = shared.filter("many").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    hub = comp.select(F.col("id").alias("hub"), F.col("comp").alias("hub_comp"))
    rest = rest.join(hub, "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
    rest = cut_lineage(rest.select("key", "id", "probe", "comp", "hub", (F.col("comp") != F.col("hub_comp")).alias("out")), name)
    mixed = rest.filter("out").select("key").distinct()
    sketches = texts.mapInPandas(sketch, "id long, sketch array<long>")
    rest = cut_lineage(rest.join(mixed, "key", "left_semi").join(sketches, "id"), name)
    columns = ["key", "id", "probe", "comp", "sketch"]
    once = F.lit(True)
    if probes is None:  # a pair that shares several buckets is made in the first of them
        keys = rest.groupBy("id").agg(F.collect_set("key").alias("keys"))  # as many as an id has keys
        rest, columns = rest.join(keys, "id"), [*columns, "keys"]
        once = F.col("key") == F.array_min(F.array_intersect("o_keys", "keys"))
    out = rest.filter("out").select(*[F.col(c).alias(f"o_{c}") for c in columns])
    # the hub itself was compared with all in round 1
    pairs = out.join(rest.filter("id != hub"), (F.col("o_key") == F.col("key")) & (F.col("o_comp") != F.col("comp"))
                     & ~(F.col("o_probe") & F.col("probe")) & maybe(F.col("o_sketch"), F.col("sketch")) & once)
    pairs = cut_lineage(_pairs(pairs, "o_id", "id").join(first, ["a", "b"], "left_anti"), name)
    if pairs.isEmpty():
        return comp
    more = verify(pairs)
    if more.isEmpty():
        return comp
    # a component's links are replaced by its star, the new links join stars
    return components(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more), name)


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
