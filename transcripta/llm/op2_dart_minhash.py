"""MinHash near-duplicates from dart signatures.

A document is a weighted set of its five-word shingles.  Darts fall on the
plane of weight times rank: each element's weight axis is cut into strips of
width one, and in every strip darts arrive along the rank axis as a Poisson
process of rate one, drawn from the hash of (element, strip, number).  A dart
counts if its place on the weight axis is below the element's weight and its
rank below a limit that yields enough darts for ``k`` coordinates.  Each dart
belongs to one coordinate by its hash; the earliest per coordinate is the
signature.  Documents of weighted Jaccard similarity J agree in a coordinate
with probability J, and a text costs O(shingles + k log k) darts instead of
shingles times k.

Signatures are cut into bands; documents that share a band are candidates, and
the exact weighted Jaccard similarity of their shingles decides.  ``links.py``
keeps large groups of copies from becoming pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of
from transcripta.llm.links import linked
from transcripta.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
#: 40 bands of 8: a pair of similarity 0.8 shares a band with probability 0.9994, one of 0.4 with 0.026.
BANDS, ROWS = 40, 8
#: Words hashed at a time in a worker.
WORDS_AT_ONCE = 200_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(2 * n, _GOLD), np.full(2 * n, np.uint64(pow(int(_GOLD), -1, 1 << 64)))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


powers = Powers()
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, number of words per text).

    Words lie between U+0020 and U+0009 to U+000D.  A word's hash is a
    polynomial in its bytes, taken from running sums over the buffer.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    gap = (buf == 32) | ((buf >= 9) & (buf <= 13))
    start = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    end = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    up, down = powers(len(buf))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up, dtype=np.uint64)))
    hashes = mix((total[end] - total[start]) * down[start])
    edges = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(start, edges))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts, number per text).  A shorter text is one shingle; no words: none."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    size = np.repeat(np.minimum(n, words), count)
    out = size.astype(np.uint64)
    padded = np.concatenate((h, np.zeros(words, np.uint64)))
    for j in range(words):
        out = np.where(j < size, mix(out * _GOLD + padded[at + j]), out)
    return out, count


def weighted(items: np.ndarray, count: np.ndarray, by_count: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, distinct item, weight) sorted by text and item."""
    text = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((items, text))
    text, items = text[order], items[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (items[1:] != items[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(text))).astype(float) if by_count else np.ones(len(at))
    return text[at], items[at], weight


def dart_signatures(text: np.ndarray, item: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(n_texts, k) signatures; rows of texts without items are 0."""
    best = np.full(n_texts * k, np.inf)
    sign = np.zeros(n_texts * k, np.uint64)
    # strips of width one on the weight axis
    strips = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(item)), strips)
    strip = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = mix(item[of] + (strip.astype(np.uint64) + np.uint64(1)) * _M1)
    room = weight[of] - strip  # share of the strip that the weight covers
    owner = text[of]
    mass = np.bincount(text, weight, n_texts)
    todo = mass > 0
    limit = np.zeros(n_texts)
    limit[todo] = (k * np.log(k) + 2 * k) / mass[todo]
    at, rank, number = np.arange(len(of)), np.zeros(len(of)), np.zeros(len(of), np.uint64)
    waiting = False
    while True:
        # throw on until every dart line is past the limit of its text
        pending = waiting  # the next dart of a line that stopped at an old limit is drawn already
        live = at
        while len(live):
            if not pending:
                number[live] += np.uint64(1)
                h = mix(seed[live] + number[live] * _GOLD)
                rank[live] -= np.log((h >> np.uint64(11)).astype(float) * 2.0 ** -53 + 2.0 ** -54)
            pending = False
            near = live[rank[live] < limit[owner[live]]]
            h = mix(mix(seed[near] + number[near] * _GOLD) + _M2)
            inside = (h >> np.uint64(40)).astype(float) * 2.0 ** -24 < room[near]
            dart, r = h[inside], rank[near][inside]
            cell = owner[near][inside] * k + (mix(dart) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, r)
            first = best[cell] == r
            sign[cell[first]] = dart[first]
            live = near
        # a text with an empty coordinate gets twice the range; its lines go on where they stopped
        short = todo & np.isinf(best.reshape(n_texts, k)).any(1)
        if not short.any():
            break
        limit[short] *= 2
        at = np.flatnonzero(short[owner])
        at = at[rank[at] < limit[owner[at]]]
        waiting = True
    return sign.reshape(n_texts, k)


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) keys; the band number is part of the key."""
    out = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)[None], len(sign), 0)
    for r in range(rows):
        out = mix(out * _GOLD + sign[:, r::rows])
    return out.view(np.int64)


def _slices(texts: list[str], at_once: int = WORDS_AT_ONCE * 6) -> Iterator[slice]:
    """Runs of texts of about ``at_once`` characters."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= at_once:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _keys(bands: int, rows: int, by_count: bool):
    def run(batches):
        import pandas as pd
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in _slices(texts):
                part = texts[s]
                text, item, weight = weighted(*shingles(part), by_count)
                n = len(part)
                has = np.bincount(text, minlength=n) > 0
                keys = band_keys(dart_signatures(text, item, weight, n, bands * rows), bands, rows)
                ids = pdf["id"].to_numpy()[s]
                yield pd.DataFrame({"id": ids[has], "keys": pd.Series(list(keys[has]), dtype=object)})
    return run


SKETCH_BITS = 4
#: Nearly four standard deviations of the similarity that sketches of 320 coordinates estimate.
SKETCH_MARGIN = 0.09


def _sketch(k: int, by_count: bool):
    """The low bits of each coordinate of the signature, a bit plane after another."""
    def run(batches):
        import pandas as pd
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s in _slices(texts):
                text, item, weight = weighted(*shingles(texts[s]), by_count)
                sign = dart_signatures(text, item, weight, len(texts[s]), k)
                planes = [np.packbits(np.pad(((sign >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), ((0, 0), (0, -k % 64))), axis=1)
                          for b in range(SKETCH_BITS)]
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[s], "sketch": pd.Series(list(np.concatenate(planes, axis=1).view(np.int64)), dtype=object)})
    return run


def _sketches_near(k: int, threshold: float):
    """Condition on two sketches: the estimated similarity is not clearly below the threshold."""
    words = -(-k // 64)

    def near(a: Column, b: Column) -> Column:
        equal = F.lit(-(-k % 64))  # padding always agrees
        for w in range(words):
            differ = None
            for p in range(SKETCH_BITS):
                x = F.get(a, F.lit(p * words + w)).bitwiseXOR(F.get(b, F.lit(p * words + w)))
                differ = x if differ is None else differ.bitwiseOR(x)
            equal = equal + F.bit_count(F.bitwise_not(differ))
        by_chance = 2.0 ** -SKETCH_BITS
        least = k * (by_chance + (1 - by_chance) * (threshold - SKETCH_MARGIN))
        return equal >= F.lit(math.floor(least))
    return near


def _similar(threshold: float, by_count: bool):
    def run(batches):
        for pdf in batches:
            keep = []
            for i in range(0, len(pdf), 64):
                a, b = pdf["text_a"].iloc[i:i + 64].tolist(), pdf["text_b"].iloc[i:i + 64].tolist()
                text, item, weight = weighted(*shingles(a + b), by_count)
                n, mass = len(a), np.bincount(text, weight, len(a) * 2)
                pair = text % n
                order = np.lexsort((item, pair))
                p, it, w = pair[order], item[order], weight[order]
                same = (p[1:] == p[:-1]) & (it[1:] == it[:-1])
                both = np.bincount(p[1:][same], np.minimum(w[1:], w[:-1])[same], n)
                union = mass[:n] + mass[n:] - both
                keep.append(both >= threshold * union - 1e-9)
            yield pdf.loc[np.concatenate(keep) if keep else [], ["a", "b"]]
    return run


def near_groups(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                by_count: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id, copies``: the smallest id of the near-duplicate class, one row per document.

    ``copies`` counts the rows with exactly this text.  Weights are 1 per
    distinct shingle, or its number of occurrences with ``by_count``.  Equal
    texts are one class; a text without words (or null) is similar to its
    equals only.  Ids are meant to be unique; if one comes
    with several texts, they share a class and the smallest text stands for it.
    Rows whose id is null take no part and have a null class.
    """
    rows_in = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    # equal texts first: one id stands for them
    same = cut_lineage(rows_in.select("doc_id", digest.alias("digest")), "near-ids")
    heads = cut_lineage(same.filter("doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies")), "near-heads")
    texts = rows_in.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    keyed = texts.mapInPandas(_keys(bands, rows, by_count), "id long, keys array<long>")
    keyed = keyed.join(heads.select("id"), "id", "left_semi")
    entries = cut_lineage(keyed.select(F.explode("keys").alias("key"), "id"), "near-bands")
    # the texts stay where they are hashed to, whatever the number of candidates
    body = lambda ids: texts.join(ids.hint("shuffle_hash"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    classes = linked(entries, None, body, _similar(threshold, by_count), _sketch(bands * rows, by_count),
                     _sketches_near(bands * rows, threshold), "near-links")
    heads = heads.join(classes, "id", "left").select("digest", F.coalesce("comp", "id").alias("class_id"), "copies")
    joined = same.join(heads, "digest", "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "copies")


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """The first document of each near-duplicate class (and rows without an id), columns as they came.

    Of rows that share the kept id one stays, the one with the smallest hash of its columns.
    """
    groups = near_groups(docs, **options)
    drop = groups.filter("doc_id != class_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(drop, docs["doc_id"] == drop["__id"], "left_anti")
    again = cut_lineage(docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
                        .filter("__n > 1").select("__id"), "near-repeated")
    once = kept.join(again, kept["doc_id"] == again["__id"], "left_anti")
    row = [F.col(f"`{c}`") for c in docs.columns]
    one = (kept.join(again, kept["doc_id"] == again["__id"], "left_semi").groupBy(F.col("doc_id").alias("__id"))
           .agg(F.min_by(F.struct(*row), F.xxhash64(*row)).alias("__row")))
    return once.unionByName(one.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
