"""Spelling variants by composing the vocabulary acceptor with a one-edit transducer.

The vocabulary is a minimised acyclic acceptor A.  The one-edit transducer T
copies, makes one replacement or one insertion, and copies on; the words that
A o T o A relates are the near pairs.

The composition is cut by its initial states.  For words of n code points and
those of n + 1, the place of the edit (the length of the common prefix, 0 to
n) lies in a window; what stands before and after the window is common to
both words.  It is the *key* of a partition: both acceptors start in the states
that their key leads to, and the composition runs over the windows only.  The
first cut halves the places; a partition that still holds more than
``max_words`` words, or words with long windows, is halved again, until it is
small or its window is one place, where the alphabet bounds it.  So no task grows with the vocabulary,
and every pair is met in exactly one partition: the one that holds its place.

Spark counts the words, deals the partitions by their keys and reduces the
pairs; chains of forms are followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of
from transcripta.session import cut_lineage

MIN_CHARS = 6
MIN_COUNT = 5
TIMES = 5
#: a partition with more words is cut again
MAX_WORDS = 2048
#: a partition with a longer window is cut again
MAX_PLACES = 200
#: one run in so many loses a code point
SLIP = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: runs of letters, ASCII lower-cased, with a code point lost where ``slip`` divides the run's hash.

    A null text has no runs, a null id counts as empty; repeated rows count each time.
    """
    letters = F.split(F.translate(text_of(text), UPPER, LOWER), "[^a-z\\u00C0-\\u00FF]+")
    run = F.col("run")
    h = F.crc32(F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    word = F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return (docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.explode(letters).alias("run"))
            .filter(F.length(run) >= min_chars).select(word.alias("word")).filter(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))


class Acceptor:
    """A minimal acyclic automaton: states with equal arcs are one state."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]  # state 0 accepts the empty string alone
        self.known: dict[tuple, int] = {}
        self.shared: dict[tuple[int, int], tuple[str, ...]] = {}

    def state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        """The state that accepts ``words[lo:hi]`` (sorted, distinct, of one length) from ``depth`` on."""
        if len(words[lo]) == depth:
            return 0
        out, i = [], lo
        while i < hi:
            c, j = words[i][depth], i + 1
            while j < hi and words[j][depth] == c:
                j += 1
            out.append((c, self.state(words, i, j, depth + 1)))
            i = j
        key = tuple(out)
        if (s := self.known.get(key)) is None:
            s = self.known[key] = len(self.arcs)
            self.arcs.append(dict(out))
        return s

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """The strings that both states accept."""
        if p > q:
            p, q = q, p
        if p == 0:
            return ("",) if q == 0 else ()
        if (found := self.shared.get((p, q))) is None:
            other = self.arcs[q]
            found = self.shared[p, q] = tuple(
                c + x for c, s in self.arcs[p].items() if c in other for x in self.common(s, other[c]))
        return found

    def replaced(self, s: int, read: str = "") -> Iterator[tuple[str, str]]:
        """Pairs of accepted strings that differ in one place."""
        arcs = list(self.arcs[s].items())
        for i, (c, p) in enumerate(arcs):
            for d, q in arcs[i + 1:]:
                for x in self.common(p, q):
                    yield read + c + x, read + d + x
            yield from self.replaced(p, read + c)

    def inserted(self, s: int, t: int, places: int, read: str = "") -> Iterator[tuple[str, str]]:
        """Pairs (string from s, string from t with one more symbol after the common prefix, which is shorter than ``places``)."""
        if len(read) < places:
            for c, q in self.arcs[t].items():
                for x in self.common(s, q):
                    if not x.startswith(c):
                        yield read + x, read + c + x
            for c, p in self.arcs[s].items():
                if c in self.arcs[t]:
                    yield from self.inserted(p, self.arcs[t][c], places, read + c)


def _compose(batches):
    """Rows sorted by key -> near pairs; a key may span batches."""
    import pandas as pd

    def pairs_of(short: dict, long: dict, places: int, acceptor: Acceptor) -> list[tuple]:
        s = acceptor.state(sorted(short), 0, len(short), 0)
        found = [(short[a], short[b]) for a, b in acceptor.replaced(s)]
        if long:
            t = acceptor.state(sorted(long), 0, len(long), 0)
            found += [(short[a], long[b]) for a, b in acceptor.inserted(s, t, places)]
        return found

    acceptor, out, key, short, long, places = Acceptor(), [], None, {}, {}, 0

    def frame():
        rows = [(a, m, b, n) for (a, m), (b, n) in out]
        out.clear()
        return pd.DataFrame(rows, columns=["a", "n_a", "b", "n_b"])

    for pdf in batches:
        for k, w, n, lo, cut, is_long, p in zip(pdf["key"], pdf["word"], pdf["n"], pdf["lo"], pdf["cut"], pdf["is_long"], pdf["places"]):
            if k != key:
                if short and len(short) + len(long) > 1:
                    out += pairs_of(short, long, places, acceptor)
                    if len(acceptor.arcs) + len(acceptor.shared) > 500_000:
                        acceptor = Acceptor()
                key, short, long = k, {}, {}
            places = p
            (long if is_long else short)[w[lo:len(w) - cut]] = (w, n)
        if len(out) >= 10_000:
            yield frame()
    if short and len(short) + len(long) > 1:
        out += pairs_of(short, long, places, acceptor)
    yield frame()


def near_pairs(words: DataFrame, max_words: int = MAX_WORDS, max_places: int = MAX_PLACES) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of ``word, n`` (distinct words) one inserted, deleted or replaced code point apart, once."""
    size = F.length("word")
    # the words of n code points are the short ones of class n and the long ones of class n - 1
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("cls")).select(
        "word", "n", "cls", (size > F.col("cls")).alias("is_long"), F.lit(0).alias("lo"), (F.col("cls") + 1).alias("hi"))
    rows, done = _halved(rows), None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("places").alias("places"))
        again = cut_lineage(sizes.filter((F.col("places") > 1) & ((F.col("rows") > max_words) | (F.col("places") > max_places)))
                            .select("key", "rows"), "large-partitions")
        if again.isEmpty():
            break
        small = rows.join(again, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = cut_lineage(_halved(rows.join(again.filter("rows > 1"), "key", "left_semi")), "halved-partitions")
    done = rows if done is None else done.unionByName(rows)
    columns = ["key", "word", "n", "lo", "cut", "is_long", "places"]
    return (done.select(*columns).repartition("key").sortWithinPartitions("key")
            .mapInPandas(_compose, "a string, n_a long, b string, n_b long"))


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of each row's window [lo, hi) of places, with the key that the words of a half share."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("hi").alias("y"))))
    rows = rows.select("word", "n", "cls", "is_long", ends.alias("w")).select(
        "word", "n", "cls", "is_long", F.col("w.x").alias("lo"), F.col("w.y").alias("hi"))
    cut = F.greatest(F.lit(0), F.col("cls") - F.col("hi"))  # code points after the window
    before = F.substring("word", F.lit(1), F.col("lo"))
    after = F.substring("word", F.length("word") - F.col("cut") + 1, F.col("cut"))
    key = F.concat_ws("\u0001", "cls", "lo", "hi", *[F.when(F.length(x) > 64, F.md5(x)).otherwise(x) for x in (before, after)])
    return (rows.withColumn("cut", cut).withColumn("places", F.col("hi") - F.col("lo")).withColumn("key", key))


def variant_groups(words: DataFrame, times: int = TIMES, max_words: int = MAX_WORDS) -> DataFrame:
    """``word, n, form, form_n, n_near, root`` for every row of ``word, n``.

    ``form`` is the near word of largest n (ties: the smaller in code-point
    order) if that n is at least ``times`` the word's own; ``root`` the end of
    the chain of forms.  Chains end, as n grows along them.
    """
    words = cut_lineage(words, "vocabulary")
    p = near_pairs(words, max_words)
    p = cut_lineage(p.select("a", F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("w")).alias("o")).unionByName(
        p.select(F.col("b").alias("a"), F.struct((-F.col("n_a")).alias("m"), F.col("a").alias("w")).alias("o")))
        .groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("best"))
        .select(F.col("a").alias("word"), "n_near", F.col("best.w").alias("best"), (-F.col("best.m")).alias("best_n")), "near-words")
    found = F.col("best_n") >= times * F.col("n")
    rows = cut_lineage(words.join(p, "word", "left").select(
        "word", "n", F.when(found, F.col("best")).alias("form"), F.when(found, F.col("best_n")).alias("form_n"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")), "forms")
    up = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each word's ancestor, twice as far each time
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        far = cut_lineage(far, "roots")
        up = far.select("word", "root")
        if far.filter("moved").isEmpty():
            break
    return rows.join(up, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(vocabulary(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


#: The CRC table follows from its polynomial; near pairs meet in the word with one code point left out.
ORACLE = """
WITH RECURSIVE poly(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
runs AS (SELECT id, run, count(*) AS n FROM (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM runs),
hashed AS (SELECT id, run, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
slipped AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n_b DESC, b) AS best, max(n_b) AS best_n FROM pairs GROUP BY a),
forms AS (SELECT word, n, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n,
                 coalesce(n_near, 0) AS n_near FROM words LEFT JOIN best ON a = word),
chain(word, tip, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(tip, k) AS root FROM chain GROUP BY word) r ON r.word = f.word"""
