"""Token-id output compressed by Re-Pair grammars, one grammar per shard.

Documents are put in ascending id order (range partitions), encoded, and cut
into shards of about ``shard_tokens`` ids.  Re-Pair then replaces frequent
pairs of neighbouring ids by new symbols, again and again, until no pair
occurs ``min_pairs`` times.  A pair never spans two documents.  Each round
counts all pairs of the shard and replaces every frequent one from the most
frequent down, as long as places do not overlap; so a round does the work of
many single replacements.

File format (a Parquet table, one row per shard):

* ``part, shard``: position; ``docs``: documents; ``tokens``: ids in all
* ``doc_ids``: ids of the documents in order
* ``rules``: little-endian uint32 pairs; rule r stands for symbol base + r
* ``lengths``: uint32 ids that each rule expands to
* ``body``: uint32 symbols, documents one after another
* ``starts``: uint64 first symbol of each document, and the end
* ``token_starts``: uint64 first id of each document, and the end

``token_range`` decodes any range of ids of a shard: the expansion lengths
tell which symbols it touches, and only those are expanded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of
from transcripta.session import cut_lineage

SHARD_TOKENS = 1 << 20
MIN_PAIRS = 256
END_ID = 2
#: Words whose ids a worker remembers at a time.
CACHE_WORDS = 800_000
SHARD_SCHEMA = ("part int, shard int, docs long, tokens long, base long, doc_ids array<long>, rules binary, "
                "lengths binary, body binary, starts binary, token_starts binary")


# -- grammar -----------------------------------------------------------------

def compress(ids: np.ndarray, starts: np.ndarray, base: int, min_pairs: int = MIN_PAIRS):
    """Re-Pair of ``ids`` (documents begin at ``starts``, the last entry is the end).

    Returns (rules, lengths, body, starts of the documents in the body).
    """
    body = ids.astype(np.uint32)
    starts = starts.astype(np.int64)
    rules, lengths, n_rules = [], [], 0
    known = np.zeros(0, np.uint32)  # expansion lengths of the rules so far
    while len(body) > 1:
        # counts of hashed pairs bound the counts of pairs: rare pairs need no sorting
        hashed = (body[:-1] * np.uint32(0x9E3779B1) + body[1:] * np.uint32(0x85EBCA77)) >> np.uint32(15)
        maybe = (np.bincount(hashed, minlength=1 << 17) >= min_pairs)[hashed]
        ends = starts[1:] - 1  # the pairs that begin here span two documents
        maybe[ends[(ends >= 0) & (ends < len(maybe))]] = False
        at = np.flatnonzero(maybe)
        keys = (body[at].astype(np.uint64) << np.uint64(32)) | body[at + 1]
        order = np.sort(keys)
        edge = np.flatnonzero(np.concatenate(([len(order) > 0], order[1:] != order[:-1])))
        count = np.diff(np.append(edge, len(order)))
        often = count >= min_pairs
        if not often.any():
            break
        pairs, count = order[edge][often], count[often]
        # most frequent first; a pair gives way where a better one overlaps it
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, -count))] = np.arange(len(pairs))
        slot = np.searchsorted(pairs, keys)
        slot[slot == len(pairs)] = 0
        hit = pairs[slot] == keys
        place, best = at[hit], rank[slot[hit]]
        score = np.full(len(body) + 1, len(pairs), np.int64)
        score[place] = best
        ahead = np.concatenate(([len(pairs)], score[:-1]))[place]
        win = (best < ahead) & (best <= score[place + 1])
        # runs of one pair (a a a a): every second place of the run
        tie = best == ahead
        if tie.any():
            run = np.cumsum(~tie)
            first = np.flatnonzero(~tie)
            offset = np.arange(len(place)) - first[run - 1]
            win = np.where(tie, (offset % 2 == 0) & win[first[run - 1]] & (best <= score[place + 1]), win)
        place, best = place[win], best[win]
        used, new = np.unique(best, return_inverse=True)
        by_rank = np.empty(len(pairs), np.uint64)
        by_rank[rank] = pairs
        added = by_rank[used]
        a, b = (added >> np.uint64(32)).astype(np.uint32), added.astype(np.uint32)
        sizes = np.concatenate((np.ones(1, np.uint32), known))  # entry 0 for plain ids
        size_of = lambda x: sizes[np.maximum(x.astype(np.int64) - base + 1, 0)]
        rules.append(np.stack((a, b), 1))
        grown = size_of(a) + size_of(b)
        lengths.append(grown)
        body[place] = (base + n_rules + new).astype(np.uint32)
        keep = np.ones(len(body), bool)
        keep[place + 1] = False
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
        body = body[keep]
        known = np.concatenate((known, grown))
        n_rules += len(added)
    flat = np.concatenate(rules).astype("<u4") if rules else np.zeros((0, 2), "<u4")
    return flat, known.astype("<u4"), body.astype("<u4"), starts.astype("<u8")


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that the symbols stand for.

    The rules are written out once, shorter parts first; the ids of all symbols
    are then gathered in one step.
    """
    if not len(rules):
        return symbols.astype(np.uint32)
    size = lengths.astype(np.int64)
    at = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    for r, (a, b) in enumerate(rules.tolist()):  # a rule uses earlier rules only
        to = at[r]
        for x in (a, b):
            n = 1 if x < base else size[x - base]
            flat[to:to + n] = x if x < base else flat[at[x - base]:at[x - base] + n]
            to += n
    rule = np.maximum(symbols.astype(np.int64) - base, -1)
    big = rule >= 0
    n = np.where(big, size[rule], 1)
    end = np.cumsum(n)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
    out[(end - n)[~big]] = symbols[~big]
    n, to, rule = n[big], (end - n)[big], rule[big]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + step] = flat[np.repeat(at[rule], n) + step]
    return out


def token_range(row, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a shard row, expanding only the symbols that hold them."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    body, lengths, base = np.frombuffer(row["body"], "<u4"), np.frombuffer(row["lengths"], "<u4"), int(row["base"])
    size = np.ones(len(body), np.int64)
    big = body >= base
    size[big] = lengths[body[big].astype(np.int64) - base]
    end = np.cumsum(size)
    lo, hi = np.searchsorted(end, first, "right"), np.searchsorted(end, first + n, "left") + 1
    skip = first - (end[lo - 1] if lo else 0)
    return expand(body[lo:hi], rules, lengths, base)[skip:skip + n]


# -- encoding ----------------------------------------------------------------

class WordEncoder:
    """Encodes texts with a tokenizer that never looks across white space.

    Words are remembered in a bounded memory.  A new word of letters with a
    tail of ASCII punctuation is two pre-tokens of the vocabulary, so each is
    looked up on its own (``units``); any other word is encoded whole.  What is
    not known goes to the library, many units in one text: the ids of a unit
    end with an end-of-word id.
    """

    #: Letters, then ASCII punctuation (fixed pattern).
    SHAPE = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_words
        self.known: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.symbols = max(vocab.values()) + 1
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "</w>"
        self.is_end = np.zeros(self.symbols, bool)
        self.is_end[[i for w, i in vocab.items() if w.endswith(suffix)]] = True

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32."""
        words, known = text.encode("utf-8", "surrogatepass").split(), self.known  # at U+0020 and U+0009 to U+000D
        ids = list(map(known.get, words))
        if None in ids:
            new = {w for w, i in zip(words, ids) if i is None}
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(words)
            self._learn(new)
            ids = [known[w] for w in words]
        return b"".join(ids)

    def _learn(self, new: set[bytes]) -> None:
        if len(self.units) > self.limit // 2:
            self.units.clear()
        units, shape, parts = self.units, self.SHAPE.fullmatch, []
        for w in new:
            s = w.decode("utf-8", "replace")
            m = shape(s)
            if m is None:
                self.known[w] = self._ids(s).tobytes()
            else:  # ASCII capitals are lowered as the vocabulary's normaliser would
                a, b = m.groups()
                parts.append((w, a.lower() if a.isascii() else a, b))
        todo = {a for _, a, _ in parts}
        todo.update(b for _, _, b in parts)
        self._learn_units([u for u in todo if u and u not in units])
        for w, a, b in parts:
            self.known[w] = units[a] + units[b] if b else units[a]

    def _learn_units(self, units: list[str]) -> None:
        for i in range(0, len(units), 256):
            part = units[i:i + 256]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):  # a letter that normalising takes apart: one at a time
                self.units.update((u, self._ids(u).tobytes()) for u in part)
                continue
            raw, at = ids.tobytes(), 0
            for u, end in zip(part, (4 * ends).tolist()):
                self.units[u], at = raw[at:end], end

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _shards(batches: Iterator, path: str, end_id: int, shard_tokens: int, min_pairs: int) -> Iterator:
    """Encode the rows of a partition and pack them into shard rows."""
    import pandas as pd
    enc, part, shard, held = encoder(path), 0, 0, 0
    parts, sizes, ids = [], [], []
    end = np.array([end_id], "<u4").tobytes()
    base = max(enc.symbols, end_id + 1)

    def pack():
        flat = np.frombuffer(b"".join(parts), "<u4")
        token_starts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
        rules, lengths, body, starts = compress(flat, token_starts.astype(np.int64), base, min_pairs)
        return pd.DataFrame([{
            "part": part, "shard": shard, "docs": len(ids), "tokens": len(flat), "base": base, "doc_ids": list(ids),
            "rules": rules.tobytes(), "lengths": lengths.tobytes(), "body": body.tobytes(),
            "starts": starts.tobytes(), "token_starts": token_starts.tobytes()}])

    for pdf in batches:
        for p, doc, text in zip(pdf["part"], pdf["doc_id"].astype(object), pdf["text"]):
            part = int(p)
            raw = enc.encode(text)
            parts.append(raw + end)
            sizes.append(len(raw) // 4 + 1)
            ids.append(None if doc is None or doc != doc else int(doc))
            held += sizes[-1]
            if held >= shard_tokens:
                yield pack()
                shard, held, parts, sizes, ids = shard + 1, 0, [], [], []
    if ids:
        yield pack()


def write_token_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS,
                       min_pairs: int = MIN_PAIRS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts (null: empty), compress them and write the shard table; returns it reread.

    Rows go in ascending id order, null ids first, equal ids in text order.
    A document longer than ``shard_tokens`` has a shard of its own.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").alias("text"))
    rows = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
            .select("doc_id", "text", F.spark_partition_id().alias("part")))
    run = lambda batches: _shards(batches, path, end_id, shard_tokens, min_pairs)
    return cut_lineage(rows.mapInPandas(run, SHARD_SCHEMA), "token-shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, shard, start``: ids of all documents before each shard.

    Partitions are totalled first, so the running sum over all of them has one
    row per partition; the other runs over the shards of one partition.
    """
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    parts = parts.select("part", ahead.alias("ahead"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    own = shards.select("part", "shard", (inside - F.col("tokens")).alias("inside"))
    return own.join(parts, "part").select("part", "shard", (F.col("inside") + F.col("ahead")).alias("start"))


def _read(batches: Iterator) -> Iterator:
    import pandas as pd
    for pdf in batches:
        for row in pdf.to_dict("records"):
            ids = expand(np.frombuffer(row["body"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2),
                         np.frombuffer(row["lengths"], "<u4"), int(row["base"])).astype("<u4")
            at = np.frombuffer(row["token_starts"], "<u8").astype(np.int64)
            raw = memoryview(ids.tobytes())
            yield pd.DataFrame({
                "part": row["part"], "shard": row["shard"],
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], dtype="Int64"),
                "inside": at[:-1], "n_tokens": np.diff(at),
                "ids_crc32": [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]})


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``part, shard``)."""
    docs = shards.select("part", "shard", "base", "doc_ids", "rules", "lengths", "body", "token_starts").mapInPandas(
        _read, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return (docs.join(shard_starts(shards), ["part", "shard"])
            .select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"))


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return read_token_shards(write_token_shards(docs, public_tokenizers.path("word_bpe_49k.json")))
