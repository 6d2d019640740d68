"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of labelled text: from its initial state
every substring of that text can be read, and nothing else.  A text is cut
into phrases, each the longest string that the automaton reads from its initial
state (a character that it cannot read at all is a phrase of its own).  A text
costs phrases * log2(length of the language's text) bits, and the language
with the fewest bits wins (ties: the smaller name).

The automata are of a bounded size: at most ``train_chars`` characters a
language, from the documents with the smallest text hashes, at most
``doc_chars`` of each.  They are built in Spark, one task a language, and sent
to the workers as tables of arcs.  Texts are read whole: letters lower-cased,
all else one space, in pieces of ``piece`` characters that are parsed side by
side (a phrase ends with its piece), all languages at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of
from transcripta.session import cut_lineage

TRAIN_CHARS = 40_000
DOC_CHARS = 400
#: letters that a language's table tells apart (the commonest ones of all languages); the others are read by no automaton
MAX_LETTERS = 96
PIECE = 512
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4 (a null id counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def letters_of(text: Column) -> Column:
    """The text in lower case, every run of other characters one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "\\P{L}+", " ")), F.lit(" "))


def training_text(docs: DataFrame, text: str = "text", lang: str = "lang", train_chars: int = TRAIN_CHARS,
                  doc_chars: int = DOC_CHARS) -> DataFrame:
    """``lang, sample``: the bounded sample of each non-null language, equal texts once.

    Documents are taken by the smallest hash of their text; the ranking sees
    hashes only, and Spark drops all but the first ones of a language before it shuffles.
    """
    most = -(-train_chars // doc_chars)
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), text_of(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    keyed = rows.withColumn("h", F.xxhash64("text"))
    ranked = keyed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= most)
    taken = keyed.join(ranked.select("lang", "h"), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    return taken.select("lang", "h", F.substring(letters_of(F.col("text")), 1, doc_chars).alias("sample"))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Arcs of every state; state 0 is the initial one."""
    arcs, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(arcs)
        arcs.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(arcs)
                arcs.append(dict(arcs[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return arcs


def _automata(alphabet: str):
    codes = {c: i for i, c in enumerate(alphabet)}

    def build(pdf):
        import pandas as pd
        # a break between samples is read by no text
        text = [codes.get(c, len(alphabet)) for s in pdf.sort_values("h")["sample"] for c in [*s, None]]
        arcs = suffix_automaton(text)
        triples = np.array([(s, c, t) for s, a in enumerate(arcs) for c, t in a.items() if c < len(alphabet)], np.int32).reshape(-1, 3)
        return pd.DataFrame([{"lang": pdf["lang"].iloc[0], "length": len(text), "states": len(arcs), "arcs": triples.tobytes()}])
    return build


def fitted(learn: DataFrame, text: str = "text", lang: str = "lang", train_chars: int = TRAIN_CHARS, doc_chars: int = DOC_CHARS) -> dict:
    """``{"alphabet": str, "langs": [(lang, length, states, arcs)]}`` of labelled rows; bounded by the languages' number and the parameters."""
    samples = cut_lineage(training_text(learn, text, lang, train_chars, doc_chars), "language-samples")
    letters = (samples.select(F.explode(F.split("sample", "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.col("n").desc(), "c").limit(MAX_LETTERS).collect())
    alphabet = "".join(sorted(r["c"] for r in letters))
    rows = samples.groupBy("lang").applyInPandas(_automata(alphabet), "lang string, length int, states int, arcs binary").collect()
    return {"alphabet": alphabet, "langs": sorted((r["lang"], r["length"], r["states"], bytes(r["arcs"])) for r in rows)}


class Parser:
    """Counts the phrases of many texts under all languages.

    The table of arcs takes 8 bytes per training character and letter for each
    language; with very many languages ``train_chars`` is to be lowered.
    """

    def __init__(self, model: dict, piece: int = PIECE) -> None:
        self.piece = piece
        self.width = len(model["alphabet"]) + 1  # the last column: a letter that no automaton reads
        self.roots, at = [], 0
        for _, _, states, _ in model["langs"]:
            self.roots.append(at)
            at += states
        self.next = np.full((at, self.width), -1, np.int32)
        for root, (_, _, _, arcs) in zip(self.roots, model["langs"]):
            a = np.frombuffer(arcs, np.int32).reshape(-1, 3)
            self.next[root + a[:, 0], a[:, 1]] = root + a[:, 2]
        self.next = self.next.ravel() * self.width  # a state is the start of its row
        self.next[self.next < 0] = -1
        self.roots = np.array(self.roots, np.int32) * self.width
        self.code = np.full(0x110001, self.width - 1, np.int16)
        for i, c in enumerate(model["alphabet"]):
            self.code[ord(c)] = i
        self.bits = np.log2(np.array([max(2, n) for _, n, _, _ in model["langs"]], float))

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text under each language, (texts, languages)."""
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[flat]
        sizes = np.array([len(t) for t in texts])
        pieces = -(-sizes // self.piece)
        owner = np.repeat(np.arange(len(texts)), pieces)
        first = np.cumsum(pieces) - pieces
        begin = (np.cumsum(sizes) - sizes)[owner] + (np.arange(len(owner)) - first[owner]) * self.piece
        end = np.minimum(begin + self.piece, np.cumsum(sizes)[owner])
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that those at work are a prefix
        size = (end - begin)[order]
        begin, out = begin[order], np.zeros((len(texts), len(self.roots)), np.int64)
        if not len(size):
            return out
        ends = np.searchsorted(-size, -np.arange(size[0]))  # pieces longer than k
        root = np.repeat(self.roots[:, None], len(size), 1)
        state, count = root.copy(), np.ones(root.shape, np.int32)
        for k in range(size[0]):
            m = int(ends[k])
            c = codes[begin[:m] + k]
            here, start = state[:, :m], root[:, :m]
            to = self.next[here + c]
            stop = to < 0
            if stop.any():
                # the phrase ends; the letter starts the next one, or is one by itself
                fresh = self.next[start + c]
                count[:, :m] += stop & (here != start)
                to = np.where(stop, fresh, to)
                alone = to < 0
                if alone.any():
                    to = np.where(alone, start, to)
                    count[:, :m] += alone & (k + 1 < size[:m])
            state[:, :m] = to
        for lang in range(len(self.roots)):
            out[:, lang] = np.bincount(owner[order], count[lang], len(texts)).astype(np.int64)
        return out


def predicted(docs: DataFrame, model: dict, text: str = "text", piece: int = PIECE) -> DataFrame:
    """The columns of ``docs`` and ``lang_pred, score``.

    ``score`` is the share by which the winner's bits fall short of the next
    language's, 1 if there is only one language.  ``und`` with score 0 for a
    null text, one without letters, or a model without languages.  A column of
    ``docs`` with one of these names is replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    langs = [x[0] for x in model["langs"]]
    letters = F.when(F.col(f"`{text}`").rlike("\\p{L}"), letters_of(F.col(f"`{text}`")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("row"), F.col(f"`{text}`").alias("text"), letters.alias("letters"))
    return _scored(rows, model, langs, piece).select(*[F.col(f"row.`{c}`") if c != text else F.col("text").alias(text) for c in kept], "lang_pred", "score")


def _scored(rows: DataFrame, model: dict, langs: list[str], piece: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        parser = Parser(sent.value, piece) if langs else None
        for batch in batches:
            texts = batch.column("letters").to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None] if langs else []
            for part in _blocks(known, texts):
                bits = parser.phrases([texts[i] for i in part]) * parser.bits
                win = bits.argmin(1)
                low = np.sort(bits, 1)
                score[part] = 1 - low[:, 0] / low[:, 1] if len(langs) > 1 else 1.0
                for i, w in zip(part, win):
                    best[i] = langs[w]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "letters"],
                                              pa.array(best, pa.string()), pa.array(score)],
                                             [*[c for c in batch.schema.names if c != "letters"], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "letters")
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def _blocks(known: list[int], texts: list[str], most: int = 1 << 21):
    """Rows in blocks of about ``most`` characters."""
    part, size = [], 0
    for i in known:
        part.append(i)
        size += len(texts[i])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def op13_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(rows, model).drop("text")
