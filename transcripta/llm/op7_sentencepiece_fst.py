"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model is compiled into a transducer from characters to piece ids:

* the normaliser (dummy prefix, white space as U+2581) rewrites the text;
* every piece is a path of its characters with an output id, and every
  character without a piece falls back to the paths of its UTF-8 bytes;
* a text composed with it is a lattice of (position, last piece), and the
  encoding is its shortest path in the tropical semiring.

For a unigram model an arc weighs minus its score and the shortest path is
found position by position.  For a BPE model the scores order merges, they do
not add up, so the weight is on pairs of neighbouring pieces instead: 0 if
merging the two side by side keeps their border, infinite if a merge would
cross it.  Merges inside one piece do not depend on the others, so a path is
the BPE encoding exactly if all its pairs weigh 0, and one such path exists.
It is found by depth-first search, longest arcs first, that remembers dead
states; the pair weights are composed on the fly.

Characters that never stand side by side in a piece cannot merge, so texts are
cut there (at words, in practice) and the encoding of a part is remembered.
"""

from __future__ import annotations

import gc
import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of

SPACE = "▁"
#: Bytes that a worker's memory of words, of parts and of pairs may take, each in two generations of half of it.
CACHE = 100_000_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Remembered:
    """Results by text, bounded by bytes: a full generation becomes the old one, and what is used of that one moves on."""

    def __init__(self, limit: int):
        self.limit, self.size, self.new, self.old = limit // 2, 0, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got, len(key) + 8)
        return got

    def put(self, key, value, size: int) -> None:
        """Keep a result; ``size``: about the characters and bytes of key and value."""
        cost = 250 + 4 * size
        if cost * 100 > self.limit:  # a very long stretch without a cut is not kept
            return
        if self.size + cost > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += cost


class Transducer:
    """A compiled SentencePiece model (``model``: the file's bytes or its path)."""

    def __init__(self, model: str | bytes, cache: int = CACHE):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"normaliser {n.name!r} with a character map or white-space removal is not supported")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix = " " if n.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.code = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), 0)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        #: Neighbouring characters within pieces: elsewhere a text can be cut.
        self.beside = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.blank_leads = not any(p[0] != SPACE and p[1] == SPACE for p in self.beside)
        #: Merges that build a piece: (score, its last symbol, its first symbol) after each.
        self.merges: dict[str, list] = {}
        self.arcs = {p for p in self.id if not self.bpe or self._derive(p)}
        #: States of the piece paths with the longest piece on the way, and the next shorter arc of each piece.
        self.states: dict[str, str] = {}
        for s in sorted({p[:n] for p in self.arcs for n in range(1, len(p) + 1)}, key=len):
            self.states[s] = s if s in self.arcs else self.states.get(s[:-1], "")
        self.shorter = {p: self.states[p[:-1]] or p[0] for p in self.arcs if len(p) > 1}
        self.pairs, self.parts, self.words = Remembered(cache), Remembered(cache), Remembered(cache)
        #: What each id decodes to (control ids: nothing).
        self.out = [b""] * len(proto.pieces)
        for p, i in self.id.items():
            self.out[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.out[i] = bytes([b])
        if self.unknown < len(self.out) and proto.pieces[self.unknown].type == UNKNOWN:
            self.out[self.unknown] = proto.trainer_spec.unk_surface.encode()

    # -- compiling -------------------------------------------------------

    def _derive(self, piece: str) -> bool:
        """Record the merges that build a piece out of its characters; false if they do not."""
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            best, at = -math.inf, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return False
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[-1], symbols[0]))
        self.merges[piece] = steps
        return True

    def _border(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two neighbouring pieces.

        Runs the merges of both in their common order, highest score first and
        leftmost on ties, and looks for a crossing merge that comes before the next.
        """
        one, two = self.merges.get(left, ()), self.merges.get(right, ())
        a, b, i, j = left[-1], right[0], 0, 0
        while True:
            n1 = one[i][0] if i < len(one) else -math.inf
            n2 = two[j][0] if j < len(two) else -math.inf
            s = self.score.get(a + b)
            if s is not None and s > n1 and s >= n2:
                return False
            if n1 == n2 == -math.inf:
                return True
            if n1 >= n2:
                a, i = one[i][1], i + 1
            else:
                b, j = two[j][2], j + 1

    # -- composing and searching -------------------------------------------

    def _longest(self, part: str, at: int) -> str:
        """The longest piece that begins at a position, or the bare character."""
        found, step = "", self.states.get
        for end in range(at + 1, len(part) + 1):
            got = step(part[at:end])
            if got is None:
                break
            found = got
        return found or part[at]

    def _arcs(self, part: str, at: int) -> list[str]:
        """Pieces that begin at a position, longest first, down to the single character."""
        out, p = [], self._longest(part, at)
        while p:
            out.append(p)
            p = self.shorter.get(p, "")
        return out

    def path(self, part: str) -> list[str]:
        """The shortest path through the lattice of a part, as pieces and bare characters."""
        return self._bpe_path(part) if self.bpe else self._unigram_path(part)

    def _bpe_path(self, part: str) -> list[str]:
        if part in self.arcs or len(part) == 1:
            return [part]
        known, dead, end, longest, shorter = self.pairs.new, set(), len(part), self._longest, self.shorter.get
        path: list[str] = []
        at, last, p = 0, "", longest(part, 0)
        while True:
            while p:  # the longest arc that the last piece allows
                if not (dead and (at + len(p), p) in dead):
                    if not last:
                        break
                    ok = known.get((last, p))
                    if ok is None:
                        ok = self._pair(last, p)
                        known = self.pairs.new
                    if ok:
                        break
                p = shorter(p, "")
            if p:
                path.append(p)
                at += len(p)
                if at == end:
                    return path
                last, p = p, longest(part, at)
            elif not path:
                raise ValueError(f"no path for {part!r}")
            else:  # a dead state: back to the one before
                p = path.pop()
                dead.add((at, p))
                at -= len(p)
                last, p = path[-1] if path else "", shorter(p, "")

    def _pair(self, left: str, right: str) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            ok = self._border(left, right)
            self.pairs.put((left, right), ok, len(left) + len(right))
        return ok

    def _unigram_path(self, part: str) -> list[str]:
        low = min(self.score.values()) - 10.0
        best, back = [0.0] + [math.inf] * len(part), [""] * (len(part) + 1)
        for at in range(len(part)):
            for p in self._arcs(part, at):
                cost = best[at] - self.score.get(p, low)
                if cost < best[at + len(p)]:
                    best[at + len(p)], back[at + len(p)] = cost, p
        out, at = [], len(part)
        while at:
            out.append(back[at])
            at -= len(back[at])
        return out[::-1]

    def _code(self, piece: str) -> bytes:
        """The ids of a piece or bare character as little-endian uint32."""
        got = self.code.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            got = np.array([self.byte[b] for b in raw] if self.byte else [self.unknown], "<u4").tobytes()
        return got

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = b"".join([self._code(p) for p in self.path(part)])
            self.parts.put(part, got, len(part) + len(got) // 4)
        return got

    def _word(self, word: str) -> bytes:
        """Ids of a stretch of normalised text, cut where no piece can span."""
        beside, out, begin = self.beside, [], 0
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in beside:
                out.append(self._part(word[begin:i]))
                begin = i
        out.append(self._part(word[begin:]))
        return b"".join(out)

    # -- texts ---------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32 (an empty text has none)."""
        if not text:
            return b""
        s = self.prefix + text
        # words with the blank before them; a piece holds no blank after another character
        words = s.split(" ") if SPACE not in s and self.blank_leads else [s]
        known = self.words.new
        ids = [known.get(w) for w in words]
        if None in ids or "" in words[1:]:
            ids = self._encode_new(words)
        else:
            ids[0] = self._word(words[0]) if words[0] else b""
        return b"".join(ids)

    def _encode_new(self, words: list[str]) -> list[bytes]:
        out = [self._word(words[0].replace(" ", SPACE))] if words[0] else []
        blanks = 0
        for w in words[1:]:
            if not w:  # blanks in a row belong to one part
                blanks += 1
            elif blanks:
                out.append(self._word(SPACE * (blanks + 1) + w))
                blanks = 0
            else:
                got = self.words.get(w)
                if got is None:
                    got = self._word(SPACE + w)
                    self.words.put(w, got, len(w) + len(got) // 4)
                out.append(got)
        if blanks:
            out.append(self._word(SPACE * blanks))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the dummy prefix."""
        out = self.out
        s = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return s[1:] if self.prefix and s.startswith(" ") else s


_MODELS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One compiled model per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = Transducer(path)
        gc.freeze()  # the compiled model stays: full collections need not walk it
    return _MODELS[path]


def _encode(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        model = transducer(path)
        for batch in batches:
            raw = [model.encode(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(r) // 4 for r in raw])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            decoded = [model.decode(np.frombuffer(r, "<u4")) for r in raw]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                pa.array([zlib.crc32(r) for r in raw], pa.int64()), ids, pa.array(decoded, pa.string()),
                *batch.columns[2:],
            ], names=["doc_id", "n_ids", "ids_crc32", "ids", "decoded", *batch.schema.names[2:]])
    return run


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: tuple = ()) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, ids, decoded``, one row per document, and the string columns ``keep``.

    Null and empty texts have no ids and decode to the empty text.  Texts decode
    to themselves, but for U+2581, which is read as a blank.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(f"`{text}`").alias("text"),
                       *[F.col(f"`{c}`").cast("string").alias(f"__{c}") for c in keep])
    out = rows.mapInArrow(_encode(path), "doc_id long, n_ids long, ids_crc32 long, ids array<int>, decoded string"
                          + "".join(f", `__{c}` string" for c in keep))
    return out.withColumnsRenamed({f"__{c}": c for c in keep})


def op7_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the length and crc32 of what they decode to."""
    import public_tokenizers
    out = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", "ids_crc32", "ids", F.char_length("decoded").cast("long").alias("decoded_chars"),
                      F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"))
