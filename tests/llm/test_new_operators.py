"""Spelling variants, whitening and language identification: brute force, held-out accuracy and edge cases."""

import random
import zlib

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from transcripta.llm import op11_spelling_variants as op11
from transcripta.llm import op12_secular_whitening as op12
from transcripta.llm import op13_cross_parsing as op13

# ---------------------------------------------------------------------------
# spelling variants
# ---------------------------------------------------------------------------


def one_edit(a, b):
    """By definition: one code point put in, left out or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variant_rows(words, times=5):
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        out[w] = best if best is not None and words[best] >= times * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.add((w, n, out[w], words.get(out[w]), len(near[w]), root))
    return rows


@pytest.mark.parametrize("max_words", [1, 3, 2048])
def test_variants_equal_the_definition(spark, max_words):
    r = random.Random(max_words)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(1, 8))): r.choice([1, 5, 25, 130, 700]) for _ in range(260)}
    # words that share long beginnings and ends, and runs of one letter (several places for the same edit)
    words |= {"a" * n: 5 ** min(n - 5, 4) for n in range(6, 12)}
    words |= {"concert" + c + "ation": 5 for c in "abcdefghij"} | {"concertation": 900}
    got = op11.variant_groups(spark.createDataFrame(sorted(words.items()), "word string, n long"), max_words=max_words).collect()
    columns = ("word", "n", "form", "form_n", "n_near", "root")
    assert len(got) == len(words) and {tuple(x[c] for c in columns) for x in got} == variant_rows(words)


def test_very_long_words(spark):
    r = random.Random(1)
    a = "".join(r.choice("abcd") for _ in range(3000))
    words = {a: 50, a[:1700] + a[1701:]: 5, a[:20] + "z" + a[21:]: 5, a + "x": 7, "q" * 5000: 5}
    got = op11.variant_groups(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()
    assert {x["word"]: (x["form"], x["n_near"]) for x in got} == {w: (f, k) for w, n, f, _, k, _ in variant_rows(words)}


def test_vocabulary_edges(spark):
    rows = [(1, "Straße ABCDEF abcdef. Çédille × x÷y", "r")] * 5 + [(2, None, "r"), (None, "abcdef", "r"), (3, "", "r"), (4, "ÀÉÎÕÜÿ" * 2000, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string").selectExpr("*", "'w' AS word", "1 AS n", "'i' AS id")
    got = {x["word"]: x["n"] for x in op11.vocabulary(docs, slip=1 << 40).collect()}
    want = {}
    for i, t, _ in rows:  # only A-Z are lower-cased
        for w in op_runs(t or ""):
            want[w] = want.get(w, 0) + 1
    assert got == {w: n for w, n in want.items() if n >= 5} and got["abcdef"] == 11 and got["Çédille"] == 5
    slipped = {x["word"] for x in op11.vocabulary(docs, slip=1, min_count=1).collect()}
    expect = set()
    for i, t, _ in rows:
        for w in op_runs(t or ""):
            p = zlib.crc32(f"{'' if i is None else i}:{w}".encode()) % len(w)
            expect |= {w[:p] + w[p + 1:]} if len(w) > 6 else set()
    assert slipped == expect
    assert op11.variant_groups(op11.vocabulary(docs.limit(0))).collect() == []


def op_runs(t):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return [w for w in re.findall("[a-zÀ-ÿ]+", low) if len(w) >= 6]


# ---------------------------------------------------------------------------
# whitening
# ---------------------------------------------------------------------------


def test_rank_one_updates_keep_the_spectrum():
    r = np.random.default_rng(3)
    for dim, n, rank in ((1, 4, 1), (2, 3, 2), (6, 4, 6), (9, 60, 9), (9, 60, 3), (40, 200, 40)):
        x = r.integers(-9, 10, (n, rank)) @ r.integers(-3, 4, (rank, dim)) + 1_000_000
        x = np.vstack([x, x[:2], x[:1]])
        want = np.cov(x.T, bias=True).reshape(dim, dim) * len(x)
        for s in (op12.spectrum_of(x), op12.joined(op12.spectrum_of(x[:2]), op12.spectrum_of(x[2:]))):
            n_, mean, values, vectors = s
            top = max(np.abs(want).max(), 1e-30)
            assert n_ == len(x) and np.allclose(mean, x.mean(0), rtol=1e-14)
            assert np.abs(vectors @ np.diag(values) @ vectors.T - want).max() < 1e-9 * top
            assert np.abs(vectors.T @ vectors - np.eye(dim)).max() < 1e-11


def brute_whitening(rows, components=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by numpy's eigendecomposition."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), object)
    n, total = len(fit), fit.sum(0)
    e, u = np.linalg.eigh(np.cov(fit.astype(float).T, bias=True).reshape(len(total), -1))
    e, u = e[::-1], u[:, ::-1]
    keep = min(components, int((e > len(e) * np.finfo(float).eps * e[0]).sum()) if e[0] > 0 else 0)
    out = {}
    for i, v in x.items():
        dev = sum((n * a - s) ** 2 for a, s in zip(v, total))
        w = (np.array(v, float) - np.array(total / n, float)) @ u[:, :keep] / np.sqrt(e[:keep])
        out |= {(i, k + 1): (n, dev, abs(w[k]), e[k] / e.sum()) for k in range(keep)}
    return out


def same_whitening(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, dev, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(abs(r["whitened"]) - w) < 1e-7 and abs(r["explained"] / share - 1) < 1e-8 and r["identity_error"] < 1e-9


def test_whitening_query(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    same_whitening(op12.op12_secular_whitening(spark, SF_SMALL).collect(), brute_whitening(rows))


def test_whitening_edges(spark):
    r = random.Random(5)
    good = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    good += [(100 + i, good[i][1]) for i in range(10)]  # repeated vectors count once in the fit
    bad = [(200, None), (201, [0.1, None, 0.2, 0.3]), (202, [float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (204, [])]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS x", "3 AS part", "4 AS n", "5 AS __e")
    floats = [(i, np.array(v, np.float32).tolist()) for i, v in good]
    same_whitening(op12.whitening(op12.quantised(frame)).collect(), brute_whitening(floats))
    # one task for each row or two, so that empty and tiny partitions are combined in several rounds
    same_whitening(op12.whitening(op12.quantised(frame.repartition(30)), 3).collect(), brute_whitening(floats, 3))
    # vectors of two dimensions are two spaces; rows of one vector have no variance
    two = spark.createDataFrame([*good, (301, [0.5, 0.5]), (302, [0.5, 0.5])], "vec_id long, embedding array<float>")
    same_whitening(op12.whitening(op12.quantised(two)).collect(), brute_whitening(floats))
    assert op12.whitening(op12.quantised(frame.limit(0))).collect() == []
    # a rank below the dimension; a null id is a row like another
    flat = spark.createDataFrame([(None, [1.0, 2.0, 0.0]), (1, [2.0, 4.0, 0.0]), (1, [3.0, 6.0, 0.0])], "vec_id long, embedding array<float>")
    got = op12.whitening(op12.quantised(flat)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], round(abs(r["whitened"]), 6)) for r in got) == [(0, 1, 1.224745), (1, 1, 0.0), (1, 1, 1.224745)]


# ---------------------------------------------------------------------------
# language identification
# ---------------------------------------------------------------------------


def phrases_of(text, learned, piece):
    """Greedy longest matches by plain search in the samples."""
    out = 0
    for at in range(0, len(text), piece):
        part, i = text[at:at + piece], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and any(part[i:j] in s for s in learned):
                j += 1
            i = max(j - 1, i + 1)
            out += 1
    return out


def test_phrases_equal_longest_matches():
    r = random.Random(2)
    for _ in range(40):
        samples = ["".join(r.choice("abc ") for _ in range(r.randrange(1, 40))) for _ in range(3)]
        arcs = op13.suffix_automaton([ord(c) - 32 if c else 99 for s in samples for c in [*s, ""]])
        alphabet = " abc"
        triples = np.array([(s, alphabet.index(chr(c + 32)), t) for s, a in enumerate(arcs) for c, t in a.items() if c != 99], np.int32)
        model = {"alphabet": alphabet, "langs": [("x", 100, len(arcs), triples.tobytes()), ("y", 100, 1, b"")]}
        texts = ["".join(r.choice("abcz ") for _ in range(r.randrange(0, 60))) for _ in range(8)]
        got = op13.Parser(model, 16).phrases(texts)
        assert got[:, 0].tolist() == [phrases_of(t, samples, 16) for t in texts]
        assert got[:, 1].tolist() == [max(len(t), 0) for t in texts]  # nothing can be read: each character is a phrase


def test_held_out_accuracy_and_folds(spark):
    # the smallest table has copies and mislabelled rows; a tenth of the next one is held to the same bound
    for d in (SF_SMALL, SF_SMALL.replace("0.001", "0.01")):
        got = op13.op13_cross_parsing(spark, d).collect()
        lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        assert {r["doc_id"] for r in got} == set(lang) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
        held = [r for r in got if r["held_out"]]
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    learn = [(1, "the cat and the dog and the house", "en"), (2, "der hund und die katze und das haus", "de"), (3, "le chat", None), (4, None, "fr"), (5, "12 34", "fr")]
    rows = [(7, "the dog and the cat", "xx"), (8, "die katze und der hund", None), (9, None, "en"), (10, "", "en"), (11, "123 !?", "en"), (7, "the dog and the cat", "xx"),
            (12, "the house and the dog " * 5000, "de"), (None, "und das haus", "en"), (13, "日本語の文", "ja")]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'a' AS lang_pred", "2 AS score", "'b' AS letters", "3 AS h", "'c' AS sample", "'d' AS row")
    model = op13.fitted(spark.createDataFrame(learn, schema).selectExpr("*", "'b' AS letters", "3 AS h", "'c' AS sample"))
    assert [x[0] for x in model["langs"]] == ["de", "en"]
    got = op13.predicted(docs, model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "letters", "h", "sample", "row", "lang_pred", "score"} and len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in got}
    want = {7: "en", 8: "de", 9: "und", 10: "und", 11: "und", 12: "en", None: "de"}
    assert {i: p for (i, _), (p, _) in by.items() if i != 13} == want
    assert by[9, None][1] == by[11, "123 !?"][1] == 0 and by[13, "日本語の文"][0] in ("de", "en")
    # the label is not read: other labels, the same predictions
    again = op13.predicted(docs.selectExpr("doc_id", "text", "'q' AS lang"), model).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in again] == [(r["doc_id"], r["lang_pred"], r["score"]) for r in got]
    # no labelled text: nothing is known; one language: it is taken
    nothing = op13.fitted(spark.createDataFrame(learn, schema).filter("lang IS NULL"))
    assert {(r["lang_pred"], r["score"]) for r in op13.predicted(docs, nothing).collect()} == {("und", 0.0)}
    one = op13.fitted(spark.createDataFrame(learn[:1], schema))
    assert {(r["lang_pred"], r["score"]) for r in op13.predicted(docs.filter("doc_id = 7"), one).collect()} == {("en", 1.0)}
    assert op13.predicted(docs.limit(0), model).collect() == []


# ---------------------------------------------------------------------------
# repeated rows in the pipeline's stages
# ---------------------------------------------------------------------------


def test_repeated_rows(spark):
    from transcripta.llm import op2_dart_minhash as op2, op9_fair_queue_mix as op9
    text = " ".join(f"word{i} is here" for i in range(40))
    rows = [(1, text, "a", 10), (1, text, "a", 10), (1, text, "a", 11), (2, text + " too", "a", 12), (3, "other words altogether", "b", 13),
            (None, text, "a", 14), (None, text, "a", 14), (4, None, "b", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    kept = op2.one_per_group(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 1, 3, 4]
    for seed in range(4):  # the mix gives what the queue took, whatever the copies of single rows
        table = [(i % 7, f"w{i % 7} " * (3 + i % 7), "abc"[i % 3], i) for i in range(30 + seed)] + [(9, "x " * 50, "a", 0)] * (5 + 2 * seed)
        docs = spark.createDataFrame(table, "doc_id long, text string, source string, extra long")
        queue = op9.fair_queue(docs).groupBy("doc_id", "source").agg({"copies": "sum"}).collect()
        mix = op9.mixed_documents(docs)
        got = {(r["doc_id"], r["source"]): r["count"] for r in mix.groupBy("doc_id", "source").count().collect()}
        assert mix.columns == docs.columns and got == {(r[0], r[1]): r[2] for r in queue if r[2]}


def test_line_dedup_writes_no_segment_rows(spark, monkeypatch):
    """Lines meet in tasks: what is written grows with the lines, not with their segments, and blocks lose no link."""
    import random
    from tests.llm.test_queries import dropped_lines
    from transcripta.llm import links
    from transcripta.llm import op4_line_dedup as op4
    r = random.Random(11)
    lines = ["".join(r.choice("abcdefg ") for _ in range(n)) for n in range(20, 260, 2)]
    rows = [(k, "\n".join((x, x[:9] + "z" + x[9 + k % 2:], x[:-1]))) for k, x in enumerate(lines)] + [(500, lines[7]), (501, lines[90])]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), dropped_lines(rows)
    written = []

    def counted(df, name="stage", cut=op4.cut_lineage):
        out = cut(df, name)
        written.append(out.count())
        return out

    for module in (op4, links):
        monkeypatch.setattr(module, "cut_lineage", counted)
    for keys in (1 << 22, 40):
        monkeypatch.setattr(op4, "CELL_KEYS", keys, raising=False)
        written.clear()
        got = {x["doc_id"]: x["dropped"] for x in op4.dropped_lines(docs).collect()}
        assert got == {k: v for k, v in want.items() if v}
        assert max(written) <= 3 * written[0]


def test_near_copies_are_compared_until_they_are_connected(monkeypatch):
    """Lines of a large class are not compared with one another any more once they are in it."""
    import numpy as np
    from transcripta.llm import op4_line_dedup as op4
    rng = np.random.default_rng(5)
    base = rng.choice(list("abcdefgh "), 300)
    lines = []
    for _ in range(100):
        x = base.copy()
        x[rng.integers(0, 300, 6)] = "z"
        lines.append("".join(x))
    compared = []

    def counted(a, b, edits, within=op4.within_edits):
        compared.append(len(a))
        return within(a, b, edits)

    monkeypatch.setattr(op4, "within_edits", counted)
    near = op4._Links(lines)
    near.test(*np.triu_indices(100, 1))
    assert len(near.found) == 99 and len(set(near.roots().tolist())) == 1
    assert sum(compared) <= 1000


def test_banded_distance_of_long_lines_and_wide_bands():
    import numpy as np
    from transcripta.llm import op4_line_dedup as op4

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    rng = np.random.default_rng(6)
    pairs = []
    for n in (0, 1, 20, 64, 65, 130, 300):
        for letters in ("ab", "abcdefgh ", "語文字abc\U0001f600"):
            a = "".join(rng.choice(list(letters), n))
            b = list(a)
            for _ in range(int(rng.integers(0, n // 3 + 2))):
                at = int(rng.integers(0, len(b) + 1))
                b[at:at + int(rng.integers(0, 2))] = rng.choice(list(letters), int(rng.integers(0, 2)))
            pairs.append((a, "".join(b)))
    true = np.array([distance(a, b) for a, b in pairs])
    for edits in (0, 8, 31, 32, 63, 64, 127, 255, 256):
        got = op4.within_edits([a for a, _ in pairs], [b for _, b in pairs], np.full(len(pairs), edits))
        assert (got == (true <= edits)).all()
    assert op4.within_edits([a for a, _ in pairs], [b for _, b in pairs], true).all()
