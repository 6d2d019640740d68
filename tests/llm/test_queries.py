"""Registered queries against their SQL, or against a brute-force version, over the whole small tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.helpers import canon_rows, rows_of
from transcripta.llm import op4_line_dedup as op4, op5_quality_rules as op5
from transcripta.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    rows, cols = rows_of(QUERIES[name](spark, SF_SMALL))
    res = duck.execute(ORACLES[name])
    want, names = res.fetchall(), [d[0] for d in res.description]
    assert sorted(cols) == sorted(names) and canon_rows(rows, cols) == canon_rows(want, names)


def _find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_classes(docs):
    """{id: smallest id of its class} by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in docs:
        w = t.encode().split()
        sets[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset([t])
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    parent = {i: i for i in sets}
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((_find(parent, i), _find(parent, j)))
                parent[b] = a
    return {i: _find(parent, i) for i in sets}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def dropped_lines(docs):
    """{id: line numbers that go} by comparing all lines of like length."""
    places = [(i, k, x) for i, t in docs for k, x in enumerate(t.split("\n")) if len(x) >= op4.MIN_CHARS]
    lines = sorted({x for *_, x in places}, key=len)
    parent, bags = {x: x for x in lines}, [Counter(x) for x in lines]
    for p, a in enumerate(lines):
        t = min(op4.MAX_EDITS, len(a) // op4.CHARS_PER_EDIT)
        for q in range(p + 1, len(lines) if t else 0):
            b = lines[q]
            if len(b) - len(a) > t:
                break
            if sum(((bags[p] - bags[q]) + (bags[q] - bags[p])).values()) <= 2 * t and distance(a, b) <= t:
                parent[_find(parent, b)] = _find(parent, a)
    first = {}
    for i, k, x in places:
        c = _find(parent, x)
        first[c] = min(first.get(c, (i, k)), (i, k))
    gone = {i: [] for i, _ in docs}
    for i, k, x in places:
        if first[_find(parent, x)] != (i, k):
            gone[i].append(k)
    return gone


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_near_groups(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_dart_minhash"](spark, SF_SMALL).collect()}
    assert got == near_classes(docs)


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: r["dropped"] for r in QUERIES["op4_line_dedup"](spark, SF_SMALL).collect()}
    assert got == dropped_lines(docs)


def test_edit_distance_and_segments():
    import random
    r = random.Random(4)

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            i = r.randrange(len(s) + 1)
            s[i:i + r.randrange(2)] = r.choice(["", "a", "b", "c"])
        return "".join(s)

    pairs = [(s := "".join(r.choice("ab") for _ in range(r.randrange(1, 30))), edited(s, r.randrange(5))) for _ in range(3000)]
    most = np.array([r.randrange(4) for _ in pairs])
    got = op4.within_edits([a for a, _ in pairs], [b for _, b in pairs], most)
    assert got.tolist() == [distance(a, b) <= e for (a, b), e in zip(pairs, most)]
    for _ in range(500):
        a = "".join(r.choice("abcd") for _ in range(r.randrange(20, 70)))
        short, long = sorted((a, edited(a, r.randrange(3))), key=len)
        if short != long and len(short) >= 20 and distance(short, long) <= min(2, len(short) // 20):
            index = set(op4.segment_keys([short], False)[1].tolist())
            assert index & {*op4.segment_keys([long], True)[1].tolist(), *op4.segment_keys([long], False)[1].tolist()}
            x = op4.parity_sketch([short, long]).view(np.uint64)
            assert int(np.bitwise_count(x[0] ^ x[1]).sum()) <= 2 * op4.GRAM * distance(short, long)


def test_long_lines_within_a_share_of_their_length(spark):
    import random
    r = random.Random(7)
    rows, want = [], []
    for k, n in enumerate([*range(20, 70, 3), *range(70, 420, 15), 700, 943, 2500]):
        a = "".join(r.choice("abcdefgh ") for _ in range(n))
        b, t = list(a), n // op4.CHARS_PER_EDIT
        for at in sorted(r.sample(range(n), t), reverse=True):  # t edits, all of one kind or mixed
            kind = k % 4 if k % 4 < 3 else r.randrange(3)
            b[at:at + (kind != 1)] = ["", "xy"[at % 2], "z"][kind]
        short, long = sorted((a, "".join(b)), key=len)
        if op4.edits_allowed(len(short)) >= t and len(short) >= 20:
            index = set(op4.segment_keys([short], False)[1].tolist())
            assert index & {*op4.segment_keys([long], True)[1].tolist(), *op4.segment_keys([long], False)[1].tolist()}
            assert op4.within_edits([a], [long if short == a else short], np.array([t])).tolist() == [True]
            rows += [(2 * k, a), (2 * k + 1, "".join(b))]
            want.append(2 * k + 1)
    for t in (9, 15, 30):  # against the whole table of distances
        a = "".join(r.choice("ab ") for _ in range(300))
        b = "".join(r.choice(["", "a", "b", c, c + "b"]) if r.random() < 0.08 else c for c in a)
        assert op4.within_edits([a], [b], np.array([t])).tolist() == [distance(a, b) <= t]
    gone = op4.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(want) > 30 and sorted(x["doc_id"] for x in gone) == want


def test_dart_signatures_estimate_weighted_jaccard():
    from transcripta.llm.op2_dart_minhash import dart_signatures
    item, weight = np.array([1, 2, 3, 1, 2, 4], np.uint64), np.array([3, 1.5, 2, 1, 2.5, 1])
    s = dart_signatures(np.array([0, 0, 0, 1, 1, 1]), item, weight, 2, 4000)
    assert abs((s[0] == s[1]).mean() - 2.5 / 8.5) < 0.03


def test_pipeline(spark, duck):
    """Each stage against a brute-force version on what the stage before kept."""
    frame = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = frame.columns
    kept = [r for r in op5.quality_rules(frame).collect() if r["kept"]]
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut_lineage(stage(spark, frame, SF_SMALL), "test-stage")
        assert frame.columns == columns
        steps[name] = sorted(((r["doc_id"], r["text"], r["source"]) for r in frame.collect()), key=str)
    assert steps["quality rules"] == sorted(((r["doc_id"], r["text"], r["source"]) for r in kept), key=str)
    texts = [(i, t) for i, t, _ in sorted(steps["quality rules"])]
    gone = dropped_lines(texts)
    clean = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i])) for i, t in texts}
    clean = {i: t for i, t in clean.items() if not gone[i] or t.split()}
    assert {i: t for i, t, _ in steps["line dedup"]} == clean
    classes = near_classes(sorted(clean.items()))
    assert {i for i, *_ in steps["near dedup"]} == {i for i, c in classes.items() if i == c}
    import sentencepiece
    import public_tokenizers
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF_SMALL).collect()
    want = Counter((i, tuple(library.encode(t))) for i, t, _ in steps["mix"])
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in last) == want
    total = sum(len(t.split()) for _, t, _ in steps["near dedup"])
    assert 0.9 * total <= sum(len(t.split()) for _, t, _ in steps["mix"]) <= total
