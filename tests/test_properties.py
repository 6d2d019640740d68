"""Property tests: custom kernels against brute force on small inputs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcripta.functions.stats import bh_adjust, t_tail, t_two_sided_p
from transcripta.operators import de
from transcripta.operators import enrichment as en
from transcripta.operators import immune as im
from transcripta.operators import linkage as lk
from transcripta.operators import multivariate as mv
from transcripta.operators import network as nw
from transcripta.operators import pairwise as pw


def long_frame(spark, mat, rows, cols, names=("gene", "sample", "value")):
    data = [(rows[i], cols[j], float(mat[i, j])) for i in range(len(rows)) for j in range(len(cols))
            if not np.isnan(mat[i, j])]
    return spark.createDataFrame(data, f"{names[0]} string, {names[1]} string, {names[2]} double")


# ---------------------------------------------------------------- linkage

def naive_average_linkage(d: np.ndarray, h: float):
    """Merge the closest pair (ties by lowest ids) while distance <= h."""
    clusters, heights = {i: [i] for i in range(len(d))}, []
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for a, b in itertools.combinations(keys, 2):
            v = np.mean([d[i, j] for i in clusters[a] for j in clusters[b]])
            key = (v, a, b)
            if best is None or key < best:
                best = key
        if best[0] > h:
            break
        heights.append(best)
        _, a, b = best
        clusters[a] = clusters[a] + clusters.pop(b)
    return sorted(sorted(c) for c in clusters.values()), sorted(heights)


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_matches_naive(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(6, 16))
    pts = rng.normal(size=(n, 3))
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    h = float(np.quantile(d[np.triu_indices(n, 1)], rng.uniform(0.1, 0.7)))
    names = [f"i{k:02d}" for k in range(n)]
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(n) for j in range(i + 1, n)],
                                  "a string, b string, d double")
    labels, merges = lk.average_linkage_cut(pairs, height=h)
    got = {}
    for r in labels.collect():
        got.setdefault(r["cluster"], []).append(int(r["item"][1:]))
    want, tree = naive_average_linkage(d, h)
    assert sorted(sorted(v) for v in got.values()) == want
    found = sorted((r["height"], int(r["c1"][1:]), int(r["c2"][1:])) for r in merges.collect())
    assert len(found) == len(tree)
    for (x, a, b), (y, i, j) in zip(found, tree):
        assert abs(x - y) < 1e-9 and (a, b) == (i, j)


def test_linkage_rewrites_only_what_merged(spark, monkeypatch):
    """Two far groups and a chain: the rows written per round fall with the clusters that changed; trees of several groups agree with naive ones."""
    rng = np.random.default_rng(3)
    n, rows, want = 24, [], {}
    for t in ("x", "y"):
        pts = rng.normal(size=(n, 2)) + np.repeat([0, 50], n // 2)[:, None]
        d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
        want[t] = naive_average_linkage(d, 1e9)[1]
        rows += [(t, f"i{i:02d}", f"i{j:02d}", float(d[i, j])) for i in range(n) for j in range(i + 1, n)]
    written = []
    add = lk.PairStore.add
    monkeypatch.setattr(lk.PairStore, "add", lambda self, made, part, whole=False: written.append(add(self, made, part, whole)) or written[-1])
    _, merges = lk.average_linkage_cut(spark.createDataFrame(rows, "t string, a string, b string, d double"), group_cols=("t",))
    for t, tree in want.items():
        found = sorted((r["height"], int(r["c1"][1:]), int(r["c2"][1:])) for r in merges.collect() if r["t"] == t)
        assert [(a, b) for _, a, b in found] == [(a, b) for _, a, b in tree]
        assert np.allclose([x for x, *_ in found], [x for x, *_ in tree])
    top = {r["t"]: (r["max_height"], r["n_merges"]) for r in lk.tree_height(merges, ("t",)).collect()}
    assert all(math.isclose(top[t][0], tree[-1][0]) and top[t][1] == n - 1 for t, tree in want.items())
    # after the pairs themselves, all rounds together write fewer rows than there are pairs
    assert written[0] == len(rows) and written[-1] <= 2 and sum(written[1:]) < len(rows), written


def _cut_of_points(spark, x, height, metric, pairs_of, **names):
    n = len(x)
    ids = [f"i{k:04d}" for k in range(n)]
    points = long_frame(spark, x, ids, [f"f{j:02d}" for j in range(x.shape[1])], ("sample", "gene", "value"))
    labels, merges = lk.average_linkage_cut(pairs_of(points), height, "sample_a", "sample_b", "distance", points=points, metric=metric)
    return {r["item"]: r["cluster"] for r in labels.collect()}, merges, ids


@pytest.mark.parametrize("metric", ["euclidean", "correlation"])
def test_linkage_of_points_equals_that_of_pairs(spark, monkeypatch, metric):
    """With the vectors given, no pair row is written and clusters are those of all pairs, also of clusters in several pieces and blocks."""
    def no_rows(*_):
        raise AssertionError("pair rows")
    monkeypatch.setattr(lk, "PairStore", no_rows)
    monkeypatch.setattr(lk, "PIECE", 3)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1300, 6)) * 0.4 + rng.normal(size=(40, 6))[rng.integers(0, 40, 1300)]
    x[5] = x[900]  # copies
    if metric == "correlation":
        d, height = 1 - np.corrcoef(x), 0.2
        def pairs_of(p):
            r = pw.pairwise(p, "sample", "gene", "value", floor=0.8 - 1e-9)
            return r.withColumn("distance", 1 - F.col("r"))
    else:
        d, height = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 1.1
        def pairs_of(p):
            return mv.sample_distance(p, ceiling=height)
    got, _, ids = _cut_of_points(spark, x, height, metric, pairs_of)
    want = lk.upgma_labels(d, height)
    assert got == {ids[k]: ids[int(want[k])] for k in range(len(x))}
    assert max(np.bincount(want)) > 9 and len(set(want.tolist())) < 800


def test_linkage_of_points_tree_and_absent_cells(spark):
    """The whole tree with heights; cells that are absent count as ``sample_distance`` counts them; nothing to pair."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(17, 5))
    x[3, 1] = x[8, 2] = x[11, 0] = np.nan
    got, merges, ids = _cut_of_points(spark, x, math.inf, "euclidean", mv.sample_distance)
    d = np.array([[math.sqrt(np.nansum((a - b) ** 2) * 5 / np.sum(~np.isnan(a - b))) for b in x] for a in x])
    tree = naive_average_linkage(d, math.inf)[1]
    found = sorted((r["height"], r["c1"], r["c2"]) for r in merges.collect())
    assert set(got.values()) == {ids[0]} and [(a, b) for _, a, b in found] == [(ids[a], ids[b]) for _, a, b in tree]
    assert np.allclose([h for h, *_ in found], [h for h, *_ in tree])
    alone, merges, ids = _cut_of_points(spark, x[:1], 1.0, "euclidean", mv.sample_distance)
    assert alone == {ids[0]: ids[0]} and merges.count() == 0


def test_merge_close_modules_equals_linkage_of_all_pairs(spark):
    """Groups of modules are those of average linkage over all eigengene pairs."""
    rng = np.random.default_rng(10)
    base = rng.normal(size=(5, 12))
    x = base[np.repeat(np.arange(5).repeat(6), 4)] + rng.normal(size=(120, 12)) * 0.7
    genes = [f"g{i:03d}" for i in range(120)]
    e = long_frame(spark, x, genes, [f"s{j:02d}" for j in range(12)])
    mods = spark.createDataFrame([(g, i // 4 + 1) for i, g in enumerate(genes)], "gene string, module int")
    me = {(r["module"], r["sample"]): r["eigengene"] for r in nw.module_eigengenes(e, mods).collect()}
    m = np.array([[me[k, f"s{j:02d}"] for j in range(12)] for k in range(1, 31)])
    order = np.argsort([str(k) for k in range(1, 31)])  # clusters are known by their names
    want = lk.upgma_labels((1 - np.corrcoef(m))[np.ix_(order, order)], 0.4)
    first = {c: min(int(order[k]) + 1 for k in np.flatnonzero(want == c)) for c in set(want.tolist())}
    want = {int(order[k]) + 1: first[int(want[k])] for k in range(30)}
    got = {int(r["gene"][1:]) // 4 + 1: r["module"] for r in nw.merge_close_modules(e, mods, cut_height=0.4).collect()}
    assert got == want and 1 < len(set(want.values())) < 30


def test_inputs_are_derived_once(spark, tmp_path):
    """QC, tissue typing and PCA derive their input once, however often they read it; a task of a derivation leaves a line."""
    from transcripta.operators import tissue as ts
    log = tmp_path / "rows"
    log.mkdir()

    def derived(rows, schema):
        def logged(batches):
            import os
            import uuid
            for pdf in batches:
                if len(pdf):
                    open(os.path.join(str(log), uuid.uuid4().hex), "w").close()
                yield pdf
        return spark.createDataFrame(rows, schema).coalesce(1).mapInPandas(logged, schema)

    def derivations():
        n = len(list(log.iterdir()))
        for f in log.iterdir():
            f.unlink()
        return n

    rng = np.random.default_rng(11)
    rows = [(f"g{i}", f"s{j}", float(v)) for (i, j), v in np.ndenumerate(rng.normal(size=(9, 6))) if (i, j) != (2, 3)]
    kept, ok = mv.qc_good_samples_genes(derived(rows, "gene string, sample string, value double"), min_fraction=0.9, min_n_genes=2)
    assert {r["gene"] for r in kept.collect()} == {f"g{i}" for i in range(9) if i != 2} and not ok
    assert derivations() == 1
    assert mv.pca_scores(derived([r for r in rows if r[0] != "g2"], "gene string, sample string, value double"), k=2).count() == 6
    assert derivations() == 1
    panel = [(g, "t" + s[1:], v) for g, s, v in rows if s in ("s0", "s1", "s3")]
    profiles = [(g, s, v) for g, s, v in rows if s in ("s4", "s5")]
    typed = ts.tissue_typing(derived(panel, "gene string, tissue string, value double"),
                             derived(profiles, "Gene string, sample string, max_TPM double")).collect()
    assert len(typed) == 8 and {r["n"] for r in typed} == {8} and derivations() == 2


def test_linkage_full_tree_height(spark):
    d = np.array([[0, 1, 4, 5], [1, 0, 4.5, 5.5], [4, 4.5, 0, 2], [5, 5.5, 2, 0]], dtype=float)
    names = list("abcd")
    pairs = spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(4) for j in range(i + 1, 4)],
                                  "a string, b string, d double")
    labels, merges = lk.average_linkage_cut(pairs)
    assert labels.select("cluster").distinct().count() == 1
    top = max(r["height"] for r in merges.collect())
    assert math.isclose(top, (4 + 5 + 4.5 + 5.5) / 4)


# ---------------------------------------------------------------- pairwise kernels

def r_dist(x, y, metric, p=3.0):
    d = np.abs(x - y)
    if metric == "euclidean":
        return math.sqrt((d ** 2).sum())
    if metric == "maximum":
        return d.max()
    if metric == "manhattan":
        return d.sum()
    if metric == "minkowski":
        return (d ** p).sum() ** (1 / p)
    if metric == "canberra":
        den = np.abs(x + y)
        use = ~((d == 0) & (den == 0))
        return (d[use] / den[use]).sum() * len(x) / use.sum()
    if metric == "binary":
        on = (x != 0) | (y != 0)
        return ((x != 0) ^ (y != 0)).sum() / on.sum() if on.sum() else 0.0


@pytest.mark.parametrize("metric", ["euclidean", "maximum", "manhattan", "canberra", "binary", "minkowski"])
def test_sample_distance_matches_naive(spark, metric):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 4, size=(30, 9)).astype(float)
    genes, samples = [f"g{i}" for i in range(30)], [f"s{j}" for j in range(9)]
    df = long_frame(spark, m, genes, samples)
    out = mv.sample_distance(df, metric=metric, p=3.0, block_size=3).collect()
    assert len(out) == 36
    for r in out:
        i, j = samples.index(r["sample_a"]), samples.index(r["sample_b"])
        assert math.isclose(r["distance"], r_dist(m[:, i], m[:, j], metric), rel_tol=1e-9, abs_tol=1e-12)


def test_whole_pairs_leave_as_arrow(spark, monkeypatch):
    """Pairs with complete sums are handed to Spark as Arrow columns; r is that of the sums, null without spread."""
    from transcripta.operators import tiles as ti
    rng = np.random.default_rng(31)
    x = rng.normal(size=(40, 7))
    x[4] = 0.1
    df = long_frame(spark, x, [f"g{i:02d}" for i in range(40)], [f"s{j}" for j in range(7)])
    monkeypatch.setattr(type(df), "mapInPandas", lambda *_: pytest.fail("pairs as pandas objects"))
    got = {(r["gene_a"], r["gene_b"]): r["r"] for r in mv.corr_pairs(df, block_size=9).collect()}
    assert len(got) == 40 * 39 // 2
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert r is None if 4 in (i, j) else abs(r - np.corrcoef(x[i], x[j])[0, 1]) < 1e-12
    part = ti.PearsonSums(40, 40)
    part.add(x, x)
    assert np.allclose(part.r(), ti.pearson(*part.sums()), equal_nan=True, atol=1e-14)


def test_corr_pairs_blocks_and_missing(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(25, 10))
    m[3, 4] = np.nan
    genes, samples = [f"g{i:02d}" for i in range(25)], [f"s{j}" for j in range(10)]
    df = long_frame(spark, m, genes, samples)
    out = mv.corr_pairs(df, block_size=4).collect()
    assert len(out) == 25 * 24 // 2
    for r in out:
        i, j = genes.index(r["gene_a"]), genes.index(r["gene_b"])
        ok = ~(np.isnan(m[i]) | np.isnan(m[j]))
        assert math.isclose(r["r"], np.corrcoef(m[i][ok], m[j][ok])[0, 1], rel_tol=1e-9)


@pytest.mark.parametrize("chunk_size, block_size", [(5, 4), (1000, 4), (7, 1000)])
def test_tiles_equal_whole_vectors(spark, chunk_size, block_size):
    """Chunks of features, blocks of items, absent cells: all statistics equal those of the whole vectors."""
    rng = np.random.default_rng(chunk_size)
    x = np.round(rng.normal(3, 2, size=(11, 23)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[3] = 2.5  # no spread
    x[x < 0.8] = 0.0
    rows = [(f"i{i:02d}", f"f{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(11) for j in range(23)]
    df = spark.createDataFrame(rows, "item string, feature string, value double")
    pairs = [(i, j) for i in range(11) for j in range(i + 1, 11)]

    def table(**kw):
        got = pw.pairwise(df, "item", "feature", "value", block_size=block_size, chunk_size=chunk_size, **kw).collect()
        return {(r["item_a"], r["item_b"], *([r["metric"]] if "metric" in r else [])): math.nan if r[2] is None else r[2] for r in got}

    def close(got, want):
        assert (math.isnan(got) and math.isnan(want)) or abs(got - want) < 1e-9

    r, dot = table(kind="pearson"), table(kind="dot", diagonal=True)
    metrics = ["euclidean", "maximum", "manhattan", "canberra", "binary", "minkowski"]
    dist = table(kind="distance", metric=metrics, p=3.0)
    assert len(r) == len(pairs) and len(dot) == len(pairs) + 11 and len(dist) == 6 * len(pairs)
    for i, j in pairs:
        a, b = x[i], x[j]
        ok = ~(np.isnan(a) | np.isnan(b))
        a, b, key = a[ok], b[ok], (f"i{i:02d}", f"i{j:02d}")
        close(r[key], float("nan") if 3 in (i, j) else float(np.corrcoef(a, b)[0, 1]))
        close(dot[key], float(a @ b))
        d, share = np.abs(a - b), 23 / ok.sum()
        nz = (a != 0) | (b != 0)
        want = [math.sqrt((d * d).sum() * share), d.max(), d.sum() * share, (d[nz] / np.abs(a + b)[nz]).sum() * 23 / nz.sum(),
                ((a != 0) != (b != 0)).sum() / nz.sum(), ((d ** 3).sum() * share) ** (1 / 3)]
        for m, w in zip(metrics, want):
            close(dist[(*key, m)], float(w))
    k = {(c["item"], c["power"]): c["k"] for c in pw.connectivity_by_power(
        df, "item", "feature", "value", [1, 4], block_size=block_size, chunk_size=chunk_size).collect()}
    for i in range(11):
        row = [0.0 if math.isnan(v) else abs(v) for key, v in r.items() if f"i{i:02d}" in key]
        assert abs(k[f"i{i:02d}", 4] - sum(v ** 4 for v in row)) < 1e-9 and abs(k[f"i{i:02d}", 1] - sum(row)) < 1e-9


def test_connectivity_and_tom_match_numpy(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(12, 15))
    genes, samples = [f"g{i:02d}" for i in range(12)], [f"s{j:02d}" for j in range(15)]
    df = long_frame(spark, m, genes, samples)
    r = np.corrcoef(m)
    a = np.abs(r) ** 3
    np.fill_diagonal(a, 0)
    k = {(r_["gene"], r_["power"]): r_["k"] for r_ in
         pw.connectivity_by_power(df, "gene", "sample", "value", [1, 3], block_size=4).collect()}
    for i, g in enumerate(genes):
        assert math.isclose(k[(g, 3)], a[i].sum(), rel_tol=1e-9)
    kk = a.sum(1)
    tom = (a @ a + a) / (np.minimum.outer(kk, kk) + 1 - a)
    for row in nw.topological_overlap(df, power=3.0).collect():
        i, j = genes.index(row["gene_a"]), genes.index(row["gene_b"])
        assert math.isclose(row["tom"], tom[i, j], rel_tol=1e-9)


def test_kendall_spark_matches_brute(spark):
    rng = np.random.default_rng(11)
    n = 40
    x = rng.integers(0, 6, n).astype(float)
    y = rng.integers(0, 6, n).astype(float)
    genes = [f"g{i}" for i in range(n)]
    a = spark.createDataFrame([(g, "s", float(v)) for g, v in zip(genes, x)], "gene string, sample string, value double")
    b = spark.createDataFrame([(g, "t", float(v)) for g, v in zip(genes, y)], "gene string, tissue string, value double")
    tau = pw.kendall_pairs(a, b).collect()[0]["tau"]
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    assert math.isclose(tau, s / math.sqrt((n0 - ties(x)) * (n0 - ties(y))), rel_tol=1e-12)


# ---------------------------------------------------------------- PCA

def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 7))  # genes x samples
    genes, samples = [f"g{i:02d}" for i in range(40)], [f"s{j}" for j in range(7)]
    df = long_frame(spark, m, genes, samples)
    res = mv.pca(df, k=6)
    sc = {r["sample"]: [r[f"PC{c}"] for c in range(1, 7)] for r in res["scores"].collect()}
    x = m.T
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    ref = u * s
    for c in range(6):
        col = ref[:, c]
        if col[np.argmax(np.abs(col))] < 0:
            col = -col
        got = np.array([sc[f"s{j}"][c] for j in range(7)])
        assert np.allclose(got, col, atol=1e-8)
    ex = sorted(r["proportion"] for r in res["explained"].collect())
    assert sum(ex) <= 1 + 1e-9
    assert np.allclose(sorted(s[:6] ** 2 / (6 * 40)), ex)


def test_sample_gram_trace(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(20, 5))
    df = long_frame(spark, m, [f"g{i}" for i in range(20)], [f"s{j}" for j in range(5)])
    g = mv.sample_gram(df, block_size=2).collect()
    trace = sum(r["gram"] for r in g if r["sample_a"] == r["sample_b"])
    assert math.isclose(trace, 20 * (5 - 1), rel_tol=1e-9)  # each z-scored gene has sum of squares S-1
    assert len(g) == 15


# ---------------------------------------------------------------- tests / DE

def test_bh_matches_numpy_and_is_monotone(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.uniform(size=200), 3)  # ties
    df = spark.createDataFrame([(f"g{i:03d}", float(v)) for i, v in enumerate(p)], "gene string, p double")
    out = {r["gene"]: r["FDR"] for r in bh_adjust(df, "p", "gene").collect()}
    order = np.argsort(p, kind="stable")
    m = len(p)
    adj = np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1]
    ref = np.empty(m)
    ref[order] = np.minimum(adj, 1)
    for i in range(m):
        assert math.isclose(out[f"g{i:03d}"], ref[i], rel_tol=1e-12)
    s = sorted(zip(p, [out[f"g{i:03d}"] for i in range(m)]))
    assert all(a[1] <= b[1] + 1e-15 for a, b in zip(s, s[1:]))


def exact_t_tail(t, df):
    """Two-sided p of an even df from its finite sum, with 400 digits."""
    from decimal import Decimal, localcontext
    with localcontext() as ctx:
        ctx.prec = 400
        t2, n = Decimal(t) ** 2, Decimal(df)
        c2, total, coef = n / (n + t2), Decimal(1), Decimal(1)
        for k in range(1, df // 2):
            coef *= Decimal(2 * k - 1) / Decimal(2 * k)
            total += coef * c2 ** k
        return float(1 - (t2 / (n + t2)).sqrt() * total)


def test_t_tail_has_small_relative_error():
    cases = [(t, df) for df in (2, 4, 10, 98, 198, 1000) for t in (1e-3, 0.3, 1.0, 1.7, 1.8, 3.0, 6.0, 12.0, 20.0, 200.0)]
    got = t_tail(*np.array(cases, dtype=float).T)
    for (t, df), p in zip(cases, got):
        want = exact_t_tail(t, df)
        if want > 1e-290:
            assert math.isclose(p, want, rel_tol=1e-9), (t, df, p, want)
    for t in (0.01, 1.0, 50.0, 1e8):  # one degree of freedom: arc tangent
        assert math.isclose(t_tail([t], [1.0])[0], 2 / math.pi * math.atan(1 / t), rel_tol=1e-9)
    for t in (0.5, 1.7, 5.0, 20.0):  # the normal limit
        limit = math.erfc(t / math.sqrt(2))
        assert math.isclose(t_tail([t], [math.inf])[0], limit, rel_tol=1e-12)
        assert math.isclose(t_tail([t], [1e10])[0], limit, rel_tol=1e-4)
    assert t_tail([0.0, math.inf], [5.0, 5.0]).tolist() == [1.0, 0.0]
    assert np.isnan(t_tail([math.nan, 1.0, 1.0], [5.0, math.nan, 0.0])).all()


def test_t_pvalue_column(spark):
    df = spark.createDataFrame([(2.2281,), (200.0,), (None,)], "t double")
    out = [r[0] for r in df.select(t_two_sided_p(F.col("t"), F.lit(10.0))).collect()]
    assert math.isclose(out[0], 0.05, abs_tol=1e-4) and math.isclose(out[1], exact_t_tail(200.0, 10), rel_tol=1e-9)
    assert out[2] is None


def test_moderated_t_prior_and_voom_weights(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        for s in range(8):
            grp = "case" if s >= 4 else "control"
            rows.append((f"g{g}", f"s{s}", grp, int(rng.poisson(20 + g) + (5 if grp == "case" and g < 5 else 0))))
    counts = spark.createDataFrame(rows, "gene string, sample string, grp string, value long")
    fit = de.de_linear_fit(counts.withColumn("value", F.log2(F.col("value") + 1)), None)
    mod = de.de_moderated_t(fit).collect()
    d0 = mod[0]["df_prior"]
    assert d0 > 0
    for r in mod:
        lo, hi = sorted([r["sigma2"], r["s2_prior"]])
        assert lo - 1e-12 <= r["s2_post"] <= hi + 1e-12
        assert 0 < r["PValue"] <= 1
    w = de.de_voom(counts, None).collect()
    assert all(math.isfinite(r["weight"]) and r["weight"] > 0 for r in w)


def test_design_fit_equals_weighted_least_squares(spark):
    """Three levels, a covariate, weights, contrasts and absent cells against numpy's least squares."""
    from transcripta.operators.design import design_fit
    rng = np.random.default_rng(21)
    levels, samples = ["c", "a", "b"], [f"s{i:02d}" for i in range(14)]
    grp, age = [levels[i % 3] for i in range(14)], rng.normal(50, 9, 14)
    coldata = spark.createDataFrame([(s, g, float(a), "x") for s, g, a in zip(samples, grp, age)] + [("s99", "other", 1.0, "x")],
                                    "sample string, grp string, age double, value string")
    y, w = rng.normal(1e6, 2, (6, 14)), rng.uniform(0.2, 3, (6, 14))
    y[1, :3] = np.nan
    y[4, [i for i in range(14) if grp[i] == "a"]] = np.nan  # a level without a cell
    rows = [(f"g{g}", s, None if np.isnan(y[g, i]) else float(y[g, i]), float(w[g, i])) for g in range(6) for i, s in enumerate(samples)]
    expr = spark.createDataFrame(rows + [("g0", "s99", 3.0, 1.0)], "gene string, sample string, value double, w double")
    contrasts = {"a": {"a": 1}, "b - a": {"b": 1, "a": -1}, "age": {"age": 1}, "mean": {"a": 0.5, "b": 0.5}}
    for weight in (None, "w"):
        got = {(r["gene"], r["coefficient"]): r for r in design_fit(
            expr, coldata.drop("value"), levels=levels, covariates=("age",), contrasts=contrasts, weight=weight).collect()}
        assert len(got) == 24 and all(got["g4", c]["logFC"] is None for c in ("a", "b - a"))
        x = np.column_stack([np.ones(14), [g == "a" for g in grp], [g == "b" for g in grp], age]).astype(float)
        for g in (0, 1, 2, 3, 5):
            ok = ~np.isnan(y[g])
            ww = w[g][ok] if weight else np.ones(ok.sum())
            xo, yo = x[ok], y[g][ok]
            inv = np.linalg.inv(xo.T @ (xo * ww[:, None]))
            beta = np.linalg.lstsq(xo * np.sqrt(ww)[:, None], yo * np.sqrt(ww), rcond=None)[0]
            s2 = (ww * (yo - xo @ beta) ** 2).sum() / (ok.sum() - 4)
            for name, c in {"a": [0, 1, 0, 0], "b - a": [0, -1, 1, 0], "age": [0, 0, 0, 1], "mean": [0, .5, .5, 0]}.items():
                r, c = got[f"g{g}", name], np.array(c, float)
                assert abs(r["logFC"] - c @ beta) < 1e-5 and math.isclose(r["stdev_unscaled"], math.sqrt(c @ inv @ c), rel_tol=1e-7)
                assert math.isclose(r["sigma2"], s2, rel_tol=1e-5) and r["df"] == ok.sum() - 4
    with pytest.raises(ValueError):
        design_fit(expr, coldata, levels=levels, contrasts={"z": {"zz": 1}})


def test_log_odds_follow_the_mixture(spark):
    """B and its prior variance against the definition, gene by gene, for equal and unequal degrees of freedom."""
    from transcripta.operators.design import log_odds, t_quantile
    rng = np.random.default_rng(8)
    n, df = 300, 14.5
    t = rng.standard_t(df, n) * np.where(rng.random(n) < 0.1, 5, 1)
    for own in (np.full(n, df), np.where(np.arange(n) % 2, df, 9.0)):
        rows = [(f"g{i:03d}", float(t[i]), float(own[i]), 0.6, 0.8, 4.5) for i in range(n)]
        frame = spark.createDataFrame(rows, "gene string, t double, df_total double, stdev_unscaled double, s2_prior double, df_prior double")
        tail = t_tail(t, own)
        common = np.where(own < df, t_quantile(tail, np.full(n, df)), np.abs(t))
        take = math.ceil(0.005 * n)
        share = max(take / n, 0.01)
        order = np.argsort(-np.abs(t), kind="stable")[:take]
        asked = []
        for k, i in enumerate(order):
            target = ((k + 0.5) / n - (1 - share) * tail[i]) / share
            asked.append(0.36 * ((common[i] / t_quantile(np.array([target]), np.array([df]))[0]) ** 2 - 1) if target > tail[i] else 0.0)
        v0 = float(np.mean(np.clip(asked, 0.01 / 0.8, 16 / 0.8)))
        r = (0.36 + v0) / 0.36
        want = math.log(0.01 / 0.99) - math.log(r) / 2 + (1 + own) / 2 * np.log((t * t + own) / (t * t / r + own))
        got = {x["gene"]: x["B"] for x in log_odds(frame).collect()}
        assert max(abs(got[f"g{i:03d}"] - want[i]) for i in range(n)) < 1e-8
    assert np.allclose(t_tail(t_quantile([0.3, 1e-9], [7.0, 3.0]), [7.0, 3.0]), [0.3, 1e-9], rtol=1e-9)


def test_nb_pvalue_range(spark):
    rows = [(f"g{g}", f"s{s}", "case" if s >= 3 else "control", 10 + g * (s % 3) + (s >= 3) * g)
            for g in range(10) for s in range(6)]
    counts = spark.createDataFrame(rows, "gene string, sample string, grp string, value long")
    sf = de.de_size_factors(counts)
    out = de.de_nb_two_group(counts, None, sf).collect()
    assert all(r["PValue"] is None or 0 <= r["PValue"] <= 1 for r in out)


def test_nb_statistics_equal_their_definition(spark):
    rng = np.random.default_rng(51)
    x = rng.poisson(rng.uniform(2, 4000, (25, 1)) * np.where(np.arange(8) >= 4, rng.uniform(0.2, 5, (25, 1)), 1.0))
    x[3, :4] = 0  # a group without counts
    rows = [(f"g{g:02d}", f"s{s}", "case" if s >= 4 else "control", int(x[g, s])) for g in range(25) for s in range(8)]
    counts = spark.createDataFrame(rows, "gene string, sample string, grp string, value long")
    factors = np.array([0.7, 1.1, 0.9, 1.3, 1.0, 0.8, 1.2, 1.05])
    sf = spark.createDataFrame([(f"s{s}", float(f)) for s, f in enumerate(factors)], "sample string, size_factor double")
    got = {r["gene"]: r for r in de.de_nb_two_group(counts, None, sf).collect()}
    q, seen = x / factors, 0
    for g in range(25):
        r = got[f"g{g:02d}"]
        if g == 3:
            assert r["logFC"] is None and r["PValue"] is None
            continue
        mu, v, z = [[f(half) for half in (slice(0, 4), slice(4, 8))] for f in (
            lambda h: q[g, h].mean(), lambda h: q[g, h].var(ddof=1), lambda h: (1 / factors[h]).mean())]
        disp = max(0.0, sum((v[i] - mu[i] * z[i]) / mu[i] ** 2 for i in (0, 1)) / 2)
        fold = math.log2(mu[1] / mu[0])
        se = math.sqrt(sum((z[i] / mu[i] + disp) / 4 for i in (0, 1))) / math.log(2)
        p = math.erfc(abs(fold / se) / math.sqrt(2))
        assert math.isclose(r["stat"], fold / se, rel_tol=1e-9) and math.isclose(r["dispersion"], disp, rel_tol=1e-9, abs_tol=1e-15)
        assert math.isclose(r["PValue"], p, rel_tol=1e-7)
        seen += p < 1e-6
    assert seen


def test_normal_tail_to_double_precision():
    from transcripta.functions.stats import _erfc
    x = np.concatenate([[0.0], np.linspace(1e-9, 26, 4001)])
    assert all(math.isclose(a, math.erfc(b), rel_tol=2e-12) for a, b in zip(_erfc(x), x))
    assert _erfc(np.array([np.inf, 40.0])).tolist() == [0.0, 0.0]


@pytest.mark.parametrize("normalised", [False, True])
def test_voom_weights_equal_their_definition(spark, normalised):
    rng = np.random.default_rng(52)
    genes, bins = 83, 20
    x = rng.poisson(np.exp(rng.uniform(0, 7, (genes, 1))) * rng.uniform(0.5, 2, 8))
    rows = [(f"g{g:02d}", f"s{s}", "case" if s >= 4 else "control", int(x[g, s])) for g in range(genes) for s in range(8)]
    counts = spark.createDataFrame(rows, "gene string, sample string, grp string, value long")
    factor = rng.uniform(0.8, 1.25, 8) if normalised else np.ones(8)
    norm = spark.createDataFrame([(f"s{s}", float(f)) for s, f in enumerate(factor)], "sample string, norm_factor double") if normalised else None
    got = {(r["gene"], r["sample"]): r for r in de.de_voom(counts, None, norm, n_bins=bins).collect()}
    lib = x.sum(0) * factor
    y = np.log2((x + 0.5) / (lib + 1) * 1e6)
    fit = np.repeat(np.column_stack([y[:, :4].mean(1), y[:, 4:].mean(1)]), 4, axis=1)
    sx = y.mean(1) + np.log2(lib + 1).mean() - math.log2(1e6)
    sy = (((y - fit) ** 2).sum(1) / 6) ** 0.25
    ordered = np.sort(sx)
    edges = [ordered[max(1, math.ceil(i / bins * genes)) - 1] for i in range(1, bins)]
    of = np.searchsorted(edges, sx, side="left")
    knots = sorted((np.median(sx[of == b]), np.median(sy[of == b])) for b in range(bins) if (of == b).any())
    trend = np.interp(np.log2(2 ** fit * 1e-6 * (lib + 1)), *zip(*knots))
    assert len(got) == x.size
    for g in range(genes):
        for s in range(8):
            r = got[f"g{g:02d}", f"s{s}"]
            assert math.isclose(r["logcpm"], y[g, s], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r["weight"], trend[g, s] ** -4, rel_tol=1e-7)


# ---------------------------------------------------------------- enrichment

def test_ora_pvalue_matches_comb(spark):
    lists = spark.createDataFrame([("up", f"g{i}") for i in range(0, 30)], "direction string, gene string")
    sets = spark.createDataFrame([("BP", f"t{t}", f"g{i}") for t in range(4) for i in range(t * 7, t * 7 + 12 + t)]
                                 + [("BP", "bg", f"g{i}") for i in range(200)], "ontology string, term string, gene string")
    res = en.ora_hypergeom(en.ora_counts(lists, sets, min_size=1, max_size=500)).collect()
    for r in res:
        k, m, n, big = r["Count"], r["term_size"], r["list_size"], r["universe_size"]
        p = sum(math.comb(m, x) * math.comb(big - m, n - x) for x in range(k, min(m, n) + 1)) / math.comb(big, n)
        assert math.isclose(r["pvalue"], min(p, 1.0), rel_tol=1e-9)


def _full_es(weights, hits, n):
    nr = sum(abs(weights[i]) for i in hits)
    run, best = 0.0, -1e9
    for i in range(n):
        run += abs(weights[i]) / nr if i in hits else -1.0 / (n - len(hits))
        best = max(best, run)
    return best


def test_storey_q_values(spark):
    """Proportions of true nulls and q-values of several panels against a small reference; several lambdas too."""
    rng = np.random.default_rng(12)
    panels = {"mixed": np.concatenate((rng.uniform(0, 1, 150), rng.beta(0.2, 6, 60))), "null": rng.uniform(0, 1, 90),
              "none": np.array([0.01, 0.02, 0.04]), "one": np.array([0.7])}
    rows = [(k, f"t{i:03d}", float(p)) for k, v in panels.items() for i, p in enumerate(v)] + [("null", "t999", None)]
    df = bh_adjust(spark.createDataFrame(rows, "panel string, term string, pvalue double"), "pvalue", "term", "p_adjust", ["panel"])
    grid = tuple(round(0.05 * i, 2) for i in range(1, 20))
    for lambdas in ((0.05,), grid):
        got = {(r["panel"], r["term"]): r["qvalue"] for r in en.storey_q(df, ("panel",), lambdas=lambdas).collect()}
        assert got["null", "t999"] is None
        for k, p in panels.items():
            m, lam = len(p), np.array(lambdas)
            w = (p[None, :] >= lam[:, None]).sum(1)
            raw = w / m / (1 - lam)
            mse = w / (m * m * (1 - lam) ** 2) * (1 - w / m) + (raw - np.quantile(raw, 0.1)) ** 2
            pi0 = min(1.0, raw[0] if len(lam) == 1 else raw[np.isclose(mse, mse.min(), rtol=1e-12, atol=1e-15)].min())
            order = np.argsort(p)
            q = np.empty(m)
            q[order] = np.minimum(1, np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1]) * pi0
            for i in range(m):
                g = got[k, f"t{i:03d}"]
                assert g is None if pi0 <= 0 else math.isclose(g, q[i], rel_tol=1e-9)
    kept = en.storey_q(df, ("panel",)).filter("qvalue <= 0.1").count()
    assert 0 < kept < 210


def test_gsea_score_equals_running_sum(spark):
    rng = np.random.default_rng(13)
    n = 60
    metric = np.sort(rng.normal(size=n))[::-1]
    ranked = spark.createDataFrame([(f"g{i:02d}", float(metric[i]), i + 1, n) for i in range(n)],
                                   "gene string, metric double, pos int, N long")
    sets_rows, truth = [], {}
    for t in range(8):
        hits = sorted(rng.choice(n, size=int(rng.integers(2, 12)), replace=False).tolist())
        truth[f"t{t}"] = _full_es(metric, set(hits), n)
        sets_rows += [(f"t{t}", f"g{i:02d}") for i in hits]
    sets = spark.createDataFrame(sets_rows, "term string, gene string")
    out = {r["term"]: r for r in en.gsea_score(ranked, sets).collect()}
    for t, es in truth.items():
        assert math.isclose(out[t]["ES"], es, rel_tol=1e-9, abs_tol=1e-12)
    perm = en.gsea_permutation(ranked, en.gsea_score(ranked, sets), n_perm=200, n_chunks=3).collect()
    assert len(perm) == 8
    for r in perm:
        assert 0 < r["pvalue"] <= 1 and 0 < r["p_adjust"] <= 1 and r["NES"] > 0


@pytest.mark.parametrize("slice_size, score_type", [(7, "pos"), (16, "std"), (1000, "neg")])
def test_null_scores_equal_full_running_sums(spark, slice_size, score_type):
    """Scores by slices equal the running sum over the whole list for the same drawn sets, and so do NES and p."""
    rng = np.random.default_rng(slice_size)
    n, n_perm, sizes = 60, 40, [1, 3, 8, 25]
    metric = np.sort(np.round(rng.normal(size=n), 2))[::-1]
    ranked = spark.createDataFrame([(f"g{i:02d}", float(metric[i]), i + 1, n) for i in range(n)], "gene string, metric double, pos int, N long")

    def score(hits):
        run, best, worst, nr = 0.0, -math.inf, math.inf, sum(abs(metric[i]) for i in hits) or 1.0
        for i in range(n):
            if i in hits:
                worst = min(worst, run)
                run += abs(metric[i]) / nr
                best = max(best, run)
            else:
                run -= 1 / (n - len(hits))
        return {"pos": best, "neg": worst}.get(score_type, best if best > -worst else worst)

    want = {(m, b): score(set(en.null_sequence(5, b, n, max(sizes))[:m].tolist())) for m in sizes for b in range(n_perm)}
    got = en.null_scores(ranked.select("pos", F.abs("metric").alias("w")), sizes, n_perm, 5, score_type, 3, slice_size).collect()
    assert len(got) == len(want) and all(abs(r["null_es"] - want[r["m"], r["perm"]]) < 1e-9 for r in got)
    observed = [("t1", 3, 0.4), ("t2", 8, 0.3), ("t3", 25, -0.2)]
    scores = spark.createDataFrame(observed, "term string, setSize long, ES double")
    rows = {r["term"]: r for r in en.gsea_permutation(ranked, scores, n_perm, 5, 1.0, score_type, 3, (), slice_size).collect()}
    for t, m, es in observed:
        null = [0.0 if abs(want[m, b]) < 1e-12 else want[m, b] for b in range(n_perm)]
        side = [x for x in null if (x >= 0) == (es >= 0)]
        p = (sum(x >= es if es >= 0 else x <= es for x in side) + 1) / (len(side) + 1)
        assert abs(rows[t]["pvalue"] - p) < 1e-9
        assert rows[t]["NES"] is None if not sum(side) else abs(rows[t]["NES"] - es / abs(sum(side) / len(side))) < 1e-9


# ---------------------------------------------------------------- immune

def test_nnls_matches_enumeration():
    rng = np.random.default_rng(17)
    for _ in range(30):
        a = rng.normal(size=(12, 4))
        b = rng.normal(size=12)
        f = im.nnls(a.T @ a, a.T @ b)
        best = None
        for mask in itertools.product([0, 1], repeat=4):
            idx = [i for i in range(4) if mask[i]]
            x = np.zeros(4)
            if idx:
                x[idx] = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
                if (x < 0).any():
                    continue
            v = ((a @ x - b) ** 2).sum()
            if best is None or v < best[0]:
                best = (v, x)
        assert math.isclose(((a @ f - b) ** 2).sum(), best[0], rel_tol=1e-7, abs_tol=1e-9)


def test_deconvolution_recovers_mixture(spark):
    rng = np.random.default_rng(19)
    sig = rng.uniform(0, 10, size=(50, 3))
    true = np.array([[0.6, 0.3, 0.1], [0.2, 0.2, 0.6]])
    x = sig @ true.T
    genes, types = [f"g{i}" for i in range(50)], ["A", "B", "C"]
    signature = spark.createDataFrame([(genes[i], types[k], float(sig[i, k])) for i in range(50) for k in range(3)],
                                      "gene string, cell_type string, weight double")
    expr = long_frame(spark, x, genes, ["s1", "s2"])
    out = {(r["sample"], r["cell_type"]): r["fraction"] for r in im.immune_deconvolve(expr, signature).collect()}
    for si, s in enumerate(["s1", "s2"]):
        assert math.isclose(sum(out[(s, t)] for t in types), 1.0, rel_tol=1e-9)
        for k, t in enumerate(types):
            assert math.isclose(out[(s, t)], true[si, k], abs_tol=1e-8)


# ---------------------------------------------------------------- modules

def planted(spark):
    rows = []
    for s in range(20):
        f = [math.sin(s * 0.9), math.cos(s * 1.7), math.sin(s * 2.3 + 1)]
        for m in range(3):
            for g in range(10):
                rows.append((f"m{m}_g{g}", f"s{s:02d}", f[m] + 0.05 * math.sin(7 * g + s * (m + 1))))
        for g in range(5):
            rows.append((f"noise{g}", f"s{s:02d}", math.sin(s * 13.1 + g * 3.7) * math.cos(g * s)))
    return spark.createDataFrame(rows, "gene string, sample string, value double")


@pytest.mark.parametrize("tumor", [False, True])
def test_deconvolution_moments_and_fractions(spark, tumor):
    """Moments over the genes each sample has, and fractions by enumerating the active sets."""
    rng = np.random.default_rng(30)
    kk, genes = 3, 25
    w = rng.uniform(0, 4, (genes, kk))
    w[rng.random(w.shape) < 0.3] = 0
    x = w @ np.array([[0.5, 0.1, 0.0], [0.0, 0.3, 2.0], [0.0, 0.0, 0.0]]).T + rng.normal(0, 0.05, (genes, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 2] = -1.0  # nothing fits
    sig = spark.createDataFrame([(f"g{g}", f"t{k}", float(w[g, k])) for g in range(genes) for k in range(kk) if w[g, k] or k == 0],
                                "gene string, cell_type string, weight double")
    expr = spark.createDataFrame([(f"g{g}", f"s{s}", None if np.isnan(x[g, s]) else float(x[g, s])) for g in range(genes) for s in range(3)]
                                 + [("nowhere", "s0", 5.0)], "gene string, sample string, value double")
    moments = {(r["sample"], r["cell_type"], r["other"]): r["moment"] for r in im.immune_moments(expr, sig).collect()}
    got = {(r["sample"], r["cell_type"]): r["fraction"] for r in im.immune_deconvolve(expr, sig, tumor=tumor).collect()}
    for s in range(3):
        ok = ~np.isnan(x[:, s])
        q, c = w[ok].T @ w[ok], w[ok].T @ x[ok, s]
        best = (0.0, np.zeros(kk))
        for mask in range(1, 1 << kk):
            idx = [k for k in range(kk) if mask >> k & 1]
            f = np.zeros(kk)
            f[idx] = np.linalg.lstsq(q[np.ix_(idx, idx)], c[idx], rcond=None)[0]
            if (f >= 0).all():
                best = min(best, (float(f @ q @ f / 2 - c @ f), f), key=lambda v: v[0])
        f, tot = best[1], best[1].sum()
        want = f / tot if tot > (1 if tumor else 0) else f
        for k in range(kk):
            assert abs(got[f"s{s}", f"t{k}"] - want[k]) < 1e-8 and abs(moments[f"s{s}", f"t{k}", None] - c[k]) < 1e-9
            for j in range(k + 1):
                assert abs(moments.get((f"s{s}", f"t{j}", f"t{k}"), 0.0) - q[j, k]) < 1e-9
        assert (f"s{s}", "uncharacterized") in got if tumor else (f"s{s}", "uncharacterized") not in got
        if tumor:
            assert abs(got[f"s{s}", "uncharacterized"] - max(0.0, 1 - want.sum())) < 1e-9


def test_block_linkage_equals_naive(spark):
    """The kernel of one block gives the naive tree's clusters, also with ties, two items and absent pairs."""
    rng = np.random.default_rng(61)
    full, rows = {}, []
    for b, n in ((1, 17), (2, 2), (3, 26), (4, 12)):
        d = rng.random((n, n))
        d = np.triu(np.round(d, 1) if b == 3 else d, 1)
        if b == 4:
            d[d > 0.6] = 0.9  # not listed below
        full[b] = d + d.T
        rows += [(b, f"b{b}_{j:02d}", f"b{b}_{i:02d}", float(d[i, j])) for i in range(n) for j in range(i + 1, n) if not (b == 4 and d[i, j] == 0.9)]
    pairs = spark.createDataFrame(rows, "block int, a string, b string, d double")
    for height in (0.35, 0.6, math.inf):
        got = {r["item"]: r["cluster"] for r in lk.average_linkage_blocks(pairs, "block", height, absent=0.9).collect()}
        for b, d in full.items():
            want = {i: min(c) for c in naive_average_linkage(d, height)[0] for i in c}
            # a gene without a listed pair is in no row
            assert all(got.get(f"b{b}_{i:02d}", f"b{b}_{i:02d}") == f"b{b}_{want[i]:02d}" for i in range(len(d)))
    assert lk.average_linkage_blocks(pairs.limit(0), "block").count() == 0


def test_missing_distances_never_merge():
    d = np.array([[0, np.nan, 0.2], [np.nan, 0, np.inf], [0.2, np.inf, 0]])
    assert lk.upgma_labels(d).tolist() == [0, 1, 0]


def test_sample_tables_from_either_form(spark):
    from transcripta.operators import reshape as rs
    long = spark.createDataFrame([("g1", "s2"), ("g1", "s1"), ("g2", "s1"), ("g2", None), ("g2", "s3")], "gene string, sample string")
    got = {tuple(r) for r in rs.tab_coldata_grouped(long, ["a", "b", "a"], sample="sample").collect()}
    assert got == {("s1", "a"), ("s2", "b"), ("s3", "a")}
    wide = spark.createDataFrame([("g1", 1, 2)], "GeneSymbol string, z long, y long")
    assert {tuple(r) for r in rs.tab_coldata_grouped(wide, ["a", "b"]).collect()} == {("z", "a"), ("y", "b")}
    with pytest.raises(ValueError):
        rs.tab_coldata_grouped(long, ["a"], sample="sample")
    drawn = dict(map(tuple, rs.tab_coldata_random(long, sample="sample").collect()))
    assert set(drawn) == {"s1", "s2", "s3"} and set(drawn.values()) <= {"T", "NT"}
    named = rs.tab_coldata_random(spark.createDataFrame([("g", 1, 2, 3)], "GeneSymbol string, s1 long, s2 long, s3 long"))
    assert dict(map(tuple, named.collect())) == drawn


def test_planted_modules_recovered(spark):
    e = planted(spark)
    tom = nw.topological_overlap(e, power=6.0)
    mods = {r["gene"]: r["module"] for r in nw.gene_modules(tom, cut_height=0.9, min_module_size=5).collect()}
    for m in range(3):
        labels = {mods[f"m{m}_g{g}"] for g in range(10)}
        assert len(labels) == 1 and labels != {0}
    assert len({mods[f"m{m}_g0"] for m in range(3)}) == 3
    conn = pw.connectivity_by_power(e, "gene", "sample", "value", list(range(1, 11)))
    fit = nw.soft_threshold_fit(conn).collect()
    assert len(fit) == 10 and all(0 <= r["SFT_R_sq"] <= 1 for r in fit if r["SFT_R_sq"] is not None)
    merged = nw.merge_close_modules(e, nw.gene_modules(tom, cut_height=0.9, min_module_size=5), cut_height=0.1)
    assert merged.select("module").distinct().count() >= 3


def test_modules_query_takes_the_whole_network(spark, monkeypatch):
    """A module of more genes than a block may have is one module."""
    from transcripta.plans import q_network as qn
    rng = np.random.default_rng(21)
    x = rng.normal(size=(1, 12)) + rng.normal(size=(130, 12)) * 0.05
    x = np.exp2(np.vstack([x, rng.normal(size=(20, 12))]) + 8)
    genes, samples = [f"g{i:03d}" for i in range(150)], [f"s{j:02d}" for j in range(12)]
    monkeypatch.setattr(qn.fx, "counts", lambda *_: long_frame(spark, x, genes, samples))
    got = {r["gene"]: r["module"] for r in qn.q_gene_modules(spark, "").collect()}
    assert set(got) == set(genes) and {got[g] for g in genes[:130]} == {1}


@pytest.mark.parametrize("absent, task_genes", [(False, 1000), (True, 1000), (False, 3)])
def test_network_modules_equal_linkage_of_all_overlaps(spark, absent, task_genes):
    """Modules over several blocks of genes are those of the full overlap matrix, also by Spark's rounds."""
    rng = np.random.default_rng(22)
    x = np.vstack([rng.normal(size=(1, 10)) + rng.normal(size=(9, 10)) * s for s in (0.2, 0.3, 0.4, 0.6)] + [rng.normal(size=(30, 10))])
    x[40] = 3.1  # without spread
    if absent:
        x[2, 3] = x[50, 1] = x[20, 9] = np.nan
    genes = [f"g{i:02d}" for i in rng.permutation(len(x))]
    a = np.abs(np.nan_to_num(pw.pearson_matrix(x, x)))
    a[40] = a[:, 40] = 0.0
    a = a ** 6
    np.fill_diagonal(a, 0.0)
    k = a.sum(1)
    order = np.argsort(genes)
    d = (1 - (a @ a + a) / (np.minimum.outer(k, k) + 1 - a))[np.ix_(order, order)]
    want = lk.upgma_labels(d, 0.9)
    size = {c: int((want == c).sum()) for c in set(want.tolist())}
    rank = {c: m for m, c in enumerate(sorted((c for c in size if size[c] >= 3), key=lambda c: (-size[c], c)), 1)}
    want = {genes[order[i]]: rank.get(c, 0) for i, c in enumerate(want.tolist())}
    e = long_frame(spark, x, genes, [f"s{j:02d}" for j in range(10)])
    got = {r["gene"]: r["module"] for r in nw.network_modules(e, 6.0, 0.9, 3, block_size=17, task_genes=task_genes).collect()}
    assert got == want and len(rank) >= 3


def test_gene_blocks_respect_cap(spark):
    e = planted(spark)
    blocks = nw.gene_blocks(e, max_block_size=8).groupBy("block").count().collect()
    assert sum(r["count"] for r in blocks) == 35 and max(r["count"] for r in blocks) <= 8


def test_block_kernels_with_empty_hash_blocks(spark):
    rows = [(f"g{i}", f"s{j}", float((i * 7 + j * 3) % 5 + i)) for i in range(5) for j in range(6)]
    df = spark.createDataFrame(rows, "gene string, sample string, value double")
    assert pw.pairwise(df, "gene", "sample", "value", block_size=1, min_blocks=1).count() == 10
    assert pw.connectivity_by_power(df, "gene", "sample", "value", [1, 2], block_size=1, min_blocks=1).count() == 10
    a = df.filter(F.col("sample") < "s3")
    tau = pw.kendall_pairs(a, df.withColumnRenamed("sample", "tissue"), block_size=1).count()
    assert tau == 3 * 6


def test_keyed_ranks_by_slices(spark):
    """Quantiles and trims of several keys against numpy and average ranks: ties, signs, huge and tiny values, one value."""
    from transcripta.functions.ranking import keyed_quantile, keyed_trim, ranked_values
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=400), 1), "c": np.array([2.5]), "d": np.repeat([0.0, -1.0], [30, 7]),
            "e": np.concatenate((10.0 ** rng.uniform(-300, 300, 99), -(10.0 ** rng.uniform(-300, 300, 50)), [math.inf, -math.inf, 0.0]))}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("b", math.nan), ("f", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for p in (0.0, 0.25, 0.5, 0.75, 1.0):
        got = {r["k"]: r["q"] for r in keyed_quantile(df, "k", "x", p).collect()}
        assert got.keys() == data.keys()
        for k, v in data.items():
            at, v = (len(v) - 1) * p, np.sort(v)
            lo, hi, f = v[math.floor(at)], v[math.ceil(at)], at - math.floor(at)
            assert math.isclose(got[k], lo if lo == hi else lo * (1 - f) + hi * f, rel_tol=1e-12, abs_tol=1e-14), (k, p)
    for share in (0.05, 0.3):
        got = {r["k"]: (r["lo"], r["hi"]) for r in keyed_trim(df, "k", "x", share).collect()}
        for k, v in data.items():
            u, c = np.unique(v, return_counts=True)
            rank, least = np.cumsum(c) - (c - 1) / 2, math.floor(len(v) * share) + 1
            kept = u[(rank >= least) & (rank <= len(v) + 1 - least)]
            assert got.get(k) == ((kept[0], kept[-1]) if len(kept) else None)
    upto = {(r["k"], r["x"]): (r["_upto"], r["_n"]) for r in ranked_values(df, "k", "x").collect()}
    assert all(upto[k, float(x)] == ((v <= x).sum(), len(v)) for k, v in data.items() for x in v)


def test_distributed_bh_and_rank_match_window(spark):
    from transcripta.functions.ranking import global_row_number
    rng = np.random.default_rng(23)
    p = np.round(rng.uniform(size=3000), 4)
    rows = [(f"g{i:05d}", float(v) if i % 97 else None) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "gene string, p double")
    a = {r["gene"]: r["FDR"] for r in bh_adjust(df, "p", "gene", distributed=False).collect()}
    b = {r["gene"]: r["FDR"] for r in bh_adjust(df, "p", "gene", distributed=True).collect()}
    assert a.keys() == b.keys()
    for g in a:
        assert (a[g] is None and b[g] is None) or math.isclose(a[g], b[g], rel_tol=1e-12)
    numbered, rp = global_row_number(df.filter(F.col("p").isNotNull()), ["p", "gene"], "rn", n_parts=7)
    got = sorted((r["p"], r["gene"], r["rn"]) for r in numbered.collect())
    assert [x[2] for x in got] == list(range(1, len(got) + 1))
    rp.unpersist()


def test_distributed_ranked_list_matches_window(spark):
    from tests.conftest import SF_SMALL
    from transcripta.plans import fixtures as fx
    d, m = fx.deg(spark, SF_SMALL), fx.id_map(spark, SF_SMALL)
    a = sorted(tuple(r) for r in en.gsea_ranked_list(d, m, "hsa", "down", distributed=False).collect())
    b = sorted(tuple(r) for r in en.gsea_ranked_list(d, m, "hsa", "down", distributed=True)
               .select("gene", "metric", "pos", "N").collect())
    assert a == b


@pytest.mark.parametrize("slice_size,block_size", [(4, 2), (9, 64), (4096, 1)])
def test_kendall_by_slices_equals_the_definition(spark, slice_size, block_size):
    rng = np.random.default_rng(slice_size)
    n = 60
    cols = {"fine": rng.normal(size=n), "few": rng.integers(0, 4, n).astype(float), "zeros": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
            "holes": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n)), "flat": np.ones(n), "half": rng.integers(-5, 2, n) * 0.5}
    names = list(cols)
    m = np.stack([cols[c] for c in names], axis=1)
    a = long_frame(spark, m, [f"g{i}" for i in range(n)], names)
    b = a.withColumnRenamed("sample", "tissue").unionByName(  # a column without a common gene
        spark.createDataFrame([("elsewhere", "lone", 1.0)], "gene string, tissue string, value double"))
    got = {(r["sample"], r["tissue"]): (r["tau"], r["n"]) for r in
           pw.kendall_pairs(a, b, block_size=block_size, slice_size=slice_size).collect()}
    assert len(got) == len(names) * (len(names) + 1)
    for p, q in itertools.product(names, names):
        ok = ~(np.isnan(cols[p]) | np.isnan(cols[q]))
        x, y = cols[p][ok], cols[q][ok]
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        spread = math.sqrt((sx * sx).sum() * (sy * sy).sum())
        tau, count = got[(p, q)]
        assert count == ok.sum()
        assert math.isnan(tau) if spread == 0 else math.isclose(tau, (sx * sy).sum() / spread, rel_tol=1e-9, abs_tol=1e-12)
    assert got[("fine", "lone")][1] == 0 and math.isnan(got[("fine", "lone")][0])


def test_pca_power_steps_reach_the_leading_components(spark):
    """Fewer basis columns than samples: the power steps end at numpy's leading vectors, whatever the partitions."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 3)) @ np.diag([9.0, 6.0, 4.0]) @ rng.normal(size=(3, 24)) + 0.3 * rng.normal(size=(60, 24))
    samples = [f"s{j:02d}" for j in range(24)]
    df = long_frame(spark, m, [f"g{i:02d}" for i in range(60)], samples)
    x = m.T
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    for frame in (df, df.repartition(5, "sample")):
        res = mv.pca(frame, k=3, oversample=2, tol=1e-10)
        rows = {r["sample"]: [r["PC1"], r["PC2"], r["PC3"]] for r in res["scores"].collect()}
        genes = {r["gene"]: [r["PC1"], r["PC2"], r["PC3"]] for r in res["genes"].collect()}
        for c in range(3):
            sign = np.sign(u[np.argmax(np.abs(u[:, c])), c])
            assert np.allclose([rows[n][c] for n in samples], sign * u[:, c] * s[c], atol=1e-6)
            assert np.allclose([genes[f"g{i:02d}"][c] for i in range(60)], sign * vt[c] * s[c], atol=1e-6)
        sd = [r["sdev"] for r in res["explained"].orderBy("pc").collect()]
        assert np.allclose(sd, s[:3] / math.sqrt(23), rtol=1e-9)


def test_pca_of_few_samples_takes_one_product(spark, monkeypatch):
    """Close eigenvalues of 12 samples: no power steps over the cells, and numpy's scores."""
    from transcripta.operators import components
    made, product = [], components._product
    monkeypatch.setattr(components, "_product", lambda *a: made.append(a[3]) or product(*a))
    m = np.random.default_rng(12).normal(size=(400, 12))
    samples = [f"s{j:02d}" for j in range(12)]
    res = mv.pca(long_frame(spark, m, [f"g{i:03d}" for i in range(400)], samples), k=2)
    x = m.T
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    rows = {r["sample"]: [r["PC1"], r["PC2"]] for r in res["scores"].collect()}
    for c in range(2):
        sign = np.sign(u[np.argmax(np.abs(u[:, c])), c])
        assert np.allclose([rows[n][c] for n in samples], sign * u[:, c] * s[c], atol=1e-9)
    assert made == ["gene"]


def test_kmeans_does_not_depend_on_the_order_of_rows(spark):
    """All starts drawn from this order once ended at a worse pair of clusters than those from other orders."""
    rows = [('S01', -9.742, 1.649), ('S08', -6.23, 9.476), ('S02', -24.807, 1.569), ('S11', 26.726, -25.775),
            ('S10', 4.065, 5.881), ('S06', -3.613, -17.152), ('S09', 0.614, 9.92), ('S07', -8.879, 2.025),
            ('S05', 1.462, -13.612), ('S12', 25.531, 28.106), ('S04', 0.868, 2.73), ('S03', -5.995, -4.816)]
    x = np.array([r[1:] for r in rows])
    best = min(sum(((x[g] - x[g].mean(0)) ** 2).sum() for g in (k, ~k))
               for k in (np.array([(c >> i) & 1 for i in range(12)], bool) for c in range(1, 1 << 11)))
    for some in (rows, rows[::-1]):
        frame = spark.createDataFrame(some, "sample string, PC1 double, PC2 double").coalesce(1)
        got = mv.kmeans_pcs(frame).collect()
        assert len(got) == 12 and all(math.isclose(r["total_within_ss"], best, rel_tol=1e-9) for r in got)


def test_pca_of_low_rank_and_constant_tables(spark):
    one = np.outer(np.arange(1.0, 9.0), np.array([1.0, 2.0, 4.0, 7.0]))  # every gene is the same line
    df = long_frame(spark, one, [f"g{i}" for i in range(8)], [f"s{j}" for j in range(4)])
    res = mv.pca(df, k=3)
    assert res["scores"].columns == ["sample", "PC1"]
    assert math.isclose(res["explained"].first()["proportion"], 1.0, rel_tol=1e-9)
    flat = long_frame(spark, np.ones((3, 4)), ["a", "b", "c"], [f"s{j}" for j in range(4)])
    assert mv.pca(flat)["status"] == "insufficient"


def naive_blocks(x: np.ndarray, cap: int) -> set:
    """Bisection at the mean (or median, if lopsided) along the widest direction, one block at a time."""
    todo, done = [np.arange(len(x))], set()
    while todo:
        at = todo.pop()
        if len(at) <= cap:
            done.add(frozenset(at.tolist()))
            continue
        y = x[at] - x[at].mean(0)
        t = y @ np.linalg.svd(y, full_matrices=False)[2][0]
        right = t > 0
        if not 0.1 <= right.mean() <= 0.9:
            return set()  # the fixture does not come here
        todo += [at[right], at[~right]]
    return done


def test_gene_blocks_bisect_by_similarity(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=(6, 10))
    m = np.vstack([base[g] + 0.1 * rng.normal(size=(9, 10)) for g in range(6)])
    genes = [f"g{i:02d}" for i in rng.permutation(54)]  # names say nothing about the groups
    df = long_frame(spark, m, genes, [f"s{j}" for j in range(10)])
    got = {}
    for r in nw.gene_blocks(df, max_block_size=12).collect():
        got.setdefault(r["block"], set()).add(r["gene"])
    assert sorted(got) == list(range(1, len(got) + 1)) and max(map(len, got.values())) <= 12
    for g in range(6):  # planted groups are never cut
        assert any(set(genes[9 * g:9 * g + 9]) <= b for b in got.values())
    z = (m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)
    want = {frozenset(genes[i] for i in b) for b in naive_blocks(z, 12)}
    assert want and {frozenset(b) for b in got.values()} == want


def test_gene_blocks_of_equal_genes(spark):
    df = long_frame(spark, np.tile([1.0, 2.0, 4.0, 3.0], (40, 1)), [f"g{i:02d}" for i in range(40)], ["a", "b", "c", "d"])
    sizes = [r["count"] for r in nw.gene_blocks(df, max_block_size=7).groupBy("block").count().collect()]
    assert sum(sizes) == 40 and max(sizes) <= 7


@pytest.mark.parametrize("seed", [0, 1])
def test_make_unique_equals_one_pass(spark, seed):
    """Names taken in turn: the first free suffix of the name, given names are never reused."""
    from transcripta.operators.reshape import make_unique
    rng = np.random.default_rng(seed)
    names = ["hot"] * 120 + [f"hot.{int(k)}" for k in rng.integers(1, 160, 50)] + ["b", "b", None, None, "b.1", "b.1", "b.01", "c"]
    names = [names[i] for i in rng.permutation(len(names))]
    given, next_of, seen, want = set(names), {}, set(), []
    for n in names:
        if n is None or n not in seen:
            want.append(n)
            seen.add(n)
            continue
        k = next_of.get(n, 0) + 1
        while f"{n}.{k}" in given:
            k += 1
        next_of[n] = k
        want.append(f"{n}.{k}")
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").repartition(5)
    got = [r["unique_name"] for r in make_unique(df, "name", "i").orderBy("i").collect()]
    assert got == want
