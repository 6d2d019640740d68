"""Hand-made edge fixtures (FIXTURES.md part C)."""

import math

import pytest
from pyspark.sql import functions as F

from transcripta.functions.columns import round_numeric
from transcripta.operators import compare as cmp
from transcripta.operators import de
from transcripta.operators import joins as jn
from transcripta.operators import multivariate as mv
from transcripta.operators import reshape as rs
from transcripta.sources import catalog


RUN_NAMES = ["normcounts_a_20250101t010203z", "exacttest_a_20250101t010203z", "coldata_a_20250101t010203z",
             "normcounts_a_20250202t000000z", "exacttest_a_20250202t000000z", "coldata_a_20250202t000000z",
             "normcounts_old", "coldata_20250101t010203z_20250102t010203z",
             "GENE_TABLE_x_20250202t000000z", "gene_metadata_x_20250202t000000z"]


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_latest_run_tokens(spark):
    out = {r["name"]: r for r in catalog.src_latest_run(_names(spark, RUN_NAMES)).collect()}
    assert out["normcounts_old"]["time_str"] is None
    assert out["coldata_20250101t010203z_20250102t010203z"]["time_str"] is None  # two tokens
    assert out["normcounts_a_20250202t000000z"]["is_latest"]
    assert out["GENE_TABLE_x_20250202t000000z"]["is_latest"]
    assert not out["normcounts_a_20250101t010203z"]["is_latest"]
    assert not out["normcounts_old"]["is_latest"]


def test_latest_or_all_when_no_time(spark):
    flagged = catalog.src_latest_run(_names(spark, ["normcounts_x", "exacttest_x"]))
    assert catalog.latest_or_all(flagged).count() == 2


def test_table_roles_aliases_case_insensitive(spark):
    roles = {r["name"]: r["role"] for r in catalog.src_table_roles(_names(spark, RUN_NAMES)).collect()}
    assert roles["GENE_TABLE_x_20250202t000000z"] == "deg"
    assert roles["gene_metadata_x_20250202t000000z"] == "deg"
    assert roles["coldata_a_20250101t010203z"] == "samples"
    assert roles["normcounts_old"] == "expression"


def test_match_tables_user_suffix_and_error(spark):
    listing = spark.createDataFrame(
        [("p1_alice", "normcounts_b"), ("p1_alice", "normcounts_a"), ("p2_bob", "normcounts_c"),
         ("p3_alice", "coldata_a")], "database string, name string")
    out = catalog.src_match_tables(listing, "ALICE", "^normcounts").collect()
    assert [(r["database"], r["label"], r["name"]) for r in out] == [("p1_alice", "p1", "normcounts_a")]
    with pytest.raises(ValueError):
        catalog.src_match_tables(listing, "carol", "^normcounts")


def test_gtf_attribute_edges(spark):
    rows = [
        ("transcript", 'gene_id "G1"; gene_name "A"; cov "2"; FPKM "1.5"; TPM "3.0";'),
        ("transcript", 'gene_id "G2"; ref_gene_id "R2"; gene_name "B"; TPM "abc";'),   # last match, bad TPM
        ("transcript", 'gene_id G3; gene_name "C";'),                                    # key without quotes
        ("transcript", 'gene_name "D"; gene_name "E";'),                                  # repeated key
        ("exon", 'gene_id "G5"; gene_name "F";'),
    ]
    g = spark.createDataFrame(rows, "feature string, attribute string")
    out = {r["Gene"]: r for r in rs.gtf_attributes(g).collect()}
    assert set(out) == {"A", "B", "C", "E"}
    assert out["A"]["TPM"] == 3.0 and out["A"]["cov"] == 2.0
    assert out["B"]["gene_id"] == "R2" and out["B"]["TPM"] is None
    assert out["C"]["gene_id"] is None
    assert out["E"]["cov"] is None


def test_gtf_gene_max_nan_and_null(spark):
    df = spark.createDataFrame([("A", 1.0, float("nan"), None), ("A", None, 2.0, None), ("B", None, None, None)],
                               "Gene string, cov double, FPKM double, TPM double")
    out = {r["Gene"]: r for r in rs.gtf_gene_max(df).collect()}
    assert out["A"]["max_cov"] == 1.0 and out["A"]["max_FPKM"] == 2.0 and out["A"]["max_TPM"] is None
    assert out["B"]["max_cov"] is None


def test_complete_cases_drops_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", None)], "g string, v double")
    assert [r["g"] for r in rs.complete_cases(df).collect()] == ["a"]


def _deg(spark):
    return spark.createDataFrame(
        [("up_at_cut", 1.0, 0.05), ("down_at_cut", -1.0, 0.05), ("up", 2.0, 0.01), ("p0", -3.0, 0.0),
         ("pnull", 5.0, None), ("small", 0.5, 0.001)], "GeneSymbol string, logFC double, PValue double")


def test_deg_select_strict_volcano_inclusive(spark):
    d = _deg(spark)
    sel = {r["GeneSymbol"]: r["direction"] for r in de.deg_select(d, 0.05, 1.0).collect()}
    assert sel == {"up": "up", "p0": "down"}
    col = {r["GeneSymbol"]: r["colour"] for r in de.volcano_classify(d, 1.0, 0.05).collect()}
    assert col["up_at_cut"] == "red" and col["down_at_cut"] == "blue" and col["pnull"] == "grey"
    nl = {r["GeneSymbol"]: r["neg_log10_p"] for r in de.volcano_classify(d).collect()}
    assert nl["p0"] is None and nl["pnull"] is None
    hl = spark.createDataFrame([("small",)], "g string")
    col2 = {r["GeneSymbol"]: r["colour"] for r in de.volcano_classify(d, highlight=hl).collect()}
    assert col2["small"] == "orange"


def test_heatmap_tracks_p_rules_and_no_match(spark):
    expr = spark.createDataFrame([("p0", "s1", 1.0), ("p0", "s2", 3.0), ("pnull", "s1", 2.0), ("pnull", "s2", 2.0)],
                                 "gene string, sample string, value double")
    d = _deg(spark)
    genes = spark.createDataFrame([("p0",), ("pnull",)], "g string")
    out = {(r["gene"], r["sample"]): r for r in cmp.heatmap_tracks(expr, d, genes).collect()}
    assert math.isclose(out[("p0", "s1")]["neg_log10_p"], -math.log10(2.220446e-16))
    assert out[("pnull", "s1")]["neg_log10_p"] == 0.0
    assert out[("pnull", "s1")]["z"] is None  # zero variance
    with pytest.raises(ValueError):
        cmp.heatmap_tracks(expr, d, spark.createDataFrame([("zzz",)], "g string"))


def test_volcano_top_labels_ties(spark):
    d = spark.createDataFrame([("b", 1.0, 0.01), ("a", 1.0, 0.01), ("c", 1.0, 0.02)],
                              "GeneSymbol string, logFC double, PValue double")
    assert [r["GeneSymbol"] for r in de.volcano_top_labels(d, 2).collect()] == ["a", "b"]
    assert de.volcano_top_labels(d, 0).count() == 0


def test_join_first_match_duplicates(spark):
    left = spark.createDataFrame([("g1",), ("g2",)], "gene string")
    right = spark.createDataFrame([("g1", 2, 10.0), ("g1", 1, 20.0)], "gene string, o int, v double")
    out = {r["gene"]: r["v"] for r in jn.join_first_match(left, right, "gene", "o").collect()}
    assert out == {"g1": 20.0, "g2": None}


def test_pivot_duplicate_cell_takes_max(spark):
    df = spark.createDataFrame([("m", "s", "G", 1.0), ("m", "s", "G", 5.0)],
                               "main_code string, sub_code string, Gene string, value double")
    out = rs.expr_long_to_wide(df, ["m_s"]).collect()
    assert out[0]["m_s"] == 5.0
    assert rs.duplicate_cells(df, ["main_code", "sub_code", "Gene"]).count() == 1


def test_make_unique_skips_existing(spark):
    df = spark.createDataFrame([("X", 1), ("X", 2), ("X.1", 3), ("Y", 4), ("Y", 5), ("Y", 6)],
                               "name string, pos int")
    out = {r["pos"]: r["unique_name"] for r in rs.make_unique(df, "name", "pos").collect()}
    assert out == {1: "X", 2: "X.2", 3: "X.1", 4: "Y", 5: "Y.1", 6: "Y.2"}


def test_multi_column_filter_padded(spark):
    df = spark.createDataFrame([(" A", 1), ("A ", 2), ("A", 3), ("B", 4)], "c string, n int")
    assert rs.multi_column_filter(df, {"c": " A"}).count() == 3
    assert rs.multi_column_filter(df, {"c": "all"}).count() == 4
    assert rs.multi_column_filter(df, {"c": ""}).count() == 4


def test_row_zscore_constant_gene_and_corr_null(spark):
    expr = spark.createDataFrame([("c", f"s{i}", 1.0) for i in range(4)] + [("v", f"s{i}", float(i)) for i in range(4)]
                                 + [("w", f"s{i}", float(i * i)) for i in range(4)],
                                 "gene string, sample string, value double")
    z = {(r["gene"], r["sample"]): r["z"] for r in cmp.row_zscore(expr).collect()}
    assert z[("c", "s0")] is None and z[("v", "s0")] is not None
    r = {(x["gene_a"], x["gene_b"]): x["r"] for x in mv.corr_pairs(expr).collect()}
    assert r[("c", "v")] is None or math.isnan(r[("c", "v")])
    assert r[("v", "w")] > 0.9


def test_qc_loop_drops_sparse_gene_and_sample(spark):
    rows = []
    for gi in range(8):
        for si in range(8):
            if gi == 7 and si < 5:      # gene mostly missing
                continue
            if si == 7 and gi < 6:      # sample mostly missing
                continue
            rows.append((f"g{gi}", f"s{si}", float((gi + 1) * (si + 2) % 7)))
    rows += [("const", f"s{si}", 3.0) for si in range(8)]
    df = spark.createDataFrame(rows, "gene string, sample string, value double")
    kept, ok = mv.qc_good_samples_genes(df)
    genes = {r[0] for r in kept.select("gene").distinct().collect()}
    samples = {r[0] for r in kept.select("sample").distinct().collect()}
    assert not ok
    assert "g7" not in genes and "const" not in genes and "s7" not in samples


def test_pca_two_samples_is_guarded(spark):
    df = spark.createDataFrame([("g1", "s1", 1.0), ("g1", "s2", 2.0), ("g2", "s1", 3.0), ("g2", "s2", 1.0)],
                               "gene string, sample string, value double")
    res = mv.pca(df)
    assert res["status"] == "insufficient"


def test_round_numeric_format(spark):
    df = spark.createDataFrame([("g", 1.234567, 0.000123456, 0.5)], "g string, logFC double, PValue double, x double")
    r = round_numeric(df).collect()[0]
    assert r["logFC"] == 1.23457 and r["PValue"] == "1.23456e-04" and r["x"] == 0.5


def test_se_tables_unknown_assay(spark):
    a = spark.createDataFrame([("counts", "g", "s", 1.0)], "assay string, gene string, sample string, value double")
    with pytest.raises(ValueError, match="counts"):
        rs.se_tables(a, a, a, "tpm")


def test_expr_subset_no_match_raises(spark):
    e = spark.createDataFrame([("g1", "s", 1.0)], "gene string, sample string, value double")
    gl = spark.createDataFrame([("zz", 1)], "gene string, pos int")
    with pytest.raises(ValueError):
        rs.expr_subset(e, gl)


def test_two_samples_special_genes_duplicate(spark):
    g1 = spark.createDataFrame([("a", 0.0), ("b", 50.0)], "Gene string, max_TPM double")
    g2 = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "Gene string, max_TPM double")
    sp = [r["Gene"] for r in cmp.cmp_special_genes(g1, g2).collect()]
    assert sorted(sp) == ["a", "a", "b"]


def test_latest_run_is_zone_independent(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = catalog.src_latest_run(_names(spark, ["coldata_a_20250101t010203z", "coldata_b_20251399t010203z"])).collect()
        got = {x["name"]: x["time"] for x in r}
        assert got["coldata_a_20250101t010203z"].isoformat() == "2025-01-01T01:02:03"
        assert [x["name"] for x in r if x["is_latest"]] == ["coldata_a_20250101t010203z"]
        assert got["coldata_b_20251399t010203z"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_strong_genes_keep_their_log_p(spark):
    from transcripta.operators.de import volcano_classify
    from transcripta.functions.stats import t_two_sided_p
    d = spark.createDataFrame([("a", 2.0, 200.0), ("b", 2.0, 20.0)], "GeneSymbol string, logFC double, t double")
    d = d.withColumn("PValue", t_two_sided_p(F.col("t"), F.lit(98.0)))
    got = {r["GeneSymbol"]: r["neg_log10_p"] for r in volcano_classify(d).collect()}
    assert got["a"] > 100 and abs(got["b"] - 35.64) < 0.01


def test_t_tests_without_spread_give_null(spark):
    from transcripta.operators.de import de_welch_or_pooled_t
    rows = [(g, f"s{i}", "case" if i < 3 else "control", v) for g in ("flat", "one")
            for i, v in enumerate([1.0] * 6) if g == "flat" or i in (0, 3)]
    expr = spark.createDataFrame(rows, "gene string, sample string, grp string, value double")
    for welch in (False, True):
        for r in de_welch_or_pooled_t(expr, None, welch=welch).collect():
            assert r["t"] is None and r["PValue"] is None


def test_gtf_group_labels_do_not_depend_on_names(spark, tmp_path):
    from transcripta.sources.files import src_read_gtf
    for name in ("run1", "run10", "run2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gtf").write_text(f"#c\n{name}\ts\tgene\t1\t2\t.\t+\t.\tgene_id \"x\";\n")
    got = src_read_gtf(spark, {"ten": f"{tmp_path}/run10", "one": f"{tmp_path}/run1/", "two": [f"{tmp_path}/run2/*.gtf"]})
    assert sorted((r["seqname"], r["group"]) for r in got.collect()) == [("run1", "one"), ("run10", "ten"), ("run2", "two")]


def test_deconvolution_uses_the_genes_a_sample_has(spark):
    from transcripta.operators.immune import immune_deconvolve
    sig = spark.createDataFrame([("g1", "A", 2.0), ("g1", "B", 1.0), ("g2", "A", 1.0), ("g2", "B", 3.0),
                                 ("g3", "A", 4.0), ("g3", "B", 1.0)], "gene string, cell_type string, weight double")
    full = {"g1": 1.5, "g2": 2.0, "g3": 2.5}  # half A, half B
    rows = [(g, "full", v) for g, v in full.items()] + [(g, "less", v) for g, v in full.items() if g != "g3"]
    rows += [(g, "null", None if g == "g1" else v) for g, v in full.items()]
    rows += [(g, "nan", float("nan") if g == "g2" else v) for g, v in full.items()]
    got = immune_deconvolve(spark.createDataFrame(rows, "gene string, sample string, value double"), sig).collect()
    assert len(got) == 8 and all(abs(r["fraction"] - 0.5) < 1e-9 for r in got)
    tumor = spark.createDataFrame([(g, "s", v / 2) for g, v in full.items()], "gene string, sample string, value double")
    part = {r["cell_type"]: r["fraction"] for r in immune_deconvolve(tumor, sig, tumor=True).collect()}
    assert all(abs(part[k] - v) < 1e-9 for k, v in {"A": 0.25, "B": 0.25, "uncharacterized": 0.5}.items())


def test_make_unique_compares_whole_names(spark):
    from transcripta.operators.reshape import make_unique
    names = ["a", "a", "a.01", "a.2", "a", "a." + "9" * 20, "a.0"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = [r["unique_name"] for r in make_unique(df, "name", "i").orderBy("i").collect()]
    assert got == ["a", "a.1", "a.01", "a.2", "a.3", "a." + "9" * 20, "a.0"]


def test_gsea_edges(spark):
    from transcripta.operators.enrichment import gsea_permutation, gsea_ranked_list, gsea_score
    deg = spark.createDataFrame([("s1", 1.0, 0.5), ("s0", 9.0, 0.9), ("s2", 0.0, 0.1), ("s3", -1.0, None)],
                                "GeneSymbol string, logFC double, PValue double")
    ids = spark.createDataFrame([("hsa", "s1", "e1"), ("hsa", "s0", "e1"), ("hsa", "s2", "e2"), ("hsa", "s3", "e3")],
                                "organism string, SYMBOL string, ENTREZID string")
    ranked = gsea_ranked_list(deg, ids)
    assert [(r["gene"], r["metric"], r["pos"]) for r in ranked.orderBy("pos").collect()] == [
        ("e1", 1.0, 1), ("e2", 0.0, 2), ("e3", -1.0, 3)]
    sets = spark.createDataFrame([("BP", "t", "e2"), ("MF", "t", "e1"), ("MF", "all", "e1"), ("MF", "all", "e2"),
                                  ("MF", "all", "e3")], "ontology string, term string, gene string")
    scores = gsea_score(ranked, sets, set_keys=("ontology",))
    got = {(r["ontology"], r["term"]): r["ES"] for r in scores.collect()}
    assert got[("BP", "t")] == -0.5 and got[("MF", "t")] == 1.0 and got[("MF", "all")] == 1.0  # no weight; no miss
    perm = gsea_permutation(ranked, scores, n_perm=20, set_keys=("ontology",)).collect()
    assert sorted((r["ontology"], r["term"]) for r in perm) == sorted(got)


@pytest.mark.parametrize("weight", [None, "w"])
def test_linear_fit_far_from_zero(spark, weight):
    """Residuals of values near 1e9 do not cancel."""
    rows = [("g", f"s{i}", "case" if i < 3 else "control", 1e9 + v, 2.0)
            for i, v in enumerate([0.1, 0.2, 0.3, 0.5, 0.6, 0.7])]
    expr = spark.createDataFrame(rows, "gene string, sample string, grp string, value double, w double")
    r = de.de_linear_fit(expr, None, weight=weight).first()
    assert abs(r["sigma2"] - 0.01 * (2 if weight else 1)) < 1e-6 and abs(r["logFC"] + 0.4) < 1e-5


def test_registered_qc_goes_on_until_nothing_changes(spark, monkeypatch):
    from transcripta.plans import q_multivariate as q
    cells = {(f"g{g}", f"s{s}") for g in range(1, 6) for s in range(1, 6)} | {("g6", "s1"), ("g6", "s2"), ("g6", "s3")}
    cells |= {("g1", "s6"), ("g2", "s6"), ("g6", "s6"), ("g7", "s6")}  # g7 goes, then s6, then g6
    rows = [(g, "m", s, float(i), "max_TPM") for i, (g, s) in enumerate(sorted(cells))]
    table = spark.createDataFrame(rows, "Gene string, main_code string, sub_code string, value double, normalization string")
    monkeypatch.setattr(q.fx, "long_expr", lambda *_: table)
    left = cells
    while True:  # all values of a gene differ
        n_s, n_g = len({s for _, s in left}), len({g for g, _ in left})
        genes = {g for g, _ in left if (k := sum(h == g for h, _ in left)) >= 4 and k >= 0.2 * n_s}
        samples = {s for _, s in left if (k := sum(r == s and g in genes for g, r in left)) >= 4 and k >= 0.2 * n_g}
        new = {(g, s) for g, s in left if g in genes and s in samples}
        if new == left:
            break
        left = new
    got = {(r["gene"], r["sample"].removeprefix("m_")) for r in q.q_qc_good_samples_genes(spark, "").collect()}
    assert got == left and not {"g6", "g7"} & {g for g, _ in got}


def test_registered_gsea_permutation_has_all_lists_and_ontologies(spark):
    from tests.conftest import SF_SMALL
    from __spark_entry__ import queries
    keys = ["direction", "ontology", "term"]
    got, scored = (queries()[n](spark, SF_SMALL).select(*keys).collect() for n in ("gsea_permutation", "gsea_score"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, scored)) and {r["direction"] for r in got} == {"up", "down"}
    assert len({r["ontology"] for r in got}) > 1


def test_readable_ids_and_group_names(spark):
    from transcripta.operators.enrichment import readable
    res = spark.createDataFrame([("up", "BP", "t1", "e9/e1/e2"), ("up", "BP", "t2", ""), ("up", "BP", "t3", None)],
                                "direction string, ontology string, term string, geneID string")
    ids = spark.createDataFrame([("hsa", "B", "e1"), ("hsa", "A", "e1"), ("mmu", "C", "e2"), ("hsa", "Z", "e9"), ("hsa", "Q", None)],
                                "organism string, SYMBOL string, ENTREZID string")
    got = {r["term"]: r["geneID"] for r in readable(res, ids, "hsa").collect()}
    assert got == {"t1": "Z/A/e2", "t2": "", "t3": ""}
    wide = spark.createDataFrame([("g1", 1.0, 2.0), ("g2", 3.0, None)], "gene string, a double, `b.c` double")
    genes = spark.createDataFrame([("g2",), ("g2",), (None,)], "id string")
    assert [tuple(r) for r in rs.target_profile(wide, genes, ["x", "y"]).collect()] == [("g2", 3.0, None)]
    assert rs.target_profile(wide, genes, ["x", "y"], include=False).columns == ["gene", "x", "y"]
    for names in (["x"], ["x", "x"], ["gene", "y"]):
        with pytest.raises(ValueError):
            rs.target_profile(wide, genes, names)


def test_first_match_does_not_depend_on_partitions(spark):
    from transcripta.operators import immune as im
    g1 = spark.createDataFrame([("a", 5.0), ("b", 9.0)], "Gene string, max_TPM double")
    rows = [("a", 3.0, 2), ("a", 1.0, 3), ("a", 8.0, 1), ("a", None, 4), ("b", None, 1), ("b", 0.0, 2)]
    for part in (1, 7):
        g2 = spark.createDataFrame(rows, "Gene string, max_TPM double, at int").repartition(part, "at")
        for order, want in ((None, {"a": 1.0, "b": 0.0}), ("at", {"a": 8.0, "b": None})):
            got = {r["Gene"]: r["ctc"] for r in cmp.cmp_two_samples(g1, g2, order_col=order, offset=0.0).collect()}
            assert got == want
            special = cmp.cmp_special_genes(g1, g2, low=0.5, order_col=order).collect()
            assert [(r["Gene"], r["rule"]) for r in special] == ([("b", "group1")] if order is None else [])
            long = {(r["Gene"], r["sample"]): r["value"] for r in im.immune_matrix(g1, g2, order_col=order).collect()}
            assert long[("a", "sample2")] == want["a"] and (("b", "sample2") in long) == (want["b"] is not None)


def _small_tables(spark, folder, parts, lines):
    """``part`` and ``lineitem`` tables of the given part keys and (part, month, quantity) rows."""
    spark.createDataFrame([(p,) for p in parts], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    (spark.createDataFrame(lines, "l_partkey long, m int, l_quantity double")
     .selectExpr("l_partkey", "make_date(1995, m, 3) AS l_shipdate", "l_quantity").write.parquet(f"{folder}/lineitem.parquet"))


def test_counts_never_broadcasts_the_exploded_parts(spark, tmp_path):
    """A part's cells are made after the join: no broadcast side of a plan over the counts holds an explode."""
    from transcripta.plans import fixtures as fx
    _small_tables(spark, str(tmp_path), [1, 2, 2, None], [(1, 1, 2.0), (1, 1, 3.0), (2, 12, 4.0), (9, 5, 7.0), (1, None, 8.0)])
    c = fx.counts(spark, str(tmp_path))
    got = sorted((r.gene or "", r.sample, r.value) for r in c.collect() if r.value)
    assert got == [("G1", "S01", 5), ("G2", "S12", 4), ("G2", "S12", 4)] and c.count() == 48
    listed = spark.range(1_000_000).selectExpr("concat('G', id) AS gene")
    for df in (c.join(listed, "gene").select("gene"), c.filter("value > 0").join(listed, "gene").select("gene", "value")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        join = [line for line in plan.split("\n") if "Join " in line and "p_partkey" not in line]
        generate = next(i for i, line in enumerate(plan.split("\n")) if "Generate" in line)
        outer = next(i for i, line in enumerate(plan.split("\n")) if "Join LeftOuter" in line)
        assert join and generate < outer, plan


def test_expr_subset_does_not_broadcast_the_list(spark):
    from transcripta.operators.reshape import expr_subset
    expr = spark.createDataFrame([("a", "s", 1), ("b", "s", 2)], "gene string, sample string, value int")
    out = expr_subset(expr, spark.createDataFrame([("b", 1), ("a", 2)], "gene string, pos int"))
    assert [r.gene for r in out.collect()] == ["b", "a"]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_wide_takes_the_largest_of_several_cells(spark):
    from transcripta.operators.reshape import expr_long_to_wide
    rows = [("m", "x", "g", 1.0), ("m", "x", "g", 3.0), ("m", "y", "g", None), ("m", "x", "h", None), ("n", "x", None, 2.0)]
    out = expr_long_to_wide(spark.createDataFrame(rows, "main_code string, sub_code string, Gene string, value double"), ["m_x", "m_y"])
    assert {r.Gene: (r.m_x, r.m_y) for r in out.collect()} == {"g": (3.0, None), "h": (None, None), None: (None, None)}
    assert "pivotfirst" not in out._jdf.queryExecution().executedPlan().toString().lower()


def test_rows_of_one_chunk_go_to_a_bounded_number_of_block_pairs(spark):
    """With all features in one chunk the blocks do not follow block_size; parts of a pair of blocks give every pair once."""
    import numpy as np
    from transcripta.operators.tiles import Tiles, connectivity_by_power, pairwise
    x = np.random.default_rng(5).normal(size=(400, 6))
    cells = spark.createDataFrame([(f"g{i:03d}", f"s{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "gene string, sample string, value double")
    tiles = Tiles(cells, "gene", "sample", "value", block_size=3)
    assert tiles.single and tiles.part == 3 and tiles.blocks <= np.ceil(np.sqrt(16 * spark.sparkContext.defaultParallelism))
    r = np.corrcoef(x)
    got = pairwise(cells, "gene", "sample", "value", block_size=3).toPandas()
    assert len(got) == 400 * 399 // 2 == len(got[["gene_a", "gene_b"]].drop_duplicates()) and (got.gene_a < got.gene_b).all()
    at = [got[c].str[1:].astype(int).to_numpy() for c in ("gene_a", "gene_b")]
    np.testing.assert_allclose(got.r.to_numpy(), r[at[0], at[1]], atol=1e-12)
    k = connectivity_by_power(cells, "gene", "sample", "value", [1, 6], block_size=3).toPandas()
    a = np.abs(r) - np.eye(400)
    np.testing.assert_allclose(k.sort_values(["power", "gene"]).k.to_numpy(), np.concatenate([a.sum(1), (a ** 6).sum(1)]), rtol=1e-10)
