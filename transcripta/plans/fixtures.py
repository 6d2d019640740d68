"""Expression-shaped inputs derived from the driver's TPC-H-like tables.

Each function reads parquet under ``sf_dir`` and derives one input with the
DataFrame API, so that the work grows with the tables.  The DuckDB oracle
derives the same inputs independently in SQL (``fixture_sql.py``).

Derivations (fixed rules, see FIXTURES.md):
  counts      gene = 'G'||partkey, sample = 'S'||month(shipdate) (2 digits),
              value = sum(quantity) as bigint over the full part x 12 grid
              (absent cell = 0); grp = control for S01-S06, case for S07-S12.
  long_expr   main_code = 'BC'||lpad(suppkey % 20, 3), sub_code = returnflag,
              Gene = 'G'||partkey; max of quantity / discount / price as
              max_Cov / max_FPKM / max_TPM.
  profiles    min(price*discount)/100 per part and returnflag, sample 'P_'||flag.
  panel       max(price) per part and region name (tissue).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL, CASE = "control", "case"
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _gene(col: str) -> Column:
    return F.concat(F.lit("G"), F.col(col).cast("string"))


def by_key(li: DataFrame, key: Column, *cols) -> DataFrame:
    """``_key`` and the columns of a large table, dealt by key to tasks of about ``TASK_ROWS`` rows.

    Nearly every row of these aggregates is a group of its own, so a scan's
    task would hold as many groups as its file split has rows, and a coalesced
    partition more.
    """
    tasks = max(li.sparkSession.sparkContext.defaultParallelism, math.ceil(li.count() / TASK_ROWS))
    return li.select(key.alias("_key"), *cols).repartition(tasks, "_key")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts(gene, sample, grp, value bigint): full gene x 12-sample grid.

    A part's twelve sums are one row up to the join and become cells after it:
    the size that Spark assumes for an exploded table is that of the table, so
    a grid of cells made before the join may be broadcast.
    """
    li = by_key(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.month("l_shipdate").alias("m"), "l_quantity")
    months = range(1, 13)
    agg = li.groupBy(F.col("_key").alias("pk")).agg(
        *[F.sum(F.when(F.col("m") == m, F.col("l_quantity"))).cast("bigint").alias(f"v{m}") for m in months])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk")).join(agg, "pk", "left")
    cells = F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"v{m}").alias("v")) for m in months])
    return (rows.select("pk", F.explode(cells).alias("cell")).select("pk", "cell.m", "cell.v")
            .select(_gene("pk").alias("gene"),
                    F.concat(F.lit("S"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("sample"),
                    F.when(F.col("m") <= 6, F.lit(CONTROL)).otherwise(F.lit(CASE)).alias("grp"),
                    F.coalesce(F.col("v"), F.lit(0).cast("bigint")).alias("value")))


def coldata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).select("sample", "grp").distinct()


def log_counts_by_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log2(count + 1) with a factor of three levels: the thirds of the year."""
    month = F.substring("sample", 2, 2).cast("int")
    third = F.when(month <= 4, "early").when(month <= 8, "middle").otherwise("late")
    return counts(spark, sf_dir).select("gene", "sample", F.log2(F.col("value") + 1).alias("value"), third.alias("grp"))


def normcounts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table as the reference stores it: ``genes``, ``_c0``, S01..S12."""
    c = counts(spark, sf_dir)
    samples = [f"S{m:02d}" for m in range(1, 13)]
    wide = (c.groupBy("gene").pivot("sample", samples)
            .agg(F.first(F.col("value").cast("double"))))
    return wide.select(F.lit(1).alias("_c0"), F.col("gene").alias("genes"), *samples)


def run_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Expression, DEG and sample tables of one run per ship year, keyed by table prefix, with a ``run`` time token.

    Cells of a run are the quantities shipped in its year; absent cells are null.
    """
    li = by_key(table(spark, sf_dir, "lineitem"), _gene("l_partkey"), F.month("l_shipdate").alias("m"),
                F.year("l_shipdate").alias("y"), "l_quantity")
    cells = (li.groupBy(F.col("_key").alias("genes"), "m", "y")
             .agg(F.sum("l_quantity").cast("double").alias("value"))
             .select("genes", F.concat(F.lit("S"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("mainCode"),
                     F.when(F.col("m") <= 6, F.lit(CONTROL)).otherwise(F.lit(CASE)).alias("subCode"),
                     F.concat(F.col("y").cast("string"), F.lit("0101t000000z")).alias("run"), "value"))
    wide = cells.groupBy("genes", "run").pivot("mainCode", [f"S{m:02d}" for m in range(1, 13)]).agg(F.first("value"))
    total = {g: F.coalesce(F.sum(F.when(F.col("subCode") == g, F.col("value"))), F.lit(0.0)) for g in (CASE, CONTROL)}
    change = cells.groupBy("genes", "run").agg((F.log2(total[CASE] + 1) - F.log2(total[CONTROL] + 1)).alias("logFC"))
    return {"normcounts": wide.withColumn("_c0", F.lit(1)), "exacttest": change,
            "coldata": cells.select("mainCode", "subCode", "run").distinct()}


def long_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = F.concat(F.lit("BC"), F.lpad((F.col("l_suppkey") % 20).cast("string"), 3, "0"))
    li = by_key(table(spark, sf_dir, "lineitem"), _gene("l_partkey"), main.alias("main_code"),
                F.col("l_returnflag").alias("sub_code"), "l_quantity", "l_discount", "l_extendedprice")
    agg = (li.groupBy("main_code", "sub_code", F.col("_key").alias("Gene"))
        .agg(F.max("l_quantity").alias("max_Cov"),
             F.max("l_discount").alias("max_FPKM"),
             F.max("l_extendedprice").alias("max_TPM")))
    return (agg.unpivot(["main_code", "sub_code", "Gene"],
                        ["max_Cov", "max_FPKM", "max_TPM"], "normalization", "value")
            .select("main_code", "sub_code", "normalization", "Gene", "value"))


def _dec2(c: Column) -> Column:
    """Exact 2-decimal text of a price-like double (integer arithmetic)."""
    cents = F.round(c * 100).cast("bigint")
    return F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def gtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GTF records: one per lineitem, attribute text built from part data.

    ref_gene_id follows gene_id on every 5th order (last-match rule), cov is
    omitted on every 7th order, TPM is 'NA' on every 13th order.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    ok = F.col("l_orderkey")
    attr = F.concat(
        F.lit('gene_id "G'), F.col("l_partkey").cast("string"), F.lit('"; '),
        F.when(ok % 5 == 0, F.concat(F.lit('ref_gene_id "R'), F.col("l_partkey").cast("string"),
                                     F.lit('"; '))).otherwise(F.lit("")),
        F.lit('transcript_id "T'), ok.cast("string"), F.lit("."), F.col("l_linenumber").cast("string"),
        F.lit('"; gene_name "'), F.coalesce(F.col("p_name"), F.lit("unknown")), F.lit('"; '),
        F.when(ok % 7 == 0, F.lit("")).otherwise(
            F.concat(F.lit('cov "'), F.col("l_quantity").cast("bigint").cast("string"), F.lit('"; '))),
        F.lit('FPKM "'), _dec2(F.col("l_discount") * 100), F.lit('"; '),
        F.lit('TPM "'), F.when(ok % 13 == 0, F.lit("NA")).otherwise(_dec2(F.col("l_extendedprice"))),
        F.lit('";'))
    return j.select(
        F.concat(F.lit("chr"), ((F.col("l_partkey") % 22) + 1).cast("string")).alias("seqname"),
        F.lit("StringTie").alias("source"),
        F.when(F.col("l_linenumber") == 2, F.lit("exon")).otherwise(F.lit("transcript")).alias("feature"),
        (ok * 10).alias("start"),
        (ok * 10 + F.col("l_linenumber") * 100).alias("end"),
        F.lit(".").alias("score"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("-")).otherwise(F.lit("+")).alias("strand"),
        F.lit(".").alias("frame"),
        attr.alias("attribute"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profiles(Gene, sample, max_TPM): three samples P_A, P_N, P_R."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(_gene("l_partkey").alias("Gene"),
                       F.concat(F.lit("P_"), F.col("l_returnflag")).alias("sample"))
            .agg((F.min(F.col("l_extendedprice") * F.col("l_discount")) / 100.0).alias("max_TPM")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel(gene, tissue, value): max price per part and supplier region."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # supplier/nation/region are dimension tables (bounded by supplier count);
    # Catalyst broadcasts them below the auto-broadcast threshold.
    j = (li.join(sup, li.l_suppkey == sup.s_suppkey)
         .join(nat, F.col("s_nationkey") == nat.n_nationkey)
         .join(reg, F.col("n_regionkey") == reg.r_regionkey))
    return (j.groupBy(_gene("l_partkey").alias("gene"), F.col("r_name").alias("tissue"))
            .agg(F.max("l_extendedprice").alias("value")))


def gene_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(_gene("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"),
                       F.col("p_type").alias("gene_type"), F.col("p_partkey").alias("pos"))


def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_map(organism, SYMBOL, ENTREZID): every 11th part unmapped, every 13th
    has a second id; 'hsa' for all mapped parts, 'mmu' for even keys."""
    part = table(spark, sf_dir, "part").select("p_partkey").filter(F.col("p_partkey") % 11 != 0)
    one = part.select("p_partkey", (F.col("p_partkey") + 100000).alias("eid"))
    two = part.filter(F.col("p_partkey") % 13 == 0).select(
        "p_partkey", (F.col("p_partkey") + 200000).alias("eid"))
    ids = one.unionByName(two)
    hsa = ids.select(F.lit("hsa").alias("organism"), "p_partkey", "eid")
    mmu = ids.filter(F.col("p_partkey") % 2 == 0).select(F.lit("mmu").alias("organism"), "p_partkey", "eid")
    return hsa.unionByName(mmu).select(
        "organism", _gene("p_partkey").alias("SYMBOL"), F.col("eid").cast("string").alias("ENTREZID"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene_sets(collection, ontology, organism, term, gene) keyed by Entrez id."""
    part = table(spark, sf_dir, "part")
    g = (F.col("p_partkey") + 100000).cast("string")
    go_bp = part.select(F.lit("GO").alias("collection"), F.lit("BP").alias("ontology"),
                        F.concat(F.lit("BP:"), F.col("p_brand")).alias("term"), g.alias("gene"))
    go_mf = part.select(F.lit("GO").alias("collection"), F.lit("MF").alias("ontology"),
                        F.concat(F.lit("MF:"), F.col("p_type")).alias("term"), g.alias("gene"))
    go_cc = part.select(F.lit("GO").alias("collection"), F.lit("CC").alias("ontology"),
                        F.concat(F.lit("CC:size"), F.col("p_size").cast("string")).alias("term"),
                        g.alias("gene"))
    kegg = part.select(F.lit("KEGG").alias("collection"), F.lit("pathway").alias("ontology"),
                       F.concat(F.lit("path:"), F.col("p_brand"), F.lit("_"), F.col("p_type")).alias("term"),
                       g.alias("gene"))
    out = (go_bp.unionByName(go_mf).unionByName(go_cc).unionByName(kegg)
           .withColumn("organism", F.lit("hsa")))
    # mouse pathways: even parts, their own term names
    mmu = part.filter(F.col("p_partkey") % 2 == 0).select(
        F.lit("KEGG").alias("collection"), F.lit("pathway").alias("ontology"), F.lit("mmu").alias("organism"),
        F.concat(F.lit("mmu:"), F.col("p_brand")).alias("term"), g.alias("gene"))
    return out.unionByName(mmu).select("collection", "ontology", "organism", "term", "gene")


def emb_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """emb_long(sample, gene, value, grp) from the embedding vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("V"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("sample"),
        F.posexplode("embedding").alias("i", "v"),
        F.when(F.col("label") < 5, F.lit(CONTROL)).otherwise(F.lit(CASE)).alias("grp"),
    ).select("sample",
             F.concat(F.lit("D"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("gene"),
             F.col("v").cast("double").alias("value"), "grp")


_ROLE_BY_PRIORITY = [  # fixed values: order priority -> table prefix
    ("1-URGENT", "normcounts"),
    ("2-HIGH", "exacttest"),
    ("3-MEDIUM", "coldata"),
    ("4-NOT SPECIFIED", "GENE_TABLE"),
    ("5-LOW", "sample_metadata"),
]


def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog listing (database, name) derived from orders.

    database = 'proj<custkey % 7>_' + user (alice for even customers, bob
    for odd); table = prefix + '_c<custkey>' + time token of the order date;
    status 'P' orders carry no token; every 17th order carries two tokens.
    """
    o = table(spark, sf_dir, "orders")
    prefix = F.lit(None).cast("string")
    for prio, pre in reversed(_ROLE_BY_PRIORITY):
        prefix = F.when(F.col("o_orderpriority") == prio, F.lit(pre)).otherwise(prefix)
    token = F.date_format("o_orderdate", "yyyyMMdd't'HHmmss'z'")
    name = (F.when(F.col("o_orderstatus") == "P",
                   F.concat(prefix, F.lit("_c"), F.col("o_custkey").cast("string")))
            .when(F.col("o_orderkey") % 17 == 0,
                  F.concat(prefix, F.lit("_c"), F.col("o_custkey").cast("string"), F.lit("_"),
                           token, F.lit("_"), token))
            .otherwise(F.concat(prefix, F.lit("_c"), F.col("o_custkey").cast("string"), F.lit("_"), token)))
    db = F.concat(F.lit("proj"), (F.col("o_custkey") % 7).cast("string"), F.lit("_"),
                  F.when(F.col("o_custkey") % 2 == 0, F.lit("alice")).otherwise(F.lit("bob")))
    return o.select(db.alias("database"), name.alias("name"))


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signature(gene, cell_type, weight): weight = retail price for genes of
    the cell type (part type), 1 otherwise."""
    part = table(spark, sf_dir, "part")
    types = [r[0] for r in part.select("p_type").distinct().orderBy("p_type").collect()]
    return part.select(
        _gene("p_partkey").alias("gene"), "p_type", "p_retailprice",
        F.explode(F.array(*[F.lit(t) for t in types])).alias("cell_type"),
    ).select("gene", "cell_type",
             F.when(F.col("p_type") == F.col("cell_type"), F.col("p_retailprice"))
             .otherwise(F.lit(1.0)).alias("weight"))


def deg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deg(GeneSymbol, logFC, logCPM, PValue, FDR): pooled t on log2(count+1)
    between case and control (df 10, closed-form p), BH-adjusted."""
    from transcripta.functions.stats import bh_adjust
    from transcripta.operators.de import de_welch_or_pooled_t
    c = counts(spark, sf_dir).withColumn("value", F.log2(F.col("value") + 1))
    t = de_welch_or_pooled_t(c, None)
    out = t.select(F.col("gene").alias("GeneSymbol"), "logFC", F.col("AveExpr").alias("logCPM"), "PValue")
    return bh_adjust(out, "PValue", "GeneSymbol", "FDR")
