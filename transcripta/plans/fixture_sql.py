"""The same derived inputs as ``fixtures.py``, written as DuckDB SQL CTEs.

``with_fixtures(sql, *names)`` prefixes a query with the CTEs it needs (and
their dependencies), so every oracle is one self-contained statement over
the driver's pre-registered tables.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "counts": ("""
SELECT 'G' || CAST(g.pk AS VARCHAR) AS gene,
       'S' || lpad(CAST(g.m AS VARCHAR), 2, '0') AS sample,
       CASE WHEN g.m <= 6 THEN 'control' ELSE 'case' END AS grp,
       CAST(coalesce(a.v, 0) AS BIGINT) AS value
FROM (SELECT p_partkey AS pk, unnest(range(1, 13)) AS m FROM part) g
LEFT JOIN (SELECT l_partkey AS pk, month(l_shipdate) AS m, CAST(sum(l_quantity) AS BIGINT) AS v
           FROM lineitem GROUP BY 1, 2) a
  ON a.pk = g.pk AND a.m = g.m""", ()),
    "thirds": ("""
SELECT gene, sample, log2(value + 1) AS y, CASE WHEN sample <= 'S04' THEN 'early' WHEN sample <= 'S08' THEN 'middle' ELSE 'late' END AS grp
FROM counts""", ("counts",)),
    "coldata": ("SELECT DISTINCT sample, grp FROM counts", ("counts",)),
    "long_expr": ("""
SELECT main_code, sub_code, normalization, Gene, value FROM (
  SELECT 'BC' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS main_code,
         l_returnflag AS sub_code, 'G' || CAST(l_partkey AS VARCHAR) AS Gene,
         max(l_quantity) AS max_Cov, max(l_discount) AS max_FPKM, max(l_extendedprice) AS max_TPM
  FROM lineitem GROUP BY 1, 2, 3)
UNPIVOT (value FOR normalization IN (max_Cov, max_FPKM, max_TPM))""", ()),
    "gtf": ("""
SELECT 'chr' || CAST(l_partkey % 22 + 1 AS VARCHAR) AS seqname, 'StringTie' AS source,
       CASE WHEN l_linenumber = 2 THEN 'exon' ELSE 'transcript' END AS feature,
       l_orderkey * 10 AS start, l_orderkey * 10 + l_linenumber * 100 AS "end",
       '.' AS score, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, '.' AS frame,
       'gene_id "G' || CAST(l_partkey AS VARCHAR) || '"; '
       || CASE WHEN l_orderkey % 5 = 0 THEN 'ref_gene_id "R' || CAST(l_partkey AS VARCHAR) || '"; ' ELSE '' END
       || 'transcript_id "T' || CAST(l_orderkey AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR)
       || '"; gene_name "' || coalesce(p_name, 'unknown') || '"; '
       || CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE 'cov "' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '"; ' END
       || 'FPKM "' || CAST(CAST(round(l_discount * 100 * 100) AS BIGINT) // 100 AS VARCHAR) || '.'
       || lpad(CAST(CAST(round(l_discount * 100 * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '"; '
       || 'TPM "' || CASE WHEN l_orderkey % 13 = 0 THEN 'NA' ELSE
            CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.'
            || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END
       || '";' AS attribute
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""", ()),
    "profiles": ("""
SELECT 'G' || CAST(l_partkey AS VARCHAR) AS Gene, 'P_' || l_returnflag AS sample,
       min(l_extendedprice * l_discount) / 100.0 AS max_TPM
FROM lineitem GROUP BY 1, 2""", ()),
    "panel": ("""
SELECT 'G' || CAST(l_partkey AS VARCHAR) AS gene, r_name AS tissue, max(l_extendedprice) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""", ()),
    "gene_info": ("""
SELECT 'G' || CAST(p_partkey AS VARCHAR) AS gene_id, p_name AS gene_name, p_type AS gene_type,
       p_partkey AS pos FROM part""", ()),
    "id_map": ("""
WITH ids AS (
  SELECT p_partkey, p_partkey + 100000 AS eid FROM part WHERE p_partkey % 11 <> 0
  UNION ALL
  SELECT p_partkey, p_partkey + 200000 FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 = 0)
SELECT 'hsa' AS organism, 'G' || CAST(p_partkey AS VARCHAR) AS SYMBOL, CAST(eid AS VARCHAR) AS ENTREZID FROM ids
UNION ALL
SELECT 'mmu', 'G' || CAST(p_partkey AS VARCHAR), CAST(eid AS VARCHAR) FROM ids WHERE p_partkey % 2 = 0""", ()),
    "gene_sets": ("""
SELECT collection, ontology, 'hsa' AS organism, term, gene FROM (
  SELECT 'GO' AS collection, 'BP' AS ontology, 'BP:' || p_brand AS term, CAST(p_partkey + 100000 AS VARCHAR) AS gene FROM part
  UNION ALL SELECT 'GO', 'MF', 'MF:' || p_type, CAST(p_partkey + 100000 AS VARCHAR) FROM part
  UNION ALL SELECT 'GO', 'CC', 'CC:size' || CAST(p_size AS VARCHAR), CAST(p_partkey + 100000 AS VARCHAR) FROM part
  UNION ALL SELECT 'KEGG', 'pathway', 'path:' || p_brand || '_' || p_type, CAST(p_partkey + 100000 AS VARCHAR) FROM part)
UNION ALL
SELECT 'KEGG', 'pathway', 'mmu', 'mmu:' || p_brand, CAST(p_partkey + 100000 AS VARCHAR) FROM part WHERE p_partkey % 2 = 0""",
                  ()),
    "emb_long": ("""
SELECT 'V' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS sample,
       'D' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS gene,
       CAST(embedding[i] AS DOUBLE) AS value,
       CASE WHEN label < 5 THEN 'control' ELSE 'case' END AS grp
FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""", ()),
    "run_tables": ("""
SELECT 'proj' || CAST(o_custkey % 7 AS VARCHAR) || '_' || CASE WHEN o_custkey % 2 = 0 THEN 'alice' ELSE 'bob' END AS database,
       CASE WHEN o_orderstatus = 'P' THEN pre || '_c' || CAST(o_custkey AS VARCHAR)
            WHEN o_orderkey % 17 = 0 THEN pre || '_c' || CAST(o_custkey AS VARCHAR) || '_' || tok || '_' || tok
            ELSE pre || '_c' || CAST(o_custkey AS VARCHAR) || '_' || tok END AS name
FROM (SELECT *, strftime(o_orderdate, '%Y%m%dt%H%M%Sz') AS tok,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'normcounts' WHEN '2-HIGH' THEN 'exacttest'
                  WHEN '3-MEDIUM' THEN 'coldata' WHEN '4-NOT SPECIFIED' THEN 'GENE_TABLE'
                  WHEN '5-LOW' THEN 'sample_metadata' END AS pre
      FROM orders)""", ()),
    "signature": ("""
SELECT 'G' || CAST(p.p_partkey AS VARCHAR) AS gene, t.cell_type,
       CASE WHEN p.p_type = t.cell_type THEN p.p_retailprice ELSE 1.0 END AS weight
FROM part p, (SELECT DISTINCT p_type AS cell_type FROM part) t""", ()),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in FIXTURE_SQL[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixtures>, <extra ctes> <sql>``."""
    parts = [f"{n} AS ({FIXTURE_SQL[n][0].strip()})" for n in _order(names)]
    for n, body in extra or []:
        parts.append(f"{n} AS ({body.strip()})")
    body = sql.strip()
    if not parts:
        return body
    if body[:4].upper() == "WITH" and body[4].isspace():
        # merge the query's own CTE list into ours
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(sql: str, double_cols: list[str], digits: int = 6) -> str:
    """Round the listed double columns of a query, -0.0 folded to 0.0."""
    if not double_cols:
        return sql
    rep = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q_"


def t_p_even_sql(t: str, df: int) -> str:
    """DuckDB text of the even-df two-sided t p-value (a finite series, where
    the library uses a continued fraction; exact to 1e-16 absolute)."""
    th = f"atan(abs({t}) / sqrt({df}))"
    terms = ["1.0"]
    coef = 1.0
    for k in range(1, df // 2):
        coef *= (2 * k - 1) / (2 * k)
        terms.append(f"{coef!r} * pow(pow(cos({th}), 2), {k})")
    return f"(1.0 - sin({th}) * ({' + '.join(terms)}))"


def bh_sql(src: str, p: str, key: str, out: str = "FDR", partition: str = "") -> str:
    """BH over ``src`` rows with non-null p; rows with null p get null."""
    part = f"PARTITION BY {partition} " if partition else ""
    return f"""
SELECT * EXCLUDE (_i, _m), least(1.0, min({p} * _m / _i) OVER ({part}ORDER BY _i DESC
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {out}
FROM (SELECT *, row_number() OVER ({part}ORDER BY {p}, {key}) AS _i,
             count(*) OVER ({part.strip()}) AS _m FROM {src} WHERE {p} IS NOT NULL) _b
UNION ALL BY NAME
SELECT *, CAST(NULL AS DOUBLE) AS {out} FROM {src} WHERE {p} IS NULL"""


def _deg_sql() -> str:
    return f"""
WITH y AS (SELECT gene, grp, log2(value + 1) AS y FROM counts),
a AS (SELECT gene,
        avg(y) FILTER (WHERE grp = 'case') AS m1, avg(y) FILTER (WHERE grp = 'control') AS m0,
        var_samp(y) FILTER (WHERE grp = 'case') AS v1, var_samp(y) FILTER (WHERE grp = 'control') AS v0,
        count(y) FILTER (WHERE grp = 'case') AS n1, count(y) FILTER (WHERE grp = 'control') AS n0,
        avg(y) AS ave
      FROM y GROUP BY gene),
t AS (SELECT gene, m1 - m0 AS logFC, ave AS logCPM,
        ((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0) AS se2 FROM a),
p AS (SELECT gene AS GeneSymbol, logFC, logCPM,
        {t_p_even_sql('CASE WHEN se2 > 0 THEN logFC / sqrt(se2) END', 10)} AS PValue FROM t)
{bh_sql('p', 'PValue', 'GeneSymbol')}"""


FIXTURE_SQL["deg"] = (_deg_sql(), ("counts",))

SAMPLES = [f"S{m:02d}" for m in range(1, 13)]
FIXTURE_SQL["normcounts"] = (
    "SELECT 1 AS _c0, gene AS genes, "
    + ", ".join(f"max(CASE WHEN sample = '{s}' THEN CAST(value AS DOUBLE) END) AS {s}" for s in SAMPLES)
    + " FROM counts GROUP BY gene", ("counts",))

TIME_SQL = ("CASE WHEN len(list_filter(string_split({n}, '_'), lambda x: regexp_full_match(x, '\\d{{8}}t\\d{{6}}z'))) = 1 "
            "THEN try_strptime(list_filter(string_split({n}, '_'), lambda x: regexp_full_match(x, '\\d{{8}}t\\d{{6}}z'))[1], "
            "'%Y%m%dt%H%M%Sz') END")
TIME_STR_SQL = ("CASE WHEN len(list_filter(string_split({n}, '_'), lambda x: regexp_full_match(x, '\\d{{8}}t\\d{{6}}z'))) = 1 "
                "THEN list_filter(string_split({n}, '_'), lambda x: regexp_full_match(x, '\\d{{8}}t\\d{{6}}z'))[1] END")
ROLE_SQL = ("CASE WHEN regexp_matches(lower({n}), '^(normcounts|expression_table)') THEN 'expression' "
            "WHEN regexp_matches(lower({n}), '^(exacttest|gene_table|gene_metadata)') THEN 'deg' "
            "WHEN regexp_matches(lower({n}), '^(coldata|sample_table|sample_metadata)') THEN 'samples' END")
