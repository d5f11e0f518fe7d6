"""ANSI SQL (DuckDB dialect) statements of the derived inputs, used by the
oracle strings of ``__spark_entry__.oracle_sql``."""

from __future__ import annotations

ORDER_COHORT = """
li AS (
  SELECT l_orderkey, count(*) AS li_lines, sum(l_quantity) AS li_qty, avg(l_extendedprice) AS li_price,
         max(l_discount) AS li_disc_max, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS li_returned
  FROM lineitem GROUP BY l_orderkey),
oc AS (
  SELECT o.o_orderkey AS row_id, o.o_totalprice AS total,
         CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS acctbal,
         CAST(li.li_lines AS DOUBLE) AS lines, li.li_qty AS qty, li.li_price AS price,
         CASE WHEN o.o_orderkey % 10 < 6 THEN NULL ELSE li.li_disc_max END AS disc,
         CAST(1 AS DOUBLE) AS constant, 2.0 * o.o_totalprice + 1.0 AS total_x2,
         c.c_mktsegment AS segment,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderpriority END AS priority,
         CASE WHEN month(o.o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS half,
         CAST(coalesce(li.li_returned, 0) AS INTEGER) AS returned,
         CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS pending,
         CAST(year(o.o_orderdate) AS INTEGER) AS yr
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey)"""

TEXT_COHORT = """
tc AS (
  SELECT d.doc_id AS row_id, CAST(d.n_chars AS DOUBLE) AS n_chars, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def vector_cohort(dim: int = 64) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(dim))
    return f"""
vc AS (
  SELECT vec_id AS row_id, {cols}, CASE WHEN label = 0 THEN 1 ELSE 0 END AS is_zero FROM embeddings)"""


SCORE_TABLE = ORDER_COHORT + """,
st_base AS (
  SELECT row_id, least(1.0, coalesce(lines, 0) / 10.0) AS s_lines, least(1.0, coalesce(qty, 0) / 300.0) AS s_qty,
         returned, pending FROM oc),
st_lab AS (
  SELECT row_id, s_lines, s_qty, 'returned' AS endpoint, CAST(returned AS INTEGER) AS y FROM st_base
  UNION ALL
  SELECT row_id, s_lines, s_qty, 'pending' AS endpoint, CAST(pending AS INTEGER) AS y FROM st_base),
st_fold AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY endpoint, y
                  ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42'))) - 1) % 5 AS INTEGER) AS fold
  FROM st_lab),
st AS (
  SELECT endpoint, 'lines' AS model, fold, row_id, y, s_lines AS score,
         CAST(s_lines >= 0.5 AS INTEGER) AS pred FROM st_fold
  UNION ALL
  SELECT endpoint, 'qty' AS model, fold, row_id, y, s_qty AS score,
         CAST(s_qty >= 0.5 AS INTEGER) AS pred FROM st_fold)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def rounded(sql: str, cols, digits: int = 6) -> str:
    """Wrap a statement so the named double columns are rounded."""
    cols = list(cols)
    if not cols:
        return sql
    def r(c):
        x = f'CAST("{c}" AS DOUBLE)'
        return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} WHEN abs({x}) < 1e-9 THEN 0.0 "
                f"ELSE round({x} / pow(10.0, floor(log10(abs({x}))) - 3), {digits}) "
                f"* pow(10.0, floor(log10(abs({x}))) - 3) END")
    rep = ", ".join(f'{r(c)} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"
