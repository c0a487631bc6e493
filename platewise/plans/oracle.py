"""DuckDB statements of the shared inputs, mirrored by `plans.inputs` on the Spark side.

`with_ctes(sql)` prefixes the CTEs a statement uses, in dependency order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(body: str) -> str:
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    if not needed:
        return body
    parts = [f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in CTES if n in needed]
    head = "WITH RECURSIVE " + ",\n".join(parts)
    if re.match(r"\s*WITH\s+RECURSIVE\b", body, re.I):
        return head + ",\n" + re.sub(r"^\s*WITH\s+RECURSIVE\b", "", body, count=1, flags=re.I)
    if re.match(r"\s*WITH\b", body, re.I):
        return head + ",\n" + re.sub(r"^\s*WITH\b", "", body, count=1, flags=re.I)
    return head + "\n" + body


def mix_sql(x: str) -> str:
    """The 32-bit mix of `functions.hashing.mix32`."""
    x = f"((xor({x}, ({x}) >> 16) * 2246822507) & 4294967295)"
    x = f"((xor({x}, {x} >> 13) * 3266489909) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


cte("cell_meta", """
SELECT o_orderkey AS barcode, c_mktsegment AS cell_line, CAST(year(o_orderdate) AS VARCHAR) AS plate,
       quarter(o_orderdate)::BIGINT AS rep,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'DMSO' ELSE o_orderpriority END AS drug,
       CASE o_orderstatus WHEN 'F' THEN '0.1 uM' WHEN 'O' THEN '1.0 uM' ELSE '10.0 uM' END AS dose,
       '24 h' AS time,
       concat_ws('_', CAST(year(o_orderdate) AS VARCHAR), CAST(quarter(o_orderdate) AS VARCHAR),
         CASE WHEN o_orderpriority = '5-LOW' THEN 'DMSO' ELSE o_orderpriority END,
         CASE o_orderstatus WHEN 'F' THEN '0.1 uM' WHEN 'O' THEN '1.0 uM' ELSE '10.0 uM' END) AS sample,
       concat('S', CASE WHEN o_orderpriority = '5-LOW' THEN 'DMSO' ELSE o_orderpriority END) AS smiles
FROM orders JOIN customer ON o_custkey = c_custkey
""")
cte("counts", """
SELECT l_orderkey AS barcode, p_brand AS gene, l_quantity AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey
""")
cte("genes", """
SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM (SELECT DISTINCT p_brand AS gene FROM part)
""")
cte("bulk_sums", """
SELECT cell_line, sample, gene, sum(cnt) AS v FROM counts JOIN cell_meta USING (barcode) GROUP BY ALL
""")
cte("bulk_meta", """
SELECT m.*, coalesce(s.umis, 0) AS total_umis FROM
 (SELECT cell_line, sample, min(plate) AS plate, min(rep) AS rep, min(drug) AS drug, min(smiles) AS smiles, min(dose) AS dose,
         min(time) AS time, count(*) AS total_cells FROM cell_meta GROUP BY cell_line, sample) m
 LEFT JOIN (SELECT cell_line, sample, sum(v) AS umis FROM bulk_sums GROUP BY ALL) s USING (cell_line, sample)
""")
cte("profile_long", """
SELECT m.*, g.gene, g.gene_idx,
       CASE WHEN total_umis = 0 THEN 0.0::DOUBLE ELSE ln(1 + coalesce(v, 0) * 10000.0::DOUBLE / total_umis) END AS value
FROM bulk_meta m CROSS JOIN genes g LEFT JOIN bulk_sums s USING (cell_line, sample, gene)
""")
cte("ctl_long", """
SELECT cell_line, plate, time, gene, avg(value) AS m FROM profile_long WHERE drug = 'DMSO' GROUP BY ALL
""")
cte("delta_long", """
SELECT p.cell_line, p.sample, p.plate, p.rep, p.drug, p.smiles, p.dose, p.time, p.gene, p.gene_idx, p.value - c.m AS value
FROM profile_long p JOIN ctl_long c USING (cell_line, plate, time, gene) WHERE p.drug <> 'DMSO'
""")
cte("emb_long", """
SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings
""")
cte("bits_long", """
SELECT vec_id, label, pos FROM emb_long WHERE x > 0
""")
cte("scores", """
SELECT CASE l_returnflag WHEN 'A' THEN 'reference' WHEN 'N' THEN 'model' ELSE 'train_mean' END AS arm,
       c_mktsegment AS cell_line, concat('D', l_suppkey) AS drug, concat('S', l_suppkey // 2) AS smiles,
       CASE o_orderstatus WHEN 'F' THEN '0.1 uM' WHEN 'O' THEN '1.0 uM' ELSE '10.0 uM' END AS dose, '24 h' AS time,
       avg(l_discount) * 20 - 1 AS pearson, avg(l_tax) * 25 - 1 AS spearman, avg(l_quantity) AS l2,
       avg(l_discount + l_tax) * 5 AS cosine, avg(l_extendedprice) / 1000 AS rmse
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
