"""DuckDB twins of the fixture views plus a tiny CTE assembler for the oracle texts.

``with_ctes(body, *names)`` prepends ``WITH name AS (...)`` for every named fragment and
its dependencies, in dependency order. Fragments are registered with ``cte(name, deps, sql)``.
"""

from __future__ import annotations

_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...] | list[str], sql: str) -> None:
    _CTE[name] = (tuple(deps), sql)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps, _ = _CTE[n]
        for d in deps:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = [f"{n} AS (\n{_CTE[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body


# ----------------------------------------------------------------------------- stays
cte("fx_stay", (), """
SELECT o_orderkey AS stay_id, o_custkey AS subject_id,
       o_custkey * 10 + (year(o_orderdate) - 1995) AS adm_id,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS intime,
       o_totalprice / 50000.0::DOUBLE AS los,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT))
         + to_seconds(CAST(floor(o_totalprice / 50000.0::DOUBLE * 86400) AS BIGINT)) AS outtime,
       CAST(floor(o_totalprice / 50000.0::DOUBLE * 1440) AS BIGINT) AS out_offset,
       c_mktsegment AS first_unit,
       CASE WHEN o_orderkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS last_unit,
       DATE '1960-01-01' + CAST((c_custkey * 37) % 14000 AS INTEGER) AS dob,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT))
            + to_hours(CAST(o_orderkey % 120 AS BIGINT)) END AS deathtime,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 'DEAD/EXPIRED'
            WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS disch_loc,
       CASE WHEN o_orderstatus = 'F' THEN 'Expired' ELSE 'Alive' END AS status,
       CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 = 0 THEN 'Expired' ELSE 'Alive' END AS hosp_status,
       c_nationkey AS hospital_id,
       CASE WHEN c_nationkey % 3 = 0 THEN 'carevue' WHEN c_nationkey % 3 = 1 THEN 'metavision'
            ELSE 'both' END AS dbsource,
       CASE WHEN c_custkey % 19 = 0 THEN '> 89' WHEN c_custkey % 23 = 0 THEN NULL
            ELSE CAST(c_custkey % 90 AS VARCHAR) END AS age_text,
       -(o_orderkey % 5000) AS unit_offset,
       1990 + c_custkey % 8 AS anchor_year,
       (c_custkey * 7) % 80 + 5 AS anchor_age
FROM orders JOIN customer ON o_custkey = c_custkey""")

# ----------------------------------------------------------------------------- codes
cte("fx_dx", (), """
SELECT l_orderkey AS stay_id, l_linenumber AS seq,
       CASE WHEN l_partkey % 2 = 0 THEN 9 ELSE 10 END AS ver,
       CASE WHEN l_partkey % 2 = 0 THEN substr(p_brand, 7, 10)
            ELSE 'K' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') END AS code
FROM lineitem JOIN part ON l_partkey = p_partkey""")

cte("fx_gem", (), """
SELECT 'K' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS icd10, substr(p_brand, 7, 10) AS icd9,
       '10000' AS flags
FROM part WHERE p_partkey % 3 <> 0""")

cte("fx_ccs", (), """
SELECT code, CAST(CAST(code AS INTEGER) % 18 + 1 AS INTEGER) AS class
FROM (SELECT DISTINCT substr(p_brand, 7, 10) AS code FROM part) b
WHERE CAST(code AS INTEGER) % 6 <> 0""")

# ----------------------------------------------------------------------------- paths
cte("fx_part_paths", (), """
SELECT p_partkey, p_brand, p_type,
       concat_ws('|', p_type, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1), p_brand) AS path4,
       concat_ws('|', p_type, split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)) AS path3
FROM part""")

cte("fx_stay_path", ("fx_part_paths",), """
SELECT l_orderkey AS stay_id, CASE WHEN l_partkey % 7 = 0 THEN path3 ELSE path4 END AS path
FROM lineitem JOIN fx_part_paths ON l_partkey = p_partkey""")

cte("fx_known", ("fx_part_paths",), """
SELECT path4 AS path,
       CASE WHEN p_partkey % 8 = 0 THEN substr(p_brand, 7, 10)
            WHEN p_partkey % 40 = 4 THEN 'K' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || ', '
                 || 'K' || lpad(CAST(p_partkey + 1 AS VARCHAR), 5, '0')
            ELSE 'K' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS codes
FROM fx_part_paths WHERE p_partkey % 4 = 0 AND p_brand <> 'Brand#3'
UNION ALL
SELECT path3 AS path,
       CASE WHEN length(substr(p_brand, 7, 10)) = 2
            THEN substr(substr(p_brand, 7, 10), 1, 1) || '.' || substr(substr(p_brand, 7, 10), 2, 1)
            ELSE substr(p_brand, 7, 10) END || ', V' || substr(p_brand, 7, 10) AS codes
FROM fx_part_paths WHERE p_partkey % 23 = 0 AND p_type <> 'LARGE'""")

cte("fx_override", ("fx_part_paths",), """
SELECT path4 AS path, CAST(p_partkey % 18 + 1 AS INTEGER) AS class
FROM fx_part_paths WHERE p_partkey % 4 = 0 AND p_brand <> 'Brand#3' AND p_partkey % 40 = 4""")

# ----------------------------------------------------------------------------- events
cte("fx_event", (), """
SELECT event_id, user_id AS id, ts,
       CASE WHEN event_type IN ('view', 'click') THEN 'lab' WHEN event_type = 'purchase' THEN 'med'
            ELSE 'inf' END AS tab,
       event_type AS code, value, json_extract_string(props, '$.k') AS uom
FROM events""")

cte("fx_event_stay", (), "SELECT user_id AS id, min(ts) AS intime FROM events GROUP BY user_id")

cte("fx_item", (), """
SELECT event_type AS "ITEMID", upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' event' AS "LABEL"
FROM (SELECT DISTINCT event_type FROM events) t WHERE event_type <> 'error'""")

# ----------------------------------------------------------------------------- text
cte("fx_dose", (), """
SELECT l_orderkey AS id, l_linenumber AS line,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL
       WHEN l_orderkey % 53 = 0 THEN ''
       WHEN l_linenumber % 6 = 0 THEN 'PRN'
       WHEN l_linenumber % 6 = 1 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ' mg'
       WHEN l_linenumber % 6 = 2 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '-'
            || CAST(CAST(floor(l_quantity) AS BIGINT) + 5 AS VARCHAR) || ' ml'
       WHEN l_linenumber % 6 = 3 THEN '1,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ' units'
       WHEN l_linenumber % 6 = 4 THEN CAST(l_linenumber AS VARCHAR) || ' '
            || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)
       ELSE CAST(CAST(floor(l_tax * 100) AS BIGINT) AS VARCHAR) || '.5 g' END AS dosage
FROM lineitem""")

cte("fx_infusion", (), """
SELECT p_partkey AS id, p_name ||
  CASE WHEN p_partkey % 11 = 0 THEN ' (a) (mcg/kg/min)'
       WHEN p_partkey % 13 = 0 THEN ' (units'
       WHEN p_partkey % 4 = 0 THEN ' (ml/hr)'
       WHEN p_partkey % 4 = 1 THEN ' (Unknown)'
       WHEN p_partkey % 4 = 2 THEN ''
       ELSE ' 0.9' END AS drugname
FROM part""")

cte("fx_text", (), "SELECT doc_id, text, lang FROM documents")

# ----------------------------------------------------------------------------- learning
cte("fx_score", (), """
SELECT doc_id AS pid, CAST(doc_id % 5 AS VARCHAR) AS client, CAST(toxic AS INTEGER) AS y,
       CAST((doc_id * 7919) % 101 AS DOUBLE) / 101.0 AS score,
       CAST(floor(doc_id / 64) AS BIGINT) AS batch
FROM labels""")

cte("fx_feature", (), """
SELECT vec_id AS pid, CAST(vec_id % 5 AS VARCHAR) AS client,
       CAST(embedding AS DOUBLE[]) AS x, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y
FROM embeddings""")

cte("fx_param", (), """
SELECT CASE WHEN owner = 5 THEN 'server' ELSE CAST(owner AS VARCHAR) END AS client,
       CASE WHEN pos < 8 THEN 'norm.weight' WHEN pos = 8 THEN 'batch.num_batches_tracked'
            ELSE 'enc.weight' END AS name,
       vec_id * 64 + pos AS idx,
       CASE WHEN pos = 8 THEN CAST(vec_id AS DOUBLE)
            ELSE CAST(v AS DOUBLE) * (owner + 1) / 5.0::DOUBLE + owner * 0.01::DOUBLE END AS value
FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v
      FROM embeddings) e,
     range(0, 6) o(owner)""")

cte("fx_metric", (), """
SELECT event_type AS client, CAST(dayofyear(ts) - 1 AS INTEGER) AS round, round(avg(value), 1) AS auprc
FROM events GROUP BY event_type, CAST(dayofyear(ts) - 1 AS INTEGER)""")

cte("fx_multilabel", (), """
SELECT l_orderkey AS pid, CAST(c_nationkey AS VARCHAR) AS client,
       list_sort(list_distinct(list(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2
            WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END))) AS labels
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey
GROUP BY l_orderkey, c_nationkey""")
