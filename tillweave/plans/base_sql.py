"""Shared fragments of the check SQL: what the rendered documents are known to contain."""

LABELS = """
    array_to_string(([
        CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 'hardware' END,
        CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gizmo%' THEN 'gadget' END,
        CASE WHEN p_name LIKE '%anvil%' OR p_name LIKE '%ring%' THEN 'metal' END
    ]), ',')
"""

# One row per rendered document (base), its items (item) and their labels (labelled).
DOCUMENTS = f"""
WITH li AS (
    SELECT l.*, p.p_name, p.p_type, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
           row_number() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
           coalesce(nullif({LABELS}, ''), 'other') AS labels
    FROM lineitem l JOIN part p ON l_partkey = p_partkey
),
agg AS (
    SELECT l_orderkey, sum(price) AS raw_subtotal, count(*) AS n, bool_or(l_linestatus = 'O') AS raw_warranty,
           max(CASE WHEN pos = 0 THEN l_returnflag END) AS first_flag
    FROM li GROUP BY 1
),
doc AS (
    SELECT o_orderkey AS k, 'receipt_' || o_orderkey || '.txt' AS filename, c_custkey AS ck, c_nationkey AS nk,
           c_name, c_mktsegment AS seg, o_orderpriority AS pri, CAST(o_orderdate AS DATE) AS odate,
           CAST(o_totalprice AS DECIMAL(12,2)) AS o_total, agg.*,
           CASE WHEN o_orderkey % 50 = 7 THEN CAST((o_orderkey // 50) % 3 AS INTEGER) ELSE -1 END AS dmg
    FROM orders JOIN agg ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
base AS (
    SELECT *, dmg <> 2 AS ok,
        CASE WHEN dmg = 2 THEN 'Unknown Merchant' ELSE c_name END AS merchant_name,
        CASE WHEN dmg = 2 THEN 'unknown merchant' ELSE replace(lower(c_name), '#', '') END AS merchant_norm,
        CASE WHEN dmg NOT IN (0, 2) THEN strftime(odate, '%Y-%m-%d') END AS day,
        CASE WHEN dmg = 2 THEN 'other' WHEN seg = 'HOUSEHOLD' THEN 'cash' WHEN seg IN ('MACHINERY', 'BUILDING') THEN 'credit'
             WHEN seg = 'AUTOMOBILE' THEN 'debit' ELSE 'apple_pay' END AS payment_method,
        CASE WHEN dmg NOT IN (1, 2) THEN raw_subtotal END AS subtotal,
        CASE WHEN dmg NOT IN (1, 2) THEN CAST((k % 900 + 100) / 100.0 AS DECIMAL(12,2)) END AS tax_amount,
        CASE WHEN dmg NOT IN (1, 2) AND pri = '1-URGENT' THEN CAST((k % 500 + 100) / 100.0 AS DECIMAL(12,2)) END AS tip_amount,
        CASE WHEN dmg NOT IN (1, 2) AND k % 7 = 0 THEN CAST(3.99 AS DECIMAL(12,2)) END AS delivery_fee,
        CASE WHEN dmg NOT IN (1, 2) AND k % 11 = 0 THEN CAST(2.50 AS DECIMAL(12,2)) END AS discounts,
        CASE WHEN dmg NOT IN (1, 2) THEN o_total END AS total_amount,
        CASE WHEN dmg <> 2 THEN raw_warranty ELSE false END AS has_warranty,
        CASE WHEN dmg <> 2 THEN first_flag = 'R' ELSE false END AS is_return,
        CASE WHEN dmg = 2 THEN NULL ELSE (ck % 900 + 100) || ' Market Street, Springfield, CA'
             || CASE WHEN ck % 4 = 0 THEN '' ELSE ' ' || (ck % 1000 + 90000) END END AS address,
        CASE WHEN dmg = 2 THEN NULL ELSE lpad(CAST(ck % 10000 AS VARCHAR), 4, '0') END AS last4
    FROM doc
),
item AS (
    SELECT b.*, li.pos, li.p_name AS name, li.price, li.labels,
           CASE WHEN b.k % 3 = 1 THEN CAST(li.l_quantity AS BIGINT) ELSE 1 END AS q
    FROM base b JOIN li ON b.k = li.l_orderkey WHERE b.ok
),
label_rows AS (
    SELECT item.*, unnest(string_split(labels, ',')) AS label FROM item
),
doc_labels AS (
    SELECT k, bool_or(label = 'hardware') AS l1, bool_or(label = 'gadget') AS l2, bool_or(label = 'metal') AS l3,
           bool_or(label = 'other') AS l4 FROM label_rows GROUP BY 1
)
"""

DOC_CATEGORIES = """array_to_string(([
    CASE WHEN l1 THEN 'hardware' END, CASE WHEN l2 THEN 'gadget' END,
    CASE WHEN l3 THEN 'metal' END, CASE WHEN l4 THEN 'other' END]), ',')"""


def documents(select: str) -> str:
    return DOCUMENTS + select
