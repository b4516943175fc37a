"""The same model as SQL views, for the queries that check results."""

MODEL_SQL = """
WITH suppliers_v AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS company_id, c_custkey AS supplier_id, c_name AS name, c_mktsegment AS segment,
    c_name || ' ' || lower(c_mktsegment) || ' ' || CASE WHEN c_custkey % 3 = 0 THEN 'INC' ELSE 'CO LTD' END AS display_name,
    c_custkey % 29 = 0 AS deleted
  FROM customer
), base AS (
  SELECT o_orderkey AS invoice_id, CAST(c_nationkey AS VARCHAR) AS company_id, o_custkey AS supplier_id, c_name AS supplier_name,
    'INV-' || o_orderkey AS invoice_no, CAST(o_orderdate AS DATE) AS invoice_date,
    CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PENDING_REVIEW' ELSE 'saved' END AS status,
    CASE WHEN o_orderkey % 23 = 0 THEN 'duplicate' WHEN o_orderkey % 13 = 0 THEN 'possible' ELSE 'none' END AS duplicate_status,
    CASE WHEN o_orderkey % 17 = 0 THEN 'POSSIBLE_MULTI_PAGE_OR_DUPLICATE' ELSE '' END AS warnings,
    o_orderkey % 19 = 0 AS deleted,
    CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'conflict' ELSE 'synced' END AS sync_status,
    'B-' || strftime(o_orderdate, '%Y%m%d') AS batch_id
  FROM orders JOIN customer ON o_custkey = c_custkey
), items AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR))) AS item_id,
    l_orderkey AS invoice_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS supplier_id,
    p_brand || ' ' || p_name AS raw_name, p_brand AS brand, p_type AS promo_group,
    CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS list_price, CAST(l_discount AS DECIMAL(4,2)) AS discount_rate,
    l_discount = CAST(0.1 AS DOUBLE) AS is_free,
    CAST(CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS total,
    CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS unit_price,
    l_returnflag = 'R' AS candidate_only, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem JOIN part ON l_partkey = p_partkey
), sums AS (
  SELECT invoice_id, SUM(total) AS item_total, COUNT(*) AS n_items FROM items GROUP BY invoice_id
), invoices AS (
  SELECT b.*, n_items, CAST(coalesce(item_total, 0) + CASE WHEN b.invoice_id % 5 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS total_amount,
    CAST(coalesce(item_total, 0) AS DECIMAL(18,2)) AS calculated_total, CASE WHEN b.invoice_id % 5 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS total_difference
  FROM base b LEFT JOIN sums s ON s.invoice_id = b.invoice_id
), discounts AS (
  SELECT invoice_id, min(brand) || ' discount' AS discount_name, CAST(-SUM(list_price * discount_rate) AS DECIMAL(18,4)) AS amount
  FROM items WHERE NOT is_free GROUP BY invoice_id HAVING SUM(list_price * discount_rate) > 0
), prices AS (
  SELECT item_id, company_id, i.supplier_id, product_id, raw_name AS product_name, unit_price AS price, quantity, total, invoice_date, i.invoice_id, invoice_no, line_no
  FROM items i JOIN base b ON b.invoice_id = i.invoice_id
  WHERE b.status = 'APPROVED' AND NOT b.deleted AND NOT is_free AND NOT candidate_only AND quantity > 0
), entries AS (
  SELECT *, false AS copy FROM invoices WHERE NOT deleted
  UNION ALL
  SELECT * REPLACE (CAST(invoice_date + CAST(invoice_id % 3 AS INTEGER) AS DATE) AS invoice_date, invoice_id + 1000000000 AS invoice_id), true AS copy FROM invoices WHERE NOT deleted AND invoice_id % 10 = 0
), feed AS (
  SELECT event_id AS change_id, user_id AS id, ts AS updated_at, value, event_type = 'error' AS deleted, event_type,
    'dev-' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS device_id
  FROM events
), tasks AS (
  SELECT event_id AS task_id, ts AS created_at, strftime(ts, '%Y-%m-%d') AS batch,
    CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'queued' END AS status,
    CASE event_type WHEN 'view' THEN 'template' WHEN 'click' THEN 'ai' WHEN 'purchase' THEN 'ocr' ELSE 'none' END AS source,
    props AS result_json, value
  FROM events
)
"""
