"""DuckDB SQL that gives the same rows as the queries of the same name.

It is written from the table derivation and the query descriptions, not from the
Spark code. `_TABLES` derives the logical tables; `_VIEWS` are shared steps.
"""

from __future__ import annotations

_TABLES = """
item AS (
  SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS item_code,
         p_brand || '-' || CAST(p_partkey AS VARCHAR) AS part_no,
         p_name AS item_name, p_brand AS item_group,
         CASE p_type WHEN 'ECONOMY' THEN '21' WHEN 'STANDARD' THEN '22' WHEN 'PROMO' THEN '23'
                     WHEN 'SMALL' THEN '29' WHEN 'MEDIUM' THEN '11' WHEN 'LARGE' THEN '11' END AS item_type,
         CASE WHEN p_size <= 15 THEN 'Q1' WHEN p_size <= 30 THEN 'Q2' ELSE 'Q9' END AS unit_code
  FROM part),
type_name AS (
  SELECT DISTINCT item_type AS code,
         CASE item_type WHEN '11' THEN 'product' WHEN '21' THEN 'raw' WHEN '22' THEN 'sub' ELSE 'pack' END AS name
  FROM item WHERE item_type IN ('11', '21', '22', '23')),
unit_name AS (
  SELECT DISTINCT unit_code AS code, CASE unit_code WHEN 'Q1' THEN 'EA' ELSE 'KG' END AS name
  FROM item WHERE unit_code IN ('Q1', 'Q2')),
po_header AS (
  SELECT 'S' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS po_no, o_custkey AS supplier_code,
         CAST(o_orderdate AS DATE) AS po_date
  FROM orders),
po_line AS (
  SELECT 'S' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS po_no,
         lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS line_seq,
         CASE WHEN l_linenumber = 3 AND min(l_partkey) % 10 = 0 THEN ' ' ELSE '' END
           || 'P' || lpad(CAST(min(l_partkey) AS VARCHAR), 9, '0') AS item_code,
         max(l_quantity) AS qty, CAST(max(l_shipdate) AS DATE) AS delivery_date,
         CASE WHEN bool_and(l_linestatus = 'F') THEN 'Y' ELSE 'N' END AS status
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
li AS (
  SELECT l.*, o.o_custkey,
         min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS min_part,
         'S' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS line_key,
         'G' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || CAST(year(l_shipdate) AS VARCHAR) AS receipt_no
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
shipped AS (
  SELECT *, 'P' || lpad(CAST(CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE min_part END AS VARCHAR), 9, '0') AS item_code,
         lpad(CAST(row_number() OVER (PARTITION BY receipt_no ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                      l_quantity, l_extendedprice) AS VARCHAR), 4, '0') AS line_seq
  FROM li),
receipt_line AS (
  SELECT line_key AS po_line_key, item_code, l_quantity AS qty, 'I' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS actual_no
  FROM shipped WHERE l_linestatus = 'F'),
receipt_header AS (SELECT DISTINCT actual_no, '1' AS receipt_type FROM receipt_line),
prov_line AS (
  SELECT receipt_no, line_seq, CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN '' ELSE line_key END AS po_line_key,
         item_code, l_quantity AS qty, CASE WHEN l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS status,
         CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS updated_on
  FROM shipped),
prov_header AS (
  SELECT receipt_no, o_custkey AS supplier_code, CAST(min(l_shipdate) AS DATE) AS saved_on,
         CAST(max(l_shipdate) AS DATE) AS due_date
  FROM li GROUP BY receipt_no, o_custkey)
"""

_VIEWS = """
bought AS (
  SELECT item_code, part_no, item_name, item_group, coalesce(u.name, i.unit_code) AS unit
  FROM item i LEFT JOIN unit_name u ON u.code = i.unit_code WHERE item_type LIKE '2%'),
po_roll AS (
  SELECT po_no, arg_min(item_code, line_seq) AS first_item_code, count(*) AS line_count,
         arg_min(delivery_date, line_seq) AS delivery_date,
         CASE WHEN bool_or(status = 'N') THEN 'N' ELSE 'Y' END AS status
  FROM po_line GROUP BY po_no),
po_named AS (
  SELECT r.*, i.item_name, coalesce(i.item_name, r.first_item_code) AS shown
  FROM po_roll r LEFT JOIN item i ON trim(i.item_code) = trim(r.first_item_code)),
ordered AS (
  SELECT po_no || line_seq AS po_line_key, item_code, sum(qty) AS ordered_qty FROM po_line GROUP BY ALL),
received AS (SELECT po_line_key, item_code, sum(qty) AS received_qty FROM receipt_line GROUP BY ALL),
balance AS (
  SELECT o.po_line_key, o.item_code, ordered_qty, coalesce(received_qty, 0) AS received_qty,
         ordered_qty - coalesce(received_qty, 0) AS outstanding_qty
  FROM ordered o LEFT JOIN received r ON r.po_line_key = o.po_line_key AND r.item_code = o.item_code),
announced AS (
  SELECT po_line_key, item_code, sum(qty) AS provisional_qty, sum(qty) FILTER (WHERE status = 'N') AS open_provisional_qty
  FROM prov_line GROUP BY ALL),
line_status AS (
  SELECT h.po_no, h.po_date, h.supplier_code, l.item_code, l.status, i.part_no, i.item_name, i.item_group, b.ordered_qty,
         b.received_qty, b.outstanding_qty, a.provisional_qty, i.unit, b.po_line_key, l.po_no || l.line_seq AS own_key
  FROM po_header h LEFT JOIN po_line l ON l.po_no = h.po_no
  LEFT JOIN balance b ON b.po_line_key = l.po_no || l.line_seq
  LEFT JOIN announced a ON a.po_line_key = l.po_no || l.line_seq AND a.item_code = l.item_code
  LEFT JOIN bought i ON i.item_code = l.item_code),
receipt_lines_po AS (
  SELECT p.*, l.po_no, p.line_seq = min(p.line_seq) OVER (PARTITION BY p.receipt_no) AS is_first
  FROM prov_line p LEFT JOIN po_line l ON l.po_no || l.line_seq = p.po_line_key),
receipt_roll AS (
  SELECT receipt_no, po_no, max(item_code) FILTER (WHERE is_first) AS receipt_item, arg_min(item_code, line_seq) AS group_item,
         count(*) AS line_count, max(updated_on) AS last_update,
         CASE WHEN bool_or(status = 'N') THEN 'N' ELSE 'Y' END AS status
  FROM receipt_lines_po GROUP BY receipt_no, po_no),
history AS (
  SELECT h.receipt_no, h.supplier_code, h.due_date, r.po_no, strftime(h.saved_on, '%Y%m%d') AS saved_on,
         strftime(r.last_update, '%Y%m%d') AS last_update, r.status, p.status AS po_status, r.line_count,
         i.item_name, coalesce(i.item_name, r.receipt_item) AS shown, coalesce(g.item_name, r.group_item) AS group_shown
  FROM prov_header h JOIN receipt_roll r ON r.receipt_no = h.receipt_no
  LEFT JOIN item i ON trim(i.item_code) = trim(r.receipt_item)
  LEFT JOIN item g ON trim(g.item_code) = trim(r.group_item)
  LEFT JOIN po_roll p ON p.po_no = r.po_no),
detail AS (
  SELECT h.receipt_no, h.due_date, l.line_seq, l.item_code, l.qty, l.status, i.item_name, i.unit, b.ordered_qty,
         b.outstanding_qty, b.po_line_key, a.open_provisional_qty
  FROM prov_header h LEFT JOIN prov_line l ON l.receipt_no = h.receipt_no
  LEFT JOIN bought i ON i.item_code = l.item_code
  LEFT JOIN balance b ON b.po_line_key = l.po_line_key
  LEFT JOIN announced a ON a.po_line_key = l.po_line_key AND a.item_code = l.item_code),
sheet_line AS (
  SELECT d.*, row_number() OVER (PARTITION BY receipt_no ORDER BY line_seq) AS line_no FROM detail d),
worksheet AS (
  SELECT po_no, item_group, item_code, part_no, item_name, '199707' AS month, coalesce(ordered_qty, 0) AS ordered_qty,
         coalesce(received_qty, 0) AS received_qty, coalesce(ordered_qty, 0) - coalesce(received_qty, 0) AS needed_qty,
         '10' AS delivery_qty, coalesce(provisional_qty, 0) AS provisional_qty, coalesce(unit, 'EA') AS unit, po_line_key
  FROM line_status),
submitted AS (
  SELECT w.po_no AS request_id, CAST(row_number() OVER (PARTITION BY w.po_no ORDER BY po_line_key) AS INTEGER) AS seq,
         '' AS receipt_no, strftime(po_date, '%Y%m%d') AS due_date, supplier_code,
         'D' || CAST(supplier_code AS VARCHAR) AS contact_name, '' AS contact_phone, 'E010' AS store_code, '' AS memo,
         w.po_no, 'N' AS status, item_code, po_line_key, needed_qty AS qty, month
  FROM worksheet w JOIN po_header h ON h.po_no = w.po_no
  WHERE needed_qty > 0 AND item_code IS NOT NULL),
asked AS (
  SELECT request_id, due_date, substr(due_date, 3) AS day, supplier_code, contact_name, count(*) AS inserted_count
  FROM submitted GROUP BY ALL),
in_use AS (
  SELECT substr(receipt_no, 2, 6) AS day, max(TRY_CAST(substr(receipt_no, 8) AS BIGINT)) AS last_number
  FROM prov_header GROUP BY 1),
numbered AS (
  SELECT a.*, 'G' || a.day || lpad(CAST(coalesce(last_number, 0)
           + row_number() OVER (PARTITION BY a.day ORDER BY request_id) AS VARCHAR), 4, '0') AS receipt_no
  FROM asked a LEFT JOIN in_use u ON u.day = a.day),
receipt_status AS (
  SELECT receipt_no, CASE WHEN bool_or(status = 'N') THEN 'N' ELSE 'Y' END AS status FROM prov_line GROUP BY receipt_no),
edited_item AS (
  SELECT receipt_no, arg_min(item_code, line_seq) AS item_code, arg_min(qty, line_seq) AS qty FROM prov_line GROUP BY receipt_no),
deleted AS (
  SELECT receipt_no FROM receipt_status WHERE status = 'Y'
  UNION ALL SELECT DISTINCT 'X' || CAST(supplier_code AS VARCHAR) FROM po_header)
"""


def _sql(body: str) -> str:
    return f"WITH {_TABLES.strip()},\n{_VIEWS.strip()}\n{body.strip()}"


def _summary(shown: str = "shown", separator: str = " 외 ") -> str:
    return (
        f"CASE WHEN line_count > 1 THEN {shown} || '{separator}' || CAST(line_count - 1 AS VARCHAR) || '건' "
        f"ELSE {shown} END AS item_summary"
    )


def _item_search(condition: str) -> str:
    return f"""
SELECT item_code, part_no, item_name, item_group, item_type, t.name AS item_type_name, unit_code
FROM item LEFT JOIN type_name t ON t.code = item_type
WHERE item_type LIKE '2%' AND {condition}"""


def _picker(condition: str, separator: str = "     외 ") -> str:
    return f"""
SELECT h.po_no, {_summary(separator=separator)}, po_date
FROM po_header h LEFT JOIN po_named n ON n.po_no = h.po_no WHERE {condition}"""


_RED_ORDER = """(contains(h.po_no, 'red') OR h.po_no IN (
  SELECT l.po_no FROM po_line l LEFT JOIN item i ON trim(i.item_code) = trim(l.item_code)
  WHERE contains(i.item_name, 'red') OR contains(l.item_code, 'red')))"""
_SPAN = "BETWEEN DATE '1996-12-20' AND DATE '1997-12-28'"
_YEAR = "BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
_LINE_STATUS = """po_no, po_date, item_code, status, part_no, item_name, item_group, ordered_qty, received_qty,
  outstanding_qty, provisional_qty, unit"""


def _history(condition: str, shown: str = "shown") -> str:
    return f"""
SELECT receipt_no, due_date, po_no, saved_on, last_update, {_summary(shown)}, status, po_status
FROM history WHERE {condition}"""


def _po_history(condition: str) -> str:
    return f"""
SELECT h.po_no, po_date, delivery_date, {_summary()}, status
FROM po_header h JOIN po_named n ON n.po_no = h.po_no WHERE {condition}"""


_BODIES = {
    "code_by_group": "SELECT code, name FROM unit_name",
    "item_search": _item_search(
        "(contains(item_code, 'red') OR contains(part_no, 'red') OR contains(item_name, 'red'))"
    ),
    "item_search_indexed": _item_search(
        "(contains(item_code, 'red') OR contains(part_no, 'red') OR contains(item_name, 'red'))"
    ),
    "item_search_indexed_short": _item_search(
        "(contains(item_code, 're') OR contains(part_no, 're') OR contains(item_name, 're'))"
    ),
    "item_search_all": _item_search("item_code IS NOT NULL"),
    "item_search_type": _item_search(
        "item_type = '21' AND (item_code LIKE '%r%d%' OR part_no LIKE '%r%d%' OR item_name LIKE '%r%d%')"
    ),
    "item_by_code": """
SELECT c.code, item_code, part_no, item_name, item_type, item_group
FROM (SELECT trim(item_code) AS code FROM po_line UNION SELECT trim(part_no) FROM item) c
JOIN item i ON i.item_code = c.code OR i.part_no = c.code""",
    "item_type_list": "SELECT code, name FROM type_name WHERE code LIKE '2%'",
    "po_picker": _picker(_RED_ORDER),
    "po_picker_all": _picker("true"),
    "po_picker_year": _picker(f"po_date {_YEAR} AND {_RED_ORDER}", " 외 "),
    "po_line_status": f"SELECT {_LINE_STATUS}, po_line_key FROM line_status",
    "po_line_status_raw": f"""
SELECT {_LINE_STATUS}, s.po_line_key
FROM line_status s LEFT JOIN (SELECT po_line_key AS received_key, actual_no FROM receipt_line) r ON received_key = own_key
LEFT JOIN receipt_header h ON h.actual_no = r.actual_no""",
    "po_line_status_supplier": f"SELECT {_LINE_STATUS}, po_line_key FROM line_status WHERE supplier_code = 7",
    "receipt_history": _history("true"),
    "receipt_history_by_month": f"SELECT *, coalesce(strftime(due_date, '%Y%m'), 'none') AS month FROM ({_history('true')})",
    "receipt_history_range": _history(f"due_date {_SPAN}"),
    "receipt_history_open": _history("status = 'N'"),
    "receipt_history_search": _history(
        "(contains(receipt_no, 'red') OR contains(po_no, 'red') OR contains(item_name, 'red'))"
    ),
    "receipt_history_year": _history(f"due_date {_YEAR}", "group_shown"),
    "receipt_history_supplier": _history("supplier_code = 7"),
    "receipt_detail": "SELECT * FROM detail",
    "receipt_detail_open": "SELECT * FROM detail WHERE status = 'N'",
    "receipt_detail_batch": """
SELECT * FROM detail WHERE receipt_no IN (SELECT receipt_no FROM receipt_status WHERE status = 'N')""",
    "receipt_detail_closed": """
SELECT * FROM detail WHERE receipt_no IN (SELECT receipt_no FROM receipt_status WHERE status = 'Y')""",
    "po_history": _po_history("true"),
    "po_history_closed": _po_history("status = 'Y'"),
    "po_history_search": _po_history(f"po_date {_YEAR} AND (contains(h.po_no, 'red') OR contains(item_name, 'red'))"),
    "first_item_per_po": "SELECT po_no, first_item_code, line_count FROM po_roll",
    "item_summary": f"SELECT po_no, {_summary()} FROM po_named",
    "po_status_rollup": "SELECT po_no, status FROM po_roll",
    "ordered_qty": "SELECT * FROM ordered",
    "received_qty": "SELECT * FROM received",
    "po_line_balance": "SELECT * FROM balance",
    "cumulative_provisional": "SELECT * FROM announced",
    "item_with_unit": "SELECT * FROM bought",
    "trim_join_items": """
SELECT po_no, line_seq, l.item_code, i.item_name
FROM po_line l LEFT JOIN item i ON trim(i.item_code) = trim(l.item_code)""",
    "receiving_worksheet": "SELECT * FROM worksheet",
    "worksheet_add_items": """
SELECT * FROM worksheet UNION ALL
SELECT po_no, item_group, item_code, part_no, i.item_name, '199707', 0, 0, 0, '10', 0, unit_code, NULL
FROM po_roll JOIN item i ON i.item_code = trim(first_item_code) WHERE item_type LIKE '2%'""",
    "worksheet_remove_items": """
SELECT w.* FROM worksheet w LEFT JOIN po_roll r ON r.po_no = w.po_no
WHERE w.item_code IS NULL OR w.item_code <> trim(r.first_item_code)""",
    "submit_lines": "SELECT * FROM submitted",
    "month_options": """
SELECT po_date AS as_of, strftime(day, '%Y%m') AS month, strftime(day, '%Y-%m') AS label
FROM (SELECT po_date, date_trunc('month', po_date) + to_months(CAST(i AS INTEGER)) AS day
      FROM (SELECT DISTINCT po_date FROM po_header), range(-5, 6) r(i))""",
    "status_label": """
SELECT h.po_no, status,
       CASE WHEN status = 'N' THEN '진행중' ELSE '종결' END AS label_closed,
       CASE WHEN status = 'Y' THEN '종결' ELSE '진행중' END AS label_open,
       CASE status WHEN 'Y' THEN '종결' WHEN 'N' THEN '진행중' ELSE '-' END AS label_value
FROM po_header h LEFT JOIN po_roll r ON r.po_no = h.po_no""",
    "bulk_status_change": """
SELECT CAST(line_seq AS BIGINT) AS seq, receipt_no, item_code, qty, CASE WHEN updated_on IS NULL THEN 'Y' ELSE status END AS status
FROM prov_line""",
    "grid_filter_sort": f"""
SELECT * FROM ({_po_history("true")})
WHERE contains(lower(item_summary), 'blue') AND contains(lower(status), 'n')""",
    "delivery_sheet": """
SELECT receipt_no, line_no, coalesce(item_code, '-') AS item_code, coalesce(item_name, '-') AS item_name,
       coalesce(qty, 0) AS qty, format('{:,}', CAST(coalesce(qty, 0) AS BIGINT)) AS qty_text, coalesce(unit, 'EA') AS unit
FROM sheet_line UNION ALL
SELECT receipt_no, i, NULL, NULL, NULL, NULL, NULL
FROM (SELECT receipt_no, max(line_no) AS n FROM sheet_line GROUP BY receipt_no), range(1, 16) r(i) WHERE i > n""",
    "delivery_sheet_nested": """
SELECT *, sum(part_qty) OVER w AS total_qty, max(part) OVER w AS part_count,
  format('{:,}', CAST(sum(part_qty) OVER w AS BIGINT)) AS total_text
FROM (
  SELECT receipt_no, CAST((line_no - 1) // 1000 + 1 AS BIGINT) AS part, sum(qty) AS part_qty,
    string_agg(concat_ws('|', line_no, coalesce(item_code, ''), CAST(qty AS BIGINT)), ';' ORDER BY line_no) AS lines
  FROM (
    SELECT receipt_no, line_no, coalesce(item_code, '-') AS item_code, coalesce(qty, 0) AS qty FROM sheet_line UNION ALL
    SELECT receipt_no, i, NULL, NULL
    FROM (SELECT receipt_no, max(line_no) AS n FROM sheet_line GROUP BY receipt_no), range(1, 16) r(i) WHERE i > n)
  GROUP BY ALL)
WINDOW w AS (PARTITION BY receipt_no)""",
    "register_rejected": """
SELECT po_no AS request_id, ['unreadable document', 'no custCode', 'no items', 'empty items', 'item without itemCode',
  'item without gaipQnty', 'quantity is no number', 'ipgoDate is no date', 'no userName', NULL, NULL,
  'item without itemCode', 'unreadable document'][CAST(substr(po_no, 2) AS BIGINT) % 13 + 1]
  AS reason
FROM po_header WHERE CAST(substr(po_no, 2) AS BIGINT) % 13 NOT IN (9, 10)""",
    "register_accepted": """
SELECT po_no AS request_id, 1 AS seq, '19970715' AS due_date, 'P1' AS item_code, CAST(5 AS DOUBLE) AS qty
FROM po_header WHERE CAST(substr(po_no, 2) AS BIGINT) % 13 IN (9, 10)""",
    "request_outcomes": """
SELECT po_no AS request_id, NULL AS receipt_no, CAST(0 AS BIGINT) AS inserted_count,
  ['unreadable document', 'no custCode', 'no items', 'empty items', 'item without itemCode',
  'item without gaipQnty', 'quantity is no number', 'ipgoDate is no date', 'no userName', NULL, NULL,
  'item without itemCode', 'unreadable document'][CAST(substr(po_no, 2) AS BIGINT) % 13 + 1] AS reason
FROM po_header WHERE CAST(substr(po_no, 2) AS BIGINT) % 13 NOT IN (9, 10)
UNION ALL
SELECT po_no, 'G970715' || format('{:04d}', row_number() OVER (ORDER BY po_no) + coalesce((
  SELECT max(CAST(substr(receipt_no, 8) AS BIGINT)) FROM prov_header WHERE receipt_no LIKE 'G970715%'), 0)), 1, NULL
FROM po_header WHERE CAST(substr(po_no, 2) AS BIGINT) % 13 IN (9, 10)""",
    "rejected_edits": """
SELECT receipt_no AS request_id, CASE kind WHEN 9 THEN ' ' ELSE receipt_no END AS receipt_no, reason
FROM (SELECT receipt_no, CAST(substr(receipt_no, 2) AS BIGINT) % 11 AS kind,
  ['unreadable document', 'no items', 'item without itemCode', 'item without itemCode', 'item without gaipQnty',
   'quantity is no number', 'item without statType', 'item without itemCode', 'item without gaipQnty',
   'no receipt number', NULL][CAST(substr(receipt_no, 2) AS BIGINT) % 11 + 1] AS reason FROM edited_item)
WHERE reason IS NOT NULL""",
    "edit_outcomes": """
SELECT receipt_no AS request_id, CASE kind WHEN 9 THEN ' ' ELSE receipt_no END AS receipt_no,
  CASE WHEN reason IS NULL THEN lines ELSE 0 END AS updated_count, reason
FROM (SELECT e.receipt_no, CAST(substr(e.receipt_no, 2) AS BIGINT) % 11 AS kind, count(l.receipt_no) AS lines,
  ['unreadable document', 'no items', 'item without itemCode', 'item without itemCode', 'item without gaipQnty',
   'quantity is no number', 'item without statType', 'item without itemCode', 'item without gaipQnty',
   'no receipt number', NULL][CAST(substr(e.receipt_no, 2) AS BIGINT) % 11 + 1] AS reason
  FROM edited_item e LEFT JOIN prov_line l ON e.receipt_no = l.receipt_no AND e.item_code = l.item_code GROUP BY e.receipt_no)""",
    "rejected_deletes": """
SELECT receipt_no AS request_id, ['unreadable document', 'no receipt numbers', 'empty receipt numbers', 'blank receipt number',
  'blank receipt number'][CAST(substr(receipt_no, 2) AS BIGINT) % 7 + 1] AS reason
FROM prov_header WHERE CAST(substr(receipt_no, 2) AS BIGINT) % 7 < 5""",
    "explode_edits": """
SELECT receipt_no || '/' || line_seq AS request_id, CAST(i AS INTEGER) AS position, receipt_no, item_code, qty + i + 1 AS qty,
       CASE i WHEN 0 THEN 'N' ELSE 'Y' END AS status
FROM prov_line, range(2) r(i)""",
    "explode_deletes": """
SELECT receipt_no AS request_id, CAST(i AS INTEGER) AS position, CASE i WHEN 0 THEN '' ELSE 'X' END || receipt_no AS receipt_no
FROM prov_header, range(2) r(i)""",
    "delivery_sheet_with_totals": """
SELECT receipt_no, line_no, false AS is_total, coalesce(item_code, '-') AS item_code, coalesce(item_name, '-') AS item_name,
       coalesce(qty, 0) AS qty, format('{:,}', CAST(coalesce(qty, 0) AS BIGINT)) AS qty_text, coalesce(unit, 'EA') AS unit
FROM sheet_line UNION ALL
SELECT receipt_no, i, false, NULL, NULL, NULL, NULL, NULL
FROM (SELECT receipt_no, max(line_no) AS n FROM sheet_line GROUP BY receipt_no), range(1, 16) r(i) WHERE i > n UNION ALL
SELECT receipt_no, NULL, true, NULL, NULL, sum(coalesce(qty, 0)), format('{:,}', CAST(sum(coalesce(qty, 0)) AS BIGINT)), NULL
FROM sheet_line GROUP BY receipt_no""",
    "delivery_sheet_totals": """
SELECT receipt_no, sum(coalesce(qty, 0)) AS total_qty, format('{:,}', CAST(sum(coalesce(qty, 0)) AS BIGINT)) AS total_text
FROM sheet_line GROUP BY receipt_no""",
    "delivery_sheet_header": """
SELECT receipt_no, coalesce(po_no, '-') AS po_no, CAST(due_date AS VARCHAR) AS due_date, '1997년 7월 15일' AS printed_on
FROM history""",
    "explode_requests": """
SELECT po_no || '/' || CAST(part AS VARCHAR) AS request_id,
       CAST(row_number() OVER (PARTITION BY po_no, part ORDER BY line_seq) AS INTEGER) AS seq, '' AS receipt_no,
       strftime(max(delivery_date) OVER (PARTITION BY po_no, part), '%Y%m%d') AS due_date,
       CAST(NULL AS VARCHAR) AS supplier_code, '' AS contact_name, '' AS contact_phone, 'E010' AS store_code,
       '' AS memo, po_no, 'N' AS status, item_code, po_no || line_seq AS po_line_key, qty,
       strftime(delivery_date, '%Y%m') AS month, '10.0.0.1' AS client_address
FROM (SELECT *, CAST(line_seq AS BIGINT) // 100 AS part FROM po_line)""",
    "register_receipts": """
SELECT n.receipt_no, lpad(CAST(s.seq AS VARCHAR), 4, '0') AS line_seq, s.po_line_key, s.item_code, s.qty, s.status,
       CAST(NULL AS DATE) AS updated_on
FROM submitted s JOIN numbered n ON n.request_id = s.request_id""",
    "register_receipts_headers": """
SELECT receipt_no, supplier_code, DATE '1997-07-15' AS saved_on,
       CAST(strptime(due_date, '%Y%m%d') AS DATE) AS due_date, contact_name, '' AS contact_phone
FROM numbered""",
    "register_receipts_summary": "SELECT request_id, receipt_no, inserted_count FROM numbered",
    "edit_receipt_lines": """
SELECT l.receipt_no, line_seq, po_line_key, l.item_code, coalesce(e.qty + 2, l.qty) AS qty,
       CASE WHEN e.receipt_no IS NULL THEN l.status ELSE 'Y' END AS status, updated_on
FROM prov_line l LEFT JOIN edited_item e ON e.receipt_no = l.receipt_no AND e.item_code = l.item_code""",
    "edit_match_count": """
SELECT e.receipt_no, CAST(2 * count(l.receipt_no) AS BIGINT) AS updated_count
FROM edited_item e LEFT JOIN prov_line l ON e.receipt_no = l.receipt_no AND e.item_code = l.item_code
GROUP BY e.receipt_no""",
    "delete_receipts": "SELECT * FROM prov_line WHERE receipt_no NOT IN (SELECT receipt_no FROM deleted)",
    "delete_receipts_counts": """
SELECT count(*) AS deleted_count, count(h.receipt_no) AS found_count
FROM deleted d LEFT JOIN prov_header h ON h.receipt_no = d.receipt_no""",
}

ORACLE: dict[str, str] = {name: _sql(body) for name, body in _BODIES.items()}
