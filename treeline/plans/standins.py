"""Stand-in inputs over the test tables, as SQL that Spark and DuckDB both read: tables in braces."""

TOC = """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS seq, CAST(l_linenumber AS STRING) AS structure,
    concat('Section ', min(l_returnflag), min(l_linestatus)) AS title, CAST(min(l_partkey) % 40 + 1 AS INT) AS page,
    CASE WHEN min(l_suppkey) % 4 = 0 THEN NULL ELSE CAST(min(l_partkey) % 40 + 1 + l_orderkey % 5 AS INT) END AS physical_index,
    CASE WHEN min(l_quantity) > 25 THEN 'yes' ELSE 'no' END AS appear_start
    FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

NODES = """SELECT source AS doc_id, CAST(doc_id AS INT) AS node_seq, lpad(CAST(doc_id AS STRING), 6, '0') AS node_id,
    substring(text, 1, 40) AS title, lang AS breadcrumb, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE substring(text, 1, 80) END AS summary,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text FROM {documents}"""

PAGES = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_no, text AS page_text,
    CAST(floor((length(text) + 3) / 4) AS BIGINT) AS n_tokens FROM {conversations}"""

LEVELS = """SELECT n_regionkey AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, level, k) - 1 AS INT) AS seq,
    CAST(level AS INT) AS level, title, text FROM (
    SELECT n_regionkey, n_nationkey, 1 AS level, CAST(-1 AS BIGINT) AS k, n_name AS title, concat('nation ', n_name) AS text FROM {nation}
    UNION ALL SELECT n_regionkey, n_nationkey, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 2 END, c_custkey, c_name, c_mktsegment
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) x"""

DOCS = """SELECT source AS doc_id, source AS doc_name, CASE WHEN count(*) % 2 = 0 THEN 'pdf' ELSE 'md' END AS doc_type,
    CAST(max(n_chars) AS INT) AS size, concat('about ', min(lang)) AS doc_description FROM {documents} GROUP BY source"""

QUESTIONS = "SELECT item_id AS id, text AS question FROM {benchmark}"

BEFORE = "SELECT url AS path, CAST(length(html) AS BIGINT) AS size, CAST(page_id % 3 AS BIGINT) AS mtime, page_id AS doc_id FROM {pages} WHERE page_id % 5 <> 0"
NOW = "SELECT url AS path, CAST(length(html) AS BIGINT) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS size, CAST(page_id % 3 AS BIGINT) AS mtime, page_id AS doc_id, page_id % 14 <> 0 AS ok FROM {pages} WHERE page_id % 4 <> 0"

ITEMS = """SELECT conv_id, CAST(turn AS INT) AS seq, CASE WHEN turn % 2 = 0 THEN 'function_call' ELSE 'function_call_output' END AS type,
    concat('c', CAST(turn - turn % 2 AS STRING)) AS call_id,
    CASE WHEN turn % 2 = 0 THEN CASE WHEN turn % 4 = 0 THEN 'get_document_structure' ELSE 'get_node_content' END END AS name,
    CASE WHEN turn % 2 = 1 THEN text END AS output FROM {conversations}"""

GOLD = """SELECT b.item_id AS id, d.doc_id AS node FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)"""
