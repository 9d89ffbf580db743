"""Inputs for the check queries, derived from the given tables.

Each fixture is a query text that Spark and the checking engine read alike, so both sides start from the
same rows.  Every fixture covers whole tables and whole texts.
"""

# each document beside the next one
TEXT_PAIRS = """
SELECT a.doc_id AS pair_id, a.lang AS lang, a.text AS gold, b.text AS pred
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
"""

# F1, short texts: each part name and type beside those of the next part
NAME_PAIRS = """
SELECT a.p_partkey AS pair_id, a.p_name || ' ' || a.p_type || ' ' || a.p_brand AS gold,
       b.p_name || ' ' || b.p_type || ' ' || a.p_brand || ' ' || b.p_name AS pred
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
"""

# every turn as a response, the turn before it as reasoning; fences in seven variants
RESPONSES = """
SELECT conv_id, turn, variant, body, prev,
  CASE variant
    WHEN 0 THEN '<think> ' || prev || ' </think>' || body
    WHEN 1 THEN '<think> ' || prev || ' </think>```sql ' || body || ' ```'
    WHEN 2 THEN '```sql ' || prev || ' ``` or rather ```sql ' || body || ' ``` Final Answer: ' || body
    WHEN 3 THEN '```sql ' || body
    WHEN 4 THEN '<think> ' || prev || ' </think>```cypher ' || body || ' ```'
    WHEN 5 THEN '<thinking>' || prev || '</thinking>```SQL ' || body || ' ```'
    ELSE '```mongodb ' || body || ' ``` Final Answer: yes, Final Answer: ' || body
  END AS response,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'Cypher' WHEN 2 THEN 'MQL' ELSE 'XQuery' END AS language
FROM (
  SELECT c.conv_id AS conv_id, c.turn AS turn, c.text AS body, coalesce(p.text, '') AS prev, (c.conv_id * 5 + c.turn) % 7 AS variant
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
) t
"""

# short answers with changed case, marks, number forms
ANSWERS = """
SELECT pair_id, gold, question,
  CASE pair_id % 9
    WHEN 0 THEN gold
    WHEN 1 THEN upper(gold) || '!'
    WHEN 2 THEN '<think> ' || gold || ' </think> ' || gold || '.'
    WHEN 3 THEN '<think> hm </think>Unanswerable'
    WHEN 4 THEN 'Final Answer: ' || gold
    WHEN 5 THEN '0' || gold
    WHEN 6 THEN gold || ' or ' || status
    WHEN 7 THEN 'Final Answer: y e s'
    ELSE 'Final Answer: No'
  END AS response
FROM (
  SELECT o_orderkey AS pair_id, o_orderstatus AS status, 'Question ' || CAST(o_orderkey AS STRING) || ': ' || o_orderpriority || '?' AS question,
    CASE o_orderkey % 6
      WHEN 0 THEN CAST(o_custkey AS STRING)
      WHEN 1 THEN o_orderpriority
      WHEN 2 THEN CAST(o_custkey AS STRING) || '.5'
      WHEN 3 THEN 'True'
      WHEN 4 THEN CAST(o_orderkey % 10 AS STRING) || 'e' || CAST(o_custkey % 4 AS STRING)
      ELSE 'Unanswerable'
    END AS gold
  FROM orders
) t
"""

# one SQL text per order; the prediction keeps, restyles, changes, cuts or replaces it
SQL_PAIRS = """
SELECT pair_id, 'sql' AS query_type, gold,
  CASE pair_id % 7
    WHEN 0 THEN gold
    WHEN 1 THEN lower(gold)
    WHEN 2 THEN replace(gold, 'o_totalprice', 'o_orderkey')
    WHEN 3 THEN replace(replace(gold, ' DESC', ''), ' AND ', ' OR ') || ' LIMIT 3'
    WHEN 4 THEN 'SELECT o_orderkey FROM orders'
    WHEN 5 THEN replace(gold, ' WHERE ', ' WHERE NOT ')
    ELSE ''
  END AS pred
FROM (
  SELECT o_orderkey AS pair_id,
    CASE o_orderkey % 8
      WHEN 0 THEN 'SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ' || c || ' AND o_orderstatus = ''' || o_orderstatus || ''' ORDER BY o_totalprice DESC LIMIT 5'
      WHEN 1 THEN 'SELECT COUNT(*) , MAX(o_totalprice) FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_custkey = ' || c
      WHEN 2 THEN 'SELECT o_orderpriority, COUNT(*) FROM orders WHERE o_custkey BETWEEN 1 AND ' || c || ' GROUP BY o_orderpriority HAVING COUNT(*) > 3'
      WHEN 3 THEN 'SELECT CASE WHEN o_totalprice > ' || c || ' THEN 1 ELSE 0 END FROM orders WHERE o_orderstatus IS NOT NULL'
      WHEN 4 THEN 'SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = ' || k || ')' || chr(10) || ' -- from nowhere' || chr(10) || 'LIMIT 3 ;'
      WHEN 5 THEN 'SELECT c_name FROM customer UNION ALL SELECT s_name FROM "supplier" EXCEPT SELECT ROUND(c_acctbal, 2) FROM customer WHERE EXISTS(SELECT 1)'
      WHEN 6 THEN 'SELECT(o_custkey) FROM orders WHERE(o_orderkey = ' || k || ' OR o_orderkey < ' || c || ') ORDER BY o_custkey ASC'
      ELSE 'SELECT ROUND(AVG(o_totalprice), 2) AS a, STRFTIME(''%Y'', ''now'') FROM orders LEFT JOIN customer ON ABS(o_custkey) = c_custkey AND c_name LIKE ''%' || c || ''' GROUP BY o_orderstatus'
    END AS gold
  FROM (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS STRING) AS c, CAST(o_orderkey AS STRING) AS k FROM orders) o
) t
"""

# one Cypher text per order
CYPHER_PAIRS = """
SELECT pair_id, 'cypher' AS query_type, gold,
  CASE pair_id % 7
    WHEN 0 THEN gold
    WHEN 1 THEN replace(gold, ':PLACED', ':MADE')
    WHEN 2 THEN replace(gold, '(c:Customer)', '(k:Client)')
    WHEN 3 THEN replace(replace(gold, '->', '-'), ' AND ', ' OR ')
    WHEN 4 THEN 'MATCH (o:Order) RETURN o.total'
    WHEN 5 THEN replace(gold, ':Nation', ':Country') || ' LIMIT 3'
    ELSE ''
  END AS pred
FROM (
  SELECT o_orderkey AS pair_id,
    CASE o_orderkey % 6
      WHEN 0 THEN 'MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.id = ' || c || ' AND o.status = ''' || o_orderstatus || ''' RETURN o.total ORDER BY o.total LIMIT 5'
      WHEN 1 THEN 'MATCH (c:Customer {id: ' || c || '})-[:PLACED]->(o:Order)-[p:HAS]->(l:Item)<-[:SUPPLIES]-(s:S' || o_orderstatus || ') RETURN s.name'
      WHEN 2 THEN 'MATCH (c:Customer)-[:IN]-(n:Nation)-[:PART_OF]->(r:Region) WHERE NOT r.name = ''ASIA'' OR c.id = ' || c || ' RETURN COUNT(c)'
      WHEN 3 THEN 'MATCH (a:Order)-[:P' || p || ']->(b:Customer) , (b)-[:PLACED]->(a) WHERE a.id = ' || k || ' RETURN a'
      WHEN 4 THEN 'MATCH (a)-[]->(:Nation)<-[:IN]-(c:Customer)-[:PLACED]->(o) WHERE o.total > ' || c || ' RETURN a SKIP 2'
      ELSE 'MATCH (c:Customer) WHERE c.id = ' || c || ' RETURN c'
    END AS gold
  FROM (SELECT o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS p, CAST(o_custkey AS STRING) AS c, CAST(o_orderkey AS STRING) AS k FROM orders) o
) t
"""

# F8: verdicts, one prompt per document source, answers numbered inside it
VERDICTS = """
SELECT prompt_key, idx, grade FROM (
  SELECT 'prompt ' || CAST(l.doc_id % 50 AS STRING) AS prompt_key, CAST((l.doc_id - l.doc_id % 50) / 50 AS INT) AS idx,
    CASE WHEN l.doc_id % 97 = 3 THEN 'Average' WHEN l.quality = 1 AND l.toxic = 0 THEN 'Excellent' WHEN l.quality = 1 THEN 'Above average'
         WHEN l.toxic = 1 THEN 'Very bad' WHEN l.doc_id % 3 = 0 THEN 'Good' ELSE 'Bad' END AS grade
  FROM labels l
) t
"""

# every document is an answer to its prompt
PROMPT_ANSWERS = """
SELECT 'prompt ' || CAST(doc_id % 50 AS STRING) AS prompt_key, CAST((doc_id - doc_id % 50) / 50 AS INT) AS idx, source || ' ' || lang AS pred
FROM documents
"""

# events as a long score table
EVENT_SCORES = "SELECT event_id AS pair_id, event_type AS metric, value FROM events"

# documents as a question corpus, one class per language
CORPUS = """
SELECT doc_id AS example_id, text AS question, lang AS query_type, source AS db_id, n_chars FROM documents
"""
