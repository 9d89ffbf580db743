"""Check queries for the query shapes that compared queries use (w_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from querygauge.fixed_values import FIXED_NOW
from querygauge.operators import shapes as S
from querygauge.plans.registry import Tables, query


@query("w_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 0")
def _(t):
    return t.customer.filter("c_acctbal > 0").select("c_mktsegment", "c_nationkey").distinct()


@query(
    "w_left_join",
    "SELECT c_custkey, o_orderkey, n_name, r_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
)
def _(t):
    df = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    df = df.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return df.select("c_custkey", "o_orderkey", "n_name", "r_name")


@query("w_inner_join", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name, o.o_orderstatus FROM lineitem AS l JOIN part AS p ON p.p_partkey = l.l_partkey JOIN orders AS o ON o.o_orderkey = l.l_orderkey")
def _(t):
    l, p, o = t.lineitem.alias("l"), t.part.alias("p"), t.orders.alias("o")
    df = l.join(p, F.col("p.p_partkey") == F.col("l.l_partkey")).join(o, F.col("o.o_orderkey") == F.col("l.l_orderkey"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "o_orderstatus")


@query("w_predicates", "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 WHERE (o_orderstatus = 'O' OR o_totalprice > 200000) AND NOT o_orderpriority = '5-LOW' AND c_custkey IS NULL")
def _(t):
    rich = t.customer.filter("c_acctbal > 0")
    df = t.orders.filter(((F.col("o_orderstatus") == "O") | (F.col("o_totalprice") > 200000)) & ~(F.col("o_orderpriority") == "5-LOW"))
    return df.join(rich, F.col("c_custkey") == F.col("o_custkey"), "left").filter(F.col("c_custkey").isNull()).select("o_orderkey")


@query(
    "w_semi_anti",
    """SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
)
def _(t):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    large = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    df = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return df.join(done, "c_custkey", "left_semi").join(large, "c_custkey", "left_anti").select("c_custkey")


@query("w_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS dear FROM part")
def _(t):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return t.part.select("p_partkey", size.alias("class"), F.expr("if(p_retailprice > 1000, 1, 0)").alias("dear"))


@query("w_between_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name ILIKE 'SMALL %'")
def _(t):
    return t.part.filter(F.col("p_size").between(5, 20) & F.col("p_name").ilike("SMALL %")).select("p_partkey", "p_name")


@query(
    "w_group_having",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_tax) AS least, max(l_tax) AS most
      FROM lineitem GROUP BY ALL HAVING count(*) > 100""",
)
def _(t):
    g = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"),
        F.min("l_tax").alias("least"), F.max("l_tax").alias("most"),
    )
    return g.filter("n > 100")


@query("w_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query(
    "w_set_ops",
    """SELECT 'union' AS op, k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer)
      UNION ALL SELECT 'all', k FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT l_suppkey FROM lineitem)
      UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""",
)
def _(t):
    key = lambda df, c: df.select(F.col(c).alias("k"))
    bought, known = key(t.orders, "o_custkey"), key(t.customer, "c_custkey")
    parts = {"union": bought.union(known).distinct(), "all": key(t.supplier, "s_suppkey").unionAll(key(t.lineitem, "l_suppkey")), "except": known.subtract(bought)}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("op"), "k")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "w_window",
    "SELECT o_orderkey, row_number() OVER w AS nth, round(sum(o_totalprice) OVER w, 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)",
)
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint")
    return t.orders.select("o_orderkey", nth.alias("nth"), F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query(
    "w_scalars",
    """SELECT c_custkey, round(c_acctbal, 1) AS r, abs(c_acctbal) AS a, CAST(length(c_name) AS INT) AS n, try_cast(c_name AS INT) AS bad, try_cast(substr(c_name, 10) AS BIGINT) AS good,
      substr(c_name, 1, 4) AS head, CAST(strpos(c_name, '#') AS INT) AS mark FROM customer""",
)
def _(t):
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", F.round("c_acctbal", 1).alias("r"), F.abs("c_acctbal").alias("a"), F.length(name).alias("n"), name.try_cast("int").alias("bad"),
        F.substring(name, F.lit(10), F.length(name)).try_cast("bigint").alias("good"), F.substring(name, 1, 4).alias("head"), F.instr(name, "#").alias("mark"),
    )


@query(
    "w_dates",
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m-%d') AS day, round(epoch(o_orderdate) / 86400.0 + 2440587.5, 3) AS julian,
      CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{FIXED_NOW[:10]}') AS INT) AS age FROM orders""",
)
def _(t):
    at = F.col("o_orderdate")
    julian = F.unix_timestamp(at.cast("timestamp")) / 86400.0 + 2440587.5
    return t.orders.select(
        "o_orderkey", F.date_format(at, "yyyy").alias("year"), F.date_format(at, "MM-dd").alias("day"), F.round(julian, 3).alias("julian"),
        F.datediff(F.lit(FIXED_NOW).cast("date"), at.cast("date")).alias("age"),
    )


# --- property graph -----------------------------------------------------------------------------


def graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers, orders, nations and regions as nodes; their keys as edges."""
    node = lambda df, kind, key, **props: df.select(
        F.concat(F.lit(kind[0] + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("label"),
        F.create_map(*[x for n, c in props.items() for x in (F.lit(n), F.col(c).cast("string"))]).alias("props"),
    )
    edge = lambda df, a, ka, kind, b, kb: df.select(
        F.concat(F.lit(a[0] + ":"), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b[0] + ":"), F.col(kb).cast("string")).alias("dst"), F.lit(kind).alias("type")
    )
    nodes = node(t.customer, "Customer", "c_custkey", name="c_name", segment="c_mktsegment")
    nodes = nodes.unionByName(node(t.orders, "Order", "o_orderkey", status="o_orderstatus", priority="o_orderpriority"))
    nodes = nodes.unionByName(node(t.nation, "Nation", "n_nationkey", name="n_name")).unionByName(node(t.region, "Region", "r_regionkey", name="r_name"))
    edges = edge(t.orders, "Customer", "o_custkey", "PLACED", "Order", "o_orderkey")
    edges = edges.unionByName(edge(t.customer, "Customer", "c_custkey", "IN", "Nation", "c_nationkey")).unionByName(edge(t.nation, "Nation", "n_nationkey", "PART_OF", "Region", "n_regionkey"))
    return nodes, edges


@query("w_node_lookup", "SELECT 'C:' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return S.node_lookup(graph(t)[0], "Customer", {"segment": "BUILDING"}).select("id", F.col("props")["name"].alias("name"))


@query("w_one_hop", "SELECT DISTINCT c_name AS name, o_orderpriority AS priority FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def _(t):
    hops = S.one_hop(*graph(t), "Customer", "PLACED", "Order", dst_props={"status": "P"})
    return hops.select(F.col("src_props")["name"].alias("name"), F.col("dst_props")["priority"].alias("priority")).distinct()


@query(
    "w_graph_agg",
    """SELECT n_name AS nation, count(*) AS customers, min(c_name) AS first, max(c_name) AS last FROM customer JOIN nation ON n_nationkey = c_nationkey
      GROUP BY n_name HAVING count(*) >= 2 ORDER BY customers DESC, nation OFFSET 2 LIMIT 10""",
)
def _(t):
    hops = S.one_hop(*graph(t), "Customer", "IN", "Nation")
    name = F.col("src_props")["name"]
    grouped = hops.groupBy(F.col("dst_props")["name"].alias("nation")).agg(F.count("*").alias("customers"), F.min(name).alias("first"), F.max(name).alias("last"))
    return S.page(grouped.filter("customers >= 2"), [F.desc("customers"), F.col("nation")], 2, 10)


# --- documents ----------------------------------------------------------------------------------


def text_docs(t: Tables) -> DataFrame:
    """One document per text: paragraphs with their sentences inside, built within the row."""
    paras = F.transform(
        F.split("text", "\n"),
        lambda p, i: F.struct(i.alias("no"), F.transform(F.split(p, r"\. "), lambda s: F.struct(s.alias("text"), F.length(s).alias("size"))).alias("sentences")),
    )
    return t.documents.select("doc_id", "lang", "source", paras.alias("paras"))


_UNWOUND = """SELECT doc_id, lang, no, sentence FROM (
  SELECT doc_id, lang, no, unnest(string_split(para, '. ')) AS sentence FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents))"""


@query("w_doc_match", f"SELECT DISTINCT doc_id FROM ({_UNWOUND}) WHERE no > 0 AND length(sentence) > 120")
def _(t):
    test = lambda p: (p["no"] > 0) & F.exists(p["sentences"], lambda s: s["size"] > 120)
    return S.doc_match(text_docs(t), "paras", test).select("doc_id")


@query("w_doc_unwind", f"SELECT doc_id, CAST(no AS INT) AS no, sentence FROM ({_UNWOUND})")
def _(t):
    rows = S.doc_unwind(S.doc_unwind(text_docs(t), "paras", "p"), "p.sentences", "s")
    return rows.select("doc_id", F.col("p.no").alias("no"), F.col("s.text").alias("sentence"))


@query("w_doc_group", f"SELECT lang, count(*) AS sentences, CAST(sum(length(sentence)) AS BIGINT) AS chars, CAST(max(no) AS INT) AS last FROM ({_UNWOUND}) GROUP BY lang")
def _(t):
    rows = S.doc_unwind(S.doc_unwind(text_docs(t), "paras", "p"), "p.sentences", "s")
    return rows.groupBy("lang").agg(F.count("*").alias("sentences"), F.sum("s.size").alias("chars"), F.max("p.no").alias("last"))


@query(
    "w_doc_lookup",
    """SELECT c_custkey, CAST(0 AS BIGINT) AS block, coalesce(n, 0) AS n, coalesce(ids, '') AS ids FROM customer LEFT JOIN
      (SELECT o_custkey, CAST(count(*) AS INT) AS n, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(t):
    orders = t.orders.select("o_custkey", F.concat(F.col("o_orderkey").cast("string"), "o_orderstatus").alias("id"), "o_orderkey")
    found = S.doc_lookup(t.customer, orders, "c_custkey", "o_custkey", "orders")
    ids = F.transform(F.array_sort(F.transform("orders", lambda o: F.struct(o["o_orderkey"], o["id"].alias("id")))), lambda o: o["id"])
    return found.select("c_custkey", "block", F.size("orders").alias("n"), F.array_join(ids, ",").alias("ids"))
