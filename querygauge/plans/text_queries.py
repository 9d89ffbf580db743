"""Check queries for extraction (x_), text scores (m_), clauses (c_) and pattern graphs (g_)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querygauge.fixed_values import ANSWER_PUNCTUATION, FIXED_NOW, LANGUAGE_TAGS, VITAL_RANGES
from querygauge.functions import extract as X
from querygauge.functions.clauses import CYPHER_ALL, CYPHER_MAIN, LISTED, SQL_ALL, mask_variables
from querygauge.operators import clauses as C, graphs as G, matching, textscore as M
from querygauge.operators.placement import spread
from querygauge.plans import fixtures as fx
from querygauge.plans.registry import Tables, query, run_scorers

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- extraction ---------------------------------------------------------------------------------


def sql_block(text: str, tag: str, absent: str) -> str:
    fence = q("```" + tag)
    tail = f"string_split({text}, {fence})[-1]"
    return f"CASE WHEN contains({text}, {fence}) AND contains({tail}, '```') THEN trim(string_split({tail}, '```')[1], {BLANKS}) ELSE {absent} END"


def sql_upper(text: str) -> str:
    """Upper case with the two-letter form of the German sharp s, as in the JVM."""
    return f"upper(replace({text}, 'ß', 'SS'))"


def responses(t: Tables) -> DataFrame:
    return t.sql(fx.RESPONSES)


@query("x_last_fence_sql", f"SELECT conv_id, turn, {sql_block('response', 'sql', q(' '))} AS found FROM ({fx.RESPONSES})")
def _(t):
    return responses(t).select("conv_id", "turn", X.last_fence(F.col("response"), "sql", "sql").alias("found"))


@query(
    "x_last_fence_upper",
    f"SELECT conv_id, turn, {sql_upper(sql_block('lower(response)', 'cypher', q(' ')))} AS found FROM ({fx.RESPONSES})",
)
def _(t):
    return responses(t).select("conv_id", "turn", X.last_fence(F.col("response"), "cypher", "upper").alias("found"))


_BY_LANGUAGE = " ".join(f"WHEN lower(language) = {q(k)} THEN {sql_upper(sql_block('lower(response)', tag, q(' ')))}" for k, tag in LANGUAGE_TAGS.items())


@query("x_last_fence_lang", f"SELECT conv_id, turn, language, CASE {_BY_LANGUAGE} ELSE ' ' END AS found FROM ({fx.RESPONSES})")
def _(t):
    return responses(t).select("conv_id", "turn", "language", X.last_fence_by_language(F.col("response"), F.col("language")).alias("found"))


@query("x_last_fence_train", f"SELECT conv_id, turn, {sql_block('lower(response)', 'sql', q(''))} AS found FROM ({fx.RESPONSES})")
def _(t):
    return responses(t).select("conv_id", "turn", X.last_fence(F.col("response"), "sql", "train").alias("found"))


@query("x_has_fence", f"SELECT conv_id, turn, regexp_matches(response, '(?is)```cypher.*?```') AS found FROM ({fx.RESPONSES})")
def _(t):
    return responses(t).select("conv_id", "turn", X.has_fence(F.col("response"), "cypher").alias("found"))


@query(
    "x_after_marker",
    f"""SELECT conv_id, turn, string_split(response, 'Final Answer:')[-1] AS optional,
      CASE WHEN contains(response, 'Final Answer:') THEN string_split(response, 'Final Answer:')[-1] ELSE '' END AS required,
      string_split(response, '</think>')[-1] AS after_think FROM ({fx.RESPONSES})""",
)
def _(t):
    r = F.col("response")
    return responses(t).select(
        "conv_id", "turn", X.after_marker(r, "Final Answer:").alias("optional"),
        X.after_marker(r, "Final Answer:", required=True).alias("required"), X.after_marker(r, "</think>").alias("after_think"),
    )


@query(
    "x_yes_no",
    f"""SELECT pair_id, CASE lower(replace(tail, ' ', '')) WHEN 'yes' THEN 'True' WHEN 'no' THEN 'False' ELSE tail END AS answer
      FROM (SELECT pair_id, string_split(response, 'Final Answer:')[-1] AS tail FROM ({fx.ANSWERS}))""",
)
def _(t):
    return t.sql(fx.ANSWERS).select("pair_id", X.yes_no(X.after_marker(F.col("response"), "Final Answer:")).alias("answer"))


@query(
    "x_first_number",
    f"SELECT pair_id, coalesce(nullif(regexp_extract(response, '\\d+\\.\\d+|\\d+'), ''), response) AS number FROM ({fx.ANSWERS})",
)
def _(t):
    return t.sql(fx.ANSWERS).select("pair_id", X.first_number(F.col("response")).alias("number"))


def sql_table_names(sql: str) -> str:
    clean = f"regexp_replace(lower({sql}), '(?m)--.*$', '', 'g')"
    found = rf"regexp_extract_all({clean}, '\b(?:from|join)\s+([^\s,();]+)', 1)"
    bare = f"list_transform({found}, lambda n: trim(n, '`\"''()[]' || chr(10) || chr(9) || ' '))"
    return f"list_sort(list_distinct(list_filter({bare}, lambda n: n <> '')))"


@query("x_table_names", f"SELECT pair_id, array_to_string({sql_table_names('gold')}, ',') AS names FROM ({fx.SQL_PAIRS})")
def _(t):
    return t.sql(fx.SQL_PAIRS).select("pair_id", F.array_join(X.table_names(F.col("gold")), ",").alias("names"))


_INFO = (
    "'CREATE TABLE \"ORDERS\" (o_orderkey)' || chr(10) || '/*' || chr(10) || CAST(pair_id AS STRING) || chr(10) || '*/' || chr(10) || "
    "'CREATE TABLE \"CUSTOMER\" (c_custkey)' || chr(10) || '/*' || chr(10) || gold || chr(10) || '*/' || chr(10) || 'CREATE TABLE \"SUPPLIER\" (s_suppkey)'"
)


@query(
    "x_schema_blocks",
    f"""SELECT pair_id, array_to_string(list_transform(
        list_filter(string_split(info, 'CREATE TABLE')[2:], lambda b: contains(b, '/*') AND
          len(list_filter(names, lambda n: contains(string_split(b, chr(10))[1], '"' || upper(n) || '"'))) > 0),
        lambda b: 'CREATE TABLE' || string_split(b, '/*')[1] || '/*' || string_split(b, '/*')[2]), chr(10)) AS blocks
      FROM (SELECT pair_id, {_INFO} AS info, {sql_table_names('gold')} AS names FROM ({fx.SQL_PAIRS}))""",
)
def _(t):
    df = t.sql(f"SELECT pair_id, gold, {_INFO} AS info FROM ({fx.SQL_PAIRS}) p")
    return df.select("pair_id", X.schema_blocks(F.col("info"), X.table_names(F.col("gold"))).alias("blocks"))


CLINICAL = """
SELECT o_orderkey AS pair_id,
  'SELECT COUNT(*) FROM chartevents WHERE valuenum BETWEEN ' ||
  CASE o_orderkey % 6 WHEN 0 THEN 'sao2_lower AND sao2_upper' WHEN 1 THEN 'heart_rate_lower AND heart_rate_upper' WHEN 2 THEN 'mean_bp_lower AND sao2_upper'
    WHEN 3 THEN 'pain_lower AND pain_upper' WHEN 4 THEN 'temperature_lower AND 40' ELSE '1 AND 2' END ||
  ' AND icu = ' || CAST(o_custkey AS STRING) || ' AND status = ''''' || o_orderstatus || ''''' AND t < CURRENT_TIME AND x < = 3 AND strftime(''%Y-%j'', ''now'') > 0' AS query
FROM orders
"""


def sql_fill_ranges(text: str) -> str:
    low = f"regexp_extract({text}, '[ \\n]+([a-zA-Z0-9_]+_lower)', 1)"
    high = f"regexp_extract({text}, '[ \\n]+([a-zA-Z0-9_]+_upper)', 1)"
    name = f"regexp_extract({low}, '([a-zA-Z0-9_]+)_lower', 1)"
    whens = " ".join(
        f"WHEN replace({name}, '_', ' ') = {q(k)} THEN replace(replace({text}, {low}, '{a}'), {high}, '{b}')" for k, (a, b) in VITAL_RANGES.items()
    )
    return f"CASE WHEN {low} = '' OR {high} = '' OR {name} <> regexp_extract({high}, '([a-zA-Z0-9_]+)_upper', 1) THEN {text} {whens} ELSE {text} END"


@query("x_fill_ranges", f"SELECT pair_id, {sql_fill_ranges('query')} AS filled FROM (SELECT pair_id, lower(query) AS query FROM ({CLINICAL}))")
def _(t):
    return t.sql(CLINICAL).select("pair_id", X.fill_ranges(F.lower("query")).alias("filled"))


_NOW = q(f"'{FIXED_NOW}'")


@query(
    "x_canonical_sql",
    f"""SELECT pair_id, replace(replace(replace(replace(replace(filled, '''''', ''''), '< =', '<='), '%y', '%Y'), '%j', '%J'), '''now''', {_NOW}) AS canonical
      FROM (SELECT pair_id, {sql_fill_ranges('query')} AS filled FROM (SELECT pair_id, replace(lower(query), 'current_time', {_NOW}) AS query FROM ({CLINICAL})))""",
)
def _(t):
    return t.sql(CLINICAL).select("pair_id", X.canonical_sql(F.col("query")).alias("canonical"))


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def sql_normalise(text: str) -> str:
    bare = f"translate(lower({text}), {q(ANSWER_PUNCTUATION)}, '')"
    return f"array_to_string({sql_words(bare)}, ' ')"


@query(
    "x_normalise",
    f"SELECT doc_id, {sql_normalise('text')} AS normal FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.normalise_answer(F.col("text")).alias("normal"))


@query(
    "x_normalise_query",
    f"""SELECT pair_id, query_type, CASE WHEN query_type = 'cypher' THEN upper(gold) ELSE regexp_replace(array_to_string({sql_words('gold')}, ' '), '\\s*;$', '') END AS normal
      FROM (SELECT pair_id, query_type, gold FROM ({fx.SQL_PAIRS}) UNION ALL SELECT pair_id, query_type, gold FROM ({fx.CYPHER_PAIRS}))""",
)
def _(t):
    both = t.sql(fx.SQL_PAIRS).unionByName(t.sql(fx.CYPHER_PAIRS))
    return both.select("pair_id", "query_type", X.normalise_query(F.col("gold"), F.col("query_type")).alias("normal"))


# --- text scores --------------------------------------------------------------------------------


def sql_exact(gold: str, pred: str) -> str:
    number = r"'^\+?\d+(e\+?\d+)?$'"
    value = lambda x: f"CAST(replace({x}, '+', '') AS DOUBLE)"
    return f"CAST(CASE WHEN regexp_matches({gold}, {number}) AND regexp_matches({pred}, {number}) THEN {value(gold)} = {value(pred)} ELSE {gold} = {pred} END AS INT)"


def sql_exact_of(gold: str, pred: str, source: str, columns: str = "pair_id") -> str:
    return f"SELECT {columns}, {sql_exact('_g', '_p')} AS exact FROM (SELECT *, {sql_normalise(gold)} AS _g, {sql_normalise(pred)} AS _p FROM ({source}))"


@query("m_exact_match", sql_exact_of("gold", "response", fx.ANSWERS))
def _(t):
    return t.sql(fx.ANSWERS).select("pair_id", M.exact_match(F.col("gold"), F.col("response")).alias("exact"))


@query("m_contains", f"SELECT pair_id, CAST(contains(lower(response), lower(gold)) AS INT) AS found FROM ({fx.ANSWERS})")
def _(t):
    return t.sql(fx.ANSWERS).select("pair_id", M.contains_match(F.col("gold"), F.col("response")).alias("found"))


_LCS = """list_reduce(list_transform(gw, lambda w: [w]), lambda row, w:
    list_reduce(list_transform(range(1, len(pw) + 1), lambda j: [CAST(j AS VARCHAR)]), lambda acc, j:
      list_append(acc, CASE WHEN pw[CAST(j[1] AS INT)] = w[1] THEN CAST(CAST(row[CAST(j[1] AS INT)] AS INT) + 1 AS VARCHAR)
        ELSE CAST(greatest(CAST(acc[CAST(j[1] AS INT)] AS INT), CAST(row[CAST(j[1] AS INT) + 1] AS INT)) AS VARCHAR) END), ['0']),
    list_transform(range(0, len(pw) + 1), lambda j: '0'))[-1]"""


@query(
    "m_rouge_l",
    f"""SELECT pair_id, round(CASE WHEN lcs = 0 THEN 0.0 ELSE 2.0 * lcs / (len(gw) + len(pw)) END, 6) AS rouge FROM (
      SELECT pair_id, gw, pw, CAST({_LCS} AS INT) AS lcs FROM (
        SELECT pair_id, {sql_words('lower(gold)')} AS gw, {sql_words('lower(pred)')} AS pw FROM ({fx.NAME_PAIRS})))""",
)
def _(t):
    return t.sql(fx.NAME_PAIRS).select("pair_id", F.round(M.rouge_l(F.col("gold"), F.col("pred")), 6).alias("rouge"))


@query("m_rouge_l_documents")
def _(t):
    return spread(t.sql(fx.TEXT_PAIRS), "pair_id").select("pair_id", F.round(M.rouge_l(F.col("gold"), F.col("pred")), 6).alias("rouge"))


def sql_bleu(pairs: str) -> str:
    grams = lambda w, side: " UNION ALL ".join(
        f"SELECT pair_id, {n} AS n, {side} AS p, unnest(list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) AS gram FROM w"
        for n in range(1, 5)
    )
    prec = lambda n: f"ln(coalesce(nullif(CAST(coalesce(h{n}, 0) AS DOUBLE) / nullif(a{n}, 0), 0), 1e-7))"
    picks = ", ".join(f"sum(hit) FILTER (n = {n}) AS h{n}, sum(cp) FILTER (n = {n}) AS a{n}" for n in range(1, 5))
    return f"""WITH w AS (SELECT pair_id, {sql_words('lower(gold)')} AS gw, {sql_words('lower(pred)')} AS pw FROM ({pairs})),
      g AS ({grams('gw', 0)} UNION ALL {grams('pw', 1)}),
      c AS (SELECT pair_id, n, gram, count(*) FILTER (p = 1) AS cp, count(*) FILTER (p = 0) AS cg FROM g GROUP BY ALL),
      s AS (SELECT pair_id, {picks} FROM (SELECT *, least(cp, cg) AS hit FROM c) GROUP BY pair_id)
      SELECT w.pair_id, round(CASE WHEN len(pw) = 0 THEN 0 ELSE least(1.0, exp(1.0 - len(gw) / len(pw))) * exp(({prec(1)} + {prec(2)} + {prec(3)} + {prec(4)}) / 4) END, 6) AS bleu
      FROM w LEFT JOIN s ON s.pair_id = w.pair_id"""


@query("m_bleu4", sql_bleu(fx.TEXT_PAIRS))
def _(t):
    return M.bleu4(t.sql(fx.TEXT_PAIRS)).select("pair_id", F.round("bleu", 6).alias("bleu"))


@query(
    "m_ngram_profile",
    f"""WITH w AS (SELECT doc_id, {sql_words('lower(text)')} AS w FROM documents),
      g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) AS gram FROM w),
      c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL)
      SELECT doc_id, CAST(sum(n) AS BIGINT) AS grams, count(*) AS kinds, max(n) AS most FROM c GROUP BY doc_id""",
)
def _(t):
    profile = M.ngram_profile(t.documents, "doc_id", "text", 2)
    return profile.groupBy("doc_id").agg(F.sum("count").alias("grams"), F.count("*").alias("kinds"), F.max("count").alias("most"))


@query("m_sequence_ratio")
def _(t):
    both = t.sql(fx.SQL_PAIRS).unionByName(t.sql(fx.CYPHER_PAIRS))
    return spread(both, "pair_id").select("pair_id", "query_type", F.round(M.sequence_ratio(F.col("gold"), F.col("pred")), 6).alias("ratio"))


@query(
    "m_levenshtein_sim",
    f"""SELECT pair_id, round(CASE WHEN greatest(length(gold), length(pred)) = 0 THEN 1.0
      ELSE 1.0 - CAST(levenshtein(gold, pred) AS DOUBLE) / greatest(length(gold), length(pred)) END, 6) AS similarity FROM ({fx.SQL_PAIRS})""",
)
def _(t):
    return spread(t.sql(fx.SQL_PAIRS), "pair_id").select("pair_id", F.round(M.levenshtein_similarity(F.col("gold"), F.col("pred")), 6).alias("similarity"))


@query(
    "m_similarity_bound",
    f"""WITH p AS ({fx.TEXT_PAIRS}),
      c AS (SELECT pair_id, 0 AS side, unnest(string_split(gold, '')) AS ch FROM p UNION ALL SELECT pair_id, 1, unnest(string_split(pred, '')) FROM p),
      n AS (SELECT pair_id, ch, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM c GROUP BY ALL)
      SELECT pair_id, round(2.0 * CAST(sum(least(a, b)) AS DOUBLE) / CAST(sum(a + b) AS DOUBLE), 6) AS bound FROM n GROUP BY pair_id""",
)
def _(t):
    return spread(t.sql(fx.TEXT_PAIRS), "pair_id").select("pair_id", F.round(M.similarity_bound(F.col("gold"), F.col("pred")), 6).alias("bound"))


_MAPS = """
SELECT a.p_partkey AS pair_id, a.p_name AS an, a.p_type AS ay, a.p_brand AS ab, b.p_name AS bn, b.p_type AS bt, b.p_brand AS bb
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
"""


def _maps(t: Tables) -> DataFrame:
    lit = F.lit
    return t.sql(_MAPS).select(
        "pair_id",
        F.create_map(lit("select"), F.col("an"), lit("from"), F.col("ay"), lit("where"), F.concat(F.col("ab"), lit("  X "))).alias("pm"),
        F.create_map(lit("select"), F.col("bn"), lit("where"), F.concat(F.col("bb"), lit(" x")), lit("limit"), F.col("bt")).alias("gm"),
    )


@query("m_map_similarity")
def _(t):
    return M.map_similarity(_maps(t), "pair_id", "pm", "gm").select("pair_id", F.round("map_similarity", 6).alias("similarity"))


def _lev(a: str, b: str) -> str:
    return f"(1.0 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})))"


@query(
    "m_map_similarity_native",
    f"SELECT pair_id, round(({_lev('lower(an)', 'lower(bn)')} + {_lev(chr(40) + 'lower(ab) || ' + q(' x') + chr(41), chr(40) + 'lower(bb) || ' + q(' x') + chr(41))} + 0 + 0) / 4, 6) AS similarity FROM ({_MAPS})",
)
def _(t):
    return M.map_similarity(_maps(t), "pair_id", "pm", "gm", native=True).select("pair_id", F.round("map_similarity", 6).alias("similarity"))


# golds of all lengths: words of part names, names, and the sentences of the benchmark passages
_PASSAGES = """SELECT DISTINCT gold FROM (
  SELECT p_name AS gold FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part
  UNION ALL SELECT upper(replace(split_part(text, '.', 1), 'ß', 'SS')) FROM benchmark UNION ALL SELECT trim(split_part(text, '.', 2)) FROM benchmark) u
WHERE gold <> ''"""


@query("m_contains_batch", f"SELECT g.gold, d.doc_id FROM ({_PASSAGES}) g JOIN documents d ON contains(lower(d.text), lower(g.gold))")
def _(t):
    return matching.contains_join(t.sql(_PASSAGES), t.documents, "gold", "gold", "doc_id", "text")


_PART_GOLDS = "SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS gold FROM part"
_PART_PREDS = """SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN replace(p_name, 'e', '') || ' ' || p_type || ' ' || p_brand WHEN 1 THEN p_name || '  ' || lower(p_type) || p_brand
  WHEN 2 THEN p_name || ' ' || p_brand || ' ' || p_type ELSE p_type || p_name || '#' END AS pred FROM part"""


@query(
    "m_best_gold",
    f"""WITH v AS (SELECT pred, gold, 1 - levenshtein(gold, pred) / greatest(length(gold), length(pred)) AS s FROM ({_PART_PREDS}) p, ({_PART_GOLDS}) g),
        b AS (SELECT pred, gold, s, row_number() OVER (PARTITION BY pred ORDER BY s DESC, gold) AS r FROM v WHERE s >= 0.8 - 1e-9)
      SELECT p.pred, b.gold, round(b.s, 6) AS similarity FROM ({_PART_PREDS}) p LEFT JOIN b ON b.pred = p.pred AND b.r = 1""",
)
def _(t):
    return matching.best_gold(t.sql(_PART_GOLDS), t.sql(_PART_PREDS), "gold", "pred").withColumn("similarity", F.round("similarity", 6))


# --- clauses ------------------------------------------------------------------------------------

_SCAN = "|".join(sorted((k.replace(" ", "\x02\x03") for k in SQL_ALL if k != "CASE WHEN"), key=len, reverse=True))
_SCAN_PLAIN = "|".join(sorted((k for k in SQL_ALL if k != "CASE WHEN"), key=len, reverse=True))
_LISTED = ", ".join(q(k) for k in LISTED)


def _variant(rest: str) -> str:
    return f"CASE substr({rest}, 1, 1) WHEN '(' THEN 1 WHEN ')' THEN 2 WHEN ',' THEN 3 WHEN chr(10) THEN 4 ELSE 0 END"


def sql_components(source: str) -> str:
    """CTEs ending in ``comp`` (pair_id, side, keyword, v, i, content, items) from rows (pair_id, side, text)."""
    joined = "replace(replace(replace(replace(' ' || text || ' ', ' AND ', ' , '), ' OR ', ' , '), ' and ', ' , '), ' or ', ' , ')"
    marked = f"regexp_replace(replace({joined}, ' ', '\x02\x03'), '(?i)\x03({_SCAN})(\x02|[(),\n])', '\x01\x03\\1\\2', 'g')"
    plain = f"list_transform(string_split({marked}, '\x01'), lambda s: replace(replace(replace(s, '\x02\x03', ' '), '\x03', ' '), '\x02', ''))"
    # marker before a first keyword leaves an empty or half-blank first piece, which holds no hit
    return f"""src AS ({source}),
      seg AS (SELECT pair_id, side, {plain} AS segs FROM src),
      rows_ AS (SELECT pair_id, side, segs, unnest(range(1, len(segs) + 1)) AS i FROM seg),
      head AS (SELECT *, upper(regexp_extract(segs[i], '(?i)^ ({_SCAN_PLAIN})([ (),\n]|$)', 1)) AS kw FROM rows_),
      hit0 AS (SELECT *, substr(segs[i], length(kw) + 2) AS rest FROM head WHERE kw <> ''),
      hit AS (SELECT pair_id, side, segs, i, kw, rest, {_variant('rest')} AS v FROM hit0
        UNION ALL SELECT pair_id, side, segs, i, 'CASE WHEN', rest, {_variant('substr(rest, 6)')} FROM hit0
          WHERE kw = 'CASE' AND regexp_matches(rest, '(?i)^ WHEN([ (),\n]|$)')),
      kept AS (SELECT h.* FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.pair_id = h.pair_id AND o.side = h.side AND o.kw = h.kw AND o.v < h.v AND o.i > h.i)),
      nxt AS (SELECT k.pair_id, k.side, k.kw, k.i, min(o.i) AS nx FROM kept k JOIN hit o ON o.pair_id = k.pair_id AND o.side = k.side AND o.i > k.i AND o.v = 0 GROUP BY ALL),
      txt AS (SELECT k.pair_id, k.side, k.kw AS keyword, k.v, k.i, trim(CASE
          WHEN k.kw IN ({_LISTED}) THEN rest || array_to_string(segs[k.i + 1:coalesce(nx, len(segs) + 1) - 1], '')
          WHEN k.kw IN ('CASE', 'CASE WHEN') THEN CASE WHEN contains(upper(array_to_string(segs[k.i:], '')), 'END')
            THEN substr(array_to_string(segs[k.i:], ''), 1, strpos(upper(array_to_string(segs[k.i:], '')), 'END') + 2) ELSE '' END
          ELSE rest END, {BLANKS}) AS content
        FROM kept k LEFT JOIN nxt n ON n.pair_id = k.pair_id AND n.side = k.side AND n.kw = k.kw AND n.i = k.i),
      comp AS (SELECT * FROM (SELECT *, CASE WHEN keyword IN ({_LISTED})
          THEN list_distinct(list_filter(list_transform(string_split(content, ','), lambda x: trim(x, {BLANKS})), lambda x: x <> ''))
          ELSE list_distinct(string_split(content, '')) END AS items FROM txt WHERE content <> '') WHERE len(items) > 0)"""


def _sides(pairs: str) -> str:
    return f"SELECT pair_id, 'g' AS side, gold AS text FROM ({pairs}) UNION ALL SELECT pair_id, 'p', pred FROM ({pairs})"


@query(
    "c_sql_clauses",
    f"""WITH {sql_components(f"SELECT pair_id, 'g' AS side, gold AS text FROM ({fx.SQL_PAIRS})")}
      SELECT pair_id, keyword, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY v, i, keyword) - 1 AS INT) AS ordinal, content FROM comp""",
)
def _(t):
    return C.sql_clauses(t.sql(fx.SQL_PAIRS), "pair_id", "gold")


_SQL_F1 = f"""WITH {sql_components(_sides(fx.SQL_PAIRS))},
  firsts AS (SELECT pair_id, side, keyword, arg_min(items, v * 100000 + i) AS items FROM comp GROUP BY ALL),
  f AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, CASE WHEN a.items IS NULL OR b.items IS NULL THEN 0.0
      ELSE 2.0 * len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items)) END AS f1
    FROM (SELECT * FROM firsts WHERE side = 'g') a FULL JOIN (SELECT * FROM firsts WHERE side = 'p') b ON a.pair_id = b.pair_id AND a.keyword = b.keyword)
  SELECT pair_id, round(avg(f1), 6) AS f1 FROM f GROUP BY pair_id"""


@query("c_sql_f1", _SQL_F1)
def _(t):
    return C.sql_f1(t.sql(fx.SQL_PAIRS)).select("pair_id", F.round("component", 6).alias("f1"))


def sql_cypher_components(source: str, keywords: list[str]) -> str:
    stop = "|".join(CYPHER_MAIN)
    words = "[" + ", ".join(q(k) for k in keywords) + "]"
    marked = "regexp_replace(d, '(?i)\x03' || replace(regexp_escape(kw), '\\ ', '\x02\x03') || '\x02', '\x03' || replace(kw, ' ', '\x02\x03') || '\x02\x01', 'g')"
    rest = "replace(replace(replace(array_to_string(segs[i:], ''), '\x02\x03', ' '), '\x02', ''), '\x03', '')"
    return f"""src AS ({source}),
      k AS (SELECT pair_id, side, replace(' ' || text || ' ', ' ', '\x02\x03') AS d, unnest({words}) AS kw FROM src),
      seg AS (SELECT pair_id, side, kw, string_split({marked}, '\x01') AS segs FROM k),
      piece AS (SELECT pair_id, side, kw, segs, unnest(range(2, len(segs) + 1)) AS i FROM seg),
      comp AS (SELECT * FROM (SELECT pair_id, side, kw AS keyword, i, trim(string_split_regex({rest}, '{stop}')[1], {BLANKS}) AS content FROM piece) WHERE content <> '')"""


@query(
    "c_cypher_clauses",
    f"WITH {sql_cypher_components(f'SELECT pair_id, 0 AS side, gold AS text FROM ({fx.CYPHER_PAIRS})', CYPHER_ALL)} SELECT pair_id, keyword, content FROM comp",
)
def _(t):
    return C.cypher_clauses(t.sql(fx.CYPHER_PAIRS), "pair_id", "gold")


def sql_mask(text: str) -> str:
    names = rf"regexp_extract_all({text}, '\((\s*\w+)\s*:(\w+)\s*\)', 1)"
    masked = f"list_reduce({names}, lambda acc, v: replace(acc, trim(v, {BLANKS}), 'VAR'), {text})"
    return rf"regexp_replace({masked}, '\(\s*\w+\s*:(\w+)\s*\)', '(VAR:\1)', 'g')"


@query("c_mask_variables", f"SELECT pair_id, {sql_mask('gold')} AS masked FROM ({fx.CYPHER_PAIRS})")
def _(t):
    return t.sql(fx.CYPHER_PAIRS).select("pair_id", mask_variables(F.col("gold")).alias("masked"))


def _masked(pairs: str) -> str:
    return f"SELECT pair_id, 'g' AS side, {sql_mask('gold')} AS text FROM ({pairs}) UNION ALL SELECT pair_id, 'p', {sql_mask('pred')} FROM ({pairs})"


_CYPHER_F1 = f"""WITH {sql_cypher_components(_masked(fx.CYPHER_PAIRS), CYPHER_MAIN)},
  sets AS (SELECT pair_id, side, keyword, list_distinct(list(content)) AS items FROM comp GROUP BY ALL),
  f AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, CASE WHEN a.items IS NULL OR b.items IS NULL THEN 0.0
      ELSE 2.0 * len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items)) END AS f1
    FROM (SELECT * FROM sets WHERE side = 'g') a FULL JOIN (SELECT * FROM sets WHERE side = 'p') b ON a.pair_id = b.pair_id AND a.keyword = b.keyword)
  SELECT pair_id, round(avg(f1), 6) AS f1 FROM f GROUP BY pair_id"""


@query("c_cypher_f1", _CYPHER_F1)
def _(t):
    return C.cypher_f1(t.sql(fx.CYPHER_PAIRS)).select("pair_id", F.round("component", 6).alias("f1"))


def both_pairs(t: Tables) -> DataFrame:
    """SQL and Cypher pairs in one table; the Cypher ids are made negative."""
    cypher = t.sql(fx.CYPHER_PAIRS).withColumn("pair_id", -1 - F.col("pair_id"))
    return t.sql(fx.SQL_PAIRS).unionByName(cypher)


SQL_COMPONENT = f"SELECT pair_id, f1 AS component FROM ({_SQL_F1}) UNION ALL SELECT -1 - pair_id, f1 FROM ({_CYPHER_F1})"


@query("c_component_score", SQL_COMPONENT)
def _(t):
    return C.component_score(both_pairs(t)).select("pair_id", F.round("component", 6).alias("component"))


@query(
    "c_keyword_profile",
    f"""SELECT 'sql' AS query_type, keyword, count(*) AS n FROM (WITH {sql_components(f"SELECT pair_id, 'g' AS side, gold AS text FROM ({fx.SQL_PAIRS})")} SELECT keyword FROM comp) GROUP BY keyword
      UNION ALL SELECT 'cypher', keyword, count(*) FROM (WITH {sql_cypher_components(f'SELECT pair_id, 0 AS side, gold AS text FROM ({fx.CYPHER_PAIRS})', CYPHER_ALL)} SELECT keyword FROM comp) GROUP BY keyword""",
)
def _(t):
    sql = C.keyword_profile(C.sql_clauses(t.sql(fx.SQL_PAIRS), "pair_id", "gold")).select(F.lit("sql").alias("query_type"), "keyword", F.col("count").alias("n"))
    cypher = C.keyword_profile(C.cypher_clauses(t.sql(fx.CYPHER_PAIRS), "pair_id", "gold"))
    return sql.unionByName(cypher.select(F.lit("cypher").alias("query_type"), "keyword", F.col("count").alias("n")))


# --- pattern graphs -----------------------------------------------------------------------------


def sql_graph(source: str) -> str:
    """CTEs ``nodes`` (pair_id, side, n, var, label) and ``edges`` (pair_id, side, src, dst, type) from rows (pair_id, side, text)."""
    node = r"^\(\s*(\w*)\s*(?::\s*(\w+))?\s*(?:\{[^}]*\})?\s*\)$"
    return rf"""src AS ({source}),
      tok AS (SELECT pair_id, side, unnest(regexp_extract_all(text, '\([^()]*\)|<?-\[[^\]]*\]->?')) AS tok, generate_subscripts(regexp_extract_all(text, '\([^()]*\)|<?-\[[^\]]*\]->?'), 1) - 1 AS pos FROM src),
      ctx AS (SELECT *, tok NOT LIKE '(%' AS is_edge, coalesce(lag(tok) OVER w LIKE '%-[%', false) OR coalesce(lead(tok) OVER w LIKE '%-[%', false) AS hop FROM tok WINDOW w AS (PARTITION BY pair_id, side ORDER BY pos)),
      par AS (SELECT *, regexp_extract(tok, '{node}', 1) AS name, nullif(regexp_extract(tok, '{node}', 2), '') AS label,
        nullif(regexp_extract(tok, '\[\s*\w*\s*(?::\s*(\w+))?', 1), '') AS type FROM ctx),
      nod AS (SELECT *, NOT is_edge AND regexp_matches(tok, '{node}') AND (name <> '' OR label IS NOT NULL OR hop) AS is_node, CASE WHEN name <> '' THEN name ELSE '_' || pos END AS var FROM par),
      nb AS (SELECT *, lag(var) OVER w AS l, lead(var) OVER w AS r, lag(is_node) OVER w AS ln, lead(is_node) OVER w AS rn FROM nod WINDOW w AS (PARTITION BY pair_id, side ORDER BY pos)),
      hops AS (SELECT * FROM nb WHERE is_edge AND ln AND rn),
      ends AS (SELECT pair_id, side, 0 AS late, pos, CASE WHEN tok LIKE '%>' THEN l ELSE r END AS src, CASE WHEN tok LIKE '%>' THEN r ELSE l END AS dst, type FROM hops WHERE (tok LIKE '%>') <> (tok LIKE '<%')
        UNION ALL SELECT pair_id, side, 1, pos, l, r, type FROM hops WHERE (tok LIKE '%>') = (tok LIKE '<%')
        UNION ALL SELECT pair_id, side, 1, pos, r, l, type FROM hops WHERE (tok LIKE '%>') = (tok LIKE '<%')),
      edges AS (SELECT e.pair_id, e.side, e.src, e.dst, e.type FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side, src, dst ORDER BY late DESC, pos DESC) AS rn_ FROM ends) e WHERE rn_ = 1),
      nodes AS (SELECT pair_id, side, var, min(pos) AS n, arg_max(label, pos) FILTER (label IS NOT NULL) AS label FROM nod WHERE is_node GROUP BY pair_id, side, var)"""


@query(
    "g_nodes",
    f"WITH {sql_graph(f'SELECT pair_id, 0 AS side, gold AS text FROM ({fx.CYPHER_PAIRS})')} SELECT pair_id, var, label FROM nodes",
)
def _(t):
    return G.pattern_nodes(t.sql(fx.CYPHER_PAIRS), "pair_id", "gold")


@query(
    "g_edges",
    f"WITH {sql_graph(f'SELECT pair_id, 0 AS side, gold AS text FROM ({fx.CYPHER_PAIRS})')} SELECT pair_id, src, dst, type FROM edges",
)
def _(t):
    return G.pattern_edges(t.sql(fx.CYPHER_PAIRS), "pair_id", "gold")


_GED = f"""WITH RECURSIVE {sql_graph(_sides(fx.CYPHER_PAIRS))},
  idx AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY n) AS k FROM nodes),
  nl AS (SELECT pair_id, side, list(coalesce(label, '') ORDER BY k) AS labels FROM idx GROUP BY ALL),
  el AS (SELECT e.pair_id, e.side, list(a.k || '>' || b.k || ':' || coalesce(e.type, '') ORDER BY a.k, b.k) AS es
    FROM edges e JOIN idx a ON a.pair_id = e.pair_id AND a.side = e.side AND a.var = e.src
    JOIN idx b ON b.pair_id = e.pair_id AND b.side = e.side AND b.var = e.dst GROUP BY ALL),
  side_ AS (SELECT s.pair_id, s.side, coalesce(nl.labels, []) AS labels, coalesce(el.es, []) AS es FROM src s LEFT JOIN nl USING (pair_id, side) LEFT JOIN el USING (pair_id, side)),
  pg AS (SELECT g.pair_id, g.labels AS gl, g.es AS ge, p.labels AS pl, p.es AS pe FROM side_ g JOIN side_ p ON g.pair_id = p.pair_id AND g.side = 'g' AND p.side = 'p'),
  shape AS (SELECT row_number() OVER () AS sid, * FROM (SELECT DISTINCT gl, ge, pl, pe FROM pg)),
  map(sid, k, img) AS (
    SELECT sid, 0, CAST([] AS INT[]) FROM shape
    UNION ALL
    SELECT m.sid, m.k + 1, list_append(m.img, CAST(o.p AS INT)) FROM map m JOIN (SELECT sid, len(gl) AS ng, unnest(range(0, len(pl) + 1)) AS p FROM shape) o
      ON o.sid = m.sid AND m.k < o.ng AND (o.p = 0 OR NOT list_contains(m.img, CAST(o.p AS INT)))),
  full_ AS (SELECT s.*, m.img,
      list_transform(ge, lambda e: img[CAST(string_split(e, '>')[1] AS INT)] || '>' || img[CAST(string_split(string_split(e, '>')[2], ':')[1] AS INT)]) AS moved,
      list_transform(ge, lambda e: string_split(e, ':')[2]) AS gt,
      list_transform(pe, lambda e: string_split(e, ':')[1]) AS pk, list_transform(pe, lambda e: string_split(e, ':')[2]) AS pt
    FROM shape s JOIN map m ON m.sid = s.sid AND m.k = len(s.gl)),
  cost AS (SELECT sid, len(pl) - len(list_filter(img, lambda p: p > 0)) +
      coalesce(list_sum(list_transform(range(1, len(gl) + 1), lambda i: CASE WHEN img[i] = 0 THEN 1 WHEN pl[img[i]] = gl[i] THEN 0 ELSE 1 END)), 0) +
      coalesce(list_sum(list_transform(range(1, len(ge) + 1), lambda i: CASE WHEN NOT list_contains(pk, moved[i]) THEN 1 WHEN pt[list_position(pk, moved[i])] = gt[i] THEN 0 ELSE 1 END)), 0) +
      len(list_filter(pk, lambda e: NOT list_contains(moved, e))) AS c FROM full_),
  best AS (SELECT sid, CAST(min(c) AS INT) AS ged FROM cost GROUP BY sid)
  SELECT p.pair_id, CAST(len(p.gl) + len(p.ge) AS INT) AS size1, CAST(len(p.pl) + len(p.pe) AS INT) AS size2, b.ged
  FROM pg p JOIN shape s ON s.gl = p.gl AND s.ge = p.ge AND s.pl = p.pl AND s.pe = p.pe JOIN best b ON b.sid = s.sid"""


@query("g_edit_distance", _GED)
def _(t):
    return G.graph_edit_distance(t.sql(fx.CYPHER_PAIRS))


_OVERLAP = f"SELECT pair_id, round(CASE WHEN greatest(size1, size2) = 0 THEN 0.0 ELSE 1.0 - CAST(ged AS DOUBLE) / greatest(size1, size2) END, 6) AS overlap FROM ({_GED})"


@query("g_overlap", _OVERLAP)
def _(t):
    return G.graph_overlap(t.sql(fx.CYPHER_PAIRS)).select("pair_id", F.round("overlap", 6).alias("overlap"))


def _shared(table: str, value: str, out: str) -> str:
    return f"""{out} AS (SELECT pair_id, CAST(sum(least(a, b)) AS INT) AS shared, CAST(greatest(sum(a), sum(b)) AS INT) AS most FROM (
      SELECT pair_id, {value}, count(*) FILTER (side = 'g') AS a, count(*) FILTER (side = 'p') AS b FROM {table} GROUP BY ALL) GROUP BY pair_id)"""


@query(
    "g_multiset_overlap",
    f"""WITH {sql_graph(_sides(fx.CYPHER_PAIRS))}, {_shared('nodes', 'label', 'ns')}, {_shared('edges', 'type', 'es')}
      SELECT p.pair_id, coalesce(ns.shared, 0) AS label_overlap, coalesce(es.shared, 0) AS type_overlap,
        coalesce(ns.most - ns.shared, 0) + coalesce(es.most - es.shared, 0) AS ged_bound
      FROM ({fx.CYPHER_PAIRS}) p LEFT JOIN ns ON ns.pair_id = p.pair_id LEFT JOIN es ON es.pair_id = p.pair_id""",
)
def _(t):
    return G.graph_multiset_overlap(t.sql(fx.CYPHER_PAIRS))


@query("g_component_or_graph", f"SELECT pair_id, f1 AS score FROM ({_SQL_F1}) UNION ALL SELECT -1 - pair_id, overlap FROM ({_OVERLAP})")
def _(t):
    return G.component_or_graph(both_pairs(t)).select("pair_id", F.round("component_or_graph", 6).alias("score"))


@query("u_registry")
def _(t):
    scores = run_scorers(both_pairs(t), ["component_or_graph", "exact_match", "sequence"])
    return scores.select("pair_id", "metric", F.round("value", 6).alias("value"))
