"""DuckDB twins of the registered queries (tables are pre-registered views).

Rounding: Spark rounds a double HALF_UP on its shortest decimal text; DuckDB
rounds the binary value.  ``r(x, d)`` makes DuckDB round the decimal text too,
so ties such as 72.365 give Spark's 72.37 in both engines.
"""

from __future__ import annotations

from ratelens.operators.sampling import unit_sql
from ratelens.operators.text import FILTER_REGEX, stop_words
from ratelens.plans.standins import ANOMALY_THRESHOLDS, FRIEND_KEY_OFFSETS


def r(expr: str, digits: int = 2) -> str:
    return f"round(cast(cast(({expr}) AS varchar) AS decimal(38,10)), {digits})::double"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


T = ANOMALY_THRESHOLDS

BUSINESS_VOLUME = """
SELECT o_custkey AS business_id, count(*) AS review_count,
       round(avg(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) * 2) / 2 AS stars
FROM orders GROUP BY o_custkey"""

REVIEWS = """
SELECT d.doc_id AS review_id, d.source AS business_id,
       CASE WHEN l.quality = 1 THEN 5 ELSE 1 END AS stars, d.text, d.lang, d.doc_id, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

_OFFSETS = ", ".join(str(d) for d in FRIEND_KEY_OFFSETS)
FRIEND_PAIRS = f"""
SELECT p.a, q.b FROM (
  SELECT c_custkey AS a, c_mktsegment AS seg, c_custkey + unnest([{_OFFSETS}]) AS probe FROM customer) p
JOIN (SELECT c_custkey AS b, c_mktsegment AS seg_b FROM customer) q
  ON p.probe = q.b AND p.seg = q.seg_b"""

USERS = f"""
WITH per_cust AS (
  SELECT o_custkey AS c_custkey, count(*) AS review_count,
         {r("avg(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER))")} AS average_stars,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS fans
  FROM orders GROUP BY o_custkey),
pairs AS ({FRIEND_PAIRS}),
both_dir AS (SELECT a AS c_custkey, b AS f FROM pairs UNION ALL SELECT b, a FROM pairs),
fr AS (SELECT c_custkey, array_to_string(list_sort(list(CAST(f AS varchar))), ', ') AS friends
       FROM both_dir GROUP BY c_custkey)
SELECT CAST(c.c_custkey AS varchar) AS user_id, c.c_name AS name,
       coalesce(p.review_count, 0) AS review_count, p.average_stars,
       coalesce(p.fans, 0) AS fans, coalesce(fr.friends, 'None') AS friends
FROM customer c LEFT JOIN per_cust p ON c.c_custkey = p.c_custkey
LEFT JOIN fr ON c.c_custkey = fr.c_custkey"""

PREDICTIONS = """
SELECT quality AS true_sentiment, 1 - toxic AS predicted_sentiment,
       quality = 1 - toxic AS correct FROM labels"""

UNIT_PRICE = """
WITH unit AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS unit FROM lineitem GROUP BY l_partkey)
SELECT l.l_extendedprice AS label, l.l_quantity * u.unit AS prediction
FROM lineitem l JOIN unit u ON l.l_partkey = u.l_partkey"""

TOP_CATEGORIES = """
SELECT category, count(*) AS count
FROM (SELECT unnest(string_split(p_name, ' ')) AS category FROM part)
GROUP BY category ORDER BY count DESC, category ASC LIMIT {k}"""

GEO = f"""
SELECT p_type AS state, p_brand AS city, {r("avg(p_size)")} AS average_stars,
       count(p_partkey) AS business_count
FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL
GROUP BY p_type, p_brand ORDER BY state, city"""

OPEN_SHARE = f"""
SELECT city, open_count, total_count,
       {r("CAST(open_count AS DOUBLE) / CAST(total_count AS DOUBLE) * 100")} AS open_percentage
FROM (SELECT o_orderpriority AS city,
             CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS open_count,
             count(o_orderkey) AS total_count
      FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority)
ORDER BY total_count DESC, city ASC"""

PRICE_MIX = """
SELECT price_range, count(*) AS count
FROM (SELECT p_type AS price_range FROM part WHERE contains(p_name, 'widget'))
WHERE price_range IS NOT NULL AND price_range <> 'None'
GROUP BY price_range ORDER BY price_range"""

MONTHLY = """
SELECT strftime(try_cast(CAST(o_orderdate AS varchar) AS TIMESTAMP), '%Y-%m') AS year_month, count(*) AS count
FROM orders GROUP BY 1 ORDER BY 1"""

TOP_USERS = f"""
SELECT name, review_count, user_id FROM ({USERS})
ORDER BY review_count DESC, user_id ASC LIMIT 100"""

WIFI = f"""
SELECT wifi_cleaned, {r("avg(stars)")} AS avg_rating, count(stars) AS count
FROM (SELECT n_chars AS stars, regexp_replace('u''' || lang || '''', '^u''|''$|''', '', 'g') AS wifi_cleaned
      FROM documents)
WHERE wifi_cleaned IS NOT NULL AND wifi_cleaned <> 'None'
GROUP BY wifi_cleaned ORDER BY avg_rating DESC, wifi_cleaned"""

PARKING = f"""
SELECT has_lot_parking, {r("avg(stars)")} AS avg_rating, count(stars) AS count
FROM (SELECT p_size AS stars,
             CASE WHEN contains(parking, '''lot'': True') THEN 'Yes' ELSE 'No' END AS has_lot_parking
      FROM (SELECT p_size, '{{''lot'': ' || CASE WHEN contains(p_name, 'widget') THEN 'True' ELSE 'False' END
                   || ', ''valet'': False}}' AS parking FROM part)
      WHERE parking IS NOT NULL)
GROUP BY has_lot_parking ORDER BY avg_rating DESC, has_lot_parking"""

LENGTH_VS_STARS = f"""
SELECT stars, {r("avg(length(text))")} AS avg_length, count(review_id) AS review_count
FROM ({REVIEWS}) WHERE text IS NOT NULL GROUP BY stars ORDER BY stars"""

LENGTH_BY_LANG = f"""
SELECT lang AS stars, {r("avg(length(text))")} AS avg_length, count(doc_id) AS review_count
FROM documents WHERE text IS NOT NULL GROUP BY lang ORDER BY stars"""

CORRELATION = f"""
SELECT {r("rr", 4)} AS correlation,
       CASE WHEN rr IS NULL THEN 'undefined' WHEN abs(rr) < 0.1 THEN 'low' ELSE 'correlated' END AS verdict,
       n
FROM (SELECT covar_pop(stars, length(text)) / nullif(stddev_pop(stars) * stddev_pop(length(text)), 0) AS rr,
             count(*) FILTER (WHERE stars IS NOT NULL AND length(text) IS NOT NULL) AS n
      FROM ({REVIEWS}) WHERE text IS NOT NULL)"""

_BAD = f"review_count > {T['bad_min_count']} AND stars < {T['bad_max_rating']}"
_GOOD = f"review_count < {T['good_max_count']} AND stars = {T['good_rating']}"

ANOMALIES = f"""
SELECT business_id, review_count, stars,
       CASE WHEN {_BAD} THEN 'suspicious_bad' ELSE 'suspicious_good' END AS anomaly_class
FROM ({BUSINESS_VOLUME}) WHERE ({_BAD}) OR ({_GOOD})"""

ANOMALY_COUNTS = f"""
SELECT count(*) FILTER (WHERE {_BAD}) AS suspicious_bad, count(*) FILTER (WHERE {_GOOD}) AS suspicious_good
FROM ({BUSINESS_VOLUME})"""

FANS_FEATURES = f"""
SELECT CAST(review_count AS DOUBLE) AS review_count, CAST(average_stars AS DOUBLE) AS average_stars,
       CAST(fans AS DOUBLE) AS label,
       CAST(CASE WHEN friends IS NULL OR trim(friends) = '' OR trim(friends) = 'None' THEN 0
            ELSE len(string_split(friends, ',')) END AS INTEGER) AS friend_count
FROM ({USERS})
WHERE review_count > 0 AND review_count <= 500 AND average_stars IS NOT NULL AND fans <= 200"""

# -- report tables --------------------------------------------------------------
CATEGORY_SHARE = f"""
WITH t AS ({TOP_CATEGORIES.format(k=15)})
SELECT category, count, {r("CAST(count AS DOUBLE) / CAST((SELECT sum(count) FROM t) AS DOUBLE) * 100")} AS share_pct
FROM t"""

STATE_SHARE = f"""
WITH s AS (SELECT state, CAST(sum(business_count) AS BIGINT) AS business_count FROM ({GEO}) GROUP BY state
           ORDER BY business_count DESC, state ASC LIMIT 8)
SELECT state, business_count,
       {r("CAST(business_count AS DOUBLE) / CAST((SELECT sum(business_count) FROM s) AS DOUBLE) * 100")} AS share_pct
FROM s"""

OPEN_CLOSED = f"""
SELECT city, open_count, total_count - open_count AS closed_count, total_count, open_percentage
FROM ({OPEN_SHARE}) ORDER BY total_count DESC, city ASC LIMIT 12"""

PRICE_SHARE = f"""
WITH t AS ({PRICE_MIX})
SELECT price_range, count, {r("CAST(count AS DOUBLE) / CAST((SELECT sum(count) FROM t) AS DOUBLE) * 100")} AS share_pct
FROM t"""

MONTHLY_SERIES = f"""
SELECT year_month, CAST(year_month || '-01' AS DATE) AS month_start, count FROM ({MONTHLY})"""

USER_QUANTILES = f"""
SELECT {r("quantile_cont(review_count, 0.125)", 4)} AS q_0_125, {r("quantile_cont(review_count, 0.25)", 4)} AS q_0_25,
       {r("quantile_cont(review_count, 0.5)", 4)} AS q_0_5, {r("quantile_cont(review_count, 0.75)", 4)} AS q_0_75,
       {r("quantile_cont(review_count, 0.875)", 4)} AS q_0_875
FROM ({TOP_USERS})"""

SENTIMENT_TOTALS = f"""
SELECT CAST(sum(predicted_sentiment) AS BIGINT) AS positive_count,
       count(*) - CAST(sum(predicted_sentiment) AS BIGINT) AS negative_count,
       CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct_count, count(*) AS total_count,
       {r("CAST(sum(CAST(correct AS INTEGER)) AS DOUBLE) / CAST(count(*) AS DOUBLE)", 4)} AS accuracy
FROM ({PREDICTIONS})"""

CONFUSION = f"""
SELECT true_label, n_pred_0, n_pred_1, n_pred_other, row_total,
       {r("CAST(n_pred_0 AS DOUBLE) / CAST(row_total AS DOUBLE)", 4)} AS rate_pred_0,
       {r("CAST(n_pred_1 AS DOUBLE) / CAST(row_total AS DOUBLE)", 4)} AS rate_pred_1
FROM (SELECT c.cls AS true_label,
             count(*) FILTER (WHERE p.predicted_sentiment = 0) AS n_pred_0,
             count(*) FILTER (WHERE p.predicted_sentiment = 1) AS n_pred_1,
             count(*) FILTER (WHERE p.predicted_sentiment NOT IN (0, 1)) AS n_pred_other,
             count(p.predicted_sentiment) AS row_total
      FROM (SELECT true_sentiment AS cls FROM ({PREDICTIONS}) WHERE true_sentiment IS NOT NULL AND predicted_sentiment IS NOT NULL
            UNION SELECT predicted_sentiment FROM ({PREDICTIONS}) WHERE true_sentiment IS NOT NULL AND predicted_sentiment IS NOT NULL) c
      LEFT JOIN (SELECT * FROM ({PREDICTIONS}) WHERE predicted_sentiment IS NOT NULL) p ON p.true_sentiment = c.cls
      GROUP BY c.cls)"""

ANOMALY_TYPES = f"""
SELECT anomaly_class, count(*) AS count FROM ({ANOMALIES}) GROUP BY anomaly_class ORDER BY count DESC, anomaly_class"""

REGRESSION_METRICS = f"""
WITH p AS ({UNIT_PRICE}), m AS (SELECT avg(label) AS mu FROM p)
SELECT {r("sqrt(sum((label - prediction) * (label - prediction)) / count(*))", 4)} AS rmse,
       {r("1.0 - sum((label - prediction) * (label - prediction)) / sum((label - mu) * (label - mu))", 4)} AS r2,
       count(*) AS n
FROM p, m"""

AXIS_BOUND = f"""
SELECT {r("greatest(max(label), max(prediction))")} AS axis_max FROM ({UNIT_PRICE})"""

# -- text -------------------------------------------------------------------------
_STOP = "[" + ", ".join(_q(w) for w in stop_words()) + "]"

STOPWORD_COUNTS = f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_words,
       CAST(len(list_filter(toks, lambda t: NOT list_contains({_STOP}, t))) AS INTEGER) AS n_filtered
FROM (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '\\s+$', ''), '\\s') AS toks
      FROM documents WHERE text IS NOT NULL)"""

_WORDS = f"list_filter(string_split(regexp_replace(lower(text), '{FILTER_REGEX}', ' ', 'g'), ' '), lambda t: t <> '')"

TOKENS = f"""
SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"""

VOCABULARY = f"""
SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word ASC) + 1 AS INTEGER) AS id
FROM (SELECT word, count(*) AS n FROM ({TOKENS}) GROUP BY word)
ORDER BY n DESC, word ASC LIMIT 19998"""

ENCODE_PAD = f"""
WITH v AS ({VOCABULARY}), t AS ({TOKENS}),
enc AS (SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids
        FROM t LEFT JOIN v ON t.word = v.word GROUP BY t.doc_id)
SELECT d.doc_id, CAST(coalesce(len(e.ids), 0) AS INTEGER) AS n_tokens,
       CAST(coalesce(len(list_filter(e.ids, lambda i: i = 1)), 0) AS INTEGER) AS n_oov,
       array_to_string(list_resize(coalesce(e.ids, CAST([] AS INTEGER[])), 200, 0), ' ') AS ids_text
FROM documents d LEFT JOIN enc e ON d.doc_id = e.doc_id"""

# -- friend graph ---------------------------------------------------------------
EDGES = f"""
WITH u AS ({USERS}),
raw AS (SELECT user_id AS src, trim(unnest(string_split(friends, ','))) AS dst FROM u
        WHERE friends IS NOT NULL AND trim(friends) NOT IN ('', 'None')),
ok AS (SELECT r.src, r.dst FROM raw r JOIN u ON r.dst = u.user_id WHERE r.src <> r.dst)
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ok"""

COMPONENTS = f"""
WITH RECURSIVE e AS ({EDGES}),
d AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(node, comp) AS (
  SELECT user_id, user_id FROM ({USERS})
  UNION
  SELECT d.b, r.comp FROM reach r JOIN d ON r.node = d.a)
SELECT node AS user_id, min(comp) AS component FROM reach GROUP BY node"""


def _lpa_round(prev: str) -> str:
    return f"""(SELECT n.user_id, coalesce(b.label, n.label) AS label FROM {prev} n LEFT JOIN (
      SELECT node, first(label ORDER BY cnt DESC, label ASC) AS label FROM (
        SELECT d.a AS node, p.label, count(*) AS cnt FROM d JOIN {prev} p ON d.b = p.user_id
        GROUP BY d.a, p.label) GROUP BY node) b ON n.user_id = b.node)"""


def label_propagation_sql(rounds: int = 24) -> str:
    """Unrolled; enough rounds for the labels of these tables to settle or to
    alternate between two states, whose smaller label counts."""
    ctes = [f"e AS MATERIALIZED ({EDGES})",
            "d AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e)",
            f"l0 AS MATERIALIZED (SELECT user_id, user_id AS label FROM ({USERS}))"]
    for i in range(1, rounds + 1):
        ctes.append(f"l{i} AS MATERIALIZED {_lpa_round(f'l{i - 1}')}")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT x.user_id, least(x.label, y.label) AS community, x.label = y.label AS settled
FROM l{rounds - 1} x JOIN l{rounds} y ON x.user_id = y.user_id"""


def community_taste_sql(k: int = 3) -> str:
    return f"""
WITH c AS ({COMPONENTS}),
lt AS (SELECT l.l_orderkey, p.p_type, count(*) AS n FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
       GROUP BY l.l_orderkey, p.p_type),
ct AS (SELECT o.o_custkey, lt.p_type, sum(lt.n) AS n FROM lt JOIN orders o ON lt.l_orderkey = o.o_orderkey
       GROUP BY o.o_custkey, lt.p_type),
cc AS (SELECT c.component AS community, ct.p_type AS category, CAST(sum(ct.n) AS BIGINT) AS n
       FROM ct JOIN c ON CAST(ct.o_custkey AS varchar) = c.user_id GROUP BY c.component, ct.p_type),
tot AS (SELECT community, sum(n) AS community_total FROM cc GROUP BY community),
g AS (SELECT category, sum(n) AS global_n FROM cc GROUP BY category),
gt AS (SELECT sum(n) AS global_total FROM cc),
scored AS (
  SELECT cc.community, cc.category, cc.n,
         CAST(cc.n AS DOUBLE) / CAST(tot.community_total AS DOUBLE) AS share,
         CAST(g.global_n AS DOUBLE) / CAST(gt.global_total AS DOUBLE) AS global_share
  FROM cc JOIN tot ON cc.community = tot.community JOIN g ON cc.category = g.category, gt)
SELECT community, category, n, {r("share", 4)} AS share, {r("share / global_share", 4)} AS lift,
       CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, category ASC) AS rank FROM scored)
WHERE rank <= {k}"""


def _taste_cells() -> str:
    """Every (community, category) cell of the settled communities, absent ones with 0."""
    return f"""
l AS MATERIALIZED ({label_propagation_sql()}),
cc AS MATERIALIZED (
  SELECT l.community, p.p_type AS category, count(*) AS n
  FROM lineitem i JOIN part p ON i.l_partkey = p.p_partkey JOIN orders o ON i.l_orderkey = o.o_orderkey
  JOIN l ON CAST(o.o_custkey AS varchar) = l.user_id WHERE l.settled GROUP BY l.community, p.p_type),
o AS (SELECT community, sum(n) AS own FROM cc GROUP BY community),
g AS (SELECT category, sum(n) AS of_all, (SELECT sum(n) FROM cc) AS total FROM cc GROUP BY category),
cells AS (
  SELECT o.community, coalesce(cc.n, 0) AS n, CAST(o.own AS DOUBLE) * g.of_all / g.total AS expected,
         coalesce(cc.n, 0) / CAST(o.own AS DOUBLE) AS p, g.of_all / CAST(g.total AS DOUBLE) AS q
  FROM o CROSS JOIN g LEFT JOIN cc ON cc.community = o.community AND cc.category = g.category),
each_ AS MATERIALIZED (
  SELECT community, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (WHERE n > 0) AS categories,
         sum((n - expected) * (n - expected) / expected) AS chi,
         sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + q * log2(2 * q / (p + q))) / 2 AS js
  FROM cells GROUP BY community)"""


def taste_test_sql() -> str:
    return f"""WITH {_taste_cells()}
SELECT community, n, CAST(categories AS BIGINT) AS categories, round(chi, 4) AS chi_square, round(js, 4) AS js_divergence FROM each_"""


def taste_association_sql() -> str:
    return f"""WITH {_taste_cells()},
t AS (SELECT sum(n) AS n, count(*) AS communities, sum(chi) AS chi, sum(n * js) AS js, (SELECT count(*) FROM g) AS categories FROM each_)
SELECT CAST(n AS BIGINT) AS n, communities, categories, round(chi, 4) AS chi_square, (communities - 1) * (categories - 1) AS degrees,
  round(sqrt(chi / (n * (least(communities, categories) - 1))), 4) AS cramers_v, round(js / n, 4) AS js_divergence FROM t"""


SAMPLE_FRACTION = f"SELECT * FROM lineitem WHERE {unit_sql(['l_orderkey', 'l_linenumber'])} < 0.1"

SAMPLE_ROWS = f"""
SELECT d.doc_id AS review_id, CAST(CASE WHEN quality = 1 THEN 5 ELSE 1 END AS INTEGER) AS stars, d.text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id ORDER BY {unit_sql(['d.doc_id'])}, d.doc_id LIMIT 100"""

STRATIFIED_SPLIT = f"""
SELECT quality, CASE WHEN {unit_sql(['quality', 'doc_id'])} < 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS n
FROM labels GROUP BY 1, 2"""

#: The users of the scatter chart: held-out users (unit of the split >= 0.8), 2000 of smallest unit.
PREDICTION_KEYS = f"""
SELECT user_id FROM ({USERS}) u WHERE review_count > 0 AND review_count <= 500 AND average_stars IS NOT NULL AND fans <= 200
  AND {unit_sql(['user_id'])} >= 0.8
ORDER BY {unit_sql(['user_id'])}, user_id LIMIT 2000"""

IDF = f"""
WITH toks AS (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '\\s+$', ''), '\\s') AS w
              FROM documents WHERE text IS NOT NULL),
kept AS (SELECT doc_id, list_distinct(list_filter(w, lambda t: NOT list_contains({_STOP}, t))) AS f FROM toks),
n AS (SELECT count(*) AS n_docs FROM documents WHERE text IS NOT NULL)
SELECT term, df, {r("ln(CAST(n_docs + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE))", 6)} AS idf
FROM (SELECT term, count(*) AS df FROM (SELECT unnest(f) AS term FROM kept) GROUP BY term), n"""

CORRELATION_BY_LANG = f"""
SELECT lang, {r("covar_pop(stars, length(text)) / nullif(stddev_pop(stars) * stddev_pop(length(text)), 0)", 4)} AS correlation,
       count(*) AS n
FROM ({REVIEWS}) WHERE text IS NOT NULL GROUP BY lang"""

CONFUSION_LONG = f"""
SELECT true_sentiment AS true_label, predicted_sentiment AS pred_label, count(*) AS count
FROM ({PREDICTIONS}) WHERE true_sentiment IS NOT NULL AND predicted_sentiment IS NOT NULL
GROUP BY true_sentiment, predicted_sentiment"""

TOP_BAD = f"""
SELECT * FROM ({ANOMALIES}) WHERE anomaly_class = 'suspicious_bad'
ORDER BY review_count DESC, business_id ASC LIMIT 10"""

LABEL_BALANCE = f"""
SELECT stars AS true_stars, CAST(stars > 3 AS INTEGER) AS true_sentiment, count(*) AS count
FROM ({REVIEWS}) WHERE text IS NOT NULL AND stars IS NOT NULL AND stars <> 3
GROUP BY stars, CAST(stars > 3 AS INTEGER)"""

EXACT_SPLIT_COUNTS = """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT quality, 'train' AS part, CAST(floor(n * 0.8) AS BIGINT) AS n FROM c WHERE floor(n * 0.8) > 0
UNION ALL
SELECT quality, 'test' AS part, n - CAST(floor(n * 0.8) AS BIGINT) AS n FROM c WHERE n - floor(n * 0.8) > 0"""

TOP_WORDS = """
SELECT category, count(*) AS count
FROM (SELECT unnest(string_split(text, ' ')) AS category FROM documents)
GROUP BY category ORDER BY count DESC, category ASC LIMIT 20"""

PRICE_KEY_CORRELATION = f"""
SELECT {r("rr", 4)} AS correlation,
       CASE WHEN rr IS NULL THEN 'undefined' WHEN abs(rr) < 0.1 THEN 'low' ELSE 'correlated' END AS verdict, n
FROM (SELECT covar_pop(o_custkey, o_totalprice) / nullif(stddev_pop(o_custkey) * stddev_pop(o_totalprice), 0) AS rr,
             count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL) AS n
      FROM orders)"""

# -- deterministic columns of the sink, stream and preview queries -----------------
PREVIEW_JSON = """
SELECT '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}' AS info, '["' || lang || '","' || source || '"]' AS tags, lang
FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 20"""

# the columns of the scoring pass that no model decides (used by its test)
STREAM_ROWS = """
SELECT d.doc_id AS review_id, CAST(CASE WHEN l.quality = 1 THEN 5 WHEN l.quality = 0 THEN 1 END AS INTEGER) AS true_stars,
       CAST(l.quality AS INTEGER) AS true_sentiment, CAST(length(d.text) AS INTEGER) AS n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL"""

TEXT_PREVIEWS = """
SELECT doc_id AS review_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS text_preview,
       CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS true_label
FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 10"""

EXTREME_REVIEWS = """
SELECT CAST(CASE WHEN quality = 1 THEN 5 ELSE 1 END AS INTEGER) AS stars, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY 1"""

SAMPLE_COUNT = """
SELECT least(100, count(*)) AS n, least(100, count(DISTINCT doc_id)) AS n_keys FROM documents JOIN labels USING (doc_id)"""

TOP_PER_LANG = """
SELECT lang, doc_id, n_chars FROM (
  SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)
WHERE k <= 3"""

TOP_CITIES = """
SELECT c_nationkey AS city, count(*) AS business_count FROM customer GROUP BY c_nationkey
ORDER BY business_count DESC, city LIMIT 15"""

LITERAL_FLAGS = """
SELECT o_orderpriority = '1-URGENT' AS urgent, o_orderstatus = 'F' AS closed, false AS absent, count(*) AS n
FROM orders GROUP BY 1, 2"""

#: Pairs of a literal of the orders: flat keys and one inner literal.
LITERAL_MAP = """
SELECT key, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS n_true, CAST(count(*) FILTER (WHERE NOT v) AS BIGINT) AS n_false,
       CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS n_null
FROM (SELECT 'urgent' AS key, o_orderpriority = '1-URGENT' AS v FROM orders
      UNION ALL SELECT 'status.closed', o_orderstatus = 'F' FROM orders
      UNION ALL SELECT 'status.open', CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'O' END FROM orders)
GROUP BY key"""


def letter_values_sql() -> str:
    """Order statistics at the letter values' probabilities (the sketch is exact up to its accuracy in rows)."""
    return f"""
WITH u AS (SELECT review_count AS x FROM ({USERS}) WHERE review_count IS NOT NULL),
n AS (SELECT count(*) AS n FROM u),
d AS (SELECT unnest(range(1, greatest(1, CAST(floor(log2(n)) AS BIGINT) - 2) + 1)) AS depth, n FROM n),
p AS (SELECT depth, n, 1 / pow(2, depth) AS p FROM d UNION ALL SELECT depth, n, 1 - 1 / pow(2, depth) FROM d WHERE depth > 1),
s AS (SELECT x, row_number() OVER (ORDER BY x) AS rank FROM u),
v AS (SELECT p.depth, p.p, p.n, s.x FROM p JOIN s ON s.rank = greatest(1, CAST(ceil(p.p * p.n) AS BIGINT)))
SELECT CAST(depth AS INTEGER) AS depth, p AS probability, CAST(x AS DOUBLE) AS value, n,
       (SELECT count(*) FROM u WHERE u.x < v.x) AS n_below, (SELECT count(*) FROM u WHERE u.x <= v.x) AS n_up_to
FROM v"""


_TERMS = f"""
toks AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '\\s+$', ''), '\\s'),
                                           lambda t: NOT list_contains({_STOP}, t))) AS term FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, term, CAST(CAST('0x' || substr(md5(term), 1, 13) AS BIGINT) % 10000 AS INTEGER) AS bucket FROM toks),
n AS (SELECT count(*) AS n_docs FROM documents WHERE text IS NOT NULL)"""

HASHED_TFIDF = f"""WITH {_TERMS},
tf AS (SELECT doc_id, bucket, count(*) AS tf FROM b GROUP BY doc_id, bucket),
df AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket)
SELECT doc_id, bucket, tf, {r("tf * ln(CAST(n_docs + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE))", 6)} AS weight
FROM tf JOIN df USING (bucket), n"""

BUCKET_COLLISIONS = f"""WITH {_TERMS}
SELECT bucket, count(DISTINCT term) AS n_terms, count(DISTINCT doc_id) AS n_docs, count(*) AS n_tokens FROM b GROUP BY bucket"""

#: Lines of the drifting export: a tenth is cut short, a fifth has a field the schema does not know.
DRIFT_COUNTS = f"""
SELECT CAST(count(*) FILTER (WHERE u >= 0.1) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE u < 0.1) AS BIGINT) AS quarantined,
       CAST(sum(CASE WHEN u >= 0.1 THEN c_custkey END) AS BIGINT) AS good_keys
FROM (SELECT c_custkey, {unit_sql(['c_custkey'], 7)} AS u FROM customer)"""

DRIFT_FIELDS = f"""
SELECT 'legacy_code' AS field, 'unknown' AS kind, CAST(count(*) AS BIGINT) AS n
FROM (SELECT {unit_sql(['c_custkey'], 7)} AS u FROM customer) WHERE u >= 0.8
UNION ALL SELECT 'fans', 'missing', CAST(count(*) AS BIGINT) FROM (SELECT {unit_sql(['c_custkey'], 7)} AS u FROM customer) WHERE u >= 0.1"""
