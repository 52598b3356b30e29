"""Queries for sums, filters, projections, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as W
from ..operators import aggregate as A
from ..operators import filters as P
from ..operators import lookup as J
from ..streaming import adapters as S
from .registry import query, table


@query("""
SELECT l.l_partkey, coalesce(p.p_name, 'Item ' || l.l_partkey) AS name, l.qty FROM
  (SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey) l
  LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) p ON p.p_partkey = l.l_partkey
""")
def inventory_sum(spark, d):
    """A1, J3, O3."""
    sums = A.inventory(table(spark, d, "lineitem"), "l_partkey", "l_quantity").withColumnRenamed("l_quantity", "qty")
    names = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    named = J.resolve(sums, names, ["l_partkey"], "name", F.concat(F.lit("Item "), F.col("l_partkey").cast("string")))
    return named.select("l_partkey", "name", "qty").orderBy(F.desc("qty"), "l_partkey")


@query("""
SELECT l_partkey AS id, sum(l_quantity) AS n FROM (
  SELECT l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'O' UNION ALL
  SELECT l_partkey, l_quantity FROM lineitem WHERE l_linestatus = 'F' UNION ALL
  SELECT p_partkey, p_size::DOUBLE FROM part) GROUP BY 1
""")
def inventory_merge(spark, d):
    """A2, A3, U1, U3."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("n"), "l_linestatus")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("n"))
    return A.merge_inventories([li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"), part], "id", "n")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_quantity < 40 AS below_minimum FROM lineitem WHERE l_discount >= 0.05 AND l_tax >= 0.02")
def threshold_filter(spark, d):
    """P1, P2."""
    kept = P.at_least(table(spark, d, "lineitem"), l_discount=0.05, l_tax=0.02)
    return P.flag_below(kept, "l_quantity", 40).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "below_minimum")


@query("""
WITH w AS (SELECT unnest(range(0, 30000, 7)) AS o_orderkey)
SELECT o_orderkey, 'found' AS state FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM w) AND o_orderkey >= 70 AND o_orderkey < 9000
UNION ALL SELECT o_orderkey, 'missing' FROM w WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)
""")
def id_range_and_missing(spark, d):
    """P3, P4, P6, J17, U5."""
    orders = table(spark, d, "orders").select("o_orderkey")
    found, missing = P.pick_ids(orders, "o_orderkey", spark.range(0, 30000, 7).toDF("o_orderkey"))
    return P.half_open(found, "o_orderkey", 70, 9000).withColumn("state", F.lit("found")).unionByName(missing.withColumn("state", F.lit("missing")))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand')")
def text_search(spark, d):
    """The match spans two fields."""
    return P.search(table(spark, d, "part"), "  Ring BRAND ", "p_name", "p_brand", "p_type").select("p_partkey", "p_name")


@query("SELECT c_custkey, regexp_extract(c_name, '^Customer#0*([0-9])', 1) AS category FROM customer WHERE regexp_matches(c_name, '^Customer#0*[1-9]') AND regexp_extract(c_name, '^Customer#0*([1-9])', 1) <> ''")
def regex_extract_category(spark, d):
    """P7, P8."""
    return P.categorised(table(spark, d, "customer"), "c_name", "Customer#0*([1-9])").select("c_custkey", "category")


@query("""
SELECT p_partkey, regexp_replace(p_name, '[^a-m ]', '', 'g') AS kept, 'strict' AS kind FROM part WHERE regexp_replace(p_name, '[^a-m ]', '', 'g') <> ''
UNION ALL SELECT p_partkey, regexp_replace(p_type, '[^A-E]', '', 'g'), 'loose' FROM part
""")
def character_filters(spark, d):
    """P9, P11."""
    part = table(spark, d, "part")
    strict = P.only_allowed(part.select("p_partkey", F.col("p_name").alias("kept")), "kept", "a-m ")
    loose = P.only_allowed(part.select("p_partkey", F.col("p_type").alias("kept")), "kept", "A-E", keep_empty=True)
    return strict.withColumn("kind", F.lit("strict")).unionByName(loose.withColumn("kind", F.lit("loose")))


@query("""
WITH c AS (SELECT DISTINCT unnest(string_split(p_name || p_type, '')) AS c FROM part), e AS (
  SELECT DISTINCT unnest([c, lower(c), upper(c)]) AS c FROM c WHERE c <> '')
SELECT string_agg(c, '' ORDER BY c) AS allowed FROM e
""")
def allowlist(spark, d):
    """P10."""
    return P.allowlist(table(spark, d, "part").select(F.concat("p_name", "p_type").alias("t")), "t")


@query("""
SELECT p_partkey, (p_size BETWEEN 1 AND 20 AND p_retailprice BETWEEN 900 AND 950 OR p_size BETWEEN 30 AND 40 AND p_retailprice BETWEEN 940 AND 1000)
  AND NOT (p_size BETWEEN 5 AND 6 AND p_retailprice BETWEEN 0 AND 2000) AS masked FROM part
""")
def colour_mask(spark, d):
    """P12 on two channels."""
    mask = P.colour_mask([F.col("p_size"), F.col("p_retailprice")], [((1, 900), (20, 950)), ((30, 940), (40, 1000))], [((5, 0), (6, 2000))])
    return table(spark, d, "part").select("p_partkey", mask.alias("masked"))


@query("""
SELECT page_id, p AS path, NOT regexp_matches(p, '^[/\\\\]') AND NOT regexp_matches(p, '^[A-Za-z]:') AND NOT regexp_matches(p, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AND lower(p) LIKE '%.png' AS safe
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b' || page_id || '.PNG' WHEN 1 THEN '/abs.png' WHEN 2 THEN 'x/../y.png' WHEN 3 THEN 'C:\\z.png' ELSE 'a/b.html' END AS p FROM pages)
""")
def safe_paths(spark, d):
    """P13."""
    n = F.col("page_id") % 5
    p = F.when(n == 0, F.concat(F.lit("a/b"), F.col("page_id").cast("string"), F.lit(".PNG"))).when(n == 1, "/abs.png").when(n == 2, "x/../y.png").when(n == 3, "C:\\z.png").otherwise("a/b.html")
    return table(spark, d, "pages").select("page_id", p.alias("path")).withColumn("safe", T.safe_relative_path("path"))


@query("""
SELECT event_id, json_keys(props)[1] AS key, json_extract_string(props, '$.k') AS value FROM events WHERE len(json_keys(props)) = 1
""")
def single_key_flatten(spark, d):
    """P15, S3."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return P.single_key(e, "m").select("event_id", "key", "value")


@query("""
SELECT 'page' AS source, page_id AS id, CASE WHEN contains(url, 'casino') OR contains(url, 'bets') THEN 'suspect' WHEN contains(html, '<article') THEN 'article' ELSE 'unknown' END AS kind FROM pages
UNION ALL SELECT 'event', event_id, CASE WHEN event_type LIKE 's%' THEN 'start' WHEN json_extract(props, '$.k') IS NOT NULL THEN 'keyed' ELSE 'unknown' END FROM events
""")
def kind_classify(spark, d):
    """The name first, then the structure, in fixed order."""
    url = F.col("url")
    page = P.first_kind([(url.contains("casino") | url.contains("bets"), "suspect"), (F.col("html").contains("<article"), "article")])
    event = P.first_kind([(F.col("event_type").startswith("s"), "start"), (F.get_json_object("props", "$.k").isNotNull(), "keyed")])
    p = table(spark, d, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), page.alias("kind"))
    return p.unionByName(table(spark, d, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), event.alias("kind")))


@query("""
SELECT o_orderkey AS ref, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS state, o_custkey::VARCHAR AS owner,
  CASE WHEN o_totalprice > 300000 AND o_orderpriority LIKE '1%' THEN substr(o_orderpriority, 3) END AS refinement FROM orders
""")
def record_projection(spark, d):
    """P17, P18, P19, P20, P21."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("ref"), P.with_default(F.col("o_orderstatus"), "pending", "P").alias("state"), F.col("o_custkey").cast("string").alias("owner"),
        F.when((F.col("o_totalprice") > 300000) & F.col("o_orderpriority").startswith("1"), F.substr("o_orderpriority", F.lit(3))).alias("refinement"),
    )


@query("""
SELECT doc_id, i - 1 AS line_no, l AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE contains(lower(l), 'license') ORDER BY doc_id, i LIMIT 50
""")
def content_lines(spark, d):
    """A top-k report."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.filter(F.lower("line").contains("license")).orderBy("doc_id", "line_no").limit(50)


@query("""
SELECT c_custkey, i AS ord, line FROM (SELECT c_custkey, unnest([0, 1, 2]) AS i,
  unnest(['Name: ' || c_name, 'Segment: ' || nullif(c_mktsegment, 'BUILDING'), 'Nation: ' || c_nationkey]) AS line FROM customer) WHERE line IS NOT NULL
""")
def unpivot_lines(spark, d):
    """P25."""
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return P.unpivot_lines(c, ["c_custkey"], {"c_name": "Name", "c_mktsegment": "Segment", "c_nationkey": "Nation"})


@query("""
SELECT vec_id, list_sum(embedding[5:8])::DOUBLE AS crop FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE * 1000)) AS embedding FROM embeddings)
""")
def array_crop(spark, d):
    """A slice of an array."""
    v = F.transform(F.slice("embedding", 5, 4), lambda x: F.round(x.cast("double") * 1000))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("crop"))


@query("""
SELECT event_id, u AS user_id, t AS event_type, coalesce(k, -1) AS k FROM (SELECT event_id, user_id AS u, event_type AS t, json_extract(props, '$.k')::BIGINT AS k FROM events)
""")
def record_round_trip(spark, d):
    """Record to JSON and back, with typed defaults and dotted paths."""
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct("user_id", "event_type", F.from_json("props", "k bigint").alias("props"))).alias("j"))
    back = F.from_json("j", "user_id bigint, event_type string, props struct<k:bigint>")
    return e.select("event_id", back.alias("b")).select("event_id", "b.user_id", "b.event_type", F.coalesce("b.props.k", F.lit(-1)).alias("k"))


@query("""
SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 40 THEN NULL ELSE p_size END NULLS LAST, p_name, p_partkey) - 1 AS position FROM part
""")
def sort_nulls_last(spark, d):
    """Positions of all rows, counted by ranges of the order."""
    p = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("s"))
    return W.numbered(p, [F.col("s").asc_nulls_last(), F.col("p_name"), F.col("p_partkey")], S.work_folder(spark)).select("p_partkey", "position")


@query("""
SELECT 'nation' AS section, 0 AS section_ord, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', 1, r_regionkey, r_name FROM region
UNION ALL SELECT 'supplier', 2, s_suppkey, s_name FROM supplier
""")
def concat_sections(spark, d):
    """U1."""
    parts = [("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("supplier", "s_suppkey", "s_name")]
    return J.concat_sections([(t, table(spark, d, t).select(F.col(k).cast("bigint").alias("id"), F.col(n).alias("name"))) for t, k, n in parts])


@query("""
SELECT count(*) FILTER (WHERE e AND p) AS present, count(*) FILTER (WHERE p IS NULL) AS missing, count(*) FILTER (WHERE e IS NULL) AS stale FROM
 (SELECT DISTINCT o_custkey AS k, true AS e FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT c_custkey AS k, true AS p FROM customer WHERE c_nationkey < 20) USING (k)
""")
def key_coverage(spark, d):
    """U4, U7, A12."""
    want = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("k"))
    return J.coverage(want, table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("k")), "k")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus FROM (SELECT *, max(l_linestatus = 'F') OVER (PARTITION BY l_orderkey) AS has FROM lineitem) WHERE NOT (has AND l_linestatus = 'O')
""")
def section_precedence(spark, d):
    """An order's finished lines suppress its open ones."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    return J.unless_present(li, "l_linestatus", "F", ["O"], ["l_orderkey"])


@query("SELECT event_type, user_id FROM (SELECT event_type, user_id, min(event_id) AS o FROM events GROUP BY 1, 2) ORDER BY o LIMIT 40")
def ordered_distinct(spark, d):
    """U8."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("o"))
    return e.orderBy("o").limit(40).select("event_type", "user_id")
