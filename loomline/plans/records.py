"""Queries for lookups, aggregates, windows, validation, matching, caches, exports and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as JS
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import export as X
from ..operators import incremental as C
from ..operators import layout as W
from ..operators import lookup as J
from ..operators import match as M
from ..operators import records as G
from ..operators import validate as V
from ..sources import readers as R
from ..streaming import adapters as S
from .registry import query, table

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


# Lookups


@query("""
SELECT n_nationkey, n_name, r_name, 'joined' AS state FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3
UNION ALL SELECT n_nationkey, n_name, NULL, 'missing' FROM nation WHERE n_regionkey >= 3
""")
def catalog_locale_join(spark, d):
    """J1, J2, J4, J6."""
    locale = table(spark, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    hit, miss = J.matched_and_missing(table(spark, d, "nation"), locale, ["n_regionkey"])
    cols = ["n_nationkey", "n_name", "r_name", "state"]
    return hit.withColumn("state", F.lit("joined")).select(cols).unionByName(miss.withColumns({"r_name": F.lit(None).cast("string"), "state": F.lit("missing")}).select(cols))


@query("""
SELECT o_orderkey, coalesce(c.c_name, n.n_name, 'Order ' || o_orderkey) AS label FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) n ON n_nationkey = o_custkey % 25
""")
def fallback_resolve(spark, d):
    """Key, then a second key, then a made name."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).cast("int").alias("n_nationkey"))
    first = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    second = table(spark, d, "nation").filter("n_nationkey < 12")
    out = J.resolve_chain(o, [(first, "o_custkey", "c_name"), (second, "n_nationkey", "n_name")], "label", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")))
    return out.select("o_orderkey", "label")


@query("""
SELECT alias, min_by(p_partkey, p_partkey) AS p_partkey, count(*) AS claims, count(DISTINCT p_partkey) > 1 AS conflict
FROM (SELECT replace(lower(trim(p_name)), ' ', '') AS alias, p_partkey FROM part) GROUP BY 1
""")
def alias_first_wins(spark, d):
    """A7, A8, J15."""
    p = table(spark, d, "part").select(T.squash("p_name").alias("alias"), "p_partkey")
    return J.alias_owners(p, "alias", "p_partkey", ["p_partkey"])


@query("""
SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def last_wins_merge(spark, d):
    """A6, A22, S7."""
    return J.last_wins(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("""
SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS kind, arg_min(value, event_id) FILTER (WHERE value > 100) AS value FROM events GROUP BY user_id
""")
def field_first_wins(spark, d):
    """A5: of each field the first value that is there."""
    e = table(spark, d, "events").select("user_id", "event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("value") > 100, F.col("value")).alias("value"))
    return J.merge_fields(e, ["user_id"], ["kind", "value"], ["event_id"])


@query("""
WITH u AS (SELECT p_partkey AS k, p_name AS v, 0 AS layer FROM part UNION ALL SELECT p_partkey, p_type, 1 FROM part WHERE p_size > 30 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier WHERE s_suppkey % 3 = 0)
SELECT k, arg_max(v, layer) AS v FROM u GROUP BY k
""")
def override_union(spark, d):
    """U2."""
    p = table(spark, d, "part")
    layers = [p.selectExpr("p_partkey k", "p_name v"), p.filter("p_size > 30").selectExpr("p_partkey k", "p_type v"), table(spark, d, "supplier").filter("s_suppkey % 3 = 0").selectExpr("s_suppkey k", "s_name v")]
    return J.override_union(layers, ["k"])


@query("""
SELECT coalesce(c.c_custkey, o.k) AS k, c.c_custkey IS NULL AS created, coalesce(o.n, 0) AS n FROM (SELECT * FROM customer WHERE c_nationkey < 10) c
FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) o ON o.k = c.c_custkey
""")
def owners_full_join(spark, d):
    """Owners that don't exist yet are created."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("k"), F.lit(True).alias("known"))
    return c.join(n, "k", "full_outer").select("k", F.col("known").isNull().alias("created"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_linestatus = 'O'),
v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_linestatus = 'F')
SELECT n.l_orderkey, n.i, n.l_partkey AS name_part, v.l_quantity AS value FROM n JOIN v USING (l_orderkey, i)
""")
def positional_zip(spark, d):
    """Truncated to the shorter side."""
    li = table(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy(*_LINE_ORDER)))
    n = li.filter("l_linestatus = 'O'").select("l_orderkey", "i", F.col("l_partkey").alias("name_part"))
    return n.join(li.filter("l_linestatus = 'F'").select("l_orderkey", "i", F.col("l_quantity").alias("value")), ["l_orderkey", "i"])


@query("""
WITH refs(w, h, ord) AS (VALUES (10, 900, 0), (25, 930, 1), (40, 960, 2)), r AS (SELECT p_partkey, w, h, abs(p_size - w) + abs(p_retailprice - h) AS dist, ord FROM part, refs)
SELECT p_partkey, arg_min(w, [dist, ord]) AS base, min(dist) AS distance FROM r GROUP BY 1
""")
def nearest_layout(spark, d):
    """Nearest base by L1, the first on ties."""
    refs = spark.sql("SELECT * FROM VALUES (10, 900, 0), (25, 930, 1), (40, 960, 2) AS t(w, h, ord)")

    def dist(r):
        return F.abs(F.col("p_size") - r["w"]) + F.abs(F.col("p_retailprice") - r["h"])

    return J.nearest(table(spark, d, "part"), refs, dist, ["p_partkey"], "w", "ord").withColumnRenamed("w", "base")


# Aggregates


@query("""
WITH t AS (SELECT l_partkey AS id, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY 1),
r AS (SELECT id, total, unnest(range(0, CASE WHEN id % 5 = 0 THEN 2 ELSE (total + 199) // 200 END)) AS ord FROM t), w AS (
SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY ord) AS i FROM r)
SELECT id, ord, CASE WHEN n > 1 AND total > 200 AND n = (total + 199) // 200 THEN CASE WHEN i < n THEN 200 ELSE total - (n - 1) * 200 END ELSE total END AS count FROM w
""")
def stack_reconstruct(spark, d):
    """A4."""
    t = A.inventory(table(spark, d, "lineitem"), "l_partkey", "l_quantity").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("bigint").alias("count"))
    n = F.when(F.col("id") % 5 == 0, 2).otherwise(F.ceil(F.col("count") / 200)).cast("int")
    rows = t.withColumn("ord", F.explode(F.sequence(F.lit(0), n - 1))).select("id", "ord", "count")
    return A.restack(rows, "id", "count", ["ord"], t.select("id", F.lit(200).cast("bigint").alias("cap")))


@query("""
SELECT r_name AS kind, count(n_nationkey) AS n FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_regionkey = r_regionkey GROUP BY 1
""")
def counts_by_kind(spark, d):
    """Kinds without rows are kept."""
    named = table(spark, d, "nation").filter("n_regionkey < 3").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("kind"))
    return A.counts_by_kind(named, "kind", table(spark, d, "region").select(F.col("r_name").alias("kind")))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS whole, coalesce(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*), 0), 1.0) AS progress,
  count(*) FILTER (WHERE o_totalprice > 250000) AS large FROM orders GROUP BY 1
""")
def progress_counts(spark, d):
    """A10, A13."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(done.alias("done"), F.count("*").alias("whole"), A.share(done, F.count("*")).alias("progress"), F.count_if(F.col("o_totalprice") > 250000).alias("large"))


@query("""
SELECT event_type, count(*) FILTER (WHERE value < 50) AS memory_hits, count(*) FILTER (WHERE value >= 50 AND value < 150) AS store_hits, count(*) FILTER (WHERE value >= 150) AS misses,
  round(100.0 * count(*) FILTER (WHERE value < 150) / count(*), 2) AS hit_pct, round(sum(value), 2) AS saved, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1
""")
def cache_report(spark, d):
    """A11, C5."""
    v = F.col("value")
    us = F.unix_micros(F.max("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(v < 50).alias("memory_hits"), F.count_if((v >= 50) & (v < 150)).alias("store_hits"), F.count_if(v >= 150).alias("misses"),
        F.round(100.0 * F.count_if(v < 150) / F.count("*"), 2).alias("hit_pct"), F.round(F.sum("value"), 2).alias("saved"), us.alias("last_us"),
    )


@query("SELECT label, pos - 1 AS pos, round(median(v), 6) AS median FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2")
def group_median_vector(spark, d):
    """A14, A15."""
    return A.grouped_median(table(spark, d, "embeddings"), "label", "embedding").withColumn("median", F.round("median", 6))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def hash_dedup(spark, d):
    """A17."""
    return A.keep_first_copy(table(spark, d, "documents"), F.col("text").cast("binary"), "doc_id")


@query("""
SELECT l_orderkey, max(l_partkey) FILTER (WHERE i = 1) AS slot0, max(l_partkey) FILTER (WHERE i = 2) AS slot1, max(l_partkey) FILTER (WHERE i = 3) AS slot2, max(l_partkey) FILTER (WHERE i = 4) AS slot3,
  max(l_partkey) FILTER (WHERE i = 5) AS slot4 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem) WHERE i <= 5 GROUP BY 1
""")
def group_top5_slots(spark, d):
    """A18, A19."""
    return A.slots(table(spark, d, "lineitem"), ["l_orderkey"], [F.col(c) for c in _LINE_ORDER], "l_partkey", 5, "slot")


@query("""
SELECT conv_id, arg_max(role, turn) AS role, arg_max(length(text), turn) AS chars, count(*) AS parts, max(turn) >= 4 AS complete FROM conversations GROUP BY 1
""")
def entity_merge(spark, d):
    """Partial records by key, the last field wins."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max_by(F.length("text"), "turn").cast("bigint").alias("chars"), F.count("*").alias("parts"), (F.max("turn") >= 4).alias("complete"))


@query("""
SELECT sha256(count(*) || ':' || sum(('0x' || substr(sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}'), 1, 15))::HUGEINT)) AS fingerprint FROM nation
""")
def table_fingerprint(spark, d):
    """A21."""
    return A.fingerprint(table(spark, d, "nation"), ["n_nationkey", "n_name"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount < 0.09")
def drop_failed(spark, d):
    """A23."""
    return table(spark, d, "lineitem").filter("l_quantity is not null and l_discount < 0.09").select(*_LINE)


@query("""
SELECT user_id, string_agg(event_type, ' ' ORDER BY event_id) AS text, round(avg(value), 4) AS conf FROM events GROUP BY 1
""")
def ordered_text(spark, d):
    """A24."""
    return A.ordered_text(table(spark, d, "events"), "user_id", ["event_id"], "event_type", "value")


@query("""
SELECT l_returnflag, min(l_quantity) AS x, min(l_extendedprice) AS y, max(l_quantity + l_linenumber) - min(l_quantity) AS w, round(max(l_extendedprice + 10) - min(l_extendedprice), 2) AS h,
  count(*) AS hits FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.06 GROUP BY 1
""")
def bounding_box(spark, d):
    """A25, A26, A28."""
    li = table(spark, d, "lineitem").filter("l_discount between 0.03 and 0.06")
    box = A.bounding_box(li, ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_quantity") + F.col("l_linenumber"), F.col("l_extendedprice") + 10)
    return box.withColumn("h", F.round("h", 2)).join(li.groupBy("l_returnflag").agg(F.count("*").alias("hits")), "l_returnflag")


@query("SELECT n_regionkey AS region, coalesce(floor(avg(n_nationkey) FILTER (WHERE n_nationkey > 20)), 128)::BIGINT AS middle FROM nation GROUP BY 1")
def midpoint_or_default(spark, d):
    """A27."""
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.coalesce(F.floor(F.avg(F.when(F.col("n_nationkey") > 20, F.col("n_nationkey")))), F.lit(128)).cast("bigint").alias("middle"))


@query("""
WITH x AS (SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS a, levenshtein(p_name, p_brand) AS b FROM part)
SELECT count(*) FILTER (WHERE a = 0) AS exact, sum(a)::BIGINT AS edits, count(*) FILTER (WHERE b < a) AS improved, count(*) FILTER (WHERE b > a) AS worsened, count(*) FILTER (WHERE a = b) AS unchanged FROM x
""")
def quality_summary(spark, d):
    """A16."""
    x = table(spark, d, "part").select(F.levenshtein("p_name", F.lower("p_type")).alias("a"), F.levenshtein("p_name", "p_brand").alias("b"))
    return x.agg(F.count_if(F.col("a") == 0).alias("exact"), F.sum("a").alias("edits"), F.count_if(F.col("b") < F.col("a")).alias("improved"), F.count_if(F.col("b") > F.col("a")).alias("worsened"), F.count_if(F.col("a") == F.col("b")).alias("unchanged"))


# Windows


@query("""
WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS top, epoch_us(ts) + (value * 1000000)::BIGINT AS bottom FROM events),
n AS (SELECT *, max(bottom) OVER (PARTITION BY user_id ORDER BY top, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM t)
SELECT event_id, user_id, sum(CASE WHEN above IS NULL OR top >= above + 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY top, event_id)::BIGINT AS row_no FROM n
""")
def row_grouping(spark, d):
    """W1."""
    e = table(spark, d, "events").withColumn("top", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("bottom", F.col("top") + F.round(F.col("value") * 1_000_000).cast("bigint"))
    return W.row_groups(e, ["user_id"], F.col("top"), F.col("bottom"), 14_400_000_000, ["top", "event_id"]).select("event_id", "user_id", "row_no")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, max(CASE WHEN nullif(l_quantity, 30) < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem) WHERE s = 0
""")
def take_while(spark, d):
    """A null doesn't stop."""
    return W.take_while(table(spark, d, "lineitem"), ["l_orderkey"], _LINE_ORDER, F.nullif("l_quantity", F.lit(30.0)) < 10).select(*_LINE)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS already_seen FROM events")
def first_seen(spark, d):
    """W5."""
    return W.first_seen(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "already_seen")


@query("""
WITH n AS (SELECT p_partkey, p_partkey AS i, count(*) OVER () AS t FROM part), p AS (SELECT *, i // 24 AS page, (t + 5) // 6 AS lines, ((t + 5) // 6 + 3) // 4 - 1 AS last, i // 6 AS line FROM n)
SELECT p_partkey, page::INT AS page, (CASE WHEN page = last AND last > 0 THEN line - (lines - 4) ELSE line - page * 4 END)::INT AS row, (i % 6)::INT AS col, i AS back FROM p
""")
def grid_position(spark, d):
    """W8 and its inverse."""
    p = table(spark, d, "part").select("p_partkey")
    p = p.join(p.agg(F.count("*").alias("t")), F.lit(True))  # one row
    p = p.withColumns(W.grid_position(F.col("p_partkey"), 4, 6, F.col("t")))
    return p.select("p_partkey", "page", "row", "col", W.grid_index(F.col("page"), F.col("row"), F.col("col"), 4, 6, F.col("t")).alias("back"))


@query("""
SELECT conv_id, coalesce(arg_min(role, turn) FILTER (WHERE role <> 'user'), arg_min(role, turn)) AS shown, arg_min(length(text), turn) AS first_chars FROM conversations GROUP BY 1
""")
def representative(spark, d):
    """The first that isn't the usual one, else the first."""
    by = F.when(F.col("role") != "user", F.col("turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.min_by("role", by), F.min_by("role", "turn")).alias("shown"), F.min_by(F.length("text"), "turn").cast("bigint").alias("first_chars"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of parts as tokens of one image per name, with made positions."""
    words = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand"))
    p = table(spark, d, "part").select("p_partkey", F.posexplode(words).alias("ord", "text"))
    return p.withColumn("y", F.col("ord") * 7.0 + F.col("p_partkey") % 5 * F.col("ord"))


@query("""
WITH RECURSIVE w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS text, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS ord FROM part UNION ALL SELECT p_partkey, p_type, 2 FROM part UNION ALL SELECT p_partkey, p_brand, 3 FROM part),
t AS (SELECT p_partkey, ord, ord * 7.0 + p_partkey % 5 * ord AS y, row_number() OVER (PARTITION BY p_partkey ORDER BY ord * 7.0 + p_partkey % 5 * ord, ord) AS rn FROM w),
r AS (SELECT p_partkey, rn, y AS a, 1 AS n FROM t WHERE rn = 1 UNION ALL SELECT t.p_partkey, t.rn, CASE WHEN t.y - r.a > 9 THEN t.y ELSE r.a END, r.n + (t.y - r.a > 9)::INT FROM r JOIN t ON t.p_partkey = r.p_partkey AND t.rn = r.rn + 1)
SELECT p_partkey, string_agg(n::VARCHAR, ',' ORDER BY rn) AS rows FROM r GROUP BY 1
""")
def anchored_rows(spark, d):
    """W2."""
    t = _tokens(spark, d).groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("y", "ord", "text"))).alias("t"))
    return t.select("p_partkey", F.array_join(F.transform(W.anchored_rows(F.col("t"), 9.0), lambda x: x.cast("string")), ",").alias("rows"))


@query("""
WITH RECURSIVE t AS (SELECT l_orderkey AS k, list(['crit', 'ra te', 'rate', 'dmg', 'zz'][l_partkey % 5 + 1] ORDER BY l_linenumber, l_partkey, l_suppkey) AS raw FROM lineitem GROUP BY 1),
r AS (SELECT k, list_transform(raw, lambda x: replace(x, ' ', '')) AS w, 1 AS i, []::VARCHAR[] AS out FROM t
  UNION ALL SELECT k, w, CASE WHEN list_contains(['critrate', 'dmg', 'rate'], w[i] || w[i + 1]) THEN i + 2 ELSE i + 1 END,
   CASE WHEN list_contains(['critrate', 'dmg', 'rate'], w[i] || w[i + 1]) THEN list_append(out, w[i] || w[i + 1]) WHEN list_contains(['critrate', 'dmg', 'rate'], w[i]) THEN list_append(out, w[i]) ELSE out END FROM r WHERE i <= len(w))
SELECT k AS l_orderkey, array_to_string(out, '|') AS names FROM r WHERE i > len(w)
""")
def known_name_merge(spark, d):
    """W3."""
    known = F.array(F.lit("critrate"), F.lit("dmg"), F.lit("rate"))
    words = F.array(*[F.lit(x) for x in ("crit", "ra te", "rate", "dmg", "zz")])
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(*_LINE_ORDER).alias("o"), F.get(words, (F.col("l_partkey") % 5).cast("int")).alias("w"))
    t = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "w"))), lambda x: x["w"]).alias("t"))
    return t.select("l_orderkey", F.array_join(W.merge_known(F.col("t"), known), "|").alias("names"))


@query()
def wrapped_names(spark, d):
    """A row without a known name is read with the next one."""
    known = F.array(F.lit("critrate"), F.lit("dmgbonus"), F.lit("hp"))
    words = F.array(*[F.lit(x) for x in ("crit", "rate", "dmg", "bonus", "hp", "zz")])

    def word(c):
        return F.get(words, (F.col(c) % 6).cast("int"))

    li = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.struct(*_LINE_ORDER).alias("o"), F.array(word("l_partkey"), word("l_suppkey")).alias("tokens")).alias("r"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("t"))
    rows = rows.select("l_orderkey", F.transform("t", lambda r: F.struct(r["o"]["l_linenumber"].cast("double").alias("y"), r["tokens"].alias("tokens"))).alias("t"))
    return rows.select("l_orderkey", F.array_join(F.transform(W.merge_wrapped(F.col("t"), known), lambda x: F.concat_ws(":", x["y"].cast("int").cast("string"), x["name"])), "|").alias("names"))


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'O' THEN 'name' ELSE 'value' END AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_quantity AS y, l_partkey::VARCHAR AS text FROM lineitem),
g AS (SELECT k, list({'y': y, 'text': text, 'ord': ord} ORDER BY ord) FILTER (WHERE side = 'value') AS free, list({'y': y, 'text': text} ORDER BY ord) FILTER (WHERE side = 'name') AS names FROM l GROUP BY 1),
r AS (SELECT k, 1 AS i, names, free, NULL::VARCHAR AS name, NULL::VARCHAR AS value FROM g WHERE names IS NOT NULL AND free IS NOT NULL
  UNION ALL SELECT k, i + 1, names, list_filter(free, lambda v: v.ord <> b.ord), names[i].text, b.text
  FROM (SELECT *, list_min(list_transform(free, lambda v: {'d': abs(v.y - names[i].y), 'y': v.y, 'text': v.text, 'ord': v.ord})) AS b FROM r WHERE i <= len(names) AND len(free) > 0))
SELECT k AS l_orderkey, name, value FROM r WHERE i > 1
""")
def greedy_pairs(spark, d):
    """J13."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "O", "name").otherwise("value").alias("side"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)).alias("ord"), F.col("l_quantity").alias("y"), F.col("l_partkey").cast("string").alias("text"))
    return W.greedy_pairs(li, "l_orderkey")


@query("""
WITH t AS (SELECT l_orderkey AS k, l_quantity AS x0, l_quantity + 1 + l_linenumber AS x1, regexp_replace(CASE WHEN l_partkey % 7 = 0 THEN 'x' ELSE l_partkey % 100 || 'x' END, '[^0-9]', '', 'g') AS t, l_discount AS c FROM lineitem),
n AS (SELECT *, row_number() OVER o AS n, lag(x0) OVER o AS a, lag(x1) OVER o AS b FROM t WHERE t <> '' WINDOW o AS (PARTITION BY k ORDER BY x0, x1, -length(t), -c, t)),
s AS (SELECT *, sum(coalesce(least(x1, b) - greatest(x0, a) > 0 AND (least(x1, b) - greatest(x0, a)) / least(greatest(x1 - x0, 1.0), greatest(b - a, 1.0)) >= 0.35, false)::INT) OVER (PARTITION BY k ORDER BY n) AS chain FROM n),
g AS (SELECT k, chain, string_agg(t, '' ORDER BY n) AS t, max(x1) AS x1, max(x1) - min(x0) AS w, sum(c) AS c FROM s GROUP BY 1, 2),
b AS (SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x1 DESC, length(t) DESC, w DESC, c DESC, chain) AS rn FROM g) WHERE rn = 1)
SELECT k AS l_orderkey, coalesce(try_cast(b.t AS BIGINT), 0) AS number FROM (SELECT DISTINCT k FROM t) LEFT JOIN b USING (k)
""")
def digit_chain(spark, d):
    """W9."""
    text = F.when(F.col("l_partkey") % 7 == 0, "x").otherwise(F.concat((F.col("l_partkey") % 100).cast("string"), F.lit("x")))
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 1 + F.col("l_linenumber")).alias("x1"), text.alias("text"), F.col("l_discount").alias("conf"))
    return W.best_chain(li, "l_orderkey")


@query("""
WITH RECURSIVE g AS (SELECT user_id, coalesce(list(value ORDER BY event_id) FILTER (WHERE event_type = 'error'), []) AS kept, coalesce(list(value ORDER BY event_id) FILTER (WHERE event_type <> 'error'), []) AS more FROM events GROUP BY 1),
r AS (SELECT user_id, 1 AS i, kept, more FROM g UNION ALL SELECT user_id, i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k - more[i]) <= 2)) > 0 THEN kept ELSE list_append(kept, more[i]) END, more FROM r WHERE i <= len(more))
SELECT user_id, len(kept)::INT AS kept FROM r WHERE i > len(more)
""")
def spaced_values(spark, d):
    """Values of the first pass stay, others are added where none is near."""

    def those(which):
        return F.transform(F.filter("v", which), lambda x: x["value"])

    v = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("v"))
    return v.select("user_id", F.size(W.spaced(those(lambda x: x["event_type"] == "error"), those(lambda x: x["event_type"] != "error"), 2.0)).alias("kept"))


# Records


@query("""
WITH e AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, p_size AS n, [20, 40, 50, 60, 70, 80, 90, 33][p_size % 8 + 1] AS cap, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS name FROM part)
SELECT k AS p_partkey, CASE WHEN kind = 0 THEN '{"' || k || '":{"level":' || n || ',"rank":2}}' WHEN kind = 1 THEN '{"note":"' || name || '"}'
  ELSE '{"' || k || '":{"level":' || (CASE WHEN kind = 3 THEN 0 ELSE n END) || ',"ascension":' || (CASE cap WHEN 20 THEN 0 WHEN 40 THEN 1 WHEN 50 THEN 2 WHEN 60 THEN 3 WHEN 70 THEN 4 WHEN 80 THEN 5 WHEN 90 THEN 6 ELSE 0 END) || ',"rank":1'
   || (CASE WHEN name <> '' THEN ',"weapon_key":"' || name || '"' ELSE '' END) || ',"maxLevel":' || cap || '}}' END AS record, CASE WHEN kind = 1 THEN '{"note":"' || name || '"}' ELSE k::VARCHAR END AS bare FROM e
""")
def gear_records(spark, d):
    """Rows of both shapes, a level that is no number, and unrecognised ones; the unwrapped id."""
    p = table(spark, d, "part").withColumn("kind", F.col("p_partkey") % 4).withColumn("cap", F.get(F.array(*[F.lit(x) for x in (20, 40, 50, 60, 70, 80, 90, 33)]), F.col("p_size") % 8))
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    keyed = F.to_json(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_size").alias("level"), F.lit(2).alias("rank"))))
    level = F.when(F.col("kind") == 3, "none").otherwise(F.col("p_size").cast("string"))
    modern = F.to_json(F.struct(F.col("p_partkey").alias("id"), name.alias("weapon_key"), level.alias("level"), F.col("cap").alias("maxLevel")))
    other = F.to_json(F.struct(name.alias("note")))
    entry = F.when(F.col("kind") == 0, keyed).when(F.col("kind") == 1, other).otherwise(modern)
    bare = F.when(F.col("kind") == 0, F.col("p_partkey").cast("string")).otherwise(entry)
    return p.select("p_partkey", G.canonical_gear(entry).alias("record"), G.unwrap_id(bare).alias("bare"))


@query("""
SELECT p_partkey, 'basic=' || p_size || (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',forte=' || (p_size + 1) END) || ',intro=' || (p_size // 2) AS talents FROM part
""")
def talent_names(spark, d):
    """P20."""
    half = F.floor(F.col("p_size") / 2).cast("string")
    forte = F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.concat((F.col("p_size") + 1).cast("string"), F.lit(".7")))
    skills = F.create_map(F.lit("normal"), F.col("p_size").cast("string"), F.lit("forte"), forte, F.lit("intro"), half, F.lit("other"), F.lit("9"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(G.talents(skills)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("talents"))


@query("""
WITH s AS (SELECT p_partkey, ['HP', 'Crit. Rate', 'skill%', 'Skill DMG', 'atk', 'basic attack', 'DEF%', 'Odd name', 'hp flat'][p_partkey % 9 + 1] AS n, p_partkey % 9 AS i, p_size % 2 = 0 AS percent, p_size % 3 = 0 AS main FROM part)
SELECT p_partkey, CASE i WHEN 0 THEN CASE WHEN percent OR main THEN 'HP' ELSE 'HP_FLAT' END WHEN 1 THEN 'CritRate' WHEN 2 THEN 'ResonanceSkillDMGBonus' WHEN 3 THEN 'ResonanceSkillDMGBonus'
  WHEN 4 THEN CASE WHEN percent OR main THEN 'ATK' ELSE 'ATK_FLAT' END WHEN 5 THEN CASE WHEN percent THEN 'BasicAttackDMGBonus' ELSE 'BasicAttack' END WHEN 6 THEN 'DEF' WHEN 7 THEN 'OddName' ELSE 'HP_FLAT' END AS token FROM s
""")
def stat_tokens(spark, d):
    """F21."""
    names = F.array(*[F.lit(x) for x in ("HP", "Crit. Rate", "skill%", "Skill DMG", "atk", "basic attack", "DEF%", "Odd name", "hp flat")])
    value = F.when(F.col("p_size") % 2 == 0, "7.5%").otherwise("30")
    return table(spark, d, "part").select("p_partkey", G.stat_token(F.get(names, (F.col("p_partkey") % 9).cast("int")), value, F.col("p_size") % 3 == 0).alias("token"))


@query("""
WITH o AS (SELECT l_returnflag AS section, l_partkey AS id, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), w AS (SELECT l_returnflag AS section, l_partkey AS id, sum(l_linenumber)::BIGINT AS n FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'N' GROUP BY 1, 2)
SELECT section, id, sum(n)::BIGINT AS n FROM (SELECT * FROM o WHERE section = 'A' UNION ALL SELECT * FROM w WHERE section = 'A') GROUP BY 1, 2
UNION ALL SELECT * FROM w WHERE section <> 'A' UNION ALL SELECT * FROM o WHERE section <> 'A' AND section NOT IN (SELECT section FROM w)
""")
def export_merge(spark, d):
    """One section is summed, the others replaced."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("n"), "l_linestatus")
    old, new = (li.filter(c).groupBy("section", "id").agg(F.sum("n").alias("n")) for c in ("l_linestatus = 'F'", "l_linestatus = 'O' and section <> 'N'"))
    return G.merge_exports(old, new, "section", "id", "n", ["A"])


@query("""
WITH p AS (SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, floor(v::DOUBLE * 1000)::BIGINT AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)), q AS (SELECT vec_id, * FROM (SELECT DISTINCT vec_id FROM embeddings), (VALUES (0, 0), (3, 4), (7, 2)) t(px, py))
SELECT p.vec_id, px AS x, py AS y, round_even(median(v), 0)::BIGINT AS v FROM q JOIN p ON p.vec_id = q.vec_id AND abs(x - px) <= 1 AND abs(y - py) <= 1 GROUP BY 1, 2, 3
""")
def neighbourhood_median(spark, d):
    """Vectors as small images."""
    p = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    p = p.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.floor(F.col("v").cast("double") * 1000).alias("v"))
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (3, 4), (7, 2))]))
    points = table(spark, d, "embeddings").select("vec_id").distinct().select("vec_id", at.alias("p")).select("vec_id", "p.x", "p.y")
    return G.neighbourhood_median(p, points, "vec_id", "v", 1)


@query("SELECT l_orderkey, count(DISTINCT (l_linenumber, l_quantity, l_tax)) AS colours, min(l_linenumber) AS min_r, max(l_linenumber) AS max_r, min(l_quantity) AS min_g, max(l_quantity) AS max_g, min(l_tax) AS min_b, max(l_tax) AS max_b FROM lineitem GROUP BY 1")
def colour_summary(spark, d):
    """A28."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("r"), F.col("l_quantity").alias("g"), F.col("l_tax").alias("b"))
    return G.colour_summary(li, "l_orderkey", ["r", "g", "b"])


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 3 END AS cost FROM part
""")
def inferred_cost(spark, d):
    """The cost that main names tell."""
    names = F.array(*[F.array(*[F.lit(x) for x in n]) for n in (("hp", "cr%"), ("er%", "atk"), ("atk", "cd%"), ("atk", "havoc%", "cr%"), ("atk", "hp%"))])
    return table(spark, d, "part").select("p_partkey", V.infer_cost(F.get(names, (F.col("p_partkey") % 5).cast("int"))).alias("cost"))


# Scalar functions


@query("""
SELECT p_partkey, replace(lower(trim(p_name)), ' ', '') AS squashed, regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]', '', 'g') AS alnum, regexp_replace(lower(p_brand), '[^a-z]', '', 'g') AS az,
  list_aggregate(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS camel,
  regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS number, least(25, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT) AS capped, coalesce(try_cast(regexp_replace(p_type, '[^0-9]', '', 'g') AS BIGINT), 0) AS digits,
  CASE p_size WHEN 20 THEN 0 WHEN 40 THEN 1 WHEN 50 THEN 2 ELSE 0 END AS step, substr(sha1(p_name || '#' || p_partkey), 1, 10) AS short FROM part
""")
def text_functions(spark, d):
    """§2.8 normal forms, parsing and hashes."""
    levels = [20, 40, 50, 60, 70, 80, 90]
    return table(spark, d, "part").select(
        "p_partkey", T.squash("p_name").alias("squashed"), T.alnum_key("p_brand").alias("alnum"), T.az_key("p_brand").alias("az"), T.upper_camel("p_name").alias("camel"), T.first_int("p_brand").alias("number"),
        T.capped_level("p_brand").alias("capped"), T.digits_or_zero("p_type").alias("digits"), T.list_index("p_size", levels).alias("step"), T.short_hash("p_name", "p_partkey").alias("short"),
    )


@query("""
WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || '.5' WHEN 4 THEN p_size || '.00%' ELSE p_name END AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN s::BIGINT ELSE 0 END AS export, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN s::BIGINT END AS item,
  CASE WHEN s = 'true' THEN 1 WHEN regexp_matches(s, '^\\s*[+-]?[0-9]+\\s*$') THEN s::BIGINT END AS viewer, CASE WHEN s <> 'true' THEN try_cast(regexp_extract(s, '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) END AS loose,
  try_cast(rtrim(s, '%') AS DOUBLE) AS num, s LIKE '%\\%' ESCAPE '\\' AS pct FROM v
""")
def coercions(spark, d):
    """§1.4: four that disagree, and stat values."""
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    s = F.when(k == 0, "true").when(k == 1, F.concat(F.lit("-"), size)).when(k == 2, size).when(k == 3, F.concat(size, F.lit(".5"))).when(k == 4, F.concat(size, F.lit(".00%"))).otherwise(F.col("p_name"))
    v = table(spark, d, "part").select("p_partkey", s.alias("s"))
    st = T.stat_value("s")
    return v.select("p_partkey", T.export_int("s", 0).alias("export"), T.item_int("s").alias("item"), T.viewer_int("s").cast("bigint").alias("viewer"), T.loose_number("s").alias("loose"), st["num"].alias("num"), st["is_pct"].alias("pct"))


@query("SELECT event_id, json_extract_string(j, '$.a[1].k') AS second, json_extract_string(j, '$.b') AS b, json_extract_string(j, '$.none') AS miss FROM (SELECT event_id, '{\"a\": [1, ' || props || '], \"b\": \"' || event_type || '\"}' AS j FROM events)")
def json_path(spark, d):
    """§2.8 paths into JSON; a miss is null."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"a": [1, '), F.col("props"), F.lit('], "b": "'), F.col("event_type"), F.lit('"}')).alias("j"))
    return e.select("event_id", JS.path_get(F.col("j"), "a[1].k").alias("second"), JS.path_get(F.col("j"), "b").alias("b"), JS.path_get(F.col("j"), "none").alias("miss"))


@query("SELECT page_id, split_part(l, chr(31), 1) AS a, split_part(l, chr(31), 2) AS b, split_part(l, chr(31), 3) AS c FROM (SELECT page_id, page_id || chr(31) || url || chr(31) || 'x' AS l FROM pages)")
def split_log(spark, d):
    """S19."""
    lines = table(spark, d, "pages").select("page_id", F.concat_ws("\x1f", F.col("page_id").cast("string"), "url", F.lit("x")).alias("l"))
    return R.split_log(lines, "l", ("a", "b", "c")).select(F.col("a").cast("bigint").alias("page_id"), "a", "b", "c")


# Validation


@query("""
WITH x AS (SELECT p_partkey, p_retailprice AS v, [905.0, 925.0, 950.0, 975.0, 995.0]::DOUBLE[] AS tiers FROM part)
SELECT p_partkey, list_min(list_transform(tiers, lambda t: {'d': abs(t - v), 't': t})).t AS tier FROM x
""")
def nearest_tier(spark, d):
    """The first listed tier on ties."""
    tiers = F.array(*[F.lit(x) for x in (905.0, 925.0, 950.0, 975.0, 995.0)])
    return table(spark, d, "part").select("p_partkey", V.nearest_tier(F.col("p_retailprice"), tiers).alias("tier"))


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.09) AS deep, count(DISTINCT l_linenumber) < count(*) AS twice FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus NOT IN ('F', 'O') AS stopped,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN '' ELSE concat_ws(';', CASE WHEN n IS NULL THEN 'no lines' END, CASE WHEN n > 6 THEN 'too many lines' END, CASE WHEN twice THEN 'duplicate line' END, CASE WHEN o_totalprice <= 0 THEN 'no price' END) END AS errors,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status not checked' ELSE concat_ws(';', CASE WHEN n < 2 THEN 'few lines' END, CASE WHEN deep > 0 THEN 'deep discount' END) END AS warnings
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
""")
def rule_validation(spark, d):
    """§2.10: early exits, errors and warnings in order."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.09).alias("deep"), (F.count_distinct("l_linenumber") < F.count("*")).alias("twice"))
    o = table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    stop = ~F.col("o_orderstatus").isin("F", "O")
    n = F.col("n")
    errors = F.concat_ws(";", F.when(n.isNull(), "no lines"), F.when(n > 6, "too many lines"), F.when(F.col("twice"), "duplicate line"), F.when(F.col("o_totalprice") <= 0, "no price"))
    warnings = F.concat_ws(";", F.when(n < 2, "few lines"), F.when(F.col("deep") > 0, "deep discount"))
    return o.select("o_orderkey", stop.alias("stopped"), F.when(stop, "").otherwise(errors).alias("errors"), F.when(stop, "status not checked").otherwise(warnings).alias("warnings"))


@query("""
WITH rec AS (SELECT o_orderkey AS rec_id, [1, 3, 4, 2][o_orderkey % 4 + 1] AS cost, o_orderkey % 27 AS level, CASE WHEN o_orderkey % 9 = 0 THEN 4 ELSE 5 END AS rarity FROM orders),
st AS (SELECT l_orderkey AS rec_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, ['hp', 'atk', 'hp%', 'crit%', 'odd'][l_partkey % 5 + 1] AS name, l_quantity AS v FROM lineitem),
t AS (SELECT *, CASE name WHEN 'hp' THEN least(abs(10 - v), abs(20 - v)) WHEN 'atk' THEN abs(15 - v) WHEN 'hp%' THEN least(abs(7 - v), abs(30 - v)) END AS gap, CASE WHEN suffix(name, '%') THEN 0.4 ELSE 0.5 END AS tol FROM st),
g AS (SELECT rec_id, list({'name': name, 'v': v, 'tol': tol} ORDER BY i) FILTER (WHERE i <= 2) AS m, list({'name': name, 'gap': gap, 'tol': tol} ORDER BY i) FILTER (WHERE i > 2) AS s FROM t GROUP BY 1),
d AS (SELECT rec.*, coalesce(m, []) AS m, coalesce(s, []) AS s, list_transform(coalesce(s, []), lambda x: x.name) AS names, CASE cost WHEN 1 THEN 'hp' ELSE 'atk' END AS fx, CASE cost WHEN 3 THEN 'crit%' ELSE 'hp%' END AS rl, 10.0 + level AS ex, level // 5 AS most FROM rec LEFT JOIN g USING (rec_id)),
c AS (SELECT *, list_filter(m, lambda x: x.name = fx)[1] AS f, list_filter(m, lambda x: x.name <> fx) AS o FROM d),
e AS (SELECT *, rarity <> 5 AS unchecked, CASE WHEN cost NOT IN (1, 3, 4) THEN 'unknown cost' WHEN level NOT BETWEEN 0 AND 25 THEN 'level out of range' END AS stop,
  list_concat([CASE WHEN len(m) <> 2 THEN 'main count' END, CASE WHEN f IS NULL THEN 'fixed main missing' END, CASE WHEN len(o) <> 1 THEN 'other main count' WHEN o[1].name <> rl THEN 'other main not allowed' END, CASE WHEN len(s) > most THEN 'too many subs' END],
   list_concat(list_transform(s, lambda x: CASE WHEN x.gap IS NULL THEN 'unknown sub: ' || x.name END), list_concat(
    list_transform(list_filter(names, lambda n, i: list_position(names, n) = i AND len(list_filter(names, lambda k: k = n)) > 1), lambda n: 'duplicate: ' || n),
    list_transform(s, lambda x: CASE WHEN x.gap > x.tol THEN 'off tier: ' || x.name END)))) AS errors,
  list_concat([CASE WHEN abs(f.v - ex) > f.tol THEN 'fixed main value' END, CASE WHEN o[1].name = rl AND abs(o[1].v - ex) > o[1].tol THEN 'other main value' END, CASE WHEN len(s) < most THEN 'missing subs' END],
   list_transform(s, lambda x: CASE WHEN x.gap > 1e-9 AND x.gap <= x.tol THEN 'near tier: ' || x.name END)) AS warnings FROM c),
x AS (SELECT rec_id, CASE WHEN unchecked THEN '' WHEN stop IS NOT NULL THEN stop ELSE array_to_string(list_filter(errors, lambda x: x IS NOT NULL), ';') END AS errors,
  CASE WHEN unchecked THEN 'rarity not checked' WHEN stop IS NOT NULL THEN '' ELSE array_to_string(list_filter(warnings, lambda x: x IS NOT NULL), ';') END AS warnings FROM e)
SELECT rec_id, errors = '' AS valid, errors, warnings FROM x
""")
def record_validation(spark, d):
    """V1-V11 over records made of orders and their lines, with small rule tables."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rec_id"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4), F.lit(2)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("cost"), (F.col("o_orderkey") % 27).cast("int").alias("level"), F.when(F.col("o_orderkey") % 9 == 0, 4).otherwise(5).alias("rarity"))
    names = F.array(*[F.lit(x) for x in ("hp", "atk", "hp%", "crit%", "odd")])
    li = table(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)))
    s = li.select(F.col("l_orderkey").alias("rec_id"), F.when(F.col("i") <= 2, "main").otherwise("sub").alias("bucket"), F.col("i").alias("ord"), F.element_at(names, (F.col("l_partkey") % 5 + 1).cast("int")).alias("name"), F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "%").otherwise("")).alias("value_raw"))
    rules = spark.sql("SELECT c AS cost, k AS kind, n AS name, l AS level, 10.0D + l AS expected FROM VALUES (1, 'fixed', 'hp'), (1, 'rolled', 'hp%'), (3, 'fixed', 'atk'), (3, 'rolled', 'crit%'), (4, 'fixed', 'atk'), (4, 'rolled', 'hp%') AS t(c, k, n) LATERAL VIEW explode(sequence(0, 25)) AS l")
    sub = spark.sql("SELECT * FROM VALUES ('hp', 0, 10.0D), ('hp', 1, 20.0D), ('atk', 0, 15.0D), ('hp%', 0, 7.0D), ('hp%', 1, 30.0D) AS t(name, tier_ord, tier)")
    most = spark.sql("SELECT id AS level, cast(id / 5 AS int) AS max_subs FROM range(26)").withColumn("level", F.col("level").cast("int"))
    v = V.validate(o, s, rules, sub, most)
    return v.select("rec_id", "valid", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


# Matching


@query("""
WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY 1), x AS (
SELECT vec_id, r.label, round(list_sum(list_transform(list_zip(e.embedding, ref), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 9) AS dist FROM embeddings e, r)
SELECT vec_id, arg_min(label, [dist, label]) AS label, round(min(dist), 6) AS distance FROM x GROUP BY 1
""")
def nearest_reference(spark, d):
    """Against the first vector of each label."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    refs = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("ref"))
    near = J.nearest(e.select("vec_id", "v"), refs, lambda r: F.round(M.squared_distance(F.col("v"), r["ref"]), 9), ["vec_id"], "label", "label")
    return near.withColumn("distance", F.round("distance", 6))


def _label_refs(e):
    return e.filter("label is not null").groupBy("label").agg(F.min_by("v", "vec_id").alias("rv"))


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE - list_avg(embedding::DOUBLE[])) AS c FROM embeddings), r AS (SELECT label AS ref_label, arg_min(c, vec_id) AS rc FROM e WHERE label IS NOT NULL GROUP BY 1), x AS (
SELECT vec_id, ref_label, round(list_dot_product(c, rc) / sqrt(list_dot_product(c, c) * list_dot_product(rc, rc)), 9) AS score FROM e, r)
SELECT vec_id, CASE WHEN max(score) >= 0.2 THEN arg_min(ref_label, [-score, ref_label]) END AS label, round(max(score), 6) AS score FROM x GROUP BY 1
""")
def correlation_best_match(spark, d):
    """The best of all references, rejected below 0.20."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return M.best_by_correlation(e, "vec_id", "v", _label_refs(e), "rv", "label", 0.2).withColumn("score", F.round("score", 6))


@query("""
WITH embeddings AS (SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN label END AS label, embedding FROM main.embeddings), e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE - list_avg(embedding::DOUBLE[])) AS c FROM embeddings), r AS (SELECT label AS ref_label, arg_min(c, vec_id) AS rc FROM e WHERE label IS NOT NULL GROUP BY 1), x AS (
SELECT vec_id, ref_label, round(list_dot_product(c, rc) / sqrt(list_dot_product(c, c) * list_dot_product(rc, rc)), 9) AS score FROM e, r WHERE label IS NULL), b AS (SELECT vec_id, arg_min(ref_label, [-score, ref_label]) AS best, max(score) AS score FROM x GROUP BY 1)
SELECT vec_id, label, 'recorded' AS state, NULL::DOUBLE AS score FROM embeddings WHERE label IS NOT NULL
UNION ALL SELECT vec_id, CASE WHEN score >= 0.5 THEN best END, CASE WHEN score >= 0.5 THEN 'matched' ELSE 'skipped' END, round(score, 6) FROM (SELECT vec_id FROM embeddings WHERE label IS NULL) LEFT JOIN b USING (vec_id)
""")
def correlation_label_fallback(spark, d):
    """Recorded label, else the best reference from 0.50 on, else a reported skip; every seventh vector is without its label."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")).withColumn("label", F.when(F.col("vec_id") % 7 != 0, F.col("label")))
    return M.label_or_best(e, "vec_id", "v", "label", _label_refs(e), "rv", 0.5).withColumn("score", F.round("score", 6))


@query("""
WITH q AS (SELECT DISTINCT substr(p_name, 2) AS t FROM part), n AS (SELECT DISTINCT p_name AS n FROM part), x AS (SELECT t, n, levenshtein(t, n) AS d FROM q, n WHERE levenshtein(t, n) <= 3)
SELECT p_partkey, t AS text, m AS match, d AS distance FROM (SELECT p_partkey, substr(p_name, 2) AS t FROM part) LEFT JOIN (SELECT t, arg_min(n, [d::VARCHAR, n]) AS m, min(d) AS d FROM x GROUP BY 1) USING (t)
""")
def edit_distance_match(spark, d):
    """J7 by edits."""
    p = table(spark, d, "part")
    return M.edit_distance_best_match(p.select("p_partkey", F.substr("p_name", F.lit(2)).alias("text")), "text", p.select("p_name"), "p_name", 3).select("p_partkey", "text", "match", F.col("distance").cast("bigint").alias("distance"))


@query()
def fuzzy_best_match(spark, d):
    """J7, P14."""
    p = table(spark, d, "part")
    return M.fuzzy_best_match(p.select("p_partkey", F.regexp_replace("p_name", "[aeo]", "").alias("text")), "text", p.select("p_name"), "p_name", 0.75)


# Caches, snapshots, exports


def _cache(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("hit_ts"), F.col("event_id").alias("payload"))
    return e.filter("payload % 2 = 0"), e.filter("payload % 2 = 1")


@query("""
SELECT user_id, event_type, payload, 0 + (payload % 2 = 0)::INT AS hit_count FROM (SELECT user_id, event_type, event_id AS payload, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000000 DESC, event_id % 2 DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def cache_upsert(spark, d):
    """C4, S14, S22."""
    old, new = _cache(spark, d)
    best = [J.last_wins(x, ["user_id", "event_type"], ["hit_ts", "payload"]) for x in (old, new)]
    return C.upsert(best[0].withColumn("hit_count", F.lit(1)), best[1].withColumn("hit_count", F.lit(7)), ["user_id", "event_type"], "hit_ts").select("user_id", "event_type", "payload", "hit_count")


@query("""
WITH o AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0)
SELECT r.user_id, r.event_type, o.user_id IS NOT NULL AS hit FROM (SELECT DISTINCT user_id, event_type FROM events) r LEFT JOIN o USING (user_id, event_type)
""")
def cache_lookup(spark, d):
    """C1, C2, C3."""
    e = table(spark, d, "events")
    wanted = e.select("user_id", "event_type").distinct()
    cached = e.filter("event_id % 2 = 0 and event_id % 3 = 0").select("user_id", "event_type").distinct().withColumn("payload", F.lit("x"))
    return C.lookup(wanted, cached, ["user_id"], "event_type", "payload").select("user_id", "event_type", "hit")


@query("SELECT event_id, epoch_us(ts) // 1000000 < 1706486400 - 14 * 86400 AS evicted FROM events")
def ttl_evict(spark, d):
    """C6."""
    e = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    stay, gone = C.evict(e, "s", 1_706_486_400, 14)
    return stay.select("event_id", F.lit(False).alias("evicted")).unionByName(gone.select("event_id", F.lit(True).alias("evicted")))


@query("SELECT DISTINCT p_name, CASE WHEN length(p_name) % 2 = 0 THEN length(p_name) ELSE -length(p_name) END AS payload FROM part")
def compute_misses(spark, d):
    """Only missing keys are computed."""
    p = table(spark, d, "part").select("p_name")
    cached = p.distinct().filter("length(p_name) % 2 = 0").select("p_name", F.length("p_name").cast("bigint").alias("payload"))
    return C.compute_misses(p, cached, ["p_name"], "payload", lambda m: m.withColumn("payload", -F.length("p_name").cast("bigint")))


@query("""
WITH a AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 10 > 1)
SELECT k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.h IS DISTINCT FROM b.h
""")
def snapshot_diff(spark, d):
    """S12, J18, J19."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    a = o.filter("o_orderkey % 10 < 8").select("k", F.md5(F.col("o_orderstatus").cast("binary")).alias("h"))
    b = o.filter("o_orderkey % 10 > 1").select("k", F.md5(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).cast("binary")).alias("h"))
    return C.snapshot_diff(a, b, "k", "h")


@query("""
WITH o AS (SELECT o_custkey AS k, string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}', ',' ORDER BY o_orderkey) AS x FROM orders GROUP BY 1)
SELECT c_custkey AS k, '{"k":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"' || coalesce(',"orders":[' || x || ']', '') || '}' AS json FROM customer LEFT JOIN o ON k = c_custkey
""")
def nested_export(spark, d):
    """S20's nested sections."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return X.nested(c, o, "k", "orders", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("""
WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'German' WHEN 2 THEN 'klingon' WHEN 3 THEN 'French' END AS n FROM documents)
SELECT coalesce(n, 'none') AS name, CASE WHEN n IN ('de', 'fr') THEN n WHEN lower(n) = 'german' THEN 'de' WHEN lower(n) = 'french' THEN 'fr' ELSE 'en' END AS code, count(*) AS n FROM n GROUP BY 1, 2
""")
def language_codes(spark, d):
    """Documents by the code of their language, most of them under names instead of codes."""
    from ..sources.readers import language_code

    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.col("lang")).when(k == 1, "German").when(k == 2, "klingon").when(k == 3, "French")
    rows = table(spark, d, "documents").select(name.alias("name"))
    coded = rows.withColumn("code", language_code(F.col("name"), ["de", "fr"], {"German": "de", "French": "fr"}))
    return coded.groupBy(F.coalesce("name", F.lit("none")).alias("name"), "code").agg(F.count("*").alias("n"))


# Streams, each compared with its batch form


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_routed_batches(spark, d):
    """Micro-batches, routed by type, each type to its own table, the other types to one."""
    folder = S.work_folder(spark)
    kinds = ("click", "view", "other")
    failures: list = []
    handlers = {k: S.append_parquet(f"{folder}/{k}") for k in kinds}
    other = handlers.pop("other")
    S.drain(S.table_stream(spark, d, "events").select("event_type", "value"), S.route("event_type", handlers, lambda *x: failures.append(x), other), folder)
    if failures:
        raise RuntimeError(f"types failed: {failures}")
    out = None
    for k in kinds:
        one = spark.read.option("recursiveFileLookup", True).schema("event_type string, value double").parquet(f"{folder}/{k}").withColumn("event_type", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    """T5: keyed state of what was seen."""
    folder = S.work_folder(spark)
    S.drain(S.table_stream(spark, d, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), S.append_parquet(f"{folder}/out"), folder)
    return spark.read.option("recursiveFileLookup", True).schema("user_id bigint, event_type string").parquet(f"{folder}/out")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) >= 4 AS complete FROM conversations GROUP BY 1")
def stream_entity_merge(spark, d):
    """Partial records merged in state."""
    folder = S.work_folder(spark)
    merged = S.merged_entities(S.table_stream(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role"), "conv_id", "turn", ["role"], 4, "turn")
    S.drain(merged, S.append_parquet(f"{folder}/out"), folder, "update")
    rows = spark.read.option("recursiveFileLookup", True).schema("conv_id bigint, role string, complete boolean").parquet(f"{folder}/out").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("int"))
    return J.last_wins(rows, ["conv_id"], ["batch"]).select("conv_id", "role", "complete")
