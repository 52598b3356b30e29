"""Queries for listings, rescans, icons, nested values, prefixes, field batches, digests, caches that change, and layouts."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as JS
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import batches as B
from ..operators import export as X
from ..operators import icons as I
from ..operators import incremental as C
from ..operators import layout as W
from ..operators import match as M
from ..operators import nested as N
from ..operators import prefixes as P
from ..operators import screens as L
from ..sources import paged, readers, sinks
from ..streaming import adapters as S
from ..streaming import progress, rescan
from .registry import query, table

# Sources and sinks


@query("""
WITH p AS (SELECT page_id, url, page_id // 500 AS listing, row_number() OVER (PARTITION BY page_id // 500 ORDER BY page_id) - 1 AS n FROM pages)
SELECT listing::BIGINT AS listing, (n // 20)::INT AS number, (n % 20)::INT AS ord, page_id, url FROM p
""")
def paged_listing(spark, d):
    """Pages dealt into page files, each with the name of the next, and read back by following them."""
    place = F.row_number().over(Window.partitionBy("listing").orderBy("page_id")) - 1
    p = table(spark, d, "pages").select("page_id", "url", F.expr("div(page_id, 500)").alias("listing")).withColumn("_n", place)
    p = p.withColumn("page", F.expr("div(_n, 20)")).withColumn("_last", F.expr("div(max(_n) over (partition by listing), 20)"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct("page_id", "url").alias("item")))), lambda x: x["item"])
    then = F.when(F.col("page") < F.col("_last"), F.struct(F.concat(F.lit("page="), (F.col("page") + 1).cast("string")).alias("next")))
    body = p.groupBy("listing", "page", "_last").agg(items.alias("all")).select("listing", "page", F.to_json(F.struct(F.struct("all").alias("query"), then.alias("continue"))).alias("value"))
    folder = f"{S.work_folder(spark)}/listings"
    body.repartition("listing").write.partitionBy("listing", "page").text(folder)
    rows = paged.read_listings(spark, folder, items="query.all", cursor="continue.next")
    item = F.from_json("item", "page_id bigint, url string")
    return rows.select(F.substring_index("listing", "=", -1).cast("bigint").alias("listing"), "number", "ord", item["page_id"].alias("page_id"), item["url"].alias("url"))


@query("SELECT r_regionkey, r_name, 0 AS missing FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT -1, 'none', 1")
def json_documents(spark, d):
    """Documents written as JSON, a malformed one among them, and a default for one that is missing."""
    folder = f"{S.work_folder(spark)}/documents"
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    text = F.when(F.col("r_regionkey") % 2 == 0, F.to_json(F.struct("r_regionkey", "r_name"))).otherwise("{broken")
    r.select("r_regionkey", text.alias("value")).repartition(5, "r_regionkey").write.partitionBy("r_regionkey").option("maxRecordsPerFile", 1).text(folder)
    found = readers.json_or_empty(spark, f"{folder}/*/*.txt", "r_regionkey bigint, r_name string").withColumn("missing", F.lit(0))
    absent = readers.json_or_default(spark, f"{folder}/absent.json", "r_regionkey bigint, r_name string", [(-1, "none")]).withColumn("missing", F.lit(1))
    return found.unionByName(absent)


@query("""
SELECT 'own' AS asked, n_nationkey, n_name FROM nation UNION ALL SELECT 'absent', n_nationkey, upper(n_name) || '!' FROM nation
UNION ALL SELECT 'empty', n_nationkey, upper(n_name) || '!' FROM nation
""")
def locale_fallback(spark, d):
    """A locale's own table, the English one where it's missing or empty; where an empty one doesn't fall through, nothing."""
    root = f"{S.work_folder(spark)}/locales"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    for lang, rows in (("de", n), ("en", n.withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!")))), ("fr", n.limit(0))):
        rows.select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("value")), ","), F.lit("]")).alias("value")).coalesce(1).write.text(f"{root}/{lang}/names.json")
    schema = "n_nationkey bigint, n_name string"
    read = lambda lang, **how: readers.locale_or_english(spark, root, lang, "names", schema, **how)
    out = read("de").select(F.lit("own").alias("asked"), "*")
    for asked, rows in (("absent", read("xx")), ("empty", read("fr")), ("kept empty", read("fr", fall_through_empty=False))):
        out = out.unionByName(rows.select(F.lit(asked).alias("asked"), "*"))
    return out


@query("SELECT user_id, arg_max(event_type, event_id) AS content FROM events GROUP BY 1")
def text_tables(spark, d):
    """Lists of (Id, Content), the last one of an id."""
    e = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("Id"), F.col("event_type").alias("Content"))
    return readers.text_table(e).select(F.col("Id").alias("user_id"), F.col("Content").alias("content"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE json_extract_string(props, '$.k') END AS section FROM events")
def section_extract(spark, d):
    """S3: the section where a document has it, else the whole document."""
    e = table(spark, d, "events").select("event_id", "props")
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"data":'), F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    name = F.when(F.col("event_id") % 3 == 0, JS.section(wrapped, "data")).otherwise(JS.section(wrapped, "k"))
    return e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.regexp_replace(name, ":", ": ")).otherwise(name).alias("section"))


@query("SELECT 'nation' AS section, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def section_files(spark, d):
    """One file set a section; absent, failed and empty sections are left out."""
    root = f"{S.work_folder(spark)}/sections"
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    failed = spark.createDataFrame([("broken",)], "error string")
    done = sinks.write_sections({"nation": n, "region": r, "failed": failed, "absent": None, "empty": n.limit(0)}, root)
    out = None
    for name in done:
        one = spark.read.json(f"{root}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT c_custkey % 7 AS part, json_extract_string(e, '$.best') AS best, json_extract_string(e, '$.all') AS all_of FROM (SELECT min(c_custkey) AS c_custkey,
  json_object('best', json_object('n', min(c_name))::VARCHAR, 'all', json_object('c', count(*))::VARCHAR) AS e FROM customer GROUP BY c_custkey % 7)
""")
def envelopes(spark, d):
    """Sections as JSON texts inside one object."""
    c = table(spark, d, "customer").groupBy((F.col("c_custkey") % 7).cast("bigint").alias("part")).agg(F.min("c_name").alias("n"), F.count("*").alias("c"))
    out = None
    for k in range(7):
        one = c.filter(F.col("part") == k)
        e = X.envelope({"best": one.select(F.to_json(F.struct("n")).alias("json")), "all": one.select(F.to_json(F.struct("c")).alias("json"))})
        e = e.select(F.lit(k).cast("bigint").alias("part"), F.get_json_object("envelope", "$.best").alias("best"), F.get_json_object("envelope", "$.all").alias("all_of"))
        out = e if out is None else out.unionByName(e)
    return out


@query("SELECT c_custkey, md5(c_name) AS digest, c_custkey % 10 <> 0 AS kept FROM customer")
def state_round_trip(spark, d):
    """A state saved and replaced by its successor, and whether any planned output is missing from it."""
    path = f"{S.work_folder(spark)}/state"
    c = table(spark, d, "customer").select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("digest"))
    sinks.save_state(c.filter("c_custkey % 10 <> 0"), path)
    first = sinks.load_state(spark, path)
    whole = C.commit_if_complete(c, first, "c_custkey")
    sinks.save_state(c.join(first.select("c_custkey", F.lit(True).alias("kept")), "c_custkey", "left").withColumn("kept", F.coalesce("kept", F.lit(whole))), path)
    return sinks.load_state(spark, path)


def _scans(spark: SparkSession, d: str) -> str:
    """Suppliers as scan folders of their nation's session, each with meta.json, every third one without full.png."""
    root = f"{S.work_folder(spark)}/scans"
    s = table(spark, d, "supplier")
    folder = F.concat(F.lit("2024-01-"), F.lpad((F.col("s_nationkey") + 1).cast("string"), 2, "0"), F.lit("_00-00-00/raw/"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    page = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey"))
    meta = s.select(F.concat(folder, F.lit("/meta.json")).alias("path"), F.to_json(F.struct(F.col("s_suppkey").alias("index"), page.alias("page"))).alias("content"))
    image = s.filter("s_suppkey % 3 <> 0").select(F.concat(folder, F.lit("/full.png")).alias("path"), F.col("s_name").alias("content"))
    sinks.write_files(meta.unionByName(image), root)
    return root


@query("""
SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS folder, s_suppkey AS "index", CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 77 END::BIGINT AS page, 5::BIGINT AS col, NULL AS lacks FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT lpad(s_suppkey::VARCHAR, 6, '0'), NULL, NULL, NULL, 'full.png' FROM supplier WHERE s_suppkey % 3 = 0
""")
def scan_folders(spark, d):
    """Complete scan folders with columns from meta.json, then the manifest, then constants; incomplete ones are reported."""
    root = _scans(spark, d)
    listed = readers.files(spark, root)
    metas = readers.scan_meta(spark, root, "index bigint, page bigint, col bigint", {"page": 77}, {"page": 1, "col": 5}, listed)
    name = F.substring_index("folder", "/", -1).alias("folder")
    lacking = readers.scan_folders(spark, root, listed=listed)[1].select(name, *[F.lit(None).cast("bigint").alias(c) for c in ("index", "page", "col")], F.array_join("lacks", ",").alias("lacks"))
    return metas.select(name, "index", "page", "col", F.lit(None).cast("string").alias("lacks")).unionByName(lacking)


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn IN (0, 1, 3, 4) GROUP BY 1 HAVING count(DISTINCT turn) = 4) GROUP BY 1")
def complete_scans(spark, d):
    """Those that have each needed section."""
    return readers.complete_sections(table(spark, d, "conversations"), "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("n"))


@query("SELECT s AS session, row_number() OVER (ORDER BY s DESC)::INT AS place FROM (SELECT DISTINCT '2024-01-' || lpad((s_nationkey + 1)::VARCHAR, 2, '0') || '_00-00-00' AS s FROM supplier)")
def session_listing(spark, d):
    """Sessions with raw scans, the newest first."""
    found = readers.sessions(spark, _scans(spark, d))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("session"))))  # a row a session


@query("""
WITH f AS (SELECT '2024-01-' || lpad((s_nationkey + 1)::VARCHAR, 2, '0') || '_00-00-00' AS a, lpad(s_suppkey::VARCHAR, 6, '0') AS b, s_suppkey AS k FROM supplier)
SELECT DISTINCT a AS path, 'dir' AS type FROM f UNION ALL SELECT DISTINCT a || '/raw', 'dir' FROM f UNION ALL SELECT a || '/raw/' || b, 'dir' FROM f UNION ALL SELECT a || '/raw/' || b || '/meta.json', 'file' FROM f UNION ALL SELECT a || '/raw/' || b || '/full.png', 'file' FROM f WHERE k % 3 <> 0
""")
def folder_tree(spark, d):
    """Files and folders, relative to the root."""
    return readers.tree(spark, _scans(spark, d)).select("path", "type")


@query("""
SELECT 1 AS run, p_partkey, true AS saved FROM part UNION ALL SELECT 2, p_partkey, false FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 3, p_partkey, true FROM part WHERE p_partkey % 4 = 0
""")
def source_sync(spark, d):
    """All sources, then the changed ones, of which one fails so that nothing is saved, then those again."""
    path = f"{S.work_folder(spark)}/sources"
    p = table(spark, d, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("digest"))
    new = p.withColumn("digest", F.when(F.col("p_partkey") % 4 == 0, F.lit("changed")).otherwise(F.col("digest")))
    out = None
    for run, planned, fetch in ((1, p, lambda x: x), (2, new, lambda x: x.filter("p_partkey % 8 <> 0")), (3, new, lambda x: x)):
        state = sinks.load_state(spark, path)
        todo = planned if state is None else planned.join(state.withColumnRenamed("digest", "_d"), "p_partkey", "left").filter(~F.col("digest").eqNullSafe(F.col("_d"))).select("p_partkey", "digest")
        told = f"{S.work_folder(spark)}/todo"
        todo.write.parquet(told)  # the state changes below
        _, saved = sinks.sync_sources(planned, state, "p_partkey", "digest", fetch, path)
        one = spark.read.parquet(told).select(F.lit(run).alias("run"), "p_partkey", F.lit(saved).alias("saved"))
        out = one if out is None else out.unionByName(one)
    return out


# Streams with state


@query("""
WITH RECURSIVE e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS item, date_trunc('millisecond', ts) AS tm, event_id,
    CASE event_type WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'again' ELSE 'taken' END AS outcome, max(date_trunc('millisecond', ts)) OVER () AS mark FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY tm, event_id) AS rn FROM e),
w(item, rn, tm, status, attempts, reason, mark) AS (
  SELECT item, rn, tm, CASE outcome WHEN 'again' THEN 'needs_rescan' WHEN 'taken' THEN 'scanned' ELSE 'failed' END, 1, CASE outcome WHEN 'again' THEN 'another look' WHEN 'rejected' THEN 'rejected' END, mark FROM o WHERE rn = 1
  UNION ALL SELECT o.item, o.rn, o.tm, CASE WHEN o.outcome = 'again' AND w.attempts + 1 < 3 THEN 'needs_rescan' WHEN o.outcome IN ('again', 'taken') THEN 'rescanned' ELSE 'failed' END, w.attempts + 1,
    CASE WHEN o.outcome = 'again' AND w.attempts + 1 < 3 THEN 'another look' WHEN o.outcome = 'rejected' THEN 'rejected after rescan' END, w.mark
  FROM w JOIN o ON o.item = w.item AND o.rn = w.rn + 1 WHERE w.status = 'needs_rescan' AND o.tm < w.tm + INTERVAL 6 HOUR),
late AS (SELECT w.item, w.tm + INTERVAL 6 HOUR AS tm, w.attempts FROM w LEFT JOIN o ON o.item = w.item AND o.rn = w.rn + 1
  WHERE w.status = 'needs_rescan' AND (o.tm >= w.tm + INTERVAL 6 HOUR OR o.tm IS NULL AND w.tm + INTERVAL 6 HOUR < w.mark))
SELECT item, epoch_ms(tm) AS "at", status, attempts, reason FROM w UNION ALL SELECT item, epoch_ms(tm), 'failed', attempts, 'no result in time' FROM late
""")
def rescan_stream(spark, d):
    """A user's events of one day are the results of one item; six hours without a result fail it."""
    folder, own = S.work_folder(spark), rescan.state_session(spark, 8)
    e = S.table_stream(own, d, "events")
    outcome = F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "again").otherwise("taken")
    at = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    results = e.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("item"), at.alias("at"), F.col("event_id").alias("ord"), outcome.alias("outcome"))
    q = rescan.rescans(results, 3, 6 * 3_600_000).writeStream.foreachBatch(S.append_parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).schema(rescan.OUT).parquet(f"{folder}/out")
    return out.select("item", F.unix_millis("at").alias("at"), "status", "attempts", "reason")


@query("SELECT event_type, count(*) AS n, 4 AS batches, 1 AS stops FROM events GROUP BY 1")
def stream_stop_and_resume(spark, d):
    """A stream of four files stopped after its second batch and taken up again; every row comes once, and progress counts them all."""
    folder, stop, counted = S.work_folder(spark), threading.Event(), []
    table(spark, d, "events").select("event_id", "event_type").repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = lambda: spark.readStream.schema("event_id bigint, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    write = S.append_parquet(f"{folder}/out")

    def two(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if number == 1:
            stop.set()

    stops = 0
    for handle in (two, write):
        done, batches = progress.drain_until(stream(), handle, folder, stop)
        counted += list(batches)
        stops += not done
        stop.clear()
    out = spark.read.option("recursiveFileLookup", True).schema("event_id bigint, event_type string").parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n")).withColumns({"batches": F.lit(len(set(counted))), "stops": F.lit(stops)})


# Icons and colours


def _icons(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as icons of 16 pixels: a mask and three channels of whole numbers from 0 to 255."""
    e = table(spark, d, "embeddings").filter("embedding is not null")
    level = lambda at: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 400 * F.get("embedding", (p * 4 + at).cast("int")).cast("double")))))
    return e.select("vec_id", "label", *[level(F.lit(i)).alias(c) for i, c in enumerate(("mask", "b", "g", "r"))])


@query("""
WITH px AS (SELECT vec_id, label, p, [least(255, greatest(0, floor(128 + 400 * embedding[p * 4 + c + 1]::DOUBLE))) FOR c IN [0, 1, 2, 3]] AS v FROM embeddings, range(16) t(p)),
r AS (SELECT label AS ref, p, v FROM px WHERE vec_id IN (SELECT min(vec_id) FROM embeddings WHERE label IS NOT NULL GROUP BY label)),
shared AS (SELECT vec_id, ref, o, p, CASE o WHEN 0 THEN [x.v[2], x.v[3], x.v[4]] ELSE [x.v[4], x.v[3], x.v[2]] END AS a, r.v[2:4] AS b FROM px x JOIN r USING (p), (VALUES (0), (1)) t(o) WHERE x.v[1] > 127 AND r.v[1] > 127),
s AS (SELECT vec_id, ref, o, count(*) * 3 AS n, sum(list_sum(a)) AS sa, sum(list_sum(b)) AS sb, sum(list_dot_product(a, a)) AS saa, sum(list_dot_product(b, b)) AS sbb, sum(list_dot_product(a, b)) AS sab,
  sqrt(power(avg(a[1]) - avg(b[1]), 2) + power(avg(a[2]) - avg(b[2]), 2) + power(avg(a[3]) - avg(b[3]), 2)) / (sqrt(3) * 255) AS apart FROM shared GROUP BY 1, 2, 3),
score AS (SELECT e.vec_id, l.ref, t.o, round(coalesce(CASE WHEN (saa - sa * sa / n) * (sbb - sb * sb / n) < 1e-20 THEN 0 ELSE (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) END - 1.5 * apart, 0), 9) AS score
  FROM embeddings e CROSS JOIN (SELECT DISTINCT ref FROM r) l CROSS JOIN (VALUES (0), (1)) t(o) LEFT JOIN s ON s.vec_id = e.vec_id AND s.ref = l.ref AND s.o = t.o),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, o, ref) AS n FROM score)
SELECT vec_id, CASE WHEN score >= 0.2 THEN ref END AS label, round(score, 6) AS score, CASE o WHEN 0 THEN 'native' ELSE 'swapped' END AS channel_order FROM best WHERE n = 1
""")
def icon_match(spark, d):
    """Masked correlation less 1.5 times the colour distance, the better channel order, rejected below 0.20."""
    icons = _icons(spark, d)
    refs = icons.filter("label is not null").groupBy("label").agg(F.min_by(F.struct("mask", "b", "g", "r"), "vec_id").alias("_r")).select("label", "_r.*")
    return I.match_icons(icons, "vec_id", refs, "label").withColumn("score", F.round("score", 6))


@query("""
WITH c AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: floor(128 + 400 * x::DOUBLE)) AS v FROM embeddings), r AS (SELECT n_name AS label, n_nationkey AS ord, [(n_nationkey * 10) % 256, (n_nationkey * 37) % 256, (n_nationkey * 91) % 256] AS w FROM nation),
x AS (SELECT vec_id, label, ord, o, power(v[1] - w[CASE o WHEN 0 THEN 1 ELSE 3 END], 2) + power(v[2] - w[2], 2) + power(v[3] - w[CASE o WHEN 0 THEN 3 ELSE 1 END], 2) AS dist FROM c, r, (VALUES (0), (1)) t(o)),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, o, ord) AS n FROM x)
SELECT vec_id, label, CASE o WHEN 0 THEN 'BGR' ELSE 'RGB' END AS channel_order, dist AS distance FROM b WHERE n = 1
""")
def nearest_colour(spark, d):
    """The nearest reference colour, pixels read in both channel orders."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.floor(128 + 400 * F.get("embedding", i).cast("double")).alias(c) for i, c in enumerate("bgr")])
    refs = table(spark, d, "nation").select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("ord"), *[((F.col("n_nationkey") * k) % 256).cast("double").alias(c) for c, k in (("b", 10), ("g", 37), ("r", 91))])
    return I.nearest_colour(e, ["vec_id"], ["b", "g", "r"], refs, "label", "ord")


# Nested values


@query("""
WITH j AS (SELECT event_id, json_object('props', props::JSON, 'user', user_id, 'list', json_array(event_id, json_array(event_type, json_object('deep', json_object('er', CASE WHEN event_id % 2 = 0 THEN event_type END)))), 'none', '{}'::JSON, 'empty', '[]'::JSON) AS j FROM events)
SELECT event_id, substr(t.fullkey, 3) AS path, json_extract_string(j, t.fullkey) AS leaf FROM j, json_tree(j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')
""")
def flatten_nested(spark, d):
    """Props and made nests of four levels as paths and leaves."""
    e = table(spark, d, "events")
    deep = F.struct(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("er")).alias("deep"))
    inner = F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), F.to_json(deep, {"ignoreNullFields": "false"}), F.lit("]"))
    json = F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"user":'), F.col("user_id"), F.lit(',"list":['), F.col("event_id"), F.lit(","), inner, F.lit('],"none":{},"empty":[]}'))
    return N.flatten(e.select("event_id", json.alias("j")), ["event_id"], "j").select("event_id", "path", "leaf")


@query("""
SELECT event_id, substr(sha1('{"k":' || json_extract_string(props, '$.k') || ',"meta":{"a":[1,{"b":null,"z":"\\u00e9"}],"type":"' || event_type || '"},"user":' || user_id || '}#' || event_id), 1, 10) AS digest FROM events
""")
def record_digests(spark, d):
    """the digest of a record whose keys come in another order, with spaces and other escapes."""
    e = table(spark, d, "events")
    json = F.concat(F.lit('{"user": '), F.col("user_id"), F.lit(', "meta": {"type" : "'), F.col("event_type"), F.lit('", "a": [1, {"z": "é", "b": null}]}, "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return e.select("event_id", N.record_digest(json, F.col("event_id")).alias("digest"))


@query("""
SELECT p_type AS rule, sha256('{' || string_agg('"' || p_brand || '":"' || n || '"', ',' ORDER BY p_brand) || '}') AS signature FROM (SELECT p_type, p_brand, max(p_size::VARCHAR) AS n FROM part GROUP BY ALL) GROUP BY 1
""")
def rule_signatures(spark, d):
    """a signature for each rule, whatever the order of its settings."""
    p = table(spark, d, "part").select(F.col("p_type").alias("rule"), F.col("p_brand").alias("setting"), F.col("p_size").cast("string").alias("value"))
    return N.rule_signatures(p)


# Prefixes, overrides, chains


@query("""
WITH known AS (SELECT s_suppkey::VARCHAR AS ref, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS cost FROM supplier WHERE s_suppkey % 3 = 0), pre(prefix, cost) AS (VALUES ('1', 10), ('12', 20), ('123', 30), ('4', 40), ('99', 50)),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT cost FROM known WHERE ref = l_suppkey::VARCHAR) AS a, (SELECT arg_max(cost, length(prefix)) FROM pre WHERE starts_with(l_partkey::VARCHAR, prefix)) AS b,
  (SELECT arg_max(cost, length(prefix)) FROM pre WHERE starts_with(l_orderkey::VARCHAR, prefix)) AS c, CASE WHEN l_linenumber < 4 THEN l_linenumber END AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(a, b, c, g)::BIGINT AS cost, CASE WHEN a IS NOT NULL THEN 'metadata' WHEN coalesce(b, c) IS NOT NULL THEN 'prefix' WHEN g IS NOT NULL THEN 'given' ELSE 'unknown' END AS step FROM x
""")
def prefix_cost(spark, d):
    """Metadata, then the longest prefix of either identifier, then the given cost."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("string")).otherwise("x").alias("given"))
    known = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("ref"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("bigint")).alias("cost"))
    prefixes = spark.createDataFrame([("1", 10), ("12", 20), ("123", 30), ("4", 40), ("99", 50)], "prefix string, cost bigint")
    return P.resolve_cost(li, ["l_suppkey"], known, ["l_partkey", "l_orderkey"], prefixes, "given").drop("given")


@query("""
WITH i AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0), k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, arg_min(p_brand, [p_name, p_brand]) AS n FROM part WHERE p_size < 25 GROUP BY 1)
SELECT p_partkey, coalesce(i.name, k.n, list_aggregate(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '')) AS name,
  CASE WHEN i.name IS NOT NULL THEN 'id' WHEN k.n IS NOT NULL THEN 'key' ELSE 'words' END AS step FROM part LEFT JOIN i ON i.id = p_partkey LEFT JOIN k ON k.a = regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')
""")
def display_names(spark, d):
    """Id, then key or alias, then the words of the key."""
    by_id = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    by_key = table(spark, d, "part").filter("p_size < 25").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("name"))
    return P.resolve_name(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", by_id, by_key).drop("p_name")


@query("""
WITH o AS (SELECT 'algeria' AS slug, 'france' AS "to" UNION ALL SELECT 'peru', 'china'), n AS (SELECT replace(lower(n_name), ' ', '') AS s, n_nationkey, 'N''' || n_name AS shown FROM nation)
SELECT n_nationkey, coalesce(o."to", s) AS found FROM n LEFT JOIN o ON o.slug = s WHERE coalesce(o."to", s) IN (SELECT s FROM n WHERE n_nationkey % 4 <> 1)
""")
def slug_overrides(spark, d):
    """Names joined by slug without apostrophes, some of them overridden."""
    n = table(spark, d, "nation")
    cut = F.ceil(F.length("n_name") / 2).cast("int")
    rows = n.select("n_nationkey", F.concat(F.substring("n_name", F.lit(1), cut), F.lit("'"), F.substring("n_name", cut + 1, F.length("n_name"))).alias("shown"))
    overrides = spark.createDataFrame([("algeria", "france"), ("peru", "china")], "slug string, to string")
    keys = n.filter("n_nationkey % 4 <> 1").select(F.lower(F.regexp_replace("n_name", " ", "")).alias("found"))
    return P.slug_join(rows, "shown", keys, "found", overrides).drop("shown")


# Fields and groups in batches


@query("""
WITH f AS (SELECT conv_id, turn, 'role' AS field, 0 AS ord, upper(role) AS result FROM conversations
  UNION ALL SELECT conv_id, turn, 'lines', i - 1, CASE WHEN l <> '' THEN length(l)::VARCHAR END FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE role <> 'user'))
SELECT conv_id, turn, field, string_agg(coalesce(result, '-'), ',' ORDER BY ord) AS results FROM f GROUP BY ALL UNION ALL SELECT conv_id, turn, 'unhandled', '' FROM conversations WHERE role = 'user'
""")
def field_batches(spark, d):
    """T4: fields of turns of different kinds, handled field by field, and put together with their gaps."""
    c = table(spark, d, "conversations")
    lines = F.transform(F.split("text", "\n"), lambda x: F.nullif(x, F.lit("")))
    fields = F.when(F.col("role") == "user", F.create_map(F.lit("role"), F.array("role"), F.lit("unhandled"), F.array("text"))).otherwise(F.create_map(F.lit("role"), F.array("role"), F.lit("lines"), lines))
    handlers = {"role": lambda v: v.withColumn("result", F.upper("value")), "lines": B.batched(lambda s: s.str.len().astype(str), "string", 500)}
    folder = S.work_folder(spark)

    def write(values: DataFrame) -> DataFrame:
        values.write.parquet(f"{folder}/fields")
        return spark.read.schema(values.schema).parquet(f"{folder}/fields")

    out = B.per_field(c, ["conv_id", "turn"], fields, handlers, write).select("conv_id", "turn", F.explode("results").alias("field", "_r"))
    return out.select("conv_id", "turn", "field", F.array_join("_r", ",", "-").alias("results"))


@query("SELECT p_partkey, p_size % 5 AS rarity, (p_size % 5) || ':' || upper(p_name) AS made FROM part")
def grouped_batches(spark, d):
    """Batches whose rows agree in rarity, a large group in several batches."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5).cast("int").alias("rarity"), F.col("p_name").alias("made"))
    return B.in_groups(p, ["rarity"], "p_partkey", lambda key, some: some.assign(made=f"{key[0]}:" + some["made"].str.upper()), "p_partkey bigint, rarity int, made string", 500)


# Caches that change


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0), s AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0),
a AS (SELECT 1 AS run, event_id, user_id, c_name, CASE WHEN c_name IS NULL THEN 'miss' WHEN n = 1 THEN 'store' ELSE 'memory' END AS tier FROM r LEFT JOIN s ON c_custkey = user_id),
b AS (SELECT 2 AS run, event_id, e.user_id, c_name, CASE WHEN c_name IS NULL THEN 'miss' WHEN e.user_id IN (SELECT user_id FROM a WHERE tier = 'store') OR n > 1 THEN 'memory' ELSE 'store' END AS tier
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) e LEFT JOIN s ON c_custkey = e.user_id)
SELECT run, tier, count(*) AS n, count(DISTINCT user_id) AS keys, count(c_name) AS found FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
UNION ALL SELECT 3, 'hits', sum(h)::BIGINT, count(*), max(h) FROM (SELECT user_id, count(*) AS h FROM (SELECT user_id, c_name FROM a UNION ALL SELECT user_id, c_name FROM b) WHERE c_name IS NOT NULL GROUP BY 1)
""")
def cache_promotion(spark, d):
    """Two runs of lookups, the first of which brings what it finds in the store into memory; and the hits of both."""
    path = f"{S.work_folder(spark)}/memory"
    e = table(spark, d, "events").select("event_id", "user_id")
    store = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    first = sinks.lookup_in_state(e.filter("event_id % 2 = 0"), "event_id", path, store, ["user_id"], "c_name").withColumn("run", F.lit(1))
    second = sinks.lookup_in_state(e, "event_id", path, store, ["user_id"], "c_name").withColumn("run", F.lit(2))
    told = first.unionByName(second).groupBy("run", "tier").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("keys"), F.count("c_name").alias("found"))
    hits = sinks.load_state(spark, path).agg(F.sum("hits").alias("n"), F.count("*").alias("keys"), F.max("hits").alias("found"))
    return told.unionByName(hits.select(F.lit(3).alias("run"), F.lit("hits").alias("tier"), "n", "keys", "found"))


@query("SELECT user_id, count(*) AS hit_count, max(event_id) AS hit_ts FROM events WHERE event_type = 'view' GROUP BY 1")
def cache_hits(spark, d):
    """Counters and times from a log of hits."""
    return C.count_hits(table(spark, d, "events").filter("event_type = 'view'"), ["user_id"], "event_id")


# Layouts, lines, records


@query("""
WITH s AS (SELECT c_custkey, 320 * (c_custkey % 9) + 640 AS width, CASE c_custkey % 4 WHEN 0 THEN (320 * (c_custkey % 9) + 640) * 10 // 16 WHEN 3 THEN 7 * (c_custkey % 11 + 1) ELSE (320 * (c_custkey % 9) + 640) * 9 // 16 END AS height FROM customer),
b(base, bw, bh, ord) AS (VALUES ('hd', 1920, 1080, 0), ('qhd', 2560, 1440, 1), ('wide', 1920, 1200, 2)), g AS (SELECT *, bw // gcd(bw, bh) || ':' || bh // gcd(bw, bh) AS ratio FROM b),
m AS (SELECT s.*, g.*, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(bw - width) + abs(bh - height), ord) AS n FROM s JOIN g ON ratio = width // gcd(width, height) || ':' || height // gcd(width, height)),
f AS (SELECT * FROM m WHERE n = 1)
SELECT c_custkey, base, n_name AS path, round(CASE WHEN n_regionkey = 0 THEN n_nationkey ELSE n_nationkey * width / bw END, 6) AS x, round(CASE WHEN n_regionkey = 0 THEN n_nationkey * 2 ELSE n_nationkey * 2 * height / bh END, 6) AS y FROM f, nation WHERE n_nationkey % 6 = 0
UNION ALL SELECT c_custkey, NULL, 'unsupported', NULL, NULL FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM f)
""")
def screen_layouts(spark, d):
    """Aspect ratio, then the nearest base, then scaled rectangles; sizes of other ratios are reported."""
    width, key = (320 * (F.col("c_custkey") % 9) + 640), F.col("c_custkey") % 4
    height = F.when(key == 0, F.floor(width * 10 / 16)).when(key == 3, 7 * (F.col("c_custkey") % 11 + 1)).otherwise(F.floor(width * 9 / 16))
    screens = table(spark, d, "customer").select("c_custkey", width.alias("width"), height.alias("height"))
    bases = spark.createDataFrame([("hd", 1920, 1080, 0), ("qhd", 2560, 1440, 1), ("wide", 1920, 1200, 2)], "base string, base_width bigint, base_height bigint, ord int")
    n = table(spark, d, "nation").filter("n_nationkey % 6 = 0")
    path = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("scroll."), F.col("n_name"))).otherwise(F.col("n_name"))
    regions = n.select(F.explode(F.array(*[F.lit(b) for b in ("hd", "qhd", "wide")])).alias("base"), path.alias("path"), F.col("n_nationkey").alias("x"), (F.col("n_nationkey") * 2).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    found, unknown = L.nearest_base(screens, ["c_custkey"], bases)
    out = L.scaled(found, ["c_custkey", "base"], regions, ["scroll"])
    out = out.select("c_custkey", "base", F.regexp_replace("path", r"^scroll\.", "").alias("path"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    return out.unionByName(unknown.select("c_custkey", F.lit(None).cast("string").alias("base"), F.lit("unsupported").alias("path"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber * 10 + l_partkey % 13 AS y0, l_linenumber * 10 + l_partkey % 13 + l_suppkey % 9 AS y1, l_partkey % 100 AS x0, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, lower(l_returnflag) AS text FROM lineitem),
n AS (SELECT *, max(y1) OVER (PARTITION BY l_orderkey ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM t),
r AS (SELECT *, sum(CASE WHEN above IS NULL OR y0 >= above + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY y0, ord)::BIGINT AS row_no FROM n)
SELECT l_orderkey, row_no, string_agg(text, ' ' ORDER BY x0, y0, ord) AS line FROM r GROUP BY 1, 2
""")
def text_lines(spark, d):
    """Tokens grouped into rows from top to bottom, joined in each from left to right."""
    li = table(spark, d, "lineitem")
    y0 = F.col("l_linenumber") * 10 + F.col("l_partkey") % 13
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    t = li.select("l_orderkey", (F.col("l_partkey") % 100).alias("x0"), y0.alias("y0"), (y0 + F.col("l_suppkey") % 9).alias("y1"), ord_.alias("ord"), F.lower("l_returnflag").alias("text"))
    return W.text_lines(t, ["l_orderkey"], 3).withColumn("row_no", F.col("row_no").cast("bigint"))


@query("""
WITH t AS (SELECT l_orderkey, l_returnflag AS k, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
SELECT l_orderkey, max(k) FILTER (i = 1) AS subType1, max(v) FILTER (i = 1) AS subValue1, max(k) FILTER (i = 2) AS subType2, max(v) FILTER (i = 2) AS subValue2, max(k) FILTER (i = 3) AS subType3, max(v) FILTER (i = 3) AS subValue3,
  max(k) FILTER (i = 4) AS subType4, max(v) FILTER (i = 4) AS subValue4, max(k) FILTER (i = 5) AS subType5, max(v) FILTER (i = 5) AS subValue5 FROM t GROUP BY 1
""")
def stat_pairs(spark, d):
    """The first five (type, value) pairs in numbered columns."""
    return A.pair_slots(table(spark, d, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], "l_returnflag", "l_quantity", 5, "sub")


@query("""
WITH k AS (SELECT event_id, value, coalesce(CASE WHEN user_id % 3 = 0 THEN user_id::VARCHAR END, nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, ''), (event_id % 50)::VARCHAR) AS key FROM events)
SELECT key, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM k GROUP BY 1
""")
def coalesced_keys(spark, d):
    """Keyed by id, else by name, else by index; the last record of a key counts."""
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("a"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("b"), (F.col("event_id") % 50).alias("c"))
    return A.keyed_by_first(e, ["a", "b", "c"], "event_id").select("key", "event_id", "value")


@query("""
SELECT c_mktsegment AS family, count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS existing, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing FROM customer GROUP BY 1
""")
def family_coverage(spark, d):
    """Planned, existing and missing by family."""
    return A.family_coverage(table(spark, d, "customer").withColumnsRenamed({"c_mktsegment": "family", "c_custkey": "key"}), table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "family", "key")


@query("""
WITH r AS (SELECT s_nationkey, s_suppkey % 200 AS a, CASE WHEN s_suppkey % 2 = 0 AND s_nationkey % 5 <> 0 THEN 1 END AS w FROM supplier)
SELECT s_nationkey, [coalesce(floor(avg((2 * a + 55) // 2) FILTER (w = 1)), 128)::BIGINT, coalesce(floor(avg((2 * s_nationkey + 30) // 2) FILTER (w = 1)), 128)::BIGINT, coalesce(floor(avg(15 // 2) FILTER (w = 1)), 128)::BIGINT] AS midpoint FROM r GROUP BY 1
""")
def range_midpoints(spark, d):
    """The mean midpoint of colour ranges by channel, 128 without any."""
    s, a = table(spark, d, "supplier"), (F.col("s_suppkey") % 200).cast("int")
    n = F.col("s_nationkey").cast("int")
    whole = (F.col("s_suppkey") % 2 == 0) & (F.col("s_nationkey") % 5 != 0)
    r = s.select("s_nationkey", F.array(a, n, F.lit(7)).alias("low"), F.when(whole, F.array(a + 55, n + 30, F.lit(8))).otherwise(F.array(F.lit(1), F.lit(2))).alias("high"))
    return A.range_midpoint(r, ["s_nationkey"], "low", "high")


@query("""
WITH t AS (SELECT l_orderkey, row_number() OVER w AS i, ['hp', 'atk', 'crit', 'HP', 'heal'][l_partkey % 5 + 1] AS name, ['hp', 'atk', NULL][l_orderkey % 3 + 1] AS fixed FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
SELECT l_orderkey, coalesce(CASE WHEN max(fixed) IS NOT NULL THEN arg_min(name, i) FILTER (lower(name) <> fixed) END, arg_min(name, i) FILTER (lower(name) NOT IN ('hp', 'atk', 'def')), arg_min(name, i)) AS shown FROM t GROUP BY 1
""")
def display_stats(spark, d):
    """The first that isn't the fixed one, else the first that isn't flat, else the first."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("hp", "atk", "crit", "HP", "heal")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    stats = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", name.alias("name")))), lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("double").alias("value")))
    fixed = F.get(F.array(F.lit("hp"), F.lit("atk"), F.lit(None)), (F.col("l_orderkey") % 3).cast("int"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(stats.alias("stats"))
    return g.select("l_orderkey", A.display_stat(F.col("stats"), fixed, ["hp", "atk", "def"])["name"].alias("shown"))


@query("""
SELECT event_id, event_id % 4 IN (0, 1) AS claimed, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS session, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events
""")
def claim_states(spark, d):
    """claimed by text or progress; session names of times, and back."""
    kind = F.col("event_id") % 4
    status = F.when(kind == 0, " CLAIM ").when(kind == 1, F.concat(F.col("event_id").cast("string"), F.lit("/9"))).when(kind == 2, F.col("event_type"))
    e = table(spark, d, "events").select("event_id", T.claimed(status).alias("claimed"), T.session_name("ts").alias("session"))
    return e.withColumn("seconds", F.unix_seconds(T.session_time("session")))


@query("""
SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9_]', '', 'g') AS words, regexp_replace(p_type, '^STANDARD ', '') AS bare, concat_ws(' | ', nullif(p_name, ''), CASE WHEN p_size > 25 THEN p_brand END, p_type) AS joined,
  p_name AS owner, p_size || '/icon.png' AS asset, p_name AS label_name, p_size::VARCHAR AS label_value FROM part
""")
def more_text_functions(spark, d):
    """F3, F7, F8, F10, F11, F24."""
    p = table(spark, d, "part")
    parts = T.label_parts(F.concat(F.lit("Part: "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")))
    path = F.concat(F.lit("/root/x/Assets/"), F.col("p_size").cast("string"), F.lit("/icon.webp"))
    return p.select(
        "p_partkey", T.word_key("p_type").alias("words"), T.without_prefix("p_type", "STANDARD ").alias("bare"), T.join_filled(" | ", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(""), "p_type").alias("joined"),
        T.captured_name(F.concat(F.lit("is EQUIPPED by  "), F.col("p_name"))).alias("owner"), T.asset_path(path, "Assets/", ".png").alias("asset"), parts["name"].alias("label_name"), parts["value"].alias("label_value"),
    )


@query("SELECT DISTINCT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0")
def plausible_names(spark, d):
    """Texts that a dictionary holds exactly or nearly; made ones that nothing is like are left out."""
    p = table(spark, d, "part").filter("p_partkey % 2 = 0").select("p_partkey", "p_name")
    odd = table(spark, d, "part").filter("p_partkey % 2 = 1").select("p_partkey", F.lit("0123456789").alias("p_name"))
    return M.plausible(p.unionByName(odd), "p_name", table(spark, d, "part"), "p_name", 0.9)
