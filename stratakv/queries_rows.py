"""The remaining rows of the operator inventory as queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import InvalidRequest
from .functions import scalar
from .operators import folds, kv, models, ranks, reconcile, spans, vectors, wide
from .plans.session import Session
from .queries import LOG, MERGED, QUERY_VECTOR, event_log, event_session, order_view, ql, query, read
from .queries_more import fresh
from .sources import files
from .storage import export, scratch
from .streaming import feeds

# --- A, B: sources, sinks, writes -----------------------------------------------------------------------


@query("SELECT event_id AS at, event_type AS op, 'f' || user_id || '.sst' AS file, user_id * 512 AS offset FROM events")
def a30_io_trace(spark, d):
    e = read(spark, d, "events")
    line = F.concat(F.lit("Access Time : "), "event_id", F.lit(" , File Operation: "), "event_type", F.lit(", File Name: f"), "user_id", F.lit(".sst, Offset: "), F.col("user_id") * 512)
    return files.io_trace(e.select(line.alias("value"))).select("at", "op", "file", F.col("offset").cast("long").alias("offset"))


@query("SELECT 'b' || user_id AS block, count(*) AS n, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS hits FROM events GROUP BY 1")
def a31_block_cache_trace(spark, d):
    e, path = read(spark, d, "events"), scratch(spark, "cache-trace")
    files.cache_trace(e.select(F.col("event_id").alias("at"), F.concat(F.lit("b"), "user_id").alias("block"), F.lit(4096).cast("long").alias("size"), (F.col("event_type") == "click").alias("hit")), path)
    return files.read_cache_trace(spark, path).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def a32_dump_round_trip(spark, d):
    path, v = scratch(spark, "dump"), read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    export(v.limit(0), "dump-folder")  # the shared folder is there
    files.dump(v, path, b"DUMPFILE", {"database-path": "customer"})
    return files.read_dump(spark, path, b"DUMPFILE").select(F.col("key").cast("string"), F.col("value").cast("string"))


@query("SELECT 0 AS number, s_suppkey AS key, s_name AS value FROM supplier UNION ALL SELECT 1, s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'new' ELSE s_name END FROM supplier WHERE s_suppkey % 4 <> 0")
def a37_incremental_backups(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    kept = files.Backups(spark, scratch(spark, "backups"))
    kept.create(s)
    kept.create(s.where("key % 4 <> 0").withColumn("value", F.when(F.col("key") % 4 == 1, "new").otherwise(F.col("value"))))
    each = [kept.restore(i).select(F.lit(i).alias("number"), "key", "value") for i in (0, 1)]
    return each[0].unionByName(each[1])


@query(f"WITH {LOG} SELECT kind, count(*) AS n, max(seq) AS last FROM log WHERE seq >= 300 GROUP BY 1")
def a40_commit_log_reader(spark, d):
    """Mutations of a commit-log folder from a position on, handled in micro-batches; the handler counts each batch."""
    path, seen = scratch(spark, "commit-log"), scratch(spark, "handled")
    log = event_log(spark, d)
    log.write.parquet(path)
    feed = feeds.tail(feeds.change_feed(spark, path, log.schema, files_per_trigger=1), 300)

    def handle(batch, epoch):
        batch.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).write.mode("overwrite").parquet(f"{seen}/batch={epoch}")

    feeds.run_available(feed, handle, scratch(spark, "commit-log-position"), mode="append")
    counts = spark.read.schema("kind string, n long, last long").parquet(f"{seen}/*")
    return counts.groupBy("kind").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


@query(f"WITH {LOG}, l AS (SELECT * FROM log WHERE kind <> 'MERGE') SELECT key, arg_max(value, seq) AS value FROM l GROUP BY key HAVING arg_max(kind, seq) <> 'DEL'")
def a47_follower(spark, d):
    path, log = scratch(spark, "leader"), event_log(spark, d).where("kind != 'MERGE'")
    log.write.parquet(path)
    return files.follower(spark, path, log.schema).select("key", "value")


@query(f"WITH {LOG} SELECT key, max(seq) AS seq FROM log GROUP BY key HAVING arg_max(kind, seq) = 'DEL'")
def b02_deleted_keys(spark, d):
    log = event_log(spark, d)
    return reconcile.newest(log).where("kind = 'DEL'").join(reconcile.live(log), ["cf", "key"], "left_anti").select("key", "seq")


@query(f"WITH {LOG}, o AS (SELECT key, seq, kind, lag(kind) OVER w AS older, lead(kind) OVER w AS newer FROM log WINDOW w AS (PARTITION BY key ORDER BY seq)), k AS (SELECT * FROM o WHERE NOT coalesce((kind = 'DEL' AND older = 'SET') OR (kind = 'SET' AND newer = 'DEL'), FALSE)) SELECT key, count(*) AS n FROM k WHERE key IN (SELECT key FROM log WHERE kind = 'DEL') GROUP BY key")
def b06_single_deletes(spark, d):
    """Deletes as single deletes: each takes the SET right below it along at compaction."""
    log = event_log(spark, d).withColumn("kind", F.when(F.col("kind") == "DEL", "SINGLEDEL").otherwise(F.col("kind")))
    touched = log.where("kind = 'SINGLEDEL'").select("key").distinct()
    return reconcile.cancel_single_deletes(log).join(touched, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (1, 3, 'a', 'one'), (3, 5, 'a', 'two'), (7, 9, 'b', 'x')) t(start, stop, suffix, value)")
def b07_range_keys(spark, d):
    rows = [(1, 5, "a", "one", "SET", 1), (3, 9, "a", "two", "SET", 2), (5, 9, "a", None, "UNSET", 3), (1, 9, "b", "old", "SET", 4), (0, 7, None, None, "DEL", 0), (1, 7, "b", None, "UNSET", 5), (7, 9, "b", "x", "SET", 6)]
    s = spark.createDataFrame(rows, "start int, end int, suffix string, value string, kind string, seq int")
    return spans.newest_per_piece(s).withColumnRenamed("end", "stop")


@query("SELECT event_id AS seq FROM events WHERE event_type <> 'view' OR floor(epoch(ts)) + 864000 > 1705500000")
def b10_timed_puts(spark, d):
    log = event_log(spark, d)
    return log.where(~reconcile.expired(1705500000)).select("seq")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (3, 5, 8) THEN 'MOVED' ELSE c_mktsegment END AS seg FROM customer")
def b13_update(spark, d):
    s = event_session(spark, d)
    s.execute("UPDATE customer SET c_mktsegment = 'MOVED' WHERE c_custkey IN (3, 5, 8)")
    return s.execute("SELECT c_custkey, c_mktsegment AS seg FROM customer")


@query(f"WITH {LOG} SELECT key, max(seq) AS seq FROM log WHERE NOT (key >= 'u00010' AND key < 'u00020' AND seq < 1000000) GROUP BY key")
def b04_delete_only_compaction(spark, d):
    """Files that a range delete covers whole are left out by their bounds; the others are read and filtered."""
    log = event_log(spark, d)
    path = export(log.withColumn("file", F.substring("key", 1, 5)), "by-file", ["file"])
    bounds = path.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max("seq").alias("newest"))
    gone = (F.col("first") >= "u00010") & (F.col("last") < "u00020") & (F.col("newest") < 1_000_000)
    left = path.join(F.broadcast(bounds.where(~gone).select("file")), "file", "left_semi")
    cut = spark.createDataFrame([("u00010", "u00020", 1_000_000)], "start string, end string, seq long")
    live = reconcile.without_covered(left, cut, lambda k: F.substring(k, 2, 4).cast("long"))
    return live.groupBy("key").agg(F.max("seq").alias("seq"))


@query("SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_nationkey = 40 UNION ALL SELECT 3, 40")
def b26_index_after_writes(spark, d):
    s = event_session(spark, d)
    s.execute("UPDATE customer SET c_nationkey = 40 WHERE c_custkey = 3")
    return s.execute("SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_nationkey = 40")


# --- C, D: projections and predicates -------------------------------------------------------------------

ql("c03_fetched_columns", "SELECT c_name FROM customer WHERE c_nationkey = 4", "SELECT c_name FROM customer WHERE c_nationkey = 4")
ql("c07_function_calls", "SELECT c_custkey, abs(c_nationkey - 10) AS a, round(c_acctbal) AS b FROM customer", "SELECT c_custkey, abs(c_nationkey - 10) AS a, floor(c_acctbal + 0.5) AS b FROM customer")
ql("c09_type_hints", "SELECT c_custkey, (bigint) ? AS n, (text) ? AS t FROM customer WHERE c_custkey = 4", "SELECT c_custkey, CAST(5 AS BIGINT) AS n, 'x' AS t FROM customer WHERE c_custkey = 4", [5, "x"])
ql("d01_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderkey > 50 ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderkey > 50")
ql("f04_average", "SELECT avg(c_acctbal) AS a, avg(c_custkey) AS k FROM customer", "SELECT avg(c_acctbal) AS a, CAST(trunc(avg(c_custkey)) AS BIGINT) AS k FROM customer")
ql("f05_extremes", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderstatus) AS first FROM orders", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderstatus) AS first FROM orders")
ql("g03_exponentials", "SELECT c_custkey, exp(c_acctbal / 10000) AS a FROM customer", "SELECT c_custkey, exp(c_acctbal / 10000) AS a FROM customer")
ql("g04_logarithms", "SELECT o_orderkey, log(o_totalprice) AS a, log10(o_totalprice) AS b FROM orders", "SELECT o_orderkey, ln(o_totalprice) AS a, log10(o_totalprice) AS b FROM orders")
ql("g06_rounding", "SELECT o_orderkey, round(o_totalprice) AS a FROM orders", "SELECT o_orderkey, floor(o_totalprice + 0.5) AS a FROM orders")
ql("g12_time_uuids", "SELECT event_id, to_unix_timestamp(min_timeuuid(ts)) AS ms FROM events", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
ql("g23_masks_to_null", "SELECT c_custkey, mask_null(c_name) AS a, mask_replace(c_mktsegment, 'seg') AS b, mask_outer(c_name, 2, 1) AS c FROM customer", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS a, 'seg' AS b, '**' || substr(c_name, 3, length(c_name) - 3) || '*' AS c FROM customer")
ql("i05_global_top", "SELECT vec_id FROM embeddings ORDER BY embedding ANN OF ? LIMIT 50", "SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]) DESC, vec_id LIMIT 50", [QUERY_VECTOR])
ql("i07_limit", "SELECT turn, role FROM conversations WHERE conv_id = 3 LIMIT 2", "SELECT turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 2")


@query("SELECT c_custkey, [c_nationkey, 2] AS l, (c_custkey, 'x') AS t FROM customer")
def c06_collection_literals(spark, d):
    """A list and a tuple of each row; the tuple's elements get the names that its SQL gives them in files and Arrow."""
    got = event_session(spark, d).execute("SELECT c_custkey, [c_nationkey, 2] AS l, (c_custkey, 'x') AS t FROM customer")
    return got.withColumn("t", F.col("t").cast("struct<element1:bigint,element2:string>"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def d08_contains_key(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    s = fresh(spark)
    s.register("e", e, ["event_id"])
    return s.execute("SELECT event_id, props['k'] AS k FROM e WHERE props CONTAINS KEY 'k' ALLOW FILTERING")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2)")
def d10_struct_membership(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation")).alias("who"))
    s = fresh(spark)
    s.register("c", c, ["c_custkey"])
    s.catalog.types[("ks", "person")] = [("nation", "int")]
    s.catalog.table("c").columns["who"].type = "frozen<person>"
    return s.execute("SELECT c_custkey FROM c WHERE who.nation IN (1, 2) ALLOW FILTERING")


@query("SELECT key, src FROM (SELECT o_orderkey AS key, 'low' AS src FROM orders WHERE o_orderkey BETWEEN 1 AND 400 UNION ALL SELECT o_orderkey, 'high' FROM orders WHERE o_orderkey BETWEEN 401 AND 900)")
def d19_concat_ranges(spark, d):
    v = order_view(spark, d).select("key")
    return kv.concat_ranges([(v.withColumn("src", F.lit("high")), 401, 900), (v.withColumn("src", F.lit("low")), 1, 400)])


@query("SELECT count(*) AS n, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(o_orderstatus)) AS BIGINT) AS bytes FROM orders")
def d32_size_of_range(spark, d):
    return kv.size_of(order_view(spark, d)).select("n", "bytes")


@query(f"WITH {LOG}, p AS (SELECT key, seq, kind FROM log WHERE seq % 3 <> 2 OR kind = 'DEL') SELECT key, max(seq) AS seq FROM p GROUP BY key HAVING arg_max(kind, seq) <> 'DEL' ORDER BY key LIMIT 40")
def e09_short_reads(spark, d):
    """Forty live rows from two replicas of which each misses some of the other's versions."""
    log = event_log(spark, d).select("key", "seq", "kind")
    one, two = log.where("seq % 3 <> 2"), log.where("kind = 'DEL'")
    return kv.refill([one, two], 40, ["key"]).select("key", "seq")


# --- F, G, H, I, J: aggregates, functions, order ----------------------------------------------------------

@query("SELECT o_custkey AS k, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def f10_resumed_groups(spark, d):
    """Groups cut by pages: each page's partial groups are written, the sum of partials is the group."""
    o = ranks.ranked(read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "at")
    pages = export(o.groupBy(F.floor(F.col("at") / 700).alias("page"), "o_custkey").agg(F.sum("o_orderkey").alias("part")), "pages")
    return pages.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("part").alias("total"))


@query(MERGED + "SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY seq) AS value FROM k GROUP BY key")
def f17_merge_append_general(spark, d):
    return reconcile.merged(event_log(spark, d), "stringappendtest").select("key", "value")


@query(MERGED + "SELECT key, max(value) - min(value) AS value FROM k GROUP BY key")
def f19_registered_merge(spark, d):
    folds.register("spread", lambda operand, seq: F.max(operand) - F.min(operand))
    return reconcile.merged(event_log(spark, d), "spread").select("key", "value")


@query("SELECT o_orderkey AS n, o_orderkey * 120 + 700 AS bytes FROM orders")
def f34_calibrated_sizes(spark, d):
    """A size model fitted to measured files, asked for every number of entries."""
    measured = read(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("n"), (F.col("o_orderkey") * 120 + 700 - F.when(F.col("o_orderkey") % 5 == 2, 40).otherwise(0)).alias("b"))
    ends = measured.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    exact = measured.join(F.broadcast(ends), F.col("n").isin(F.col("lo"), F.col("hi")), "left_semi").select("n", (F.col("n") * 120 + 700).alias("b"))
    model = models.SizeModel.fitted(measured.unionByName(exact), "n", "b")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("n"), model.column(F.col("o_orderkey")).alias("bytes"))


@query("WITH RECURSIVE s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), a AS (SELECT event_type, n, value AS v FROM s WHERE n = 1 UNION ALL SELECT s.event_type, s.n, a.v + 0.1 * (s.value - a.v) FROM a JOIN s ON s.event_type = a.event_type AND s.n = a.n + 1) SELECT event_type, round(arg_max(v, n), 6) AS average FROM a GROUP BY 1")
def f36_moving_average(spark, d):
    e = read(spark, d, "events").select("event_type", "event_id", F.col("value").cast("double").alias("value"))
    return files.moving_average(e, "value", ["event_id"], ["event_type"], 0.1).select("event_type", F.round("average", 6).alias("average"))


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name DESC, p_partkey) - 1 AS place FROM part")
def g35_reverse_comparator(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name")
    placed = ranks.ranked(p.withColumn("by", kv.sort_key("reverse", "p_name")), ["by", "p_partkey"], "place")
    return placed.select("p_partkey", "p_name", "place")


@query("SELECT vec_id, list_distance(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 AS same FROM embeddings")
def g21_distance_to_itself(spark, d):
    x = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", (vectors.euclidean(x, x) == 1).alias("same"))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey <= (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000)")
def i08_early_stop(spark, d):
    v = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    return kv.stop_after(v, ["key"], F.col("o_totalprice") > 300000).select("key")


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_nationkey < 5 OR c_mktsegment = 'BUILDING'")
def j02_key_union(spark, d):
    c = read(spark, d, "customer")
    lists = [c.where("c_nationkey < 5"), c.where("c_mktsegment = 'BUILDING'")]
    return lists[0].select(F.col("c_custkey").alias("key")).union(lists[1].select("c_custkey")).distinct()


@query("SELECT c_custkey AS key FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'")
def j03_posting_lists(spark, d):
    v = read(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    nation = wide.lookup(v, wide.index(v, "c_nationkey"), 5)
    return wide.lookup(nation, wide.index(v, "c_mktsegment"), "BUILDING").select("key")


# --- K, L, M, N ---------------------------------------------------------------------------------------------

@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def k06_triggered_counts(spark, d):
    e = read(spark, d, "events").select("event_type", F.lit(1).alias("x"))
    twice = feeds.with_triggers(e, [lambda b: b.withColumn("x", F.lit(0))])
    return twice.groupBy("event_type").agg(F.sum("x").cast("long").alias("n"))


@query("SELECT c_custkey, c_nationkey - 1 AS lo, c_nationkey + 1 AS hi FROM customer")
def l02_user_types_from_functions(spark, d):
    s = event_session(spark, d)
    s.execute("CREATE TYPE around (lo int, hi int)")
    s.execute("CREATE FUNCTION near(x int) RETURNS NULL ON NULL INPUT RETURNS around LANGUAGE python AS $$ {'lo': x - 1, 'hi': x + 1} $$")
    return s.execute("SELECT c_custkey, near(c_nationkey) AS n FROM customer").select("c_custkey", "n.lo", "n.hi")


@query("SELECT c_nationkey AS nation, string_agg(CAST(c_custkey AS VARCHAR), '/' ORDER BY c_custkey) AS joined FROM customer GROUP BY 1")
def l04_python_aggregates(spark, d):
    s = fresh(spark)
    s.register("c", read(spark, d, "customer"), ["c_nationkey"], ["c_custkey"])
    s.execute("CREATE FUNCTION glue(s text, v bigint) CALLED ON NULL INPUT RETURNS text LANGUAGE python AS $$ (s + '/' if s else '') + str(v) $$")
    s.execute("CREATE AGGREGATE joined(bigint) SFUNC glue STYPE text INITCOND ''")
    return s.execute("SELECT c_nationkey AS nation, joined(c_custkey) AS joined FROM c GROUP BY c_nationkey")


@query("SELECT * FROM (VALUES ('added', 1), ('dropped', 1), ('index', 1), ('type', 1), ('view', 2)) t(what, n)")
def m02_definitions(spark, d):
    """Statements that create, alter and drop; each count is what the catalog then holds."""
    s, out = fresh(spark), []
    for text in ("CREATE KEYSPACE k2 WITH replication = {'class': 'x'}", "USE k2", "CREATE TABLE t (id int PRIMARY KEY, a int)", "ALTER TABLE t ADD b text", "CREATE TABLE gone (id int PRIMARY KEY)"):
        s.execute(text)
    out.append(("added", int("b" in s.catalog.table("t").columns)))
    s.execute("DROP TABLE gone")
    out.append(("dropped", len(s.catalog.tables)))
    s.execute("CREATE INDEX ON t(a)")
    out.append(("index", len(s.catalog.table("t").indexes)))
    s.execute("CREATE TYPE p (x int)")
    out.append(("type", len(s.catalog.types)))
    s.execute("CREATE MATERIALIZED VIEW v AS SELECT a, id FROM t WHERE a IS NOT NULL AND id IS NOT NULL PRIMARY KEY (a, id)")
    out.append(("view", len(s.catalog.tables)))
    return spark.createDataFrame(out, "what string, n int")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS type FROM events")
def n02_key_value_lines(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit(" type="), "event_type").alias("line"))
    pairs = files.key_values("line")
    return e.select("event_id", F.try_element_at(pairs, F.lit("k")).alias("k"), F.try_element_at(pairs, F.lit("type")).alias("type"))


@query("SELECT event_type, CAST(trunc(quantile_cont(value, 0.99)) AS BIGINT) AS p99 FROM events GROUP BY 1")
def n04_percentiles(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(files.percentile_linear("value", 0.99).alias("p99"))


# --- rows that until here had no query of their own -----------------------------------------------------

def sparse(spark, d) -> Session:
    """Customers without a nation below 5 and without a balance below 0."""
    c = read(spark, d, "customer").select("c_custkey", F.expr("if(c_nationkey < 5, null, c_nationkey)").alias("nation"), F.expr("if(c_acctbal < 0, null, c_acctbal)").alias("balance"))
    s = fresh(spark)
    s.register("c", c, ["c_custkey"])
    return s


def refused(s: Session, text: str) -> bool:
    try:
        s.execute(text)
    except InvalidRequest:
        return True
    return False


@query("SELECT c_custkey, c_name AS first, CAST(c_nationkey AS VARCHAR) AS nation, NULL::VARCHAR AS none FROM customer")
def c14_wide_find(spark, d):
    """Columns of an entity by place in the order of names and by name."""
    e = read(spark, d, "customer").select("c_custkey", wide.entity(seg=F.col("c_mktsegment"), name=F.col("c_name"), nation=F.col("c_nationkey")).alias("e"))
    return e.select("c_custkey", wide.sorted_columns("e")[0]["value"].alias("first"), wide.column_of("e", "nation").alias("nation"), wide.column_of("e", "no").alias("none"))


@query("SELECT c_nationkey AS nation, c_custkey FROM customer WHERE c_nationkey >= 5")
def d12_is_not_null(spark, d):
    """A view leaves out rows without a value in its key."""
    s = sparse(spark, d)
    s.execute("CREATE MATERIALIZED VIEW by_nation AS SELECT nation, c_custkey FROM c WHERE nation IS NOT NULL AND c_custkey IS NOT NULL PRIMARY KEY (nation, c_custkey)")
    return s.execute("SELECT nation, c_custkey FROM by_nation")


ql("d16_index_and_residual", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IN (1, 7, 12) AND c_acctbal > 0 ALLOW FILTERING", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IN (1, 7, 12) AND c_acctbal > 0")


@query(f"WITH {LOG} SELECT key, max(seq) AS seq FROM log WHERE NOT (key >= 'u00010' AND key < 'u00020' AND seq < 5000) GROUP BY key HAVING arg_max(kind, seq) <> 'DEL'")
def e02_points_under_range_deletes(spark, d):
    """Newest rows over several sources, under point and range deletes."""
    log = event_log(spark, d)
    both = log.where("seq % 2 = 0").unionByName(log.where("seq % 2 = 1"))
    cut = spark.createDataFrame([("u00010", "u00020", 5000)], "start string, end string, seq long")
    return reconcile.newest(reconcile.without_covered(both, cut, spans.text_bucket(4))).where("kind <> 'DEL'").select("key", "seq")


@query("SELECT c_mktsegment AS seg, true AS refused, count(c_acctbal) FILTER (WHERE c_acctbal >= 0) AS n, max(c_acctbal) FILTER (WHERE c_acctbal >= 0) AS hi FROM customer GROUP BY 1")
def f06_aggregate_contract(spark, d):
    """Aggregates start anew for each group and pass nulls over; aggregates of aggregates are refused."""
    c = read(spark, d, "customer").select("c_mktsegment", "c_custkey", F.expr("if(c_acctbal < 0, null, c_acctbal)").alias("balance"))
    s = fresh(spark)
    s.register("c", c, ["c_mktsegment"], ["c_custkey"])
    no = refused(s, "SELECT max(min(balance)) FROM c")
    return s.execute("SELECT c_mktsegment AS seg, count(balance) AS n, max(balance) AS hi FROM c GROUP BY c_mktsegment").withColumn("refused", F.lit(no))


@query("WITH s AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 4611686018427387904 + event_id::HUGEINT END) % 18446744073709551616 AS x FROM events GROUP BY 1) SELECT user_id, CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END AS BIGINT) AS total FROM s")
def f13_sums_that_wrap(spark, d):
    """Sums wrap at 64 bits, operands that are no numbers count as 0."""
    big = F.expr("if(event_type = 'error', 'bad', string(4611686018427387904 + event_id))")
    return read(spark, d, "events").groupBy("user_id").agg(folds.uint64add(big, F.col("event_id")).alias("total"))


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(kind, seq) AS kind FROM log GROUP BY key")
def f24_collapsed_points(spark, d):
    """One point for each key, deletes too."""
    return reconcile.newest(event_log(spark, d)).select("key", "seq", "kind")


ql("g05_log10_in_type", "SELECT o_orderkey, log10(o_totalprice) AS a, log10(o_custkey + 1) AS b FROM orders", "SELECT o_orderkey, log10(o_totalprice) AS a, CAST(trunc(log10(o_custkey + 1)) AS BIGINT) AS b FROM orders")


@query("SELECT c_custkey, CASE WHEN c_nationkey >= 5 THEN c_nationkey END AS n, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal + 0.5) END AS r, CASE WHEN c_acctbal >= 0 THEN exp(c_acctbal / 10000) END AS e FROM customer")
def g07_nulls_in_math(spark, d):
    return sparse(spark, d).execute("SELECT c_custkey, abs(nation) AS n, round(balance) AS r, exp(balance / 10000) AS e FROM c")


ql("g10_now", "SELECT event_id, to_unix_timestamp(now()) AS ms FROM events", "SELECT event_id, 1706745600000 AS ms FROM events")
ql("g11_current_moments", "SELECT event_id, current_date() AS day, to_unix_timestamp(current_timestamp()) AS ms FROM events", "SELECT event_id, DATE '2024-02-01' AS day, 1706745600000 AS ms FROM events")


@query("SELECT count(*) AS n, count(*) AS different, count(*) AS random FROM orders")
def g14_uuids(spark, d):
    u = event_session(spark, d).execute("SELECT o_orderkey, uuid() AS u FROM orders")
    return u.agg(F.count("u").alias("n"), F.countDistinct("u").alias("different"), F.count_if(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab]")).alias("random"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (3, 5) THEN 'from \"json\"' ELSE c_name END AS c_name FROM customer")
def g18_values_from_json(spark, d):
    s = event_session(spark, d)
    s.execute("UPDATE customer SET c_name = from_json('\"from \\\"json\\\"\"') WHERE c_custkey IN (3, 5)")
    return s.execute("SELECT c_custkey, c_name FROM customer")


ql("g19_json_forms", "SELECT event_id, to_json(event_type) AS t, to_json(user_id) AS n, to_json(text_as_blob(event_type)) AS b FROM events", "SELECT event_id, '\"' || event_type || '\"' AS t, CAST(user_id AS VARCHAR) AS n, '\"0x' || lower(hex(encode(event_type))) || '\"' AS b FROM events")
ql("g24_default_masks", "SELECT o_orderkey, mask_default(o_orderstatus) AS t, mask_default(o_totalprice) AS x, mask_default(o_orderdate) AS at FROM orders", "SELECT o_orderkey, '****' AS t, CAST(0 AS DOUBLE) AS x, TIMESTAMP '1970-01-01' AS at FROM orders")
ql("g25_replacing_masks", "SELECT c_custkey, mask_replace(c_mktsegment, 'seg') AS t, mask_replace(c_nationkey, 7) AS n FROM customer", "SELECT c_custkey, 'seg' AS t, CAST(7 AS INTEGER) AS n FROM customer")
ql("g27_outer_masks", "SELECT p_partkey, mask_outer(p_name, 3, 0) AS a, mask_outer(p_name, 1, 2, '#') AS b FROM part", "SELECT p_partkey, '***' || substr(p_name, 4) AS a, '#' || substr(p_name, 2, length(p_name) - 3) || '##' AS b FROM part")


@query("SELECT c_custkey, sha256(c_name) AS a, md5(c_name) AS b FROM customer")
def g28_hash_masks(spark, d):
    h = event_session(spark, d).execute("SELECT c_custkey, mask_hash(c_name) AS a, mask_hash(c_name, 'MD5') AS b FROM customer")
    return h.select("c_custkey", *(F.lower(F.hex(c)).alias(c) for c in ("a", "b")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events")
def g29_elements(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    s = fresh(spark)
    s.register("e", e, ["event_id"])
    return s.execute("SELECT event_id, props['k'] AS k, props['none'] AS none FROM e")


@query("SELECT c_custkey, '****' AS masked, c_mktsegment AS plain FROM customer")
def g33_mask_definitions(spark, d):
    """A masked column by role: without and with the permission to see it."""
    s = event_session(spark, d)
    s.execute("ALTER TABLE customer ALTER c_mktsegment MASKED WITH mask_default()")
    s.execute("GRANT select ON customer TO reader")
    masked = Session(spark, s.catalog, role="reader").execute("SELECT c_custkey, c_mktsegment AS masked FROM customer")
    return masked.join(s.execute("SELECT c_custkey, c_mktsegment AS plain FROM customer"), "c_custkey")


@query(f"WITH {LOG} SELECT substr(key, 1, 4) AS prefix, count(*) AS n, count(DISTINCT substr(key, 1, 5)) AS longer FROM log GROUP BY 1")
def g34_prefixes(spark, d):
    return event_log(spark, d).groupBy(kv.fixed_prefix(4).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kv.capped_prefix(5)).alias("longer"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus) || ['A', 'F'])), ',') AS both, array_to_string(list_sort(list_filter(list_distinct(list(o_orderstatus)), lambda x: x NOT IN ('A', 'F'))), ',') AS without FROM orders GROUP BY 1")
def j05_set_algebra(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(scalar.set_of(F.collect_set("o_orderstatus")).alias("s"))
    other = F.array(F.lit("A"), F.lit("F"))
    return o.select("o_custkey", F.array_join(scalar.set_add(F.col("s"), other), ",").alias("both"), F.array_join(scalar.set_remove(F.col("s"), other), ",").alias("without"))


@query(f"WITH {LOG} SELECT key, count(*) AS n, max(seq) AS seq FROM log WHERE seq >= 3000 GROUP BY key")
def k03_change_stream(spark, d):
    """Changes of a log folder from a sequence number on, taken in micro-batches of one file."""
    log = event_log(spark, d)
    folder, out = scratch(spark, "changes"), scratch(spark, "changes-out")
    for part in (0, 1, 2):
        log.where(f"seq % 3 = {part}").write.mode("append").parquet(folder)
    feed = feeds.tail(feeds.change_feed(spark, folder, log.schema, files_per_trigger=1), 3000)
    feeds.run_available(feed, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/epoch={n}"), scratch(spark, "changes-state"), "append")
    return spark.read.schema(log.schema).parquet(out).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))


@query(f"WITH {LOG} SELECT key, count(*) AS n FROM log WHERE expire_at IS NULL OR expire_at > 1706745600 GROUP BY key")
def k04_unexpired(spark, d):
    return feeds.unexpired(event_log(spark, d), 1_706_745_600).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey = 3 THEN 'flushed' ELSE c_name END AS c_name FROM customer WHERE c_custkey <> 5")
def k08_flush(spark, d):
    """Writes and deletions of statements are in the files after a flush."""
    s = event_session(spark, d)
    s.execute("UPDATE customer SET c_name = 'flushed' WHERE c_custkey = 3")
    s.execute("DELETE FROM customer WHERE c_custkey = 5")
    s.flush("customer", scratch(spark, "flushed"))
    return s.execute("SELECT c_custkey, c_name FROM customer")


@query("SELECT c_custkey, c_nationkey * 2 AS n, true AS refused FROM customer")
def l05_dropped_function(spark, d):
    s = event_session(spark, d)
    s.execute("CREATE FUNCTION twice(x int) RETURNS NULL ON NULL INPUT RETURNS int LANGUAGE sql AS $$ x * 2 $$")
    rows = s.execute("SELECT c_custkey, twice(c_nationkey) AS n FROM customer")
    s.execute("DROP FUNCTION twice")
    return rows.withColumn("refused", F.lit(refused(s, "SELECT twice(c_nationkey) FROM customer")))


@query("SELECT p_partkey FROM part WHERE length(p_name) >= 12")
def l08_custom_index_class(spark, d):
    s = event_session(spark, d)
    s.index_classes["longer"] = lambda c, v: F.length(c) >= v
    s.execute("CREATE CUSTOM INDEX names ON part(p_name) USING 'longer'")
    return s.execute("SELECT p_partkey FROM part WHERE expr(names, 12)")


@query("SELECT p_partkey, true AS before, true AS after FROM part WHERE p_size = 7")
def m04_indexes(spark, d):
    """A predicate on a column is refused without an index, served with one and refused again once it is dropped."""
    s, text = event_session(spark, d), "SELECT p_partkey FROM part WHERE p_size = 7"
    before = refused(s, text)
    s.execute("CREATE INDEX sizes ON part(p_size)")
    rows = s.execute(text)
    s.execute("DROP INDEX sizes")
    return rows.select("p_partkey", F.lit(before).alias("before"), F.lit(refused(s, text)).alias("after"))


@query("SELECT o_orderstatus AS status, o_custkey, o_orderdate, o_orderkey, true AS gone FROM orders")
def m05_views(spark, d):
    s = event_session(spark, d)
    keys = "o_orderstatus, o_custkey, o_orderdate, o_orderkey"
    s.execute(f"CREATE MATERIALIZED VIEW by_status AS SELECT {keys} FROM orders WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", ")) + f" PRIMARY KEY ({keys})")
    text = "SELECT o_orderstatus AS status, o_custkey, o_orderdate, o_orderkey FROM by_status"
    rows = s.execute(text)
    s.execute("DROP MATERIALIZED VIEW by_status")
    return rows.withColumn("gone", F.lit(refused(s, text)))
