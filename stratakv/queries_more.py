"""More of the operator inventory as queries: writes, collections, catalog, streams, models, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import log as L
from .catalog import InvalidRequest
from .functions import scalar
from .operators import aggregates, folds, kv, models, ranks, reconcile, spans, vectors, wide
from .plans.session import Session
from .queries import LOG, MERGED, event_log, event_session, order_view, ql, query, read
from .sources import files
from .storage import export, scratch
from .streaming import feeds

E_TEXT = "SELECT event_id, user_id, event_type FROM events"


def fresh(spark: SparkSession) -> Session:
    ticks = iter(range(1_700_000_000_000_000, 1_700_000_000_999_999))
    return Session(spark, clock=lambda: next(ticks))


# --- A: sources, sinks, feeds ---------------------------------------------------------------------------

@query("SELECT event_id, user_id FROM events WHERE event_id >= 100")
def a12_tailing_feed(spark, d):
    """A forward-only feed of the log folder: what is there is taken in micro-batches."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    out, state = scratch(spark, "tail"), scratch(spark, "tail-state")
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = feed.where("event_id >= 100").select("event_id", "user_id")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query(f"WITH {LOG} SELECT key, seq, kind, value FROM log WHERE key = 'u00007'")
def a20_raw_entries(spark, d):
    return event_log(spark, d).where("key = 'u00007'").select("key", "seq", "kind", "value")


@query("SELECT * FROM (VALUES ('conversations', 1, 1), ('customer', 1, 0), ('embeddings', 1, 0), ('events', 1, 2), ('orders', 1, 2), ('part', 1, 0)) t(name, partition, clustering)")
def a26_virtual_table(spark, d):
    s = event_session(spark, d)
    rows = [(t.name, len(t.partition), len(t.clustering)) for t in s.catalog.tables.values()]
    return spark.createDataFrame(rows, "name string, partition int, clustering int")


@query(f"WITH {LOG} SELECT key, count(*) AS n FROM log WHERE seq <= 4000 GROUP BY key")
def a34_checkpoint_export(spark, d):
    copy = export(reconcile.snapshot(event_log(spark, d), 4000), "checkpoint")
    return copy.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG}, a AS (SELECT key, seq, kind, value FROM log UNION ALL SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 5, '0'), 1000000, 'SET', -1 FROM customer WHERE c_nationkey < 5) SELECT key, arg_max(value, seq) AS value FROM a GROUP BY key HAVING arg_max(kind, seq) <> 'DEL'")
def a35_ingest_external_file(spark, d):
    new = read(spark, d, "customer").where("c_nationkey < 5").select(
        F.lit("default").alias("cf"), F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("key"), F.lit("SET").alias("kind"), F.lit(-1).cast("long").alias("value")
    )
    return reconcile.live(files.ingest(event_log(spark, d), new, 1_000_000)).select("key", "value")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 500 = 1 THEN 'X' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 500 = 1 THEN 9 ELSE 0 END AS BIGINT) AS wt FROM orders")
def a39_clustered_bulk_write(spark, d):
    """A flush writes the buffer and the base with their write times; an older write afterwards changes nothing."""
    s = event_session(spark, d)
    some = read(spark, d, "orders").where("o_orderkey % 500 = 1").select("o_custkey", "o_orderdate", "o_orderkey").collect()  # a row in 500, as statements
    put = "UPDATE orders USING TIMESTAMP ? SET o_orderstatus = ? WHERE o_custkey = ? AND o_orderdate = ? AND o_orderkey = ?"
    for r in some:
        s.execute(put, [9, "X", r.o_custkey, r.o_orderdate, r.o_orderkey])
    s.flush("orders", scratch(spark, "bulk"))
    for r in some[:20]:
        s.execute(put, [3, "late", r.o_custkey, r.o_orderdate, r.o_orderkey])
    return s.execute("SELECT o_custkey, o_orderkey, o_orderstatus AS status, writetime(o_orderstatus) AS wt FROM orders")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def a42_copy_round_trip(spark, d):
    path, t = scratch(spark, "copy"), read(spark, d, "supplier")
    files.copy_to(t, path, ["s_suppkey", "s_name", "s_acctbal"])
    return files.copy_from(spark, path, "s_suppkey long, s_name string, s_acctbal double")


@query(f"WITH {LOG} SELECT key, max(CASE WHEN seq <= 5000 THEN seq END) AS old, max(seq) AS new FROM log GROUP BY key")
def a46_refreshed_iterator(spark, d):
    """An iterator keeps its snapshot until it is refreshed to the newest one."""
    log = event_log(spark, d)
    old = reconcile.newest(reconcile.snapshot(log, 5000)).select("key", F.col("seq").alias("old"))
    return reconcile.newest(log).select("key", F.col("seq").alias("new")).join(old, "key", "left")


# --- B: writes through the language ------------------------------------------------------------------------

@query("SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def b08_entities(spark, d):
    c = read(spark, d, "customer")
    e = c.select(F.col("c_custkey").alias("key"), wide.entity(name=F.col("c_name"), nation=F.col("c_nationkey"), none=F.lit(None)).alias("columns"))
    return e.select("key", wide.column_of("columns", "name").alias("name"), wide.column_of("columns", "nation").alias("nation"))


@query("SELECT * FROM (VALUES ('a', 100), ('b', 101), ('c', 103)) t(key, seq)")
def b09_write_batch(spark, d):
    log, _ = L.WriteBatch().put("a", "1").put("b", "2").delete_range("x", "y").merge("c", "3").commit(spark, 100)
    return log.select("key", F.col("seq").cast("int").alias("seq"))


def small(spark, *statements: str, ask: str) -> DataFrame:
    s = fresh(spark)
    for text in statements:
        s.execute(text)
    return s.execute(ask)


@query("SELECT * FROM (VALUES (1, 'x', NULL), (2, 'kept', 'u')) t(id, a, b)")
def b12_insert_json(spark, d):
    return small(
        spark, "CREATE TABLE t (id int PRIMARY KEY, a text, b text)", "INSERT INTO t (id, a, b) VALUES (1, 'o', 'o')", "INSERT INTO t (id, a, b) VALUES (2, 'kept', 'o')",
        "INSERT INTO t JSON '{\"id\": 1, \"a\": \"x\"}'", "INSERT INTO t JSON '{\"id\": 2, \"b\": \"u\"}' DEFAULT UNSET", ask="SELECT id, a, b FROM t",
    )


@query("SELECT * FROM (VALUES (1, 3), (1, 7), (2, 1)) t(k, c)")
def b14_delete_ranges(spark, d):
    rows = [f"INSERT INTO t (k, c, v) VALUES (1, {c}, 0)" for c in (3, 4, 5, 7)] + ["INSERT INTO t (k, c, v) VALUES (2, 1, 0)", "INSERT INTO t (k, c, v) VALUES (3, 1, 0)"]
    return small(spark, "CREATE TABLE t (k int, c int, v int, PRIMARY KEY (k, c))", *rows, "DELETE FROM t WHERE k = 1 AND c > 3 AND c <= 5", "DELETE FROM t WHERE k = 3", ask="SELECT k, c FROM t")


@query("SELECT * FROM (VALUES (1, 5), (2, 6)) t(id, v)")
def b15_batch(spark, d):
    return small(spark, "CREATE TABLE t (id int PRIMARY KEY, v int)", "BEGIN BATCH INSERT INTO t (id, v) VALUES (1, 5); UPDATE t SET v = 6 WHERE id = 2; APPLY BATCH", ask="SELECT id, v FROM t")


@query("SELECT (SELECT count(*) FROM orders) AS before, CAST(0 AS BIGINT) AS emptied, CAST(1 AS BIGINT) AS after")
def b16_truncate(spark, d):
    s = event_session(spark, d)
    count = lambda n: s.execute(f"SELECT count(*) AS {n} FROM orders")
    before = count("before")
    s.execute("TRUNCATE orders")
    emptied = count("emptied")
    s.execute("INSERT INTO orders (o_custkey, o_orderdate, o_orderkey) VALUES (1, '2020-01-01', 1)")
    return before.join(emptied).join(count("after"))


@query("SELECT o_custkey, array_to_string(list_filter(list(o_orderkey ORDER BY o_orderkey), lambda x: x % 3 <> 0) || [-1], ',') AS l FROM orders GROUP BY 1")
def b17_list_operations(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    kept = scalar.list_remove(F.col("l"), F.filter("l", lambda x: x % 3 == 0))
    return o.select("o_custkey", F.array_join(scalar.list_append(kept, F.array(F.lit(-1).cast("long"))), ",").alias("l"))


@query("SELECT o_custkey, array_to_string(list_sort(list_filter(list(DISTINCT o_orderstatus), lambda x: x <> 'F') || ['Z']), ',') AS s FROM orders GROUP BY 1")
def b18_set_operations(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(scalar.set_of(F.collect_list("o_orderstatus")).alias("s"))
    return o.select("o_custkey", F.array_join(scalar.set_add(scalar.set_remove(F.col("s"), F.array(F.lit("F"))), F.array(F.lit("Z"))), ",").alias("s"))


@query("SELECT c_custkey, c_mktsegment AS seg, 'new' AS added, NULL::VARCHAR AS gone FROM customer")
def b19_map_operations(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("n"), F.lit("x")).alias("m"))
    m = scalar.map_remove(scalar.map_put(F.col("m"), F.create_map(F.lit("added"), F.lit("new"))), F.array(F.lit("n")))
    c = c.select("c_custkey", m.alias("m"))
    return c.select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(a) for k, a in (("seg", "seg"), ("added", "added"), ("n", "gone"))))


@query("SELECT event_id AS seq, event_type AS kind FROM events UNION ALL SELECT event_id, 'audit' FROM events WHERE event_type = 'error'")
def b25_trigger(spark, d):
    batch = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    audit = lambda b: b.where("kind = 'error'").withColumn("kind", F.lit("audit"))
    return feeds.with_triggers(batch, [audit])


# --- C, D ------------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, c_name AS n, c_nationkey AS k FROM customer WHERE c_nationkey = 5")
def c05_struct_fields(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("who"))
    s = fresh(spark)
    s.register("c", c, ["c_custkey"])
    s.catalog.types[("ks", "person")] = [("name", "text"), ("nation", "int")]
    s.catalog.table("c").columns["who"].type = "frozen<person>"
    return s.execute("SELECT c_custkey, who.name AS n, who.nation AS k FROM c WHERE who.nation = 5 ALLOW FILTERING")


@query("SELECT * FROM (VALUES (1, 10::BIGINT, 7::BIGINT, 9::BIGINT)) t(id, ttl, wt, mwt)")
def c10_cell_metadata(spark, d):
    s = Session(spark, clock=lambda: 5_000_000)
    s.execute("CREATE TABLE t (id int PRIMARY KEY, a int, b int)")
    s.execute("INSERT INTO t (id, a) VALUES (1, 1) USING TTL 10 AND TIMESTAMP 7")
    s.execute("UPDATE t USING TIMESTAMP 9 SET b = 2 WHERE id = 1")
    return s.execute("SELECT id, ttl(a) AS ttl, writetime(a) AS wt, maxwritetime(b) AS mwt FROM t")


@query("SELECT c_custkey, substr(c_name, 1, 1) || repeat('*', length(c_name) - 3) || right(c_name, 2) AS c_name, c_nationkey FROM customer")
def c15_masked_columns(spark, d):
    s = event_session(spark, d)
    s.execute("ALTER TABLE customer ALTER c_name MASKED WITH mask_inner(1, 2)")
    s.execute("GRANT select ON customer TO reader")
    return Session(spark, s.catalog, role="reader").execute("SELECT c_custkey, c_name, c_nationkey FROM customer")


@query("SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1")
def d06_token_relation(spark, d):
    """The keys on either side of a key's token are all keys, each on one side."""
    s = event_session(spark, d)
    above = s.execute("SELECT c_custkey FROM customer WHERE token(c_custkey) > token(10)")
    below = s.execute("SELECT c_custkey FROM customer WHERE token(c_custkey) <= token(10)")
    return above.unionByName(below).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING list_contains(list(o_orderkey), 77)")
def d07_contains_list(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    s = fresh(spark)
    s.register("o", o, ["o_custkey"], indexed=["keys"])
    return s.execute("SELECT o_custkey FROM o WHERE keys CONTAINS 77")


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 2")
def d13_custom_index(spark, d):
    s = event_session(spark, d)
    s.index_classes["modulo"] = lambda c, v: c % 5 == v
    s.execute("CREATE CUSTOM INDEX fives ON customer(c_nationkey) USING 'modulo'")
    return s.execute("SELECT c_custkey FROM customer WHERE expr(fives, 2)")


@query("SELECT * FROM (VALUES (0, TRUE), (1, TRUE), (2, TRUE), (3, FALSE)) t(i, rejected)")
def d14_restriction_rules(spark, d):
    s, out = event_session(spark, d), []
    for i, text in enumerate(("SELECT * FROM events WHERE event_id = 3", "SELECT * FROM events WHERE value > 3", "SELECT * FROM events WHERE user_id > 3", "SELECT * FROM events WHERE user_id = 3 AND ts > '2024-01-01'")):
        try:
            s.execute(text)
            out.append((i, False))
        except InvalidRequest:
            out.append((i, True))
    return spark.createDataFrame(out, "i int, rejected boolean")


@query("SELECT p_partkey FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'widget')")
def d21_tokenized_text(spark, d):
    return read(spark, d, "part").where(F.array_contains(scalar.tokens(F.col("p_name"), ["the"]), "widget")).select("p_partkey")


@query(MERGED + "SELECT key, seq, kind FROM b WHERE seq >= base AND NOT (kind = 'SET' AND value <= 2000)")
def d24_compaction_filter(spark, d):
    return reconcile.compact(event_log(spark, d), keep=F.col("value") > 2000).select("key", "seq", "kind")


@query("SELECT * FROM (VALUES (3, 5), (5, 8)) t(start, stop)")
def d29_truncated_spans(spark, d):
    s = spark.createDataFrame([(1, 5), (5, 9), (20, 30)], "start int, end int")
    return spans.truncate(s, 3, 8).withColumnRenamed("end", "stop")


# --- E, F -------------------------------------------------------------------------------------------------------

@query("SELECT event_id AS key, 'a' AS src FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b' FROM events WHERE event_id % 3 = 0")
def e01_sorted_merge(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("key"))
    return kv.scan(e.where("key % 2 = 0").withColumn("src", F.lit("a")).unionByName(e.where("key % 3 = 0").withColumn("src", F.lit("b"))), columns=("key", "src"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def e06_index_to_rows(spark, d):
    hits = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(hits, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def e13_shadowed_keys(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT * FROM (VALUES ('sum', '45'), ('error', chr(5) || chr(3) || 'sum1' || chr(6) || chr(4) || 'none2'), ('last3', 'f,c,d')) t(func, payload)")
def f21_named_aggregate_errors(spark, d):
    ops = spark.createDataFrame([([("sum", "10"), ("sum", "20"), ("sum", "15")],), ([("sum", "1"), ("none", "2")],), ([("last3", "a,b"), ("last3", "c,d,e"), ("last3", "f")],)], "ops array<struct<func:string,payload:string>>")
    return ops.select(folds.aggregate_merge(F.col("ops")).alias("r")).select("r.func", "r.payload")


@query(MERGED + "SELECT key, CAST(sum(value) AS BIGINT) AS value FROM k GROUP BY key HAVING sum(value) > 5000")
def f23_deletable_merge(spark, d):
    """A merge whose result may be nothing: such keys go."""
    drop_small = lambda v, seq: F.when(F.sum(v) > 5000, F.sum(v))
    return reconcile.merged(event_log(spark, d), drop_small).where("value is not null").select("key", "value")


@query("SELECT o_orderkey * 7 AS key, TRUE AS close FROM orders")
def f28_rank_inverse(spark, d):
    """Of every key: whether the key at its predicted rank is within twice the error, in steps of seven, of it."""
    keys = read(spark, d, "orders").select(F.lit(0).cast("long").alias("model"), (F.col("o_orderkey") * 7).cast("double").alias("key"))
    seg = models.fit_plr(keys, "model", "key", 2.0)
    asked = models.predict(keys, seg).select("model", F.col("rank").alias("pos"), F.col("key").alias("want"))
    back = models.inverse(asked.select("model", "pos").distinct(), seg)
    return back.join(asked, ["model", "pos"]).select(F.col("want").cast("long").alias("key"), (F.abs(F.col("key") - F.col("want")) <= 2 * 2 * 7).alias("close"))


@query("SELECT o_orderkey AS key, TRUE AS close FROM orders WHERE o_orderkey % 10 = 0")
def f29_merged_rank_models(spark, d):
    """Ranks by the merged model of two interleaved key sets are near the exact ranks in their union."""
    o = read(spark, d, "orders").select(F.col("o_orderkey"))
    keys = o.select(F.lit(0).cast("long").alias("m"), F.col("o_orderkey").alias("k")).unionByName(o.select(F.lit(1).cast("long").alias("m"), (F.col("o_orderkey") * 3 + 0.5).alias("k")))
    merged = models.merge_plr(models.fit_plr(keys, "m", "k", 1.0))
    exact = ranks.ranked(keys.select(F.col("k").cast("double").alias("key")).distinct(), ["key"], "exact").where("key = floor(key) and key % 10 = 0")
    got = models.predict(exact.select(F.lit(0).cast("long").alias("model"), "key"), merged).join(exact, "key")
    return got.select(F.col("key").cast("long").alias("key"), (F.abs(F.col("rank") - F.col("exact")) <= 5).alias("close"))


@query("SELECT * FROM (VALUES (7, 14)) t(least, most)")
def f31_feasible_totals(spark, d):
    m = models.DiscreteCdf([(10, 19, 4), (30, 39, 3)])
    return spark.createDataFrame([models.merge_discrete([m, m])], "least int, most int")


@query("SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def f35_histograms(spark, d):
    """A streaming histogram per group keeps the mass: its weighted mean is the mean."""
    h = read(spark, d, "events").groupBy("event_type").agg(F.histogram_numeric("value", F.lit(40)).alias("h"))
    total = lambda f: F.aggregate("h", F.lit(0.0), lambda s, b: s + f(b).cast("double"))
    return h.select("event_type", F.round(total(lambda b: b["x"] * b["y"]) / total(lambda b: b["y"]), 4).alias("mean"))


# --- G, H, I -------------------------------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES (14, 3, 14400000000000), (0, 0, 320688000000000), (0, 21, 0)) t(months, days, nanos)")
def g09_duration_literals(spark, d):
    return spark.createDataFrame([scalar.parse_duration(x) for x in ("P1Y2M3DT4H", "89h4m48s", "P3W")], "months int, days int, nanos long")


@query("SELECT * FROM (VALUES (1, -4069959284402364209), (2, -3248873570005575792), (3, 9010454139840013625)) t(k, token)")
def g15_tokens(spark, d):
    k = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    return k.select("k", scalar.token(scalar.as_blob(F.col("k"), "int")).alias("token"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS j FROM events")
def g17_json(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("j"))


@query("SELECT vec_id, CAST(round(embedding[1] * 1000) AS INTEGER) AS first, CAST(round(embedding[64] * 1000) AS INTEGER) AS last, CAST(256 AS INTEGER) AS n FROM embeddings")
def g36_vector_bytes(spark, d):
    """Elements read back from the bytes of a vector (big-endian single precision)."""
    e = read(spark, d, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("b"))

    def element(i: int):
        bits = F.conv(F.substring(F.hex("b"), 8 * i + 1, 8), 16, 10).cast("long")
        sign = F.when(bits >= 2**31, -1.0).otherwise(1.0)
        exponent, part = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(2**23 - 1))
        whole = F.when(exponent == 0, part / 2.0**22).otherwise(1 + part / 2.0**23)
        return sign * whole * F.pow(F.lit(2.0), exponent - 127)

    # single precision, as the vectors are: the product is rounded before the whole number is taken
    cut = lambda i: F.round(element(i).cast("float") * F.lit(1000).cast("float")).cast("int")
    return e.select("vec_id", cut(0).alias("first"), cut(63).alias("last"), F.octet_length("b").alias("n"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def h02_newest_version(spark, d):
    return reconcile.newest(read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, count(*) AS n FROM events GROUP BY 1")
def h04_first_row_of_group(spark, d):
    return aggregates.group_by_prefix(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], n=F.count(F.lit(1))).withColumnRenamed("event_type", "first_type")


@query("SELECT o_orderkey // 1000 AS file, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def i10_prefix_partitioned_files(spark, d):
    out = export(order_view(spark, d).withColumn("file", F.floor(F.col("key") / 1000)), "prefix", ["file"])
    return out.groupBy(F.col("file").cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@query("SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders")
def i09_sorted_bulk_build(spark, d):
    """Range-partitioned, sorted files with each row's place in the whole order."""
    placed = ranks.ranked(order_view(spark, d).select("key"), ["key"], "n").withColumn("n", F.col("n") + 1)
    return export(placed.repartitionByRange(4, "n").sortWithinPartitions("n"), "sorted")


# --- K, L, M ----------------------------------------------------------------------------------------------------------

@query("SELECT user_id, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def k05_running_merge(spark, d):
    """A merge operator as running state of a stream, read from its last update of each key."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = L.as_log(feed, F.col("user_id"), F.col("event_id"), F.col("event_id"))
    state = scratch(spark, "merge-state")
    merged = feeds.running_merge(log, folds.total(F.col("value"), F.col("seq")))
    merged.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.format("statestore").load(state)
    return kept.select(F.col("key.key").alias("user_id"), F.col("value.sum").alias("total"))


@query(MERGED + "SELECT key, CAST(sum(value) AS BIGINT) AS value, max(seq) AS seq, CAST(1 AS BIGINT) AS n FROM k GROUP BY key")
def k07_compaction(spark, d):
    """The compacted log is one row a key, and reading it gives what reading the log gives."""
    log = event_log(spark, d)
    out = export(reconcile.compact(log, fold="uint64add", gc_before=2**62).repartitionByRange(4, "key").sortWithinPartitions("key"), "compacted")
    seen = out.groupBy("key").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return reconcile.merged(out, "uint64add").join(seen, "key").select("key", "value", "seq", "n")


@query(f"WITH {LOG} SELECT seq % 4 AS file, round(count(*) FILTER (WHERE kind = 'DEL') / count(*), 6) AS density FROM log GROUP BY 1")
def k09_deletion_density(spark, d):
    log = event_log(spark, d)
    return log.groupBy((F.col("seq") % 4).alias("file")).agg(F.round(F.count_if(F.col("kind") == "DEL") / F.count(F.lit(1)), 6).alias("density"))


@query("SELECT c_custkey, c_nationkey + 1 AS a, upper(c_mktsegment) || '!' AS b FROM customer")
def l01_user_functions(spark, d):
    s = event_session(spark, d)
    s.execute("CREATE FUNCTION more(x int) RETURNS NULL ON NULL INPUT RETURNS int LANGUAGE sql AS 'x + 1'")
    s.execute("CREATE FUNCTION more(x text) RETURNS NULL ON NULL INPUT RETURNS text LANGUAGE python AS $$ x.upper() + '!' $$")
    return s.execute("SELECT c_custkey, more(c_nationkey) AS a, more(c_mktsegment) AS b FROM customer")


@query("SELECT c_nationkey AS nation, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer GROUP BY 1")
def l04_user_aggregates(spark, d):
    s = fresh(spark)
    s.register("c", read(spark, d, "customer"), ["c_nationkey"], ["c_custkey"])
    s.execute("CREATE FUNCTION st(s bigint, v bigint) CALLED ON NULL INPUT RETURNS bigint LANGUAGE sql AS 's + v'")
    s.execute("CREATE AGGREGATE summed(bigint) SFUNC st STYPE bigint INITCOND 0")
    return s.execute("SELECT c_nationkey AS nation, summed(c_custkey) AS total FROM c GROUP BY c_nationkey")


@query("SELECT * FROM (VALUES ('bob', 'modify', 'orders'), ('bob', 'select', 'orders')) t(role, permission, resource)")
def m07_permissions(spark, d):
    s = event_session(spark, d)
    for text in ("CREATE ROLE bob", "GRANT select ON orders TO bob", "GRANT modify ON orders TO bob", "GRANT unmask ON orders TO bob", "REVOKE unmask ON orders FROM bob"):
        s.execute(text)
    return s.execute("LIST ALL PERMISSIONS OF bob")


@query("SELECT i, i > 2 AS stopped FROM (VALUES (1), (2), (3), (5)) t(i)")
def m08_guardrails(spark, d):
    s, out = event_session(spark, d), []
    s.guardrails["in_values"] = 2
    for n in (1, 2, 3, 5):
        try:
            s.execute(f"SELECT * FROM customer WHERE c_custkey IN ({', '.join(map(str, range(n)))})")
            out.append((n, False))
        except InvalidRequest:
            out.append((n, True))
    return spark.createDataFrame(out, "i int, stopped boolean")


@query("SELECT 'more jobs' AS suggestion")
def n10_rules(spark, d):
    facts = read(spark, d, "events").select(F.concat_ws(" ", "event_type", "props").alias("value"))
    rules = spark.createDataFrame([("r1", "c1", "^error", "more jobs"), ("r1", "c2", '"k": 6', "more jobs"), ("r2", "c3", "never seen", "no")], "rule string, condition string, pattern string, suggestion string")
    return files.triggered(facts, rules).select("suggestion")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def n09_rates_over_time(spark, d):
    e = read(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


@query("SELECT count(*) AS rows_seen, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT * FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey DESC LIMIT 500)")
def n12_scan_benchmark(spark, d):
    rows = kv.scan(kv.between(order_view(spark, d), 100), reverse=True).limit(500)
    return rows.agg(F.count(F.lit(1)).alias("rows_seen"), F.sum("key").alias("total"))
