"""Engine semantics: fixtures with stated results, a dict model with random operations, rules of the language."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from stratakv import log as L
from stratakv.catalog import InvalidRequest, Unauthorized
from stratakv.functions import scalar
from stratakv.operators import aggregates, folds, kv, models, reconcile, spans, vectors, wide
from stratakv.plans import parser
from stratakv.plans.session import Session
from stratakv.sources import files
from stratakv.streaming import feeds


@pytest.fixture
def session(spark):
    return Session(spark, clock=lambda: 1_700_000_000_000_000)


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- log and views ------------------------------------------------------------------------------------

def test_batch_get(spark):
    points, _ = L.WriteBatch().put("a", "1").put("a", "2").commit(spark, 1)
    assert rows(kv.get(reconcile.live(points), "a").select("value")) == [("2",)]
    more, _ = L.WriteBatch().delete("a").commit(spark, 3)
    assert rows(reconcile.live(points.unionByName(more))) == []


def test_snapshots(spark):
    log, _ = L.WriteBatch().put("a", "1").put("a", "2").put("a", "3").commit(spark, 1)
    for s in (1, 2, 3):
        assert rows(reconcile.live(reconcile.snapshot(log, s)).select("value")) == [(str(s),)]


def test_point_collapse(spark):
    log = spark.createDataFrame([("d", "a", 5, "SET", "foo"), ("d", "b", 6, "SET", "foo"), ("d", "b", 4, "DEL", None), ("d", "c", 7, "SET", "bar"), ("d", "c", 5, "SET", "foo")], "cf string, key string, seq long, kind string, value string")
    assert sorted(rows(reconcile.live(log).select("key", "value"))) == [("a", "foo"), ("b", "foo"), ("c", "bar")]


def test_model_of_random_operations(spark):
    rng = random.Random(7)
    batch, model = L.WriteBatch(), {}
    for i in range(400):
        k = f"k{rng.randrange(40):02d}"
        op = rng.random()
        if op < 0.6:
            batch.put(k, str(i))
            model[k] = str(i)
        elif op < 0.8:
            batch.delete(k)
            model.pop(k, None)
        else:
            end = f"k{rng.randrange(40):02d}"
            batch.delete_range(min(k, end), max(k, end))
            model = {x: v for x, v in model.items() if not min(k, end) <= x < max(k, end)}
    log, ranges = batch.commit(spark, 1)
    got = reconcile.live(reconcile.without_covered(log, ranges, spans.text_bucket(2)))
    assert dict(rows(got.select("key", "value"))) == model


def test_merges(spark):
    log, _ = L.WriteBatch().put("a", "1").merge("a", "2").merge("b", "9").merge("b", "x").delete("c").merge("c", "4").put("e", "1").delete("e").commit(spark, 1)
    got = lambda how: dict(rows(reconcile.merged(log, how).select("key", "value")))
    assert got("uint64add") == {"a": 3, "b": 9, "c": 4}
    assert got("stringappend") == {"a": "1,2", "b": "9,x", "c": "4"}
    assert got("max") == {"a": "2", "b": "x", "c": "4"} and got("put") == {"a": "2", "b": "x", "c": "4"}
    with pytest.raises(ValueError):
        folds.fold("none")


def test_uint64add_wraps(spark):
    df = spark.createDataFrame([(1, 2**63 - 1), (2, 2**63 - 1), (3, 4)], "seq long, v long")
    assert rows(df.agg(folds.uint64add(F.col("v"), F.col("seq")))) == [(2,)]


def test_xor_keeps_the_longer_tail(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02"), bytearray(b"\x03\x04\x05"))], "a binary, b binary")
    assert bytes(df.select(folds.xor_bytes(F.col("a"), F.col("b"))).first()[0]) == b"\x02\x06\x05"


@pytest.mark.parametrize(
    "operands, want",
    [
        ([("sum", "10"), ("sum", "20"), ("sum", "15")], ("sum", "45")),
        ([("", "30"), ("sum", "10"), ("sum", "20")], ("sum", "60")),
        ([("mul", "10"), ("mul", "20"), ("sum", "30"), ("sum", "40")], ("sum", "270")),
        # The stated results of named aggregates.
        ([("last3", "a,b"), ("last3", "c,d,e"), ("last3", "f")], ("last3", "f,c,d")),
        ([("sum", "1"), ("other", "2")], ("error", "\x05\x03sum1\x07\x05other2")),
        ([("sum", "1"), ("sum", "x")], ("error", "\x05\x03sum1\x05\x03sumx")),
    ],
)
def test_named_aggregates(spark, operands, want):
    df = spark.createDataFrame([(operands,)], "ops array<struct<func:string,payload:string>>")
    got = df.select(folds.aggregate_merge(F.col("ops")).alias("r")).first().r
    assert (got.func, got.payload) == want


def test_cells_and_row_tombstone(spark):
    data = [("p", f"c{t}", "v", t, False, None) for t in (5, 6, 10, 12, 13, 14)] + [("p", None, None, 11, True, None)]
    m = spark.createDataFrame(data, "pk string, column string, value string, wt long, deleted boolean, expire_at long")
    assert sorted(r.column for r in reconcile.cells(m, ["pk"]).collect()) == ["c12", "c13", "c14"]


def test_range_key_mask(spark):
    points = spark.createDataFrame([("a", 2), ("a", 3), ("a", 9), ("a", 10), ("b", None)], "key string, suffix int")
    cover = spark.createDataFrame([("a", "d", 8)], "start string, end string, suffix int")
    masked = lambda m: sorted(rows(spans.masked(points, cover, m, spans.text_bucket(1))), key=str)
    assert masked(8) == [("a", 10), ("a", 9), ("b", None)]
    assert len(masked(7)) == 5


def test_spans(spark):
    s = spark.createDataFrame([(1, 10, 1, "a", "x", "SET"), (5, 15, 2, "a", "y", "SET"), (20, 25, 3, "a", "z", "SET"), (22, 23, 4, None, None, "DEL"), (3, 4, 5, "a", None, "UNSET")], "start int, end int, seq long, suffix string, value string, kind string")
    got = sorted(rows(spans.newest_per_piece(s)))
    assert got == [(1, 3, "a", "x"), (4, 5, "a", "x"), (5, 10, "a", "y"), (10, 15, "a", "y"), (20, 22, "a", "z"), (23, 25, "a", "z")]
    one = spark.createDataFrame([(1, 10)], "start int, end int")
    assert rows(spans.truncate(one, 3, 20)) == [(3, 10)] and sorted(rows(spans.excise(one, 3, 5))) == [(1, 3), (5, 10)]


def test_key_value_reads(spark):
    v = spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("value"))
    assert [r[0] for r in rows(kv.between(v, 251, 751).orderBy("key"))] == list(range(251, 751))
    assert rows(kv.seek(v, 2000)) == [] and rows(kv.seek_for_prev(v, 5000)) == [(999, 999)]
    with pytest.raises(ValueError):
        kv.page(v, 0, ["key"])
    with pytest.raises(ValueError):
        kv.multi_scan(v, [(5, 9), (8, 10)])
    seen, after = [], None
    while page := rows(kv.page(v.where("key < 110"), 25, ["key"], after)):
        seen += [r[0] for r in page]
        after = [page[-1][0]]
    assert seen == list(range(110))
    p = spark.createDataFrame([(f"{chr(97 + i)}", s) for i in range(26) for s in (1, 10, 100)], "prefix string, suffix int")
    first = kv.first_per_prefix(p, F.col("prefix"), [F.desc("suffix")])
    assert sorted(rows(first)) == [(chr(97 + i), 100) for i in range(26)]


def test_secondary_index_and_entities(spark):
    v = spark.createDataFrame([("a", "x"), ("b", "xx"), ("c", "x"), ("d", None)], "key string, c string")
    assert sorted(rows(wide.lookup(v, wide.index(v, "c"), "x").select("key"))) == [("a",), ("c",)]
    e = spark.range(1).select(wide.entity(b=F.lit("2"), a=F.lit("1"), z=F.lit(None)).alias("e"))
    assert [tuple(x) for x in e.select(wide.sorted_columns("e")).first()[0]] == [("a", "1"), ("b", "2")]


# --- functions -----------------------------------------------------------------------------------------

def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    lit = lambda x, t: F.lit(x).cast(t)
    assert get(scalar.add(lit(2147483647, "int"), lit(1, "int"), "int")) == -2147483648
    assert get(scalar.multiply(lit(2**62, "bigint"), lit(4, "bigint"), "bigint")) == 0
    assert get(scalar.divide(lit(-7, "int"), lit(2, "int"), "int")) == -3
    assert get(scalar.divide(lit(1.0, "double"), lit(0.0, "double"), "double")) == float("inf")
    assert get(scalar.round_half_up(F.lit(-2.5))) == -2 and get(scalar.exp(lit(1, "int"), "int")) == 2
    assert scalar.result_type("int", "float") == "float" and scalar.result_type("bigint", "float") == "double"
    assert scalar.parse_duration("89h4m48s") == (0, 0, (89 * 3600 + 4 * 60 + 48) * 10**9)
    assert scalar.parse_duration("P1Y2M3DT4H") == (14, 3, 4 * 3600 * 10**9)
    assert scalar.parse_duration("P0001-02-03T00:00:01") == (14, 3, 10**9)
    assert get(scalar.mask_inner(F.lit("Alice"), 1, 2)) == "A**ce" and get(scalar.mask_outer(F.lit("Alice"), 1, 2)) == "*li**"
    assert get(scalar.list_remove(F.array(*map(F.lit, [1, 2, 1, 3])), F.array(F.lit(1)))) == [2, 3]
    assert get(scalar.map_put(F.create_map(F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))) == {"a": 2, "b": 1}
    for kind, x in (("int", -5), ("bigint", -(2**63)), ("smallint", 7), ("text", "é"), ("boolean", True)):
        assert get(scalar.blob_as(scalar.as_blob(lit(x, {"text": "string"}.get(kind, kind)), kind), kind)) == x
    assert get(scalar.analyzed(F.lit("Ünï"), False, True, True)) == "uni"
    u = "d2177dd0-eaa2-11de-a572-001b779c76e3"
    ms = (uuid.UUID(u).time - scalar.GREGORIAN) // 10000
    assert get(scalar.timeuuid_millis(F.lit(u))) == ms
    assert get(scalar.timeuuid_timestamp(F.lit(u))) == dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    lo, hi = (get(scalar.timeuuid_bound(F.lit(ms).cast("long"), largest)) for largest in (False, True))
    assert get(scalar.timeuuid_ticks(F.lit(lo))) <= get(scalar.timeuuid_ticks(F.lit(u))) <= get(scalar.timeuuid_ticks(F.lit(hi)))


def test_tokens():
    # known values of the partitioner for 32-bit and text keys
    assert scalar.murmur3_token((1).to_bytes(4, "big")) == -4069959284402364209
    assert scalar.murmur3_token(b"") == 0


@pytest.mark.parametrize(
    "how, a, b, want",
    [
        ("cosine", [0.1, 0.2], [0.1, 0.2], 1.0), ("cosine", [0.1, 0.2], [-0.1, -0.2], 0.0), ("cosine", [0.1, 0.2], [0.9, 0.8], 0.964238),
        ("euclidean", [0.1, 0.2], [0.1, 0.2], 1.0), ("euclidean", [0.1, 0.2], [-0.1, -0.2], 0.833333), ("euclidean", [0.1, 0.2], [0.9, 0.8], 0.5),
        ("dot_product", [0.1, 0.2], [0.1, 0.2], 0.525), ("dot_product", [0.1, 0.2], [-0.1, -0.2], 0.475), ("dot_product", [0.1, 0.2], [0.9, 0.8], 0.625),
    ],
)
def test_similarities(spark, how, a, b, want):
    got = spark.range(1).select(vectors.SIMILARITIES[how](vectors.vector(a), vectors.vector(b)).alias("v")).first().v
    assert abs(got - want) < 1e-6


def test_vector_bytes(spark):
    import struct

    xs = [0.0, 1.0, -2.5, 3.14159, 1e-10, -1e20]
    df = spark.range(1).select(vectors.vector(xs).alias("v"))
    assert bytes(df.select(vectors.to_bytes("v")).first()[0]) == struct.pack(">6f", *xs)


# --- models ------------------------------------------------------------------------------------------------

def test_rank_models(spark):
    rng = random.Random(1)
    sets = {0: sorted(rng.sample(range(10_000), 800)), 1: sorted(rng.sample(range(50_000), 500))}
    keys = spark.createDataFrame([(m, k) for m, ks in sets.items() for k in ks], "m long, k long")
    segments = models.fit_plr(keys, "m", "k", 3.0, chunk=300)
    got = models.predict(keys.select(F.col("m").alias("model"), F.col("k").alias("key")), segments).collect()
    assert all(abs(r["rank"] - sets[r.model].index(int(r.key))) <= 3.001 for r in got)
    back = models.inverse(spark.createDataFrame([(0, 100), (0, 700)], "model long, pos long"), segments).collect()
    assert all(abs(sum(x < r.key for x in sets[0]) - r.pos) <= 8 for r in back)
    both = models.merge_plr(segments)
    assert abs(both.agg(F.max("n")).first()[0] - 1300) < 60


def test_seeks_look_at_each_row_once(spark, capsys):
    trace = spark.createDataFrame([(1, "seek", 4), (2, "seek", 5), (3, "seek", 9), (4, "seek", None), (5, "get", 8)], "seq long, op string, key long")
    got = files.replay(trace, spark.createDataFrame([(5, "a"), (8, "b")], "key long, value string"))
    assert sorted((r.seq, r.found) for r in got.collect()) == [(1, 5), (2, 5), (3, None), (4, None), (5, 8)]
    got.explain()
    assert "specifiedwindowframe(RangeFrame, currentrow$(), unboundedfollowing$())" not in capsys.readouterr().out


def test_discrete_models(spark):
    m = models.DiscreteCdf([(10, 19, 4), (30, 39, 3)])
    assert m.count == 7 and [m.count_less_than(m.select(r)) for r in range(7)] == list(range(7))
    assert m.slice(2, 4) == [m.select(2), m.select(3)]
    assert models.merge_discrete([m, m]) == (7, 14)
    table = spark.createDataFrame([(10, 19, 4), (30, 39, 3)], "key_min long, key_max long, num long")
    assert sorted(r.key for r in models.materialize(table).collect()) == m.slice(0, 7)
    s = models.SizeModel([(10, 1200), (20, 2200)])
    assert s.estimate(15) == 1700 and s.max_entries(1700) == 15 and s.estimate(2**62) == models.SizeModel.LIMIT


def test_sketch_union(spark):
    df = spark.range(4096 * 4).select((F.col("id") % 4).alias("f"), F.col("id").alias("k"))
    n = aggregates.sketch_union(df, "k", ["f"], 11).first().n
    assert abs(n / (4096 * 4) - 1) < 0.08


# --- query language --------------------------------------------------------------------------------------------

def test_counter_and_static(session):
    x = session.execute
    x("CREATE TABLE pc (id int PRIMARY KEY, popularity counter)")
    for d in ("+ 1", "+ 125", "- 64", "+ 2"):
        x(f"UPDATE pc SET popularity = popularity {d} WHERE id = 1")
    assert rows(x("SELECT popularity FROM pc")) == [(64,)]
    x("CREATE TABLE f (country text, name text, flag int STATIC, PRIMARY KEY (country, name))")
    for r in (("B", "J", 1), ("B", "A", 1), ("F", "A", 2), ("F", "G", 3)):
        x("INSERT INTO f (country, name, flag) VALUES (?, ?, ?)", r)
    assert sorted(rows(x("SELECT * FROM f"))) == [("B", "A", 1), ("B", "J", 1), ("F", "A", 3), ("F", "G", 3)]
    assert sorted(rows(x("SELECT DISTINCT country, flag FROM f"))) == [("B", 1), ("F", 3)]


def test_collections_and_conditions(session):
    x = session.execute
    x("CREATE TABLE m (id int PRIMARY KEY, fav map<text, text>, tags set<text>, l list<int>)")
    x("INSERT INTO m JSON '{\"id\": 1, \"fav\": {\"a\": \"b\"}, \"tags\": [\"y\", \"x\"], \"l\": [1, 2, 1]}'")
    x("UPDATE m SET fav['z'] = 'q', tags = tags + {'b'}, l = [0] + l WHERE id = 1")
    x("UPDATE m SET l[1] = 9, tags = tags - {'x'} WHERE id = 1")
    x("DELETE fav['a'], l[0] FROM m WHERE id = 1")
    assert rows(x("SELECT fav, tags, l FROM m")) == [({"z": "q"}, ["b", "y"], [9, 2, 1])]
    x("UPDATE m SET l = l - [1] WHERE id = 1")
    assert rows(x("SELECT l, collection_sum(l), collection_max(l) FROM m")) == [([9, 2], 11, 9)]
    assert rows(x("INSERT INTO m (id) VALUES (1) IF NOT EXISTS")) == [(False,)]
    assert rows(x("UPDATE m SET tags = {'n'} WHERE id = 1 IF l[0] = 9 AND tags CONTAINS 'b'")) == [(True,)]
    assert rows(x("SELECT id FROM m WHERE tags CONTAINS 'n' ALLOW FILTERING")) == [(1,)]
    with pytest.raises(InvalidRequest):
        x("UPDATE m SET l[5] = 1 WHERE id = 1")


def test_ttl_timestamp_and_ranges(spark):
    now = [1_000_000_000]
    s = Session(spark, clock=lambda: now[0])
    x = s.execute
    x("CREATE TABLE t (k int, c int, v int, PRIMARY KEY (k, c)) WITH default_time_to_live = 100")
    x("INSERT INTO t (k, c, v) VALUES (1, 1, 1) USING TTL 10 AND TIMESTAMP 5")
    x("INSERT INTO t (k, c, v) VALUES (1, 2, 2)")
    assert sorted(rows(x("SELECT c, ttl(v), writetime(v) FROM t"))) == [(1, 10, 5), (2, 100, 1_000_000_000)]
    x("UPDATE t USING TIMESTAMP 4 SET v = 7 WHERE k = 1 AND c = 1")
    assert rows(x("SELECT v FROM t WHERE k = 1 AND c = 1")) == [(1,)]
    now[0] += 11_000_000
    assert rows(x("SELECT c FROM t")) == [(2,)]
    for c in range(3, 9):
        x("INSERT INTO t (k, c, v) VALUES (1, ?, 0)", [c])
    x("DELETE FROM t WHERE k = 1 AND c > 3 AND c <= 6")
    assert sorted(rows(x("SELECT c FROM t WHERE k = 1"))) == [(2,), (3,), (7,), (8,)]
    with pytest.raises(InvalidRequest):
        x("INSERT INTO t (k, c) VALUES (1, 1) USING TTL -1")


def test_user_functions_views_masks_roles(spark, session):
    x = session.execute
    x("CREATE TABLE a (pk int PRIMARY KEY, val int, name text MASKED WITH mask_inner(1, 2))")
    for i in range(1, 5):
        x("INSERT INTO a (pk, val, name) VALUES (?, ?, 'Alice')", [i, i])
    x("CREATE FUNCTION st(s tuple<int, bigint>, v int) CALLED ON NULL INPUT RETURNS tuple<int, bigint> LANGUAGE sql AS 'struct(s._0 + 1, s._1 + v)'")
    x("CREATE FUNCTION fin(s tuple<int, bigint>) CALLED ON NULL INPUT RETURNS double LANGUAGE sql AS 's._1 / s._0'")
    x("CREATE AGGREGATE average(int) SFUNC st STYPE tuple<int, bigint> FINALFUNC fin INITCOND (0, 0)")
    assert rows(x("SELECT average(val) FROM a")) == [(2.5,)]
    x("CREATE FUNCTION twice(v int) RETURNS NULL ON NULL INPUT RETURNS int LANGUAGE python AS 'v * 2'")
    assert sorted(rows(x("SELECT twice(val) FROM a"))) == [(2,), (4,), (6,), (8,)]
    x("CREATE MATERIALIZED VIEW v AS SELECT val, pk FROM a WHERE val IS NOT NULL AND pk IS NOT NULL PRIMARY KEY (val, pk)")
    assert rows(x("SELECT pk FROM v WHERE val = 3")) == [(3,)]
    with pytest.raises(InvalidRequest):
        x("CREATE MATERIALIZED VIEW w AS SELECT val FROM a WHERE val IS NOT NULL PRIMARY KEY (val)")
    x("CREATE ROLE bob")
    x("GRANT select ON a TO bob")
    bob = Session(spark, session.catalog, role="bob")
    assert rows(bob.execute("SELECT name FROM a WHERE pk = 1")) == [("A**ce",)]
    assert rows(x("SELECT name FROM a WHERE pk = 1")) == [("Alice",)]
    for q in ("SELECT pk FROM a WHERE name = 'Alice' ALLOW FILTERING", "INSERT INTO a (pk) VALUES (9)"):
        with pytest.raises(Unauthorized):
            bob.execute(q)


def test_triggers_batches_types_alter(session):
    x = session.execute
    session.trigger_classes["audit"] = lambda e: ["INSERT INTO log (k) VALUES ('seen')"]
    x("CREATE TABLE log (k text PRIMARY KEY)")
    x("CREATE TYPE addr (street text, zip int)")
    x("CREATE TABLE p (id int PRIMARY KEY, home frozen<addr>)")
    x("CREATE TRIGGER t1 ON p USING 'audit'")
    x("BEGIN BATCH INSERT INTO p (id, home) VALUES (1, {street: 'x', zip: 5}); UPDATE p SET home.zip = 6 WHERE id = 1; APPLY BATCH")
    assert rows(x("SELECT home.zip AS z FROM p")) in ([(5,)], [(6,)])
    assert rows(x("SELECT k FROM log")) == [("seen",)]
    x("ALTER TABLE p ADD note text")
    x("UPDATE p SET note = 'n' WHERE id = 1")
    assert rows(x("SELECT note FROM p")) == [("n",)]
    x("ALTER TABLE p DROP note")
    x("TRUNCATE p")
    assert rows(x("SELECT * FROM p")) == []
    x("CREATE TABLE c (id int PRIMARY KEY, n counter)")
    with pytest.raises(InvalidRequest):
        x("BEGIN BATCH INSERT INTO p (id) VALUES (1); UPDATE c SET n = n + 1 WHERE id = 1; APPLY BATCH")


@pytest.mark.parametrize(
    "text",
    [
        "SELECT v FROM t WHERE v = 3", "SELECT v FROM t WHERE a = 1 AND c = 1", "SELECT v FROM t WHERE a = 1 OR a = 2", "SELECT v FROM t GROUP BY b",
        "SELECT v FROM t ORDER BY b", "SELECT v FROM t WHERE a = 1 ORDER BY c", "SELECT DISTINCT v FROM t", "SELECT nope FROM t", "SELECT max(min(v)) FROM t",
        "SELECT v FROM t LIMIT 0", "SELECT v FROM t WHERE a = 1 AND a = 2", "SELECT v FROM t WHERE a IS NOT NULL", "SELECT nope(v) FROM t", "SELECT from", "INSERT INTO t (a) VALUES (1, 2)",
        "INSERT INTO t (b, c) VALUES (1, 2)", "SELECT writetime(a) FROM t", "SELECT v FROM t WHERE a = 1 AND (c) > (1)", "CREATE TABLE x (a int)", "SELECT v FROM t ORDER BY v ANN OF [1] LIMIT 1",
    ],
)
def test_rejected(session, text):
    session.execute("CREATE TABLE t (a int, b int, c int, v int, PRIMARY KEY (a, b, c))")
    with pytest.raises(InvalidRequest):
        session.execute(text)


def test_ann_and_custom_index(session):
    x = session.execute
    x("CREATE TABLE e (id int PRIMARY KEY, v vector<float, 2>, n int)")
    x("CREATE CUSTOM INDEX ON e(v) USING 'sai' WITH OPTIONS = {'similarity_function': 'euclidean'}")
    for i in range(5):
        x("INSERT INTO e (id, v, n) VALUES (?, ?, ?)", [i, [float(i), 1.0], i])
    assert rows(x("SELECT id FROM e ORDER BY v ANN OF [3.2, 1] LIMIT 2")) == [(3,), (4,)]
    session.index_classes["even"] = lambda c, v: c % 2 == v
    x("CREATE CUSTOM INDEX parity ON e(n) USING 'even'")
    assert sorted(rows(x("SELECT id FROM e WHERE expr(parity, 0)"))) == [(0,), (2,), (4,)]


def test_buffer_over_base(spark, session, tmp_path):
    base = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"), F.lit("x").alias("s"))
    session.register("b", base, ["k"])
    x = session.execute
    x("UPDATE b SET v = 5 WHERE k = 3")
    x("DELETE FROM b WHERE k = 4")
    x("INSERT INTO b (k, s) VALUES (77, 'new')")
    x("DELETE s FROM b WHERE k = 5")
    got = {r[0]: r[1:] for r in rows(x("SELECT k, v, s FROM b"))}
    assert got[3] == (5, "x") and 4 not in got and got[77] == (None, "new") and got[5] == (50, None) and len(got) == 10
    session.flush("b", str(tmp_path / "flushed"))
    assert {r[0]: r[1:] for r in rows(x("SELECT k, v, s FROM b"))} == got
    assert parser.parse("SELECT * FROM a.b WHERE token(k) > token(3) LIMIT 5").table == "a.b"


def test_filters_reach_the_scan(spark, session, capsys):
    session.register("o", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), ["o_custkey"], ["o_orderkey"])
    plan = session.execute("SELECT o_orderkey FROM o WHERE o_custkey = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_totalprice" not in plan


# --- sources and streams ------------------------------------------------------------------------------------------

def test_load_trace(spark, tmp_path):
    files.write_trace(str(tmp_path / "t.bin"), [5, 6, 2**40])
    assert [r.key_id for r in files.read_trace(spark, str(tmp_path / "t.bin")).orderBy("seq").collect()] == [5, 6, 2**40]
    assert files.generate_trace(spark, 1000).select("key_id").distinct().count() == 1000
    z = files.generate_trace(spark, 5000, 0.5, alpha=0.9)
    assert z.where("key_id < 0 or key_id >= 2500").count() == 0 and z.groupBy("key_id").count().agg(F.max("count")).first()[0] > 100


def test_copy_dump_checksums(spark, tmp_path):
    v = spark.createDataFrame([("b", "2"), ("a", "1")], "key string, value string")
    files.copy_to(v, str(tmp_path / "csv"), ["key", "value"])
    assert sorted(rows(files.copy_from(spark, str(tmp_path / "csv"), v.schema))) == [("a", "1"), ("b", "2")]
    files.dump(v, str(tmp_path / "dump"), b"DUMPFILE", {"database-path": "x"})
    raw = (tmp_path / "dump").read_bytes()
    assert raw.startswith(b"DUMPFILE" + (1).to_bytes(8, "big") + (22).to_bytes(4, "little") + b'{"database-path": "x"}' + (1).to_bytes(4, "little") + b"a")
    assert [(bytes(r.key), bytes(r.value)) for r in files.read_dump(spark, str(tmp_path / "dump"), b"DUMPFILE").collect()] == [(b"a", b"1"), (b"b", b"2")]


def test_traces_backups_followers_averages(spark, tmp_path):
    lines = spark.createDataFrame([("Access Time : 17 , File Operation: Read, Latency: 5, File Name: 000013.sst, Length: 4096, Offset: 53",), ("no record",)], "value string")
    assert rows(files.io_trace(lines)) == [(17, "Read", "000013.sst", 5, 53, 4096)]
    accesses = spark.createDataFrame([(2, "b", 10, True), (1, "a", 20, False)], "at long, block string, size long, hit boolean")
    files.cache_trace(accesses, str(tmp_path / "cache"))
    assert sorted(rows(files.read_cache_trace(spark, str(tmp_path / "cache")))) == [(1, "a", 20, False), (2, "b", 10, True)]
    views = [[("a", 1), ("b", 2)], [("a", 1), ("b", 3), ("c", 4)], [("b", 3)]]
    backups = files.Backups(spark, str(tmp_path / "backups"))
    for v in views:
        backups.create(spark.createDataFrame(v, "key string, v long"))
    assert [sorted(rows(backups.restore(i))) for i in range(3)] == views
    assert spark.read.parquet(str(tmp_path / "backups" / "1")).count() == 2
    log = spark.createDataFrame([("default", "a", 1, "SET", 5, 1, None), ("default", "a", 2, "DEL", None, 2, None), ("default", "b", 3, "SET", 6, 3, None)], LOG_SCHEMA)
    log.write.parquet(str(tmp_path / "log"))
    assert [r.key for r in files.follower(spark, str(tmp_path / "log"), log.schema).collect()] == ["b"]
    assert [r.key for r in files.follower(spark, str(tmp_path / "log"), log.schema, upto=1).collect()] == ["a"]
    samples = [(g, i, float(i * i % 7)) for g in "xy" for i in range(9)]
    want = {}
    for g, _, v in samples:
        want[g] = v if g not in want else want[g] + 0.25 * (v - want[g])
    got = files.moving_average(spark.createDataFrame(samples, "g string, i long, v double"), "v", ["i"], ["g"], 0.25)
    assert {r.g: round(r.average, 9) for r in got.collect()} == {g: round(v, 9) for g, v in want.items()}


def test_size_model_from_samples(spark):
    data = [(n, 100 * n + 500 + (n * 37 % 11)) for n in range(1, 200)]
    m = models.SizeModel.fitted(spark.createDataFrame(data, "n long, b long"), "n", "b")
    assert all(m.estimate(n) >= b for n, b in data) and sum(m.estimate(n) - b for n, b in data) < 11 * len(data)


def test_islands_without_groups(spark):
    data = [(1, 4), (3, 6), (6, 7), (9, 10), (9, 10), (20, 30), (22, 23), (28, 35)]
    df = spark.createDataFrame(data, "start long, end long")
    assert sorted(rows(spans.islands(df))) == [(1, 7), (9, 10), (20, 35)]


def test_rule_engine_and_log_words(spark):
    facts = spark.createDataFrame([("stall at level 3",), ("size=5 time=9",)], "value string")
    rules = spark.createDataFrame([("r1", "c1", "stall", "more jobs"), ("r1", "c2", "level [0-9]", "more jobs"), ("r2", "c3", "never", "no")], "rule string, condition string, pattern string, suggestion string")
    assert rows(files.triggered(facts, rules)) == [("r1", "more jobs")]
    assert facts.where("value like 'size%'").select(files.key_values("value")).first()[0] == {"size": "5", "time": "9"}


def test_change_feed_and_view(spark, tmp_path):
    schema = "cf string, key string, seq long, kind string, value string"
    put = lambda *r: spark.createDataFrame(list(r), schema).write.mode("append").parquet(str(tmp_path / "log"))
    view = feeds.IncrementalView(spark, str(tmp_path / "view"), ["value"], lambda b: b.select("value", "key", "seq", "kind"))
    put(("d", "a", 1, "SET", "x"), ("d", "b", 2, "SET", "y"))
    for _ in range(2):
        feeds.run_available(feeds.change_feed(spark, str(tmp_path / "log"), schema), view.apply, str(tmp_path / "ck"))
        put(("d", "c", 3, "SET", "x"), ("d", "b", 4, "DEL", "y"))
    assert sorted(rows(view.rows().select("value", "key"))) == [("x", "c")]
    spark.createDataFrame([("d", "a", 1, "SET", "x"), ("d", "a", 2, "SET", "z")], schema).write.parquet(str(tmp_path / "c"))
    logged = spark.createDataFrame([("d", "a", 1, "SET", "x", 1, None), ("d", "a", 2, "DEL", None, 2, None)], schema + ", ts long, expire_at long")
    logged.write.parquet(str(tmp_path / "full"))
    feeds.compact_folder(spark, str(tmp_path / "full"), str(tmp_path / "out"), logged.schema, gc_before=5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


def test_view_of_many_batches(spark, tmp_path):
    """After every batch the view is what the newest rows of all batches so far give; a batch may come twice."""
    batches = [[(k, i, "DEL" if (i + k) % 4 == 0 else "SET") for k in range(i % 3, 6)] for i in range(7)]
    view = feeds.IncrementalView(spark, str(tmp_path / "view"), ["k"], lambda b: b, merge_every=3)
    want = {}
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "k long, seq long, kind string")
        for _ in range(1 + i % 2):
            view.apply(df, i)
        want |= {k: (seq, kind) for k, seq, kind in batch}
        assert sorted(rows(view.rows().select("k", "seq", "kind"))) == sorted((k, *v) for k, v in want.items() if v[1] == "SET")


def test_lru_cache(spark):
    t = spark.createDataFrame([(i, k) for i, k in enumerate("abcabdab")], "seq long, key string")
    assert rows(files.simulate_cache(t, 2)) == [("all", 1, 7)] or rows(files.simulate_cache(t, 3))[0][1] == 4


# --- compaction, writes that keep their times, ranks --------------------------------------------------------

def random_log(seed, n=160, keys=7):
    import random

    r = random.Random(seed)
    kinds = ["SET", "MERGE", "MERGE", "DEL", "SINGLEDEL"]
    rows = []
    for seq in range(1, n + 1):
        kind = r.choice(kinds)
        rows.append(("default", f"k{r.randrange(keys)}", seq, kind, r.randrange(100) if kind in ("SET", "MERGE") else None, seq, None))
    return rows


LOG_SCHEMA = "cf string, key string, seq long, kind string, value long, ts long, expire_at long"


def model_of(rows, upto, gone=()):
    """Sums by key as a dict: SET starts anew, DEL clears, MERGE adds; range deletes (start, end, seq)."""
    out = {}
    events = [(seq, key, kind, value) for _, key, seq, kind, value, _, _ in rows] + [(s, a, "RANGE", b) for a, b, s in gone]
    for seq, key, kind, value in sorted(events, key=lambda e: e[0]):
        if seq > upto:
            break
        if kind == "SET":
            out[key] = value
        elif kind == "MERGE":
            out[key] = out.get(key, 0) + value
        elif kind == "RANGE":
            out = {k: v for k, v in out.items() if not key <= k < value}
        else:
            out.pop(key, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fold", [None, "uint64add"])
def test_compaction_changes_no_read(spark, seed, fold):
    rows, gone = random_log(seed), [("k1", "k4", 60), ("k3", "k6", 120)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    cut = spark.createDataFrame(gone, "start string, end string, seq long")
    bucket = lambda k: F.substring(k, 2, 1).cast("long")
    for snapshots in ((), (50, 100)):
        small = reconcile.compact(log, fold=fold, snapshots=snapshots, ranges=cut, bucket=bucket)
        assert small.count() < len(rows)
        for at in (*snapshots, 10**9):
            left = reconcile.without_covered(reconcile.snapshot(small, at), cut.where(F.col("seq") <= at), bucket)
            got = {r.key: r.value for r in reconcile.merged(left, "uint64add").collect()}
            assert got == model_of(rows, at, gone)
    plain = {r.key: r.value for r in reconcile.merged(reconcile.compact(log, gc_before=10**9), "uint64add").collect()}
    assert plain == model_of(rows, 10**9)


def test_compaction_filter_and_single_deletes(spark):
    rows = [("default", "a", 1, "SET", 5, 1, None), ("default", "a", 2, "SET", 1, 2, None), ("default", "b", 3, "SET", 7, 3, None), ("default", "b", 4, "SINGLEDEL", None, 4, None), ("default", "c", 5, "SET", 1, 5, None), ("default", "c", 6, "SET", 2, 6, None), ("default", "c", 7, "SINGLEDEL", None, 7, None)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    assert [(r.key, r.kind) for r in reconcile.compact(log, keep=F.col("value") > 3).where("kind = 'SET'").collect()] == []
    kept = reconcile.compact(log, keep=F.col("value") > 3, snapshots=(1,)).where("key = 'a'").collect()
    assert sorted((r.seq, r.kind) for r in kept) == [(1, "SET"), (2, "DEL")]
    assert sorted((r.key, r.seq) for r in reconcile.cancel_single_deletes(log).collect()) == [("a", 1), ("a", 2), ("c", 5)]


def test_reads_at_a_time_hide_deleted_keys(spark):
    rows = [("default", "a", 1, "SET", 5, 10, None), ("default", "a", 2, "DEL", None, 20, None), ("default", "b", 3, "SET", 6, 15, None)]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    at = lambda ts: {r.key: r.value for r in reconcile.read_as_of(log, ts, "uint64add").collect()}
    assert at(12) == {"a": 5} and at(18) == {"a": 5, "b": 6} and at(20) == {"b": 6}
    assert [(r.key, r.value) for r in kv.mvcc_scan(log, 20).collect()] == [("b", 6)]


def test_conditional_writes_are_tested_in_turn(spark):
    pending = spark.createDataFrame([("a", 1, 3), ("a", 2, 9), ("a", 3, 4), ("a", 4, 12), ("b", 5, 1)], "key string, seq long, value long")
    view = spark.createDataFrame([("a", 5)], "key string, value long")
    got = L.conditional(pending, view, "current < value").collect()
    assert sorted((r.key, r.seq, r.applied) for r in got) == [("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 5, False)]


def test_flush_keeps_times_and_expiry(spark, tmp_path):
    moment = [1_000_000_000]
    s = Session(spark, clock=lambda: moment[0])
    s.execute("CREATE TABLE t (id int PRIMARY KEY, a int, b int)")
    s.execute("INSERT INTO t (id, a) VALUES (1, 1) USING TTL 10")
    s.execute("INSERT INTO t (id, a, b) VALUES (2, 2, 2) USING TIMESTAMP 900")
    s.execute("INSERT INTO t (id, a) VALUES (3, 3) USING TIMESTAMP 50")
    s.execute("DELETE FROM t USING TIMESTAMP 60 WHERE id = 3")
    s.flush("t", str(tmp_path / "f1"))
    s.execute("UPDATE t USING TIMESTAMP 5 SET a = 7 WHERE id = 2")  # older than the flushed cell
    s.execute("UPDATE t USING TIMESTAMP 901 SET b = 8 WHERE id = 2")
    s.execute("UPDATE t USING TIMESTAMP 55 SET a = 9 WHERE id = 3")  # older than the flushed deletion
    ask = lambda: sorted(map(tuple, s.execute("SELECT id, a, b FROM t").collect()))
    assert ask() == [(1, 1, None), (2, 2, 8)]
    assert s.execute("SELECT writetime(a) AS w, writetime(b) AS v FROM t WHERE id = 2").first()[:] == (900, 901)
    s.flush("t", str(tmp_path / "f2"))
    moment[0] += 60_000_000
    assert ask() == [(2, 2, 8)]
    s.execute("DELETE FROM t USING TIMESTAMP 902 WHERE id = 2")
    assert ask() == []


def test_buffer_spills_and_keys_reach_the_scan(spark, tmp_path, capsys):
    base = spark.range(1000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v"))
    base.write.parquet(str(tmp_path / "base"))
    s = Session(spark)
    s.buffer_rows = 3
    s.register("t", spark.read.parquet(str(tmp_path / "base")), ["k"])
    s.execute("INSERT INTO t (k, v) VALUES (5, 'new')")
    df = s.execute("SELECT k, v FROM t WHERE k = 5")
    assert [tuple(r) for r in df.collect()] == [(5, "new")]
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(k,5)" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0] and "FullOuter" not in plan
    for i in range(6):
        s.execute("INSERT INTO t (k, v) VALUES (?, 'w')", [2000 + i])
    table = s.catalog.table("t")
    assert table.flushed and len(table.rows) <= 3
    assert s.execute("SELECT count(*) AS n FROM t").first().n == 1006


def test_python_state_functions_and_user_types(spark):
    s = Session(spark)
    s.register("c", spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v bigint"), ["k"], ["v"])
    s.execute("CREATE TYPE pair (lo bigint, hi bigint)")
    s.execute("CREATE FUNCTION st(s bigint, v bigint) CALLED ON NULL INPUT RETURNS bigint LANGUAGE python AS $$ s * 10 + v $$")
    s.execute("CREATE AGGREGATE digits(bigint) SFUNC st STYPE bigint INITCOND 0")
    s.execute("CREATE FUNCTION both(v bigint) RETURNS NULL ON NULL INPUT RETURNS pair LANGUAGE python AS $$ {'lo': v - 1, 'hi': v + 1} $$")
    assert sorted(map(tuple, s.execute("SELECT k, digits(v) AS d FROM c GROUP BY k").collect())) == [(1, 23), (2, 4)]
    assert [(r.p.lo, r.p.hi) for r in s.execute("SELECT both(v) AS p FROM c WHERE k = 2").collect()] == [(3, 5)]


def test_ranks_without_one_task(spark):
    from stratakv.operators import ranks

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("key"), (F.col("id") % 3).alias("g"))
    got = ranks.ranked(df, ["key"]).collect()
    assert [r.key for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.key for r in got)
    by = ranks.ranked(df, ["key"], by=["g"]).collect()
    for g in range(3):
        own = sorted((r for r in by if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and [r.key for r in own] == sorted(r.key for r in own)


def test_orders_stops_refills_and_ranges(spark):
    view = spark.createDataFrame([("a",), ("ab",), ("b",), ("B",)], "key string")
    order = lambda kind: [r.key for r in view.orderBy(kv.sort_key(kind), "key").collect()]
    assert order("bytewise") == ["B", "a", "ab", "b"] and order("reverse") == ["b", "ab", "a", "B"] and order("nocase") == ["a", "ab", "B", "b"]
    n = spark.range(20).select(F.col("id").alias("key"))
    assert sorted(r.key for r in kv.stop_after(n, ["key"], F.col("key") % 7 == 6).collect()) == list(range(7))
    assert sorted(r.key for r in kv.concat_ranges([(n, 10, 12), (n, 2, 3)]).collect()) == [2, 3, 10, 11, 12]
    with pytest.raises(ValueError):
        kv.concat_ranges([(n, 1, 5), (n, 5, 6)])
    one = spark.createDataFrame([("a", 1, "SET"), ("b", 1, "SET"), ("c", 1, "SET")], "key string, seq long, kind string")
    two = spark.createDataFrame([("a", 2, "DEL"), ("d", 2, "SET")], "key string, seq long, kind string")
    assert [r.key for r in kv.refill([one, two], 2, ["key"]).collect()] == ["b", "c"]
