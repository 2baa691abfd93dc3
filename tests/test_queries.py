"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import datetime as dt

import duckdb
import pytest

from stratakv import queries, queries_more, queries_rows  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in queries.ORACLES:
        assert got
        return
    want = duck.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_inverted_lists_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = queries.read(spark, d, "embeddings")
    near = queries.vectors.nearest(rows, "embedding", queries.QUERY_VECTOR, 10, "euclidean", ["vec_id"])
    got = {r.vec_id for r in queries.QUERIES["i06_inverted_lists"](spark, d).collect()}
    assert len(got & {r.vec_id for r in near.collect()}) >= 9


def in_duck(name, **tables):
    """The query's SQL over tables that are given as SELECT."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"CREATE VIEW {t} AS {sql}")
    return con.sql(queries.ORACLES[name])


def given(tmp_path, **tables):
    for t, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


def test_merged_rank_models_over_many_chunks(spark):
    keys = spark.range(2000).selectExpr("0L as m", "cast(id as double) as k").union(spark.range(2000).selectExpr("1L as m", "id * 3 + 0.5D as k"))
    merged = queries.models.merge_plr(queries.models.fit_plr(keys, "m", "k", 1.0, chunk=100))
    got = queries.models.predict(spark.range(2000).selectExpr("0L as model", "cast(id as double) as key"), merged)
    assert all(abs(r["rank"] - (r.key + -(-(r.key - 0.5) // 3) * (r.key > 0.5))) <= 5 for r in got.collect())
    assert {r.n for r in merged.collect()} == {4000}


def test_vector_bytes_at_halves(spark, tmp_path):
    """0.0125 is below one half of a thousandth more in double precision and at it in single precision."""
    e = "SELECT i AS vec_id, CAST(list_transform(range(64), lambda x: (i + 0.5) / 1000) AS FLOAT[]) AS embedding FROM range(200) t(i)"
    got = queries.QUERIES["g36_vector_bytes"](spark, given(tmp_path, embeddings=e))
    assert sorted(map(tuple, got.collect())) == sorted(in_duck("g36_vector_bytes", embeddings=e).fetchall())


def test_sketch_union_beyond_the_sketch(spark, tmp_path):
    e = "SELECT i AS event_id, i AS user_id, 'view' AS event_type FROM range(20000) t(i)"
    got = queries.QUERIES["f26_sketch_union"](spark, given(tmp_path, events=e))
    assert list(map(tuple, got.collect())) == [(20000, True)]


def test_tuple_elements_have_the_names_of_the_sql(spark, duck):
    got = queries.QUERIES["c06_collection_literals"](spark, SF).toArrow().to_pylist()
    want = duck.sql(queries.ORACLES["c06_collection_literals"]).to_arrow_table().to_pylist()
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_coverage_of_tied_ranges(spark):
    r = spark.createDataFrame([(1, lo, lo + w) for lo in range(0, 300, 10) for w in (3, 3, 12, 3, 12) if lo % 40 or w == 3], "g int, lo long, hi long")
    keys = {k for x in r.collect() for k in range(x.lo, x.hi + 1)}
    want = (1, len(keys), sum(k - 1 not in keys for k in keys))
    assert list(map(tuple, queries.spans.coverage(r, ["g"]).collect())) == [want]
