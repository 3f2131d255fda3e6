"""Sorted tables under writers, readers and crashes; dates; order checks; printers."""

import datetime
import os

import pytest

from millrace import operators as ops
from millrace import queries
from millrace.catalog import struct
from millrace.functions.parser import ParseError, parse_cnf
from millrace.plans.explain import show_cnf, show_order, show_schema
from millrace.session import Session
from millrace.sources import Tables, console_lines, lines
from millrace.sources.tables import key_prefix

KV = struct([("k", "INTEGER"), ("v", "STRING")])


@pytest.fixture
def tables(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/tables")
    t.create("t", KV, "sorted", ["k"])
    return t


def put(spark, tables, *keys):
    tables.append("t", spark.createDataFrame([(k, f"v{k}") for k in keys], KV))


def keys(df):
    return [r.k for r in df.collect()]


def test_a_frame_read_before_a_merge_still_reads(spark, tables):
    put(spark, tables, 3, 1)
    before = tables.read("t")
    put(spark, tables, 2)
    assert keys(tables.scan("t")) == [1, 2, 3]
    assert sorted(keys(before)) == [1, 3]


def test_rows_staged_during_a_merge_wait_for_the_next(spark, tables, monkeypatch):
    put(spark, tables, 5, 4)
    save = tables._save

    def late(name, about):
        put(spark, tables, 9)  # a writer between the merge's read and its clean-up
        save(name, about)

    monkeypatch.setattr(tables, "_save", late)
    tables.merge("t")
    monkeypatch.undo()
    assert keys(tables.scan("t")) == [4, 5, 9]


def test_a_crash_before_the_clean_up_repeats_no_row(spark, tables, monkeypatch):
    put(spark, tables, 2, 1)
    monkeypatch.setattr("millrace.sources.tables.remove", lambda spark, path: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        tables.merge("t")
    monkeypatch.undo()
    put(spark, tables, 3)
    assert keys(tables.scan("t")) == [1, 2, 3] == keys(tables.scan("t"))


def test_files_hold_disjoint_key_ranges_and_lookups_push_the_key(spark, tables):
    put(spark, tables, *range(3000, 0, -1))
    from pyspark.sql import functions as F

    df = tables.read("t")
    ranges = sorted((r.a, r.b) for r in df.groupBy(F.input_file_name()).agg(F.min("k").alias("a"), F.max("k").alias("b")).collect())
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    hit = tables.lookup("t", "(k = 77) AND (v > 'a')")
    assert keys(hit) == [77] and "EqualTo(k,77)" in hit._jdf.queryExecution().executedPlan().toString()


def test_key_prefix():
    assert key_prefix("(a = 1) AND ('x' = b) AND (c > 2)", ["a", "b", "c"]) == [("a", 1), ("b", "x")]
    assert key_prefix("(b = 1)", ["a", "b"]) == [] == key_prefix("(a = 1 OR a = 2)", ["a"])


def test_dates_reach_the_reader(spark, sf):
    plan = queries.pushed(spark, sf, "lineitem", "(l_shipdate > '1994-01-01') AND (l_shipdate < '1994-02-01')")
    assert "GreaterThanOrEqual(l_shipdate,1994-01-02" in plan and "LessThan(l_shipdate,1994-02-01" in plan


def test_dates_compare_as_their_strings(spark):
    days = [datetime.datetime(1998, 10, 2, 23, 59), datetime.datetime(1998, 10, 3), datetime.datetime(1998, 10, 3, 5), datetime.datetime(1998, 10, 4)]
    for kind in ("timestamp", "timestamp_ntz", "date"):
        df = spark.createDataFrame([(d.date() if kind == "date" else d,) for d in days], f"d {kind}")
        for op in "<>=":
            for day in ("1998-10-03", "1998-1", "9999-12-31", "1998-02-31"):
                want = [r.d for r in df.collect() if eval(f"str(r.d)[:10] {op.replace('=', '==')} day")]
                assert [r.d for r in ops.select_pipe(df, f"(d {op} '{day}')").collect()] == want
                flip = {"<": ">", ">": "<"}.get(op, op)
                assert [r.d for r in ops.select_pipe(df, f"('{day}' {flip} d)").collect()] == want


def test_printed_dates_and_doubles(spark):
    xs = [999999.5, 999999.4, 0.00001234567, 0.0, -1.5, 1e20, 123456.7, 0.1, 1 / 3, -0.00001, 100000.0, 9.999995, 262188.5, 262189.5]
    df = spark.createDataFrame([(datetime.datetime(1998, 10, 3), x) for x in xs], "d timestamp, x double")
    assert [r.value for r in console_lines(df).collect()] == [f"d: [1998-10-03], x: [{x:g}]" for x in xs]
    assert lines(df).first().value == "d: [1998-10-03]|x: [999999.500000]"
    odd = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert [r.value for r in console_lines(odd).collect()] == ["x: [nan]", "x: []"]


def test_order_violations(spark):
    rows = [(1, "a"), (1, None), (1, "b"), (0, "z"), (None, "q"), (2, "é"), (2, "z")]
    down = sum((x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()) > (y[0] is not None, y[0] or 0, y[1] is not None, (y[1] or "").encode()) for x, y in zip(rows, rows[1:], strict=False))
    for parts in (1, 3):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "a int, b string")
        assert ops.order_violations(df, ["a", "b"]) == down == 4
    assert ops.order_violations(spark.range(5000).repartition(4).orderBy("id"), ["id"]) == 0


def test_quotes_in_strings(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",)], "s string")
    assert ops.select_pipe(df, r"(s = 'it\'s')").first().s == "it's" and ops.select_pipe(df, r"(s = 'a\\b')").count() == 1
    tree = parse_cnf(r"(s = 'it\'s' OR s = 'a\\b')")
    assert parse_cnf(show_cnf(tree)) == tree


def test_printers():
    assert show_schema(KV, "t") == "t\nk Int\nv String" and show_order(["v", "k"], KV) == "2 keys\n1: v String\n0: k Int"


def test_grouping_by_the_same_column_of_two_relations(spark, sf):
    s = Session(spark)
    s.register_parquet(sf, "nation")
    two = "FROM nation AS a, nation AS b WHERE (a.n_nationkey < b.n_nationkey) GROUP BY a.n_regionkey"
    assert s.select(f"SELECT SUM (a.n_nationkey) {two}, b.n_regionkey").columns == ["sum", "a_n_regionkey", "b_n_regionkey"]
    for wrong in (f"SELECT SUM (a.n_nationkey), b.n_regionkey {two}", f"SELECT b.n_regionkey {two}"):
        with pytest.raises(ParseError):
            s.select(wrong)


def test_the_greedy_order_is_the_order_of_execution(spark, sf):
    text = "SELECT c.c_custkey FROM customer AS c, nation AS n, region AS r WHERE (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey)"
    s = Session(spark)
    s.register_parquet(sf, "customer", "nation", "region")
    plain = sorted(map(tuple, s.select(text).collect()))
    for name in ("customer", "nation", "region"):
        s.analyze(name)
    df = s.select(text)
    logical = df._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, df.collect())) == plain
    assert logical.index("SubqueryAlias n") < logical.index("SubqueryAlias r") < logical.index("SubqueryAlias c")
    assert os.path.exists(sf)
