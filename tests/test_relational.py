import pytest

from millrace import operators as ops
from millrace import queries
from millrace.catalog import Catalog, struct
from millrace.functions.expressions import TypeMismatch
from millrace.session import Session
from millrace.sources import Tables, compose_record, console_lines, lines, load_text

MINE = struct([("att1", "INTEGER"), ("att2", "DOUBLE"), ("att3", "STRING")])
ROWS = [(0, 0.01, "abc0"), (1, 0.02, "abc1"), (2, 0.03, "abc2"), (3, 0.04, "abc3"), (4, 0.05, "abc4")]


@pytest.fixture
def mine(spark):
    return spark.createDataFrame(ROWS, MINE)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_empty_relation(spark):
    none = spark.createDataFrame([], MINE)
    assert rows(ops.sum_of(none, "att2")) == [(0.0,)] and rows(ops.sum_of(none, "att1")) == [(0,)]
    assert rows(ops.group_by(none, ["att3"], "att1")) == [] == rows(ops.distinct(none)) == rows(ops.sort(none, "(att1)"))
    assert ops.order_violations(none, ["att1"]) == 0 == ops.row_count(none)


def test_distinct_over_all_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (1, 2.0, "a"), (1, 2.0, "b")], MINE)
    assert len(rows(ops.distinct(df))) == 2
    assert ops.sum_distinct_rows(df, "att1").first()["sum"] == 2
    assert ops.sum_of(df, "att1", unique=True).first()["sum"] == 1


def test_division_truncates_towards_zero(spark):
    df = spark.createDataFrame([(-7, 2.0, "x")], MINE)
    assert ops.sum_of(df, "att1 / 2").first()["sum"] == -3
    assert ops.sum_of(df, "att1 / 2.0").first()["sum"] == -3.5
    assert ops.sum_of(df, "-att1 / 2").first()["sum"] == 3


def test_strings_compare_by_bytes(spark):
    df = spark.createDataFrame([(0, 0.0, s) for s in ("a", "B", "EUROPE", "middle east")], MINE)
    assert [r.att3 for r in ops.sort(df, ["att3"]).collect()] == ["B", "EUROPE", "a", "middle east"]
    assert {r.att3 for r in ops.select_pipe(df, "(att3 < 'a')").collect()} == {"B", "EUROPE"}


def test_strings_with_bars_and_quotes(spark):
    df = spark.createDataFrame([(0, 0.0, "a|b"), (1, 0.0, "it's")], MINE)
    assert ops.select_pipe(df, "(att3 = 'a|b')").count() == 1


def test_types(mine):
    assert ops.select_pipe(mine, "(att1 > 1.5)").count() == 3
    with pytest.raises(TypeMismatch):
        ops.select_pipe(mine, "(att1 > 1.5)", strict_types=True)
    with pytest.raises(TypeMismatch):
        ops.select_pipe(mine, "(att3 = 1)")
    with pytest.raises(TypeMismatch):
        ops.sum_of(mine, "att3 + 1")
    with pytest.raises(KeyError):
        ops.select_pipe(mine, "(nope = 1)")


def test_join_groups_of_equal_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (1, "r"), (3, "s")], "j int, b string")
    j = ops.join(a, b, "(k = j)")
    assert j.columns == ["k", "a", "j", "b"] and j.count() == 6
    assert ops.join(a, b, "(k < j)").count() == 3 and ops.cross(a, b).count() == 12
    assert ops.equi_keys(a, b, "(k = j) AND (a < b)") == (["k"], ["j"])
    assert ops.join(a, b, "(k = j)", hint="merge").count() == 6


def test_sort_all_orders_by_type(spark):
    df = spark.createDataFrame([("b", 1.0, 2), ("a", 2.0, 1), ("c", 0.0, 1)], "s string, d double, i int")
    assert [r.s for r in ops.sort_all(df).collect()] == ["c", "a", "b"]
    assert ops.order_violations(df.coalesce(1), ["i"]) == 1


def test_text_loading(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("2x|1.5z|abc|\n|||\n -7|abc| d|\n\n99999999999|.5|x|extra|\n3|\n")
    got = load_text(spark, str(tmp_path / "t.tbl"), MINE).collect()
    assert [tuple(r) for r in got] == [(2, 1.5, "abc"), (0, 0.0, ""), (-7, 0.0, " d"), (0, 0.5, "x"), (3, 0.0, "")]
    assert tuple(compose_record(spark, MINE, "1|2|x|").first()) == (1, 2.0, "x")
    assert compose_record(spark, MINE, "1|2|x") is None


def test_text_forms(spark):
    df = spark.createDataFrame([(1, 1.01, "a"), (2, 1234567.0, "b"), (3, 0.0, "c"), (4, 100000.0, "d"), (5, 0.00001234, "e"), (6, -2.5, "f")], MINE)
    assert lines(df).first()["value"] == "att1: [1]|att2: [1.010000]|att3: [a]"
    shown = [r["value"].split("att2: [")[1].split("]")[0] for r in console_lines(df).collect()]
    assert shown == ["1.01", "1.23457e+06", "0", "100000", "1.234e-05", "-2.5"]


def test_heap_and_sorted_tables(spark, tmp_path, mine):
    t = Tables(spark, f"file://{tmp_path}")
    t.create("h", MINE)
    assert t.scan("h").count() == 0
    t.append("h", mine)
    t.append("h", mine)
    assert t.scan("h").count() == 10
    t.create("s", MINE, "sorted", ["att1"])
    t.append("s", mine.where("att1 in (1, 3)"))
    assert [r.att1 for r in t.scan("s").collect()] == [1, 3]
    t.append("s", mine.where("att1 in (0, 2, 4)"))
    t.append("s", mine.where("att1 = 2"))
    assert [r.att1 for r in t.scan("s").collect()] == [0, 1, 2, 2, 3, 4]
    assert Tables(spark, f"file://{tmp_path}").lookup("s", "(att1 = 2) AND (att3 = 'abc2')").count() == 2
    assert t.describe("s")["kind"] == "sorted"
    for bad in (lambda: t.create("s", MINE), lambda: t.create("x", MINE, "tree"), lambda: t.create("x", MINE, "sorted", [])):
        with pytest.raises(ValueError):
            bad()
    t.drop("s")
    with pytest.raises(KeyError):
        t.scan("s")


def test_catalog_round_trip():
    text = "BEGIN\nmytable\nmytable.tbl\natt1 Int\natt2 Double\natt3 String\nEND\n"
    c = Catalog.parse(text)
    assert c["mytable"].schema == MINE and Catalog.parse(c.format())["mytable"] == c["mytable"]
    for bad in ("BEGIN\nx\nEND", "x", "BEGIN\nt\nt.tbl\na Float\nEND", "BEGIN\nt\nt.tbl"):
        with pytest.raises(ValueError):
            Catalog.parse(bad)


def test_session(spark, tmp_path, capsys):
    (tmp_path / "mine.tbl").write_text("".join(f"{a}|{b}|{c}|\n" for a, b, c in ROWS))
    s = Session(spark, f"file://{tmp_path}/tables", str(tmp_path))
    s.execute("CREATE TABLE m (att1 INTEGER, att2 DOUBLE, att3 STRING) AS SORTED ON att3, att1;")
    s.execute("INSERT 'mine.tbl' INTO m;")
    assert s.execute("SELECT m.att1 FROM m AS m WHERE (m.att2 > 0.03)").count() == 2
    assert "att1: [4]" in capsys.readouterr().out
    s.analyze("m")
    s.execute("SET OUTPUT NONE;")
    assert "SELECT FILE m AS m" in s.execute("SELECT SUM (m.att1) FROM m AS m WHERE (m.att1 > 2)")
    s.execute(f"SET OUTPUT '{tmp_path}/out';")
    s.execute("SELECT SUM (x.att1 + y.att1) FROM m AS x, m AS y WHERE (x.att1 = y.att1)")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["sum: [20]"]
    s.execute("DROP TABLE m;")
    with pytest.raises(KeyError):
        s.execute("SELECT m.att1 FROM m AS m WHERE (m.att1 = 1)")
    s.execute("QUIT;")
    with pytest.raises(RuntimeError):
        s.execute("QUIT;")


def test_select_rules(spark):
    s = Session(spark)
    s.register("a", spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"))
    s.register("b", spark.createDataFrame([(1, "x"), (3, "y")], "k int, w string"))
    assert s.select("SELECT a.k, b.k FROM a AS a, b AS b WHERE (a.v = b.w)").columns == ["a_k", "b_k"]
    assert s.select("SELECT v, w FROM a AS a, b AS b WHERE (a.k < b.k)").count() == 2
    assert s.select("SELECT SUM (a.k) FROM a AS a WHERE (a.k > 9)").first()["sum"] == 0
    assert s.select("SELECT SUM (a.k * a.k + 1) FROM a AS a WHERE (a.k > 0)", legacy_assoc=True).first()["sum"] == 1 * 2 + 2 * 3
    for bad in ("SELECT k FROM a AS a, b AS b WHERE (a.v = b.w)", "SELECT a.z FROM a AS a WHERE (a.k = 1)"):
        with pytest.raises(KeyError):
            s.select(bad)
    with pytest.raises(ValueError):
        s.select("SELECT SUM (a.k), a.v FROM a AS a WHERE (a.k = 1)")


def test_plans(spark, sf):
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThan(s_acctbal,2500.0)]" in queries.pushed(spark, sf, "supplier", "(s_acctbal > 2500.0)")
    plan = queries.QUERIES["join3_sum"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and plan.index("Filter") > plan.index("Join")
