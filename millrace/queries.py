"""The registered queries of the relational engine, each with SQL that gives the same rows.

Sums of doubles are rounded to cents on both sides: the order of addition differs between engines.
partsupp isn't among the tables; it is derived from lineitem, in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .catalog import Relation, struct
from .functions.expressions import columns_of, predicate
from .plans.estimator import Statistics
from .plans.explain import show_order, show_schema
from .session import Session
from .sources import text as txt
from .sources.tables import Tables, key_prefix
from .workspace import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PS = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MAX(l_linenumber) AS ps_availqty, MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"


def query(sql: str | None = None, name: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "partsupp":
        keys = [F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")]
        return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_linenumber").alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str) -> Session:
    s = Session(spark)
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "partsupp"):
        s.register(name, table(spark, sf_dir, name))
    return s


def cents(df: DataFrame, column: str = "sum") -> DataFrame:
    return df.withColumn(column, F.round(column, 2))


def _filtered(name: str, relation: str, cnf: str, keep: list[str] | None, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = ops.select_pipe(table(spark, sf_dir, relation), cnf)
        return ops.project(df, keep) if keep else df

    query(f"SELECT {', '.join(keep) if keep else '*'} FROM {PS + ' ps' if relation == 'partsupp' else relation} WHERE {sql}", name)(run)


# Scans and predicates: S1-S3, F1-F8, R1

for _name, _relation, _cnf, _keep, _sql in (
    ("filter_eq_str", "region", "(r_name = 'EUROPE')", None, "r_name = 'EUROPE'"),
    ("filter_str_less", "region", "(r_name < 'middle east') AND (r_regionkey > 1)", None, "r_name < 'middle east' AND r_regionkey > 1"),
    ("filter_and_mixed", "nation", "(n_regionkey = 3) AND (n_nationkey > 10) AND (n_name > 'NATION_15')", None, "n_regionkey = 3 AND n_nationkey > 10 AND n_name > 'NATION_15'"),
    ("filter_key_range", "supplier", "(s_suppkey < 10)", None, "s_suppkey < 10"),
    ("filter_three", "supplier", "(s_nationkey = 18) AND (s_acctbal > 1000) AND (s_suppkey < 400)", None, "s_nationkey = 18 AND s_acctbal > 1000 AND s_suppkey < 400"),
    ("filter_customer", "customer", "(c_nationkey = 23) AND (c_mktsegment = 'FURNITURE') AND (c_acctbal > 1023.99) AND (c_acctbal < 7110.83)", None, "c_nationkey = 23 AND c_mktsegment = 'FURNITURE' AND c_acctbal > 1023.99 AND c_acctbal < 7110.83"),
    ("filter_part", "part", "(p_brand = 'Brand#13') AND (p_retailprice > 500) AND (p_retailprice < 1930) AND (p_size > 8) AND (p_size < 1000000)", None, "p_brand = 'Brand#13' AND p_retailprice > 500 AND p_retailprice < 1930 AND p_size > 8 AND p_size < 1000000"),
    ("filter_range_dbl", "part", "(p_retailprice > 931.01) AND (p_retailprice < 961.3)", ["p_partkey", "p_name", "p_retailprice"], "p_retailprice > 931.01 AND p_retailprice < 961.3"),
    ("filter_partsupp", "partsupp", "(ps_availqty < 3) AND (ps_supplycost > 100) AND (ps_suppkey < 30)", None, "ps_availqty < 3 AND ps_supplycost > 100 AND ps_suppkey < 30"),
    ("filter_orders", "orders", "(o_orderpriority = '1-URGENT') AND (o_orderstatus = 'O') AND (o_totalprice > 1015.68) AND (o_totalprice < 101051.89)", ["o_orderkey", "o_totalprice"], "o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_totalprice > 1015.68 AND o_totalprice < 101051.89"),
    ("filter_lineitem", "lineitem", "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-01-17') AND (l_discount > 0.03) AND (l_quantity > 4)", ["l_orderkey", "l_linenumber", "l_discount"], "strftime(l_shipdate, '%Y-%m-%d') > '1996-01-01' AND strftime(l_shipdate, '%Y-%m-%d') < '1996-01-17' AND l_discount > 0.03 AND l_quantity > 4"),
    ("filter_lineitem_keys", "lineitem", "(l_orderkey > 100) AND (l_orderkey < 1000) AND (l_partkey > 100) AND (l_partkey < 5000) AND (l_linestatus = 'F') AND (l_tax < 0.07)", ["l_orderkey", "l_linenumber"], "l_orderkey > 100 AND l_orderkey < 1000 AND l_partkey > 100 AND l_partkey < 5000 AND l_linestatus = 'F' AND l_tax < 0.07"),
    ("filter_or_multi_att", "lineitem", "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')", ["l_orderkey", "l_partkey", "l_suppkey"], "l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')"),
    ("filter_or_same_att", "part", "(p_size = 3 OR p_size = 6 OR p_size = 19)", ["p_partkey", "p_size"], "p_size IN (3, 6, 19)"),
    ("filter_literal_left", "supplier", "(10 > s_suppkey)", None, "10 > s_suppkey"),
    ("filter_att_att", "lineitem", "(l_tax > l_discount)", ["l_orderkey", "l_linenumber"], "l_tax > l_discount"),
    ("filter_tautology", "supplier", "(s_suppkey = s_suppkey)", None, "true"),
    ("date_as_string", "lineitem", "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-02-01')", ["l_orderkey", "l_linenumber"], "strftime(l_shipdate, '%Y-%m-%d') > '1996-01-01' AND strftime(l_shipdate, '%Y-%m-%d') < '1996-02-01'"),
):
    _filtered(_name, _relation, _cnf, _keep, _sql)


@query("SELECT * FROM region")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region")


@query("SELECT n_name, n_nationkey FROM nation")
def project_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.project(table(spark, sf_dir, "nation"), [1, 0])


# Sums and arithmetic: A1, A2, E1-E11


def _summed(name: str, relation: str, expression: str, sql: str, cnf: str = "", unique: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, relation)
        out = ops.sum_of(ops.select_pipe(df, cnf) if cnf else df, expression, unique)
        return cents(out) if out.schema["sum"].dataType.simpleString() == "double" else out

    query(sql, name)(run)


_summed("sum_global", "supplier", "(s_acctbal + (s_acctbal * 1.05))", "SELECT ROUND(SUM(s_acctbal + (s_acctbal * CAST(1.05 AS DOUBLE))), 2) AS sum FROM supplier")
_summed("sum_int", "nation", "(n_nationkey)", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation")
_summed("sum_empty", "supplier", "s_acctbal", "SELECT CAST(0 AS DOUBLE) AS sum", "(s_suppkey < -1)")
_summed("sum_empty_int", "nation", "n_nationkey", "SELECT CAST(0 AS BIGINT) AS sum", "(n_nationkey < -1)")
_summed("int_div", "nation", "n_nationkey / 2", "SELECT CAST(SUM(n_nationkey // 2) AS BIGINT) AS sum FROM nation")
_summed("int_div_neg", "nation", "(0 - n_nationkey) / 2", "SELECT CAST(-SUM(n_nationkey // 2) AS BIGINT) AS sum FROM nation")
_summed("unary_minus", "supplier", "-s_acctbal", "SELECT ROUND(SUM(-s_acctbal), 2) AS sum FROM supplier")
_summed("precedence", "nation", "n_nationkey * 2 + n_regionkey - 1 - 1", "SELECT CAST(SUM(n_nationkey * 2 + n_regionkey - 1 - 1) AS BIGINT) AS sum FROM nation")
_summed("promotion", "part", "p_size * p_retailprice / 2 - p_size", "SELECT ROUND(SUM(p_size * p_retailprice / 2 - p_size), 2) AS sum FROM part")
_summed("sum_distinct_global", "nation", "n_regionkey", "SELECT CAST(SUM(DISTINCT n_regionkey) AS BIGINT) AS sum FROM nation", unique=True)


@query("SELECT CAST(SUM(n_nationkey * (2 + n_regionkey)) AS BIGINT) AS sum FROM nation")
def legacy_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sum_of(table(spark, sf_dir, "nation"), "n_nationkey * 2 + n_regionkey", legacy_assoc=True)


# Joins: J1-J9


@query(f"SELECT ROUND(SUM(ps_supplycost), 2) AS sum FROM supplier, {PS} ps WHERE s_suppkey = ps_suppkey")
def join_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ops.join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "partsupp"), "(s_suppkey = ps_suppkey)")
    return cents(ops.sum_of(j, "ps_supplycost"))


@query(f"SELECT s_suppkey, s_name, ps_partkey, ps_availqty FROM supplier, {PS} ps WHERE s_suppkey = ps_suppkey")
def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ops.join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "partsupp"), "(s_suppkey = ps_suppkey)", hint="merge")
    return ops.project(j, ["s_suppkey", "s_name", "ps_partkey", "ps_availqty"])


@query("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a, nation b WHERE a.n_regionkey < b.n_regionkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return ops.join(n, n.select(*[F.col(c) for c in n.columns]), "(l.n_regionkey < r.n_regionkey)").select(F.col("l.n_nationkey").alias("a_key"), F.col("r.n_nationkey").alias("b_key"))


@query("SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cross(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey"))


@query(f"SELECT l_orderkey, l_linenumber, ps_availqty FROM lineitem, {PS} ps WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ops.join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "partsupp"), "(l_partkey = ps_partkey) AND (l_suppkey = ps_suppkey)")
    return ops.project(j, ["l_orderkey", "l_linenumber", "ps_availqty"])


@query("SELECT l.n_name AS n_name, r.n_nationkey AS other FROM nation l, nation r WHERE l.n_name = r.n_name")
def string_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return ops.join(n, n.select(F.col("n_name").alias("m_name"), F.col("n_nationkey").alias("other")), "(n_name = m_name)").select("n_name", "other")


# Groups, distinct, sort: A3, A6, X1, O1, O6, O7, O9


@query(f"SELECT ROUND(SUM(ps_supplycost), 2) AS sum, s_nationkey FROM supplier, {PS} ps WHERE s_suppkey = ps_suppkey GROUP BY s_nationkey")
def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ops.join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "partsupp"), "(s_suppkey = ps_suppkey)")
    return cents(ops.group_by(j, ["s_nationkey"], "ps_supplycost"))


@query("SELECT ROUND(SUM(l_extendedprice * (1.0 - l_discount)), 2) AS sum, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cents(ops.group_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice * (1.0 - l_discount)"))


@query(f"SELECT DISTINCT ps_suppkey FROM {PS} ps WHERE ps_supplycost < 30000.11")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct(ops.project(ops.select_pipe(table(spark, sf_dir, "partsupp"), "(ps_supplycost < 30000.11)"), ["ps_suppkey"]))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct(ops.project(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("SELECT CAST(SUM(k) AS BIGINT) AS sum FROM (SELECT DISTINCT l_suppkey AS k, l_linenumber FROM lineitem) t")
def sum_distinct_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sum_distinct_rows(ops.project(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_linenumber"]), "l_suppkey")


@query("SELECT c_custkey, c_name, ROW_NUMBER() OVER (ORDER BY c_name, c_custkey) AS place FROM customer")
def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the sorted order: Spark numbers the rows of the range-partitioned sort without one task for all."""
    ordered = ops.sort(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), "(c_name) AND (c_custkey)")
    kept = ordered.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.col("p").cast("long"), 33))
    path = scratch(spark, "sorted")
    kept.write.parquet(path)
    kept = spark.read.parquet(path)
    before, starts = 0, []
    for p, n in sorted((r["p"], r["n"]) for r in kept.groupBy("p").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        starts.append((p, before))
        before += n
    starts = spark.createDataFrame(starts, "p int, before long")
    return kept.join(F.broadcast(starts), "p").select("c_custkey", "c_name", (F.col("before") + F.col("i") + 1).alias("place"))


@query("SELECT CAST(0 AS BIGINT) AS violations, (SELECT CAST(COUNT(*) AS BIGINT) FROM orders) AS row_count")
def sort_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = ops.sort(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])
    return spark.createDataFrame([(ops.order_violations(ordered, ["o_totalprice", "o_orderkey"]), ops.row_count(ordered))], "violations long, row_count long")


@query("SELECT * FROM supplier")
def sort_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sort_all(table(spark, sf_dir, "supplier"))


# Tables and text: S4-S16, D1-D4


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def heap_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables = Tables(spark, scratch(spark, "heap"))
    tables.create("nation", n.schema)
    tables.append("nation", n)
    tables.append("nation", ops.select_pipe(n, "(n_regionkey = 1)").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return tables.scan("nation")


def _sorted_suppliers(spark: SparkSession, sf_dir: str) -> Tables:
    s = table(spark, sf_dir, "supplier")
    tables = Tables(spark, scratch(spark, "sorted"))
    tables.create("supplier", s.schema, "sorted", ["s_nationkey", "s_suppkey"])
    tables.append("supplier", ops.select_pipe(s, "(s_suppkey > 40)"))
    tables.merge("supplier")
    tables.append("supplier", ops.select_pipe(s, "(s_suppkey < 41)"))
    return tables


@query("SELECT * FROM supplier")
def sorted_merge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_suppliers(spark, sf_dir).scan("supplier")


@query("SELECT * FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0")
def sorted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted_suppliers(spark, sf_dir).lookup("supplier", "(s_nationkey = 3) AND (s_acctbal > 0)")


def _tbl(spark: SparkSession, sf_dir: str) -> str:
    """nation as a `.tbl` file, every field ended by a bar."""
    path = scratch(spark, "tbl")
    n = table(spark, sf_dir, "nation")
    n.select(F.concat(*[F.concat(F.col(c).cast("string"), F.lit("|")) for c in ("n_nationkey", "n_name", "n_regionkey")])).write.text(path)
    return path


NATION = [("n_nationkey", "INTEGER"), ("n_name", "STRING"), ("n_regionkey", "INTEGER")]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def text_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.load_text(spark, _tbl(spark, sf_dir), struct(NATION))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2 AND n_name > 'NATION_1'")
def text_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.scan_text(spark, _tbl(spark, sf_dir), struct(NATION), "(n_regionkey = 2) AND (n_name > 'NATION_1')")


@query("SELECT 7 AS att1, CAST(2.5 AS DOUBLE) AS att2, 'abc' AS att3")
def compose_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.compose_record(spark, struct([("att1", "INTEGER"), ("att2", "DOUBLE"), ("att3", "STRING")]), "7|2.5|abc|")


@query("SELECT 's_suppkey: [' || s_suppkey || ']|s_name: [' || s_name || ']|s_nationkey: [' || s_nationkey || ']|s_acctbal: [' || printf('%.6f', s_acctbal) || ']' AS value FROM supplier")
def write_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "written")
    txt.write_out(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return spark.read.text(path)


@query("SELECT 'n_nationkey: [' || n_nationkey || '], n_name: [' || n_name || ']' AS value FROM nation")
def print_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.console_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT 'o_orderkey: [' || o_orderkey || ']|o_orderdate: [' || strftime(o_orderdate, '%Y-%m-%d') || ']|o_totalprice: [' || printf('%.6f', o_totalprice) || ']' AS value FROM orders WHERE o_orderdate < '1995-06-01'")
def write_out_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "written")
    some = ops.select_pipe(table(spark, sf_dir, "orders"), "(o_orderdate < '1995-06-01')")
    txt.write_out(some.select("o_orderkey", "o_orderdate", "o_totalprice"), path)
    return spark.read.text(path)


@query("SELECT 'o_orderdate: [' || strftime(o_orderdate, '%Y-%m-%d') || '], o_totalprice: [' || printf('%g', o_totalprice) || ']' AS value FROM orders WHERE o_orderdate > '1997-12-31'")
def print_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.console_lines(ops.select_pipe(table(spark, sf_dir, "orders"), "('1997-12-31' < o_orderdate)").select("o_orderdate", "o_totalprice"))


@query("SELECT CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(s_acctbal), 2) AS total FROM supplier")
def drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return spark.createDataFrame([(ops.row_count(s), round(ops.total(s, "s_acctbal"), 2))], "n long, total double")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ddl_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = Session(spark), _tbl(spark, sf_dir)
    s.execute("CREATE TABLE mine (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS HEAP;")
    s.execute(f"INSERT '{path}' INTO mine;")
    s.execute(f"INSERT '{path}' INTO mine;")
    s.execute("CREATE TABLE gone (a INTEGER) AS HEAP;")
    s.execute("DROP TABLE gone;")
    return s.select("SELECT m.n_nationkey, m.n_name, m.n_regionkey FROM mine AS m WHERE (m.n_nationkey > -1)")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def ddl_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute("CREATE TABLE mine (n_nationkey INTEGER, n_name STRING, n_regionkey INTEGER) AS SORTED ON n_regionkey, n_name;")
    s.execute(f"INSERT '{_tbl(spark, sf_dir)}' INTO mine;")
    return s.select("SELECT m.n_nationkey, m.n_name FROM mine AS m WHERE (m.n_regionkey = 1)")


@query("SELECT 'n_name: [' || n_name || ']' AS value FROM nation WHERE n_regionkey = 4")
def set_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = session(spark, sf_dir), scratch(spark, "output")
    s.execute(f"SET OUTPUT '{path}';")
    s.execute("SELECT n.n_name FROM nation AS n WHERE (n.n_regionkey = 4)")
    return spark.read.text(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming import load_arrivals

    relation, tables = Relation("arrived", struct(NATION)), Tables(spark, scratch(spark, "arrivals"))
    tables.create("arrived", relation.schema)
    load_arrivals(spark, _tbl(spark, sf_dir), relation, tables, scratch(spark, "arrivals-checkpoint"), once=True).awaitTermination()
    return tables.read("arrived")


# The SQL dialect: R3, R4, F10, J6-J9, A6-A8, X2, L1-L7


def _dialect(name: str, text: str, sql: str, rounded: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = session(spark, sf_dir).select(text)
        return cents(out) if rounded else out

    query(sql, name)(run)


_dialect("sql_filter", "SELECT n.n_nationkey FROM nation AS n WHERE (n.n_name = 'NATION_7')", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7'")
_dialect("sql_join", "SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 5")
_dialect("sql_sum", "SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_7')", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_7'")
_dialect("sql_group", "SELECT SUM (n.n_regionkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_7') GROUP BY n.n_regionkey", "SELECT CAST(SUM(n_regionkey) AS BIGINT) AS sum, n_regionkey FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_7' GROUP BY n_regionkey")
_dialect("sum_distinct_group", "SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey) FROM nation AS n, region AS r, customer AS c WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (n.n_nationkey > 10) GROUP BY r.r_regionkey", "SELECT CAST(SUM(DISTINCT n_nationkey + r_regionkey) AS BIGINT) AS sum, r_regionkey FROM nation, region, customer WHERE n_regionkey = r_regionkey AND n_nationkey = c_nationkey AND n_nationkey > 10 GROUP BY r_regionkey")
_FLAGSHIP = "SELECT SUM (ps.ps_supplycost), s.s_suppkey FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey"
_dialect("join3_group", _FLAGSHIP, f"SELECT ROUND(SUM(ps_supplycost), 2) AS sum, s_suppkey FROM part, supplier, {PS} ps WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_acctbal > 2500.0 GROUP BY s_suppkey", True)
_dialect("join3_sum", "SELECT SUM (ps.ps_supplycost) FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0)", f"SELECT ROUND(SUM(ps_supplycost), 2) AS sum FROM part, supplier, {PS} ps WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_acctbal > 2500.0", True)
_dialect("self_join", "SELECT s.s_suppkey, c.c_custkey FROM supplier AS s, customer AS c, nation AS n1, nation AS n2 WHERE (s.s_nationkey = n1.n_nationkey) AND (c.c_nationkey = n2.n_nationkey) AND (n1.n_nationkey = n2.n_nationkey)", "SELECT s_suppkey, c_custkey FROM supplier s, customer c, nation n1, nation n2 WHERE s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND n1.n_nationkey = n2.n_nationkey")
_dialect("select_above_join", "SELECT s.s_suppkey, ps.ps_partkey FROM supplier AS s, partsupp AS ps WHERE (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0 OR ps.ps_partkey < 100)", f"SELECT s_suppkey, ps_partkey FROM supplier, {PS} ps WHERE s_suppkey = ps_suppkey AND (s_acctbal > 2500.0 OR ps_partkey < 100)")
_dialect("sql_distinct", "SELECT DISTINCT ps.ps_suppkey FROM partsupp AS ps WHERE (ps.ps_supplycost < 30000.11)", f"SELECT DISTINCT ps_suppkey FROM {PS} ps WHERE ps_supplycost < 30000.11")
_dialect("sql_group_only", "SELECT o.o_orderstatus FROM orders AS o WHERE (o.o_orderkey > 0) GROUP BY o.o_orderstatus", "SELECT DISTINCT o_orderstatus FROM orders")
_dialect("sql_group_two_aliases", "SELECT SUM (a.n_nationkey) FROM nation AS a, nation AS b WHERE (a.n_nationkey < b.n_nationkey) GROUP BY a.n_regionkey, b.n_regionkey", "SELECT CAST(SUM(a.n_nationkey) AS BIGINT) AS sum, a.n_regionkey AS a_n_regionkey, b.n_regionkey AS b_n_regionkey FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey GROUP BY a.n_regionkey, b.n_regionkey")
_dialect("sql_group_one_of_two", "SELECT SUM (a.n_nationkey), b.n_regionkey FROM nation AS a, nation AS b WHERE (a.n_nationkey < b.n_nationkey) GROUP BY a.n_regionkey, b.n_regionkey", "SELECT CAST(SUM(a.n_nationkey) AS BIGINT) AS sum, b.n_regionkey AS b_n_regionkey FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey GROUP BY a.n_regionkey, b.n_regionkey")
_dialect("sql_day", "SELECT o.o_orderkey FROM orders AS o WHERE (o.o_orderdate = '1996-01-02' OR o.o_orderdate > '1998-06-01')", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-01-02' OR CAST(o_orderdate AS DATE) > DATE '1998-06-01'")
_dialect("sql_cross", "SELECT n.n_nationkey, r.r_name FROM nation AS n, region AS r WHERE (n.n_nationkey < 3)", "SELECT n_nationkey, r_name FROM nation, region WHERE n_nationkey < 3")
_dialect("sql_inner_and", "SELECT n.n_nationkey FROM nation AS n WHERE (n.n_regionkey = 1 OR n.n_regionkey = 2 AND n.n_nationkey > 5)", "SELECT n_nationkey FROM nation WHERE (n_regionkey = 1 OR n_regionkey = 2) AND n_nationkey > 5")
_dialect("sql_theta", "SELECT a.n_nationkey, b.n_name FROM nation AS a, nation AS b WHERE (a.n_regionkey < b.n_regionkey)", "SELECT a.n_nationkey, b.n_name FROM nation a, nation b WHERE a.n_regionkey < b.n_regionkey")
_dialect("sum_distinct_sql", "SELECT SUM DISTINCT (n.n_regionkey) FROM nation AS n WHERE (n.n_nationkey > 3)", "SELECT CAST(SUM(DISTINCT n_regionkey) AS BIGINT) AS sum FROM nation WHERE n_nationkey > 3")
_dialect("revenue", "SELECT SUM (l.l_extendedprice * (1.0 - l.l_discount)), c.c_mktsegment FROM customer AS c, orders AS o, lineitem AS l WHERE (c.c_custkey = o.o_custkey) AND (l.l_orderkey = o.o_orderkey) AND (o.o_orderdate < '1997-03-15') AND (l.l_shipdate > '1997-03-15') GROUP BY c.c_mktsegment", "SELECT ROUND(SUM(l_extendedprice * (1.0 - l_discount)), 2) AS sum, c_mktsegment FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND strftime(o_orderdate, '%Y-%m-%d') < '1997-03-15' AND strftime(l_shipdate, '%Y-%m-%d') > '1997-03-15' GROUP BY c_mktsegment", True)


@query("SELECT 'selects: 1, joins: 2, above joins: 0' AS head, true AS pushed")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = session(spark, sf_dir).explain(_FLAGSHIP)
    return spark.createDataFrame([(text.split("\n")[0], "GreaterThan(s_acctbal,2500.0)" in text)], "head string, pushed boolean")


# Statistics: C1-C9


@query("SELECT 'orders' AS relation, (SELECT CAST(COUNT(*) AS BIGINT) FROM orders) AS row_count, 'o_custkey' AS attribute, (SELECT CAST(COUNT(DISTINCT o_custkey) AS BIGINT) FROM orders) AS distinct_values UNION ALL SELECT 'customer', (SELECT COUNT(*) FROM customer), 'c_custkey', (SELECT COUNT(DISTINCT c_custkey) FROM customer)")
def statistics_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Statistics()
    for name, column in (("orders", "o_custkey"), ("customer", "c_custkey")):
        s.collect(name, table(spark, sf_dir, name), [column], exact=True)
    rows = [(r, int(x.rows), c, n) for r, x in s.relations.items() for c, n in x.distinct.items()]
    return spark.createDataFrame(rows, "relation string, row_count long, attribute string, distinct_values long")


@query("SELECT CAST(COUNT(*) AS DOUBLE) AS estimate FROM orders")
def statistics_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer x orders on its key: as many rows as orders, whatever share of the customers ordered."""
    s = Statistics()
    s.collect("customer", table(spark, sf_dir, "customer"), ["c_custkey"], exact=True)
    s.collect("orders", table(spark, sf_dir, "orders"), ["o_custkey"], exact=True)
    s = Statistics.read(s.write())
    return spark.createDataFrame([(float(round(s.apply("(c_custkey = o_custkey)", ["customer", "orders"]))),)], "estimate double")


@query("SELECT 'a' AS relation, CAST(COUNT(*) AS DOUBLE) * COUNT(*) / COUNT(DISTINCT n_regionkey) AS estimate FROM nation")
def statistics_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate of a self-join, through copies of a relation's statistics."""
    s = Statistics()
    s.collect("nation", table(spark, sf_dir, "nation"), ["n_regionkey"], exact=True)
    s.copy_relation("nation", "a")
    s.copy_relation("nation", "b")
    return spark.createDataFrame([("a", round(float(s.estimate("(a.n_regionkey = b.n_regionkey)", ["a", "b"])), 6))], "relation string, estimate double")


@query("SELECT relation, CAST(row_count AS DOUBLE) AS row_count FROM (VALUES ('region', 5.0), ('nation', 25.0), ('part', 200000.0), ('supplier', 10000.0), ('partsupp', 800000.0), ('customer', 150000.0), ('orders', 1500000.0), ('lineitem', 6001215.0)) t (relation, row_count)")
def statistics_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Statistics.read(Statistics.tpch().write())
    return spark.createDataFrame([(name, float(r.rows)) for name, r in s.relations.items()], "relation string, row_count double")


_ORDERED = "SELECT c.c_custkey, r.r_name FROM customer AS c, nation AS n, region AS r WHERE (c.c_nationkey = n.n_nationkey) AND (n.n_regionkey = r.r_regionkey)"


@query("SELECT c_custkey, r_name, 'n.n_regionkey = r.r_regionkey' AS first_join FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def greedy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest join comes first, in the plan and in execution."""
    s = session(spark, sf_dir)
    for name in ("customer", "nation", "region"):
        s.analyze(name)
    first = next(x for x in s.explain(_ORDERED).split("\n") if x.startswith("JOIN")).removeprefix("JOIN ").partition(",")[0]
    return s.select(_ORDERED).withColumn("first_join", F.lit(first))


@query("SELECT * FROM (VALUES ('quit', true), ('closed', true)) t (step, done)")
def quit_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(spark)
    s.execute("quit;")
    try:
        s.execute("SET OUTPUT NONE;")
        refused = False
    except RuntimeError:
        refused = True
    return spark.createDataFrame([("quit", s.closed), ("closed", refused)], "step string, done boolean")


@query("SELECT 'schema' AS kind, string_agg(column_name || ' ' || CASE column_type WHEN 'BIGINT' THEN 'Int' WHEN 'INTEGER' THEN 'Int' WHEN 'DOUBLE' THEN 'Double' ELSE 'String' END, ', ') AS text FROM (DESCRIBE SELECT s_suppkey, s_name, s_acctbal FROM supplier) UNION ALL SELECT 'order', '2 keys, 2: s_acctbal Double, 0: s_suppkey Int'")
def printers(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").schema
    shown = [("schema", show_schema(schema)), ("order", show_order(["s_acctbal", "s_suppkey"], schema))]
    return spark.createDataFrame([(k, t.replace("\n", ", ")) for k, t in shown], "kind string, text string")


@query("SELECT n_nationkey, n_name, n_regionkey, 1 AS prefix FROM nation WHERE n_nationkey = 7")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in a table sorted on two columns by the key prefix of its predicate."""
    tables, schema = Tables(spark, scratch(spark, "tables")), struct(NATION)
    tables.create("mine", schema, "sorted", ["n_nationkey", "n_name"])
    tables.append("mine", txt.load_text(spark, _tbl(spark, sf_dir), schema))
    cnf = "(n_nationkey = 7) AND (n_regionkey > -1)"
    return tables.lookup("mine", cnf).withColumn("prefix", F.lit(len(key_prefix(cnf, ["n_nationkey", "n_name"]))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join3_group"](spark, sf_dir)


def pushed(spark: SparkSession, sf_dir: str, relation: str, cnf: str) -> str:
    """The physical plan of a filtered scan, for tests."""
    df = table(spark, sf_dir, relation)
    df = df.filter(predicate(cnf, columns_of(df)))
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
