"""Every registered query of the relational engine, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalar as S
from brindle.operators import aggregates as A
from brindle.operators import dml as M
from brindle.operators import joins as J
from brindle.operators import relational as R
from brindle.sources.tables import catalog_tables, one_row, scan, values
from brindle.sql.binder import select_over

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str):
    """Registers a function of (t, spark, sf_dir), t(name) being a scan, under its name, with its SQL."""

    def register(f):
        def run(spark, sf_dir):
            return f(lambda name, alias=None: scan(spark, sf_dir, name, alias), spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return f

    return register


# ---- scans, inline values, projection ----


@query("SELECT * FROM region")
def scan_region(t, spark, sf):
    return t("region")


@query("SELECT n_nationkey AS nation, upper(n_name) AS name, n_regionkey + 1 AS next_region FROM nation n")
def project_alias(t, spark, sf):
    return R.project(t("nation", "n"), nation=col("n.n_nationkey"), name=S.upper(col("n.n_name")), next_region=col("n.n_regionkey") + 1)


@query("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, 2.5::DOUBLE), (3, 'c', NULL)) v(id, name, score)")
def values_inline(t, spark, sf):
    return values(spark, [(1, "a", 1.5), (2, None, 2.5), (3, "c", None)], "id int, name string, score double")


@query("SELECT 1 + 1 AS two, 'abc' AS word, CAST(7 // 6 AS INTEGER) AS quotient, 2 < -1 + 4 AS less")
def const_select(t, spark, sf):
    return one_row(spark, two=lit(1) + lit(1), word=lit("abc"), quotient=S.int_div(lit(7), lit(6)), less=lit(2) < lit(-1) + lit(4))


@query("SELECT 1 AS one, n.*, r.* FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def star_join(t, spark, sf):
    return R.star(J.join(t("nation"), t("region"), col("n_regionkey") == col("r_regionkey")), lit(1).alias("one"))


@query("""SELECT 'region' AS table_name, 'r_regionkey int, r_name string' AS schema, count(*) AS cardinality FROM region
          UNION ALL SELECT 'nation', 'n_nationkey int, n_name string, n_regionkey int', count(*) FROM nation
          UNION ALL SELECT 'customer', 'c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string', count(*) FROM customer
          UNION ALL SELECT 'supplier', 's_suppkey bigint, s_name string, s_nationkey int, s_acctbal double', count(*) FROM supplier
          UNION ALL SELECT 'part', 'p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double', count(*) FROM part
          UNION ALL SELECT 'embeddings', 'vec_id bigint, embedding array<float>, label int', count(*) FROM embeddings
          UNION ALL SELECT 'documents', 'doc_id bigint, text string, lang string, source string, n_chars bigint', count(*) FROM documents
          UNION ALL SELECT 'labels', 'doc_id bigint, quality int, toxic int', count(*) FROM labels
          UNION ALL SELECT 'pages', 'page_id bigint, url string, html string', count(*) FROM pages
          UNION ALL SELECT 'benchmark', 'item_id bigint, text string', count(*) FROM benchmark
          UNION ALL SELECT 'conversations', 'conv_id bigint, turn bigint, role string, text string', count(*) FROM conversations""")
def catalog_listing(t, spark, sf):
    return catalog_tables(spark, sf, ["region", "nation", "customer", "supplier", "part", "embeddings", "documents", "labels", "pages", "benchmark", "conversations"])


# ---- comparisons and predicates ----


def _compared(name: str, op: str, condition) -> None:
    def run(t, spark, sf):
        return R.where(t("part"), condition(col("p_size"))).select("p_partkey", "p_size")

    run.__name__ = f"cmp_{name}"
    query(f"SELECT p_partkey, p_size FROM part WHERE p_size {op} 25")(run)


_compared("eq", "=", lambda c: c == 25)
_compared("ne", "<>", lambda c: c != 25)
_compared("lt", "<", lambda c: c < 25)
_compared("le", "<=", lambda c: c <= 25)
_compared("gt", ">", lambda c: c > 25)
_compared("ge", ">=", lambda c: c >= 25)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > c_nationkey")
def cmp_promoted(t, spark, sf):
    return R.where(t("customer"), col("c_acctbal") > col("c_nationkey")).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def between(t, spark, sf):
    return R.where(t("part"), S.between(col("p_size"), 10, 20)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice NOT BETWEEN 950 AND 1450.5")
def not_between(t, spark, sf):
    return R.where(t("part"), ~S.between(col("p_retailprice"), 950, 1450.5)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49)")
def in_list(t, spark, sf):
    return R.where(t("part"), S.in_list(col("p_size"), [1, 7, 49])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 7, 49)")
def not_in_list(t, spark, sf):
    return R.where(t("part"), ~S.in_list(col("p_size"), [1, 7, 49])).select("p_partkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_strings(t, spark, sf):
    return R.where(t("customer"), S.in_list(col("c_mktsegment"), ["BUILDING", "MACHINERY"])).select("c_custkey", "c_mktsegment")


@query("SELECT count(*) AS n, (2 NOT IN (1, NULL)) IS NULL AS unknown FROM nation WHERE n_nationkey IN (1, NULL)")
def in_list_null(t, spark, sf):
    rows = R.where(t("nation"), S.in_list(col("n_nationkey"), [1, None]))
    return A.aggregate(rows, [], n=A.count_star()).withColumn("unknown", (~S.in_list(lit(2), [1, None])).isNull())


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def like_contains(t, spark, sf):
    return R.where(t("part"), S.like(col("p_name"), "%ring%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '_____ r___'")
def like_underscore(t, spark, sf):
    return R.where(t("part"), S.like(col("p_name"), "_____ r___")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE 's%'")
def not_like(t, spark, sf):
    return R.where(t("part"), ~S.like(col("p_name"), "s%")).select("p_partkey", "p_name")


@query("SELECT id, s LIKE 'a.b%' AS dotted, s LIKE '_中' AS wide FROM (VALUES (1, 'a.b c'), (2, 'axb'), (3, 'a中'), (4, NULL)) v(id, s)")
def like_special(t, spark, sf):
    rows = values(spark, [(1, "a.b c"), (2, "axb"), (3, "a中"), (4, None)], "id int, s string")
    return rows.select("id", S.like(col("s"), "a.b%").alias("dotted"), S.like(col("s"), "_中").alias("wide"))


@query("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_name LIKE 's%'")
def logic_and_or_not(t, spark, sf):
    return R.where(t("part"), ((col("p_size") < 5) | (col("p_size") > 45)) & ~S.like(col("p_name"), "s%")).select("p_partkey")


_SOME_ORDERS = "(SELECT * FROM orders WHERE o_totalprice > 300000)"


def _customers_and_some_orders(t):
    return J.join(t("customer"), R.where(t("orders"), col("o_totalprice") > 300000), col("c_custkey") == col("o_custkey"), "left")


@query(f"SELECT c_custkey FROM customer LEFT JOIN {_SOME_ORDERS} o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def is_null(t, spark, sf):
    return R.where(_customers_and_some_orders(t), col("o_orderkey").isNull()).select("c_custkey")


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_SOME_ORDERS} o ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL")
def is_not_null(t, spark, sf):
    return R.where(_customers_and_some_orders(t), col("o_orderkey").isNotNull()).select("c_custkey", "o_orderkey")


@query("""SELECT a, b, a AND b AS both, a OR b AS either, NOT a AS neg FROM (VALUES (true, true), (true, false), (true, NULL),
          (false, true), (false, false), (false, NULL), (NULL, true), (NULL, false), (NULL::BOOLEAN, NULL::BOOLEAN)) v(a, b)""")
def null_three_valued(t, spark, sf):
    rows = values(spark, [(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    return rows.select("a", "b", (col("a") & col("b")).alias("both"), (col("a") | col("b")).alias("either"), (~col("a")).alias("neg"))


# ---- arithmetic, casts, functions ----


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 10 AS plus, l_linenumber - 10 AS minus, l_linenumber * 3 AS times, l_quantity + l_linenumber AS mixed FROM lineitem")
def arith_add_sub_mul(t, spark, sf):
    n = col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", (n + 10).alias("plus"), (n - 10).alias("minus"), (n * 3).alias("times"), (col("l_quantity") + n).alias("mixed"))


@query("SELECT p_partkey, CAST(p_size // 7 AS INTEGER) AS quotient, CAST((-p_size) // 7 AS INTEGER) AS negative FROM part")
def arith_int_div(t, spark, sf):
    return t("part").select("p_partkey", S.int_div(col("p_size"), lit(7)).alias("quotient"), S.int_div(-col("p_size"), lit(7)).alias("negative"))


@query("SELECT p_partkey, p_retailprice / p_size AS ratio FROM part WHERE p_size > 0")
def arith_double_div(t, spark, sf):
    return R.where(t("part"), col("p_size") > 0).select("p_partkey", S.divide(col("p_retailprice"), col("p_size")).alias("ratio"))


@query("SELECT p_partkey, -p_size AS size, -p_retailprice AS price FROM part")
def unary_minus(t, spark, sf):
    return t("part").select("p_partkey", (-col("p_size")).alias("size"), (-col("p_retailprice")).alias("price"))


@query("SELECT id, CASE WHEN flag IN ('t') THEN true WHEN flag IN ('f') THEN false END AS value FROM (VALUES (1, 't'), (2, 'f'), (3, NULL)) v(id, flag)")
def cast_bool(t, spark, sf):
    return values(spark, [(1, "t"), (2, "f"), (3, None)], "id int, flag string").select("id", S.to_bool(col("flag")).alias("value"))


@query("SELECT p_partkey, lower(p_brand) AS brand FROM part")
def lower(t, spark, sf):
    return t("part").select("p_partkey", S.lower(col("p_brand")).alias("brand"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def upper(t, spark, sf):
    return t("part").select("p_partkey", S.upper(col("p_name")).alias("name"))


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes FROM documents")
def byte_length(t, spark, sf):
    return t("documents").select("doc_id", S.byte_length(col("text")).alias("bytes"))


# ---- joins ----


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner_on(t, spark, sf):
    return J.join(t("nation"), t("region"), col("n_regionkey") == col("r_regionkey")).select("n_name", "r_name")


@query("SELECT a.n_regionkey AS n_regionkey, b.n_regionkey AS right_n_regionkey, a.n_name AS name, b.n_nationkey AS nation FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_using(t, spark, sf):
    a = t("nation").select("n_regionkey", col("n_name").alias("name"))
    b = t("nation").select("n_regionkey", col("n_nationkey").alias("nation"))
    return J.join_using(a, b, "n_regionkey")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(t, spark, sf):
    out = J.join(t("orders"), t("customer"), col("o_custkey") == col("c_custkey"))
    out = J.join(out, t("nation"), col("c_nationkey") == col("n_nationkey"))
    return J.join(out, t("region"), col("n_regionkey") == col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT n_nationkey, r_regionkey FROM nation, region")
def join_cross(t, spark, sf):
    return J.cross(t("nation"), t("region")).select("n_nationkey", "r_regionkey")


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey * 5 AND n_regionkey <> r_regionkey")
def join_theta(t, spark, sf):
    on = (col("n_nationkey") < col("r_regionkey") * 5) & (col("n_regionkey") != col("r_regionkey"))
    return J.join(t("nation"), t("region"), on).select("n_nationkey", "r_regionkey")


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def self_join_alias(t, spark, sf):
    both = J.join(t("nation", "a"), t("nation", "b"), col("a.n_regionkey") == col("b.n_regionkey"))
    return R.where(both, col("a.n_nationkey") < col("b.n_nationkey")).select(col("a.n_name").alias("one"), col("b.n_name").alias("other"))


@query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 200000")
def join_from_where(t, spark, sf):
    both = J.cross(t("orders"), t("customer"))
    return R.where(both, (col("o_custkey") == col("c_custkey")) & (col("o_totalprice") > 200000)).select("o_orderkey", "c_name")


def _outer(how: str, sql: str) -> None:
    def run(t, spark, sf):
        left = R.where(t("customer"), col("c_nationkey") < 20)
        right = R.where(t("orders"), col("o_totalprice") > 250000)
        return J.join(left, right, col("c_custkey") == col("o_custkey"), how).select("c_custkey", "o_orderkey")

    run.__name__ = f"join_{how}"
    query(f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey < 20) c {sql} JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey")(run)


for _how in ("left", "right", "full"):
    _outer(_how, _how.upper())


def _forced(algorithm: str) -> None:
    def run(t, spark, sf):
        on = col("o_custkey") == col("c_custkey")
        if algorithm == "broadcast":
            both = J.broadcast_checked(t("orders"), t("customer"), on)
        else:
            both = J.join(t("orders"), t("customer"), on, "inner", algorithm)
        return A.aggregate(both, ["c_mktsegment"], n=A.count_star(), total=S.exact_sum(col("o_totalprice")))

    run.__name__ = f"join_forced_{algorithm}"
    query("SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")(run)


for _algorithm in ("merge", "hash", "broadcast", "none"):
    _forced(_algorithm)


def _bounded_relations(spark):
    """Four tables of about a hundred rows each, whose statistics make one join order clearly best."""
    n = spark.range(100).select(col("id").cast("int").alias("i"))
    r1 = n.select((col("i") % 5 + 1).alias("a"))
    r2 = n.select((col("i") % 4 + 1).alias("a"), (col("i") % 10 + 1).alias("b"))
    r3 = spark.range(101).select(col("id").cast("int").alias("i")).select((col("i") % 2 + 1).alias("b"), (col("i") % 20 + 1).alias("c"))
    r4 = n.select((col("i") % 25 + 1).alias("c"))
    sizes = {"r1": (100, {"a": 5}), "r2": (100, {"a": 4, "b": 10}), "r3": (101, {"b": 2, "c": 20}), "r4": (100, {"c": 25})}
    return [J.Relation(k, df, *sizes[k]) for k, df in (("r1", r1), ("r2", r2), ("r3", r3), ("r4", r4))]


@query("""WITH r1 AS (SELECT i % 5 + 1 AS a FROM range(100) t(i)), r2 AS (SELECT i % 4 + 1 AS a, i % 10 + 1 AS b FROM range(100) t(i)),
          r3 AS (SELECT i % 2 + 1 AS b, i % 20 + 1 AS c FROM range(101) t(i)), r4 AS (SELECT i % 25 + 1 AS c FROM range(100) t(i))
          SELECT CAST(r1.a AS INTEGER) AS a, CAST(r3.b AS INTEGER) AS b, CAST(r4.c AS INTEGER) AS c, count(*) AS n
          FROM r1 JOIN r2 ON r1.a = r2.a JOIN r3 ON r2.b = r3.b JOIN r4 ON r3.c = r4.c GROUP BY ALL""")
def greedy_join_result(t, spark, sf):
    joined = J.greedy_join(_bounded_relations(spark), [("r1", "r2", "a"), ("r2", "r3", "b"), ("r3", "r4", "c")])
    return A.aggregate(joined, [col("r1_a").alias("a"), col("r3_b").alias("b"), col("r4_c").alias("c")], n=A.count_star())


# ---- aggregation ----


@query("SELECT count(*) AS n FROM lineitem")
def agg_count_star(t, spark, sf):
    return A.aggregate(t("lineitem"), [], n=A.count_star())


@query(f"SELECT count(o_orderkey) AS n, count(*) AS rows_all FROM customer LEFT JOIN {_SOME_ORDERS} o ON c_custkey = o_custkey")
def agg_count_col(t, spark, sf):
    return A.aggregate(_customers_and_some_orders(t), [], n=F.count("o_orderkey"), rows_all=A.count_star())


@query("SELECT CAST(sum(p_size) AS BIGINT) AS sizes, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS prices FROM part")
def agg_sum(t, spark, sf):
    return A.aggregate(t("part"), [], sizes=F.sum("p_size"), prices=S.exact_sum(col("p_retailprice")))


@query("SELECT avg(p_size) AS size, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(p_retailprice) AS price FROM part")
def agg_avg(t, spark, sf):
    return A.aggregate(t("part"), [], size=F.avg("p_size"), price=S.exact_sum(col("p_retailprice")) / F.count("p_retailprice"))


@query("SELECT min(p_size) AS least, max(p_retailprice) AS most, min(p_name) AS first_name FROM part")
def agg_min_max(t, spark, sf):
    return A.aggregate(t("part"), [], least=F.min("p_size"), most=F.max("p_retailprice"), first_name=F.min("p_name"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t, spark, sf):
    return A.aggregate(t("lineitem"), ["l_returnflag"], suppliers=F.count_distinct("l_suppkey"))


@query("SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes, avg(DISTINCT p_size) AS mean FROM part")
def agg_sum_distinct(t, spark, sf):
    return A.aggregate(t("part"), [], sizes=F.sum_distinct("p_size"), mean=F.sum_distinct("p_size") / F.count_distinct("p_size"))


@query("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes, avg(p_size) AS mean, min(p_size) AS least FROM part WHERE p_size < 0")
def agg_empty_input(t, spark, sf):
    return A.aggregate(R.where(t("part"), col("p_size") < 0), [], n=A.count_star(), sizes=F.sum("p_size"), mean=F.avg("p_size"), least=F.min("p_size"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by(t, spark, sf):
    return A.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], n=A.count_star(), quantity=S.exact_sum(col("l_quantity")))


@query("SELECT CAST(p_size // 10 AS INTEGER) AS decade, count(*) AS n FROM part GROUP BY decade")
def group_by_expr(t, spark, sf):
    return A.aggregate(t("part"), [S.int_div(col("p_size"), lit(10)).alias("decade")], n=A.count_star())


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def group_by_having(t, spark, sf):
    return A.aggregate(t("orders"), ["o_custkey"], col("n") > 12, n=A.count_star())


@query(f"SELECT o_orderstatus, count(*) AS n FROM customer LEFT JOIN {_SOME_ORDERS} o ON c_custkey = o_custkey GROUP BY o_orderstatus")
def group_by_null_key(t, spark, sf):
    return A.aggregate(_customers_and_some_orders(t), ["o_orderstatus"], n=A.count_star())


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t, spark, sf):
    return R.distinct(t("orders").select("o_orderstatus", "o_orderpriority"))


@query("""SELECT 'c_nationkey' AS column_name, count(DISTINCT c_nationkey) AS n_distinct, count(*) AS cardinality FROM customer
          UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FROM customer""")
def analyze_counts(t, spark, sf):
    return A.analyze(t("customer"), ["c_nationkey", "c_mktsegment"])


# ---- sort and limit ----


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def order_multi(t, spark, sf):
    return R.order_by(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", ("o_totalprice", "desc"), "o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")
def order_desc(t, spark, sf):
    return R.order_by(t("part").select("p_partkey", "p_retailprice"), ("p_retailprice", "desc"), "p_partkey")


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {_SOME_ORDERS} o ON c_custkey = o_custkey ORDER BY o_orderkey DESC NULLS LAST, c_custkey")
def order_nulls(t, spark, sf):
    return R.order_by(_customers_and_some_orders(t).select("c_custkey", "o_orderkey"), ("o_orderkey", "desc"), "c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 17")
def limit(t, spark, sf):
    return R.limit(R.order_by(t("orders").select("o_orderkey"), "o_orderkey"), 17)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 14900")
def offset(t, spark, sf):
    return R.limit(R.order_by(t("orders").select("o_orderkey"), "o_orderkey"), None, 14900)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def limit_offset(t, spark, sf):
    return R.limit(R.order_by(t("orders"), ("o_totalprice", "desc"), "o_orderkey"), 10, 5).select("o_orderkey")


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(t, spark, sf):
    return R.limit(t("orders").select("o_orderkey"), 0)


@query("SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 9 OFFSET 3")
def distinct_limit(t, spark, sf):
    return R.limit(R.order_by(R.distinct(t("orders").select("o_custkey")), "o_custkey"), 9, 3)


# ---- row changes ----


@query("SELECT * FROM region UNION ALL SELECT * FROM (VALUES (5, 'ATLANTIS'), (6, NULL)) v")
def insert_values(t, spark, sf):
    return M.insert(t("region"), values(spark, [(5, "ATLANTIS"), (6, None)], "k int, n string"))


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def insert_select(t, spark, sf):
    more = R.where(t("nation"), col("n_regionkey") == 1).select(col("n_nationkey") + 100, S.lower(col("n_name")), "n_regionkey")
    return M.insert(t("nation"), more)


@query("SELECT * FROM nation UNION ALL SELECT 200, NULL, 3")
def insert_missing_cols(t, spark, sf):
    return M.insert(t("nation"), values(spark, [(3, 200)], "r int, k int"), ["n_regionkey", "n_nationkey"])


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size + 100 ELSE p_size END AS p_size, CASE WHEN p_size > 40 THEN 'LARGE' ELSE p_brand END AS p_brand FROM part")
def update_where(t, spark, sf):
    table = t("part").select("p_partkey", "p_size", "p_brand")
    return M.update(table, {"p_size": col("p_size") + 100, "p_brand": lit("LARGE")}, col("p_size") > 40)


@query("SELECT p_partkey, CASE WHEN p_size < 30 THEN p_size + 20 ELSE p_size END AS p_size FROM part")
def update_halloween(t, spark, sf):
    return M.update(t("part").select("p_partkey", "p_size"), {"p_size": col("p_size") + 20}, col("p_size") < 30)


@query("SELECT * FROM region WHERE NOT (r_regionkey < 2 OR r_name = 'EUROPE')")
def delete_where(t, spark, sf):
    return M.delete(t("region"), (col("r_regionkey") < 2) | (col("r_name") == "EUROPE"))


@query("SELECT * FROM region WHERE false")
def delete_all(t, spark, sf):
    return M.delete(t("region"))


# ---- the SQL dialect, lowered to the same plans ----


def _dialect(name: str, text: str, oracle: str | None = None) -> None:
    def run(t, spark, sf):
        names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
        return select_over({n: t(n) for n in names}, text)

    run.__name__ = f"sql_{name}"
    query(oracle or text)(run)


_dialect("select", "SELECT p_partkey AS k, p_size * 2 + 1 AS odd, -p_size AS neg, lower(p_brand) AS brand FROM part WHERE p_size BETWEEN 5 AND 30 AND p_name LIKE '%r%'")
_dialect("int_div", "SELECT p_partkey, p_size / 7 AS q FROM part WHERE NOT p_size / 7 = 2", "SELECT p_partkey, CAST(p_size // 7 AS INTEGER) AS q FROM part WHERE NOT p_size // 7 = 2")
_dialect("length", "SELECT n_name, length(n_name) AS bytes FROM nation", "SELECT n_name, CAST(strlen(n_name) AS INTEGER) AS bytes FROM nation")
_dialect("joins", "SELECT c.c_custkey AS k, n.n_name AS nation, r.r_name AS region FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA' WHERE c.c_acctbal > 0")
_dialect("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND (r_name IN ('ASIA', 'EUROPE') OR n_nationkey < 3)")
_dialect("group", "SELECT n_regionkey AS r, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, max(c_custkey) AS last FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY r HAVING count(*) > 1")
_dialect("scalar_aggregate", "SELECT count(*) AS n, min(p_size) AS least, avg(p_size) AS mean FROM part WHERE p_size > 3 AND p_brand IS NOT NULL")
_dialect("distinct", "SELECT DISTINCT o_orderstatus AS s, o_custkey / 100 AS hundreds FROM orders", "SELECT DISTINCT o_orderstatus AS s, o_custkey // 100 AS hundreds FROM orders")
_dialect("top", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 4")


# ---- composite plans over the star schema ----

_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _revenue():
    return S.money(col("l_extendedprice")) * (lit(1).cast("decimal(1,0)") - S.money(col("l_discount"), 4))


def _day(text: str):
    return lit(text).cast("timestamp_ntz")


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price, CAST(sum({_PRICE}) AS DOUBLE) AS sum_disc_price,
          CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS avg_qty, count(*) AS count_order
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def tpch_like_q1(t, spark, sf):
    quantity = F.sum(S.money(col("l_quantity"))).cast("double")
    return A.aggregate(
        R.where(t("lineitem"), col("l_shipdate") <= _day("1998-09-02")), ["l_returnflag", "l_linestatus"],
        sum_qty=quantity, sum_base_price=F.sum(S.money(col("l_extendedprice"))).cast("double"), sum_disc_price=F.sum(_revenue()).cast("double"),
        avg_qty=quantity / A.count_star(), count_order=A.count_star(),
    )


@query(f"""SELECT l_orderkey, o_orderdate, CAST(sum({_PRICE}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
          JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
          GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def tpch_like_q3(t, spark, sf):
    out = J.join(R.where(t("customer"), col("c_mktsegment") == "BUILDING"), R.where(t("orders"), col("o_orderdate") < _day("1995-03-15")), col("c_custkey") == col("o_custkey"))
    out = J.join(out, R.where(t("lineitem"), col("l_shipdate") > _day("1995-03-15")), col("l_orderkey") == col("o_orderkey"))
    out = A.aggregate(out, ["l_orderkey", "o_orderdate"], revenue=F.sum(_revenue()).cast("double"))
    return R.limit(R.order_by(out, ("revenue", "desc"), "l_orderkey"), 10)


@query(f"""SELECT n_name, CAST(sum({_PRICE}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
          JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          WHERE r_name = 'ASIA' GROUP BY n_name""")
def tpch_like_q5(t, spark, sf):
    out = J.join(t("lineitem"), t("orders"), col("l_orderkey") == col("o_orderkey"))
    out = J.join(out, t("customer"), col("o_custkey") == col("c_custkey"))
    out = J.join(out, t("supplier"), (col("l_suppkey") == col("s_suppkey")) & (col("c_nationkey") == col("s_nationkey")))
    out = J.join(out, t("nation"), col("s_nationkey") == col("n_nationkey"))
    out = J.join(out, R.where(t("region"), col("r_name") == "ASIA"), col("n_regionkey") == col("r_regionkey"))
    return A.aggregate(out, ["n_name"], revenue=F.sum(_revenue()).cast("double"))


@query("""SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem
          WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def tpch_like_q6(t, spark, sf):
    shipped = (col("l_shipdate") >= _day("1994-01-01")) & (col("l_shipdate") < _day("1995-01-01"))
    rows = R.where(t("lineitem"), shipped & S.between(col("l_discount"), 0.05, 0.07) & (col("l_quantity") < 24))
    return A.aggregate(rows, [], revenue=F.sum(S.money(col("l_extendedprice")) * S.money(col("l_discount"), 4)).cast("double"))


@query(f"""SELECT c_custkey, c_name, n_name, CAST(sum({_PRICE}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
          JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R'
          GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def tpch_like_q10(t, spark, sf):
    out = J.join(R.where(t("lineitem"), col("l_returnflag") == "R"), t("orders"), col("l_orderkey") == col("o_orderkey"))
    out = J.join(out, t("customer"), col("o_custkey") == col("c_custkey"))
    out = J.join(out, t("nation"), col("c_nationkey") == col("n_nationkey"))
    out = A.aggregate(out, ["c_custkey", "c_name", "n_name"], revenue=F.sum(_revenue()).cast("double"))
    return R.limit(R.order_by(out, ("revenue", "desc"), "c_custkey"), 20)


@query("""SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey
          JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY n_name HAVING count(*) > 5 ORDER BY total DESC, n_name LIMIT 10""")
def flagship(t, spark, sf):
    """Scan, filter, two joins, aggregate, having, sort, limit."""
    out = J.join(R.where(t("orders"), col("o_totalprice") > 100000), t("customer"), col("o_custkey") == col("c_custkey"))
    out = J.join(out, t("nation"), col("c_nationkey") == col("n_nationkey"))
    out = A.aggregate(out, ["n_name"], col("orders") > 5, orders=A.count_star(), total=S.exact_sum(col("o_totalprice")))
    return R.limit(R.order_by(out, ("total", "desc"), "n_name"), 10)
