"""Registered queries that go the way a user's statements go: through a connection, its transactions, and the store.

Each makes a store of its own in the shared folder, loads whole tables, runs a script, and returns the
rows of its last statement.
"""

from __future__ import annotations

import uuid

from brindle.plans.catalogue import query
from brindle.sources.snapshots import Store
from brindle.sql.engine import Engine, Result
from brindle.streaming.ingest import append_batch

PART = ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _opened(spark) -> Engine:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Engine(spark, f"{shared.rstrip('/')}/brindle-store/{uuid.uuid4().hex}")


def _loaded(t, spark):
    """A connection to a new store that has the tables part and orders."""
    c = _opened(spark).connect()
    c.load("part", t("part").select(*PART))
    c.load("orders", t("orders").select(*ORDERS))
    return c


def _rows(result: Result):
    return result.df.toDF(*result.names)


def _script(name: str, text: str, oracle: str) -> None:
    def run(t, spark, sf):
        return _rows(_loaded(t, spark).query(text))

    run.__name__ = f"engine_{name}"
    query(oracle)(run)


_PART, _ORDERS = f"SELECT {', '.join(PART)} FROM part", f"SELECT {', '.join(ORDERS)} FROM orders"
_script("insert_values", "INSERT INTO part VALUES (900001, 'new part', 'Brand#99', 7, 1.5), (900002, NULL, NULL, NULL, NULL); SELECT * FROM part",
        _PART + " UNION ALL VALUES (900001, 'new part', 'Brand#99', 7, 1.5), (900002, NULL, NULL, NULL, NULL)")
_script("insert_select", "INSERT INTO part SELECT p_partkey, upper(p_name), p_brand, p_size * 2, p_retailprice FROM part WHERE p_size > 25; SELECT * FROM part",
        _PART + " UNION ALL SELECT p_partkey, upper(p_name), p_brand, p_size * 2, p_retailprice FROM part WHERE p_size > 25")
_script("insert_columns", "INSERT INTO part (p_size, p_partkey) SELECT p_size, p_partkey FROM part WHERE p_size < 5; SELECT * FROM part",
        _PART + " UNION ALL SELECT p_partkey, NULL, NULL, p_size, NULL FROM part WHERE p_size < 5")
_script("update", "UPDATE part SET p_size = p_size + 100, p_brand = 'LARGE' WHERE p_size > 40; SELECT * FROM part",
        "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 'LARGE' ELSE p_brand END AS p_brand, CASE WHEN p_size > 40 THEN p_size + 100 ELSE p_size END AS p_size, p_retailprice FROM part")
_script("update_halloween", "UPDATE part SET p_size = p_size + 20 WHERE p_size < 30; SELECT p_partkey, p_size FROM part",
        "SELECT p_partkey, CASE WHEN p_size < 30 THEN p_size + 20 ELSE p_size END AS p_size FROM part")
_script("update_twice", "UPDATE orders SET o_totalprice = o_totalprice * 2 WHERE o_orderstatus = 'O'; UPDATE orders SET o_orderstatus = 'X' WHERE o_totalprice > 300000; SELECT * FROM orders",
        "SELECT o_orderkey, o_custkey, CASE WHEN price > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, price AS o_totalprice FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders)")
_script("delete", "DELETE FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 50000; SELECT * FROM orders", _ORDERS + " WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
_script("delete_all", "DELETE FROM orders; SELECT count(*) AS n, max(o_orderkey) AS last FROM orders", "SELECT 0::BIGINT AS n, NULL::BIGINT AS last")
_script("rollback", "BEGIN; DELETE FROM part WHERE p_size > 10; UPDATE part SET p_brand = 'gone'; INSERT INTO part (p_partkey) VALUES (1); ROLLBACK; SELECT * FROM part", _PART)
_script("commit", "BEGIN; DELETE FROM part WHERE p_size > 10; UPDATE part SET p_brand = lower(p_brand); COMMIT; SELECT * FROM part",
        "SELECT p_partkey, p_name, lower(p_brand) AS p_brand, p_size, p_retailprice FROM part WHERE p_size <= 10")
_script("vacuum", "DELETE FROM part WHERE p_size > 25; UPDATE part SET p_size = 0 WHERE p_size < 3; VACUUM; UPDATE part SET p_size = -1 WHERE p_size = 0; SELECT p_partkey, p_size FROM part",
        "SELECT p_partkey, CASE WHEN p_size < 3 THEN -1 ELSE p_size END AS p_size FROM part WHERE p_size <= 25")
_script("join_after_changes", "UPDATE orders SET o_custkey = 1 WHERE o_orderstatus = 'P'; DELETE FROM part WHERE p_size <> 7; SELECT p_partkey, count(*) AS n FROM part JOIN orders ON p_partkey = o_custkey GROUP BY p_partkey",
        "SELECT p_partkey, count(*) AS n FROM part JOIN (SELECT CASE WHEN o_orderstatus = 'P' THEN 1 ELSE o_custkey END AS k FROM orders) ON p_partkey = k WHERE p_size = 7 GROUP BY p_partkey")
_script("statistics", "ANALYZE; SELECT table_name, column_name, n_distinct FROM sys_statistic",
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cs in (("part", PART), ("orders", ORDERS)) for c in cs))
_script("system_tables", "CREATE TABLE empty (id int); CREATE TABLE dropped (id int); DROP TABLE dropped; ANALYZE; SELECT table_name, cardinality FROM sys_table",
        "SELECT 'part' AS table_name, count(*) AS cardinality FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'empty', 0")
_script("databases", "CREATE DATABASE other; CREATE DATABASE third; DROP DATABASE third; SELECT db_name FROM sys_database", "SELECT unnest(['main', 'other']) AS db_name")


def _meanwhile(level: str):
    """What a transaction of that level sees after another one has changed rows and committed."""

    def run(t, spark, sf):
        c = _loaded(t, spark)
        c.execute(f"SET isolation_level = {level}; BEGIN; UPDATE part SET p_brand = 'own' WHERE p_size = 1")
        c.engine.connect().execute("UPDATE part SET p_brand = 'other' WHERE p_size = 2; DELETE FROM part WHERE p_size > 40")
        return _rows(c.query("SELECT * FROM part"))

    return run


def _seen(other: str, where: str) -> str:
    return f"SELECT p_partkey, p_name, CASE WHEN p_size = 1 THEN 'own' {other} ELSE p_brand END AS p_brand, p_size, p_retailprice FROM part {where}"


for _level, _sql in (("read_committed", _seen("WHEN p_size = 2 THEN 'other'", "WHERE p_size <= 40")), ("repeatable_read", _seen("", ""))):
    _run = _meanwhile(_level)
    _run.__name__ = f"engine_{_level}"
    query(_sql)(_run)


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'kept' ELSE p_brand END AS p_brand FROM part")
def engine_recovery(t, spark, sf):
    c = _loaded(t, spark)
    c.execute("UPDATE part SET p_brand = 'kept' WHERE p_size > 20; BEGIN; UPDATE part SET p_brand = 'lost'; DELETE FROM part WHERE p_size < 9")
    return _rows(Engine(spark, c.engine.store.root).connect().query("SELECT p_partkey, p_brand FROM part"))


@query(_ORDERS + " UNION ALL " + _ORDERS + " WHERE o_orderstatus = 'F'")
def engine_stream_batches(t, spark, sf):
    """Micro-batches: the second comes again after a failure and is added once."""
    engine = _opened(spark)
    orders = t("orders").select(*ORDERS)
    engine.connect().load("orders", orders.limit(0))
    store: Store = engine.store
    for batch, rows in ((0, orders), (1, orders.where("o_orderstatus = 'F'")), (1, orders.where("o_orderstatus = 'F'"))):
        append_batch(store, "main", "orders", "s", rows, batch)
    return _rows(engine.connect().query("SELECT * FROM orders"))
