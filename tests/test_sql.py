"""The SQL front end: golden files, isolation, locks, recovery, plans."""

import os

import pytest

from brindle.sql import golden
from brindle.sql.engine import Engine
from brindle.sql.errors import EngineError

HERE = os.path.join(os.path.dirname(__file__), "golden")


@pytest.mark.parametrize("name", sorted(os.listdir(HERE)))
def test_golden(name, engine):
    with open(os.path.join(HERE, name)) as f:
        assert golden.run(engine, f.read()) == []


def rows(connection, text):
    return sorted(connection.query(text).rows, key=str)


def plan(connection, text):
    return connection.query(f"explain (optimizer) {text}").text()


def test_golden_runner_sees_faults(engine):
    assert len(golden.run(engine, "query\nselect 1\n----\n2\n\nstatement error\nselect 1\n\nstatement ok\nselect x\n")) == 3


def test_filters_land_below_the_join(engine):
    c = engine.connect()
    c.execute("create table a(id int, x double); create table b(id int, y varchar(9)); insert into a values (1, 1.5); insert into b values (1, 'q')")
    text = plan(c, "select a.x, b.y from a, b where a.id = b.id and a.x > 1 and b.y = 'q'")
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,1.0)" in text


@pytest.mark.parametrize("how, node", [("merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin")])
def test_forced_joins(engine, how, node):
    c = engine.connect()
    c.execute(f"create table a(id int); create table b(id int); insert into a values (1), (2); insert into b values (2), (3); set force_join = {how}")
    assert node in plan(c, "select a.id from a join b on a.id = b.id")
    assert rows(c, "select a.id from a join b on a.id = b.id") == [(2,)]


def test_greedy_order(engine):
    c = engine.connect()
    c.execute("create table r1(a int); create table r2(a int, b int); create table r3(b int, c int); create table r4(c int)")
    fill = lambda t, f, n=100: c.execute(f"insert into {t} values " + ", ".join(f(i) for i in range(n)))
    fill("r1", lambda i: f"({i % 5 + 1})")
    fill("r2", lambda i: f"({i % 4 + 1}, {i % 10 + 1})")
    fill("r3", lambda i: f"({i % 2 + 1}, {i % 20 + 1})", 101)
    fill("r4", lambda i: f"({i % 25 + 1})")
    query = "select count(*) from r1, r2, r3, r4 where r1.a = r2.a and r2.b = r3.b and r3.c = r4.c"
    plain = rows(c, query)
    c.execute("analyze; set join_order_algorithm = greedy")
    assert rows(c, query) == plain == [(80800,)]
    # r2 with r3, then r4, then r1: the deepest join is of b, the last of a.
    planned = c.query("explain (planner) " + query).text()
    joins = [line.split("Join")[1] for line in planned.split("\n") if "Join Inner" in line]
    assert len(joins) == 3
    assert rows(c, "select n_distinct from sys_statistic where table_name = 'r4'") == [(25,)]


def test_statements_of_a_failed_batch_before_the_fault_stay(engine):
    c = engine.connect()
    c.execute("create table t(id int)")
    with pytest.raises(EngineError):
        c.execute("insert into t values (1); insert into t values ('a'); insert into t values (3)")
    assert rows(c, "select * from t") == [(1,)]


def test_rollback_and_own_changes(engine):
    c = engine.connect()
    c.execute("create table t(id int); insert into t values (1), (2); begin; insert into t values (3); update t set id = id + 10 where id > 1; delete from t where id = 1")
    assert rows(c, "select * from t") == [(12,), (13,)]
    assert rows(engine.connect(), "select * from t") == [(1,), (2,)]
    c.execute("rollback")
    assert rows(c, "select * from t") == [(1,), (2,)]
    with pytest.raises(EngineError):
        c.execute("commit")


def test_failed_statement_leaves_the_transaction_open(engine):
    c = engine.connect()
    c.execute("create table t(id int, s varchar(2)); begin; insert into t values (1, 'a')")
    with pytest.raises(EngineError):
        c.execute("insert into t values (2, 'b'), (3, 'long')")
    with pytest.raises(EngineError):
        c.execute("create table u(id int)")
    with pytest.raises(EngineError):
        c.execute("begin")
    c.execute("commit")
    assert rows(c, "select id from t") == [(1,)]


@pytest.mark.parametrize("level, during", [("read_committed", 2), ("serializable", 2), ("repeatable_read", 1)])
def test_isolation(engine, level, during):
    a, b = engine.connect(), engine.connect()
    a.execute("create table t(id int); insert into t values (1)")
    b.execute(f"set isolation_level = {level}; begin")
    assert len(rows(b, "select * from t")) == 1
    a.execute("begin; insert into t values (2)")
    assert len(rows(b, "select * from t")) == 1
    a.execute("commit")
    assert len(rows(b, "select * from t")) == during
    b.execute("commit")
    assert len(rows(b, "select * from t")) == 2


def test_write_skew_on_different_rows(engine):
    a, b = engine.connect(), engine.connect()
    a.execute("create table t(s varchar(1)); insert into t values ('A'), ('B')")
    for c in (a, b):
        c.execute("set isolation_level = repeatable_read")
    a.execute("begin; update t set s = 'B' where s = 'A'")
    b.execute("begin; update t set s = 'A' where s = 'B'; select * from t")
    assert rows(b, "select * from t") == [("A",), ("A",)]
    a.execute("commit")
    b.execute("commit")
    assert rows(a, "select * from t") == [("A",), ("B",)]


def test_a_row_changed_since_cannot_be_changed_again(engine):
    a, b = engine.connect(), engine.connect()
    a.execute("create table t(id int); insert into t values (1)")
    b.execute("set isolation_level = repeatable_read; begin; select * from t")
    a.execute("update t set id = 2")
    with pytest.raises(EngineError):
        b.execute("update t set id = 3")
    b.execute("rollback; update t set id = 4 where id = 2")
    assert rows(a, "select * from t") == [(4,)]


def test_row_locks(engine):
    a, b, c = (engine.connect() for _ in range(3))
    a.execute("create table t(s varchar(1), v int); insert into t values ('A', 0), ('B', 0); begin")
    b.execute("begin")
    a.execute("delete from t where s = 'A'")
    for text in ("update t set v = 5 where s = 'A'", "delete from t", "select * from t for share"):
        with pytest.raises(EngineError):
            b.execute(text)
    b.execute("update t set v = 7 where s = 'B'; commit")
    a.execute("rollback; begin; select * from t where s = 'A' for share")
    b.execute("begin; select * from t for share")
    for text in ("select * from t for update", "update t set v = 1 where s = 'A'"):
        with pytest.raises(EngineError):
            c.execute(text)
    for x in (a, b):
        x.execute("commit")
    assert c.query("update t set v = v + 1").rows == [(2,)]
    assert rows(c, "select * from t") == [("A", 1), ("B", 8)]


@pytest.mark.parametrize("first, then, fits", [
    ("insert into t values (9)", "lock t in share mode", False), ("insert into t values (9)", "insert into t values (8)", True),
    ("lock t in share mode", "lock t in share mode", True), ("lock t in share mode", "update t set id = 6 where id = 2", False),
    ("lock t in exclusive mode", "select * from t", False), ("select * from t", "lock t in exclusive mode", False),
    ("lock t in share mode; insert into t values (9)", "lock t in share mode", False), ("lock t in share mode; insert into t values (9)", "select * from t", True),
])
def test_table_locks(engine, first, then, fits):
    a, b = engine.connect(), engine.connect()
    a.execute("create table t(id int); insert into t values (1), (2); begin")
    a.execute(first)
    b.execute("begin")
    if fits:
        b.execute(then)
    else:
        with pytest.raises(EngineError):
            b.execute(then)
    a.execute("rollback")
    b.execute(then)
    b.execute("commit")


def test_crash_keeps_what_was_committed(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    engine = Engine(spark, root)
    a, b = engine.connect(), engine.connect()
    a.execute("create table t(id int); insert into t values (1), (2); begin; delete from t where id = 1; insert into t values (3); checkpoint")
    b.execute("begin; insert into t values (4); commit")
    engine.crash()
    for c in (engine.connect(), Engine(spark, root).connect(), a):
        assert rows(c, "select * from t") == [(1,), (2,), (4,)]
    a.execute("begin; delete from t where id = 1; commit")


def test_settings_and_meta_commands(engine):
    c = engine.connect()
    for bad in ("show nothing", "set isolation_level = x", "set join_order_algorithm = x", "set force_join = x", "set enable_optimizer = 7", "\\c", "\\c none", "\\x", "drop database main", "drop database none", "create database system"):
        with pytest.raises(EngineError):
            c.execute(bad)
    c.execute("set a = abc; set enable_optimizer = off; set isolation_level = 'serializable'; set deadlock = wait_die; create index i on t(id); drop index i")
    assert c.query("show a").text() == "abc" and c.query("show isolation_level").text() == "serializable"
    c.execute("create database other")
    with pytest.raises(EngineError):
        c.execute("create database other")
    assert c.query("\\l").text() == "system\nmain\nother" and c.query("show databases").text() == c.query("\\l").text()
    c.execute("\\c other")
    c.execute("create table a(id int, g char, name varchar(10), score double)")
    assert c.query("\\d").text() == c.query("show tables").text() == "a"
    assert c.query("\\d a").text() == "id int 4\ng char 1\nname varchar 10\nscore double 8"
    assert rows(c, "select db_name from sys_database") == [("main",), ("other",)]
    assert rows(c, "select table_name, cardinality from sys_table") == [("a", None)]
    c.execute("\\c main")
    c.execute("drop database other")
    assert "SELECT" in c.query("\\?").text().upper() or c.query("\\?").rows


def test_explain_stages(engine):
    c = engine.connect()
    c.execute("create table t(id int)")
    assert [x for x in c.query("explain select id from t where id > 1").text().split("\n") if x.startswith("===")] == ["===Binder===", "===Planner===", "===Optimizer==="]
    for text in ("explain (planner) update t set id = 1 where id = 2", "explain (binder) insert into t values (1)", "explain (optimizer) delete from t"):
        assert c.query(text).rows
    with pytest.raises(EngineError):
        c.execute("explain begin")


def test_writers(engine):
    result = engine.connect().query("select 1 as a, null as b, 0.1 + 0.2 as c, '<x>' as d")
    assert result.text() == "1 NULL 0.3 <x>"
    assert "| a | b    | c   | d   |" in result.text("table")
    assert "<td>&lt;x&gt;</td>" in result.text("html")


def test_computed_variables(engine):
    c = engine.connect()
    c.execute("create table t(id int); insert into t values (1); select * from t")
    assert c.query("show redo_count").text() == "0" and int(c.query("show disk_access_count").text()) > 0


def test_select_over_frames(spark):
    from brindle.sql.binder import select_over

    df = spark.createDataFrame([(2**40, None, True)], "big long, at timestamp, flag boolean")
    assert [tuple(r) for r in select_over({"t": df}, "select big + 1 as b, at is null as n, flag and true as f, big / 2 as h from t").collect()] == [(2**40 + 1, True, True, 2**39)]
    for bad in ("insert into t values (1)", "select * from other", "select at + 1 from t"):
        with pytest.raises(EngineError):
            select_over({"t": df}, bad)


def test_shell(engine):
    import io

    from brindle.__main__ import loop

    out = io.StringIO()
    loop(engine.connect(), io.StringIO("create table t(id int);\ninsert into t\nvalues (1), (2);\n\\d\nselect x from t;\nselect id from t\norder by id;\n\\q\nselect 9;\n"), out, "plain")
    assert out.getvalue().split("\n")[:6] == ["CREATE TABLE", "2", "t", 'Error: column "x" does not exist', "1", "2"]


def two_engines(spark, tmp_path, level="read_committed"):
    """Two processes' view of one store, each with an open transaction."""
    root = f"file://{tmp_path}/shared"
    first = Engine(spark, root).connect()
    first.execute("create table t(id int, n int); insert into t values (1, 10), (2, 20), (3, 30)")
    second = Engine(spark, root).connect()
    for c in (first, second):
        c.execute(f"set isolation_level = {level}; begin")
    return first, second


@pytest.mark.parametrize("level", ["read_committed", "repeatable_read", "serializable"])
@pytest.mark.parametrize("change", ["update t set n = 11 where id = 1", "delete from t where id = 1"])
def test_the_second_of_two_engines_cannot_commit_the_same_row(spark, tmp_path, level, change):
    first, second = two_engines(spark, tmp_path, level)
    first.execute("update t set n = 12 where id = 1")
    second.execute(change)
    first.execute("commit")
    with pytest.raises(EngineError, match="changed by a transaction that has committed"):
        second.execute("commit")
    assert rows(second, "select id, n from t") == [(1, 12), (2, 20), (3, 30)]
    # What has failed can be done anew.
    second.execute(change)
    assert len(rows(first, "select id from t where n = 12")) == 0


def test_engines_commit_different_rows(spark, tmp_path):
    first, second = two_engines(spark, tmp_path, "repeatable_read")
    first.execute("update t set n = 12 where id = 1; insert into t values (4, 40)")
    second.execute("update t set n = 22 where id = 2; delete from t where id = 3; update t set n = 23 where id = 2")
    first.execute("commit")
    second.execute("commit")
    assert rows(first, "select id, n from t") == [(1, 12), (2, 23), (4, 40)]


def test_a_vacuum_between_does_not_hide_a_conflict(spark, tmp_path):
    first, second = two_engines(spark, tmp_path)
    first.execute("update t set n = 12 where id = 1; commit")
    second.execute("insert into t values (5, 50); update t set n = 51 where id = 5; update t set n = 22 where id = 2")
    first.execute("update t set n = 33 where id = 3; vacuum")
    second.execute("commit")
    assert rows(first, "select id, n from t") == [(1, 12), (2, 22), (3, 33), (5, 51)]
    second.execute("begin; update t set n = 0 where id = 1")
    first.execute("update t set n = 1 where id = 1; vacuum")
    with pytest.raises(EngineError, match="changed by a transaction"):
        second.execute("commit")
    assert rows(first, "select n from t where id = 1") == [(1,)]


def test_of_many_writers_of_one_version_one_succeeds(engine):
    from concurrent.futures import ThreadPoolExecutor

    files, path = engine.store.files, f"{engine.store.root}/_log/{77:012d}.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: files.create(path, f'{{"by": {k}}}' + " " * 100_000), range(16)))
    assert sum(made) == 1 and files.read(path).strip() == f'{{"by": {made.index(True)}}}'
    assert [n for n in files.names(f"{engine.store.root}/_log") if n.endswith(".tmp")] == []


def test_exclusive_files_without_links(engine):
    files, path = engine.store.files, f"{engine.store.root}/_log/{78:012d}.json"
    assert files._link(path + ".missing", path, bytearray(b"{}")) and files.read(path) == "{}"  # a link that can't be made
    with pytest.raises(Exception, match="FileAlreadyExists"):
        files._link(path + ".missing", path, bytearray(b"[]"))
    assert files.read(path) == "{}"


def test_writers_at_once_lose_nothing(engine):
    from concurrent.futures import ThreadPoolExecutor

    engine.connect().execute("create table t(id int)")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: engine.connect().execute(f"insert into t values ({k})"), range(12)))
    assert rows(engine.connect(), "select id from t") == sorted([(k,) for k in range(12)], key=str)


def test_vacuum_frees_what_is_no_longer_named(engine):
    c, store = engine.connect(), engine.store
    c.execute("create table t(id int); create table u(id int); insert into t values (1), (2); insert into u values (7)")
    for k in range(3):
        c.execute(f"update t set id = id + {k + 1}")
    c.execute("delete from t where id = 7")
    assert len(store.files.names(f"{store.root}/data")) == 6
    c.execute("vacuum")
    assert len(store.files.names(f"{store.root}/data")) == 2 and len(store.files.names(f"{store.root}/_log")) == 1
    assert rows(c, "select id from t") == [(8,)] and rows(c, "select id from u") == [(7,)]
    # What another process has written and not committed stays, unless it is old.
    path, _ = store.write(engine.spark.range(1).toDF("id"))
    c.execute("vacuum")
    assert len(store.files.names(f"{store.root}/data")) == 3
    store.ORPHAN_SECONDS = -1
    c.execute("vacuum")
    assert len(store.files.names(f"{store.root}/data")) == 2 and rows(c, "select id from t") == [(8,)]


def test_long_lists(engine):
    c = engine.connect()
    c.execute("create table t(id int, s varchar(9)); insert into t values (1, 'a'), (2, 'b'), (null, null), (4000000, 'd')")
    many = ", ".join(str(k) for k in range(2, 3000))
    assert rows(c, f"select id from t where id in ({many})") == [(2,)] and rows(c, f"select id from t where id not in ({many})") == [(1,), (4000000,)]
    assert "OR" not in plan(c, f"select id from t where id in ({many})")
    assert rows(c, "select s from t where s in ('a', 'd', 'x', 'y')") == [("a",), ("d",)]
    assert rows(c, "select id from t where id in (1, null, 7)") == [(1,)] and rows(c, "select id from t where id not in (5, null, 7)") == []
    assert rows(c, "select id from t where id in (1, 2.0, 7)") == [(1,), (2,)]
