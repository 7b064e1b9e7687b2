"""The server on a socket, its clients, and the listing of a store's log."""

import io
import socket
import threading

import pytest

from brindle.__main__ import main
from brindle.serving import client, server
from brindle.shell import print_log


@pytest.fixture
def listening(engine, tmp_path):
    path = str(tmp_path / "s")
    with server(engine, path, "plain") as s:
        thread = threading.Thread(target=s.serve_forever, daemon=True)
        thread.start()
        yield path
        s.shutdown()
        thread.join()


def said(path, text):
    out = io.StringIO()
    client(path, io.StringIO(text), out)
    return out.getvalue().split("\n")[:-1]


def test_clients_share_tables_not_sessions(listening, engine):
    assert said(listening, "create table t(id int, s varchar(9));\ninsert into t values (1, 'é'), (2, null);\nset force_join = hash;\n") == ["CREATE TABLE", "2", "SET"]
    assert said(listening, "select s from t\nwhere id = 1;\nshow force_join;\nselect nothing;\n\\d\n")[:2] == ["é", "none"]
    assert said(listening, "select nothing;\n\\q\nselect 1;\n") == ['Error: column "nothing" does not exist']
    assert engine.open == {}


def test_a_client_that_goes_away_is_rolled_back(listening, engine):
    said(listening, "create table t(id int);\n")
    with socket.socket(socket.AF_UNIX) as s:
        s.connect(listening)
        s.sendall(b"begin;\ninsert into t values (1);\n")
        answers = s.makefile()
        assert [answers.readline() for _ in range(2)] == ["BEGIN\n", "1\n"]
        assert len(engine.open) == 1
        answers.close()
        s.shutdown(socket.SHUT_RDWR)
    assert said(listening, "select count(*) from t;\n") == ["0"]
    for _ in range(100):
        if not engine.open:
            break
        threading.Event().wait(0.1)
    assert engine.open == {}


def test_one_server_for_a_socket(listening, engine):
    with pytest.raises(OSError, match="already"):
        server(engine, listening)


def test_log(engine):
    c = engine.connect()
    c.execute("create table t(id int, s varchar(9)); insert into t values (1, 'a'); update t set id = 2; analyze t; create table u(x double); drop table t")
    out = io.StringIO()
    print_log(engine.store, out)
    text = out.getvalue()
    assert "+ main.t (oid 2): id int, s varchar(9)" in text and "- main.t" in text and "+ main.u (oid 3): x double" in text
    assert text.count("+ segments") == 2 and text.count("+ removed") == 1 and 'statistics {"rows": 1' in text
    assert text.startswith("version 0\n")


def test_usage():
    with pytest.raises(SystemExit):
        main(["a", "b", "c", "d"])
