"""A server on a Unix socket: every client has a connection of its own, all share one engine."""

from __future__ import annotations

import io
import os
import shutil
import socket
import socketserver
import threading

from brindle.shell import loop
from brindle.sql.engine import Engine


def server(engine: Engine, path: str, style: str = "table") -> socketserver.ThreadingUnixStreamServer:
    """A server that listens at path, which a server gone before may have left; ``serve_forever`` runs it.

    A client that goes away has its open transaction rolled back.
    """

    class Client(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            connection = engine.connect()
            out = io.TextIOWrapper(self.wfile, "utf-8", newline="\n", write_through=True)
            try:
                loop(connection, io.TextIOWrapper(self.rfile, "utf-8", errors="replace", newline="\n"), out, style)
            except (BrokenPipeError, ConnectionResetError):
                pass
            finally:
                if connection.transaction:
                    connection.execute("rollback")

    class Server(socketserver.ThreadingUnixStreamServer):
        daemon_threads, allow_reuse_address = True, True

        def server_close(self) -> None:
            super().server_close()
            if os.path.exists(path):
                os.unlink(path)

    if os.path.exists(path):
        with socket.socket(socket.AF_UNIX) as probe:
            if probe.connect_ex(path) == 0:
                raise OSError(f"a server listens at {path} already")
        os.unlink(path)
    return Server(path, Client)


def client(path: str, lines, out) -> None:
    """Sends lines to the server at path and writes what it answers to out, until both have ended."""
    with socket.socket(socket.AF_UNIX) as s:
        s.connect(path)

        def send() -> None:
            try:
                for line in lines:
                    s.sendall(line.encode())
                s.shutdown(socket.SHUT_WR)
            except OSError:  # the server has ended the session
                pass

        threading.Thread(target=send, daemon=True).start()
        with s.makefile("r", encoding="utf-8", newline="\n") as answers:
            shutil.copyfileobj(answers, out, 1)
