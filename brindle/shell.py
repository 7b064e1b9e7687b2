"""The loop that reads statements and prints their rows, and a listing of a store's log."""

from __future__ import annotations

import json

from brindle.sources.snapshots import Store
from brindle.sql.errors import EngineError


def loop(connection, lines, out, style: str = "table") -> None:
    """Runs each statement of lines; a fault is printed and doesn't end the loop."""
    held = ""
    for line in lines:
        held += line
        text = held.strip()
        if not text:
            held = ""
        elif text in ("\\q", "quit", "exit"):
            return
        elif text.startswith("\\") or text.endswith(";"):
            held = ""
            try:
                for result in connection.execute(text):
                    print(result.text(style) or result.tag, file=out)
            except EngineError as e:
                print(f"Error: {e}", file=out)


def print_log(store: Store, out) -> None:
    """Each version of a store that is kept: its tables, and the folders that came and went since the one before."""
    before: dict = {}
    for version, state in store.history():
        print(f"version {version}", file=out)
        now = {(d, t): table for d, content in state["databases"].items() for t, table in content["tables"].items()}
        for key in sorted({*before, *now}):
            table, was = now.get(key), before.get(key, {})
            if table is None:
                print(f"  - {'.'.join(key)}", file=out)
                continue
            columns = ", ".join(f"{n} {k}({size})" if k in ("char", "varchar") else f"{n} {k}" for n, k, size in table["columns"])
            changes = [f"    {sign} {what} {path.rsplit('/', 1)[-1]}" for what in ("segments", "removed") for sign, new, old in (("+", table, was), ("-", was, table)) for path in new.get(what, []) if path not in old.get(what, [])]
            if key not in before or changes or table != was:
                print(f"  {'+' if key not in before else ' '} {'.'.join(key)} (oid {table['oid']}): {columns}", file=out)
                for line in changes:
                    print(line, file=out)
                if table.get("statistics") != was.get("statistics"):
                    print(f"    statistics {json.dumps(table['statistics'])}", file=out)
        before = now
