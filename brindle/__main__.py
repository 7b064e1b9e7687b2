"""python -m brindle ROOT           a shell: statements, a line or up to a semicolon each
python -m brindle serve ROOT PATH  a server on a Unix socket at PATH
python -m brindle connect PATH     a client of that server
python -m brindle log ROOT         the versions of the store, and what changed in each
"""

from __future__ import annotations

import sys

from brindle.session import create_session
from brindle.shell import loop, print_log


def main(arguments: list[str], lines=sys.stdin, out=sys.stdout) -> None:
    from brindle import serving
    from brindle.sources.snapshots import Store
    from brindle.sql.engine import Engine

    match arguments:
        case ["connect", path]:
            serving.client(path, lines, out)
            return
        case ["serve", _, _] | ["log", _] | [_]:
            pass
        case _:
            sys.exit(__doc__)
    spark = create_session("brindle shell")
    spark.sparkContext.setLogLevel("ERROR")
    match arguments:
        case ["serve", root, path]:
            with serving.server(Engine(spark, root), path) as server:
                print(f"listening at {path}", file=out, flush=True)
                server.serve_forever()
        case ["log", root]:
            print_log(Store(spark, root), out)
        case [root]:
            loop(Engine(spark, root).connect(), lines, out)


if __name__ == "__main__":
    main(sys.argv[1:])
