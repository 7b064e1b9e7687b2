"""Brings this package to executors that don't have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

_HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark) -> None:
    """Adds the package, zipped, to the application's Python files, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_brindle_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="brindle-"), "brindle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(_HERE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("brindle", os.path.relpath(full, _HERE)))
    context.addPyFile(path)
    context._brindle_shipped = True


def shipped(query):
    """The query, with the package shipped before it is built."""

    @functools.wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
