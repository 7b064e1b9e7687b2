"""Versioned tables over Parquet in any file system that Spark reads.

A state names, for each table, the folders its rows lie in (segments) and folders of removed row
keys. States are numbered files under ``_log``; the next one is created exclusively, so of two
writers only one succeeds and the other tries again on what it left. Data folders are written before
the state that names them and never changed, so a reader keeps its version and a crash leaves at most
folders that no state names. ``free`` deletes what only past states name.

A row's key is (__seg, __row): the segment's random number and the row's number in it. An update
writes one folder with the new rows, their new keys, and the keys they replace; a delete writes the
keys alone. Row changes thus cost what they touch, not the whole table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.tables import values
from brindle.sql.errors import EngineError

KEYS, OLD = ("__seg", "__row"), ("__old_seg", "__old_row")
_KINDS = {"int": T.IntegerType(), "double": T.DoubleType(), "char": T.StringType(), "varchar": T.StringType(), "uint": T.LongType()}


class Files:
    """The file system operations the log needs, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def create(self, path: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if there is one already, however many try at once."""
        raw, scheme = bytearray(text.encode()), self.fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "webhdfs", "viewfs"):
            # Object stores show a file when it is closed, and refuse then if there is one.
            return self._write(path, raw, False)
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        self._write(temp, raw, True)
        try:
            if scheme == "file":  # a rename would replace; a link doesn't
                return self._link(temp, path, raw)
            return bool(self.fs.rename(self._path(temp), self._path(path)))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(self._path(temp), False)

    def _link(self, temp: str, path: str, raw: bytearray) -> bool:
        nio = self.jvm.java.nio.file
        place = lambda p: nio.Paths.get(self.fs.makeQualified(self._path(p)).toUri())
        try:
            nio.Files.createLink(place(path), place(temp))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            # A file system without links: created exclusively, though for a moment it is there and not yet whole.
            nio.Files.write(place(path), raw, self._options("CREATE_NEW", "WRITE"))
        return True

    def _options(self, *names: str):
        kind = self.jvm.java.nio.file.StandardOpenOption
        out = self.gateway.new_array(self.jvm.java.nio.file.OpenOption, len(names))
        for i, name in enumerate(names):
            out[i] = getattr(kind, name)
        return out

    def _write(self, path: str, raw: bytearray, overwrite: bool) -> bool:
        try:
            out = self.fs.create(self._path(path), overwrite)
            out.write(raw)
            out.close()
            return True
        except Py4JJavaError as e:
            if overwrite or not any(w in str(e.java_exception) for w in ("AlreadyExists", "already exists", "PreconditionFailed", "412")):
                raise
            return False

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def ages(self, folder: str) -> dict[str, float]:
        """Seconds since each entry of a folder was written last."""
        p, now = self._path(folder), time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self.fs.listStatus(p)} if self.fs.exists(p) else {}


def empty_state(database: str) -> dict:
    return {"version": 0, "next_oid": 2, "databases": {database: {"oid": 1, "tables": {}}}}


class Store:
    """States and data folders under one root."""

    KEPT = 20  # versions of the log that stay
    ORPHAN_SECONDS = 86_400  # age at which a folder that no version ever named was left by a crash

    def __init__(self, spark: SparkSession, root: str, database: str = "main"):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.folders_read = 0
        if not self._versions():
            self.files.create(self._file(0), json.dumps(empty_state(database)))

    def _file(self, version: int) -> str:
        return f"{self.root}/_log/{version:012d}.json"

    def _versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.root}/_log") if n.endswith(".json")]

    def state(self) -> dict:
        for _ in range(5):
            last = max(self._versions())
            try:
                return json.loads(self.files.read(self._file(last)))
            except Py4JJavaError:  # deleted meanwhile by another process: there is a later one then
                if max(self._versions()) == last:
                    raise
            except json.JSONDecodeError:  # not yet whole
                time.sleep(0.2)
        raise EngineError("too many writers at once")

    def history(self) -> list[tuple[int, dict]]:
        """The versions that are kept, with their states, the oldest first."""
        return [(v, json.loads(self.files.read(self._file(v)))) for v in self._versions()]

    def publish(self, change: Callable[[dict], None], tries: int = 50) -> dict:
        """Applies change to the latest state and writes the outcome as the next; again if another writer was first."""
        for _ in range(tries):
            state = self.state()
            change(state)
            state["version"] += 1
            if self.files.create(self._file(state["version"]), json.dumps(state)):
                for v in self._versions()[: -self.KEPT]:
                    self.files.delete(self._file(v))
                return state
        raise EngineError("too many writers at once")

    def folder(self) -> str:
        return f"{self.root}/data/{uuid.uuid4().hex}"

    # -- rows --

    def schema(self, table: dict) -> T.StructType:
        return T.StructType([T.StructField(n, _KINDS[k], True) for n, k, _ in table["columns"]])

    def read(self, table: dict, segments: list[str], removed: list[str]) -> DataFrame:
        """Rows with their keys."""
        schema = T.StructType([*self.schema(table).fields, *(T.StructField(c, T.LongType()) for c in KEYS)])
        if not segments:
            return values(self.spark, [], schema)
        self.folders_read += len(segments) + len(removed)
        rows = self.spark.read.schema(schema).parquet(*segments)
        if not removed:
            return rows
        return rows.join(self.read_keys(removed), list(KEYS), "left_anti").select(*schema.names)

    def read_keys(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in OLD])
        if not folders:
            return values(self.spark, [], schema).toDF(*KEYS)
        return self.spark.read.schema(schema).parquet(*folders).toDF(*KEYS)

    def write(self, rows: DataFrame) -> tuple[str, int]:
        """Writes rows to a new folder; its path and the number of rows, counted on the way."""
        path, seen = self.folder(), Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return path, seen.get["n"]

    def with_keys(self, rows: DataFrame) -> DataFrame:
        """Adds a new key to each row."""
        return rows.withColumn(KEYS[0], F.lit(uuid.uuid4().int >> 66)).withColumn(KEYS[1], F.monotonically_increasing_id())

    def compact(self, table: dict) -> tuple[list[str], list[str]]:
        """The table's rows in one new segment, keys unchanged: (segments, removed)."""
        if len(table["segments"]) <= 1 and not table["removed"]:
            return table["segments"], table["removed"]
        path, n = self.write(self.read(table, table["segments"], table["removed"]))
        return ([path] if n else []), []

    @staticmethod
    def _named(state: dict) -> set[str]:
        return {p for d in state["databases"].values() for t in d["tables"].values() for p in (*t["segments"], *t["removed"])}

    def free(self) -> int:
        """Forgets all states but the latest, and deletes the folders that only they named, and old ones that none named; how many.

        A transaction of another process that still reads a past state fails from then on; folders it
        has written and not committed are left alone.
        """
        *past, (_, last) = self.history()
        before = {p for _, state in past for p in self._named(state)}
        now = self._named(last)
        for v, _ in past:
            self.files.delete(self._file(v))
        prefix = f"{self.root}/data/"
        old = {prefix + name for name, age in self.files.ages(prefix).items() if age > self.ORPHAN_SECONDS}
        gone = (before | old) - now
        for path in gone:
            self.files.delete(path)
        return len(gone)

    # -- conflicts --

    def share_keys(self, folder: str, others: list[str]) -> bool:
        """Whether a folder of removed keys has one that is in the other folders too."""
        return bool(others) and not self.read_keys([folder]).join(self.read_keys(others), list(KEYS), "left_semi").isEmpty()

    def all_live(self, folder: str, table: dict) -> bool:
        """Whether all keys of a folder are those of rows the table has."""
        rows = self.read(table, table["segments"], table["removed"]).select(*KEYS)
        return self.read_keys([folder]).join(rows, list(KEYS), "left_anti").isEmpty()
