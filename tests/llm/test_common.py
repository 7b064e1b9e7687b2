"""Batches of bounded size, stored tables, joins with hot keys."""

import os
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import common
from brindle.llm.common import forget, fresh_prefix, in_pieces, join_hot, map_arrow, own_dir, prepared, shared_dir, stored


def test_pieces_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    texts = ["x" * n for n in (10, 5000, 10, 10, 400, 900, 0, 3000, 1)] * 20
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    pieces = list(in_pieces([batch, batch.slice(0, 0)]))
    assert [i for p in pieces for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows and (p.num_rows == 1 or p.nbytes <= 2000) for p in pieces)
    assert [p.num_rows for p in in_pieces([batch.slice(2, 2)])] == [2]


def test_columns_with_dots(spark):
    df = spark.range(3).selectExpr("id as `a.b`", "id + 1 as c")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("a.b")], names=["n"])

    assert sorted(r.n for r in map_arrow(df, run, "n long").collect()) == [0, 1, 2]


def test_the_shared_folder(spark):
    set_ = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == set_ and own_dir(spark).startswith(set_)
    # Unset: the warehouse, never a folder of one machine.
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: {"spark.sql.warehouse.dir": "hdfs:///w"}.get(key, *default)))
    assert shared_dir(bare) == "hdfs:///w"


def test_stored_tables(spark):
    first, second = stored(spark.range(10), "t"), stored(spark.range(6).withColumn("k", F.col("id") % 2), "t", partition_by="k")
    place = first.stored_at.removeprefix("file:")
    assert first.count() == 10 and second.where("k = 1").count() == 3 and os.path.isdir(place)
    forget(first)
    assert not os.path.exists(place) and second.count() == 6


def test_settings_are_lowered_by_applications_only(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "67108864")
        map_arrow(spark.range(1), lambda batches: batches, "id long").collect()
        assert spark.conf.get(key) == "67108864"
        prepared(spark)
        assert spark.conf.get(key) == str(common.SENT_BYTES)
        for small in ("1000", "512k"):
            spark.conf.set(key, small)
            prepared(spark)
            assert spark.conf.get(key) == small
        spark.conf.set(key, "8m")
        prepared(spark)
        assert spark.conf.get(key) == str(common.SENT_BYTES)
    finally:
        spark.conf.set(key, before.rstrip("b"))


def test_hot_keys(spark):
    left = spark.range(8000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("weight")).withColumn("v", F.col("k") * 2)
    got = join_hot(left, right, "k", "weight", 8000)
    assert got.count() == 8000 and got.where("v = 2 * k").count() == 8000
    assert fresh_prefix(spark.range(1).withColumn("__Xx", F.lit(1))) == "__xxx"
