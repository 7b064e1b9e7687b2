"""A stream of files lands in a versioned table once, also when it is started again."""

from brindle.sources.snapshots import Store
from brindle.streaming.ingest import append_batch, ingest


def test_ingest(spark, engine, tmp_path):
    c = engine.connect()
    c.execute("create table t(id int, s varchar(9))")
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").write.parquet(source)
    start = lambda: ingest(spark.readStream.schema("id int, s string").parquet(source), engine.store, "t", "files", f"{tmp_path}/check", availableNow=True)
    start().awaitTermination(60)
    spark.createDataFrame([(3, None)], "id int, s string").write.mode("append").parquet(source)
    start().awaitTermination(60)
    start().awaitTermination(60)
    assert sorted(r[0] for r in c.query("select id from t").rows) == [1, 2, 3]


def test_a_batch_is_added_once(spark, engine):
    engine.connect().execute("create table t(id int)")
    rows = spark.createDataFrame([(1,)], "id int")
    store: Store = engine.store
    assert append_batch(store, "main", "t", "s", rows, 0)
    assert not append_batch(store, "main", "t", "s", rows, 0)
    assert append_batch(store, "main", "t", "s", rows, 1)
    assert engine.connect().query("select count(*) from t").rows == [(2,)]
