"""Exact duplicates by two passes over a Bloom filter of text hashes.

The first pass hashes every text and counts, in cells of a Bloom filter that saturate at two, how
often each hash may occur. The second pass tests each hash: where one of its cells was hit once only,
the text is alone and its row passes straight through; only the others ("possibly repeated") are
shuffled by hash and settled exactly. A filter is made for ROUND_ROWS hashes. More of them are dealt by
hash into rounds, 32 bytes and an id for each row: one round after the other has its filter made, sent
out, asked for that round's hashes alone, and taken back, so neither what is broadcast at once nor
what a worker holds grows with the input.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.bloom import CELLS, MAX_CELLS, bloom_filter, flat, may_hold
from brindle.llm.common import field, forget, fresh_prefix, join_hot, map_arrow, own_dir, session_of, stored
from brindle.llm.tokens import release_encoders

ROUND_ROWS = MAX_CELLS // CELLS
#: Partitions that a round's hashes are written in.
_ROUND_PARTS = 64


def normal_digest(text: str | None) -> bytes:
    """SHA-256 of the text, A-Z lower-cased, in UTF-8; a null counts as empty."""
    return hashlib.sha256((text or "").encode().lower()).digest()  # bytes.lower() folds A-Z alone


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.lower()).digest() for x in texts.fill_null("").cast(pa.binary()).to_pylist()], pa.binary())


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and sha of each row."""

    def run(batches):
        release_encoders()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), _digests(b.column(text_col))], names=[id_col, "sha"])

    return map_arrow(df.select(id_col, text_col), run, T.StructType([field(df, id_col), T.StructField("sha", T.BinaryType())]))


def _asked(digests: DataFrame, rows: int) -> tuple[DataFrame, object]:
    """digests with a column maybe, from a filter over about ``rows`` of them, and the broadcast filter."""
    bits, cells = bloom_filter(digests, rows, least=2)
    spread = session_of(digests).sparkContext.broadcast(bits)

    def probe(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(may_hold(flat(b.column("sha")), spread.value, cells))], names=[*b.schema.names, "maybe"])

    return map_arrow(digests, probe, T.StructType([*digests.schema.fields, T.StructField("maybe", T.BooleanType())])), spread


def _probed(df: DataFrame, id_col: str, text_col: str, round_rows: int) -> tuple[DataFrame, int]:
    """Stored table of id, sha and maybe (whether the hash may be repeated), and its row count."""
    spark, rows = session_of(df), df.count()
    rounds = max(1, -(-rows // round_rows))
    digests = _hashed(df, id_col, text_col)
    if rounds == 1:
        digests = stored(digests, "digests")
        asked, spread = _asked(digests, rows)
        out = stored(asked, "probed")
        spread.destroy()
        forget(digests)
        return out, rows
    # Dealt by the hash alone: equal texts share a round, and a hot one is a share of one round at most in rows of a few bytes.
    mark = F.xxhash64("sha")
    dealt = digests.withColumn("round", F.pmod(mark, F.lit(rounds))).repartition(F.col("round"), F.pmod(F.xxhash64(id_col, "sha"), F.lit(_ROUND_PARTS)))
    digests = stored(dealt, "digests", partition_by="round")
    path = f"{own_dir(spark)}/probed-{uuid.uuid4().hex[:12]}"
    for k in range(rounds):
        asked, spread = _asked(digests.where(F.col("round") == k).drop("round"), -(-rows // rounds))
        asked.write.option("compression", "zstd").parquet(f"{path}/round={k}")
        spread.destroy()
    forget(digests)
    return spark.read.schema(asked.schema).parquet(path), rows


def _groups(probed: DataFrame, id_col: str) -> DataFrame:
    """Of the possibly repeated hashes: the id that stays and the number of rows."""
    return probed.where("maybe").groupBy("sha").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", round_rows: int = ROUND_ROWS) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null counts as empty, and whole texts
    are read, however long. Of equal texts the row with the largest id stays. Rows that share that largest
    id are one document and are all marked as kept (``exact_dedup_rows`` leaves one of them). A null id is
    smaller than any other; a group of null ids has a null keep_id and its rows are kept. An empty table
    gives an empty result. Other columns are not read.
    """
    probed, rows = _probed(df, id_col, text_col, round_rows)
    alone = probed.where(~F.col("maybe")).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long")})
    groups = stored(_groups(probed, id_col).withColumn("weight", F.col("group_size")), "groups")
    many = join_hot(probed.where("maybe").select(id_col, "sha"), groups, "sha", "weight", rows)
    out = alone.select(id_col, "sha", "keep_id", "group_size").unionByName(many.select(id_col, "sha", "keep_id", "group_size"))
    return out.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _has_map(kind: T.DataType) -> bool:
    inner = {T.ArrayType: lambda k: [k.elementType], T.StructType: lambda k: [f.dataType for f in k.fields]}.get(type(kind), lambda k: [])(kind)
    return isinstance(kind, T.MapType | T.VariantType) or any(map(_has_map, inner))


def exact_dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", round_rows: int = ROUND_ROWS) -> DataFrame:
    """The rows of df that stay, with all their columns, exactly one for each different text.

    A second filter, over the hashes that are really repeated, marks the rows to be shuffled; all others
    pass straight through. (Beyond ROUND_ROWS repeated texts it lets more and more rows through to
    the shuffle.) Among rows that share a group's largest id, the one with the smallest hash of all its
    columns stays, maps left out. Nulls, long texts and empty tables as in ``exact_dedup``.
    """
    probed, _ = _probed(df, id_col, text_col, round_rows)
    groups = stored(_groups(probed, id_col).where("group_size > 1"), "groups")
    p = fresh_prefix(df)

    bits, cells = bloom_filter(groups.select("sha"), groups.count())
    spread = session_of(df).sparkContext.broadcast(bits)

    def mark(batches):
        for b in batches:
            sha = _digests(b.column(text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, sha, pa.array(may_hold(flat(sha), spread.value, cells))], names=[*b.schema.names, f"{p}sha", f"{p}may"])

    marked = map_arrow(df, mark, T.StructType([*df.schema.fields, T.StructField(f"{p}sha", T.BinaryType()), T.StructField(f"{p}may", T.BooleanType())]))
    doubtful = marked.where(F.col(f"{p}may")).drop(f"{p}may")
    keep = groups.select(F.col("sha").alias(f"{p}key"), F.col("keep_id").alias(f"{p}keep"))
    joined = doubtful.join(keep, F.col(f"{p}sha") == F.col(f"{p}key"), "left")
    single = joined.where(F.col(f"{p}key").isNull()).select(*map(_quoted, df.columns))
    stay = joined.where(F.col(f"{p}key").isNotNull() & F.col(id_col).eqNullSafe(F.col(f"{p}keep")))
    order = F.xxhash64(*(_quoted(f.name) for f in df.schema.fields if not _has_map(f.dataType)))
    first = stay.groupBy(f"{p}sha").agg(F.min_by(F.struct(*map(_quoted, df.columns)), order).alias(f"{p}row")).select(f"{p}row.*")
    return marked.where(~F.col(f"{p}may")).select(*map(_quoted, df.columns)).unionByName(single).unionByName(first)


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")
