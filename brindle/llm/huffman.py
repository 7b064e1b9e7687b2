"""Token ids in files: canonical, length-limited Huffman codes from global counts.

A written set of ids is a folder with two Parquet tables used as containers. ``codebook`` has one row:
the ids that occur and the lengths of their codes (canonical: codes ascend by length, then id).
``blocks`` has a row for each independent block: its file, its place there, the documents in it, in
order, and its bytes:

    "BHF1" | documents n, ids m, checkpoints c (each an unsigned 32-bit integer, little-endian)
    | ids of each document (n x unsigned 32-bit) | bit offset of each checkpoint (c x unsigned 64-bit)
    | the codes, most significant bit first

A checkpoint stands before every STRIDE-th id, so a block is decoded from all its checkpoints at once
with one table lookup for each id, and single documents can be read without what comes before them.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import field, map_arrow, own_dir, session_of, stored
from brindle.llm.spans import texts_of
from brindle.llm.tokens import unit_encoder

MAGIC, STRIDE, BLOCK_IDS, MIN_LIMIT = b"BHF1", 256, 1 << 18, 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths, limit at most, of an optimal prefix code for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    items, marks = leaves, []
    for _ in range(limit):
        if marks:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, pairs])
            place = np.argsort(both, kind="stable")
            items, leaf = both[place], place < n
        else:
            leaf = np.ones(n, bool)
        marks.append(leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(marks):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Codes of the given ids (ascending) by their lengths, and the decoding table."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids.astype(np.int64), lengths.astype(np.int64)
        self.limit = int(self.lengths.max()) if len(ids) else 1
        size = int(self.ids[-1]) + 1 if len(ids) else 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.table = np.zeros(1 << self.limit, np.uint32)  # id << 8 | length, for each next `limit` bits
        order = np.lexsort((self.ids, self.lengths))
        spans = np.int64(1) << (self.limit - self.lengths[order])
        begin = np.cumsum(spans) - spans  # of each code among the tables's slots
        self.length[self.ids] = self.lengths
        self.code[self.ids[order]] = (begin >> (self.limit - self.lengths[order])).astype(np.uint64)
        if len(ids):
            filled = np.repeat(self.ids[order] << 8 | self.lengths[order], spans).astype(np.uint32)
            self.table[: len(filled)] = filled

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Codebook:
        return cls(ids, code_lengths(counts, max(MIN_LIMIT, int(np.ceil(np.log2(max(2, len(ids))))) + 1)))

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the checkpoints and the bytes."""
        if not len(ids):
            return np.zeros(0, np.uint64), b""
        code, length = self.code[ids], self.length[ids]
        over = np.cumsum(length)
        at = over - length
        word, end = at >> 6, (at & 63) + length
        spill = end > 64
        high = np.where(spill, code >> np.where(spill, end - 64, 0).astype(np.uint64), code << np.where(spill, 0, 64 - end).astype(np.uint64))
        out = np.zeros((int(over[-1]) >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(high, first)
        out[word[spill] + 1] |= code[spill] << (128 - end[spill]).astype(np.uint64)
        return at[::STRIDE].astype(np.uint64), out.astype(">u8").tobytes()[: (int(over[-1]) + 7) >> 3]

    def decode(self, count: int, checkpoints: np.ndarray, data: bytes) -> np.ndarray:
        if not count:
            return np.zeros(0, np.uint32)
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits from each byte on
        at = checkpoints.astype(np.int64)
        out = np.zeros((STRIDE, len(at)), np.uint32)
        last, down = len(ahead) - 1, np.uint32(32 - self.limit)
        for k in range(min(STRIDE, count)):
            bits = ahead[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
            got = self.table[bits >> down]
            out[k] = got >> np.uint32(8)
            at += got & np.uint32(255)
        return out.T.ravel()[:count]


def pack_block(book: Codebook, docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    checkpoints, data = book.encode(ids)
    head = np.array([len(docs), len(ids), len(checkpoints), *map(len, docs)], "<u4")
    return MAGIC + head.tobytes() + checkpoints.astype("<u8").tobytes() + data


def unpack_block(book: Codebook, block: bytes) -> list[np.ndarray]:
    if block[:4] != MAGIC:
        raise ValueError("not a block")
    n, m, c = np.frombuffer(block, "<u4", 3, 4).tolist()
    sizes = np.frombuffer(block, "<u4", n, 16)
    at = 16 + 4 * n
    ids = book.decode(m, np.frombuffer(block, "<u8", c, at), block[at + 8 * c :])
    return np.split(ids, np.cumsum(sizes)[:-1]) if n else []


def _tokenised(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, file, at (ids before it in its file), ids as bytes; files in ascending order of id.

    A row of file -1 ends each partition: it holds the partition's counts, as pairs of id and number (unsigned 64 bits).
    """
    schema = T.StructType([field(df, id_col), T.StructField("file", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        from pyspark import TaskContext

        encoder = unit_encoder(tokenizer)
        kind = np.dtype("<u2" if max(encoder.size, end_id) <= 1 << 16 else "<u4")
        end = np.array([end_id], kind)
        file, so_far, n = TaskContext.get().partitionId(), 0, np.zeros(max(encoder.size, end_id + 1), np.int64)
        for b in batches:
            ids, at = encoder.encode(*texts_of(b.column(text_col)))
            n += np.bincount(ids, minlength=len(n))
            n[end_id] += b.num_rows
            ids = ids.astype(kind)
            rows = [np.concatenate([ids[at[i] : at[i + 1]], end]) for i in range(b.num_rows)]
            before = so_far + np.cumsum([0, *map(len, rows)])
            so_far = int(before[-1])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([file] * len(rows), pa.int32()), pa.array(before[:-1], pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary())], names=schema.names)
        seen = np.flatnonzero(n)
        if len(seen):
            counts = np.stack([seen, n[seen]], 1).astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column(id_col).type), pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([counts], pa.binary())], names=schema.names)

    ordered = df.select(id_col, text_col).repartitionByRange(F.col(id_col).asc()).sortWithinPartitions(F.col(id_col).asc())
    return map_arrow(ordered, run, schema)


def _pairs(batches):
    """id and n of each pair of some counts."""
    for b in batches:
        pairs = np.frombuffer(b"".join(b.column("ids").to_pylist()), "<u8").reshape(-1, 2).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])


def write_ids(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (a null counts as empty), appends end_id, and writes the ids under path in ascending order of id.

    Whole texts are encoded, however long. Null ids come first; rows with equal ids stand in any order beside each other. An empty table
    gives an empty codebook and no blocks. Other columns are not read. What comes to the driver is
    a count for each id of the vocabulary.
    """
    spark = session_of(df)
    encoder = unit_encoder(tokenizer)
    kind = "<u2" if max(encoder.size, end_id) <= 1 << 16 else "<u4"
    tokens = stored(_tokenised(df, tokenizer, end_id, id_col, text_col), "tokens")
    # These rows lie at the end of each file: by the statistics of pages, little else is read.
    counted = map_arrow(tokens.where("file = -1").select("ids"), _pairs, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    tokens = tokens.where("file >= 0")
    table = np.array(sorted((r.id, r.n) for r in counted), np.int64).reshape(-1, 2)
    book = Codebook.of_counts(table[:, 0], table[:, 1])
    spark.createDataFrame([(bytearray(table[:, 0].astype("<u4").tobytes()), bytearray(book.lengths.astype(np.uint8).tobytes()))], "ids binary, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    spread = spark.sparkContext.broadcast((book.ids, book.lengths))
    kept = tokens.schema[id_col].dataType
    schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("docs", T.ArrayType(kept)), T.StructField("block", T.BinaryType())])

    def run(batches):
        own = Codebook(*spread.value)

        def block(file, at, docs, rows, ids_type):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([at], pa.int64()), pa.array([sum(map(len, rows))], pa.int64()), pa.array([docs], pa.list_(ids_type)), pa.array([pack_block(own, rows)], pa.binary())], names=schema.names)

        for b in batches:
            docs, rows, size, head = [], [], 0, None
            for doc, file, at, raw in zip(*(b.column(c).to_pylist() for c in (id_col, "file", "at", "ids")), strict=True):
                if rows and (size >= BLOCK_IDS or file != head[0] or at != head[1] + size):
                    yield block(*head, docs, rows, b.column(id_col).type)
                    docs, rows, size = [], [], 0
                if not rows:
                    head = (file, at)
                docs.append(doc)
                rows.append(np.frombuffer(raw, kind))
                size += len(rows[-1])
            if rows:
                yield block(*head, docs, rows, b.column(id_col).type)

    # Blocks are Huffman codes already: the container needn't compress them again.
    map_arrow(tokens, run, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row for each document written: id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids; no rows where none were written."""
    (row,) = spark.read.parquet(f"{path}/codebook").collect()
    spread = spark.sparkContext.broadcast((np.frombuffer(bytes(row.ids), "<u4"), np.frombuffer(bytes(row.lengths), np.uint8)))
    blocks = spark.read.parquet(f"{path}/blocks")
    fields = [T.StructField(id_col, blocks.schema["docs"].dataType.elementType), T.StructField("file", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("at", "n_tokens", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        book = Codebook(*spread.value)
        for b in batches:
            for i in range(b.num_rows):
                docs = unpack_block(book, b.column("block")[i].as_py())
                sizes = np.array([len(x) for x in docs], np.int64)
                at = b.column("at")[i].as_py() + np.cumsum(sizes) - sizes
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in docs]
                columns = [b.column("docs")[i].values, pa.array([b.column("file")[i].as_py()] * len(docs), pa.int32()), pa.array(at), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in docs], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    docs = map_arrow(blocks, run, T.StructType(fields))
    # Files follow each other in order of their number: what stands before one is a sum over files, which are few.
    last = blocks.select("file", (F.col("at") + F.col("n")).alias("end")).groupBy("file").agg(F.max("end").alias("size"))
    before = last.select("file", (F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    out = docs.join(before, "file").withColumn("start", F.col("before") + F.col("at"))
    return out.select(id_col, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def ids_round_trip(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``write_ids`` to path (a new one in the shared folder if none is given), then ``read_ids``."""
    spark = session_of(df)
    path = path or f"{own_dir(spark)}/ids-{uuid.uuid4().hex[:12]}"
    write_ids(df, path, tokenizer, end_id, id_col, text_col)
    return read_ids(spark, path, id_col, with_ids)
