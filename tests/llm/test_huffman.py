"""Huffman codes: optimal, bounded, and an exact round trip through files."""

import heapq
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm.common import vocabulary
from brindle.llm.huffman import Codebook, code_lengths, ids_round_trip, pack_block, read_ids, unpack_block, write_ids
from tests.llm.cases import frame, tables, words
from tests.llm.test_spans_tokens import thue_morse


@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=60))
@settings(max_examples=100, deadline=None)
def test_lengths(counts):
    c = np.array(counts)
    heap, cost = counts[:], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (code_lengths(c, 40) * c).sum() == cost
    tight = code_lengths(c, 6)
    assert tight.max() <= 6 and (2.0**-tight).sum() <= 1


@given(st.lists(st.lists(st.integers(0, 70_000), max_size=700), max_size=6))
@settings(max_examples=60, deadline=None)
def test_blocks(docs):
    flat = np.array([i for d in docs for i in d], np.int64)
    ids, counts = np.unique(flat, return_counts=True)
    book = Codebook.of_counts(ids, counts)
    arrays = [np.array(d, np.uint32) for d in docs]
    assert [x.tolist() for x in unpack_block(book, pack_block(book, arrays))] == docs
    again = Codebook(book.ids, book.lengths)
    assert (again.code == book.code).all()


def test_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(vocabulary())  # as the file gives it
    long, other = thue_morse(10)
    more = [(100, "a <|endoftext|> b", "en", "a", 1), (101, f"{long} {other}", "en", "a", 1), (102, other, "en", "a", 1), (103, words(9, 25_000), "en", "a", 1)]
    for k, (df, rows) in enumerate([(frame(spark, more), more), *tables(spark)]):
        path = f"file://{tmp_path}/{k}"
        write_ids(df, path, vocabulary(), 2)
        got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
        texts = {(i, x) for i, x, *_ in rows}
        want = {i: [*library.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts}
        over = 0
        for r in got:
            assert r.ids == want[r.doc_id] and r.n_tokens == len(r.ids) and r.start == over
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            over += r.n_tokens
        assert spark.read.parquet(f"{path}/codebook").count() == 1
    assert ids_round_trip(df, vocabulary()).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
