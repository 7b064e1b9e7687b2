"""Exact duplicates against plain grouping."""

import hashlib
import re
from collections import defaultdict

import numpy as np

from brindle.llm import exact_dedup as module
from brindle.llm.bloom import bloom_filter, may_hold
from brindle.llm.exact_dedup import exact_dedup, exact_dedup_rows, normal_digest
from tests.llm.cases import SCHEMA, awkward, collected, frame, tables


def fold(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def brute(rows):
    groups = defaultdict(list)
    for i, x, *_ in rows:
        groups[fold(x)].append(i)
    out = []
    for i, x, *_ in rows:
        own = groups[fold(x)]
        keep = max((j for j in own if j is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(fold(x).encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows(spark):
    for df, rows in tables(spark):
        for round_rows in (1 << 25, 5):
            assert collected(exact_dedup(df, round_rows=round_rows)) == brute(rows)


def test_rounds(spark, monkeypatch):
    rows = [(i, "Hot" if i % 3 else f"text {i % 2000}", "en", "a", 1) for i in range(6000)]
    seen = []

    def counted(digests, n, least=1):
        bits, cells = bloom_filter(digests, n, least)
        seen.append(digests.count())
        return bits, cells

    monkeypatch.setattr(module, "bloom_filter", counted)
    assert collected(exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(6), round_rows=1000)) == brute(rows)
    # Six rounds, each with a filter of its own hashes alone; the hot text lies in one of them.
    assert len(seen) == 6 and sum(seen) == 6000 and sorted(seen)[-2] < 1000


def test_no_task_holds_more_than_one_filter(spark, monkeypatch):
    rows = [(i, f"text {i % 4000}", "en", "a", 1) for i in range(5000)]
    held, most = set(), []
    context = type(spark.sparkContext)

    def broadcast(self, value, plain=context.broadcast):
        out = plain(self, value)
        held.add(id(out))
        most.append(len(held))
        free = out.destroy
        out.destroy = lambda *a: (held.discard(id(out)), free(*a))
        return out

    monkeypatch.setattr(context, "broadcast", broadcast)
    assert collected(exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(6), round_rows=1000)) == brute(rows)
    assert len(most) == 5 and set(most) == {1}


def test_tied_rows(spark):
    """Of rows that share text and largest id, the same one stays however the table is dealt."""
    rows = [(7, "same", "en", f"s{i}", i) for i in range(50)] + [(3, "Same", "en", "a", 1)]
    kept = {tuple(exact_dedup_rows(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(kept) == 1 and kept <= set(rows)


def test_long_texts(spark):
    long = "Ab " * 60_000
    rows = [(1, long, "en", "a", 1), (2, long.lower(), "en", "a", 1), (3, long + "x", "en", "a", 1)]
    assert collected(exact_dedup(frame(spark, rows))) == brute(rows)
    assert sorted(r.doc_id for r in exact_dedup_rows(frame(spark, rows)).collect()) == [2, 3]


def test_columns_that_cannot_be_hashed(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "A", 2), (2, "b", 3)], "doc_id long, text string, `odd.name` int").selectExpr("*", "map('k', doc_id) as m", "array(struct(map('k', 1) as x)) as a")
    got = exact_dedup_rows(rows)
    assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_hot_group(spark):
    rows = [(i, "Hot" if i % 3 else f"t{i}", "en", "a", 1) for i in range(6000)]
    assert collected(exact_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_kept_rows(spark):
    for df, rows in tables(spark):
        got = exact_dedup_rows(df, round_rows=5)
        assert got.columns == df.columns
        want = {(keep, sha) for i, keep, n, kept, sha in brute(rows)}
        kept = [(r.doc_id, normal_digest(r.text).hex()) for r in got.collect()]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_filter_knows_every_repeat(spark):
    digests = [normal_digest(f"text {i % 900}") for i in range(1000)]
    table = spark.createDataFrame([(bytearray(d),) for d in digests], "sha binary").repartition(5)
    bits, cells = bloom_filter(table, len(digests), least=2)
    flags = may_hold(np.frombuffer(b"".join(digests), np.uint8), bits, cells)
    assert flags[:100].all() and flags[900:].all() and not flags.all()
    bits, cells = bloom_filter(table, len(digests))
    others = np.frombuffer(b"".join(normal_digest(f"other {i}") for i in range(1000)), np.uint8)
    assert may_hold(np.frombuffer(b"".join(digests), np.uint8), bits, cells).all() and may_hold(others, bits, cells).mean() < 0.2


def test_null_ids_form_a_group(spark):
    rows = [(None, "x", "en", "a", 1), (None, "X", "en", "a", 1)]
    assert collected(exact_dedup(frame(spark, rows))) == brute(rows)
    assert exact_dedup_rows(frame(spark, rows)).count() == 1
    assert len(awkward()) > 10
