"""The similarity join against brute force, with and without chunks and large blocks."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from brindle.llm import jaccard
from brindle.llm.components import components
from brindle.llm.jaccard import near_duplicate_rows, near_duplicates
from brindle.llm.signature_tree import Groups, bitmap, folded, similar_groups, width_of
from tests.llm.cases import SCHEMA, collected, frame, tables, words
from tests.llm.test_spans_tokens import thue_morse


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    groups = Groups(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                groups.join(i, j)
    members = defaultdict(list)
    for i, g in enumerate(groups.flat()):
        members[g].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in members.items()}
    return sorted(((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, groups.flat(), strict=True)), key=str)


def family(seed, n, size, edits, first):
    """n texts made from one by replacing some words."""
    r = random.Random(seed)
    base = words(seed, size).split()
    out = []
    for i in range(n):
        own = base[:]
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(size)] = f"e{r.random()}"
        out.append((first + i, " ".join(own), "en", "a", 1))
    return out


def corpus():
    rows = []
    for k, (n, size, edits) in enumerate([(60, 80, 6), (25, 300, 14), (12, 12, 2), (30, 40, 2), (5, 900, 30)]):
        rows += family(k, n, size, edits, 1000 * k)
    passage = words(99, 60)
    rows += [(9000 + i, words(500 + i, 30 + i) + " " + passage, "en", "a", 1) for i in range(60)]
    return rows


def test_awkward_rows(spark):
    for df, rows in tables(spark):
        assert collected(near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("chunk, block", [(1 << 20, 1 << 22), (700, 1 << 22), (100, 1 << 22), (1 << 20, 3000), (300, 900)])
def test_families(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    rows = corpus()
    assert collected(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_tokens=chunk)) == brute(rows)


def mosaics():
    """Texts that are a common passage for the most part, with a few near copies among them."""
    passage = words(99, 200)
    rows = [(9000 + i, words(500 + i, 20 + i % 90) + " " + passage, "en", "a", 1) for i in range(300)]
    return rows + [(9500 + i, rows[i][1] + " and more", "en", "a", 1) for i in range(0, 300, 7)]


@pytest.mark.parametrize("sample, block, chunk", [(1, 1 << 22, 1 << 20), (2, 20_000, 1 << 20), (1, 6000, 3000), (10**9, 9000, 20_000)])
def test_common_shingles_last(spark, monkeypatch, sample, block, chunk):
    for name, value in (("SAMPLE", sample), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus() + mosaics()
    assert collected(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), chunk_tokens=chunk)) == brute(rows)


def test_keys():
    assert [jaccard.key_count(n, 0) for n in (1, 4, 5, 100, 20_000)] == [1, 2, 2, 24, 24]
    assert jaccard.key_count(400, 100) == 31 and jaccard.key_count(400, 300) == jaccard.key_count(400, 400) == 101
    tokens, hot = np.arange(100, dtype=np.uint64), np.arange(0, 100, 2, dtype=np.uint64)
    assert jaccard.keys_of(tokens, hot).tolist() == list(range(1, 53, 2))
    assert jaccard.keys_of(tokens, tokens).tolist() == list(range(26))
    assert jaccard.keys_of(tokens, hot[:0]).tolist() == list(range(24))


def test_bound_on_common_shingles(spark, monkeypatch):
    docs = spark.createDataFrame([(i, words(7, 30) + f" x{i}" + (" " + words(8, 30) if i % 2 else "")) for i in range(40)], "id long, text string").selectExpr("*", "xxhash64(text) salt")
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    every = jaccard.common_shingles(docs)
    assert len(every) == 26 * 2 and (np.diff(every.astype(object)) > 0).all()
    monkeypatch.setattr(jaccard, "HOT_MOST", 30)
    assert set(jaccard.common_shingles(docs).tolist()) < set(every.tolist()) and len(jaccard.common_shingles(docs)) == 26
    monkeypatch.setattr(jaccard, "HOT_MOST", 10)
    assert len(jaccard.common_shingles(docs)) == 0 and len(jaccard.common_shingles(docs.where("false"))) == 0


def test_kept_rows(spark):
    for df, rows in tables(spark):
        got = near_duplicate_rows(df)
        assert got.columns == df.columns
        ids = sorted({c for i, n, c in brute(rows) if i is not None}, key=str)
        kept = {r.doc_id for r in got.collect()}
        assert {i for i in ids if i is not None} <= kept and len(kept - set(ids) - {None}) == 0


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0


def test_tree_joins_what_brute_force_joins():
    rng = np.random.default_rng(5)
    for _ in range(10):
        sets = []
        for _ in range(12):
            base = np.unique(rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64))
            for _ in range(rng.integers(1, 9)):
                own = base[rng.random(len(base)) > rng.choice([0.02, 0.12, 0.14, 0.2])]
                if len(own):
                    sets.append(own)
        sizes, near = np.array(list(map(len, sets))), np.array([int(s[0]) for s in sets], np.uint64)
        similar = lambda i, j: 4 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 3 * (len(sets[i]) + len(sets[j]) - k)  # noqa: E731, B023
        verify = lambda i, others: np.array([similar(i, j) for j in others], bool)  # noqa: E731, B023
        bitmaps = [bitmap(s, width_of(len(s))) for s in sets]
        want = Groups(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if similar(i, j):
                    want.join(i, j)
        assert (similar_groups(bitmaps, sizes, near, Groups(len(sets)), verify).flat() == want.flat()).all()
        loose = similar_groups(bitmaps, sizes, near, Groups(len(sets))).flat()
        assert all(loose[i] == loose[j] for i in range(len(sets)) for j in range(i) if want.flat()[i] == want.flat()[j])


def test_bitmaps_fold():
    tokens = np.array([3, 70, 131, 2**40 + 5], np.uint64)
    assert (folded(bitmap(tokens, 256), 64) == bitmap(tokens, 64)).all()
    assert width_of(1) == 64 and width_of(17) == 128 and width_of(500) == 2048


def test_hot_copies(spark):
    rows = [(i, words(1, 50) if i % 3 else words(i, 50), "en", "a", 1) for i in range(3000)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).groupBy("component_id").count().where("count > 1").collect()
    assert [tuple(r) for r in got] == [(1, 2000)]
    assert frame(spark).count() == 16


def test_regular_words_are_told_apart(spark):
    long, other = thue_morse(10)
    rows = [(1, f"{long} a b c d", "en", "a", 1), (2, f"{other} a b c d", "en", "a", 1), (3, f"{long} {other}", "en", "a", 1), (4, f"{other} {long}", "en", "a", 1), (5, f"{long} A B c d", "en", "a", 1)]
    got = collected(near_duplicates(frame(spark, rows)))
    assert got == brute(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]


def test_long_texts(spark):
    long = words(3, 60_000, 10**6)
    rows = [(1, long, "en", "a", 1), (2, long[: len(long) * 4 // 5], "en", "a", 1), (3, long[: len(long) // 2], "en", "a", 1), (4, "x " * 50_000, "en", "a", 1)]
    assert collected(near_duplicates(frame(spark, rows))) == brute(rows)


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNT_TOKENS", 500, raising=False)
    monkeypatch.setattr(jaccard, "COUNT_BYTES", 4000, raising=False)
    rows = [(words(7, 30) if i < 80 else words(8, 30) if i < 159 else words(9, 30)) + f" x{i}" for i in range(170)]
    rows += [rows[80]] * 50 + [rows[165]] * 200 + [None, "", " "] * 100  # repeated texts count once
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string").selectExpr("*", "xxhash64(text) salt").repartition(5)
    data = np.frombuffer(words(7, 30).encode(), np.uint8)
    want = jaccard.shingle_sets(data, np.array([0, len(data)]))[0]
    assert jaccard.common_shingles(docs).tolist() == want.tolist()
    monkeypatch.setattr(jaccard, "HOT_LEAST", 79 / 16)
    assert len(jaccard.common_shingles(docs)) == 2 * len(want)
