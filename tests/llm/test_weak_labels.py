"""Weak labels: known accuracies are recovered, and scores agree with held labels nobody trained on."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import weak_labels
from brindle.llm.common import documents
from brindle.llm.spans import texts_of
from brindle.llm.weak_labels import BUCKETS, CALM, LABELLERS, accuracies, fit_labellers, train_scorer, training_sample, trigram_counts, trigrams, votes, weak_label_scores
from tests.conftest import DATA
from tests.llm.cases import SCHEMA, frame, tables, words


def test_expectation_maximisation_recovers_the_labellers():
    rng = np.random.default_rng(3)
    n, right, voting = 40_000, np.array([0.97, 0.95, 0.93, 0.96, 0.9]), np.array([0.9, 0.6, 0.8, 0.5, 0.7])
    good = rng.random(n) < 0.85
    table = np.where(rng.random((n, 5)) < voting, np.where((rng.random((n, 5)) < right) == good[:, None], 1, -1), 0)
    patterns, counts = np.unique(table, axis=0, return_counts=True)
    prior, fitted, posterior = fit_labellers(patterns, counts.astype(float))
    assert abs(prior - 0.85) < 0.03
    assert np.abs(accuracies(prior, fitted) - right).max() < 0.04
    where = {tuple(p): q for p, q in zip(patterns, posterior, strict=True)}
    assert np.mean([(where[tuple(v)] > 0.5) == g for v, g in zip(table, good, strict=True)]) > 0.95


def test_votes_and_trigrams_of_odd_texts():
    data, at = texts_of(pa.array(["", None, "a", "ab", "abc", "abc abc"]))
    assert votes(data, at).shape == (6, len(LABELLERS))
    buckets, owner = trigrams(data, at)
    assert np.bincount(owner, minlength=6).tolist() == [0, 0, 0, 0, 1, 5] and buckets[0] == buckets[1]
    assert votes(*texts_of(pa.array([], pa.string()))).shape == (0, len(LABELLERS))


def test_against_labels(spark):
    sf = f"{DATA}/sf0.1"
    got = weak_label_scores(documents(spark, sf)).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in got]) > 0.97
    assert np.mean([r.kept for r in got if r.quality]) > 0.995


def test_awkward_rows(spark):
    for df, rows in tables(spark):
        got = weak_label_scores(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.kept == (r.score >= 0.5) for r in got)


def brute_em(patterns, counts, rounds):
    """The same model in plain Python, pattern by pattern and labeller by labeller."""
    good = [0.1 if any(v < 0 for v in p) else 0.9 for p in patterns]
    for _ in range(rounds):
        mass = [sum(c * (g if y else 1 - g) for c, g in zip(counts, good, strict=True)) for y in (0, 1)]
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        right = []
        for j in range(len(patterns[0])):
            seen = [[weak_labels.PRIOR_VOTES * (0.5 if y == 0 else 0.98 if v > 0 else 0.02) for v in (-1, 1)] for y in (0, 1)]
            for p, c, g in zip(patterns, counts, good, strict=True):
                if p[j]:
                    for y in (0, 1):
                        seen[y][p[j] > 0] += c * (g if y else 1 - g)
            right.append([[n / sum(row) for n in row] for row in seen])
        good = []
        for p in patterns:
            like = [(1 - prior, prior)[y] * math.prod(right[j][y][v > 0] for j, v in enumerate(p) if v) for y in (0, 1)]
            good.append(like[1] / (like[0] + like[1]))
    return prior, good


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(8)
    patterns = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for rounds in (1, 2, 25):
        counts = rng.integers(0, 200, len(patterns)).astype(float)
        prior, _, good = fit_labellers(np.array(patterns), counts, rounds)
        want_prior, want = brute_em(patterns, counts.tolist(), rounds)
        assert prior == pytest.approx(want_prior, abs=1e-9) and good == pytest.approx(want, abs=1e-9)


def test_scorer_by_a_dense_loop():
    texts = ["abcabcabd", "xyz xyz", "", "hello there, abc", "zzzzzzzz"]
    soft = np.array([0.9, 0.2, 0.5, 0.8, 0.1])
    got = train_scorer(*trigram_counts(*texts_of(pa.array(texts))), soft, steps=15)
    bucket = lambda t: ((t[0] << 16 | t[1] << 8 | t[2]) * 2654435761 % 2**32) >> 16
    rows = [Counter(bucket(raw[i : i + 3]) for i in range(len(raw) - 2)) for raw in map(str.encode, texts)]
    used = sorted({b for r in rows for b in r})
    x = np.array([[r[b] / (CALM + sum(r.values())) for b in used] + [1.0] for r in rows])
    w, m, v = np.zeros((3, len(used) + 1))
    weigh = soft / soft.sum() + (1 - soft) / (1 - soft).sum()
    for t in range(1, 16):
        g = x.T @ (weigh * (1 / (1 + np.exp(-x @ w)) - soft))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w -= 0.3 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert got[[*used, BUCKETS]] == pytest.approx(w, abs=1e-8) and not got[np.setdiff1d(np.arange(BUCKETS), used)].any()


def test_the_sample_is_bounded(spark):
    texts = spark.createDataFrame([(words(i % 500, 20),) for i in range(3000)] + [("same",)] * 3000 + [("",)] * 3000, "text string").repartition(5)
    whole = training_sample(texts, 9000, 8000).collect()
    assert len(whole) == len({r.text for r in whole}) == 502
    some = [r.text for r in training_sample(texts, 9000, 100).collect()]
    assert 2 <= len(some) == len(set(some)) <= 100 and some == [r.text for r in training_sample(texts.repartition(3), 9000, 100).collect()]
    # Null and repeated ids change nothing.
    rows = [(None if i % 2 else 7, words(i, 60), "en", "a", 1) for i in range(400)]
    got = weak_label_scores(frame(spark, rows), train_rows=50)
    again = weak_label_scores(frame(spark, [(i, *r[1:]) for i, r in enumerate(rows)]), train_rows=50)
    assert sorted(r.score for r in got.collect()) == sorted(r.score for r in again.collect())
    # Bytes are bounded too, and no text can't be had.
    assert weak_label_scores(frame(spark, rows), train_bytes=0).where("score = 0.5").count() == 400


def test_long_texts(spark):
    rows = [(1, words(1, 40_000), "en", "a", 1), (2, "x" * 300_000, "en", "a", 1), (3, "y\n" * 100_000, "en", "a", 1)]
    got = {r.doc_id: r.posterior for r in weak_label_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3} and got[3] < 0.5
