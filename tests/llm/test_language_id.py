"""Language identification: held-out accuracy, what is learned from, awkward texts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from brindle.llm.common import documents
from brindle.llm.language_id import PROFILE, grams_of, identify_language, learn_profiles, predict_language, ranked
from tests.conftest import DATA
from tests.llm.cases import awkward, collected, frame, tables, words


def test_held_out_accuracy(spark):
    df = documents(spark, f"{DATA}/sf0.01")
    rows = identify_language(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_held_out_rows_teach_nothing(spark):
    df = documents(spark, f"{DATA}/sf0.001")
    lied = df.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in learn_profiles(lied)
    assert collected(identify_language(lied)) == collected(identify_language(df))
    shuffled = df.withColumn("source", F.lit("other"))
    assert collected(identify_language(shuffled)) == collected(identify_language(df))


def test_profiles_by_hand(spark):
    rows = [(i, "ab ab", "x", "s", 1) for i in range(40)]
    (profile,) = learn_profiles(frame(spark, rows)).values()
    grams, counts = grams_of("ab ab")
    assert profile == ranked(grams, counts, PROFILE).tolist()
    # a, b, _a, ab, b_, _ab, ab_: twice each
    assert len(grams) == 7 and set(counts.tolist()) == {2}


def test_bounded_sample(spark):
    df = documents(spark, f"{DATA}/sf0.01")
    assert set(learn_profiles(df, train_rows=200)) == set(learn_profiles(df))


def test_awkward_rows(spark):
    for df, rows in tables(spark):
        got = identify_language(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        langs = {r[2] for r in rows if r[2]}
        for r in got:
            assert 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}
            assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
            text = next(x for i, x, *_ in rows if i == r.doc_id)
            if not any(c.isalpha() for c in text or ""):
                assert r.lang_pred == "und" and r.score == 0
    assert all(r.lang_pred == "und" for r in predict_language(frame(spark, awkward()), {}).collect())


def test_ties_go_to_the_first_language(spark):
    profiles = {"b": [1, 2, 3], "a": [1, 2, 3]}
    assert {r.lang_pred for r in predict_language(frame(spark, [(1, "hello", "x", "s", 1)]), profiles).collect()} == {"a"}


def test_rare_languages_are_learned_whatever_the_size(spark):
    rows = [(i, f"common words of text {i}", "en", "s", 1) for i in range(4000)]
    rare = [(9000 + i, "zyx wvu zyx " + "q" * (i % 3 + 1), "zz", "s", 1) for i in range(12)]
    alone = learn_profiles(frame(spark, rare))["zz"]
    got = learn_profiles(frame(spark, rows + rare), train_rows=40)
    assert set(got) == {"en", "zz"} and got["zz"] == alone
    assert {r.lang_pred for r in predict_language(frame(spark, rare), got).collect()} == {"zz"}


def plain_grams(text):
    """The same n-grams by plain Python: (value for ties, count)."""
    framed, n = " ", Counter()
    for c in text.lower():
        if c.isalpha():
            framed += c
        elif framed[-1] != " ":
            framed += " "
    framed += "" if framed[-1] == " " else " "
    if framed.strip() == "":
        return n
    value = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g)))
    for k in (1, 2, 3):
        for i in range(len(framed) - k + 1):
            g = framed[i : i + k]
            if g != " " and (k < 3 or g[1] != " "):
                n[value(g)] += 1
    return n


def plain_ranks(n, top):
    return {g: i for i, (g, _) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top])}


def test_against_plain_out_of_place_distances(spark):
    docs = documents(spark, f"{DATA}/sf0.001")
    rows = [tuple(r)[:3] for r in docs.collect()] + [(9000 + i, x, lang) for i, (_, x, lang, *_) in enumerate(awkward())]
    rows += [(9900, words(3, 30_000), "en"), (9901, "日本語 テキスト", "ja"), (9902, "ÀÉ 12 ß", None)]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if not held[i] and text is not None and lang is not None:
            counts[lang] += plain_grams(text)
    profiles = {lang: plain_ranks(n, 300) for lang, n in counts.items() if n}
    want = []
    for i, text, _ in rows:
        own = plain_ranks(plain_grams(text or ""), 300)
        far = {x: sum(min(300, abs(p[g] - k)) if g in p else 300 for g, k in own.items()) for x, p in sorted(profiles.items())}
        best = min(far, key=far.get) if own else "und"
        want.append((i, held[i], best, round(1 - far[best] / (300 * len(own)), 9) if own else 0.0))
    got = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == sorted(want)
