"""The pipeline against the brute-force versions of its stages, and the registered queries."""

import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import queries
from brindle.llm.common import documents, vocabulary
from brindle.llm.exact_dedup import normal_digest
from brindle.llm.quality_rules import quality_rules
from brindle.llm.tokens import unit_encoder
from tests.conftest import DATA
from tests.llm.cases import awkward, frame
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_jaccard import brute as brute_near
from tests.llm.test_mixing import brute_targets, size
from tests.llm.test_quality_rules import brute as brute_counts
from tests.oracle import assert_same, connect

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = documents(spark, SF)
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    columns = docs.columns
    quality, exact, near, mixing, packing = (f for _, f in corpus_pipeline.STAGES)

    kept = quality(spark, docs, SF)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    for i, r in rows.items():
        n, _, _, _, repeats = brute_counts(r[1])
        if n < 50 or 100 * repeats > 50 * n:
            assert i not in ids
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, good in labels.items() if good and brute_counts(rows[i][1])[0] >= 50 and 100 * brute_counts(rows[i][1])[4] <= 50 * brute_counts(rows[i][1])[0]]
    assert set(clean) <= ids

    left = [rows[i] for i in sorted(ids)]
    kept = exact(spark, kept, SF)
    want = {i for i, keep, *_ in brute_exact(left) if i == keep}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    left = [rows[i] for i in sorted(want)]
    kept = near(spark, kept, SF)
    want = {c for _, _, c in brute_near(left)}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want

    mixed = mixing(spark, kept, SF)
    assert mixed.columns == columns
    got, total, taken = mixed.collect(), Counter(), Counter()
    for i in want:
        total[rows[i][3]] += size(rows[i][1])
    for r in got:
        assert r.doc_id in want
        taken[r.source] += size(r.text)
    for s, t in brute_targets(dict(total)).items():
        assert abs(taken[s] - t) <= 2 * corpus_pipeline.MIX_BLOCK_WORDS

    encoder = unit_encoder(vocabulary())
    pieces = packing(spark, mixed, SF).collect()
    assert sum(r.length for r in pieces) == sum(len(encoder.one(r.text)) + 1 for r in got)


def test_run(spark):
    first = corpus_pipeline.run(spark, SF)
    assert first.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert first.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_oracles(spark):
    c: duckdb.DuckDBPyConnection = connect(SF)
    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, SF), sql, c)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def awkward_texts():
    """The awkward rows, with near and exact copies, nulls in every column and a long text, each of a size that the rules keep."""
    rows = awkward()
    prose = {r.doc_id: r.text for r in sorted(PROSE)}
    some = list(prose.values())
    rows += [(100 + i, x, "en", "s", len(x)) for i, x in enumerate(some[:12])]
    rows += [(200 + i, x.upper() if i % 2 else x, None, None, None) for i, x in enumerate(some[:6])]
    rows += [(300 + i, x + " and one more", "de", "t", 1) for i, x in enumerate(some[:12])]
    rows += [(None, some[12], "en", "s", 1), (None, some[12], "en", "s", 1), (400, " ".join(some[13:15]) * 30, "en", "s", 1)]
    return rows


PROSE = []


@pytest.mark.parametrize("extra", [False, True])
def test_stages_on_awkward_rows(spark, extra):
    if not PROSE:
        labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
        PROSE.extend(documents(spark, SF).join(labels, "doc_id").orderBy("doc_id").select("doc_id", "text").collect())
    docs = frame(spark, awkward_texts(), extra=extra)
    quality, exact, near, mixing, packing = (f for _, f in corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]

    kept = quality(spark, docs, SF)
    got = [tuple(r) for r in kept.collect()]
    verdicts = {(r.doc_id, r.n_words): r.kept for r in quality_rules(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert kept.columns == docs.columns and sorted(got, key=str) == sorted((r for r in rows if verdicts[r[0], brute_counts(r[1])[0]]), key=str) and len(got) > 20

    left = got
    kept = exact(spark, kept, SF)
    got = [tuple(r) for r in kept.collect()]
    want = {(keep, sha) for _, keep, _, _, sha in brute_exact(left)}
    assert kept.columns == docs.columns and set(got) <= set(left)
    assert sorted(((r[0], normal_digest(r[1]).hex()) for r in got), key=str) == sorted(want, key=str)

    left = got
    kept = near(spark, kept, SF)
    got = [tuple(r) for r in kept.collect()]
    groups = {}
    for i, _, c in brute_near(left):
        groups.setdefault(c, []).append(i)
    assert kept.columns == docs.columns and set(got) <= set(left) and sorted((r[0] for r in got), key=str) == sorted(groups, key=str)

    mixed = mixing(spark, kept, SF)
    assert mixed.columns == docs.columns
    texts = {r[0]: r[1].split() for r in got}
    for r in mixed.collect():
        own, at = texts[r.doc_id], 0
        for w in r.text.split():
            at = own.index(w, at) + 1
        assert r.n_chars == len(r.text)
    pieces = packing(spark, mixed, SF).collect()
    encoder = Tokenizer.from_file(vocabulary())
    assert sum(r.length for r in pieces) == sum(len(encoder.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_stages_on_an_empty_table(spark):
    for extra in (False, True):
        docs = frame(spark, [], extra=extra)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
