"""A quality classifier from overlapping heuristics, without labelled data.

Each labeller votes good (1), bad (-1) or not at all (0). The votes of all documents are counted by
pattern (there are few patterns, whatever the number of documents), and expectation-maximisation
estimates from the counts how often documents are good and how each labeller votes on good and on bad
ones, and so how accurate it is. The posterior of its pattern is a document's soft label; on a bounded sample, these labels train
a linear scorer over hashed character trigrams, which then scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import field, forget, map_arrow, session_of, stored
from brindle.llm.quality_rules import _distinct, _per_text, base_counts
from brindle.llm.spans import texts_of, word_hashes, word_spans

#: Different texts the scorer is trained on at most, and bytes of these; buckets of trigrams; score from which a document is kept.
TRAIN_ROWS, TRAIN_BYTES, BUCKETS, KEEP = 8000, 1 << 24, 1 << 16, 0.5
#: Trigrams of weight 0 that each text is taken to have besides its own: short texts stay near the bias.
CALM = 64
ROUNDS, STEPS = 60, 200
#: Observations that stand for what a labeller is meant to say.
PRIOR_VOTES = 10.0

#: Frequent function words of some languages.
STOP_WORDS = """the of and to in a is that it was for on are with as be at from or an this by
der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch
de la le et les des en un une du que dans est pour par au sur avec pas ne
el los las y en un una que del se por con para al lo como su es""".split()

_UPPER, _LETTER, _STOPS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xF5] = True  # first bytes of letters beyond ASCII
_STOPS[[ord(c) for c in ".!?:;\"'"]] = True


def _stop_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(sorted(set(STOP_WORDS))).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in sorted(set(STOP_WORDS))])
    return np.sort(word_hashes(raw, np.concatenate([[0], ends[:-1]]), ends, fold=True))


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


LABELLERS = ("length", "signs", "repeats", "variety", "runs", "lines", "capitals", "function_words", "word_length")


def votes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A column of votes for each of LABELLERS; most say nothing of short texts."""
    spans = starts, ends, owner = word_spans(data, at)
    n = len(at) - 1
    c = base_counts(data, at, spans)
    count = c["n_words"]
    words = np.maximum(1, count)
    letters = np.maximum(1, _per_text(_LETTER[data], at))
    capitals = _per_text(_UPPER[data], at) / letters
    lines = _per_text(data == 10, at) + 1
    known = _stop_hashes()
    hashes = word_hashes(data, starts, ends, fold=True)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    stops = np.bincount(owner[known[place] == hashes], minlength=n) / words
    again = np.bincount(owner[1:][(hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / words
    variety = _distinct(hashes, owner, n) / words
    repeats, signs = c["n_repeat_words"] / words, c["n_symbols"] / words
    mean = c["word_chars"] / words
    some, long = count >= 20, count >= 50
    return np.stack([
        _vote(words, long, count == 0),
        _vote(signs, some & (signs < 0.05), some & (signs > 0.15)),
        _vote(repeats, long & (repeats < 0.15), long & (repeats > 0.4)),
        _vote(variety, long & (variety > 0.3), long & (variety < 0.12)),
        _vote(again, some & (again < 0.1), some & (again > 0.3)),
        _vote(lines, (c["n_dup_lines"] == 0) & (lines > 2), (lines > 4) & (c["n_dup_lines"] > 0.5 * lines)),
        _vote(capitals, some & (capitals < 0.2), some & (capitals > 0.5)),
        _vote(stops, long & (stops > 0.1), long & (stops < 0.02)),
        _vote(mean, some & (mean > 3.5) & (mean < 8), some & ((mean < 2.5) | (mean > 12))),
    ], 1)


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, table[labeller, good?, vote + 1], and each pattern's posterior of being good.

    A labeller that doesn't vote says nothing: the table has the shares among its votes.
    Defects are rare and each is known to few labellers, so the start takes a document for bad if any
    labeller does. PRIOR_VOTES observations of each vote, shared out as labellers are meant to vote,
    are added: no vote is ever impossible, and none turns against its meaning on little evidence.
    """
    k = patterns.shape[1]
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    prior, table = 0.5, np.full((k, 2, 3), 1 / 3)
    meant = PRIOR_VOTES * np.array([[0.5, 0, 0.5], [0.02, 0, 0.98]])
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = float((mass[1].sum() + 1) / (mass.sum() + 2))
        for j in range(k):
            for y in (0, 1):
                table[j, y] = np.bincount(patterns[:, j] + 1, mass[y], 3) + meant[y]
                table[j, y] /= table[j, y, 0] + table[j, y, 2]
                table[j, y, 1] = 1
        logs = [np.log(1 - prior if y == 0 else prior) + sum(np.log(table[j, y, patterns[:, j] + 1]) for j in range(k)) for y in (0, 1)]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return prior, table, good


def accuracies(prior: float, table: np.ndarray) -> np.ndarray:
    """How often each labeller is right when it votes."""
    right = prior * table[:, 1, 2] + (1 - prior) * table[:, 0, 0]
    wrong = prior * table[:, 1, 0] + (1 - prior) * table[:, 0, 2]
    return right / (right + wrong)


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of three bytes within a text, and its text."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    key = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = owner[:-2] == owner[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(16))[inside].astype(np.int64), owner[:-2][inside]


def trigram_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and how often: the counts of each text's trigrams by bucket."""
    buckets, owner = trigrams(data, at)
    keys, times = np.unique(owner * BUCKETS + buckets, return_counts=True)
    return (keys // BUCKETS).astype(np.int32), (keys % BUCKETS).astype(np.int32), times.astype(np.int32)


def train_scorer(whose: np.ndarray, which: np.ndarray, times: np.ndarray, soft: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """BUCKETS weights and a bias of a logistic model of the mean weight of a text's trigrams (Adam, both classes weigh the same).

    The first three are trigram counts by text and bucket, soft the labels of the texts.
    """
    n = len(soft)
    w = np.zeros(BUCKETS + 1)
    if not n:
        return w
    # In the order of the texts, so that sums over a text are sums over a stretch.
    order = np.argsort(whose, kind="stable") if (np.diff(whose) < 0).any() else slice(None)
    whose, which = whose[order].astype(np.intp), which[order].astype(np.intp)
    value = times[order] / (CALM + np.bincount(whose, times[order], n))[whose]
    texts, starts = np.unique(whose, return_index=True)
    z = np.zeros(n)
    balance = soft / max(soft.sum(), 1e-9) + (1 - soft) / max((1 - soft).sum(), 1e-9)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        if len(starts):
            z[texts] = np.add.reduceat(value * w[which], starts)
        error = balance * (1 / (1 + np.exp(-np.clip(z + w[-1], -60, 60))) - soft)
        g = np.append(np.bincount(which, value * error[whose], BUCKETS), error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def training_sample(df: DataFrame, total: int, train_rows: int) -> DataFrame:
    """At most train_rows different texts of a table (text) of ``total`` rows, in the order of their hashes.

    About twice as many rows are looked at as are wanted, chosen by a hash of the text and first of
    all reduced to one of each hash, so neither copies nor null or repeated ids add to the sample.
    """
    mark = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    some = df.withColumn("mark", mark)
    if total > 2 * train_rows:
        some = some.where(F.col("mark") < F.lit((1 << 63) * 2 * train_rows // total))
    return some.groupBy("mark").agg(F.first("text").alias("text")).orderBy("mark").limit(train_rows).select("text")


def weak_label_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, keep: float = KEEP) -> DataFrame:
    """One row for each row of df: id, posterior (of its votes), score (of the scorer) and kept (score >= keep).

    A null text counts as empty: its votes are those of no words, its score that of the bias alone.
    The scorer is trained on train_rows different texts at most (``training_sample``), in their order as
    long as they come to train_bytes at most; the pattern counts are of all rows, and all rows are
    scored, whole texts however long. Repeated rows count as often as they occur, and are scored alike;
    ids, null or not, are carried along. An empty table gives an empty result. Other columns are not read.
    """
    spark, k = session_of(df), len(LABELLERS)
    ballot = T.StructType([field(df, id_col), T.StructField("pattern", T.IntegerType())])
    powers = 3 ** np.arange(k)

    def cast(batches):
        for b in batches:
            v = votes(*texts_of(b.column(text_col))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(((v + 1) @ powers).astype(np.int32))], names=ballot.names)

    counted = stored(map_arrow(df.select(id_col, text_col), cast, ballot).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "patterns").collect()
    codes = np.array(sorted(r.pattern for r in counted), np.int64)
    counts = np.array([r.n for r in sorted(counted)], float)
    patterns = (codes[:, None] // powers % 3 - 1).astype(np.int64).reshape(-1, k)
    _, _, good = fit_labellers(patterns, counts)
    known = spark.sparkContext.broadcast((codes, good))
    total = int(counts.sum())
    # Written first: what trains is one task, but reads only this.
    sample = stored(training_sample(df.select(F.coalesce(text_col, F.lit("")).alias("text")), total, train_rows), "sample")

    def posterior(data, at):
        codes, good = known.value
        own = (votes(data, at).astype(np.int64) + 1) @ powers
        return good[np.minimum(np.searchsorted(codes, own), len(codes) - 1)] if len(codes) else np.zeros(len(own))

    def train(batches):
        parts, n, left = [], 0, train_bytes
        for b in batches:
            if left < 0:
                continue
            data, at = texts_of(b.column("text"))
            fits = int(np.searchsorted(at, left, "right")) - 1
            data, at, left = data[: at[fits]], at[: fits + 1], left - int(at[-1])
            whose, which, times = trigram_counts(data, at)
            parts.append((whose + n, which, times, posterior(data, at)))
            n += fits
        joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
        yield pa.RecordBatch.from_pydict({"weights": [train_scorer(*joined).tobytes()]})

    rows = map_arrow(sample.coalesce(1).sortWithinPartitions(F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))), train, "weights binary").collect()
    forget(sample)
    weights = spark.sparkContext.broadcast(np.frombuffer(bytes(rows[0].weights)) if rows else np.zeros(BUCKETS + 1))
    schema = T.StructType([field(df, id_col), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def score(batches):
        w = weights.value
        for b in batches:
            data, at = texts_of(b.column(text_col))
            buckets, owner = trigrams(data, at)
            n = np.bincount(owner, minlength=b.num_rows)
            z = np.bincount(owner, w[buckets], b.num_rows) / (CALM + n) + w[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(posterior(data, at)), pa.array(s), pa.array(s >= keep)], names=schema.names)

    return map_arrow(df.select(id_col, text_col), score, schema)
