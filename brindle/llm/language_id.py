"""Language identification by rank-order profiles of character n-grams.

A profile lists the PROFILE most frequent n-grams (one to three letters, words framed by blanks) of a
language. A document's own list is compared with each profile by out-of-place distance: the sum over
its n-grams of how far apart the two ranks are, PROFILE for an n-gram the profile lacks. The nearest
language wins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import field, map_arrow, session_of

#: n-grams in a profile; n-grams of a document that are compared; labelled rows of a language that its profile is learned from, about.
PROFILE, TOP, TRAIN_ROWS = 300, 300, 20_000
_BITS = 21  # of a code point
_FRAME = np.uint64(1)  # stands for the border of a word; no letter has this code point


def _letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of other characters than letters as one _FRAME, with one at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    seen, where = np.unique(points, return_inverse=True)
    points = np.where(np.array([chr(int(p)).isalpha() for p in seen], bool)[where], points, _FRAME) if len(points) else points
    points = np.concatenate([[_FRAME], points, [_FRAME]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != _FRAME) | (points[:-1] != _FRAME)
    return points[keep]


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the text (61 bits: up to three code points) and how often each occurs; none if it has no letter."""
    p = _letters(text)
    if len(p) < 2:  # only a frame: no letter
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.uint64(_BITS)
    two = p[:-1] << s | p[1:]
    three = two[:-1] << s | p[2:]
    # A gram of the frame alone, or with a frame inside, says nothing.
    grams = np.concatenate([p[p != _FRAME], two, three[p[1:-1] != _FRAME]])
    return np.unique(grams, return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The top most frequent grams, ties by gram."""
    return grams[np.lexsort((grams, -counts))[:top]]


def held_out_of(doc_id) -> bool:
    """crc32 of the id as text is divisible by 5 (a null id counts as the empty text, which is held out)."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def learn_profiles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """The profile of each language, from rows with a language that are not held out.

    Of each language about train_rows of those rows are read, chosen by a hash of id and text, whatever
    the size of df and the share of the language in it; all if there are fewer. Rows equal in id and text are chosen,
    and count, together; their counts are summed before they are shuffled. The profiles (PROFILE
    n-grams for each language) come to the driver.
    """
    usable = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 0))
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("hash"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > train_rows)
    share = F.coalesce(F.lit(float(train_rows)) / F.col("rows"), F.lit(1.0))
    chosen = rows.join(F.broadcast(sizes), "lang", "left").where(F.col("hash").bitwiseAND(F.lit((1 << 63) - 1)) <= share * float(1 << 63))

    def count(batches):
        held: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams_of(text))
            for lang, parts in held.items():
                grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                held[lang] = [(grams, np.bincount(back, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64))]
        for lang, [(grams, counts)] in held.items():
            for i in range(0, len(grams), 10_000):
                n = len(grams[i : i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(grams[i : i + n].astype(np.int64)), pa.array(counts[i : i + n])], names=["lang", "gram", "n"])

    grams = map_arrow(chosen.select("lang", "text"), count, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    top = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def predict_language(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, held_out, lang_pred, score.

    lang_pred is `und`, with a score of 0, where the text is null or has no letter or there are no
    profiles; ties go to the language that comes first by code point. score is one minus the mean
    distance as a share of the largest possible. The whole text is read, however long; a null
    id is held out and carried along; repeated rows each have a row; an empty table gives no rows; other
    columns than id and text are not read.
    """
    schema = T.StructType([field(df, id_col), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = sorted(profiles)
    known = np.unique(np.array([g for x in langs for g in profiles[x]], np.uint64))
    ranks = np.full((len(known) + 1, max(1, len(langs))), -1, np.int64)  # the last row: grams of no profile
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(known, np.array(profiles[lang], np.uint64)), k] = np.arange(len(profiles[lang]))
    spread = session_of(df).sparkContext.broadcast((langs, known, ranks))

    def predict(text, langs, known, ranks):
        grams = ranked(*grams_of(text or ""), TOP)
        if not len(grams) or not langs:
            return "und", 0.0
        at = np.searchsorted(known, grams)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == grams), at, len(known))
        theirs = ranks[at]
        distance = np.where(theirs < 0, PROFILE, np.minimum(PROFILE, np.abs(theirs - np.arange(len(grams))[:, None]))).sum(0)
        best = int(np.argmin(distance))
        return langs[best], float(1 - distance[best] / (PROFILE * len(grams)))

    def run(batches):
        for b in batches:
            got = [predict(x, *spread.value) for x in b.column(text_col).to_pylist()]
            held = [held_out_of(x) for x in b.column(id_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(held, pa.bool_()), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=schema.names)

    return map_arrow(df.select(id_col, text_col), run, schema)


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``predict_language`` with profiles learned from df itself; held-out rows teach nothing."""
    return predict_language(df, learn_profiles(df, id_col, text_col, lang_col, train_rows), id_col, text_col)
