"""Quality rules: counts of words, signs and repeats, and the fertility of a public vocabulary.

A text's fertility is measured over its words with a sentencepiece vocabulary that falls back to
bytes: characters per token, the share of tokens that are single bytes, the entropy of the tokens as
a share of what as many tokens could have, and the share of tokens without a letter or digit. Each
language (or, for languages without bands of their own, each script) has bands that a text must lie in;
texts far outside are written in no known way, stuffed with signs, or say the same over and over. Of
scripts of which that vocabulary knows single letters at most, a second one, a byte-level BPE for many languages, measures
characters per token, and the share of tokens that are parts of characters, as well.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.common import field, map_arrow
from brindle.llm.spans import SPACE, mix, texts_of, window_hashes, word_hashes, word_spans
from brindle.llm.tokens import piece_encoder

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: For a language, or else a script: least and most characters per token, most byte-fallback share,
#: least entropy as a share of log2(tokens), most share of tokens that are signs.
BANDS = {
    "en": (1.45, 7.0, 0.05, 0.45, 0.16),
    "de": (1.45, 7.0, 0.05, 0.45, 0.16),
    "fr": (1.35, 7.0, 0.05, 0.45, 0.16),
    "es": (1.35, 7.0, 0.05, 0.45, 0.16),
    "latin": (1.2, 8.0, 0.10, 0.40, 0.16),
    "cyrillic": (1.1, 8.0, 0.10, 0.40, 0.16),
    "greek": (0.2, 8.0, 0.30, 0.30, 0.30),
    "armenian": (0.2, 8.0, 0.50, 0.30, 0.30),
    "hebrew": (0.2, 8.0, 0.30, 0.30, 0.30),
    "arabic": (0.2, 8.0, 0.30, 0.30, 0.30),
    "han": (0.2, 8.0, 0.80, 0.30, 0.30),
    "hangul": (0.2, 8.0, 0.70, 0.30, 0.30),
    "devanagari": (0.2, 8.0, 0.50, 0.30, 0.30),
    "bengali": (0.2, 8.0, 0.50, 0.30, 0.30),
    "tamil": (0.2, 8.0, 0.50, 0.30, 0.30),
    "thai": (0.2, 8.0, 0.50, 0.30, 0.30),
    "mixed": (0.2, 8.0, 0.60, 0.30, 0.30),
    # Scripts of which the vocabulary may know no letter: all bytes says nothing of them.
    "other": (0.2, 8.0, 1.00, 0.30, 0.30),
}
#: For a script, by the second vocabulary: least characters per token, most share of tokens that are parts of characters.
SECOND_BANDS = {
    "han": (0.6, 0.65), "hangul": (0.6, 0.75), "arabic": (0.95, 0.2), "greek": (0.85, 0.45), "armenian": (0.55, 0.88),
    "devanagari": (0.55, 0.85), "tamil": (0.7, 0.55), "thai": (0.7, 0.45),
}
#: Scripts besides latin and cyrillic by their letters' first bytes, and, after 0xE0, by the second (kana go with han).
_FIRST = {"greek": (0xCE, 0xD0), "armenian": (0xD4, 0xD7), "hebrew": (0xD7, 0xD8), "arabic": (0xD8, 0xDC), "han": (0xE3, 0xEA), "hangul": (0xEB, 0xEE)}
_SECOND = {"devanagari": (0xA4, 0xA6), "bengali": (0xA6, 0xA8), "tamil": (0xAE, 0xB0), "thai": (0xB8, 0xBA)}
_OTHERS = ("other", *_FIRST, *_SECOND)


def _other_script(data: np.ndarray, kind: np.ndarray) -> str:
    """The script that half of the letters that are neither latin nor cyrillic have at least; mixed if none has."""
    at = np.flatnonzero(kind == 3)
    first, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    table, after = np.zeros((2, 256), np.int64)
    for k, name in enumerate(_OTHERS):
        table[slice(*_FIRST.get(name, (0, 0)))] = k
        after[slice(*_SECOND.get(name, (0, 0)))] = k
    n = np.bincount(np.where(first == 0xE0, after[second], table[first]), minlength=len(_OTHERS))
    return _OTHERS[n.argmax()] if 2 * n.max() >= len(at) else "mixed"


def script_of(data: np.ndarray, at: np.ndarray) -> list[str]:
    """The script of each text: latin, cyrillic or another, by which has most of the first bytes of letters."""
    kinds = np.zeros(256, np.int64)
    kinds[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 1
    kinds[[*range(0xD0, 0xD4)]] = 2
    kinds[[*range(0xCA, 0xD0), *range(0xD4, 0xF5)]] = 3
    kind = kinds[data]
    n = np.stack([_per_text(kind == k, at) for k in (1, 2, 3)])
    return [("latin", "cyrillic")[k] if k < 2 else _other_script(data[s:e], kind[s:e]) for k, s, e in zip(n.argmax(0), at[:-1], at[1:], strict=True)]


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each text's bytes have the mark."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), at))


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each owner has."""
    both = np.unique(np.stack([owner.astype(np.uint64), keys], 1), axis=0) if len(keys) < 64 else None
    if both is None:
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        first = np.ones(len(k), bool)
        first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[first], minlength=n)
    return np.bincount(both[:, 0].astype(np.int64), minlength=n)


def base_counts(data: np.ndarray, at: np.ndarray, spans=None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(at) - 1
    starts, ends, owner = spans if spans is not None else word_spans(data, at)
    solid = ~SPACE[data]
    out = {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": _per_text(solid & ((data & 0xC0) != 0x80), at),
        "n_symbols": _per_text(SYMBOLS[data], at),
    }
    # Lines: from a text's start or after a line end, up to the next; those with a word count.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([at[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    line_of = np.searchsorted(begin, starts, "right") - 1
    worded = np.unique(line_of)
    begin = begin[worded]
    stop = np.concatenate([breaks, at[1:]])
    stop.sort()
    end = stop[np.searchsorted(stop, begin, "right")] if len(begin) else begin
    line_owner = np.searchsorted(at, begin, "right") - 1
    hashes = word_hashes(data, begin, end)
    out["n_dup_lines"] = np.bincount(line_owner, minlength=n) - _distinct(hashes, line_owner, n)
    # Windows of words within one text; a word counts if any window over it is found twice or more.
    words = word_hashes(data, starts, ends)
    covered = np.zeros(len(words), bool)
    windows = window_hashes(words, WINDOW)
    if len(windows):
        inside = np.flatnonzero(owner[: len(windows)] == owner[WINDOW - 1 :])
        keys = mix(windows[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = inside[twice[place] == keys]
            for j in range(WINDOW):
                covered[hit + j] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)
    return out


def fertility(data: np.ndarray, at: np.ndarray, spans, vocabulary: str, word_chars: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, chars_per_token, byte_share, entropy_share and sign_share of each text; zeros for a text without words."""
    n = len(at) - 1
    encoder = piece_encoder(vocabulary)
    starts, ends, owner = spans
    ids, over = encoder.ids(data, starts, ends)
    holder = np.repeat(owner, np.diff(over))
    tokens = np.bincount(holder, minlength=n)
    single = np.bincount(holder[encoder.is_byte[ids]], minlength=n)
    sign = np.bincount(holder[encoder.is_sign[ids]], minlength=n)
    keys = np.sort(holder.astype(np.uint64) << np.uint64(32) | ids)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))
    whose = (keys[first] >> np.uint64(32)).astype(np.int64)
    weighed = np.bincount(whose, times * np.log2(times), n)
    safe = np.maximum(tokens, 1)
    entropy = np.log2(safe) - weighed / safe
    most = np.log2(np.maximum(2, np.minimum(safe, len(encoder.is_byte))))
    return {"n_tokens": tokens, "chars_per_token": word_chars / safe, "byte_share": single / safe, "entropy_share": np.where(tokens > 0, entropy / most, 0.0), "sign_share": sign / safe}


def verdict(measures: dict[str, np.ndarray], bands: np.ndarray) -> np.ndarray:
    """Whether each text lies in its bands (rows of BANDS)."""
    low, high, most_bytes, least_entropy, most_signs = bands.T
    chars = measures["chars_per_token"]
    return (chars >= low) & (chars <= high) & (measures["byte_share"] <= most_bytes) & (measures["entropy_share"] >= least_entropy) & (measures["sign_share"] <= most_signs)


@lru_cache(maxsize=1)
def _second(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}

    def part(token: bytes) -> bool:
        try:
            token.decode()
        except UnicodeDecodeError:
            return True
        return False

    parts = frozenset(rank for token, rank in ranks.items() if part(token))
    return tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), parts


def second_fertility(text: str, path: str) -> tuple[float, float]:
    """Characters that are no white space per token, and the share of tokens that are parts of characters, by a tiktoken vocabulary."""
    encoding, parts = _second(path)
    ids = encoding.encode_ordinary(text)
    return sum(map(len, text.split())) / max(1, len(ids)), sum(i in parts for i in ids) / max(1, len(ids))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "entropy_share", "sign_share")


def quality_rules(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict = BANDS, carry: bool = False, second: str | None = None) -> DataFrame:
    """One row for each row of df: id, the base counts, base_failed, kept, n_tokens and the measures.

    second is the path of a tiktoken vocabulary that measures texts judged by a script of SECOND_BANDS too;
    second_chars and second_parts are null for all others, and without it.

    A null text has no words and fails; whole texts are measured, however long. Null ids are carried along. Bands are chosen by lang_col (if there is such a column and
    its value has bands), else by script. Repeated rows are judged alike; an empty table gives an
    empty result. With carry, the rows of df that are kept come back instead, all columns unchanged.
    """
    lang_col = lang_col if lang_col in df.columns else None
    longs = [T.StructField(c, T.LongType()) for c in COUNTS]
    flags = [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    schema = T.StructType([field(df, id_col), *longs, *flags, T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in (*MEASURES, "second_chars", "second_parts"))])

    def run(batches):
        for b in batches:
            data, at = texts_of(b.column(text_col))
            spans = word_spans(data, at)
            counts = base_counts(data, at, spans)
            words = counts["n_words"]
            failed = (words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
            measures = fertility(data, at, spans, vocabulary, counts["word_chars"])
            langs = b.column(lang_col).to_pylist() if lang_col else [None] * b.num_rows
            judged = [x if x in bands else s if s in bands else "other" for x, s in zip(langs, script_of(data, at), strict=True)]
            kept = ~failed & verdict(measures, np.array([bands[x] for x in judged], float).reshape(-1, 5))
            twice: list = [None] * b.num_rows
            for i, x in enumerate(judged):
                if second and x in SECOND_BANDS:
                    twice[i] = second_fertility(data[at[i] : at[i + 1]].tobytes().decode(), second)
                    kept[i] &= twice[i][0] >= SECOND_BANDS[x][0] and twice[i][1] <= SECOND_BANDS[x][1]
            if carry:
                yield b.filter(pa.array(kept))
                continue
            columns = [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *columns, pa.array(failed), pa.array(kept), pa.array(measures["n_tokens"].astype(np.int64)), *(pa.array(measures[c].astype(float)) for c in MEASURES), *(pa.array([x and x[k] for x in twice], pa.float64()) for k in (0, 1))], names=schema.names)

    if carry:
        return map_arrow(df, run, df.schema)
    return map_arrow(df.select(id_col, text_col, *([lang_col] if lang_col else [])), run, schema)
