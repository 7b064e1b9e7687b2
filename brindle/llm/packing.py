"""Packing of documents into windows of a fixed number of tokens by non-negative least squares.

Whole windows are cut off each document; what remains of it (its rest) is shorter than a window. The
rests are packed group by group, a group being up to GROUP_ROWS consecutive documents of a partition,
so packing needs no shuffle, its memory is bounded, and a lost task is simply run again. Within a
group: the shallow combinations (two or three lengths) that fill a window exactly are enumerated, and
for each length, as the least, the middle or the largest, the PER_LENGTH of which there is most are kept. The
number of times to use each is solved for against the histogram of rests by non-negative least
squares, up to TOLERANCE on the conditions of the optimum, and the solution is rounded within the stock.
(With all combinations the same windows would be spread over so many that each has a small fraction of one, which rounds to none.)
What is left over is laid end to end and cut where a window is full. Only the last window of a group can
have a gap; it is cut into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.common import BATCH_BYTES, field, map_arrow
from brindle.llm.spans import texts_of
from brindle.llm.tokens import unit_encoder

GROUP_ROWS, GROUP_TOKENS = 8192, 1 << 21
#: Combinations kept for each length in each place; distance from the optimum, in windows, and rounds of the solver at most.
PER_LENGTH, TOLERANCE, ROUNDS = 2, 0.02, 20_000


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three of the lengths (one, if it is the window), ascending and padded with 0, that add up to the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    pairs = lengths[(2 * lengths <= window)]
    pairs = pairs[have[window - pairs]]
    least, middle = np.meshgrid(lengths[3 * lengths <= window], lengths[2 * lengths <= window], indexing="ij")
    fits = (least <= middle) & (middle <= window - least - middle)
    least, middle = least[fits], middle[fits]
    fits = have[window - least - middle]
    least, middle = least[fits], middle[fits]
    return np.concatenate([np.stack([np.zeros_like(pairs), pairs, window - pairs], 1), np.stack([least, middle, window - least - middle], 1)])


def chosen(combos: np.ndarray, stock: np.ndarray, per_length: int = PER_LENGTH) -> np.ndarray:
    """All pairs, and the triples that are among the per_length with the most stock for any of their lengths in its place."""
    most = np.where(combos > 0, stock[combos], np.inf).min(1, initial=np.inf)
    keep = combos[:, 0] == 0
    for place in range(3):
        order = np.lexsort((np.arange(len(combos)), -most, combos[:, place]))
        first = np.flatnonzero(np.diff(combos[order, place], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep[order[rank < per_length]] = True
    return combos[keep]


def solve_counts(combos: np.ndarray, stock: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Non-negative x that minimises |A x - stock|^2, A having the lengths of each combination (accelerated projected gradient).

    It stops where the conditions of the optimum hold up to the tolerance: no x below 0, no gradient
    below 0, and one of the two 0 for each combination.
    """
    m, size = len(combos), len(stock)
    if not m:
        return np.zeros(0)
    weight = (combos > 0).astype(float)

    def gain(z: np.ndarray) -> np.ndarray:
        """The gradient's opposite at z."""
        left = stock - np.bincount(combos.ravel(), (weight * z[:, None]).ravel(), size)
        left[0] = 0
        return left[combos].sum(1)

    x = y = np.zeros(m)
    uses = np.bincount(combos.ravel(), weight.ravel(), size)
    uses[0] = 0
    step = 1.0 / max(1.0, 3.0 * uses.max())  # |A|^2 is at most its largest row sum times its largest column sum
    t = 1.0
    for k in range(1, ROUNDS + 1):
        new = np.maximum(0, y + step * gain(y))
        if ((y - new) * (new - x)).sum() > 0:  # past the lowest point on this way: start anew from here
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
        if k % 50 == 0 and np.abs(np.minimum(x, -gain(x))).max() < tolerance:
            break
    return x


def rounded(combos: np.ndarray, x: np.ndarray, stock: np.ndarray) -> tuple[list[tuple[int, list[int]]], np.ndarray]:
    """(times, lengths) of each combination used, x rounded, the largest first and within the stock, and the stock left."""
    left = stock.astype(np.int64).tolist()
    used = []
    for i in np.argsort(-x, kind="stable").tolist():
        k = int(x[i] + 0.5)
        if not k:
            break
        lengths = [v for v in combos[i].tolist() if v]
        need = {v: lengths.count(v) for v in lengths}
        k = min(k, *(left[v] // c for v, c in need.items()))
        if k > 0:
            for v, c in need.items():
                left[v] -= c * k
            used.append((k, lengths))
    return used, np.array(left, np.int64)


def pack_rests(rests: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start in its rest, length, sequence, offset) of pieces that cover rests shorter than the window.

    Sequences are numbered from 0; only the last ones (of powers of two) are shorter than the window.
    """
    stock = np.bincount(rests, minlength=window + 1).astype(np.int64)
    stock[0] = 0
    lengths = np.flatnonzero(stock)
    combos = chosen(combinations(lengths, window), stock)
    used, left = rounded(combos, solve_counts(combos, stock.astype(float)), stock)
    order = np.argsort(rests, kind="stable")
    at = np.searchsorted(rests[order], np.arange(window + 2)).tolist()
    order = order.tolist()
    out, sequence = [], 0
    for k, parts in used:
        for _ in range(k):
            offset = 0
            for v in parts:
                out.append((order[at[v]], 0, v, sequence, offset))
                at[v] += 1
                offset += v
            sequence += 1
    offset = 0
    tail = []
    for v in np.flatnonzero(left).tolist()[::-1]:
        for _ in range(int(left[v])):
            doc, start = order[at[v]], 0
            at[v] += 1
            while start < v:
                n = min(v - start, window - offset)
                tail.append((doc, start, n, sequence, offset))
                start, offset = start + n, offset + n
                if offset == window:
                    sequence, offset = sequence + 1, 0
                    out += tail
                    tail = []
    # What fills no window: windows of powers of two, the largest first.
    size = 1 << (offset.bit_length() - 1) if offset else 0
    room = size
    for doc, start, n, _, _ in tail:
        while n:
            k = min(n, room)
            out.append((doc, start, k, sequence, size - room))
            start, n, room, offset = start + k, n - k, room - k, offset - k
            if not room and offset:
                sequence, size = sequence + 1, 1 << (offset.bit_length() - 1)
                room = size
    return out


def _pack_group(docs: list[tuple[object, np.ndarray]], window: int, first: int) -> tuple[dict[str, list], int]:
    rests = np.array([len(ids) % window for _, ids in docs], np.int64)
    rows: list[tuple] = []
    sequence = first
    for i, (_, ids) in enumerate(docs):
        for start in range(0, len(ids) - int(rests[i]), window):
            rows.append((i, start, window, sequence, 0))
            sequence += 1
    last = sequence
    for i, start, n, s, offset in pack_rests(rests, window):
        rows.append((i, len(docs[i][1]) - int(rests[i]) + start, n, sequence + s, offset))
        last = max(last, sequence + s + 1)
    pieces = [docs[i][1][s : s + n] for i, s, n, _, _ in rows]
    out = {
        "start": [r[1] for r in rows], "length": [r[2] for r in rows], "ids_crc32": [zlib.crc32(p) for p in pieces], "doc_tokens": [len(docs[r[0]][1]) for r in rows],
        "sequence_id": [r[3] for r in rows], "offset": [r[4] for r in rows], "ids": pieces, "doc": [docs[r[0]][0] for r in rows],
    }
    return out, last


def pack(df: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A document's ids are those of its whole text, however long, with end_id after them; a null text counts as
    empty, so each row has at least one id. Repeated rows are packed like others. A null id is
    carried along. Sequence ids are unique, not dense: the partition's number lies above bit 40.
    An empty table gives no pieces. Columns besides id and text are not read.
    """
    fields = [field(df, id_col), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        from pyspark import TaskContext

        encoder = unit_encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, np.ndarray]] = []
        tokens, kind = 0, None

        def packed():
            nonlocal sequence, held, tokens
            rows, sequence = _pack_group(held, window, sequence)
            held, tokens = [], 0
            step = max(1, BATCH_BYTES // (4 * window if with_ids else 64))
            for i in range(0, len(rows["doc"]), step):
                own = {k: v[i : i + step] for k, v in rows.items()}
                columns = [pa.array(own["doc"], kind), *(pa.array(own[f.name], pa.int64()) for f in fields[1:7])]
                if with_ids:
                    over = np.concatenate([[0], np.cumsum(own["length"])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(over, np.concatenate(own["ids"]).view(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

        end = np.array([end_id], np.uint32)
        for b in batches:
            kind = b.column(id_col).type
            ids, at = encoder.encode(*texts_of(b.column(text_col)))
            for i, doc in enumerate(b.column(id_col).to_pylist()):
                held.append((doc, np.concatenate([ids[at[i] : at[i + 1]], end])))
                tokens += len(held[-1][1])
                if len(held) >= GROUP_ROWS or tokens >= GROUP_TOKENS:
                    yield from packed()
        if held:
            yield from packed()

    return map_arrow(df.select(id_col, text_col), run, T.StructType(fields))
