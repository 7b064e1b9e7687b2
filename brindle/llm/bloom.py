"""Bloom filters of digests, gathered in segments on executors and of bounded size on the driver.

A digest is 32 bytes, as of SHA-256. A filter says of a digest that its cells were hit ``least`` times
or more; it may say so wrongly, but never fails to say so rightly. A filter has MAX_CELLS cells at
most (a bit each on the driver and in each Python worker that asks it: 128 MB), however many digests
there are; what is asked of a fuller one is true more often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_arrow

#: Cells for each digest, and cells that each digest hits.
CELLS, PROBES, MAX_CELLS = 8, 3, 1 << 30
_SEGMENT = 16  # bits of a place within a segment of the filter


def flat(column: pa.Array) -> np.ndarray:
    """The digests of a column end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def digest_of(*columns: Column) -> Column:
    """A digest of some values; null differs from every value."""
    texts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("\x1f", *texts), 256))


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    words = digests.reshape(-1, 32).view("<u8")
    step = words[:, 1] | np.uint64(1)
    return (words[:, :1] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(cells - 1)


def _cell_counts(cells: int):
    """Once for each partition: the places hit once, and those hit more often, by segment."""

    def run(batches):
        hits = [np.zeros(0, np.uint64)]
        for b in batches:
            hits.append(_places(flat(b.column("sha")), cells).ravel())
        place, n = np.unique(np.concatenate(hits), return_counts=True)
        segment = (place >> np.uint64(_SEGMENT)).astype(np.int64)
        low = (place & np.uint64((1 << _SEGMENT) - 1)).astype("<u2")
        if not len(place):
            return
        borders = np.flatnonzero(np.diff(segment, prepend=-1))
        for a, b in zip(borders, np.append(borders[1:], len(place)), strict=True):
            one = n[a:b] == 1
            yield pa.RecordBatch.from_pydict({"segment": [int(segment[a])], "once": [low[a:b][one].tobytes()], "more": [low[a:b][~one].tobytes()]})

    return run


def _merged(least: int):
    """The bits of each segment, from parts of segments that are sorted by it."""

    def run(batches):
        n, now = np.zeros(1 << _SEGMENT, np.int32), None

        def done():
            return pa.RecordBatch.from_pydict({"segment": [now], "bits": [np.packbits(n >= least).tobytes()]})

        for b in batches:
            for segment, once, more in zip(*(b.column(c).to_pylist() for c in ("segment", "once", "more")), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    n[:], now = 0, segment
                n[np.frombuffer(once, "<u2")] += 1
                n[np.frombuffer(more, "<u2")] += 2
        if now is not None:
            yield done()

    return run


def bloom_filter(digests: DataFrame, rows: int, least: int = 1) -> tuple[np.ndarray, int]:
    """Bits of the filter over a table with a column sha of about ``rows`` rows, and the number of its cells."""
    cells = min(MAX_CELLS, 1 << max(_SEGMENT, int(np.ceil(np.log2(max(1, CELLS * rows))))))
    parts = map_arrow(digests.select("sha"), _cell_counts(cells), "segment long, once binary, more binary")
    merged = map_arrow(parts.repartition("segment").sortWithinPartitions("segment"), _merged(least), "segment long, bits binary")
    bits = np.zeros((cells >> _SEGMENT, 1 << (_SEGMENT - 3)), np.uint8)
    for row in merged.collect():
        bits[row.segment] = np.frombuffer(row.bits, np.uint8)
    return bits.ravel(), cells


def may_hold(digests: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Whether each digest's cells all have their bit."""
    place = _places(digests, cells)
    return ((bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7)))) & 1).all(axis=1)


def rows_that_may_match(df: DataFrame, digest: Column, keys: DataFrame, rows: int, flag: str) -> DataFrame:
    """df with a column ``flag``: false where the row's digest is certainly not among those of keys (a column sha).

    df is passed through Python once, by the batch; nothing is shuffled but the filter's segments.
    """
    from pyspark.sql import types as T

    spread = df.sparkSession.sparkContext.broadcast(bloom_filter(keys, rows))
    marked = df.withColumn(flag, digest)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(flag)
            yield b.set_column(at, pa.field(flag, pa.bool_()), pa.array(may_hold(flat(b.column(at)), *spread.value)))

    return map_arrow(marked, run, T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())]))
