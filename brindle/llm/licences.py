"""License scans by conditional compression.

Where a text has words that licenses use, each template is looked for in windows of about its own
length around them, however long the lines and blocks are. A window that holds too few of the
template's words can't be confirmed and is ruled out by their counts. What is left is compressed with
zstandard on its own and with each template as a raw-content dictionary: the closer the wording, the
more it shrinks. In that order every template left is held against the words, down to the last; it is
reported only if it confirms, with what is missing and what is extra. One row for each document comes
back, so nothing is lost where there is no license.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.common import field, map_arrow

#: Most words missing or extra as a share of the template's.
MOST_DIFFERENT = 0.15
#: Cue lines at most so many characters apart form one block.
GAP = 400

#: Wordings of public licenses and of the usual notices.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_CUE_PARTS = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "free software")
_CUE = re.compile("|".join(_CUE_PARTS))
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/'][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _lower(text: str) -> str:
    """Lower case, character by character: the few whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Spans from the first to the last line with a cue of each block; long lines are cut to GAP characters around the cue."""
    low = _lower(text)
    if not any(p in low for p in _CUE_PARTS):
        return []
    out: list[list[int]] = []
    for m in _CUE.finditer(low):
        start = max(text.rfind("\n", 0, m.start()) + 1, m.start() - GAP)
        end = text.find("\n", m.end())
        end = min(len(text) if end < 0 else end, m.end() + GAP)
        if out and start - out[-1][1] <= GAP:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


@lru_cache(maxsize=1)
def _compressors():
    import zstandard

    plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
    known = {}
    for name, text in TEMPLATES.items():
        raw = zstandard.ZstdCompressionDict(" ".join(words_of(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known[name] = zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)
    return plain, known, {name: words_of(text) for name, text in TEMPLATES.items()}


def differences(template: list[str], words: list[str]) -> tuple[int, int, int, int]:
    """Words of the template that are missing, words between its first and last match that are extra, and that span.

    A match at either end that is a small island, far from the next, is chance and is left out.
    """
    found = [m for m in SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks() if m.size]
    while len(found) > 1 and found[1].b - found[0].b - found[0].size > 3 * found[0].size:
        found.pop(0)
    while len(found) > 1 and found[-1].b - found[-2].b - found[-2].size > 3 * found[-1].size:
        found.pop()
    if not found:
        return len(template), 0, 0, 0
    matched = sum(m.size for m in found)
    start, end = found[0].b, found[-1].b + found[-1].size
    return len(template) - matched, end - start - matched, start, end


def ranked_templates(block: str, names=None) -> list[tuple[float, str]]:
    """Reduction by each template (of names, if given), the largest first (ties by name)."""
    plain, known, _ = _compressors()
    raw = " ".join(words_of(block)).encode()
    alone = len(plain.compress(raw))
    return sorted(((1 - len(known[name].compress(raw)) / alone, name) for name in (known if names is None else names)), key=lambda x: (-x[0], x[1]))


def _runs(own: list[str], words: list[str], cues: list[int], low: int, high: int) -> list[tuple[int, list[int]]]:
    """Runs of windows around cues, each by its first start, that may hold the template: how many of its words each window has.

    A window is as long as the template with all extra words allowed; one with fewer of its words
    than may be missing can't be confirmed. Only words from low to high count.
    """
    slack = int(MOST_DIFFERENT * len(own))
    long, least = len(own) + slack, len(own) - slack
    counts = Counter(own)
    out: list[tuple[int, list[int]]] = []
    k = bisect_left(cues, low)
    while k < len(cues) and cues[k] < high:
        # Starts of all windows that hold a cue, as long as those of one cue meet those of the next.
        first, last = max(low, cues[k] - long + 1), cues[k]
        k += 1
        while k < len(cues) and cues[k] < high and cues[k] - long <= last:
            last = cues[k]
            k += 1
        stop = min(high, last + long)
        if sum((counts & Counter(w for w in words[first:stop] if w in counts)).values()) < least:
            continue
        need, held, before = dict(counts), 0, None
        for i in range(first, stop):
            if words[i] in need:
                held += need[words[i]] > 0
                need[words[i]] -= 1
            start = i - long + 1
            if start > first and words[start - 1] in need:
                need[words[start - 1]] += 1
                held -= need[words[start - 1]] > 0
            if held >= least and (start >= first or i == stop - 1):
                start = max(start, first)
                if before is None or start > before + 1:
                    out.append((start, []))
                out[-1][1].append(held)
                before = start
    return out


def _confirmed(own: list[str], words: list[str], start: int, end: int) -> tuple[int, int, int, int] | None:
    missing, extra, first, last = differences(own, words[start:end])
    return (missing, extra, start + first, start + last) if missing + extra <= MOST_DIFFERENT * len(own) else None


def _found_in(words: list[str], cues: list[int], low: int, high: int) -> list[tuple]:
    """Confirmed wordings among words from low to high, which may overlap: rank, first word, end, what is reported."""
    _, _, templates = _compressors()
    spans: dict[tuple[int, int], list] = {}
    for name, own in templates.items():
        long = len(own) + int(MOST_DIFFERENT * len(own))
        for start, held in _runs(own, words, cues, low, high):
            # A long run is gone through in pieces, so that a near match is not hidden by a far one.
            for i in range(0, len(held), long):
                piece = held[i : i + long]
                spans.setdefault((start + i, min(high, start + i + len(piece) - 1 + long)), []).append((name, piece))
    out = []
    for (start, end), proposed in spans.items():
        pieces = dict(proposed)
        for reduction, name in ranked_templates(" ".join(words[start:end]), pieces):
            own, piece = templates[name], pieces[name]
            long = len(own) + int(MOST_DIFFERENT * len(own))
            got = _confirmed(own, words, start, end)
            for i in sorted(range(len(piece)), key=lambda i: -piece[i]) if not got else ():
                got = _confirmed(own, words, start + i, min(high, start + i + long))
                if got:
                    break
            if got:
                missing, extra, first, last = got
                # The fewest differences win, then the longest wording: a full text over its notice.
                rank = (missing + extra) / len(own), -len(own), -reduction, name, first
                out.append((rank, first, last, {"license": name, "reduction": round(reduction, 6), "missing": missing, "extra": extra}))
    return sorted(out, key=lambda x: x[0])


def scan_text(text: str | None) -> list[dict]:
    """Confirmed licenses: span of the wording (code points), name, reduction, words missing and extra.

    What stands before, between and after the licenses found is searched again until no more are
    found, so a text may hold several, side by side.
    """
    text = text or ""
    low = _lower(text)
    if not any(p in low for p in _CUE_PARTS):
        return []
    places = [m.span() for m in _WORD.finditer(low)]
    words = [low[s:e] for s, e in places]
    ends = [e for _, e in places]
    cues = sorted({i for m in _CUE.finditer(low) if (i := bisect_left(ends, m.start() + 1)) < len(words)})
    out: list[dict] = []
    open_ranges = [(0, len(words))]
    while open_ranges:
        begin, stop = open_ranges.pop()
        chosen: list[tuple[int, int]] = []
        for _, first, last, found in _found_in(words, cues, begin, stop):
            k = bisect_left(chosen, (first, 0))
            if (k and chosen[k - 1][1] > first) or (k < len(chosen) and chosen[k][0] < last):
                continue
            chosen.insert(k, (first, last))
            out.append({"start": places[first][0], "end": places[last - 1][1], **found})
        if chosen:
            borders = [begin, *(x for span in chosen for x in span), stop]
            open_ranges += [(s, e) for s, e in zip(borders[::2], borders[1::2], strict=True) if s < e]
    return sorted(out, key=lambda f: f["start"])


FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")] + [T.StructField("license", T.StringType()), T.StructField("reduction", T.DoubleType()), T.StructField("missing", T.LongType()), T.StructField("extra", T.LongType())])


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_blocks (candidates), found (array of confirmed licenses), license (the first, or null).

    A null, empty or license-free text has an empty array; the whole text is searched, however long; of
    wordings that fit one place equally well the longest is told, then the first by name; repeated rows
    each have a row; a null id is carried along; an empty table gives an empty result. Other columns
    are not read.
    """
    schema = T.StructType([field(df, id_col), T.StructField("n_blocks", T.LongType()), T.StructField("found", T.ArrayType(FOUND)), T.StructField("license", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("missing", pa.int64()), ("extra", pa.int64())]))

    def run(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            found = [scan_text(x) for x in texts]
            blocks = [len(candidate_blocks(x or "")) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(blocks, pa.int64()), pa.array(found, kind), pa.array([f[0]["license"] if f else None for f in found], pa.string())], names=schema.names)

    return map_arrow(df.select(id_col, text_col), run, schema)
