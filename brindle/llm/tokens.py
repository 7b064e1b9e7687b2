"""Token ids of whole texts with a public byte-level BPE vocabulary.

A byte-level BPE cuts a text into pre-tokens (an optional blank and a run of letters, digits or
signs; runs of white space) before it merges bytes, so the ids of a text are those of its pieces laid
end to end wherever the pieces meet at a border of pre-tokens. ``UnitEncoder`` cuts the bytes of a
whole batch at borders that are certain (before a lone blank, around a lone line end, between ASCII
letters or digits and ASCII signs), hashes the pieces, and lets the library encode each piece it
hasn't met yet. That is several times faster than encoding every text anew and gives the library's
ids. Pieces of letters alone are one pre-token: the library's model merges their bytes directly.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, pairwise
from operator import attrgetter

import numpy as np

from brindle.llm.spans import joined, span_keys

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: What a byte is, as bits: a letter or digit of ASCII; a sign of ASCII; no white space; perhaps the first byte of white space beyond ASCII.
_WORD, _SIGN, _SOLID, _ODD = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] |= _SOLID | _SIGN
_KIND[128:] |= _SOLID
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] ^= _SIGN | _WORD
_KIND[39] ^= _SIGN  # "'s" is a pre-token
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] |= _ODD


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where a text, or another piece of one, begins."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    if n > 1:
        kind = _KIND[data]
        # A byte beside which a border may lie: no white space, nor possibly part of any.
        ahead = kind & (_SOLID | _ODD) == _SOLID
        behind = ahead.copy()
        odd = np.flatnonzero(kind & _ODD)
        for step in (1, 2):
            after = odd[odd + step < n] + step
            behind[after[data[after] > 127]] = False
        space = np.flatnonzero((data == 32) | (data == 10))
        inner = space[(space > 0) & (space < n - 1)]
        lone = inner[behind[inner - 1] & ahead[inner + 1]]
        cut[lone] = True
        cut[lone[data[lone] == 10] + 1] = True
        # Between a letter or digit and a sign, one way or the other.
        cut[1:n] |= (kind[:-1] ^ kind[1:]) & (_WORD | _SIGN) == _WORD | _SIGN
        # White space at the end or start of a text joins nothing across it.
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        near = space[edge[space] | edge[space + 1]]
        cut[near[~edge[near]]] = False
        cut[near[~edge[near + 1]] + 1] = False
    return np.flatnonzero(cut[:n])


class SpanMemory:
    """Remembers the ids of byte spans met before; ``limit`` bounds how many, TEXT_MOST the bytes of the longer ones.

    Spans are found by their keys. Longer ones are then compared byte by byte: one that only has the
    hash of another is encoded anew. When the memory is full, spans that were met in one batch only are
    forgotten, and all of them if that doesn't help. A subclass has ``ids_of_all(bytes of spans end to
    end, n + 1 offsets)``, which gives all ids end to end and how many each span has.
    """

    TEXT_MOST = 1 << 24

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # keys of the spans met, ascending
        self.slot = np.zeros(0, np.int32)  # and where in begin, count and the like each is
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 16, np.uint8), 0
        #: Where the ids of a slot begin and how many they are; where its bytes are kept, and how many they are; batches it was met in.
        self.begin, self.count, self.place, self.length, self.met = np.zeros((5, 1 << 14), np.int32)

    def _shrink(self) -> None:
        """Forgets what was met once."""
        keep = self.met[self.slot] > 1
        slots = self.slot[keep]
        lengths, counts = self.length[slots].astype(np.int64), self.count[slots].astype(np.int64)
        long = np.where(lengths > 7, lengths, 0)
        if 2 * len(slots) > self.limit or 2 * long.sum() > self.TEXT_MOST:
            self._clear()
            return
        known, flat, text = self.known[keep], joined(self.flat, self.begin[slots], counts), joined(self.text, self.place[slots], long)
        self._clear()
        self.known, self.slot = known, np.arange(len(slots), dtype=np.int32)
        self.flat, self.used, self.text, self.text_used = flat, len(flat), text, len(text)
        self.begin, self.count = (np.cumsum(counts) - counts).astype(np.int32), counts.astype(np.int32)
        self.place, self.length, self.met = (np.cumsum(long) - long).astype(np.int32), lengths.astype(np.int32), np.zeros(len(slots), np.int32)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(len(array), size - len(array)), array.dtype)])

    def _encoded(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans end to end and how many each has, from the library."""
        return self.ids_of_all(joined(data, starts, lengths), np.concatenate([[0], np.cumsum(lengths)]))

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        ids, counts = self._encoded(data, starts, lengths)
        k, n = len(self.known), len(starts)
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        long = np.where(lengths > 7, lengths, 0)
        size = int(long.sum())
        self.text = self._room(self.text, self.text_used + size)
        self.text[self.text_used : self.text_used + size] = joined(data, starts, long)
        for name, values in (("begin", self.used + np.cumsum(counts) - counts), ("count", counts), ("place", self.text_used + np.cumsum(long) - long), ("length", lengths), ("met", 0)):
            array = self._room(getattr(self, name), k + n)
            array[k : k + n] = values
            setattr(self, name, array)
        self.used += len(ids)
        self.text_used += size
        at = np.searchsorted(self.known, keys)
        self.known = np.insert(self.known, at, keys)
        self.slot = np.insert(self.slot, at, np.arange(k, k + n, dtype=np.int32))

    def _others(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which spans are not the ones remembered under their key."""
        same = self.length[slots] == lengths
        at = np.flatnonzero(same & (lengths > 7))
        differs = joined(data, starts[at], lengths[at]) != joined(self.text, self.place[slots[at]], lengths[at])
        if differs.any():
            same[np.repeat(at, lengths[at])[differs]] = False
        return np.flatnonzero(~same)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans laid end to end, and n + 1 offsets."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lengths = ends - starts
        unique, first, back = np.unique(span_keys(data, starts, lengths), return_index=True, return_inverse=True)
        if len(self.known) > self.limit or self.text_used > self.TEXT_MOST:
            self._shrink()
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        there = place < len(self.known)
        new[there] = self.known[place[there]] != unique[there]
        if new.any():
            self._learn(data, unique[new], starts[first[new]], lengths[first[new]])
            place = np.searchsorted(self.known, unique)
        slots = self.slot[place]
        self.met[slots] += 1
        slots = slots[back]
        flat, begin, counts = self.flat, self.begin[slots], self.count[slots]
        odd = self._others(data, starts, lengths, slots)
        if len(odd):
            extra, own = self._encoded(data, starts[odd], lengths[odd])
            begin[odd], counts[odd] = self.used + np.cumsum(own) - own, own
            flat = np.concatenate([flat[: self.used], extra])
        return joined(flat, begin, counts), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


_ID = attrgetter("id")


class UnitEncoder(SpanMemory):
    """``encode(data, at)``: ids (unsigned 32 bits) of the texts laid end to end, and n + 1 offsets.

    As in the library, the string of a special token of the vocabulary is that token wherever it stands
    in a text; a text with one goes to the library whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(limit)
        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        #: The sign that a byte-level vocabulary writes for each byte.
        self.signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.merge = self.tokenizer.model.tokenize
        self.size = self.tokenizer.get_vocab_size()

    def ids_of_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A blank and letters, or letters alone: the vocabulary's signs of their bytes can be merged as they are.
        body = at[:-1] + (data[at[:-1]] == 32)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        plain = (letters[at[1:]] - letters[body] == at[1:] - body) & (body < at[1:])
        raw, merge = data.tobytes(), self.merge
        signs = raw.decode("latin-1").translate(self.signs)
        encoded: dict[int, list[int]] = {}
        for i in np.flatnonzero(~plain).tolist():
            text = raw[at[i] : at[i + 1]].decode()
            if (text[1:] if text[0] == " " else text).isalpha():
                plain[i] = True
            else:
                encoded[i] = self.tokenizer.encode(text, add_special_tokens=False).ids
        tokens, counts = [], np.zeros(len(plain), np.int64)
        easy = np.flatnonzero(plain)
        over = []
        for s, e in zip(at[easy].tolist(), at[easy + 1].tolist(), strict=True):
            tokens += merge(signs[s:e])
            over.append(len(tokens))
        ids = np.fromiter(map(_ID, tokens), np.uint32, len(tokens))
        counts[easy] = np.diff(np.array(over, np.int64), prepend=0)
        if not encoded:
            return ids, counts
        extra = np.fromiter(chain.from_iterable(encoded.values()), np.uint32)
        counts[~plain] = [len(x) for x in encoded.values()]
        begin = np.zeros(len(plain), np.int64)
        begin[easy] = np.cumsum(counts[easy]) - counts[easy]
        begin[~plain] = len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
        return joined(np.concatenate([ids, extra]), begin, counts), counts

    def _marked(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """Texts that hold the string of a special token."""
        raw, out = data.tobytes(), set()
        for mark in self.marks:
            found = raw.find(mark)
            while found >= 0:
                k = int(np.searchsorted(at, found, "right")) - 1
                if found + len(mark) <= at[k + 1]:
                    out.add(k)
                found = raw.find(mark, found + 1)
        return sorted(out)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = unit_starts(data, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ids, over = self.ids(data, starts, np.append(starts[1:], len(data)))
        over = over[np.searchsorted(starts, at, "left")]
        marked = self._marked(data, at)
        if marked:
            parts = np.split(ids, over[1:-1])
            for k in marked:
                parts[k] = np.array(self.tokenizer.encode(data[at[k] : at[k + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            ids, over = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, over

    def one(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode(raw, np.array([0, len(raw)]))[0]


class PieceEncoder(SpanMemory):
    """Ids of single words in a sentencepiece vocabulary."""

    def __init__(self, path: str, limit: int = 400_000):
        import sentencepiece

        super().__init__(limit)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())], bool)
        #: Tokens of a character that is no letter or digit; the mark of a word's start isn't counted.
        texts = [self.pieces.id_to_piece(i).replace("\u2581", "") for i in range(self.pieces.vocab_size())]
        self.is_sign = np.array([bool(x) and not any(c.isalnum() for c in x) for x in texts], bool) & ~self.is_byte

    def ids_of_all(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        new = self.pieces.encode([raw[s:e].decode() for s, e in pairwise(at.tolist())], num_threads=1)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        return np.fromiter(chain.from_iterable(new), np.uint32, int(counts.sum())), counts


@lru_cache(maxsize=1)
def _encoder(kind: type[SpanMemory], path: str) -> SpanMemory:
    """A worker process holds one encoder at a time: that of another stage is let go."""
    return kind(path)


def release_encoders() -> None:
    """Lets go of what another stage has left in this worker process."""
    _encoder.cache_clear()


def unit_encoder(path: str) -> UnitEncoder:
    return _encoder(UnitEncoder, path)


def piece_encoder(path: str) -> PieceEncoder:
    return _encoder(PieceEncoder, path)
