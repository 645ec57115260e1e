"""Encoding with a public tokenizer file, memoised on pieces that hardly exceed a word.

Both vocabularies cut a text before anything else at the step from a visible
character to white space, from a letter to another kind of character and from a
digit to a letter or sign.  So a text's ids are the ids of its pieces, one
after another.  Corpus text repeats its pieces; each worker keeps the ids of
those that it has seen lately (bounded, no effect on results).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the sense of Unicode, as the tokenizers' patterns take it.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A generation of remembered pieces; two are kept.  Longer pieces aren't remembered.
GENERATION, LONGEST = 150_000, 64
#: Bytes of text that are encoded together.
CHUNK = 2_000_000

#: Kinds of bytes: unknown, letter, sign, digit, white space, and the bar, which special tokens have after a letter.
OTHER, LETTER, SIGN, DIGIT, SPACE, BAR = range(6)


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for at in range(0x21, 0x7F):
        c = chr(at)
        kinds[at] = LETTER if c.isalpha() else DIGIT if c.isdigit() else BAR if c == "|" else SIGN
    for at in (*range(9, 14), 32):
        kinds[at] = SPACE
    return kinds


KINDS = _kinds()
#: Whether texts are cut between two bytes, by kind of the first * 8 + kind of the second.
CUT = np.zeros(64, bool)
for _before, _after in [(LETTER, SPACE), (SIGN, SPACE), (DIGIT, SPACE), (BAR, SPACE), (LETTER, SIGN), (LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, SIGN)]:
    CUT[8 * _before + _after] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts (large strings without nulls) and, for each text, where its pieces begin; one number more at the end.

    Cuts stand between characters that no word of either vocabulary joins, and
    before an ASCII character only, so that no mark is parted from its letter.
    Latin letters of two bytes count as letters, but for the dotted capital I,
    whose lower case ends in a mark.
    """
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kinds = KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    last = data[lead + 1]
    signs = ((data[lead] == 0xC3) & ((last == 0x97) | (last == 0xB7))) | ((data[lead] == 0xC4) & (last == 0xB0))
    kinds[lead[~signs] + 1] = LETTER
    marked = np.zeros(len(data) + 1, bool)
    if len(data):
        marked[1:-1] = CUT[8 * kinds[:-1] + kinds[1:]]
    marked[ends] = True
    places = np.flatnonzero(marked)
    pieces = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(np.ascontiguousarray(places, "<i8")), pa.py_buffer(data))
    return pieces, np.searchsorted(places, ends)


class PieceEncoder:
    """Ids of whole texts.

    learn: gives the ids of strings that it is asked for, as bytes
    (little-endian unsigned 32-bit).
    """

    def __init__(self, learn):
        self.learn = learn
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def recall(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.now) > GENERATION:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        out = list(map(now.get, pieces))
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                ids = before.get(pieces[i])
                if ids is None:
                    new.append(i)
                else:
                    out[i] = now[pieces[i]] = ids
        if new:
            wanted = [pieces[i] for i in new]
            for i, p, ids in zip(new, wanted, self.learn(wanted), strict=True):
                out[i] = ids
                if len(p) <= LONGEST:
                    now[p] = ids
        return out

    def encode_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, offsets = cut(texts)
        pieces = pieces.dictionary_encode()
        taken = pa.array(self.recall(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        bounds, ids = taken.buffers()[1:]
        return np.frombuffer(ids or b"", "<u4"), np.frombuffer(bounds, np.int64)[offsets] // 4

    def encode(self, texts: pa.Array, chunk: int = CHUNK):
        """Yield (first text, ids, offsets) for runs of texts; ids[offsets[i] : offsets[i + 1]] are those of text first + i.  Null: none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
            yield at, *self.encode_chunk(texts.slice(at, to - at))
            at = to


def as_binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value for each text."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((4 * offsets).astype("<i8")), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())


def join_learner(encode, special: str, special_id: int):
    """Ids of many strings from few calls: they are encoded as one text, with a special token between them."""

    def learn(strings: list[str]) -> list[bytes]:
        plain = [s for s in strings if "<" not in s]
        runs = [special.join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]
        found = []
        for ids in encode(runs):
            ids = np.array(ids, "<u4")
            cuts = np.flatnonzero(ids == special_id)
            data, cuts = ids.tobytes(), cuts.tolist()
            found += [data[4 * a : 4 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]
        odd = [s for s in strings if "<" in s]
        found = iter(found)
        rest = iter([np.array(ids, "<u4").tobytes() for ids in encode(odd)])
        return [next(rest) if "<" in s else next(found) for s in strings]

    return learn


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The tokenizers library's encoder for the file at path, without added special tokens, truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    special_id, special = max((i, t.content) for i, t in found.get_added_tokens_decoder().items())

    def encode(strings: list[str]) -> list[list[int]]:
        return [e.ids for e in found.encode_batch_fast(strings, add_special_tokens=False)]

    return PieceEncoder(join_learner(encode, special, special_id))
