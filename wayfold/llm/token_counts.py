"""Token counts by byte-pair merging with a heap and a linked list.

A word begins as one symbol for each byte, in a doubly linked list.  A heap
holds its adjacent pairs by the rank of their merge, then by place; the lowest
is popped and merged, its neighbours' new pairs go in, and pairs whose symbols
have changed since are skipped.  Every merge takes one symbol away, so a word's
count is its bytes less its merges: no list of ids is ever made.  A word of n
bytes takes n log n steps, whatever its length.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SIMPLE, WORD, byte_letters
from .vocab import LONGEST, WS, cut

#: Words and pieces whose counts a worker remembers before it starts anew; no effect on results.
REMEMBERED = 500_000
#: Bytes of text that a worker looks at together.
CHUNK = 4_000_000
#: A heap entry is a rank and a place in one number.
PLACE_BITS = 40


class Merges:
    """The merges of a byte-level tokenizers file, and the special tokens in it."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        #: (left, right) -> (rank, what they become)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[ids[left], ids[right]] = (rank, ids[left + right])
        self.symbol = [ids[letter] for letter, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        special = sorted((x["content"] for x in file["added_tokens"]), key=len, reverse=True)
        #: Special tokens, each of which has "<" in it.
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.word = regex.compile(WORD.format(w=WS))
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """How many tokens a word has: its bytes less the merges that the heap gives."""
        merge, n = self.merge.get, len(word)
        symbols = [self.symbol[b] for b in word]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [found[0] << PLACE_BITS | at for at in range(n - 1) if (found := merge((symbols[at], symbols[at + 1])))]
        heapify(heap)
        left = n
        while heap:
            entry = heappop(heap)
            at = entry & (1 << PLACE_BITS) - 1
            to = after[at]
            if to < 0 or symbols[at] < 0:
                continue
            found = merge((symbols[at], symbols[to]))
            if not found or found[0] != entry >> PLACE_BITS:
                continue  # one of the two has been merged since
            left -= 1
            symbols[at], symbols[to] = found[1], -1
            beyond = after[at] = after[to]
            if beyond >= 0:
                before[beyond] = at
                if found := merge((symbols[at], symbols[beyond])):
                    heappush(heap, found[0] << PLACE_BITS | at)
            front = before[at]
            if front >= 0 and (found := merge((symbols[front], symbols[at]))):
                heappush(heap, found[0] << PLACE_BITS | front)
        return left

    def of_word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.merged(word.encode())
            if len(word) <= LONGEST:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[word] = found
        return found

    def of_text(self, text: str) -> int:
        """Tokens of a string; a special token's string in it is one token."""
        if "<" in text and self.special is not None and self.special.search(text):
            return len(self.special.findall(text)) + sum(map(self.of_text, filter(None, self.special.split(text))))
        return sum(map(self.of_word, self.word.findall(text)))

    def of_piece(self, piece: str) -> int:
        """Tokens of a piece of a text that cut() gives; short pieces are remembered."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.of_word(piece) if SIMPLE.fullmatch(piece) else self.of_text(piece)
            if len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (large strings without nulls): distinct pieces are counted once for all of them."""
        pieces, offsets = cut(texts)
        pieces = pieces.dictionary_encode()
        each = np.fromiter(map(self.of_piece, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
        ends = np.concatenate([[0], np.cumsum(each[np.asarray(pieces.indices)])])
        return np.diff(ends[offsets])


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count(docs: DataFrame, vocab_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: the id column, n_bytes and n_tokens (long), and over_limit (n_tokens > limit).

    n_bytes is the length in UTF-8; n_tokens what the tokenizers library gives
    for the byte-level file at vocab_path without added special tokens,
    truncation and padding.  A special token's string in a text is one token.

    Null and empty text: no bytes, no tokens.  A long text is counted a stretch
    of some megabytes of the batch at a time, or by itself if it is longer.  Rows
    keep their number and partition, so nothing is shuffled; repeated rows and
    null ids are counted like others.  Other columns aren't read.  An empty table
    gives none.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        counted = merges(vocab_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            ends, at, out = np.cumsum(sizes), 0, []
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                out.append(counted.of_texts(texts.slice(at, to - at)))
                at = to
            tokens = np.concatenate([*out, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens)], names=[id_col, "n_bytes", "n_tokens"])

    counted = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
