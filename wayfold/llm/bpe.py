"""Byte-pair encoding and decoding over a trie of distinct words.

Greedy merging has one encoding for every byte string, and the encoding of a
word's prefix ends in one token.  So a prefix's state is that last token and
the prefix in front of it.  A token can end a prefix if it and the token before
it stay apart when they are merged alone.

Distinct words of a batch form a trie.  Sorted words are its nodes in
depth-first order: a word adds the nodes below the prefix that it shares with
the word before, and one path of states is held.  Every new node takes the one
token that can end it, so what words share at their start is encoded once.
Reading a word's ids is a walk back over those states.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .vocab import WS, PieceEncoder, as_binary

#: The word pattern of byte-level vocabularies; {w} is white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{w}\p{{L}}\p{{N}}]+|[{w}]+(?![^{w}])|[{w}]+"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


#: Strings that are one word, so that the pattern needn't look.
SIMPLE = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Strings whose words share one trie, which bounds its memory.
TRIE_WORDS = 200_000
#: Bytes that are looked at for the shared start of two words; longer starts are encoded again.
SHARED = 24


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = byte_letters(), file["model"]
        ids = model["vocab"]
        as_bytes = {t: bytes(letters[c] for c in t) for t in ids}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.bytes[i] = as_bytes[t]
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        #: (left, right) -> rank of the merge; token -> its two halves and rank.
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[ids[left], ids[right]] = r
            self.halves.setdefault(ids[left + right], (ids[left], ids[right], r))
        self._link(sorted((as_bytes[t], i) for t, i in ids.items()))
        self.word = regex.compile(WORD.format(w=WS))
        #: Special tokens, each of which has "<" in it.
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.raw_ids = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.known: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.edges: dict[int, tuple[list, list]] = {}

    def spines(self, token: int) -> tuple[list, list]:
        """Parts of a token along its right and its left edge, each with the rank of the merge that takes it in."""
        if token not in self.edges:
            sides = []
            for side in (1, 0):
                part, until, out = token, len(self.rank), []
                while True:
                    out.append((part, until))
                    if part not in self.halves:
                        break
                    until = self.halves[part][2]
                    part = self.halves[part][side]
                sides.append(out)
            self.edges[token] = tuple(sides)
        return self.edges[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay apart: no merge across their border comes before both of its parts are taken in.  At the same rank the merge further left comes first."""
        rank, found = self.rank, True
        for x, x_until in self.spines(left)[0]:
            for y, y_until in self.spines(right)[1]:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    found = False
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[left << 32 | right] = found
        return found

    def _link(self, tokens: list[tuple[bytes, int]]) -> None:
        """The vocabulary as a trie with links to the longest proper suffix that is in it; ends has, longest first, the tokens that are suffixes of a node."""
        self.below: list[dict[int, int]] = [{}]
        self.suffix, self.ends, whole, depth = [0], [()], {}, [0]
        for t, i in tokens:
            at = 0
            for b in t:
                to = self.below[at].get(b)
                if to is None:
                    to = self.below[at][b] = len(self.below)
                    self.below.append({})
                    self.suffix.append(0)
                    self.ends.append(())
                    depth.append(depth[at] + 1)
                at = to
            whole[at] = i
        for at in sorted(range(len(depth)), key=depth.__getitem__):
            for b, to in self.below[at].items():
                if at:
                    back = self.suffix[at]
                    while back and b not in self.below[back]:
                        back = self.suffix[back]
                    self.suffix[to] = self.below[back].get(b, 0)
                self.ends[to] = (((depth[to], whole[to]),) if to in whole else ()) + self.ends[self.suffix[to]]

    def step(self, at: int, byte: int) -> int:
        """The node of the longest suffix after one byte more."""
        back = at
        while back and byte not in self.below[back]:
            back = self.suffix[back]
        if len(self.steps) > 500_000:
            self.steps.clear()
        to = self.steps[at << 8 | byte] = self.below[back].get(byte, 0)
        return to

    def encode_words(self, words) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of every distinct word."""
        coded = sorted((w.encode(), w) for w in words)
        if not coded:
            return {}
        lengths = np.fromiter((len(raw) for raw, _ in coded), np.int64, len(coded))
        heads = np.array([raw for raw, _ in coded], f"S{SHARED}").view(np.uint8).reshape(-1, SHARED)
        differ = np.ones((len(coded), SHARED + 1), bool)
        differ[1:, :SHARED] = heads[1:] != heads[:-1]
        shared = np.minimum(differ.argmax(1), lengths)
        shared[1:] = np.minimum(shared[1:], lengths[:-1])
        shared[0] = 0
        out: dict[str, bytes] = {}
        # By depth: the node of the vocabulary, the token that ends the prefix, and where that token starts.
        deepest = int(lengths.max()) + 1
        node, last, start = [0] * deepest, [-1] * deepest, [0] * deepest
        steps, known, ends, raw_ids = self.steps, self.known, self.ends, self.raw_ids
        for (raw, word), depth in zip(coded, shared.tolist(), strict=True):
            state = node[depth]
            for byte in raw[depth:]:
                depth += 1
                at = steps.get(state << 8 | byte)
                state = node[depth] = self.step(state, byte) if at is None else at
                for size, token in ends[state]:
                    at = depth - size
                    if at:
                        apart = known.get(last[at] << 32 | token)
                        if apart is None:
                            apart = self.apart(last[at], token)
                        if not apart:
                            continue
                    last[depth], start[depth] = token, at
                    break
            ids = []
            while depth:
                ids.append(raw_ids[last[depth]])
                depth = start[depth]
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def learn(self, strings: list[str]) -> list[bytes]:
        """Ids of strings that may hold special tokens; words that they share are encoded once, TRIE_WORDS strings to a trie."""
        if len(strings) > TRIE_WORDS:
            return [x for i in range(0, len(strings), TRIE_WORDS) for x in self.learn(strings[i : i + TRIE_WORDS])]
        find, simple, words, odd = self.word.findall, SIMPLE.fullmatch, [], {}
        for s in strings:
            if simple(s):
                words.append((s,))
            elif "<" in s and self.cut is not None and self.cut.search(s):
                odd[s] = [p if p in self.special else find(p) for p in self.cut.split(s) if p]
                words.append([w for ws in odd[s] if not isinstance(ws, str) for w in ws])
            else:
                words.append(find(s))
        ids = self.encode_words({w for ws in words for w in ws})
        known = ids.__getitem__
        return [known(s) if len(ws) == 1 and ws[0] == s else b"".join(map(known, ws)) if s not in odd else b"".join(self.raw_ids[self.special[p]] if isinstance(p, str) else b"".join(map(known, p)) for p in odd[s]) for s, ws in zip(strings, words, strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def trie_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(vocabulary(path).learn)


#: Bytes of text that a worker encodes together.
TRIE_CHUNK = 4_000_000


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Encode every text: the id column and ids (binary, little-endian unsigned 32-bit).

    decoded: also return the text that the ids decode to, as decode() gives it,
    from the same worker.  Null text: no ids.  A special token's string in a
    text gets the special token's id.  Rows keep their number and partition;
    repeated rows are encoded each; an empty table gives none.  Other columns
    are dropped.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        tokens = vocabulary(vocab_path).bytes
        for batch in batches:
            for at, ids, offsets in trie_encoder(vocab_path).encode(batch.column(1), TRIE_CHUNK):
                columns = [batch.column(0).slice(at, len(offsets) - 1), as_binary(ids, offsets)]
                if decoded:
                    columns.append(pa.array([text_of(tokens, ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded string" * decoded)


def text_of(tokens: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids to text: the id column, ids and decoded (string).

    Special tokens are written out.  Bytes that aren't UTF-8 become U+FFFD.
    Null ids give empty text; an id outside the vocabulary fails the job.
    """
    kind = dict(encoded.dtypes)[id_col]

    def run(batches):
        tokens = vocabulary(vocab_path).bytes
        for batch in batches:
            texts = [text_of(tokens, np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")
