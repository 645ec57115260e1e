"""Packing, token store and BPE against the tokenizers library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from wayfold.llm import bpe, packing, token_store, vocab

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*" \n\t  'abcsdTRE", "é", "\xa0", "　", "\x1c", "\x85", "ß", "Σ", "ς", "1", "٣", "!?", "<|", "<|endoftext|>", "<|startoftext|>", "'ll", "́", "   ", "\r\n", "中文", "😀", "İ", "the ", "tion"]


def texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def encoded(encoder, strings):
    out = []
    for _, ids, offsets in encoder.encode(pa.array(strings, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_gives_the_library_ids(path):
    strings = texts(4000) + ["", "a" * 5000, " " * 300]
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(strings, add_special_tokens=False)]
    assert encoded(vocab.encoder(path), strings) == expected


def test_trie_gives_the_library_ids_and_text():
    strings = texts(4000, 6) + ["", "ab" * 4000, "\n" * 200, None]
    library = Tokenizer.from_file(BYTE)
    expected = [e.ids for e in library.encode_batch([s or "" for s in strings], add_special_tokens=False)]
    assert encoded(bpe.trie_encoder(BYTE), strings) == expected
    tokens = bpe.vocabulary(BYTE).bytes
    assert [bpe.text_of(tokens, np.array(x, "<u4")) for x in expected] == library.decode_batch(expected, skip_special_tokens=False)


def test_trie_shares_prefixes():
    found = bpe.vocabulary(BYTE).encode_words(["", " in", " inter", " international", " internationally", "in"])
    library = Tokenizer.from_file(BYTE)
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in found.items()} == {w: library.encode(w, add_special_tokens=False).ids for w in found}


def documents(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 7))] + [(100, None), (101, ""), (101, "twice"), (101, "twice"), (None, "no id"), (102, "word " * 9000)]
    return spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int"), rows


def test_bpe_on_spark(spark):
    docs, rows = documents(spark)
    library = Tokenizer.from_file(BYTE)
    out = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    expected = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out) == expected
    assert bpe.encode(docs.limit(0), BYTE).count() == 0


def test_first_fit_decreasing_is_that():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    rooms, expected = [], {}
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        k = next((k for k, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        if k == len(rooms):
            rooms.append(100)
        expected[i] = (k, 100 - rooms[k])
        rooms[k] -= lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == [expected[i] for i in range(300)]


def test_packing_holds_every_id_once(spark):
    docs, rows = documents(spark)
    library = Tokenizer.from_file(WORD)
    out = packing.pack(docs, WORD, capacity=64, group_pieces=50).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        assert r.length == len(r.ids) // 4
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sorted(x for i, t in rows for x in library.encode(t or "", add_special_tokens=False).ids + [2])
    assert sorted(x for ps in pieces.values() for _, ids, _ in ps for x in ids) == total
    long = library.encode("word " * 9000, add_special_tokens=False).ids + [2]
    assert [x for _, ids, _ in sorted(pieces[102]) for x in ids] == long and {n for _, _, n in pieces[102]} == {len(long)}
    filled = packing.padding(packing.pack(docs, WORD, capacity=64, group_pieces=50), 64).first()
    assert filled.ids == len(total) and filled.sequences == len(sequences)
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_store_round_trip(spark, tmp_path):
    docs, rows = documents(spark)
    library = Tokenizer.from_file(BYTE)
    path = f"file://{tmp_path}/store"
    manifest = token_store.write_store(docs, path, BYTE, shard_bytes=400)
    assert len(manifest) > 1
    out = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r in out:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert ids == sorted(ids)
    expected = sorted((-1 if i is None else i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in rows)
    assert sorted((i, zlib.crc32(r.ids)) for i, r in zip(ids, out, strict=True)) == expected
    shard = token_store.Shard(path, manifest[0]["name"])
    assert shard.document(0) == out[0].ids
    assert token_store.write_store(docs.limit(0), f"{path}-empty", BYTE) == []
    assert token_store.read_store(spark, f"{path}-empty").count() == 0


def test_store_refuses_another_dictionary(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    manifest = token_store.write_store(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path, BYTE)
    (tmp_path / "store" / "dictionary").write_bytes(b"other")
    token_store._dictionary.cache_clear()
    with pytest.raises(ValueError):
        token_store.Shard(path, manifest[0]["name"])


def test_dictionary_helps_short_documents():
    samples = [np.arange(i % 50, i % 50 + 200, dtype="<u4").tobytes() for i in range(400)]
    assert len(token_store.train_dictionary(samples)) > 0
    assert token_store.train_dictionary([]) == b""
