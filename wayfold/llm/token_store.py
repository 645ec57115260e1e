"""A binary store of token ids: one zstandard frame per document, a shared dictionary, an index by position.

A store is a folder:

``dictionary``      the zstandard dictionary (may be empty)
``shard-NNNNN.tok`` magic, SHA-256 of the dictionary, the frames, the index, the footer
``manifest.json``   the shards in order, with their counts

The index holds, for each document in order, its id and whether it is null,
where its frame starts, and its number of ids.  The footer holds the index's
place, the number of documents and the magic once more.  A reader opens the
footer and the index, then reads only the frames that it wants.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, written
from .vocab import encoder

MAGIC = b"WFTOK\x00\x00\x01"
FOOTER, FOOTER_SIZE = "<QQ8s", struct.calcsize("<QQ8s")
#: Documents that the dictionary is trained on, at most, and ids of each: a bounded sample; it bears on size alone.
DICTIONARY_DOCS, DICTIONARY_IDS, DICTIONARY_BYTES = 1000, 2048, 112_640


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    system, at = _open(path)
    with system.open_output_stream(at) as out:
        out.write(data)


def _get(path: str) -> bytes:
    system, at = _open(path)
    with system.open_input_stream(at) as f:
        return f.read()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; empty where there is too little to learn from."""
    import zstandard

    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16_384:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _sample(docs: DataFrame, vocab_path: str, end: bytes, id_col: str, text_col: str) -> list[bytes]:
    """Serialized ids of some DICTIONARY_DOCS documents, spread over the table by a hash of the id."""
    rows = docs.select(id_col).count()
    every = max(1, rows // (2 * DICTIONARY_DOCS))
    some = docs.select(text_col).where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).limit(DICTIONARY_DOCS)

    def run(batches):
        enc = encoder(vocab_path)
        for batch in batches:
            for _, ids, offsets in enc.encode(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([(ids[a:b].tobytes() + end)[: 4 * DICTIONARY_IDS] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["ids"])

    return sorted(bytes(r[0]) for r in some.mapInArrow(run, "ids binary").collect())


def write_store(docs: DataFrame, path: str, vocab_path: str, end_id: int = 2, shard_bytes: int = 32 << 20, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every text with the tokenizers library, append end_id, and write a store at path.

    Documents stand in ascending order of the id, nulls first; repeated ids by
    their number of ids, then a hash of their frames.  Documents are encoded and
    compressed where they are read; only frames are sorted (a range partition
    for each shard_bytes of frames, one shard each).  A shard appears under its
    name when it is whole, so a task may be run again.

    Null or empty text: the end id alone.  An empty table gives a store without
    documents.  Other columns are not read.  Returns the manifest.
    """
    spark, end, kind = docs.sparkSession, int(end_id).to_bytes(4, "little"), dict(docs.dtypes)[id_col]
    path = path if "://" in path else f"file://{path}"
    dictionary = train_dictionary(_sample(docs, vocab_path, end, id_col, text_col))
    system, at = _open(path)
    system.create_dir(at, recursive=True)
    _put(f"{path}/dictionary", dictionary)
    sha = hashlib.sha256(dictionary).digest()

    def compress(batches):
        import zstandard

        enc = encoder(vocab_path)
        shared = zstandard.ZstdCompressionDict(_dictionary(path, sha)) if dictionary else None
        tool = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        for batch in batches:
            for at, ids, offsets in enc.encode(batch.column(1)):
                frames = [tool.compress(ids[a:b].tobytes() + end) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(frames)).cast(pa.int64()), pa.array(np.diff(offsets) + 1), pa.array(frames, pa.binary())], names=["id", "n", "frame"])

    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number, not {kind}")
    frames = written(docs.select(id_col, text_col).mapInArrow(compress, "id long, n long, frame binary"), "frames", "none")
    total = frames.select(F.sum(F.octet_length("frame").cast("long"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    order = [F.col("id").asc_nulls_first(), F.col("n"), F.xxhash64("frame")]  # rows of one id may lie in several shards
    ordered = frames.repartitionByRange(shards, *order).sortWithinPartitions(*order, "frame")

    def save(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, at = _open(path)
        name, ids, null, starts, counts = f"shard-{part:05d}.tok", [], [], [], []
        where = 8 + len(sha)
        with system.open_output_stream(f"{at}/.{name}.{attempt}") as out:
            out.write(MAGIC + sha)
            for batch in batches:
                for i, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids.append(i or 0)
                    null.append(i is None)
                    starts.append(where)
                    counts.append(n)
                    out.write(frame)
                    where += len(frame)
            for column, form in ((ids, "<i8"), (starts, "<u8"), (counts, "<u8"), (null, "u1")):
                out.write(np.array(column, form).tobytes())
            out.write(struct.pack(FOOTER, where, len(ids), MAGIC))
        if ids:
            if system.get_file_info(f"{at}/{name}").is_file:  # another attempt at this task has written the same bytes
                system.delete_file(f"{at}/.{name}.{attempt}")
            else:
                system.move(f"{at}/.{name}.{attempt}", f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(ids)], "ids": [sum(counts)]})
        else:
            system.delete_file(f"{at}/.{name}.{attempt}")

    manifest, start = [], 0
    for row in sorted(ordered.mapInArrow(save, "part long, name string, docs long, ids long").collect()):
        manifest.append({"name": row["name"], "docs": row["docs"], "ids": row["ids"], "start": start})
        start += row["ids"]
    _put(f"{path}/manifest.json", json.dumps({"dictionary_sha256": sha.hex(), "shards": manifest}).encode())
    remove(spark, frames._wayfold_path)
    return manifest


@lru_cache(maxsize=4)
def _dictionary(path: str, sha: bytes) -> bytes:
    data = _get(f"{path}/dictionary")
    if hashlib.sha256(data).digest() != sha:
        raise ValueError("the dictionary isn't the one that the store was written with")
    return data


class Shard:
    """One shard, open for reading: its index, and single documents by position."""

    def __init__(self, path: str, name: str):
        import zstandard

        system, at = _open(path)
        self.file = system.open_input_file(f"{at}/{name}")
        size = self.file.size()
        where, n, magic = struct.unpack(FOOTER, self._read(size - FOOTER_SIZE, FOOTER_SIZE))
        sha = self._read(0, 40)
        if magic != MAGIC or sha[:8] != MAGIC:
            raise ValueError(f"{name} is not a shard")
        index = self._read(where, 25 * n)
        self.ids, self.starts, self.counts, self.null = (np.frombuffer(index, form, n, place) for form, place in (("<i8", 0), ("<u8", 8 * n), ("<u8", 16 * n), ("u1", 24 * n)))
        self.ends = np.append(self.starts[1:], np.uint64(where))
        shared = _dictionary(path, sha[8:])
        self.tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def document(self, i: int) -> bytes:
        """Ids of the document at a position, as bytes; reads that frame alone."""
        return self.tool.decompress(self._read(int(self.starts[i]), int(self.ends[i] - self.starts[i])))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit).

    Shards are read by one task each, and a shard's frames a few megabytes at a time.
    """
    path = path if "://" in path else f"file://{path}"
    shards = json.loads(_get(f"{path}/manifest.json"))["shards"]
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    rows = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long").repartitionByRange(len(shards), "start")

    def run(batches):
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, at = Shard(path, name), 0
                begins = start + np.concatenate([[0], np.cumsum(shard.counts)]).astype(np.int64)
                while at < len(shard.ids):
                    to, size = at, 0
                    while to < len(shard.ids) and size < 8_000_000:
                        size += 4 * int(shard.counts[to])
                        to += 1
                    yield pa.RecordBatch.from_arrays([pa.array(shard.ids[at:to], mask=shard.null[at:to].astype(bool)), pa.array(begins[at:to]), pa.array(shard.counts[at:to].astype(np.int64)), pa.array([shard.document(i) for i in range(at, to)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at = to

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
