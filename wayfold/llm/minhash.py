"""Near duplicates by b-bit MinHash: bands give candidates, packed low bits estimate, full shingle sets confirm."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, mixed, written

#: Minima of a signature; bands of ROWS minima each; low bits kept of a minimum.
MINIMA, BANDS, ROWS, BITS = 128, 25, 5, 4
LONGS = MINIMA * BITS // 64
WORDS = 5
#: An estimate may fall short of the threshold by so much before a pair is dropped: over five standard deviations, so that this loses less than the bands do.
MARGIN = 0.2

#: Parts of the hash space in which a set's shingles are counted.
PARTS = 64

SIGNATURE = [f"s{i}" for i in range(LONGS)]


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Yield each text's shingle set as sorted distinct 64-bit hashes.

    A-Z are lower-cased; words are runs of characters other than blanks, tabs
    and line ends (ASCII).  A text of fewer words than a shingle has is one
    shingle; a text without words has none.
    """
    import xxhash

    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at, steps = 0, [np.uint64(x) for x in mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)]
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 6_000_000, "right")))
        cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.slice(at, to - at)))
        offsets = np.asarray(cut.offsets, np.int64)
        coded = cut.flatten().dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        h = hashes[coded.indices.to_numpy()]
        offsets = offsets - offsets[0]
        n = max(0, len(h) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += h[k : k + n] * steps[k]
        rolled = mixed(rolled)
        for i in range(to - at):
            a, b = offsets[i], offsets[i + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b - a == 1 and not texts[at + i].as_py().strip(" \t\n\r\x0b\x0c"):
                yield np.zeros(0, np.uint64)
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mixed(short * steps[0] + h[k])
                yield short
            else:
                yield np.zeros(0, np.uint64)
        at = to


def sketch_parameters() -> tuple[np.ndarray, np.ndarray]:
    """For each minimum, what its permutation of 32-bit values flips and (odd) multiplies by."""
    x = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
    return (x[:MINIMA] >> np.uint64(32)).astype(np.uint32), (x[MINIMA:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed low bits of all minima (LONGS values) and the key of each band."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    minima = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        minima = np.minimum(minima, ((low[None, at : at + 2048] ^ flips[:, None]) * factors[:, None]).min(axis=1))
    bits = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, -1)
    packed = (bits << (np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(BITS))[None, :]).sum(axis=1, dtype=np.uint64)
    rows = minima[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return packed.view(np.int64), keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_hash (binary; null without words), the signature's longs, keys (one for each band) and counts (shingles in each of PARTS of the hash space)."""

    def run(batches):
        import xxhash

        flips, factors = sketch_parameters()
        for batch in batches:
            count, sets, packed, keys, parts = [], [], [], [], []
            for s in shingle_sets(batch.column(1)):
                count.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                a, b = sketch(s, flips, factors) if len(s) else (np.zeros(LONGS, np.int64), np.zeros(0, np.int64))
                packed.append(a)
                keys.append(b)
                parts.append(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS))
            table = np.array(packed, np.int64).reshape(len(count), LONGS)
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            counted = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * PARTS, pa.int32()), pa.array(np.array(parts, np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(sets, pa.binary()), *(pa.array(table[:, i]) for i in range(LONGS)), flat, counted], names=["doc_id", "n_shingles", "set_hash", *SIGNATURE, "keys", "counts"])

    fields = ", ".join(f"{s} long" for s in SIGNATURE)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"doc_id long, n_shingles long, set_hash binary, {fields}, keys array<long>, counts array<int>")


def estimate(a: str, b: str) -> str:
    """SQL of the similarity of two signatures: equal minima by bit counts, less what low bits agree on by chance."""
    differ = []
    for s in SIGNATURE:
        x, mask = f"({a}.{s} ^ {b}.{s})", "0x1111111111111111"
        lanes = " | ".join(f"shiftrightunsigned({x}, {k})" if k else x for k in range(BITS))
        differ.append(f"bit_count(({lanes}) & {int(mask, 16)}L)")
    chance = 2.0**-BITS
    return f"((({MINIMA} - ({' + '.join(differ)})) / {MINIMA}.0D - {chance}D) / {1 - chance}D)"


def may_link(a: str, b: str, percent: int) -> str:
    """SQL: whether two classes may be linked, by their sizes, their estimate, and their counts.

    Counts that differ by d in all mean d shingles at least that only one set
    has; a link allows (100 - percent) / (100 + percent) of both sizes.  Sizes
    and counts never turn a link away.
    """
    sizes = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
    differ = f"aggregate(zip_with({a}.counts, {b}.counts, (x, y) -> abs(x - y)), 0, (s, d) -> s + d)"
    return f"{sizes} and {estimate(a, b)} >= {percent / 100 - MARGIN} and {100 + percent} * {differ} <= {100 - percent} * ({a}.n + {b}.n)"


#: Parts into which the rows of one key are dealt where they meet their group.
SALTS = 64


def grouped(rows: DataFrame, key: str, ident: str, name: str, how: str) -> DataFrame:
    """Rows with the smallest ident of their key as name, if the key has two rows or more; others have none (left) or are left out (inner).

    A key's rows are dealt to SALTS parts, counted by part and then by key, and
    each part is joined by itself, so that no key is one task's.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "_part").agg(F.count("*").alias("_c"), F.min(ident).alias("_m"))
    whole = Window.partitionBy(key)
    groups = parts.select(key, "_part", F.sum("_c").over(whole).alias("_c"), F.min("_m").over(whole).alias(name)).where("_c > 1").drop("_c")
    return dealt.join(groups, [key, "_part"], how).drop("_part")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the near-duplicate group that they are in.

    Two documents are linked if their sets of 5-word shingles have a Jaccard
    similarity of percent / 100 or more.  Returns doc_id, n_shingles (size of
    its set), class_id (smallest id of the documents with the same set),
    component_id (smallest id reachable by links, itself included) and kept
    (doc_id = component_id).

    Documents with equal sets form a class, and one stands for all.  Classes
    that share a band are candidates: first each bucket's smallest id against
    the others, next the smallest id that this left outside, then all pairs
    that are still in different components.  A pair whose estimate is far below
    the threshold, or whose shingles can't be common enough by their counts, is
    dropped; full sets decide on the others.  Pairs within a
    component that is known by then needn't be compared, so a group of n near
    copies takes a few times n comparisons.  At the threshold a pair shares no
    band with probability (1 - similarity ** 5) ** 25, 4.9e-5 at 0.8 and 4.3e-7
    at 0.85, and its estimate drops it with 2.0e-7 and 1.9e-8 (binomial tails):
    4.9e-5 and 4.5e-7 in all.

    Null text and text without words: an empty set, linked with nothing.  A
    null id is never linked; its component is null and it is kept.  Rows that
    share an id are one document, whose links are those of all its rows, and
    each row is returned.  Other columns aren't read.  An empty table gives none.
    """
    found = written(sketches(docs, id_col, text_col), "sketches")
    linkable = found.where("set_hash is not null and doc_id is not null")
    same = grouped(linkable, "set_hash", "doc_id", "class_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    none = found.where("set_hash is null or doc_id is null").withColumn("class_id", F.lit(None).cast("long"))
    classed = written(same.unionByName(none).withColumn("keys", F.expr("if(doc_id = class_id, keys, null)")).drop("set_hash"), "classes")
    reps = classed.where("doc_id = class_id").dropDuplicates(["doc_id"])
    signed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "counts", *SIGNATURE)

    rows = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    buckets = written(grouped(rows, "key", "id", "center", "inner"), "buckets")
    members = buckets.select("id").distinct()
    sets = written(shingle_arrays(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(members, "id", "left_semi")).dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs a, b (columns of a bucket's side each, with signatures), those that are links."""
        near = may_link("a", "b", percent)
        likely = pairs.join(signed.alias("a"), F.expr("a.id = ida")).join(signed.alias("b"), F.expr("b.id = idb")).where(near).select("ida", "idb")
        both = likely.join(sets.select(F.col("id").alias("idb"), F.col("shingles").alias("sb")), "idb").join(sets.select(F.col("id").alias("ida"), F.col("shingles").alias("sa")), "ida")
        both = both.withColumn("common", F.expr("size(array_intersect(sa, sb))"))
        return both.where(f"100 * common >= {percent} * (size(sa) + size(sb) - common)").select(F.col("ida").alias("a"), F.col("idb").alias("b"))

    # A class's own smallest center first: one pair for each class, however many bands it shares.
    pairs = buckets.where("id <> center").groupBy(F.col("id").alias("idb")).agg(F.min("center").alias("ida"))
    links = written(confirmed(pairs), "links")
    roots = connected_components(links)
    for step in ("center", "outside", "outside", "all"):
        open_ = still_open(buckets, roots)
        if not open_.limit(1).count():
            break
        if step == "all":
            pairs = open_pairs(open_, signed, percent)
        elif step == "center":
            pairs = one_each(open_.where("root <> center_root").select("id", F.col("center").alias("other"), F.col("center_root").alias("other_root")))
        else:
            outside = open_.where("root <> center_root").groupBy("key").agg(F.min_by(F.struct("id", "root"), F.struct(F.xxhash64("id", "key", F.lit(step)), "id")).alias("o"))
            pairs = one_each(open_.join(outside, "key").where("root <> o.root").select("id", F.col("o.id").alias("other"), F.col("o.root").alias("other_root")))
        more = written(confirmed(pairs.select(F.least("ida", "idb").alias("ida"), F.greatest("ida", "idb").alias("idb")).distinct()), "links")
        if more.limit(1).count():
            links = links.union(more)
            roots = connected_components(links)
    out = classed.join(roots.select(F.col("id").alias("class_id"), F.col("component").alias("root")), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def still_open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that still have more than one component: key, center, id, root, center_root."""
    rooted = written(buckets.join(roots, "id", "left").select("key", "center", "id", F.coalesce("component", "id").alias("root")), "rooted")
    mixed_ = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.expr("if(id = center, root, null)")).alias("center_root")).where("low <> high").select("key", "center_root")
    return written(rooted.join(mixed_, "key"), "open")


def one_each(candidates: DataFrame) -> DataFrame:
    """Of candidates (id, other, other_root) one for each id and component of the others: ida, idb."""
    best = candidates.groupBy("id", "other_root").agg(F.min("other").alias("other"))
    return best.select(F.col("other").alias("ida"), F.col("id").alias("idb"))


def open_pairs(open_: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components whose estimate passes; one side is outside its center's component.

    A pair comes from the first of the buckets that both share, not from each:
    all buckets of a pair in different components are open.
    """
    mine = open_.groupBy("id").agg(F.collect_set("key").alias("mine"))  # BANDS at most
    rows = open_.join(signed.join(mine, "id"), "id").withColumn("outside", F.expr("root <> center_root"))
    likely = f"a.root <> b.root and (not b.outside or a.id < b.id) and {may_link('a', 'b', percent)} and array_min(array_intersect(a.mine, b.mine)) = a.key"
    return rows.where("outside").alias("a").join(rows.alias("b"), F.expr(f"a.key = b.key and {likely}")).select(F.col("a.id").alias("ida"), F.col("b.id").alias("idb"))


def shingle_arrays(docs: DataFrame) -> DataFrame:
    """id and shingles (array of long, sorted as unsigned, distinct) of documents (id, text)."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))], names=["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of docs, one of each group of near duplicates: that with the smallest id; all columns."""
    dropped = near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)
